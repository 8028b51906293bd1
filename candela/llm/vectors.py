"""Shared preparation of vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v array<double>) of the rows with an id and a vector that is not null or zero
    and holds no null or non-finite component. Vectors of another length than the commonest
    (the shorter on ties) take no part."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    v = v.where("vec_id is not null and v is not null and forall(v, x -> x is not null and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    sizes = v.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return v.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def one_each(vectors: DataFrame) -> DataFrame:
    """One row an id: of rows that share it, the least vector."""
    return vectors.groupBy("vec_id").agg(F.min("v").alias("v"))


def copies(vectors: DataFrame, keep: int) -> DataFrame:
    """(rep, v, ids, n): each distinct vector with its least id, its `keep` least ids and how
    many rows have it. The limit is applied before the shuffle, so a hot vector stays small."""
    first = vectors.withColumn("rn", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("rn") <= keep)
    ids = first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    n = vectors.groupBy("v").agg(F.count("*").alias("n"))
    return ids.join(n, "v").select(F.element_at("ids", 1).alias("rep"), "v", "ids", "n")
