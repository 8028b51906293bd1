"""How the driver's tables stand in for cases: a user is a person, the events before the
split date are the PRE scan, the others the POST scan; even users are institutional, with
both scans, odd users are distractors, with the PRE scan. Views are shares of event types,
statistics of the value and shares of day times; h says how finely."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPLIT = "2024-01-16"
TYPES = ("click", "purchase", "view", "signup", "error")
H_VALUES = (2, 4)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a (user, half) with all feature columns; one aggregation of events, kept by
    Spark (on disk where memory is short), as scaler, queries and gallery all read it."""
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    flag = (F.col("ts") >= F.lit(SPLIT).cast("timestamp_ntz")).cast("int")
    r = lambda c: F.round(c, 9)
    share = lambda c: r(F.count_if(c) / F.count("*"))
    hour = F.hour("ts")
    out = e.groupBy("user_id", flag.alias("pre_0_post_1")).agg(
        F.count("*").alias("n_events"),
        *[share(F.col("event_type") == t).alias(f"cor_H4_{t}") for t in TYPES],
        r(F.avg("value")).alias("sag_H4_avg"), r(F.stddev_samp("value")).alias("sag_H4_std"), F.max("value").alias("sag_H4_max"), r(F.median("value")).alias("sag_H4_median"),
        *[share(F.floor(hour / 4) == i).alias(f"axial_H2_b{i:02d}") for i in range(6)],
        *[share(F.floor(hour / 2) == i).alias(f"axial_H4_b{i:02d}") for i in range(12)],
    )
    return out.select(
        F.concat(F.lit("U"), "user_id", F.when(F.col("pre_0_post_1") == 1, "_POST").otherwise("_PRE")).alias("case_id"), F.concat(F.lit("U"), "user_id").alias("person_id"),
        F.col("pre_0_post_1").cast("byte").alias("pre_0_post_1"), F.when(F.col("user_id") % 2 == 0, "institutional").otherwise("distractor").alias("dataset"), *[c for c in out.columns if c not in ("user_id", "pre_0_post_1")],
    ).persist()


BLOCKS = {
    ("cor", 2): ["cor_H4_click", "cor_H4_purchase"], ("cor", 4): [f"cor_H4_{t}" for t in TYPES],
    ("sag", 2): ["sag_H4_avg", "sag_H4_std"], ("sag", 4): ["sag_H4_avg", "sag_H4_std", "sag_H4_max", "sag_H4_median"],
    ("axial", 2): [f"axial_H2_b{i:02d}" for i in range(6)], ("axial", 4): [f"axial_H4_b{i:02d}" for i in range(12)],
}

#: The same in SQL: wide(case_id, person_id, user_id, flag, dataset, ...) and long features.
WIDE_SQL = f"""wide as (
  select 'U' || user_id || case when flag = 1 then '_POST' else '_PRE' end as case_id, 'U' || user_id as person_id, flag, case when user_id % 2 = 0 then 'institutional' else 'distractor' end as dataset, n_events,
    {', '.join(f"cor_H4_{t}" for t in TYPES)}, sag_H4_avg, sag_H4_std, sag_H4_max, sag_H4_median, {', '.join(f"axial_H2_b{i:02d}" for i in range(6))}, {', '.join(f"axial_H4_b{i:02d}" for i in range(12))}
  from (select user_id, (ts >= timestamp '{SPLIT}')::int as flag, count(*) as n_events,
    {', '.join(f"round(sum((event_type = '{t}')::int)::double / count(*), 9) as cor_H4_{t}" for t in TYPES)},
    round(avg(value), 9) as sag_H4_avg, round(stddev_samp(value), 9) as sag_H4_std, max(value) as sag_H4_max, round(median(value), 9) as sag_H4_median,
    {', '.join(f"round(sum((hour(ts) // 4 = {i})::int)::double / count(*), 9) as axial_H2_b{i:02d}" for i in range(6))},
    {', '.join(f"round(sum((hour(ts) // 2 = {i})::int)::double / count(*), 9) as axial_H4_b{i:02d}" for i in range(12))}
    from events where user_id is not null and ts is not null group by all))"""
LONG_SQL = WIDE_SQL + ", feats as (" + " union all ".join(f"select case_id, person_id, flag, dataset, '{v}' as view, {h} as h, {i} as i, {c} as x from wide" for (v, h), cols in BLOCKS.items() for i, c in enumerate(cols)) + """
), q as (select * from feats where flag = 1 and dataset = 'institutional'), g as (select * from feats where flag = 0)"""


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scoring import to_arrays

    return to_arrays(wide_cases(spark, sf_dir), BLOCKS, ("case_id", "person_id", "pre_0_post_1", "dataset"))


def queries_and_gallery(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """POST scans of institutional people against all PRE scans."""
    f = features(spark, sf_dir)
    keep = ("case_id", "person_id", "view", "h", "f")
    return f.where("pre_0_post_1 = 1 and dataset = 'institutional'").select(*keep), f.where("pre_0_post_1 = 0").select(*keep)


def supplier_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clouds: a supplier is a case, its lines are points, tilted and longest upwards."""
    z = (F.col("l_partkey") % 97).cast("double")
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey is not null")
    return lines.select(F.concat(F.lit("S"), "l_suppkey").alias("case_id"), (F.col("l_quantity") + 0.25 * z).alias("x"), (300 * F.col("l_discount") + 0.125 * z).alias("y"), z.alias("z"))


def supplier_voxels(spark: SparkSession, sf_dir: str, coarse: bool = False) -> DataFrame:
    """Foreground voxels: a supplier is a case, its lines are voxels of a grid of 51 x 11 x 97, or
    coarse of 11 x 11 x 11."""
    i, k = (F.floor(F.col("l_quantity") / 5), 11) if coarse else (F.col("l_quantity"), 97)
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey is not null")
    return lines.select(F.col("l_suppkey").alias("case_id"), i.cast("int").alias("i"), (F.col("l_discount") * 100).cast("int").alias("j"), (F.col("l_partkey") % k).cast("int").alias("k")).distinct()


def vector_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids: the first nine components of a vector are the axes, the next three the origin."""
    v = table(spark, sf_dir, "embeddings").where("vec_id is not null and size(embedding) >= 12")
    e = lambda n: F.col("embedding")[n].cast("double")
    return v.select(F.col("vec_id").alias("case_id"), *[F.lit(n).alias(f"n{a}") for a, n in zip("ijk", (51, 11, 97))], *[e(3 * w + j).alias(f"m{w}{j}") for w in range(3) for j in range(3)], *[e(9 + w).alias(f"t{w}") for w in range(3)])


def supplier_sizes(voxels: DataFrame) -> DataFrame:
    """Sizes of voxels that differ by case."""
    key = F.col("case_id")
    return voxels.select("case_id").distinct().select("case_id", (0.75 + 0.25 * (key % 4)).alias("si"), (0.5 + 0.5 * (key % 3)).alias("sj"), (0.8 + 0.4 * (key % 5)).alias("sk"))


def customer_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed curves: a customer's orders in order of their keys."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").where("o_custkey is not null and o_orderkey is not null")
    seq = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("curve"), seq.cast("long").alias("seq"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 101).cast("double").alias("y"))


CLOUD_SQL = """points as (select 'S' || l_suppkey as case_id, l_quantity + 0.25::double * (l_partkey % 97) as x, 300::double * l_discount + 0.125::double * (l_partkey % 97) as y, (l_partkey % 97)::double as z from lineitem where l_suppkey is not null)"""
CURVE_SQL = """curves as (select o_custkey as curve, row_number() over (partition by o_custkey order by o_orderkey) - 1 as seq, o_totalprice / 1000 as x, (o_orderkey % 101)::double as y from orders where o_custkey is not null and o_orderkey is not null)"""
VOXEL_SQL = """voxels as (select distinct l_suppkey as case_id, trunc(l_quantity)::int as i, trunc(l_discount * 100)::int as j, (l_partkey % 97)::int as k from lineitem where l_suppkey is not null)"""
COARSE_SQL = """voxels as (select distinct l_suppkey as case_id, floor(l_quantity / 5)::int as i, trunc(l_discount * 100)::int as j, (l_partkey % 11)::int as k from lineitem where l_suppkey is not null)"""
SIZES_SQL = """sizes as (select distinct case_id, 0.75::double + 0.25::double * (case_id % 4) as si, 0.5::double + 0.5::double * (case_id % 3) as sj, 0.8::double + 0.4::double * (case_id % 5) as sk from voxels)"""
