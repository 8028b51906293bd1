"""What passes between the stages of a study: candidate choice, result completeness, order,
review sheets and roles. Contracts come as one audit row of counts, all 0 in a sound table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import SHA256
from .contracts import HASHES, ContractError, require_columns

DONE = ("OK", "SKIPPED")
#: Volumes are equal within the sum of both.
RELATIVE, ABSOLUTE = 1e-6, 1e-3


def choose_candidate(candidates: DataFrame, by=("case_id",)) -> DataFrame:
    """One row a case: (name, n_candidates, policy, error). A single candidate is taken as it is.
    Of several the three-dimensional one with the most voxels, then the greatest volume; where
    others tie with it, the only one of them with _eq in its name. Without a three-dimensional
    one, or with ties that the name does not settle, error says so and name is null.

    candidates: by, name, ndim, voxel_count, volume. A null ndim is not three-dimensional."""
    require_columns(candidates, (*by, "name", "ndim", "voxel_count", "volume"), "candidates")
    solid = F.coalesce(F.col("ndim") == 3, F.lit(False))
    best = candidates.groupBy(*by).agg(F.count("*").alias("n_candidates"), F.first("name").alias("only"), F.count_if(solid).alias("n_solid"), F.max(F.when(solid, F.struct("voxel_count", "volume"))).alias("best"))
    close = F.abs(F.col("volume") - F.col("best.volume")) <= F.lit(ABSOLUTE) + F.lit(RELATIVE) * F.abs(F.col("best.volume"))
    tied = solid & (F.col("voxel_count") == F.col("best.voxel_count")) & close
    even = tied & F.contains(F.lower("name"), F.lit("_eq"))
    rows = candidates.join(best, list(by)).groupBy(*by).agg(
        F.first("n_candidates").alias("n_candidates"), F.first("only").alias("only"), F.first("n_solid").alias("n_solid"),
        F.count_if(tied).alias("n_tied"), F.min(F.when(tied, F.col("name"))).alias("tied"), F.count_if(even).alias("n_even"), F.min(F.when(even, F.col("name"))).alias("even"),
    )
    single = F.col("n_candidates") == 1
    name = F.when(single, F.col("only")).when(F.col("n_tied") == 1, F.col("tied")).when(F.col("n_even") == 1, F.col("even"))
    error = F.when(single | (F.col("n_tied") == 1) | (F.col("n_even") == 1), F.lit("")).when(F.col("n_solid") == 0, "not_3d").otherwise("ambiguous")
    return rows.select(*by, name.alias("name"), "n_candidates", F.when(single, "single_output").otherwise("largest_3d").alias("policy"), error.alias("error"))


def result_audit(results: DataFrame, cases: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """One row of how results depart from the cases: both have case_id and their input order in
    `ordinal`; results a status and the hash columns. A row is misplaced if the other table has
    another case at its ordinal."""
    require_columns(results, ("case_id", ordinal, "status", *HASHES), "results")
    has = lambda c: F.coalesce(F.col(c).rlike(SHA256), F.lit(False))
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    all_hashes, any_hash = has(HASHES[0]), some(HASHES[0])
    for c in HASHES[1:]:
        all_hashes, any_hash = all_hashes & has(c), any_hash | some(c)
    right = cases.select(F.col(ordinal).alias(ordinal), F.col("case_id").alias("_case"), F.lit(True).alias("_wanted"))
    left = results.withColumn("_given", F.lit(True))
    both = left.join(right, ordinal, "full")
    done, given = F.col("status").isin(*DONE), F.col("_given").isNotNull()
    return both.agg(
        F.count_if(~given).alias("missing"),
        F.count_if(F.col("_wanted").isNull()).alias("extra"),
        F.count_if(given & F.col("_wanted").isNotNull() & ~F.equal_null("case_id", "_case")).alias("misplaced"),
        F.count_if(given & ~F.coalesce(F.col("status").isin(*DONE, "ERROR"), F.lit(False))).alias("unknown_status"),
        F.count_if(done & ~all_hashes).alias("done_without_hash"),
        F.count_if((F.col("status") == "ERROR") & any_hash).alias("failed_with_hash"),
    )


def require_complete_results(results: DataFrame, cases: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    bad = {k: v for k, v in result_audit(results, cases, ordinal).first().asDict().items() if v}
    if bad:
        raise ContractError("results: " + ", ".join(f"{k} {v}" for k, v in bad.items()))
    return results


def first_rows(df: DataFrame, n: int | None, ordinal: str = "ordinal") -> DataFrame:
    """The first n rows in input order, all without n; fewer than one is an error."""
    if n is None:
        return df
    if n < 1:
        raise ContractError("at least one case is taken")
    return df.orderBy(ordinal).limit(n)


def lookup_in_order(queries: DataFrame, rows: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Each query with its row of the other table, ordinal kept so that the input order can be
    told; an absent or repeated row, one that is not done or is no POST scan is an error."""
    once = rows.groupBy("case_id").agg(F.count("*").alias("_n"), F.first(F.struct(*[c for c in rows.columns if c != "case_id"])).alias("_row"))
    out = queries.select(ordinal, "case_id").join(once, "case_id", "left")
    bad = (
        F.when(F.col("_n").isNull(), "absent").when(F.col("_n") > 1, "repeated")
        .when(~F.coalesce(F.col("_row.status").isin(*DONE), F.lit(False)), "not done").when(~F.coalesce(F.col("_row.pre_0_post_1") == 1, F.lit(False)), "no POST scan")
    )
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("query "), F.col("case_id"), F.lit(" is "), bad)).cast("string")).otherwise(F.col("case_id"))
    return out.select(ordinal, checked.alias("case_id"), "_row.*")


def masked_review_sheet(pairs: DataFrame, fields) -> DataFrame:
    """A review sheet of the locked pairs (person_id, pre_case_id, post_case_id) with every answer
    empty: nothing of a matching outcome is in it."""
    return pairs.select("person_id", "pre_case_id", "post_case_id", *[F.lit("").alias(c) for c in ("reviewer_id", "review_date", *fields)])


def analysis_role(policy: Column, representation: Column, configurations: Column, locked) -> Column:
    """primary for the primary policy with area-normalised features and exactly the locked
    (mode, h) configurations, each once; else sensitivity."""
    want = F.array_sort(F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(h).alias("h")) for m, h in locked]))
    same = (policy == "primary") & (representation == "area_normalized") & (F.array_sort(configurations) == want)
    return F.when(F.coalesce(same, F.lit(False)), "primary").otherwise("sensitivity")


def load_ranks(table: DataFrame, configured: bool = False) -> DataFrame:
    """Rank rows with trimmed ids: one positive rank a person, and where configured the case, the
    selected mode and a positive whole h; anything else is an error."""
    ids = ("query_person", *(("query_case", "selected_mode") if configured else ()))
    require_columns(table, (*ids, "true_rank", *(("selected_harmonic",) if configured else ())), "ranks")
    rank = F.col("true_rank").try_cast("double")
    h = F.col("selected_harmonic").try_cast("double") if configured else F.lit(1.0)
    bad = table.agg(
        F.sum(sum((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "").cast("int") for c in ids)).alias("blank"),
        (F.count("*") - F.count_distinct(F.trim(F.col("query_person").cast("string")))).alias("repeated"),
        F.count_if(~F.coalesce((rank > 0) & ~F.isnan(rank), F.lit(False))).alias("bad_rank"),
        F.count_if(~F.coalesce((h > 0) & (h == F.floor(h)), F.lit(False))).alias("bad_harmonic"),
    ).first()
    if any(bad):
        raise ContractError(f"ranks: {bad.asDict()}")
    out = table.withColumns({**{c: F.trim(F.col(c).cast("string")) for c in ids}, "true_rank": rank})
    return out.withColumn("selected_harmonic", h.cast("int")).select("query_case", "query_person", "selected_mode", "selected_harmonic", "true_rank") if configured else out.select(F.col("query_person").alias("person_id"), "true_rank")


def with_input_order(df: DataFrame, order, ordinal: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 by `order`: each range of it is numbered by itself and starts from
    the number of rows before, so no task sorts the whole table."""
    names = [order] if isinstance(order, str) else list(order)
    n = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = df.repartitionByRange(n, *names).withColumn("_part", F.spark_partition_id()).persist()
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # n rows at most
    starts = ranged.groupBy("_part").agg(F.count("*").alias("_m")).select("_part", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    return ranged.join(F.broadcast(starts), "_part").withColumn(ordinal, F.col("_start") + inside - 1).drop("_part", "_start")
