"""Summaries for reports and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import finite, share_text


def exact_quantiles(df: DataFrame, value: str, probs, by=(), accuracy: int = 10_000) -> DataFrame:
    """(by, n, q): the quantiles by linear interpolation as an array in the order of probs; nulls
    are skipped, a group of nulls alone has nulls, and without groups so has an empty table.

    No task holds a group's values. A mergeable sketch says between which values each rank lies;
    values below are only counted, and of those between, equal ones one row each, running counts
    find the rank. A sketch that misses a rank fails by name. The input is read twice."""
    probs = [float(p) for p in probs]
    by = list(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).where("_x is not null")
    wide = [min(1.0, max(0.0, p + d)) for p in probs for d in (-3.0 / accuracy, 3.0 / accuracy)]
    ends = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min("_x").alias("_min"), F.max("_x").alias("_max"), F.percentile_approx("_x", wide, accuracy).alias("_w"))
    # a small group has all its values between the ends
    few = F.col("n") <= accuracy
    cuts = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.when(few, F.col("_min")).otherwise(F.col("_w")[2 * i]).alias("lo"), F.when(few, F.col("_max")).otherwise(F.col("_w")[2 * i + 1]).alias("hi")) for i, p in enumerate(probs)])
    cells = ends.select(*[F.col(c).alias(f"_by_{c}") for c in by], "n", F.explode(cuts).alias("_c")).select(*[f"_by_{c}" for c in by], "n", "_c.*")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    kept = F.when(F.col("_x") < F.col("lo"), F.lit(None)).otherwise(F.col("_x"))
    met = rows.join(F.broadcast(cells) if not by else cells, same).where("_x <= hi").withColumn("_v", kept)
    keys = [f"_by_{c}" for c in by] + ["i", "p", "n"]
    counted = met.groupBy(*keys, "_v").agg(F.count("*").alias("_k"))
    order = Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    run = counted.withColumn("_to", F.sum("_k").over(order))
    at = F.col("p") * (F.col("n") - 1)
    first = lambda rank: F.min_by("_v", F.when(F.col("_to") > rank, F.col("_to")))
    found = run.groupBy(*keys).agg(first(F.floor(at)).alias("_a"), first(F.ceil(at)).alias("_b"))
    sure = lambda c: F.coalesce(c, F.raise_error(F.lit("a rank lies outside the sketch's bounds")).cast("double"))
    part = at - F.floor(at)
    q = F.when(part == 0, sure(F.col("_a"))).otherwise((1 - part) * sure(F.col("_a")) + part * sure(F.col("_b")))
    each = found.select(*[F.col(f"_by_{c}").alias(c) for c in by], "n", "i", q.alias("q"))
    out = each.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda s: s["q"]).alias("q"))  # one entry a probability
    groups = df.select(*by).distinct() if by else df.agg(F.lit(0).alias("_one")).select()  # without groups one row
    aside = out.select(*[F.col(c).alias(f"_by_{c}") for c in by], "n", "q")
    return groups.join(aside, same, "left").select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("q", F.array(*[F.lit(None).cast("double")] * len(probs))).alias("q"))


def quartiles(df: DataFrame, value: str, by=(), unit: str = "s", status: str | None = None, done=("success",)) -> DataFrame:
    """n, q1, median, q3 by linear interpolation. A value that is missing or not finite fails, and
    where a status column is named, so does a row that isn't done."""
    x = F.col(value).cast("double")
    fail = lambda text: F.raise_error(F.lit(text)).cast("double")
    sound = F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), fail(f"{value} has values that are no numbers")).otherwise(x)
    if status:
        sound = F.when(~F.coalesce(F.lower(F.trim(status)).isin(*done), F.lit(False)), fail("some rows have no success")).otherwise(sound)
    rows = df.select(*by, sound.alias("_x"))
    return exact_quantiles(rows, "_x", (0.25, 0.5, 0.75), by).select(*by, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), F.lit(unit).alias("unit"))


def distribution(df: DataFrame, metrics: list[str], by=()) -> DataFrame:
    """Metric x group: n, median, q1, q3, min, max."""
    long = df.unpivot(list(by), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value").withColumn("value", finite(F.col("value")))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = long.groupBy(*by, "metric").agg(F.count("value").alias("n"), q.alias("q"), F.min("value").alias("min"), F.max("value").alias("max"))
    return out.select(*by, "metric", "n", F.col("q")[1].alias("median"), F.col("q")[0].alias("q1"), F.col("q")[2].alias("q3"), "min", "max")


def pose_summary(df: DataFrame, value: str, threshold: float, dataset: str = "dataset") -> DataFrame:
    """Overall and by dataset: n, median, max, min and how many exceed the threshold."""
    x = finite(F.col(value))
    spread = df.select(x.alias("x"), F.explode(F.array(F.lit("overall"), F.col(dataset))).alias("group"))
    return spread.where("group is not null").groupBy("group").agg(F.count("x").alias("n"), F.median("x").alias("median"), F.max("x").alias("max"), F.min("x").alias("min"), F.count_if(F.col("x") > threshold).alias("n_above"))


def projection_summary(df: DataFrame, components: dict[str, str], discarded: dict[str, str], threshold: float) -> DataFrame:
    """By view: rows, rows of more than one component, rows that discard more than the
    threshold, and the greatest discarded share."""
    views = F.array(*[F.struct(F.lit(v).alias("view"), F.col(components[v]).cast("double").alias("c"), finite(F.col(discarded[v]).cast("double")).alias("d")) for v in components])
    return df.select(F.explode(views).alias("x")).select("x.*").groupBy("view").agg(F.count("c").alias("n"), F.count_if(F.col("c") > 1).alias("n_multiple"), F.count_if(F.col("d") > threshold).alias("n_above"), F.max("d").alias("max_discarded"))


def rank1_matrix(summary: DataFrame, h_values) -> DataFrame:
    """Modes x h with texts like 3/75 (4.0%)."""
    cells = summary.withColumn("cell", share_text(F.col("rank1_count"), F.col("n")))
    return cells.groupBy("mode_order", "mode").pivot("h", list(h_values)).agg(F.first("cell")).withColumnsRenamed({str(h): f"h{h}" for h in h_values})


def value_counts(df: DataFrame, fields: list[str]) -> DataFrame:
    """(field, value, n, percent) over closed-domain columns."""
    long = df.unpivot([], [F.col(f).cast("string").alias(f) for f in fields], "field", "value")
    n = df.agg(F.count("*").alias("total"))
    return long.groupBy("field", "value").agg(F.count("*").alias("n")).crossJoin(F.broadcast(n)).select("field", "value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))


def review_overview(review: DataFrame, reviewer: str, findings: dict[str, dict[str, str]]) -> DataFrame:
    """One row: n_reviewed, n_reviewers (nulls are none) and, for each finding {column: value},
    how many reviews have the value in any of its columns. A null is no finding."""
    any_of = {name: F.greatest(*[F.col(c).eqNullSafe(v) for c, v in columns.items()], F.lit(False)) for name, columns in findings.items()}
    return review.agg(F.count("*").alias("n_reviewed"), F.count_distinct(reviewer).alias("n_reviewers"), *[F.count_if(x).alias(name) for name, x in any_of.items()])


def crosstab(df: DataFrame, group: str, labels: tuple[str, str], findings: list[str]) -> DataFrame:
    """Two fixed groups of a boolean x findings: n_group, n, percent; an empty group stays,
    with null percents."""
    spark = df.sparkSession
    fixed = spark.createDataFrame([(labels[0], f) for f in findings] + [(labels[1], f) for f in findings], "group string, finding string")
    named = df.withColumn("group", F.when(F.col(group), labels[0]).otherwise(labels[1]))
    sums = named.groupBy("group").agg(F.count("*").alias("n_group"), *[F.count_if(F.col(f)).alias(f) for f in findings])
    long = sums.unpivot(["group", "n_group"], findings, "finding", "n")
    out = fixed.join(long, ["group", "finding"], "left").na.fill(0, ["n_group", "n"])
    return out.withColumn("percent", F.try_divide(100.0 * F.col("n"), F.col("n_group")))


def tail_queries(ranks: DataFrame, flags: list[str], above: float = 10, expected: int | None = None) -> DataFrame:
    """Queries ranked beyond `above` with the whole part of their rank and whether all flags hold."""
    every = F.lit(True)
    for f in flags:
        every = every & F.coalesce(F.col(f), F.lit(False))
    out = ranks.where(F.col("true_rank") > above).withColumns({"rank_floor": F.floor("true_rank").cast("long"), "all_flags": every})
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"{n} tail queries, not {expected}")
    return out
