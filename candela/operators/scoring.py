"""Leave-one-person-out scaling, distances, scores and their fusion.

Features are long rows of arrays: (case_id, person_id, view, h, f array<double>). The fit
set of a query is every reference of another person. Instead of joining each query with its
fit set, the two extreme values of distinct persons are kept for each feature: a query of
the person that holds the first extreme takes the second.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VIEWS = ("cor", "sag", "axial")
#: Order matters for ties: single views first, then pairs, then all.
MODES = ("cor", "sag", "axial", "cor_sag", "cor_axial", "sag_axial", "cor_sag_axial")
BLOCK_ROWS = 2048


def modes_table(spark, modes=MODES) -> DataFrame:
    return spark.createDataFrame([(m, i, len(m.split("_")), v) for i, m in enumerate(modes) for v in m.split("_")], "mode string, mode_order int, n_views int, view string")


def to_arrays(wide: DataFrame, blocks: dict[tuple[str, int], list[str]], keep=("case_id", "person_id")) -> DataFrame:
    """Wide feature columns as one row a (case, view, h)."""
    parts = F.array(*[F.struct(F.lit(v).alias("view"), F.lit(h).alias("h"), F.array(*[F.col(c).cast("double") for c in cols]).alias("f")) for (v, h), cols in blocks.items()])
    return wide.select(*keep, F.explode(parts).alias("b")).select(*keep, "b.view", "b.h", "b.f")


def extremes(gallery: DataFrame) -> DataFrame:
    """(view, h, lo1, lo1_person, lo2, hi1, hi1_person, hi2): arrays over the features. lo2 and
    hi2 are null where one person is all there is. One row a view: small whatever the gallery."""
    per = gallery.select("view", "h", "person_id", F.posexplode("f").alias("i", "x")).groupBy("view", "h", "i", "person_id").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    first = per.groupBy("view", "h", "i").agg(F.min(F.struct("lo", "person_id")).alias("a"), F.max(F.struct("hi", "person_id")).alias("b"))
    both = per.join(first, ["view", "h", "i"])
    second = both.groupBy("view", "h", "i").agg(
        F.first("a").alias("a"), F.first("b").alias("b"),
        F.min(F.when(F.col("person_id") != F.col("a.person_id"), F.col("lo"))).alias("lo2"),
        F.max(F.when(F.col("person_id") != F.col("b.person_id"), F.col("hi"))).alias("hi2"),
    )
    packed = F.array_sort(F.collect_list(F.struct("i", F.col("a.lo").alias("lo1"), F.col("a.person_id").alias("lo1_person"), "lo2", F.col("b.hi").alias("hi1"), F.col("b.person_id").alias("hi1_person"), "hi2")))
    return second.groupBy("view", "h").agg(packed.alias("x")).select("view", "h", *[F.col(f"x.{c}").alias(c) for c in ("lo1", "lo1_person", "lo2", "hi1", "hi1_person", "hi2")])


def scaler(persons: DataFrame, gallery: DataFrame, person: str = "person_id") -> DataFrame:
    """persons x views: lo and hi of the fit set without that person. persons needs one
    column of distinct ids; a person whose fit set is empty gets nulls."""
    pick = lambda one, who, two: F.transform(F.arrays_zip(F.col(one).alias("a"), F.col(who).alias("w"), F.col(two).alias("b")), lambda x: F.when(x["w"] == F.col(person), x["b"]).otherwise(x["a"]))
    return persons.select(person).crossJoin(F.broadcast(extremes(gallery))).select(person, "view", "h", pick("lo1", "lo1_person", "lo2").alias("lo"), pick("hi1", "hi1_person", "hi2").alias("hi"))


def sound(f: Column, what: str) -> Column:
    """The features; a null, NaN or infinite one is an error, as it would rank anywhere."""
    bad = F.exists(f, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(f.isNull() | bad, F.raise_error(F.lit(f"{what} features are not finite")).cast("array<double>")).otherwise(f)


def weights(lo: Column, hi: Column, spread: bool = False) -> Column:
    """1 / range of each feature; a constant feature counts with its difference as it is. An
    empty fit set is an error, and with `spread` one without any feature that varies, as any
    with fewer than two references is."""
    each = F.transform(F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda x: F.when(x["hi"] > x["lo"], 1.0 / (x["hi"] - x["lo"])).otherwise(1.0))
    fail = lambda text: F.raise_error(F.lit(text)).cast("array<double>")
    out = F.when(F.exists(lo, lambda x: x.isNull()), fail("the scaler has no reference but the person's own")).otherwise(each)
    if not spread:
        return out
    flat = ~F.exists(F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda x: x["hi"] > x["lo"])
    return F.when(flat, fail("all features are constant, or a single reference is left, without the person")).otherwise(out)


#: So many features are written out as column arithmetic, which Spark compiles.
WRITTEN_OUT = 64


def distance(q: Column, r: Column, w: Column, size: int | None = None) -> Column:
    """Weighted Euclidean distance of arrays; size bounds their length, where it is known."""
    if size is None or size > WRITTEN_OUT:
        zipped = F.arrays_zip(q.alias("q"), r.alias("r"), w.alias("w"))
        return F.sqrt(F.aggregate(zipped, F.lit(0.0), lambda acc, x: acc + ((x["q"] - x["r"]) * x["w"]) * ((x["q"] - x["r"]) * x["w"])))
    total = F.lit(0.0)
    for i in range(size):
        part = (F.get(q, F.lit(i)) - F.get(r, F.lit(i))) * F.get(w, F.lit(i))
        total = total + F.coalesce(part * part, F.lit(0.0))  # null beyond the end of a shorter view
    return F.sqrt(total)


def meet(left: DataFrame, right: DataFrame, left_rows: int, right_rows: int, on=(), block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every left row with every right row of equal `on`: the rows are dealt to a grid of
    blocks and joined by cell, so no side is broadcast and no cell holds more than a block."""
    a, b = max(1, -(-left_rows // block_rows)), max(1, -(-right_rows // block_rows))
    x = left.withColumns({"_a": F.pmod(F.xxhash64(*left.columns), F.lit(a)).cast("int"), "_b": F.explode(F.sequence(F.lit(0), F.lit(b - 1)))})
    y = right.withColumns({"_b": F.pmod(F.xxhash64(*right.columns), F.lit(b)).cast("int"), "_a": F.explode(F.sequence(F.lit(0), F.lit(a - 1)))})
    return x.join(y, ["_a", "_b", *on]).drop("_a", "_b")


def views_audit(features: DataFrame, views=VIEWS) -> DataFrame:
    """One row: the cases and h of features, and by view how many lack it or have it more than once;
    all 0 where modes of these views can be ranked."""
    by = features.groupBy("case_id", "h").agg(*[F.count_if(F.col("view") == v).alias(v) for v in views])
    return by.agg(F.count("*").alias("n"), *[F.count_if(F.col(v) == 0).alias(f"n_without_{v}") for v in views], *[F.count_if(F.col(v) > 1).alias(f"n_repeated_{v}") for v in views])


def view_scores(queries: DataFrame, gallery: DataFrame, fit: DataFrame | None = None, digits: int | None = None, spread: bool = True) -> DataFrame:
    """(query_case, query_person, db_case, db_person, view, h, distance, score, n_features) of
    every query with the whole gallery; score = 1 / (1 + distance).

    The scaler leaves out the query's person; `fit` (person_id, view, h, lo, hi) replaces it.
    Features that are not finite fail, and so do fit sets as weights says.
    digits rounds distance and score, where another engine must find the same ties."""
    fit = scaler(queries.select("person_id").distinct(), gallery) if fit is None else fit
    asked = queries.join(fit, ["person_id", "view", "h"])
    asked = asked.select(F.col("case_id").alias("query_case"), F.col("person_id").alias("query_person"), "view", "h", sound(F.col("f"), "query").alias("q"), weights(F.col("lo"), F.col("hi"), spread).alias("w"))
    held = gallery.select(F.col("case_id").alias("db_case"), F.col("person_id").alias("db_person"), "view", "h", sound(F.col("f"), "gallery").alias("r"))
    facts = gallery.agg(F.count("*").alias("n"), F.max(F.size("f")).alias("size")).first()
    pairs = meet(asked, held, queries.count(), facts["n"], on=("view", "h"))
    d = distance(F.col("q"), F.col("r"), F.col("w"), facts["size"] or 0)
    d = d if digits is None else F.round(d, digits)
    s = 1.0 / (1.0 + F.col("distance"))
    return pairs.withColumn("distance", d).select("query_case", "query_person", "db_case", "db_person", "view", "h", "distance", (s if digits is None else F.round(s, digits)).alias("score"), F.size("q").alias("n_features"))


def fused_scores(scores: DataFrame, modes: DataFrame, keys=("query_case", "query_person", "db_case", "db_person"), digits: int | None = None) -> DataFrame:
    """By mode and h: one view passes through; several average their scores, with the distance
    that the average stands for and the features of all. A pair needs every view of the modes,
    once: a view that is missing or repeated fails by name, as a mean of fewer would rank."""
    rows = modes.collect()  # a few rows
    views = sorted({r["view"] for r in rows})
    parts = sorted({(r["mode_order"], r["mode"], r["n_views"]) for r in rows})

    def one(v, c):
        here = F.when(F.col("view") == v, F.col(c))
        fail = lambda what: F.raise_error(F.concat(F.lit(f"view {v} {what}: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))).cast("double")
        return F.when(F.count(here) > 1, fail("is repeated")).otherwise(F.coalesce(F.first(here, ignorenulls=True), fail("is missing"))).alias(f"{c}_{v}")

    wide = scores.where(F.col("view").isin(views)).groupBy(*keys, "h").agg(*[one(v, c) for v in views for c in ("score", "distance", "n_features")])

    def fuse(order, mode, n):
        own = [r["view"] for r in rows if r["mode"] == mode]
        add = lambda c: sum((F.col(f"{c}_{v}") for v in own[1:]), F.col(f"{c}_{own[0]}"))
        mean = add("score") / n if digits is None else F.round(add("score") / n, digits + 3)  # three digits more: an average of rounded scores is no rounding tie there
        return F.struct(F.lit(mode).alias("mode"), F.lit(order).alias("mode_order"), F.lit(n).alias("n_views"), (F.col(f"score_{own[0]}") if n == 1 else mean).alias("score"), F.col(f"distance_{own[0]}").alias("d1"), add("n_features").cast("long").alias("n_features"))

    out = wide.select(*keys, "h", F.explode(F.array(*[fuse(*p) for p in parts])).alias("x")).select(*keys, "h", "x.*")
    single = F.col("n_views") == 1
    equal = 1.0 / F.least(F.greatest(F.col("score"), F.lit(1e-12)), F.lit(1.0)) - 1.0
    return out.select(*keys, "mode", "mode_order", "n_views", "h", F.when(single, F.col("d1")).otherwise(equal if digits is None else F.round(equal, digits)).alias("distance"), F.when(single, "distance").otherwise("equivalent_distance").alias("distance_kind"), "score", "n_features")
