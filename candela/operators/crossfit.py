"""Nested cross-fitted choice of a configuration, and its audit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import extremes, modes_table, scaler, sound, weights

CONFIG = ("mode", "mode_order", "n_views", "h")


def _side_by_side(df: DataFrame, keys, views, value, prefix: str) -> DataFrame:
    """One row a key with a column for each view; a view that is missing or repeated fails by name."""

    def one(v):
        here = F.when(F.col("view") == v, value)
        fail = lambda what: F.raise_error(F.concat(F.lit(f"view {v} {what}: "), F.concat_ws(" ", *[F.col(k).cast("string") for k in keys]))).cast("array<double>")
        return F.when(F.count(here) > 1, fail("is repeated")).otherwise(F.coalesce(F.first(here, ignorenulls=True), fail("is missing"))).alias(f"{prefix}_{v}")

    return df.groupBy(*keys).agg(*[one(v) for v in views])


@dataclass(frozen=True)
class _Plan:
    """What the blocks compare: for each mode its order, name, number of views and views."""

    modes: tuple[tuple[int, str, int, tuple[str, ...]], ...]
    digits: int | None

    @classmethod
    def of(cls, modes: DataFrame, digits: int | None) -> "_Plan":
        rows = modes.collect()  # a few rows
        names = sorted({(r["mode_order"], r["mode"], r["n_views"]) for r in rows})
        return cls(tuple((i, m, n, tuple(sorted(r["view"] for r in rows if r["mode"] == m))) for i, m, n in names), digits)

    @property
    def views(self) -> list[str]:
        return sorted({v for *_, parts in self.modes for v in parts})

    def similarity(self, q: np.ndarray, r: np.ndarray, w: np.ndarray) -> np.ndarray:
        """1 / (1 + distance) of arrays that broadcast over all but the last axis."""
        total = np.zeros(np.broadcast_shapes(q.shape[:-1], r.shape[:-1]))
        for i in range(q.shape[-1]):
            part = (q[..., i] - r[..., i]) * w[..., i]
            part *= part
            total += part
        d = np.sqrt(total, out=total)
        s = 1.0 / (1.0 + (d if self.digits is None else np.round(d, self.digits)))
        return s if self.digits is None else np.round(s, self.digits)

    def fused(self, by_view: dict[str, np.ndarray], parts: tuple[str, ...]) -> np.ndarray:
        if len(parts) == 1:
            return by_view[parts[0]]
        mean = sum((by_view[v] for v in parts[1:]), by_view[parts[0]]) / len(parts)
        return mean if self.digits is None else np.round(mean, self.digits + 3)

    def blocks(self, asked: pd.DataFrame, held: pd.DataFrame, rows: int = 256):
        """(slice of asked, mode number, scores, genuine scores) for runs of asked rows."""
        matrix = lambda df, c: np.stack(df[c].to_numpy()).astype(float)
        r = {v: matrix(held, f"r_{v}") for v in self.views}
        known = asked["known"].to_numpy(bool)
        for lo in range(0, len(asked), rows):
            part, here = asked.iloc[lo : lo + rows], slice(lo, lo + rows)
            own, others = {}, {}
            for v in self.views:
                q, w = matrix(part, f"q_{v}"), matrix(part, f"w_{v}")
                g = np.stack([x if k else y for x, y, k in zip(part[f"g_{v}"], q, known[here])]).astype(float)
                own[v] = self.similarity(q, g, w)
                others[v] = self.similarity(q[:, None], r[v][None], w[:, None])
            for n, (*_, parts) in enumerate(self.modes):
                yield here, n, self.fused(others, parts), self.fused(own, parts)


def _codes(*columns) -> list[np.ndarray]:
    """The values of columns as numbers of their own."""
    numbers = pd.factorize(np.concatenate([np.asarray(c, object) for c in columns]))[0]
    return np.split(numbers, np.cumsum([len(c) for c in columns])[:-1])


#: Pairs that are compared at once, in a core's cache.
PAIRS = 1 << 18
#: What three operations in single precision can move a score of at most 1.
SINGLE = 1e-6


def _places(mask: np.ndarray) -> np.ndarray:
    """Where a mask that is seldom true is, flat, by looking at eight at a time."""
    flat = mask.reshape(-1)
    whole = len(flat) // 8 * 8
    near = (8 * np.flatnonzero(flat[:whole].view(np.uint64))[:, None] + np.arange(8)).ravel()
    return np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])


class _Screen:
    """Which references of a block beat or equal the genuine score of each asked row, as blocks()
    would tell, mostly without its arithmetic.

    Queries of one scaler get their distances from one matrix product, and scores in single
    precision. Far more than their error above the genuine score is better, far more below is
    worse, and what lies between is scored by similarity(), whose word is the only one on ties."""

    def __init__(self, plan: _Plan, asked: pd.DataFrame, held: pd.DataFrame):
        matrix = lambda df, c: np.stack(df[c].to_numpy()).astype(float)
        self.plan = plan
        self.r, self.q, self.w = ({v: matrix(df, f"{c}_{v}") for v in plan.views} for df, c in ((held, "r"), (asked, "q"), (asked, "w")))
        known = asked["known"].to_numpy(bool)
        self.own = {v: plan.similarity(q, np.stack([x if k else y for x, y, k in zip(asked[f"g_{v}"], q, known)]).astype(float), self.w[v]) for v, q in self.q.items()}
        self.genuine = np.stack([plan.fused(self.own, parts) for *_, parts in plan.modes], 1)
        shape = max(1, PAIRS // len(held)), len(held)
        self.square, self.total, self.score = np.empty(shape), np.empty(shape, np.float32), {v: np.empty(shape, np.float32) for v in plan.views}
        self.above, self.level = np.empty((len(plan.modes), *shape), bool), np.empty(shape, bool)

    def _scaled(self, v: str, one: int) -> tuple[np.ndarray, np.ndarray, float]:
        """The block's references times the weights of an asked row, with what turns a product into
        squared distances, their centre, and the greatest squared length."""
        centre = self.r[v].mean(0)
        y = (self.r[v] - centre) * self.w[v][one]
        size = (y * y).sum(1)
        return np.concatenate([y, np.ones((len(y), 1)), size[:, None]], 1).T, centre, float(size.max())

    def runs(self):
        """(asked rows, mode number, which pairs are better for sure, then row, column and exact
        score of the pairs in question). Every other pair is worse. The pairs that are better for
        sure are overwritten by the next run."""
        every = np.concatenate([self.w[v] for v in self.plan.views], 1)
        kinds, kind = np.unique(every, axis=0, return_inverse=True)
        step, kind = len(self.square), kind.reshape(-1)
        order = np.argsort(kind, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(kind[order])) + 1):
            with np.errstate(all="ignore"):  # what overflows is not finite below
                scaled = {v: self._scaled(v, own[0]) for v in self.plan.views}
            for lo in range(0, len(own), step):
                yield from self._run(own[lo : lo + step], scaled)

    def _run(self, rows: np.ndarray, scaled: dict):
        score, slack = {}, {}
        for v, (y, centre, longest) in scaled.items():
            with np.errstate(all="ignore"):
                x = (self.q[v][rows] - centre) * self.w[v][rows]
                size = (x * x).sum(1)
                error = 4 * (len(y) + 4) * np.finfo(float).eps * (float(size.max()) + longest)
                s = self.score[v][: len(rows)]
                s[...] = np.matmul(np.concatenate([-2 * x, size[:, None], np.ones((len(x), 1))], 1), y, out=self.square[: len(rows)])
                np.sqrt(np.abs(s, out=s), out=s)
                s += np.float32(1)
                np.divide(np.float32(1), s, out=s)
            score[v], slack[v] = s, np.sqrt(error) + SINGLE + (0.0 if self.plan.digits is None else 2 * 10.0**-self.plan.digits)
        found = []
        for n, (*_, parts) in enumerate(self.plan.modes):
            total, better, level = score[parts[0]], self.above[n, : len(rows)], self.level[: len(rows)]
            for v in parts[1:]:
                total = np.add(total, score[v], out=self.total[: len(rows)])
            least, around = self.genuine[rows, n] * len(parts), sum(slack[v] for v in parts) + len(parts) * SINGLE
            if around < 0.1 * len(parts):
                np.greater(total, (least + around).astype(np.float32)[:, None], out=better)
                np.greater_equal(total, (least - around).astype(np.float32)[:, None], out=level)
                found.append(_places(np.not_equal(better, level, out=level)))
            else:  # features that are too large, or no numbers: all pairs are scored
                better[...] = False
                found.append(np.arange(total.size))
        row, column = np.divmod(np.concatenate(found), len(next(iter(self.r.values()))))
        exact = {v: self.plan.similarity(self.q[v][rows[row]], self.r[v][column], self.w[v][rows[row]]) for v in self.plan.views}
        hi = np.cumsum([len(at) for at in found])
        for n, (*_, parts) in enumerate(self.plan.modes):
            own = slice(hi[n] - len(found[n]), hi[n])
            yield rows, n, self.above[n, : len(rows)], row[own], column[own], self.plan.fused({v: exact[v][own] for v in parts}, parts)


def _count(plan: _Plan, keys: list[str], leave_out: str | None):
    """Counts of better and equal references of a block of asked rows in a block of the gallery."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        k = len(plan.modes)
        better, equal = np.zeros((len(asked), k), np.int64), np.zeros((len(asked), k), np.int64)
        n, own = np.full(len(asked), len(held), np.int64), np.full((len(asked), k), np.nan)
        if len(asked) and len(held):
            screen = _Screen(plan, asked, held)
            own, gone, out = screen.genuine, None, None
            if leave_out:
                gone, has = _codes(asked[leave_out], held["db_person"])
            for rows, m, sure, row, column, s in screen.runs():
                if gone is not None:
                    if m == 0:
                        out = gone[rows][:, None] == has[None, :]
                        n[rows] -= out.sum(1)
                    sure, stays = sure & ~out, ~out[row, column]
                    row, s = row[stays], s[stays]
                g = own[rows[row], m]
                better[rows, m] = [np.count_nonzero(x) for x in sure] + np.bincount(row, s > g, len(rows)).astype(np.int64)
                equal[rows, m] = np.bincount(row, s == g, len(rows))
        known = asked["known"].to_numpy(bool)[:, None]
        frame = asked[keys].copy()
        frame["n_gallery"] = n
        for name, x in (("better", better), ("equal", equal)):
            frame[name] = pd.Series(list(x * known), index=frame.index, dtype=object)
        frame["own"] = pd.Series(list(np.where(known, own, np.nan)), index=frame.index, dtype=object)
        return frame

    return run


def _held(gallery: DataFrame, views) -> DataFrame:
    return _side_by_side(gallery, ("case_id", "person_id", "h"), views, sound(F.col("f"), "gallery"), "r").withColumnsRenamed({"case_id": "db_case", "person_id": "db_person"})


def _with_genuine(asked: DataFrame, held: DataFrame, views) -> DataFrame:
    several = F.when(F.count("*") > 1, F.raise_error(F.lit("a query has several genuine references")).cast("boolean")).otherwise(True).alias("known")
    genuine = held.groupBy(F.col("db_person").alias("query_person"), "h").agg(several, *[F.first(f"r_{v}").alias(f"g_{v}") for v in views])
    return asked.join(genuine, ["query_person", "h"], "left").withColumn("known", F.coalesce("known", F.lit(False)))


#: A grid has so many cells at least, as far as blocks of asked rows can be cut.
CELLS, FEWEST = 64, 256


def _dealt(asked: DataFrame, held: DataFrame, asked_rows: int, gallery_rows: int, block_rows: int = 16_384):
    """Both sides dealt to a grid of blocks, cogrouped by cell: neither is broadcast, and a cell
    holds about a block of each. Where that gives few cells, blocks of asked rows are smaller."""
    b = max(1, -(-gallery_rows // block_rows))
    a = max(1, -(-asked_rows // block_rows), min(-(-CELLS // b), asked_rows // FEWEST))
    place = lambda df, n: F.pmod(F.xxhash64(*[c for c in df.columns if c.endswith(("case", "person", "fold"))]), F.lit(n)).cast("int")
    x = asked.withColumns({"_a": place(asked, a), "_b": F.explode(F.sequence(F.lit(0), F.lit(b - 1)))})
    y = held.withColumns({"_b": place(held, b), "_a": F.explode(F.sequence(F.lit(0), F.lit(a - 1)))})
    y = y.select(*[F.col(c).alias(c) for c in y.columns])  # columns of its own: both sides may stem from one table
    return x.groupBy("_a", "_b", "h").cogroup(y.groupBy("_a", "_b", "h"))


def _counts(asked: DataFrame, held: DataFrame, plan: _Plan, keys: list[str], asked_rows: int, gallery_rows: int, leave_out: str | None = None) -> DataFrame:
    """keys, h, n_gallery and, as arrays over the modes, better, equal and the genuine reference's
    own score (NaN without one). A block compares all views of one h with the query's genuine
    reference, so no other score is shuffled."""
    every = [*keys, "h"]
    types = {f.name: f.dataType.simpleString() for f in asked.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in every) + ", n_gallery long, better array<long>, equal array<long>, own array<double>"
    parts = _dealt(_with_genuine(asked, held, plan.views), held, asked_rows, gallery_rows).applyInPandas(_count(plan, every, leave_out), schema)
    total = lambda c: F.array(*[F.sum(F.col(c)[i]) for i in range(len(plan.modes))]).alias(c)
    return parts.groupBy(*every).agg(F.sum("n_gallery").alias("n_gallery"), total("better"), total("equal"), F.array(*[F.min(F.col("own")[i]) for i in range(len(plan.modes))]).alias("own"))


def _by_mode(counts: DataFrame, plan: _Plan, keys: list[str]) -> DataFrame:
    def row(n, i, m, views):
        b, e = F.col("better")[n], F.col("equal")[n]
        return F.struct(F.lit(m).alias("mode"), F.lit(i).alias("mode_order"), F.lit(views).alias("n_views"), F.when(e > 0, 1.0 + b + 0.5 * (e - 1)).alias("true_rank"), F.when(e > 0, e - 1).alias("n_ties"))

    rows = F.array(*[row(n, i, m, k) for n, (i, m, k, _) in enumerate(plan.modes)])
    return counts.select(*keys, "h", "n_gallery", F.explode(rows).alias("x")).select(*keys, "h", "x.*", "n_gallery")


def _asked(queries: DataFrame, views) -> DataFrame:
    return _side_by_side(queries, ("case_id", "person_id", "h"), views, sound(F.col("f"), "query"), "q").withColumnsRenamed({"case_id": "query_case", "person_id": "query_person"})


def _cases(df: DataFrame) -> int:
    return df.select("case_id").distinct().count()


def _fixed_counts(queries: DataFrame, gallery: DataFrame, plan: _Plan) -> DataFrame:
    fit = _side_by_side(scaler(queries.select("person_id").distinct(), gallery), ("person_id", "h"), plan.views, weights(F.col("lo"), F.col("hi")), "w")
    asked = _asked(queries, plan.views).join(fit.withColumnRenamed("person_id", "query_person"), ["query_person", "h"])
    return _counts(asked, _held(gallery, plan.views), plan, ["query_case", "query_person"], _cases(queries), _cases(gallery))


def fixed_configurations(queries: DataFrame, gallery: DataFrame, modes: DataFrame, digits: int | None = None) -> DataFrame:
    """True mid-rank of every query under every configuration, each scaled without its person.
    Features that are not finite and persons without another reference fail."""
    plan = _Plan.of(modes, digits)
    return _by_mode(_fixed_counts(queries, gallery, plan), plan, ["query_case", "query_person"])


def true_rank_table(queries: DataFrame, gallery: DataFrame, view: str, digits: int | None = None) -> DataFrame:
    """One row a query of one view and h: its rank from the blocks' counters, and the case and score
    of its genuine reference. No other score leaves a block."""
    plan = _Plan.of(modes_table(queries.sparkSession, (view,)), digits)
    c = _fixed_counts(queries, gallery, plan).select("query_case", "query_person", "n_gallery", *[F.col(x)[0].alias(x) for x in ("better", "equal", "own")])
    genuine = gallery.select(F.col("person_id").alias("query_person"), F.col("case_id").alias("matched_case"))
    known, equal = F.col("equal") > 0, F.col("equal")
    return c.join(genuine, "query_person", "left").select(
        "query_case", "query_person", F.when(known, 1.0 + F.col("better") + 0.5 * (equal - 1)).alias("true_rank"), F.when(known, equal - 1).otherwise(0).alias("n_ties"),
        F.coalesce("matched_case", F.lit("")).alias("matched_case"), F.when(known, F.col("own")).alias("matched_score"), known.alias("has_match_in_database"), "n_gallery",
    )


def _best(plan: _Plan, k: int):
    """Of each query the k best of a block, those that tie with the last by db_case, and with the
    first row of each score how many of the block have it."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        held = held.sort_values("db_case", kind="stable").reset_index(drop=True)
        row, column, scores, counts = [], [], [], []
        if len(asked) and len(held):
            for here, _, s, _ in plan.blocks(asked, held):
                for i, own in enumerate(s, here.start):
                    last = np.partition(own, len(own) - k)[len(own) - k] if len(own) > k else -np.inf
                    above, level = np.flatnonzero(own > last), np.flatnonzero(own == last)
                    at = np.concatenate([above[np.argsort(-own[above], kind="stable")], level[:k]])
                    new = np.flatnonzero(np.append(True, own[at][1:] != own[at][:-1]))
                    n = np.zeros(len(at), np.int64)
                    n[new] = np.diff(np.append(new, len(at)))
                    if len(level):
                        n[len(above)] = len(level)
                    row.append(np.full(len(at), i))
                    column.append(at)
                    scores.append(own[at])
                    counts.append(n)
        row, column, scores, counts = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((row, int), (column, int), (scores, float), (counts, np.int64)))
        out = asked[["query_case", "query_person"]].iloc[row].reset_index(drop=True)
        out[["db_case", "db_person"]] = held[["db_case", "db_person"]].iloc[column].reset_index(drop=True)
        return out.assign(score=scores, n=counts)

    return run


def top_k(queries: DataFrame, gallery: DataFrame, view: str, k: int = 10, digits: int | None = None) -> DataFrame:
    """ranking.top_k of one view and h, merged from the k best of each block. A score that is listed
    is counted in full: a block that leaves it out has k better ones."""
    spark = queries.sparkSession
    plan = _Plan.of(modes_table(spark, (view,)), digits)
    fit = _side_by_side(scaler(queries.select("person_id").distinct(), gallery), ("person_id", "h"), plan.views, weights(F.col("lo"), F.col("hi")), "w")
    asked = _asked(queries, plan.views).join(fit.withColumnRenamed("person_id", "query_person"), ["query_person", "h"])
    held = _held(gallery, plan.views)
    schema = "query_case string, query_person string, db_case string, db_person string, score double, n long"
    rows = _dealt(_with_genuine(asked, held, plan.views), held, _cases(queries), _cases(gallery)).applyInPandas(_best(plan, k), schema)
    same = rows.groupBy("query_case", "query_person", "score").agg(F.sum("n").alias("same"), F.slice(F.array_sort(F.collect_list(F.struct("db_case", "db_person"))), 1, k).alias("cases"))
    before = Window.partitionBy("query_case").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    listed = same.withColumn("better", F.coalesce(F.sum("same").over(before), F.lit(0))).where(F.col("better") < k)
    out = listed.select("query_case", "query_person", "score", "better", "same", F.posexplode("cases").alias("at", "x")).withColumn("display_order", (F.col("better") + F.col("at") + 1).cast("int")).where(F.col("display_order") <= k)
    return out.select("query_case", "query_person", "display_order", "x.db_case", "x.db_person", "score", (1 + F.col("better") + 0.5 * (F.col("same") - 1)).alias("midrank"), (F.col("same") - 1).alias("n_ties"), (F.col("query_person") == F.col("x.db_person")).alias("correct"))


def _below_genuine(plan: _Plan, shared):
    """Of each block the number of pairs, and twice the number of genuine scores above each pair's
    score in sum, ties half."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        total = 0
        if len(asked) and len(held):
            (view,), matrix = plan.views, lambda df, c: np.stack(df[c].to_numpy()).astype(float)
            q, w, r = matrix(asked, f"q_{view}"), matrix(asked, f"w_{view}"), matrix(held, f"r_{view}")
            step = max(1, PAIRS // len(held))
            for lo in range(0, len(asked), step):
                here = slice(lo, lo + step)
                total += _twice_above(plan.similarity(q[here, None], r[None], w[here, None]).ravel(), *shared.value)
        return pd.DataFrame({"n": [len(asked) * len(held)], "twice": [int(total)]})

    return run


def _twice_above(scores: np.ndarray, values: np.ndarray, counts: np.ndarray, above: np.ndarray) -> int:
    """Twice the genuine scores above each score, and once those equal to it, in sum. values: the
    distinct ones, ascending; above: how many there are from each value on, then 0."""
    at = np.searchsorted(values, scores)
    level = np.flatnonzero(values[np.minimum(at, len(values) - 1)] == scores)
    return int(2 * above[at].sum() - counts[np.minimum(at[level], len(values) - 1)].sum())


def pooled_auc(queries: DataFrame, gallery: DataFrame, view: str, digits: int | None = None) -> DataFrame:
    """inference.auc of all pairs of one view and h. The distinct genuine scores, one a query at most,
    go to every block, which counts its pairs against them: no pair's score leaves a block."""
    spark = queries.sparkSession
    plan = _Plan.of(modes_table(spark, (view,)), digits)
    fit = _side_by_side(scaler(queries.select("person_id").distinct(), gallery), ("person_id", "h"), plan.views, weights(F.col("lo"), F.col("hi"), True), "w")
    asked, held = _asked(queries, plan.views).join(fit.withColumnRenamed("person_id", "query_person"), ["query_person", "h"]), _held(gallery, plan.views)
    asked = _with_genuine(asked, held, plan.views).persist()

    def own(frames):
        for f in frames:
            if len(f):
                yield pd.DataFrame({"g": plan.similarity(*[np.stack(f[f"{c}_{view}"].to_numpy()).astype(float) for c in "qgw"])})

    genuine = asked.where("known").mapInPandas(own, "g double").groupBy("g").agg(F.count("*").alias("n")).toPandas().sort_values("g")
    values, counts = genuine["g"].to_numpy(float), genuine["n"].to_numpy(np.int64)
    above = np.append(counts[::-1].cumsum()[::-1], 0)
    n_genuine = int(above[0])
    if not n_genuine:
        values, counts, above = np.array([np.inf]), np.zeros(1, np.int64), np.zeros(2, np.int64)
    own_pairs = int(((2 * above[:-1] - counts) * counts).sum())
    blocks = _dealt(asked, held, _cases(queries), _cases(gallery)).applyInPandas(_below_genuine(plan, spark.sparkContext.broadcast((values, counts, above))), "n long, twice long")
    sums = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum(F.col("twice").cast("decimal(38,0)")).alias("twice"))
    g, i = F.lit(n_genuine).cast("long"), F.col("n") - n_genuine
    return sums.select(g.alias("n_genuine"), i.alias("n_impostor"), ((F.col("twice") - own_pairs).cast("double") / 2 / F.nullif(g.cast("double") * i, F.lit(0.0))).alias("auc"))


def summarize_configurations(ranks: DataFrame, digits: int = 12) -> DataFrame:
    """By configuration: counts and rates at 1, 5 and 10, median and mean rank, mean log rank."""
    hit = lambda k: F.count_if(F.coalesce(F.col("true_rank") <= k, F.lit(False)))
    out = ranks.groupBy(*CONFIG).agg(
        F.count("*").alias("n"), *[hit(k).alias(f"rank{k}_count") for k in (1, 5, 10)],
        F.median("true_rank").alias("median_rank"), F.round(F.avg("true_rank"), digits).alias("mean_rank"), F.round(F.avg(F.ln("true_rank")), digits).alias("mean_log_rank"),
    )
    return out.withColumns({f"rank{k}_rate": F.col(f"rank{k}_count") / F.col("n") for k in (1, 5, 10)})


def fold_training_ranks(queries: DataFrame, gallery: DataFrame, modes: DataFrame, digits: int | None = None, folds: DataFrame | None = None) -> DataFrame:
    """(fold, query_case, query_person, configuration, true_rank): for each held-out query
    person (or those of folds, under all h or that which folds names) all other queries, ranked in
    the gallery without that person, scaled without it. Folds x queries x references; fold_audit
    needs it for few folds only."""
    plan = _Plan.of(modes, digits)
    people = queries.select("person_id").distinct() if folds is None else folds.select("person_id")
    fit = scaler(people.distinct(), gallery)
    fit = (fit if folds is None else fit.join(F.broadcast(folds), folds.columns, "left_semi")).withColumnRenamed("person_id", "fold")
    fit = _side_by_side(fit, ("fold", "h"), plan.views, weights(F.col("lo"), F.col("hi")), "w")
    asked = _asked(queries, plan.views).join(fit, "h").where("fold <> query_person")
    keys = ["fold", "query_case", "query_person"]
    return _by_mode(_counts(asked, _held(gallery, plan.views), plan, keys, people.count() * _cases(queries), _cases(gallery), "fold"), plan, keys)


_SUMS = ("n", "hit1", "hit5", "hit10", "ranked", "logs")


def _sums(rank: np.ndarray) -> np.ndarray:
    """The sums of a fold's audit for ranks along the first axis; NaN is no match."""
    known = ~np.isnan(rank)
    return np.stack([np.ones(rank.shape), *[(rank <= k) & known for k in (1, 5, 10)], known, np.log(np.where(known, rank, 1.0))]).sum(1)


def _corrections(plan: _Plan):
    """What leaving out each reference of a block changes in the sums over a block of queries."""

    def run(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((len(plan.modes), len(_SUMS), len(held)))
        if len(asked) and len(held):
            rank = np.stack(asked["ranks"].to_numpy()).astype(float)
            person, has = _codes(asked["query_person"], held["db_person"])
            screen = _Screen(plan, asked, held)
            more = np.empty(screen.square.shape)
            for rows, m, sure, row, column, s in screen.runs():
                was, g = rank[rows, m], screen.genuine[rows[row], m]
                stays = (s >= g) & (person[rows[row]] != has[column])
                row, column, above = row[stays], column[stays], (s > g)[stays]
                whole = more[: len(rows)]
                whole[...] = sure
                whole[row[above], column[above]] = 1.0
                for less in (1.0, 0.5):
                    # a query without a match, or none better than it, has nothing to lose
                    loses = was > less
                    now = np.where(loses, was - less, 1.0)
                    for i, change in zip((1, 2, 3, 5), [(now <= k).astype(float) - (was <= k) for k in (1, 5, 10)] + [np.log(now) - np.log(was)]):
                        change = np.where(loses, change, 0.0)
                        at = np.flatnonzero(change)
                        if less == 1.0 and len(at):
                            out[m, i] += change @ whole if len(at) == len(change) else change[at] @ whole[at]
                        elif len(at):
                            out[m, i] += np.bincount(column[~above], change[row[~above]], len(held))
        frame = held[["db_person", "h"]].rename(columns={"db_person": "fold"})
        frame["sums"] = pd.Series(list(out.transpose(2, 0, 1).reshape(len(held), len(plan.modes) * len(_SUMS))), index=frame.index, dtype=object)
        return frame

    return run


def fold_audit(queries: DataFrame, gallery: DataFrame, modes: DataFrame, digits: int | None = None, out_digits: int = 12) -> DataFrame:
    """selection_audit of all folds, without ranking every query anew in every fold.

    Only a person that alone holds an extreme of a feature changes the scaler when left out: at most
    two a feature, and those folds are ranked as they are, under the h of the feature. In any other
    fold a query's rank is its rank in the whole gallery, less what the person's one reference
    contributes; so one pass ranks the queries and a second sums the corrections by reference, both
    within blocks."""
    plan = _Plan.of(modes, digits)
    views, keys = plan.views, ["query_case", "query_person"]
    people = queries.select("person_id").distinct()
    bounds = extremes(gallery)
    alone = lambda one, who, two: F.transform(F.filter(F.arrays_zip(F.col(one).alias("a"), F.col(who).alias("p"), F.col(two).alias("b")), lambda x: ~F.equal_null(x["a"], x["b"])), lambda x: x["p"])
    holders = bounds.select("h", F.explode(F.array_union(alone("lo1", "lo1_person", "lo2"), alone("hi1", "hi1_person", "hi2"))).alias("person_id")).distinct()  # two a feature at most
    special = people.join(F.broadcast(holders), "person_id").select("person_id", "h").persist()
    changed_scale = F.broadcast(special.withColumnRenamed("person_id", "fold"))
    full = _side_by_side(bounds, ("h",), views, weights(F.col("lo1"), F.col("hi1")), "w")
    asked, held = _asked(queries, views).join(F.broadcast(full), "h"), _held(gallery, views)
    n_queries, n_gallery = _cases(queries), _cases(gallery)
    counts = _counts(asked, held, plan, keys, n_queries, n_gallery)
    ranks = F.array(*[F.when(F.col("equal")[i] > 0, 1.0 + F.col("better")[i] + 0.5 * (F.col("equal")[i] - 1)).otherwise(float("nan")) for i in range(len(plan.modes))])
    ranked = asked.join(counts.select(*keys, "h", ranks.alias("ranks")), [*keys, "h"]).persist()
    ordinary = people.withColumnRenamed("person_id", "fold")
    left_out = held.join(people.withColumnRenamed("person_id", "db_person"), "db_person", "left_semi").join(F.broadcast(special.withColumnRenamed("person_id", "db_person")), ["db_person", "h"], "left_anti")
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(len(plan.modes) * len(_SUMS))]).alias("sums")
    changed = _dealt(_with_genuine(ranked, held, views), left_out, n_queries, n_gallery).applyInPandas(_corrections(plan), "fold string, h int, sums array<double>").groupBy("fold", "h").agg(sums)

    def per_query(frames):
        for f in frames:
            if len(f):
                each = [_sums(np.asarray(r, float)[None]).T.ravel() for r in f["ranks"]]
                yield pd.DataFrame({"fold": f["query_person"], "h": f["h"], "sums": each})

    own = ranked.select("query_person", "h", "ranks").mapInPandas(per_query, "fold string, h int, sums array<double>").groupBy("fold", "h").agg(sums)
    total = own.groupBy("h").agg(sums.alias("total"))
    zero = F.array(*[F.lit(0.0)] * (len(plan.modes) * len(_SUMS)))
    folds = ordinary.crossJoin(F.broadcast(total)).join(changed_scale, ["fold", "h"], "left_anti").join(own.withColumnRenamed("sums", "own"), ["fold", "h"], "left").join(changed.withColumnRenamed("sums", "change"), ["fold", "h"], "left")
    at = lambda n, i: F.col("total")[n * len(_SUMS) + i] - F.coalesce("own", zero)[n * len(_SUMS) + i] + F.coalesce("change", zero)[n * len(_SUMS) + i]

    def row(n, i, m, k):
        count = F.round(at(n, 0))
        rate = lambda j: F.round(at(n, j)) / count
        mean = F.when(F.round(at(n, 4)) > 0, F.round(at(n, 5) / F.round(at(n, 4)), out_digits))
        return F.struct(F.lit(m).alias("mode"), F.lit(i).alias("mode_order"), F.lit(k).alias("n_views"), count.cast("long").alias("training_n"), rate(1).alias("rank1_rate"), rate(2).alias("rank5_rate"), rate(3).alias("rank10_rate"), mean.alias("mean_log_rank"))

    rows = folds.select("fold", "h", F.explode(F.array(*[row(n, i, m, k) for n, (i, m, k, _) in enumerate(plan.modes)])).alias("x")).where("x.training_n > 0").select("fold", *[f"x.{c}" for c in CONFIG[:3]], "h", *[f"x.{c}" for c in ("training_n", "rank1_rate", "rank5_rate", "rank10_rate", "mean_log_rank")])
    return _selected(rows.unionByName(_audit_rows(fold_training_ranks(queries, gallery, modes, digits, special), out_digits)))


def _audit_rows(training: DataFrame, digits: int) -> DataFrame:
    hit = lambda k: F.count_if(F.coalesce(F.col("true_rank") <= k, F.lit(False)))
    return training.groupBy("fold", *CONFIG).agg(F.count("*").alias("training_n"), (hit(1) / F.count("*")).alias("rank1_rate"), (hit(5) / F.count("*")).alias("rank5_rate"), (hit(10) / F.count("*")).alias("rank10_rate"), F.round(F.avg(F.ln("true_rank")), digits).alias("mean_log_rank"))


def _selected(rows: DataFrame) -> DataFrame:
    key = F.struct(-F.col("rank1_rate"), "mean_log_rank", "n_views", "h", "mode_order")
    # a fold has one row a configuration, so a window over it is small
    return rows.withColumn("selected", F.row_number().over(Window.partitionBy("fold").orderBy(key)) == 1)


def selection_audit(training: DataFrame, digits: int = 12) -> DataFrame:
    """Fold x configuration with the selected one marked: best rank-1 rate, then mean log
    rank, fewer views, smaller h, mode order."""
    return _selected(_audit_rows(training, digits))


def held_out_ranks(queries: DataFrame, gallery: DataFrame, modes: DataFrame, audit: DataFrame, digits: int | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """Each query against the whole gallery under its fold's configuration, the scaler still
    without its person: true mid-rank and the flags at 1, 5 and 10. fixed: the rows of
    fixed_configurations, where they are there."""
    chosen = audit.where("selected").select(F.col("fold").alias("query_person"), "mode", "h")
    ranks = (fixed_configurations(queries, gallery, modes, digits) if fixed is None else fixed).join(chosen, ["query_person", "mode", "h"])
    return ranks.withColumns({f"rank_{k}": F.coalesce(F.col("true_rank") <= k, F.lit(False)) for k in (1, 5, 10)})


def tie_stages(audit: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """By fold: how many configurations each criterion leaves and which one decides. The two
    float criteria allow the tolerance. resolved_mode and resolved_h repeat the choice."""
    out = audit.select("fold", *CONFIG, "rank1_rate", "mean_log_rank", "selected")
    within, best = Window.partitionBy("fold"), F.lit(True)
    steps = (("rank1_rate", F.max, tolerance), ("mean_log_rank", F.min, tolerance), ("n_views", F.min, 0.0), ("h", F.min, 0.0), ("mode_order", F.min, 0.0))
    for i, (column, extreme, slack) in enumerate(steps):  # one sort by fold serves all windows
        top = extreme(F.when(best, F.col(column))).over(within)
        out = out.withColumn(f"in_{i}", best & (F.abs(F.col(column) - top) <= slack))
        best = F.col(f"in_{i}")
    left = [F.count_if(F.col(f"in_{i}")).alias(f"left_{i}") for i in range(len(steps))]
    winner = F.max_by(F.struct(F.col("mode").alias("resolved_mode"), F.col("h").alias("resolved_h"), F.col("selected").alias("agrees")), F.col("in_4").cast("int")).alias("w")
    counts = out.groupBy("fold").agg(*left, winner)
    stage = F.when(F.col("left_0") == 1, "rank1_rate").when(F.col("left_1") == 1, "mean_log_rank").when(F.col("left_2") == 1, "n_views").when(F.col("left_3") == 1, "h").otherwise("mode_order")
    return counts.select("fold", *[f"left_{i}" for i in range(len(steps))], "w.*", stage.alias("stage"))


def require_complete_audit(audit: DataFrame) -> None:
    """One selected row a fold, and the same configurations in each."""
    per = audit.groupBy("fold").agg(F.count_if("selected").alias("s"), F.array_sort(F.collect_set(F.struct("mode", "h"))).alias("c"))
    row = per.agg(F.count_if(F.col("s") != 1).alias("bad"), F.count_distinct("c").alias("sets")).first()
    if row["bad"] or row["sets"] > 1:
        raise ValueError(f"{row['bad']} folds without one selected row; {row['sets']} sets of configurations")


def deviating_folds(audit: DataFrame, ranks: DataFrame, fixed: DataFrame) -> DataFrame:
    """Folds whose choice is not the commonest one, with their rank and what the commonest
    configuration would have given. fixed: fixed_configurations rows."""
    chosen = audit.where("selected").select(F.col("fold").alias("query_person"), "mode", "h", "mode_order")
    common = chosen.groupBy("mode", "h", "mode_order").agg(F.count("*").alias("n")).agg(F.max_by(F.struct("mode", "h"), F.struct("n", -F.col("mode_order"), -F.col("h"))).alias("c")).select(F.col("c.mode").alias("common_mode"), F.col("c.h").alias("common_h"))
    odd = chosen.crossJoin(F.broadcast(common)).where("mode <> common_mode or h <> common_h")  # one row of common
    rank = ranks.select("query_person", F.col("true_rank").alias("selected_rank"))
    other = fixed.select("query_person", F.col("mode").alias("common_mode"), F.col("h").alias("common_h"), F.col("true_rank").alias("common_rank"))
    return odd.drop("mode_order").join(rank, "query_person", "left").join(other, ["query_person", "common_mode", "common_h"], "left")
