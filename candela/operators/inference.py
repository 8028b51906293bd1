"""Rank-based statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.special import mcnemar_exact, t_two_sided
from .contracts import require_same_keys
from .ranking import midranks_within
from .stages import with_input_order


def _hit(k) -> F.Column:
    return F.coalesce(F.col("true_rank") <= k, F.lit(False)).cast("double")


def rank_rates(ranks: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """(k, n, n_correct, rate): null ranks are misses."""
    hits = ranks.agg(F.count("*").alias("n"), *[F.sum(_hit(k)).alias(f"c{k}") for k in ks])
    return hits.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"c{k}").alias("c")) for k in ks])).alias("x")).select("x.k", "n", F.col("x.c").cast("long").alias("n_correct"), (F.col("x.c") / F.col("n")).alias("rate"))


def cmc_curve(ranks: DataFrame, max_rank: int = 10) -> DataFrame:
    return rank_rates(ranks, tuple(range(1, max_rank + 1)))


def align(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_person, rank_a, rank_b) of two methods over the same people."""
    require_same_keys(a, b, ("query_person",), "methods")
    return a.select("query_person", F.col("true_rank").alias("rank_a")).join(b.select("query_person", F.col("true_rank").alias("rank_b")), "query_person")


def mcnemar(aligned: DataFrame, ks=(1, 5, 10)) -> DataFrame:
    """By k the 2 x 2 counts, n01 (a right, b wrong), n10, exact p, and p by Holm over the ks."""
    right = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    cells = aligned.agg(*[F.count_if(x & y).alias(f"{n}_{k}") for k in ks for n, x, y in (("both", right("rank_a", k), right("rank_b", k)), ("n01", right("rank_a", k), ~right("rank_b", k)), ("n10", ~right("rank_a", k), right("rank_b", k)), ("neither", ~right("rank_a", k), ~right("rank_b", k)))]).first()
    rows = [(k, *[int(cells[f"{n}_{k}"]) for n in ("both", "n01", "n10", "neither")], mcnemar_exact(cells[f"n01_{k}"], cells[f"n10_{k}"])) for k in ks]
    return holm(aligned.sparkSession.createDataFrame(rows, "k int, n_both long, n01 long, n10 long, n_neither long, p double"), "p", "k")


def holm(df: DataFrame, p: str = "p", tie: str = "k") -> DataFrame:
    """Step-down Holm: p_holm. A few rows, one for each hypothesis."""
    order = Window.partitionBy(F.lit(0)).orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy(F.lit(0)))
    out = df.withColumn("_raw", F.least(F.lit(1.0), (m - F.row_number().over(order) + 1) * F.col(p)))
    return out.withColumn("p_holm", F.max("_raw").over(order)).drop("_raw")


def rank_distribution(ranks: DataFrame) -> DataFrame:
    """Mean, median and mean normalised rank (N - r) / (N - 1); null ranks are skipped."""
    return ranks.agg(F.count("true_rank").alias("n_ranked"), F.avg("true_rank").alias("mean_rank"), F.median("true_rank").alias("median_rank"), F.avg((F.col("n_gallery") - F.col("true_rank")) / (F.col("n_gallery") - 1)).alias("mean_normalised_rank"))


def bootstrap_rates(ranks: DataFrame, ks=(1, 5, 10), replicates: int = 10_000, seed: int = 42, methods=("true_rank",), block: int = 500) -> DataFrame:
    """(replicate, method, k, rate): people drawn with replacement, the same draw for every
    method. People with the same hits count alike, so they are counted by hit pattern in Spark,
    at most (len(ks) + 1) ** len(methods) rows for any number of people, and a replicate is one
    multinomial draw of the patterns. Blocks of replicates are tasks, each with its own
    generator, seeded by its number."""
    spark = ranks.sparkSession
    names = [f"h{i}_{j}" for i in range(len(methods)) for j in range(len(ks))]
    hit = [F.coalesce(F.col(m) <= k, F.lit(False)).alias(f"h{i}_{j}") for i, m in enumerate(methods) for j, k in enumerate(ks)]
    rows = sorted(tuple(r) for r in ranks.select(*hit).groupBy(*names).agg(F.count("*").alias("n")).collect())
    patterns = spark.sparkContext.broadcast((np.array([r[:-1] for r in rows], float), np.array([r[-1] for r in rows], np.int64)))

    def run(frames):
        for frame in frames:
            for b in frame["id"]:
                (hits, count), size = patterns.value, min(block, replicates - b * block)
                if len(count):
                    draws = np.random.default_rng([seed, int(b)]).multinomial(count.sum(), count / count.sum(), size)
                    rate = (draws @ hits / count.sum()).reshape(size, len(methods), len(ks))
                else:
                    rate = np.full((size, len(methods), len(ks)), np.nan)
                i, m, j = np.indices(rate.shape)
                yield pd.DataFrame({"replicate": (b * block + i).ravel(), "method": np.array(methods)[m.ravel()], "k": np.array(ks)[j.ravel()], "rate": rate.ravel()})

    return spark.range(0, -(-replicates // block), 1, max(1, min(64, -(-replicates // block)))).mapInPandas(run, "replicate long, method string, k long, rate double")


def _accepted(stream: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which 32-bit numbers of a stream give an index below n without bias, and those indices: the
    high half of number * n, unless its low half falls below 2**32 mod n."""
    product = stream.astype(np.uint64) * np.uint64(n)
    fair = (product & np.uint64(0xFFFFFFFF)) >= np.uint64((1 << 32) % n)
    return fair, (product >> np.uint64(32)).astype(np.int64)


def _stream(seed: int, lo: int, hi: int) -> np.ndarray:
    """The 32-bit numbers lo to hi of a seeded generator: each of its 64-bit numbers gives its low
    half, then its high half. The generator jumps to the place."""
    bits = np.random.PCG64(seed).advance(lo // 2)
    halves = bits.random_raw(-(-hi // 2) - lo // 2).astype("<u8").view("<u4")
    return halves[lo % 2 : lo % 2 + hi - lo]


def _seeded_blocks(spark, n: int, replicates: int, seed: int, block: int) -> DataFrame:
    """(id, start): the blocks of the stream, and how many draws are made before each. A first pass
    counts what each rejects, which tells where the next one's draws begin."""
    if not 1 < n < 1 << 32:
        raise ValueError("draws are from 2 to 2**32 - 1 things")
    total = replicates * n

    def rejected(frames):
        for frame in frames:
            yield pd.DataFrame({"id": frame["id"], "out": [int((~_accepted(_stream(seed, b * block, (b + 1) * block), n)[0]).sum()) for b in frame["id"]]})

    # blocks until all draws are made; rejections are rare, so one more block nearly always does
    starts, made, b = [], 0, 0
    while made < total:
        more = max(1, -(-(total - made) // block))
        counts = {r["id"]: r["out"] for r in spark.range(b, b + more, 1, min(more, 64)).mapInPandas(rejected, "id long, out long").collect()}
        for i in range(b, b + more):
            starts.append((i, made))
            made += block - counts[i]
        b += more
    return spark.createDataFrame(starts, "id long, start long").repartition(min(len(starts), 64), "id")


def _drawn(n: int, replicates: int, seed: int, block: int):
    """The indices that a block of the stream draws, from its number and how many are made before."""

    def draw(i: int, start: int) -> np.ndarray:
        fair, index = _accepted(_stream(seed, i * block, (i + 1) * block), n)
        return index[fair][: max(0, replicates * n - start)]

    return draw


def seeded_draws(spark, n: int, replicates: int, seed: int = 42, block: int = 1 << 18) -> DataFrame:
    """(replicate, i, times): how often each replicate draws index i of n, equal to rows of
    numpy.random.default_rng(seed).integers(0, n, (replicates, n)) whatever the blocks, which are
    tasks."""
    drawn = _drawn(n, replicates, seed, block)

    def draws(frames):
        for frame in frames:
            for i, start in zip(frame["id"], frame["start"]):
                index = drawn(i, start)
                key, times = np.unique((start + np.arange(len(index))) // n * n + index, return_counts=True)
                yield pd.DataFrame({"replicate": key // n, "i": key % n, "times": times})

    return _seeded_blocks(spark, n, replicates, seed, block).mapInPandas(draws, "replicate long, i long, times long")


#: People whose hits are one row, and up to how many people all of these rows are broadcast.
PACKED, SENT = 1 << 20, 1 << 26


def seeded_rates(ranks: DataFrame, ks=(1, 5, 10), replicates: int = 10_000, seed: int = 42, methods=("true_rank",), order: str = "query_person", block: int = 1 << 18, packed: int = PACKED) -> DataFrame:
    """(replicate, method, k, rate) of the very resamples that a seeded index matrix over the people
    in `order` gives, the same for every method.

    People are packed: a row has, for a range of them in order, a byte a method that says at
    how many of the ks they hit. A block of the stream meets each of these rows and gives its sums
    by replicate, so no draw leaves a task; it is made again for each row, of a million people."""
    ks = tuple(ks)
    spark, kept, steps = ranks.sparkSession, ranks.persist(), sorted(set(ks))
    if len(steps) > 127:
        raise ValueError("a byte tells 127 ks at most")
    n = kept.count()
    level = [sum(F.coalesce(F.col(m) <= k, F.lit(False)).cast("int") for k in steps).cast("byte").alias(f"h{i}") for i, m in enumerate(methods)]
    people = with_input_order(kept, order).select((F.col("ordinal") / packed).cast("long").alias("range"), "ordinal", *level)
    people = people.groupBy("range").agg(F.array_sort(F.collect_list(F.struct("ordinal", *[f"h{i}" for i in range(len(methods))]))).alias("x"))
    people = people.select("range", F.array(*[F.col(f"x.h{i}") for i in range(len(methods))]).alias("hits"))
    tasks, drawn = _seeded_blocks(spark, n, replicates, seed, block), _drawn(n, replicates, seed, block)

    def sums(frames):
        for frame in frames:
            for i, start, part, hits in zip(frame["id"], frame["start"], frame["range"], frame["hits"]):
                index = drawn(i, start)
                if not len(index):
                    continue
                row, index = (start + np.arange(len(index))) // n, index - part * packed
                here = (index >= 0) & (index < len(hits[0]))
                first = row[0]
                row, index = row[here] - first, index[here]
                size, wide = int(row.max(initial=0)) + 1, len(steps) + 1
                for m, name in enumerate(methods):
                    # whoever hits at c of the ascending ks hits at the last c of them
                    c = np.bincount(row * wide + hits[m][index], minlength=size * wide).reshape(size, wide)
                    reached = c[:, ::-1].cumsum(1)[:, ::-1]
                    for j, k in enumerate(steps):
                        yield pd.DataFrame({"replicate": first + np.arange(size), "method": name, "k": k, "c": reached[:, len(steps) - j]})

    parts = tasks.crossJoin(F.broadcast(people) if n <= SENT else people).mapInPandas(sums, "replicate long, method string, k int, c long")
    return parts.groupBy("replicate", "method", "k").agg((F.sum("c") / n).alias("rate"))


def cmc_bands(rates: DataFrame, curve: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(k, rate, lo, hi): a curve with the percentile band of its resamples at each k."""
    return curve.select("k", "rate").join(percentile_interval(rates, by=("k",), alpha=alpha), "k")


def poisson_rates_of(people: DataFrame, replicates: int) -> DataFrame:
    """Each person in each replicate with how often it is drawn."""
    edges, total = [], 0.0
    for i in range(12):
        total += math.exp(-1) / math.factorial(i)
        edges.append(total)
    u = (F.pmod(F.xxhash64("query_person", "replicate"), F.lit(1 << 52)) / float(1 << 52)).alias("u")
    times = sum((F.col("u") >= e).cast("int") for e in edges)
    return people.select(*people.columns, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select("*", u).withColumn("times", times)


def poisson_rates(ranks: DataFrame, ks=(1, 5, 10), replicates: int = 200) -> DataFrame:
    """(replicate, k, rate) for any number of people: each counts in a replicate as often as a
    Poisson(1) draw made from the hash of person and replicate, so sums combine before the
    shuffle and runs repeat."""
    drawn = poisson_rates_of(ranks.select("query_person", "true_rank"), replicates)
    sums = drawn.groupBy("replicate").agg(F.sum("times").alias("n"), *[F.sum(F.col("times") * _hit(k)).alias(f"c{k}") for k in ks])
    return sums.select("replicate", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.try_divide(F.col(f"c{k}"), F.col("n")).alias("rate")) for k in ks])).alias("x")).select("replicate", "x.k", "x.rate")


def poisson_means(values: DataFrame, value: str = "auc", person: str = "query_person", replicates: int = 2000) -> DataFrame:
    """(replicate, mean): the bootstrap of a mean over people, such as of the AUC of each query,
    drawn as in poisson_rates; null values take no part."""
    drawn = poisson_rates_of(values.where(F.col(value).isNotNull()).select(F.col(person).alias("query_person"), F.col(value).alias("x")), replicates)
    return drawn.groupBy("replicate").agg(F.try_divide(F.sum(F.col("times") * F.col("x")), F.sum("times")).alias("mean"))


def percentile_interval(samples: DataFrame, by=("method", "k"), value: str = "rate", alpha: float = 0.05) -> DataFrame:
    """Linear percentiles; NaN is ignored."""
    x = F.when(~F.isnan(value), F.col(value))
    return samples.groupBy(*by).agg(F.percentile(x, alpha / 2).alias("lo"), F.percentile(x, 1 - alpha / 2).alias("hi"))


def paired_differences(samples: DataFrame, a: str, b: str) -> DataFrame:
    one = lambda m, n: samples.where(F.col("method") == m).select("replicate", "k", F.col("rate").alias(n))
    return one(a, "ra").join(one(b, "rb"), ["replicate", "k"]).select("replicate", "k", (F.col("ra") - F.col("rb")).alias("rate"))


def auc(pairs: DataFrame, by=()) -> DataFrame:
    """Mann-Whitney area with mid-ranks, by group or pooled; null where one class is missing."""
    ranked = midranks_within(pairs, "score", by)
    sums = ranked.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("n_genuine"), F.count_if(F.col("label") == 0).alias("n_impostor"), F.sum(F.when(F.col("label") == 1, F.col("midrank"))).alias("_s"))
    area = (F.col("_s") - F.col("n_genuine") * (F.col("n_genuine") + 1) / 2.0) / F.nullif(F.col("n_genuine") * F.col("n_impostor"), F.lit(0))
    return sums.withColumn("auc", area).drop("_s")


def sign_flip_p(differences: DataFrame, column: str = "difference", permutations: int = 100_000, seed: int = 43, block: int = 10_000) -> float:
    """Monte-Carlo p of a zero mean under random signs, (extreme + 1) / (permutations + 1);
    1 where all differences are 0. Null differences are skipped.

    Equal sizes are counted, and a permutation draws how many of them are positive. The draws
    of a size are seeded by its bits, so they do not depend on the partitions; tasks give
    partial sums by permutation for any number of differences."""
    d = differences.select(F.col(column).cast("double").alias("d")).where("d is not null")
    total = d.agg(F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.abs("d")).alias("a")).first()
    if not total["n"] or total["a"] == 0:
        return 1.0
    # sums of the same terms differ by their order in the last digits
    seen = abs(total["s"]) - max(1e-15 * total["n"], 1e-12 * total["a"])
    sizes = d.where("d != 0").groupBy(F.abs("d").alias("d")).agg(F.count("*").alias("n"))

    def run(frames):
        out = np.zeros(permutations)
        for frame in frames:
            for value, n in zip(frame["d"].to_numpy(float), frame["n"].tolist()):
                key = int(np.float64(value).view(np.uint64))
                for lo in range(0, permutations, block):
                    rng, hi = np.random.default_rng([seed, key >> 32, key & 0xFFFFFFFF, lo // block]), min(lo + block, permutations)
                    out[lo:hi] += value * (2.0 * rng.binomial(n, 0.5, hi - lo) - n)
        yield pd.DataFrame({"permutation": np.arange(permutations), "s": out})

    sums = sizes.mapInPandas(run, "permutation long, s double").groupBy("permutation").agg(F.sum("s").alias("s"))
    return (sums.where(F.abs("s") >= seen).count() + 1) / (permutations + 1)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: n, rho and its two-sided p by t with n - 2 degrees; null pairs are skipped."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    ranked = midranks_within(midranks_within(both, "x", alias="rx"), "y", alias="ry")
    row = ranked.agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho")).first()
    n, rho = row["n"], row["rho"]
    p = None
    if n > 2 and rho is not None and not math.isnan(rho):
        p = 0.0 if abs(rho) >= 1 else t_two_sided(rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)
    return df.sparkSession.createDataFrame([(n, rho, p)], "n long, rho double, p double")


def principal_components(df: DataFrame, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Scores on k components of the z-scored features (population deviation) and their
    shares of the variance. Each axis points to its largest loading. Moments come from Spark."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in features], *[F.stddev_pop(c).alias(f"s_{c}") for c in features], *[F.covar_pop(a, b).alias(f"c_{a}_{b}") for a, b in pairs]).first()
    sd = np.array([r[f"s_{c}"] or 1.0 for c in features])
    cov = np.array([[r[f"c_{a}_{b}"] if (a, b) in pairs else r[f"c_{b}_{a}"] for b in features] for a in features]) / np.outer(sd, sd)
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:k]
    axes = axes[:, order] * np.sign(axes[np.abs(axes[:, order]).argmax(0), order])
    score = lambda j: sum(((F.col(c) - r[f"m_{c}"]) / float(sd[i]) * float(axes[i, j]) for i, c in enumerate(features)), F.lit(0.0))
    return df.withColumns({f"pc{j + 1}": score(j) for j in range(len(order))}), [float(values[o] / values.sum()) for o in order]
