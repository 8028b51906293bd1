"""Approximate nearest neighbours: a navigable small-world graph per shard, merged.

Distinct vectors are dealt to shards of bounded size. Each shard builds hierarchical
graphs, kept as flat arrays of neighbours, one row a shard in a staged table. Query blocks
meet every shard; inside, a block moves through a graph in lockstep, so numpy handles
all its queries at once. Shard results are merged by score.

Nearness is the inner product. A graph holds the vectors of a shard whose lengths are
within a factor of 2**0.5 of one another, and one more component evens them, which turns the
product into plain distance; so a few long vectors don't blur the rest. Groups of few
vectors are compared one by one. Groups go from long to short, and a group is left out where
its length times the query's is below what the query has found already.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stage import stage
from .vectors import copies, one_each, usable

SHARD_ROWS = 8192
QUERY_BLOCK = 8192
#: Groups of so many vectors of like length have no graph.
PLAIN_ROWS = 256
LINKS = 16
EF_BUILD, EF_SEARCH = 96, 160


class Graph:
    """links[0] is the ground level (2 * LINKS wide), links[l] the levels above; -1 is none."""

    def __init__(self, v: np.ndarray, links: list[np.ndarray], entry: int):
        self.v, self.links, self.entry = v, links, entry

    def _scores(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        s = np.matmul(self.v[ids], q[:, :, None])[:, :, 0]
        s[ids < 0] = -np.inf
        return s

    def descend(self, q: np.ndarray, at: np.ndarray, level: int) -> np.ndarray:
        """Greedy walk of every query at one level."""
        best = np.einsum("bd,bd->b", self.v[at], q)
        live = np.arange(len(q))
        while len(live):
            near = self.links[level][at[live]]
            s = self._scores(q[live], near)
            j = s.argmax(1)
            top = s[np.arange(len(live)), j]
            better = top > best[live]
            live, near, j, top = live[better], near[better], j[better], top[better]
            at[live], best[live] = near[np.arange(len(live)), j], top
        return at

    def beam(self, q: np.ndarray, at: np.ndarray, level: int, ef: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the ef best met by each query, best first; -1 fills up."""
        n = len(q)
        seen = np.zeros((n, len(self.v)), bool)
        ids, scores = np.full((n, ef), -1, np.int64), np.full((n, ef), -np.inf, np.float32)
        done = np.ones((n, ef), bool)
        ids[:, 0], scores[:, 0], done[:, 0] = at, np.einsum("bd,bd->b", self.v[at], q), False
        seen[np.arange(n), at] = True
        live = np.arange(n)
        while len(live):
            waiting = np.where(done[live], -np.inf, scores[live])
            pick = np.argpartition(-waiting, min(step, ef) - 1, axis=1)[:, : min(step, ef)]
            usable_ = np.take_along_axis(waiting, pick, 1) > -np.inf
            keep = usable_.any(1)
            live, pick, usable_ = live[keep], pick[keep], usable_[keep]
            if not len(live):
                break
            mark = done[live]
            np.put_along_axis(mark, pick, True, 1)
            done[live] = mark
            chosen = np.where(usable_, np.take_along_axis(ids[live], pick, 1), -1)
            near = np.where(chosen[:, :, None] >= 0, self.links[level][chosen], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            near[(near >= 0) & seen[live[:, None], np.maximum(near, 0)]] = -1
            r, c = np.nonzero(near >= 0)
            seen[live[r], near[r, c]] = True
            s = self._scores(q[live], near)
            all_ids, all_s = np.concatenate([ids[live], near], 1), np.concatenate([scores[live], s], 1)
            all_done = np.concatenate([done[live], near < 0], 1)
            top = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
            ids[live], scores[live], done[live] = (np.take_along_axis(x, top, 1) for x in (all_ids, all_s, all_done))
        order = np.argsort(-scores, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(scores, order, 1)

    def search(self, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.full(len(q), self.entry, np.int64)
        for level in range(len(self.links) - 1, 0, -1):
            at = self.descend(q, at, level)
        return self.beam(q, at, 0, ef)


def diverse(v: np.ndarray, base: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """For each base node up to `keep` of its candidates: nearest first, those first that are
    nearer to the base than to any taken before, then the nearest of the others."""
    out = np.full((len(base), keep), -1, np.int64)
    step = max(1, min(512, 5_000_000 // max(1, ids.shape[1]) ** 2))
    for lo in range(0, len(base), step):
        b, c = base[lo : lo + step], ids[lo : lo + step]
        s = np.matmul(v[c], v[b][:, :, None])[:, :, 0]
        s[c < 0] = -np.inf
        order = np.argsort(-s, axis=1)
        c, s = np.take_along_axis(c, order, 1), np.take_along_axis(s, order, 1)
        between = np.matmul(v[c], v[c].transpose(0, 2, 1))
        closest, taken = np.full(s.shape, -np.inf, np.float32), np.zeros(s.shape, bool)
        for j in range(c.shape[1]):
            ok = (c[:, j] >= 0) & (s[:, j] > closest[:, j]) & (taken.sum(1) < keep)
            taken[ok, j] = True
            closest[ok] = np.maximum(closest[ok], between[ok, j])
        rank = np.where(c < 0, 2, np.where(taken, 0, 1))
        first = np.argsort(rank, axis=1, kind="stable")[:, :keep]
        got = np.take_along_axis(c, first, 1)
        out[lo : lo + step, : got.shape[1]] = got
    return out


def even_lengths(v: np.ndarray) -> np.ndarray:
    """Vectors with a component that makes all as long as the longest."""
    squares = (v * v).sum(1)
    return np.concatenate([v, np.sqrt(np.maximum(squares.max() - squares, 0))[:, None]], 1).astype(np.float32)


def build(v: np.ndarray, links: int = LINKS, ef: int = EF_BUILD, seed: int = 3) -> Graph:
    """The graph of evened vectors. Nodes enter in batches of at most a third of the graph
    so far, linked to what their search found and to one another."""
    n = len(v)
    rng = np.random.default_rng(seed)
    level_of = (-np.log(1 - rng.random(n)) / np.log(links)).astype(int)
    order = np.argsort(-level_of, kind="stable")  # high levels first, so the entry is at the top
    top = int(level_of[order[0]])
    g = Graph(v, [np.full((n + 1, 2 * links if k == 0 else links), -1, np.int32) for k in range(top + 1)], int(order[0]))
    done = 0
    while done < n:
        size = min(256, max(1, done // 3), n - done)
        new = order[done : done + size]
        at = np.full(size, g.entry, np.int64)
        for level in range(top, -1, -1):
            here = level_of[new] >= level
            if done and not here.all():
                at[~here] = g.descend(v[new[~here]], at[~here], level)
            rows = new[here]
            if not len(rows):
                continue
            if done:
                found, _ = g.beam(v[rows], at[here], level, ef if level == 0 else min(ef, 32))
                at[here] = np.where(found[:, 0] >= 0, found[:, 0], at[here])
            else:
                found = np.full((len(rows), 0), -1, np.int64)
            mates = np.broadcast_to(rows, (len(rows), len(rows))).copy()
            mates[np.arange(len(rows)), np.arange(len(rows))] = -1
            if mates.shape[1] > 32:
                s = v[rows] @ v[rows].T
                np.fill_diagonal(s, -np.inf)
                mates = rows[np.argpartition(-s, 31, axis=1)[:, :32]]
            candidates = np.concatenate([found, mates], 1)
            width = g.links[level].shape[1]
            picked = diverse(v, rows, candidates, min(links, width))
            g.links[level][rows, : picked.shape[1]] = picked
            # links back; nodes with too many choose again
            src, dst = np.repeat(rows, picked.shape[1]), picked.ravel()
            src, dst = src[dst >= 0], dst[dst >= 0]
            by = np.argsort(dst, kind="stable")
            src, dst = src[by], dst[by]
            start = np.flatnonzero(np.concatenate([[True], dst[1:] != dst[:-1]])) if len(dst) else np.zeros(0, np.int64)
            count = np.diff(np.concatenate([start, [len(dst)]]))
            nodes = dst[start]
            back = np.full((len(nodes), int(count.max()) if len(count) else 0), -1, np.int64)
            back[np.repeat(np.arange(len(nodes)), count), np.arange(len(dst)) - np.repeat(start, count)] = src
            all_ = np.sort(np.concatenate([g.links[level][nodes].astype(np.int64), back], 1), axis=1)
            all_[:, 1:][all_[:, 1:] == all_[:, :-1]] = -1
            all_ = -np.sort(-all_, axis=1)
            full = (all_ >= 0).sum(1) > width
            g.links[level][nodes[~full]] = all_[~full][:, :width]
            if full.any():
                g.links[level][nodes[full]] = diverse(v, nodes[full], all_[full], width)
        done += size
    return g


def lengths(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(part, power): the length of each vector is part * 2.0**power, part from 0.5 on; no
    component is too large or small to square."""
    top = np.frexp(np.abs(v).max(1))[1]
    part, power = np.frexp(np.sqrt((np.ldexp(v, -top[:, None]) ** 2).sum(1)))
    return part, power + top


def _build_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("rep")
    raw = np.stack(rows["v"].to_numpy()).astype(np.float64)
    part, power = lengths(raw)
    group = 2 * power + (part >= 0.5**0.5)
    order = np.argsort(-group, kind="stable")  # long ones first
    raw, group, power = raw[order], group[order], power[order]
    cut = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(raw)]
    groups = []
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a <= PLAIN_ROWS:
            groups.append({"n": b - a, "power": int(power[a]), "entry": -1, "links": []})
        else:
            g = build(even_lengths(np.ldexp(raw[a:b], -int(power[a]))))
            groups.append({"n": b - a, "power": int(power[a]), "entry": g.entry, "links": [x.tobytes() for x in g.links]})
    return pd.DataFrame({"shard": [rows["shard"].iloc[0]], "reps": [rows["rep"].to_numpy(np.int64)[order].tobytes()], "raw": [raw.tobytes()], "groups": [groups]})


GRAPH_SCHEMA = "shard int, reps binary, raw binary, groups array<struct<n int, power int, entry int, links array<binary>>>"


def index(reps: DataFrame, shards: int) -> DataFrame:
    """One row a shard: its vectors, and by length its graphs as flat arrays. reps: (rep, v)."""
    dealt = reps.select("rep", "v", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int").alias("shard"))
    return stage(dealt.groupBy("shard").applyInPandas(_build_shard, GRAPH_SCHEMA), "hnsw-graphs")


def _search_block(k: int, ef: int):
    def run(graphs: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query": np.zeros(0, np.int64), "rep": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(graphs) or not len(queries):
            return empty
        row = graphs.iloc[0]
        reps = np.frombuffer(row["reps"], np.int64)
        raw = np.frombuffer(row["raw"]).reshape(len(reps), -1)
        parts, at = [], 0
        for x in row["groups"]:
            v = raw[at : at + x["n"]]
            g = None
            if x["entry"] >= 0:
                g = Graph(even_lengths(np.ldexp(v, -x["power"])), [np.frombuffer(y, np.int32).reshape(x["n"] + 1, -1) for y in x["links"]], x["entry"])
            parts.append((at, v, g, x["power"]))
            at += x["n"]
        every = np.stack(queries["v"].to_numpy()).astype(np.float64)
        names, out = queries["query"].to_numpy(np.int64), []
        for lo in range(0, len(every), 512):
            q = every[lo : lo + 512]
            part, power = lengths(q)
            best_s, best_i = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)
            for begin, v, g, top in parts:
                # no vector here is as long as 2.0**top
                with np.errstate(over="ignore"):
                    may = np.flatnonzero(~(np.ldexp(part, power + top) < best_s[:, -1]))
                if not len(may):
                    continue
                own = q[may]
                if g is None:
                    ids = np.broadcast_to(np.arange(len(v)), (len(own), len(v)))
                    score = own @ v.T  # double precision, original vectors
                else:
                    flat = np.concatenate([np.ldexp(own, -power[may][:, None]), np.zeros((len(own), 1))], 1).astype(np.float32)
                    ids, _ = g.search(flat, min(ef, len(v)))
                    score = np.matmul(v[ids], own[:, :, None])[:, :, 0]
                    score[ids < 0] = -np.inf
                ids = np.where(ids >= 0, ids + begin, -1)
                score, ids = np.concatenate([best_s[may], score], 1), np.concatenate([best_i[may], ids], 1)
                best = np.lexsort((reps[ids], -score), axis=1)[:, :k]
                best_s[may], best_i[may] = np.take_along_axis(score, best, 1), np.take_along_axis(ids, best, 1)
            r, c = np.nonzero(best_i >= 0)
            out.append(pd.DataFrame({"query": names[lo : lo + 512][r], "rep": reps[best_i[r, c]], "score": best_s[r, c]}))
        return pd.concat(out) if out else empty

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, ef: int = EF_SEARCH, shard_rows: int = SHARD_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k nearest other rows of
    vectors found, by inner product in double precision, ties to the smaller id.

    Both tables have the same columns. Unusable vectors (see vectors.usable) neither ask nor
    answer; a query with fewer candidates gets them all; of rows that share an id the least
    vector counts; other columns are ignored."""
    good = one_each(usable(vectors, id_col, vector_col))
    known = stage(copies(good, k + 1), "hnsw-vectors")
    n = known.count()
    shards = max(1, -(-n // shard_rows))
    graphs = index(known, shards)
    asked = one_each(usable(queries, id_col, vector_col))
    asking = stage(asked.groupBy("v").agg(F.min("vec_id").alias("query")), "hnsw-queries")  # equal queries search once
    blocks = max(1, -(-asking.count() // QUERY_BLOCK))
    placed = asking.withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    spread = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    hits = spread.groupBy("shard", "block").cogroup(placed.groupBy("shard", "block")).applyInPandas(_search_block(k + 1, ef), "query long, rep long, score double")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    top = hits.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1)
    rows = top.join(known.select("rep", "ids"), "rep").select("query", "score", F.explode("ids").alias("vec_id"))
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))).where(F.col("rn") <= k + 1)
    found = stage(rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))).alias("found")), "hnsw-found")
    each = asked.join(asking, "v").select(F.col("vec_id").alias("query_id"), "query").join(found, "query")
    own = F.expr(f"slice(filter(found, x -> x.vec_id <> query_id), 1, {k})")
    return each.select("query_id", F.posexplode(own).alias("p", "x")).select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))
