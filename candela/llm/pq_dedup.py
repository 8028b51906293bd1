"""Embedding near-dedup by product quantisation.

Unit vectors are put into coarse inverted lists and their residuals coded in subspaces; the
error of each reconstruction is kept. A query goes to its nearest lists, as far down as finds
a neighbour just at the threshold in all but one of two thousand cases, either asking for the other:
that is measured on neighbours made from the sample, so it follows the data and not a guess. In a
list, table lookups give the product with each reconstruction, whose error bounds the true
product; what the bound lets through is decided by the exact cosine. So the codes lose no
link, and probing loses few, as most links are above the threshold.

Equal vectors are one from the start. Lists and their queries meet in blocks of bounded
size; a block gives counts a vector and the links that connect it, never all its pairs. Lists
take turns, so that only the queries of some are on disk at a time.
Centroids and codebooks come from a bounded sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .stage import discard, stage
from .vectors import copies, one_each, usable

#: Vectors that training sees, the least by hash of id.
SAMPLE_ROWS = 65_536
#: Of neighbours at the threshold, the share of which neither asks the list of the other.
MISSED = 5e-4
BLOCK_ROWS = 4096
#: Queries of a list that meet a block of its members at once.
QUERY_ROWS = 16_384
#: Rows that are dealt in one turn: so many, or so many a vector.
TURN_ROWS, TURN_SHARE = 1 << 20, 1.5
CODES = 256
SLACK = 1e-5


@dataclass
class Codebook:
    centroids: np.ndarray  # lists x dim, unit length
    books: np.ndarray  # subspaces x CODES x width
    dim: int

    def _split(self, x: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        padded = np.zeros((len(x), m * width))
        padded[:, : self.dim] = x
        return padded.reshape(len(x), m, width)

    def encode(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the reconstruction's error) of unit vectors."""
        to = (u @ self.centroids.T).argmax(1)
        rest = self._split(u - self.centroids[to])
        codes = np.empty(rest.shape[:2], np.uint8)
        left = np.zeros(len(u))
        for s, book in enumerate(self.books):
            far = (rest[:, s] ** 2).sum(1)[:, None] - 2 * rest[:, s] @ book.T + (book**2).sum(1)
            codes[:, s] = far.argmin(1)
            left += np.maximum(far.min(1), 0)
        return to, codes, np.sqrt(left) + SLACK

    def used(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By subspace: the codes that some rows have, and which of them each row has."""
        kinds = [np.unique(c, return_inverse=True) for c in codes.T]
        return [(book[k].astype(np.float32), at.reshape(-1)) for book, (k, at) in zip(self.books, kinds, strict=True)]

    def lookup(self, q: np.ndarray, used: list[tuple[np.ndarray, np.ndarray]], score: np.ndarray) -> np.ndarray:
        """score (rows x queries) plus each row's entries of the queries' tables, in place. A table
        has the product of a query's part with each code in use."""
        parts = self._split(q).astype(np.float32).transpose(1, 2, 0)
        for (book, at), part in zip(used, parts, strict=True):
            score += (book @ part)[at]
        return score


def _nearest(x: np.ndarray, c: np.ndarray, half: np.ndarray) -> np.ndarray:
    """The centre of each x, in blocks of rows."""
    return np.concatenate([(x[lo : lo + 4096] @ c.T - half).argmax(1) for lo in range(0, len(x), 4096)])


def _centres(x: np.ndarray, k: int, rng, rounds: int = 8) -> np.ndarray:
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, c, 0.5 * (c**2).sum(1))
        order = np.argsort(near, kind="stable")
        kinds, first, count = np.unique(near[order], return_index=True, return_counts=True)
        c[kinds] = np.add.reduceat(x[order], first, axis=0) / count[:, None]
    return c


def train(sample: np.ndarray, lists: int, subspaces: int = 16, seed: int = 9) -> Codebook:
    """sample: unit vectors, at least one."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    c = _centres(sample, lists, rng)
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    m = min(subspaces, dim)
    width = -(-dim // m)
    book = Codebook(c, np.zeros((m, 1, width)), dim)
    rest = book._split((sample - c[_nearest(sample, c, np.zeros(len(c)))])[:16_384])
    books = np.zeros((m, CODES, width))
    for s in range(m):
        got = _centres(rest[:, s], CODES, rng, 6)
        books[s, : len(got)] = got
        books[s, len(got) :] = got[0]
    return Codebook(c, books, dim)


def reach(sample: np.ndarray, book: Codebook, least: float, seen: float = 1.0, missed: float = MISSED, seed: int = 4) -> float:
    """How far below its best centroid a vector still asks a list, in the product with it. Random
    vectors of the sample get neighbours with the cosine `least`, turned half the time towards
    another vector of the sample and half the time in any direction. Both of a pair ask, so
    the nearer way counts. At most a share `missed` lies beyond, for both kinds of directions and for
    each quarter of the vectors by closeness to their centroid: tight ones don't outvote loose ones.
    A vector that training saw has drawn its centroid towards itself, so a share `seen` of the
    neighbours is held against the centroid that it would have been part of, as is its partner."""
    rng = np.random.default_rng(seed)
    own = np.concatenate([(sample[lo : lo + 1024] @ book.centroids.T).argmax(1) for lo in range(0, len(sample), 1024)])
    sums = np.zeros_like(book.centroids)
    np.add.at(sums, own, sample)
    sums = np.linalg.norm(sums, axis=1)
    close, gaps = [], ([], [])
    for _ in range(32):
        m = sample[rng.integers(0, len(sample), 1024)]
        at = np.arange(len(m))
        near_m = m @ book.centroids.T
        own_m = near_m.argmax(1)
        close.append(near_m[at, own_m])
        for kind, aim in enumerate((sample[rng.integers(0, len(sample), len(m))], rng.standard_normal(m.shape))):
            aside = aim - (aim * m).sum(1)[:, None] * m
            size = np.linalg.norm(aside, axis=1)
            q = least * m + np.sqrt(max(0.0, 1 - least * least)) * aside / np.where(size > 1e-6, size, 1)[:, None]
            near_q = q @ book.centroids.T
            own_q = near_q.argmax(1)
            size_q, best, back = sums[own_q], near_q[at, own_q], near_m[at, own_q]
            part = rng.random(len(m)) < seen
            length = np.sqrt(np.maximum(size_q**2 + 2 * size_q * best + 1, SLACK))
            best, back = np.where(part, (size_q * best + 1) / length, best), np.where(part, (size_q * back + least) / length, back)
            gap = np.minimum(near_m[at, own_m] - back, best - near_q[at, own_m])
            gap = np.where(own_m == own_q, 0.0, gap)
            gaps[kind].append(np.where(size > 1e-6, gap, 0.0))
    order = np.argsort(np.concatenate(close), kind="stable")
    return SLACK + max(float(np.quantile(np.concatenate(kind)[part], 1 - missed, method="higher")) for kind in gaps for part in np.array_split(order, 4))


def _asked(near: np.ndarray, far: float) -> np.ndarray:
    return near >= near.max(1, keepdims=True) - far


def probes(sample: np.ndarray, book: Codebook, least: float) -> float:
    """Lists that a vector of the sample asks, on average."""
    far = reach(sample, book, least)
    return float(np.mean([n for lo in range(0, len(sample), 4096) for n in _asked(sample[lo : lo + 4096] @ book.centroids.T, far).sum(1)]))


def _scaled(v: np.ndarray) -> np.ndarray:
    """Vectors times a power of two, so that their squares neither vanish nor overflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _unit(v: np.ndarray) -> np.ndarray:
    v = _scaled(v)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def _slices(batches, rows: int = 2048):
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def _encode(shared, far: float):
    """Codes, and the lists that a vector asks as bits."""

    def run(batches):
        book = shared.value
        for batch in _slices(batches):
            u = _unit(_matrix(batch.column(1)))
            to, codes, error = book.encode(u)
            asks = np.packbits(_asked(u @ book.centroids.T, far), axis=1, bitorder="little")
            asks[np.arange(len(u)), to >> 3] |= np.left_shift(1, to & 7).astype(np.uint8)
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), pa.array(to.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array([a.tobytes() for a in asks], pa.binary())], names=["rep", "v", "n", "list", "codes", "error", "asks"])

    return run


def _asking(column: pa.Array, first: int, end: int) -> np.ndarray:
    """By row, which of the lists first to end are asked; first is a multiple of 8."""
    bits = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    return np.unpackbits(bits[:, first // 8 : -(-end // 8)], axis=1, count=end - first, bitorder="little").astype(bool)


def _askers(lists: int):
    """How many queries each list has."""

    def run(batches):
        n = np.zeros(lists, np.int64)
        for batch in _slices(batches):
            n += _asking(batch.column(0), 0, lists).sum(0)
        yield pa.record_batch([pa.array(np.arange(lists, dtype=np.int32)), pa.array(n)], names=["list", "n"])

    return run


def _turns(load: np.ndarray, most: float) -> list[tuple[int, int]]:
    """Ranges of lists whose load is at most `most`, but eight lists at least."""
    out, first, sum_ = [], 0, 0
    for at in range(0, len(load), 8):
        more = int(load[at : at + 8].sum())
        if at > first and sum_ + more > most:
            out.append((first, at))
            first, sum_ = at, 0
        sum_ += more
    return [*out, (first, len(load))]


def _probe(blocks: np.ndarray, first: int, end: int):
    """Queries to those of the lists first to end that they ask; one row for each block of the list."""

    def run(batches):
        for batch in _slices(batches):
            row, to = np.nonzero(_asking(batch.column(4), first, end) & (blocks[first:end] > 0))
            to += first
            times = blocks[to]
            row, to = np.repeat(row, times), np.repeat(to, times)
            block = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            step = 20_000
            for lo in range(0, len(row), step):
                r = pa.array(row[lo : lo + step])
                yield pa.record_batch([batch.column(0).take(r), batch.column(1).take(r), batch.column(2).take(r), batch.column(3).take(r), pa.array(to[lo : lo + step].astype(np.int32)), pa.array(block[lo : lo + step].astype(np.int32))], names=["rep", "v", "n", "own", "list", "block"])

    return run


def _meet(shared, least: float):
    """Links between a block of queries and a block of a list's members. Where two vectors of
    different lists ask for each other, the query of the lower list has the pair."""

    def run(queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        out = {"rep": [], "links": [], "a": [], "b": []}
        if len(queries) and len(members):
            book, here = shared.value, int(members["list"].iloc[0])
            mv, qv = _scaled(np.stack(members["v"].to_numpy()).astype(float)), _scaled(np.stack(queries["v"].to_numpy()).astype(float))
            m_len, q_len = np.linalg.norm(mv, axis=1), np.linalg.norm(qv, axis=1)
            m_id, q_id = members["rep"].to_numpy(), queries["rep"].to_numpy()
            m_n, q_n, own = members["n"].to_numpy(), queries["n"].to_numpy(), queries["own"].to_numpy()
            inner, asks = own == here, np.frombuffer(b"".join(members["asks"]), np.uint8).reshape(len(members), -1)
            codes = np.frombuffer(b"".join(members["codes"]), np.uint8).reshape(len(members), -1)
            used, floor = book.used(codes), (least - members["error"].to_numpy()).astype(np.float32)[:, None]
            m_links, group = np.zeros(len(members), np.int64), np.arange(len(members))
            for lo in range(0, len(queries), 256):
                part = slice(lo, lo + 256)
                q = qv[part] / q_len[part][:, None]
                start = np.broadcast_to((q @ book.centroids[here]).astype(np.float32), (len(members), len(q))).copy()
                score = book.lookup(q, used, start)
                c, r = np.nonzero(score >= floor)
                if len(r) * 8 > score.size:
                    cos = (qv[part] @ mv.T) / (q_len[part][:, None] * m_len[None, :])
                    r, c = np.nonzero(cos >= least)
                else:
                    cos = np.einsum("nd,nd->n", qv[part][r], mv[c]) / (q_len[part][r] * m_len[c])
                    r, c = r[cos >= least], c[cos >= least]
                home = own[part][r]
                other = (q_id[part][r] != m_id[c]) & ((home <= here) | ((asks[c, home >> 3] >> (home & 7)) & 1 == 0))
                r, c = r[other], c[other]
                if not len(r):
                    continue
                linked = np.bincount(r, m_n[c], len(q)).astype(np.int64)
                outer = ~inner[part][r]
                m_links += np.bincount(c[outer], q_n[part][r[outer]], len(members)).astype(np.int64)
                for i in np.flatnonzero(linked):
                    near = c[r == i]
                    kinds, first = np.unique(group[near], return_index=True)
                    if len(kinds) > 1:
                        group[np.isin(group, kinds)] = kinds[0]
                    out["rep"].append(int(q_id[part][i]))
                    out["links"].append(int(linked[i]))
                    out["a"] += [int(q_id[part][i])] * len(first)
                    out["b"] += [int(x) for x in m_id[near[first]]]
            for j in np.flatnonzero(m_links):
                out["rep"].append(int(m_id[j]))
                out["links"].append(int(m_links[j]))
        n = len(out["rep"])
        return pd.DataFrame({"rep": np.array(out["rep"] + [-1] * len(out["a"]), np.int64), "links": np.array(out["links"] + [0] * len(out["a"]), np.int64), "a": np.array([-1] * n + out["a"], np.int64), "b": np.array([-1] * n + out["b"], np.int64), "link": np.array([False] * n + [True] * len(out["a"]), bool)})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, sample_rows: int = SAMPLE_ROWS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept): vectors linked by cosine >= least in double
    precision, of those that meet in a probed list. n_links counts other rows linked directly,
    component_id is the least vec_id reachable, kept marks that row.

    Unusable vectors (see vectors.usable) link with nothing and each give a row; rows
    without an id take no part; of rows that share an id the least vector counts, and each
    gives a row; other columns are ignored."""
    every = vectors.select(F.col(id_col).cast("long").alias("vec_id")).where("vec_id is not null")
    good = one_each(usable(vectors, id_col, vector_col))
    known = stage(copies(good, 1).select("rep", "v", "n"), "pq-vectors")
    members = stage(good.join(known.select("v", "rep", "n"), "v").select("vec_id", "rep", "n"), "pq-members")
    total = known.count()
    if not total:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    spark = vectors.sparkSession
    sample = known.select("rep", "v").orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).toArrow().sort_by("rep")
    unit = _unit(_matrix(sample["v"].combine_chunks()))
    book = train(unit, int(min(max(1, 2 * np.sqrt(total)), max(1, len(unit) // 4))))  # at most sample_rows / 4 lists
    shared = spark.sparkContext.broadcast(book)
    # single precision where the input has it: the same numbers in half the space
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    coded = stage(known.withColumn("v", F.col("v").cast(kind)).mapInArrow(_encode(shared, reach(unit, book, least, len(unit) / total)), f"rep long, v {kind}, n long, list int, codes binary, error double, asks binary"), "pq-codes")
    discard(known)
    by_list = {r["list"]: r["rows"] for r in coded.groupBy("list").agg(F.count("*").alias("rows")).collect()}  # a row a list
    rows = np.array([by_list.get(i, 0) for i in range(len(book.centroids))])
    by_list = {r["list"]: r["n"] for r in coded.select("asks").mapInArrow(_askers(len(rows)), "list int, n long").groupBy("list").agg(F.sum("n").alias("n")).collect()}  # a row a list
    asked = np.array([by_list.get(i, 0) for i in range(len(rows))])
    blocks, parts = -(-rows // BLOCK_ROWS), -(-asked // QUERY_ROWS)
    sizes = spark.createDataFrame([(i, int(b), int(p)) for i, (b, p) in enumerate(zip(blocks, parts, strict=True)) if b and p], "list int, n_blocks int, n_parts int")  # a row a list
    place = lambda n, *salt: F.pmod(F.xxhash64("rep", *salt), F.col(n)).cast("int")
    met = None
    for first, end in _turns(asked * blocks + rows * parts, max(TURN_ROWS, TURN_SHARE * total)):
        here = sizes.where((F.col("list") >= first) & (F.col("list") < end))
        queries = coded.select("rep", "v", "n", "list", "asks").mapInArrow(_probe(blocks, first, end), f"rep long, v {kind}, n long, own int, list int, block int")
        queries = queries.join(F.broadcast(here), "list").select("rep", "v", "n", "own", "list", "block", place("n_parts").alias("part"))
        held = coded.join(F.broadcast(here), "list").select("rep", "v", "n", "list", "codes", "error", "asks", place("n_blocks", F.lit(1)).alias("block"), F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1)).alias("part"))
        turn = stage(queries.groupBy("list", "block", "part").cogroup(held.groupBy("list", "block", "part")).applyInPandas(_meet(shared, least), "rep long, links long, a long, b long, link boolean"), "pq-links")
        met = turn if met is None else met.unionByName(turn)
    counts = met.where("not link").groupBy("rep").agg(F.sum("links").alias("links"))
    found = components(met.where("link").select("a", "b"))
    per_rep = members.join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    per_row = per_rep.select("vec_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = every.join(per_row, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept"))
