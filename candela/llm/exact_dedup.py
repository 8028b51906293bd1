"""Exact duplicates by composable polynomial fingerprints.

The fingerprint of a text is its bytes as digits to fixed bases, modulo primes. Fingerprints
compose: that of ab is that of a, times the base to the length of b, plus that of b. So a huge text
is cut into chunks that tasks anywhere fingerprint; each result, shifted by the bytes that follow,
goes into a sum.

Equal length and fingerprint only make a group. In every group the texts are compared with one of
them, byte by byte: chunks are sorted so that the chosen text's comes first and the others' stream
past it, one chunk in memory. Texts that differ form groups of their own and are compared again,
until none differs, so results don't rest on fingerprints. A group with much text is compared in
slices, each with the chosen text.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import LOWER, text_chunks
from .stage import discard, id_and_text, stage

#: Primes below 2**31 and a base for each.
MODULI = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1812433253, 1664525001, 1597334677)
#: Texts of more bytes are fingerprinted in chunks of so many, dealt out to all tasks.
HUGE = 1 << 20
#: Bytes of a chunk that is compared, and of a slice of a group, where a row counts as ROW more.
PIECE, SLICE, ROW = 1 << 13, 1 << 21, 1 << 12
#: Groups with one in so many of all rows are joined by broadcast: there are at most as many.
HOT_SHARE = 256
KEY = ("n_bytes", "print")
NAMED = ("row", "doc_id", "raw", "n_bytes", "sha")
_LOWER = LOWER.tobytes()


class Polynomials:
    """Fingerprints of slices of byte buffers; tables of powers grow with the longest buffer."""

    def __init__(self, moduli: tuple[int, ...] = MODULI):
        self.moduli = moduli
        self.bases = [1 + b % (p - 1) for b, p in zip(BASES, moduli)]
        self._powers = [np.ones(1, np.uint64)] * len(moduli)
        self._inverses = [np.ones(1, np.uint64)] * len(moduli)

    def _tables(self, i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        p, base = self.moduli[i], self.bases[i]
        for tables, b in ((self._powers, base), (self._inverses, pow(base, -1, p))):
            while len(tables[i]) < n:
                tables[i] = np.concatenate([tables[i], tables[i] * np.uint64(pow(b, len(tables[i]), p)) % np.uint64(p)])
        return self._powers[i], self._inverses[i]

    def of(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """A row for each slice between offsets, a column for each modulus. Slices have at most
        2**24 bytes, so that their sums fit."""
        n, out = len(data), np.zeros((len(off) - 1, len(self.moduli)), np.uint64)
        some = np.flatnonzero(off[1:] > off[:-1])
        digits = data.astype(np.uint64) + np.uint64(1)  # so that zeros count
        for i, p in enumerate(self.moduli):
            powers, inverses = self._tables(i, n + 1)
            if len(some):
                sums = np.add.reduceat(digits * powers[:n][::-1], off[:-1][some]) % np.uint64(p)
                out[some, i] = sums * inverses[n - off[1:][some]] % np.uint64(p)
        return out

    def shifted(self, row: list[int], after: int) -> list[int]:
        """What a chunk adds to the whole's fingerprint, with so many bytes after it."""
        return [x * pow(b, after, p) % p for x, b, p in zip(row, self.bases, self.moduli)]


def _packed(rows: np.ndarray) -> pa.Array:
    """Fingerprints as binary."""
    rows = np.ascontiguousarray(rows.astype(">u4"))
    width = rows.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _whole_prints(moduli):
    def run(batches):
        polynomials = Polynomials(moduli)
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(2)):
                data = LOWER[data]
                prints = polynomials.of(data, off)
                body, edge = data.tobytes(), off.tolist()
                shas = [hashlib.sha256(body[a:b]).digest() for a, b in zip(edge[:-1], edge[1:])]
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(np.diff(off)), _packed(prints), pa.array(shas, pa.binary())], names=["doc_id", "raw", *KEY, "sha"])

    return run


def _chunk_prints(moduli):
    def run(batches):
        polynomials = Polynomials(moduli)
        for batch in batches:
            added = []
            for chunk, after in zip(batch.column(5), batch.column(6).to_pylist()):
                data = LOWER[np.frombuffer(chunk.as_buffer(), np.uint8)]
                added.append(polynomials.shifted(polynomials.of(data, np.array([0, len(data)]))[0].tolist(), after))
            yield pa.record_batch([*batch.columns[:5], pa.array(added, pa.list_(pa.int64()))], names=[*NAMED, "added"])

    return run


def _prints(docs: DataFrame, moduli: tuple[int, ...], huge: int) -> DataFrame:
    """(doc_id, raw, n_bytes, print, sha, times): docs by id and bytes, with the fingerprint and the
    sha256 of the text with A-Z lower-cased."""
    here = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("raw"), "text")
    size = F.octet_length("text")
    small = here.where(size <= huge).mapInArrow(_whole_prints(moduli), "doc_id long, raw binary, n_bytes long, print binary, sha binary")
    # one pass makes the number of a row and all that goes with it: made twice, numbers could differ
    upper = "".join(map(chr, range(65, 91)))
    large = here.where(size > huge).withColumns({"row": F.monotonically_increasing_id(), "n_bytes": size.cast("long"), "sha": F.unhex(F.sha2(F.translate("text", upper, upper.lower()), 256)), "b": F.col("text").cast("binary")})
    chunks = large.select(*NAMED, "b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / huge))).alias("i"))
    chunks = chunks.select(*NAMED, F.expr(f"substring(b, cast(i * {huge} + 1 as int), {huge})").alias("chunk"), F.greatest(F.col("n_bytes") - (F.col("i") + 1) * huge, F.lit(0)).alias("after"), "i")
    parts = chunks.repartition("row", "i").drop("i").mapInArrow(_chunk_prints(moduli), "row long, doc_id long, raw binary, n_bytes long, sha binary, added array<long>")
    sums = parts.groupBy(*NAMED).agg(*[(F.sum(F.col("added")[i]) % p).alias(f"f{i}") for i, p in enumerate(moduli)])
    shown = F.unhex(F.concat(*[F.lpad(F.hex(f"f{i}"), 8, "0") for i in range(len(moduli))]))
    whole = sums.select("doc_id", "raw", "n_bytes", shown.alias("print"), "sha")
    return small.unionByName(whole).groupBy("doc_id", "raw", *KEY, "sha").agg(F.count("*").alias("times"))


def _compare(batches):
    """Chunks in order of (print, n_bytes, slice, i), the chosen text's first; gives the rows of
    which one differs."""
    at, chosen = None, b""
    for batch in batches:
        ids, raws = [], []
        keys = zip(*(batch.column(c).to_pylist() for c in range(4)))
        for key, first, doc_id, raw, piece in zip(keys, *(batch.column(c).to_pylist() for c in range(4, 8))):
            piece = piece.translate(_LOWER)
            if first:
                at, chosen = key, piece
            elif key != at:
                raise ValueError("chunks without the chosen text's")
            elif piece != chosen:
                ids.append(doc_id)
                raws.append(raw)
        if ids:
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(raws, pa.binary())], names=["doc_id", "raw"])


def _by_group(rows: DataFrame, groups: DataFrame, on: tuple[str, ...], n_rows: int) -> DataFrame:
    """rows left-joined with their groups (members, ...); the few groups that hold much of all rows
    are broadcast, so no key of the shuffled rest has a large share."""
    hot = groups.where(F.col("members") * HOT_SHARE >= n_rows)
    cold = groups.where(F.col("members") * HOT_SHARE < n_rows)
    met = rows.join(F.broadcast(hot), list(on), "left")
    added = [c for c in groups.columns if c not in on]
    return met.where("members is not null").unionByName(met.where("members is null").drop(*added).join(cold, list(on), "left"))


def _differing(docs: DataFrame, rows: DataFrame, groups: DataFrame, n_rows: int, piece: int) -> DataFrame:
    """(doc_id, raw): rows whose text differs from their group's chosen one."""
    slices = F.ceil(F.col("members") * (F.col("n_bytes") + ROW) / SLICE).cast("int")
    members = _by_group(rows, groups, KEY, n_rows).where("members is not null")
    chosen = (F.col("doc_id") == F.col("chosen.doc_id")) & (F.col("raw") == F.col("chosen.raw"))
    members = members.withColumns({"slices": F.greatest(slices, F.lit(1)), "first": chosen})
    own = F.array(F.pmod(F.xxhash64("doc_id", "raw"), F.col("slices")).cast("int"))
    members = members.select("doc_id", "raw", *KEY, "first", F.when(F.col("first"), F.sequence(F.lit(0), F.col("slices") - 1)).otherwise(own).alias("slices"))
    texts = docs.select("doc_id", F.unhex(F.sha2("text", 256)).alias("raw"), F.col("text").cast("binary").alias("b")).join(members, ["doc_id", "raw"])
    pieces = texts.select("*", F.explode("slices").alias("slice")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.greatest(F.col("n_bytes") - 1, F.lit(0)) / piece))).alias("i"))
    pieces = pieces.select("print", "n_bytes", "slice", "i", "first", "doc_id", "raw", F.expr(f"substring(b, cast(i * {piece} + 1 as int), {piece})").alias("piece"))
    order = pieces.repartition("print", "n_bytes", "slice").sortWithinPartitions("print", "n_bytes", "slice", "i", F.desc("first"))
    return order.mapInArrow(_compare, "doc_id long, raw binary").distinct()


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", moduli: tuple[int, ...] = MODULI, huge: int = HUGE, piece: int = PIECE) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256): for each row, the greatest id among rows of
    the same text (A-Z and a-z being the same), their number, whether this row is the one that
    stays, and the sha256 of the text with A-Z lower-cased.

    Null text counts as empty, and empty texts are equal; rows without an id take no part; rows
    that share an id are told apart by their bytes, and of rows equal in both one stays at most;
    other columns are ignored. moduli: primes below 2**31, at most four. Fewer or smaller ones make
    more groups that are taken apart by comparison, with the same result."""
    docs = id_and_text(docs, id_col, text_col)
    rows = stage(_prints(docs, moduli, huge), "exact-prints")
    n_rows, left, rounds = rows.count(), rows, []
    while True:
        groups = stage(left.groupBy(*KEY).agg(F.count("*").alias("members"), F.max(F.struct("doc_id", "raw")).alias("chosen")).where("members > 1"), "exact-groups")
        differ = stage(_differing(docs, left, groups, n_rows, piece), "exact-differing")
        discard(groups)
        if differ.isEmpty():
            discard(differ)
            break
        rounds.append(differ)
        left = left.join(differ, ["doc_id", "raw"], "left_semi")
    if rounds:
        level = reduce(DataFrame.unionByName, rounds).groupBy("doc_id", "raw").agg(F.count("*").alias("level"))
        rows = rows.join(level, ["doc_id", "raw"], "left")
    else:
        rows = rows.withColumn("level", F.lit(0).cast("long"))
    rows = rows.withColumn("level", F.coalesce("level", F.lit(0).cast("long")))
    on = (*KEY, "level")
    classes = rows.groupBy(*on).agg(F.count("*").alias("members"), F.sum("times").alias("group_size"), F.max(F.struct("doc_id", "raw")).alias("stays")).where("members > 1")
    out = _by_group(rows, classes, on, n_rows).select(
        "doc_id", F.coalesce("stays.doc_id", "doc_id").alias("keep_id"), F.coalesce("group_size", "times").alias("group_size"), F.coalesce(F.col("stays.raw") == F.col("raw"), F.lit(True)).alias("last"),
        F.lower(F.hex("sha")).alias("text_sha256"), F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("i"),
    )
    return out.select("doc_id", "keep_id", "group_size", ((F.col("doc_id") == F.col("keep_id")) & F.col("last") & (F.col("i") == 1)).alias("kept"), "text_sha256")


#: The same in DuckDB's SQL, over documents with an id each.
SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
