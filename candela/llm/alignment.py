"""Alignment of two tokenizers by interval coalescing.

Both tokenizers cut the same bytes (a space and the text). The tokens of both are sorted by
start; where a start reaches the running maximum of the ends before it, a new group begins, so
groups end where tokens of both do. Inside a group every token of one tokenizer is linked with
every token of the other.

Corpus-wide, an id pair counts the documents that hold it linked. Those counts meet the documents
again in shards by the first tokenizer's id: a shard's counts are read first and its rows stream
past them. Shards grow with the number of id pairs, slices of a shard with the number of rows, so
neither is bounded by anything but a task's share.
"""

from __future__ import annotations

import hashlib
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PIECE, byte_symbols
from .kernels import text_chunks
from .stage import discard, id_and_text, stage

#: Tokens of words that a task remembers; then it starts anew.
REMEMBERED_TOKENS = 2_000_000
#: Pairs that are expanded at once.
BLOCK_PAIRS = 2_000_000
#: Id pairs of a shard, links of a slice, and id pairs of one row of counts.
SHARD_PAIRS, SLICE_LINKS, ROW_PAIRS = 500_000, 2_000_000, 4_000
#: A pair of ids is one number: a * ID + b.
ID = 1 << 16

WORD = re.compile(" +[^ ]*")
_BYTE = re.compile("<0x([0-9A-F]{2})>")


class ByteTokens:
    """The byte-level vocabulary of a tokenizers JSON file; its special tokens are plain text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        back = {c: b for b, c in byte_symbols().items()}
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(back[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self._coder = tiktoken.Encoding("bytes", pat_str=PIECE, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.size[i] = len(token)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        ids = [self._coder.encode_ordinary(t) for t in texts]
        count = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.int64, int(count.sum())), count


class PieceTokens:
    """A sentencepiece BPE model. No piece goes on after a space, so words (with the spaces before
    them) are encoded once and remembered; a model with other pieces is refused."""

    def __init__(self, path: str):
        self._coder = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self._coder.id_to_piece(i) for i in range(self._coder.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("pieces that go on after a space")
        self.bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {" ": 0}  # words by number; a space alone is the piece that words begin with
        self._ids, self._start, self._good = np.array([self._coder.piece_to_id("▁")], np.int64), np.array([0, 1]), np.array([self.bytes[self._coder.piece_to_id("▁")] == b" "])

    def _learn(self, words: list[str]) -> None:
        ids = self._coder.encode([w[1:] for w in words], num_threads=1)  # the model adds a space
        good = [b"".join([self.bytes[i] for i in x]) == w.encode() for w, x in zip(words, ids)]
        self._known.update(zip(words, range(len(self._known), len(self._known) + len(words))))
        self._ids = np.concatenate([self._ids, np.fromiter(chain.from_iterable(ids), np.int64)])
        self._start = np.concatenate([self._start, self._start[-1] + np.cumsum([len(x) for x in ids])])
        self._good = np.concatenate([self._good, good])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and whether its pieces give its bytes back. Each
        text begins with the space that the model adds."""
        if len(self._ids) > REMEMBERED_TOKENS:
            self._forget()
        words = [WORD.findall(t) for t in texts]
        known = self._known
        new = [w for w in set(chain.from_iterable(words)) if w not in known]
        if new:
            self._learn(new)
        n = np.fromiter(map(len, words), np.int64, len(words))
        number = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.int64, int(n.sum()))
        first, size = self._start[number], self._start[number + 1] - self._start[number]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        edge = np.concatenate([[0], np.cumsum(n)])
        count = np.diff(np.concatenate([[0], np.cumsum(size)])[edge])
        bad = np.diff(np.concatenate([[0], np.cumsum(~self._good[number])])[edge])
        return self._ids[at], count, bad == 0


def coalesce(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from 0, by the ends of tokens without gaps."""
    ends = np.concatenate([ends_a, ends_b])
    starts = np.concatenate([[0], ends_a[:-1], [0], ends_b[:-1]])[: len(ends)] if len(ends) else ends
    order = np.lexsort((np.arange(len(ends)), starts))
    running = np.maximum.accumulate(ends[order])
    new = np.zeros(len(ends), np.int64)
    new[1:] = starts[order][1:] >= running[:-1]
    group = np.empty(len(ends), np.int64)
    group[order] = np.cumsum(new)
    return group[: len(ends_a)], group[len(ends_a) :]


def _distinct(key: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often (or with what sum of weights) each occurs."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.diff(np.append(new, len(key))) if weight is None else (np.add.reduceat(weight[order], new) if len(new) else weight)
    return key[new], total


def linked_pairs(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, links): for each document the id pairs that it holds linked, and how often;
    doc: the document of each group. Ids that repeat in a group are expanded once, and pairs a
    block at a time."""
    ka, ca = _distinct(group_a * ID + ids_a)
    kb, cb = _distinct(group_b * ID + ids_b)
    ga, b_count = ka // ID, np.bincount(kb // ID, minlength=len(doc))
    first_b = np.cumsum(b_count) - b_count
    wide = b_count[ga]
    limit = np.cumsum(wide)
    key, links, lo = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    while lo < len(ka):
        hi = max(lo + 1, int(np.searchsorted(limit, (limit[lo - 1] if lo else 0) + BLOCK_PAIRS, side="right")))
        row = np.repeat(np.arange(lo, hi), wide[lo:hi])
        of = first_b[ga[row]] + np.arange(len(row)) - np.repeat(limit[lo:hi] - wide[lo:hi] - (limit[lo - 1] if lo else 0), wide[lo:hi])
        more = (doc[ga[row]] << 32) | ((ka[row] % ID) * ID + kb[of] % ID)
        key, links = _distinct(np.concatenate([key, more]), np.concatenate([links, ca[row] * cb[of]]))
        lo = hi
    return key >> 32, key & ((1 << 32) - 1), links


_DIGITS = None


def group_text(group_a: np.ndarray, ids_a: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray) -> tuple[bytes, np.ndarray]:
    """`a1,a2|b1;a3|b2,b3;` of groups in order, and where each group's part ends."""
    global _DIGITS
    if _DIGITS is None:
        text = np.char.mod("%d", np.arange(ID)).astype("S6")
        _DIGITS = text.view(np.uint8).reshape(ID, 6), np.char.str_len(text)
    digits, size = _DIGITS
    key = np.concatenate([group_a * 2, group_b * 2 + 1])
    order = np.argsort(key, kind="stable")
    key, ids = key[order], np.concatenate([ids_a, ids_b])[order]
    out, n = digits[ids], size[ids]
    last = np.append(key[1:] != key[:-1], True) if len(key) else np.zeros(0, bool)
    out[np.arange(len(ids)), n] = np.where(last, np.where(key % 2 == 0, ord("|"), ord(";")), ord(","))
    ends = np.cumsum(n + 1)
    return out[np.arange(6) <= n[:, None]].tobytes(), ends[last & (key % 2 == 1)]


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokens(byte_path), PieceTokens(piece_path)
        if max(len(self.a.size), len(self.b.size)) > ID:
            raise ValueError(f"ids from {ID} on")

    def align(self, texts: list[str]) -> dict[str, list | np.ndarray]:
        """For each text: n_a, n_b, n_groups, n_links, groups_sha256, and its pairs and links as lists."""
        n = len(texts)
        spaced = [" " + t for t in texts]
        ia, na = self.a.encode(spaced)
        ib, nb, good = self.b.encode(spaced)
        size = np.fromiter((len(t.encode()) for t in spaced), np.int64, n)
        edge = np.concatenate([[0], np.cumsum(na)])
        good &= (size > 1) & (np.diff(np.concatenate([[0], np.cumsum(self.a.size[ia])])[edge]) == size)
        ia, ib = ia[np.repeat(good, na)], ib[np.repeat(good, nb)]
        na, nb = np.where(good, na, 0), np.where(good, nb, 0)
        ga, gb = coalesce(np.cumsum(self.a.size[ia]), np.cumsum(self.b.size[ib]))
        groups = int(ga[-1]) + 1 if len(ga) else 0
        doc = np.zeros(groups, np.int64)
        doc[ga] = np.repeat(np.arange(n), na)
        text, ends = group_text(ga, ia, gb, ib)
        last = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
        ends = np.concatenate([[0], ends])[last]
        shas = [hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
        total = np.bincount(doc, np.bincount(ga, minlength=groups) * np.bincount(gb, minlength=groups), minlength=n).astype(np.int64) if groups else np.zeros(n, np.int64)
        of, pair, links = linked_pairs(ga, ia, gb, ib, doc)
        return {"n_a": na, "n_b": nb, "n_groups": np.diff(last), "n_links": total, "groups_sha256": shas, "offsets": np.searchsorted(of, np.arange(n + 1)), "pair": pair, "links": links}


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_path: str, piece_path: str) -> Aligner:
    """One a task process and pair of vocabularies."""
    key = byte_path, piece_path
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


COLUMNS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def linked_ids(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pair array<long>, links array<long>):
    each text's tokens, groups and links, and its distinct linked id pairs (a * 65536 + b) with the
    number of links of each.

    Null and empty texts, and those whose tokens don't give their bytes back, have no tokens; rows
    without an id take no part; repeated rows each give a row; other columns are ignored. The
    paths must be readable by every executor."""

    def run(batches):
        both = aligner(byte_path, piece_path)
        for batch in batches:
            column = batch.column(1)
            for lo, hi, _, _ in text_chunks(column):
                got = both.align(column.slice(lo, hi - lo).to_pylist())
                offsets = pa.array(got["offsets"].astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(got[c])) for c in ("pair", "links")]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, hi - lo), *[pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(got["groups_sha256"], pa.string()), *lists],
                    names=[c.split()[0] for c in COLUMNS.split(", ")] + ["pair", "links"],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"{COLUMNS}, pair array<long>, links array<long>")


def pair_counts(linked: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows hold each id pair linked, and whether no pair of its A id is
    held by more."""
    counts = linked.select(F.explode("pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.floor(F.col("pair") / ID))
    return counts.withColumn("best", F.col("n") == F.max("n").over(w))


def _shard(shards: int):
    """The pairs of each row (row, pair, links), a row for each shard that has any."""

    def run(batches):
        for batch in batches:
            pairs, links = batch.column(1), batch.column(2)
            row = np.repeat(np.arange(len(batch)), np.diff(pairs.offsets.to_numpy()))
            pair, link = pairs.flatten().to_numpy(), links.flatten().to_numpy()
            key = row * shards + pair // ID % shards
            order = np.argsort(key, kind="stable")
            key = key[order]
            new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            offsets = pa.array(np.append(new, len(key)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[order])) for x in (pair, link)]
            yield pa.record_batch([batch.column(0).take(pa.array(key[new] // shards)), pa.array((key[new] % shards).astype(np.int32)), *lists], names=["row", "shard", "pair", "value"])

    return run


def _look_up(batches):
    """Rows (shard, slice, row, pair, value) in order of the first three; the counts of a slice
    come first, without a row, and a value is there twice the count, plus one for the best."""
    here, known, table = None, [], None
    for batch in batches:
        at = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy().astype(np.int64)
        row = batch.column(2)
        counts = row.is_null().to_numpy(zero_copy_only=False)
        turns = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (counts[1:] != counts[:-1])])) if len(at) else np.zeros(0, np.int64)
        for a, b in zip(turns.tolist(), np.append(turns[1:], len(at)).tolist()):
            if at[a] != here:
                here, known, table = at[a], [], None
            pairs, values = (batch.column(c).slice(a, b - a) for c in (3, 4))
            flat, value = (x.flatten().to_numpy() for x in (pairs, values))
            if counts[a]:
                known.append((flat, value))
                continue
            if table is None:
                keys, found = (np.concatenate(x) for x in zip(*known))
                order = np.argsort(keys)
                table = keys[order], found[order]
            new = pairs.offsets.to_numpy()[:-1] - pairs.offsets.to_numpy()[0]
            got = table[1][np.searchsorted(table[0], flat)]
            yield pa.record_batch([row.slice(a, b - a), pa.array(np.add.reduceat(value * (got & 1), new)), pa.array(np.add.reduceat(value * (got >> 1), new))], names=["row", "n_best", "count_sum"])


def align_digest(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each row of
    linked_ids: n_best counts links whose pair is held by as many rows as any of their A id,
    count_sum sums the counts of all links. A row is a document, also where ids are shared."""
    linked = stage(linked_ids(docs, byte_path, piece_path, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "align-linked")
    counts = stage(pair_counts(linked), "align-counts")
    n_pairs, n_held = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    shards = 8 + n_pairs // SHARD_PAIRS
    slices = 1 + n_held // (shards * SLICE_LINKS)
    shard = F.pmod(F.floor(F.col("pair") / ID), F.lit(shards)).cast("int").alias("shard")
    packed = counts.select(shard, F.pmod(F.xxhash64("pair"), F.lit(1 + n_pairs // (shards * ROW_PAIRS))).alias("part"), F.struct("pair", (2 * F.col("n") + F.col("best").cast("long")).alias("value")).alias("x"))
    packed = packed.groupBy("shard", "part").agg(F.collect_list("x").alias("x"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    table = packed.select("shard", everywhere, F.lit(None).cast("long").alias("row"), F.col("x.pair").alias("pair"), F.col("x.value").alias("value"))
    rows = linked.select("row", "pair", "links").mapInArrow(_shard(shards), "row long, shard int, pair array<long>, value array<long>")
    rows = rows.select("shard", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int").alias("slice"), "row", "pair", "value")
    dealt = table.unionByName(rows).repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.col("row").asc_nulls_first())
    sums = dealt.mapInArrow(_look_up, "row long, n_best long, count_sum long").groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    sums = stage(sums, "align-sums")
    discard(counts)
    none = F.lit(0).cast("long")
    return linked.drop("pair", "links").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
