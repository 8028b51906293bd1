"""Suffix-array dedup by distributed prefix doubling.

A byte is removed where it lies in a string of `length` bytes that also starts anywhere
else. Sorting every suffix of the corpus is not needed for that: equal strings hold
equal content-defined positions (the least gram of a window of grams), so only those
positions are ranked, about one byte in thirty.

1. Positions get the fingerprint of their first `PREFIX` bytes as rank; positions whose
   rank is unique are out. Then rank pairs (rank at i, name at i + offset) are grouped at
   offsets that double, each group takes its least position as the new rank, and unique
   ones leave, until the rank covers every byte that all strings of the position share.
2. What is left is past that threshold. A position's cell spans all the strings that it
   anchors: where a whole cell recurs, all its strings do. Where cells of one rank differ,
   one of each kind gives blocks of strings; where what a block's strings share recurs, they
   are ranked one by one.

Fingerprints are made with a key that each run draws for itself, so no bytes can be written that
pass for others. Ranks come from sums grouped before the shuffle, so a passage in a third of all
documents is one group of a few partial rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SliceHash, cells, covered, mix, new_key, text_chunks
from .stage import discard, id_and_text, stage

GRAM = 16
PREFIX = 64
BLOCK = 8
_CELL_SEED = 3
#: So that anchors and prefixes have the bytes that fingerprints take at least.
LEAST_LENGTH = 48


def _windows(length: int) -> tuple[int, list[int]]:
    """Grams of a window's anchor choice, and the doubling lengths of a position's prefix.

    The anchor starts in the first half of its strings at the latest, so that every
    string has at least half its bytes after it."""
    sizes = [min(PREFIX, max(1, length // 3))]
    w = max(1, min(length - GRAM + 1, length // 3 + 5))
    while sizes[-1] * 2 <= length - w + 1:
        sizes.append(sizes[-1] * 2)
    return w, sizes


def _cells_of(data: np.ndarray, off: np.ndarray, length: int, key: int):
    rolling = SliceHash.of_bytes(data, key)
    w, sizes = _windows(length)
    k = min(GRAM, length - w + 1)
    grams = np.zeros(len(data), np.uint64)
    fixed = rolling.fixed(k)
    grams[: len(fixed)] = fixed
    end = np.repeat(off[1:], np.diff(off))
    # the choice looks at w grams from a string's start only; the string itself may be longer
    at, first, last = cells(grams, end - (length - w - k + 1), w, k)
    return rolling, sizes, at, first, last + length


def _emit_ranks(length: int, key: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_chunks(batch.column(1)):
                rolling, sizes, at, _, _ = _cells_of(data, off, length, key)
                doc = np.searchsorted(off, at, side="right") - 1
                yield pa.record_batch([pa.array(rolling.of(at, at + sizes[0]).view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array((at - off[doc]).astype(np.int32))], names=["rank", "doc_id", "pos"])

    return run


def _wanted_mask(column: pa.Array, off: np.ndarray, n: int) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(off[:-1], sizes)
    mask = np.zeros(n + 1, bool)
    mask[flat[flat < n]] = True
    return mask


def _emit_cells(length: int, key: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_chunks(batch.column(1)):
                rolling, sizes, at, start, stop = _cells_of(data, off, length, key)
                keep = _wanted_mask(batch.column(2).slice(lo, hi - lo), off, len(data))[at]
                at, start, stop = at[keep], start[keep], stop[keep]
                doc = np.searchsorted(off, at, side="right") - 1
                names = [rolling.of(at + s, at + 2 * s) for s in sizes[:-1]]
                columns = {"rank": rolling.of(at, at + sizes[0]), "cell": rolling.of(start, stop, _CELL_SEED)}
                columns |= {f"name{i}": x for i, x in enumerate(names)}
                yield pa.record_batch(
                    [pa.array(x.view(np.int64)) for x in columns.values()] + [pa.array(ids[lo:hi][doc]), pa.array((start - off[doc]).astype(np.int32)), pa.array((stop - start - length + 1).astype(np.int32)), pa.array((at - start).astype(np.int32))],
                    names=[*columns, "doc_id", "start", "n_strings", "lead"],
                )

    return run


def _same(rolling: SliceHash, off: np.ndarray, doc: np.ndarray, start: np.ndarray, count: np.ndarray, name: np.ndarray, length: int) -> np.ndarray:
    """Numbers of the cells that are what their fingerprint says: another row may have the same
    doc_id and other bytes. start: within the document."""
    fits = np.flatnonzero(off[doc] + start + count - 1 + length <= off[doc + 1])
    begin = off[doc[fits]] + start[fits]
    return fits[rolling.of(begin, begin + count[fits] - 1 + length, _CELL_SEED).view(np.int64) == name[fits]]


def _emit_strings(length: int, key: int):
    """The strings of cells in blocks counted back from the anchor: the fingerprint of what
    all strings of a whole block share, and those of the strings."""
    block = min(BLOCK, length)

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_chunks(batch.column(1)):
                rolling = SliceHash.of_bytes(data, key)
                part = batch.column(2).slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                flat = part.flatten()
                start, count, lead, rank, name = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "n_strings", "lead", "rank", "cell"))
                own = _same(rolling, off, doc, start, count, name, length)
                doc, start, count, lead, rank = doc[own], start[own], count[own], lead[own], rank[own]
                cell = np.repeat(np.arange(len(doc)), count)
                step = np.arange(len(cell)) - np.repeat(np.cumsum(count) - count, count)
                at = off[doc[cell]] + start[cell] + step
                back = (lead[cell] - step) // block
                new = np.flatnonzero(np.concatenate([[True], (cell[1:] != cell[:-1]) | (back[1:] != back[:-1])])) if len(cell) else np.zeros(0, np.int64)
                own = cell[new]
                near = off[doc[own]] + start[own] + lead[own] - block * back[new]  # where the block's last string starts
                core = mix(rolling.fixed(length - block + 1)[near] + back[new].astype(np.uint64))
                strings = rolling.fixed(length)[at].view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.append(new, len(cell)).astype(np.int32)), pa.array(strings))
                yield pa.record_batch([pa.array(rank[own]), pa.array(core.view(np.int64)), lists, pa.array(ids[lo:hi][doc[own]]), pa.array((start[own] + step[new]).astype(np.int32))], names=["rank", "core", "strings", "doc_id", "start"])

    return run


def find_repeats(docs: DataFrame, length: int, key: int) -> DataFrame:
    """(doc_id, runs array<struct<start,count,name,whole>>): where strings of `length` bytes start
    that also start anywhere else, as runs of starts; the fingerprint `name`, of the whole
    run or of the single string, tells whether a row has the bytes meant. Documents without
    any are left out.

    docs: doc_id long not null, text string not null."""
    here = docs.select("doc_id", "text")
    _, sizes = _windows(length)
    positions = here.mapInArrow(_emit_ranks(length, key), "rank long, doc_id long, pos int")
    repeated = stage(positions.groupBy("rank").agg(F.count("*").alias("n")).where("n > 1").select("rank"), "suffix-prefixes")  # staged, so that a hot rank's rows can be split
    candidates = stage(positions.join(repeated, "rank").groupBy("doc_id").agg(F.collect_set("pos").alias("wanted")), "suffix-positions")
    names = [f"name{i}" for i in range(len(sizes) - 1)]
    schema = "rank long, cell long, " + "".join(f"{x} long, " for x in names) + "doc_id long, start int, n_strings int, lead int"
    ranked = stage(here.join(candidates, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_emit_cells(length, key), schema), "suffix-ranks-0")
    discard(candidates, repeated)
    for i, name in enumerate(names):
        pairs = ranked.groupBy("rank", name).agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start")).alias("least")).where("n > 1")
        pairs = stage(pairs.select("rank", name, F.xxhash64("least.doc_id", "least.start", "rank", name).alias("next_rank")), "suffix-pairs")  # staged as repeated is
        was, ranked = ranked, stage(ranked.join(pairs, ["rank", name]).drop("rank", name).withColumnRenamed("next_rank", "rank"), f"suffix-ranks-{i + 1}")
        discard(was, pairs)
    kinds = stage(ranked.groupBy("rank", "cell").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "start", "n_strings", "lead")).alias("least")), "suffix-kinds")
    per_rank = kinds.groupBy("rank").agg(F.count("*").alias("n_kinds"), F.sum("n").alias("n_all")).where("n_all > 1")
    again = stage(kinds.where("n > 1").select("rank", "cell"), "suffix-again")
    whole_runs = stage(ranked.join(again, ["rank", "cell"]).select("doc_id", "start", F.col("n_strings").alias("count"), F.col("cell").alias("name"), F.lit(True).alias("whole")), "suffix-whole")
    discard(ranked, again)
    samples = kinds.join(per_rank.where("n_kinds > 1").select("rank"), "rank").select("least.doc_id", F.struct("least.start", "least.n_strings", "least.lead", "rank", "cell").alias("part"))
    sampled = samples.groupBy("doc_id").agg(F.collect_list("part").alias("parts"))
    blocks = stage(here.join(sampled, "doc_id").select("doc_id", "text", "parts").mapInArrow(_emit_strings(length, key), "rank long, core long, strings array<long>, doc_id long, start int"), "suffix-blocks")
    cores = blocks.groupBy("rank", "core").agg(F.count("*").alias("n")).where("n > 1").select("rank", "core")
    strings = stage(blocks.join(cores, ["rank", "core"]).select("rank", "doc_id", "start", F.posexplode("strings").alias("i", "string")), "suffix-strings")
    discard(blocks, kinds)
    seen = strings.groupBy("rank", "string").agg(F.count("*").alias("n")).where("n > 1").select("rank", "string")
    single_runs = stage(strings.join(seen, ["rank", "string"]).select("doc_id", (F.col("start") + F.col("i")).alias("start"), F.lit(1).alias("count"), F.col("string").alias("name"), F.lit(False).alias("whole")), "suffix-single")
    discard(strings)
    return whole_runs.unionByName(single_runs).groupBy("doc_id").agg(F.collect_list(F.struct("start", "count", "name", "whole")).alias("runs"))


def _gone(data: np.ndarray, off: np.ndarray, runs: pa.Array, length: int, key: int) -> np.ndarray:
    """Mask of the bytes of a chunk that are removed."""
    sizes = pc.fill_null(pc.list_value_length(runs), 0).to_numpy(zero_copy_only=False)
    doc, flat = np.repeat(np.arange(len(runs)), sizes), runs.flatten()
    if not len(flat):
        return np.zeros(len(data), bool)
    start, count, name = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "count", "name"))
    whole = flat.field("whole").to_numpy(zero_copy_only=False)
    rolling = SliceHash.of_bytes(data, key)
    cell = np.flatnonzero(whole)
    cell = cell[_same(rolling, off, doc[cell], start[cell], count[cell], name[cell], length)]
    single = np.flatnonzero(~whole & (off[doc] + start + length <= off[doc + 1]))
    if len(single):
        single = single[rolling.fixed(length)[off[doc[single]] + start[single]].view(np.int64) == name[single]]
    keep = np.concatenate([cell, single])
    return covered(off[doc[keep]] + start[keep], count[keep], length, len(data))


def _finish(length: int, digest: bool, key: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(1)):
                gone = _gone(data, off, batch.column(2).slice(lo, hi - lo), length, key)
                rest = data[~gone].tobytes()
                edge = (off - np.concatenate([[0], np.cumsum(gone)])[off]).tolist()
                bodies = [rest[a:b] for a, b in zip(edge[:-1], edge[1:])]
                doc_id = batch.column(0).slice(lo, hi - lo)
                if not digest:
                    yield pa.record_batch([doc_id, pa.array([x.decode(errors="ignore") for x in bodies], pa.string())], names=["doc_id", "text"])
                    continue
                first = gone.copy()
                first[1:] &= ~gone[:-1]
                starts = off[:-1][off[:-1] < off[1:]]
                first[starts] = gone[starts]
                spans, size = np.diff(np.concatenate([[0], np.cumsum(first)])[off]), np.diff(off)
                yield pa.record_batch([doc_id, pa.array(size), pa.array(size - np.diff(edge)), pa.array(spans.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def _with_runs(docs: DataFrame, length: int, key: int) -> DataFrame:
    if length < LEAST_LENGTH:
        raise ValueError(f"a string has at least {LEAST_LENGTH} bytes")
    return docs.join(find_repeats(docs, length, key), "doc_id", "left").select("doc_id", "text", "runs")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the texts without every byte that lies in a string of `length` bytes
    that also starts anywhere else in the corpus; a character cut apart goes whole.

    Null text counts as empty; rows without an id take no part; rows that share an id each
    give a row of their own bytes, and equal ones repeat each other; other columns are
    ignored."""
    key = new_key()
    return _with_runs(id_and_text(docs, id_col, text_col), length, key).mapInArrow(_finish(length, False, key), "doc_id long, text string")


def repeat_digest(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what remove_repeats keeps, in bytes."""
    key = new_key()
    return _with_runs(id_and_text(docs, id_col, text_col), length, key).mapInArrow(_finish(length, True, key), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
