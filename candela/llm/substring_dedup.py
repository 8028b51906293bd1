"""Substring dedup by repeated-phrase automata.

A phrase is a window of consecutive words. The job

1. screens: content-defined anchors (the least 7-word gram of any 7 in a row) are
   counted over all documents; a phrase can recur only where its first anchor does;
2. confirms: the stretch of words around each recurring anchor (a cell, at most
   length + 8 words) is made distinct with the least and greatest doc_id that has it;
3. compiles: cells are dealt to shards of bounded size, and each shard compiles one
   Aho-Corasick automaton of the phrases seen in two documents, over word numbers;
4. streams every cell through its shard's automaton, which locates every phrase, and
   brings what was found back to every document.

Inside a hot passage a cell stays one distinct cell however many documents hold it. At its
edges cells also span the neighbouring words, so they differ by document: the phrases of an
anchor with very many cells are made distinct by an aggregate, one row of each goes to the
automata, and a join on the phrase brings the owners back to the cells. A document's own words
are fingerprinted again before any is removed. Fingerprints are made with a key that each run draws
for itself, so no text can be written whose words pass for others.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import SEPARATOR, SliceHash, Words, cells, covered, mix, new_key, text_chunks
from .stage import discard, id_and_text, stage

GRAM = 7
#: Distinct cells of a shard's automaton, and of one anchor before it is dealt out by phrase.
SHARD_CELLS = 4_000
HOT_ANCHOR_CELLS = 2_000


#: What tells cells of equal words from others, beside the anchor's fingerprint.
_CELL_SEED = 11


def _cells(words: Words, slices: SliceHash, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, their gram fingerprints, and the words (start, stop) of all windows that each anchors."""
    grams = np.zeros(len(words.start), np.uint64)
    fixed = slices.fixed(GRAM)
    grams[: len(fixed)] = fixed
    at, first, last = cells(grams, words.doc_end(), length - GRAM + 1, GRAM)
    return at, grams[at], first, last + length


def _own(words: Words, slices: SliceHash, parts: pa.StructArray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, start, stop) of the parts that are cells of these very words: another row may
    have the same doc_id and other words."""
    start = parts.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + words.off[doc]
    stop = start + parts.field("n").to_numpy(zero_copy_only=False)
    fits = np.flatnonzero(stop <= words.off[doc + 1])
    same = slices.of(start[fits], stop[fits], _CELL_SEED).view(np.int64) == parts.field("cell").to_numpy(zero_copy_only=False)[fits]
    fits = fits[same]
    return fits, start[fits], stop[fits]


def _emit_cells(length: int, key: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_chunks(batch.column(1)):
                words = Words(data, off)
                slices = SliceHash(words.hashes(key))
                at, grams, start, stop = _cells(words, slices, length)
                doc = np.searchsorted(words.off, at, side="right") - 1
                cell = slices.of(start, stop, _CELL_SEED)
                yield pa.record_batch(
                    [pa.array(grams.view(np.int64)), pa.array(cell.view(np.int64)), pa.array(ids[lo:hi][doc]), pa.array((start - words.off[doc]).astype(np.int32)), pa.array((stop - start).astype(np.int32))],
                    names=["anchor", "cell", "doc_id", "start", "n"],
                )

    return run


def _emit_words(key: int):
    """The words of each document's wanted cells, joined by one space."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(0)):
                words = Words(data, off)
                part = batch.column(1).slice(lo, hi - lo)
                doc = np.repeat(np.arange(hi - lo), np.diff(part.offsets.to_numpy()))
                flat = part.flatten()
                keep, start, stop = _own(words, SliceHash(words.hashes(key)), flat, doc)
                flat = flat.take(pa.array(keep))
                joined, w0, w1 = words.joined()
                text = [joined[a:b] for a, b in zip(w0[start].tolist(), w1[stop - 1].tolist())]
                yield pa.record_batch([flat.field(c) for c in ("anchor", "cell", "lo", "hi", "n_cells")] + [pa.array(text, pa.binary()).cast(pa.string())], names=["anchor", "cell", "lo", "hi", "n_cells", "words"])

    return run


def _automaton(length: int, key: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """One shard: its passages seen in two documents as an automaton, its cells through it.

        The passage of an anchor with one cell is that cell; otherwise each phrase is one. A
        word is two letters, its number's digits in a base about the root of the vocabulary,
        each digit with letters of its own: no node of the automaton has many children, and
        matches keep to whole words. Gives runs of phrases: offset, count, owner. Rows with a
        phrase are one phrase of a hot anchor, known by its words alone."""
        numbers: dict[str, int] = {}
        split = [text.split(" ") for text in rows["words"]]
        size = np.array([len(c) for c in split], np.int64)
        flat = np.array([numbers.setdefault(w, len(numbers)) for c in split for w in c], np.int64)
        digits = int(np.sqrt(len(numbers))) + 1
        text = (256 + np.stack([flat // digits, digits + flat % digits], 1).ravel()).astype("<u4").tobytes().decode("utf-32-le")
        begin = np.cumsum(size) - size
        lo, hi, base = rows["lo"].to_numpy(), rows["hi"].to_numpy(), rows["base"].tolist()
        many = rows["n_cells"].to_numpy() > 1
        windows = np.where(many, size - length + 1, 0)
        of = np.repeat(np.arange(len(size)), windows)
        at = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
        code = SliceHash(mix(flat.astype(np.uint64) ^ np.uint64(key))).fixed(length)[at]
        order = np.argsort(code, kind="stable")
        code, of, at = code[order], of[order], at[order]
        new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
        least, most = (np.minimum.reduceat(lo[of], new), np.maximum.reduceat(hi[of], new)) if len(new) else (lo[:0], hi[:0])
        confirmed = least < most
        whole = np.flatnonzero(~many & (lo < hi))
        starts = np.concatenate([at[new[confirmed]], begin[whole]]).tolist()
        lengths = np.concatenate([np.full(int(confirmed.sum()), length), size[whole]]).tolist()
        owners = np.concatenate([least[confirmed], lo[whole]]).tolist()
        found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, (a, n) in enumerate(zip(starts, lengths)):
            found.add_word(text[2 * a : 2 * (a + n)], number)
        keep, offsets, counts, values = [], [], [], []
        if owners:
            found.make_automaton()
            for i, (a, n, b, top) in enumerate(zip(begin.tolist(), size.tolist(), base, hi.tolist())):
                o, c, v = [], [], []
                for end, number in found.iter(text[2 * a : 2 * (a + n)]):
                    owner = owners[number]
                    if owner < top:
                        size_ = lengths[number]
                        first = b + end // 2 - size_ + 1
                        if o and v[-1] == owner and o[-1] + c[-1] == first:
                            c[-1] += size_ - length + 1
                        else:
                            o.append(first)
                            c.append(size_ - length + 1)
                            v.append(owner)
                if o:
                    keep.append(i)
                    offsets.append(o)
                    counts.append(c)
                    values.append(v)
        return pd.DataFrame({"anchor": rows["anchor"].iloc[keep], "cell": rows["cell"].iloc[keep], "offsets": offsets, "counts": counts, "owners": values, "phrase": rows["phrase"].iloc[keep]})

    return run


def _phrases(cells_: DataFrame, length: int) -> DataFrame:
    """(anchor, cell, lo, hi, base, phrase): a row for each phrase of each cell, by its words."""
    return cells_.withColumn("w", F.split("words", " ", -1)).select(
        "anchor", "cell", "lo", "hi", F.posexplode(F.expr(f"transform(sequence(0, size(w) - {length}), j -> array_join(slice(w, j + 1, {length}), ' '))")).alias("base", "phrase")
    )


def find_repeats(docs: DataFrame, length: int, key: int) -> DataFrame:
    """(doc_id, parts array<struct<start,n,cell,offsets,counts,owners>>): stretches of words of
    each document (start, n) that hold phrases; phrases start there at the offsets, as runs of
    counts, and their words start first in the document `owners`. The fingerprint `cell` tells
    whether a row has the words meant. Documents without any are left out.

    docs: doc_id long not null, text string not null. Words are runs of anything but space
    and \\t to \\r."""
    here = docs.select("doc_id", "text")
    found = here.mapInArrow(_emit_cells(length, key), "anchor long, cell long, doc_id long, start int, n int")
    recurring = stage(found.groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor"), "phrase-anchors")  # staged, so that a hot anchor's rows can be split
    cells_ = stage(found.join(recurring, "anchor"), "phrase-cells")
    discard(recurring)
    kinds = stage(cells_.groupBy("anchor", "cell").agg(F.min(F.struct("doc_id", "start", "n")).alias("least"), F.max("doc_id").alias("hi")), "phrase-kinds")
    per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("n_cells"), F.min("least.doc_id").alias("a_lo"), F.max("hi").alias("a_hi")).where("a_lo < a_hi")
    wanted = kinds.join(per_anchor, "anchor").select(
        F.col("least.doc_id").alias("doc_id"),
        F.struct("anchor", "cell", F.col("least.start").alias("start"), F.col("least.n").alias("n"), F.col("least.doc_id").alias("lo"), "hi", "n_cells").alias("part"),
    )
    wanted = wanted.groupBy("doc_id").agg(F.collect_list("part").alias("parts"))
    live = stage(here.join(wanted, "doc_id").select("text", "parts").mapInArrow(_emit_words(key), "anchor long, cell long, lo long, hi long, n_cells long, words string"), "phrase-words")
    discard(kinds)
    hot = _phrases(live.where(F.col("n_cells") > HOT_ANCHOR_CELLS), length)
    # minima and maxima combine before the shuffle: a phrase of any number of cells is a few rows
    distinct = stage(hot.groupBy("phrase").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi"), "phrase-hot")
    cool = live.where(F.col("n_cells") <= HOT_ANCHOR_CELLS)
    shards = max(1, -(-(cool.count() + distinct.count()) // SHARD_CELLS))
    cool = cool.select("anchor", "cell", "n_cells", "lo", "hi", F.lit(0).alias("base"), "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"), F.lit(None).cast("string").alias("phrase"))
    no = F.lit(0).cast("long")  # not null: pandas would make the shard's keys floats
    once = distinct.select(no.alias("anchor"), no.alias("cell"), F.lit(2).cast("long").alias("n_cells"), "lo", "hi", F.lit(0).alias("base"), F.col("phrase").alias("words"), F.pmod(F.xxhash64("phrase"), F.lit(shards)).alias("shard"), "phrase")
    runs = "offsets array<int>, counts array<int>, owners array<long>"
    matched = stage(cool.unionByName(once).groupBy("shard").applyInPandas(_automaton(length, key), f"anchor long, cell long, {runs}, phrase string"), "phrase-matched")
    owners = matched.where("phrase is not null").select("phrase", F.col("owners")[0].alias("owner"))
    hot = hot.join(owners, "phrase").where("owner < hi").select("anchor", "cell", F.array("base").alias("offsets"), F.array(F.lit(1)).alias("counts"), F.array("owner").alias("owners"))
    located = matched.where("phrase is null").drop("phrase").unionByName(stage(hot, "phrase-located"))
    discard(live, distinct)
    parts = cells_.join(located, ["anchor", "cell"]).where(F.array_min("owners") < F.col("doc_id"))
    return parts.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "cell", "offsets", "counts", "owners")).alias("parts"))


def _gone(words: Words, parts: pa.Array, ids: np.ndarray, length: int, key: int) -> np.ndarray:
    """Mask of the words of a chunk that are removed; ids: doc_id of each document."""
    sizes = pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False)
    doc, flat = np.repeat(np.arange(len(parts)), sizes), parts.flatten()
    keep, start, _ = _own(words, SliceHash(words.hashes(key)), flat, doc)
    flat, doc = flat.take(pa.array(keep)), doc[keep]
    lists = [flat.field(c) for c in ("offsets", "counts", "owners")]
    each = np.repeat(np.arange(len(keep)), pc.list_value_length(lists[0]).to_numpy(zero_copy_only=False))
    offset, count, owner = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in lists)
    earlier = owner < ids[doc[each]]
    return covered((start[each] + offset)[earlier], count[earlier], length, len(words.start))


def _finish(length: int, digest: bool, key: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in text_chunks(batch.column(1)):
                words = Words(data, off)
                keep = ~_gone(words, batch.column(2).slice(lo, hi - lo), ids[lo:hi], length, key)
                size = words.end - words.start
                # the kept words with one space after each
                inside = np.repeat(keep, size)
                end = np.cumsum(np.where(keep, size + 1, 0))
                out = np.full(int(end[-1]) if len(end) else 0, 32, np.uint8)
                letters = np.ones(len(out), bool)
                letters[end[keep] - 1] = False
                out[letters] = data[~SEPARATOR[data]][inside]
                joined, edge = out.tobytes(), np.concatenate([[0], end])[words.off].tolist()
                bodies = [joined[a : max(a, b - 1)] for a, b in zip(edge[:-1], edge[1:])]
                kept = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.off])
                doc_id = batch.column(0).slice(lo, hi - lo)
                if digest:
                    yield pa.record_batch([doc_id, pa.array(words.count.astype(np.int64)), pa.array((words.count - kept).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in bodies], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
                else:
                    yield pa.record_batch([doc_id, pa.array(bodies, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return run


def _with_parts(docs: DataFrame, length: int, key: int) -> DataFrame:
    if length < GRAM:
        raise ValueError(f"a phrase has at least {GRAM} words")
    return docs.join(find_repeats(docs, length, key), "doc_id", "left").select("doc_id", "text", "parts")


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): each document's words without those covered by a window of `length`
    words that also starts in a document with a smaller id, joined by one space.

    Null text counts as empty; rows without an id take no part; rows that share an id each
    give a row of their own words, and none of them counts as earlier than another; other
    columns are ignored."""
    key = new_key()
    return _with_parts(id_and_text(docs, id_col, text_col), length, key).mapInArrow(_finish(length, False, key), "doc_id long, text string")


def repeat_digest(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of what remove_repeats keeps."""
    key = new_key()
    return _with_parts(id_and_text(docs, id_col, text_col), length, key).mapInArrow(_finish(length, True, key), "doc_id long, n_words long, n_removed long, kept_sha256 string")
