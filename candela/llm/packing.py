"""Packing by minimum bin slack.

Documents are tokenised and cut where they are read; what moves on is one small row a
piece. The plan needs only how many pieces there are of each length, at most `capacity`
numbers: the longest length left opens a bin, bitset subset-sum dynamic programming over
the available lengths finds the fullest combination, and that combination is removed as
often as the counts allow. Every step takes at least half of what is left of some length,
so the plan is bounded by the capacity and not by the corpus. Pieces then find their place
from their number among the pieces of their length.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PairRanks, latin_1, slices
from .stage import id_and_text, stage

REMEMBERED, REMEMBERED_WORDS = 600_000, 500_000
LONGEST_REMEMBERED = 64
#: Characters of text that are cut and learnt at once.
BATCH_CHARS = 1 << 20


def fullest(first: int, counts: dict[int, int], lengths: list[int], capacity: int) -> list[int]:
    """The fullest bin that holds `first`: its lengths. lengths: those with a count, descending."""
    room = capacity - first
    reach, limit, steps = 1, (1 << (room + 1)) - 1, []
    for length in lengths:
        if reach >> room & 1:
            break
        have = min(counts[length] - (length == first), room // length)
        take = 1
        while have > 0:
            take = min(take, have)
            grown = reach | (reach << (length * take)) & limit
            if grown != reach:
                steps.append((length, take, reach))
                reach = grown
            have -= take
            take *= 2
    at, out = reach.bit_length() - 1, [first]
    for length, take, was in reversed(steps):
        if not was >> at & 1:
            out += [length] * take
            at -= length * take
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[Counter, int]]:
    """(lengths of a bin, how many such bins), until every piece is placed."""
    left = {k: v for k, v in counts.items() if v > 0}
    order, plan = sorted(left, reverse=True), []
    while order:
        bin_ = Counter(fullest(order[0], left, order, capacity))
        times = min(left[k] // v for k, v in bin_.items())
        plan.append((bin_, times))
        for k, v in bin_.items():
            left[k] -= v * times
            if not left[k]:
                del left[k]
                order.remove(k)
    return plan


def _places(plan: list[tuple[Counter, int]]) -> dict[int, list[np.ndarray]]:
    """By length: the first piece number of each run, its first bin, pieces a bin, and offset."""
    used, out, first_bin = Counter(), {}, 0
    for bin_, times in plan:
        offset = 0
        for length in sorted(bin_, reverse=True):
            out.setdefault(length, []).append((used[length], first_bin, bin_[length], offset))
            used[length] += bin_[length] * times
            offset += bin_[length] * length
        first_bin += times
    return {k: list(np.array(v, np.int64).T) for k, v in out.items()}


_STOPS = frozenset(".,;:!?")
#: Of each Latin-1 byte: a letter, white space, a mark in _STOPS, or # for any other.
_KINDS = bytes(ord("a" if c.isalpha() else " " if c in " \n\t\r" else "." if c in _STOPS else "#") for c in map(chr, range(256)))
_NONE = PairRanks.NONE


class MergeTable(PairRanks):
    """The merges of a byte-level BPE model with an end-of-word suffix, and words in bulk.

    Words of up to WIDTH bytes are rows of a matrix: every round merges the leftmost
    lowest-ranked pair of each row that still has one, for all rows at once."""

    WIDTH = 32

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str):
        letters = _byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        super().__init__(*(np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1)))

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of 1 to WIDTH bytes, as little-endian 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), 8192):
            rows = order[lo : lo + 8192]
            ids, count = self._rows([words[i] for i in rows.tolist()], size[rows])
            flat, end = ids.tobytes(), (4 * np.cumsum(count)).tolist()
            for i, a, b in zip(rows.tolist(), [0, *end], end):
                out[i] = flat[a:b]
        return out

    def _rows(self, words: list[bytes], size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, width = len(words), int(size.max()) + 1  # the last column is a sentinel
        ids = np.full((n, width), -1, np.int32)
        inside = np.arange(width)[None, :] < size[:, None]
        data = np.frombuffer(b"".join(words), np.uint8)
        ids[inside] = self.inner[data]
        ids[np.arange(n), size - 1] = self.last[data[np.cumsum(size) - 1]]
        rank = np.full((n, width), _NONE, np.int32)
        rank[:, :-1] = self.rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        after = np.tile(np.arange(1, width + 1, dtype=np.int32), (n, 1))
        before = np.tile(np.arange(-1, width - 1, dtype=np.int32), (n, 1))
        flat, ranks, nxt, prv = ids.reshape(-1), rank.reshape(-1), after.reshape(-1), before.reshape(-1)
        live = np.arange(n)
        while len(live):
            at = rank[live].argmin(1)
            base = live * width
            best = ranks[base + at]
            some = best < _NONE
            live, at, base, best = live[some], at[some], base[some], best[some]
            if not len(live):
                break
            here, gone = base + at, base + nxt[base + at]
            follow = nxt[gone]
            flat[here], nxt[here] = self.made[best], follow
            flat[gone], ranks[gone] = -1, _NONE
            prv[base + np.minimum(follow, width - 1)] = at
            ranks[here] = self.rank(flat[here], flat[base + np.minimum(follow, width - 1)])
            led = prv[here]
            has = led >= 0
            ahead = base[has] + led[has]
            ranks[ahead] = self.rank(flat[ahead], flat[here[has]])
        alive = ids >= 0
        return ids[alive].astype("<u4"), alive.sum(1)


def _byte_letters() -> list[str]:
    """The printable letter that byte-level models use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    return [other.get(b, chr(b)) for b in range(256)]


class ChunkTokens:
    """Ids of texts, as little-endian bytes; each new word is merged once.

    A text of Latin-1 is lower-cased and cut into words as a whole. Any other goes by white-space
    chunks, which no token crosses: a new chunk of plain Latin letters, digits and marks is
    normalised and cut into words here; what is left goes to the tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.model, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        for m in (self.model, self.plain):
            m.no_truncation()
            m.no_padding()
        form = json.loads(self.model.to_str())
        steps = [x["type"] for x in (form["normalizer"] or {}).get("normalizers", [])]
        split = ((form["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.cut = self.latin = self.merges = None
        if steps == ["NFC", "Replace", "Lowercase"] and split.get("behavior") == "Removed" and split.get("invert"):
            self.cut, self.latin = regex.compile(split["pattern"]["Regex"]).findall, latin_1(split["pattern"]["Regex"]).findall
            self.plain.normalizer = normalizers.Sequence([])
            self.plain.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            model = form["model"]
            if model["type"] == "BPE" and model["end_of_word_suffix"] and not (model["dropout"] or model["continuing_subword_prefix"] or model["byte_fallback"] or model.get("ignore_merges")):
                suffix = model["end_of_word_suffix"]
                if all(c in model["vocab"] and c + suffix in model["vocab"] for c in _byte_letters()):
                    self.merges = MergeTable(model["vocab"], model["merges"], suffix)
        self.special = [t["content"] for t in form["added_tokens"]]
        self.known: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _words(self, chunk: str) -> list[str] | None:
        """The words of a chunk of Latin up to U+024F, which is composed already and whose
        lower case does not depend on neighbours; None for any other."""
        if not (chunk.isascii() or max(chunk) < "\u0250"):
            return None
        low = chunk.lower()
        if low.isalpha():
            return [low]
        if low[-1:] in _STOPS and low[:-1].isalpha():
            return [low[:-1], low[-1]]
        return None if any(t in chunk for t in self.special) else self.cut(low)

    def _encode_words(self, words: list[str]) -> list[bytes]:
        raw = [w.encode() for w in words]
        if self.merges is not None and max(map(len, raw), default=0) <= MergeTable.WIDTH:
            return self.merges.encode(raw)
        out: list[bytes] = [b""] * len(words)
        fits = [i for i, w in enumerate(raw) if self.merges is not None and len(w) <= MergeTable.WIDTH]
        for i, ids in zip(fits, self.merges.encode([raw[i] for i in fits]) if fits else []):
            out[i] = ids
        rest = [i for i, w in enumerate(raw) if self.merges is None or len(w) > MergeTable.WIDTH]
        for lo in range(0, len(rest), 1000):
            part = rest[lo : lo + 1000]
            e = self.plain.encode([words[i] for i in part], is_pretokenized=True, add_special_tokens=False)
            ids, at = np.array(e.ids, "<u4"), np.searchsorted(np.array(e.word_ids, np.int64), np.arange(len(part) + 1)).tolist()
            for i, a, b in zip(part, at[:-1], at[1:]):
                out[i] = ids[a:b].tobytes()
        return out

    def _word_ids(self, met: set[str]) -> dict[str, bytes]:
        """Ids of each word met. words holds those of the words met before, within a bound."""
        words = self.words
        out = dict(zip(met, map(words.get, met)))
        fresh = [w for w, ids in out.items() if ids is None]
        learnt = dict(zip(fresh, self._encode_words(fresh)))
        out |= learnt
        if len(words) + len(learnt) > REMEMBERED_WORDS:
            words.clear()
            learnt = out
        words.update((w, ids) for w, ids in learnt.items() if len(w) <= LONGEST_REMEMBERED)
        return out

    def _learn(self, new: list[str]) -> None:
        """Ids of new chunks into known."""
        known = self.known
        cut = list(map(self._words, new)) if self.cut else [None] * len(new)
        hard = [c for c, ws in zip(new, cut) if ws is None]
        known.update((c, np.array(e.ids, "<u4").tobytes()) for c, e in zip(hard, self.model.encode_batch_fast(hard, add_special_tokens=False)))
        words = self._word_ids({w for ws in cut if ws is not None for w in ws})
        for c, ws in zip(new, cut):
            if ws is not None:
                known[c] = words[ws[0]] if len(ws) == 1 else b"".join([words[w] for w in ws])

    def _latin_words(self, text: str) -> list[str] | None:
        """The words of a text of Latin-1, which is composed and lower-cases to itself; None for any other."""
        try:
            kinds = text.encode("latin-1").translate(_KINDS)
        except UnicodeEncodeError:
            return None
        if self.latin is None or any(t in text for t in self.special):
            return None
        low = text.lower()
        if b"#" in kinds or b".." in kinds:
            return self.latin(low)
        for c in _STOPS:
            if c in low:
                low = low.replace(c, f" {c} ")
        return low.split()

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. What is remembered is bounded; a batch of texts is learnt at once."""
        cut = list(map(self._latin_words, texts))
        words = self._word_ids(set().union(*[ws for ws in cut if ws is not None]))
        get, others = words.__getitem__, iter(self._chunk_ids([t for t, ws in zip(texts, cut) if ws is None]))
        return [next(others) if ws is None else b"".join(map(get, ws)) for ws in cut]

    def _chunk_ids(self, texts: list[str]) -> list[bytes]:
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        known, fresh = self.known, set()
        for chunks in split:
            fresh |= set(chunks).difference(known)
        if len(known) + len(fresh) > REMEMBERED:
            known.clear()
            fresh = set().union(*split)
        self._learn(list(fresh))
        get = known.__getitem__
        out = [b"".join(map(get, chunks)) for chunks in split]
        for c in [c for c in fresh if len(c) > LONGEST_REMEMBERED]:
            del known[c]
        return out


_models: dict[str, ChunkTokens] = {}


def _cut(path: str, capacity: int, end_id: int):
    def run(batches):
        if path not in _models:
            _models[path] = ChunkTokens(path)
        model = _models[path]
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end, step = np.array([end_id], "<u4").tobytes(), capacity * 4
        for batch in batches:
            docs = batch.column(0)
            for first, texts in slices(batch.column(1), BATCH_CHARS):
                bodies = [ids + end for ids in model.ids(texts)]
                total = np.array([len(b) // 4 for b in bodies], np.int64)
                pieces = -(-total // capacity)
                of = np.repeat(np.arange(len(bodies)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                length = np.minimum(total[of] - piece * capacity, capacity)
                crc = [zlib.crc32(b) if len(b) <= step else zlib.crc32(b[i * step : (i + 1) * step]) for b, n in zip(bodies, pieces.tolist()) for i in range(n)]
                # the number of each piece among those of its length in this task
                order = np.argsort(length, kind="stable")
                ranked = length[order]
                new = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
                times = np.diff(np.append(new, len(ranked)))
                number = np.empty(len(of), np.int64)
                number[order] = np.arange(len(of)) - np.repeat(new, times) + seen[ranked]
                seen[ranked[new]] += times
                yield pa.record_batch(
                    [docs.take(pa.array(first + of)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(of), part, np.int32)), pa.array(number)],
                    names=_PIECE_NAMES,
                )

    return run


_PIECE_NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "in_part"]


def _place(places: dict[int, list[np.ndarray]]):
    def run(batches):
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            number = batch.column("number").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                begin, first_bin, each, base = places[n]
                run_ = np.searchsorted(begin, number[rows], side="right") - 1
                inside = number[rows] - begin[run_]
                sequence[rows] = first_bin[run_] + inside // each[run_]
                offset[rows] = base[run_] + inside % each[run_] * n
            yield pa.record_batch([*[batch.column(c) for c in _PIECE_NAMES[:5]], pa.array(sequence), pa.array(offset)], names=[*_PIECE_NAMES[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): all documents in
    sequences of at most `capacity` tokens.

    A document is its ids and then end_id; only longer ones are cut, into pieces of
    capacity tokens and a last one. Null and empty texts are end_id alone; rows without an
    id take no part; repeated rows are packed each; other columns are ignored."""
    pieces = stage(id_and_text(docs, id_col, text_col).mapInArrow(_cut(path, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long, part int, in_part long"), "pieces")
    per_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    numbered = pieces.join(offsets, ["part", "length"]).select(*_PIECE_NAMES[:5], (F.col("before") + F.col("in_part")).alias("number"))
    return numbered.mapInArrow(_place(_places(plan_bins(counts, capacity))), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
