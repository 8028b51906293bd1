"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The tree's leaves are the ranks of a piece's adjacent pairs; its root is the leftmost pair
of the lowest rank. A merge changes at most three leaves, each a logarithmic point update,
so a piece of n bytes takes O(n log n) however long it is. Texts are cut a batch at a time:
the pieces that a task has not met grow their trees side by side, as rows of a matrix with
one merge a row and round. Tasks remember the pieces that they have met, within a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .stage import id_and_text

PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED = 500_000
LONGEST_REMEMBERED = 48
#: Characters of text that are cut and learnt at once.
BATCH_CHARS = 1 << 20
#: Fewer pieces of like lengths, or longer ones, are merged one by one.
FEW, WIDEST = 48, 1024
_INF = 1 << 62


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(extra)}


def latin_1(pattern: str) -> re.Pattern:
    """The pattern with its classes spelt out for characters below U+0100."""
    chars = list(map(chr, range(256)))
    letter, number, space = ("".join(f"\\x{ord(c):02x}" for c in chars if regex.match(k, c)) for k in (r"\p{L}", r"\p{N}", r"\s"))
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{letter}{number}]").replace(r"[\p{L}]", f"[{letter}]").replace(r"[\p{N}]", f"[{number}]")
    for k, v in ((r"\p{L}", f"[{letter}]"), (r"\p{N}", f"[{number}]"), (r"\s", f"[{space}]"), (r"\S", f"[^{space}]")):
        out = out.replace(k, v)
    return re.compile(out)


_BEYOND_LATIN_1 = re.compile("[^\0-\xff]").search


class PairRanks:
    """Ranks of pairs of ids by open addressing with four slots a pair at least."""

    NONE = np.int32(1 << 30)

    def __init__(self, left: np.ndarray, right: np.ndarray):
        """left, right: the pairs by rising rank."""
        self.bits = int(len(left) * 4).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.NONE, np.int32)
        keys = np.asarray(left, np.int64) << 32 | np.asarray(right, np.int64)
        at, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            self.keys[at[free]], self.ranks[at[free]] = keys[free], free
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE without a merge or where an id is negative."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        at = self._slots(key)
        found = self.keys[at]
        out = np.where(found == key, self.ranks[at], self.NONE)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = self.NONE
        return out


class SegmentTree:
    """Least value with its leftmost leaf at the root; logarithmic point updates."""

    def __init__(self, values: list[int]):
        self.size = size = 1 << max(0, (len(values) - 1).bit_length())
        self.tree = tree = [_INF] * size + [v * size + i if v < _INF else _INF for i, v in enumerate(values)] + [_INF] * (size - len(values))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a <= b else b

    def put(self, leaf: int, value: int) -> None:
        tree = self.tree
        i = self.size + leaf
        tree[i] = value * self.size + leaf if value < _INF else _INF
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                break
            tree[i] = least
            i >>= 1


class SegmentTrees:
    """A segment tree in each row of a matrix: least value with its leftmost leaf at the root.

    leaves: values by row, NONE for no value; as many columns as a power of two."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, leaves: np.ndarray):
        rows, size = leaves.shape
        self.log = size.bit_length() - 1
        self.tree = tree = np.full((rows, 2 * size), self.NONE, np.int64)
        tree[:, size:] = np.where(leaves < self.NONE, leaves << self.log | np.arange(size), self.NONE)
        while size > 1:
            np.minimum(tree[:, size : 2 * size : 2], tree[:, size + 1 : 2 * size : 2], out=tree[:, size // 2 : size])
            size //= 2
        self.flat = tree.reshape(-1)

    def least(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least value of each row, NONE where all are gone, and its leftmost leaf."""
        root = self.tree[rows, 1]
        return np.where(root < self.NONE, root >> self.log, self.NONE), root & ((1 << self.log) - 1)

    def put(self, rows: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        """Point updates of different leaves; values that meet on the way up are made once a level."""
        base, node = rows << (self.log + 1), leaf + (1 << self.log)
        self.flat[base + node] = np.where(value < self.NONE, value << self.log | leaf, self.NONE)
        for _ in range(self.log):
            pair = base + (node & ~1)
            node >>= 1
            self.flat[base + node] = np.minimum(self.flat[pair], self.flat[pair + 1])


class BytePairCoder:
    """Encoder and decoder for a byte-level BPE vocabulary in the tokenizers JSON format."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        vocab = model["model"]["vocab"]
        symbols = byte_symbols()
        back = {c: b for b, c in symbols.items()}
        self.first = [vocab[symbols[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        rising = sorted((rank, a, b, made) for (a, b), (rank, made) in self.merges.items())
        _, left, right, self.made = np.array(rising, np.int64).reshape(-1, 4).T
        self.pairs = PairRanks(left, right)
        self.first_of = np.array(self.first, np.int64)
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.bytes_of = {i: bytes(back[c] for c in token) for token, i in vocab.items()}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        top = max(self.bytes_of) + 1
        self._decoded = [self.bytes_of.get(i, b"") for i in range(top)]
        self._lengths = np.array([len(b) for b in self._decoded], np.int64)
        self._names = [b"%d," % i for i in range(top)] + [b"%d\n" % i for i in range(top)]
        self._piece, self._latin = regex.compile(PIECE).findall, latin_1(PIECE).findall
        self._special = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._ids: dict[str, bytes] = {}
        self._bytes: dict[str, bytes] = {}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        ids = [self.first[b] for b in data]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        found = [merges.get(p) for p in zip(ids, ids[1:])]
        tree = SegmentTree([f[0] if f else _INF for f in found])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        size, root = tree.size, tree.tree
        while root[1] < _INF:
            i = root[1] % size
            j = after[i]
            ids[i] = found[i][1]
            k = after[i] = after[j]
            ids[j] = -1
            if k < n:
                before[k] = i
                f = found[i] = merges.get((ids[i], ids[k]))
                tree.put(i, f[0] if f else _INF)
            else:
                tree.put(i, _INF)
            if j < n - 1:
                tree.put(j, _INF)
            h = before[i]
            if h >= 0:
                f = found[h] = merges.get((ids[h], ids[i]))
                tree.put(h, f[0] if f else _INF)
        return [x for x in ids if x >= 0]

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order in which pieces were merged, their ids in that order, and how many each has."""
        size = np.array([len(p) for p in pieces], np.int64)
        order = np.argsort(size, kind="stable")
        ids, count, lo, width = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0, 1
        while lo < len(order):
            hi = int(np.searchsorted(size[order], width, side="right"))
            if hi - lo < FEW or width > WIDEST:
                few = [self.merge(pieces[i]) for i in order[lo:hi].tolist()]
                ids.append(np.array([x for f in few for x in f], np.int64))
                count.append(np.array([len(f) for f in few], np.int64))
                lo = hi
            while lo < hi:
                rows = order[lo : min(hi, lo + max(FEW, (1 << 18) // width))]
                got = self._rows([pieces[i] for i in rows.tolist()], size[rows], width)
                ids.append(got[0]), count.append(got[1])
                lo += len(rows)
            width *= 2
        return order, np.concatenate(ids), np.concatenate(count)

    def _rows(self, pieces: list[bytes], size: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """merge_all for pieces of at most `width` bytes, a power of two."""
        n, w = len(pieces), width + 1  # the last column is a sentinel
        ids = np.full((n, w), -1, np.int64)
        ids[np.arange(w) < size[:, None]] = self.first_of[np.frombuffer(b"".join(pieces), np.uint8)]
        trees = SegmentTrees(self._values(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width))
        after, before = np.tile(np.arange(1, w + 1), n), np.tile(np.arange(-1, w - 1), n)
        flat, live = ids.reshape(-1), np.arange(n)
        while True:
            best, at = trees.least(live)
            some = best < trees.NONE
            live, at, best = live[some], at[some], best[some]
            if not len(live):
                break
            base = live * w
            here, j = base + at, after[base + at]
            k = after[base + j]
            flat[here], flat[base + j], after[here] = self.made[best], -1, k
            end = np.minimum(k, width)
            before[base + end] = at
            h = before[here]
            has = h >= 0
            led = base[has] + h[has]
            right, left = self._values(flat[here], flat[base + end]), self._values(flat[led], flat[here[has]])
            trees.put(np.concatenate([live, live, live[has]]), np.concatenate([at, j, h[has]]), np.concatenate([right, np.full(len(j), trees.NONE), left]))
        alive = ids >= 0
        return ids[alive], alive.sum(1)

    def _values(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        rank = self.pairs.rank(left, right)
        return np.where(rank < PairRanks.NONE, rank.astype(np.int64), SegmentTrees.NONE)

    def _cut(self, text: str) -> list[str]:
        """The pieces of a text; a special token, which no piece can hold, is one."""
        if self._special is None or not any(t in text for t in self.special):
            return (self._latin if text.isascii() or not _BEYOND_LATIN_1(text) else self._piece)(text)
        return [p for i, span in enumerate(self._special.split(text)) for p in ([span] if i % 2 else self._piece(span))]

    def _learn(self, met: set[str]) -> tuple[dict[str, bytes], dict[str, bytes]]:
        """Of each piece met: its ids joined by commas, and the bytes that they decode to."""
        ids, data = self._ids, self._bytes
        fresh = met.difference(ids)
        if len(ids) + len(fresh) > REMEMBERED:
            ids.clear(), data.clear()
            fresh = met
        new = [p for p in fresh if p not in self.special]
        order, flat, count = self.merge_all([p.encode() for p in new])
        new = [new[i] for i in order.tolist()]
        ends = np.cumsum(count)
        last = np.zeros(len(flat), np.int64)
        last[ends - 1] = len(self._decoded)
        ids.update(zip(new, b"".join(map(self._names.__getitem__, (flat + last).tolist())).split(b"\n")))
        whole = b"".join(map(self._decoded.__getitem__, flat.tolist()))
        cuts = np.concatenate([[0], np.cumsum(self._lengths[flat])])[ends].tolist()
        data.update(zip(new, [whole[a:b] for a, b in zip([0, *cuts], cuts)]))
        for t in fresh.intersection(self.special):
            ids[t], data[t] = b"%d" % self.special[t], self.bytes_of[self.special[t]]
        out = {p: ids[p] for p in met}, {p: data[p] for p in met}
        for p in [p for p in fresh if len(p) > LONGEST_REMEMBERED]:
            del ids[p], data[p]
        return out

    def code(self, texts: list[str]) -> Iterator[tuple[int, bytes, bytes]]:
        """Of each text: the number of ids, the ids joined by commas, and the bytes that they decode to."""
        cut = [self._cut(t) for t in texts]
        ids, data = self._learn(set().union(*cut))
        for pieces in cut:
            joined = b",".join(map(ids.__getitem__, pieces))
            yield joined.count(b",") + bool(joined), joined, b"".join(map(data.__getitem__, pieces))

    def encode(self, text: str) -> list[int]:
        (_, joined, _), = self.code([text])
        return list(map(int, joined.split(b","))) if joined else []

    def decode(self, ids: Iterable[int]) -> str:
        """Unknown ids decode to nothing; bytes that are not UTF-8 to replacement characters."""
        return b"".join([self.bytes_of.get(i, b"") for i in ids]).decode(errors="replace")


_coders: dict[str, BytePairCoder] = {}


def coder(path: str) -> BytePairCoder:
    """One coder a task process and vocabulary."""
    if path not in _coders:
        _coders[path] = BytePairCoder(path)
    return _coders[path]


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about limit characters."""
    rows, size, lo = [], 0, 0
    for i, text in enumerate(column):
        text = text.as_py() or ""
        rows.append(text)
        size += len(text)
        if size >= limit:
            yield lo, rows
            rows, size, lo = [], 0, i + 1
    if rows:
        yield lo, rows


def _digest(path: str):
    def run(batches):
        code = coder(path)
        for batch in batches:
            n, ids_sha, text_sha = [], [], []
            for _, texts in slices(batch.column(1), BATCH_CHARS):
                for many, ids, data in code.code(texts):
                    n.append(many)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    text_sha.append(hashlib.sha256(data.decode(errors="replace").encode()).hexdigest())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>): the token ids of each whole text.

    Null and empty texts have no ids; rows without an id take no part; repeated rows each
    give a row; other columns are ignored. `path` must be readable by every executor."""

    def run(batches):
        code = coder(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([code.encode(t.as_py() or "") for t in batch.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each row's ids; null ids decode to the empty text."""

    def run(batches):
        code = coder(path)
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([code.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encode and decode in one pass."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_digest(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
