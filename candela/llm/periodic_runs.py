"""Periodic runs of words: stretches in which words a fixed distance apart are identical.

Each document's words go one by one into a suffix automaton. Its links form a tree in which the
path from the node of the words so far to the root holds every suffix; nodes of that path whose
strings ended last at the same place form a segment, and link-cut access recolours the segments of
the path with the new end. A segment whose strings are up to L words long and ended last d words
ago says that the last L + d words have period d, as far to the left as that goes; where the next
word breaks the period, this is a run. d is the least period, as a lesser one would have been a
later end. Access is amortised, so a document of n words takes about n log n steps.

Only stretches that can hold a run go into the automaton: in a run every gram of GRAM words recurs
within a period, which is at most a third of the stretch. Grams are compared by fingerprints there,
which can only let more through; the automaton compares words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .kernels import SliceHash, Words, spans_of, text_chunks
from .stage import id_and_text

GRAM = 8
#: A run has at least so many words, and so many periods.
LEAST, TIMES = 24, 3


class GrowingSequence:
    """Suffix automaton of a sequence that grows, with its link tree cut into paths.

    Nodes are numbers from 1, the root; 0 is none. A path is a splay tree by depth, with the last
    end of its strings kept at its top; `up` of a top is where the path hangs in the tree."""

    def __init__(self):
        self.length, self.link = [0, 0], [0, 0]
        self.word, self.to, self.more = [-1, -1], [0, 0], {}  # a node's first step, and its others
        self.left, self.right, self.up, self.ended = [0, 0], [0, 0], [0, 0], [-1, -1]
        self.last, self.n = 1, 0

    def _node(self, length: int) -> int:
        for values, x in ((self.length, length), (self.link, 0), (self.word, -1), (self.to, 0), (self.left, 0), (self.right, 0), (self.up, 0), (self.ended, -1)):
            values.append(x)
        return len(self.length) - 1

    def _step(self, node: int, word: int) -> int:
        if self.word[node] == word:
            return self.to[node]
        others = self.more.get(node)
        return others.get(word, 0) if others else 0

    def _put(self, node: int, word: int, to: int) -> None:
        if self.word[node] in (-1, word):
            self.word[node], self.to[node] = word, to
        else:
            self.more.setdefault(node, {})[word] = to

    def _splay(self, x: int) -> int:
        """x to the top of its path; gives the path's last end."""
        left, right, up, ended = self.left, self.right, self.up, self.ended
        top = x
        while (p := up[top]) and (left[p] == top or right[p] == top):
            top = p
        end = ended[top]
        while x != top:
            p = up[x]
            g = up[p] if p != top else 0
            if g and (left[g] == p) == (left[p] == x):
                self._rotate(p)
                self._rotate(x)
            else:
                self._rotate(x)
                if g:
                    self._rotate(x)
            if g == top or p == top:
                top = x
        ended[x] = end
        return end

    def _rotate(self, x: int) -> None:
        left, right, up = self.left, self.right, self.up
        p = up[x]
        g = up[p]
        if left[p] == x:
            c = left[p] = right[x]
            right[x] = p
        else:
            c = right[p] = left[x]
            left[x] = p
        if c:
            up[c] = p
        if g:
            if left[g] == p:
                left[g] = x
            elif right[g] == p:
                right[g] = x
        up[x], up[p] = g, x

    def _grow(self, word: int) -> int:
        """The node of the whole sequence with this word at its end."""
        new = self._node(self.n + 1)
        p = self.last
        while p and not self._step(p, word):
            self._put(p, word, new)
            p = self.link[p]
        parent = 1
        if p:
            parent = q = self._step(p, word)
            if self.length[q] != self.length[p] + 1:
                parent = self._split(q, self.length[p] + 1)
                while p and self._step(p, word) == q:
                    self._put(p, word, parent)
                    p = self.link[p]
        self.link[new] = self.up[new] = parent
        self.last, self.n = new, self.n + 1
        return new

    def _split(self, q: int, length: int) -> int:
        """A node between q and its link, for the shorter strings of q; they ended where q's did,
        so it comes into q's path, just above q."""
        above = self._node(length)
        self.word[above], self.to[above], self.link[above] = self.word[q], self.to[q], self.link[q]
        if q in self.more:
            self.more[above] = dict(self.more[q])
        self.link[q] = above
        self._splay(q)
        shallower = self.left[q]
        self.left[above], self.left[q], self.up[above] = shallower, above, q
        if shallower:
            self.up[shallower] = above
        return above

    def append(self, word: int) -> list[tuple[int, int]]:
        """(last end, length) of the segments of suffixes that ended before: the longest suffix,
        the new word its last, that ended last there. Ends are word numbers."""
        end, new = self.n, self._grow(word)
        right, up, ended, length = self.right, self.up, self.ended, self.length
        found, below, x = [], 0, new
        while x:
            before = self._splay(x)
            if right[x]:
                ended[right[x]] = before  # deeper nodes keep their end in a path of their own
            if before >= 0:
                found.append((before, length[x]))
            right[x], below, x = below, x, up[x]
        self._splay(new)
        ended[new] = end
        return found


def runs_of(words: list[int], least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, least period) of the runs of a sequence, in order of their ends."""
    seen, out, n = GrowingSequence(), [], len(words)
    for i, word in enumerate(words):
        for end, size in seen.append(word):
            period = i - end
            if size + period >= least and size >= (times - 1) * period and (i + 1 == n or words[i + 1] != words[i + 1 - period]):
                out.append((i - size - period + 1, size + period, period))
    return out


def stretches(code: np.ndarray, off: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that can hold runs; every run lies in one whole.

    code: a number for each word, equal for equal words; off: where documents start. A run of n
    words has period q <= n / times, and n >= 2 q + k - 1, so each of its k-grams has its like
    within q words to one side."""
    k = min(GRAM, (least + 5) // 3)
    if times < 3 or k < 2:
        raise ValueError("runs have at least three periods and two words")
    grams = SliceHash(code).fixed(k)
    n = len(grams)
    near = np.full(n, np.iinfo(np.int64).max)
    if n:
        doc = np.searchsorted(off, np.arange(n), side="right") - 1
        inside = np.flatnonzero(np.arange(n) + k <= off[doc + 1])
        order = inside[np.argsort(grams[inside], kind="stable")]
        a, b = order[:-1], order[1:]
        same = (grams[a] == grams[b]) & (doc[a] == doc[b])
        a, b = a[same], b[same]
        near[a] = b - a
        near[b] = np.minimum(near[b], b - a)
    alive = near < np.iinfo(np.int64).max
    while True:
        start, end = spans_of(alive)
        size = end - start + k - 1
        at = np.flatnonzero(alive)
        each = np.repeat(size, end - start)
        out = at[(each < least) | (near[at] > each // times)]
        if not len(out):
            return start, end + k - 1
        alive[out] = False


def _sources(ids: list[int], words: Words, change: Callable[[int, int], tuple[int, int] | None] | None) -> tuple[np.ndarray, set[int]]:
    """Which word stands at each place, and the documents that were changed."""
    source, changed = np.arange(len(words.start)), set()
    if change:
        for d, (doc_id, n) in enumerate(zip(ids, words.count.tolist())):
            got = change(doc_id, n)
            if got:
                first, period = got
                lo = int(words.off[d])
                source[lo + first : lo + n] = lo + first + np.arange(n - first) % period
                changed.add(d)
    return source, changed


class Found:
    """The runs of one document: (start, length, period) in order, and the words that stay."""

    def __init__(self, runs: list[tuple[int, int, int]], n: int, words: Callable[[np.ndarray | None], bytes]):
        self.runs, self.n, self._words = sorted(runs, key=lambda r: (r[0], r[2])), n, words

    def best(self) -> tuple[int, int, int] | None:
        return min(self.runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)

    def collapsed(self) -> bytes:
        """The words outside the repeated periods of every run, joined by one space."""
        if not self.runs:
            return self._words(None)
        keep = np.ones(self.n, bool)
        for start, length, period in self.runs:
            keep[start + period : start + length] = False
        return self._words(np.flatnonzero(keep))


def _found(change):
    """For each chunk of documents: (first row, their Found)."""

    def run(batch):
        ids = batch.column(0).to_pylist()
        for lo, hi, data, off in text_chunks(batch.column(1)):
            words = Words(data, off)
            source, changed = _sources(ids[lo:hi], words, change)
            joined, w0, w1 = words.joined()
            start, end = stretches(words.hashes()[source], words.off)
            of = np.searchsorted(words.off, start, side="right") - 1
            by: dict[int, list] = {}
            for d, a, b in zip(of.tolist(), start.tolist(), end.tolist()):
                numbers: dict[bytes, int] = {}
                text = [joined[x:y] for x, y in zip(w0[source[a:b]].tolist(), w1[source[a:b]].tolist())]
                first = a - int(words.off[d])
                by.setdefault(d, []).extend((first + s, n, q) for s, n, q in runs_of([numbers.setdefault(w, len(numbers)) for w in text]))

            def body(d, changed=changed, joined=joined, w0=w0, w1=w1, words=words, source=source):
                lo_, hi_ = int(words.off[d]), int(words.off[d + 1])

                def kept(which):
                    if which is None and d not in changed:
                        return joined[w0[lo_] : w1[hi_ - 1]] if lo_ < hi_ else b""
                    at = source[lo_:hi_] if which is None else source[lo_:hi_][which]
                    return b" ".join([joined[x:y] for x, y in zip(w0[at].tolist(), w1[at].tolist())])

                return kept

            yield lo, [Found(by.get(d, []), int(words.count[d]), body(d)) for d in range(hi - lo)]

    return run


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, period): every run of every whole text, a row each.

    A run is a stretch of consecutive words (anything but space and \\t to \\r), at least LEAST
    words and TIMES periods long, that neither neighbouring word continues. Null and empty texts
    have none; rows without an id take no part; repeated rows each give their runs; other columns
    are ignored."""
    find = _found(None)

    def run(batches):
        for batch in batches:
            for lo, found in find(batch):
                rows = [(lo + d, *r) for d, f in enumerate(found) for r in f.runs]
                at, *columns = zip(*rows) if rows else ([], [], [], [])
                yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64()))] + [pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "period"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text): the words of each text without what runs repeat after their first period,
    joined by one space. Rows as in runs()."""
    find = _found(None)

    def run(batches):
        for batch in batches:
            for lo, found in find(batch):
                yield pa.record_batch([batch.column(0).slice(lo, len(found)), pa.array([f.collapsed() for f in found], pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, text string")


def tenth_periodic(doc_id: int, n: int) -> tuple[int, int] | None:
    """(first word, period) from which a tenth of the documents is made periodic, by their ids."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    first = h // 10 % n
    return first, 1 + (n - first) // (3 + h // 10 % 8)


DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def run_digest(docs: DataFrame, change: Callable[[int, int], tuple[int, int] | None] | None = tenth_periodic, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: the number of runs, the run of the most periods (ties: least start,
    then period; nulls where there is none), and fingerprints of all runs and of what collapse()
    keeps. `change` makes documents periodic before they are read. Rows as in runs()."""
    find = _found(change)

    def run(batches):
        for batch in batches:
            for lo, found in find(batch):
                best = [f.best() or (None, None, None) for f in found]
                milli = [None if b[0] is None else 1000 * b[1] // b[2] for b in best]
                lines = [hashlib.sha256("".join([f"{s},{n},{q}\n" for s, n, q in f.runs]).encode()).hexdigest() for f in found]
                columns = [[len(f.runs) for f in found], *zip(*best), milli]
                yield pa.record_batch(
                    [batch.column(0).slice(lo, len(found)), *[pa.array(c, pa.int64()) for c in columns], pa.array(lines, pa.string()), pa.array([hashlib.sha256(f.collapsed()).hexdigest() for f in found], pa.string())],
                    names=[c.split()[0] for c in DIGEST.split(", ")],
                )

    return id_and_text(docs, id_col, text_col).mapInArrow(run, DIGEST)
