"""MinHash near-dedup with circulant signatures, banding and exact verification.

Two permutations of the 32-bit ring give all coordinates: shingles go through the first
once, and coordinate k is the least image under the second shifted circularly by k.

Documents with the same words are one class from the start. Two rounds then try each class
with one leader of its buckets, so that a group of copies costs pairs in proportion to its
size. What buckets still hold of unconnected classes meets in blocks of bounded size, blocks
of one component never with one another. A block has the texts; it compares their full sets
and gives only links that connect two components there, fewer than it has members.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .kernels import LOWER, SliceHash, U, Words, mix, text_chunks
from .stage import discard, id_and_text, stage

#: A pair at the threshold of 0.75 shares no band with a chance of 8e-5, at 0.8 of 4e-7.
BANDS, ROWS = 48, 6
ROUNDS, BLOCK = 2, 512
_FOLD = LOWER.tobytes()


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): sorted distinct hashes of each document's k-word shingles, one document
    after the other; the whole sequence as one if it is shorter; none without words. A-Z count
    as a-z."""
    words = Words(LOWER[data], off)
    hashes = SliceHash(words.hashes())
    grams = hashes.fixed(k)
    n = len(off) - 1
    doc = np.repeat(np.arange(n), words.count)
    at = np.flatnonzero(np.arange(len(doc)) + k <= words.doc_end())
    short = np.flatnonzero((words.count > 0) & (words.count < k))
    flat = np.concatenate([grams[at], hashes.of(words.off[short], words.off[short + 1])])
    doc = np.concatenate([doc[at], short])
    order = np.lexsort((flat, doc))
    flat, doc = flat[order], doc[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (doc[1:] != doc[:-1])
    return flat[new], np.bincount(doc[new], minlength=n)


def circulant_signature(flat: np.ndarray, begin: np.ndarray, n: int) -> np.ndarray:
    """n coordinates for each run of shingles that starts at begin."""
    spread = np.uint32(0x9E3779B1)
    first = (mix(flat ^ U(0x2545F4914F6CDD1D)) >> U(32)).astype(np.uint32)  # the first permutation
    first *= spread  # so that the circular shift by k is the addition of k * spread
    out, y, z = np.empty((len(begin), n), np.uint32), np.empty_like(first), np.empty_like(first)
    for k in range(n):
        np.add(first, np.uint32((k + 1) * 0x9E3779B1 & 0xFFFFFFFF), out=y)
        np.right_shift(y, np.uint32(15), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint32(0x85EBCA77), out=y)
        np.right_shift(y, np.uint32(13), out=z)
        np.bitwise_xor(y, z, out=y)
        np.multiply(y, np.uint32(0xC2B2AE3D), out=y)
        out[:, k] = np.minimum.reduceat(y, begin)
    return out


def _sketch(k: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            for lo, hi, data, off in text_chunks(batch.column(2), 1 << 18):
                flat, size = shingle_sets(data, off, k)
                some = np.flatnonzero(size)
                digests = np.zeros((hi - lo, 2), np.int64)
                keys = np.zeros((len(some), bands), np.uint64)
                if len(some):
                    signature = circulant_signature(flat, (np.cumsum(size) - size)[some], bands * rows).reshape(len(some), bands, rows).astype(np.uint64)
                    for r in range(rows):
                        keys = mix(keys * U(0x9E3779B97F4A7C15) + signature[:, :, r])
                    keys = mix(keys + np.arange(bands, dtype=np.uint64)[None, :])
                    for i in some.tolist():
                        same = b" ".join(data[off[i] : off[i + 1]].tobytes().translate(_FOLD).split())
                        digests[i] = np.frombuffer(hashlib.blake2b(same, digest_size=16).digest(), np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((size > 0) * bands)]).astype(np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.record_batch([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(size.astype(np.int64)), pa.array(digests[:, 0].copy()), pa.array(digests[:, 1].copy()), lists], names=["doc_id", "version", "n_shingles", "d0", "d1", "bands"])

    return run


def linked(a: str, b: str, k: int, share: int, of: int) -> bool:
    """Whether two texts reach the threshold, by their words themselves."""
    numbers: dict[bytes, int] = {}
    sides = []
    for text in (a, b):
        w = [numbers.setdefault(x, len(numbers)) for x in text.encode().translate(_FOLD).split()]
        sides.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    both = len(sides[0] & sides[1])
    return both > 0 and of * both >= share * (len(sides[0]) + len(sides[1]) - both)


def _sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    out = []
    for _, _, data, off in text_chunks(texts):
        flat, size = shingle_sets(data, off, k)
        out += np.split(flat, np.cumsum(size)[:-1])
    return out


def _reach(x: np.ndarray, y: np.ndarray, share: int, of: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and of * both >= share * (len(x) + len(y) - both)


def _verify(k: int, share: int, of: int):
    """Pairs with their texts: those that are linked. Hashed sets say no, words say yes."""

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [_sets(part.column(c), k) for c in (2, 3)]
                ok = [i for i, (x, y) in enumerate(zip(*sets)) if _reach(x, y, share, of) and linked(part.column(2)[i].as_py(), part.column(3)[i].as_py(), k, share, of)]
                rows = pa.array(ok, pa.int64())
                yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows)], names=["a", "b"])

    return run


_CELL = ["bucket", "c1", "t1", "c2", "t2"]


def _candidates(sets: list[np.ndarray], share: int, of: int) -> np.ndarray:
    """Numbers i * members + j, i < j, of the pairs that can reach the threshold: of a linked pair's
    shingles, one at least is among the rarest of both, as many as may be missing and one more."""
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    flat, doc = np.concatenate(sets), np.repeat(np.arange(m), size)
    _, number, times = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((number, times[number], doc))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    need = -(-size * share // of)
    head = order[place <= (size - need)[doc]]
    head = head[times[number[head]] > 1]
    head = head[np.argsort(number[head], kind="stable")]
    group, who = number[head], doc[head]
    found, step = np.zeros(0, np.int64), 1
    pending: list[np.ndarray] = []
    while step < len(head):
        same = np.flatnonzero(group[step:] == group[:-step])
        if not len(same):
            break
        x, y = who[same], who[same + step]
        pending.append(np.unique(np.minimum(x, y) * m + np.maximum(x, y)))
        step += 1
        if sum(map(len, pending)) > 4_000_000:
            found, pending = np.unique(np.concatenate([found, *pending])), []
    return np.unique(np.concatenate([found, *pending]))


def _joined(k: int, share: int, of: int):
    """The cells, sorted and whole in a task: links that join components in them."""

    def links(cell: pa.Table) -> list[tuple[int, int]]:
        texts = cell.column("text").combine_chunks()
        side, comp = cell.column("side").to_numpy(), cell.column("comp").to_numpy()
        sets, m = _sets(texts, k), len(side)
        size = np.array([len(s) for s in sets], np.int64)
        pairs = _candidates(sets, share, of)
        i, j = pairs // m, pairs % m
        may = (comp[i] != comp[j]) & (of * np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j]))
        if side.any():
            may &= side[i] != side[j]  # one side's own pairs are another cell's
        i, j = i[may], j[may]
        group = comp.copy()
        out = []
        for x, y in zip(i.tolist(), j.tolist()):
            if group[x] != group[y] and _reach(sets[x], sets[y], share, of) and linked(texts[x].as_py(), texts[y].as_py(), k, share, of):
                out.append((int(comp[x]), int(comp[y])))
                group[group == group[y]] = group[x]
        return out

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            keys = np.stack([table.column(c).to_numpy() for c in _CELL], 1)
            cut = (np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist()
            got = [x for a, b in zip([0, *cut], cut) for x in links(table.slice(a, b - a))]
            rest = table.slice(cut[-1] if cut else 0)
            if got:
                yield pa.record_batch([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["a", "b"])
        if rest is not None and rest.num_rows:
            got = links(rest)
            yield pa.record_batch([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] for x in got], pa.int64())], names=["a", "b"])

    return run


def _cells(open_: DataFrame) -> DataFrame:
    """The members of open buckets in block cells: (bucket, c1, t1, c2, t2, side, ...). A component
    of over half a block in a bucket has blocks of its own, which meet all but one another."""
    sizes = open_.groupBy("bucket", "comp").agg(F.count("*").alias("times"))
    large = F.col("times") > BLOCK // 2
    small = sizes.where(~large).groupBy("bucket").agg(F.sum("times").alias("n_small"))
    of = lambda n: F.ceil(F.col(n) / BLOCK)
    placed = open_.join(sizes, ["bucket", "comp"]).join(small, "bucket", "left")
    placed = placed.select("bucket", "rep", "alt", "comp", F.when(large, F.col("comp")).otherwise(-1).alias("c"), F.pmod(F.xxhash64("rep", "alt"), F.when(large, of("times")).otherwise(of("n_small"))).cast("int").alias("t"))
    placed = stage(placed, "minhash-placed")
    blocks = placed.select("bucket", "c", "t").distinct()
    one, two = (blocks.select("bucket", F.col("c").alias(f"c{i}"), F.col("t").alias(f"t{i}")) for i in (1, 2))
    cells = stage(one.join(two, "bucket").where("(c1 < c2 or (c1 = c2 and t1 <= t2)) and (c1 <> c2 or c1 = -1)"), "minhash-cells")
    left = placed.join(cells.withColumns({"c": F.col("c1"), "t": F.col("t1"), "side": F.lit(0)}), ["bucket", "c", "t"])
    right = placed.join(cells.where("c1 <> c2 or t1 <> t2").withColumns({"c": F.col("c2"), "t": F.col("t2"), "side": F.lit(1)}), ["bucket", "c", "t"])
    return left.unionByName(right).drop("c", "t")


def near_duplicates(docs: DataFrame, k: int = 5, share: int = 75, of: int = 100, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): documents linked where
    of * |A and B| >= share * |A or B| for their sets of k-word shingles.

    A-Z count as a-z; words are runs of anything but space and \\t to \\r. With fewer than k
    words the whole sequence is the one shingle; null or empty texts have none and link with
    nothing. Rows without an id take no part, repeated rows each give a row, other columns
    are ignored. Rows that share an id are one document in several versions: what is linked
    with one is reachable from all. component_id is the least doc_id reachable; kept marks
    that document."""
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("version"), "text")
    sketches = stage(texts.mapInArrow(_sketch(k, bands, rows), "doc_id long, version long, n_shingles long, d0 long, d1 long, bands array<long>"), "minhash-sketches")
    some = sketches.where("n_shingles > 0")
    least = some.groupBy("d0", "d1").agg(F.min(F.struct("doc_id", "version", "n_shingles", "bands")).alias("least"))
    # alt tells classes apart that have the same least doc_id, as rows may share an id
    alt = F.expr("row_number() over (partition by least.doc_id order by d0, d1) - 1").cast("int")
    classes = stage(least.select("d0", "d1", F.col("least.doc_id").alias("rep"), alt.alias("alt"), F.col("least.version").alias("version"), F.col("least.n_shingles").alias("n"), F.col("least.bands").alias("bands")), "minhash-classes")
    members = stage(some.select("doc_id", "d0", "d1").join(classes.select("d0", "d1", "rep"), ["d0", "d1"]).select("doc_id", "rep").distinct(), "minhash-members")
    filled = classes.select("rep", "alt", "n", F.explode("bands").alias("bucket"))
    shared = filled.groupBy("bucket").agg(F.count("*").alias("times")).where("times > 1").select("bucket")
    buckets = stage(filled.join(shared, "bucket").select("bucket", "rep", "alt", "n"), "minhash-buckets")
    wanted = classes.select(F.col("rep").alias("doc_id"), "version", "alt").join(buckets.select(F.col("rep").alias("doc_id"), "alt").distinct(), ["doc_id", "alt"])
    bodies = stage(texts.join(wanted, ["doc_id", "version"]).dropDuplicates(["doc_id", "alt"]).select(F.col("doc_id").alias("rep"), "alt", "text"), "minhash-texts")
    discard(classes)

    links = stage(members.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")), "minhash-links")
    known = None  # (rep, comp) of what verified links connect so far
    open_ = buckets.withColumn("comp", F.col("rep"))
    for turn in range(ROUNDS + 1):
        undone = open_.groupBy("bucket").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least < most").select("bucket")
        open_ = stage(open_.join(undone, "bucket", "left_semi"), "minhash-open")
        if turn < ROUNDS:  # every class with the first leader, by a hash, of its buckets
            first = open_.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("rep", "alt", F.lit(turn)), F.col("rep").alias("rep_a"), F.col("alt").alias("alt_a"), F.col("n").alias("na"), F.col("comp").alias("ca"))).alias("lead"))
            fits = of * F.least("lead.na", "n") >= share * F.greatest("lead.na", "n")
            tried = open_.join(first, "bucket").where((F.col("comp") != F.col("lead.ca")) & fits).groupBy("rep", "alt", "comp").agg(F.min("lead").alias("lead"))
            one = tried.join(bodies, ["rep", "alt"]).select("comp", F.col("lead.ca").alias("ca"), F.col("lead.rep_a").alias("rep"), F.col("lead.alt_a").alias("alt"), F.col("text").alias("tb"))
            checked = one.join(bodies, ["rep", "alt"]).select("ca", "comp", F.col("text").alias("ta"), "tb").mapInArrow(_verify(k, share, of), "a long, b long")
        else:
            dealt = _cells(open_).join(bodies, ["rep", "alt"]).repartition(*_CELL).sortWithinPartitions(*_CELL, "side")
            checked = dealt.select(*_CELL, "side", "comp", "text").mapInArrow(_joined(k, share, of), "a long, b long")
        merged = stage(components(checked), "minhash-merged")  # between what was connected before
        if known is None:
            known = merged.select(F.col("node").alias("rep"), F.col("component").alias("comp"))
        else:
            step = merged.select(F.col("node").alias("comp"), "component")
            fresh = merged.join(known.select(F.col("rep").alias("node")), "node", "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("comp"))
            known = stage(known.join(step, "comp", "left").select("rep", F.coalesce("component", "comp").alias("comp")).unionByName(fresh), "minhash-known")
        open_ = open_.drop("comp").join(known, "rep", "left").select("bucket", "rep", "alt", "n", F.coalesce("comp", "rep").alias("comp"))
    discard(buckets, bodies)
    # equal words and shared ids connect documents, too
    found = components(links.unionByName(known.select(F.col("rep").alias("a"), F.col("comp").alias("b"))))
    out = sketches.select("doc_id", "n_shingles").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
