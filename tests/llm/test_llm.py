"""The operators against brute force, on small tables with nulls, empty and long texts,
repeated rows, ties and clashing extra columns."""

import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from candela.llm import alignment, bpe, exact_dedup, hnsw, kernels, minhash, packing, periodic_runs, pq_dedup, quality, substring_dedup, subword, suffix_dedup, toxicity, url_filter
from candela.llm.components import components


def corpus(n=60, seed=2):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows = []
    for i in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 14, 80, 200]))]
        if i % 5 == 0:
            w[len(w) // 2 : len(w) // 2] = passage[rng.randint(0, 10) : rng.randint(40, 60)]
        if i % 7 == 0 and rows:
            w = rows[-1][1].split()
            if w:
                w[rng.randrange(len(w))] = "changed"
        rows.append((i, (" " if i % 3 else "\n\t ").join(w)))
    rows += [(100, None), (101, ""), (102, "   \n"), (103, rows[1][1]), (104, rows[1][1]), (105, "Ünï côdé 日本 " * 40), (106, "a " * 500), (107, "x" * 3000), (108, "A B C d E f"), (109, "a b c D e F")]
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    # extra columns have the names that operators use inside
    df = spark.createDataFrame([(*r, 7, 1.0, "x") for r in ROWS], "doc_id long, text string, pos int, rank double, anchor string")
    return df.repartition(3)


def tuples(df):
    return sorted(tuple(r) for r in df.collect())


def test_op1(docs):
    assert tuples(substring_dedup.repeat_digest(docs)) == brute.op1(ROWS)
    assert tuples(substring_dedup.repeat_digest(docs, 20)) == brute.op1(ROWS, 20)


def test_op1_hot_anchor(docs, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR_CELLS", 1)
    monkeypatch.setattr(substring_dedup, "SHARD_CELLS", 5)
    assert tuples(substring_dedup.repeat_digest(docs)) == brute.op1(ROWS)


def test_op1_crafted_words(spark):
    # two words of one fingerprint without a key
    a, b = "wordwordendsends", "61W!Jvc;0Hy<L@\\G"
    data = np.frombuffer((a + b).encode(), np.uint8)
    hashes = lambda key: kernels.word_hashes(data, np.array([0, 16]), np.array([16, 32]), key)
    assert len(set(hashes(0).tolist())) == 1 and len(set(hashes(kernels.new_key()).tolist())) == 2
    w = [f"w{i}" for i in range(31)]
    rows = [(1, " ".join(w[:30] + [a])), (2, " ".join(w[:30] + [b])), (3, " ".join(w[:15] + [a] + w[15:30])), (4, " ".join(w[:15] + [b] + w[15:30]))]
    got = tuples(substring_dedup.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.op1(rows) and got[1][2] == 30


def crafted_bytes(seed=1):
    """Two strings of 16 printable bytes that chained sums of their halves can't tell apart."""
    rng = np.random.default_rng(seed)
    turn = lambda h: (((h + 16) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) << 27 | ((h + 16) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 37) & (1 << 64) - 1
    x, z = b"firsthal", b"secondha"
    while True:
        other = rng.integers(33, 127, 8).astype(np.uint8).tobytes()
        rest = (int.from_bytes(z, "little") + turn(int.from_bytes(x, "little")) - turn(int.from_bytes(other, "little"))) % (1 << 64)
        rest = rest.to_bytes(8, "little")
        if all(33 <= c < 127 for c in rest):
            return (x + z).decode(), (other + rest).decode()


def test_op8_crafted_bytes(spark):
    a, b = crafted_bytes()
    plain = lambda t: kernels.SliceHash(kernels.eights(np.frombuffer(t.encode(), np.uint8))[:9], 8, 16).fixed(16)[0]
    assert a != b and plain(a) == plain(b)
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefgh ") for _ in range(400))
    rows = [(1, text[:160] + a + text[176:200]), (2, text[:160] + b + text[176:200]), (3, text[200:360] + a + text[:300]), (4, text[200:360] + b + text[:300])]
    got = tuples(suffix_dedup.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == brute.op8(rows) and got[0][2] == got[1][2] == 0


def test_op1_hot_phrase_is_one_row(spark, monkeypatch):
    # a passage between words that differ by document: its edge cells differ, too
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(30))
    near = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(20))
    rows = [(i, f"{near()} {passage} {near()}") for i in range(80)]
    inner = substring_dedup._automaton

    def checked(length, key):
        run = inner(length, key)

        def once(rows):
            if not rows["words"].is_unique:
                raise ValueError("a phrase came to a shard more than once")
            return run(rows)

        return once

    monkeypatch.setattr(substring_dedup, "_automaton", checked)
    monkeypatch.setattr(substring_dedup, "HOT_ANCHOR_CELLS", 10)
    assert tuples(substring_dedup.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.op1(rows)


def test_op1_texts(docs):
    kept = dict(tuples(substring_dedup.remove_repeats(docs)))
    assert {d: brute.sha(t) for d, t in kept.items()} == {r[0]: r[3] for r in brute.op1(ROWS)}


def test_op3(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert tuples(bpe.round_trip_digest(docs, path)) == brute.op3(ROWS)
    ids = bpe.encode(docs, path)
    assert dict(tuples(bpe.decode(ids, path))) == {d: t or "" for d, t in ROWS}
    odd = ["<|endoftext|>x <|endoftext|>", "don't I'LL  two 　spaces \x1c\x85 end ", "é" * 200, "\r\n\r\n  x", "ab" * 700]
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    assert all(bpe.coder(path).encode(x) == t.encode(x, add_special_tokens=False).ids for x in odd)


def test_op3_new_pieces_in_bulk(monkeypatch):
    """New pieces of a batch are merged side by side; only few or very long ones one by one."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t, code, rng, alone = Tokenizer.from_file(path), bpe.BytePairCoder(path), random.Random(4), []
    merge = bpe.BytePairCoder.merge
    monkeypatch.setattr(bpe.BytePairCoder, "merge", lambda self, data: alone.append(data) or merge(self, data))
    texts = [" ".join("".join(rng.choice("theinga\u00e9") for _ in range(rng.randint(1, 24))) for _ in range(400)) for _ in range(5)]
    assert all(code.encode(x) == t.encode(x, add_special_tokens=False).ids for x in texts)
    assert len(alone) < 400
    monkeypatch.setattr(bpe, "FEW", 1)
    data = [rng.randbytes(rng.randint(1, 70)) for _ in range(300)] + [b"ab" * 300, b"a" * 1024, b"a" * 1025, b"a", b"", b"\xff" * 9]
    order, ids, count = code.merge_all(data)
    assert sorted(order) == list(range(len(data)))
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])] == [merge(code, data[i]) for i in order]


def test_op3_odd_characters(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t, code, rng = Tokenizer.from_file(path), bpe.BytePairCoder(path), random.Random(6)
    kinds = ["".join(map(chr, range(256))), "ab '.,s\x85\xa0\u00e90\u00b2\n\x1c", "a '0\u0130\u017f\u65e5\u0303\U0001f600\u3000", "<|endoftext|> "]
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(0, 60))) for k in kinds for _ in range(300)] + ["<|endoftext|><|endoftext|> a", "don't we'LL'd", ""]
    for lo in range(0, len(texts), 50):
        for x, (n, ids, data) in zip(texts[lo : lo + 50], code.code(texts[lo : lo + 50])):
            want = t.encode(x, add_special_tokens=False).ids
            assert (n, ids.decode()) == (len(want), ",".join(map(str, want))) and data.decode(errors="replace") == t.decode(want, skip_special_tokens=False)


def test_op5(docs):
    assert tuples(minhash.near_duplicates(docs)) == brute.op5(ROWS)


def test_op5_blocks(spark, monkeypatch):
    """Many near copies that do not all reach one another, met in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4, 5])):
            w[rng.randrange(120)] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    assert tuples(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.op5(rows)


def test_op7(docs):
    placed = tuples(packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=256))
    assert [r[:5] for r in placed] == brute.op7(ROWS, 256)
    bins = brute.bins_are_sound(placed, 256)
    assert bins <= -(-sum(r[3] for r in placed) // 256) + 2


def test_minimum_bin_slack():
    plan = packing.plan_bins({6: 2, 4: 2, 5: 2, 3: 1, 7: 1}, 10)
    assert sum(n for _, n in plan) == 4 and sum(sum(k * v for k, v in b.items()) * n for b, n in plan) == 40
    assert packing.plan_bins({}, 10) == []


def test_op8(docs):
    assert tuples(suffix_dedup.repeat_digest(docs)) == brute.op8(ROWS)
    assert tuples(suffix_dedup.repeat_digest(docs, 64)) == brute.op8(ROWS, 64)


def test_op8_repeated_rows(spark):
    rows = [(1, "abcdefghij" * 30), (1, "abcdefghij" * 30), (2, "z" * 150)]
    assert tuples(suffix_dedup.repeat_digest(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.op8(rows)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    codec = bpe.round_trip_digest(none, public_tokenizers.path("byte_bpe_50k.json"))
    for df in (substring_dedup.repeat_digest(none), suffix_dedup.repeat_digest(none), minhash.near_duplicates(none), quality.classify(none, labels), toxicity.classify(none, labels), codec, packing.pack(none, public_tokenizers.path("word_bpe_49k.json"))):
        assert df.count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert hnsw.nearest(vectors, vectors).count() == 0 and pq_dedup.near_duplicates(vectors).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def vector_rows():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(260, 8))
    v[100:160] = v[0] + rng.normal(scale=0.08, size=(60, 8))
    v[160:200] = v[5]
    rows = [(i, [float(np.float32(c)) for c in x]) for i, x in enumerate(v)]
    return rows + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [None] * 8), (304, [float("inf")] + [1.0] * 7), (305, []), (306, [1.0] * 3)]


def test_op4(spark):
    rows = vector_rows()
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = [tuple(r) for r in hnsw.nearest(df, df.where(F.col("vec_id") % 20 == 0), k=20, shard_rows=100).collect()]
    good = [(i, np.array(x)) for i, x in rows if i < 300]
    hit = total = 0
    for q, x in good:
        if q % 20:
            continue
        want = sorted(((-float(x @ y), i) for i, y in good if i != q))[:20]
        own = sorted(r[1:] for r in got if r[0] == q)
        assert [r[0] for r in own] == list(range(1, 21)) and [(-s, i) for _, i, s in own] == sorted((-s, i) for _, i, s in own)
        hit += len({i for _, i in want} & {r[1] for r in own})
        total += 20
    assert hit / total >= 0.95 and {r[0] for r in got} == {i for i, _ in good if i % 20 == 0}


def test_op6(spark):
    rows = vector_rows()
    got = tuples(pq_dedup.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, n int")))
    good = {i: np.array(x) / np.linalg.norm(x) for i, x in rows if i < 300}
    near = {i: [j for j in good if j != i and float(good[i] @ good[j]) >= 0.9] for i in good}
    least = {i: i for i in good}
    for _ in good:
        least = {i: min([least[i], *[least[j] for j in near[i]]]) for i in good}
    want = [(i, len(near.get(i, [])), least.get(i, i), least.get(i, i) == i) for i, _ in rows]
    assert got == sorted(want)


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 9), (5, 5), (3, 4), (20, 10), (20, 30), (30, 40)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {k: got.get(k, k) for k in (1, 2, 3, 4, 7, 8, 9, 10, 20, 30, 40)} == {1: 1, 2: 1, 3: 1, 4: 1, 7: 7, 8: 7, 9: 7, 10: 10, 20: 10, 30: 10, 40: 10}


def test_op2(spark):
    urls = ["http://www.Example.com/en/x?q", "https://EXAMPLE.com/en/1", "http://a.net/es/", "b.com/x", None, "http://c.com", "http://d.org/p", "http://notcom/x", "http://x.net/fr/9#y", ""] * 3
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: r for r in url_filter.judge(df).collect()}
    assert len(got) == 30
    assert [got[i]["rule"] for i in range(10)] == ["www.example.com/en/", "example.com/en/", "net/es/", None, None, None, None, None, "net/fr/", None]
    assert (got[0]["host"], got[0]["path"], got[4]["host"], got[5]["path"]) == ("www.example.com", "/en/x", "", "")
    assert all(got[i]["verdict"] in ("allow", "block") for i in got) and got[0]["verdict"] == "allow" and got[8]["verdict"] == "block"


@pytest.mark.parametrize("module, column, mod, out, least", [(quality, "quality", 4, 2, 0.9), (toxicity, "toxic", 3, 1, 0.85)])
def test_classifiers(spark, module, column, mod, out, least):
    """Held-out accuracy; misspellings are not among the words that were learnt."""
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioutnsrl") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    bad = ["kzzork", "vexxqu", "wyzzbal"]
    rows, labels = [], []
    for i in range(1500):
        w = [rng.choice(words) for _ in range(rng.choice([5, 40, 120]))]
        sign = i % 3 == 0
        if sign:
            for _ in range(1 + len(w) // 15):
                x = rng.choice(bad)
                w[rng.randrange(len(w))] = x + rng.choice("aeiou") if zlib.crc32(str(i).encode()) % mod == out else x
        rows.append((i, " ".join(w)))
        labels.append((i, int(sign)))
    docs = spark.createDataFrame([*rows, (9000, None), (9001, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in module.classify(docs, spark.createDataFrame([*labels, (None, 1), (70000, None)], f"doc_id long, {column} int")).collect()}
    assert len(got) == 1502 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert np.mean([p == y for p, y in held]) >= least
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % mod == out) for i, r in got.items())


def test_training_without_two_classes():
    weights, bias = subword.train([(np.array([1]), np.array([1.0], np.float32))], np.array([1]))
    assert not weights.any() and bias > 0


def structured_rows():
    """Words over two letters that sums of powers modulo 2**64 take for equal."""
    rows = []
    for n in (1024, 2048):
        x = [0]
        while len(x) < n:
            x += [1 - v for v in x]
        a, b = ("".join(pair[v] for v in x) for pair in ("ab", "ba"))
        base = [f"q{n}w{i}" for i in range(30)]
        rows += [(n, a), (n + 1, b), (n + 2, " ".join(base[:15] + [a] + base[15:])), (n + 3, " ".join(base[:15] + [b] + base[15:]))]
    return rows


@pytest.mark.parametrize("run, want", [(substring_dedup.repeat_digest, brute.op1), (suffix_dedup.repeat_digest, brute.op8), (minhash.near_duplicates, brute.op5)])
def test_structured_words_do_not_collide(spark, run, want):
    rows = structured_rows()
    assert tuples(run(spark.createDataFrame(rows, "doc_id long, text string"))) == want(rows)


def test_rows_that_share_an_id(spark):
    rng = random.Random(9)
    a, b = (" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(2))
    rows = [(1, a), (1, b), (2, a), (3, b), (3, "c d e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert tuples(suffix_dedup.repeat_digest(docs)) == brute.op8(rows)
    assert tuples(substring_dedup.repeat_digest(docs)) == brute.op1(rows)
    assert [r[2] for r in tuples(minhash.near_duplicates(docs))] == [1] * 5  # versions of one document


def test_op5_recall(spark):
    """Pairs at and above the threshold, each in a cluster of its own, among pairs below it."""
    rng = random.Random(6)
    rows = []
    for i in range(400):
        w = [f"v{i}x{j}" for j in range(104)]
        other = list(w)
        for at in rng.sample(range(104), rng.choice([1, 2, 3, 4])):
            other[at] = f"n{i}x{at}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(other))]
    want, got = brute.op5(rows), tuples(minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    linked = [(x, y) for x, y in zip(want, got) if not x[3]]
    assert all(not x[3] for x, y in zip(want, got) if not y[3])  # nothing is linked that should not be
    assert np.mean([x == y for x, y in linked]) >= 0.99


def _search_recall(v, k=20, asked=150):
    import pandas as pd

    graphs = hnsw._build_shard(pd.DataFrame({"rep": np.arange(len(v)), "v": list(v), "shard": 0}))
    got = hnsw._search_block(k + 1, hnsw.EF_SEARCH)(graphs, pd.DataFrame({"query": np.arange(asked), "v": list(v[:asked])}))
    hit = 0
    for i in range(asked):
        want = [j for j in np.argsort(-(v @ v[i]), kind="stable") if j != i][:k]
        hit += len(set(want) & set(got[(got["query"] == i) & (got["rep"] != i)]["rep"].tolist()[:k]))
    return hit / asked / k


def test_op4_recall_on_uneven_lengths():
    rng = np.random.default_rng(0)
    unit = rng.normal(size=(2500, 32))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    assert _search_recall(unit * np.exp(rng.normal(size=(2500, 1)))) >= 0.95
    one = unit.copy()
    one[7] *= 1e4
    assert _search_recall(one) >= 0.95


def test_op4_few_candidates_and_shared_ids(spark):
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [-1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in hnsw.nearest(df, df.where("vec_id % 20 = 0"), k=20).orderBy("rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, -0.5)]  # of the two rows 20 the lesser vector


def test_op6_lengths_beyond_squares_and_shared_ids(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    rows = [(i, [float(c) for c in base + rng.normal(scale=0.05, size=8)]) for i in range(30)]
    rows += [(90, [1e-200 * float(c) for c in base]), (91, [1e200 * float(c) for c in base]), (92, [1e-200] + [0.0] * 7), (93, [5e-324] + [0.0] * 7)]
    got = {r["vec_id"]: r for r in pq_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert all(got[i]["component_id"] == 0 and got[i]["n_links"] == 31 for i in [*range(30), 90, 91])
    assert (got[92]["n_links"], got[92]["component_id"], got[93]["component_id"]) == (1, 92, 92)
    twice = tuples(pq_dedup.near_duplicates(spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 2.0])], "vec_id long, embedding array<double>")))
    assert twice == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]


def test_op6_probes_find_what_is_linked(spark):
    """Many lists, of which a query goes to some: links against brute force."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 24))
    for i in range(0, 3000, 3):
        v[i + 1] = v[i] + rng.normal(scale=0.3, size=24) * np.linalg.norm(v[i]) / 5
    df = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    u = pq_dedup._unit(v)
    want = (u @ u.T >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(df).collect()}
    assert all(got[i] <= w for i, w in enumerate(want)) and sum(got.values()) >= 0.99 * want.sum() > 500
    book = pq_dedup.train(u, 108)
    assert pq_dedup.probes(u, book, 0.9) < 60


@pytest.mark.parametrize("tight_first, cosine, directions", [(True, 0.9001, "rows"), (False, 0.9001, "rows"), (True, 0.9001, "any"), (False, 0.96, "any")])
def test_op6_keeps_links_whatever_the_order_of_kinds(spark, tight_first, cosine, directions):
    rng = np.random.default_rng(11)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    groups = unit(rng.standard_normal((100, 32)))
    tight, loose = unit(groups[rng.integers(0, 100, 1500)] + 0.04 * rng.standard_normal((1500, 32))), unit(rng.standard_normal((1500, 32)))
    kinds = np.concatenate([tight, loose] if tight_first else [loose, tight])
    base = loose[:1000]
    aim = kinds[(np.flatnonzero(np.isin(kinds[:, 0], base[:, 0])) + rng.integers(1, 3000, 1000)) % 3000] if directions == "rows" else rng.standard_normal(base.shape)
    near = cosine * base + np.sqrt(1 - cosine**2) * unit(aim - (aim * base).sum(1)[:, None] * base)
    v = np.concatenate([kinds, near])
    want = ((v @ v.T) >= 0.9).sum(1) - 1
    got = {r["vec_id"]: r["n_links"] for r in pq_dedup.near_duplicates(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()}
    got = np.array([got[i] for i in range(len(v))])
    assert (got <= want).all()  # no pair is counted from both sides
    assert got[-1000:].sum() >= 0.997 * want[-1000:].sum() and got.sum() >= 0.999 * want.sum()


M = (1 << 64) - 1


def _mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M
    x ^= x >> 29
    x = x * 0xC4CEB9FE1A85EC53 & M
    return x ^ x >> 32


def _word_hash(w):
    import xxhash

    if len(w) > 64:
        return xxhash.xxh3_64_intdigest(w, 0x27D4EB2F)
    h = _mix(((int.from_bytes(w[:8], "little") ^ 0x5851F42D4C957F2D) + len(w) * 0xD6E8FEB86659FD93) & M)
    for i in range(8, len(w), 8):
        y = h * 0x9E3779B97F4A7C15 & M
        y = ((y << 27 | y >> 37) + int.from_bytes(w[i : i + 8], "little")) & M
        h = _mix(y)
    return h


def _naive_buckets(text, log2, lower):
    import re

    data = text.encode()
    data = bytes(c + 32 if lower and 65 <= c <= 90 else c for c in data)
    out, before = [], None
    for w in re.findall(rb"[^\x20\x09-\x0D]+", data):
        h = _word_hash(w)
        out.append((h * 0x9E3779B97F4A7C15 & M) >> (64 - log2))
        if w == before:
            out.append(0xB5297A4D >> (32 - log2))
        before = w
    padded = b" " + re.sub(rb"[\x09-\x0D]", b" ", data) + b" "
    for size in (3, 4, 5, 6):
        for i in range(len(padded) - size + 1):
            gram = padded[i : i + size]
            if b" " not in gram[1:-1]:
                out.append(((int.from_bytes(gram, "big") + (size << 56)) * 0x9E3779B97F4A7C15 & M) >> (64 - log2))
    return sorted(out)


def _as_chunk(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


@pytest.mark.parametrize("lower", [True, False])
def test_features_and_scores_against_plain_python(lower):
    texts = ["", "  ", "A bad bad BAD word", "xyzzyxyzzy \t plugh", "é" * 5, "w" * 70 + " w", "a\nb", "q" * 40_000 + " idiot " * 3000]
    data, off = _as_chunk(texts)
    doc, bucket = subword.token_buckets(data, off, 12, lower)
    for i, t in enumerate(texts):
        assert sorted(bucket[doc == i].tolist()) == _naive_buckets(t, 12, lower)
    features = subword.document_features(data, off, 12, lower)
    assert features[-1][1].sum() == len(_naive_buckets(texts[-1], 12, lower)) and features[-1][1].max() >= 39_990  # counts are not capped
    weights = np.random.default_rng(0).normal(size=1 << 12).astype(np.float32)
    got = subword.score_chunk(data, off, weights, 0.25, lower)
    for i, t in enumerate(texts):
        b = _naive_buckets(t, 12, lower)
        mean = sum(float(weights[x]) for x in b) / max(1, len(b))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(mean + 0.25))), abs=1e-9)


def test_calibration_is_the_damped_optimum():
    rng = np.random.default_rng(3)
    y = (rng.random(200) < 0.5).astype(int)
    x = rng.normal(size=200) + y
    scale, offset = subword.calibrate(x, y, 0.2)
    weight = np.where(y == 1, 0.2 / y.mean(), 0.8 / (1 - y.mean()))

    def loss(a, b):
        z = a * x + b
        return float((weight * (np.log1p(np.exp(z)) - y * z)).sum() + 5e-3 * ((a - 1) ** 2 + b**2))

    assert all(loss(scale, offset) <= loss(scale + da, offset + db) for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))


@pytest.mark.parametrize("module, column", [(quality, "quality"), (toxicity, "toxic")])
def test_classifier_edges(spark, module, column):
    rows = [(i, f"good words here {i}" if i % 2 else f"odd junk zzz {i}", "x") for i in range(60)] + [(100, None, "x"), (101, "", "x"), (102, "long " * 60_000, "x"), (1, "good words here 1", "x"), (None, "lost", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None)], f"doc_id long, {column} int")
    got = module.classify(docs, labels).collect()
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got)
    again = {(r["doc_id"], r["score"]) for r in module.classify(docs, labels).collect()}
    assert again == {(r["doc_id"], r["score"]) for r in got}
    edge = got[0]["score"]  # a score that is the threshold counts as reached
    at = {r["doc_id"]: r["predicted"] for r in module.classify(docs, labels, threshold=edge).collect()}
    assert at[got[0]["doc_id"]] == 1
    kept = module.keep(docs, labels, threshold=edge)
    assert kept.columns == docs.columns


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    from candela.llm import stage

    class Away:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "spark://host:7077"

            class getConf:
                get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="checkpoint"):
        stage.shared_dir(Away)


def test_op7_long_words_and_marks(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rng = random.Random(8)
    alphabet = "abcdefghiorst'.,!?-0123 éßñÜİ日本ñ̃ǅͅ\u200b\xa0\x85_$|<>A\n\t\r"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(1500)] + ["<|endoftext|> x<|startoftext|>y", "it's we'LL don't", "x" * 3000, "é" * 300, "z" * 32, "z" * 33, "", " "]
    got = packing.ChunkTokens(path).ids(texts)
    assert all(np.frombuffer(g, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids for x, g in zip(texts, got))


def test_op7_latin_texts_as_a_whole(monkeypatch):
    """Texts of Latin-1 are cut into words as a whole, so white-space chunks are kept for others only."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, tokens, rng = Tokenizer.from_file(path), packing.ChunkTokens(path), random.Random(9)
    chunks = []
    monkeypatch.setattr(packing, "REMEMBERED_WORDS", 100)
    inner = packing.ChunkTokens._learn
    monkeypatch.setattr(packing.ChunkTokens, "_learn", lambda self, new: chunks.extend(new) or inner(self, new))
    kinds = ["abcdth  \n.,;:!?", "abT \u00c9\u00df\u00b5.,", "".join(map(chr, range(256))), "it's we'LL don't'd'RE 12", "<|endoftext|> A."]
    texts = ["".join(rng.choice(k) for _ in range(rng.randint(0, 90))) for k in kinds for _ in range(300)] + ["", " ", "...", "a..b. .c", "Z" * 300, "Z" * 32 + "."]
    special = ["<|endoftext|> x<|startoftext|>y", "a<|EndOfText|>", "\u65e5\u672c no Latin-1", "\u0130 a"]
    for part in (texts, special, texts[::-1]):
        for lo in range(0, len(part), 70):
            got = tokens.ids(part[lo : lo + 70])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [t.encode(x, add_special_tokens=False).ids for x in part[lo : lo + 70]]
        assert len(tokens.words) <= 100 + 70 * 90 and max(map(len, tokens.words), default=0) <= packing.LONGEST_REMEMBERED
    assert 0 < len(chunks) < 20


COPIES = [(i, t) for i, t in enumerate(["Same Text", "same text", "SAME TEXT", "same  text", None, "", "É", "é", "long " * 9000, "LONG " * 9000, "long " * 8999 + "lung ", "\x00", "\x00\x00", "a\nb", "A\nB"])]
COPIES += [(3, "same text"), (3, "same text"), (2, "SAME TEXT"), (90, "other"), (90, "other")] + [(200 + i, "copy " * 40) for i in range(80)]


@pytest.mark.parametrize("options", [{}, {"huge": 1000, "piece": 64}, {"moduli": (5,)}, {"moduli": (2,), "huge": 4000}])
def test_op11(spark, options, monkeypatch):
    # with a modulus of 5 or 2 nearly every group holds different texts: comparison decides
    monkeypatch.setattr(exact_dedup, "SLICE", 1 << 14)
    rows = COPIES + ROWS if not options.get("moduli") else COPIES
    rows = [(d + 1000 * (i >= len(COPIES)), t) for i, (d, t) in enumerate(rows)]
    df = spark.createDataFrame([(*r, 1, "x", True) for r in rows] + [(None, "same text", 1, "x", True)], "doc_id long, text string, members long, print string, first boolean")
    assert tuples(exact_dedup.duplicates(df.repartition(3), **options)) == brute.op11(rows)


def test_op11_empty(spark):
    assert exact_dedup.duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_op11_fingerprints_compose():
    data = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    polynomials = exact_dedup.Polynomials()
    whole = polynomials.of(data, np.array([0, 5000]))[0]
    cuts = np.array([0, 7, 7, 1200, 4999, 5000])
    parts = polynomials.of(data, cuts)
    added = np.array([polynomials.shifted(row, 5000 - int(end)) for row, end in zip(parts.tolist(), cuts[1:])])
    for i, p in enumerate(exact_dedup.MODULI):
        plain = 0
        for byte in data.tolist():
            plain = (plain * polynomials.bases[i] + byte + 1) % p
        assert plain == whole[i] == added[:, i].sum() % p


def tokens_of_libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    back = {c: b for b, c in bpe.byte_symbols().items()}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = [b.id_to_piece(i) for i in range(b.get_piece_size())]
    own = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in pieces]
    return lambda t: [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(t, add_special_tokens=False).ids], lambda t: [(i, own[i]) for i in b.encode(t)]


ALIGNED = ROWS + [(300, " "), (301, "a  b   "), (302, "▁x"), (303, "<|endoftext|> <s> </s>"), (304, "\n\n  foo\t 　 bar\u2028x"), (305, "\x00a"), (306, "é ﬁ ½ 👩‍👩‍👧 don't"), (307, "  lead"), (307, "  lead"), (308, "1234567890" * 300)]


@pytest.mark.parametrize("small", [False, True])
def test_op12(spark, small, monkeypatch):
    if small:  # many shards, slices, rows of counts and blocks of pairs; nothing is remembered
        for name, x in (("SHARD_PAIRS", 50), ("SLICE_LINKS", 20), ("ROW_PAIRS", 3), ("BLOCK_PAIRS", 7), ("REMEMBERED_TOKENS", 10)):
            monkeypatch.setattr(alignment, name, x)
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in ALIGNED] + [(None, "a b", 1, "x", 2)], "doc_id long, text string, row long, pair string, shard int").repartition(3)
    got = alignment.align_digest(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    assert tuples(got) == brute.op12(ALIGNED, *tokens_of_libraries())


def test_op12_groups_of_many_tokens():
    # tokens whose ends meet only at the end of each document: repeated ids, all pairs
    rng = np.random.default_rng(3)
    ga, gb = np.repeat([0, 1, 2], [40, 1, 7]), np.repeat([0, 1, 2], [30, 5, 1])
    ia, ib = rng.integers(0, 6, len(ga)), rng.integers(0, 5, len(gb))
    doc = np.array([0, 0, 1])
    want = {}
    for g in range(3):
        for x in ia[ga == g].tolist():
            for y in ib[gb == g].tolist():
                key = int(doc[g]), x * alignment.ID + y
                want[key] = want.get(key, 0) + 1
    assert {(d, p): n for d, p, n in zip(*(x.tolist() for x in alignment.linked_pairs(ga, ia, gb, ib, doc)))} == want


def test_op12_coalesce():
    a, b = np.array([2, 5, 6, 9]), np.array([1, 5, 9])
    ga, gb = alignment.coalesce(a, b)
    assert ga.tolist() == [0, 0, 1, 1] and gb.tolist() == [0, 0, 1]


def test_op12_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert tuples(alignment.align_digest(docs, *paths)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
    assert alignment.align_digest(docs.where("false"), *paths).collect() == []


def periodic(seed=5):
    rng = random.Random(seed)
    rows = [(i, t) for i, t in ROWS]
    for i in range(120):
        k = rng.choice([1, 2, 3, 50])
        w = [f"w{rng.randrange(k)}" for _ in range(rng.choice([0, 1, 23, 24, 60, 150]))]
        for _ in range(rng.randrange(3)):
            p, at = rng.randint(1, 20), rng.randint(0, len(w))
            w[at:at] = (w[:p] * 8)[: rng.randint(0, 90)]
        rows.append((1000 + i, " ".join(w)))
    return rows + [(2000, "a\x1cb " * 30), (2001, "x " * 23), (2002, "x " * 24), (2003, "ab " * 24 + "ab"), (2001, "y " * 25)]


def test_op13(spark):
    rows = periodic()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows] + [(None, "a " * 40, 1, "x")], "doc_id long, text string, start long, runs string").repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.run_digest(df).collect()), key=str)
    assert got == sorted(brute.op13(rows), key=str)
    assert sum(r[1] > 1 for r in got) > 5
    every = tuples(periodic_runs.runs(df))
    assert every == sorted((d, *r) for d, t in rows for r in brute.runs(brute.words(t)))
    kept = {r.doc_id: r.text for r in periodic_runs.collapse(df).collect()}
    assert kept[2002] == "x" and kept[2000] == "a\x1cb" and kept[2001] in ("x " * 22 + "x", "y")


def test_op13_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic_runs.run_digest(empty).collect() == [] and periodic_runs.runs(empty).collect() == []


def test_op13_sequences():
    rng = random.Random(8)
    for _ in range(400):
        k = rng.choice([1, 2, 3, 5])
        w = [rng.randrange(k) for _ in range(rng.randint(0, 70))]
        for least, times in ((24, 3), (4, 3), (2, 2)):
            assert sorted(periodic_runs.runs_of(w, least, times), key=lambda r: (r[0], r[2])) == brute.runs(w, least, times)


def test_op13_long_text():
    words = [f"w{i * i % 7919}" for i in range(4000)]
    w = words[:500] + words[500:800] * 40 + words[800:]
    assert periodic_runs.runs_of([hash(x) for x in w]) == [(500, 12000, 300)]


@pytest.mark.parametrize("w", [1, 2, 7, 71])
def test_anchors_are_the_first_least(w):
    rng = np.random.default_rng(w)
    # few values, so that ties are many; some differ in their lower halves alone
    x = (rng.integers(0, 4, 500).astype(np.uint64) << np.uint64(62)) | rng.integers(0, 9, 500).astype(np.uint64)
    upper = (x >> np.uint64(32)).tolist()
    want = [i + min(range(w), key=lambda j: (upper[i + j], j)) for i in range(len(x) - w + 1)]
    assert kernels._leftmost_least(x, w).tolist() == want


def test_equal_windows_have_their_anchor_at_the_same_place():
    rng = np.random.default_rng(0)
    passage = rng.integers(0, 3, 40)
    text = np.concatenate([rng.integers(0, 3, 30), passage, rng.integers(0, 3, 25), passage, rng.integers(0, 3, 8)])
    k, w = 4, 9
    grams = np.zeros(len(text), np.uint64)
    for i in range(len(text) - k + 1):
        grams[i] = kernels.mix(np.array([int("".join(map(str, text[i : i + k])), 3) + 1], np.uint64))[0]
    at, first, last = kernels.cells(grams, np.full(len(text), len(text)), w, k)
    place = {}
    for a, lo, hi in zip(at.tolist(), first.tolist(), last.tolist()):
        for i in range(lo, hi + 1):
            place.setdefault(tuple(text[i : i + w + k - 1].tolist()), set()).add(a - i)
    assert sum(hi - lo + 1 for lo, hi in zip(first.tolist(), last.tolist())) == len(text) - (w + k - 1) + 1
    assert all(len(x) == 1 for x in place.values()) and len(place) < len(text) - (w + k - 1) + 1
