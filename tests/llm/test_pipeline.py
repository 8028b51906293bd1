"""The pipeline's stages at the smallest size: what goes, what stays, what is placed."""

import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline as p
    from candela.llm import minhash, quality, suffix_dedup, toxicity

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = docs
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        ids, was = {r[0] for r in now.select("doc_id").collect()}, {r[0] for r in docs.select("doc_id").collect()}
        if name == "quality":
            assert ids == {r["doc_id"] for r in quality.classify(docs, labels, learn_from=first).collect() if r["predicted"]}
        if name == "toxicity":
            assert ids == {r["doc_id"] for r in toxicity.classify(docs, labels, learn_from=first).collect() if not r["predicted"]}
        if name == "minhash":
            rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            assert ids == {r[0] for r in brute.op5(rows) if r[3]} == {r["doc_id"] for r in minhash.near_duplicates(docs).collect() if r["kept"]}
        if name == "suffix":
            rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
            kept = {r["doc_id"]: r["text"] for r in now.collect()}
            for d, _, removed, _, digest in brute.op8(rows):
                text = dict(rows)[d].encode()
                assert len(kept[d].encode()) <= len(text) - removed and (removed or brute.sha(kept[d]) == digest)
            assert ids == was
        if name == "packing":
            assert ids == was and brute.bins_are_sound([(r["doc_id"], r["piece"], r["start"], r["length"], 0, r["sequence_id"], r["offset"]) for r in now.collect()])
        else:
            assert now.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs = now


def test_run_is_the_stages_one_after_the_other(spark, tmp_path):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in p.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    whole = p.run(spark, SF)
    plain = lambda df: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert whole.columns == docs.columns and plain(whole) == plain(docs)


def test_rows_that_share_an_id_and_nulls(spark):
    import corpus_pipeline as p

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = docs.limit(3).collect()
    rows = [*map(tuple, some), (some[0]["doc_id"], "another text", "en", "s", 12), (None, "no id", "en", "s", 5), (987654, None, None, None, None)]
    odd = spark.createDataFrame(rows, docs.schema)
    stages = dict(p.STAGES)
    kept = stages["quality"](spark, odd, SF)
    assert kept.where("doc_id is null").count() == 0 and kept.columns == docs.columns
    one = stages["minhash"](spark, odd.where("doc_id is not null"), SF)
    assert one.count() == one.select("doc_id").distinct().count() and one.columns == docs.columns
    assert stages["suffix"](spark, odd.where("doc_id is not null"), SF).columns == docs.columns
    assert labels.count() > 0
