import hashlib
import json

import pytest
from pyspark.sql import functions as F

from candela.operators.contracts import ContractError
from candela.sources import lineage, tables
from candela.sources.store import Store
from candela.streaming.scorer import rank_stream


@pytest.fixture(params=["plain", "viewfs"])
def root(request, spark, tmp_path):
    """A folder; for viewfs under a name that only Spark opens."""
    if request.param == "plain":
        return str(tmp_path)
    host = tmp_path.name.lower().replace("_", "-")
    spark._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{host}.link./in", f"file://{tmp_path}")
    return f"viewfs://{host}/in"


def test_content_hash(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    assert lineage.content_hash(df) == lineage.content_hash(df.repartition(3).orderBy("b"))
    assert lineage.content_hash(df) != lineage.content_hash(df.limit(1))


def test_run_protocol(spark, root):
    store, df = Store(spark), spark.createDataFrame([("ü", 1), (None, 2)], "a string, b int")
    path = f"{root}/manifest.json"
    with pytest.raises(RuntimeError), lineage.Run(spark, path, "p", {}, {}):
        raise RuntimeError
    assert json.loads(store.read_text(path))["completed"] is False
    with lineage.Run(spark, path, "p", {}, {}, analysis_role="primary") as run:
        run.output("t", df, f"{root}/t")
        run.report(df.orderBy("b"), f"{root}/r.csv")
    m = json.loads(store.read_text(path))
    assert m["completed"] is True and m["analysis_role"] == "primary" and m["outputs"]["t"] == lineage.content_hash(df)
    assert store.read_text(f"{root}/r.csv") == "\ufeffa,b\nü,1\n,2\n"
    assert lineage.require_output(store, path, f"{root}/r.csv", ("outputs", "r.csv")) == m
    with pytest.raises(lineage.LineageError, match="of p, not of another"):
        lineage.Run(spark, path, "another", {}, {})
    assert not [f for f in store.children(root) if f.startswith("_")]


def test_publishing(spark, root):
    store = Store(spark)
    store.publish_json(f"{root}/x.json", {"a": 1})
    with pytest.raises(ValueError):
        store.publish_json(f"{root}/x.json", {"a": float("nan")})
    assert json.loads(store.read_text(f"{root}/x.json")) == {"a": 1}
    store.publish_csv(spark.range(3).orderBy("id"), f"{root}/x.csv")
    bad = spark.range(3).selectExpr("cast(raise_error('broken') as string) as id")
    with pytest.raises(Exception, match="broken"):
        store.publish_csv(bad, f"{root}/x.csv")
    assert store.read_text(f"{root}/x.csv") == "\ufeffid\n0\n1\n2\n"
    assert spark.read.option("header", True).csv(f"{root}/x.csv").columns == ["id"]  # the mark is not part of the name
    store.publish_csv(spark.range(0), f"{root}/x.csv", bom=False)
    assert store.read_text(f"{root}/x.csv") == "id\n" and sorted(store.children(root)) == ["x.csv", "x.json"]


def test_hashes_of_any_size(spark, root):
    store = Store(spark)
    for name, text in (("d/a b.txt", "a" * 5000), ("d/e/b.txt", "b"), ("d/e f/empty", "")):
        store.publish_text(f"{root}/{name}", text)
    want = {name: hashlib.sha256(text.encode()).hexdigest() for name, text in (("a b.txt", "a" * 5000), ("b.txt", "b"), ("empty", ""))}
    for most in (1 << 28, 100, 0):  # in tasks, mixed, streamed
        assert {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in tables.artifact_hashes(spark, f"{root}/d", most).collect()} == want
    assert store.reference(f"{root}/d/a b.txt") == {"name": "a b.txt", "sha256": want["a b.txt"]}
    h = lineage.directory_hash(spark, f"{root}/d")
    lines = sorted(f"{n}\n{want[n.rsplit('/', 1)[-1]]}" for n in ("a b.txt", "e/b.txt", "e f/empty"))
    assert h == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    store.publish_text(f"{root}/d/e/b.txt", "c")
    assert lineage.directory_hash(spark, f"{root}/d") != h
    store.delete(f"{root}/d/e/b.txt")
    store.delete(f"{root}/d/a b.txt")
    store.delete(f"{root}/d/e f/empty")
    with pytest.raises(lineage.LineageError, match="no file"):
        lineage.directory_hash(spark, f"{root}/d")


def test_output_paths(spark, root):
    store = Store(spark)
    for out in (f"{root}/in.csv", f"{root}/x/../in.csv", root, f"{root}/in.csv/part"):
        with pytest.raises(lineage.LineageError, match="collides"):
            lineage.require_safe_output(store, out, [f"{root}/in.csv"])
    lineage.require_safe_output(store, f"{root}/in.csv2", [f"{root}/in.csv"])
    lineage.require_distinct_outputs(store, [f"{root}/a", f"{root}/b"], [f"{root}/c"])
    with pytest.raises(lineage.LineageError, match="same file"):
        lineage.require_distinct_outputs(store, [f"{root}/a", f"{root}/x/../a"], [])
    with pytest.raises(lineage.LineageError, match=r"outputs are inputs: \['a'\]"):
        lineage.require_distinct_outputs(store, [f"{root}/a", f"{root}/b"], [f"{root}/./a"])
    df = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert sorted(map(tuple, lineage.output_collisions(df("a", "b", "b", "c"), df("c", "d", "d")).collect())) == [("b", 2, 0), ("c", 1, 1)]
    store.publish_text(f"{root}/m.json", "{")
    with pytest.raises(lineage.LineageError, match="unreadable"):
        lineage.require_owned_manifest(store, f"{root}/m.json", "p")
    assert lineage.task_count(spark, -1, 1000) == spark.sparkContext.defaultParallelism and lineage.task_count(spark, 50, 20, 8) == 8
    for bad in ((0, 5), (-2, 5), (3, 0)):
        with pytest.raises(lineage.LineageError):
            lineage.task_count(spark, *bad)


def study(spark, root):
    """Segmentation, features, cohort and two matching runs, each with its manifest."""
    store = Store(spark)

    def run(folder, pipeline, files, **body):
        for name, text in files.items():
            store.publish_text(f"{root}/{folder}/{name}", text)
        store.publish_json(f"{root}/{folder}/manifest.json", {"pipeline": pipeline, "completed": True, "outputs": {n: store.sha256(f"{root}/{folder}/{n}") for n in files}, **body})
        return store.reference(f"{root}/{folder}/manifest.json")

    seg = run("seg", "segmentation", {"results.csv": "case_id\n"})
    feats = {k: run(k, k, {"features.csv": k}, segmentation_manifest=seg) for k in ("radiomics", "efa")}
    ranks = "query_person,true_rank,has_match_in_database\nA,1.0,true\nB,2.0,true\n"
    cohort = run("cohort", "cohort_locking", {"query.csv": "q", "reference.csv": "r", "audit.csv": "query_person\nA\nB\n"}, qc_feature_manifests=feats, segmentation_manifest=seg)
    inputs = {f"{x}_csv": store.reference(f"{root}/cohort/{x}.csv") for x in ("query", "reference")}
    common = {"cohort_policy": "all", "n_query": 2, "n_reference": 3, "inputs": inputs, "analysis_role": "primary"}
    for k in feats:
        run(f"match_{k}", "matching", {"true_rank.csv": ranks}, upstream={"cohort_manifest": cohort, "feature_manifest": feats[k]}, **common)
    return store


def test_study(spark, root):
    store = study(spark, root)
    assert lineage.audit(spark, root).collect() == []
    both = [f"{root}/match_{k}/true_rank.csv" for k in ("radiomics", "efa")]
    shared = lineage.require_paired_outputs(store, *both)
    assert shared["analysis_role"] == "primary" and shared["cohort_manifest"] == store.reference(f"{root}/cohort/manifest.json")
    files = f"{root}/cohort/query.csv", f"{root}/cohort/reference.csv", f"{root}/efa/features.csv", f"{root}/efa/manifest.json", ("outputs", "features.csv")
    assert lineage.require_cohort_lineage(store, *files, "efa")["segmentation_manifest"] == store.reference(f"{root}/seg/manifest.json")
    with pytest.raises(lineage.LineageError, match="another radiomics run"):
        lineage.require_cohort_lineage(store, *files, "radiomics")
    cohort, _, reference = lineage.verified_cohort(spark, f"{root}/cohort/audit.csv", "cohort_locking")
    ranks, _ = lineage.verified_primary_rank(spark, both[0], cohort, reference)
    assert ranks.count() == 2
    with pytest.raises(lineage.LineageError, match="not of other"):
        lineage.verified_cohort(spark, f"{root}/cohort/audit.csv", "other")
    with pytest.raises(lineage.LineageError, match="different runs"):
        lineage.verified_primary_rank(spark, both[0], cohort, {"name": "x", "sha256": "y"})
    with pytest.raises(ContractError):
        lineage.verified_primary_rank(spark, both[0], cohort.limit(1), reference)
    walk = {r["path"].split("/")[-2]: r["depth"] for r in lineage.ancestors(spark, root, f"{root}/match_efa/manifest.json").collect()}
    assert walk == {"match_efa": 0, "cohort": 1, "efa": 1, "radiomics": 2, "seg": 2}


BREAKS = {
    "incomplete": ("match_efa", lambda m: m | {"completed": False}, "not completed"),
    "no hash": ("match_efa", lambda m: m | {"outputs": {}}, "records no hash"),
    "hash": ("match_efa", lambda m: m | {"outputs": {"true_rank.csv": "0" * 64}}, "another hash"),
    "lacks": ("match_efa", lambda m: {k: v for k, v in m.items() if k != "upstream"}, "lacks upstream"),
    "count": ("match_efa", lambda m: m | {"n_query": 0}, "bad n_query"),
    "references": ("match_efa", lambda m: m | {"n_reference": True}, "bad n_reference"),
    "inputs": ("match_efa", lambda m: m | {"inputs": {"query_csv": {}}}, "names no query and reference"),
    "policy": ("match_efa", lambda m: m | {"cohort_policy": "x"}, "different cohort policies"),
    "queries": ("match_efa", lambda m: m | {"n_query": 7}, "different query counts"),
    "gallery": ("match_efa", lambda m: m | {"n_reference": 7}, "different reference counts"),
    "input": ("match_efa", lambda m: m | {"inputs": m["inputs"] | {"query_csv": {"name": "q", "sha256": "1"}}}, "read different query_csv"),
    "cohort": ("match_efa", lambda m: m | {"upstream": {"cohort_manifest": {"name": "manifest.json", "sha256": "1" * 64}}}, "different cohorts"),
}


@pytest.mark.parametrize("name", BREAKS)
def test_broken_pairs(spark, tmp_path, name):
    store = study(spark, str(tmp_path))
    folder, change, said = BREAKS[name]
    path = f"{tmp_path}/{folder}/manifest.json"
    store.publish_json(path, change(json.loads(store.read_text(path))))
    with pytest.raises(lineage.LineageError, match=said):
        lineage.require_paired_outputs(store, *[f"{tmp_path}/match_{k}/true_rank.csv" for k in ("radiomics", "efa")])


def test_broken_cohorts(spark, root):
    store = study(spark, root)
    body = json.loads(store.read_text(f"{root}/cohort/manifest.json"))
    files = f"{root}/cohort/query.csv", f"{root}/cohort/reference.csv", f"{root}/efa/features.csv", f"{root}/efa/manifest.json", ("outputs", "features.csv"), "efa"
    with pytest.raises(lineage.LineageError, match="different cohort folders"):
        lineage.require_cohort_lineage(store, f"{root}/seg/results.csv", *files[1:])
    for change, said in (({"qc_feature_manifests": None}, "names no feature manifests"), ({"segmentation_manifest": {"name": "manifest.json", "sha256": "2" * 64}}, "different segmentation runs")):
        store.publish_json(f"{root}/cohort/manifest.json", body | change)
        with pytest.raises(lineage.LineageError, match=said):
            lineage.require_cohort_lineage(store, *files)
    store.delete(f"{root}/cohort/manifest.json")
    with pytest.raises(lineage.LineageError, match="there is no manifest"):
        lineage.require_cohort_lineage(store, *files)


def test_audit_of_a_broken_study(spark, root):
    store = study(spark, root)
    store.publish_text(f"{root}/radiomics/features.csv", "changed")
    store.delete(f"{root}/efa/features.csv")
    seg = json.loads(store.read_text(f"{root}/seg/manifest.json"))
    store.publish_json(f"{root}/seg/manifest.json", seg | {"completed": False})
    store.publish_text(f"{root}/other/manifest.json", "not json")
    got = sorted((r["path"].split("/")[-2], r["subject"], r["error"]) for r in lineage.audit(spark, root).collect())
    lost = [("cohort", "segmentation_manifest", "reference_without_manifest"), ("efa", "segmentation_manifest", "reference_without_manifest"), ("radiomics", "segmentation_manifest", "reference_without_manifest")]
    assert got == sorted([("efa", "features.csv", "output_missing"), ("radiomics", "features.csv", "output_has_another_hash"), ("seg", "", "incomplete"), ("other", "", "unreadable"), *lost])


def test_case_artifacts(spark, root):
    store = Store(spark)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = []

    def case(case_id, folder=None, drop=(), config=None, **changes):
        folder = folder or case_id
        said = {"case_id": case_id, "person_id": "P", "pre_0_post_1": 0, "output_integrity": {k: {"name": f"{k}.nii", "sha256": sha(k + case_id)} for k in ("image", "mask")}}
        text = json.dumps(said) if config is None else config(said)
        for name, body in (("image.nii", "image" + case_id), ("mask.nii", "mask" + case_id), ("segmentation_config.json", text)):
            if name not in drop:
                store.publish_text(f"{root}/{folder}/{name}", body)
        at = store.qualified(f"{root}/{folder}")
        row = {"case_id": case_id, "person_id": "P", "pre_0_post_1": 0, "image_path": f"{at}/image.nii", "mask_path": f"{at}/mask.nii", "image_sha256": sha("image" + case_id).upper(), "mask_sha256": sha("mask" + case_id), "config_sha256": sha(text), "status": "OK"}
        rows.append(tuple((row | changes).values()))

    case("good")
    case("failed", drop=("image.nii", "mask.nii"), status="ERROR")
    case("elsewhere", folder="x")
    case("no_mask", drop=("mask.nii",))
    case("no_config", drop=("segmentation_config.json",))
    case("changed", image_sha256="0" * 64)
    case("no_hash", mask_sha256=None)
    case("broken", config=lambda s: "{")
    case("person", config=lambda s: json.dumps(s | {"person_id": "Q"}))
    case("name", config=lambda s: json.dumps(s | {"output_integrity": s["output_integrity"] | {"mask": {"name": "m", "sha256": "x"}}}))
    case("hash", config=lambda s: json.dumps(s | {"output_integrity": s["output_integrity"] | {"mask": {"name": "mask.nii", "sha256": "x"}}}))
    cases = spark.createDataFrame(rows, "case_id string, person_id string, pre_0_post_1 int, image_path string, mask_path string, image_sha256 string, mask_sha256 string, config_sha256 string, status string")
    texts = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(root).select("path", F.col("content").cast("string").alias("value"))
    got = dict(map(tuple, tables.case_artifact_errors(cases, tables.artifact_hashes(spark, root), texts).collect()))
    assert got == {
        "elsewhere": "paths_do_not_match_case", "no_mask": "missing_mask", "no_config": "missing_config", "changed": "image_hash_mismatch", "no_hash": "mask_hash_mismatch",
        "broken": "invalid_config", "person": "config_identity_mismatch", "name": "config_mask_name_mismatch", "hash": "config_mask_hash_mismatch",
    }


def test_input_cases(spark, tmp_path):
    f = tmp_path / "c.csv"
    f.write_text("﻿case_id,person_id,path,pre_0_post_1\nc1,p,a/b,0\nc2,p,a/c,1\n")
    assert tables.read_input_cases(spark, str(f)).count() == 2
    for body in ("c1,p,a,0\nC1,q,b,0\n", "c1,p,/a,0\n", "c1,p,../a,0\n", "c1,p,a,2\n", "c1,p,a,0\nc2,P,b,1\n", "c1,p,a,\n"):
        f.write_text("case_id,person_id,path,pre_0_post_1\n" + body)
        with pytest.raises(ContractError):
            tables.read_input_cases(spark, str(f))


def test_stream(spark, tmp_path):
    schema = "case_id string, person_id string, view string, h int, f array<double>"
    gallery = spark.createDataFrame([(f"r{p}", p, "cor", 1, [x]) for p, x in zip("ABC", (0.0, 5.0, 10.0))], schema)
    spark.createDataFrame([("qA", "A", "cor", 1, [0.1])], schema).write.parquet(str(tmp_path / "in"))
    rank_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), gallery, str(tmp_path / "out"), str(tmp_path / "cp"), k=2).awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("display_order").collect()
    assert [r["db_case"] for r in rows] == ["rA", "rB"]
