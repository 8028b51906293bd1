"""Manifests: what a run read and wrote, so that a later run can insist on it.

A manifest is JSON beside the run's outputs. It holds the hash of each output, and references (name
and hash) to inputs and to the manifests of earlier runs, so all manifests of a study are a graph
that hashes hold together. Guards look at the manifests that a run is about to build on; audit()
checks every manifest below a folder as Spark jobs. All files are reached by Hadoop's file system."""

from __future__ import annotations

import json
import platform
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import require_same_keys
from .store import Store
from .tables import artifact_hashes, read_true_ranks

MANIFEST = "manifest.json"
SHA256 = "^[0-9a-f]{64}$"


class LineageError(ValueError):
    """Outputs or manifests do not belong together."""


# --- identities


def content_hash(df: DataFrame) -> str:
    """The same for the same rows in any order and any files: the sum of row hashes."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"h{i}") for i in range(4)]
    r = df.agg(F.count("*").alias("n"), *parts).first()
    return ":".join([str(r["n"]), *(f"{int(r[f'h{i}'] or 0):x}" for i in range(4))])


def directory_hash(spark: SparkSession, root: str) -> str:
    """One hash of the relative names and contents of all files below a folder."""
    where = lambda x: F.regexp_replace(x, "^[A-Za-z0-9]+:/*", "/")
    files = artifact_hashes(spark, root).select(where(F.col("path")).alias("p"), "sha256")
    start = F.length(where(F.lit(Store(spark).qualified(root)))) + 2
    line = F.concat(F.substring("p", start, F.length("p")), F.lit("\n"), "sha256")
    r = files.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("h")).first()
    if not r["n"]:
        raise LineageError(f"{root} holds no file")
    return r["h"]


def runtime_info(spark: SparkSession) -> dict:
    return {"spark": spark.version, "python": platform.python_version(), "python_implementation": platform.python_implementation(), "platform": platform.system(), "machine": platform.machine(), "parallelism": spark.sparkContext.defaultParallelism}


def task_count(spark: SparkSession, requested: int, n_cases: int, most: int | None = None) -> int:
    """Partitions for heavy cases: -1 is as many as run at once; never more than the cases, or `most`."""
    if requested != -1 and requested < 1:
        raise LineageError("tasks are -1 or a positive number")
    if n_cases < 1:
        raise LineageError("at least one case is required")
    n = spark.sparkContext.defaultParallelism if requested == -1 else requested
    return min(n, n_cases, most or n_cases)


# --- guards on paths


def _load(store: Store, path: str) -> dict:
    try:
        value = json.loads(store.read_text(path))
    except ValueError as e:
        raise LineageError(f"the manifest {store.name(path)} is unreadable") from e
    if not isinstance(value, dict):
        raise LineageError(f"the manifest {store.name(path)} is unreadable")
    return value


def require_safe_output(store: Store, path: str, inputs: Iterable[str]) -> None:
    """The output is neither an input, nor the folder of one, nor above or inside one."""
    out = store.qualified(path)
    for i in inputs:
        i = store.qualified(i)
        if out == i or f"{i}/".startswith(f"{out}/") or f"{out}/".startswith(f"{i}/"):
            raise LineageError(f"output {store.name(path)} collides with input {store.name(i)}")


def require_distinct_outputs(store: Store, outputs: Sequence[str], inputs: Iterable[str]) -> None:
    """No two outputs are one file, and none is an input."""
    named = [store.qualified(o) for o in outputs]
    if len(set(named)) != len(named):
        raise LineageError("two outputs are the same file")
    taken = sorted({n.rsplit("/", 1)[1] for n in named} & {store.name(i) for i in inputs if store.qualified(i) in named})
    if taken:
        raise LineageError(f"outputs are inputs: {taken}")


def output_collisions(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(path, n_outputs, n_inputs) of paths that two outputs have, or an output and an input: the
    same for tables of paths, by grouping both."""
    both = outputs.select("path", F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(inputs.select("path", F.lit(0).alias("o"), F.lit(1).alias("i")))
    return both.groupBy("path").agg(F.sum("o").alias("n_outputs"), F.sum("i").alias("n_inputs")).where("n_outputs > 1 or (n_outputs > 0 and n_inputs > 0)")


def require_owned_manifest(store: Store, path: str, pipeline: str) -> None:
    """A manifest that exists is this pipeline's."""
    if store.exists(path):
        owner = _load(store, path).get("pipeline")
        if owner != pipeline:
            raise LineageError(f"{store.name(path)} is a manifest of {owner}, not of {pipeline}")


# --- guards on what manifests say


def require_output(store: Store, manifest: str, output: str, keys: Sequence[str]) -> dict:
    """The manifest of a completed run that recorded, under keys, the hash that the output has."""
    if not store.is_file(manifest):
        raise LineageError(f"there is no manifest {store.name(manifest)}")
    body = _load(store, manifest)
    if body.get("completed") is not True:
        raise LineageError(f"the run of {store.name(manifest)} was not completed")
    found: object = body
    for key in keys:
        found = found.get(key) if isinstance(found, dict) else None
    found = found.get("sha256") if isinstance(found, dict) else found
    if found is None:
        raise LineageError(f"{store.name(manifest)} records no hash under {'.'.join(keys)}")
    if found != store.sha256(output):
        raise LineageError(f"{store.name(output)} has another hash than its manifest says")
    return body


def require_sibling_output(store: Store, output: str) -> tuple[dict, dict]:
    """(manifest, reference to it) of the run that wrote an output beside its manifest."""
    manifest = f"{store.parent(output)}/{MANIFEST}"
    return require_output(store, manifest, output, ("outputs", store.name(output))), store.reference(manifest)


def require_cohort_lineage(store: Store, query: str, gallery: str, features: str, feature_manifest: str, keys: Sequence[str], kind: str) -> dict:
    """What a matching run stands on: query and gallery of one locked cohort, features of the very
    run that the cohort's quality control used, and one segmentation run behind both."""
    if store.parent(query) != store.parent(gallery):
        raise LineageError("query and gallery are of different cohort folders")
    cohort, cohort_reference = require_sibling_output(store, query)
    require_sibling_output(store, gallery)
    run, reference = require_output(store, feature_manifest, features, keys), store.reference(feature_manifest)
    used = cohort.get("qc_feature_manifests")
    if not isinstance(used, dict):
        raise LineageError("the cohort names no feature manifests of its quality control")
    if used.get(kind) != reference:
        raise LineageError(f"the cohort's quality control used another {kind} run")
    segmentation = cohort.get("segmentation_manifest")
    if not segmentation or segmentation != run.get("segmentation_manifest"):
        raise LineageError("cohort and features are of different segmentation runs")
    return {"cohort_manifest": cohort_reference, "feature_manifest": reference, "qc_feature_manifests": used, "segmentation_manifest": segmentation}


def require_matching_output(store: Store, output: str) -> tuple[dict, dict]:
    """(manifest, reference) of a matching run that says what statistics need."""
    body, reference = require_sibling_output(store, output)
    missing = [k for k in ("cohort_policy", "n_query", "n_reference", "inputs", "upstream") if k not in body]
    if missing:
        raise LineageError(f"the matching manifest lacks {', '.join(missing)}")
    for key, least in (("n_query", 1), ("n_reference", 2)):
        if not isinstance(body[key], int) or isinstance(body[key], bool) or body[key] < least:
            raise LineageError(f"the matching manifest has a bad {key}")
    if not isinstance(body["inputs"], dict) or not {"query_csv", "reference_csv"} <= set(body["inputs"]):
        raise LineageError("the matching manifest names no query and reference inputs")
    return body, reference


def require_paired_outputs(store: Store, a: str, b: str) -> dict:
    """What two matching runs over one locked cohort share; primary only if both are."""
    (one, reference_a), (two, reference_b) = require_matching_output(store, a), require_matching_output(store, b)
    alike = {"cohort policies": "cohort_policy", "query counts": "n_query", "reference counts": "n_reference"}
    for what, key in alike.items():
        if one[key] != two[key]:
            raise LineageError(f"the runs have different {what}")
    for key in ("query_csv", "reference_csv"):
        if one["inputs"][key] != two["inputs"][key]:
            raise LineageError(f"the runs read different {key}")
    cohorts = [m["upstream"].get("cohort_manifest") if isinstance(m["upstream"], dict) else None for m in (one, two)]
    if not cohorts[0] or cohorts[0] != cohorts[1]:
        raise LineageError("the runs stand on different cohorts")
    primary = one.get("analysis_role") == two.get("analysis_role") == "primary"
    return {"cohort_policy": one["cohort_policy"], "analysis_role": "primary" if primary else "sensitivity", "n_query": one["n_query"], "n_reference": one["n_reference"], "cohort_manifest": cohorts[0], "matching_manifest_a": reference_a, "matching_manifest_b": reference_b}


def verified_cohort(spark: SparkSession, path: str, pipeline: str) -> tuple[DataFrame, dict, dict]:
    """(table, manifest, reference) of a cohort audit, only if its completed run was the pipeline's."""
    body, reference = require_sibling_output(Store(spark), path)
    if body.get("pipeline") != pipeline:
        raise LineageError(f"the cohort is of {body.get('pipeline')}, not of {pipeline}")
    return spark.read.option("header", True).option("inferSchema", True).csv(path), body, reference


def verified_primary_rank(spark: SparkSession, path: str, cohort: DataFrame, cohort_reference: dict, person: str = "query_person") -> tuple[DataFrame, dict]:
    """(ranks, reference) of the primary matching run over that very cohort, one row for each of its
    people (cohort: query_person)."""
    body, reference = require_sibling_output(Store(spark), path)
    if body.get("analysis_role") != "primary":
        raise LineageError("the ranks are not of a primary analysis")
    upstream = body.get("upstream")
    if not isinstance(upstream, dict) or upstream.get("cohort_manifest") != cohort_reference:
        raise LineageError("ranks and cohort are of different runs")
    ranks = read_true_ranks(spark, path, person)
    if body.get("n_query") != ranks.count():
        raise LineageError("the manifest has another number of queries than the ranks")
    require_same_keys(ranks, cohort, [person])
    return ranks, reference


# --- runs


class Run:
    """Writes an incomplete manifest first and a complete one last, so a failed run leaves
    its old outputs but no manifest that vouches for them. more: further fields, such as upstream
    or analysis_role."""

    def __init__(self, spark: SparkSession, manifest: str, pipeline: str, inputs: dict, parameters: dict, **more):
        self.store = Store(spark)
        require_owned_manifest(self.store, manifest, pipeline)
        self.path = manifest
        self.body = {"pipeline": pipeline, "schema_version": 2, "completed": False, "inputs": inputs, "parameters": parameters, "outputs": {}, "runtime": runtime_info(spark), **more}

    def __enter__(self) -> Run:
        self.store.publish_json(self.path, self.body)
        return self

    def output(self, name: str, df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(path)
        self.body["outputs"][name] = content_hash(df.sparkSession.read.parquet(path))

    def report(self, df: DataFrame, path: str) -> None:
        """A small table as one CSV file, by its name and the file's hash."""
        self.store.publish_csv(df, path)
        self.body["outputs"][self.store.name(path)] = self.store.sha256(path)

    def __exit__(self, kind, value, trace) -> None:
        if kind is None:
            self.body["completed"] = True
            self.store.publish_json(self.path, self.body)


def reusable(manifest: dict | None, parameters: dict, inputs: dict[str, str], outputs: dict[str, str]) -> bool:
    """A result is used again only if settings, inputs and its own content are the same."""
    return bool(manifest) and manifest.get("completed") is True and manifest.get("parameters") == parameters and manifest.get("inputs") == inputs and manifest.get("outputs") == outputs


# --- the graph of all manifests


def manifests(spark: SparkSession, root: str) -> DataFrame:
    """(path, folder, sha256, pipeline, completed, outputs, refs, readable) of every file below root
    that is called *manifest.json. refs: (key, name, sha256) of all references in it, at any of
    the top fields or one below."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{MANIFEST}").load(root)
    text = F.col("content").cast("string")
    fields = F.from_json(text, "map<string,string>")
    m = files.select("path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.sha2("content", 256).alias("sha256"), text.alias("text"), fields.alias("f"))
    top = F.map_entries("f")
    flat = F.transform(top, lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    nested = F.flatten(F.transform(top, lambda e: F.transform(F.coalesce(F.map_entries(F.from_json(e["value"], "map<string,string>")), F.array().cast("array<struct<key:string,value:string>>")), lambda x: F.struct(F.concat(e["key"], F.lit("."), x["key"]).alias("key"), x["value"].alias("value")))))
    refs = F.transform(F.concat(flat, nested), lambda e: F.struct(e["key"].alias("key"), F.get_json_object(e["value"], "$.name").alias("name"), F.get_json_object(e["value"], "$.sha256").alias("sha256")))
    refs = F.filter(refs, lambda r: r["name"].isNotNull() & r["sha256"].rlike(SHA256))
    got = lambda key: F.get(F.filter(F.transform(top, lambda e: F.when(e["key"] == key, e["value"])), lambda x: x.isNotNull()), F.lit(0))
    return m.select("path", "folder", "sha256", got("pipeline").alias("pipeline"), F.coalesce(got("completed") == "true", F.lit(False)).alias("completed"), F.from_json(got("outputs"), "map<string,string>").alias("outputs"), refs.alias("refs"), (F.col("f").isNotNull() & (F.size("f") > 0)).alias("readable"))


def audit(spark: SparkSession, root: str) -> DataFrame:
    """(path, subject, error) of everything below root that doesn't hold: manifests that are unreadable
    or incomplete, outputs in a manifest's folder that are missing or have another hash, and
    references to manifests that no manifest answers. Outputs that are recorded by content_hash
    are tables and not looked up as files."""
    m = manifests(spark, root)
    bad = m.where("not readable").select("path", F.lit("").alias("subject"), F.lit("unreadable").alias("error"))
    open_ = m.where("readable and not completed").select("path", F.lit("").alias("subject"), F.lit("incomplete").alias("error"))
    said = m.where("readable").select("path", "folder", F.explode("outputs").alias("subject", "said"))
    said = said.withColumn("said", F.coalesce(F.get_json_object("said", "$.sha256"), "said")).where(F.col("said").rlike(SHA256))
    found = artifact_hashes(spark, root).select(F.col("path").alias("file"), F.col("sha256").alias("found"))
    held = said.withColumn("file", F.concat("folder", F.lit("/"), "subject")).join(found, "file", "left")
    error = F.when(F.col("found").isNull(), "output_missing").when(F.col("found") != F.col("said"), "output_has_another_hash")
    outputs = held.select("path", "subject", error.alias("error")).where("error is not null")
    refs = m.where("readable").select("path", F.explode("refs").alias("r")).where(F.col("r.name").endswith(MANIFEST))
    lost = refs.join(m.select(F.col("sha256").alias("there")).distinct(), F.col("r.sha256") == F.col("there"), "left_anti").select("path", F.col("r.key").alias("subject"), F.lit("reference_without_manifest").alias("error"))
    return bad.unionByName(open_).unionByName(outputs).unionByName(lost)


def ancestors(spark: SparkSession, root: str, manifest: str) -> DataFrame:
    """(path, sha256, pipeline, depth) of the manifests that one stands on, itself at depth 0, by the
    shortest way. One join a level: studies are a few levels deep."""
    m = manifests(spark, root).persist()
    try:
        edges = m.select("sha256", F.explode("refs").alias("r")).select(F.col("sha256").alias("from"), F.col("r.sha256").alias("to"))
        level = [Store(spark).sha256(manifest)]
        seen = {level[0]: 0}
        while level:
            after = edges.where(F.col("from").isin(level)).join(m.select("sha256"), F.col("to") == F.col("sha256"), "left_semi").select("to").distinct()
            depth = max(seen.values()) + 1
            level = [r["to"] for r in after.collect() if r["to"] not in seen]
            seen |= dict.fromkeys(level, depth)
        depths = spark.createDataFrame(list(seen.items()), "sha256 string, depth int")
        rows = m.select("path", "sha256", "pipeline").join(depths, "sha256").select("path", "sha256", "pipeline", "depth").collect()
        return spark.createDataFrame(rows, "path string, sha256 string, pipeline string, depth int")
    finally:
        m.unpersist()
