"""Reading and writing case tables."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import finite
from ..operators.contracts import validate_cases, validate_input_cases, validate_pairs, validate_true_ranks
from .store import Store

INPUT_SCHEMA = "case_id string, person_id string, path string, pre_0_post_1 string"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; a byte order mark is fine; blanks are null. Without a schema the
    types are inferred. NaN becomes null, infinities stay."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumns({f.name: finite(F.col(f.name)) for f in df.schema if f.dataType.typeName() in ("double", "float")})


def read_input_cases(spark: SparkSession, path: str) -> DataFrame:
    """The strict ingestion table: exactly case_id, person_id, path, pre_0_post_1."""
    df = spark.read.option("header", True).option("enforceSchema", False).schema(INPUT_SCHEMA).csv(path)
    return validate_input_cases(df)


def read_cases(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return validate_cases(read_csv(spark, path, schema), path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return validate_pairs(read_csv(spark, path))


def read_true_ranks(spark: SparkSession, path: str, person: str = "query_person") -> DataFrame:
    return validate_true_ranks(read_csv(spark, path), person)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Input order as a column, for operators that mean the first row: increasing within a
    file and over the files of a scan, not consecutive."""
    return df.withColumn(name, F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header. The job's committer publishes all files or none; single_file is for
    small report tables."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", True).csv(path)


def artifact_hashes(spark: SparkSession, path: str, row_bytes: int = 1 << 28) -> DataFrame:
    """(path, length, sha256) of the files below path, of any size. Tasks hash files of up to
    row_bytes, as a row holds a whole file; longer ones are streamed, one by one, by the
    driver's JVM, of which no more than a buffer is in memory."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    small = files.where(F.col("length") <= row_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > row_bytes).select("path", "length")
    store = Store(spark)
    rows = [(r["path"], r["length"], store.sha256(r["path"])) for r in large.toLocalIterator()]
    # the scan has no row for empty files; its listing has
    listed = spark.createDataFrame([(unquote(re.sub("^file:///", "file:/", x)),) for x in files.inputFiles()], "path string")
    empty = listed.join(files.select("path"), "path", "left_anti").select("path", F.lit(0).cast("long").alias("length"), F.sha2(F.lit("").cast("binary"), 256).alias("sha256"))
    out = small.unionByName(empty)
    return out.unionByName(spark.createDataFrame(rows, "path string, length long, sha256 string")) if rows else out


def case_artifact_errors(cases: DataFrame, hashes: DataFrame, configs: DataFrame) -> DataFrame:
    """(case_id, error) of successful cases whose files aren't those that were recorded.

    cases: case_id, person_id, pre_0_post_1, image_path, mask_path, image_sha256, mask_sha256,
    config_sha256, status; hashes: of artifact_hashes; configs: (path, value), the JSON texts of
    settings. Image and mask lie in one folder, called as the case, with its settings beside
    them, which name the case, both files and their hashes. The first fault counts: paths, a
    missing file, another hash, then the settings."""
    c, status = F.col, F.upper(F.trim(F.coalesce("status", F.lit("OK"))))
    folder = lambda x: F.regexp_extract(x, "^(.*)/[^/]*$", 1)
    name = lambda x: F.regexp_extract(x, "([^/]*)$", 1)
    rows = cases.where(status.isin("OK", "SKIPPED")).withColumn("config_path", F.concat(folder(c("mask_path")), F.lit("/segmentation_config.json")))
    for kind in ("image", "mask", "config"):
        rows = rows.join(hashes.select(c("path").alias(f"{kind}_path"), c("sha256").alias(f"{kind}_found")), f"{kind}_path", "left")
    said = "case_id string, person_id string, pre_0_post_1 int, output_integrity struct<image:struct<name:string,sha256:string>,mask:struct<name:string,sha256:string>>"
    rows = rows.join(configs.select(c("path").alias("config_path"), F.from_json("value", said).alias("said")), "config_path", "left")
    error = F.when((folder(c("image_path")) != folder(c("mask_path"))) | (name(folder(c("image_path"))) != c("case_id")), "paths_do_not_match_case")
    for kind in ("image", "mask", "config"):
        error = error.when(c(f"{kind}_found").isNull(), f"missing_{kind}").when(~F.equal_null(F.lower(f"{kind}_sha256"), c(f"{kind}_found")), f"{kind}_hash_mismatch")
    error = error.when(c("said.output_integrity").isNull(), "invalid_config")
    same = F.equal_null(c("said.case_id"), c("case_id")) & F.equal_null(c("said.person_id"), c("person_id")) & F.equal_null(c("said.pre_0_post_1"), c("pre_0_post_1").cast("int"))
    error = error.when(~same, "config_identity_mismatch")
    for kind in ("image", "mask"):
        error = error.when(~F.equal_null(c(f"said.output_integrity.{kind}.name"), name(c(f"{kind}_path"))), f"config_{kind}_name_mismatch").when(~F.equal_null(c(f"said.output_integrity.{kind}.sha256"), F.lower(f"{kind}_sha256")), f"config_{kind}_hash_mismatch")
    return rows.select("case_id", error.alias("error")).where("error is not null")


def verify_artifacts(cases: DataFrame, hashes: DataFrame, path_column: str, hash_column: str) -> DataFrame:
    """Cases whose recorded hash is not that of the file at their path, or whose file is missing.
    A file that is there without a hash is an error, not a mismatch."""
    found = hashes.select(F.col("path").alias(path_column), F.col("sha256").alias("_found"), F.lit(True).alias("_there"))
    joined = cases.join(found, path_column, "left")
    unread = F.raise_error(F.concat(F.col(path_column), F.lit(" was not hashed"))).cast("boolean")
    odd = F.when(F.col("_there") & F.col("_found").isNull(), unread).otherwise(F.col("_found").isNull() | ~F.equal_null("_found", hash_column))
    return joined.where(odd).drop("_found", "_there")
