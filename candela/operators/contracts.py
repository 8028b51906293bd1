"""Table contracts: each check costs one aggregate row on the driver."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.parsing import SHA256, is_finite

CASE = ("case_id", "person_id", "pre_0_post_1")
HASHES = ("image_sha256", "mask_sha256", "config_sha256")


class ContractError(ValueError):
    """A table does not keep its contract."""


def require_columns(df: DataFrame, required, table: str = "table") -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ContractError(f"{table} lacks {', '.join(missing)}")


def columns_by_prefix(columns, prefix: str) -> list[str]:
    out = sorted(c for c in columns if c.startswith(prefix))
    if not out:
        raise ContractError(f"no column starts with {prefix}")
    return out


def columns_by_pattern(columns, pattern: str) -> list[str]:
    out = sorted(c for c in columns if re.fullmatch(pattern, c))
    if not out:
        raise ContractError(f"no column matches {pattern}")
    return out


def _expect(df: DataFrame, table: str, **counts: Column) -> None:
    """Every count must be 0."""
    row = df.agg(*[F.coalesce(c, F.lit(0)).alias(k) for k, c in counts.items()]).first()
    bad = {k: row[k] for k in counts if row[k]}
    if bad:
        raise ContractError(f"{table}: " + ", ".join(f"{k} {v}" for k, v in bad.items()))


def case_audit(df: DataFrame) -> DataFrame:
    """One row of what breaks the case contract: all 0 in a sound table."""
    c, p = F.trim(F.col("case_id").cast("string")), F.trim(F.col("person_id").cast("string"))
    flag = F.col("pre_0_post_1").try_cast("double")
    return df.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.coalesce(c, F.lit("")) == "").alias("blank_case_id"),
        F.count_if(F.coalesce(p, F.lit("")) == "").alias("blank_person_id"),
        (F.count(c) - F.count_distinct(c)).alias("repeated_case_id"),
        F.count_if(~F.coalesce(flag.isin(0.0, 1.0), F.lit(False))).alias("bad_flag"),
    )


def validate_cases(df: DataFrame, table: str = "cases") -> DataFrame:
    """Trimmed ids and a byte flag, or ContractError."""
    require_columns(df, CASE, table)
    row = case_audit(df).first().asDict()
    bad = {k: v for k, v in row.items() if k != "n_rows" and v}
    if bad:
        raise ContractError(f"{table}: {bad}")
    return df.withColumns({"case_id": F.trim(F.col("case_id").cast("string")), "person_id": F.trim(F.col("person_id").cast("string")), "pre_0_post_1": F.col("pre_0_post_1").cast("double").cast("byte")})


def validate_input_cases(df: DataFrame) -> DataFrame:
    """The strict ingestion contract: exact columns, literal flags, ids and paths unique with
    case ignored, one capitalisation a person, paths relative and inside the root."""
    if set(df.columns) != {*CASE, "path"}:
        raise ContractError(f"columns are {df.columns}")
    low = lambda c: F.lower(F.col(c))
    blank = sum(F.count_if(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "") for c in df.columns)
    persons = df.groupBy(low("person_id").alias("p")).agg(F.count_distinct("person_id").alias("n")).where("n > 1")
    _expect(
        df, "input cases", blank=blank, bad_flag=F.count_if(~F.coalesce(F.col("pre_0_post_1").cast("string").isin("0", "1"), F.lit(False))),
        repeated_case=F.count("case_id") - F.count_distinct(low("case_id")), repeated_path=F.count("path") - F.count_distinct(low("path")),
        outside=F.count_if(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)")),
    )
    if not persons.isEmpty():
        raise ContractError("a person is written in two ways")
    return validate_cases(df, "input cases")


def require_numeric(df: DataFrame, columns, table: str = "features") -> DataFrame:
    """Columns as finite doubles, or ContractError."""
    require_columns(df, columns, table)
    as_number = {c: F.col(c).try_cast("double") for c in columns}
    _expect(df, table, **{f"not_finite_{c}": F.count_if(~is_finite(x)) for c, x in as_number.items()})
    return df.withColumns(as_number)


def validate_matching_cohorts(queries: DataFrame, gallery: DataFrame) -> str:
    """POST queries, PRE gallery, one policy, one query a person, one genuine reference each.
    Returns the policy."""
    for df, name, flag in ((queries, "queries", 1), (gallery, "gallery", 0)):
        require_columns(df, (*CASE, "cohort_policy"), name)
        _expect(df, name, wrong_flag=F.count_if(~F.coalesce(F.col("pre_0_post_1") == flag, F.lit(False))), blank_policy=F.count_if(F.coalesce(F.trim("cohort_policy"), F.lit("")) == ""))
    policies = [r[0] for r in queries.select("cohort_policy").union(gallery.select("cohort_policy")).distinct().limit(2).collect()]
    if len(policies) != 1:
        raise ContractError(f"policies {policies}")
    _expect(queries, "queries", repeated_person=F.count("*") - F.count_distinct("person_id"))
    genuine = gallery.groupBy("person_id").agg(F.count("*").alias("n"))
    _expect(queries.join(genuine, "person_id", "left"), "queries", without_one_genuine=F.count_if(F.coalesce(F.col("n"), F.lit(0)) != 1))
    return policies[0]


def validate_qc(df: DataFrame, paired: int | None = None, distractors: int | None = None) -> DataFrame:
    """Flags agree with one another; the numbers of complete pairs and of distractor scans
    are checked where given."""
    out = validate_cases(df, "qc")
    hard, outlier, tech, maha = (F.col(c) for c in ("hard_qc_failure", "mahalanobis_outlier", "include_technical_only", "include_mahalanobis"))
    _expect(out, "qc", technical=F.count_if(tech == hard), mahalanobis=F.count_if(maha != ~(hard | outlier)))
    if paired is not None:
        n = out.where("dataset = 'institutional'").groupBy("person_id").agg(F.count_distinct("pre_0_post_1").alias("k"), F.count("*").alias("n")).where("k = 2 and n = 2").count()
        if n != paired:
            raise ContractError(f"{n} complete pairs, not {paired}")
    if distractors is not None and (n := out.where("dataset <> 'institutional'").count()) != distractors:
        raise ContractError(f"{n} distractors, not {distractors}")
    return out


def validate_artifact_hashes(df: DataFrame, columns=HASHES) -> None:
    """Successful rows have a SHA-256 in every column, others have none."""
    good = F.upper(F.trim("status")).isin("OK", "SKIPPED", "SUCCESS")
    _expect(df, "artifacts", **{f"bad_{c}": F.count_if(good & ~F.coalesce(F.col(c).rlike(SHA256), F.lit(False))) for c in columns}, **{f"odd_{c}": F.count_if(~good & (F.coalesce(F.col(c), F.lit("")) != "")) for c in columns})


def validate_pairs(df: DataFrame) -> DataFrame:
    """query_person, db_case, label 0/1, finite score: unique pairs, one genuine and more
    than one pair a query."""
    require_columns(df, ("query_person", "db_case", "label", "score"), "pairs")
    _expect(df, "pairs", bad_score=F.count_if(~is_finite(F.col("score").try_cast("double"))), bad_label=F.count_if(~F.coalesce(F.col("label").try_cast("double").isin(0.0, 1.0), F.lit(False))))
    per_pair = df.groupBy("query_person", "db_case").agg(F.count("*").alias("n"), F.sum(F.col("label").cast("int")).alias("g"))
    per_query = per_pair.groupBy("query_person").agg(F.max("n").alias("n"), F.count("*").alias("pairs"), F.sum("g").alias("g"))
    _expect(per_query, "pairs", repeated=F.count_if(F.col("n") > 1), not_one_genuine=F.count_if(F.col("g") != 1), alone=F.count_if(F.col("pairs") < 2))
    return df.withColumns({"label": F.col("label").cast("int"), "score": F.col("score").cast("double")})


def validate_true_ranks(df: DataFrame, person: str = "query_person") -> DataFrame:
    """One row a person; a rank above 0, or null exactly where there is no match."""
    require_columns(df, (person, "true_rank", "has_match_in_database"), "ranks")
    rank = F.col("true_rank")
    _expect(df, "ranks", repeated=F.count("*") - F.count_distinct(person), not_positive=F.count_if(rank <= 0), disagree=F.count_if(rank.isNull() == F.col("has_match_in_database")))
    return df


def validate_review(df: DataFrame, pairs: DataFrame, domains: dict[str, tuple[str, ...]]) -> DataFrame:
    """Review sheet: closed domains, ISO dates, one row a person, ids as in the locked pairs."""
    ids = ("person_id", "pre_case_id", "post_case_id")
    require_columns(df, (*ids, "reviewer_id", "review_date", *domains), "review")
    bad_date = ~F.coalesce(F.col("review_date").cast("string").rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(F.col("review_date").cast("string")).isNotNull(), F.lit(False))
    _expect(df, "review", repeated=F.count("*") - F.count_distinct("person_id"), bad_date=F.count_if(bad_date), **{f"bad_{c}": F.count_if(~F.coalesce(F.col(c).isin(*d), F.lit(False))) for c, d in domains.items()})
    require_same_keys(df, pairs, ids, "review and locked pairs")
    return df


def key_differences(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys in one table only, with the side that has them."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))


def require_same_keys(a: DataFrame, b: DataFrame, keys, what: str = "tables") -> None:
    odd = key_differences(a, b, keys).limit(3).collect()
    if odd:
        raise ContractError(f"{what} differ: {[r.asDict() for r in odd]}")


#: What a feature table tells of its making; not joined.
NOT_FEATURES = ("status", "error_message", "path", "image_path", "mask_path", "processing_time_seconds")


def attach_audit(cohort: DataFrame, features: DataFrame) -> DataFrame:
    """One row of what breaks the 1:1 join on case_id: all 0 where attach_features works. Only
    the status success, in any case, counts as done; null does not."""
    good = F.coalesce(F.lower(F.trim(F.col("status").cast("string"))) == "success", F.lit(False)) if "status" in features.columns else F.lit(True)
    right = features.select(F.col("case_id").alias("_case_id"), F.col("person_id").alias("_person_id"), F.col("pre_0_post_1").alias("_flag"), good.alias("_good"))
    n = right.groupBy("_case_id").agg(F.count("*").alias("_n"), F.min("_person_id").alias("_person_id"), F.min("_flag").alias("_flag"), F.min("_good").alias("_good"))
    both = cohort.select(*CASE).join(n, F.col("case_id") == F.col("_case_id"), "left")
    return both.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("_case_id").isNull()).alias("missing"),
        F.count_if(~F.col("_good")).alias("failed"),
        F.count_if(F.col("person_id") != F.col("_person_id")).alias("other_person"),
        F.count_if(F.col("pre_0_post_1") != F.col("_flag")).alias("other_flag"),
        (F.count_if(F.col("_n") > 1) + F.count("*") - F.count_distinct("case_id")).alias("repeated"),
    )


def attach_features(cohort: DataFrame, features: DataFrame, name: str = "features") -> DataFrame:
    """Left 1:1 join on case_id; missing rows, another person or flag, and rows that are not a
    success fail."""
    require_columns(features, CASE, name)
    bad = {k: v for k, v in attach_audit(cohort, features).first().asDict().items() if k != "n_rows" and v}
    if bad:
        raise ContractError(f"{name}: " + ", ".join(f"{k} {v}" for k, v in bad.items()))
    drop = {*NOT_FEATURES, *CASE}
    return cohort.join(features.select("case_id", *[c for c in features.columns if c not in drop]), "case_id", "left")
