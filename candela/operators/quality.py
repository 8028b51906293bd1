"""Quality flags, Mahalanobis outliers and locked cohorts."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.parsing import is_finite
from ..functions.special import chi2_quantile

#: policy: (flag that admits a row, one distractor scan a person)
POLICIES = {"primary": ("include_mahalanobis", False), "technical_only_sensitivity": ("include_technical_only", False), "one_per_person": ("include_mahalanobis", True)}


def _group(columns, what: str) -> list[Column]:
    """Missing suppresses non-finite."""
    missing = F.lit(False)
    odd = F.lit(False)
    for c in columns:
        missing = missing | F.col(c).isNull() | F.isnan(c)
        odd = odd | ~is_finite(F.col(c))
    return [F.when(missing, f"missing_{what}_feature").when(odd, f"non_finite_{what}_feature")]


def hard_failures(df: DataFrame, shape: list[str], efa: list[str], status: str | None = "status", efa_status: str = "efa_status") -> DataFrame:
    """hard_qc_failure and hard_qc_reason, the reasons in fixed order joined by ;."""
    reasons = []
    if status and status in df.columns:
        reasons.append(F.when(~F.coalesce(F.lower(F.trim(status)).isin("success", "ok", "skipped"), F.lit(False)), "radiomics_failure"))
    reasons.append(F.when(~F.coalesce(F.lower(F.trim(efa_status)) == "success", F.lit(False)), "efa_failure"))
    reason = F.concat_ws(";", *reasons, *_group(shape, "shape"), *_group(efa, "efa"))
    return df.withColumn("hard_qc_reason", reason).withColumn("hard_qc_failure", F.col("hard_qc_reason") != "")


class Fit(NamedTuple):
    """What one dataset's distances are measured by."""

    dataset: str
    n_fit: int
    features: list[str]
    mean: list[float]
    size: np.ndarray
    inverse: np.ndarray
    rank: int
    condition_number: float
    threshold: float


def _fits(df: DataFrame, features: list[str], dataset: str, confidence: float) -> list[Fit]:
    """One fit a dataset, of its rows that are no hard failure. Spark sums the moments; only
    matrices of len(features) squared reach the driver."""
    valid = df.where(~F.col("hard_qc_failure"))
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    rows = valid.groupBy(dataset).agg(
        F.count("*").alias("n"), *[F.min(c).alias(f"lo_{c}") for c in features], *[F.max(c).alias(f"hi_{c}") for c in features],
        *[F.avg(c).alias(f"mean_{c}") for c in features], *[F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in pairs],
    ).collect()
    out = []
    for r in sorted(rows, key=lambda r: r[dataset]):
        used = [c for c in features if r[f"hi_{c}"] > r[f"lo_{c}"]]
        if not used:
            raise ValueError(f"all features are constant in {r[dataset]}")
        if r["n"] <= len(used) + 1:
            raise ValueError(f"too few rows in {r[dataset]}: {r['n']}")
        size = np.array([r[f"hi_{c}"] - r[f"lo_{c}"] for c in used])
        cov = np.array([[r[f"cov_{a}_{b}"] if (a, b) in pairs else r[f"cov_{b}_{a}"] for b in used] for a in used]) / np.outer(size, size)
        rank, inverse = int(np.linalg.matrix_rank(cov)), np.linalg.pinv(cov)
        if rank < 1:
            raise ValueError(f"covariance of {r[dataset]} has rank 0")
        out.append(Fit(r[dataset], r["n"], used, [r[f"mean_{c}"] for c in used], size, inverse, rank, float(np.linalg.cond(cov)), chi2_quantile(confidence, rank)))
    return out


def mahalanobis(df: DataFrame, features: list[str], dataset: str = "dataset", confidence: float = 0.99) -> DataFrame:
    """Squared Mahalanobis distance of the rows that are no hard failure, within each dataset,
    on min-max scaled features that vary there; the threshold is the chi-square quantile with
    the covariance's rank as degrees of freedom, and outliers lie strictly above."""
    d2 = threshold = F.lit(None).cast("double")
    for fit in _fits(df, features, dataset, confidence):
        z = [(F.col(c) - m) / float(s) for c, m, s in zip(fit.features, fit.mean, fit.size)]
        form = F.lit(0.0)
        for i in range(len(z)):
            for j in range(len(z)):
                form = form + z[i] * z[j] * float(fit.inverse[i, j])
        here = (F.col(dataset) == fit.dataset) & ~F.col("hard_qc_failure")
        d2, threshold = F.when(here, form).otherwise(d2), F.when(here, F.lit(fit.threshold)).otherwise(threshold)
    return df.withColumns({"mahalanobis_distance_squared": d2, "mahalanobis_threshold": threshold}).withColumn("mahalanobis_outlier", F.coalesce(F.col("mahalanobis_distance_squared") > F.col("mahalanobis_threshold"), F.lit(False)))


def mahalanobis_fits(df: DataFrame, features: list[str], dataset: str = "dataset", confidence: float = 0.99) -> DataFrame:
    """One row a dataset: how many rows were fitted, how many features vary, the rank and the
    condition number of their scaled covariance (infinite, if singular) and the threshold."""
    rows = [(f.dataset, f.n_fit, len(f.features), f.rank, f.condition_number, f.threshold) for f in _fits(df, features, dataset, confidence)]
    kind = df.schema[dataset].dataType.simpleString()
    return df.sparkSession.createDataFrame(rows, f"{dataset} {kind}, n_fit long, n_features int, covariance_rank int, condition_number double, threshold double")


def include_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"include_technical_only": ~F.col("hard_qc_failure"), "include_mahalanobis": ~(F.col("hard_qc_failure") | F.col("mahalanobis_outlier"))})


def qc_counts(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    return df.groupBy(dataset).agg(F.count("*").alias("n_input"), F.count_if("hard_qc_failure").alias("n_hard_failure"), F.count_if(~F.col("hard_qc_failure")).alias("n_fit"), F.count_if("mahalanobis_outlier").alias("n_outlier"))


def pair_completeness(df: DataFrame) -> DataFrame:
    """How many scans of either flag each person has."""
    return df.groupBy("person_id").pivot("pre_0_post_1", [0, 1]).count().na.fill(0).withColumnsRenamed({"0": "n_pre", "1": "n_post"})


def cohort_roles(df: DataFrame, policy: str, institutional: str = "institutional", ordinal: str | None = None) -> DataFrame:
    """All rows with their role under a policy: query and true_reference are the scans of
    eligible people that have both, distractor the eligible scans of the other dataset (the
    first by `ordinal` a person, where the policy says so), excluded the rest. Without `ordinal` the
    column ordinal gives the order of input (stages.with_input_order), or else case_id."""
    column, one = POLICIES[policy]
    ordinal = ordinal or _order_of(df)
    eligible, own = F.col(column), F.col("dataset") == institutional
    people = df.where(eligible & own).groupBy("person_id").agg(F.min("pre_0_post_1").alias("a"), F.max("pre_0_post_1").alias("b")).where("a = 0 and b = 1").select("person_id", F.lit(True).alias("paired"))
    out = df.join(people, "person_id", "left")
    distractor = eligible & ~own
    if one:
        order = F.row_number().over(Window.partitionBy("person_id", (eligible & ~own)).orderBy(ordinal))
        out = out.withColumn("_first", order)
        distractor = distractor & (F.col("_first") == 1)
    pair = eligible & own & F.coalesce("paired", F.lit(False))
    role = F.when(pair & (F.col("pre_0_post_1") == 1), "query").when(pair, "true_reference").when(distractor, "distractor").otherwise("excluded")
    return out.withColumns({"role": role, "cohort_policy": F.lit(policy)}).drop("paired", "_first")


def genuine_errors(audit: DataFrame) -> DataFrame:
    """(cohort_policy, person_id, n_query, n_genuine) of the people of a cohort that haven't one query
    with one genuine reference: none, where the cohort can be locked."""
    by = audit.where("role in ('query', 'true_reference')").groupBy("cohort_policy", "person_id")
    return by.agg(F.count_if(F.col("role") == "query").alias("n_query"), F.count_if(F.col("role") == "true_reference").alias("n_genuine")).where("n_query <> 1 or n_genuine <> 1")


def locked(audit: DataFrame) -> DataFrame:
    """The audit, only if every query has one genuine reference."""
    bad = genuine_errors(audit).limit(3).collect()
    if bad:
        raise ValueError(f"queries without one genuine reference: {[r['person_id'] for r in bad]}")
    return audit


def cohort_summary(audit: DataFrame) -> DataFrame:
    """Counts of a cohort, one row a policy."""
    of = lambda r: F.count_if(F.col("role") == r)
    return audit.groupBy("cohort_policy").agg(
        F.count("*").alias("n_input"), of("query").alias("n_query"), of("true_reference").alias("n_true_reference"), of("distractor").alias("n_distractor"),
        of("excluded").alias("n_excluded"), (of("true_reference") + of("distractor")).alias("n_gallery"), F.count_distinct(F.when(F.col("role") != "excluded", F.col("person_id"))).alias("n_people"),
    )


def _order_of(df: DataFrame) -> str:
    return "ordinal" if "ordinal" in df.columns else "case_id"


def first_scan(df: DataFrame, ordinal: str | None = None) -> DataFrame:
    """One row a person, the first by ordinal, as in cohort_roles."""
    ordinal = ordinal or _order_of(df)
    first = df.groupBy("person_id").agg(F.min_by("case_id", ordinal).alias("case_id"))
    return df.join(first, ["person_id", "case_id"], "left_semi")


def paired_cases(df: DataFrame, drop_incomplete: bool = False) -> DataFrame:
    """(person_id, pre_case_id, post_case_id). A repeated scan fails; a missing one too, unless dropped."""
    g = df.groupBy("person_id").agg(*[F.count_if(F.col("pre_0_post_1") == v).alias(f"n{v}") for v in (0, 1)], *[F.max(F.when(F.col("pre_0_post_1") == v, F.col("case_id"))).alias(n) for v, n in ((0, "pre_case_id"), (1, "post_case_id"))])
    bad = g.where("n0 > 1 or n1 > 1" if drop_incomplete else "n0 <> 1 or n1 <> 1").limit(3).collect()
    if bad:
        raise ValueError(f"people without one pair: {[r['person_id'] for r in bad]}")
    return g.where("n0 = 1 and n1 = 1").select("person_id", "pre_case_id", "post_case_id")
