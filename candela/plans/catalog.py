"""The registered queries over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clouds, contracts, crossfit, curves, geometry, inference, quality, ranking, scoring, shapes, stages, summaries, voxels
from .roles import BLOCKS, H_VALUES, LONG_SQL, WIDE_SQL, customer_curves, queries_and_gallery, supplier_points, supplier_sizes, supplier_voxels, vector_grids, wide_cases

DIGITS = 9
ONE = ("sag", 4)  # the view of the single-view queries


def _modes(spark):
    return scoring.modes_table(spark)


def _one_view(spark, sf_dir):
    return scoring.view_scores(*_one_view_cases(spark, sf_dir), digits=DIGITS)


def case_contract_audit(spark, sf_dir):
    return contracts.case_audit(wide_cases(spark, sf_dir))


def feature_attach(spark, sf_dir):
    wide = wide_cases(spark, sf_dir)
    cohort = wide.where("dataset = 'institutional'").select(*contracts.CASE, "dataset")
    return contracts.attach_features(cohort, wide.drop("dataset").withColumn("status", F.lit("success"))).select("case_id", "person_id", "dataset", "n_events", "sag_H4_avg", "cor_H4_click")


def lopo_scaler(spark, sf_dir):
    q, g = queries_and_gallery(spark, sf_dir)
    s = scoring.scaler(q.select("person_id").distinct(), g)
    return s.select("person_id", "view", "h", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "x")).select("person_id", "view", "h", "i", "x.lo", "x.hi")


def lopo_pair_scores(spark, sf_dir):
    return ranking.pair_scores(_one_view(spark, sf_dir))


def _one_view_cases(spark, sf_dir):
    q, g = queries_and_gallery(spark, sf_dir)
    here = (F.col("view") == ONE[0]) & (F.col("h") == ONE[1])
    return q.where(here), g.where(here)


def lopo_true_rank(spark, sf_dir):
    return crossfit.true_rank_table(*_one_view_cases(spark, sf_dir), ONE[0], DIGITS)


def lopo_topk(spark, sf_dir):
    return crossfit.top_k(*_one_view_cases(spark, sf_dir), ONE[0], 10, DIGITS)


def view_scores(spark, sf_dir):
    q, g = queries_and_gallery(spark, sf_dir)
    return scoring.view_scores(q, g, digits=DIGITS)


def _fused(spark, sf_dir):
    return scoring.fused_scores(view_scores(spark, sf_dir), _modes(spark), digits=DIGITS)


def fused_scores(spark, sf_dir):
    return _fused(spark, sf_dir)


def _fixed(spark, sf_dir):
    q, g = queries_and_gallery(spark, sf_dir)
    return crossfit.fixed_configurations(q, g, _modes(spark), DIGITS)


def _fixed_of(spark, sf_dir, modes, h):
    """The rows of a few modes and one h, ranked once however often they are read."""
    q, g = (df.where(F.col("h") == h) for df in queries_and_gallery(spark, sf_dir))
    return crossfit.fixed_configurations(q, g, scoring.modes_table(spark, modes), DIGITS).persist()


def fixed_config_ranks(spark, sf_dir):
    return _fixed(spark, sf_dir).select("query_case", "mode", "h", "true_rank", "n_ties", "n_gallery")


def fixed_config_summary(spark, sf_dir):
    return crossfit.summarize_configurations(_fixed(spark, sf_dir), DIGITS).drop("rank1_rate", "rank5_rate", "rank10_rate")


def rank1_matrix(spark, sf_dir):
    return summaries.rank1_matrix(crossfit.summarize_configurations(_fixed(spark, sf_dir)), H_VALUES)


#: Stand-in for stage results: few events are a failure of the second extraction, and very
#: large values of the maximum are missing.
def _flagged(spark, sf_dir):
    wide = wide_cases(spark, sf_dir)
    wide = wide.withColumns({"status": F.lit("success"), "efa_status": F.when(F.col("n_events") < 25, "failed").otherwise("success"), "sag_H4_max": F.when(F.col("sag_H4_max") <= 300, F.col("sag_H4_max"))})
    return quality.hard_failures(wide, ["sag_H4_avg", "sag_H4_std", "sag_H4_max"], ["cor_H4_click", "axial_H4_b00"])


def hard_failure_flags(spark, sf_dir):
    return _flagged(spark, sf_dir).select("case_id", "hard_qc_failure", "hard_qc_reason")


def _qc(spark, sf_dir):
    return quality.include_flags(quality.mahalanobis(_flagged(spark, sf_dir), ["sag_H4_avg", "sag_H4_std"], confidence=0.95))


def mahalanobis_fits(spark, sf_dir):
    f = quality.mahalanobis_fits(_flagged(spark, sf_dir), ["sag_H4_avg", "sag_H4_std"], confidence=0.95)
    return f.withColumns({"condition_number": F.round("condition_number", 6), "threshold": F.round("threshold", 9)})


def mahalanobis_flags(spark, sf_dir):
    return _qc(spark, sf_dir).select("case_id", "dataset", F.round("mahalanobis_distance_squared", 6).alias("d2"), "mahalanobis_outlier", "include_technical_only", "include_mahalanobis")


def qc_counts(spark, sf_dir):
    return quality.qc_counts(_qc(spark, sf_dir))


def pair_completeness(spark, sf_dir):
    return quality.pair_completeness(wide_cases(spark, sf_dir))


def cohort_audit(spark, sf_dir):
    qc = _qc(spark, sf_dir)
    out = None
    for policy in quality.POLICIES:
        rows = quality.cohort_roles(qc, policy).select("cohort_policy", "case_id", "person_id", "role")
        out = rows if out is None else out.unionByName(rows)
    return out


def cohort_query(spark, sf_dir):
    return cohort_audit(spark, sf_dir).where("role = 'query'").select("cohort_policy", "case_id", "person_id")


def cohort_gallery(spark, sf_dir):
    return cohort_audit(spark, sf_dir).where("role in ('true_reference', 'distractor')")


def cohort_summary(spark, sf_dir):
    return quality.cohort_summary(cohort_audit(spark, sf_dir))


def paired_cases(spark, sf_dir):
    return quality.paired_cases(wide_cases(spark, sf_dir), drop_incomplete=True)


def first_scan(spark, sf_dir):
    return quality.first_scan(wide_cases(spark, sf_dir)).select("person_id", "case_id")


def crossfit_selection_audit(spark, sf_dir):
    q, g = queries_and_gallery(spark, sf_dir)
    return crossfit.fold_audit(q, g, _modes(spark), DIGITS, DIGITS)


def crossfit_true_rank(spark, sf_dir):
    q, g = queries_and_gallery(spark, sf_dir)
    return crossfit.held_out_ranks(q, g, _modes(spark), crossfit_selection_audit(spark, sf_dir), DIGITS).select("query_case", "mode", "h", "true_rank", "rank_1", "rank_5", "rank_10")


def tie_stage_summary(spark, sf_dir):
    return crossfit.tie_stages(crossfit_selection_audit(spark, sf_dir)).select("fold", "stage", "resolved_mode", "resolved_h", "agrees")


def deviating_folds(spark, sf_dir):
    q, g = queries_and_gallery(spark, sf_dir)
    audit, fixed = crossfit_selection_audit(spark, sf_dir).persist(), _fixed(spark, sf_dir).persist()
    return crossfit.deviating_folds(audit, crossfit.held_out_ranks(q, g, _modes(spark), audit, DIGITS, fixed), fixed)


def _ranks(spark, sf_dir):
    return crossfit.fixed_configurations(*_one_view_cases(spark, sf_dir), scoring.modes_table(spark, ONE[:1]), DIGITS)


def rank_rates(spark, sf_dir):
    return inference.rank_rates(_ranks(spark, sf_dir))


def cmc_curve(spark, sf_dir):
    return inference.cmc_curve(_ranks(spark, sf_dir))


def rank_distribution(spark, sf_dir):
    r = inference.rank_distribution(_ranks(spark, sf_dir))
    return r.select("n_ranked", F.round("mean_rank", 6).alias("mean_rank"), "median_rank", F.round("mean_normalised_rank", 6).alias("mean_normalised_rank"))


def mcnemar_table(spark, sf_dir):
    f = _fixed_of(spark, sf_dir, ("sag", "cor_sag_axial"), 4)
    one = lambda m: f.where(F.col("mode") == m)
    return inference.mcnemar(inference.align(one("sag"), one("cor_sag_axial"))).select("k", "n_both", "n01", "n10", "n_neither", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


def bootstrap_intervals(spark, sf_dir):
    s = inference.bootstrap_rates(_ranks(spark, sf_dir), replicates=10_000)
    return inference.percentile_interval(s)


def seeded_intervals(spark, sf_dir):
    """The cumulative curve with the band of a seeded bootstrap."""
    r, ks = _ranks(spark, sf_dir).persist(), tuple(range(1, 11))
    return inference.cmc_bands(inference.seeded_rates(r, ks, replicates=2000, order="query_case"), inference.cmc_curve(r))


def broken_views_audit(spark, sf_dir):
    """Views that are missing or repeated, told apart."""
    q, g = queries_and_gallery(spark, sf_dir)
    f = q.unionByName(g)
    broken = f.where(~((F.col("view") == "sag") & (F.length("case_id") % 7 == 0))).unionByName(f.where((F.col("view") == "axial") & F.col("case_id").contains("1")))
    return scoring.views_audit(broken)


def poisson_intervals(spark, sf_dir):
    return inference.percentile_interval(inference.poisson_rates(_ranks(spark, sf_dir)), by=("k",))


def per_query_auc(spark, sf_dir):
    a = ranking.auc_of_ranks(_ranks(spark, sf_dir))
    return a.select("query_person", "n_genuine", "n_impostor", F.round("auc", 9).alias("auc"))


def pooled_auc(spark, sf_dir):
    return crossfit.pooled_auc(*_one_view_cases(spark, sf_dir), ONE[0], DIGITS).select("n_genuine", "n_impostor", F.round("auc", 9).alias("auc"))


def spearman_rho(spark, sf_dir):
    w = wide_cases(spark, sf_dir)
    return inference.spearman(w, "n_events", "sag_H4_avg").select("n", F.round("rho", 9).alias("rho"))


def pca_scores(spark, sf_dir):
    out, share = inference.principal_components(wide_cases(spark, sf_dir).where("sag_H4_std is not null"), BLOCKS["sag", 4])
    return out.select("case_id", "pc1", "pc2", *[F.lit(x).alias(f"share{i + 1}") for i, x in enumerate(share)])


def pose_summary(spark, sf_dir):
    return summaries.pose_summary(wide_cases(spark, sf_dir), "sag_H4_avg", 50.0).select("group", "n", F.round("median", 9).alias("median"), "max", "min", "n_above")


def projection_summary(spark, sf_dir):
    w = wide_cases(spark, sf_dir)
    return summaries.projection_summary(w, {"cor": "n_events", "axial": "n_events"}, {"cor": "cor_H4_click", "axial": "axial_H2_b00"}, 0.2)


def runtime_quartiles(spark, sf_dir):
    q = summaries.quartiles(wide_cases(spark, sf_dir), "sag_H4_avg", ("dataset",))
    return q.select("dataset", "n", *[F.round(c, 9).alias(c) for c in ("q1", "median", "q3")], "unit")


def metric_distribution(spark, sf_dir):
    d = summaries.distribution(wide_cases(spark, sf_dir), ["sag_H4_avg", "n_events"], ("dataset",))
    return d.select("dataset", "metric", "n", *[F.round(c, 9).alias(c) for c in ("median", "q1", "q3", "min", "max")])


def review_counts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return summaries.value_counts(o, ["o_orderstatus", "o_orderpriority"]).select("field", "value", "n", F.round("percent", 9).alias("percent"))


def review_overview(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return summaries.review_overview(o, "o_custkey", {"n_any_urgent_or_pending": {"o_orderstatus": "P", "o_orderpriority": "1-URGENT"}, "n_any_open": {"o_orderstatus": "O"}})


def outlier_crosstab(spark, sf_dir):
    qc = _qc(spark, sf_dir).withColumns({"many_clicks": F.col("cor_H4_click") > 0.2, "few_events": F.col("n_events") < 30})
    people = qc.groupBy("person_id").agg(F.bool_or("mahalanobis_outlier").alias("outlier"), F.bool_or("many_clicks").alias("many_clicks"), F.bool_or("few_events").alias("few_events"))
    return summaries.crosstab(people, "outlier", ("outlier", "other"), ["many_clicks", "few_events"]).select("group", "finding", "n_group", "n", F.round("percent", 9).alias("percent"))


def rank1_crosstab(spark, sf_dir):
    w = wide_cases(spark, sf_dir).where("pre_0_post_1 = 1").select("case_id", (F.col("cor_H4_click") > 0.2).alias("many_clicks"), (F.col("n_events") < 30).alias("few_events"))
    r = _ranks(spark, sf_dir).select(F.col("query_case").alias("case_id"), F.coalesce(F.col("true_rank") <= 1, F.lit(False)).alias("first"))
    return summaries.crosstab(r.join(w, "case_id"), "first", ("rank-1", "not rank-1"), ["many_clicks", "few_events"]).select("group", "finding", "n_group", "n", F.round("percent", 9).alias("percent"))


def tail_diagnostics(spark, sf_dir):
    w = wide_cases(spark, sf_dir).select(F.col("case_id").alias("query_case"), (F.col("n_events") >= 30).alias("enough"), (F.col("sag_H4_avg") > 20).alias("large"))
    return summaries.tail_queries(_ranks(spark, sf_dir).join(w, "query_case", "left"), ["enough", "large"]).select("query_case", "rank_floor", "all_flags")


def key_differences(spark, sf_dir):
    """Customers without a large order."""
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet"), spark.read.parquet(f"{sf_dir}/orders.parquet")
    return contracts.key_differences(c.select("c_custkey"), o.where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")), ("c_custkey",))


def _broken(spark, sf_dir):
    """Cases of which some break the contract: blank ids, ids of another case, odd flags."""
    n = F.col("n_events")
    return wide_cases(spark, sf_dir).select(
        F.when(n % 11 == 0, " ").when(n % 13 == 0, "again").otherwise(F.col("case_id")).alias("case_id"), F.when(n % 7 == 0, F.lit(None)).otherwise(F.col("person_id")).alias("person_id"),
        F.when(n % 5 == 0, 2).otherwise(F.col("pre_0_post_1").cast("int")).alias("pre_0_post_1"), "n_events", "dataset",
    )


def broken_case_audit(spark, sf_dir):
    return contracts.case_audit(_broken(spark, sf_dir))


def broken_attach_audit(spark, sf_dir):
    """Failed, skipped and null results, other people and missing rows are told apart."""
    wide, n = wide_cases(spark, sf_dir), F.col("n_events")
    features = wide.where(n % 17 != 0).select("case_id", F.when(n % 7 == 0, "other").otherwise(F.col("person_id")).alias("person_id"), F.when(n % 11 == 0, 1 - F.col("pre_0_post_1")).otherwise(F.col("pre_0_post_1")).cast("byte").alias("pre_0_post_1"), F.when(n % 5 == 0, "skipped").when(n % 3 == 0, F.lit(None)).otherwise(" SUCCESS").alias("status"))
    return contracts.attach_audit(wide, features)


def candidate_order(spark, sf_dir):
    return ranking.candidate_order(_one_view(spark, sf_dir))


def first_cases(spark, sf_dir):
    ordered = stages.with_input_order(wide_cases(spark, sf_dir).select("case_id", "person_id"), "case_id")
    return stages.first_rows(ordered, 25).select("ordinal", "case_id", "person_id")


def selected_candidate(spark, sf_dir):
    """Lines of an order play the files of a case."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    name = F.concat(F.lit("line"), F.col("l_linenumber").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "_Eq_1").otherwise(""))
    rows = lines.select(F.col("l_orderkey").alias("case_id"), name.alias("name"), F.when(F.col("l_quantity") > 45, 4).otherwise(3).alias("ndim"), F.floor(F.col("l_quantity") / 20).cast("long").alias("voxel_count"), F.floor(F.col("l_extendedprice") / 40000).cast("double").alias("volume"))
    return stages.choose_candidate(rows)


def result_completeness(spark, sf_dir):
    """Results of which some are lost, moved, unknown or without their hashes."""
    cases = stages.with_input_order(wide_cases(spark, sf_dir).select("case_id", "n_events"), "case_id")
    n = F.col("n_events")
    status = F.when(n % 7 == 0, "ERROR").when(n % 19 == 0, "LOST").when(n % 3 == 0, "SKIPPED").otherwise("OK")
    sha = F.when((n % 7 == 0) & (n % 2 == 0), "").when(n % 10 == 0, "none").otherwise(F.sha2("case_id", 256))
    results = cases.where(n % 23 != 0).select("ordinal", F.when(n % 29 == 0, "moved").otherwise(F.col("case_id")).alias("case_id"), status.alias("status"), *[sha.alias(c) for c in contracts.HASHES])
    return stages.result_audit(results, cases)


def query_lookup(spark, sf_dir):
    wide = wide_cases(spark, sf_dir)
    asked = stages.with_input_order(wide.where("pre_0_post_1 = 1").select("case_id"), "case_id")
    return stages.lookup_in_order(asked, wide.withColumn("status", F.lit("OK"))).select("ordinal", "case_id", "person_id", "n_events")


def review_template(spark, sf_dir):
    return stages.masked_review_sheet(paired_cases(spark, sf_dir), ("alignment", "field_of_view"))


def analysis_roles(spark, sf_dir):
    """The role of each cohort policy, with the locked configurations and with one less."""
    locked = [(m, h) for m in scoring.MODES for h in H_VALUES]
    every = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(h).alias("h")) for m, h in locked])
    kinds = F.array(*[F.struct(F.lit(len(locked) - k).alias("n_configurations"), F.slice(every, 1, len(locked) - k).alias("c")) for k in (0, 1)])
    rows = cohort_summary(spark, sf_dir).select("cohort_policy", "n_query", F.explode(kinds).alias("x"))
    return rows.select("cohort_policy", "n_query", "x.n_configurations", stages.analysis_role(F.col("cohort_policy"), F.lit("area_normalized"), F.col("x.c"), locked).alias("role"))


def configured_ranks(spark, sf_dir):
    """Ranks under the chosen configurations, as a later stage loads them."""
    one = _fixed_of(spark, sf_dir, ("cor_sag",), 4)
    return stages.load_ranks(one.select(F.concat(F.lit(" "), "query_case").alias("query_case"), "query_person", F.col("mode").alias("selected_mode"), F.col("h").cast("string").alias("selected_harmonic"), "true_rank"), configured=True)


def mean_auc_interval(spark, sf_dir):
    return inference.percentile_interval(inference.poisson_means(per_query_auc(spark, sf_dir)).withColumn("k", F.lit(0)), by=("k",), value="mean")


def affine_axes(spark, sf_dir):
    """The first nine components of a vector play the axes of a voxel grid."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("size(embedding) >= 9")
    m = [[F.col("embedding")[3 * i + j].cast("double") for j in range(3)] for i in range(3)]
    sizes = [F.round(s, 6).alias(f"size_{k}") for s, k in zip(clouds.voxel_sizes(m), "ijk")]
    angle = clouds.obliquity(m)
    return v.select("vec_id", clouds.axis_codes(m).alias("codes"), F.round(angle, 6).alias("obliquity"), (angle <= 45).alias("within_45"), *sizes)


def foreground_boxes(spark, sf_dir):
    """Lines of a supplier play its foreground voxels."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    voxels = lines.select(F.col("l_suppkey").alias("case_id"), F.col("l_quantity").cast("int").alias("i"), (F.col("l_discount") * 100).cast("int").alias("j"), (F.col("l_partkey") % 97).cast("int").alias("k"))
    return clouds.foreground_box(voxels, (51, 11, 97))


def cloud_poses(spark, sf_dir):
    p = clouds.poses(supplier_points(spark, sf_dir))
    return p.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in p.dtypes])


def cloud_extents(spark, sf_dir):
    """How far each cloud reaches in each view, in its own pose."""
    points = supplier_points(spark, sf_dir)
    b = clouds.view_bounds(clouds.to_canonical(points, clouds.poses(points)))
    return b.select("case_id", "view", "n_points", F.round("umin", 6).alias("umin"), F.round("vmax", 6).alias("vmax"), "width", "height", "error")


def cloud_rasters(spark, sf_dir):
    """Filled pixels of each view, and their sums of places."""
    points = supplier_points(spark, sf_dir)
    own = clouds.to_canonical(points, clouds.poses(points))
    cells = clouds.view_cells(own, clouds.view_bounds(own))
    return cells.groupBy("case_id", "view").agg(F.count("*").alias("n_cells"), F.sum("col").alias("cols"), F.sum("row").alias("rows"))


def cloud_features(spark, sf_dir):
    """Outlines of the rasters, and their normalised coefficients."""
    f = geometry.extract(supplier_points(spark, sf_dir), orders=(5, 10))
    return f.withColumn("f", F.transform("f", lambda v: F.round(v, 6)))


def reoriented_grids(spark, sf_dir):
    """Grids of any orientation in left, back and up axes."""
    g = voxels.with_axes(vector_grids(spark, sf_dir))
    new = voxels.reoriented_grids(g).select("case_id", *[F.col(f"n{a}") for a in "ijk"], *[F.round(f"m{w}{j}", 6).alias(f"m{w}{j}") for w in range(3) for j in range(3)], *[F.round(f"t{w}", 6).alias(f"t{w}") for w in range(3)])
    return new.join(g.select("case_id", F.col("codes").alias("input_codes"), F.array_join(F.col("world").cast("array<string>"), "").alias("world")), "case_id")


def reoriented_voxels(spark, sf_dir):
    g = voxels.with_axes(vector_grids(spark, sf_dir))
    return voxels.reoriented_voxels(supplier_voxels(spark, sf_dir), g)


def resampled_voxels(spark, sf_dir):
    """The boxes around each case's foreground in cubes of one unit."""
    v = supplier_voxels(spark, sf_dir)
    grids = v.select("case_id").distinct().select("case_id", *[F.lit(n).alias(f"n{a}") for a, n in zip("ijk", (51, 11, 97))])
    return voxels.isotropic(v, voxels.boxes(v, grids), supplier_sizes(v))


def shape_measures(spark, sf_dir):
    v = supplier_voxels(spark, sf_dir, coarse=True)
    m = shapes.measures(v, supplier_sizes(v))
    return m.select("case_id", "n_voxels", *[F.round(c, 6).alias(c) for c in m.columns[2:]])


def shape_diameters(spark, sf_dir):
    v = supplier_voxels(spark, sf_dir, coarse=True)
    d = shapes.diameters(v, supplier_sizes(v))
    return d.select("case_id", *[F.round(c, 6).alias(c) for c in d.columns[1:]])


def curve_areas(spark, sf_dir):
    a = curves.areas(customer_curves(spark, sf_dir), ["curve"])
    return a.select("curve", "n_vertices", F.round("area", 6).alias("area"))


def _even(spark, sf_dir):
    return curves.even_points(curves.counter_clockwise(customer_curves(spark, sf_dir), ["curve"]), ["curve"], 64)


def curve_points(spark, sf_dir):
    return _even(spark, sf_dir).select("curve", "seq", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def curve_coefficients(spark, sf_dir):
    c = curves.fourier(_even(spark, sf_dir), ["curve"], 5)
    return c.select("curve", "i", *[(F.round(k, 6) + 0.0).alias(k) for k in "abcd"])


QUERIES = [
    case_contract_audit, feature_attach, lopo_scaler, lopo_pair_scores, lopo_true_rank, lopo_topk, view_scores, fused_scores, fixed_config_ranks, fixed_config_summary, rank1_matrix,
    hard_failure_flags, mahalanobis_flags, mahalanobis_fits, qc_counts, pair_completeness, cohort_audit, cohort_query, cohort_gallery, cohort_summary, paired_cases, first_scan,
    crossfit_selection_audit, crossfit_true_rank, tie_stage_summary, deviating_folds, rank_rates, cmc_curve, rank_distribution, mcnemar_table, bootstrap_intervals, poisson_intervals, seeded_intervals,
    per_query_auc, pooled_auc, spearman_rho, pca_scores, pose_summary, projection_summary, runtime_quartiles, metric_distribution, review_counts, review_overview, outlier_crosstab, rank1_crosstab, tail_diagnostics, key_differences,
    broken_case_audit, broken_attach_audit, broken_views_audit, candidate_order, first_cases, selected_candidate, result_completeness, query_lookup, review_template, analysis_roles, configured_ranks, mean_auc_interval,
    affine_axes, foreground_boxes, cloud_poses, cloud_extents, cloud_rasters, cloud_features, reoriented_grids, reoriented_voxels, resampled_voxels, shape_measures, shape_diameters, curve_areas, curve_points, curve_coefficients,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}
