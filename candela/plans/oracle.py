"""SQL of the registered queries, for DuckDB."""

from __future__ import annotations

from ..operators.shapes import cube_triangles
from .roles import CLOUD_SQL, COARSE_SQL, CURVE_SQL, LONG_SQL, SIZES_SQL, VOXEL_SQL, WIDE_SQL

SCALED = LONG_SQL + """, scaled as (
  select p.person_id, g.view, g.h, g.i, min(g.x) as lo, max(g.x) as hi from (select distinct person_id from q) p join g on g.person_id <> p.person_id group by all
)"""
VIEWS = SCALED + """, views as (
  select *, round(1.0::double / (1.0::double + distance), 9) as score from (
    select q.case_id as query_case, q.person_id as query_person, g.case_id as db_case, g.person_id as db_person, q.view, q.h, count(*)::int as n_features,
      round(sqrt(sum(((q.x - g.x) * case when hi > lo then 1.0::double / (hi - lo) else 1.0::double end) ** 2 order by q.i)), 9) as distance
    from q join scaled s on s.person_id = q.person_id and s.view = q.view and s.h = q.h and s.i = q.i join g on g.view = q.view and g.h = q.h and g.i = q.i
    group by all))"""
ONE = VIEWS + ", one as (select * from views where view = 'sag' and h = 4)"
MODES = """, modes(mode, mode_order, n_views, view) as (values ('cor',0,1,'cor'),('sag',1,1,'sag'),('axial',2,1,'axial'),('cor_sag',3,2,'cor'),('cor_sag',3,2,'sag'),('cor_axial',4,2,'cor'),('cor_axial',4,2,'axial'),
  ('sag_axial',5,2,'sag'),('sag_axial',5,2,'axial'),('cor_sag_axial',6,3,'cor'),('cor_sag_axial',6,3,'sag'),('cor_sag_axial',6,3,'axial'))"""
FUSED = VIEWS + MODES + """, fused as (
  select query_case, query_person, db_case, db_person, mode, mode_order, n_views, h, case when n_views = 1 then d1 else round(1.0::double / least(greatest(s, 1e-12::double), 1.0::double) - 1.0::double, 9) end as distance,
    case when n_views = 1 then 'distance' else 'equivalent_distance' end as distance_kind, s as score, n_features
  from (select query_case, query_person, db_case, db_person, mode, mode_order, n_views, h, round(avg(score), 12) as s, min(distance) as d1, sum(n_features)::bigint as n_features from views join modes using (view) group by all))"""


def _ranks(source: str, by: str) -> str:
    return f"""(select {by}, 1.0::double + sum((s.score > g)::int) + 0.5::double * (sum((s.score = g)::int) - 1) as true_rank, sum((s.score = g)::int) - 1 as n_ties, count(*) as n_gallery
      from {source} s join (select {by}, score as g from {source} where query_person = db_person) using ({by}) group by all)"""


BY_CONFIG = "query_case, query_person, mode, mode_order, n_views, h"
FIXED = FUSED + f", fixed as (select * from {_ranks('fused', BY_CONFIG)})"
RANKS = ONE + f", ranks as (select * from {_ranks('one', 'query_case, query_person')})"
SUMMARY = FIXED + """, summary as (select mode, mode_order, n_views, h, count(*) as n, sum((true_rank <= 1)::int) as rank1_count, sum((true_rank <= 5)::int) as rank5_count, sum((true_rank <= 10)::int) as rank10_count,
  median(true_rank) as median_rank, round(avg(true_rank), 9) as mean_rank, round(avg(ln(true_rank)), 9) as mean_log_rank from fixed group by all)"""
FLAGS = WIDE_SQL + """, flagged as (select *, concat_ws(';', case when n_events < 25 then 'efa_failure' end, case when sag_H4_avg is null or sag_H4_std is null or m is null then 'missing_shape_feature' end) as hard_qc_reason
  from (select *, case when sag_H4_max <= 300 then sag_H4_max end as m from wide))"""
#: Two features: the inverse of the covariance is closed, and so is the chi-square quantile.
QC = FLAGS + """, moments as (select dataset, count(*) as n, min(sag_H4_avg) as l1, max(sag_H4_avg) - min(sag_H4_avg) as r1, min(sag_H4_std) as l2, max(sag_H4_std) - min(sag_H4_std) as r2, avg(sag_H4_avg) as m1, avg(sag_H4_std) as m2,
    var_samp(sag_H4_avg) as v1, var_samp(sag_H4_std) as v2, covar_samp(sag_H4_avg, sag_H4_std) as c from flagged where hard_qc_reason = '' group by dataset
), qc as (select *, hard_qc_reason <> '' as hard, coalesce(d2 > -2 * ln(0.05), false) as outlier from (
  select f.*, case when hard_qc_reason = '' then (v2 * (sag_H4_avg - m1) ** 2 - 2 * c * (sag_H4_avg - m1) * (sag_H4_std - m2) + v1 * (sag_H4_std - m2) ** 2) / (v1 * v2 - c * c) end as d2 from flagged f left join moments using (dataset)))"""
COHORT = QC + """, policies(cohort_policy, tech, one) as (values ('primary', false, false), ('technical_only_sensitivity', true, false), ('one_per_person', false, true)
), eligible as (select cohort_policy, one, case_id, person_id, flag, dataset, case when tech then not hard else not (hard or outlier) end as ok from qc cross join policies
), paired as (select cohort_policy, person_id from eligible where ok and dataset = 'institutional' group by all having count(distinct flag) = 2
), audit as (select e.cohort_policy, case_id, e.person_id, case when ok and dataset = 'institutional' and p.person_id is not null then case when flag = 1 then 'query' else 'true_reference' end
    when ok and dataset <> 'institutional' and (not one or row_number() over (partition by e.cohort_policy, e.person_id, ok and dataset <> 'institutional' order by case_id) = 1) then 'distractor' else 'excluded' end as role
  from eligible e left join paired p on p.cohort_policy = e.cohort_policy and p.person_id = e.person_id)"""
FOLDS = LONG_SQL + MODES + f""", folds as (select distinct person_id as fold from q),
scaled as (select fold, g.view, g.h, g.i, min(g.x) as lo, max(g.x) as hi from folds join g on g.person_id <> fold group by all),
fviews as (select *, round(1.0::double / (1.0::double + distance), 9) as score from (
  select fold, q.case_id as query_case, q.person_id as query_person, g.case_id as db_case, g.person_id as db_person, q.view, q.h,
    round(sqrt(sum(((q.x - g.x) * case when hi > lo then 1.0::double / (hi - lo) else 1.0::double end) ** 2 order by q.i)), 9) as distance
  from folds join q on q.person_id <> fold join scaled s using (fold, view, h, i) join g on g.view = q.view and g.h = q.h and g.i = q.i and g.person_id <> fold group by all)),
ffused as (select fold, query_case, query_person, db_case, db_person, mode, mode_order, n_views, h, round(avg(score), 12) as score from fviews join modes using (view) group by all),
training as (select * from {_ranks('ffused', 'fold, ' + BY_CONFIG)}),
rates as (select fold, mode, mode_order, n_views, h, count(*) as training_n, sum((true_rank <= 1)::int)::double / count(*) as rank1_rate, sum((true_rank <= 5)::int)::double / count(*) as rank5_rate, sum((true_rank <= 10)::int)::double / count(*) as rank10_rate, round(avg(ln(true_rank)), 9) as mean_log_rank from training group by all),
audit as (select *, row_number() over (partition by fold order by rank1_rate desc, mean_log_rank, n_views, h, mode_order) = 1 as selected from rates)"""
CHOSEN = FUSED + ", " + FOLDS[len(LONG_SQL + MODES) + 1 :].replace("scaled as (", "fscaled as (", 1).replace("join scaled s using", "join fscaled s using", 1) + f""", fixed as (select * from {_ranks('fused', BY_CONFIG)}),
held as (select f.query_case, f.query_person, f.mode, f.h, f.true_rank, true_rank <= 1 as rank_1, true_rank <= 5 as rank_5, true_rank <= 10 as rank_10 from fixed f join audit a on a.selected and a.fold = f.query_person and a.mode = f.mode and a.h = f.h)"""
#: Which configurations each criterion leaves.
TIES = """t0 as (select *, rank1_rate >= max(rank1_rate) over (partition by fold) - 1e-12 as i0 from audit), t1 as (select *, i0 and mean_log_rank <= min(mean_log_rank) filter (i0) over (partition by fold) + 1e-12 as i1 from t0),
  t2 as (select *, i1 and n_views = min(n_views) filter (i1) over (partition by fold) as i2 from t1), t3 as (select *, i2 and h = min(h) filter (i2) over (partition by fold) as i3 from t2), t4 as (select *, i3 and mode_order = min(mode_order) filter (i3) over (partition by fold) as i4 from t3)"""
BROKEN = """broken as (select case when n_events % 11 = 0 then ' ' when n_events % 13 = 0 then 'again' else case_id end as case_id, case when n_events % 7 = 0 then null else person_id end as person_id, case when n_events % 5 = 0 then 2 else flag end as f from wide)"""
PEOPLE = "select count(*)::bigint"
HITS = "unnest(range(1, 11)) as k"

#: Poses by the closed form of a symmetric 3 x 3 matrix's largest root, and the cross products of what remains.
POSES = CLOUD_SQL + """, mo as (select case_id, count(*) as n, avg(x) as mx, avg(y) as my, avg(z) as mz, var_pop(x) as xx, var_pop(y) as yy, var_pop(z) as zz, covar_pop(x, y) as xy, covar_pop(x, z) as xz, covar_pop(y, z) as yz from points group by case_id),
  m1 as (select *, (xx + yy + zz) / 3 as q from mo), m2 as (select *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) as p from m1),
  m3 as (select *, acos(greatest(-1, least(1, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3)))) / 3 as t from m2),
  m4 as (select *, q + 2 * p * cos(t) as e1, q + 2 * p * cos(t + 2 * pi() / 3) as e3 from m3),
  m5 as (select *, 3 * q - e1 - e3 as e2, xy * yz - xz * (yy - e1) as c2x, xz * xy - (xx - e1) * yz as c2y, (xx - e1) * (yy - e1) - xy * xy as c2z from m4),
  m6 as (select *, sqrt(c2x ** 2 + c2y ** 2 + c2z ** 2) as s from m5), m7 as (select *, c2x / s as r20, c2y / s as r21, c2z / s as r22 from m6),
  m8 as (select *, sqrt((1 - r20 * r20) ** 2 + (r20 * r21) ** 2 + (r20 * r22) ** 2) as w from m7), m9 as (select *, (1 - r20 * r20) / w as r00, -r20 * r21 / w as r01, -r20 * r22 / w as r02 from m8),
  poses as (select *, r21 * r02 - r22 * r01 as r10, r22 * r00 - r20 * r02 as r11, r20 * r01 - r21 * r00 as r12 from m9),
  own as (select case_id, r00 * (x - mx) + r01 * (y - my) + r02 * (z - mz) as x, r10 * (x - mx) + r11 * (y - my) + r12 * (z - mz) as y, r20 * (x - mx) + r21 * (y - my) + r22 * (z - mz) as z from points join poses using (case_id) where n >= 50),
  flat as (select case_id, 'cor' as view, x as u, z as v from own union all select case_id, 'sag', y, z from own union all select case_id, 'axial', x, -y from own),
  bounds as (select *, ceil(umax - umin)::bigint + 1 as width, ceil(vmax - vmin)::bigint + 1 as height from (select case_id, view, count(*) as n_points, min(u) - 4 as umin, max(u) + 4 as umax, min(v) - 4 as vmin, max(v) + 4 as vmax from flat group by all))"""
FOLLOWING = CURVE_SQL + """, f0 as (select *, coalesce(lead(x) over w, first(x) over w) as x1, coalesce(lead(y) over w, first(y) over w) as y1, count(*) over (partition by curve) as n from curves window w as (partition by curve order by seq)),
  ccw as (select curve, case when sum(x * y1 - x1 * y) over (partition by curve) < 0 then n - 1 - seq else seq end as seq, x, y, n from f0),
  f1 as (select *, coalesce(lead(x) over w, first(x) over w) as x1, coalesce(lead(y) over w, first(y) over w) as y1 from ccw window w as (partition by curve order by seq)),
  f2 as (select *, sqrt((x1 - x) ** 2 + (y1 - y) ** 2) as d from f1), f3 as (select *, sum(d) over (partition by curve order by seq) as till, sum(d) over (partition by curve) as total from f2 where d > 0),
  at_ as (select curve, total, k, k * total / 64 as pos from (select distinct curve, total from f3), range(64) t(k)),
  even as (select a.curve, a.k as seq, f.x + least(1, greatest(0, (a.pos - (f.till - f.d)) / f.d)) * (f.x1 - f.x) as x, f.y + least(1, greatest(0, (a.pos - (f.till - f.d)) / f.d)) * (f.y1 - f.y) as y from at_ a asof join f3 f on a.curve = f.curve and a.pos <= f.till)"""

AXES = """g as (select vec_id as case_id, embedding[1:12]::double[] as e from embeddings where vec_id is not null and len(embedding) >= 12),
  z as (select *, sqrt(e[1] ** 2 + e[4] ** 2 + e[7] ** 2) as s0, sqrt(e[2] ** 2 + e[5] ** 2 + e[8] ** 2) as s1, sqrt(e[3] ** 2 + e[6] ** 2 + e[9] ** 2) as s2 from g),
  ways as (select *, row_number() over (partition by case_id order by abs(e[1 + 3 * w0]) / s0 + abs(e[2 + 3 * w1]) / s1 + abs(e[3 + 3 * w2]) / s2 desc, n) as r from z, (values (0, 0, 1, 2), (1, 0, 2, 1), (2, 1, 0, 2), (3, 1, 2, 0), (4, 2, 0, 1), (5, 2, 1, 0)) p(n, w0, w1, w2)),
  best as (select *, [e[1 + 3 * w0] > 0, e[2 + 3 * w1] > 0, e[3 + 3 * w2] > 0] as up from ways where r = 1),
  named as (select *, (case when up[1] then 'RAS' else 'LPI' end)[1 + w0] || (case when up[2] then 'RAS' else 'LPI' end)[1 + w1] || (case when up[3] then 'RAS' else 'LPI' end)[1 + w2] as input_codes,
    list_position([w0, w1, w2], 0) - 1 as f0, list_position([w0, w1, w2], 1) - 1 as f1, list_position([w0, w1, w2], 2) - 1 as f2 from best),
  axes as (select *, up[1 + f0] as turn0, up[1 + f1] as turn1, not up[1 + f2] as turn2 from named)"""

SQL = {
    "case_contract_audit": f"with {WIDE_SQL} select count(*) as n_rows, sum((coalesce(trim(case_id), '') = '')::int)::bigint as blank_case_id, sum((coalesce(trim(person_id), '') = '')::int)::bigint as blank_person_id, count(case_id) - count(distinct case_id) as repeated_case_id, sum((flag not in (0, 1))::int)::bigint as bad_flag from wide",
    "feature_attach": f"with {WIDE_SQL} select case_id, person_id, dataset, n_events, sag_H4_avg, cor_H4_click from wide where dataset = 'institutional'",
    "lopo_scaler": f"with {SCALED} select person_id, view, h, i, lo, hi from scaled",
    "lopo_pair_scores": f"with {ONE} select query_case, query_person, db_case, db_person, (query_person = db_person)::int as label, score, distance from one",
    "lopo_true_rank": f"with {RANKS} select r.query_case, r.query_person, r.true_rank, r.n_ties::bigint as n_ties, o.db_case as matched_case, o.score as matched_score, true as has_match_in_database, r.n_gallery from ranks r join one o on o.query_case = r.query_case and o.db_person = r.query_person",
    "lopo_topk": f"""with {ONE} select query_case, query_person, display_order, db_case, db_person, score, midrank, n_ties, query_person = db_person as correct from (
      select *, row_number() over (partition by query_case order by score desc, db_case) as display_order, rank() over (partition by query_case order by score desc) + 0.5::double * (count(*) over (partition by query_case, score) - 1) as midrank, count(*) over (partition by query_case, score) - 1 as n_ties from one) where display_order <= 10""",
    "view_scores": f"with {VIEWS} select query_case, query_person, db_case, db_person, view, h, distance, score, n_features from views",
    "fused_scores": f"with {FUSED} select * from fused",
    "fixed_config_ranks": f"with {FIXED} select query_case, mode, h, true_rank, n_ties::bigint as n_ties, n_gallery from fixed",
    "fixed_config_summary": f"with {SUMMARY} select mode, mode_order, n_views, h, n, rank1_count::bigint as rank1_count, rank5_count::bigint as rank5_count, rank10_count::bigint as rank10_count, median_rank, mean_rank, mean_log_rank from summary",
    "rank1_matrix": f"""with {SUMMARY}, cells as (select mode, mode_order, h, rank1_count || '/' || n || ' (' || round_even(100.0::double * rank1_count / n, 1)::decimal(5, 1) || '%)' as cell from summary)
      select mode_order, mode, max(cell) filter (h = 2) as h2, max(cell) filter (h = 4) as h4 from cells group by all""",
    "hard_failure_flags": f"with {FLAGS} select case_id, hard_qc_reason <> '' as hard_qc_failure, hard_qc_reason from flagged",
    "mahalanobis_fits": f"with {QC}, spread as (select dataset, n, v1 / r1 ** 2 + v2 / r2 ** 2 as trace, sqrt((v1 / r1 ** 2 - v2 / r2 ** 2) ** 2 + 4 * (c / (r1 * r2)) ** 2) as gap from moments) select dataset, n as n_fit, 2::int as n_features, 2::int as covariance_rank, round((trace + gap) / (trace - gap), 6) as condition_number, round(-2 * ln(0.05), 9) as threshold from spread",
    "mahalanobis_flags": f"with {QC} select case_id, dataset, round(d2, 6) as d2, outlier as mahalanobis_outlier, not hard as include_technical_only, not (hard or outlier) as include_mahalanobis from qc",
    "qc_counts": f"with {QC} select dataset, count(*) as n_input, sum(hard::int)::bigint as n_hard_failure, sum((not hard)::int)::bigint as n_fit, sum(outlier::int)::bigint as n_outlier from qc group by dataset",
    "pair_completeness": f"with {WIDE_SQL} select person_id, sum((flag = 0)::int)::bigint as n_pre, sum((flag = 1)::int)::bigint as n_post from wide group by person_id",
    "cohort_audit": f"with {COHORT} select cohort_policy, case_id, person_id, role from audit",
    "cohort_query": f"with {COHORT} select cohort_policy, case_id, person_id from audit where role = 'query'",
    "cohort_gallery": f"with {COHORT} select cohort_policy, case_id, person_id, role from audit where role in ('true_reference', 'distractor')",
    "cohort_summary": f"""with {COHORT} select cohort_policy, count(*) as n_input, sum((role = 'query')::int)::bigint as n_query, sum((role = 'true_reference')::int)::bigint as n_true_reference, sum((role = 'distractor')::int)::bigint as n_distractor,
      sum((role = 'excluded')::int)::bigint as n_excluded, sum((role in ('true_reference', 'distractor'))::int)::bigint as n_gallery, count(distinct case when role <> 'excluded' then person_id end) as n_people from audit group by cohort_policy""",
    "paired_cases": f"with {WIDE_SQL} select person_id, max(case_id) filter (flag = 0) as pre_case_id, max(case_id) filter (flag = 1) as post_case_id from wide group by person_id having count(*) = 2",
    "first_scan": f"with {WIDE_SQL} select person_id, min(case_id) as case_id from wide group by person_id",
    "crossfit_selection_audit": f"with {FOLDS} select fold, mode, mode_order, n_views, h, training_n, rank1_rate, rank5_rate, rank10_rate, mean_log_rank, selected from audit",
    "crossfit_true_rank": f"with {CHOSEN} select query_case, mode, h, true_rank, rank_1, rank_5, rank_10 from held",
    "rank_rates": f"with {RANKS} select k, count(*) as n, sum((true_rank <= k)::int)::bigint as n_correct, sum((true_rank <= k)::int)::double / count(*) as rate from ranks cross join (values (1), (5), (10)) t(k) group by k",
    "cmc_curve": f"with {RANKS} select k::int as k, count(*) as n, sum((true_rank <= k)::int)::bigint as n_correct, sum((true_rank <= k)::int)::double / count(*) as rate from ranks cross join range(1, 11) t(k) group by k",
    "rank_distribution": f"with {RANKS} select count(true_rank) as n_ranked, round(avg(true_rank), 6) as mean_rank, median(true_rank) as median_rank, round(avg((n_gallery - true_rank) / (n_gallery - 1)), 6) as mean_normalised_rank from ranks",
    "per_query_auc": f"""with {ONE}, r as (select *, rank() over (partition by query_person order by score) + 0.5::double * (count(*) over (partition by query_person, score) - 1) as m, query_person = db_person as genuine from one)
      select query_person, sum(genuine::int)::bigint as n_genuine, sum((not genuine)::int)::bigint as n_impostor, round((sum(m) filter (genuine) - sum(genuine::int) * (sum(genuine::int) + 1) / 2.0::double) / (sum(genuine::int) * sum((not genuine)::int)), 9) as auc from r group by query_person""",
    "pooled_auc": f"""with {ONE}, r as (select *, rank() over (order by score) + 0.5::double * (count(*) over (partition by score) - 1) as m, query_person = db_person as genuine from one)
      select sum(genuine::int)::bigint as n_genuine, sum((not genuine)::int)::bigint as n_impostor, round((sum(m) filter (genuine) - sum(genuine::int) * (sum(genuine::int) + 1) / 2.0::double) / (sum(genuine::int) * sum((not genuine)::int)), 9) as auc from r""",
    "spearman_rho": f"""with {WIDE_SQL}, r as (select rank() over (order by n_events) + 0.5::double * (count(*) over (partition by n_events) - 1) as a, rank() over (order by sag_H4_avg) + 0.5::double * (count(*) over (partition by sag_H4_avg) - 1) as b from wide)
      select count(*) as n, round(corr(a, b), 9) as rho from r""",
    "pose_summary": f"""with {WIDE_SQL}, s as (select sag_H4_avg as x, 'overall' as "group" from wide union all select sag_H4_avg, dataset from wide)
      select "group", count(x) as n, round(median(x), 9) as median, max(x) as max, min(x) as min, sum((x > 50)::int)::bigint as n_above from s group by "group" """,
    "projection_summary": f"""with {WIDE_SQL}, s as (select 'cor' as view, n_events as c, cor_H4_click as d from wide union all select 'axial', n_events, axial_H2_b00 from wide)
      select view, count(c) as n, sum((c > 1)::int)::bigint as n_multiple, sum((d > 0.2)::int)::bigint as n_above, max(d) as max_discarded from s group by view""",
    "runtime_quartiles": f"with {WIDE_SQL} select dataset, count(sag_H4_avg) as n, round(quantile_cont(sag_H4_avg, 0.25), 9) as q1, round(quantile_cont(sag_H4_avg, 0.5), 9) as median, round(quantile_cont(sag_H4_avg, 0.75), 9) as q3, 's' as unit from wide group by dataset",
    "metric_distribution": f"""with {WIDE_SQL}, s as (select dataset, 'sag_H4_avg' as metric, sag_H4_avg as x from wide union all select dataset, 'n_events', n_events::double from wide)
      select dataset, metric, count(x) as n, round(median(x), 9) as median, round(quantile_cont(x, 0.25), 9) as q1, round(quantile_cont(x, 0.75), 9) as q3, round(min(x), 9) as min, round(max(x), 9) as max from s group by all""",
    "review_overview": "select count(*) as n_reviewed, count(distinct o_custkey) as n_reviewers, count(*) filter (o_orderstatus = 'P' or o_orderpriority = '1-URGENT') as n_any_urgent_or_pending, count(*) filter (o_orderstatus = 'O') as n_any_open from orders",
    "review_counts": "select field, value, count(*) as n, round(100.0::double * count(*) / (select count(*) from orders), 9) as percent from (select 'o_orderstatus' as field, o_orderstatus as value from orders union all select 'o_orderpriority', o_orderpriority from orders) group by all",
    "outlier_crosstab": f"""with {QC}, people as (select person_id, bool_or(outlier) as o, bool_or(cor_H4_click > 0.2) as many_clicks, bool_or(n_events < 30) as few_events from qc group by person_id),
      long as (select o, 'many_clicks' as finding, many_clicks as x from people union all select o, 'few_events', few_events from people), fixed(g, o, finding) as (values ('outlier', true, 'many_clicks'), ('outlier', true, 'few_events'), ('other', false, 'many_clicks'), ('other', false, 'few_events'))
      select g as "group", f.finding, count(l.o) as n_group, coalesce(sum(x::int), 0)::bigint as n, round(100.0::double * coalesce(sum(x::int), 0) / nullif(count(l.o), 0), 9) as percent from fixed f left join long l on l.o = f.o and l.finding = f.finding group by all""",
    "rank1_crosstab": f"""with {RANKS}, people as (select true_rank <= 1 as o, cor_H4_click > 0.2 as many_clicks, n_events < 30 as few_events from ranks join wide on wide.case_id = query_case),
      long as (select o, 'many_clicks' as finding, many_clicks as x from people union all select o, 'few_events', few_events from people), fixed(g, o, finding) as (values ('rank-1', true, 'many_clicks'), ('rank-1', true, 'few_events'), ('not rank-1', false, 'many_clicks'), ('not rank-1', false, 'few_events'))
      select g as "group", f.finding, count(l.o) as n_group, coalesce(sum(x::int), 0)::bigint as n, round(100.0::double * coalesce(sum(x::int), 0) / nullif(count(l.o), 0), 9) as percent from fixed f left join long l on l.o = f.o and l.finding = f.finding group by all""",
    "tail_diagnostics": f"with {RANKS} select query_case, floor(true_rank)::bigint as rank_floor, n_events >= 30 and sag_H4_avg > 20 as all_flags from ranks join wide on wide.case_id = query_case where true_rank > 10",
    "key_differences": "select c_custkey, 'left' as only_in from (select c_custkey from customer except select o_custkey from orders where o_totalprice > 200000) union all select o_custkey, 'right' from (select o_custkey from orders where o_totalprice > 200000 except select c_custkey from customer)",
    "tie_stage_summary": f"""with {FOLDS}, {TIES} select fold, case when sum(i0::int) = 1 then 'rank1_rate' when sum(i1::int) = 1 then 'mean_log_rank' when sum(i2::int) = 1 then 'n_views' when sum(i3::int) = 1 then 'h' else 'mode_order' end as stage,
      max(mode) filter (i4) as resolved_mode, max(h) filter (i4) as resolved_h, bool_or(selected) filter (i4) as agrees from t4 group by fold""",
    "deviating_folds": f"""with {CHOSEN}, chosen as (select fold as query_person, mode, h, mode_order from audit where selected), common as (select mode as common_mode, h as common_h from chosen group by mode, h, mode_order order by count(*) desc, mode_order, h limit 1)
      select c.query_person, c.mode, c.h, common_mode, common_h, d.true_rank as selected_rank, f.true_rank as common_rank from chosen c cross join common left join held d using (query_person) left join fixed f on f.query_person = c.query_person and f.mode = common_mode and f.h = common_h
      where c.mode <> common_mode or c.h <> common_h""",
    "mcnemar_table": f"""with {FIXED}, both_ as (select k::int as k, coalesce(a.true_rank <= k, false) as a, coalesce(b.true_rank <= k, false) as b from fixed a join fixed b using (query_person, h) cross join (values (1), (5), (10)) t(k) where h = 4 and a.mode = 'sag' and b.mode = 'cor_sag_axial'),
      cells as (select k, sum((a and b)::int)::bigint as n_both, sum((a and not b)::int)::bigint as n01, sum((not a and b)::int)::bigint as n10, sum((not a and not b)::int)::bigint as n_neither from both_ group by k),
      tails as (select *, case when n01 + n10 = 0 then 1.0 else least(1.0, 2 * (select sum(exp(lgamma(n01 + n10 + 1) - lgamma(i + 1) - lgamma(n01 + n10 - i + 1) - (n01 + n10) * ln(2.0))) from range(0, 1 + least(n01, n10)::bigint) r(i))) end as p from cells),
      raw as (select *, least(1.0, p * (4 - row_number() over (order by p, k))) as q from tails)
      select k, n_both, n01, n10, n_neither, round(p, 9) as p, round(max(q) over (order by p, k rows unbounded preceding), 9) as p_holm from raw""",
    "broken_case_audit": f"with {WIDE_SQL}, {BROKEN} select count(*) as n_rows, sum((coalesce(trim(case_id), '') = '')::int)::bigint as blank_case_id, sum((coalesce(trim(person_id), '') = '')::int)::bigint as blank_person_id, count(case_id) - count(distinct trim(case_id)) as repeated_case_id, sum((f not in (0, 1))::int)::bigint as bad_flag from broken",
    "broken_attach_audit": f"""with {WIDE_SQL} select count(*) as n_rows, sum((n_events % 17 = 0)::int)::bigint as missing, sum((n_events % 17 <> 0 and (n_events % 5 = 0 or n_events % 3 = 0))::int)::bigint as failed,
      sum((n_events % 17 <> 0 and n_events % 7 = 0)::int)::bigint as other_person, sum((n_events % 17 <> 0 and n_events % 11 = 0)::int)::bigint as other_flag, 0::bigint as repeated from wide""",
    "broken_views_audit": f"""with {LONG_SQL}, f as (select distinct case_id, view, h from (select * from q union all select * from g)),
      b as (select * from f where not (view = 'sag' and length(case_id) % 7 = 0) union all select * from f where view = 'axial' and contains(case_id, '1')),
      c as (select case_id, h, {", ".join(f"sum((view = '{v}')::int) as {v}" for v in ("cor", "sag", "axial"))} from b group by all)
      select count(*) as n, {", ".join(f"sum(({v} = 0)::int)::bigint as n_without_{v}" for v in ("cor", "sag", "axial"))}, {", ".join(f"sum(({v} > 1)::int)::bigint as n_repeated_{v}" for v in ("cor", "sag", "axial"))} from c""",
    "candidate_order": f"with {ONE} select query_case, (row_number() over (partition by query_case order by score desc, db_case))::int as display_order, db_case, score from one",
    "first_cases": f"with {WIDE_SQL} select * from (select row_number() over (order by case_id) - 1 as ordinal, case_id, person_id from wide) where ordinal < 25",
    "selected_candidate": """with c as (select l_orderkey as case_id, 'line' || l_linenumber || case when l_linenumber % 3 = 0 then '_Eq_1' else '' end as name, l_quantity <= 45 as solid, floor(l_quantity / 20)::bigint as v, floor(l_extendedprice / 40000)::double as m from lineitem),
      b as (select *, count(*) over (partition by case_id) as n, max(v) filter (solid) over (partition by case_id) as bv from c),
      d as (select *, max(m) filter (solid and v = bv) over (partition by case_id) as bm from b),
      t as (select *, coalesce(solid and v = bv and abs(m - bm) <= 1e-3 + 1e-6 * abs(bm), false) as tied from d),
      g as (select case_id, max(n) as n, min(name) as only_, sum(solid::int) as n_solid, sum(tied::int) as n_tied, min(name) filter (tied) as tied, coalesce(sum(1) filter (tied and contains(lower(name), '_eq')), 0) as n_even, min(name) filter (tied and contains(lower(name), '_eq')) as even from t group by case_id)
      select case_id, case when n = 1 then only_ when n_tied = 1 then tied when n_even = 1 then even end as name, n as n_candidates, case when n = 1 then 'single_output' else 'largest_3d' end as policy,
        case when n = 1 or n_tied = 1 or n_even = 1 then '' when n_solid = 0 then 'not_3d' else 'ambiguous' end as error from g""",
    "result_completeness": f"""with {WIDE_SQL}, r as (select n_events as n, n_events % 23 <> 0 as given, case when n_events % 7 = 0 then 'ERROR' when n_events % 19 = 0 then 'LOST' when n_events % 3 = 0 then 'SKIPPED' else 'OK' end as status,
        case when n_events % 14 = 0 then '' when n_events % 10 = 0 then 'none' else sha256(case_id) end as sha from wide)
      select sum((not given)::int)::bigint as missing, 0::bigint as extra, sum((given and n % 29 = 0)::int)::bigint as misplaced, sum((given and status = 'LOST')::int)::bigint as unknown_status,
        sum((given and status in ('OK', 'SKIPPED') and length(sha) <> 64)::int)::bigint as done_without_hash, sum((given and status = 'ERROR' and sha <> '')::int)::bigint as failed_with_hash from r""",
    "query_lookup": f"with {WIDE_SQL} select row_number() over (order by case_id) - 1 as ordinal, case_id, person_id, n_events from wide where flag = 1",
    "review_template": f"with {WIDE_SQL} select person_id, max(case_id) filter (flag = 0) as pre_case_id, max(case_id) filter (flag = 1) as post_case_id, '' as reviewer_id, '' as review_date, '' as alignment, '' as field_of_view from wide group by person_id having count(*) = 2",
    "analysis_roles": f"with {COHORT} select cohort_policy, sum((role = 'query')::int)::bigint as n_query, n::int as n_configurations, case when cohort_policy = 'primary' and n = 14 then 'primary' else 'sensitivity' end as role from audit cross join (values (14), (13)) t(n) group by cohort_policy, n",
    "configured_ranks": f"with {FIXED} select query_case, query_person, mode as selected_mode, h as selected_harmonic, true_rank from fixed where mode = 'cor_sag' and h = 4",
    "affine_axes": """with m as (select vec_id, embedding[1:9]::double[] as m from embeddings where len(embedding) >= 9),
      a as (select vec_id, j, m[1 + j] as x, m[4 + j] as y, m[7 + j] as z, sqrt(m[1 + j] ** 2 + m[4 + j] ** 2 + m[7 + j] ** 2) as s from m, range(3) t(j)),
      b as (select *, case when abs(x) >= abs(y) and abs(x) >= abs(z) then (case when x > 0 then 'R' else 'L' end) when abs(y) >= abs(z) then (case when y > 0 then 'A' else 'P' end) else (case when z > 0 then 'S' else 'I' end) end as code,
        degrees(acos(least(1, greatest(abs(x), abs(y), abs(z)) / s))) as angle from a)
      select vec_id, string_agg(code, '' order by j) as codes, round(max(angle), 6) as obliquity, max(angle) <= 45 as within_45, round(max(s) filter (j = 0), 6) as size_i, round(max(s) filter (j = 1), 6) as size_j, round(max(s) filter (j = 2), 6) as size_k from b group by vec_id""",
    "foreground_boxes": """select l_suppkey as case_id, count(*) as n_voxels, greatest(min(i) - 1, 0)::bigint as i_lo, least(max(i) + 2, 51)::bigint as i_hi, greatest(min(j) - 1, 0)::bigint as j_lo, least(max(j) + 2, 11)::bigint as j_hi, greatest(min(k) - 1, 0)::bigint as k_lo, least(max(k) + 2, 97)::bigint as k_hi
      from (select l_suppkey, trunc(l_quantity)::int as i, trunc(l_discount * 100)::int as j, (l_partkey % 97)::int as k from lineitem) group by l_suppkey""",
    "cloud_poses": f"""with {POSES} select case_id, n, round(mx, 6) as mx, round(my, 6) as my, round(mz, 6) as mz, round(r00, 6) as r00, round(r01, 6) as r01, round(r02, 6) as r02, round(r10, 6) as r10, round(r11, 6) as r11, round(r12, 6) as r12, round(r20, 6) as r20, round(r21, 6) as r21, round(r22, 6) as r22, round(r00, 6) as dot_left, round(r11, 6) as dot_back, round(r22, 6) as dot_up, r00 > 0 as x_ok, r11 > 0 as y_ok, r22 > 0 as z_ok,
      round(r20, 6) as long_axis_x, round(r21, 6) as long_axis_y, round(r22, 6) as long_axis_z, round(degrees(acos(least(1, r22))), 6) as obliquity_deg, round(sqrt(e1 / e2), 6) as singular_ratio, round(e1 / e2, 6) as eigenvalue_ratio, round(e1 / (3 * q), 6) as explained_variance,
      case when n < 50 then 'failed' else 'success' end as status, case when n < 50 then 'too_few_points_for_pose' else '' end as error from poses""",
    "cloud_extents": f"with {POSES} select case_id, view, n_points, round(umin, 6) as umin, round(vmax, 6) as vmax, width, height, case when least(width, height) < 12 then 'raster_too_small' else '' end as error from bounds",
    "cloud_rasters": f"""with {POSES} select case_id, view, count(*) as n_cells, sum(c)::bigint as cols, sum(r)::bigint as rows from (select distinct case_id, view, greatest(0, least(round_even(u - umin, 0)::int, width - 1)) as c, greatest(0, least(round_even(vmax - v, 0)::int, height - 1)) as r
      from flat join bounds using (case_id, view) where least(width, height) >= 12) group by all""",
    "reoriented_grids": f"""with {AXES} select case_id, [51, 11, 97][1 + f0]::int as ni, [51, 11, 97][1 + f1]::int as nj, [51, 11, 97][1 + f2]::int as nk,
      {", ".join(f"round(case when turn{a} then -1 else 1 end * e[1 + 3 * {w} + f{a}], 6) as m{w}{a}" for w in range(3) for a in range(3))},
      {", ".join(f"round(e[10 + {w}] + " + " + ".join(f"case when turn{a} then e[1 + 3 * {w} + f{a}] * ([51, 11, 97][1 + f{a}] - 1) else 0 end" for a in range(3)) + f", 6) as t{w}" for w in range(3))},
      input_codes, w0 || '' || w1 || '' || w2 as world from axes""",
    "reoriented_voxels": f"""with {AXES}, {VOXEL_SQL} select case_id, {", ".join(f"case when turn{a} then [51, 11, 97][1 + f{a}] - 1 - [i, j, k][1 + f{a}] else [i, j, k][1 + f{a}] end::int as {x}" for a, x in enumerate("ijk"))} from voxels join axes using (case_id)""",
    "resampled_voxels": f"""with {VOXEL_SQL}, {SIZES_SQL}, b as (select case_id, {", ".join(f"greatest(min({x}) - 1, 0) as lo_{x}, least(max({x}) + 2, {n}) - greatest(min({x}) - 1, 0) as n_{x}" for x, n in zip("ijk", (51, 11, 97)))} from voxels group by case_id),
      o as (select *, {", ".join(f"round_even(n_{x} * s{x} / 1.0::double, 0)::int as out_{x}" for x in "ijk")} from b join sizes using (case_id)),
      s as (select *, {", ".join(f"case when out_{x} > 1 then (n_{x} - 1)::double / (out_{x} - 1) else 1.0::double end as step_{x}" for x in "ijk")} from o),
      t as (select case_id, {", ".join(f"list_filter(range(0, out_{x}), lambda t: floor(t * step_{x} + 0.5::double) = {x} - lo_{x}) as to_{x}" for x in "ijk")} from voxels join s using (case_id)),
      ti as (select case_id, unnest(to_i)::int as i, to_j, to_k from t), tj as (select case_id, i, unnest(to_j)::int as j, to_k from ti) select case_id, i, j, unnest(to_k)::int as k from tj""",
    "shape_measures": f"""with {COARSE_SQL}, {SIZES_SQL}, tri(code, x, y, z, height) as (values {", ".join(str((c, *(repr(v) for v in xs))).replace("'", "") for c, *xs in cube_triangles())}),
      cubes as (select case_id, i - a as i, j - b as j, k - c as k, bit_or((1 << (a + 2 * b + 4 * c))::int) as code from voxels, range(2) p(a), range(2) q(b), range(2) r(c) group by all),
      kinds as (select case_id, code, count(*) as n, sum(k) as k_sum from cubes where code < 255 group by all),
      mesh as (select case_id, sum(z / 2 * si * sj * (n * height + k_sum) * sk) as mv, sum(n * sqrt((x * sj * sk) ** 2 + (y * si * sk) ** 2 + (z * si * sj) ** 2) / 2) as sa from kinds join tri using (code) join sizes using (case_id) group by case_id),
      m as (select case_id, count(*) as n_voxels, count(*) * any_value(si * sj * sk) as vv, covar_pop(i * si, i * si) as xx, covar_pop(j * sj, j * sj) as yy, covar_pop(k * sk, k * sk) as zz, covar_pop(i * si, j * sj) as xy, covar_pop(i * si, k * sk) as xz, covar_pop(j * sj, k * sk) as yz from voxels join sizes using (case_id) group by case_id),
      q as (select *, (xx + yy + zz) / 3 as q from m), p as (select *, sqrt(((xx - q) ** 2 + (yy - q) ** 2 + (zz - q) ** 2 + 2 * (xy ** 2 + xz ** 2 + yz ** 2)) / 6) as p from q),
      d as (select *, ((xx - q) * ((yy - q) * (zz - q) - yz ** 2) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p ** 3) as det from p),
      t as (select *, case when p > 0 then acos(greatest(-1, least(1, det))) / 3 else 0 end as t from d),
      e as (select *, q + 2 * p * cos(t) as e1, greatest(q + 2 * p * cos(t + 2 * pi() / 3), 0) as e3 from t), f as (select *, greatest(3 * q - e1 - (q + 2 * p * cos(t + 2 * pi() / 3)), 0) as e2 from e)
      select case_id, n_voxels, round(case when e1 > 0 then sqrt(e2 / e1) end, 6) as "Elongation", round(case when e1 > 0 then sqrt(e3 / e1) end, 6) as "Flatness", round(4 * sqrt(e3), 6) as "LeastAxisLength", round(4 * sqrt(e1), 6) as "MajorAxisLength", round(mv, 6) as "MeshVolume",
        round(4 * sqrt(e2), 6) as "MinorAxisLength", round((36 * pi() * mv ** 2) ** (1.0::double / 3) / sa, 6) as "Sphericity", round(sa, 6) as "SurfaceArea", round(sa / mv, 6) as "SurfaceVolumeRatio", round(vv, 6) as "VoxelVolume" from f join mesh using (case_id)""",
    "shape_diameters": f"""with {COARSE_SQL}, {SIZES_SQL}, sides as (select case_id, 2 * i + di as i, 2 * j + dj as j, 2 * k + dk as k from voxels, (values (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)) d(di, dj, dk)),
      v as (select case_id, i, j, k, i * si / 2 as x, j * sj / 2 as y, k * sk / 2 as z from (select case_id, i, j, k from sides group by all having count(*) = 1) join sizes using (case_id)),
      d as (select a.case_id, a.i = b.i as ei, a.j = b.j as ej, a.k = b.k as ek, (a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2 as d from v a join v b on a.case_id = b.case_id)
      select case_id, round(sqrt(max(d)), 6) as in_space, round(sqrt(max(d) filter (ei)), 6) as across_i, round(sqrt(max(d) filter (ej)), 6) as across_j, round(sqrt(max(d) filter (ek)), 6) as across_k from d group by case_id""",
    "curve_areas": f"with {FOLLOWING} select curve, count(*) as n_vertices, round(sum(x * y1 - x1 * y) / 2, 6) as area from f0 group by curve",
    "curve_points": f"with {FOLLOWING} select curve, seq, round(x, 6) as x, round(y, 6) as y from even",
    "curve_coefficients": f"""with {FOLLOWING}, e1 as (select *, coalesce(lead(x) over w, first(x) over w) - x as dx, coalesce(lead(y) over w, first(y) over w) - y as dy from even window w as (partition by curve order by seq)),
      e2 as (select *, greatest(sqrt(dx ** 2 + dy ** 2), 1e-12) as dt from e1), e3 as (select *, sum(dt) over (partition by curve order by seq) as till, sum(dt) over (partition by curve) as total from e2),
      e4 as (select *, cos(2 * pi() * i * till / total) - cos(2 * pi() * i * (till - dt) / total) as tc, sin(2 * pi() * i * till / total) - sin(2 * pi() * i * (till - dt) / total) as ts, total / (2 * i * i * pi() ** 2) as scale from e3, range(1, 6) t(i))
      select curve, i::int as i, round(sum(dx / dt * tc * scale), 6) + 0.0::double as a, round(sum(dx / dt * ts * scale), 6) + 0.0::double as b, round(sum(dy / dt * tc * scale), 6) + 0.0::double as c, round(sum(dy / dt * ts * scale), 6) + 0.0::double as d from e4 group by curve, i""",
}
