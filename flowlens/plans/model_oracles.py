"""DuckDB twins of the queries in ``model_catalog``."""

from __future__ import annotations

from flowlens.plans.oracles import ALERTS, FLOWS, KEY, _index, _with

ROWS = """
rows as (
  select vec_id, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::double as class,
    ('0x' || substr(md5(vec_id::varchar), 1, 8))::bigint % 100 < 80 as trains
  from embeddings)"""
SIDES = """
select {label} as class, count(*) filter (trains) as train_rows, count(*) filter (not trains) as test_rows,
  true as as_reported, true as beats_guess
from rows group by 1"""
BINARY = _with(ROWS, SIDES.format(label="case when class = 0 then 0.0::double else 1.0::double end"))

ORACLES = {
    "train_lr_checked": BINARY,
    "train_rf_binary_checked": BINARY,
    "train_gbt_binary_checked": BINARY,
    "train_rf_multiclass_checked": _with(ROWS, SIDES.format(label="class")),
    "model_comparison_checked": _with(ROWS, """
select model, metric, true as in_range, true as agrees,
  (select count(*) from rows where trains) as train_rows, (select count(*) from rows where not trains) as test_rows
from (select unnest(['unweighted', 'weighted']) as model), (select unnest(['accuracy', 'f1', 'weighted_precision',
  'weighted_recall', 'auc_roc', 'auc_pr']) as metric)"""),
    "feature_importance_checked": """
select 'feature_' || i as feature, true as in_range, true as adds_up
from (select unnest(range((select max(length(embedding)) from embeddings))) as i)""",
    "score_binary_checked": _with(ROWS, """
select vec_id, true as likelier, true as all_attacks, true as no_attacks, true as no_model from rows where not trains"""),
    "saved_model_checked": _with(ROWS, "select vec_id, true as same, true as class_names from rows where not trains"),
    "stream_detect_checked": _with(ROWS, """
select count(*) as sent, count(*) as parsed, 0::bigint as unequal from rows where not trains"""),
    "session_lifecycle": _with(ALERTS, """
select session_id, min(processed_at) as started_at,
  case when substr(session_id, 5)::int % 2 = 0 then max(processed_at) end as ended_at,
  case when substr(session_id, 5)::int % 2 = 0 then 'ended' else 'active' end as status, 'unsw' as data_source
from alerts group by 1"""),
    "delete_all_sessions": _with(ALERTS, """
select count(*) filter (is_attack) as alerts_deleted, count(distinct session_id) as sessions_deleted,
  0::bigint as alerts_left, 0::bigint as events_left from alerts"""),
    "compact_alerts": _with(ALERTS, """
select event_id, severity, attack_type, session_id, processed_at::date as alert_date, -2::bigint as batch_id
from alerts, (select unnest([1, 2]) as copy) where is_attack and (copy = 1 or session_id = 'sess2')"""),
    "index_many_categories": _with(FLOWS + "," + _index("service"), f"""
, orders_rank as (select l_orderkey, row_number() over (order by count(*) desc, l_orderkey::varchar) - 1 as i
  from flows group by 1)
select {KEY}, o.i::double as l_orderkey_indexed, coalesce(s.i, (select count(*) from service_rank))::double as service_indexed
from flows join orders_rank o using (l_orderkey) left join service_rank s using (service)"""),
    "read_processed": _with(FLOWS, f"select {KEY}, bytes, service, label from flows"),
    "enrich_now": _with(ALERTS, "select event_id, true as stamped, severity from alerts"),
}
