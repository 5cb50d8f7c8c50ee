"""DuckDB twins of the registered queries, over the same tables.

They are written independently of the Spark code and only used to check it.
"""

from __future__ import annotations

SCORED = """
scored as (
  select event_id, ts as processed_at, concat('10.0.0.', user_id::varchar) as source_ip,
         concat('sess', (user_id % 10)::varchar) as session_id,
         case when value < 10 then 0.0::double else 1.0::double end as binary_prediction,
         (case event_type when 'view' then 0 when 'signup' then 1 when 'error' then 3
                          when 'purchase' then 4 else 7 end)::double as raw_class,
         value / 500 as prediction_score
  from events)"""


def _alerts(cls: str) -> str:
    return SCORED + f""",
typed as (
  select *, {cls} as multiclass_prediction,
         case ({cls})::int when 0 then 'Normal' when 1 then 'Fuzzers' when 3 then 'Backdoor'
              when 4 then 'DoS' when 7 then 'Reconnaissance' else 'Unknown' end as attack_type,
         binary_prediction = 1 as is_attack
  from scored),
alerts as (
  select *, case when attack_type in ('Backdoor', 'Shellcode', 'Worms', 'Heartbleed', 'Infiltration') then 'HIGH'
                 when attack_type in ('DoS', 'DDoS', 'Exploits', 'Fuzzers', 'Analysis', 'Generic', 'Reconnaissance',
                                      'BruteForce', 'WebAttack', 'Botnet', 'PortScan') then 'MEDIUM'
                 when is_attack then 'LOW' else 'NONE' end as severity
  from typed)"""


ALERTS = _alerts("case when binary_prediction = 0 then 0.0::double else raw_class end")
PARALLEL = _alerts("raw_class")

FLOWS = """
flows as (
  select l_orderkey, l_partkey, l_suppkey, l_linenumber as pkts,
         case when l_partkey % 83 = 0 then 'NaN'::double when l_partkey % 89 = 0 then 'Infinity'::double
              when l_partkey % 91 = 0 then '-Infinity'::double when l_partkey % 97 = 0 then null
              else l_quantity end as flow_rate,
         l_extendedprice as bytes, l_discount as jitter, 5.0::double as const_col,
         case when l_partkey % 3 = 0 then l_tax end as sparse_col, l_linestatus as proto,
         case when l_partkey % 7 <> 0 then l_returnflag end as service,
         case when l_partkey % 100 = 0 then ' Bot' when l_partkey % 100 < 6 then 'PortScan'
              when l_partkey % 100 < 16 then 'DDoS' else 'BENIGN' end as label
  from lineitem)"""

PREDICTIONS = FLOWS + """,
truth as (
  select *, (case label when 'BENIGN' then 0 when 'DDoS' then 2 when ' Bot' then 6 else 7 end)::double as class
  from flows),
predictions as (
  select l_orderkey, l_partkey, l_suppkey, pkts, class as label,
         case when l_suppkey % 7 = 0 then 0.0::double when l_suppkey % 11 = 0 then 1.0::double else class end as prediction,
         bytes / 100000 + (case when class > 0 then 0.2::double else 0.0::double end) - jitter as score,
         case when class > 0 then 1.0::double else 0.0::double end as binary_label
  from truth)"""

KEY = "l_orderkey, l_partkey, l_suppkey, pkts"
VIEW = "event_id, processed_at, attack_type, severity, session_id"
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
FINITE = "case when isfinite(flow_rate) then flow_rate end"
HASH = f"('0x' || substr(md5(concat_ws('|', {KEY})), 1, 8))::bigint"
LEVELS = """count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium,
  count(*) filter (severity is null or severity not in ('HIGH', 'MEDIUM')) as low"""


def _with(prelude: str, body: str) -> str:
    return f"with {prelude.strip()}\n{body.strip()}"


def _series(minutes: int, steps: int, measures: str, outputs: list[str]) -> str:
    filled = ", ".join(f"coalesce({c}, 0) as {c}" for c in outputs)
    return _with(ALERTS, f"""
, counted as (
  select least(floor((epoch_us(processed_at) - epoch_us({NOW} - INTERVAL {minutes * steps} MINUTE))
                     / {minutes * 60000000}.0)::bigint, {steps}) as slot, {measures}
  from alerts where processed_at >= {NOW} - INTERVAL {minutes * steps} MINUTE group by 1)
select {NOW} - INTERVAL {minutes * steps} MINUTE + to_minutes((i * {minutes})::bigint) as bucket_start, {filled}
from generate_series(0, {steps}) t(i) left join counted on slot = i""")


def _weights(weight: str) -> str:
    return _with(FLOWS, f"""
, counts as (select trim(lower(label), ' ') as label, count(*) as count from flows group by 1)
select label, count, round({weight}, 6) as weight from counts""")


def _index(column: str, source: str = "flows") -> str:
    return f"""
{column}_rank as (select {column}, row_number() over (order by count(*) desc, {column}) - 1 as i
  from {source} where {column} is not null group by {column})"""


SPLIT = FLOWS + f""",
keyed as (select {KEY}, label, {HASH} as h, concat_ws('|', {KEY}) as k from flows)"""

LACKING = SPLIT + """,
train as (select * from keyed where h % 100 < 80 and label <> ' Bot'),
test as (select * from keyed where h % 100 >= 80)"""

SCORES = """
, steps as (select binary_label as y, score from predictions)"""

REPORT = PREDICTIONS + """,
classes as (select label as c from predictions union select prediction from predictions),
per_class as (
  select c, (select count(*) from predictions where label = c) as support,
         (select count(*) from predictions where prediction = c) as predicted,
         (select count(*) from predictions where label = c and prediction = c) as correct
  from classes),
scores as (
  select *, case when predicted = 0 then 0 else correct / predicted end as precision,
         case when support = 0 then 0 else correct / support end as recall from per_class),
full_scores as (
  select *, case when precision + recall = 0 then 0 else 2 * precision * recall / (precision + recall) end as f1
  from scores)"""

STORED = f"select {VIEW}, processed_at::date as alert_date from alerts where is_attack"

LEFT = ALERTS + """,
remaining as (select * from alerts where is_attack and session_id <> 'sess4'
  and processed_at >= TIMESTAMP '2024-01-20 13:30:00')"""
LATER = "TIMESTAMP '2024-01-30 13:37:00'"

ORACLES = {
    # Reports from maintained counts
    "alert_statistics_rollup": _with(LEFT, f"""
, found as (select * from remaining where processed_at >= {LATER} - INTERVAL 168 HOUR)
select count(*) as total_alerts, count(*) filter (severity = 'HIGH') as high_severity,
  count(*) filter (severity = 'MEDIUM') as medium_severity, count(*) filter (severity = 'LOW') as low_severity,
  168::int as time_period_hours, {LATER} - INTERVAL 168 HOUR as since,
  (select string_agg(attack_type || '=' || n, ',' order by attack_type || '=' || n)
     from (select attack_type, count(*) as n from found group by 1)) as by_attack_type
from found"""),
    "severity_trend_rollup": _with(LEFT, f"""
, first as (select {LATER} - INTERVAL 30 DAY as t0),
counted as (
  select least(floor((epoch_us(processed_at) - epoch_us(t0)) / 172800000000.0)::bigint, 15) as slot, {LEVELS}
  from remaining, first where processed_at >= t0 group by 1)
select t0 + to_days(2 * i::int) as bucket_start, coalesce(high, 0) as high, coalesce(medium, 0) as medium, coalesce(low, 0) as low
from generate_series(0, 15) t(i) cross join first left join counted on slot = i"""),
    "alert_timeline_rollup": _with(LEFT, f"""
select time_bucket(INTERVAL 360 MINUTE, processed_at) as timestamp, count(*) as count,
  count(*) filter (severity = 'HIGH') as high_severity_count
from remaining where processed_at >= {LATER} - INTERVAL 120 HOUR group by 1"""),
    "alert_page_rollup": _with(LEFT, f"""
select {VIEW} from remaining order by severity desc, processed_at desc, event_id desc limit 50 offset 300"""),
    "alert_page_rollup_types": _with(LEFT, f"""
select {VIEW} from remaining where session_id = 'sess5' order by attack_type, processed_at, event_id limit 20 offset 40"""),
    "alert_search_rollup": _with(LEFT, f"""
select {VIEW} from remaining where concat_ws('|', attack_type, session_id, severity) ilike '%s1%'
union all select {VIEW} from remaining where severity = 'MEDIUM' and processed_at >= TIMESTAMP '2024-01-25'
  and (attack_type ilike '%dos%' or session_id ilike '%dos%' or severity ilike '%dos%')"""),
    # Alerts
    "recent_alerts": _with(ALERTS, f"""
select {VIEW} from alerts where severity = 'HIGH' order by processed_at desc, event_id desc limit 100"""),
    "recent_alerts_session": _with(ALERTS, f"""
select {VIEW} from alerts where attack_type = 'DoS' and session_id = 'sess3'
order by processed_at desc, event_id desc limit 50"""),
    "alert_time_range": _with(ALERTS, f"""
select {VIEW} from alerts where processed_at between TIMESTAMP '2024-01-10' and TIMESTAMP '2024-01-12'"""),
    "alert_search": _with(ALERTS, f"""
select {VIEW} from alerts where severity = 'MEDIUM'
  and (attack_type ilike '%sess1%' or session_id ilike '%sess1%' or severity ilike '%sess1%')
  and processed_at >= TIMESTAMP '2024-01-05' and processed_at <= TIMESTAMP '2024-01-25'"""),
    "relative_range": _with(ALERTS, f"select {VIEW} from alerts where processed_at >= {NOW} - INTERVAL 7 DAY"),
    "alert_page": _with(ALERTS, f"select {VIEW} from alerts order by attack_type, event_id limit 50 offset 100"),
    "alert_page_deep": _with(ALERTS, f"""
select {VIEW} from alerts order by severity desc, event_id desc limit 50 offset 900"""),
    "alert_page_count": _with(ALERTS, """
select count(*) as total_rows, ceil(count(*) / 50)::bigint as total_pages from alerts"""),
    "top_attack_types": _with(ALERTS, """
select attack_type, count(*) as count from alerts group by 1 order by 2 desc, 1 limit 10"""),
    "top_sources": _with(ALERTS, """
select source_ip, count(*) as count from alerts where is_attack group by 1 order by 2 desc, 1 limit 10"""),
    "alert_statistics": _with(ALERTS, f"""
select count(*) as total_alerts, count(*) filter (severity = 'HIGH') as high_severity,
  count(*) filter (severity = 'MEDIUM') as medium_severity, count(*) filter (severity = 'LOW') as low_severity,
  24::int as time_period_hours, {NOW} - INTERVAL 24 HOUR as since,
  (select string_agg(kind || '=' || n, ',' order by kind || '=' || n) from (
     select case when event_id % 7 = 0 or event_id % 11 = 0 then 'Unknown' else attack_type end as kind, count(*) as n
     from alerts where processed_at >= {NOW} - INTERVAL 24 HOUR group by 1)) as by_attack_type
from alerts where processed_at >= {NOW} - INTERVAL 24 HOUR"""),
    "alert_type_counts": _with(ALERTS, f"""
select attack_type, count(*) as count from alerts where processed_at >= {NOW} - INTERVAL 24 HOUR group by 1"""),
    "alert_timeline": _with(ALERTS, f"""
select time_bucket(INTERVAL 60 MINUTE, processed_at) as timestamp, count(*) as count,
  count(*) filter (severity = 'HIGH') as high_severity_count
from alerts where processed_at >= {NOW} - INTERVAL 30 DAY group by 1"""),
    "alert_timeline_odd_bins": _with(ALERTS, f"""
select time_bucket(INTERVAL 7 MINUTE, processed_at, TIMESTAMP '2000-01-01') as timestamp, count(*) as count,
  count(*) filter (severity = 'HIGH') as high_severity_count
from alerts where session_id = 'sess3' and processed_at >= {NOW} - INTERVAL 30 DAY group by 1"""),
    "alert_metrics": _with(ALERTS, f"""
select count(*) as total_alerts, count(*) filter (severity = 'HIGH') as high_severity,
  count(distinct attack_type) as attack_types, round(avg(coalesce(prediction_score, 0)), 6) as avg_confidence
from alerts where processed_at >= {NOW} - INTERVAL 7 DAY"""),
    "alert_metrics_custom": _with(ALERTS, """
select count(*) as total_alerts, count(*) filter (severity = 'HIGH') as high_severity,
  count(distinct attack_type) as attack_types, round(avg(coalesce(prediction_score, 0)), 6) as avg_confidence
from alerts where processed_at between TIMESTAMP '2024-01-10' and TIMESTAMP '2024-01-20'"""),
    "top_attacks": _with(ALERTS, f"""
, best as (select attack_type, count(*) as count, {LEVELS} from alerts
  where processed_at >= {NOW} - INTERVAL 30 DAY group by 1 order by 2 desc, 1 limit 10)
select *, round(count / (select max(count) from best), 6) as bar from best"""),
    "attack_share": _with(ALERTS, f"""
, best as (select attack_type, count(*) as count from alerts
  where processed_at >= {NOW} - INTERVAL 30 DAY group by 1 order by 2 desc, 1 limit 4)
select *, round(100.0 * count / (select sum(count) from best), 6)::double as percent from best"""),
    "activity_series": _series(60, 24, "count(*) as count", ["count"]),
    "activity_series_30d": _series(2880, 15, "count(*) as count", ["count"]),
    "severity_trend": _series(1440, 7, LEVELS, ["high", "medium", "low"]),
    "session_statistics": _with(ALERTS, f"""
select session_id, count(*) as count, {LEVELS}, min(processed_at) as first_seen, max(processed_at) as last_seen
from alerts where processed_at >= {NOW} - INTERVAL 30 DAY group by 1 order by 2 desc, 1 limit 10"""),
    "alert_count": _with(ALERTS, """
select count(*) as count from alerts where severity = 'HIGH' and processed_at >= TIMESTAMP '2024-01-20'"""),
    "recent_count": _with(ALERTS, f"""
select count(*) as total, count(*) filter (processed_at >= {NOW} - INTERVAL 600 MINUTE) as recent from alerts"""),
    "severity_distribution": _with(ALERTS, f"""
select severity, count(*) as count from alerts where processed_at >= {NOW} - INTERVAL 7 DAY group by 1"""),
    "traffic_totals": _with(ALERTS, """
select count(*) as events, count(*) filter (is_attack) as attacks, count(*) filter (severity = 'HIGH') as high_severity,
  count(*) filter (not is_attack) as normal from alerts"""),
    "traffic_split": _with(ALERTS, "select is_attack, count(*) as count from alerts group by 1"),
    "export_alerts": _with(ALERTS, """
select processed_at, attack_type, severity, session_id, binary_prediction as prediction, prediction_score
from alerts where severity = 'MEDIUM' order by processed_at desc, event_id desc limit 1000"""),
    # Sessions and the stored table
    "sessions": _with(ALERTS, """
select session_id, min(processed_at) as started_at,
  case when substr(session_id, 5)::int % 2 = 0 then max(processed_at) end as ended_at,
  case when substr(session_id, 5)::int % 2 = 0 then 'ended' else 'active' end as status
from alerts group by 1 order by 2 desc, 1 limit 20"""),
    "active_sessions": _with(ALERTS, """
select session_id, min(processed_at) as started_at, null::timestamp as ended_at, 'active' as status
from alerts where substr(session_id, 5)::int % 2 = 1 group by 1 order by 2 desc, 1 limit 10"""),
    "session_info": _with(ALERTS, """
select session_id, min(processed_at) as started_at, max(processed_at) as ended_at, 'ended' as status
from alerts where session_id = 'sess4' group by 1"""),
    "delete_session": _with(ALERTS, STORED + " and session_id <> 'sess4'"),
    "delete_old_alerts": _with(ALERTS, STORED + " and processed_at >= TIMESTAMP '2024-01-20 13:30:00'"),
    "append_alerts": _with(ALERTS, """
select session_id, 0::bigint as batch_id, count(*) as count from alerts where is_attack group by 1
union all select session_id, -1, count(*) from alerts where is_attack and session_id = 'sess2' group by 1"""),
    # Scoring
    "score_cascade": _with(ALERTS, "select event_id, binary_prediction, multiclass_prediction from alerts"),
    "score_parallel": _with(PARALLEL, """
select event_id, binary_prediction, multiclass_prediction, attack_type, is_attack, severity from alerts"""),
    "enrich": _with(ALERTS, """
select event_id, binary_prediction, multiclass_prediction, attack_type, is_attack, severity from alerts"""),
    "severity_policies": _with(PARALLEL, """
, legacy as (select event_id, is_attack,
    case raw_class::int when 0 then 'Benign' when 1 then 'DoS' when 3 then 'PortScan' when 4 then 'BruteForce'
         else 'Botnet' end as attack_type,
    case when attack_type = 'Backdoor' then 'HIGH' when attack_type in ('Fuzzers', 'DoS') then 'MEDIUM'
         when attack_type = 'Reconnaissance' then 'LOW' when attack_type = 'Normal' then 'NONE'
         when is_attack then 'LOW' else 'NONE' end as graded
  from alerts)
select event_id, attack_type, graded, case attack_type when 'DoS' then 'HIGH' when 'BruteForce' then 'MEDIUM'
  when 'Botnet' then 'MEDIUM' when 'PortScan' then 'LOW' else 'NONE' end as severity from legacy"""),
    "apply_threshold": _with(SCORED, """
select case when prediction_score >= 0.05 then 1.0::double else 0.0::double end as binary_prediction, count(*) as count
from scored group by 1"""),
    "detection_summary": _with(ALERTS, """
select session_id, count(*) as processed, count(*) filter (is_attack) as attacks,
  count(*) filter (is_attack and severity = 'HIGH') as high, count(*) filter (is_attack and severity = 'MEDIUM') as medium,
  count(*) filter (is_attack and severity = 'LOW') as low,
  round(count(*) filter (is_attack) / count(*), 6) as detection_rate
from alerts group by 1"""),
    "attacks_by_type": _with(ALERTS, "select attack_type, count(*) as count from alerts where is_attack group by 1"),
    # Cleaning
    "clean_zero": _with(FLOWS, f"""
select {KEY}, coalesce({FINITE}, 0) as flow_rate, coalesce(sparse_col, 0) as sparse_col from flows"""),
    "clean_mean": _with(FLOWS, f"""
, means as (select avg({FINITE}) as a, avg(sparse_col) as b from flows)
select {KEY}, round(coalesce({FINITE}, (select a from means)), 6) as flow_rate,
  round(coalesce(sparse_col, (select b from means)), 6) as sparse_col from flows"""),
    "clean_drop": _with(FLOWS, f"select {KEY}, flow_rate, sparse_col from flows where isfinite(flow_rate)"),
    "impute_drop": _with(FLOWS, f"""
select {KEY}, sparse_col, service, label from flows
where flow_rate is not null and not isnan(flow_rate) and sparse_col is not null and service is not null"""),
    "deduplicate": _with(FLOWS, """
select distinct pkts, flow_rate, jitter, const_col, sparse_col, proto, service, label from flows"""),
    "deduplicate_increment": _with(FLOWS, """
select distinct pkts, flow_rate, jitter, const_col, sparse_col, proto, service, label from flows"""),
    "duplicate_report": _with(FLOWS, """
, picked as (select l_partkey, pkts, flow_rate, jitter, const_col, sparse_col, proto, service, label from flows),
doubled as (select * from picked union all select * from picked),
n as (select (select count(*) from doubled) as t, (select count(*) from (select distinct * from doubled)) as d)
select t as total_rows, d as distinct_rows, t - d as removed_rows, round((t - d) / t, 6) as removed_ratio from n"""),
    "missing_profile": _with(FLOWS, "\nunion all\n".join(
        [f"select '{c}' as column_name, count(*) filter ({test}) as missing, count(*) as total_rows, "
         f"round(count(*) filter ({test}) / count(*), 6) as missing_ratio from flows"
         for c, test in [(c, f"{c} is null") for c in
                         ("l_orderkey", "l_partkey", "l_suppkey", "pkts", "proto", "service")]
         + [(c, f"{c} is null or isnan({c})") for c in ("flow_rate", "bytes", "jitter", "const_col", "sparse_col")]])),
    "drop_sparse_columns": _with(FLOWS, f"select {KEY}, bytes, jitter, const_col, proto, label from flows"),
    "drop_low_variance": _with(FLOWS, f"select {KEY}, bytes, proto, label from flows"),
    "clean_names": _with(FLOWS, """
select pkts as total_fwd_packets, max(bytes) as flow_bytes_s, max(jitter) as fwd_header_length_1,
  'Total_Fwd_Packets,Flow_Bytes_per_s,Fwd_Header_Length_dot_1,Label' as stream_names from flows group by 1"""),
    # Labels and weights
    "standardize_label": _with(FLOWS, """
select trim(lower(label), ' ') as label, count(*) as count from flows group by 1"""),
    "binary_label": _with(FLOWS, f"""
select {KEY}, trim(lower(label), ' ') as label, (case when label = 'BENIGN' then 0 else 1 end)::int as binary_label
from flows"""),
    "label_text": _with(FLOWS, f"""
select {KEY}, (case when label = 'BENIGN' then 0 else 1 end)::int as label, service as attack_cat,
  case when label = 'BENIGN' then 'normal' else service end as label_text from flows"""),
    "normalize_attack_cat": _with(FLOWS, """
select coalesce(service, 'Normal') as attack_cat, count(*) as count from flows group by 1"""),
    "map_labels": _with(FLOWS, f"""
select {KEY}, label, (case label when 'BENIGN' then 0 when 'DDoS' then 2 when ' Bot' then 6 else 7 end)::int as unified_label,
  (case label when 'BENIGN' then 0 when ' Bot' then 6 else 8 end)::int as label_2018 from flows"""),
    "prepare_unsw_labels": _with(ALERTS, """
, cats as (select event_id, case when attack_type = 'DoS' then 'Normal' else attack_type end as attack_cat from alerts)
select event_id, attack_cat, (case attack_cat when 'Normal' then 0 when 'Fuzzers' then 1 when 'Backdoor' then 3
  else 7 end)::double as multiclass_label, (case when attack_cat = 'Normal' then 0 else 1 end)::double as binary_label
from cats"""),
    "class_weights_inverse": _weights("(select max(count) from counts) / count"),
    "class_weights_sqrt": _weights("sqrt((select sum(count) from counts) / ((select count(*) from counts) * count))"),
    "class_weights_sqrt2": _weights("sqrt((select sum(count) from counts) / (2 * count))"),
    "attach_weights": _with(FLOWS, f"""
, rows_ as (select {KEY}, trim(lower(label), ' ') as label from flows),
counts as (select label, count(*) as n from rows_ group by 1),
weights as (select label, (select max(n) from counts) / n as w from counts where label <> 'bot')
select {KEY}, label, round(coalesce(w, 1.0::double), 6) as sample_weight, round(w, 6) as strict_weight
from rows_ left join weights using (label)"""),
    "harmonize": _with(FLOWS, f"""
, merged as (
  select {KEY}, label, case when proto = 'F' then 'cicids2017' else 'cicids2018' end as dataset_source,
    (case when label = 'BENIGN' then 0 when label = ' Bot' then 6 when proto <> 'F' and label in ('DDoS', 'PortScan') then 8
          when label = 'DDoS' then 2 else 7 end)::int as unified_label from flows),
counts as (select unified_label, count(*) as n from merged group by 1)
select merged.*, round((select max(n) from counts) / n, 6) as multiclass_weight from merged join counts using (unified_label)"""),
    "harmonized_metadata": _with(FLOWS, """
, merged as (
  select case when proto = 'F' then 'a' else 'b' end as source,
    (case when label = 'BENIGN' then 0 when label = ' Bot' then 6 when proto <> 'F' and label in ('DDoS', 'PortScan') then 8
          when label = 'DDoS' then 2 else 7 end)::int as unified_label from flows),
counts as (select unified_label, count(*) as n, count(*) filter (source = 'a') as a, count(*) filter (source = 'b') as b
  from merged group by 1)
select unified_label, case unified_label when 0 then 'Benign' when 2 then 'DDoS' when 6 then 'Botnet' when 7 then 'PortScan'
    else 'Other' end as class_name, n as class_rows, round((select max(n) from counts) / n, 6) as weight,
  a as rows_cicids2017, b as rows_cicids2018 from counts"""),
    "counts_by_source": _with(FLOWS, """
select case when proto = 'F' then 'cicids2017' else 'cicids2018' end as dataset_source, count(*) as count
from flows group by 1"""),
    "union_flows": _with(FLOWS, f"""
select {KEY}, case when proto <> 'F' then jitter end as jitter, case when proto = 'F' then sparse_col end as sparse_col, label
from flows"""),
    # Aggregates
    "class_distribution": _with(FLOWS, """
select label, count(*) as count, round(100.0 * count(*) / (select count(*) from flows), 6)::double as percent
from flows group by 1"""),
    "distribution_2d": _with(FLOWS, "select label, proto, count(*) as count from flows group by 1, 2"),
    "distribution_matrix": _with(FLOWS, """
select label, count(*) filter (proto = 'F') as "F", count(*) filter (proto = 'O') as "O" from flows group by 1"""),
    "column_summary": _with(FLOWS, """
select count(bytes) as count, round(avg(bytes), 4) as mean, round(stddev_samp(bytes), 4) as stddev, min(bytes) as min,
  round(quantile_cont(bytes, 0.25), 4) as q25, round(quantile_cont(bytes, 0.5), 4) as q50,
  round(quantile_cont(bytes, 0.75), 4) as q75, max(bytes) as max from flows"""),
    "column_summary_tied": _with(FLOWS, """
select count(jitter) as count, round(avg(jitter), 6) as mean, round(stddev_samp(jitter), 6) as stddev, min(jitter) as min,
  round(quantile_cont(jitter, 0.25), 6) as q25, round(quantile_cont(jitter, 0.5), 6) as q50,
  round(quantile_cont(jitter, 0.75), 6) as q75, max(jitter) as max from flows"""),
    "dataset_summary": _with(FLOWS, """
select 'flows' as dataset, count(*) as total_rows, 12::bigint as total_columns,
  'l_orderkey, l_partkey, l_suppkey, pkts, flow_rate, bytes, jitter, const_col, sparse_col, proto...' as first_columns
from flows"""),
    "dataset_metadata": _with(FLOWS, """
, counts as (select trim(lower(label), ' ') as class_label, count(*) as class_rows from flows group by 1)
select class_label, class_rows, round((select max(class_rows) from counts) / class_rows, 6) as weight,
  (select count(*) from flows) as total_rows, 4::bigint as total_features,
  'pkts, flow_rate, bytes, jitter' as feature_columns from counts"""),
    "distinct_labels": _with(FLOWS, "select distinct trim(lower(label), ' ') as label from flows"),
    # Features and splits
    "index_categories": _with(FLOWS + "," + _index("proto") + "," + _index("service"), f"""
select {KEY}, proto, service, coalesce(p.i, (select count(*) from proto_rank))::double as proto_indexed,
  coalesce(s.i, (select count(*) from service_rank))::double as service_indexed
from flows left join proto_rank p using (proto) left join service_rank s using (service)"""),
    "standardize_features": _with(FLOWS, f"""
, clean as (select {KEY}, coalesce({FINITE}, 0) as r, bytes, jitter from flows),
m as (select avg(r) as ar, stddev_samp(r) as sr, avg(bytes) as ab, stddev_samp(bytes) as sb,
  avg(jitter) as aj, stddev_samp(jitter) as sj from clean)
select {KEY}, round((r - ar) / sr, 6) as z0, round((bytes - ab) / sb, 6) as z1, round((jitter - aj) / sj, 6) as z2,
  0.0::double as z3 from clean, m"""),
    "assemble_features": _with(FLOWS, f"""
select {KEY}, pkts::double as f0, flow_rate as f1, bytes as f2 from flows
where flow_rate is not null and not isnan(flow_rate)"""),
    "feature_columns": _with(FLOWS, """
select count(*) as rows, 'l_orderkey,l_partkey,l_suppkey,pkts,flow_rate,bytes,jitter,const_col,sparse_col' as features
from flows"""),
    "hash_split": _with(SPLIT, f"""
select {KEY}, label, case when h % 100 < 80 then 'train' else 'test' end as side from keyed"""),
    "stratified_split": _with(SPLIT, f"""
, ranked as (select *, row_number() over (partition by label order by h, k) as r,
  count(*) over (partition by label) as n from keyed)
select {KEY}, label, case when r <= floor(0.8 * n) then 'train' else 'test' end as side from ranked"""),
    "hash_sample": _with(SPLIT, f"select {KEY}, label from keyed where h < floor(0.15 * 4294967296)"),
    "missing_classes": _with(LACKING, """
select distinct label from test where label not in (select label from train)"""),
    "rebalance_missing": _with(LACKING, f"""
, marked as (select *, label not in (select label from train)
  and ('0x' || substr(md5(k || '#42'), 1, 8))::bigint < 2147483648 as moves from test)
select {KEY}, label, 'train' as side from train
union all select {KEY}, label, case when moves then 'train' else 'test' end from marked"""),
    "shuffled_head": "select least(count(*), 500) as rows from lineitem",
    # Messages and files
    "flows_to_json": _with(FLOWS, """
select l_orderkey::double as l_orderkey, l_partkey::double as l_partkey, l_suppkey::double as l_suppkey,
  pkts::double as pkts, case when flow_rate is null or isnan(flow_rate) then 0 else flow_rate end as flow_rate,
  coalesce(sparse_col, 0) as sparse_col, coalesce(service, '0.0') as service, label, 7::int as producer_id from flows"""),
    "parse_flow_json": """
select event_id, regexp_extract(props, '[0-9]+')::double as k from events where event_type <> 'error'""",
    "rejected_flow_json": "select event_id, substr(props, 2) as value from events where event_type = 'error'",
    "read_flow_csv": _with(FLOWS, f"""
select {KEY}, flow_rate, bytes, case when proto = 'F' then jitter end as jitter, proto, service from flows"""),
    "read_flow_csv_headerless": _with(FLOWS, """
select l_orderkey::varchar as sport, l_partkey::varchar as dsport, bytes as dur, l_suppkey::double as sbytes,
  pkts::double as spkts, service, 0::int as label from flows"""),
    "verify_written": "select count(*) as written_rows, count(*) as expected_rows, true as verified from lineitem",
    # Evaluation
    "confusion": _with(PREDICTIONS, "select label, prediction, count(*) as count from predictions group by 1, 2"),
    "confusion_normalized": _with(PREDICTIONS, """
, classes as (select label as c from predictions union select prediction from predictions),
cells as (select a.c as label, b.c as prediction, (select count(*) from predictions p
  where p.label = a.c and p.prediction = b.c) as count from classes a, classes b)
select label, prediction, count, round(coalesce(count / nullif(sum(count) over (partition by label), 0), 0), 6)::double as share
from cells"""),
    "per_class_accuracy": _with(PREDICTIONS, """
select label, count(*) as total, count(*) filter (label = prediction) as correct,
  round(count(*) filter (label = prediction) / count(*), 4) as accuracy from predictions group by 1"""),
    "classification_report": _with(REPORT, """
select c::int::varchar as entry, round(precision, 6)::double as precision, round(recall, 6)::double as recall,
  round(f1, 6)::double as f1, support from full_scores
union all select 'accuracy', round(sum(correct) / sum(support), 6), round(sum(correct) / sum(support), 6),
  round(sum(correct) / sum(support), 6), sum(support)::bigint from full_scores
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::bigint
  from full_scores
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::bigint
  from full_scores"""),
    "multiclass_metrics": _with(REPORT, """
select round(sum(correct) / sum(support), 6) as accuracy, round(sum(f1 * support) / sum(support), 6) as f1,
  round(sum(precision * support) / sum(support), 6) as weighted_precision,
  round(sum(recall * support) / sum(support), 6) as weighted_recall from full_scores"""),
    "auc_roc": _with(PREDICTIONS + SCORES, """
, ranked as (select y, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from steps),
n as (select count(*) filter (y = 1) as p, count(*) filter (y = 0) as q from steps)
select round(((select sum(r) from ranked where y = 1) - p * (p + 1) / 2.0) / (p::double * q), 6)::double as auc_roc from n"""),
    "auc_pr": _with(PREDICTIONS + SCORES, """
, grouped as (select score, sum(y) as hits, count(*) as n from steps group by 1),
curve as (select sum(hits) over w as tp, sum(n) over w as seen, row_number() over w as i from grouped
  window w as (order by score desc)),
points as (select i, tp / (select sum(y) from steps) as recall, tp / seen as precision from curve),
segments as (select recall - coalesce(lag(recall) over (order by i), 0) as width,
  (precision + coalesce(lag(precision) over (order by i), precision)) / 2 as height from points)
select round(sum(width * height), 6) as auc_pr from segments"""),
    "prediction_distribution": _with(PREDICTIONS, """
select prediction, count(*) as count, count(*) filter (prediction = label) as agreeing from predictions group by 1"""),
    # Pipelines and streams
    "preprocess": _with(FLOWS + "," + _index("proto") + "," + _index("service"), f"""
, labelled as (
  select pkts, flow_rate, bytes, jitter, const_col, sparse_col, proto, service, trim(lower(label), ' ') as label from flows),
clean as (
  select pkts, coalesce({FINITE}, 0) as flow_rate, bytes, jitter, const_col, label, proto, service
  from (select distinct * from labelled)),
counts as (select label, count(*) as n from clean group by 1),
m as (select avg(pkts) as ap, stddev_samp(pkts) as sp, avg(flow_rate) as ar, stddev_samp(flow_rate) as sr,
  avg(bytes) as ab, stddev_samp(bytes) as sb, avg(jitter) as aj, stddev_samp(jitter) as sj from clean)
select pkts, flow_rate, bytes, jitter, const_col, label, (case when label = 'benign' then 0 else 1 end)::int as binary_label,
  coalesce(p.i, (select count(*) from proto_rank))::double as proto_indexed,
  coalesce(s.i, (select count(*) from service_rank))::double as service_indexed,
  round((select max(n) from counts) / n, 6) as sample_weight,
  round((pkts - ap) / sp, 6) as z_pkts, round((flow_rate - ar) / sr, 6) as z_flow_rate,
  round((bytes - ab) / sb, 6) as z_bytes, round((jitter - aj) / sj, 6) as z_jitter, 0.0::double as z_const_col
from clean cross join m join counts using (label) left join proto_rank p using (proto) left join service_rank s using (service)"""),
    "preprocess_mean": _with(FLOWS + "," + _index("proto") + "," + _index("service"), """
, clean as (
  select distinct pkts::double as pkts, flow_rate, bytes, jitter, const_col, sparse_col,
    coalesce(p.i, (select count(*) from proto_rank))::double as proto,
    coalesce(s.i, (select count(*) from service_rank))::double as service, label
  from flows left join proto_rank p using (proto) left join service_rank s using (service)),
means as (select avg(flow_rate) filter (isfinite(flow_rate)) as mr, avg(sparse_col) as ms from clean),
filled as (
  select pkts, case when isfinite(flow_rate) then flow_rate else mr end as flow_rate, bytes, jitter, const_col,
    coalesce(sparse_col, ms) as sparse_col, proto, service, label, (case when label = 'BENIGN' then 0 else 1 end)::int as y
  from clean cross join means),
counts as (select y, count(*) as n from filled group by 1),
""" + "m as (select " + ", ".join(f"avg({c}) as a_{c}, stddev_samp({c}) as s_{c}" for c in
                                  ("pkts", "flow_rate", "bytes", "jitter", "sparse_col", "proto", "service"))
        + " from filled)\nselect " + ", ".join(f"round({c}, 6) as {c}" for c in (
            "pkts", "flow_rate", "bytes", "jitter", "const_col", "sparse_col", "proto", "service"))
        + ", label, y as binary_label, round((select max(n) from counts) / n, 6) as sample_weight, "
        + ", ".join(f"round(({c} - a_{c}) / s_{c}, 6) as z_{c}" for c in
                    ("pkts", "flow_rate", "bytes", "jitter", "sparse_col", "proto", "service"))
        + ", 0.0::double as z_const_col from filled cross join m join counts using (y)"),
    "stream_alerts": _with(ALERTS, """
select event_id, attack_type, severity, source_ip, 'replay' as session_id, processed_at::date as alert_date
from alerts where is_attack"""),
    "stream_timeline": _with(ALERTS, """
select time_bucket(INTERVAL 60 MINUTE, processed_at) as timestamp, count(*) as count,
  count(*) filter (severity = 'HIGH') as high_severity_count
from alerts where is_attack group by 1"""),
    "stream_timeline_updates": _with(ALERTS, """
select time_bucket(INTERVAL 60 MINUTE, processed_at) as timestamp, count(*) as count,
  count(*) filter (severity = 'HIGH') as high_severity_count
from alerts where is_attack group by 1"""),
    "stream_redelivered": _with(ALERTS, """
select event_id, attack_type, severity, source_ip, 'replay' as session_id, processed_at::date as alert_date
from alerts where is_attack"""),
    "stream_accounting": """
select count(*) as sent, count(*) filter (event_type <> 'error') as parsed,
  count(*) filter (event_type = 'error') as rejected, 0::bigint as attacks,
  count(*) filter (event_type = 'error') as stored, true as adds_up from events""",
    "stream_rejects": "select props as value, count(*) as messages from events where event_type <> 'error' group by 1",
    "read_alerts_mixed_columns": _with(ALERTS, """
select event_id, attack_type, case when processed_at < TIMESTAMP '2024-01-15 00:00:00' then source_ip end as source_ip
from alerts where is_attack"""),
    "read_flow_csv_unknown_columns": _with(FLOWS, f"""
select {KEY}, bytes as tot_bytes, service, 'int,double,string' as kinds from flows"""),
    "read_flow_csv_exact_types": _with(FLOWS, f"""
select {KEY}, 1700000000123456789 + l_orderkey as flow_id, lpad(l_partkey::varchar, 8, '0') as code, flow_rate,
  'bigint,string,double' as kinds from flows"""),
    "read_flow_csv_rejects": _with(FLOWS, """
, lines as (
  select l_orderkey % 40 as turn, concat_ws(',', l_orderkey, case when l_orderkey % 40 = 0 then 'xx' else l_partkey::varchar end,
    l_suppkey, pkts) as line, concat_ws(',', l_orderkey, l_partkey, l_suppkey) as short from flows)
select case when turn < 3 then 'rejected' else 'kept' end as side,
  case turn when 1 then line || ',7' when 2 then short else line end as line, count(*) as lines from lines group by 1, 2"""),
    "read_flow_csv_duplicate_headers": _with(FLOWS, f"select {KEY}, bytes as load_0, jitter as load_1 from flows"),
    "read_flow_csv_mixed_folder": _with(FLOWS, f"select {KEY}, bytes, jitter, service from flows"),
    "rebalance_small_fraction": _with(LACKING, f"""
, marked as (select *, label not in (select label from train)
  and ('0x' || substr(md5(k || '#42'), 1, 8))::bigint < floor(0.004 * 4294967296) as moves from test)
select {KEY}, label, 'train' as side from train
union all select {KEY}, label, case when moves then 'train' else 'test' end from marked"""),
}
