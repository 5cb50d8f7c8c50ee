from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from frames import rows

from flowlens.operators import alerts as al
from flowlens.operators import sessions as se

NOW = datetime(2024, 1, 31)


def ago(**delta):
    return NOW - timedelta(**delta)


DATA = [
    (1, ago(minutes=1), "DoS", "MEDIUM", "s1", 0.9, True, "10.0.0.1"),
    (2, ago(hours=1), "Worms", "HIGH", "s1", None, True, "10.0.0.1"),
    (3, ago(hours=24), "DoS", "MEDIUM", "s2", 0.5, True, "10.0.0.2"),
    (4, ago(hours=24, minutes=1), None, None, None, 0.1, False, None),
    (5, ago(days=3), "Normal", "LOW", "s2", 0.7, True, "10.0.0.2"),
    (6, NOW + timedelta(minutes=5), "DoS", "MEDIUM", "s2", 0.6, True, "10.0.0.2"),
]


@pytest.fixture(scope="module")
def alerts(spark):
    return spark.createDataFrame(DATA, "event_id bigint, processed_at timestamp_ntz, attack_type string, severity string, "
                                       "session_id string, prediction_score double, is_attack boolean, source_ip string")


def ids(df):
    return sorted(r["event_id"] for r in df.collect())


def test_filters(alerts):
    assert ids(al.alert_filter(alerts, severity="high")) == [2]
    assert ids(al.alert_filter(alerts, attack_type="DoS", session_id="s2")) == [3, 6]
    assert ids(al.alert_filter(alerts, current_session="s1")) == [1, 2]
    assert ids(al.alert_filter(alerts, current_session="s1", session_id="s2")) == [3, 5, 6]
    assert ids(al.alert_filter(alerts, current_session="s1", session_only=False)) == [1, 2, 3, 4, 5, 6]


def test_ranges_include_their_bounds(alerts):
    found = al.alert_time_range(alerts, ago(hours=24), ago(minutes=1))
    assert [r["event_id"] for r in found.collect()] == [1, 2, 3]
    assert ids(al.relative_range(alerts, "24h", NOW)) == [1, 2, 3, 6]
    assert ids(al.relative_range(alerts, "1h", NOW)) == [1, 2, 6]
    assert ids(al.relative_range(alerts, "custom", start=ago(days=3), end=ago(hours=24))) == [3, 4, 5]
    assert ids(al.relative_range(alerts, "custom", start=ago(hours=1))) == [1, 2, 6]
    assert ids(al.relative_range(alerts, "custom", end=ago(hours=1))) == [1, 2, 3, 4, 5, 6]
    with pytest.raises(ValueError):
        al.relative_range(alerts, "unknown", NOW)


def test_statistics_count_null_and_unknown_types_as_one(alerts):
    mixed = alerts.withColumn("attack_type", F.when(F.col("attack_type") == "DoS", F.lit(None)).otherwise(F.lit("Unknown")))
    row = al.alert_statistics(mixed, 24, NOW).first()
    assert row["by_attack_type"] == {"Unknown": row["total_alerts"]}


def test_default_now_is_the_clock(alerts):
    assert al.relative_range(alerts, "30d").count() == 0
    assert al.alert_time_range(alerts, ago(days=30)).count() == 6


def test_search(alerts):
    assert ids(al.alert_search(alerts, "dOs")) == [1, 3, 6]
    assert ids(al.alert_search(alerts, "S1", severity="HIGH")) == [2]
    assert ids(al.alert_search(alerts, "zzz")) == []
    assert ids(al.alert_search(alerts, date_from=ago(hours=1), date_to=NOW)) == [1, 2]


def test_statistics(alerts):
    found = al.alert_statistics(alerts, 24, NOW).first()
    assert (found["total_alerts"], found["high_severity"], found["medium_severity"], found["low_severity"]) == (4, 1, 3, 0)
    assert found["by_attack_type"] == {"DoS": 3, "Worms": 1}
    assert found["since"] == ago(hours=24)


def test_empty_table(alerts):
    empty = alerts.limit(0)
    row = al.alert_statistics(empty, 24, NOW).first()
    assert (row["total_alerts"], row["high_severity"], row["by_attack_type"]) == (0, 0, {})
    assert al.alert_timeline(empty, 24, 60, NOW).count() == 0
    assert rows(al.alert_metrics(empty, "24h", NOW)) == [(0, 0, 0, 0.0)]
    series = al.activity_series(empty, "24h", NOW).collect()
    assert len(series) == 25 and {r["count"] for r in series} == {0}
    assert al.top_attacks(empty, "24h", 10, NOW).count() == 0
    assert rows(al.traffic_totals(empty)) == [(0, 0, 0, 0)]
    assert rows(al.page_count(empty)) == [(0, 0)]


@pytest.mark.parametrize("minutes", [7, 15, 60, 1440])
def test_bins_are_counted_from_the_origin(alerts, minutes):
    origin = datetime(2000, 1, 1)
    expected = {}
    for _, at, _, severity, *_ in DATA:
        if at >= ago(hours=24 * 7):
            start = at - (at - origin) % timedelta(minutes=minutes)
            count, high = expected.get(start, (0, 0))
            expected[start] = (count + 1, high + (severity == "HIGH"))
    found = al.alert_timeline(alerts, 24 * 7, minutes, NOW).collect()
    assert [(r[0], (r[1], r[2])) for r in found] == sorted(expected.items())


def test_timeline_interval():
    assert (al.timeline_interval(6), al.timeline_interval(7)) == (15, 60)


@pytest.mark.parametrize("period, buckets, width", [
    ("1h", 13, timedelta(minutes=5)), ("6h", 13, timedelta(minutes=30)), ("24h", 25, timedelta(hours=1)),
    ("7d", 8, timedelta(days=1)), ("30d", 16, timedelta(days=2))])
def test_series_buckets(alerts, period, buckets, width):
    found = al.activity_series(alerts, period, NOW).collect()
    starts = [r["bucket_start"] for r in found]
    assert len(starts) == buckets and starts[-1] == NOW and starts[1] - starts[0] == width
    assert found[-1]["count"] == 1  # the alert after now falls in the open bucket
    assert sum(r["count"] for r in found) == al.relative_range(alerts, period, NOW).count()


def test_trend_counts_the_rest_as_low(alerts):
    found = al.severity_trend(alerts, "7d", NOW).collect()
    assert [sum(r[c] for r in found) for c in ("high", "medium", "low")] == [1, 3, 2]


def test_top_lists(alerts):
    assert rows(al.top_attack_types(alerts, 2)) == [("DoS", 3), (None, 1)]
    assert rows(al.top_sources(alerts, 1)) == [("10.0.0.2", 3)]
    best = al.top_attacks(alerts, "30d", 2, NOW).collect()
    assert [(r["attack_type"], r["count"], r["bar"]) for r in best] == [("DoS", 3, 1.0), ("Normal", 1, pytest.approx(1 / 3))]
    share = al.attack_share(alerts, "30d", 2, NOW).collect()
    assert [r["percent"] for r in share] == [75.0, 25.0]
    sessions = al.session_statistics(alerts, "30d", 10, NOW).collect()
    assert [(r["session_id"], r["count"], r["low"]) for r in sessions] == [("s2", 3, 1), ("s1", 2, 0), ("Unknown", 1, 1)]
    assert sessions[0]["first_seen"] == ago(days=3)


def test_counts(alerts):
    assert rows(al.alert_count(alerts)) == [(6,)]
    assert rows(al.alert_count(alerts, since=ago(hours=24), severity="medium")) == [(3,)]
    assert rows(al.recent_count(alerts, 60, NOW, session_id="s1")) == [(2, 2)]
    metrics = al.alert_metrics(alerts, "24h", NOW).first()
    assert metrics["avg_confidence"] == pytest.approx((0.9 + 0.5 + 0.6) / 4) and metrics["attack_types"] == 2
    assert {tuple(r) for r in al.severity_distribution(alerts, None).collect()} == {
        ("MEDIUM", 3), ("HIGH", 1), ("LOW", 1), (None, 1)}
    assert rows(al.traffic_totals(alerts)) == [(6, 5, 1, 1)]


def test_deletion_as_a_filter(alerts):
    assert ids(al.without_session(alerts, "s2")) == [1, 2, 4]
    assert ids(al.retained_alerts(alerts, 1, NOW)) == [1, 2, 3, 6]


# Sessions ----------------------------------------------------------------

def at(hour):
    return datetime(2024, 1, 1, hour)


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame([
        ("a", "registered", at(1), {"data_source": "unsw"}), ("a", "ended", at(2), None),
        ("b", "registered", at(3), {}),
        ("gone", "registered", at(4), {}), ("gone", "deleted", at(5), None),
        ("again", "registered", at(1), {"n": "1"}), ("again", "ended", at(2), None), ("again", "deleted", at(3), None),
        ("again", "registered", at(6), {"n": "2"}),
        ("never", "ended", at(9), None),
    ], "session_id string, event string, event_at timestamp_ntz, metadata map<string,string>")


def test_session_states(log):
    found = {r["session_id"]: r for r in se.session_states(log).collect()}
    assert set(found) == {"a", "b", "again"}
    assert (found["a"]["status"], found["a"]["ended_at"]) == ("ended", at(2))
    assert (found["b"]["status"], found["b"]["ended_at"]) == ("active", None)
    assert (found["again"]["status"], found["again"]["started_at"]) == ("active", at(6))
    assert found["again"]["metadata"] == {"n": "2"} and found["a"]["metadata"] == {"data_source": "unsw"}


def test_session_lists(log):
    assert [r["session_id"] for r in se.sessions(log).collect()] == ["again", "b", "a"]
    assert [r["session_id"] for r in se.sessions(log, 1, active_only=True).collect()] == ["again"]
    assert se.session_info(log, "gone").count() == 0 and se.session_info(log, "b").count() == 1
    assert len(se.new_session_id()) == 8
