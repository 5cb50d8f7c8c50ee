"""Reports from maintained counts equal those over the alerts, after every kind of change."""

from datetime import datetime, timedelta, timezone

import pytest
from frames import rows
from pyspark.sql import functions as F

from flowlens.operators import alerts as al, rollups as ro
from flowlens.sources import alert_counts as ac, alert_table as at
from flowlens.streaming import detect as de

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def flows(spark, n, shift=0):
    """Flows ten minutes apart, a quarter of them no attacks, every fifth of no type."""
    n_th = F.col("id")
    return spark.range(n).select(
        n_th.alias("event_id"), (n_th % 4 > 0).alias("is_attack"),
        F.when(n_th % 5 > 0, F.concat(F.lit("type"), n_th % 3)).alias("attack_type"),
        F.when(n_th % 3 == 0, "HIGH").when(n_th % 3 == 1, "MEDIUM").otherwise("LOW").alias("severity"),
        F.lit(1.0).alias("binary_prediction"), F.lit(4.0).alias("multiclass_prediction"), F.lit(0.9).alias("prediction_score"),
        (F.lit(START) + F.make_dt_interval(mins=(n_th * 10 + shift).cast("int"))).alias("processed_at"))


def check(spark, path, counts, now):
    """Every report both ways, over all sessions and one."""
    c, a = ac.read_counts(spark, counts), at.read_alerts(spark, path)
    assert c.agg(F.sum("n")).first()[0] == (a.count() or None)
    for period in ("6h", "24h", "7d"):
        assert rows(ro.severity_trend_rollup(c, a, period, now)) == rows(al.severity_trend(a, period, now))
        assert rows(ro.activity_series_rollup(c, a, period, now)) == rows(al.activity_series(a, period, now))
    for session in ({}, {"session_id": "b"}):
        assert rows(ro.alert_statistics_rollup(c, a, 24, now, **session)) == rows(al.alert_statistics(a, 24, now, **session))
        assert rows(ro.alert_type_counts_rollup(c, a, 24, now, **session)) == rows(al.alert_type_counts(a, 24, now, **session))
    assert rows(ro.alert_timeline_rollup(c, a, 24, 120, now)) == rows(al.alert_timeline(a, 24, 120, now))


def test_reports_equal_those_over_alerts_after_every_change(spark, folder):
    path, counts, now = f"{folder}/alerts", f"{folder}/counts", START + timedelta(days=2, hours=3, minutes=17)
    for session, shift in (("a", 0), ("b", 7)):
        sink = de.alert_sink(path, session, counts=counts)
        sink(flows(spark, 200, shift), 0)
        sink(flows(spark, 200, shift), 0)  # a repeated batch
        sink(flows(spark, 100, shift + 1500), 1)
    check(spark, path, counts, now)
    ac.compact(spark, path, counts, START, START + timedelta(days=1))
    check(spark, path, counts, START + timedelta(days=2))  # no bin is cut
    assert ac.clear_session(spark, path, counts, "a") > 0 and ac.clear_session(spark, path, counts, "a") == 0
    assert ac.delete_old(spark, path, counts, 1, now) > 0 and ac.delete_old(spark, path, counts, 1, now) == 0
    check(spark, path, counts, now)
    assert ac.delete_everything(spark, path, counts) > 0
    check(spark, path, counts, now)


def test_only_cut_bins_are_read_from_the_alerts(spark, folder):
    path, counts = f"{folder}/alerts", f"{folder}/counts"
    de.alert_sink(path, "a", counts=counts)(flows(spark, 300), 0)
    c, a = ac.read_counts(spark, counts), at.read_alerts(spark, path)
    whole = ro.weighted_rows(c, a, [START + timedelta(hours=5)])
    assert path not in str(whole.inputFiles())
    cut = ro.weighted_rows(c, a, [START + timedelta(hours=5, minutes=1)])
    plan = cut._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(processed_at,2024-01-01 05:00:00" in plan  # and an upper bound, cut off in the text
    assert "PartitionFilters: [isnotnull(alert_date" in plan
    assert cut.agg(F.sum("n")).first()[0] == a.count()


@pytest.mark.parametrize("call", [lambda c, a: ro.alert_timeline_rollup(c, a, 24, 90), lambda c, a: ac.counts_of(a, 7),
                                  lambda c, a: ro.severity_trend_rollup(c, a, "custom")])
def test_bins_that_do_not_fit(spark, folder, call):
    with pytest.raises(ValueError):
        call(ac.read_counts(spark, f"{folder}/c"), at.read_alerts(spark, f"{folder}/a"))


def stored(spark, folder):
    path, counts = f"{folder}/alerts", f"{folder}/counts"
    for session, shift in (("a", 0), ("b", 7), ("Cab", 3)):
        de.alert_sink(path, session, counts=counts)(flows(spark, 400, shift), 0)
    return ac.read_counts(spark, counts), at.read_alerts(spark, path)


@pytest.mark.parametrize("sort", ["processed_at", "severity", "attack_type", "session_id"])
def test_pages_by_counts_equal_sorted_alerts(spark, folder, sort):
    """Every page in both directions, types without a name included; pages past the end are empty."""
    c, a = stored(spark, folder)
    a = a.withColumn("event_id", F.concat("session_id", F.col("event_id").cast("string")))
    keys = list(dict.fromkeys([sort, "processed_at", "event_id"]))
    for order in ("asc", "desc"):
        by = [F.col(k).asc_nulls_first() if order == "asc" else F.col(k).desc_nulls_last() for k in keys]
        everything = rows(a.orderBy(*by), "event_id")
        for number in (4, 11):
            found = ro.alert_page_rollup(c, a, sort, order, number, 90)
            assert rows(found, "event_id") == everything[(number - 1) * 90: number * 90]
    assert rows(ro.alert_page_rollup(c, a, sort, "asc", 2, 30, session_id="b", severity="high"), "event_id") == rows(
        a.where("session_id = 'b' and severity = 'HIGH'").orderBy(*[F.col(k).asc_nulls_first() for k in keys]), "event_id")[30:60]


def test_a_page_reads_its_bins_only(spark, folder):
    """Neither an exchange of alerts nor a scan without the bounds of the page's bins."""
    c, a = stored(spark, folder)
    page = ro.alert_page_rollup(c, a, "processed_at", "asc", 5, 50)
    plan = page._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Exchange" not in plan and "GreaterThanOrEqual(processed_at" in plan and "LessThan(processed_at" in plan
    assert ro.alert_page_rollup(c.limit(0), a, "severity", "asc", 1, 50).count() == 0
    with pytest.raises(ValueError, match="not counted"):
        ro.alert_page_rollup(c, a, "source_ip")


def test_search_by_dictionary_equals_search(spark, folder):
    c, a = stored(spark, folder)
    late = {"severity": "low", "date_to": START + timedelta(hours=30)}
    for text, options in (("A", {}), ("type1", late), ("IGH", {"session_id": "b"}), ("%", {}), ("", late), ("TYPE", {})):
        expected = sorted(rows(al.alert_search(a, text, **options), "session_id", "event_id"))
        assert sorted(rows(ro.alert_search_rollup(c, a, text, **options), "session_id", "event_id")) == expected
        assert sorted(rows(ro.alert_search_rollup(c, a, text, 1, **options), "session_id", "event_id")) == expected
    plan = ro.alert_search_rollup(c, a, "type1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(attack_type,type1)" in plan or "In(attack_type, [type1])" in plan
