from datetime import date, datetime, timedelta, timezone
from pathlib import Path

import pytest
from frames import rows
from pyspark.sql import functions as F

from flowlens.operators import models as mo
from flowlens.operators import scoring as sc
from flowlens.schemas import UNSW_FEATURES
from flowlens.sources import alert_table as at
from flowlens.sources import flows as fl
from flowlens.sources import streams as ss
from flowlens.streaming import detect as de

UTC = timezone.utc


def flow_frame(spark, n, start=0):
    """Flows whose duration alone decides attack or not."""
    base = spark.range(start, start + n).select(F.col("id").cast("double").alias("id"))
    features = [F.when(F.col("id") % 3 == 0, 5.0).otherwise(0.0).alias("dur")]
    features += [(F.col("id") % (i + 2)).alias(f) for i, f in enumerate(UNSW_FEATURES) if f != "dur"]
    return base.select("id", *features, F.lit("tcp").alias("proto"), F.lit(None).cast("string").alias("service"))


@pytest.fixture(scope="module")
def detector(spark):
    train = flow_frame(spark, 300).withColumn("binary_label", (F.col("dur") > 1).cast("double")).withColumn(
        "multiclass_label", F.when(F.col("dur") > 1, 3.0 + F.col("id") % 2).otherwise(0.0))
    return sc.Detector(
        mo.train_gbt_binary(train, UNSW_FEATURES, weight=None, prefix=sc.BINARY, maxIter=2, maxDepth=2),
        mo.train_rf_multiclass(train, UNSW_FEATURES, "multiclass_label", None, prefix=sc.MULTI, numTrees=3, maxDepth=3))


def put(spark, folder, n, start=0, extra=()):
    """Append messages to the replay folder."""
    df = fl.flows_to_json(flow_frame(spark, n, start)).select("value").coalesce(1)
    if extra:
        df = df.unionByName(spark.createDataFrame([(v,) for v in extra], "value string"))
    df.write.mode("append").text(folder)


def run(spark, folder, out, detector, checkpoint, max_files=None, session="s1", log=None):
    stream = ss.read_flow_stream_files(spark, folder, max_files)
    return de.run_detection(spark, stream, "unsw", detector, [de.alert_sink(out, session)], session, log, checkpoint,
                            every=None)


def test_stream_equals_batch_and_restart_adds_nothing(spark, folder, detector):
    source, out, checkpoint, log = (f"{folder}/{n}" for n in ("in", "out", "check", "log"))
    put(spark, source, 60, extra=['{"broken": ', "not json"])
    put(spark, source, 30, start=60)
    run(spark, source, out, detector, checkpoint, max_files=1, log=log)
    stored = at.read_alerts(spark, out)
    batch = de.detect(spark.read.text(source), "unsw", detector).where("is_attack")
    columns = ["attack_type", "severity", "binary_prediction", "multiclass_prediction", "proto"]
    assert sorted(rows(stored, *columns)) == sorted(rows(batch, *columns))
    assert stored.count() == 30
    assert stored.select("batch_id").distinct().count() == 2
    assert stored.where("inserted_at is null or kafka_timestamp is null or prediction_score < 0.5").count() == 0

    run(spark, source, out, detector, checkpoint)
    assert at.read_alerts(spark, out).count() == 30
    put(spark, source, 30, start=90)
    run(spark, source, out, detector, checkpoint)
    assert at.read_alerts(spark, out).count() == 40
    states = at.S.session_states(at.read_session_log(spark, log)).collect()
    assert [(r["session_id"], r["status"], r["metadata"]) for r in states] == [("s1", "ended", {"data_source": "unsw"})]


def test_failing_sink_fails_the_stream_and_ends_the_session(spark, folder, detector):
    put(spark, f"{folder}/in", 6)

    def broken(batch, batch_id):
        raise RuntimeError("disk full")

    stream = ss.read_flow_stream_files(spark, f"{folder}/in")
    with pytest.raises(Exception, match="disk full"):
        de.run_detection(spark, stream, "unsw", detector, [de.alert_sink(f"{folder}/out", "x"), broken], "x",
                         f"{folder}/log", f"{folder}/check", every=None)
    assert at.S.session_info(at.read_session_log(spark, f"{folder}/log"), "x").first()["status"] == "ended"
    # The repeated batch replaces what the failed attempt already stored.
    run(spark, f"{folder}/in", f"{folder}/out", detector, f"{folder}/check", session="x")
    assert at.read_alerts(spark, f"{folder}/out").count() == 2


def test_one_batch_feeds_every_sink(spark, folder, detector, capsys):
    put(spark, f"{folder}/in", 9)
    seen = []
    sinks = [de.alert_sink(f"{folder}/out", "s"), lambda batch, i: seen.append(batch.count()), de.console_sink()]
    scored = de.detect(ss.read_flow_stream_files(spark, f"{folder}/in"), "unsw", detector)
    de.start_sinks(scored, sinks, f"{folder}/check", every=None).awaitTermination()
    assert seen == [9] and at.read_alerts(spark, f"{folder}/out").count() == 3


def test_one_read_parts_messages_and_accounts_for_them(spark, folder, detector):
    broken = ['{"broken": ', "not json", "", "not json"]
    put(spark, f"{folder}/in", 9, extra=broken)
    put(spark, f"{folder}/in", 3, start=9)
    query = run(spark, f"{folder}/in", f"{folder}/out", detector, f"{folder}/check", max_files=1)
    assert sum(p["numInputRows"] for p in query.recentProgress) == 12 + len(broken)
    found = de.read_accounts(spark, f"{folder}/check-accounts")
    assert found.count() == len({r["batch_id"] for r in found.collect()}) > 1
    assert rows(found.groupBy().sum("sent", "parsed", "rejected", "attacks")) == [(16, 12, 4, 4)]
    assert found.where("sent <> parsed + rejected").count() == 0
    rejects = de.read_rejects(spark, f"{folder}/check-rejects")
    assert sorted(r["value"] for r in rejects.collect()) == sorted(broken)
    run(spark, f"{folder}/in", f"{folder}/out", detector, f"{folder}/check")
    assert de.read_accounts(spark, f"{folder}/check-accounts").count() == found.count()


def test_failing_reject_sink_ends_the_run(spark, folder, detector):
    put(spark, f"{folder}/in", 6, extra=["broken"])
    Path(f"{folder}/file").write_text("in the way")
    stream = ss.read_flow_stream_files(spark, f"{folder}/in")
    with pytest.raises(Exception):
        de.run_detection(spark, stream, "unsw", detector, [de.alert_sink(f"{folder}/out", "x")], "x",
                         checkpoint=f"{folder}/check", rejects=f"{folder}/file", every=None)
    assert at.read_alerts(spark, f"{folder}/out").count() == 0
    run(spark, f"{folder}/in", f"{folder}/out", detector, f"{folder}/check", session="x")
    assert at.read_alerts(spark, f"{folder}/out").count() == 2


def test_routing_equals_parsing_apart(spark):
    from flowlens.schemas import stream_schema
    from flowlens.streaming import messages as me

    schema = stream_schema("unsw")
    df = spark.createDataFrame([('{"dur": 1}', 1), ("x", 2), (None, 3), ('{"other": 1}', 4), ("", 5), ('{"dur": "y"}', 6)],
                               "value string, n int")
    routed = me.route_flow_json(df, schema)
    assert rows(me.accepted_flows(routed), "dur", "n") == rows(me.parse_flow_json(df, schema), "dur", "n") == [(1.0, 1)]
    assert rows(me.rejected_messages(routed), "n") == [(n,) for n in (2, 3, 4, 5, 6)]
    assert routed.where(me.is_accepted()).count() + me.rejected_messages(routed).count() == df.count()


def alert_stream(spark, folder, parts, run_part):
    """Files that come one by one, each followed by a run that drains the source."""
    schema = "id int, kafka_timestamp timestamp, is_attack boolean, severity string"
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_part(spark.readStream.schema(schema).parquet(f"{folder}/in"))


def test_timeline_updates_take_late_alerts_into_few_files(spark, folder):
    def part(n, hour, day=1):
        return [(i, datetime(2024, 1, day, hour, i), True, "HIGH" if i % 2 else "LOW") for i in range(n)]

    parts = [part(3, 10), part(2, 12), part(1, 3, day=9), part(4, 10), part(2, 12), [(0, datetime(2024, 1, 1), False, "NONE")]]
    out, check = f"{folder}/out", f"{folder}/check"
    alert_stream(spark, folder, parts, lambda stream: de.write_timeline_updates(
        stream, out, check, every=None).awaitTermination())
    assert rows(de.read_timeline_updates(spark, out).orderBy("timestamp")) == [
        (datetime(2024, 1, 1, 10), 7, 3), (datetime(2024, 1, 1, 12), 4, 2), (datetime(2024, 1, 9, 3), 1, 0)]
    assert len(files(out)) == 2  # days, not batches
    again = spark.createDataFrame([(datetime(2024, 1, 1, 12), 4, 2)], "timestamp timestamp, count long, high_severity_count long")
    before = sorted(rows(de.read_timeline_updates(spark, out)))
    de.upsert_timeline(spark, out, again)
    assert sorted(rows(de.read_timeline_updates(spark, out))) == before
    assert de.read_timeline_updates(spark, f"{folder}/none").count() == 0


def test_redelivered_messages_come_once(spark, folder):
    """A key that comes again in the same or a later batch, after a restart too; rows without a key stay."""
    schema = "key string, value string, timestamp timestamp"
    noon = datetime(2024, 1, 1, 12)
    parts = [[("a", "1", noon), ("a", "1", noon), ("b", "2", noon), (None, "3", noon), (None, "4", noon)],
             [("a", "1", noon + timedelta(minutes=9)), ("c", "5", noon + timedelta(minutes=9)), (None, "3", noon + timedelta(minutes=9))],
             [("b", "2", noon + timedelta(minutes=11)), (None, "3", noon)]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        (de.drop_redelivered(stream, ["key"]).writeStream.format("parquet").option("path", f"{folder}/out")
         .option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start().awaitTermination())
    found = sorted((r["key"] or "", r["value"]) for r in spark.read.schema(schema).parquet(f"{folder}/out").collect())
    assert found == [("", "3"), ("", "3"), ("", "4"), ("a", "1"), ("b", "2"), ("c", "5")]


def test_alert_messages(spark, detector):
    messages = fl.flows_to_json(flow_frame(spark, 6)).withColumn("timestamp", F.lit(datetime(2024, 1, 1)))
    found = de.alert_messages(de.detect(messages, "unsw", detector))
    assert found.columns == ["value"] and found.count() == 2
    schema = "kafka_timestamp timestamp, is_attack boolean, attack_type string, severity string, processed_at timestamp"
    body = found.select(F.from_json("value", schema).alias("b")).select("b.*").first()
    assert body["is_attack"] and body["severity"] in ("HIGH", "MEDIUM") and body["processed_at"] is not None


def test_cic_names_reach_the_model(spark):
    df = spark.createDataFrame([('{"Flow Bytes/s": "Infinity", "Fwd Header Length.1": 2, "Source IP": "10.0.0.9"}',)],
                               "value string")
    found = de.detect(df, "cicids2017", sc.Detector(class_space="cic_unified", cascade=False))
    row = found.first()
    assert row["Flow_Bytes_per_s"] == 0.0 and row["Fwd_Header_Length_dot_1"] == 2.0 and row["Idle_Min"] == 0.0
    assert row["Source_IP"] == "10.0.0.9" and row["severity"] == "NONE"


def test_timeline_closes_bins_behind_the_watermark(spark, folder):
    def alert(i, at_):
        return (i, at_, True, "HIGH" if i % 2 else "LOW")

    schema = "id int, kafka_timestamp timestamp, is_attack boolean, severity string"
    first = [alert(i, datetime(2024, 1, 1, 10, m)) for i, m in enumerate([0, 5, 59])]
    later = [alert(9, datetime(2024, 1, 1, 12, 30))]
    late = [alert(11, datetime(2024, 1, 1, 10, 30))]
    out, check = f"{folder}/out", f"{folder}/check"
    for part in (first, later, late):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        (de.stream_timeline(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", check)
         .trigger(availableNow=True).start().awaitTermination())
    assert rows(spark.read.parquet(out)) == [(datetime(2024, 1, 1, 10), 3, 1)]


# The stored table --------------------------------------------------------

def scored(spark, n, when, session_attacks=True):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.lit(session_attacks).alias("is_attack"), F.lit("DoS").alias("attack_type"),
        F.lit("MEDIUM").alias("severity"), F.lit(1.0).alias("binary_prediction"),
        F.lit(4.0).alias("multiclass_prediction"), F.lit(0.9).alias("prediction_score"),
        F.lit(when).cast("timestamp").alias("processed_at"), F.lit("10.0.0.1").alias("Source_IP"))


def files(folder):
    return {p: p.stat().st_mtime_ns for p in Path(folder).rglob("*.parquet")}


def test_replaying_a_batch_replaces_it(spark, folder):
    # A replay after midnight stamps another day.
    at.write_alert_batch(scored(spark, 5, datetime(2024, 1, 1, 23, 59)), folder, "s", 7)
    at.write_alert_batch(scored(spark, 5, datetime(2024, 1, 2, 0, 1)), folder, "s", 7)
    found = at.read_alerts(spark, folder)
    assert found.count() == 5 and {r["alert_date"] for r in found.collect()} == {date(2024, 1, 2)}
    assert "source_ip" in found.columns and "Source_IP" not in found.columns


def test_only_attacks_are_stored(spark, folder):
    at.write_alert_batch(scored(spark, 5, datetime(2024, 1, 1), False), folder + "/a", "s", 0)
    at.write_alert_batch(scored(spark, 2, datetime(2024, 1, 1)), folder + "/a", "s", 1)
    assert at.read_alerts(spark, folder + "/a").count() == 2


def test_a_table_without_alerts_is_empty(spark, folder):
    assert at.read_alerts(spark, folder + "/none").count() == 0
    at.write_alert_batch(scored(spark, 5, datetime(2024, 1, 1), False), folder + "/quiet", "s", 0)
    assert at.read_alerts(spark, folder + "/quiet").count() == 0


def test_bad_alerts_fail_the_batch(spark, folder):
    bad = scored(spark, 1, datetime(2024, 1, 1)).withColumn("severity", F.lit("SEVERE"))
    with pytest.raises(Exception, match="unknown severity"):
        at.write_alert_batch(bad, folder, "s", 0)


def test_time_filter_skips_days(spark, folder):
    from flowlens.operators.alerts import relative_range

    for day in (1, 2, 3):
        at.write_alert_batch(scored(spark, 4, datetime(2024, 1, day, 12)), folder, "s", day)
    recent = relative_range(at.read_alerts(spark, folder), "24h", datetime(2024, 1, 3, 18, tzinfo=UTC))
    assert recent.count() == 4
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(alert_date" in plan and "2024-01-02" in plan


def test_append_and_export(spark, folder):
    at.append_alerts(scored(spark, 3, datetime(2024, 1, 1)), folder + "/t", "s")
    at.append_alerts(scored(spark, 2, datetime(2024, 1, 2)), folder + "/t", "s")
    at.append_alerts(scored(spark, 0, datetime(2024, 1, 2)), folder + "/t", "s")
    table = at.read_alerts(spark, folder + "/t")
    assert table.count() == 5 and {r["batch_id"] for r in table.collect()} == {-1}
    export = at.export_alerts(table, 4, severity="medium", tie_break="event_id")
    assert export.columns == ["processed_at", "attack_type", "severity", "session_id", "prediction", "prediction_score"]
    at.write_export(export, folder + "/csv", "csv")
    at.write_export(export, folder + "/json", "json")
    assert spark.read.option("header", True).csv(folder + "/csv").count() == 4
    assert spark.read.json(folder + "/json").first()["severity"] == "MEDIUM"
    with pytest.raises(ValueError):
        at.write_export(export, folder + "/x", "xml")


@pytest.mark.parametrize("name", ["00123456", "1234e567", "2024-01-01", "a.b_c-d"])
def test_session_ids_stay_text(spark, folder, name):
    at.write_alert_batch(scored(spark, 2, datetime(2024, 1, 1)), folder, name, 0)
    assert {r["session_id"] for r in at.read_alerts(spark, folder).collect()} == {name}
    assert at.clear_session_alerts(spark, folder, name) == 2


@pytest.mark.parametrize("name", ["a/b", "*", "", "..", "a=b"])
def test_unusable_session_ids(spark, folder, name):
    with pytest.raises(ValueError):
        at.write_alert_batch(scored(spark, 1, datetime(2024, 1, 1)), folder, name, 0)


def test_reading_a_period_lists_its_days_only(spark, folder):
    for day in (1, 2, 3):
        at.write_alert_batch(scored(spark, day, datetime(2024, 1, day, 12)), folder, "s", day)
    some = at.read_alerts(spark, folder, since=datetime(2024, 1, 2, 18), until=datetime(2024, 1, 2, 23))
    assert some.count() == 2 and all("2024-01-02" in f for f in some.inputFiles())
    assert at.read_alerts(spark, folder, since=datetime(2024, 1, 2)).count() == 5
    assert at.read_alerts(spark, folder, since=datetime(2024, 2, 1)).count() == 0


def test_two_sessions_write_at_once(spark, folder):
    from concurrent.futures import ThreadPoolExecutor

    def write(n):
        at.write_alert_batch(scored(spark, 20, datetime(2024, 1, 1)), folder, f"s{n % 3}", n)

    with ThreadPoolExecutor(6) as pool:
        list(pool.map(write, range(12)))
    assert at.read_alerts(spark, folder).count() == 240


def test_levels_of_another_policy(spark, folder):
    critical = scored(spark, 2, datetime(2024, 1, 1)).withColumn("severity", F.lit("CRITICAL"))
    de.alert_sink(folder, "s", severities=["CRITICAL", "HIGH"])(critical, 0)
    assert at.read_alerts(spark, folder).count() == 2


def test_clearing_one_session_leaves_the_other_alone(spark, folder):
    at.write_alert_batch(scored(spark, 5, datetime(2024, 1, 1)), folder, "a", 0)
    at.write_alert_batch(scored(spark, 3, datetime(2024, 1, 1)), folder, "b", 0)
    at.write_alert_batch(scored(spark, 2, datetime(2024, 1, 2)), folder, "a", 1)
    before = {p: t for p, t in files(folder).items() if "session_id=b" in str(p)}
    assert at.clear_session_alerts(spark, folder, "a") == 7
    assert at.clear_session_alerts(spark, folder, "a") == 0 and at.clear_session_alerts(spark, folder, "") == 0
    assert files(folder) == before and at.read_alerts(spark, folder).count() == 3


def test_old_alerts_are_deleted_to_the_minute(spark, folder):
    now = datetime(2024, 2, 1, 12, tzinfo=UTC)
    cutoff = now - timedelta(days=30)
    moments = [cutoff - timedelta(days=2), cutoff - timedelta(minutes=1), cutoff, cutoff + timedelta(minutes=1), now]
    for i, moment in enumerate(moments):
        at.write_alert_batch(scored(spark, 2, moment), folder, "s", i)
    at.write_alert_batch(scored(spark, 4, cutoff - timedelta(days=9)), folder, "t", 9)
    mixed = scored(spark, 2, moments[1]).unionByName(scored(spark, 3, moments[3]))
    at.write_alert_batch(mixed, folder, "t", 0)
    assert sum("session_id=s/batch_id=3" in str(p) for p in files(folder)) > 0
    untouched = {p: t for p, t in files(folder).items()
                 if "alert_date=2024-02-01" in str(p) or "session_id=s/batch_id=3" in str(p)}
    assert at.delete_old_alerts(spark, folder, 30, now) == 10
    left = at.read_alerts(spark, folder)
    assert left.count() == 9 and left.where(F.col("processed_at") < F.lit(cutoff)).count() == 0
    assert untouched.items() <= files(folder).items()
    assert at.delete_old_alerts(spark, folder, 30, now) == 0


def test_sessions_on_disk(spark, folder):
    table, log = f"{folder}/t", f"{folder}/log"
    first = at.register_session(spark, log, metadata={"data_source": "unsw"}, at=datetime(2024, 1, 1, tzinfo=UTC))
    second = at.register_session(spark, log, "second", at=datetime(2024, 1, 2, tzinfo=UTC))
    at.write_alert_batch(scored(spark, 5, datetime(2024, 1, 1)), table, first, 0)
    assert at.end_session(spark, log, first) and not at.end_session(spark, log, "unknown")
    assert at.delete_session(spark, table, log, first) == {
        "session_id": first, "alerts_deleted": 5, "session_deleted": True}
    assert at.delete_session(spark, table, log, "unknown") == {
        "session_id": "unknown", "alerts_deleted": 0, "session_deleted": False}
    assert [r["session_id"] for r in at.S.sessions(at.read_session_log(spark, log)).collect()] == [second]
    with pytest.raises(ValueError):
        at.delete_session(spark, table, log, "")
    at.write_alert_batch(scored(spark, 4, datetime(2024, 1, 1)), table, second, 0)
    assert at.delete_all_sessions(spark, table, log) == {"alerts_deleted": 4, "sessions_deleted": 1}
    assert at.read_session_log(spark, log).count() == 0


# Compaction --------------------------------------------------------------

def stored(spark, path):
    return sorted(rows(at.read_alerts(spark, path), "processed_at", "severity", "session_id"))


def test_compaction_keeps_rows_and_finishes_interrupted_runs(spark, folder, monkeypatch):
    path, day = folder + "/alerts", datetime(2024, 1, 2)
    for batch, session in ((0, "a"), (1, "a"), (2, "b"), (3, "a")):
        at.write_alert_batch(scored(spark, 6, datetime(2024, 1, 1 + batch // 3, 12, batch)), path, session, batch)
    before = stored(spark, path)
    at.compact_alerts(spark, path, datetime(2024, 1, 5), datetime(2024, 1, 6))
    assert stored(spark, path) == before

    def fail(*_):
        raise OSError("lost")
    monkeypatch.setattr(at, "delete_all", fail)
    with pytest.raises(OSError):
        at.compact_alerts(spark, path, datetime(2024, 1, 1), datetime(2024, 1, 1))
    monkeypatch.undo()
    at.write_alert_batch(scored(spark, 3, datetime(2024, 1, 1, 13)), path, "b", 9)
    at.compact_alerts(spark, path, day, day)
    later = stored(spark, path)
    assert len(later) == len(before) + len(rows(at.read_alerts(spark, path).where("batch_id = 9")))
    assert {r[0] for r in at.read_alerts(spark, path).select("batch_id").collect()} == {at.COMPACTED, 9}
    at.compact_alerts(spark, path, datetime(2024, 1, 1), day)
    assert stored(spark, path) == later
    found = at.read_alerts(spark, path)
    assert {r[0] for r in found.select("batch_id").collect()} == {at.COMPACTED}
    assert len(found.inputFiles()) == found.select("session_id", "alert_date").distinct().count()
    for file in found.inputFiles():
        kinds = rows(spark.read.parquet(file).select("severity", "attack_type"))
        assert kinds == sorted(kinds)


def test_only_first_and_failed_batches_look_for_leftovers(spark, folder, monkeypatch):
    looked = []
    monkeypatch.setattr(at, "write_alert_batch", lambda *a, replayed: looked.append(replayed) or (len(looked) == 3 and 1 / 0))
    sink = de.alert_sink(folder, "s")
    for batch in (4, 5, 6, 6, 7, 7):
        try:
            sink(None, batch)
        except ZeroDivisionError:
            pass
    assert looked == [True, False, False, True, False, True]
