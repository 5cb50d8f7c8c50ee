import gzip
import json
import re
from pathlib import Path

import pytest
from frames import rows
from pyspark.sql import functions as F, types as T

from flowlens import schemas
from flowlens.operators import labeling as la
from flowlens.operators import scoring as sc
from flowlens.plans import training as tr
from flowlens.plans.preprocess import RECIPES, Recipe, harmonize_processed, preprocess, preprocess_folder, write_prepared
from flowlens.sources import flows as fl
from flowlens.sources import models as sm
from flowlens.sources import storage as st
from flowlens.sources import streams as ss
from flowlens.streaming import messages as me


def write(folder, name, text):
    path = Path(folder) / name
    path.write_text(text)
    return str(path)


SCHEMA = T.StructType([T.StructField("Flow Bytes/s", T.DoubleType()), T.StructField("Total Fwd Packets", T.DoubleType()),
                       T.StructField("Label", T.StringType())])


def test_csv_by_name(spark, folder, caplog):
    a = write(folder, "a.csv", "Flow Bytes/s, Label,Total Fwd Packets\nInfinity,BENIGN,3\nNaN,Bot,4\n")
    b = write(folder, "b.csv", "Flow ID,Total Fwd Packets,Flow Bytes/s,Label\nx,5,1.5,DDoS\n")
    found = fl.read_flow_csv(spark, [a, b, f"{folder}/no.csv"], SCHEMA, drop=["Flow ID"])
    assert "no.csv" in caplog.text
    assert set(found.columns) == {"Flow Bytes/s", "Total Fwd Packets", "Label"}
    assert sorted(rows(found.select(F.col("`Flow Bytes/s`").cast("string"), "Total Fwd Packets", "Label"))) == [
        ("1.5", 5.0, "DDoS"), ("Infinity", 3.0, "BENIGN"), ("NaN", 4.0, "Bot")]


def test_files_with_one_header_are_one_scan(spark, folder):
    paths = [write(folder, f"{i}.csv", f"Label,Flow Bytes/s\nx,{i}\n") for i in range(4)]
    found = fl.read_flow_csv(spark, paths, SCHEMA)
    assert found.count() == 4
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1


def test_headers_take_no_job_of_their_own(spark, folder):
    """As many jobs for 2,000 files as for 80, names with blanks and percent signs included."""
    def opened(n):
        Path(f"{folder}/{n}").mkdir()
        for i in range(n):
            write(f"{folder}/{n}", f"part %20 {i}.csv", ("Label,Flow Bytes/s\nx,1\n" if i % 2 else "Flow Bytes/s,Label\n1,x\n"))
        write(f"{folder}/{n}", "empty.csv", "")
        spark.sparkContext.setJobGroup(f"open{n}", "")
        found = fl.read_flow_csv(spark, f"{folder}/{n}", SCHEMA)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return found, len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"open{n}"))

    few, jobs_of_few = opened(80)
    many, jobs_of_many = opened(2_000)
    assert jobs_of_many == jobs_of_few <= 8
    assert rows(many.groupBy("Label", "Flow Bytes/s").count()) == [("x", 1.0, 2_000)] and few.count() == 80


def test_only_the_first_line_of_a_file_is_read(spark, folder):
    """A header group keeps the order of its files; long files are not split for their headers."""
    write(folder, "a.csv", "b,a\n" + "1,2\n" * 200_000)
    write(folder, "b.csv", "a,b\n1,2\n")
    write(folder, "c.csv", "b,a\r\n1,2\r\n")
    with gzip.open(f"{folder}/d.csv.gz", "wt") as out:
        out.write("a,b\n1,2\n")
    found = fl._headers(spark, fl._present(spark, folder))
    assert [(line, [f.rsplit("/", 1)[1] for f in files]) for line, files in found] == [
        ("b,a", ["a.csv", "c.csv"]), ("a,b", ["b.csv", "d.csv.gz"])]


def test_no_files_is_an_error(spark, folder):
    with pytest.raises(FileNotFoundError):
        fl.read_flow_csv(spark, [f"{folder}/a.csv", f"{folder}/b.csv"], SCHEMA)


def test_headerless_needs_all_columns(spark, folder):
    good = write(folder, "raw.csv", ",".join(["1"] * 49) + "\n")
    schema = schemas.csv_schema("unsw_raw")
    found = fl.read_flow_csv(spark, good, schema, header=False)
    assert found.columns == schemas.UNSW_RAW_COLUMNS and found.first()["dur"] == 1.0
    bad = write(folder, "bad.csv", ",".join(["1"] * 48) + "\n")
    with pytest.raises(ValueError, match="48 columns"):
        fl.read_flow_csv(spark, bad, schema, header=False)


def test_union_modes(spark, caplog):
    a = spark.createDataFrame([(1, 2)], ["x", "y"])
    b = spark.createDataFrame([(20, 10)], ["y", "x"])
    c = spark.createDataFrame([(5,)], ["x"])
    assert rows(fl.union_flows([a, b])) == [(1, 2), (10, 20)]
    with pytest.raises(ValueError, match="differ"):
        fl.union_flows([a, c])
    assert rows(fl.union_flows([a, c, b], on_mismatch="skip")) == [(1, 2), (10, 20)]
    assert "skipped" in caplog.text
    assert rows(fl.union_flows([a, c], on_mismatch="null")) == [(1, 2), (5, None)]
    assert rows(fl.union_flows([a, c], drop=["y"])) == [(1,), (5,)]


def test_written_tables_are_verified(spark, folder):
    df = spark.range(10)
    fl.write_processed(df, f"{folder}/t", partitions=2)
    assert rows(fl.verify_written(spark, f"{folder}/t", 10)) == [(10, 10, True)]
    assert rows(fl.verify_written(spark, f"{folder}/t", 11)) == [(10, 11, False)]
    assert len(list(Path(f"{folder}/t").glob("part-*"))) <= 2
    assert fl.read_processed(spark, f"{folder}/t").count() == 10


def test_large_tables_get_more_files(spark, folder):
    df = spark.range(0, 400_000, 1, 8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        fl.write_processed(df, f"{folder}/t", partitions=2)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    assert len(list(Path(f"{folder}/t").glob("part-*"))) > 2
    assert fl.read_processed(spark, f"{folder}/t").agg(F.count("id"), F.sum("id")).first() == (400_000, 399_999 * 200_000)


def test_stream_schemas():
    assert len(schemas.CIC_FEATURES) == len(set(schemas.CIC_FEATURES)) == 78
    assert len(schemas.UNSW_FEATURES) == len(set(schemas.UNSW_FEATURES)) == 39
    assert len(schemas.UNSW_RAW_COLUMNS) == 49
    assert len(schemas.stream_schema("unsw").fields) == 1 + 39 + 5
    assert len(schemas.stream_schema("cicids2018").fields) == 78 + 4
    assert "label" not in [n.lower() for n in schemas.stream_schema("unsw").names]
    for make in (schemas.stream_schema, schemas.csv_schema):
        with pytest.raises(ValueError):
            make("other")


# Messages ----------------------------------------------------------------

FLOW = T.StructType([T.StructField("dur", T.DoubleType()), T.StructField("Flow Bytes/s", T.DoubleType()),
                     T.StructField("Fwd Header Length.1", T.DoubleType()), T.StructField("proto", T.StringType())])


def test_parse_and_reject(spark):
    lines = ['{"dur": 1, "Flow Bytes/s": 2.5, "Fwd Header Length.1": 3, "proto": "tcp", "label": 1}',
             '{"proto": "udp"}', '{"dur": ', "", "[1, 2]", '"text"', '{"label": 1}', None, '{"dur": "NaN"}']
    df = spark.createDataFrame([(i, v) for i, v in enumerate(lines)], "n int, value string").coalesce(1)
    found = me.parse_flow_json(df, FLOW)
    assert found.columns == ["dur", "Flow Bytes/s", "Fwd Header Length.1", "proto", "n"]
    assert rows(found)[:2] == [(1.0, 2.5, 3.0, "tcp", 0), (None, None, None, "udp", 1)]
    assert [r["n"] for r in found.collect()] == [0, 1, 8]
    rejected = me.rejected_flow_json(df, FLOW)
    assert [(r["n"], r["value"]) for r in rejected.collect()] == [(i, lines[i]) for i in (2, 3, 4, 5, 6, 7)]


def test_binary_values_and_source_time(spark):
    df = spark.sql("""select cast('{"dur": 4}' as binary) as value, timestamp'2024-01-01 00:00:00' as timestamp,
                   cast('k' as binary) as key""")
    found = me.parse_flow_json(df, FLOW)
    assert found.columns[-1] == "kafka_timestamp" and "key" not in found.columns
    assert found.first()["dur"] == 4.0


def test_messages(spark):
    df = spark.createDataFrame([(1, float("nan"), None, "10.0.0.1", True), (2, float("inf"), "tcp", None, False)],
                               ["n", " rate ", "proto", "Source IP", "flag"]).coalesce(1)
    found = fl.flows_to_json(df, producer_id=3, clock=F.lit("2024-01-01 00:00:00"))
    bodies = [json.loads(r["value"]) for r in found.collect()]
    assert [r["key"] for r in found.collect()] == ["10.0.0.1", None]
    assert bodies[0] == {"n": 1.0, "rate": 0.0, "proto": "0.0", "Source IP": "10.0.0.1", "flag": True,
                         "timestamp": "2024-01-01 00:00:00", "producer_id": 3}
    assert bodies[1]["rate"] == "Infinity" and bodies[1]["proto"] == "tcp"
    spread = fl.flows_to_json(spark.range(500), batch_size=10)
    assert {r["key"] for r in spread.collect()} == {str(i) for i in range(10)}


def test_shuffled_head_does_not_depend_on_partitions(spark):
    df = spark.range(500)
    a = rows(fl.shuffled_head(df, ["id"], 50))
    assert a == rows(fl.shuffled_head(df.repartition(3), ["id"], 50)) and a != [(i,) for i in range(50)]
    assert fl.shuffled_head(df, ["id"]).count() == 500


def test_abbreviated_and_repeated_headers_stay_features(spark, folder):
    from flowlens.operators.columns import feature_columns
    from flowlens.schemas import csv_schema

    (Path(folder) / "day.csv").write_text(
        "Fwd Header Length,Flow Duration,Tot Fwd Pkts,Fwd Header Length,Note,Label\n1,2,3,4,a,Benign\n5,,Infinity,8,,Bot\n")
    (Path(folder) / "more.csv").write_text("tot fwd pkts,Flow Duration,Label\n7,9,Benign\n")
    (Path(folder) / "empty.csv").write_text("")
    found = fl.read_flow_csv(spark, folder, csv_schema("cicids2018"))
    names = ["Fwd Header Length", "Flow Duration", "Tot Fwd Pkts", "Fwd Header Length.1"]
    assert set(names) <= set(feature_columns(found)) and "Note" not in feature_columns(found)
    assert sorted(rows(found, *[f"`{n}`" for n in names[1:3]]), key=str) == sorted(
        [(2.0, 3.0), (None, float("inf")), (9.0, 7.0)], key=str)


def test_kafka_options():
    options = ss.kafka_source_options("host:1", "flows", max_per_trigger=50)
    assert options["maxOffsetsPerTrigger"] == "50" and options["startingOffsets"] == "latest"
    assert options["failOnDataLoss"] == "false" and options["subscribe"] == "flows"
    assert "maxOffsetsPerTrigger" not in ss.kafka_source_options("host:1", "flows", "earliest")


# Storage -----------------------------------------------------------------

def test_shared_folder_is_the_configured_one(spark):
    assert st.shared_folder(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert st.scratch_path(spark, "x").startswith(st.shared_folder(spark) + "/x-")


def test_materialize_prunes_columns(spark):
    copy = st.materialize(spark.range(5).withColumn("b", F.col("id") * 2), "pair")
    assert sorted(rows(copy)) == [(i, 2 * i) for i in range(5)]
    assert "ReadSchema: struct<b:bigint>" in copy.select("b")._jdf.queryExecution().executedPlan().toString()


def test_delete_and_exists(spark, folder):
    spark.range(1).write.parquet(f"{folder}/x")
    assert st.exists(spark, f"{folder}/x") and st.delete(spark, f"{folder}/x")
    assert not st.exists(spark, f"{folder}/x") and not st.delete(spark, f"{folder}/x")


def test_model_preference(spark, folder):
    found = sm.load_detector(spark, folder, "unsw")
    assert (found.binary, found.multiclass, found.cascade, found.class_space) == (None, None, True, "unsw")
    assert sm.load_detector(spark, folder, "cicids2017").cascade is False
    assert sm.PREFERENCE["unsw"]["binary"] == ["unsw_gbt_binary", "unsw_rf_binary"]


def test_trained_suite_serves(spark, folder):
    features = ["dur", "rate"]
    data = [(i, float(i % 10), float(i % 7), ["Normal", "DoS", "Worms"][(i % 10 > 4) + (i % 10 > 7)]) for i in range(300)]
    everything = spark.createDataFrame(data, "id int, dur double, rate double, attack_cat string")
    train, test = everything.where("id < 200 and attack_cat <> 'Worms'"), everything.where("id >= 200")
    train, test = tr.unsw_training_rows(train, test, ["id"], features=features)
    assert train.where("attack_cat = 'Worms'").count() > 0
    small = {"numTrees": 5, "maxDepth": 4}
    results = tr.train_suite(train, test, features, "unsw", folder, {
        "unsw_rf_binary": small, "unsw_gbt_binary": {"maxIter": 2, "maxDepth": 3}, "unsw_multiclass": small})
    accuracy = {r["model"]: r["value"] for r in results.where("metric = 'accuracy'").collect()}
    assert set(accuracy) == {"unsw_rf_binary", "unsw_gbt_binary", "unsw_multiclass"} and min(accuracy.values()) > 0.9
    assert spark.read.json(f"{folder}/unsw_training_results").count() == results.count()

    detector = sm.load_detector(spark, folder, "unsw")
    assert detector.class_space == schemas.CLASS_NAMES["unsw"]
    found = sc.score_and_enrich(test, detector)
    assert found.where("is_attack and attack_type = attack_cat").count() >= 0.9 * test.where("attack_cat <> 'Normal'").count()
    assert sm.load_detector(spark, folder, "unsw", class_space="cic_legacy").class_space == "cic_legacy"
    split = sc.score_and_enrich(test, sc.Detector(
        detector.binary, detector.multiclass, split=True))
    columns = ["id", "attack_type", "severity"]
    assert sorted(rows(split, *columns)) == sorted(rows(found, *columns))


# Preprocessing -----------------------------------------------------------

def test_preprocess_cic(spark, folder):
    raw = spark.createDataFrame([
        (1.0, float("inf"), None, " BENIGN", "a"), (1.0, float("inf"), None, " BENIGN", "a"),
        (2.0, float("nan"), None, "Bot", "b"), (3.0, 4.0, 1.0, "Benign", "c"), (4.0, 8.0, None, "Benign", "d")],
        "`Flow Duration` double, ` Flow Bytes/s` double, sparse double, ` Label` string, Timestamp string")
    prepared = preprocess(raw, "cicids2018")
    assert prepared.features == ["flow_duration", "flow_bytes_s"]
    table = prepared.table.orderBy("flow_duration")
    assert rows(table, "flow_duration", "flow_bytes_s", "label", "binary_label", "sample_weight") == [
        (1.0, 0.0, "benign", 0, 1.0), (2.0, 0.0, "bot", 1, 3.0), (3.0, 4.0, "benign", 0, 1.0),
        (4.0, 8.0, "benign", 0, 1.0)]
    assert list(table.first()["scaled_features"]) == pytest.approx([-1.5 / (5 / 3) ** 0.5, -3 / (44 / 3) ** 0.5])
    write_prepared(prepared, folder, "flows")
    assert fl.read_processed(spark, f"{folder}/flows_preprocessed.parquet").count() == 4
    described = {r["class_label"]: r for r in spark.read.json(f"{folder}/flows_metadata").collect()}
    assert described["benign"]["class_rows"] == 3 and described["bot"]["total_features"] == 2


def test_preprocess_unsw(spark):
    raw = spark.createDataFrame([
        (1, "10.0.0.1", 0.5, 2, "tcp", None, "FIN", None, 0), (2, "10.0.0.2", 0.5, 2, "tcp", None, "FIN", None, 0),
        (3, "10.0.0.3", 0.7, 5, "udp", "dns", "CON", " Exploits", 1)],
        "id int, srcip string, dur double, spkts int, proto string, service string, state string, attack_cat string, label int")
    prepared = preprocess(raw, "unsw")
    table = prepared.table.orderBy("dur")
    assert prepared.features == ["dur", "spkts"]
    assert rows(table, "dur", "spkts", "label", "binary_label", "label_text", "attack_cat", "proto_indexed",
                "sample_weight") == [
        (0.5, 2, 0, 0, "normal", None, 0.0, 1.0), (0.7, 5, 1, 1, "exploits", "exploits", 1.0, 1.0)]


def test_preprocess_without_a_binary_column(spark):
    raw = spark.createDataFrame([(1.0, "Normal"), (2.0, "Worms")], "dur double, attack_cat string")
    assert sorted(rows(preprocess(raw, "unsw").table, "dur", "label", "binary_label")) == [(1.0, 0, 0), (2.0, 1, 1)]


def test_preprocess_with_means(spark):
    raw = spark.createDataFrame([
        (1, 1.0, "tcp", "Normal", 0), (2, float("inf"), "udp", "Worms", 1), (3, 3.0, "udp", "Worms", 1),
        (4, None, None, "Worms", 1)], "id int, dur double, proto string, attack_cat string, label int")
    prepared = preprocess(raw, "unsw_mean")
    assert prepared.features == ["dur", "proto"]
    assert rows(prepared.table.orderBy("proto", "dur"), "dur", "proto", "binary_label", "sample_weight") == [
        (2.0, 0.0, 1, 1.0), (3.0, 0.0, 1, 1.0), (1.0, 1.0, 0, 3.0), (2.0, 2.0, 1, 1.0)]
    cic = spark.createDataFrame([(1.0, "BENIGN"), (2.0, "benign")], "`Flow Duration` double, Label string")
    assert sorted(rows(preprocess(cic, "cicids2017_mean").table, "label", "binary_label")) == [("BENIGN", 0), ("benign", 1)]


def test_published_files_to_a_harmonised_table(spark, folder):
    for name in ("cicids2017", "cicids2018"):
        (Path(folder) / name).mkdir()
    head = "Destination Port,Flow Duration,Flow Bytes/s, Label"
    write(folder, "cicids2017/Monday-WorkingHours.pcap_ISCX.csv", head + "\n80,1,2.5,BENIGN\n80,1,2.5,BENIGN\n22,3,NaN,SSH-Patator\n")
    write(folder, "cicids2017/Friday-WorkingHours-Morning.pcap_ISCX.csv", head + "\n443,5,1.5,Bot\n")
    write(folder, "cicids2018/02-14-2018.csv", "Destination Port,Timestamp,Flow Duration,Flow Bytes/s,Label\n80,now,7,Infinity,Benign\n")
    write(folder, "cicids2018/02-20-2018.csv", "Flow ID,Src IP,Src Port,Dst IP,Destination Port,Timestamp,Flow Duration,Flow Bytes/s,Label\n"
          "f,10.0.0.1,5,10.0.0.2,21,now,9,4,DDOS attack-LOIC-UDP\n")
    for name in ("cicids2017", "cicids2018"):
        preprocess_folder(spark, f"{folder}/{name}", f"{folder}/out", name)
    merged = harmonize_processed(spark, f"{folder}/out", f"{folder}/out")
    assert sorted(rows(merged, "label", "unified_label", "binary_label", "dataset_source", "multiclass_weight")) == [
        ("benign", 0, 0, "cicids2017", 1.0), ("benign", 0, 0, "cicids2018", 1.0), ("bot", 6, 1, "cicids2017", 2.0),
        ("ddos attack-loic-udp", 2, 1, "cicids2018", 2.0), ("ssh-patator", 3, 1, "cicids2017", 2.0)]
    described = {r["class_name"]: r["class_rows"] for r in spark.read.json(
        f"{folder}/out/cicids_merged_harmonized_metadata").collect()}
    assert described == {"Benign": 2, "Botnet": 1, "DDoS": 1, "Brute_Force": 1}


def test_raw_unsw_files_are_skipped_when_columns_differ(spark, folder, caplog):
    names = ["id", *schemas.UNSW_FEATURES, "proto", "service", "state", "attack_cat", "label"]
    write(folder, "UNSW_NB15_training-set.csv", ",".join(names) + "\n" + ",".join(["1"] * len(names)) + "\n")
    write(folder, "UNSW-NB15_1.csv", ",".join(["1"] * 49) + "\n")
    assert fl.read_dataset(spark, folder, "unsw").count() == 1
    assert "skipped" in caplog.text
    with pytest.raises(FileNotFoundError):
        fl.read_dataset(spark, folder + "/none", "unsw")


def test_recipes_name_known_datasets():
    assert {name.removesuffix("_mean") for name in RECIPES} == set(la.LABEL_SPACES)
    assert all(isinstance(r, Recipe) and r.name == name for name, r in RECIPES.items())


def test_malformed_lines_are_set_apart(spark, folder):
    with open(f"{folder}/a.csv", "w") as out:
        out.write("n,x,extra\n1,1.5,a\nxx,2.5,b\n3,3.5\n4,4.5,d,e\n5,,f\n")
    with open(f"{folder}/b.csv", "w") as out:
        out.write("x,n\n9.5,9\n1.0.0,2\n")
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("x", T.DoubleType())])
    kept, rejects = fl.read_flow_csv_checked(spark, folder, schema)
    assert sorted(rows(kept, "n", "x", "extra"), key=str) == [(1, 1.5, "a"), (5, None, "f"), (9, 9.5, None)]
    assert sorted(r["line"] for r in rejects.collect()) == ["1.0.0,2", "3,3.5", "4,4.5,d,e", "xx,2.5,b"]
    assert {r["file"].rsplit("/", 1)[1] for r in rejects.collect()} == {"a.csv", "b.csv"}
    assert kept.count() + rejects.count() == 7
    assert kept.select("n").count() == 3  # whichever columns are used


def test_unlisted_columns_lose_nothing(spark, folder):
    table = {"id": ["1700000000123456789", "1700000000123456788"], "code": ["00123", "7"], "rate": ["1.50", "-2e3"],
             "mixed": ["9007199254740993", "0.5"], "suffix": ["12d", "3f"], "spaced": [" 5", "6 "], "odd": ["NaN", "1"],
             "long_digits": ["0.12345678901234567891", "1.0"], "empty": ["", ""]}
    with open(f"{folder}/a.csv", "w") as out:
        out.write(",".join(table) + "\n" + "".join(",".join(v[n] for v in table.values()) + "\n" for n in range(2)))
    found = fl.read_flow_csv(spark, folder, T.StructType([]))
    assert dict(found.dtypes) == {"id": "bigint", "code": "string", "rate": "double", "mixed": "string", "suffix": "string",
                                  "spaced": "bigint", "odd": "double", "long_digits": "string", "empty": "string"}
    assert {r["id"] for r in found.collect()} == {1700000000123456789, 1700000000123456788}


def test_unlisted_numbers_at_the_ends_of_their_types(spark, folder):
    table = {"least": ["-9223372036854775808", "9223372036854775807"], "whole": ["-9007199254740992", "0.1"],
             "beyond": ["9007199254740993", "1.5E300"], "least_mixed": ["-9223372036854775808", "0.5"],
             "written": ["1.0E10", "-Infinity"], "zero": ["-0", "0.0"], "signed": ["+5", "7"]}
    with open(f"{folder}/a.csv", "w") as out:
        out.write(",".join(table) + "\n" + "".join(",".join(v[n] for v in table.values()) + "\n" for n in range(2)))
    found = fl.read_flow_csv(spark, folder, T.StructType([]))
    assert dict(found.dtypes) == {"least": "bigint", "whole": "double", "beyond": "string", "least_mixed": "string",
                                  "written": "double", "zero": "double", "signed": "double"}
    assert sorted(r["least"] for r in found.collect()) == [-2**63, 2**63 - 1]


def test_casts_are_tried_on_numbers_only(spark, monkeypatch):
    """A cast that fails costs some twenty times one that succeeds; most values of a column may fail."""
    df = spark.createDataFrame([("1.25",), ("2",), ("word",)], "x string")
    plans, agg = [], type(df).agg

    def recorded(self, *checks):
        out = agg(self, *checks)
        plans.append(out._jdf.queryExecution().analyzed().toString())
        return out
    monkeypatch.setattr(type(df), "agg", recorded)
    assert fl._typed(df, ["x"]).dtypes == [("x", "string")]
    tried = [before[-40:] for plan in plans for before in re.split(r"(?i)try_cast\(trim\(x[^)]*\) as bigint\)", plan)[:-1]]
    assert tried and all(before.endswith("THEN ") for before in tried), plans
