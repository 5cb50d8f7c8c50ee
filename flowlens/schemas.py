"""Schemas, feature lists, label spaces and severity policies.

Apart from the small factories at the bottom, this module holds the constants the
rest of the package refers to.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --------------------------------------------------------------------------
# Feature names, label texts, class ids and severity lists. They
# name the columns and labels of the public datasets, so results depend on them.
# --------------------------------------------------------------------------

CIC_FEATURES = [
    "Destination Port", "Flow Duration", "Total Fwd Packets", "Total Backward Packets",
    "Total Length of Fwd Packets", "Total Length of Bwd Packets", "Fwd Packet Length Max",
    "Fwd Packet Length Min", "Fwd Packet Length Mean", "Fwd Packet Length Std",
    "Bwd Packet Length Max", "Bwd Packet Length Min", "Bwd Packet Length Mean",
    "Bwd Packet Length Std", "Flow Bytes/s", "Flow Packets/s", "Flow IAT Mean",
    "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Total", "Fwd IAT Mean",
    "Fwd IAT Std", "Fwd IAT Max", "Fwd IAT Min", "Bwd IAT Total", "Bwd IAT Mean",
    "Bwd IAT Std", "Bwd IAT Max", "Bwd IAT Min", "Fwd PSH Flags", "Bwd PSH Flags",
    "Fwd URG Flags", "Bwd URG Flags", "Fwd Header Length", "Bwd Header Length",
    "Fwd Packets/s", "Bwd Packets/s", "Min Packet Length", "Max Packet Length",
    "Packet Length Mean", "Packet Length Std", "Packet Length Variance", "FIN Flag Count",
    "SYN Flag Count", "RST Flag Count", "PSH Flag Count", "ACK Flag Count",
    "URG Flag Count", "CWE Flag Count", "ECE Flag Count", "Down/Up Ratio",
    "Average Packet Size", "Avg Fwd Segment Size", "Avg Bwd Segment Size",
    "Fwd Header Length.1", "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk",
    "Fwd Avg Bulk Rate", "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk",
    "Bwd Avg Bulk Rate", "Subflow Fwd Packets", "Subflow Fwd Bytes",
    "Subflow Bwd Packets", "Subflow Bwd Bytes", "Init_Win_bytes_forward",
    "Init_Win_bytes_backward", "act_data_pkt_fwd", "min_seg_size_forward",
    "Active Mean", "Active Std", "Active Max", "Active Min", "Idle Mean",
    "Idle Std", "Idle Max", "Idle Min",
]

UNSW_FEATURES = [
    "dur", "spkts", "dpkts", "sbytes", "dbytes", "rate", "sttl", "dttl",
    "sload", "dload", "sloss", "dloss", "sinpkt", "dinpkt", "sjit", "djit",
    "swin", "stcpb", "dtcpb", "dwin", "tcprtt", "synack", "ackdat", "smean",
    "dmean", "trans_depth", "response_body_len", "ct_srv_src", "ct_state_ttl",
    "ct_dst_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
    "is_ftp_login", "ct_ftp_cmd", "ct_flw_http_mthd", "ct_src_ltm", "ct_srv_dst",
    "is_sm_ips_ports",
]

# Column names, by position, of the headerless raw UNSW files.
UNSW_RAW_COLUMNS = [
    "srcip", "sport", "dstip", "dsport", "proto", "state", "dur", "sbytes", "dbytes",
    "sttl", "dttl", "sloss", "dloss", "service", "sload", "dload", "spkts", "dpkts",
    "swin", "dwin", "stcpb", "dtcpb", "smeansz", "dmeansz", "trans_depth",
    "res_bdy_len", "sjit", "djit", "stime", "ltime", "sintpkt", "dintpkt",
    "tcprtt", "synack", "ackdat", "is_sm_ips_ports", "ct_state_ttl", "ct_flw_http_mthd",
    "is_ftp_login", "ct_ftp_cmd", "ct_srv_src", "ct_srv_dst", "ct_dst_ltm",
    "ct_src_ltm", "ct_src_dport_ltm", "ct_dst_sport_ltm", "ct_dst_src_ltm",
    "attack_cat", "label",
]

UNSW_RAW_TEXT_COLUMNS = ["srcip", "sport", "dstip", "dsport", "proto", "state", "service", "attack_cat"]

UNIFIED_LABELS_2017 = {
    "BENIGN": 0,
    "DoS Hulk": 1,
    "DoS GoldenEye": 1,
    "DoS slowloris": 1,
    "DoS Slowhttptest": 1,
    "DDoS": 2,
    "FTP-Patator": 3,
    "SSH-Patator": 3,
    "Web Attack \x96 Brute Force": 4,
    "Web Attack \x96 XSS": 4,
    "Web Attack \x96 Sql Injection": 4,
    "Infiltration": 5,
    "Bot": 6,
    "PortScan": 7,
    "Heartbleed": 8,
}

UNIFIED_LABELS_2018 = {
    "Benign": 0,
    "DoS attacks-Hulk": 1,
    "DoS attacks-GoldenEye": 1,
    "DoS attacks-Slowloris": 1,
    "DoS attacks-SlowHTTPTest": 1,
    "DDoS attack-HOIC": 2,
    "DDoS attacks-LOIC-HTTP": 2,
    "DDOS attack-LOIC-UDP": 2,
    "DDoS attack-LOIC-UDP": 2,
    "FTP-BruteForce": 3,
    "SSH-Bruteforce": 3,
    "Brute Force -Web": 4,
    "Brute Force -XSS": 4,
    "SQL Injection": 4,
    "Infilteration": 5,
    "Bot": 6,
}

UNSW_LABELS = {
    "Normal": 0,
    "Fuzzers": 1,
    "Analysis": 2,
    "Backdoors": 3,
    "Backdoor": 3,
    "DoS": 4,
    "Exploits": 5,
    "Generic": 6,
    "Reconnaissance": 7,
    "Shellcode": 8,
    "Worms": 9,
}

# Class id to class name, one space per model family. "cic_unified" is the space
# the harmonised table trains on; "cic_legacy" is the older serving list whose ids
# 3 to 8 name other classes.
CLASS_NAMES = {
    "cic_unified": {
        0: "Benign", 1: "DoS", 2: "DDoS", 3: "Brute_Force", 4: "Web_Attack",
        5: "Infiltration", 6: "Botnet", 7: "PortScan", 8: "Other",
    },
    "cic_legacy": {
        0: "Benign", 1: "DoS", 2: "DDoS", 3: "PortScan", 4: "BruteForce",
        5: "WebAttack", 6: "Infiltration", 7: "Botnet", 8: "Heartbleed",
    },
    "unsw": {
        0: "Normal", 1: "Fuzzers", 2: "Analysis", 3: "Backdoor", 4: "DoS",
        5: "Exploits", 6: "Generic", 7: "Reconnaissance", 8: "Shellcode", 9: "Worms",
    },
}

# Severity policies: attack type to level, checked in the listed order; "fallback"
# is given to attacks whose type is in no list, everything else is NONE.
SEVERITY_POLICIES = {
    "default": {
        "levels": [
            # "Other" is the unified name of class 8, served elsewhere as Heartbleed.
            ("HIGH", ["Backdoor", "Shellcode", "Worms", "Heartbleed", "Infiltration", "Other"]),
            ("MEDIUM", ["DoS", "DDoS", "Exploits", "Fuzzers", "Analysis", "Generic",
                        "Reconnaissance", "BruteForce", "WebAttack", "Botnet", "PortScan",
                        "Brute_Force", "Web_Attack"]),
        ],
        "fallback": "LOW",
    },
    "graded": {
        "levels": [
            ("CRITICAL", ["Infiltration", "Botnet"]),
            ("HIGH", ["Backdoor", "Shellcode", "Worms"]),
            ("MEDIUM", ["Fuzzers", "DoS", "Exploits", "Generic"]),
            ("LOW", ["Reconnaissance", "Analysis"]),
            ("NONE", ["Normal", "Benign"]),
        ],
        "fallback": "LOW",
    },
    "simulation": {
        "levels": [
            ("HIGH", ["DDoS", "DoS", "Infiltration", "Heartbleed"]),
            ("MEDIUM", ["BruteForce", "WebAttack", "Botnet", "Brute_Force", "Web_Attack"]),
            ("LOW", ["PortScan"]),
        ],
        "fallback": "NONE",
    },
}

IDENTIFIER_COLUMNS = {
    "cicids2017": [],
    "cicids2018": ["flow_id", "src_ip", "src_port", "dst_ip", "timestamp"],
    "unsw": ["srcip", "dstip", "stime", "ltime", "id"],
}

CIC_2018_DROP = ["Flow ID", "Src IP", "Src Port", "Dst IP"]

# File names of the published datasets; the raw UNSW files have no header.
CSV_FILES = {
    "cicids2017": [
        "Monday-WorkingHours.pcap_ISCX.csv",
        "Tuesday-WorkingHours.pcap_ISCX.csv",
        "Wednesday-workingHours.pcap_ISCX.csv",
        "Thursday-WorkingHours-Morning-WebAttacks.pcap_ISCX.csv",
        "Thursday-WorkingHours-Afternoon-Infilteration.pcap_ISCX.csv",
        "Friday-WorkingHours-Morning.pcap_ISCX.csv",
        "Friday-WorkingHours-Afternoon-PortScan.pcap_ISCX.csv",
        "Friday-WorkingHours-Afternoon-DDos.pcap_ISCX.csv",
    ],
    "cicids2018": [
        "02-14-2018.csv", "02-15-2018.csv", "02-16-2018.csv", "02-20-2018.csv", "02-21-2018.csv",
        "02-22-2018.csv", "02-23-2018.csv", "02-28-2018.csv", "03-01-2018.csv", "03-02-2018.csv",
    ],
    "unsw": ["UNSW_NB15_training-set.csv", "UNSW_NB15_testing-set.csv"],
    "unsw_raw": ["UNSW-NB15_1.csv", "UNSW-NB15_2.csv", "UNSW-NB15_3.csv", "UNSW-NB15_4.csv"],
}

NON_FEATURE_COLUMNS = [
    "label", "attack_cat", "label_text", "sample_weight", "binary_label", "unified_label",
    "multiclass_weight", "dataset_source", "features", "scaled_features", "id", "timestamp",
]

ALERT_SEVERITIES = ["NONE", "LOW", "MEDIUM", "HIGH"]
EXPORT_COLUMNS = ["processed_at", "attack_type", "severity", "session_id", "prediction", "prediction_score"]

# Hyper-parameters used with each dataset.
MODEL_PRESETS = {
    "lr": {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 0.1},
    "rf_binary_example": {"numTrees": 100, "maxDepth": 10, "minInstancesPerNode": 1, "seed": 42},
    "rf_binary_cic": {"numTrees": 30, "maxDepth": 6, "maxBins": 32, "minInstancesPerNode": 10, "seed": 42},
    "rf_binary_unsw": {"numTrees": 100, "maxDepth": 15, "maxBins": 64, "minInstancesPerNode": 5,
                       "featureSubsetStrategy": "sqrt", "seed": 42},
    "gbt_binary_cic": {"maxIter": 20, "maxDepth": 5, "seed": 42},
    "gbt_binary_unsw": {"maxIter": 50, "maxDepth": 8, "stepSize": 0.1, "seed": 42},
    "rf_multiclass_cic": {"numTrees": 30, "maxDepth": 8, "maxBins": 32, "minInstancesPerNode": 10,
                          "minInfoGain": 0.001, "seed": 42},
    "rf_multiclass_cic_improved": {"numTrees": 50, "maxDepth": 12, "maxBins": 64, "minInstancesPerNode": 5,
                                   "featureSubsetStrategy": "sqrt", "seed": 42},
    "rf_multiclass_unsw": {"numTrees": 100, "maxDepth": 15, "maxBins": 64, "minInstancesPerNode": 3,
                           "featureSubsetStrategy": "sqrt", "seed": 42},
    "rf_multiclass_unsw_fixed": {"numTrees": 50, "maxDepth": 12, "maxBins": 32, "minInstancesPerNode": 5,
                                 "featureSubsetStrategy": "sqrt", "seed": 42},
}

# --------------------------------------------------------------------------
# End of fixed values.
# --------------------------------------------------------------------------


def _fields(names, data_type):
    return [T.StructField(name, data_type, True) for name in names]


def stream_schema(source: str) -> T.StructType:
    """Schema of one JSON flow message. Labels are left out on purpose."""
    if source == "unsw":
        fields = (
            _fields(["id"], T.DoubleType())
            + _fields(UNSW_FEATURES, T.DoubleType())
            + _fields(["proto", "service", "state", "timestamp"], T.StringType())
        )
    elif source in ("cicids2017", "cicids2018"):
        fields = _fields(CIC_FEATURES, T.DoubleType()) + _fields(
            ["Source IP", "Destination IP", "timestamp"], T.StringType()
        )
    else:
        raise ValueError(f"unknown flow source {source!r}")
    return T.StructType(fields + _fields(["producer_id"], T.IntegerType()))


def csv_schema(dataset: str) -> T.StructType:
    """Explicit schema of a dataset's CSV files; the reader matches it by name."""
    if dataset == "unsw_raw":
        return T.StructType([
            T.StructField(name, T.StringType() if name in UNSW_RAW_TEXT_COLUMNS
                          else T.IntegerType() if name == "label" else T.DoubleType(), True)
            for name in UNSW_RAW_COLUMNS
        ])
    if dataset == "unsw":
        return T.StructType(
            _fields(["id"], T.LongType())
            + _fields(UNSW_FEATURES, T.DoubleType())
            + _fields(["proto", "service", "state", "attack_cat"], T.StringType())
            + _fields(["label"], T.IntegerType())
        )
    if dataset in ("cicids2017", "cicids2018"):
        text = ["Label"] + (CIC_2018_DROP + ["Timestamp"] if dataset == "cicids2018" else [])
        return T.StructType(_fields(CIC_FEATURES, T.DoubleType()) + _fields(text, T.StringType()))
    raise ValueError(f"unknown dataset {dataset!r}")


ALERT_SCHEMA = T.StructType([
    T.StructField("is_attack", T.BooleanType(), False),
    T.StructField("attack_type", T.StringType(), True),
    T.StructField("severity", T.StringType(), True),
    T.StructField("binary_prediction", T.DoubleType(), True),
    T.StructField("multiclass_prediction", T.DoubleType(), True),
    T.StructField("prediction_score", T.DoubleType(), True),
    T.StructField("processed_at", T.TimestampType(), False),
    T.StructField("kafka_timestamp", T.TimestampType(), True),
    T.StructField("inserted_at", T.TimestampType(), True),
    T.StructField("session_id", T.StringType(), True),
    T.StructField("batch_id", T.LongType(), True),
    T.StructField("alert_date", T.DateType(), True),
])

SESSION_EVENT_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("event", T.StringType(), False),
    T.StructField("event_at", T.TimestampType(), False),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])
