"""Schemas and fixed values shared across the library.

The constants in the FIXED VALUES block must equal the detector's conventions for
results to match (feature contract, keyword lists, bins, service ports).
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the detector's conventions; natural order)
# ---------------------------------------------------------------------------

# Flow feature contract: the 17 numeric columns, in this order.
EXPECTED_FEATURES = [
    "Flow Duration", "Total Fwd Packet", "Total Bwd packets", "Flow Bytes/s",
    "Flow Packets/s", "Packet Length Mean", "Packet Length Std", "Packet Length Variance",
    "FIN Flag Count", "SYN Flag Count", "RST Flag Count", "PSH Flag Count",
    "ACK Flag Count", "URG Flag Count", "Average Packet Size", "Fwd Segment Size Avg",
    "Bwd Segment Size Avg",
]

# Keyword rule for log lines.
ATTACK_MARKER = "APT_attack"
LABEL_ATTACK = "attaque"
LABEL_NORMAL = "normal"
BENIGN_STAGE = "benign"

# Log event vocabulary of the sample generator.
NORMAL_EVENTS = ["user_login", "file_access", "system_update"]
ATTACK_EVENTS = ["APT_attack_port_scan", "APT_attack_data_exfiltration", "APT_attack_bruteforce"]

# Column-role keywords (lower-case substring match on the column name).
TIME_KEYWORDS_ALL = ["time", "date", "timestamp", "created", "modified"]
TIME_KEYWORDS_PIPELINE = ["time", "date", "timestamp"]
IP_KEYWORDS_ALL = ["ip", "addr", "host", "source", "destination", "src", "dst"]
IP_KEYWORDS_PIPELINE = ["ip", "src", "dst", "source", "destination"]
PORT_KEYWORDS = ["port"]
PROTOCOL_KEYWORDS = ["protocol", "proto"]
# Case-sensitive name fragments of flow-statistic columns.
FLOW_KEYWORDS = ["Flow", "Packet", "flag", "Duration"]

# Time of day: hour bins (-1,5], (5,11], (11,17], (17,23].
TIME_CATEGORY_BINS = [(5, "night"), (11, "morning"), (17, "afternoon"), (23, "evening")]
REFERENCE_DATE = "2020-01-01 00:00:00"

# IP categories.
PRIVATE_PREFIXES = ["10.", "192.168.", "172."]

# Port bins (-1,1023], (1023,49151], (49151,65535].
PORT_CATEGORY_BINS = [(-1, 1023, "well-known"), (1023, 49151, "registered"), (49151, 65535, "dynamic")]
SERVICE_PORTS = [22, 23, 53, 80, 443, 445, 3389]
COMMON_PORTS = [22, 53, 80, 443, 8080, 8443]
PROTOCOLS = ["TCP", "UDP", "ICMP", "HTTP", "HTTPS", "DNS"]

# Heuristic thresholds.
LONG_CONNECTION_S = 600
SCAN_CONNECTION_S = 1
BEACONING_CV = 0.1
EXFIL_QUANTILE = 0.95
HIGH_SIZE_VARIATION = 0.5

# Encoding / labelling defaults.
MAX_CATEGORIES = 10
OTHER_CATEGORY = "other"
UNKNOWN_CATEGORY = "unknown"
ZSCORE_LIMIT = 2.5
MIN_OUTLIER_COLUMNS = 3
LABEL_RATE_LIMIT = 0.1

# Keyword feature rules for the stage predictor: value when the keyword is present / absent.
KEYWORD_DURATION = (80000, 4000)          # "exfiltration"
KEYWORD_BYTES_RATE = (850.0, 150.0)       # "exfiltration" or "c2"
KEYWORD_PACKET_RATE = (300.0, 50.0)       # "scan"
KEYWORD_LENGTH_MEAN = (700.0, 400.0)      # "ack"
KEYWORD_CONSTANTS = {
    "Packet Length Std": 50.0,
    "Packet Length Variance": 1200.0,
    "URG Flag Count": 0,
    "Average Packet Size": 900.0,
    "Fwd Segment Size Avg": 1000.0,
    "Bwd Segment Size Avg": 900.0,
}

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

LOG_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("event", T.StringType()),
])

LOG_SCHEMA_RAW = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("destination", T.StringType()),
    T.StructField("event", T.StringType()),
])

FLOW_SCHEMA = T.StructType(
    [T.StructField(name, T.DoubleType()) for name in EXPECTED_FEATURES]
    + [T.StructField("Stage", T.StringType()), T.StructField("is_apt", T.IntegerType())]
)

HISTORY_SCHEMA = T.StructType([
    T.StructField("batch", T.LongType()),
    T.StructField("samples", T.LongType()),
    T.StructField("accuracy", T.DoubleType()),
    T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()),
    T.StructField("f1", T.DoubleType()),
])
