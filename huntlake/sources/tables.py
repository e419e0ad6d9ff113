"""Driver tables and the two fixture views (``logs`` from events, ``flows`` from lineitem).

The views are narrow projections: Catalyst prunes the scan to the columns each
query needs and pushes filters into the parquet reader.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huntlake.session import ensure_utc

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _case_mod(key, mapping: dict[int, object], default=None):
    """CASE key WHEN k THEN v ... chain (mapping in natural order)."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default)) if default is not None else expr


def logs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log_id, timestamp, source, destination, event, dst_port, protocol, bytes."""
    ensure_utc(spark)
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    attack = _case_mod(eid % 3, {0: "APT_attack_port_scan", 1: "APT_attack_data_exfiltration",
                                 2: "APT_attack_bruteforce"})
    event = (F.when(F.col("event_type").isin("click", "purchase"), F.lit("user_login"))
             .when(F.col("event_type") == "view", F.lit("file_access"))
             .when(F.col("event_type") == "signup", F.lit("system_update"))
             .otherwise(attack))
    port = _case_mod(eid % 11, {0: 22, 1: 23, 2: 53, 3: 80, 4: 443, 5: 445, 6: 3389,
                                7: 8080, 8: 1024, 9: 50000}).cast("int")
    proto = _case_mod(eid % 3, {0: "tcp", 1: "udp", 2: "icmp"})
    return ev.select(
        eid.alias("log_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.concat(F.lit("192.168.1."), (F.col("user_id") % 50 + 1).cast("string")).alias("source"),
        F.concat(F.lit("10.0.0."), (eid % 10 + 1).cast("string")).alias("destination"),
        event.alias("event"),
        port.alias("dst_port"),
        proto.alias("protocol"),
        F.when(eid % 17 == 0, F.lit(None).cast("double")).otherwise(F.col("value")).alias("bytes"),
    )


def flows_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """flow_id, flow_start, the 17 features, Stage, is_apt, siem_detection, delays."""
    ensure_utc(spark)
    li = read_table(spark, sf_dir, "lineitem")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    ln, qty = F.col("l_linenumber"), F.col("l_quantity")
    rflag = F.col("l_returnflag")
    std = (F.lit(10) + sk % 200)
    is_apt = (rflag == "R") & (qty > 40)
    flow_id = ((ok * 10 + ln) * 1000000 + pk) * 10000 + sk
    base = li.select(
        flow_id.alias("flow_id"),
        F.col("l_shipdate").cast("timestamp").alias("flow_start"),
        (qty * 20).alias("Flow Duration"),
        (pk % 97 + qty * 4).cast("double").alias("Total Fwd Packet"),
        (sk % 41 + qty * 2).cast("double").alias("Total Bwd packets"),
        F.when(ok % 19 == 0, F.lit(None).cast("double")).otherwise(F.col("l_extendedprice"))
        .alias("Flow Bytes/s"),
        (F.lit(1) + F.col("l_discount") * 500).alias("Flow Packets/s"),
        (pk % 800).cast("double").alias("Packet Length Mean"),
        std.cast("double").alias("Packet Length Std"),
        (std * std).cast("double").alias("Packet Length Variance"),
        (ln % 2).cast("double").alias("FIN Flag Count"),
        (ok % 2).cast("double").alias("SYN Flag Count"),
        F.when(rflag == "R", F.lit(1.0)).otherwise(F.lit(0.0)).alias("RST Flag Count"),
        (pk % 2).cast("double").alias("PSH Flag Count"),
        F.when(F.col("l_linestatus") == "F", F.lit(1.0)).otherwise(F.lit(0.0)).alias("ACK Flag Count"),
        (sk % 2).cast("double").alias("URG Flag Count"),
        (pk % 800).cast("double").alias("Average Packet Size"),
        (F.lit(200) + pk % 1000).cast("double").alias("Fwd Segment Size Avg"),
        (F.lit(100) + sk % 400).cast("double").alias("Bwd Segment Size Avg"),
        F.when(is_apt, F.when(ln % 3 == 0, F.lit("exfiltration")).otherwise(F.lit("lateral")))
        .otherwise(F.lit("normal")).alias("Stage"),
        F.when(is_apt, F.lit(1)).otherwise(F.lit(0)).alias("is_apt"),
    )
    bucket = (F.col("flow_id") % 100003) % 10
    siem = (F.when((F.col("is_apt") == 1) & (bucket < 7), F.lit(1))
            .when((F.col("is_apt") == 0) & (bucket == 9), F.lit(1)).otherwise(F.lit(0)))
    return base.select(
        "*",
        siem.alias("siem_detection"),
        (F.col("flow_id") % 1009).cast("int").alias("siem_delay_s"),
        (F.col("flow_id") % 907).cast("int").alias("ml_delay_s"),
    )


def register_views(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views for SQL users: ``logs`` and ``flows``."""
    logs_view(spark, sf_dir).createOrReplaceTempView("logs")
    flows_view(spark, sf_dir).createOrReplaceTempView("flows")
