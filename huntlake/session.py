"""Session helpers: one place for the settings every job in the library relies on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "huntlake") -> SparkSession:
    """Local/test session. On a cluster, the submitter's session is used instead.

    UTC is pinned because the fixture timestamps are TIMESTAMP_NTZ and every epoch
    computation casts them to TIMESTAMP in the session zone.
    """
    cores = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cores}]"
    parts = shuffle_partitions or int(cores)
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("HUNTLAKE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.autoBroadcastJoinThreshold", str(32 * 1024 * 1024))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_utc(spark)
    return spark


# Settings for a large cluster (reading ~100 TB): many shuffle partitions that AQE
# coalesces at run time, skew-join splitting, larger scan splits, and a broadcast
# threshold that only admits small dimension-like sides.
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * 1024 * 1024),
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.shuffle.partitions": "20000",
    "spark.sql.files.maxPartitionBytes": str(512 * 1024 * 1024),
    "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.session.timeZone": "UTC",
}


def apply_cluster_conf(spark: SparkSession, overrides: dict | None = None) -> None:
    """Apply the runtime SQL settings above to an existing (cluster) session."""
    for k, v in {**CLUSTER_CONF, **(overrides or {})}.items():
        spark.conf.set(k, v)


def ensure_utc(spark: SparkSession) -> None:
    """Epoch arithmetic on TIMESTAMP_NTZ columns is only stable in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def compiled_code(spark: SparkSession) -> None:
    """A stage whose generated method is larger than what the JVM compiles (8,000 bytes) runs without
    whole-stage code: its expressions come in small methods, which are compiled."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the setting is absent (local tests) is a private folder created.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster "
                               "(running sums and intermediate tables are written there)")
        configured = tempfile.mkdtemp(prefix="huntlake-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (never a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate tables, inside the shared checkpoint folder
    (never a machine-local temporary folder on a cluster)."""
    import uuid

    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/huntlake-tables/{name}-{uuid.uuid4().hex[:12]}"
