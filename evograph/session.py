"""Session construction and lineage-cutting helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "evograph") -> SparkSession:
    """Build (or reuse) a session with the settings the operators are tuned for.

    AQE stays on: it coalesces small shuffle partitions, splits skewed join
    partitions and converts joins to broadcast only when the runtime-measured
    side is below ``spark.sql.adaptive.autoBroadcastJoinThreshold``. That is
    the size check behind every broadcast of a data-derived table here.
    """
    builder = SparkSession.builder.appName(app_name)
    master = master or os.environ.get("EVOGRAPH_MASTER")
    if master or "PYSPARK_GATEWAY_PORT" not in os.environ:  # a submitted job brings its own cluster settings
        parts = shuffle_partitions or int(os.environ.get("EVOGRAPH_SHUFFLE_PARTITIONS", "8"))
        builder = (builder.master(master or "local[8]").config("spark.sql.shuffle.partitions", str(parts))
                   .config("spark.driver.memory", os.environ.get("EVOGRAPH_DRIVER_MEMORY", "16g")))
    builder = (
        builder
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # runtime-checked broadcast: AQE converts a join only when the measured side is smaller
        .config("spark.sql.adaptive.autoBroadcastJoinThreshold",
                os.environ.get("EVOGRAPH_BROADCAST_THRESHOLD", "10MB"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory of the session.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that value
    is always used when present. Only a local-mode session without the setting
    (unit tests, laptop runs) gets a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="evograph-ckpt-")
    sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame, name: str = "round") -> DataFrame:
    """Cut the lineage of ``df`` by writing it as a Parquet table under the reliable
    checkpoint folder (survives executor loss; columnar, so later scans prune)."""
    return materialize(df, name)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder for intermediate files under the session's checkpoint folder
    (a shared location on a cluster)."""
    import uuid
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/evograph-out/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared scratch folder and read it back.

    Used where one derived table feeds many branches of a plan: the branches
    then scan columnar files (with pruning and pushdown) instead of
    recomputing the derivation, and the lineage is cut, so a lost executor
    never replays it.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)
