"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Session settings every job relies on: UTC so DATE/TIMESTAMP values agree with
# other engines, AQE for runtime coalescing and skew-join splitting.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    # Split a hot join partition even when the split costs an extra shuffle
    # (otherwise a later aggregate reusing the join's partitioning blocks it).
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    # Delete checkpoint files once their frames are garbage collected.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Streaming state on disk: the ids that T2 remembers may exceed an executor's memory.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# Shuffle files of a finished query go at once (an action on the same frame would need them; a write has a plan of its own).
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, app: str = "tavola", conf: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the defaults above.

    On a cluster the launcher sets the master and ``spark.checkpoint.dir``;
    here they are only filled in when absent (local runs and tests).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    elif not os.environ.get("SPARK_MASTER"):
        b = b.master("local[8]")
    for k, v in {**DEFAULT_CONF, **(conf or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    _size_shuffles(spark, conf or {})
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def _size_shuffles(spark: SparkSession, conf: dict) -> None:
    """Shuffle width: a few partitions per core locally; on a cluster keep the
    launcher's setting, else start wide and let AQE coalesce small partitions
    towards the advisory size (so large stages never run with too few tasks)."""
    if "spark.sql.shuffle.partitions" in conf or spark.sparkContext.getConf().contains("spark.sql.shuffle.partitions"):
        return
    master = spark.sparkContext.master or ""
    if master.startswith("local"):
        spark.conf.set("spark.sql.shuffle.partitions", str(max(8, 2 * spark.sparkContext.defaultParallelism)))
    else:
        spark.conf.set("spark.sql.shuffle.partitions", "8192")
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(256 * 1024 * 1024))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder, registered with the session once.

    ``spark.checkpoint.dir`` wins; without it the folder the launcher registered
    is used as it is. Only a local session with neither gets a scratch folder;
    on a cluster that would be a machine-local folder, so it is an error there.
    """
    sc = spark.sparkContext
    registered = sc._jsc.sc().getCheckpointDir()
    registered = registered.get() if registered.isDefined() else None
    folder = spark.conf.get("spark.checkpoint.dir", None) or registered
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tavola-ckpt-")
    if registered is None:
        sc.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def written(df, name: str):
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Cuts the lineage like a checkpoint, but the plan knows the size of what was
    written. A checkpoint keeps the estimate of the plan that made it, and in a
    loop with joins those estimates multiply without end. The shuffle files of the write
    are given back when it ends, not when the driver collects garbage."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")     # read when the write's own plan is made
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def reliable_checkpoint(df):
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage
    (survives executor loss, unlike a local checkpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
