"""Session defaults and the checkpoint folder used to cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Static options a session should be started with. Call-site capture costs several JVM calls
# per column operator, and page expressions have thousands of operators.
START_OPTIONS = {"spark.python.sql.dataFrameDebugging.enabled": "false"}
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # A table of very many folders is listed in so many tasks at most; Spark's own 10,000 take longer to start than to list.
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
    # A repeated key of a JSON object keeps its last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the runtime options the jobs rely on (all changeable at run time)."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the cluster's ``spark.checkpoint.dir`` when it names one.

    Only a local master, where driver and tasks share a disk, may go without the setting and gets a
    folder named after the application. On a cluster this raises rather than use a local disk.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = f"/tmp/checkpoints/{sc.applicationId}"
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
