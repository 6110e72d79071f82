"""Session helpers: one place for the settings every job relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_spark(master: str | None = None, app: str = "spendlens",
              shuffle_partitions: int | None = None,
              extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session with AQE on, the UI off and UTC time."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str | None:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    The session setting wins. ``fallback`` is only used where the setting is
    unset (tests on one machine); the library itself never invents a local path.
    """
    d = spark.conf.get(CHECKPOINT_CONF, None)
    # The setting itself can't be changed at run time; the context's folder can.
    d = d or fallback
    if d:
        sc = spark.sparkContext
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(d)
    return d


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that outlive a job: the cluster's checkpoint folder. Only Spark in one process on one
    machine may do without the setting; it gets a temporary one."""
    d = checkpoint_dir(spark)
    if not d and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spendlens-"))
    return d or spark.sparkContext.getCheckpointDir()


def stable_copy(df: DataFrame) -> DataFrame:
    """``df`` written once to the cluster's checkpoint folder and read from there: what was decided
    on the way (the partition of each row) stays as it is, whoever reads it and whichever
    executor is lost."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
