"""Session helpers: how the engine expects a Spark session to be set up."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

#: Settings for one machine; a cluster brings its own.
LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for tests and benches on one machine."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("textloom")
    builder = builder.config("spark.driver.memory", driver_memory)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config(map=LOCAL_CONF).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable.

    The folder that the cluster names in ``spark.checkpoint.dir`` is taken, as all executors share it. Only
    where that is unset (tests, one machine) a temporary folder is made.
    """
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    context.setCheckpointDir(named or tempfile.mkdtemp(prefix="textloom-checkpoint-"))

