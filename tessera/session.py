"""SparkSession construction and cluster-aware settings.

On a cluster the session comes from the platform; ``get_session`` only fills
in settings that are unset, so a cluster's own values always win.
"""

from __future__ import annotations

import os
import tempfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

# Settings we want when nobody else chose a value. Shuffle partitions stay
# modest because AQE coalesces small ones and splits skewed ones at runtime.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # delete a checkpoint's files once no DataFrame refers to it, so the
    # shared checkpoint folder does not fill up over a long session
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def _already_set(key: str, active: SparkSession | None, submitted: SparkConf) -> bool:
    if submitted.contains(key):
        return True
    return active is not None and active.conf.get(key, None) is not None


def get_session(master: str | None = None, app_name: str = "tessera",
                shuffle_partitions: int | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    # values from spark-submit / spark-defaults or an already running
    # session win; ours only fill the gaps
    active, submitted = SparkSession.getActiveSession(), SparkConf()
    for k, v in _DEFAULTS.items():
        if not _already_set(k, active, submitted):
            builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if not _already_set("spark.driver.memory", active, submitted):
        builder = builder.config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's value is used as is. Only when the setting is unset and the
    master is local (tests) do we create a private scratch folder and register
    it; on a cluster a folder of one machine would lose data, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-ckpt-"))
    return sc.getCheckpointDir()


_MARKED: set[str] = set()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path for an intermediate table, in this application's folder under the
    shared checkpoint folder. The folder goes when the application ends."""
    sc = spark.sparkContext
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{sc.applicationId}"
    if root not in _MARKED:
        folder = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = folder.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _MARKED.add(root)
    return f"{root}/{name}"
