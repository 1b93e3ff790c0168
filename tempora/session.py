"""SparkSession helpers.

The cluster names the shared checkpoint folder in ``spark.checkpoint.dir``;
we read it from the session and only set our own when it is unset (tests,
local runs).
"""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    # delete checkpoint files once their DataFrame is garbage-collected, so
    # the shared checkpoint folder does not grow across jobs
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, app: str = "tempora",
              shuffle_partitions: int | None = None,
              extra: dict | None = None, driver_memory: str | None = None) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = dict(_DEFAULTS)
    if driver_memory:
        conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder, registering it with the context.

    ``fallback`` is used only when the session has none configured (local
    tests); on a cluster ``spark.checkpoint.dir`` names a shared folder.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if fallback is None:
            raise RuntimeError("spark.checkpoint.dir is unset and no fallback was given")
        d = fallback
        os.makedirs(d, exist_ok=True)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def ship_package(spark: SparkSession) -> None:
    """Give the executors' Python workers this package (once per session).

    Functions run by Python workers are pickled by module name, so a cluster
    whose nodes have no copy of the repository needs the package on each
    worker's path; Spark's own file distribution carries a zip of it.
    """
    sc = spark.sparkContext
    if getattr(sc, "_tempora_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tempora-pkg-"), "tempora_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("tempora", os.path.relpath(path, here)))
    sc.addPyFile(target)
    sc._tempora_shipped = True


def prepare_workers(spark: SparkSession) -> None:
    """What jobs with Python workers ask of a session: the package on the workers' path, and
    Arrow batches of 16 MB at most (a worker holds a batch or two; the default is 64 MB)."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16m")
