"""The Spark session of tests, benchmarks and the command line."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, **conf: str) -> SparkSession:
    """A local session. A cluster's own session can be passed to every function here instead."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config(
        map={
            "spark.sql.shuffle.partitions": str(cpus if str(cpus).isdigit() else os.cpu_count()),
            "spark.sql.adaptive.enabled": "true",
            # scoring costs far more per byte than a shuffle: don't merge small partitions into one task
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
            "spark.sql.session.timeZone": "UTC",
            "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("VAKTAVYA_DRIVER_MEMORY", "8g"),
            **conf,
        }
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Put this package on the path of the executors' Python workers.

    Functions that run there are found by the name of their module. Hosts that don't share this folder need the
    package installed, or sent with --py-files.
    """
    environment, folder = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if folder not in known:
        environment["PYTHONPATH"] = os.pathsep.join([folder, *filter(None, known)])


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share: that of spark.checkpoint.dir.

    Only a local session, as in tests, gets a temporary one where none is set; on a cluster that would be a folder of one
    host, so a missing setting raises.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vaktavya"))
    return context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder.

    The session's cleaner removes the files with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is on.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """Give Python-heavy work at least one partition a core.

    A few small files make fewer scan tasks than there are cores; only then are rows
    redistributed. A large input already has more splits than cores and isn't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
