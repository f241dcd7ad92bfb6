"""Session helpers shared by queries, tests and the bench."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
PART_BYTES, WIDE_PARTS = 4 << 20, 8


def local_session(cpus: int | str = 8, app: str = "sedimenta", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SEDIMENTA_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the Python workers, unless it is on their path already: installed, on PYTHONPATH or in
    the directory they start in."""
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    sc = spark.sparkContext
    if ROOT in known or Path.cwd() == ROOT or "site-packages" in ROOT.parts or getattr(sc, "_sedimenta_shipped", False):
        return
    folder = tempfile.mkdtemp()  # on the driver only; Spark's own file server hands it out
    sc.addPyFile(shutil.make_archive(f"{folder}/sedimenta", "zip", ROOT, "sedimenta"))
    sc._sedimenta_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory; a Parquet file or a folder of them."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_key(df: DataFrame, column: str) -> DataFrame:
    """The rows of a table read from files, those of a key in one partition; grouping and windows over the column need no other exchange. The number of
    partitions follows the files' size, PART_BYTES a partition. Beyond as many partitions as a scan task writes straight to files (with more it holds its rows to
    order them) a partition grows, to WIDE_PARTS times that, before there are more of them."""
    sc = df.sparkSession.sparkContext
    size, straight = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()), int(sc.getConf().get("spark.shuffle.sort.bypassMergeThreshold", "200"))
    n = max(min(-(-size // PART_BYTES), straight), -(-size // (WIDE_PARTS * PART_BYTES)))
    return df.repartition(max(sc.defaultParallelism, n), column)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written tables: the one that the cluster names (spark.checkpoint.dir). Where none is named, a
    folder of this machine serves local masters only; on a cluster its executors couldn't share it, so that is an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sedimenta-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The table written to the checkpoint folder and read from there: a loop's lineage ends here, and lost
    executors don't lose it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
