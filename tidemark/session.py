"""Session helpers shared by operators and queries."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table on whose rows much is computed. Where it lies in fewer parts than there are cores, its rows are shared out; a large table is read as it is."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def use_checkpoints(spark: SparkSession) -> None:
    """Make ``DataFrame.checkpoint`` usable, on the folder that the cluster names.

    ``spark.checkpoint.dir`` wins. Only a local session without the setting gets
    a folder of its own; a cluster without it is a configuration error, since
    a folder of one machine is lost with that machine.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="spark-ckpt-")
    sc.setCheckpointDir(shared)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and read it from there."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def computed_once(df: DataFrame, **values: Column) -> DataFrame:
    """df with more columns, each computed once a row however often it is used later.

    They pass through a generator of one row, below which no filter is pushed and into which no later expression is merged.
    """
    made = F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_once")
    return df.select(*[c for c in df.columns if c not in values], made).select("*", "_once.*").drop("_once")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors' Python, once per application, wherever the session was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='spark-pkg-')}/{package.name}", "zip", package.parent, package.name)
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
