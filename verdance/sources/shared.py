"""Intermediate tables in the folder that driver and executors share, and numbering in order."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _deleted_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the application ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers on machines that have this package at the same path import it; ship it by --py-files elsewhere.

    Operators whose helpers run in Python workers call it, so that nobody has to set PYTHONPATH.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir.

    Unset on a cluster it is an error, for a folder of one machine would lose data there; a
    local session (as in tests) gets a temporary folder. The application's own folder in it is deleted when it ends.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
        _deleted_at_exit(spark, context.getCheckpointDir())
    return context.getCheckpointDir()


#: Spark's setting by which a query's shuffle files go when it ends, instead of when the driver collects garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """For tables that are written once and read back: their shuffle files take no disk afterwards."""
    before = spark.conf.get(SHUFFLES_GO, "false")
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.set(SHUFFLES_GO, before)


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder and read back, without its lineage."""
    checkpoint_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        # The setting holds for frames that are made under it.
        return df.select("*").checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared checkpoint folder: compressed, and read by column."""
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    _deleted_at_exit(df.sparkSession, path)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """df with rank (long, from 0) in the given order, without gathering it: sorted ranges are
    numbered where they lie, and only the number of rows of each range comes to the driver."""
    placed = cut(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().collect())
    before, pairs = 0, []
    for p, n in sizes:
        pairs += [F.lit(p), F.lit(before)]
        before += n
    first = F.try_element_at(F.create_map(*pairs), part) if pairs else F.lit(0)
    return placed.withColumn("rank", (first + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_at")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the application ends."""
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _deleted_at_exit(spark, path)
    return path
