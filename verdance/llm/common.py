"""Helpers shared by the operators of this folder."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdance.sources.shared import checkpoint_dir, cut, ranked, scratch, stored

#: Words of most contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: A lookup table of at most this many rows may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000


def long_ids(rows: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, DataFrame | None]:
    """(rows whose id_col is a long, table of _long and _name to go back). Whole numbers are cast and need no
    table; ids of other types are numbered in their own order, so that the smallest stays the smallest."""
    if isinstance(rows.schema[id_col].dataType, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return rows.withColumn(id_col, F.col(id_col).cast("long")), None
    names = rows.select(F.col(id_col).alias("_name")).where("_name IS NOT NULL").distinct()
    names = cut(ranked(names, F.col("_name")).select(F.col("rank").alias("_long"), "_name"))
    joined = rows.join(names, F.col(id_col) == F.col("_name"), "left").withColumn(id_col, F.col("_long"))
    return joined.drop("_long", "_name"), names


def named_ids(df: DataFrame, names: DataFrame | None, *columns: str) -> DataFrame:
    """df with the ids in the given columns as they were before long_ids."""
    if names is None:
        return df
    for c in columns:
        df = df.join(names, F.col(c) == F.col("_long"), "left").withColumn(c, F.col("_name")).drop("_long", "_name")
    return df


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers on machines that have this folder at the same path import it; else ship it by --py-files."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *paths])


def deleted(spark: SparkSession, path: str) -> None:
    """Removes an intermediate table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(df: DataFrame, small: DataFrame, on: Column | list[str], how: str, rows: int) -> DataFrame:
    """Join with a table whose row count was measured: broadcast only under BROADCAST_ROWS."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def n_words(text: Column) -> Column:
    """Number of words as long, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def unit_hash(key: Column, seed: str) -> Column:
    """48 seeded bits of md5 as a long; engines with md5 agree on it."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(seed)).cast("binary")), 1, 12), 16, 10).cast("long")
