"""Sources and sinks: explicit schemas, JSON lines in, tables and chat records out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from verdance.operators.keys import duplicate_keys, resume_todo, with_item_key
from verdance.operators.rollups import dataset_summary

from .shared import cut

#: Blocks of files whose first line numbers may be broadcast.
BROADCAST_ROWS = 100_000

CONSTRAINT = "struct<constraint_id:string,constraint:string,tag:string,family:string,check_type:string,config:map<string,string>>"
ITEMS = f"id string, item_id string, case_id string, line_number long, line long, workflow string, task string, work_product string, query string, full_prompt string, extracted_constraints array<{CONSTRAINT}>, constraints array<{CONSTRAINT}>, source_registry array<struct<source_id:string,prompt_label:string,title:string,content:string>>"
RESPONSES = "model string, id string, item_id string, case_id string, line_number long, line long, response string, output string, context string"
MANIFEST = "id string, workflow string, task string, work_product string, source_type string, url string, local_path string, status string, bytes long, error string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """value and row, the line's number from 1 over the files in name order, blank lines counted.

    A block of a file is read by one task in order, so a line's number is its place in the block and the lines
    of the blocks before; only one row a block is sorted for that.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at"))
    blocks = lines.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = cut(blocks.select("_file", "_start", "_first", before.alias("_before")))
    # One row a block; so few of them are broadcast, and the lines stay where they are.
    known = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    return lines.join(known, ["_file", "_start"]).select("value", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("row"))


@dataclass(frozen=True)
class ReadReport:
    """What a reading pass met: lines, blank and bad ones among them, keys that several items have, and the first of these."""

    lines: int
    blank: int
    bad: int
    duplicate_keys: int
    first_duplicates: tuple[str, ...]


def read_items_counted(spark: SparkSession, path: str, *, strict: bool = False, shown: int = 5) -> tuple[DataFrame, DataFrame, ReadReport]:
    """(items with their item_key and row, bad lines, report). strict refuses bad lines and duplicate keys by a ValueError that names the first keys.

    The files are read once: lines are parsed, counted by an observation and written to the checkpoint folder in the same pass; their numbers and the
    duplicates come from there, and only counts and `shown` keys reach the driver. Blank lines count in line numbers. No files, or empty ones, give empty tables.
    """
    seen = Observation()
    where = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")]
    parsed = F.from_json("value", f"{ITEMS}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    lines = spark.read.text(path).select("value", *where, parsed.alias("r")).withColumn("_blank", F.trim("value") == "")
    wrong = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    lines = lines.withColumn("_wrong", ~F.col("_blank") & F.coalesce(wrong, F.lit(True)))
    lines = lines.observe(seen, F.count("*").alias("lines"), F.count_if("_blank").alias("blank"), F.count_if("_wrong").alias("bad"))
    # Of good lines only what was read stays, of bad ones only the text.
    held = cut(lines.select("_file", "_start", "_at", "_blank", "_wrong", F.when(F.col("_wrong"), F.col("value")).alias("value"), F.when(~F.col("_blank") & ~F.col("_wrong"), F.col("r")).alias("r")))
    blocks = held.groupBy("_file", "_start").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a block
    blocks = cut(blocks.select("_file", "_start", "_first", before.alias("_before")))
    known = F.broadcast(blocks) if blocks.count() <= BROADCAST_ROWS else blocks
    rows = held.where("r IS NOT NULL").join(known, ["_file", "_start"]).select("r.*", (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("row")).drop("_bad")
    items, bad = with_item_key(rows), held.where("_wrong").select("value")
    twice = cut(duplicate_keys(items))
    first = tuple(r[0] for r in twice.orderBy("item_key").limit(shown).collect())
    report = ReadReport(seen.get["lines"], seen.get["blank"], seen.get["bad"], twice.count(), first)
    if strict and (report.bad or report.duplicate_keys):
        raise ValueError(f"{path}: {report.bad} bad lines, {report.duplicate_keys} duplicate item keys, first of them {', '.join(map(str, first)) or 'none'}")
    return items, bad, report


def read_appended(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The rows of all batches of append_batch, with their batch (text); none where nothing was written yet."""
    kinds = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kinds = T.StructType([f for f in kinds.fields if f.name != "batch"] + [T.StructField("batch", T.StringType())])
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], kinds)
    return spark.read.schema(kinds).parquet(path)


def append_batch(rows: DataFrame, path: str, batch: str, keys: Sequence[str]) -> None:
    """Adds rows to a growing table as one batch, in such a way that it can be run again after a lost job.

    A batch is a folder that a run replaces as a whole when it commits: what a lost run left behind is never read, and a run after a commit that nobody heard of
    gives the same rows once. Rows whose keys another batch has stay out, and of several rows of one key in the batch one stays, so a key is there once. Rows of null keys are
    kept, each key with its nulls once. An empty batch changes nothing. Two batches must not be written at the same time if they share keys.
    """
    spark, own = rows.sparkSession, [F.col(f"`{k}`") for k in keys]
    there = read_appended(spark, path, rows.schema).where(F.col("batch") != batch).select(*[k.alias(f"_k{i}") for i, k in enumerate(own)])
    same = F.lit(True)
    for i, k in enumerate(own):
        same = same & k.eqNullSafe(F.col(f"_k{i}"))
    fresh = rows.dropDuplicates(list(keys)).join(there, same, "left_anti")
    fresh.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def resume(work: DataFrame, path: str, schema: T.StructType | str, keys: Sequence[str]) -> DataFrame:
    """The rows of work whose keys no batch has yet."""
    return resume_todo(work, read_appended(work.sparkSession, path, schema).select(*keys).distinct(), keys)


def read_json_lines(spark: SparkSession, path: str, schema: str, *, numbered: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines: value) of JSON lines, rows with their line number as row if numbered. Blank lines are skipped."""
    lines = numbered_lines(spark, path) if numbered else spark.read.text(path)
    row = ["row"] if numbered else []
    parsed = lines.where(F.trim("value") != "").select("value", *row, F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | ~F.ltrim("value").startswith("{")
    return parsed.where(~bad).select("r.*", *row).drop("_bad"), parsed.where(bad).select("value")


def read_items(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(items with their item_key, bad lines). Items of one key are found by keys.duplicate_keys, or refused by keys.unique_items."""
    rows, bad = read_json_lines(spark, path, ITEMS, numbered=True)
    return with_item_key(rows), bad


def read_responses(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Responses with a body; lines without response and output are bad lines."""
    rows, bad = read_json_lines(spark, path, RESPONSES, numbered=True)
    body = F.coalesce("response", "output")
    return rows.withColumn("response", body).where("response IS NOT NULL"), bad.unionByName(rows.where(body.isNull()).select(F.to_json(F.struct("*")).alias("value")))


def read_context_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Documents and bytes by workflow and status."""
    rows, _ = read_json_lines(spark, path, MANIFEST)
    return rows.groupBy("workflow", "status").agg(F.count("*").alias("documents"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def nested_results(results: DataFrame) -> DataFrame:
    """Results of an item as one nested row, constraints in order."""
    return results.groupBy("model", "item_id").agg(F.array_sort(F.collect_list(F.struct("constraint_index", "tag", "score", "method"))).alias("results"))


def write_results(results: DataFrame, quality: DataFrame, path: str) -> None:
    """The long table as Parquet by model, the nested form as JSON lines, and each model's dataset summary as JSON lines."""
    results.write.mode("overwrite").partitionBy("model").parquet(f"{path}/results")
    write_json_lines(nested_results(results), f"{path}/items")
    write_json_lines(dataset_summary(results, quality), f"{path}/summary")


def write_sharegpt(chats: DataFrame, path: str) -> None:
    """Chat records as JSON lines."""
    write_json_lines(chats, path)
