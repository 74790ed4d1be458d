"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, lookup, n_words, ranked, table, unit_hash

MAX_EPOCHS = 3
SEED = "mix-1"
#: A document of more than this part of its source is drawn on its own; at most so many are.
BIG_SHARE = 50


def rank_weights(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, by the rank of the source from 0."""
    return (rank % 3 + 1).cast("long")


def water_level(sources: DataFrame, budget: int, max_epochs: int) -> float:
    """Words per unit of weight after all rounds of clamping.

    Each round shares what the clamped sources leave over the free ones; sources above
    max_epochs times their size are clamped; ends when a round clamps no further source.
    A round reads one row per source and returns three sums.
    """
    cap = F.col("source_size") * max_epochs
    level, clamped = None, -1
    while True:
        full = F.lit(False) if level is None else cap < F.col("weight") * F.lit(level)
        row = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("free"),
            F.count_if(full).alias("n"),
        ).first()
        if row["n"] == clamped:
            return level or 0.0
        clamped = row["n"]
        if row["free"] == 0:
            return level or 0.0
        level = (budget - row["held"]) / row["free"]


def mix(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
    weights=rank_weights,
    budget: int | None = None,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, repeats, taken.

    Sources are ranked by code point, null last, and weighted by `weights(rank)`; together
    they get `budget` words (default: all words). The targets are water-filled under
    max_epochs. A source gets floor(target / size) whole repetitions of each document; the
    rest is one more repetition of the documents that come first in a seeded order, as long
    as at least half of a document fits. Documents of over 1/BIG_SHARE of their source come
    first if their own draw picks them, else last, so that they don't spoil the cut. The
    running sums of that order are taken in about sqrt(n) hash ranges per source, so a hot
    source is spread over many tasks.

    Nulls: a null text has size 0; a null source is a source of its own; null ids are ordered
    as the empty string. Repeated rows count as documents of their own. An empty table gives
    an empty result. Other columns are not read.
    """
    sizes = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("size")))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = cut(ranked(sources, F.col("source").asc_nulls_last()).withColumn("weight", weights(F.col("rank"))))
    totals = sources.agg(F.count("*").alias("n"), F.sum("source_size").alias("words")).first()
    level = water_level(sources, totals["words"] or 0 if budget is None else budget, max_epochs)
    cap = (F.col("source_size") * max_epochs).cast("double")
    target = F.when(cap < F.col("weight") * F.lit(level), cap).otherwise(F.col("weight") * F.lit(level))
    plan = (
        sources.withColumn("target", target)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("n_ranges", F.ceil(F.sqrt("n_docs")))
        .select(F.col("source").alias("of"), "rank", "source_size", "target", "whole", "rest", "n_ranges")
    )
    rows = lookup(sizes, plan, F.col("source").eqNullSafe(F.col("of")), "inner", totals["n"]).drop("of")
    rows = rows.withColumn("h", unit_hash(F.col("doc_id"), seed))
    chosen = F.col("h").cast("double") * F.col("source_size") < F.col("rest") * F.lit(2.0**48)
    place = F.floor(F.col("h") * F.col("n_ranges") / F.lit(2.0**48)) + 1
    big = F.col("size") * BIG_SHARE > F.col("source_size")
    rows = rows.withColumn("range", F.when(~big, place).when(chosen, F.lit(0)).otherwise(F.col("n_ranges") + 2).cast("int"))
    ranges = rows.groupBy("rank", "range").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("rank").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("rank", "range", F.coalesce(before, F.lit(0)).alias("before"))
    inside = F.sum("size").over(Window.partitionBy("rank", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.join(ranges, ["rank", "range"]).withColumn("upto", F.col("before") + inside)
    extra = (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")
    repeats = F.least(F.col("whole") + extra, F.lit(max_epochs)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (F.col("size") * repeats).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each repeated as often as it is taken, with its epoch from 1.

    Documents are told apart by id; of rows of one id each is repeated as the one taken most often. A column
    named epoch gives way to the new one; other names cannot clash, for a row travels as one column.
    """
    id_col = f"`{options.get('id_col', 'doc_id')}`"
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("_of")).agg(F.max("repeats").alias("_repeats")).where("_repeats > 0")
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"), F.col(id_col).alias("_id"))
    rows = rows.join(taken, F.col("_id").eqNullSafe(F.col("_of")), "inner")
    rows = rows.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_repeats"))).alias("_epoch"))
    return rows.select(*[F.col("_row")[n].alias(n) for n in docs.columns if n != "epoch"], F.col("_epoch").alias("epoch"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


ORACLE = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || 'mix-1'), 1, 12))::BIGINT AS h
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sizes GROUP BY source),
fill AS (
  SELECT *, row_number() OVER w AS k,
         (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(weight) OVER () - coalesce(sum(weight) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM src WINDOW w AS (ORDER BY source_size / weight, weight, source NULLS LAST)),
level AS (
  SELECT arg_min(level, k) FILTER (3 * source_size >= level * weight) AS level FROM fill),
plan AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, weight * level) AS target FROM src, level),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan),
runs AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
         sum(size) OVER (PARTITION BY s.source ORDER BY CASE WHEN size * 50 <= source_size THEN 1 WHEN h::DOUBLE * source_size < (target - whole * source_size) * 281474976710656::DOUBLE THEN 0 ELSE 2 END, h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sizes s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source),
reps AS (
  SELECT *, least(whole + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END, 3)::BIGINT AS repeats FROM runs)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken, repeats FROM reps
"""
