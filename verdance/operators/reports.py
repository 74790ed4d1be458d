"""Distribution reports: counts, shares and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .rollups import family


def constraint_distribution(constraints: DataFrame) -> DataFrame:
    """Counts by tag, category and type in one pass."""
    tag = F.coalesce("tag", F.lit("unknown"))
    kinds = F.explode(F.array(F.struct(F.lit("tag").alias("dimension"), tag.alias("value")), F.struct(F.lit("category").alias("dimension"), F.substring(tag, 1, 1).alias("value")), F.struct(F.lit("type").alias("dimension"), F.col("type").alias("value"))))
    return constraints.select(kinds.alias("k")).groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"))


def constraints_per_case(constraints: DataFrame, easy: int = 3) -> DataFrame:
    sizes = constraints.groupBy("item_id").agg(F.count("*").alias("n_constraints"))
    return sizes.groupBy("n_constraints").agg(F.count("*").alias("cases")).withColumn("difficulty", F.when(F.col("n_constraints") <= easy, "easy").otherwise("hard"))


def tier_distribution(constraints: DataFrame) -> DataFrame:
    cases = constraints.select("item_id").distinct().select(F.split("item_id", r"\.")[0].alias("l1"), F.split("item_id", "-")[0].alias("l2"))
    return cases.groupBy("l1", "l2").agg(F.count("*").alias("cases"))


def counted(rows: DataFrame, **dimensions: Column) -> DataFrame:
    """dimension, value and n for several dimensions of the rows in one pass; null values are left out."""
    kinds = F.explode(F.array(*[F.struct(F.lit(name).alias("dimension"), value.cast("string").alias("value")) for name, value in dimensions.items()]))
    return rows.select(kinds.alias("k")).where("k.value IS NOT NULL").groupBy("k.dimension", "k.value").agg(F.count("*").alias("n"))


def totals(row: DataFrame, **values: Column) -> DataFrame:
    """The one row of an aggregate as dimension total, with one value a line (n is a double there)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("value"), v.cast("double").alias("n")) for name, v in values.items()])).alias("k")).select(F.lit("total").alias("dimension"), "k.value", "k.n")


def first_level(case: Column) -> Column:
    return F.split(case, r"\.")[0]


def second_level(case: Column) -> Column:
    return F.split(case, "-")[0]


def tag_category(tag: Column) -> Column:
    return F.when(tag != "", F.substring(tag, 1, 1))


def benchmark_stats(constraints: DataFrame) -> DataFrame:
    """dimension, value, n: totals (cases, constraints, mean per case, compliance and correctness constraints, share of the former in percent)
    and counts by l1 and l2 (cases), checker, tag and tag category (constraints). constraints: item_id, tag, checker, is_if."""
    cases = counted(constraints.select("item_id").distinct(), l1=first_level(F.col("item_id")), l2=second_level(F.col("item_id")))
    own = counted(constraints, checker=F.col("checker"), tag=F.nullif(F.col("tag"), F.lit("")), tag_category=tag_category(F.col("tag")))
    by_if = F.count_if(F.coalesce("is_if", F.lit(False)))
    row = constraints.agg(F.countDistinct("item_id").alias("cases"), F.count("*").alias("n"), by_if.alias("c"))
    n = F.greatest(F.col("n"), F.lit(1))
    found = totals(row, cases=F.col("cases"), constraints=F.col("n"), mean_per_case=F.round(F.col("n") / F.greatest(F.col("cases"), F.lit(1)), 2), compliance=F.col("c"), correctness=F.col("n") - F.col("c"), compliance_share=F.round(100.0 * F.col("c") / n, 1))
    return found.unionByName(cases.unionByName(own).withColumn("n", F.col("n").cast("double")))


def case_categories(constraints: DataFrame) -> DataFrame:
    """The tag categories of each case, with its compliance and correctness constraints (those that say so)."""
    return constraints.groupBy("item_id").agg(F.array_sort(F.collect_set(tag_category(F.col("tag")))).alias("categories"), F.count_if(F.col("is_if")).alias("n_compliance"), F.count_if(~F.col("is_if")).alias("n_correctness"))


def training_stats(samples: DataFrame, constraints: DataFrame) -> DataFrame:
    """dimension, value, n: totals (samples, mean constraints, hard, soft, hidden) and counts by l1, l2, source (none: legacy) and constraint id.

    samples: sample_id, l1, l2, source, n_constraints, n_hidden. constraints: sample_id, constraint_id, type.
    """
    source = F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit("legacy"))
    row = samples.agg(F.count("*").alias("n"), F.avg("n_constraints").alias("mean"), F.sum("n_hidden").alias("hidden"))
    kinds = constraints.agg(F.count_if(F.col("type") == "hard").alias("hard"), F.count_if(F.col("type") == "soft").alias("soft"))
    found = totals(row, samples=F.col("n"), mean_constraints=F.round("mean", 2), hidden=F.coalesce("hidden", F.lit(0))).unionByName(totals(kinds, hard=F.col("hard"), soft=F.col("soft")))
    by = counted(samples, l1=F.col("l1"), l2=F.col("l2"), source=source).unionByName(counted(constraints, constraint=F.col("constraint_id")))
    return found.unionByName(by.withColumn("n", F.col("n").cast("double")))


def sample_stats(samples: DataFrame, constraints: DataFrame) -> DataFrame:
    """dimension, value, n: averages to one decimal of constraints, general, soft and hidden ones, totals of hard and soft, and counts by l1, l2, variant and constraint id."""
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0))), 1)
    row = samples.agg(F.count("*").alias("n"), mean("n_constraints").alias("a"), mean("n_general").alias("g"), mean("n_soft").alias("s"), mean("n_hidden").alias("h"))
    kinds = constraints.agg(F.count_if(F.col("type") == "hard").alias("hard"), F.count_if(F.col("type") == "soft").alias("soft"))
    found = totals(row, samples=F.col("n"), constraints=F.col("a"), general=F.col("g"), soft_mean=F.col("s"), hidden=F.col("h")).unionByName(totals(kinds, hard=F.col("hard"), soft=F.col("soft")))
    by = counted(samples, l1=F.col("l1"), l2=F.col("l2"), variant=F.coalesce("variant", F.lit(""))).unionByName(counted(constraints, constraint=F.col("constraint_id")))
    return found.unionByName(by.withColumn("n", F.col("n").cast("double")))


def usage_distribution(constraints: DataFrame, pool_size: int) -> DataFrame:
    """Uses of each method and tag, and of how many of the pool."""
    out = constraints.groupBy("method", F.coalesce("tag", F.lit("unknown")).alias("tag")).agg(F.count("*").alias("uses"))
    totals = out.agg(F.countDistinct("tag").alias("distinct_used")).withColumn("pool_size", F.lit(pool_size).cast("long"))
    return out.join(F.broadcast(totals))


def response_length_stats(responses: DataFrame, group: str, length: Column) -> DataFrame:
    """Exact quartiles and moments, from how often each length occurs: a group is reduced to its distinct
    lengths before it is sorted, so none holds its answers."""
    n = responses.groupBy(group, length.cast("double").alias("_n")).agg(F.count("*").alias("_times")).where("_n IS NOT NULL")
    q = lambda p: F.percentile("_n", F.lit(p), F.col("_times"))
    total, mean = F.sum("_times"), F.sum(F.col("_n") * F.col("_times")) / F.sum("_times")
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("_n") * F.col("_n") * F.col("_times")) / total - mean * mean))
    return n.groupBy(group).agg(total.alias("n"), F.round(mean, 4).alias("mean"), q(0.5).alias("median"), F.min("_n").alias("min"), F.max("_n").alias("max"), F.round(spread, 4).alias("std"), q(0.25).alias("q1"), q(0.75).alias("q3"))


def log_histogram(rows: DataFrame, value: str, bins: int = 25, floor: float = 5.0, head: float = 1.05) -> DataFrame:
    """bin, n, mean: bins evenly spaced on a log scale from max(min, floor) to head * max; smaller values drop out, the last bin is
    closed. mean is the mean of all values, rounded half to even, the same in every row."""
    edges = rows.agg(F.greatest(F.min(value).cast("double"), F.lit(floor)).alias("lo"), (F.max(value) * head).alias("hi"), F.bround(F.avg(value)).cast("long").alias("mean"))
    at = F.floor(F.ln(F.col(value) / F.col("lo")) / F.ln(F.col("hi") / F.col("lo")) * bins)
    # edges is one row.
    placed = rows.join(F.broadcast(edges)).where(F.col(value) >= F.col("lo")).select(F.least(at, F.lit(bins - 1)).cast("long").alias("bin"), "mean")
    return placed.groupBy("bin", "mean").agg(F.count("*").alias("n")).select("bin", "n", "mean")


def family_share(constraints: DataFrame) -> DataFrame:
    counts = constraints.groupBy(family(F.col("tag")).alias("family")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def context_reuse(cites: DataFrame, item: str, document: str) -> DataFrame:
    """One row: items, distinct context sets, the most cited document (of equally cited ones the first by its id, of any type) and how often it is cited."""
    sets = cites.groupBy(item).agg(F.sort_array(F.collect_set(document)).alias("s")).agg(F.count("*").alias("items"), F.countDistinct(F.xxhash64("s")).alias("context_sets"))
    counts = cites.select(item, document).distinct().groupBy(document).agg(F.count("*").alias("n"))
    # Of the documents the one row that stands first; ids are compared as they are.
    top = counts.orderBy(F.desc("n"), F.asc_nulls_last(document)).limit(1).select(F.col(document).alias("top_document"), F.col("n").alias("top_cites"))
    return sets.join(F.broadcast(top), F.lit(True), "left")
