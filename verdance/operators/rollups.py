"""Scores and roll-ups of constraint results (model, item_id, constraint_index, tag, type, method, score).

A score is 1, 0 or null (undecided). Four policies exist and are kept apart: undecided is left
out (item_summary and what builds on it), counts as not passed (sample_pass_rate, isr), a missing
result counts as failed (model_rates), or is ignored (radar_rates).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions.measures import fold

PASSED = F.count_if
CENTRAL = tuple([f"EG{i}" for i in range(1, 8)] + [f"QV{i}" for i in range(1, 8)] + [f"DB{i}" for i in range(1, 10)])
SEVERE = ("EG1", "EG2", "DB1", "DB3", "DB4")
#: A central failure is severe, too, if its constraint speaks of one of these.
SEVERE_TERMS = ("authority", "route", "trigger", "replace the governed", "not ready for sign-off", "subsequent-events", "escalate")


def passed(score: str = "score") -> Column:
    return F.count_if(F.col(score) == 1)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, F.round(part / whole, digits))


def family(tag: Column) -> Column:
    """Leading letters of the tag; RC belongs to EG; none is unknown."""
    letters = F.regexp_extract(tag, "^([A-Z]+)", 1)
    return F.when(tag.isNull() | (letters == ""), "unknown").when(letters == "RC", "EG").otherwise(letters)


def item_summary(results: DataFrame) -> DataFrame:
    out = results.groupBy("model", "item_id").agg(F.count("*").alias("total"), F.count("score").alias("decided"), passed().alias("passed"))
    return out.withColumn("needs_judge", F.col("total") - F.col("decided")).withColumn("score", share(F.col("passed"), F.col("decided"))).withColumn("coverage", share(F.col("decided"), F.col("total")))


def by_key(results: DataFrame, key: Column, name: str) -> DataFrame:
    return results.groupBy("model", key.alias(name)).agg(F.count("*").alias("total"), passed().alias("passed"), F.count_if(F.col("score").isNull()).alias("needs_judge"))


def by_method(results: DataFrame) -> DataFrame:
    return by_key(results, F.coalesce(F.split("method", ":")[0], F.lit("unknown")), "method")


def by_tag(results: DataFrame) -> DataFrame:
    return by_key(results, F.coalesce("tag", F.lit("unknown")), "tag")


def dataset_summary(results: DataFrame, quality: DataFrame) -> DataFrame:
    """One row a model: micro score, macro item score, exact pass rate over fully decided items, coverage, quality, final."""
    items = item_summary(results).join(quality, ["model", "item_id"], "left")
    full = F.col("decided") == F.col("total")
    out = items.groupBy("model").agg(
        F.count("*").alias("items"),
        F.sum("passed").alias("p"),
        F.sum("decided").alias("d"),
        F.sum("total").alias("t"),
        F.avg(F.when(F.col("decided") > 0, F.col("passed") / F.col("decided"))).alias("macro"),
        F.count_if(full).alias("full"),
        F.count_if(full & (F.col("passed") == F.col("total"))).alias("exact"),
        F.avg("quality").alias("q"),
    )
    micro = F.col("p") / F.col("d")
    return out.select(
        "model",
        "items",
        share(F.col("p"), F.col("d")).alias("micro_score"),
        F.round("macro", 4).alias("macro_score"),
        share(F.col("exact"), F.col("full")).alias("exact_item_pass_rate"),
        share(F.col("d"), F.col("t")).alias("coverage"),
        F.round("q", 4).alias("quality"),
        F.round(0.8 * micro + 0.2 * F.col("q") / 10, 4).alias("final"),
    )


def isr(results: DataFrame) -> DataFrame:
    """Share of items with every constraint passed; undecided is not passed."""
    items = results.groupBy("model", "item_id").agg(F.bool_and(F.coalesce("score", F.lit(0)) == 1).alias("ok"))
    return items.groupBy("model").agg(F.count("*").alias("items"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("isr"))


def csr(results: DataFrame) -> DataFrame:
    return results.groupBy("model").agg(F.count("*").alias("total"), passed().alias("passed")).withColumn("csr", share(F.col("passed"), F.col("total")))


def metrics_by_dimension(results: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """ISR, CSR and mean quality per model by workflow, task, family and tag.

    An item counts in a dimension's value with its constraints of that value: it is satisfied there if all of them pass. Quality is the mean
    over the items that have the value. Results are first summed up by item and value, in one pass over grouping sets.
    """
    rows = results.select("model", "item_id", F.split("item_id", r"\.")[0].alias("workflow"), F.split("item_id", "-")[0].alias("task"), family(F.col("tag")).alias("family"), F.coalesce("tag", F.lit("unknown")).alias("tag"), "score")
    names = ["workflow", "task", "family", "tag"]
    sets = [["model", "item_id", n] for n in names]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], "model", "item_id", *names).agg(F.count("*").alias("n"), passed().alias("p"), *[F.grouping(n).alias(f"g_{n}") for n in names])
    pick = lambda what: F.coalesce(*[F.when(F.col(f"g_{n}") == 0, what(n)) for n in names])
    items = out.select("model", "item_id", pick(F.lit).alias("dimension"), pick(F.col).alias("value"), "n", "p")
    if quality is not None:
        items = items.join(quality, ["model", "item_id"], "left")
    mean = [F.round(F.avg("quality"), 4).alias("quality")] if quality is not None else []
    found = items.groupBy("model", "dimension", "value").agg(F.count("*").alias("items"), F.sum("n").alias("total"), F.sum("p").alias("passed"), F.count_if(F.col("n") == F.col("p")).alias("ok"), *mean)
    return found.select("model", "dimension", "value", "items", "total", "passed", share(F.col("ok"), F.col("items")).alias("isr"), share(F.col("passed"), F.col("total")).alias("csr"), *[c for c in ("quality",) if mean])


def leaderboard(results: DataFrame, quality: DataFrame) -> DataFrame:
    mean = quality.groupBy("model").agg(F.round(F.avg("quality"), 4).alias("quality"))
    return isr(results).join(csr(results).select("model", "csr"), "model").join(mean, "model", "left").orderBy(F.desc("isr"), "model")


def case_scores(results: DataFrame) -> DataFrame:
    hard = F.col("type") == "hard"
    ok = F.col("score") == 1
    return results.groupBy("model", "item_id").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(hard).alias("hard_total"), F.count_if(hard & ok).alias("hard_passed"), F.count_if(~hard).alias("soft_total"), F.count_if(~hard & ok).alias("soft_passed")
    )


def tier_scores(results: DataFrame) -> DataFrame:
    """Mean case score by tier T1 to T3 and over all cases, other tiers included in the latter only."""
    cases = case_scores(results).select("model", F.split("item_id", r"\.")[0].alias("tier"), (F.col("passed") / F.col("total")).alias("s"))
    out = cases.rollup("model", "tier").agg(F.count("*").alias("cases"), F.round(F.avg("s"), 4).alias("score")).where("model IS NOT NULL AND (tier IS NULL OR tier IN ('T1', 'T2', 'T3'))")
    return out.select("model", F.coalesce("tier", F.lit("overall")).alias("tier"), "cases", "score")


def sample_pass_rate(results: DataFrame) -> DataFrame:
    out = results.groupBy("model", "item_id").agg(F.count("*").alias("n_total"), passed().alias("n_pass"))
    return out.withColumn("pass_rate", F.when(F.col("n_total") == 0, 1.0).otherwise(F.round(F.col("n_pass") / F.col("n_total"), 4))).withColumn("all_pass", F.col("n_pass") == F.col("n_total"))


def pass_totals(results: DataFrame) -> DataFrame:
    cases = case_scores(results)
    return cases.groupBy("model").agg(
        share(F.sum("hard_passed"), F.sum("hard_total")).alias("hard_rate"),
        share(F.sum("soft_passed"), F.sum("soft_total")).alias("soft_rate"),
        share(F.sum("passed"), F.sum("total")).alias("rate"),
        share(F.count_if(F.col("passed") == F.col("total")), F.count("*")).alias("prompt_rate"),
    )


def tag_pass_rates(results: DataFrame) -> DataFrame:
    out = results.groupBy(F.coalesce("tag", F.lit("unknown")).alias("tag")).agg(F.count("*").alias("total"), passed().alias("passed"))
    return out.withColumn("rate", share(F.col("passed"), F.col("total"))).orderBy("rate", "tag")


def survival_by_threshold(results: DataFrame, thresholds: Sequence[float] = (1.0, 0.95, 0.9, 0.85, 0.8)) -> DataFrame:
    rates = sample_pass_rate(results).agg(F.count("*").alias("n"), *[F.count_if(F.col("pass_rate") >= t).alias(f"k{i}") for i, t in enumerate(thresholds)])
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("kept")) for i, t in enumerate(thresholds)]))
    return rates.select("n", rows.alias("r")).select("r.threshold", "r.kept", share(F.col("r.kept"), F.col("n")).alias("share"))


def dropped_samples(results: DataFrame, threshold: float = 0.9, limit: int = 20) -> DataFrame:
    """The worst samples under the threshold (a top-k report) with their failed tags."""
    worst = sample_pass_rate(results).where(F.col("pass_rate") < threshold).orderBy("pass_rate", F.desc("n_total"), "model", "item_id").limit(limit)
    failed = results.where(F.coalesce("score", F.lit(0)) != 1).join(F.broadcast(worst.select("model", "item_id")), ["model", "item_id"])
    tags = failed.groupBy("model", "item_id").agg(F.array_join(F.array_sort(F.collect_set(F.coalesce("tag", F.lit("unknown")))), ",").alias("failed_tags"))
    return worst.select("model", "item_id", "n_total", "n_pass", "pass_rate").join(tags, ["model", "item_id"], "left")


def constraints_of(results: DataFrame) -> DataFrame:
    """The constraint list behind the results of several models."""
    return results.groupBy("item_id", "constraint_index").agg(F.max("tag").alias("tag"), F.max("type").alias("type"))


def with_missing(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """Every constraint for every model; a missing result has a null score."""
    every = constraints_of(results).withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    return every.join(results.select("model", "item_id", "constraint_index", "score"), ["model", "item_id", "constraint_index"], "left")


def model_rates(results: DataFrame, models: Sequence[str], dimension: Column, name: str) -> DataFrame:
    out = with_missing(results, models).groupBy("model", dimension.alias(name)).agg(F.count("*").alias("total"), passed().alias("passed"))
    return out.withColumn("rate", F.round(100.0 * F.col("passed") / F.col("total"), 1))


def difficulty_rates(results: DataFrame, models: Sequence[str], easy: int = 3) -> DataFrame:
    every = with_missing(results, models)
    sizes = constraints_of(results).groupBy("item_id").agg(F.when(F.count("*") <= easy, "easy").otherwise("hard").alias("difficulty"))
    out = every.join(sizes, "item_id").groupBy("model", "difficulty").agg(F.count("*").alias("total"), passed().alias("passed"))
    return out.withColumn("rate", F.round(100.0 * F.col("passed") / F.col("total"), 1))


def tags_by_avg_rate(results: DataFrame, models: Sequence[str]) -> DataFrame:
    rates = model_rates(results, models, F.coalesce("tag", F.lit("unknown")), "tag").withColumn("r", 100.0 * F.col("passed") / F.col("total"))
    return rates.groupBy("tag").agg(F.round(F.avg("r"), 1).alias("avg_rate")).orderBy(F.desc("avg_rate"), "tag")


def constraint_model_matrix(results: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row a constraint, one boolean a model; missing is false."""
    wide = results.withColumn("ok", F.coalesce("score", F.lit(0)) == 1).groupBy("item_id", "constraint_index").pivot("model", list(models)).agg(F.bool_or("ok"))
    return wide.select("item_id", "constraint_index", *[F.coalesce(F.col(m), F.lit(False)).alias(m) for m in models])


def matrix_filter(results: DataFrame, models: Sequence[str], *, tag: str | None = None, kind: str | None = None, text: str | None = None, agreement: str | None = None, sort: str | None = None, ascending: bool = True) -> DataFrame:
    """Rows of the matrix by tag, type, a text in the key or the constraint (in any case), and agreement (all_pass, all_fail or differ),
    sorted by one of the columns (texts in any case)."""
    words = ["constraint"] if "constraint" in results.columns else []
    more = results.groupBy("item_id", "constraint_index").agg(F.max("tag").alias("tag"), F.max("type").alias("type"), *[F.max(w).alias(w) for w in words])
    rows = constraint_model_matrix(results, models).join(more, ["item_id", "constraint_index"])
    rows = rows.withColumn("key", F.concat(F.col("item_id").cast("string"), F.lit("#C"), (F.col("constraint_index") + 1).cast("string")))
    cells = F.array(*models)
    every, some = F.forall(cells, lambda x: x), F.exists(cells, lambda x: x)
    tests = [F.col("tag") == tag] if tag else []
    tests += [F.col("type") == kind] if kind else []
    if text:
        found = [F.lower(F.coalesce(c, F.lit(""))).contains(text.lower()) for c in ("key", *words)]
        tests.append(found[0] | found[-1])
    tests += [{"all_pass": every, "all_fail": ~some, "differ": some & ~every}[agreement]] if agreement else []
    for test in tests:
        rows = rows.where(test)
    if sort:
        by = F.lower(sort) if rows.schema[sort].dataType.simpleString() == "string" else F.col(sort)
        rows = rows.orderBy(by.asc() if ascending else by.desc(), "item_id", "constraint_index")
    return rows


def radar_rates(results: DataFrame) -> DataFrame:
    """Tag and category rates per model over the results present."""
    rows = results.where("score IS NOT NULL").select("model", "score", F.explode(F.array(F.concat(F.lit("tag:"), F.coalesce("tag", F.lit("unknown"))), F.concat(F.lit("category:"), F.substring(F.coalesce("tag", F.lit("unknown")), 1, 1)))).alias("axis"))
    return rows.groupBy("model", "axis").agg(F.count("*").alias("total"), passed().alias("passed")).withColumn("rate", share(F.col("passed"), F.col("total")))


def accuracy_by_constraint_count(results: DataFrame) -> DataFrame:
    items = results.groupBy("model", "item_id").agg(F.count("*").alias("n_constraints"), F.bool_and(F.coalesce("score", F.lit(0)) == 1).alias("ok"))
    return items.groupBy("model", "n_constraints").agg(F.count("*").alias("items"), F.round(F.avg(F.col("ok").cast("int")), 4).alias("accuracy"))


def dual_axis_scores(cases: DataFrame, tiers: DataFrame) -> DataFrame:
    """Compliance and correctness of each model and of its tiers T1 to T3, in percent.

    cases: model, item_id, compliance, correctness (shares, may be null). tiers: model, tier (overall, T1, ...), compliance, correctness as
    scored before; an overall score that is missing there falls back to the mean over cases, a tier's stays null.
    """
    means = cases.groupBy("model").agg(F.count("*").alias("n_cases"), F.avg("compliance").alias("c"), F.avg("correctness").alias("r"))
    of = lambda what, tier: F.max(F.when(F.col("tier") == tier, F.col(what)))
    wide = tiers.groupBy("model").agg(*[of(w, t).alias(f"{w}_{t}") for w in ("compliance", "correctness") for t in ("overall", "T1", "T2", "T3")])
    percent = lambda c: F.round(100 * c, 1)
    out = means.join(wide, "model", "left")
    return out.select(
        "model",
        "n_cases",
        percent(F.coalesce("compliance_overall", "c")).alias("compliance"),
        percent(F.coalesce("correctness_overall", "r")).alias("correctness"),
        *[percent(F.col(f"{w}_{t}")).alias(f"{w}_{t}") for w in ("compliance", "correctness") for t in ("T1", "T2", "T3")],
    )


def sft_gain(results: DataFrame, before: str, after: str, quality: DataFrame | None = None) -> DataFrame:
    """ISR (percent) and mean quality of two models by workflow and over all, and the differences."""
    items = results.where(F.col("model").isin(before, after)).groupBy("model", "item_id").agg(F.bool_and(F.coalesce("score", F.lit(0)) == 1).alias("ok"))
    items = items.join(quality, ["model", "item_id"], "left") if quality is not None else items.withColumn("quality", F.lit(None).cast("double"))
    of = lambda m, what: F.avg(F.when(F.col("model") == m, what))
    ok = F.col("ok").cast("int") * 100
    out = items.withColumn("workflow", F.explode(F.array(F.split("item_id", r"\.")[0], F.lit("overall"))))
    out = out.groupBy("workflow").agg(of(before, ok).alias("b"), of(after, ok).alias("a"), of(before, F.col("quality")).alias("qb"), of(after, F.col("quality")).alias("qa"))
    r = lambda c, name: F.round(c, 2).alias(name)
    return out.select("workflow", r(F.col("b"), "before"), r(F.col("a"), "after"), r(F.col("a") - F.col("b"), "gain"), r(F.col("qb"), "quality_before"), r(F.col("qa"), "quality_after"), r(F.col("qa") - F.col("qb"), "quality_gain"))


def quality_cap(results: DataFrame, quality: DataFrame) -> DataFrame:
    """Quality after caps: one failed central tag 6, two or more 4, a severe one 3; the raw score stays.

    A central failure is severe by its tag or by the words of its constraint (if results have them).
    """
    tag = F.upper("tag")
    failed = (F.col("score") == 0) & tag.isin(*CENTRAL)
    severe = tag.isin(*SEVERE)
    if "constraint" in results.columns:
        words = fold(F.coalesce("constraint", F.lit("")))
        severe = severe | F.exists(F.array(*[F.lit(t) for t in SEVERE_TERMS]), lambda t: words.contains(t))
    counts = results.groupBy("model", "item_id").agg(F.count_if(failed).alias("failed"), F.count_if(failed & severe).alias("severe"))
    cap = F.when(F.col("severe") > 0, 3).when(F.col("failed") >= 2, 4).when(F.col("failed") >= 1, 6).otherwise(10)
    return quality.join(counts, ["model", "item_id"], "left").select("model", "item_id", F.col("quality").alias("raw_quality"), F.least("quality", cap).cast("long").alias("quality"))
