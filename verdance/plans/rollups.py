"""Queries of scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdance.operators import rollups as R

from .demo import QUALITY, RESULTS, spark_rows, with_sql

MODELS = ("m0", "m1", "m2", "m3")


def on_results(work):
    return lambda spark, sf_dir: work(spark_rows(spark, sf_dir, RESULTS))


def on_both(work):
    return lambda spark, sf_dir: work(spark_rows(spark, sf_dir, RESULTS), spark_rows(spark, sf_dir, QUALITY))


def with_words(results):
    """Wording for the constraints: every third speaks of a route, and each is rule <index>."""
    route = F.when(F.col("constraint_index") % 3 == 2, " on the ROUTE taken").otherwise("")
    return results.withColumn("constraint", F.concat(F.lit("Rule "), F.col("constraint_index").cast("string"), route))


def axis_cases(results, quality):
    """Compliance of each case from its results, correctness from its quality where that is not 0."""
    cases = R.case_scores(results).select("model", "item_id", (F.col("passed") / F.col("total")).alias("compliance"))
    return cases.join(quality, ["model", "item_id"], "left").select("model", "item_id", "compliance", (F.nullif("quality", F.lit(0)) / 10).alias("correctness"))


def axis_tiers(results):
    """Tier scores of two models; only one of them has an overall score."""
    tiers = R.tier_scores(results).where("model IN ('m0', 'm1') AND (tier <> 'overall' OR model = 'm0')")
    return tiers.select("model", "tier", F.col("score").alias("compliance"), F.when(F.col("tier") != "overall", F.col("score") / 2).alias("correctness"))


QUERIES = {
    "item_summary": on_results(R.item_summary),
    "by_method": on_results(R.by_method),
    "by_tag": on_results(R.by_tag),
    "dataset_summary": on_both(R.dataset_summary),
    "isr": on_results(R.isr),
    "csr": on_results(R.csr),
    "metrics_by_dimension": on_both(R.metrics_by_dimension),
    "leaderboard": on_both(R.leaderboard),
    "case_scores": on_results(R.case_scores),
    "tier_scores": on_results(R.tier_scores),
    "sample_pass_rate": on_results(R.sample_pass_rate),
    "pass_totals": on_results(R.pass_totals),
    "tag_pass_rates": on_results(R.tag_pass_rates),
    "survival_by_threshold": on_results(R.survival_by_threshold),
    "dropped_samples": on_results(R.dropped_samples),
    "model_tag_rates": on_results(lambda r: R.model_rates(r, MODELS, F.coalesce("tag", F.lit("unknown")), "tag")),
    "model_category_rates": on_results(lambda r: R.model_rates(r, MODELS, F.substring(F.coalesce("tag", F.lit("unknown")), 1, 1), "category")),
    "model_type_rates": on_results(lambda r: R.model_rates(r, MODELS, F.col("type"), "type")),
    "model_l2_rates": on_results(lambda r: R.model_rates(r, MODELS, F.split("item_id", "-")[0], "l2")),
    "difficulty_rates": on_results(lambda r: R.difficulty_rates(r, MODELS)),
    "tags_by_avg_rate": on_results(lambda r: R.tags_by_avg_rate(r, MODELS)),
    "constraint_model_matrix": on_results(lambda r: R.constraint_model_matrix(r, MODELS)),
    "matrix_filter": on_results(lambda r: R.matrix_filter(with_words(r), MODELS, tag="EG1", text="RULE 2", agreement="differ", sort="m1")),
    "radar_rates": on_results(R.radar_rates),
    "accuracy_by_constraint_count": on_results(R.accuracy_by_constraint_count),
    "dual_axis_scores": on_both(lambda r, q: R.dual_axis_scores(axis_cases(r, q), axis_tiers(r))),
    "sft_gain": on_both(lambda r, q: R.sft_gain(r, "m0", "m1", q)),
    "quality_cap": on_both(lambda r, q: R.quality_cap(with_words(r), q)),
}

P = "count(*) FILTER (score = 1)"
ITEMS = f"SELECT model, item_id, count(*) AS t, count(score) AS d, {P} AS p, bool_and(coalesce(score, 0) = 1) AS ok FROM results GROUP BY ALL"
CASES = f"SELECT model, item_id, count(*) AS total, {P} AS passed, count(*) FILTER (type = 'hard') AS hard_total, count(*) FILTER (type = 'hard' AND score = 1) AS hard_passed, count(*) FILTER (type <> 'hard') AS soft_total, count(*) FILTER (type <> 'hard' AND score = 1) AS soft_passed FROM results GROUP BY ALL"
CONS = "SELECT item_id, constraint_index, max(tag) AS tag, max(type) AS type FROM results GROUP BY ALL"
EVERY = f"SELECT m.model, c.*, r.score FROM ({CONS}) c CROSS JOIN (VALUES ('m0'), ('m1'), ('m2'), ('m3')) AS m(model) LEFT JOIN results r ON r.model = m.model AND r.item_id = c.item_id AND r.constraint_index = c.constraint_index"
MATRIX = "SELECT item_id, constraint_index, " + ", ".join(f"coalesce(bool_or(coalesce(score, 0) = 1) FILTER (model = '{m}'), false) AS {m}" for m in MODELS) + " FROM results GROUP BY ALL"
ISR_OF, Q_OF = "avg(ok::INT) FILTER (model = '{}') * 100", "avg(quality) FILTER (model = '{}')"
RATE = f"count(*) AS total, {P} AS passed, round(100.0::DOUBLE * {P} / count(*), 1) AS rate"
SHARE = "round({0}::DOUBLE / {1}, 4)"


def rates(dimension: str, name: str) -> str:
    return f"SELECT model, {dimension} AS {name}, {RATE} FROM ({EVERY}) GROUP BY ALL"


SQL = {
    "item_summary": f"SELECT model, item_id, t AS total, d AS decided, p AS passed, t - d AS needs_judge, CASE WHEN d > 0 THEN round(p::DOUBLE / d, 4) END AS score, round(d::DOUBLE / t, 4) AS coverage FROM ({ITEMS})",
    "by_method": f"SELECT model, coalesce(split_part(method, ':', 1), 'unknown') AS method, count(*) AS total, {P} AS passed, count(*) FILTER (score IS NULL) AS needs_judge FROM results GROUP BY ALL",
    "by_tag": f"SELECT model, coalesce(tag, 'unknown') AS tag, count(*) AS total, {P} AS passed, count(*) FILTER (score IS NULL) AS needs_judge FROM results GROUP BY ALL",
    "dataset_summary": f"""SELECT model, count(*) AS items, round(sum(p)::DOUBLE / sum(d), 4) AS micro_score, round(avg(CASE WHEN d > 0 THEN p::DOUBLE / d END), 4) AS macro_score,
        round(count(*) FILTER (d = t AND p = t)::DOUBLE / count(*) FILTER (d = t), 4) AS exact_item_pass_rate, round(sum(d)::DOUBLE / sum(t), 4) AS coverage, round(avg(quality), 4) AS quality,
        round(0.8::DOUBLE * sum(p)::DOUBLE / sum(d) + 0.2::DOUBLE * avg(quality) / 10, 4) AS final FROM ({ITEMS}) LEFT JOIN quality USING (model, item_id) GROUP BY model""",
    "isr": f"SELECT model, count(*) AS items, round(avg(ok::INT), 4) AS isr FROM ({ITEMS}) GROUP BY model",
    "csr": f"SELECT model, count(*) AS total, {P} AS passed, round({P}::DOUBLE / count(*), 4) AS csr FROM results GROUP BY model",
    "metrics_by_dimension": "SELECT model, dimension, value, count(*) AS items, sum(n)::BIGINT AS total, sum(p)::BIGINT AS passed, round(count(*) FILTER (n = p)::DOUBLE / count(*), 4) AS isr, round(sum(p)::DOUBLE / sum(n), 4) AS csr, round(avg(quality), 4) AS quality FROM (SELECT model, item_id, dimension, value, count(*) AS n, count(*) FILTER (score = 1) AS p FROM ("
    + " UNION ALL ".join(f"SELECT model, item_id, score, '{d}' AS dimension, {e} AS value FROM results" for d, e in (("workflow", "split_part(item_id, '.', 1)"), ("task", "split_part(item_id, '-', 1)"), ("family", "CASE WHEN tag IS NULL THEN 'unknown' WHEN tag LIKE 'RC%' THEN 'EG' ELSE regexp_extract(tag, '^[A-Z]+') END"), ("tag", "coalesce(tag, 'unknown')")))
    + ") GROUP BY ALL) LEFT JOIN quality USING (model, item_id) GROUP BY ALL",
    "leaderboard": f"SELECT model, items, isr, csr, quality FROM (SELECT model, count(*) AS items, round(avg(ok::INT), 4) AS isr FROM ({ITEMS}) GROUP BY model) JOIN (SELECT model, round({P}::DOUBLE / count(*), 4) AS csr FROM results GROUP BY model) USING (model) LEFT JOIN (SELECT model, round(avg(quality), 4) AS quality FROM quality GROUP BY model) USING (model)",
    "case_scores": CASES,
    "tier_scores": f"WITH c AS (SELECT model, split_part(item_id, '.', 1) AS tier, passed::DOUBLE / total AS s FROM ({CASES})) SELECT model, tier, count(*) AS cases, round(avg(s), 4) AS score FROM c WHERE tier IN ('T1', 'T2', 'T3') GROUP BY ALL UNION ALL SELECT model, 'overall', count(*), round(avg(s), 4) FROM c GROUP BY model",
    "sample_pass_rate": f"SELECT model, item_id, t AS n_total, p AS n_pass, round(p::DOUBLE / t, 4) AS pass_rate, p = t AS all_pass FROM ({ITEMS})",
    "pass_totals": f"SELECT model, round(sum(hard_passed)::DOUBLE / sum(hard_total), 4) AS hard_rate, round(sum(soft_passed)::DOUBLE / sum(soft_total), 4) AS soft_rate, round(sum(passed)::DOUBLE / sum(total), 4) AS rate, round(count(*) FILTER (passed = total)::DOUBLE / count(*), 4) AS prompt_rate FROM ({CASES}) GROUP BY model",
    "tag_pass_rates": f"SELECT coalesce(tag, 'unknown') AS tag, count(*) AS total, {P} AS passed, round({P}::DOUBLE / count(*), 4) AS rate FROM results GROUP BY 1",
    "survival_by_threshold": f"SELECT threshold::DOUBLE AS threshold, count(*) FILTER (rate >= threshold) AS kept, round(count(*) FILTER (rate >= threshold)::DOUBLE / count(*), 4) AS share FROM (SELECT round(p::DOUBLE / t, 4) AS rate FROM ({ITEMS})) CROSS JOIN (VALUES (1.0::DOUBLE), (0.95::DOUBLE), (0.9::DOUBLE), (0.85::DOUBLE), (0.8::DOUBLE)) AS x(threshold) GROUP BY threshold",
    "dropped_samples": f"WITH w AS (SELECT model, item_id, t AS n_total, p AS n_pass, round(p::DOUBLE / t, 4) AS pass_rate FROM ({ITEMS}) WHERE round(p::DOUBLE / t, 4) < 0.9 ORDER BY pass_rate, n_total DESC, model, item_id LIMIT 20) SELECT w.*, f.failed_tags FROM w LEFT JOIN (SELECT model, item_id, string_agg(DISTINCT coalesce(tag, 'unknown'), ',' ORDER BY coalesce(tag, 'unknown')) AS failed_tags FROM results WHERE coalesce(score, 0) <> 1 GROUP BY ALL) f USING (model, item_id)",
    "model_tag_rates": rates("coalesce(tag, 'unknown')", "tag"),
    "model_category_rates": rates("substr(coalesce(tag, 'unknown'), 1, 1)", "category"),
    "model_type_rates": rates("type", "type"),
    "model_l2_rates": rates("split_part(item_id, '-', 1)", "l2"),
    "difficulty_rates": f"SELECT model, difficulty, {RATE} FROM ({EVERY}) JOIN (SELECT item_id, CASE WHEN count(*) <= 3 THEN 'easy' ELSE 'hard' END AS difficulty FROM ({CONS}) GROUP BY item_id) USING (item_id) GROUP BY ALL",
    "tags_by_avg_rate": f"SELECT tag, round(avg(r), 1) AS avg_rate FROM (SELECT model, coalesce(tag, 'unknown') AS tag, 100.0::DOUBLE * {P} / count(*) AS r FROM ({EVERY}) GROUP BY ALL) GROUP BY tag",
    "constraint_model_matrix": MATRIX,
    "matrix_filter": f"SELECT m.*, c.tag, c.type, 'Rule 2 on the ROUTE taken' AS constraint, m.item_id || '#C3' AS key FROM ({MATRIX}) m JOIN ({CONS}) c USING (item_id, constraint_index) WHERE tag = 'EG1' AND constraint_index = 2 AND (m0 OR m1 OR m2 OR m3) AND NOT (m0 AND m1 AND m2 AND m3)",
    "radar_rates": f"SELECT model, axis, count(*) AS total, {P} AS passed, round({P}::DOUBLE / count(*), 4) AS rate FROM (SELECT model, score, 'tag:' || coalesce(tag, 'unknown') AS axis FROM results WHERE score IS NOT NULL UNION ALL SELECT model, score, 'category:' || substr(coalesce(tag, 'unknown'), 1, 1) FROM results WHERE score IS NOT NULL) GROUP BY ALL",
    "accuracy_by_constraint_count": f"SELECT model, t AS n_constraints, count(*) AS items, round(avg(ok::INT), 4) AS accuracy FROM ({ITEMS}) GROUP BY ALL",
    "dual_axis_scores": f"""WITH c AS (SELECT model, split_part(item_id, '.', 1) AS tier, passed::DOUBLE / total AS s FROM ({CASES})), t AS (SELECT model, tier, round(avg(s), 4) AS s FROM c WHERE model IN ('m0', 'm1') AND tier IN ('T1', 'T2', 'T3') GROUP BY ALL),
        o AS (SELECT model, round(avg(s), 4) AS s FROM c WHERE model = 'm0' GROUP BY model), m AS (SELECT model, count(*) AS n_cases, avg(s) AS s FROM c GROUP BY model), q AS (SELECT model, avg(nullif(quality, 0)::DOUBLE / 10) AS r FROM quality JOIN ({CASES}) USING (model, item_id) GROUP BY model)
        SELECT m.model, n_cases, round(100 * coalesce(o.s, m.s), 1) AS compliance, round(100 * q.r, 1) AS correctness, """ + ", ".join(f"round(100 * (SELECT {e} FROM t WHERE t.model = m.model AND tier = '{t}'), 1) AS {w}_{t}" for w, e in (("compliance", "s"), ("correctness", "s / 2")) for t in ("T1", "T2", "T3")) + " FROM m LEFT JOIN o ON o.model = m.model LEFT JOIN q ON q.model = m.model",
    "sft_gain": "SELECT w AS workflow, " + ", ".join(f"round({e.format('m1' if k else 'm0')}, 2) AS {n}" for n, e, k in (("before", ISR_OF, 0), ("after", ISR_OF, 1), ("quality_before", Q_OF, 0), ("quality_after", Q_OF, 1))) + f", round({ISR_OF.format('m1')} - {ISR_OF.format('m0')}, 2) AS gain, round({Q_OF.format('m1')} - {Q_OF.format('m0')}, 2) AS quality_gain FROM (SELECT i.*, q.quality, unnest([split_part(i.item_id, '.', 1), 'overall']) AS w FROM ({ITEMS}) i LEFT JOIN quality q USING (model, item_id)) GROUP BY w",
    "quality_cap": """SELECT q.model, q.item_id, quality AS raw_quality, least(quality, CASE WHEN coalesce(severe, 0) > 0 THEN 3 WHEN coalesce(failed, 0) >= 2 THEN 4 WHEN coalesce(failed, 0) >= 1 THEN 6 ELSE 10 END)::BIGINT AS quality
        FROM quality q LEFT JOIN (SELECT model, item_id, count(*) FILTER (score = 0 AND (tag LIKE 'EG%' OR tag LIKE 'QV%' OR tag LIKE 'DB%')) AS failed, count(*) FILTER (score = 0 AND (tag LIKE 'EG%' OR tag LIKE 'QV%' OR tag LIKE 'DB%') AND (tag IN ('EG1', 'EG2', 'DB1', 'DB3', 'DB4') OR constraint_index % 3 = 2)) AS severe FROM results GROUP BY ALL) c ON c.model = q.model AND c.item_id = q.item_id""",
}
ORACLES = {name: with_sql("SELECT * FROM (" + text + ")", results=RESULTS, quality=QUALITY) for name, text in SQL.items()}
