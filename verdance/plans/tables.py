"""Queries of keys, reports, judge tables and data construction over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.operators import construct as C
from verdance.operators import judge as J
from verdance.operators import keys as K
from verdance.operators import reports as P

from .demo import RESULTS, spark_rows, with_sql

CONS = "SELECT item_id, constraint_index, max(tag) AS tag, max(type) AS type, max(method) AS method FROM ({results}) AS r GROUP BY item_id, constraint_index"
CONSTRAINTS = CONS.replace("{results}", RESULTS)
SAMPLES = f"SELECT item_id, substr(item_id, 1, 2) AS l1, substr(item_id, 1, 4) AS l2, CASE WHEN substr(item_id, 4, 1) = '3' THEN '' ELSE 'set' || substr(item_id, 4, 1) END AS source, count(*) AS n_constraints, sum(CASE WHEN type = 'hard' THEN 1 ELSE 0 END) AS hard, sum(CASE WHEN type = 'soft' THEN 1 ELSE 0 END) AS soft FROM ({CONSTRAINTS}) AS c GROUP BY item_id"
#: Events as votes: a user is an item, the order of events the repeats, the kind the verdict.
VOTES = "SELECT user_id AS item_id, event_id % 3 AS constraint_index, event_id AS repeat, CASE WHEN value > 10 THEN 1 ELSE 0 END AS score, 'because of ' || event_type AS reason FROM {events}"
QUALITIES = "SELECT user_id AS item_id, event_id AS repeat, CAST(event_id % 11 AS BIGINT) AS quality, event_type AS reason FROM {events}"
#: Orders of a customer as candidates.
CANDIDATES = "SELECT o_custkey AS sample_id, o_orderkey AS index, o_orderstatus || o_orderpriority AS response, CAST(o_orderkey % 5 AS DOUBLE) / 4 AS score FROM {orders}"
CITES = "SELECT l_orderkey AS item, 'DOC-' || CAST(l_suppkey AS STRING) AS document FROM {lineitem}"
DOCS = "SELECT doc_id, text, lang, source FROM {documents}"


def on(text, work):
    return lambda spark, sf_dir: work(spark_rows(spark, sf_dir, text))


def on2(a, b, work):
    return lambda spark, sf_dir: work(spark_rows(spark, sf_dir, a), spark_rows(spark, sf_dir, b))


CONFIGS = "SELECT c_custkey AS item_id, c_mktsegment AS seg FROM {customer}"

QUERIES = {
    "route_constraints": on(CONSTRAINTS, lambda c: K.route_constraints(c.withColumn("check_type", F.when(F.col("tag").isNull(), F.lit(None)).when(F.col("tag") == "DB4", "odd").when(F.col("type") == "hard", "Rule").otherwise("judge")).withColumn("has_config", F.col("constraint_index") != 1)).groupBy("route", "reject_reason").agg(F.count("*").alias("n"))),
    "join_scored_pairs": on2(CANDIDATES, "SELECT c_custkey AS sample_id, c_mktsegment AS segment FROM {customer} WHERE c_nationkey < 10", lambda a, b: K.join_scored_pairs(a, b, "sample_id").groupBy("segment").agg(F.count("*").alias("n"))),
    "group_by_case": on(CONSTRAINTS, lambda c: K.group_by_case(c.select(F.concat("item_id", F.lit("#C"), (F.col("constraint_index") + 1).cast("string")).alias("constraint_key"))).select("case_id", F.array_join("constraint_keys", ",").alias("constraint_keys"))),
    "resume_todo": on2("SELECT o_orderkey AS id FROM {orders}", "SELECT l_orderkey AS id FROM {lineitem} WHERE l_quantity > 45", lambda a, b: K.resume_todo(a, b, ["id"])),
    "merge_override": on2("SELECT c_custkey AS id, c_name AS text, c_mktsegment AS seg FROM {customer}", "SELECT s_suppkey AS id, s_name AS text, CAST(NULL AS STRING) AS seg FROM {supplier}", lambda a, b: K.merge_override(a, b, "id", ["text", "seg"])),
    "apply_repairs": on2("SELECT c_custkey AS id, c_name AS response FROM {customer}", "SELECT p_partkey AS id, p_name AS text FROM {part}", lambda a, b: K.apply_repairs(a, b, "id")),
    "resolve_config": on(CONFIGS, lambda r: r.select("item_id", F.array_join(F.transform(F.array_sort(F.map_entries(K.resolve_config([F.create_map(F.lit("min"), F.lit("1"), F.lit("mode"), F.col("seg")), F.when(F.col("item_id") % 2 == 0, F.create_map(F.lit("min"), F.lit("2")))], F.create_map(F.lit("min"), F.lit("9"), F.lit("max"), F.col("item_id").cast("string"))))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("config"))),
    "resolve_checker": on(CONFIGS, lambda r: r.select("item_id", K.resolve_checker(F.when(F.col("item_id") % 3 == 0, F.lit("Check-JSON format")), F.when(F.col("item_id") % 3 == 1, F.lit(" ")), F.col("seg")).alias("checker"))),
    "constraint_distribution": on(CONSTRAINTS, P.constraint_distribution),
    "constraints_per_case": on(CONSTRAINTS, P.constraints_per_case),
    "tier_distribution": on(CONSTRAINTS, P.tier_distribution),
    "usage_distribution": on(CONSTRAINTS, lambda c: P.usage_distribution(c, 37)),
    "response_length_stats": on(DOCS, lambda d: P.response_length_stats(d, "source", F.length("text"))),
    "family_share": on(CONSTRAINTS, P.family_share),
    "context_reuse": on(CITES, lambda c: P.context_reuse(c, "item", "document")),
    "parse_judge_lenient": on("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '{{\"pass\": true}}' WHEN 1 THEN '{{\"pass\": false' WHEN 2 THEN 'none' ELSE 'x \"pass\" : TRUE' END AS raw FROM {events}", lambda r: r.select("id", H.judge_lenient("raw").alias("passed"))),
    "majority_vote": on(VOTES, J.majority_vote),
    "quality_mean": on(QUALITIES, J.quality_mean),
    "sample_constraint_count": on(CONFIGS, lambda r: r.select("item_id", C.sample_constraint_count(F.col("item_id").cast("string")).alias("n"))),
    "trim_constraints": on(CONSTRAINTS, lambda c: C.trim_constraints(c.select("item_id", "constraint_index", "tag"), c.select("item_id").distinct().withColumn("keep", F.lit(3)))),
    "best_of_n": on(CANDIDATES, C.best_of_n),
    "candidate_summary": on(CANDIDATES, C.candidate_summary),
    "sharegpt_pairs": on2("SELECT conv_id AS sample_id, max(text) AS prompt FROM {conversations} WHERE role = 'user' GROUP BY conv_id", "SELECT conv_id AS sample_id, min(text) AS response FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id", lambda p, r: C.sharegpt_pairs(p, r).select("sample_id", F.array_join(F.transform("conversations", lambda t: F.concat(t["from"], F.lit(":"), t["value"])), "|").alias("chat"))),
}


U = "((('0x' || substr(md5('{seed}' || '|' || {key}), 1, 12))::BIGINT + 1)::DOUBLE / 281474976710658.0::DOUBLE)"
SQL = {
    "route_constraints": "WITH c AS (SELECT CASE WHEN tag IS NULL THEN 'llm' WHEN tag = 'DB4' THEN 'odd' WHEN type = 'hard' THEN 'rule' ELSE 'llm' END AS t, constraint_index <> 1 AS cfg FROM cons) SELECT CASE WHEN t = 'odd' OR (t = 'rule' AND NOT cfg) THEN 'reject' WHEN t = 'rule' THEN 'rule' ELSE 'LLM' END AS route, CASE WHEN t = 'odd' THEN 'unknown check_type' WHEN t = 'rule' AND NOT cfg THEN 'rule without settings' END AS reject_reason, count(*) AS n FROM c GROUP BY ALL",
    "join_scored_pairs": "SELECT c_mktsegment AS segment, count(*) AS n FROM candidates JOIN customer ON c_custkey = sample_id WHERE c_nationkey < 10 GROUP BY ALL",
    "group_by_case": "SELECT item_id AS case_id, string_agg(item_id || '#C' || (constraint_index + 1)::VARCHAR, ',' ORDER BY constraint_index) AS constraint_keys FROM cons GROUP BY item_id",
    "resume_todo": "SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "merge_override": "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS text, CASE WHEN s_suppkey IS NULL THEN c_mktsegment END AS seg FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "apply_repairs": "SELECT coalesce(c_custkey, p_partkey) AS id, coalesce(p_name, c_name) AS response, p_name IS NOT NULL AS repaired FROM customer FULL JOIN part ON p_partkey = c_custkey",
    "resolve_config": "SELECT c_custkey AS item_id, 'max=' || c_custkey::VARCHAR || ';min=' || CASE WHEN c_custkey % 2 = 0 THEN '2' ELSE '1' END || ';mode=' || c_mktsegment AS config FROM customer",
    "resolve_checker": "SELECT c_custkey AS item_id, CASE WHEN c_custkey % 3 = 0 THEN 'valid_json' ELSE replace(lower(c_mktsegment), ' ', '_') END AS checker FROM customer",
    "constraint_distribution": "SELECT dimension, value, count(*) AS n FROM (SELECT 'tag' AS dimension, coalesce(tag, 'unknown') AS value FROM cons UNION ALL SELECT 'category', substr(coalesce(tag, 'unknown'), 1, 1) FROM cons UNION ALL SELECT 'type', type FROM cons) GROUP BY ALL",
    "constraints_per_case": "SELECT n_constraints, count(*) AS cases, CASE WHEN n_constraints <= 3 THEN 'easy' ELSE 'hard' END AS difficulty FROM (SELECT item_id, count(*) AS n_constraints FROM cons GROUP BY item_id) GROUP BY n_constraints",
    "tier_distribution": "SELECT split_part(item_id, '.', 1) AS l1, split_part(item_id, '-', 1) AS l2, count(DISTINCT item_id) AS cases FROM cons GROUP BY ALL",
    "usage_distribution": "SELECT method, coalesce(tag, 'unknown') AS tag, count(*) AS uses, (SELECT count(DISTINCT coalesce(tag, 'unknown')) FROM cons) AS distinct_used, 37::BIGINT AS pool_size FROM cons GROUP BY method, 2",
    "response_length_stats": "SELECT source, count(*) AS n, round(avg(length(text)), 4) AS mean, quantile_cont(length(text), 0.5) AS median, min(length(text))::DOUBLE AS min, max(length(text))::DOUBLE AS max, round(stddev_pop(length(text)), 4) AS std, quantile_cont(length(text), 0.25) AS q1, quantile_cont(length(text), 0.75) AS q3 FROM documents GROUP BY source",
    "family_share": "SELECT family, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 4) AS share FROM (SELECT CASE WHEN tag IS NULL THEN 'unknown' WHEN tag LIKE 'RC%' THEN 'EG' ELSE regexp_extract(tag, '^[A-Z]+') END AS family FROM cons) GROUP BY family",
    "context_reuse": "WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS s FROM lineitem GROUP BY 1), d AS (SELECT 'DOC-' || l_suppkey::VARCHAR AS l_suppkey, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 1) SELECT (SELECT count(*) FROM s) AS items, (SELECT count(DISTINCT s) FROM s) AS context_sets, l_suppkey AS top_document, n AS top_cites FROM d",
    "parse_judge_lenient": "SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 3 THEN true END AS passed FROM events",
    "majority_vote": "SELECT item_id, constraint_index, votes, score, CASE WHEN score = 1 THEN r1 ELSE r0 END AS reason FROM (SELECT item_id, constraint_index, count(*) AS votes, (CASE WHEN 2 * sum(score) > count(*) THEN 1 WHEN 2 * sum(score) < count(*) THEN 0 ELSE arg_max(score, repeat) END)::INT AS score, arg_max(reason, repeat) FILTER (score = 1) AS r1, arg_max(reason, repeat) FILTER (score = 0) AS r0 FROM votes GROUP BY ALL)",
    "quality_mean": "SELECT item_id, round_even(avg(quality), 0)::BIGINT AS quality, arg_max(reason, repeat) AS reason FROM qualities GROUP BY item_id",
    "sample_constraint_count": f"SELECT c_custkey AS item_id, (CASE WHEN u < 10 THEN 1 WHEN u < 30 THEN 2 WHEN u < 60 THEN 3 WHEN u < 85 THEN 4 ELSE 5 END)::BIGINT AS n FROM (SELECT c_custkey, {U.format(seed='count', key='c_custkey::VARCHAR')} * 100 AS u FROM customer)",
    "trim_constraints": "SELECT item_id, constraint_index, tag FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY CASE WHEN nth > 1 THEN 1 ELSE 0 END, freq, constraint_index) AS r FROM (SELECT *, row_number() OVER (PARTITION BY item_id, tag ORDER BY constraint_index) AS nth, count(*) OVER (PARTITION BY tag) AS freq FROM cons)) WHERE r <= 3",
    "best_of_n": "SELECT sample_id, index, response, score FROM candidates QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, length(response), index) = 1",
    "candidate_summary": "SELECT count(*) AS samples, round(avg(s), 4) AS mean_score, round(avg((s = 1)::INT), 4) AS perfect, round(avg((s >= 0.5)::INT), 4) AS half FROM (SELECT max(score) AS s FROM candidates GROUP BY sample_id)",
    "sharegpt_pairs": "SELECT conv_id AS sample_id, 'human:' || p || '|gpt:' || r AS chat FROM (SELECT conv_id, min(text) FILTER (role = 'assistant') AS r, max(text) FILTER (role = 'user') AS p, count(*) FILTER (role = 'user') AS u FROM conversations GROUP BY 1) WHERE trim(r) <> '' AND u > 0",
}
PARTS = {"results": RESULTS, "cons": CONSTRAINTS, "samples": SAMPLES, "votes": VOTES, "qualities": QUALITIES, "candidates": CANDIDATES}
ORACLES = {name: with_sql("SELECT * FROM (" + text + ")", **{k: v for k, v in PARTS.items() if k in text}) for name, text in SQL.items()}
