"""Queries of sources, matching, judge tables, statistics and data construction; the oracles are closed forms over the keys."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.operators import construct as C
from verdance.operators import judge as J
from verdance.operators import keys as K
from verdance.operators import reports as P
from verdance.sources import io
from verdance.sources.shared import scratch

from .checkers import MIXED, NUMBERED
from .demo import FACTS, QUALITY, RESPONSES, RESULTS, with_sql
from .tables import CANDIDATES, CONSTRAINTS, DOCS, U, on, on2

ORDERS = "SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderpriority AS pr FROM {orders}"
CUSTOMERS = "SELECT c_custkey AS item_id, c_nationkey AS nation, c_mktsegment AS seg FROM {customer}"
TEXT = lambda c: F.col(c).cast("string")


def lines_file(rows: DataFrame, order: str, line) -> str:
    """Lines in order, written as text files; their path."""
    path = scratch(rows.sparkSession, "lines")
    rows.orderBy(order).select(line.alias("value")).write.text(path)
    return path


def read_items(orders: DataFrame) -> DataFrame:
    """Keys of items read from JSON lines with blank and bad ones among them, and how often each occurs."""
    r = F.col("k") % 6
    record = lambda **kv: F.to_json(F.struct(*[v.alias(n) for n, v in kv.items()]))
    line = (
        F.when(r == 0, "")
        .when(r == 1, F.concat(F.lit("["), TEXT("k"), F.lit("]")))
        .when(r == 2, record(id=F.concat(F.lit(" A"), TEXT("k")), case_id=F.lit("x")))
        .when(r == 3, record(item_id=F.concat(F.lit("B"), (F.col("k") % 1000).cast("string"))))
        .when(r == 4, record(id=F.lit(" "), line_number=F.col("k"), query=TEXT("pr")))
        .otherwise(record(query=TEXT("pr")))
    )
    items, bad = io.read_items(orders.sparkSession, lines_file(orders, "k", line))
    found = items.groupBy("item_key").agg(F.count("*").alias("n"))
    return found.unionByName(bad.agg(F.lit("bad").alias("item_key"), F.count("*").alias("n")))


def read_report(orders: DataFrame) -> DataFrame:
    """The report of reading items with blank and bad lines and duplicate keys among them."""
    r = F.col("k") % 5
    line = F.when(r == 0, " ").when(r == 1, "{").when(r == 2, F.concat(F.lit('{"id": "D'), (F.col("k") % 100).cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('{"id": "'), TEXT("k"), F.lit('"}')))
    items, bad, report = io.read_items_counted(orders.sparkSession, lines_file(orders, "k", line))
    counted = items.agg(F.count("*").alias("items"), F.max("row").alias("last_row"))
    return counted.select(F.lit(report.lines).cast("long").alias("lines"), F.lit(report.blank).cast("long").alias("blank"), F.lit(report.bad).cast("long").alias("bad"), F.lit(report.duplicate_keys).cast("long").alias("duplicate_keys"), F.lit(",".join(report.first_duplicates)).alias("first"), "items", "last_row")


def appended(orders: DataFrame) -> DataFrame:
    """Batches of results written one after the other, the first of them twice, and what is left to do then."""
    spark, path = orders.sparkSession, scratch(orders.sparkSession, "appended")
    rows = orders.select(F.concat(F.lit("m"), (F.col("k") % 4).cast("string")).alias("model"), F.col("k").alias("case_id"), F.col("c").alias("score"))
    even, third = rows.where("case_id % 2 = 0"), rows.where("case_id % 3 = 0")
    for batch, own in (("a", even.where("case_id % 4 = 0")), ("a", even), ("b", third.unionByName(third)), ("a", even)):
        io.append_batch(own, path, batch, ["model", "case_id"])
    stored_rows = io.read_appended(spark, path, rows.schema).groupBy("batch").agg(F.count("*").alias("n"), F.sum("score").alias("total"))
    left = io.resume(rows, path, rows.schema, ["model", "case_id"]).agg(F.lit("todo").alias("batch"), F.count("*").alias("n"), F.sum("score").alias("total"))
    return stored_rows.unionByName(left)


def read_responses(orders: DataFrame) -> DataFrame:
    """The last response of each key from JSON lines; a row with a primary id does not register under its line number."""
    r, k = F.col("k") % 4, F.col("k")
    record = lambda **kv: F.to_json(F.struct(*[v.alias(n) for n, v in kv.items()]))
    said = F.concat(F.lit("by "), TEXT("k"))
    line = F.when(r == 0, record(id=k.cast("string"), line_number=k, response=said)).when(r == 1, record(case_id=(k - 1).cast("string"), output=said)).when(r == 2, record(line_number=-k, output=said)).otherwise(record(id=k.cast("string")))
    rows, bad = io.read_responses(orders.sparkSession, lines_file(orders, "k", line))
    return K.latest_responses(rows, "row").unionByName(bad.agg(F.lit("bad").alias("key"), F.count("*").cast("string").alias("response")))


def read_manifest(docs: DataFrame) -> DataFrame:
    path = scratch(docs.sparkSession, "manifest")
    rows = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("lang").alias("workflow"), F.when(F.length("text") > 1000, "ok").otherwise("failed").alias("status"), F.octet_length("text").cast("long").alias("bytes"))
    io.write_json_lines(rows, path)
    return io.read_context_manifest(docs.sparkSession, path)


def write_results(results: DataFrame, quality: DataFrame) -> DataFrame:
    """What the written files hold: rows of the long table and of the nested one, scores in order, final scores."""
    path, spark = scratch(results.sparkSession, "results"), results.sparkSession
    io.write_results(results, quality, path)
    items = spark.read.schema("model string, item_id string, results array<struct<constraint_index:long,tag:string,score:int,method:string>>").json(f"{path}/items")
    nested = items.groupBy("model").agg(F.count("*").alias("items"), F.sum(F.size("results")).alias("nested"), F.sum(F.aggregate("results", F.lit(0), lambda n, x: n + F.coalesce(x["score"], F.lit(0)) * (x["constraint_index"] + 1).cast("int"))).alias("weighted"))
    long = spark.read.parquet(f"{path}/results").groupBy(F.col("model").alias("m")).agg(F.count("*").alias("long"))
    summary = spark.read.schema("model string, items long, final double").json(f"{path}/summary").select(F.col("model").alias("s"), "final")
    return nested.join(long, F.col("model") == F.col("m")).join(summary, F.col("model") == F.col("s")).select("model", "items", "nested", "weighted", "long", "final")


PROMPTS = "SELECT conv_id AS sample_id, max(text) AS prompt FROM {conversations} WHERE role = 'user' GROUP BY conv_id"
REPLIES = "SELECT conv_id AS sample_id, min(text) AS response FROM {conversations} WHERE role = 'assistant' GROUP BY conv_id"


def write_sharegpt(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    path = scratch(prompts.sparkSession, "chats")
    io.write_sharegpt(C.sharegpt_pairs(prompts, responses), path)
    chats = prompts.sparkSession.read.schema("sample_id long, conversations array<struct<from:string,value:string>>").json(path)
    return chats.select("sample_id", F.size("conversations").cast("long").alias("turns"), F.array_join("conversations.from", ",").alias("who"), F.element_at("conversations", -1)["value"].alias("answer"))


ITEMS = "SELECT CAST(o_orderkey AS STRING) AS item_key, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey END AS id, o_custkey AS line_number FROM {orders}"
#: Half of the orders have a row of their own, and customers one by line number; a row with an id has a line number, too, which does not count.
ANSWERS = "SELECT o_orderkey AS id, o_custkey AS line_number, 'by id ' || CAST(o_orderkey AS STRING) AS response, o_orderkey AS row FROM {orders} WHERE o_orderkey % 2 = 0 UNION ALL SELECT CAST(NULL AS BIGINT), c_custkey, 'by line ' || CAST(c_custkey AS STRING), 1000000000 + c_custkey FROM {customer} WHERE c_custkey % 3 = 0"


def matched(items: DataFrame, answers: DataFrame) -> DataFrame:
    return K.match_response(items, K.latest_responses(answers, "row"))


WORDINGS = ["Return JSON in this format", "A table with columns", "Finish within 5 days", "At least 5 sections", "Use a matrix", "No more than ten words", "One heading"]


def is_tagged(df: DataFrame) -> DataFrame:
    return df.withColumn("checker", F.when(F.col("type") == "hard", F.split("method", ":")[1])).withColumn("is_if", F.when(F.col("constraint_index") != 4, F.col("type") == "hard"))


SAMPLES = f"SELECT item_id AS sample_id, substr(item_id, 1, 2) AS l1, substr(item_id, 1, 4) AS l2, CASE WHEN substr(item_id, 4, 1) = '3' THEN '' ELSE 'set' || substr(item_id, 4, 1) END AS source, substr(item_id, 4, 1) AS variant, count(*) AS n_constraints, sum(CASE WHEN type = 'hard' THEN 1 ELSE 0 END) AS n_general, sum(CASE WHEN type = 'soft' THEN 1 ELSE 0 END) AS n_soft, CAST(length(item_id) % 3 AS BIGINT) AS n_hidden FROM ({CONSTRAINTS}) AS c GROUP BY item_id"


def stats_inputs(work):
    own = lambda c: c.select(F.col("item_id").alias("sample_id"), F.concat(F.lit("C"), F.col("constraint_index").cast("string")).alias("constraint_id"), "type")
    return on2(SAMPLES, CONSTRAINTS, lambda s, c: work(s, own(c)))


#: Lines of a raw context for each order, some of which are no text.
RAW = """
SELECT o_orderkey AS k, 'T' || CAST(o_orderkey % 3 AS STRING) AS l2, 'n' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS name,
  '  Order ' || CAST(o_orderkey AS STRING) || '  ' || nl || nl || 'https://x.org/a b' || nl || CAST(o_custkey AS STRING) || ' / 10' || nl || '第 ' || CAST(o_custkey AS STRING) || ' 页 尾' || nl || 'ab' || nl || '中' || nl
  || CASE o_orderkey % 3 WHEN 0 THEN '首页 导航' WHEN 1 THEN '见首页' ELSE 'see https://x.org' END || nl || repeat('x', CAST(o_orderkey % 7 AS INT) * 20) || nl || '页 3' AS raw
FROM (SELECT *, CHR(10) AS nl FROM {orders}) AS x
"""
CLEANED = "'Order ' || k::VARCHAR || chr(10) || '中' || CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN chr(10) || '见首页' ELSE chr(10) || 'see https://x.org' END || CASE WHEN k % 7 > 0 THEN chr(10) || repeat('x', (k % 7) * 20) ELSE '' END || chr(10) || '页 3'"

def labelled_text():
    k, n, nl = TEXT("item_id"), TEXT("nation"), F.lit("\n")
    return F.concat(F.lit("净利润为 "), k, F.lit(",000.5 万元；资产负债率："), n, F.lit("%"), nl, F.lit("| 毛利率 | "), n, F.lit(" | "), nl, F.lit("营业收入 "), k, F.lit(" 亿元，发行 1,234,5"), n, F.lit(" 股，持股比例约 7.5 %。净利润为 3 元"))


#: Every eighth document is a test source, named by text as in manifests; half of all documents end in one of two footers.
SPLIT = "SELECT 'DOC-' || CAST(doc_id AS STRING) AS doc_id, text || CASE WHEN doc_id % 2 = 0 THEN CHR(10) || '  Footer of ' || lang || '  ' ELSE '' END AS text FROM {{documents}} WHERE doc_id % 8 {side}"
SHARED = """
SELECT p, side, doc_id FROM (
  SELECT *, count(DISTINCT side) OVER (PARTITION BY p) AS sides FROM (
    SELECT DISTINCT trim(unnest(string_split(text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Footer of ' || lang ELSE '' END, chr(10)))) AS p,
      CASE WHEN doc_id % 8 = 0 THEN 'test' ELSE 'train' END AS side, 'DOC-' || doc_id::VARCHAR AS doc_id FROM documents) WHERE p <> '')
WHERE sides = 2
"""
#: All documents are train sources, all benchmark items test sources.
AGAINST = ("SELECT 'DOC-' || CAST(doc_id AS STRING) AS doc_id, text FROM {documents}", "SELECT 'ITEM-' || CAST(item_id AS STRING) AS doc_id, text FROM {benchmark}")
SHARED_ITEMS = """
SELECT p, side, doc_id FROM (
  SELECT *, count(DISTINCT side) OVER (PARTITION BY p) AS sides FROM (
    SELECT DISTINCT trim(unnest(string_split(text, chr(10)))) AS p, 'train' AS side, 'DOC-' || doc_id::VARCHAR AS doc_id FROM documents
    UNION ALL SELECT DISTINCT trim(unnest(string_split(text, chr(10)))), 'test', 'ITEM-' || item_id::VARCHAR FROM benchmark) WHERE p <> '')
WHERE sides = 2
"""


def disjoint(spark, sf_dir):
    """Links of all documents with the benchmark, and of the documents' own split."""
    scopes = {"benchmark": AGAINST, "split": (SPLIT.format(side="> 0"), SPLIT.format(side="= 0"))}
    found = [on2(a, b, C.disjoint_links)(spark, sf_dir).withColumn("scope", F.lit(scope)) for scope, (a, b) in scopes.items()]
    return found[0].unionByName(found[1])


QUERIED = "SELECT o_orderkey AS sample_id, 'T' || CAST(o_orderkey % 5 + 1 AS STRING) AS l1, o_orderpriority || CASE o_orderkey % 4 WHEN 0 THEN ' 用表格' WHEN 1 THEN ' 以列表呈现' ELSE '' END AS query FROM {orders}"
POOL = [("check_no_table", ["T1", "T2"], None), ("check_no_list", None, []), ("S1", ["T2", "T4"], ["urgent"])]


def pool(like: DataFrame) -> DataFrame:
    return like.sparkSession.createDataFrame(POOL, "constraint_id string, applicable array<string>, blocked_by array<string>")


def audited(samples: DataFrame) -> DataFrame:
    drawn = samples.select("sample_id", F.explode(F.array(F.lit("check_no_table"), F.when(F.col("sample_id") % 3 == 0, "check_no_list").otherwise("S1"))).alias("constraint_id"))
    return C.conflict_audit(drawn, samples)


#: Each sample may draw from six constraints, some of which exclude others; the order of draws is closed-form.
NAMES = ["check_markdown_table", "check_no_table", "check_json_format", "check_heading_depth", "S1", "S2"]


def candidates_of(customers: DataFrame) -> DataFrame:
    entry = lambda i, n: F.struct(F.lit(n).alias("constraint_id"), F.lit(1.0 + i).alias("weight"), F.lit("N3" if n == "S2" else "X").alias("tag"), F.array(*[F.lit(x) for x in (["S2"] if n == "S1" else [])]).cast("array<string>").alias("template_excludes"))
    return customers.select(F.col("item_id").alias("sample_id"), F.explode(F.array(*[entry(i, n) for i, n in enumerate(NAMES)])).alias("c")).select("sample_id", "c.*")


def sampled(customers: DataFrame) -> DataFrame:
    return C.sample_constraints(candidates_of(customers), customers.select(F.col("item_id").alias("sample_id"), F.lit(2).alias("n")))


CLASH = "(a = 'check_markdown_table' AND b IN ('check_no_table', 'check_json_format')) OR (a = 'check_no_table' AND b IN ('check_markdown_table', 'check_json_format')) OR (a = 'check_heading_depth' AND b = 'check_json_format') OR (a = 'check_json_format' AND b IN ('check_markdown_table', 'check_no_table', 'check_heading_depth')) OR (a = 'S2' AND b = 'S1')"
DRAWS = "SELECT c_custkey AS sample_id, n AS id, -ln(" + U.format(seed="draw", key="c_custkey::VARCHAR || '|' || n") + ") / ((i + 1) * CASE WHEN n = 'S2' THEN 3 ELSE 1 END)::DOUBLE AS o FROM customer, (VALUES " + ", ".join(f"({i}, '{n}')" for i, n in enumerate(NAMES)) + ") AS x(i, n)"

#: Draws under caps with weights far apart, so that samples are turned away again and again: name, weight, uses per 100 samples.
CAPPED = [("A", 1000.0, 10), ("B", 100.0, 20), ("C", 10.0, 20), ("D", 1.0, None), ("E", 0.5, 5)]


def sampled_capped(customers: DataFrame) -> DataFrame:
    entry = lambda n, w, c: F.struct(F.lit(n).alias("constraint_id"), F.lit(w).alias("weight"), F.lit(c).cast("long").alias("cap"), F.lit("soft").alias("type"))
    rows = customers.select(F.col("item_id").alias("sample_id"), F.explode(F.array(*[entry(*x) for x in CAPPED])).alias("c")).select("sample_id", "c.*")
    return C.sample_constraints(rows, customers.select(F.col("item_id").alias("sample_id"), F.lit(2).alias("n")))


#: The same as a growing set of refusals: it is complete when nobody is refused any more.
CAPPED_SQL = f"""
WITH RECURSIVE t AS (SELECT count(*) AS total FROM customer),
prefs AS MATERIALIZED (SELECT c_custkey AS s, n AS id, -ln({U.format(seed="draw", key="c_custkey::VARCHAR || '|' || n")}) / w AS o, ('0x' || substr(md5('draw-cap|' || n || '|' || c_custkey::VARCHAR), 1, 12))::BIGINT AS p,
  CASE WHEN cap IS NOT NULL THEN greatest(1, floor(cap * total / 100)) END AS most FROM customer, t, (VALUES {", ".join(f"('{n}', {w}, {'NULL' if c is None else c})" for n, w, c in CAPPED)}) AS x(n, w, cap)),
away(turn, s, id) AS (
  SELECT 0, -1::BIGINT, ''
  UNION ALL
  SELECT turn, s, id FROM (
    WITH r AS (SELECT * FROM away),
    ask AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o) AS k FROM prefs WHERE (s, id) NOT IN (SELECT (s, id) FROM r)),
    place AS (SELECT s, id, most, row_number() OVER (PARTITION BY id ORDER BY p, s::VARCHAR) AS place FROM ask WHERE k <= 2),
    fresh AS (SELECT s, id FROM place WHERE place > most)
    SELECT (SELECT max(turn) FROM r) + 1 AS turn, s, id FROM (SELECT s, id FROM r UNION ALL SELECT s, id FROM fresh) WHERE (SELECT count(*) FROM fresh) > 0) AS z)
SELECT s AS sample_id, id AS constraint_id, k AS position FROM (
  SELECT s, id, row_number() OVER (PARTITION BY s ORDER BY o) AS k FROM prefs WHERE (s, id) NOT IN (SELECT (s, id) FROM away)) WHERE k <= 2
"""

SPACE = {
    "min": {"type": "int", "range": [100, 300], "step": 50},
    "max": {"type": "int", "relative_to": "min", "offset": [10, 30], "step": 10},
    "level": {"type": "int", "options": [2, 5]},
    "unit": {"type": "string", "pool": ["a", "b", "c"]},
    "words": {"type": "string_list", "default": ["x", "y"]},
    "strict": {"type": "bool", "default": False},
    "maybe": {"type": "string", "default": "z", "optional": True},
    "trigger": {"type": "string", "default": "loss"},
    "followup": {"type": "string", "pool_by_trigger": {"loss": ["p", "q"]}},
}
TIERS = {"T2": {"min": [7, 7], "max_offset": [1, 1]}}


def parameters(customers: DataFrame) -> DataFrame:
    tier = F.when(F.col("item_id") % 2 == 0, "T2").otherwise("T1")
    params = C.sample_params(TEXT("item_id"), F.lit("check_conditional_trigger"), F.lit(json.dumps(SPACE)), F.lit(json.dumps(TIERS)), tier)
    return customers.select("item_id", F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("params"))


def u(seed: str, name: str) -> str:
    return U.format(seed=seed, key=f"c_custkey::VARCHAR || '|check_conditional_trigger|{name}'")


def rendered(customers: DataFrame) -> DataFrame:
    params = F.create_map(F.lit("n"), TEXT("item_id"), F.lit("seg"), F.col("seg"), F.lit("forbidden"), F.lit('["甲", "乙"]'), F.lit("required_keywords"), F.concat(F.lit('["'), F.col("seg"), F.lit('"]')))
    hard = lambda hint: F.struct(F.lit("hard").alias("type"), F.lit(None).cast("string").alias("description"), F.lit(hint).alias("text_hint"), params.alias("params"))
    soft = F.struct(F.lit("soft").alias("type"), F.concat(F.lit("说明 "), F.col("seg")).alias("description"), F.lit(None).cast("string").alias("text_hint"), F.expr("cast(map() as map<string,string>)").alias("params"))
    block = C.render_constraint_text(F.array(hard("字数 {n}，{gone}，"), soft, hard('不得出现{forbidden_desc}，另见"{gone}"'), hard("含 {kw1}/{kw2}、{forbidden}")))
    return customers.select("item_id", block.alias("text"))


SIZED = "SELECT CAST(c_custkey AS STRING) AS item_id, CAST(c_nationkey % 5 + 2 AS BIGINT) AS n FROM {customer}"

PROMPT = "SELECT o_orderkey AS k, o_orderpriority AS pr FROM {orders}"


def renumbered(orders: DataFrame) -> DataFrame:
    prompt = F.concat(F.lit("（1）intro\n附加要求：\n\n  （1）a\n（2）"), F.col("pr"), F.lit("\n（3）c\n尾\n（9）z"))
    keep = F.when(F.col("k") % 3 == 0, F.array(F.lit(0), F.lit(2))).when(F.col("k") % 3 == 1, F.array(F.lit(1))).otherwise(F.expr("cast(array() as array<int>)"))
    return orders.select("k", C.renumber_prompt(prompt, keep).alias("prompt"))


#: Samples with three constraints of which two may be parameterized.
PARAMETRIC = "SELECT o_orderkey AS k, o_custkey AS c, o_orderpriority AS pr FROM {orders}"


def parametric(orders: DataFrame) -> tuple[DataFrame, DataFrame]:
    one = lambda i, t: F.struct(F.lit(i).alias("id"), t.alias("rendered_text"))
    samples = orders.select(
        TEXT("k").alias("sample_id"),
        F.concat(F.lit("case"), (F.col("k") % 1000).cast("string")).alias("case_id"),
        F.concat(F.lit("T"), (F.col("k") % 3 + 1).cast("string")).alias("l1"),
        F.lit("ctx").alias("context_text"),
        F.col("pr").alias("query_text"),
        F.lit("old").alias("prompt"),
        F.array(one("F1", F.lit("keep")), one("F6", F.lit("six")), one("F9", F.lit("nine"))).alias("constraints"),
    )
    by_sample = orders.where("k % 4 = 0").select(TEXT("k").alias("key"), F.lit("F6").alias("constraint_id"), F.concat(F.lit("new "), F.col("pr")).alias("rendered_text"))
    by_case = orders.where("k % 1000 < 300").select(F.concat(F.lit("case"), (F.col("k") % 1000).cast("string")).alias("key"), F.explode(F.array(F.lit("F9"), F.lit("F1"))).alias("constraint_id"), F.lit("case text").alias("rendered_text")).distinct()
    return samples, by_sample.unionByName(by_case)


def parameterized(orders: DataFrame) -> DataFrame:
    samples, mapping = parametric(orders)
    return C.parameterize_constraints(samples, mapping, level="T1").select("sample_id", "replaced", "prompt")


def unmapped(orders: DataFrame) -> DataFrame:
    return C.parameterize_missing(*parametric(orders)).groupBy("constraint_id").agg(F.count("*").alias("n"))


def hidden(orders: DataFrame) -> DataFrame:
    """Candidates of a customer are its orders' priorities; every fifth customer has no hidden checkers."""
    params = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v if not isinstance(v, str) else F.lit(v))])
    one = lambda name, p: F.struct(F.lit(name).alias("checker"), p.alias("params"))
    checks = F.array(one("check_keyword_presence", params(keywords='["HIGH"]')), one("check_word_limit", params(max=F.concat(F.lit("1"), F.lit("")))), one("no_such", params(x="1")), one("check_first_word", params(word=(F.col("c") % 5).cast("string"))))
    samples = orders.select(F.col("c")).distinct().select(F.col("c").alias("sample_id"), F.when(F.col("c") % 5 == 0, F.slice(checks, F.lit(1), F.lit(0))).otherwise(checks).alias("hidden_checkers"))
    candidates = orders.select(F.col("c").alias("sample_id"), F.col("k").alias("index"), F.col("pr").alias("response"))
    return C.hidden_checker_score(candidates, samples).select("sample_id", "index", "passed", "total", F.round("score", 4).alias("score"))


def assembled(messages: DataFrame, orders: DataFrame) -> DataFrame:
    chat = messages.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"), F.max("role").alias("case_id"))
    return C.assemble_final(chat, C.best_of_n(orders), "big").select("sample_id", "case_id", F.size("messages").cast("long").alias("turns"), F.try_element_at("messages", F.lit(-1))["content"].alias("last"), "teacher_model", "teacher_score")


def exported(results: DataFrame, quality: DataFrame) -> DataFrame:
    one = results.where("model = 'm1'")
    asked = quality.where("model = 'm1'").select(F.col("item_id").alias("sample_id"), F.concat(F.lit("ask "), "item_id").alias("prompt"))
    said = quality.where("model = 'm1' AND quality > 2").select(F.col("item_id").alias("sample_id"), F.concat(F.lit("say "), TEXT("quality")).alias("response"))
    return C.export_threshold(one, asked, said, system="s").select("sample_id", "pass_rate", F.array_join(F.transform("conversations", lambda t: F.concat(t["from"], F.lit("="), t["value"])), "|").alias("chat"))


def tasks(results: DataFrame) -> DataFrame:
    texts = results.select("item_id", "constraint_index").distinct().withColumn("constraint", F.concat(F.lit("c"), TEXT("constraint_index")))
    out = C.repair_tasks(results.withColumn("reason", F.concat(F.lit("r"), F.col("score").cast("string"))), texts)
    return out.select("model", "item_id", "total", F.array_join(F.transform("failed", lambda x: F.concat_ws(":", x["constraint_index"].cast("string"), x["constraint"], F.coalesce(x["reason"], F.lit("-")))), ",").alias("failed"), F.array_join("every", ",").alias("every"))


def diagnosed(responses: DataFrame) -> DataFrame:
    m = lambda **kv: F.create_map(*[F.lit(x) for pair in kv.items() for x in pair]) if kv else F.expr("cast(map() as map<string,string>)")
    told = lambda name, **kv: C.diagnose_failure(F.col("response"), name, m(**kv)).alias(name.removeprefix("check_"))
    return responses.select("item_id", told("check_word_range", min_words="30", max_words="44"), told("check_ordered_list_count", exact_count="2"), told("check_json_format"), told("check_first_word", word="Order"), told("check_heading_depth", min_depth="2"), told("check_checkbox_format"), told("check_first_last_line", last_line="Closing"))


def verified(responses: DataFrame) -> DataFrame:
    """Every fourth answer is repaired: a second box and, for every eighth, no table."""
    keep = F.col("item_id") % 4 == 0
    text = F.when(F.col("item_id") % 8 == 0, F.replace("response", F.lit("|"), F.lit(" "))).otherwise(F.col("response"))
    repairs = responses.where(keep).select("item_id", F.concat(text, F.lit("\n- [ ] open")).alias("text"))
    rule = lambda i, name, **kv: F.struct(F.lit(i).alias("constraint_index"), F.lit("rule").alias("check_type"), F.lit(name).alias("checker"), F.create_map(*[F.lit(x) for p in kv.items() for x in p]).alias("params"))
    rules = responses.select("item_id", F.explode(F.array(rule(0, "checkbox", x="1"), rule(1, "no_table", x="1"), rule(2, "heading_level", level="2", exact="1"))).alias("r")).select("item_id", "r.*")
    out = C.verify_repairs(responses, repairs, rules)
    return out.select("item_id", "checks", "passed_before", "passed_after", "all_pass", F.array_join("failing.checker", ",").alias("failing"))


def prompted(customers: DataFrame) -> DataFrame:
    failed = F.array(F.struct(F.lit("N3").alias("tag"), F.col("seg").alias("constraint"), F.lit("check_decimal_places").alias("checker"), F.create_map(F.lit("places"), F.lit("2")).alias("params"), TEXT("nation").alias("reason")))
    every = F.array(F.struct(F.lit("N3").alias("tag"), F.col("seg").alias("constraint")), F.struct(F.lit("S1").alias("tag"), F.lit("b").alias("constraint")))
    return customers.select("item_id", C.repair_prompts(failed, every, TEXT("item_id")).alias("prompt"))


NUMBERS = "SELECT o_orderkey AS k, CAST(o_custkey AS STRING) || '.' || CAST(100 + o_orderkey % 900 AS STRING) AS x FROM {orders}"


def decimals(orders: DataFrame) -> DataFrame:
    x = F.col("x")
    text = F.concat(F.lit("# "), x, F.lit("\nsum "), x, F.lit("  % and 2.5, "), x, F.lit("年 1.2 节 12.5 a\n| --- |\n"), x)
    return orders.select("k", H.fix_decimals(text, F.lit(2)).alias("fixed"))


LONG = "SELECT o_orderkey AS doc_id, repeat('one two three' || CHR(10), CAST(o_orderkey % 9 AS INT)) || CHR(10) || repeat('w ', 15) || CHR(10) || 'last' AS text FROM {orders}"

JUDGED = '{{"constraint_scores": [{{"constraint_index": 0, "score": {score}, "reason": "fine"}}], "quality_score": {quality}{reason}}}'


def judge_case(event_id, values):
    """A judge's answers by the remainder of the event's number."""
    case = F.when(F.lit(False), "")
    for i, v in enumerate(values):
        case = case.when(event_id % len(values) == i, v)
    return case


RAW_ANSWERS = [
    ("no json", "not_json"),
    ("[1]", "not_object"),
    ('{"constraint_scores": 1}', "no_list"),
    ('```json\n{"constraint_scores": [{"constraint_index": 0, "score": 1, "reason": "fine"}], "quality_score": 7, "quality_reason": "good"}\n```', None),
    ('{"constraint_scores": [{"constraint_index": 0, "score": true, "reason": "x"}], "quality_score": 1}', "bad_score"),
    ('{"constraint_scores": [], "quality_score": 3}', "missing_index"),
    ('{"constraint_scores": [{"constraint_index": 0, "score": 1, "reason": "x"}, {"constraint_index": 0, "score": 1, "reason": "x"}]}', "duplicate_index"),
    ('{"constraint_scores": [{"constraint_index": 3, "score": 1, "reason": "x"}]}', "unexpected_index"),
    ('{"constraint_scores": [{"constraint_index": 0, "score": 1, "reason": " "}]}', "empty_reason"),
    ('{"constraint_scores": [{"constraint_index": 0, "score": 0, "reason": "x"}], "quality_score": 11}', "bad_quality"),
    ('{"constraint_scores": [{"constraint_index": 0, "score": 0, "reason": "x"}], "quality_score": 10}', "empty_quality_reason"),
    ('{"constraint_scores": [{"constraint_index": 0.5, "score": 0, "reason": "x"}]}', "bad_index"),
]
EVENTS = "SELECT event_id, user_id FROM {events}"


def judged(events: DataFrame) -> DataFrame:
    raw = judge_case(F.col("event_id"), [x for x, _ in RAW_ANSWERS])
    return J.parse_judge_item(events.withColumn("raw", raw).withColumn("expected", F.array(F.lit(0).cast("long"))))


QUERIES = {
    "read_items": on(ORDERS, read_items),
    "read_items_report": on(ORDERS, read_report),
    "append_results": on(ORDERS, appended),
    "read_responses": on(ORDERS, read_responses),
    "read_context_manifest": on(DOCS, read_manifest),
    "write_results": on2(RESULTS, QUALITY, write_results),
    "write_sharegpt": on2(PROMPTS, REPLIES, write_sharegpt),
    "match_response": on2(ITEMS, ANSWERS, matched),
    "missing_responses": on2(ITEMS, ANSWERS, lambda i, a: K.missing_responses(i, matched(i, a)).select("item_key")),
    "explode_constraints": on(
        CONSTRAINTS,
        lambda c: K.explode_constraints(c.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("constraint_index", F.when(F.col("constraint_index") == 1, "own").alias("id"), F.when(F.col("constraint_index") % 2 == 0, F.col("tag")).otherwise("other").alias("constraint_id"), "type"))).alias("constraints"))).select("item_id", "constraint_index", "constraint_id", "type"),
    ),
    "infer_checker": on(CONSTRAINTS, lambda c: c.select("item_id", "constraint_index", K.infer_checker(F.get(F.array(*[F.lit(w) for w in WORDINGS]), F.col("constraint_index").cast("int")), F.col("tag")).alias("checker"))),
    "benchmark_stats": on(CONSTRAINTS, lambda c: P.benchmark_stats(is_tagged(c))),
    "training_stats": stats_inputs(P.training_stats),
    "sample_stats": stats_inputs(P.sample_stats),
    "prompt_length_hist": on(DOCS, lambda d: P.log_histogram(d.select(F.regexp_count("text", F.lit(r"[^\s]+")).cast("double").alias("n")), "n")),
    "judge_requests": on2(
        "SELECT o_orderkey AS item_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS query, o_orderstatus AS response, 'W' || CAST(o_orderkey % 3 AS STRING) AS workflow, CASE WHEN o_orderkey % 3 = 0 THEN 'all of it' END AS full_prompt, array(named_struct('id', CAST(o_custkey AS STRING), 'content', 'text')) AS documents FROM {orders}",
        "SELECT l_orderkey AS item_id, l_linenumber AS constraint_index, max(l_returnflag) AS constraint, 'EG1' AS tag FROM {lineitem} GROUP BY l_orderkey, l_linenumber",
        lambda a, b: J.judge_requests(a, b).select("item_id", "prompt"),
    ),
    "judge_prompt_single": on(
        "SELECT p_partkey AS item_id, p_name AS name, p_brand AS brand, p_type AS type FROM {part}",
        lambda p: p.select("item_id", J.judge_prompt_single(F.concat(F.lit(" "), "name"), F.when(F.col("item_id") % 2 == 0, F.array(F.struct(F.when(F.col("item_id") % 4 == 0, F.col("brand")).alias("id"), F.when(F.col("item_id") % 6 == 0, "").otherwise(F.col("type")).alias("title"), F.col("name").alias("content")))), F.col("type")).alias("prompt")),
    ),
    "parse_judge_item": on(EVENTS, lambda e: judged(e).select("event_id", F.col("parsed.error").alias("error"), F.col("parsed.quality_score").alias("quality"), F.col("parsed.quality_reason").alias("reason"))),
    "first_valid_attempt": on(EVENTS, lambda e: J.first_valid_attempt(judged(e).select(F.col("user_id").alias("item_id"), (F.col("event_id") % 2).alias("repeat"), F.col("event_id").alias("attempt"), "parsed")).select("item_id", "repeat", "attempt")),
    "clean_context_text": on(RAW, lambda r: r.select("k", C.clean_context_text(F.col("raw")).alias("text"))),
    "context_pool": on(RAW, lambda r: C.context_pool(r, most=150).select("name", "context_id", "char_count")),
    "extract_labelled_values": on(CUSTOMERS, lambda r: r.select("item_id", F.array_join(F.transform(F.array_sort(F.map_entries(C.extract_labelled_values(labelled_text()))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("found"))),
    "pool_candidates": on(QUERIED, lambda s: C.pool_candidates(s, pool(s))),
    "conflict_audit": on(QUERIED, audited),
    "sample_constraints": on(CUSTOMERS, sampled),
    "sample_constraints_capped": on(CUSTOMERS, sampled_capped),
    "sample_params": on(CUSTOMERS, parameters),
    "render_constraint_text": on(CUSTOMERS, rendered),
    "trim_targets": on(SIZED, C.trim_targets),
    "renumber_prompt": on(PROMPT, renumbered),
    "trim_coverage": on(CONSTRAINTS, lambda c: C.trim_coverage(c, c.where("constraint_index < 2"))),
    "parameterize_constraints": on(PARAMETRIC, parameterized),
    "parameterize_missing": on(PARAMETRIC, unmapped),
    "hidden_checker_score": on(ORDERS, hidden),
    "candidate_details": on(CANDIDATES, lambda c: C.candidate_details(c).select("sample_id", "n", F.array_join(F.transform("candidates", lambda x: F.concat_ws(":", x["index"].cast("string"), (x["score"] * 4).cast("int").cast("string"), x["chars"].cast("string"))), ",").alias("candidates"))),
    "assemble_final": on2("SELECT conv_id AS sample_id, role, text, turn FROM {conversations}", "SELECT o_custkey AS sample_id, o_orderkey AS index, o_orderstatus AS response, CAST(o_orderkey % 2 AS DOUBLE) AS score FROM {orders}", assembled),
    "export_threshold": on2(RESULTS, QUALITY, exported),
    "repair_tasks": on(RESULTS, tasks),
    "diagnose_failure": on(RESPONSES, diagnosed),
    "verify_repairs": on(RESPONSES, verified),
    "conflicting_constraints": on(
        CUSTOMERS,
        lambda r: C.conflicting_constraints(r.select("item_id", F.when(F.col("item_id") % 3 == 0, F.array(F.lit("check_json_format"), F.lit("check_first_word"), F.lit("min_words"))).when(F.col("item_id") % 3 == 1, F.array(F.lit("check_json_format"), F.lit("check_last_line"))).otherwise(F.array(F.lit("check_first_word"), F.lit("min_words"))).alias("names"))).select(
            "item_id", F.array_join("blocked", ",").alias("blocked"), F.array_join("actionable", ",").alias("actionable")
        ),
    ),
    "repair_prompts": on(CUSTOMERS, prompted),
    "fix_decimals": on(NUMBERS, decimals),
    "excerpt_chunks": on(LONG, lambda d: C.excerpt_chunks(d, least=7, most=14).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"), F.sum(F.length("text")).alias("chars"))),
    "source_disjoint_check": disjoint,
    "shared_passages": on2(SPLIT.format(side="> 0"), SPLIT.format(side="= 0"), lambda a, b: C.shared_passages(a, b).drop("passage")),
}

FAM = "tag LIKE 'FP%'"
LATEST = "SELECT key, arg_max(response, row) AS response FROM (SELECT coalesce(id, line_number)::VARCHAR AS key, response, row FROM answers) GROUP BY key"
MATCH = f"SELECT i.item_key, a.response FROM items i JOIN ({LATEST}) a ON a.key = coalesce(i.id, i.line_number)::VARCHAR"
N = "n::DOUBLE AS n"
NL = "chr(10)"
PICK = lambda seed, name, *values: f"(CASE floor({u(seed, name)} * {len(values)}) " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END)"
MIN = f"(CASE WHEN c_custkey % 2 = 0 THEN 7 ELSE 100 + 50 * floor({u('param', 'min')} * 5) END)::BIGINT"
MAX = f"({MIN} + CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 10 + 10 * floor({u('param', 'max')} * 3) END)::BIGINT"
FIRST_BOX = "(NOT j AND k % 3 = 0)"
SQL = {
    "read_items_report": "WITH d AS (SELECT 'D' || (k % 100)::VARCHAR AS d, count(*) AS n FROM orders_ WHERE k % 5 = 2 GROUP BY 1 HAVING count(*) > 1) SELECT count(*) AS lines, count(*) FILTER (k % 5 = 0) AS blank, count(*) FILTER (k % 5 = 1) AS bad, (SELECT count(*) FROM d) AS duplicate_keys, (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT d FROM d ORDER BY d LIMIT 5)) AS first, count(*) FILTER (k % 5 > 1) AS items, max(r) FILTER (k % 5 > 1) AS last_row FROM (SELECT *, row_number() OVER (ORDER BY k) AS r FROM orders_)",
    "append_results": "SELECT CASE WHEN k % 2 = 0 THEN 'a' WHEN k % 3 = 0 THEN 'b' ELSE 'todo' END AS batch, count(*) AS n, sum(c)::BIGINT AS total FROM orders_ GROUP BY 1",
    "read_items": "SELECT CASE k % 6 WHEN 2 THEN 'A' || k::VARCHAR WHEN 3 THEN 'B' || (k % 1000)::VARCHAR WHEN 4 THEN k::VARCHAR WHEN 5 THEN r::VARCHAR ELSE 'bad' END AS item_key, count(*) AS n FROM (SELECT *, row_number() OVER (ORDER BY k) AS r FROM orders_) WHERE k % 6 > 0 GROUP BY 1",
    "read_responses": "SELECT key, arg_max(response, k) AS response FROM (SELECT k, CASE k % 4 WHEN 0 THEN k::VARCHAR WHEN 1 THEN (k - 1)::VARCHAR ELSE (-k)::VARCHAR END AS key, 'by ' || k::VARCHAR AS response FROM orders_ WHERE k % 4 < 3) GROUP BY key UNION ALL SELECT 'bad', count(*)::VARCHAR FROM orders_ WHERE k % 4 = 3",
    "read_context_manifest": "SELECT lang AS workflow, CASE WHEN length(text) > 1000 THEN 'ok' ELSE 'failed' END AS status, count(*) AS documents, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY ALL",
    "write_results": "WITH i AS (SELECT model, item_id, count(*) AS t, count(score) AS d, count(*) FILTER (score = 1) AS p, sum(coalesce(score, 0) * (constraint_index + 1))::BIGINT AS w FROM results GROUP BY ALL) SELECT model, count(*) AS items, sum(t)::BIGINT AS nested, sum(w)::BIGINT AS weighted, sum(t)::BIGINT AS long, round(0.8::DOUBLE * sum(p)::DOUBLE / sum(d) + 0.2::DOUBLE * avg(quality) / 10, 4) AS final FROM i LEFT JOIN quality USING (model, item_id) GROUP BY model",
    "write_sharegpt": "SELECT conv_id AS sample_id, 2::BIGINT AS turns, 'human,gpt' AS who, r AS answer FROM (SELECT conv_id, min(text) FILTER (role = 'assistant') AS r, count(*) FILTER (role = 'user') AS p FROM conversations GROUP BY 1) WHERE trim(r) <> '' AND p > 0",
    "match_response": MATCH,
    "missing_responses": f"SELECT item_key FROM items WHERE item_key NOT IN (SELECT item_key FROM ({MATCH}))",
    "explode_constraints": "SELECT item_id, k AS constraint_index, CASE WHEN constraint_index = 1 THEN 'own' WHEN constraint_index % 2 = 1 THEN 'other' WHEN tag IS NOT NULL THEN tag ELSE item_id || '#C' || (k + 1)::VARCHAR END AS constraint_id, type FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY constraint_index) - 1 AS k FROM cons)",
    "infer_checker": f"SELECT item_id, constraint_index, CASE WHEN constraint_index = 0 THEN 'valid_json' WHEN constraint_index = 3 THEN 'contains_number' WHEN constraint_index = 2 THEN CASE WHEN tag = 'QV5' THEN 'deadline' END WHEN {FAM} THEN CASE constraint_index WHEN 1 THEN 'table_columns' WHEN 4 THEN 'markdown_table' WHEN 5 THEN 'max_words' WHEN 6 THEN 'min_sections' END END AS checker FROM cons",
    "benchmark_stats": f"SELECT dimension, value, {N} FROM (SELECT 'l1' AS dimension, split_part(item_id, '.', 1) AS value, count(DISTINCT item_id) AS n FROM cons GROUP BY 2 UNION ALL SELECT 'l2', split_part(item_id, '-', 1), count(DISTINCT item_id) FROM cons GROUP BY 2 UNION ALL SELECT 'checker', CASE WHEN constraint_index % 2 = 0 THEN 'min_words' ELSE 'table_columns' END, count(*) FROM cons WHERE type = 'hard' GROUP BY 2 UNION ALL SELECT 'tag', tag, count(*) FROM cons WHERE tag IS NOT NULL GROUP BY 2 UNION ALL SELECT 'tag_category', tag[1], count(*) FROM cons WHERE tag IS NOT NULL GROUP BY 2) UNION ALL SELECT 'total', unnest(['cases', 'constraints', 'mean_per_case', 'compliance', 'correctness', 'compliance_share']), unnest([c::DOUBLE, t::DOUBLE, round(t::DOUBLE / c, 2), f::DOUBLE, (t - f)::DOUBLE, round(100.0::DOUBLE * f / t, 1)]) FROM (SELECT count(DISTINCT item_id) AS c, count(*) AS t, count(*) FILTER (type = 'hard' AND constraint_index <> 4) AS f FROM cons)",
    "training_stats": f"SELECT dimension, value, {N} FROM (SELECT 'l1' AS dimension, l1 AS value, count(*) AS n FROM samples GROUP BY 2 UNION ALL SELECT 'l2', l2, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'source', CASE WHEN source = '' THEN 'legacy' ELSE source END, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'constraint', 'C' || constraint_index::VARCHAR, count(*) FROM cons GROUP BY 2 UNION ALL SELECT 'total', type, count(*) FROM cons GROUP BY 2 UNION ALL SELECT 'total', 'samples', count(*) FROM samples UNION ALL SELECT 'total', 'hidden', sum(n_hidden) FROM samples) UNION ALL SELECT 'total', 'mean_constraints', round(avg(n_constraints), 2) FROM samples",
    "sample_stats": f"SELECT dimension, value, {N} FROM (SELECT 'l1' AS dimension, l1 AS value, count(*) AS n FROM samples GROUP BY 2 UNION ALL SELECT 'l2', l2, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'variant', variant, count(*) FROM samples GROUP BY 2 UNION ALL SELECT 'constraint', 'C' || constraint_index::VARCHAR, count(*) FROM cons GROUP BY 2 UNION ALL SELECT 'total', type, count(*) FROM cons GROUP BY 2 UNION ALL SELECT 'total', 'samples', count(*) FROM samples) UNION ALL SELECT 'total', unnest(['constraints', 'general', 'soft_mean', 'hidden']), unnest([round(avg(n_constraints), 1), round(avg(n_general), 1), round(avg(n_soft), 1), round(avg(n_hidden), 1)]) FROM samples",
    "prompt_length_hist": r"WITH n AS (SELECT len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+'))::DOUBLE AS n FROM documents), e AS (SELECT greatest(min(n), 5::DOUBLE) AS lo, max(n) * 1.05::DOUBLE AS hi, round_even(avg(n), 0)::BIGINT AS mean FROM n) SELECT least(floor(ln(n / lo) / ln(hi / lo) * 25), 24)::BIGINT AS bin, count(*) AS n, max(mean) AS mean FROM n, e WHERE n >= lo GROUP BY bin",
    "judge_requests": f"SELECT o_orderkey AS item_id, 'Item: ' || o_orderkey::VARCHAR || {NL} || {NL} || 'Workflow and task: W' || (o_orderkey % 3)::VARCHAR || ' / ' || {NL} || {NL} || CASE WHEN o_orderkey % 2 = 0 THEN 'Query:' || {NL} || o_orderpriority || {NL} || {NL} ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'Prompt:' || {NL} || 'all of it' ELSE 'Documents:' || {NL} || '[{{\"id\":\"' || o_custkey::VARCHAR || '\",\"content\":\"text\"}}]' END || {NL} || {NL} || 'Constraints to judge, by zero-based index:' || {NL} || '[' || c || ']' || {NL} || {NL} || 'Response:' || {NL} || o_orderstatus AS prompt FROM orders JOIN (SELECT l_orderkey, string_agg('{{\"constraint_index\":' || l_linenumber::VARCHAR || ',\"constraint\":\"' || f || '\",\"tag\":\"EG1\",\"family\":\"\"}}', ',' ORDER BY l_linenumber) AS c FROM (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS f FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey) ON l_orderkey = o_orderkey".replace("{{", "{").replace("}}", "}"),
    "judge_prompt_single": f"SELECT p_partkey AS item_id, 'Does the response meet the constraint' || CASE WHEN p_partkey % 2 = 0 THEN ', with the documents as the only source of facts?' ELSE '?' END || ' Answer pass or fail with a short reason.' || {NL} || {NL} || 'Constraint:' || {NL} || p_name || CASE WHEN p_partkey % 2 = 0 THEN {NL} || {NL} || 'Documents:' || {NL} || '[' || CASE WHEN p_partkey % 4 = 0 THEN p_brand ELSE 'DOC' END || CASE WHEN p_partkey % 6 = 0 THEN '' ELSE ' - ' || p_type END || ']' || {NL} || p_name ELSE '' END || {NL} || {NL} || 'Response:' || {NL} || p_type AS prompt FROM part",
    "parse_judge_item": f"SELECT event_id, ([{', '.join('NULL' if e is None else repr(e) for _, e in RAW_ANSWERS)}])[(event_id % {len(RAW_ANSWERS)})::INT + 1] AS error, CASE WHEN event_id % {len(RAW_ANSWERS)} = 3 THEN 7 END AS quality, CASE WHEN event_id % {len(RAW_ANSWERS)} = 3 THEN 'good' END AS reason FROM events",
    "first_valid_attempt": f"SELECT user_id AS item_id, 1::BIGINT AS repeat, min(event_id) AS attempt FROM events WHERE event_id % {len(RAW_ANSWERS)} = 3 GROUP BY user_id",
    "clean_context_text": f"SELECT o_orderkey AS k, {CLEANED.replace('k::', 'o_orderkey::').replace('k %', 'o_orderkey %')} AS text FROM orders",
    "context_pool": f"SELECT name, 'EXT-' || l2 || '-' || CASE WHEN r < 1000 THEN right('000' || r::VARCHAR, 3) ELSE r::VARCHAR END AS context_id, least(n, 150) AS char_count FROM (SELECT *, row_number() OVER (ORDER BY name) AS r FROM (SELECT name, l2, length({CLEANED}) AS n FROM raws) WHERE n >= 100)",
    "extract_labelled_values": "SELECT c_custkey AS item_id, '净利润为=' || c_custkey::VARCHAR || '000.5万元;发行=12345' || c_nationkey::VARCHAR || '股;持股比例=7.5%;持股比例约=7.5%;毛利率=' || c_nationkey::VARCHAR || ';营业收入=' || c_custkey::VARCHAR || '亿元;资产负债率=' || c_nationkey::VARCHAR || '%' AS found FROM customer",
    "pool_candidates": "SELECT o_orderkey AS sample_id, p AS constraint_id FROM orders, (VALUES ('check_no_table'), ('check_no_list'), ('S1')) AS x(p) WHERE CASE p WHEN 'check_no_table' THEN o_orderkey % 5 IN (0, 1) AND o_orderkey % 4 <> 0 WHEN 'check_no_list' THEN o_orderkey % 4 <> 1 ELSE o_orderkey % 5 IN (1, 3) AND NOT contains(lower(o_orderpriority), 'urgent') END",
    "conflict_audit": "SELECT 'check_no_table' AS constraint_id, count(*) AS conflicts FROM orders WHERE o_orderkey % 4 IN (0) UNION ALL SELECT 'check_no_list', count(*) FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey % 3 = 0",
    "sample_constraints_capped": CAPPED_SQL,
    "sample_constraints": f"WITH d AS ({DRAWS}), f AS (SELECT sample_id, arg_min(id, o) AS a, min(o) AS o FROM d GROUP BY sample_id), s AS (SELECT sample_id, arg_min(d.id, d.o) AS b FROM (SELECT d.*, f.a, d.id AS b FROM d JOIN f USING (sample_id)) d WHERE d.id <> d.a AND NOT ({CLASH.replace('b IN', 'd.b IN').replace('b =', 'd.b =').replace('(a =', '(d.a =')}) GROUP BY sample_id) SELECT sample_id, a AS constraint_id, 1 AS position FROM f UNION ALL SELECT sample_id, b, 2 FROM s",
    "sample_params": f"SELECT c_custkey AS item_id, 'followup=' || {PICK('pool', 'followup', 'p', 'q')} || ';level=' || {PICK('option', 'level', 2, 5)} || ';max=' || {MAX}::VARCHAR || CASE WHEN {u('optional', 'maybe')} < 0.4 THEN '' ELSE ';maybe=z' END || ';min=' || {MIN}::VARCHAR || ';strict=false;trigger=loss;unit=' || {PICK('pool', 'unit', 'a', 'b', 'c')} || ';words=[\"x\",\"y\"]' AS params FROM customer",
    "render_constraint_text": f"SELECT c_custkey AS item_id, '请在回答时严格遵守以下附加要求：' || {NL} || '（1）字数 ' || c_custkey::VARCHAR || {NL} || '（2）说明 ' || c_mktsegment || {NL} || '（3）不得出现“甲”、“乙”' || {NL} || '（4）含 ' || c_mktsegment || '/' || c_mktsegment || '、甲、乙' AS text FROM customer",
    "trim_targets": f"SELECT item_id, n, (CASE WHEN n = 3 THEN 3 WHEN n = 4 THEN CASE WHEN r <= 15 THEN 1 WHEN r <= 22 THEN 2 ELSE 3 END WHEN n = 5 THEN CASE WHEN r <= 13 THEN 2 WHEN r <= 17 THEN 3 ELSE 4 END WHEN n = 6 THEN CASE WHEN r <= 13 THEN 4 ELSE 5 END ELSE n END)::BIGINT AS keep FROM (SELECT c_custkey::VARCHAR AS item_id, (c_nationkey % 5 + 2)::BIGINT AS n, row_number() OVER (PARTITION BY c_nationkey % 5 ORDER BY {U.format(seed='trim', key='c_custkey::VARCHAR')}, c_custkey::VARCHAR) AS r FROM customer)",
    "renumber_prompt": f"SELECT o_orderkey AS k, '（1）intro' || {NL} || '附加要求：' || {NL} || {NL} || CASE o_orderkey % 3 WHEN 0 THEN '  （1）a' || {NL} || '（2）c' || {NL} WHEN 1 THEN '（1）' || o_orderpriority || {NL} ELSE '' END || '尾' || {NL} || '（9）z' AS prompt FROM orders",
    "trim_coverage": "SELECT dimension, value, count(*) AS before, count(*) FILTER (constraint_index < 2) AS after, round(100.0::DOUBLE * count(*) FILTER (constraint_index < 2) / count(*), 1) AS kept_percent, dimension = 'tag' AND 100.0::DOUBLE * count(*) FILTER (constraint_index < 2) / count(*) < 40 AS low FROM (SELECT constraint_index, 'tag' AS dimension, coalesce(tag, 'unknown') AS value FROM cons UNION ALL SELECT constraint_index, 'type', type FROM cons) GROUP BY dimension, value",
    "parameterize_constraints": f"SELECT k::VARCHAR AS sample_id, (six + nine)::BIGINT AS replaced, CASE WHEN six + nine > 0 THEN 'ctx' || {NL} || {NL} || pr || {NL} || {NL} || '请在回答时严格遵守以下附加要求：' || {NL} || '（1）keep' || {NL} || '（2）' || CASE WHEN six = 1 THEN 'new ' || pr ELSE 'six' END || {NL} || '（3）' || CASE WHEN nine = 1 THEN 'case text' ELSE 'nine' END ELSE 'old' END AS prompt FROM (SELECT *, (k % 4 = 0)::INT AS six, (k % 1000 < 300)::INT AS nine FROM orders_) WHERE k % 3 = 0",
    "parameterize_missing": "SELECT 'F6' AS constraint_id, count(*) AS n FROM orders_ WHERE k % 4 <> 0 UNION ALL SELECT 'F9', count(*) FROM orders_ WHERE k % 1000 >= 300",
    "hidden_checker_score": "SELECT c AS sample_id, k AS index, p::BIGINT AS passed, t::BIGINT AS total, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE round(p::DOUBLE / t, 4) END AS score FROM (SELECT *, CASE WHEN c % 5 = 0 THEN 0 ELSE 4 END AS t, CASE WHEN c % 5 = 0 THEN 0 ELSE contains(pr, 'HIGH')::INT + (pr NOT LIKE '4%')::INT + (pr[1] = (c % 5)::VARCHAR)::INT END AS p FROM orders_)",
    "candidate_details": "SELECT sample_id, count(*) AS n, string_agg(index::VARCHAR || ':' || (score * 4)::INT::VARCHAR || ':' || length(response)::VARCHAR, ',' ORDER BY index) AS candidates FROM candidates GROUP BY 1",
    "assemble_final": "SELECT conv_id AS sample_id, m AS case_id, t + 1 AS turns, o_orderstatus AS last, 'big' AS teacher_model, (o_orderkey % 2)::DOUBLE AS teacher_score FROM (SELECT conv_id, count(*) AS t, max(role) AS m FROM conversations GROUP BY 1) JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 2 DESC, length(o_orderstatus), o_orderkey) = 1) ON o_custkey = conv_id",
    "export_threshold": f"SELECT item_id AS sample_id, r AS pass_rate, 'system=s|human=ask ' || item_id || '|gpt=<think>' || {NL} || {NL} || '</think>' || {NL} || {NL} || 'say ' || quality::VARCHAR AS chat FROM (SELECT item_id, round(count(*) FILTER (score = 1)::DOUBLE / count(*), 4) AS r FROM results WHERE model = 'm1' GROUP BY ALL) JOIN (SELECT * FROM quality WHERE model = 'm1' AND quality > 2) USING (item_id) WHERE r >= 0.9",
    "repair_tasks": "SELECT model, item_id, count(*) AS total, string_agg(constraint_index::VARCHAR || ':c' || constraint_index::VARCHAR || ':' || coalesce('r' || score::VARCHAR, '-'), ',' ORDER BY constraint_index) FILTER (coalesce(score, 0) <> 1) AS failed, string_agg('c' || constraint_index::VARCHAR, ',' ORDER BY constraint_index) AS every FROM results GROUP BY ALL HAVING count(*) FILTER (coalesce(score, 0) <> 1) > 0",
    "diagnose_failure": f"SELECT item_id, CASE WHEN {MIXED} < 30 THEN {MIXED}::VARCHAR || ' words, wanted 30 to 44: add ' || (30 - {MIXED})::VARCHAR WHEN {MIXED} > 44 THEN {MIXED}::VARCHAR || ' words, wanted 30 to 44: cut ' || ({MIXED} - 44)::VARCHAR END AS word_range, {NUMBERED}::VARCHAR || ' numbered items, wanted exactly 2' AS ordered_list_count, 'must be valid JSON as a whole, without Markdown' AS json_format, CASE WHEN j THEN 'must open with Order, opens with ' || CASE WHEN k % 14 = 0 THEN '```json5' || {NL} || substr('{{\"order\": ' || k::VARCHAR || ', \"status\": \"' || st, 1, 21) ELSE substr('{{\"order\": ' || k::VARCHAR || ', \"status\": \"' || st || '\", \"tags', 1, 30) END WHEN k % 4 = 2 THEN 'must open with Order, opens with ' || substr('1. Order ' || k::VARCHAR || {NL} || {NL} || 'Summary: status ' || st || ' and', 1, 30) END AS first_word, CASE WHEN j THEN 0 ELSE (k % 4 = 0)::INT + 1 END::VARCHAR || ' heading levels, wanted at least 2' AS heading_depth, CASE WHEN NOT j AND k % 6 = 0 THEN 1 ELSE 0 END::VARCHAR || ' checkboxes, wanted at least 1' AS checkbox_format, CASE WHEN j THEN 'last line must hold Closing, is ' || CASE WHEN k % 14 = 0 THEN '```' ELSE substr('{{\"order\": ' || k::VARCHAR || ', \"status\": \"' || st || '\", \"tags\": [\"a\", \"bb\", \"' || pr, 1, 50) END WHEN k % 10 = 0 THEN 'last line must hold Closing, is 以上内容仅供参考，不构成投资建议' WHEN k % 10 = 5 THEN 'last line must hold Closing, is 风险提示' END AS first_last_line FROM facts".replace("{{", "{"),
    "verify_repairs": f"SELECT item_id, 3::BIGINT AS checks, {FIRST_BOX}::BIGINT + ((j OR k % 3 = 0)::INT) + lvl AS passed_before, 1 + ((j OR k % 3 = 0 OR k % 8 = 0)::INT) + lvl::BIGINT AS passed_after, (j OR k % 3 = 0 OR k % 8 = 0) AND lvl = 1 AS all_pass, concat_ws(',', CASE WHEN NOT (j OR k % 3 = 0 OR k % 8 = 0) THEN 'no_table' END, CASE WHEN lvl = 0 THEN 'heading_level' END) AS failing FROM (SELECT *, (NOT j AND k % 5 <> 4)::INT AS lvl FROM facts) WHERE k % 4 = 0",
    "conflicting_constraints": "SELECT c_custkey AS item_id, CASE WHEN c_custkey % 3 = 0 THEN 'check_json_format,check_first_word' ELSE '' END AS blocked, CASE c_custkey % 3 WHEN 0 THEN 'min_words' WHEN 1 THEN 'check_json_format,check_last_line' ELSE 'check_first_word,min_words' END AS actionable FROM customer",
    "repair_prompts": f"SELECT c_custkey AS item_id, '## Constraints not met' || {NL} || {NL} || '### [N3]' || {NL} || '- Constraint: ' || c_mktsegment || {NL} || '- Checker: check_decimal_places' || {NL} || '- Settings: {{\"places\":\"2\"}}' || {NL} || '- Why it fails: ' || c_nationkey::VARCHAR || {NL} || {NL} || '## All constraints (keep those that are met)' || {NL} || {NL} || '1. [N3] ' || c_mktsegment || {NL} || '2. [S1] b' || {NL} || {NL} || '## Response' || {NL} || {NL} || c_custkey::VARCHAR AS prompt FROM customer".replace("{{", "{").replace("}}", "}"),
    "fix_decimals": f"SELECT o_orderkey AS k, '# ' || x || {NL} || 'sum ' || y || '% and 2.50, ' || x || '年 1.2 节 12.50a' || {NL} || '| --- |' || {NL} || y AS fixed FROM (SELECT o_orderkey, o_custkey::VARCHAR || '.' || (100 + o_orderkey % 900)::VARCHAR AS x, o_custkey::VARCHAR || '.' || ((100 + o_orderkey % 900) // 10)::VARCHAR AS y FROM orders)",
    "excerpt_chunks": "SELECT doc_id, chunks, (3 * m + 16)::BIGINT AS tokens, longest::BIGINT AS longest, (13 * m + 30 + 4 + (m + 2 - chunks))::BIGINT AS chars FROM (SELECT *, CASE WHEN m = 0 THEN 15 ELSE 15 END AS longest, CASE WHEN m = 0 THEN 2 ELSE ceil(m / 3.0)::BIGINT + 2 END AS chunks FROM (SELECT o_orderkey AS doc_id, o_orderkey % 9 AS m FROM orders))",
    "source_disjoint_check": f"WITH m AS (SELECT 'benchmark' AS scope, * FROM ({SHARED_ITEMS}) UNION ALL SELECT 'split', * FROM ({SHARED})), c AS (SELECT scope, p, side, count(*) AS links, min(doc_id) AS first FROM m GROUP BY ALL) SELECT m.scope, md5(m.p) AS passage_id, length(m.p) AS chars, m.side, m.doc_id, c.links, c.first FROM m JOIN c ON c.scope = m.scope AND c.p = m.p AND c.side <> m.side",
    "shared_passages": f"SELECT md5(p) AS passage_id, side, doc_id FROM ({SHARED})",
}
PARTS = {"results": RESULTS, "quality": QUALITY, "cons": CONSTRAINTS, "samples": SAMPLES, "candidates": CANDIDATES, "items": ITEMS, "answers": ANSWERS, "facts": FACTS, "orders_": ORDERS, "raws": "SELECT o_orderkey AS k, 'T' || CAST(o_orderkey % 3 AS STRING) AS l2, 'n' || lpad(CAST(o_orderkey AS STRING), 9, '0') AS name FROM {orders}"}
ORACLES = {name: with_sql("SELECT * FROM (" + text + ")", **{k: v for k, v in PARTS.items() if f"FROM {k}" in text or f"JOIN {k}" in text}) for name, text in SQL.items()}
