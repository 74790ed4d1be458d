"""Queries of measures and checkers over rendered answers.

The oracles do not measure texts: they are closed forms over the remainders of the key by which the answers are made.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.functions import measures as M
from verdance.operators.checkers import check, evaluate

from .demo import FACTS, RESPONSES, spark_rows, with_sql

NL = "chr(10)"


def one(test: str) -> str:
    return f"({test})::INT"


def part(json: str, text: str) -> str:
    return f"(CASE WHEN j THEN {json} ELSE {text} END)"


FENCED = "(k % 14 = 0)::INT"
EVEN, QUOTE, DONE, LABEL, CHINESE, SIGN = (f"(k % {n} = {r})::INT" for n, r in ((2, 0), (5, 0), (6, 0), (8, 1), (9, 0), (11, 0)))
LAST = "CASE k % 10 WHEN 0 THEN {} WHEN 5 THEN {} ELSE 3 + np END"
WORDS = part(f"8 + np + {FENCED}", f"2 + (k % 4 = 2)::INT + 16 + np + CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 6 ELSE 8 END + 1 + 4 + 4 - {SIGN} + 6 * {EVEN} + 4 * {QUOTE} + 2 * {DONE} + 2 * {LABEL} + 3 * {CHINESE} + " + LAST.format(2, 1))
MIXED = part(f"7 + np + {FENCED}", f"1 + 16 + np + CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 5 END + 1 + 2 + 2 - {SIGN} + 4 * {EVEN} + 4 * {QUOTE} + 2 * {DONE} + 2 * {LABEL} + 7 * {CHINESE} + " + LAST.format(15, 4))
SPACED = part(f"8 + np + 2 * {FENCED}", f"CASE WHEN k % 2 = 0 THEN 3 ELSE 2 END + 16 + np + CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 20 ELSE 25 END + 2 + 4 + 4 - {SIGN} + 6 * {EVEN} + 7 * {QUOTE} + CASE k % 6 WHEN 0 THEN 3 WHEN 3 THEN 2 ELSE 0 END + 3 * {LABEL} + 3 * {CHINESE} + " + LAST.format(1, 1))
TITLE, DETAILS = "(k % 4 = 0)::INT", "(k % 5 <> 4)::INT"
HEADINGS = f"({TITLE} + {DETAILS})"
SECTIONS = part("0", f"CASE WHEN {HEADINGS} > 0 THEN {HEADINGS} ELSE {LABEL} END")
NUMBERED = part("0", f"(k % 4 = 2)::INT + 2 * {EVEN}")
ITEMS = part("0", f"(k % 4 = 2)::INT + 1 + 2 * {EVEN} + {DONE}")
BLOCKS = part("1", "(k % 4 >= 2)::INT + 1 + (k % 3 <> 0)::INT + 2")
SENTENCES = part("1", f"5 + {EVEN}")
QUOTES, CODE = part("0", QUOTE), part(FENCED, QUOTE)
DEPTH, LEVEL2 = part("0", HEADINGS), part("0", DETAILS)
ROWS = part("0", "CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 2 ELSE 3 END")
TABLE = "(NOT j AND k % 3 <> 0)"
OPEN_END = "k % 10 NOT IN (0, 5)"

#: name -> (settings, wording, the oracle's test of the same thing)
CHECKS: dict[str, tuple[dict, str, str]] = {
    "required_keyword": ({"keywords": ["STATUS", "details"]}, "", "NOT j"),
    "forbidden_phrase": ({}, 'Never write "Quoted NOTE".', "j OR k % 5 <> 0"),
    "min_words": ({}, "Use at least 45 words.", f"{WORDS} >= 45"),
    "max_words": ({"max": 48}, "", f"{WORDS} <= 48"),
    "word_range": ({"min_words": 30, "max": 44}, "", f"{MIXED} BETWEEN 30 AND 44"),
    "min_sections": ({"min": 2}, "", f"{SECTIONS} >= 2"),
    "max_sections": ({"max": 1}, "", f"{SECTIONS} <= 1"),
    "section_titles": ({"headings": ["Details", "Summary"]}, "", "NOT j"),
    "item_count": ({"count": 3, "mode": "at_least"}, "", f"{ITEMS} >= 3"),
    "ordered_list_count": ({"exact": 2, "max": 2}, "", f"{NUMBERED} = 2"),
    "no_list": ({}, "", f"{ITEMS} = 0"),
    "paragraph_count": ({"min": 4, "max": 5}, "", f"{BLOCKS} BETWEEN 4 AND 5"),
    "sentence_count": ({"min_count": 6}, "", f"{SENTENCES} >= 6"),
    "valid_json": ({}, "", "j"),
    "required_fields": ({"format": "json", "fields": ["order", "status"]}, "", "j"),
    "json_field_count": ({"field": "tags", "exact": 3}, "", "j"),
    "json_field_item_limit": ({"field": "tags", "max_chars": 6}, "", "j AND length(pr) <= 6"),
    "json_field_word_limit": ({"field": "tags", "max": 23}, "", "j AND length(pr) <= 8"),
    "markdown_table": ({}, "", TABLE),
    "no_table": ({}, "", f"NOT {TABLE}"),
    "table_columns": ({}, "A table with ITEM, and qty.", TABLE),
    "table_row_count": ({"min_rows": 1, "max_rows": 2}, "", "NOT j AND k % 3 = 1"),
    "checkbox": ({}, "", "NOT j AND k % 3 = 0"),
    "code_block": ({}, "", f"{CODE} >= 1"),
    "blockquote_count": ({"exact": 1}, "", f"{QUOTES} = 1"),
    "contains_number": ({"numbers": ["0.5 percent"]}, "", "NOT j AND c % 10 = 0 AND k % 11 <> 0"),
    "threshold": ({"thresholds": ["99.5 percent"]}, "", "NOT j AND c % 100 = 99 AND k % 11 <> 0"),
    "deadline": ({"deadlines": ["Today!"]}, "", "NOT j"),
    "exact_value": ({"expected_values": {"Share": "25.5%"}}, "", "NOT j AND c % 100 = 25 AND k % 11 = 0"),
    "decimal_places": ({"places": 2, "target": "percent"}, "", "j"),
    "first_line": ({"line": "# Order"}, "", "NOT j AND k % 4 = 0"),
    "first_line_format": ({"format": "bold"}, "", "NOT j AND k % 4 = 1"),
    "last_line": ({"word": "HIGH"}, "", f"pr LIKE '%HIGH%' AND CASE WHEN j THEN k % 14 <> 0 ELSE {OPEN_END} END"),
    "conditional_trigger": ({"trigger": "QUOTED", "required_if_present": "done"}, "", "j OR k % 5 <> 0 OR k % 6 = 0"),
    "simple_regex": ({"pattern": r"STATUS [fo]\b"}, "", "NOT j AND st IN ('F', 'O')"),
    "forbidden_regex": ({"forbidden_regex": "^1[.]"}, "", "j OR k % 4 <> 2"),
    "regex_count": ({"pattern": "\n- ", "min": 2}, "", "NOT j AND k % 6 = 0"),
    "forbidden_regex_before_heading": ({"heading": "details", "pattern": r"\| a \|"}, "", "j OR k % 3 = 0"),
    "first_word": ({"word": "Order"}, "", "NOT j AND k % 4 <> 2"),
    "first_last_line": ({"first_line": "Order", "last_line": "LOW"}, "", f"NOT j AND pr = '5-LOW' AND {OPEN_END}"),
    "heading_order": ({"headings": ["Details", "RISK & scope"]}, "", "NOT j AND k % 8 = 1"),
    "heading_level": ({"level": 2, "min": 1, "max": 1}, "", f"{LEVEL2} = 1"),
    "heading_depth": ({"min": 2}, "", f"{DEPTH} >= 2"),
    "keyword_presence": ({"required_keywords": ["check stock", "quoted"], "match_all": False}, "", "NOT j AND (k % 2 = 0 OR k % 5 = 0)"),
    "keyword_absence": ({"forbidden_keywords": ["ship it", "done"]}, "", "j OR k % 2 <> 0"),
    "first_person": ({}, "", "j OR k % 9 <> 0"),
    "risk_disclaimer": ({}, "", f"NOT j AND NOT {OPEN_END}"),
    "currency_format": ({"unit": "万元"}, "", "j OR k % 9 <> 0"),
    "no_percent": ({}, "", "j OR k % 11 <> 0"),
    "no_arabic_numerals": ({}, "", "NOT j AND k % 4 = 0"),
}


def checker(name: str, config: dict, wording: str):
    # Every answer has digits somewhere; its first line has none outside of a heading where that is one.
    text = "substring_index(response, '\n', 1)" if name == "no_arabic_numerals" else "response"
    return lambda spark, sf_dir: spark_rows(spark, sf_dir, RESPONSES).select("item_id", check(F.expr(text), name, config, F.lit(wording)).alias("score"))


CUSTOMERS = "SELECT c_custkey AS item_id, c_name AS name, c_mktsegment AS seg FROM {customer}"
def limits_of():
    """The limits that a wording names, one beside the other."""
    said = F.when(F.col("item_id") % 4 == 0, "At LEAST ").when(F.col("item_id") % 4 == 1, "Fewer than ").when(F.col("item_id") % 4 == 2, "a minimum of ").otherwise("")
    text = F.concat(F.lit("Write "), said, F.col("item_id").cast("string"), F.lit(" word or no more than 900 words"))
    return F.concat_ws("/", *[F.coalesce(M.infer_word_limit(text)[k].cast("string"), F.lit("-")) for k in ("min", "max")])


def key():
    return F.col("item_id").cast("string")


#: name -> (input, measure, the oracle's expression, and its input)
MEASURES = {
    "word_count": (RESPONSES, lambda: M.word_count(F.col("response")), WORDS, "facts"),
    "mixed_word_count": (RESPONSES, lambda: M.mixed_word_count(F.col("response")), MIXED, "facts"),
    "ws_word_count": (RESPONSES, lambda: M.ws_word_count(F.col("response")), SPACED, "facts"),
    "section_count": (RESPONSES, lambda: M.section_count(F.col("response")), SECTIONS, "facts"),
    "item_list_count": (RESPONSES, lambda: M.item_list_count(F.col("response")), ITEMS, "facts"),
    "ordered_count": (RESPONSES, lambda: M.ordered_count(F.col("response")), NUMBERED, "facts"),
    "paragraph_measure": (RESPONSES, lambda: M.paragraph_measure(F.col("response")), BLOCKS, "facts"),
    "sentence_measure": (RESPONSES, lambda: M.sentence_measure(F.col("response")), SENTENCES, "facts"),
    "blockquote_measure": (RESPONSES, lambda: M.blockquote_measure(F.col("response")), QUOTES, "facts"),
    "code_block_measure": (RESPONSES, lambda: M.code_block_measure(F.col("response")), CODE, "facts"),
    "heading_depth_measure": (RESPONSES, lambda: M.heading_depth_measure(F.col("response")), DEPTH, "facts"),
    "heading_level_measure": (RESPONSES, lambda: M.heading_level_measure(F.col("response"), 2), LEVEL2, "facts"),
    "md_table": (
        RESPONSES,
        lambda: F.array_join(F.transform(M.table_cells(F.col("response")), lambda row: F.array_join(row, ",")), ";"),
        f"CASE WHEN {TABLE} THEN 'Item,**Qty**;A,' || (c % 50)::VARCHAR || ';B,7' || CASE WHEN k % 3 = 2 THEN ';C,9' ELSE '' END END",
        "facts",
    ),
    "strip_fence": (RESPONSES, lambda: M.strip_fence(F.col("response")), f"CASE WHEN item_id % 14 = 0 THEN substr(response, 10, length(response) - 13) ELSE response END", "responses"),
    "heading_position": (RESPONSES, lambda: H.heading_position(F.col("response"), F.lit("details")), f"CASE WHEN item_id % 7 <> 0 THEN instr(response, {NL} || {NL} || CASE WHEN item_id % 5 = 4 THEN '    ' ELSE '  ' END || '## Details') END", "responses"),
    "canonical_number": (CUSTOMERS, lambda: M.canonical_number(F.concat(F.lit("  Rate "), key(), F.lit(",000\n PERCENT "))), "'rate ' || item_id::VARCHAR || '000 %'", "customers"),
    "extract_numbers": (
        CUSTOMERS,
        lambda: F.array_join(M.extract_numbers(F.concat(F.lit("Paid $1,"), key(), F.lit("00 and "), key(), F.lit(".5  percent in 3 Days, x9 no, 20%"))), "|"),
        "'$1' || item_id::VARCHAR || '00|' || item_id::VARCHAR || '.5 %|3 days|20%'",
        "customers",
    ),
    "quoted_terms": (CUSTOMERS, lambda: F.array_join(M.quoted_terms(F.concat(F.lit('Use "'), F.col("name"), F.lit(' " or \''), F.col("seg"), F.lit("' or “x”, not \"\""))), "|"), "name || '|' || seg || '|x'", "customers"),
    "infer_word_limit": (
        CUSTOMERS,
        limits_of,
        "CASE WHEN item_id % 2 = 0 THEN item_id::VARCHAR ELSE '-' END || '/900'",
        "customers",
    ),
    "infer_table_columns": (
        CUSTOMERS,
        lambda: F.array_join(
            M.infer_table_columns(
                F.when(F.col("item_id") % 4 == 0, F.concat(F.lit("Give a table with columns "), F.col("seg"), F.lit(", **Qty**, and `Unit Price`. Short.")))
                .when(F.col("item_id") % 4 == 1, F.concat(F.lit("A two-column table of "), F.col("seg"), F.lit(" and Risk; no more")))
                .when(F.col("item_id") % 4 == 2, F.concat(F.lit("A table with "), F.col("seg"), F.lit(", x")))
                .otherwise("A table with care")
            ),
            "|",
        ),
        "CASE item_id % 4 WHEN 0 THEN seg || '|Qty|Unit Price' WHEN 1 THEN seg || '|Risk' WHEN 2 THEN seg || '|x' END",
        "customers",
    ),
}


def measured(text, column):
    return lambda spark, sf_dir: spark_rows(spark, sf_dir, text).select("item_id", column().alias("value"))


def constraints_of(orders):
    """Eleven constraints for each order, with settings of its own: names, aliases, inference, routes and errors."""
    k = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    none = F.lit(None).cast("map<string,string>")

    def rule(index, tag, kind, checker, wording, settings=none, evaluator=none, params=none):
        return F.struct(F.lit(index).alias("constraint_index"), F.lit(tag).cast("string").alias("tag"), F.lit(kind).alias("check_type"), F.lit(checker).cast("string").alias("checker"), wording.alias("constraint"), settings.alias("settings"), evaluator.alias("evaluator"), params.alias("params"))

    m = lambda *kv: F.create_map(*[x if not isinstance(x, str) else F.lit(x) for x in kv])
    blank = F.lit("")
    rows = [
        rule(0, "FP3", "rule", "Check markdown-table", blank),
        rule(1, "FP3", "rule_aided", "table_row_count", blank, m("min_rows", "9"), none, m("min_rows", text(2 + k % 2))),
        rule(2, "FP1", "rule", None, blank, m("type", "minimum_words", "min", text(40 + k % 10))),
        rule(3, "FP1", "rule", None, F.concat(F.lit("No more than "), text(45 + k % 5), F.lit(" words")), m("mode", "any")),
        rule(4, "EG1", "LLM", None, F.lit("Be right")),
        rule(5, "DB1", "rule", "no_such_checker", blank),
        rule(6, None, "magic", None, blank),
        rule(7, "QV1", "rule", None, blank, m("places", "2")),
        rule(8, "RC2", "rule", "regex", blank, none, none, m("pattern", F.concat(F.lit("STATUS ["), F.col("o_orderstatus"), F.lit("]")))),
        rule(9, "DB2", "rule", "required_fields", blank, none, m("format", "json", "fields", '["order", "status"]')),
        rule(10, "RC2", "rule", "keywords", F.concat(F.lit("Name '"), F.col("o_orderpriority"), F.lit("'"))),
    ]
    return orders.select(k.alias("item_id"), F.explode(F.array(*rows)).alias("r")).select("item_id", "r.*")


def evaluated(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    found = evaluate(spark_rows(spark, sf_dir, RESPONSES), constraints_of(orders))
    return found.select("item_id", "constraint_index", "constraint_id", "check_type", "tag", "family", "checker", "score", "status", "method", "error")


#: index, check type, tag, family, checker, method, error, test
EVALUATED = [
    (0, "rule", "FP3", "FP", "markdown_table", None, None, TABLE),
    (1, "rule", "FP3", "FP", "table_row_count", None, None, f"{TABLE} AND {ROWS} >= 2 + k % 2"),
    (2, "rule", "FP1", "FP", "min_words", None, None, f"{WORDS} >= 40 + k % 10"),
    (3, "rule", "FP1", "FP", "max_words", None, None, f"{WORDS} <= 45 + k % 5"),
    (4, "LLM", "EG1", "EG", None, "judge", None, "NULL::BOOLEAN"),
    (5, "rule", "DB1", "DB", "no_such_checker", "rule_aided:unresolved", "rule gave no verdict", "NULL::BOOLEAN"),
    (6, "magic", None, "unknown", None, "schema", "unknown check_type", "false"),
    (7, "rule", "QV1", "QV", None, "rule_aided:unresolved", "rule without settings", "NULL::BOOLEAN"),
    (8, "rule", "RC2", "EG", "simple_regex", None, None, "NOT j"),
    (9, "rule", "DB2", "DB", "required_fields", None, None, "j"),
    (10, "rule", "RC2", "EG", "required_keyword", None, None, "true"),
]


def _evaluated_sql() -> str:
    text = lambda x: "NULL::VARCHAR" if x is None else f"'{x}'"
    parts = [
        f"SELECT item_id, {i}::BIGINT AS constraint_index, item_id::VARCHAR || '#C{i + 1}' AS constraint_id, {text(kind)} AS check_type, {text(tag)} AS tag, {text(fam)} AS family, {text(name)} AS checker, ({test})::INT AS score, {text(method or f'rule_aided:{name}')} AS method, {text(error)} AS error FROM facts"
        for i, kind, tag, fam, name, method, error, test in EVALUATED
    ]
    return "SELECT *, CASE score WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' ELSE 'needs_judge' END AS status FROM (" + " UNION ALL ".join(parts) + ")"


QUERIES = {name: checker(name, config, wording) for name, (config, wording, _) in CHECKS.items()} | {name: measured(text, column) for name, (text, column, _, _) in MEASURES.items()}
QUERIES |= {"response_profile": lambda spark, sf_dir: (r := spark_rows(spark, sf_dir, RESPONSES)).select("item_id", *M.response_profile(r["response"])), "evaluate_constraints": evaluated}
SQL = {name: f"SELECT item_id, {one(test)} AS score FROM facts" for name, (_, _, test) in CHECKS.items()} | {name: f"SELECT item_id, {e} AS value FROM {source}" for name, (_, _, e, source) in MEASURES.items()}
SQL["response_profile"] = (
    f"SELECT item_id, length(response) AS n_chars, {WORDS} AS words, {MIXED} AS mixed_words, {SPACED} AS ws_words, {SECTIONS} AS sections, {ITEMS} AS list_items, {NUMBERED} AS ordered_items, {BLOCKS} AS paragraphs, {SENTENCES} AS sentences, {QUOTES} AS quotes, {CODE} AS code_blocks, {DEPTH} AS heading_depth, {TABLE} AS has_table FROM facts JOIN responses USING (item_id)"
)
SQL["evaluate_constraints"] = _evaluated_sql()
INPUTS = {"responses": RESPONSES, "facts": FACTS, "customers": CUSTOMERS}
ORACLES = {name: with_sql(text, **{k: v for k, v in INPUTS.items() if f" {k}" in text}) for name, text in SQL.items()}
