"""What evaluate asks of Python goes there as one text an answer, in one step with the counts."""

import json

from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.operators.checkers import evaluate

PARAMS = "item_id int, constraint_index int, check_type string, checker string, params map<string,string>"


def test_asks_go_to_python_as_text_and_with_the_counts(spark):
    rules = spark.createDataFrame([(0, 0, "rule", "min_words", {"min": "1"}), (0, 1, "rule", "simple_regex", {"pattern": "a"}), (0, 2, "rule", "valid_json", {"x": "1"})], PARAMS)
    found = evaluate(spark.createDataFrame([(0, "a")], "item_id int, response string"), rules)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    step = [x for x in plan.split("\n") if "ArrowEvalPython" in x]
    assert len(step) == 1 and "answer_facts" in step[0] and "counted" in step[0]
    assert {r.constraint_index: r.score for r in found.collect()} == {0: 1, 1: 1, 2: 0}


def test_asks_are_lines_of_json(spark):
    """One for each constraint, empty for those that ask nothing; what is not written is null."""
    asks = '{"kind": "count", "exact": true, "pattern": "a"}\n\n{"kind": "places", "headings": ["B"]}'
    found = spark.range(1).select(H.answer_facts(F.lit("aa\nb"), F.lit(asks)).alias("f")).first().f
    assert [None if x is None else (x.n, x.places) for x in found] == [(2, None), None, (None, [3])]
    assert spark.range(1).select(H.answer_facts(F.lit("a"), F.lit(None).cast("string")).alias("f")).first().f is None


def test_asks_keep_their_settings(spark):
    """Patterns with line ends, quotes, backslashes and separators; headings and fields in lists; many terms."""
    terms = [f"t\n{i}" for i in range(40)]
    cases = [
        ("simple_regex", {"pattern": "a\nb"}, "xa\nb", 1),
        ("simple_regex", {"pattern": "\"\\d\\\\ \""}, "\"7\\ \"", 1),
        ("simple_regex", {"pattern": "A", "case_sensitive": "true"}, "a", 0),
        ("regex_count", {"pattern": "\\n", "exact": "2"}, "a\nb\nc", 1),
        ("heading_order", {"headings": '["B\\"", "A"]'}, "# B\"\n# A", 1),
        ("required_fields", {"fields": '["a\\nb"]', "format": "json"}, json.dumps({"a\nb": 1}), 1),
        ("json_field_item_limit", {"field": "中", "max": "2"}, '{"中": ["ab", "c"]}', 1),
        ("keyword_presence", {"required_keywords": json.dumps(terms)}, " ".join(terms), 1),
        ("keyword_presence", {"required_keywords": json.dumps(terms + ["T\n0"])}, " ".join(terms), 0),
    ]
    # All on one answer's list, and each on a list of its own.
    for spread in (False, True):
        one = [(100 * k if spread else k, k, "rule", name, params) for k, (name, params, _, _) in enumerate(cases)]
        texts = [(r[0], case[2]) for r, case in zip(one, cases, strict=True)]
        if not spread:
            one = [(i, k, *rest) for i in range(len(cases)) for (_, k, *rest) in one]
        got = {(r.item_id, r.constraint_index): r.score for r in evaluate(spark.createDataFrame(texts, "item_id int, response string"), spark.createDataFrame(one, PARAMS)).collect()}
        for k, case in enumerate(cases):
            assert got[texts[k][0], k] == case[3], case
