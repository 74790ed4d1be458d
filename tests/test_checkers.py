"""Truth tables of checkers, measures and helpers, derived by hand."""

import json

import pytest
from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.functions import measures as M
from verdance.operators import construct as C
from verdance.operators import judge as J
from verdance.operators.checkers import CHECKERS, check, evaluate, register_checker


def verdicts(spark, name, config, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(check(F.col("t"), name, config)).collect()]


TABLE = "| A | B |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"
THREE = TABLE + "\n| 5 | 6 |"
LIST = "1. a\n2) b\n- c\n* d\n• e"
TWENTY = " ".join(["word"] * 20)

#: checker, settings, answer, score, wording (empty where it is not read). Worked out by hand.
TRUTH = [
    # limits: exact, min and max hold together; 0 is unset in a chain, its last term keeps it
    ("ordered_list_count", {"exact": 2, "max": 1}, "1. a\n2. b", 0, ""),
    ("ordered_list_count", {"exact": 2, "max": 2}, "1. a\n2. b", 1, ""),
    ("ordered_list_count", {"exact_count": 0}, "text", None, ""),
    ("ordered_list_count", {"exact": 0}, "text", 1, ""),
    ("ordered_list_count", {"exact_count": 0, "exact": 2}, "1. a\n2) b", 1, ""),
    ("ordered_list_count", {"min_count": 1, "max_count": 3}, LIST, 1, ""),
    ("ordered_list_count", {"min": 3}, LIST, 0, ""),
    ("ordered_list_count", {}, LIST, None, ""),
    ("paragraph_count", {"exact": 2}, "# Head\n\none\n\n**Bold line**\n\ntwo\nlines", 1, ""),
    ("paragraph_count", {"exact": 2}, "**Bold**:\n\ntext", 1, ""),
    ("paragraph_count", {"min": 1, "max": 1}, "a\n \nb", 0, ""),
    ("sentence_count", {"exact": 2}, "First sentence. Second sentence! No.", 1, ""),
    ("sentence_count", {"min": 3}, "第一句话说完了。第二句话也完了！第三句话问完了？", 1, ""),
    ("blockquote_count", {"exact": 1}, ">no space", 0, ""),
    ("blockquote_count", {"exact": 1}, "  > with space\n>none", 1, ""),
    # words
    ("min_words", {"min": 6}, "Straße café don't x2² 中文 a_b", 1, ""),
    ("min_words", {"min": 7}, "Straße café don't x2² 中文 a_b", 0, ""),
    ("min_words", {}, "a b", None, "Be brief."),
    ("min_words", {}, TWENTY, 1, "Use at least 20 words."),
    ("min_words", {"min": 0}, TWENTY, 0, "A minimum of 21 words"),
    ("max_words", {}, TWENTY, 0, "Use FEWER THAN 20 words? No more than 19 words."),
    ("max_words", {"max": "20"}, TWENTY, 1, ""),
    ("max_words", {"max": "many"}, TWENTY, None, ""),
    ("word_range", {"min_words": 3, "max": 4}, "中文 two words", 1, ""),
    ("word_range", {"max_words": 3}, "中文 two words", 0, ""),
    ("word_range", {"min": "x", "max": 9}, "a", None, ""),
    ("word_range", {}, "a", None, ""),
    # sections, items
    ("min_sections", {"min": 1}, "  ## Indented", 1, ""),
    ("min_sections", {"min": 0}, "text", 1, ""),
    ("min_sections", {"min": 2}, "1. Scope:\nRisk & cost:\ntext", 1, ""),
    ("min_sections", {"min": 2}, "# One\nLabel here:\n", 0, ""),
    ("min_sections", {}, "# A\n# B", 1, 'Sections "A" and “B”'),
    ("min_sections", {}, "# A", None, "some sections"),
    ("max_sections", {"max": 1}, "# A\n    # code", 1, ""),
    ("max_sections", {}, "# A", None, '"A"'),
    ("section_titles", {"required_titles": [" Scope ", "Risk"]}, "Scope and Risk", 1, ""),
    ("section_titles", {"fields": "scope"}, "Scope", 0, ""),
    ("section_titles", {}, "Scope", 1, "Use 'Scope'"),
    ("item_count", {"count": 1}, "+ a\n- b", 1, ""),
    ("item_count", {"min": 2}, "- a\n- b\n- c", 0, ""),
    ("item_count", {"min": 2, "mode": "at_least"}, "- a\n- b\n- c", 1, ""),
    ("item_count", {"exact": 5}, LIST, 1, ""),
    ("item_count", {}, "- a\n- b\n- c", 1, "at least 2 bullets"),
    ("item_count", {}, "- a\n- b\n- c", 0, "Exactly 2 findings"),
    ("item_count", {}, "- a", None, "two bullets"),
    ("no_list", {}, "a - b\n+ c", 1, ""),
    ("no_list", {}, "  • c", 0, ""),
    # keywords
    ("required_keyword", {"keywords": ["STRASSE"]}, "Die Straße", 1, ""),
    ("required_keyword", {"keyword": "x", "case_sensitive": True}, "X", 0, ""),
    ("required_keyword", {"keywords": [], "keyword": "y"}, "Y", 1, ""),
    ("required_keyword", {}, "the Term", 1, 'Mention "term" please'),
    ("required_keyword", {}, "text", None, "Mention it"),
    ("forbidden_phrase", {"phrases": ["Bad"]}, "so bad", 0, ""),
    ("forbidden_phrase", {"keywords": "worse"}, "so bad", 1, ""),
    ("forbidden_phrase", {}, "ok", 1, "Avoid 'bad'"),
    ("keyword_presence", {"required_keywords": ["a"]}, "a", 1, ""),
    ("keyword_presence", {"keywords": ["a", "Z"], "match_all": False}, "a", 1, ""),
    ("keyword_presence", {"keywords": ["a", "Z"]}, "a", 0, ""),
    ("keyword_presence", {"match_all": False}, "a", None, '"a"'),
    ("keyword_absence", {"forbidden_keywords": ["bad"]}, "bad", 0, ""),
    ("keyword_absence", {"forbidden": "bad"}, "Bad", 1, ""),
    ("keyword_absence", {"keywords": ["bad"]}, "bad", None, ""),
    ("first_person", {}, "本报告认为", 0, ""),
    ("first_person", {}, "This report", 1, ""),
    ("first_person", {"forbidden_phrases": ["we"]}, "本文 we", 0, ""),
    ("risk_disclaimer", {}, "text\n以上内容仅供参考，不构成投资建议", 1, ""),
    ("risk_disclaimer", {}, "免责声明\n1\n2\n3\n4\n5", 0, ""),
    ("risk_disclaimer", {"risk_line": "No advice"}, "x\nNo advice given", 1, ""),
    ("risk_disclaimer", {}, "Risk: high", 0, ""),
    ("risk_disclaimer", {}, " \n", 0, ""),
    ("currency_format", {"unit": "万元"}, "共 5 亿元", 0, ""),
    ("currency_format", {"unit": "USD"}, "5 €", 1, ""),
    ("currency_format", {"forbidden_units": ["€"]}, "5 €", 0, ""),
    ("currency_format", {"forbidden_units": "亿元"}, "5 元", 1, ""),
    ("currency_format", {}, "5 元", None, ""),
    ("conditional_trigger", {"trigger": "Loan", "required_if_present": "risk"}, "a loan", 0, ""),
    ("conditional_trigger", {"trigger": "Loan", "followup": "RISK"}, "a loan at risk", 1, ""),
    ("conditional_trigger", {"trigger": "Loan", "followup": "risk", "case_sensitive": True}, "a loan", 1, ""),
    ("conditional_trigger", {"trigger": "Loan"}, "a loan", None, ""),
    # JSON
    ("valid_json", {}, '```json\n{"a": 1}\n```', 1, ""),
    ("valid_json", {}, '```json5\n{"a": 1}\n```', 1, ""),
    ("valid_json", {}, '{"a":1} x', 0, ""),
    ("valid_json", {}, '{"a":1,"a":2}', 1, ""),
    ("valid_json", {}, "NaN", 1, ""),
    ("valid_json", {}, "[1,]", 0, ""),
    ("valid_json", {}, "", 0, ""),
    ("required_fields", {"format": "json", "fields": ["a"]}, '{"a": null}', 1, ""),
    ("required_fields", {"type": "Valid-JSON", "required_fields": ["a", "b"]}, '{"a": 1}', 0, ""),
    ("required_fields", {"format": "json", "fields": ["a"]}, "[1]", 0, ""),
    ("required_fields", {"fields": ["Net Debt"]}, "- net debt | 5", 1, ""),
    ("required_fields", {"fields": ["Net Debt"]}, "the net debt is", 0, ""),
    ("required_fields", {}, "has Net", 1, 'fields "Net"'),
    ("json_field_count", {"field": "t", "exact": 2}, "[1,2]", 1, ""),
    ("json_field_count", {"field": "t", "exact": 2}, '{"t": {"a": 1, "b": 2}}', 1, ""),
    ("json_field_count", {"field": "t", "exact": 2}, '{"t": "ab"}', 0, ""),
    ("json_field_count", {"exact_count": 1}, '{"t": "ab"}', 1, ""),
    ("json_field_count", {"field": "t"}, "{}", None, ""),
    ("json_field_item_limit", {"field": "t", "max_chars": 5}, '{"t":"ab"}', 0, ""),
    ("json_field_item_limit", {"field": "t", "max": 2}, '{"t":["ab", 12]}', 1, ""),
    ("json_field_item_limit", {"field": "t", "max_chars": 1}, '{"t":["ab"]}', 0, ""),
    ("json_field_item_limit", {"max_chars": 1}, "{}", None, ""),
    ("json_field_word_limit", {"field": "t", "max_chars": 6}, '{"t":["abc","def"]}', 0, ""),
    ("json_field_word_limit", {"field": "t", "max_chars": 6}, '{"x": 1}', 1, ""),
    ("json_field_word_limit", {"field": "t", "max_chars": 6}, "text", 0, ""),
    ("json_field_word_limit", {"field": "t"}, "{}", None, ""),
    # tables
    ("markdown_table", {}, TABLE, 1, ""),
    ("markdown_table", {}, "| A | B |", 0, ""),
    ("markdown_table", {}, "| A |\n| --- |\n| 1 |", 0, ""),
    ("no_table", {}, TABLE, 0, ""),
    ("table_row_count", {"min_rows": 1, "max_rows": 2}, THREE, 0, ""),
    ("table_row_count", {"exact_rows": 2}, TABLE, 1, ""),
    ("table_row_count", {"exact_rows": 0}, "no table", 0, ""),
    ("table_row_count", {"max_rows": 0}, "| A | B |\n| --- | --- |", 1, ""),
    ("table_row_count", {}, "no table", None, ""),
    ("table_columns", {"columns": ["b"]}, TABLE.replace("B", "**B**"), 1, ""),
    ("table_columns", {"required_columns": ["C"], "columns": ["A"]}, TABLE, 0, ""),
    ("table_columns", {}, TABLE, 1, 'columns "A"'),
    ("table_columns", {}, TABLE, 1, "a table with A, and B."),
    ("table_columns", {}, TABLE, 0, "headers named A, C; more"),
    ("table_columns", {}, TABLE, 1, "a two-column table of A and B"),
    ("table_columns", {}, "text", None, "a table with care"),
    ("table_columns", {"columns": "A"}, "text", 0, ""),
    ("checkbox", {}, "[ ]", 0, ""),
    ("checkbox", {}, "- [] task", 1, ""),
    ("checkbox", {}, "+ [x] task", 0, ""),
    ("checkbox", {}, "[X] task", 1, ""),
    ("code_block", {}, "```\na\n```", 1, ""),
    ("code_block", {"min_count": 2}, "```\na\n```", 0, ""),
    ("code_block", {"min": 0}, "```", 0, ""),
    # numbers
    ("contains_number", {"numbers": ["1,000 percent"]}, "1000  %", 1, ""),
    ("contains_number", {"number": "12"}, "12 Days", 1, ""),
    ("contains_number", {"numbers": [7]}, "none", 0, ""),
    ("contains_number", {}, "12", None, "must contain 12"),
    ("threshold", {"thresholds": ["$5"]}, "about $5.5", 1, ""),
    ("threshold", {"thresholds": ["6"]}, "about $5.5", 0, ""),
    ("deadline", {"deadline": "March  1"}, "by march 1", 1, ""),
    ("deadline", {"deadlines": ["30 days"]}, "30-days", 0, ""),
    ("exact_value", {"expected_values": {"a": 1}}, "a 1", 1, ""),
    ("exact_value", {"expected_values": {"Share": "5 percent"}}, "share is 6 %", 0, ""),
    ("exact_value", {"values": {"a": 1}}, "a 1", None, ""),
    ("exact_value", {"expected_values": {"a": [1, 2]}}, "a [1, 2]", 1, ""),
    ("exact_value", {"expected_values": {"a": [1, 2]}}, "a [12]", 0, ""),
    ("exact_value", {"expected_values": {"a": ["x, y", None, {"b": True}]}}, "A: ['x, y', None, {'b': True}]", 1, ""),
    ("decimal_places", {"places": 2}, "12 units and 3.10", 0, ""),
    ("decimal_places", {"places": 2}, "1.25 and -3.10%", 1, ""),
    ("decimal_places", {"places": 1, "target": "percent"}, "12% share", 0, ""),
    ("decimal_places", {"places": 1, "mode": "percentages"}, "7 and 1.5 percentage points", 1, ""),
    ("decimal_places", {"places": 2, "target": "percent"}, "1.5", 1, ""),
    ("decimal_places", {"places": 2}, "no numbers", 0, ""),
    ("decimal_places", {"places": 0}, "5", None, ""),
    ("decimal_places", {"exact": 0}, "5", 1, ""),
    ("decimal_places", {}, "1.25", 1, "Use 2 decimal places"),
    ("no_percent", {}, "5％", 0, ""),
    ("no_arabic_numerals", {}, "# Part 1\ntext\n| 1 |", 1, ""),
    ("no_arabic_numerals", {}, "| 1 | open", 0, ""),
    ("no_arabic_numerals", {}, " # Part 1", 0, ""),
    # lines and words
    ("first_line", {"line": "b"}, "\r\n \nb\na", 1, ""),
    ("first_line", {"word": "Dear"}, "dear", 0, ""),
    ("first_line", {}, "Dear all", 1, "Open with 'Dear'"),
    ("first_line", {}, "Dear all", None, "Open politely"),
    ("last_line", {"word": "end"}, "a\nthe end.\n\n", 1, ""),
    ("last_line", {"line": "z"}, "", 0, ""),
    ("first_line_format", {"format": "numbered"}, "7. x", 0, ""),
    ("first_line_format", {"format": "Numbered"}, "1) x", 1, ""),
    ("first_line_format", {"format": "bold"}, "**a** b", 1, ""),
    ("first_line_format", {"format": "heading"}, "#x", 0, ""),
    ("first_line_format", {"format": "odd"}, "x", None, ""),
    ("first_line_format", {"format": "odd"}, "", 0, ""),
    ("first_line_format", {}, "x", None, ""),
    ("first_word", {"word": "Hello"}, " **Hello** you", 1, ""),
    ("first_word", {"word": "Hello"}, "## Hello", 1, ""),
    ("first_word", {}, "Hello", 0, "Begin with 'hello'"),
    ("first_last_line", {"first_line": "a"}, "b", 0, ""),
    ("first_last_line", {"first_line": "a", "last_line": "c"}, "xay\nb\nc", 1, ""),
    ("first_last_line", {"last_line": "c"}, "\n", 0, ""),
    ("first_last_line", {"first": "b"}, "a", None, ""),
    # headings
    ("heading_order", {"headings": ["Risk", "Plan"]}, "Risk:\ntext\n2. plan", 1, ""),
    ("heading_order", {"headings": ["Risk"]}, "# Risk Factors", 0, ""),
    ("heading_order", {"fields": ["B", "A"]}, "# A\n# B", 0, ""),
    ("heading_order", {"headings": ["a"], "case_sensitive": True}, "# A", 0, ""),
    ("heading_order", {}, "# A\n# B", 1, 'Order "A", "B"'),
    ("heading_order", {}, "# A", None, "in order"),
    ("heading_level", {"level": 2, "exact": 1}, "## A\n### B\n   ## \n", 1, ""),
    ("heading_level", {"level": 7, "exact": 0}, "####### A", 1, ""),
    ("heading_level", {"exact": 1}, "## A", None, ""),
    ("heading_depth", {"min": 2}, "# A\n   ## B", 1, ""),
    ("heading_depth", {"min_depth": 2}, "# A\n    ## B", 0, ""),
    ("heading_depth", {}, "# A", None, ""),
    # patterns
    ("simple_regex", {"pattern": "total"}, "TOTAL due", 1, ""),
    ("simple_regex", {"regex": "total", "case_sensitive": True}, "TOTAL due", 0, ""),
    ("simple_regex", {"pattern": "("}, "text", 0, ""),
    ("simple_regex", {}, "text", None, ""),
    ("forbidden_regex", {"pattern": "^b"}, "a\nb", 1, ""),
    ("forbidden_regex", {"forbidden_regex": "B", "pattern": "z"}, "a\nb", 0, ""),
    ("forbidden_regex", {"pattern": "("}, "text", 0, ""),
    ("regex_count", {"pattern": "a", "exact": 2}, "Aa", 1, ""),
    ("regex_count", {"pattern": "a", "min": 1, "max": 1}, "Aa", 0, ""),
    ("regex_count", {"pattern": "("}, "text", 0, ""),
    ("regex_count", {"pattern": "a"}, "text", None, ""),
    ("forbidden_regex_before_heading", {"pattern": "x", "heading": "End"}, "a\n# End\nx", 1, ""),
    ("forbidden_regex_before_heading", {"regex": "X", "heading": "end"}, "x\nEnd:", 0, ""),
    ("forbidden_regex_before_heading", {"pattern": "x", "heading": "Gone"}, "a x", 0, ""),
    ("forbidden_regex_before_heading", {"pattern": "x"}, "a x", None, ""),
    ("unknown", {}, "x", None, ""),
]


def as_settings(config):
    return {k: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in config.items()}


def test_truth_table_with_settings_of_each_row(spark):
    """All rows in one table: every answer has a constraint with settings of its own."""
    schema = "item_id int, constraint_index int, constraint string, check_type string, checker string, params map<string,string>"
    rules = spark.createDataFrame([(i, 0, wording, "rule", name, as_settings(config)) for i, (name, config, _, _, wording) in enumerate(TRUTH)], schema)
    answers = spark.createDataFrame([(i, "m", t) for i, (_, _, t, _, _) in enumerate(TRUTH)], "item_id int, model string, response string")
    got = {r.item_id: r for r in evaluate(answers, rules).collect()}
    # A type among the settings names the checker; required_fields reads it as the format.
    named = [i for i, (name, config, *_) in enumerate(TRUTH) if "type" in config]
    wrong = [(TRUTH[i], got[i].score) for i in range(len(TRUTH)) if i not in named and got[i].score != TRUTH[i][3]]
    assert not wrong
    assert [got[i].checker for i in named] == ["valid_json"]
    for i, r in got.items():
        if i not in named:
            assert r.method == ("rule_aided:unresolved" if r.checker == "unknown" else f"rule_aided:{TRUTH[i][0]}")
        assert r.status == {1: "pass", 0: "fail", None: "needs_judge"}[r.score]
        assert (r.reason is None) == (r.score is None) and (r.error is None) == (r.score is not None)


def test_truth_table_with_literal_settings(spark):
    """One checker for a whole table, one expression a row of the truth table."""
    texts = sorted({row[2] for row in TRUTH})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    picked = TRUTH[::3]
    wrong = []
    for at in range(0, len(picked), 12):
        part = picked[at : at + 12]
        columns = [check(F.col("t"), name, config, F.lit(wording)).alias(f"c{k}") for k, (name, config, _, _, wording) in enumerate(part)]
        rows = {r.t: r for r in df.select("t", *columns).collect()}
        wrong += [(row, rows[row[2]][f"c{k}"]) for k, row in enumerate(part) if rows[row[2]][f"c{k}"] != row[3]]
    assert not wrong


def test_routes_aliases_inference_and_errors(spark):
    rows = [
        (0, None, "rule", "Check JSON-format", "", {"places": "2"}, None, '{"a": 1}'),  # alias
        (1, "FP2", "rule", None, "Give a table with A, B", {"min": "1"}, None, TABLE),  # inferred
        (2, "QV4", "rule_aided", None, "at least 5", None, {"numbers": '["5"]'}, "5 units"),
        (3, "EG1", "LLM", "min_words", "Be kind", None, {"min": "1"}, "text"),
        (4, None, "magic", "min_words", "", None, {"min": "1"}, "text"),
        (5, None, "rule", None, "", {"places": "1"}, None, "text"),  # places is no explicit setting
        (6, None, None, None, "judge me", None, None, "text"),
        (7, None, "rule", "min_words", "Be brief", {"min": "x"}, None, "text"),
    ]
    schema = "item_id int, constraint_index int, tag string, check_type string, checker string, constraint string, settings map<string,string>, params map<string,string>"
    rules = spark.createDataFrame([(i, 3, tag, kind, name, wording, top, params) for i, tag, kind, name, wording, top, params, _ in rows], schema)
    answers = spark.createDataFrame([(r[0], r[7]) for r in rows], "item_id int, response string")
    got = {r.item_id: (r.checker, r.score, r.method, r.error) for r in evaluate(answers, rules).collect()}
    assert got == {
        0: ("valid_json", 1, "rule_aided:valid_json", None),
        1: ("table_columns", 1, "rule_aided:table_columns", None),
        2: ("contains_number", 1, "rule_aided:contains_number", None),
        3: (None, None, "judge", None),
        4: (None, 0, "schema", "unknown check_type"),
        5: (None, None, "rule_aided:unresolved", "rule without settings"),
        6: (None, None, "judge", None),
        7: ("min_words", None, "rule_aided:min_words", "rule gave no verdict"),
    }
    assert evaluate(answers, rules).select("constraint_id").first()[0].endswith("#C4")


def test_settings_override_in_order(spark):
    schema = "item_id int, constraint_index int, check_type string, checker string, settings map<string,string>, evaluator map<string,string>, params map<string,string>"
    rules = spark.createDataFrame([(0, 0, "rule", "max_words", {"max": "1", "bogus": "x"}, {"max": "2"}, {"max": "3"}), (1, 0, "rule", "max_words", {"max": "1"}, {"min": "2"}, None)], schema)
    answers = spark.createDataFrame([(0, "a b c"), (1, "a b c")], "item_id int, response string")
    assert {r.item_id: r.score for r in evaluate(answers, rules).collect()} == {0: 1, 1: 0}


def test_folding_equals_casefold(spark):
    """Two characters are equal folded if and only if Python's casefold makes them so."""
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000 and i != 0xE000 and chr(i) != chr(i).casefold()]
    chars += [c for x in chars for c in x.casefold()] + ["ı", "ς", "σ", "ß", "SS", "ss"]
    df = spark.createDataFrame([(c,) for c in sorted(set(chars))], "c string")
    own: dict = {}
    theirs: dict = {}
    for r in df.select("c", M.fold(F.col("c")).alias("f")).collect():
        own.setdefault(r.f, set()).add(r.c)
        theirs.setdefault(r.c.casefold(), set()).add(r.c)
    assert {frozenset(v) for v in own.values()} == {frozenset(v) for v in theirs.values()}


def test_all_fifty_checkers_are_there():
    assert len(CHECKERS) >= 50


def test_own_checker(spark):
    @register_checker("loud")
    def _(response, config):
        return response.endswith("!")

    assert verdicts(spark, "loud", {}, "a!", "a") == [1, 0]


def test_line_ends(spark):
    df = spark.createDataFrame([("a\r\nb\x0bc\u2028d\re",)], "t string")
    assert df.select(F.size(M.lines(F.col("t")))).first()[0] == 5


@pytest.mark.parametrize(
    ("raw", "error"),
    [
        ("x", "not_json"),
        ("[]", "not_object"),
        ("{}", "no_list"),
        ('{"constraint_scores":[{"constraint_index":true}]}', "bad_index"),
        ('{"constraint_scores":[{"constraint_index":7,"score":1,"reason":"r"}]}', "unexpected_index"),
        ('{"constraint_scores":[{"constraint_index":0,"score":true,"reason":"r"}]}', "bad_score"),
        ('{"constraint_scores":[{"constraint_index":0,"score":1,"reason":" "}]}', "empty_reason"),
        ('{"constraint_scores":[{"constraint_index":0,"score":1,"reason":"r"},{"constraint_index":0,"score":1,"reason":"r"}]}', "duplicate_index"),
        ('{"constraint_scores":[{"constraint_index":0,"score":1,"reason":"r"}],"quality_score":3}', "missing_index"),
        ('{"constraint_scores":[{"constraint_index":0,"score":1,"reason":"r"},{"constraint_index":1,"score":0,"reason":"r"}],"quality_score":11}', "bad_quality"),
        ('{"constraint_scores":[{"constraint_index":0,"score":1,"reason":"r"},{"constraint_index":1,"score":0,"reason":"r"}],"quality_score":3}', "empty_quality_reason"),
        ('{"constraint_scores":[{"constraint_index":0,"score":1.0,"reason":"r"},{"constraint_index":1,"score":0,"reason":"r"}],"quality_score":3,"quality_reason":"q"}', None),
    ],
)
def test_judge_errors(raw, error):
    assert H.parse_judge(raw, [0, 1])["error"] == error


def test_majority_tie_goes_to_the_last_vote(spark):
    votes = spark.createDataFrame([(1, 0, 1, 1, "a"), (1, 0, 2, 0, "b")], "item_id int, constraint_index int, repeat int, score int, reason string")
    assert [(r.score, r.reason) for r in J.majority_vote(votes).collect()] == [(0, "b")]


def test_quality_rounds_half_to_even(spark):
    votes = spark.createDataFrame([(1, 1, 6, "a"), (1, 2, 7, "b")], "item_id int, repeat int, quality int, reason string")
    assert [r.quality for r in J.quality_mean(votes).collect()] == [6]


def test_drawn_sets_hold_no_excluded_pair_and_depend_on_keys_only(spark):
    rows = [(s, f"c{c}", 1.0 + c % 3, [f"c{k}" for k in range(1, 8, 2) if k != c] if c % 2 else []) for s in range(50) for c in range(8)]
    pool = spark.createDataFrame(rows, "sample_id int, constraint_id string, weight double, excludes array<string>")
    counts = spark.createDataFrame([(s, 3) for s in range(50)], "sample_id int, n int")
    drawn = lambda n: sorted(tuple(r) for r in C.sample_constraints(pool.repartition(n), counts).collect())
    one = drawn(1)
    assert one == drawn(7) and len(one) == 150
    for s in range(50):
        assert sum(int(c[1]) % 2 for t, c, _ in one if t == s) <= 1


def test_drawn_uses_stay_within_their_caps(spark):
    names = ["check_json_format", "check_no_list", "check_heading_level", "a", "b", "c"]
    rows = [(s, n, "hard", n in ("a", "check_no_list"), 10 if n == "a" else 30) for s in range(60) for n in names]
    pool = spark.createDataFrame(rows, "sample_id int, constraint_id string, type string, inv boolean, cap long")
    counts = spark.createDataFrame([(s, 3) for s in range(60)], "sample_id int, n int")
    got = C.sample_constraints(pool, counts, rounds=4).collect()
    uses = {n: sum(r.constraint_id == n for r in got) for n in names}
    assert uses["a"] <= 6 and uses["check_no_list"] <= 18 and uses["b"] > 18
    by: dict = {}
    for r in got:
        by.setdefault(r.sample_id, set()).add(r.constraint_id)
    assert all(len(v) <= 3 for v in by.values()) and sum(len(v) for v in by.values()) == len(got)
    assert not any("check_json_format" in v and v & {"check_no_list", "check_heading_level"} for v in by.values())


def test_parameters_follow_their_space(spark):
    space = {"min": {"type": "int", "range": [10, 20], "step": 5}, "max": {"type": "int", "relative_to": "min", "offset": [1, 3]}, "drop": {"type": "string", "default": "d", "optional": True}}
    df = spark.range(300).select(C.sample_params(F.col("id").cast("string"), F.lit("x"), F.lit(json.dumps(space)), F.lit("{}"), F.lit("T1")).alias("p"))
    got = [r.p for r in df.collect()]
    assert {p["min"] for p in got} == {"10", "15", "20"}
    assert {int(p["max"]) - int(p["min"]) for p in got} == {1, 2, 3}
    assert 0.5 < sum("drop" in p for p in got) / 300 < 0.7


def test_fix_decimals_cuts(spark):
    df = spark.createDataFrame([("# 1.239\nvalue 1.239 and 2.5",)], "t string")
    assert df.select(H.fix_decimals("t", F.lit(2))).first()[0] == "# 1.239\nvalue 1.23and 2.50"


def test_reading_json_lines(spark, tmp_path):
    from verdance.sources import io

    path = tmp_path / "r.jsonl"
    path.write_text('{"id":"a","response":"x"}\n\n{"id":"b","output":"y"}\n[1]\n{"id":"c"}\n')
    rows, bad = io.read_responses(spark, str(path))
    assert sorted((r.id, r.response) for r in rows.collect()) == [("a", "x"), ("b", "y")]
    assert bad.count() == 2


def test_lines_are_numbered_over_files(spark, tmp_path):
    from verdance.sources import io

    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text("".join(f"{i}-{k}\n\n" for k in range(4)))
    got = {r.row: r.value for r in io.numbered_lines(spark, str(tmp_path)).collect()}
    assert len(got) == 24 and [got[n] for n in (1, 2, 9, 23)] == ["0-0", "", "1-0", "2-3"]


def test_primary_ids_are_exclusive_and_keys_unique(spark):
    from verdance.operators import keys as K

    items = spark.createDataFrame([("a", None, 7, 1), (None, None, 7, 2), (None, None, None, 3)], "id string, case_id string, line_number long, row long")
    answers = spark.createDataFrame([("a", 7, "x", 1), (None, 7, "y", 2), ("3", None, "z", 3)], "id string, line_number long, response string, row long")
    found = K.match_response(K.with_item_key(items), K.latest_responses(answers, "row"), row="row")
    assert {r.item_key: r.response for r in found.collect()} == {"a": "x", "7": "y", "3": "z"}
    with pytest.raises(Exception, match="duplicate item key"):
        K.unique_items(K.with_item_key(items.unionByName(items))).collect()


def test_context_ids_stay_apart_past_999(spark):
    raw = spark.createDataFrame([(f"n{i:05d}", "ab"[i % 2], "long enough text") for i in range(1, 1012)], "name string, l2 string, raw string")
    ids = {r.name: r.context_id for r in C.context_pool(raw, least=1).collect()}
    assert len(set(ids.values())) == 1011
    assert (ids["n00007"], ids["n00999"], ids["n01000"], ids["n01011"]) == ("EXT-b-007", "EXT-b-999", "EXT-a-1000", "EXT-b-1011")


def test_parameterize_does_not_force_a_broadcast(spark):
    samples = spark.createDataFrame([("1", "k", "T1", "c", "q", "old", [("F6", "six")])], "sample_id string, case_id string, l1 string, context_text string, query_text string, prompt string, constraints array<struct<id:string,rendered_text:string>>")
    mapping = spark.createDataFrame([("k", "F6", "new")], "key string, constraint_id string, rendered_text string")
    out = C.parameterize_constraints(samples, mapping)
    assert "broadcast" not in out._jdf.queryExecution().analyzed().toString().lower()
    assert [(r.replaced, r.prompt) for r in out.collect()] == [(1, "c\n\nq\n\n" + C.BLOCK_HEAD + "\n（1）new")]
