"""Diagnoses: the words of each checker, and measures worked out once."""

import pytest
from pyspark.sql import functions as F

from verdance.functions import measures as M
from verdance.operators.construct import diagnose_failure
from verdance.operators.settings import as_map

TOLD = [
    ("check_word_range", {"min_words": 3, "max_words": 4}, "中 a", "2 words, wanted 3 to 4: add 1"),
    ("check_word_range", {"min_words": 1, "max_words": 2}, "中文 a", "3 words, wanted 1 to 2: cut 1"),
    ("check_word_range", {"min_words": 1, "max_words": 3}, "中文 a", None),
    ("check_word_range", {"min_words": 1}, None, "0 words, wanted 1 to 99999: add 1"),
    ("word_limit", {"max_words": 1}, "a b", "2 words, at most 1: cut 1"),
    ("check_paragraph_count", {"max_count": 1}, "a\n\nb", "2 paragraphs, wanted 1 to 1: join some"),
    ("check_paragraph_count", {"min_count": 3}, "a\n\nb", "2 paragraphs, wanted 3 to any: split some"),
    ("check_first_last_line", {"first_line": "x", "last_line": "b"}, " \r\n a\nb\n", "first line must hold x, is a"),
    ("check_first_last_line", {"first_line": "x", "last_line": "y"}, "a  b 　", "first line must hold x, is a; last line must hold y, is b"),
    ("check_first_last_line", {"last_line": "b"}, "ab", None),
    ("check_first_last_line", {"last_line": "b"}, None, "last line must hold b, is "),
    ("check_first_word", {"word": "A "}, "　**A ", "must open with A , opens with **A"),
    ("check_first_word", {"word": "A"}, "## A", None),
    ("check_decimal_places", {"places": 1}, "1.25 and 2.5", "numbers must have 1 places: 1.25"),
    ("check_heading_depth", {}, "# a\r## b\n x # c\n#d\n\t# e", "2 heading levels, wanted at least 2"),
    ("check_checkbox_format", {}, "- [x] a\n[ ] b\n* [ ]", "2 checkboxes, wanted at least 1"),
    ("check_checkbox_format", {}, "none", "0 checkboxes, wanted at least 1"),
]


def test_what_is_told(spark):
    df = spark.createDataFrame([(i, t) for i, (_, _, t, _) in enumerate(TOLD)], "i int, t string")
    columns = [diagnose_failure(F.col("t"), name, as_map(config)).alias(f"c{i}") for i, (name, config, _, _) in enumerate(TOLD)]
    rows = {r.i: r for r in df.select("i", *columns).collect()}
    assert [rows[i][f"c{i}"] for i in range(len(TOLD))] == [x[3] for x in TOLD]


@pytest.mark.parametrize("name, config, part", [
    ("check_word_range", {"min_words": 3, "max_words": 4}, "[A-Za-z]++"),
    ("check_first_last_line", {"first_line": "x", "last_line": "y"}, "split("),
    ("check_paragraph_count", {"min_count": 3, "max_count": 4}, "split("),
])
def test_measures_are_worked_out_once(spark, name, config, part):
    df = spark.createDataFrame([("a",)], "t string").select(diagnose_failure(F.col("t"), name, as_map(config)).alias("d"))
    # The first and the last line have lines of their own.
    assert df._jdf.queryExecution().optimizedPlan().toString().count(part) == (2 if "line" in name else 1)


def test_mixed_words_of_other_alphabets(spark):
    rows = [("é ab", 1), ("中a文 b", 4), ("plain text", 2), ("", 0), ("ﬁ", 0)]
    df = spark.createDataFrame([r[:1] for r in rows], "t string")
    assert [r[0] for r in df.select(M.mixed_word_count(F.col("t"))).collect()] == [n for _, n in rows]
