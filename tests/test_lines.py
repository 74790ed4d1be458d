"""Lines, and the checkers that look at them: right on odd line ends, and worked out once an answer."""

import random

import pytest
from pyspark.sql import functions as F

from verdance.functions import measures as M
from verdance.operators.checkers import check

ODD = "\n\r\t\x0b\x0c\x1c\x1d\x1e\x1f \x85\xa0   ​    　﻿"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_those_of_python(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(ODD + "ab|é中😀") for _ in range(r.randrange(40))) for _ in range(800)] + ["", "\n", "\r\n", "a\r\nb"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    own = lambda t: [x for x in map(str.strip, t.splitlines()) if x]
    for r in df.select("t", M.nonblank(F.col("t")).alias("n"), M.table_lines(F.col("t")).alias("b")).collect():
        assert r.n == (None if r.t is None else own(r.t))
        assert r.b == (None if r.t is None else [x for x in own(r.t) if x[0] == x[-1] == "|"])


@pytest.mark.parametrize("line, text, score", [
    (None, "仅供参考\n1\n2\n3\n4", 1),
    (None, "仅供参考\n1\n2\n3\n4\n5", 0),
    ("a\nb", "x\r\n a \r\n\r\nb", 1),
    ("a\nb", "a b", 0),
    (" b", "a b", 1),
    (" b", "a\n b", 0),
])
def test_risk_lines(spark, line, text, score):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(check(F.col("t"), "risk_disclaimer", {"risk_line": line})).first()[0] == score


def test_risk_terms_are_looked_for_before_lines_and_lines_are_taken_once(spark):
    df = spark.createDataFrame([("x",)], "t string").select(check(F.col("t"), "risk_disclaimer", {}).alias("s"))
    assert plan(df).count("split(") == 1 and "regexp_extract_all" not in plan(df)


def test_table_lines_are_taken_once(spark):
    df = spark.createDataFrame([("| a | b |\n| --- | --- |\n| 1 | 2 |",)], "t string")
    for name, config, wording in (("table_row_count", {"min_rows": 1, "max_rows": 2}, ""), ("table_columns", {}, "A table with B, and a.")):
        found = df.select(check(F.col("t"), name, config, F.lit(wording)).alias("s"))
        assert plan(found).count("coalesce(t#") == plan(df.select(M.table_lines(F.coalesce("t", F.lit(""))).alias("s"))).count("coalesce(t#")
        assert found.first()[0] == 1


def test_wanted_columns_are_read_once(spark):
    """The wording is read for the names in quotes, then by three patterns, once each."""
    df = spark.createDataFrame([("x", "A table with B, and a.")], "t string, w string")
    text = plan(df.select(check(F.col("t"), "table_columns", {}, F.col("w")).alias("s")))
    assert text.count("two-column table of") == 1 and text.count("|'[^']+'") == 1


def test_shared_passages_read_no_text_after_the_candidates(spark, monkeypatch):
    """Members are the same whether hashes are broadcast or shuffled; documents are not split again for the check of the hashes."""
    from verdance.operators import construct as C

    train = spark.createDataFrame([("a", "x\n y\r\nx"), ("b", "y\nz"), (None, "z\n z"), (None, "z"), ("c", None)], "doc_id string, text string")
    test = spark.createDataFrame([("d", "y"), ("e", " z\n\nw"), ("e", "z")], "doc_id string, text string")
    wanted = {("y", "train", "a"), ("y", "train", "b"), ("z", "train", "b"), ("z", "train", None), ("y", "test", "d"), ("z", "test", "e")}
    for most in (C.BROADCAST_HASHES, 0):
        monkeypatch.setattr(C, "BROADCAST_HASHES", most)
        found = C.shared_passages(train, test)
        rows = [(r.passage, r.side, r.doc_id) for r in found.collect()]
        assert set(rows) == wanted and len(rows) == len(wanted)
        assert "Generate" not in plan(found)


def test_passages_of_one_hash_are_told_apart(spark, monkeypatch):
    """With one hash for all passages only the texts decide."""
    from verdance.operators import construct as C

    train = spark.createDataFrame([("a", "x\ny"), ("b", "x")], "doc_id string, text string")
    test = spark.createDataFrame([("c", "y\nz")], "doc_id string, text string")
    monkeypatch.setattr(C.F, "xxhash64", lambda *_: F.lit(7).cast("long"))
    assert sorted((r.passage, r.side, r.doc_id) for r in C.shared_passages(train, test).collect()) == [("y", "test", "c"), ("y", "train", "a")]


def test_shared_passages_are_not_dealt_out_by_passage(spark):
    from verdance.operators import construct as C

    rows = spark.createDataFrame([("a", "x\ny")], "doc_id string, text string")
    found = C.shared_passages(rows, rows)
    assert found.count() == 4 and "Join" not in plan(found)
