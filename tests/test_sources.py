"""Reading with a report, appending that survives lost jobs, repair in rounds, balanced excerpts."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.operators import construct as C
from verdance.sources import io

SCHEMA = "model string, case_id long, text string"


def test_items_are_counted_in_the_reading_pass(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id":"x","query":"q"}\n\n[1]\n{"id":"x"}\n   \n{"line":9}\n')
    (tmp_path / "b.jsonl").write_text('{"query":"no key"}\nbad\n')
    items, bad, report = io.read_items_counted(spark, str(tmp_path))
    assert (report.lines, report.blank, report.bad, report.duplicate_keys, report.first_duplicates) == (8, 2, 2, 1, ("x",))
    assert sorted((r.row, r.item_key) for r in items.collect()) == [(1, "x"), (4, "x"), (6, "9"), (7, "7")]
    assert sorted(r.value for r in bad.collect()) == ["[1]", "bad"]
    with pytest.raises(ValueError, match="2 bad lines, .* x"):
        io.read_items_counted(spark, str(tmp_path), strict=True)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "empty.jsonl").write_text("")
    items, bad, report = io.read_items_counted(spark, str(tmp_path / "c"), strict=True)
    assert (items.count(), bad.count(), report.lines) == (0, 0, 0)


def rows_of(spark, path):
    return sorted((r.model, r.case_id, r.text, r.batch) for r in io.read_appended(spark, path, SCHEMA).collect())


def test_append_survives_a_job_lost_between_write_and_commit(spark, tmp_path):
    path = str(tmp_path / "out")
    work = spark.createDataFrame([("m", i, f"t{i}") for i in range(8)], SCHEMA)
    assert rows_of(spark, path) == []
    io.append_batch(work.where("case_id < 3"), path, "1", ["model", "case_id"])

    # All tasks but one write their files, then the job is lost before it commits.
    dies = F.udf(lambda i: 1 // (i - 5) and "t", "string")
    with pytest.raises(Exception, match="ZeroDivision"):
        io.append_batch(work.where("case_id BETWEEN 3 AND 5").repartition(3, "case_id").withColumn("text", dies("case_id")), path, "2", ["model", "case_id"])
    # Files of a run whose driver was lost lie in a folder that nobody reads.
    lost = tmp_path / "out" / ".spark-staging-lost" / "batch=2"
    lost.mkdir(parents=True)
    committed = next(p for p in (tmp_path / "out" / "batch=1").iterdir() if p.suffix == ".parquet")
    (lost / committed.name).write_bytes(committed.read_bytes())
    assert [r[1] for r in rows_of(spark, path)] == [0, 1, 2]

    todo = io.resume(work, path, SCHEMA, ["model", "case_id"])
    assert sorted(r.case_id for r in todo.collect()) == [3, 4, 5, 6, 7]
    for _ in range(2):  # once more, as after a commit that nobody heard of
        io.append_batch(work.where("case_id BETWEEN 2 AND 5").unionByName(work.where("case_id = 4")), path, "2", ["model", "case_id"])
        assert [(r[1], r[3]) for r in rows_of(spark, path)] == [(0, "1"), (1, "1"), (2, "1"), (3, "2"), (4, "2"), (5, "2")]
    io.append_batch(work.where("false"), path, "2", ["model", "case_id"])
    assert len(rows_of(spark, path)) == 6


def test_repairs_go_in_rounds_and_only_changed_answers_are_checked_again(spark, tmp_path):
    answers = spark.createDataFrame([(str(i), "good word" if i < 3 else "bad" if i < 6 else None) for i in range(8)], "item_id string, response string")
    rules = spark.createDataFrame([(str(i), k, "rule", n, s) for i in range(7) for k, (n, s) in enumerate([("min_words", {"min": "2"}), ("keyword_presence", {"keywords": '["word"]'})])], "item_id string, constraint_index long, check_type string, checker string, settings map<string,string>")
    asked = []

    def repair(tasks):
        asked.append(sorted((r.item_id, len(r.failing)) for r in tasks.collect()))
        better = F.when(F.col("item_id") == "5", F.col("response")).when(F.col("response") == "bad", "bad bad").otherwise("a word")
        return tasks.select("item_id", better.alias("text"))

    got = {r.item_id: (r.round, r.response, r.checks, r.passed, r.all_pass) for r in C.repair_rounds(answers, rules, repair, str(tmp_path / "r"), rounds=3).collect()}
    assert asked == [[("3", 2), ("4", 2), ("5", 2), ("6", 2)], [("3", 1), ("4", 1), ("5", 2)], [("5", 2)]]
    assert got["0"] == (0, "good word", 2, 2, True) and got["7"] == (0, "", 0, 0, True)
    assert got["3"] == got["4"] == (2, "a word", 2, 2, True)
    assert got["5"] == (0, "bad", 2, 0, False) and got["6"] == (1, "a word", 2, 2, True)
    written = {n: spark.read.parquet(str(tmp_path / "r" / f"round={n}")).count() for n in range(3)}
    assert written == {0: 8, 1: 3, 2: 2} and not os.path.exists(tmp_path / "r" / "round=3")


def all_cuts(sizes, most):
    n = len(sizes)
    for k in range(n):
        for inner in itertools.combinations(range(1, n), k):
            ends = [*inner, n]
            pieces = [sizes[a:b] for a, b in zip([0, *ends], ends)]
            if all(sum(p) <= most or len(p) == 1 for p in pieces):
                yield ends, [sum(p) for p in pieces]


def test_balanced_cuts_equal_brute_force():
    r = random.Random(2)
    for _ in range(300):
        sizes = [r.choice([1, 2, 3, 5, 8, 13, 30]) for _ in range(r.randint(1, 9))]
        least, most = r.choice([(5, 9), (6, 20), (1, 3), (10, 11)])
        score = lambda found: (sum(not least <= n <= most for n in found[1]), sum(max(0, least - n) ** 2 for n in found[1]), len(found[1]))  # noqa: B023, E731
        best = min(map(score, all_cuts(sizes, most)))
        ends = H.balanced_cuts(sizes, least, most)
        assert score((ends, [sum(sizes[a:b]) for a, b in zip([0, *ends], ends)])) == best
    assert H.balanced_cuts([], 1, 2) == []


def test_balanced_excerpts_leave_no_short_end(spark):
    text = "\n\n".join(["a b c d e"] * 7)
    docs = spark.createDataFrame([("x", text), ("y", None), ("z", " \n "), ("w", "one")], "doc_id string, text string")
    greedy = [r.tokens for r in C.excerpt_chunks(docs, least=10, most=17).where("doc_id = 'x'").orderBy("chunk").collect()]
    got = C.balanced_excerpts(docs, least=10, most=17).orderBy("doc_id", "chunk").collect()
    assert greedy == [10, 10, 10, 5]
    assert [(r.doc_id, r.tokens) for r in got] == [("w", 3 - 2), ("x", 10), ("x", 10), ("x", 15)]
    assert "\n".join(r.text for r in got if r.doc_id == "x") == text.replace("\n\n", "\n")


def test_intermediate_tables_leave_no_shuffle_files(spark):
    import time

    from verdance.sources import shared

    manager = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def names():
        files = manager.getAllFiles()
        return {f.getName() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}

    before = names()
    out = shared.cut(spark.range(1000).repartition(3, "id").groupBy("id").count())
    assert out.count() == 1000
    for _ in range(50):
        left = {n for n in names() - before if n.endswith(".data")}
        if len(left) <= 1:
            break
        time.sleep(0.1)
    # What is left at most is from the count.
    assert len({n.split("_")[1] for n in left}) <= 1, left
    assert spark.conf.get(shared.SHUFFLES_GO) == "false"
