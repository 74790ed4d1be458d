"""Exact copies, phrases and the repair of conversations against brute force, with edge cases."""

import hashlib
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdance.llm import exact, phrases, repair

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
SPACES = re.compile(r"[\x20\x09-\x0D]+")


# Exact copies


def exact_by_hand(rows):
    """(doc_id, text) -> doc_id, keep_id, group_size, text_sha256 for each row, and the number of rows that stay."""
    groups: dict = {}
    for i, t in rows:
        groups.setdefault(SPACES.sub(" ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return out, len(groups)


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize(("partitions", "rounds", "run_rows"), [(1, 3, 1 << 18), (7, 1, 5), (16, 2, 3), (5, 3, 1)])
def test_exact_equals_brute_force(spark, partitions, rounds, run_rows):
    r = random.Random(partitions)
    texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 4))) + r.choice(["", " ", "\n\t"]) for _ in range(300)]
    texts += ["hot text"] * 150 + [None, "", "\x0b\x0c", "x" * 100_000, "x" * 100_000, " one", "one", "ä b", "ä\tb", "ä b"]
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(3, "same id"), (3, "same id"), (3, "other"), (None, "hot text"), (None, "lost"), (None, "lost")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions)
    got = exact.exact_duplicates(docs, rounds=rounds, run_rows=run_rows).collect()
    want, kept = exact_by_hand(rows)
    assert ordered((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == ordered(want)
    # One row of each group stays, and it is the one of the smallest id.
    stays = [g for g in got if g.kept]
    assert len(stays) == len({g.text_sha256 for g in stays}) == kept
    assert all(g.doc_id == g.keep_id for g in stays)


def test_exact_ids_of_any_type_clashing_columns_empty(spark):
    docs = spark.createDataFrame([("b", "t  x", 1, 2), ("a", "t x", 3, 4), ("c", "u", 5, 6)], "doc_id string, text string, part int, key int")
    got = {r.doc_id: r.keep_id for r in exact.exact_duplicates(docs).collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
    assert sorted(map(tuple, exact.without_copies(docs).collect())) == [("a", "t x", 3, 4), ("c", "u", 5, 6)]
    assert exact.exact_duplicates(docs.where("false")).collect() == []
    twice = spark.createDataFrame([(1, "t"), (1, "t"), (2, "t"), (None, "z")], "doc_id long, text string")
    assert sorted(map(str, exact.without_copies(twice).collect())) == sorted(["Row(doc_id=1, text='t')", "Row(doc_id=None, text='z')"])


def test_runs_merge_to_the_smallest(spark):
    r = random.Random(5)
    runs, want = [], {}
    for _ in range(9):
        own = np.empty(40, exact.RUN)
        own["key"] = [bytes([r.randint(0, 20)]) + b"\0" * 47 for _ in range(40)]
        own["lost"], own["n"] = [r.random() < 0.2 for _ in range(40)], 1
        own["id"], own["tie"] = [r.randint(0, 9) for _ in range(40)], [r.randint(0, 9**9) for _ in range(40)]
        for e in own:
            best, n = want.get(e["key"], ((2, 0, 0), 0))
            want[e["key"]] = (min(best, (e["lost"], e["id"], e["tie"])), n + 1)
        runs.append(exact.sorted_run(own))
    got = exact.merged(runs)
    assert list(got["key"]) == sorted(want)
    assert {e["key"]: ((e["lost"], e["id"], e["tie"]), e["n"]) for e in got} == want
    assert len(exact.merged([])) == 0


@needs_tables
def test_exact_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = exact.op11_exact_dedup(spark, SF)
    cursor = con.execute(exact.ORACLE)
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(cursor.fetchall())


# Phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def phrase_rows(seed, n=120):
    r = random.Random(seed)
    fixed = ["New York City", "in the", "a b c d e f", "der der der", "ça  va\tbien"]
    words = [f"w{i}" for i in range(12)] + ["of", "the"] * 4
    out = []
    for i in range(n):
        parts = [r.choice(fixed) if r.random() < 0.3 else r.choice(words) for _ in range(r.randint(0, 30))]
        out.append((i, "".join(p + r.choice([" ", " ", " ", "  ", ", ", ".", "\n", "\x0b", "\t"]) for p in parts), r.choice(["en", "de", None])))
    return [*out, (None, None, "en"), (n, "", None), (n, " ".join(["long text"] * 3000), "fr"), (n, ".,;", "xx")]


@pytest.mark.parametrize(("shards", "slots"), [(1, 1 << 16), (3, 1 << 16), (4, 4)])
def test_phrases_equal_brute_force(spark, monkeypatch, shards, slots):
    # With four slots all phrases share slots: less is pruned, nothing may change.
    monkeypatch.setattr(phrases, "LEAST_SLOTS", slots)
    monkeypatch.setattr(phrases, "MOST_SLOTS", slots)
    rows = phrase_rows(shards)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = phrases.collocations(docs, least=8, top=40, shards=shards).select(*COLUMNS).collect()
    want = phrases.brute_force([(lang, text) for _, text, lang in rows], least=8, top=40)
    assert sorted(map(tuple, got)) == sorted(want)
    assert any(len(p[2].split()) == 5 for p in want)


def test_phrases_edges(spark):
    docs = spark.createDataFrame([(1, "a b", "en", 5)], "doc_id long, text string, lang string, n long")
    assert phrases.collocations(docs.where("false")).collect() == []
    assert phrases.collocations(docs).collect() == []
    assert phrases.collocations(docs.withColumn("text", F.lit(None).cast("string"))).collect() == []
    with pytest.raises(ValueError):
        phrases.frequent_phrases(docs, shards=60)


@needs_tables
def test_phrase_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cursor = con.execute(phrases.ORACLE)
    names = [d[0] for d in cursor.description]
    assert sorted(map(tuple, phrases.op12_collocations(spark, SF).select(*names).collect())) == sorted(cursor.fetchall())


def test_long_words_that_trade_bytes_are_different_words(spark):
    """Words of more than 4,096 bytes whose bytes change places a period of the hash apart."""
    one, two = ("".join((a, "x" * 4095, b, "y" * 9)) for a, b in ("ab", "ba"))
    rows = [("en", f"{one} k")] * 6 + [("en", f"{two} k")] * 9 + [("de", "z" * 20_000 + " k")] * 5
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "doc_id long, lang string, text string").repartition(3)
    got = phrases.collocations(docs, least=5).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(phrases.brute_force(rows, least=5)) and len(got) == 3


# Conversations


def by_conversation(rows, damage):
    out: dict = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 99
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        own += [] if kind == 0 else [(turn, role, text)] * (2 if kind == 3 else 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {c: sorted(own, key=key) for c, own in out.items()}


def random_rows(seed, conversations=60, giant=700):
    r = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "What?", "Go on!  ", "same.", "same.", "éa.", None]
    roles = ["user", "assistant", "system", "tool", "", None, "sys", "u"]
    out = []
    for c in range(conversations):
        for t in range(r.randint(1, 9)):
            role = r.choice(roles) if r.random() < 0.3 else ("user", "assistant")[t % 2]
            out.append((c, r.choice([t, t, t, t + 3, None]), role, r.choice(texts) if r.random() < 0.5 else f"text {c} {t}."))
    out += [(1000, t, ("user", "assistant")[t % 2] if r.random() < 0.8 else r.choice(roles), r.choice(texts) if r.random() < 0.3 else f"text {t}{r.choice('.. ')}") for t in range(giant)]
    return [*out, (None, 1, "user", "A."), (None, None, "assistant", "B.")]


@pytest.mark.parametrize(("ranges", "damage"), [(1, True), (4, True), (40, True), (40, False)])
def test_repair_equals_brute_force(spark, ranges, damage):
    rows = random_rows(ranges)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = repair.repair_conversations(repair.damaged(table), present=F.col("present")) if damage else repair.repair_conversations(table)
        got = {r.conv_id: tuple(r)[1:] for r in got.collect()}
        want = {c: repair.brute_force(own) for c, own in by_conversation(rows, damage).items()}
        assert got == want
        # The rows themselves, in order, make the digest.
        if not damage:
            lines: dict = {}
            for x in sorted(repair.repaired_rows(table).collect(), key=lambda x: (x.conv_id is not None, x.conv_id, x.position)):
                own = lines.setdefault(x.conv_id, [])
                assert x.position == len(own)
                own.append(f"{x.role}:{x.text}")
            assert {c: hashlib.sha256("\n".join(lines.get(c, [])).encode()).hexdigest() for c in want} == {c: v[-1] for c, v in want.items()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_repair_edges(spark):
    schema = "conv_id string, turn int, role string, text string, part int, seq int"
    assert repair.repair_conversations(spark.createDataFrame([], schema)).collect() == []
    rows = [("x", 5, "user", "Hi.", 1, 1), ("x", 2, "assistant", "Hello.", 1, 1), ("y", None, "system", " ", 1, 1), ("z", 1, "system", "S.", 0, 0)]
    got = {r.conv_id: tuple(r)[1:] for r in repair.repair_conversations(spark.createDataFrame(rows, schema)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    # Re-roling both rows is cheaper than deleting both, and as cheap as nothing else.
    assert got["x"] == (2, 0, 0, 0, 0, 2, "RR", sha("user:Hello.\nassistant:Hi."))
    assert got["y"] == (0, 1, 0, 0, 0, 2, "D", sha(""))
    assert got["z"] == (0, 0, 0, 0, 0, 2, "D", sha(""))
    dropped = repair.repair_conversations(spark.createDataFrame(rows, schema), present=F.col("conv_id") != "z").where("conv_id = 'z'").first()
    assert tuple(dropped) == ("z", 0, 0, 0, 0, 0, 0, "", sha(""))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 15), min_size=1, max_size=40), st.integers(1, 12))
def test_fix_up_passes_reach_the_sequential_search(codes, length):
    """Chunks from speculative vectors, fixed up from the right, give the vectors and the cost of one pass over all rows."""
    codes = bytes(codes)
    whole, cost, edits = repair.backward(codes, repair.END)
    chunks = [codes[i : i + length] for i in range(0, len(codes), length)]
    ends = [repair.SPECULATIVE] * len(chunks)
    found = [repair.backward(c, repair.SPECULATIVE)[:2] for c in chunks]
    for _ in range(len(chunks) + 1):
        wanted = [found[k + 1][0] if k + 1 < len(chunks) else repair.END for k in range(len(chunks))]
        if wanted == ends:
            break
        found = [repair.fixed_up(c, e, w, *f)[:2] if e != w else f for c, e, w, f in zip(chunks, ends, wanted, found, strict=True)]
        ends = wanted
    assert wanted == ends
    assert found[0][0] == whole
    assert sum(f[1] for f in found) == cost
    state, letters = repair.START, []
    for k, (c, e) in enumerate(zip(chunks, ends, strict=True)):
        own, state = repair.traced(repair.backward(c, e)[2], state, k == len(chunks) - 1)
        letters += own
    assert letters == repair.traced(edits, repair.START, True)[0]


@needs_tables
def test_repair_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in repair.op13_repair_conversations(spark, SF).collect()}
    assert got == {c: repair.brute_force(own) for c, own in by_conversation(rows, True).items()}
