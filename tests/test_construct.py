"""Draws under caps, shared passages and other building steps against brute force."""

import hashlib
import math
import os
import random

import pytest

from verdance.operators import construct as C


def bits(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def accepted(rows, counts, seed="draw"):
    """Deferred acceptance in rounds, by hand. rows: (sample, id, weight, cap or None, excludes)."""
    most = {i: max(1, math.floor(cap * len(counts) / 100)) for _, i, _, cap, _ in rows if cap is not None}
    own: dict = {}
    for s, i, w, _, excludes in rows:
        own.setdefault(s, []).append((-math.log((bits(seed, s, i) + 1) / (2.0**48 + 2)) / w, i, excludes))
    held = {s: [] for s in own}
    closed = {s: set() for s in own}
    turn = 0
    while True:
        for s, prefs in own.items():
            for o, i, excludes in sorted(prefs):
                have = {h[2]: h[3] for h in held[s]}
                if len(have) < counts[s] and i not in have and i not in closed[s] and not any(i in e for e in have.values()) and not set(excludes) & set(have):
                    held[s].append((turn, o, i, excludes))
        asking: dict = {}
        for s, own_held in held.items():
            for h in own_held:
                asking.setdefault(h[2], []).append((bits(f"{seed}-cap", h[2], s), str(s)))
        away = {(s, i) for i, who in asking.items() if i in most for _, s in sorted(who)[most[i] :]}
        if not away:
            return sorted((s, h[2], k + 1) for s, own_held in held.items() for k, h in enumerate(sorted(own_held, key=lambda h: h[:3])))
        for s in held:
            closed[s] |= {h[2] for h in held[s] if (str(s), h[2]) in away}
            held[s] = [h for h in held[s] if (str(s), h[2]) not in away]
        turn += 1


def draws(spark, rows, counts, partitions=3):
    pool = spark.createDataFrame([(s, i, "soft", w, cap, excludes) for s, i, w, cap, excludes in rows], "sample_id int, constraint_id string, type string, weight double, cap long, excludes array<string>")
    return sorted(tuple(r) for r in C.sample_constraints(pool.repartition(partitions), spark.createDataFrame(list(counts.items()), "sample_id int, n int")).collect())


def test_no_sample_is_short_while_there_is_room(spark):
    """Weights far apart: A, B and C are full at once, and all others must come to D."""
    rows = [(s, n, w, cap, []) for s in range(100) for n, w, cap in (("A", 1000.0, 10), ("B", 100.0, 10), ("C", 10.0, 10), ("D", 1.0, None))]
    got = draws(spark, rows, dict.fromkeys(range(100), 1))
    assert [sum(i == n for _, i, _ in got) for n in "ABCD"] == [10, 10, 10, 70]
    assert got == accepted(rows, dict.fromkeys(range(100), 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_draws_under_caps_equal_brute_force(spark, seed):
    r = random.Random(seed)
    names = "abcdefgh"
    pool = {n: (10.0 ** r.randint(0, 3), r.choice([5, 10, 20, 40, None]), [x for x in names if x != n and r.random() < 0.15]) for n in names}
    rows = [(s, n, *pool[n]) for s in range(60) for n in names if r.random() < 0.8]
    counts = {s: r.randint(0, 4) for s in range(60)}
    got = draws(spark, rows, counts, 1 + 6 * seed)
    assert got == accepted(rows, counts)
    by = {s: [i for t, i, _ in got if t == s] for s in counts}
    uses = {n: sum(n in v for v in by.values()) for n in names}
    room = {n for n, (_, cap, _) in pool.items() if cap is None or uses[n] < max(1, cap * 60 // 100)}
    assert all(cap is None or uses[n] <= max(1, cap * 60 // 100) for n, (_, cap, _) in pool.items())
    allowed = {(s, n) for s, n, *_ in rows}
    for s, v in by.items():
        assert not any(a in pool[b][2] for a in v for b in v)
        if len(v) < counts[s]:
            # Whatever has room is excluded by something the sample has.
            assert not [n for n in room if (s, n) in allowed and n not in v and not set(pool[n][2]) & set(v) and not any(n in pool[x][2] for x in v)]


def test_draws_without_candidates_or_with_none_wanted(spark):
    rows = [(1, "a", 1.0, 100, []), (1, "a", 1.0, 100, []), (2, "a", 1.0, 1, [])]
    assert draws(spark, rows, {1: 2, 2: 0, 3: 1}) == [(1, "a", 1)]


def test_cut_offs_are_exact_inside_a_bucket(spark):
    """With one bit only there are two buckets, so ranks inside a bucket decide, ties included."""
    r = random.Random(3)
    rows = [(i, r.choice([5, 1 << 46, (1 << 46) + 1, 1 << 47]), str(k)) for i in "xyz" for k in range(40)]
    for most in (1, 7, 25, 39, 40, 41):
        table = spark.createDataFrame(rows, "id string, p long, s string")
        got = {x.id: (x.p, x.s) for x in C.cut_offs(table, spark.createDataFrame([(i, most) for i in "xyz"], "id string, most long"), bits=1).collect()}
        for i in "xyz":
            own = sorted((p, s) for n, p, s in rows if n == i)
            if most >= 40:
                assert i not in got
            else:
                assert [x for x in own if x <= got[i]] == own[:most]


def test_a_footer_in_all_documents_is_one_row(spark):
    train = spark.createDataFrame([(f"a{i}", f"own {i}\n  Page footer \nPage footer\nhere {i % 5}") for i in range(2000)], "doc_id string, text string")
    test = spark.createDataFrame([(f"b{i}", f"Page footer\nother {i}\n\nhere {i % 7}\n") for i in range(2000)] + [("none", None)], "doc_id string, text string")
    got = {r.chars: (r.train_docs, r.test_docs, r.train_first, r.test_first) for r in C.source_disjoint_check(train, test, least=7).collect()}
    assert got == {11: (2000, 2000, "a0", "b0")}
    members = C.shared_passages(train, test, least=7)
    assert members.count() == 4000 and {r.side: r["count"] for r in members.groupBy("side").count().collect()} == {"train": 2000, "test": 2000}
    assert C.source_disjoint_check(train, test).count() == 6
    assert C.source_disjoint_check(train, test.where("doc_id = 'none'")).count() == 0


def test_context_reuse_of_text_ids(spark):
    from verdance.operators.reports import context_reuse

    rows = [("i", "DOC-B"), ("i", "DOC-A"), ("j", "DOC-A"), ("j", "DOC-B"), ("k", "DOC-C"), ("k", None)]
    got = context_reuse(spark.createDataFrame(rows, "item string, document string"), "item", "document").first()
    assert tuple(got) == (3, 2, "DOC-A", 2)
    assert tuple(context_reuse(spark.createDataFrame([], "item string, document string"), "item", "document").first()) == (0, 0, None, None)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_all_documents_are_checked_against_the_benchmark(spark):
    """Every pair of a document and a benchmark item with a line in common is a link of the query, and the documents' own split is there, too."""
    import duckdb

    from verdance.plans.data import ORACLES, QUERIES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    lines = "SELECT DISTINCT {0}, trim(unnest(string_split(text, chr(10)))) AS p FROM {1}"
    pairs = con.execute(f"SELECT 'DOC-' || doc_id, 'ITEM-' || item_id, md5(p) FROM ({lines.format('doc_id', 'documents')}) JOIN ({lines.format('item_id', 'benchmark')}) USING (p) WHERE p <> ''").fetchall()
    rows = [r.asDict() for r in QUERIES["source_disjoint_check"](spark, sf).collect()]
    sides = {side: [(r["doc_id"], r["passage_id"]) for r in rows if r["scope"] == "benchmark" and r["side"] == side] for side in ("train", "test")}
    assert len(pairs) > 0 and sorted(pairs) == sorted((a, b, p) for a, p in sides["train"] for b, q in sides["test"] if p == q)
    cursor = con.execute(ORACLES["source_disjoint_check"])
    names = [d[0] for d in cursor.description]
    assert sorted(tuple(r[n] for n in names) for r in rows) == sorted(cursor.fetchall())
    assert {r["scope"] for r in rows} == {"benchmark", "split"}
