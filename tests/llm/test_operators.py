"""The training-data operators on small tables: brute force, edge cases, invariants."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdance.llm import bytesops, decontaminate, graph, lm, mixing, near, pii, quality, rules, suffixes, tokens, webpages

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean"


def documents(spark, texts, ids=None, sources=None):
    ids = ids or list(range(len(texts)))
    sources = sources or [f"s{i % 3}" for i in range(len(texts))]
    rows = [(i, t, "en", s, len(t or ""), -1, False) for i, t, s in zip(ids, texts, sources, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


EDGES = [None, "", " \n\t ", "word", "word", "x" * 5000, "a b c d e " * 300, "ÄÖ ß 中文 \U0001f600 end", "one two three four five six seven eight nine ten eleven"]


def prose(seed, n, words=400):
    r = random.Random(seed)
    return [" ".join(f"w{r.randint(0, 3000)}" for _ in range(words)) for _ in range(n)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# Mixing


def test_mix_targets_and_taken(spark):
    texts = prose(1, 300, 30) + [None, ""]
    sources = ["a"] * 10 + ["b"] * 200 + ["c"] * 90 + [None, None]
    got = mixing.mix(documents(spark, texts, sources=sources)).collect()
    by = {}
    for r in got:
        assert r.taken <= 3 * r.size
        s = by.setdefault(r.source, [0, r.target, r.source_size])
        s[0] += r.taken
    assert set(by) == {"a", "b", "c", None}
    total = sum(s[2] for s in by.values())
    assert by["a"][1] == 3 * by["a"][2]
    assert abs(sum(s[1] for s in by.values()) - total) < 1e-6
    for taken, target, _ in by.values():
        assert abs(taken - target) <= 30
    again = mixing.mix(documents(spark, texts, sources=sources).repartition(5)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mix_equals_sql(spark):
    texts = prose(2, 60, 20) + EDGES
    docs = documents(spark, texts)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    cursor = con.execute(mixing.ORACLE)
    names = [d[0] for d in cursor.description]
    want = sorted(tuple(r) for r in cursor.fetchall())
    assert sorted(tuple(r) for r in mixing.mix(docs).select(*names).collect()) == want


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark, prose(3, 20, 10))
    out = mixing.mixed_documents(docs)
    assert out.columns == [*docs.columns, "epoch"]
    taken = {r.doc_id: r.repeats for r in mixing.mix(docs).collect()}
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {i: n for i, n in taken.items() if n}


# Language model


def test_lm_base_and_probabilities(spark):
    texts = prose(4, 80, 60) + EDGES
    docs = documents(spark, texts)
    got = {r.doc_id: r for r in lm.score_documents(docs, bucket_bytes=4000).collect()}
    assert len(got) == len(texts)
    assert got[80].n_tokens == 1
    held = sum(r.held_out for r in got.values())
    assert 0 < held < len(texts)
    train = [r for r in got.values() if not r.held_out]
    assert sum(r.n_tokens for r in train) == train[0].train_tokens
    assert all(r.score <= 0 for r in got.values())
    bits = lambda rows: -sum(r.score for r in rows) / sum(r.n_tokens for r in rows)
    base = -sum(r.base_score for r in train) / sum(r.n_tokens for r in train)
    assert bits(train) < base


def test_lm_base_equals_brute_force(spark):
    import math
    import re
    import zlib

    texts = prose(21, 60, 40) + EDGES
    got = {r.doc_id: r for r in lm.score_documents(documents(spark, texts), bucket_bytes=3000).collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) + [None]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    counts: dict = {}
    for i, t in enumerate(texts):
        for w in [] if held[i] else split(t):
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        w = split(t)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(w), sum(x in counts for x in w), n)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts.get(x, 0) + 1) / (n + v + 1)) for x in w), rel=1e-9)


def test_ids_of_any_type(spark):
    texts = [*prose(22, 1, 40) * 3, "other text"]
    docs = documents(spark, texts).withColumn("doc_id", F.concat(F.lit("d"), (9 - F.col("doc_id")).cast("string")))
    near_ = {r.doc_id: (r.component_id, r.kept) for r in near.near_duplicates(docs).collect()}
    assert near_ == {"d9": ("d7", False), "d8": ("d7", False), "d7": ("d7", True), "d6": ("d6", True)}
    assert {r.doc_id: r.n_removed > 0 for r in suffixes.repeated_passages(docs).collect()} == {"d9": True, "d8": True, "d7": False, "d6": False}
    assert {r.doc_id for r in lm.score_documents(docs).collect()} == {"d6", "d7", "d8", "d9"}


def test_names_that_clash_do_not_crash(spark):
    docs = documents(spark, [*prose(23, 4, 30), None, ""])
    for n in ("_of", "_repeats", "_row", "_id", "_text", "hits", "spans", "base", "_host", "p_doc", "rank", "tag"):
        docs = docs.withColumn(n, F.lit("x"))
    docs = docs.withColumn("epoch", F.lit(0))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for out in (mixing.mixed_documents(docs), near.without_near_duplicates(docs), quality.good_documents(docs, labels), decontaminate.clean_documents(docs, items), pii.redact(docs)):
        assert set(out.columns) == set(docs.columns)
        assert {r["_of"] for r in out.collect()} <= {"x"}


def test_lm_seating_bounds():
    rng = np.random.default_rng(0)
    customers = np.array([0, 1, 2, 31, 32, 33, 500, 100_000])
    few = lm.seat(customers, np.full(8, 1e-9), 0.5, rng)
    many = lm.seat(customers, np.full(8, 1e9), 0.5, rng)
    assert few.tolist() == [0, 1, 1, 1, 1, 1, 1, 1]
    assert many[:7].tolist() == customers[:7].tolist() and many[7] > 99_000


def test_lm_parent_sums_to_one():
    shape = lm.Shape(np.zeros(lm.CONTEXTS), {"n": 10, "v": 3, "ones": 1, "twos": 1, "up_ones": 1, "up_twos": 1})
    customers, tables = np.array([5, 2, 1]), np.array([2, 1, 1])
    shape.sweeps.append((np.zeros(lm.CONTEXTS), 8.0, 4.0))
    known = shape.parent(customers, tables, 0).sum()
    assert known + shape.parent(np.zeros(1), np.zeros(1), 0)[0] == pytest.approx(1)


def test_lm_contexts_are_whole_words(spark):
    """Each previous word has a restaurant of its own, however many there are: 20,000 words decide what follows them, and all are told apart."""
    import zlib

    n = 20_000
    # Word k is followed by x or by y, by its parity; each is seen often enough to be sure.
    texts = [" ".join(f"w{k} {'xy'[k % 2]} w{k} {'xy'[k % 2]} w{k} {'xy'[k % 2]}" for k in range(i * 100, i * 100 + 100)) for i in range(n // 100)]
    ids = [i for i in range(10_000) if zlib.crc32(str(i).encode()) % 7 != 2][: len(texts)]
    asked = [i for i in range(10_000, 30_000) if zlib.crc32(str(i).encode()) % 7 == 2][:400]
    words = list(range(0, n, 100)) + list(range(1, n, 100))
    docs = documents(spark, texts + [f"w{k} {'xy'[i]}" for i in (0, 1) for k in words[::2]], ids=ids + asked)
    got = {r.doc_id: r.score for r in lm.score_documents(docs, bucket_bytes=200_000).collect()}
    # What follows x and y differs, but by the same for all words.
    gaps = {k: got[a] - got[b] for k, a, b in zip(words[::2], asked[:200], asked[200:], strict=True)}
    even, odd = ([g for k, g in gaps.items() if k % 2 == r] for r in (0, 1))
    # A word that shared its restaurant with one of the other parity would give both the same chance.
    assert min(even) - max(odd) > 1, (sorted(even)[:5], sorted(odd)[-5:])


def test_lm_scores_do_not_hang_on_what_is_hot(spark, monkeypatch):
    """Where pairs are counted and scored, and how contexts are written, changes only the draws."""
    docs = documents(spark, prose(33, 60, 60) + EDGES)
    runs = []
    for hot, pairs, contexts in ((1_024, 1 << 16, 65_535), (2, 1, 2), (500, 300, 16)):
        monkeypatch.setattr(lm, "HOT", hot)
        monkeypatch.setattr(lm, "HOT_PAIRS", pairs)
        monkeypatch.setattr(lm, "CONTEXTS", contexts)
        runs.append({r.doc_id: r for r in lm.score_documents(docs, bucket_bytes=3_000).collect()})
    for other in runs[1:]:
        assert {i: tuple(r)[:5] for i, r in other.items()} == {i: tuple(r)[:5] for i, r in runs[0].items()}
        for i, r in runs[0].items():
            assert other[i].base_score == pytest.approx(r.base_score, rel=1e-9)
            assert other[i].score == pytest.approx(r.score, abs=0.15 * r.n_tokens)


def test_lm_repeated_rows_and_null_ids(spark):
    docs = documents(spark, ["a b", "a b", "c", "d e", "d e"], ids=[1, 1, 1, None, None])
    got = sorted(str(tuple(r)[:4]) for r in lm.score_documents(docs).collect())
    assert len(got) == 5


# Quality


def test_quality_accuracy_and_edges(spark):
    good, bad = prose(5, 150, 60), [" ".join(w + "###" for w in t.split()) for t in prose(6, 60, 60)]
    toxic = [t.replace(" ", " idiot ", 5) for t in prose(7, 60, 60)]
    texts = good + bad + toxic + EDGES
    docs = documents(spark, texts)
    labels = [(i, 1 if i < 150 or i >= 210 else 0, int(i >= 210)) for i in range(0, 270, 2)] + [(1, None, 0), (None, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.id: r.kept for r in quality.classify(docs, labels).select(F.col("_row.doc_id").alias("id"), "kept").collect()}
    assert len(got) == len(texts)
    odd = [i for i in range(270) if i % 2]
    right = sum(got[i] == (i < 150) for i in odd)
    assert right >= 0.97 * len(odd)
    assert quality.good_documents(docs, labels).columns == docs.columns


def test_quality_without_labels_keeps_everything(spark):
    docs = documents(spark, EDGES)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.good_documents(docs, labels).count() == len(EDGES)


def test_site_posteriors_equal_brute_force(spark):
    r = random.Random(5)
    rows = [(h, p, round(min(1.0, max(0.0, r.gauss(m, 0.1))), 3)) for h, m in (("h1", 0.9), ("h2", 0.3), (None, 0.6)) for p in ("x", "y", None) for _ in range(r.randint(1, 40))]
    rows += [("h3", "p", 0.0), ("h4", None, 1.0)]
    df = spark.createDataFrame(rows, "_host string, _path string, p_doc double")
    sites, mean, n = quality.site_posteriors(df)
    assert mean == pytest.approx(sum(x[2] for x in rows) / len(rows)) and n == 11

    def groups(width):
        out = {}
        for row in rows:
            out.setdefault(row[:width], []).append(row[2])
        return out

    def strength(found, parent):
        many = {k: v for k, v in found.items() if len(v) > 1}
        between = np.mean([(np.mean(v) - parent(k)) ** 2 - np.var(v) / len(v) for k, v in many.items()])
        spread = np.mean([parent(k) * (1 - parent(k)) for k in many])
        return 1e6 if between <= 0 else min(1e6, max(1.0, spread / between - 1))

    hosts, paths = groups(1), groups(2)
    k = strength(hosts, lambda _: mean)
    whole = {h: (k * mean + sum(v)) / (k + len(v)) for h, v in hosts.items()}
    kp = strength(paths, lambda key: whole[key[:1]])
    joined = df.join(sites.withColumnsRenamed({"_host": "h", "_path": "p"}), F.col("_host").eqNullSafe(F.col("h")) & F.col("_path").eqNullSafe(F.col("p")))
    host, path = quality.posterior_means(F.col("p_doc"), mean)
    got = joined.select("_host", "_path", "p_doc", host.alias("a"), path.alias("b")).collect()
    assert len(got) == len(rows)
    for x in got:
        h, p = hosts[(x._host,)], paths[(x._host, x._path)]
        a = (k * mean + sum(h) - x.p_doc) / (k + len(h) - 1)
        assert x.a == pytest.approx(a) and x.b == pytest.approx((kp * a + sum(p) - x.p_doc) / (kp + len(p) - 1))
        if x._host in ("h3", "h4"):
            assert x.a == pytest.approx(mean)


# HTML


PAGE = """<html><head><title>T</title><script>var a = "</p>";</script></head><body><header>Site</header><nav><a href=x>A</a></nav>
<div class="cookie-notice">We use cookies on the site and they are good for you.</div><article><h1>Head &amp; line</h1><p>First <b>bold</b>
 text.<p>Second&nbsp;one</p><div class="comments"><p>Nice!</p></div><aside>More</aside></article><form><p>Search</p></form><footer>&copy; X</footer></body>"""


def test_html_article():
    assert webpages.extract(PAGE) == "Head & line\nFirst bold text.\nSecond one"


def test_html_without_article():
    main = "It is the case that the men of the town were there and that they had been with us for a long time, and so it was that we went to the sea and were glad of it for the rest of the day."
    page = f"<body><div><a href=a>Home</a> <a href=b>News</a></div><h2>Title</h2><p>{main}</p><p>Short bit.</p><p>{main}</p><div><a href=c>Next page of this list</a></div></body>"
    assert webpages.extract(page) == f"Title\n{main}\nShort bit.\n{main}"


def test_html_layout_classes_and_comments():
    main = "It is the case that the men of the town were there and that they had been with us for a long time, and so it was that we went to the sea and were glad of it for the rest of the day."
    page = f"<div class='layout with-sidebar'><div class=sidebar>{main}</div><article><h1>T</h1><p>{main}</p><ul><li><a href=x>Link of a list</a></ul></article></div><div class=comments><article><p>{main}</p></article></div>"
    assert webpages.extract(page) == f"T\n{main}"
    assert webpages.extract(f"<div class='sidebar-page'><main><p>{main}</p><p>Short.</p></main></div>") == f"{main}\nShort."
    assert webpages.extract(f"<article><a href=a>One</a></article><h2>Title</h2><p>{main}</p><p>Bit.</p>") == f"Title\n{main}\nBit."


def test_html_neighbours_equal_brute_force():
    r = random.Random(3)
    for _ in range(200):
        labels = [r.choice(["good", "bad", "near_good", "short"]) for _ in range(r.randint(0, 12))]
        decided = [i for i, x in enumerate(labels) if x in ("good", "bad")]
        want = [{labels[max(j for j in decided if j < i)] if any(j < i for j in decided) else None, labels[min(j for j in decided if j > i)] if any(j > i for j in decided) else None} - {None} for i in range(len(labels))]
        assert webpages.decided_neighbours(labels) == want


@pytest.mark.parametrize("part", ["<div><b><p>x", "<a '", "<", "<!--", "</div>", "<li>", "<a href=\"'>"])
def test_html_time_is_linear(part):
    import time

    began = time.perf_counter()
    webpages.extract(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 20


@pytest.mark.parametrize("page", [None, "", "<", "<p", "</p></p>", "<!-- open", "<script>never", "&#x110000;&bogus;", "<p>" * 2000, "plain"])
def test_html_broken(page):
    assert isinstance(webpages.extract(page), str)


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None)], "page_id long, url string, html string")
    got = webpages.main_text(pages).collect()
    assert sorted(r.n_chars for r in got) == [0, 39, 39]


# Decontamination


@pytest.mark.parametrize("block_windows", [1 << 20, 9])
def test_decontamination_equals_brute_force(spark, block_windows):
    bench = prose(8, 6, 25) + ["Short item here", None, "", "ÄÖ ß 中文 end"]
    texts = [*EDGES, f"start {bench[0]} end", bench[1].upper().replace(" ", ", "), "a short, ITEM here", " ".join(bench[2].split()[:9]), " ".join(bench[2].split()[3:13]), *prose(9, 5)]
    docs = documents(spark, texts)
    items = spark.createDataFrame(list(enumerate(bench)), "item_id long, text string")
    docs = docs.unionByName(docs)
    found = decontaminate.find_windows(docs, items, block_windows=block_windows)
    got = sorted((r.doc_id, r.n_words, len(r.hits), len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest()) for r in found.collect())
    want = decontaminate.brute_force(list(enumerate(texts)), list(enumerate(bench)))
    assert got == sorted((i, *v) for i, v in want.items() for _ in range(2))
    clean = decontaminate.clean_documents(docs, items, block_windows=block_windows)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted(i for i, v in want.items() if not v[1] for _ in range(2))


# PII


def test_pii_spans_and_redaction(spark):
    texts = ["mail a.b@c.de or x@y.z.w.", "ip 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5", "card 4111 1111 1111 1111, 4111 1111 1111 1112", "call +1 (555) 123-4567 now", "a@b.c._x@d.e", *EDGES]
    docs = documents(spark, texts)
    found = pii.find_pii(docs)
    got = {r.doc_id: r.w for r in found.select("doc_id", pii.written("base").alias("w")).collect()}
    assert got[0] == "email:5:13,email:17:25" or got[0] == "email:5:13,email:17:24"
    assert got[1] == "ip:3:10,ip:29:36"
    assert got[2] == "card:5:24"
    assert got[3] == "phone:5:22"
    assert got[4] == "email:0:5,email:6:11" or got[4].startswith("email:0:5")
    assert all(got[i] == "" for i in range(5, len(texts)))
    out = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert out[2] == "card [CARD], 4111 1111 1111 1112"
    assert out[5] is None
    assert pii.redact(docs).columns == docs.columns


OBFUSCATED = [
    ("write to jane.doe (at) example (dot) com today", "write to [EMAIL] today"),
    ("write to jane [dot] doe [AT] mail.example.org today", "write to [EMAIL] today"),
    ("write to jane @ example.com today", "write to [EMAIL] today"),
    ("call 555-123-4567 now", "call [PHONE] now"),
    ("the office is at (555) 123-4567 now", "the office is at [PHONE] now"),
    ("from abroad 0049 30 1234567 works", "from abroad [PHONE] works"),
    ("pay by 4111.1111.1111.1111 now", "pay by [CARD] now"),
    ("the server 10 . 0 . 0 . 17 answers", "the server [IP] answers"),
]
HARMLESS = [
    "order 5551234567 went out", "pay by 4111.1111.1111.1112 now", "due 2024-01-15 2024-02-15", "rows 10 20 30 40 50 60 70", "years 2021 2022 2023",
    "the server 10 . 0 . 0 . 999 answers", "look (at) this.", "token 681c09b8e90e7e8c9575180f595f646cf", "code x_5551234567_y",
]


@pytest.mark.parametrize("more", [0, 400])
def test_pii_obfuscated_is_redacted_at_every_size(spark, more):
    r = random.Random(18)
    number = lambda n: "".join(str(r.randint(0, 9)) for _ in range(n))
    rest = [f"mail u{i}@host{i}.com or +49 30 {number(8)} ip 10.0.{i % 256}.7 no {number(16)} hex {number(7)}f" for i in range(more)]
    texts = [x for x, _ in OBFUSCATED] + HARMLESS + rest
    out = {row.doc_id: row.text for row in pii.redact(documents(spark, texts)).collect()}
    assert [out[i] for i in range(len(OBFUSCATED))] == [x for _, x in OBFUSCATED]
    assert [out[len(OBFUSCATED) + i] for i in range(len(HARMLESS))] == HARMLESS


def test_pii_trees_do_not_see_the_base_pattern(spark):
    texts = ["jane (at) example (dot) com", "jane@example.com", "call 555-123-4567", "call +1 555-123-4567", "no 5551234567890123"]
    rows = pii.candidates(pii.with_spans(documents(spark, texts), "doc_id", "text")).collect()
    assert "wide_only" not in pii.FEATURES and "plus" not in pii.FEATURES
    assert sorted((x.kind, x.label) for x in rows) == [("card", 0.0), ("email", 1.0), ("email", 1.0), ("phone", 0.0), ("phone", 1.0), ("phone", 1.0)]


def test_pii_trees_equal_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    r = random.Random(9)
    rows = [(float(a > 0.5 and b < 0.7 or c > 0.9), a, b, c) for a, b, c in ((r.random(), r.random(), r.random()) for _ in range(300))]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(rows, "label double, a double, b double, c double"))
    model = GBTClassifier(maxIter=5, maxDepth=3, seed=1).fit(df)
    both = model.transform(df).select(vector_to_array("rawPrediction")[1].alias("x"), pii.boosted(model, F.array("a", "b", "c")).alias("y")).collect()
    assert len({round(z.x, 6) for z in both}) > 3 and all(z.x == pytest.approx(z.y) for z in both)


# Near duplicates


def edited(text, n, seed):
    r, words = random.Random(seed), text.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"z{r.random()}"
    return " ".join(words)


def test_near_duplicates_equal_brute_force(spark):
    base = prose(10, 6)
    texts = [*base, *[edited(base[k % 6], n, 7 * k + n) for k in range(30) for n in (1, 4, 6, 8, 12)], *base[:3], *EDGES]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(documents(spark, texts)).collect()}
    assert got == near.brute_force(list(enumerate(texts)))


def test_near_copies_between_80_and_85_are_linked(spark):
    base = prose(16, 40, words=500)
    texts = [x for i, b in enumerate(base) for x in (b, edited(b, 10, i))]
    sets = near.brute_force(list(enumerate(texts)), percent=80)
    assert all(not sets[2 * i + 1][2] for i in range(40))
    assert sum(not v[2] for v in near.brute_force(list(enumerate(texts)), percent=85).values()) < 40
    docs = documents(spark, texts)
    kept = {r.doc_id for r in near.without_near_duplicates(docs).collect()}
    assert kept == {2 * i for i in range(40)}
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == kept
    assert (near.bands_for(80, 5), near.bands_for(85, 5)) == (41, 28)


def test_op7_links_at_85_as_its_contract_says(spark, tmp_path):
    base = prose(17, 10, words=500)
    texts = [x for i, b in enumerate(base) for x in (b, edited(b, 10, i), edited(b, 4, 100 + i))]
    documents(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near.op7_near_duplicates(spark, str(tmp_path)).collect()}
    assert got == near.brute_force(list(enumerate(texts)), percent=85)


def test_large_groups_are_cut_into_blocks(spark):
    base = prose(11, 2)
    texts = [edited(base[k % 2], 9, k) for k in range(40)]
    docs = documents(spark, texts).select("doc_id", "text")
    _, buckets = near.classes(docs, n=5, rows=2, bands=20)
    edges = near.links(docs, buckets, n=5, percent=70, block=7)
    got = {r.node: r.component for r in graph.components(edges).collect()}
    want = {i: c for i, (_, c, _) in near.brute_force(list(enumerate(texts)), percent=70).items()}
    assert {i: got.get(i, i) for i in want} == want


def test_near_duplicates_null_ids_and_repeats(spark):
    text = prose(12, 1)[0]
    docs = documents(spark, [text, text, text, None], ids=[3, 3, None, 5])
    kept = near.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "5", "None"]


# Rules


def test_rules_equal_brute_force(spark):
    texts = [*EDGES, "a b c a b c d\nx\nx\n\n#*$", *prose(13, 3)]
    got = {r.doc_id: r for r in rules.apply_rules(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        words = (text or "").replace("\t", " ").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        grams = list(zip(words, words[1:], words[2:], strict=False))
        twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else set(grams)
        covered = {p + k for p, g in enumerate(grams) if g in twice for k in range(3)}
        assert (got[i].n_words, got[i].n_repeat_words) == (len(words), len(covered)), i
        assert got[i].base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
    assert got[9].n_dup_lines == 1 and got[9].n_symbols == 3
    assert all(got[i].kept for i in range(10, 13))


def test_rule_order_does_not_change_the_verdict(spark):
    docs = documents(spark, prose(14, 20, 80) + ["THE!! LOUD!! ONE!! " * 30, "a### b*** " * 40])
    own = rules.default_rules()
    a = {r.doc_id: r.kept for r in rules.apply_rules(docs, rules=own).collect()}
    b = {r.doc_id: r.kept for r in rules.apply_rules(docs, rules=own[::-1], sample_rows=1).collect()}
    assert a == b and not a[20] and not a[21]


# Tokens


def test_token_counts_equal_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path(tokens.TOKENIZER)
    texts = [*EDGES, "a<|endoftext|>b <|startoftext|>", "it's  we'll don't\x1c12 345", "é Å", "same", "same"]
    ids = [*range(len(texts) - 2), 0, 0]
    exact = Tokenizer.from_file(path)
    want = sorted((i, len((t or "").encode()), len(exact.encode(t or "", add_special_tokens=False))) for i, t in zip(ids, texts, strict=True))
    for hot in (0, 3, 1000):
        got = tokens.count_tokens(documents(spark, texts, ids=ids), path=path, hot=hot)
        assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want


# Suffixes


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 700])
def test_repeated_passages_equal_brute_force(spark, bucket_bytes):
    r = random.Random(15)
    parts = ["".join(r.choice("ab cé") for _ in range(n)) for n in (49, 50, 51, 120, 300)]
    filler = lambda n: "".join(r.choice("defghij klmno") for _ in range(n))
    texts = [*EDGES, *[filler(r.randint(0, 90)) + r.choice(parts) + filler(r.randint(0, 60)) + r.choice(parts)[r.randint(0, 9) :] for _ in range(40)], "a" * 200, "a" * 90, parts[4], parts[4]]
    found = suffixes.repeated_passages(documents(spark, texts), bucket_bytes=bucket_bytes)
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in found.collect()}
    assert got == suffixes.brute_force(list(enumerate(texts)))


def test_repeated_passages_null_and_repeated_ids(spark):
    text = prose(16, 1, 40)[0]
    found = suffixes.repeated_passages(documents(spark, [text, text, text, None], ids=[1, 1, None, None]))
    assert sorted((str(r.doc_id), r.n_removed) for r in found.collect()) == [("1", 0), ("1", 0), ("None", 0), ("None", 0)]


@pytest.mark.parametrize("op", [mixing.mix, lm.score_documents, pii.find_pii, near.near_duplicates, rules.apply_rules, suffixes.repeated_passages])
def test_empty_tables(spark, op):
    assert op(documents(spark, [])).count() == 0


def test_empty_tables_beside_others(spark):
    public = pytest.importorskip("public_tokenizers")
    none = documents(spark, [])
    labels, items = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    assert quality.classify(none, labels).count() == 0 and decontaminate.find_windows(none, items).count() == 0
    assert tokens.count_tokens(none, path=public.path(tokens.TOKENIZER)).count() == 0
    assert webpages.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_suffix_slices_and_equal_hashes(monkeypatch):
    """Strings are compared in slices of whole groups; where all hashes are equal the bytes decide."""
    r = random.Random(31)
    texts = ["".join(r.choice("ab ") for _ in range(r.randint(0, 200))) for _ in range(12)]
    texts += [texts[0], texts[1][:120] + texts[2], "x" * 90 + texts[3]]

    def whole():
        import pyarrow as pa

        docs = pa.table([pa.array(range(len(texts))), pa.array([0] * len(texts)), suffixes.zipped(pa.array(texts))], names=["doc_id", "tag", "z"])
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(texts)], names=["doc_id", "tag", "text"])
        hot = np.zeros(0, np.uint64)
        table = lambda found, name: pa.Table.from_batches(list(found)) if found else pa.table([pa.array([], pa.int32()), pa.array([], pa.binary())], names=[name, "blob"])
        dealt = table(list(suffixes._hash_blobs(iter([batch]), 50, 1, hot)), "bucket")
        shared = table(list(suffixes._shared_hashes(dealt, 1)), "home")
        contexts = table(list(suffixes._contexts(docs, shared, 50, hot, hot, 1, 1)), "bucket")
        known, open_ = contexts.filter(pa.compute.field("bucket") >= 1), contexts.filter(pa.compute.field("bucket") < 1)
        found = [b.as_py() for b in known.column("blob")] + [b.as_py() for x in suffixes._repeats(open_, 50, 1) for b in x.column(1)]
        out = next(suffixes._removed(docs, pa.table([pa.array(found, pa.binary())], names=["blob"]), True))
        return {row["doc_id"]: (row["n_bytes"], row["n_removed"], row["n_spans"], row["kept_sha256"]) for row in out.to_pylist()}

    want = suffixes.brute_force(list(enumerate(texts)))
    assert whole() == want
    monkeypatch.setattr(suffixes, "AT_ONCE", 20)
    assert whole() == want
    monkeypatch.setattr(suffixes.B, "mix64", lambda x: x * np.uint64(0) if isinstance(x, np.ndarray) else x)
    assert whole() == want


def test_text_chunks_cover_all_rows():
    import pyarrow as pa

    column = pa.array(["a" * n for n in (0, 5, 100, 3, 0)] + [None])
    seen = [(lo, hi, len(data)) for lo, hi, data, _ in bytesops.text_chunks(column.slice(1), 6)]
    assert seen[0][0] == 0 and seen[-1][1] == 5 and sum(n for *_, n in seen) == 108
