"""Registered queries on small tables of their own, against brute force: verdicts, digests, very long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from verdance.llm import near, quality, rules, suffixes

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def saved(spark, folder, texts, sources=None, langs=None):
    """A folder of tables with documents numbered from 0."""
    rows = [(i, t, langs[i] if langs else "en", sources[i] if sources else "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def prose(seed, n, words, vocabulary=3000):
    r = random.Random(seed)
    return [" ".join(f"w{r.randint(0, vocabulary)}" for _ in range(words)) for _ in range(n)]


# Quality classifier


def strength(groups, parent):
    many = {k: v for k, v in groups.items() if len(v) > 1}
    between = np.mean([(np.mean(v) - parent(k)) ** 2 - np.var(v) / len(v) for k, v in many.items()])
    spread = np.mean([parent(k) * (1 - parent(k)) for k in many])
    return 1e6 if between <= 0 else min(1e6, max(1.0, spread / between - 1))


def test_quality_query_equals_brute_force(spark, tmp_path):
    """Scores and verdicts from the document evidence that the query itself returns; the evidence by held-out accuracy."""
    r = random.Random(31)
    texts, sources, langs, clean = [], [], [], []
    for i, text in enumerate(prose(32, 240, 60)):
        source = r.choice(["good", "mixed", "bad", None])
        fine = r.random() < {"good": 0.95, "mixed": 0.5, "bad": 0.1, None: 0.6}[source]
        dirt = r.choice([" ".join(w + "###" for w in text.split()), text.replace(" ", " idiot ", 6)])
        texts.append(text if fine else dirt)
        sources.append(source)
        langs.append(r.choice(["en", "de", None]))
        clean.append(fine)
    folder = saved(spark, tmp_path, [*texts, None, ""], [*sources, "alone", "mixed"], [*langs, None, "fr"])
    labels = [(i, int("###" not in texts[i]), int(" idiot " in texts[i])) for i in range(0, 240, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = {x.doc_id: x for x in quality.op3_quality_classifier(spark, folder).collect()}
    assert sorted(got) == list(range(242))

    keys = {i: (s, p) for i, (s, p) in enumerate(zip([*sources, "alone", "mixed"], [*langs, None, "fr"], strict=True))}
    hosts, paths = {}, {}
    for i, key in keys.items():
        assert got[i].p_doc == pytest.approx(got[i].p_quality * (1 - got[i].p_toxic))
        hosts.setdefault(key[:1], []).append(got[i].p_doc)
        paths.setdefault(key, []).append(got[i].p_doc)
    mean = sum(x.p_doc for x in got.values()) / len(got)
    k_host = strength(hosts, lambda _: mean)
    host_means = {h: (k_host * mean + sum(v)) / (k_host + len(v)) for h, v in hosts.items()}
    k_path = strength(paths, lambda key: host_means[key[:1]])
    odds = lambda p: np.log(max(p, 1e-9) / max(1 - p, 1e-9))
    for i, key in keys.items():
        own, h, p = got[i].p_doc, hosts[key[:1]], paths[key]
        host = (k_host * mean + max(0.0, sum(h) - own)) / (k_host + len(h) - 1)
        path = (k_path * host + max(0.0, sum(p) - own)) / (k_path + len(p) - 1)
        score = 1 / (1 + np.exp(-(odds(own) + odds(path) - odds(mean))))
        assert (got[i].host_mean, got[i].path_mean, got[i].score) == pytest.approx((host, path, score), abs=1e-6), i
        assert got[i].kept == (got[i].score >= 0.5)
    unseen = range(1, 240, 2)
    assert sum(got[i].kept == clean[i] for i in unseen) >= 0.97 * len(unseen)


def test_labels_that_disagree_are_not_used(spark):
    """Repeats in any order give the same fit; a label with two values counts as none."""
    texts = prose(33, 40, 40) + [t.replace(" ", "### ") for t in prose(34, 40, 40)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCUMENTS)
    schema = "doc_id long, quality int, toxic int"
    labels = [(i, int(i < 40), 0) for i in range(0, 80, 2)]
    doubled = [*labels, *[(i, int(i >= 40), 0) for i in range(0, 80, 4)], *labels[::3]]
    left = [x for x in labels if x[0] % 4]

    def scores(rows):
        found = quality.classify(docs, spark.createDataFrame(rows, schema).coalesce(1))
        return {x.id: x.p_doc for x in found.select(F.col("_row.doc_id").alias("id"), "p_doc").collect()}

    want = scores(left)
    assert scores(doubled) == pytest.approx(want, abs=1e-4)
    assert scores(doubled[::-1]) == pytest.approx(want, abs=1e-4)


# Quality rules


def judged(text):
    """(measures and verdicts of one text) worked out word by word."""
    text = text or ""
    parts = re.findall(r"([^\x20\x09-\x0D]+)([\x20\x09-\x0D]*)", text)
    words = [w for w, _ in parts]
    n = len(words)
    chars, symbols = sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    count = Counter(grams)
    repeat = len({p + k for p, g in enumerate(grams) if count[g] > 1 for k in range(3)})
    runs, at = 0, 0
    while at < n:
        end = at
        while end + 1 < n and parts[end][1] == " " and words[end + 1] == words[at]:
            end += 1
        runs += end - at >= 3
        at = end + 1
    base = n < 50 or 100 * repeat > 50 * n
    some = max(n, 1)
    rejected = [
        100 * symbols > 30 * some,
        chars < 2 * n or chars > 14 * n,
        100 * dup > 40 * len(text.split("\n")),
        100 * text.count("!") > 40 * some,
        100 * len(regex.findall(r"\p{Lu}", text)) > 60 * len(text),
        20 * runs > some,
    ]
    return (n, chars, symbols, dup, repeat, base, not base and not any(rejected))


def test_rules_query_equals_brute_force(spark, tmp_path):
    r = random.Random(41)
    spaces = [" ", " ", " ", " ", "\t", "\n", " \n", "\x0b", "\r\n", " "]
    vocabulary = {
        "plain": [f"w{i}" for i in range(900)],
        "symbols": ["a#", "b|c", "<d>", "plain", "words", *[f"w{i}" for i in range(300)]],
        "short": list("abcdefghijklmnop"),
        "loud": [f"Hey{i}!" for i in range(300)],
        "capitals": [f"{a}{b}{c}" for a in "ABCÄ" for b in "XYZΩ" for c in "QRST\U0001d400"],
        "long": ["中" * 20 + str(i) for i in range(200)],
    }
    texts = [None, "", " \n", "x", "\n\n\n"]
    for name, choices in vocabulary.items():
        for n in (30, 49, 50, 51, 120):
            texts.append("".join(r.choice(choices) + r.choice(spaces) for _ in range(n)) if name != "short" else "".join(r.choice(choices) + r.choice(choices) * (i % 3 == 0) + " " for i in range(n)))
    line = " ".join(f"l{i}" for i in range(12))
    texts += ["\n".join([line] * 3 + [f"{i} x{i} y{i} z{i} q{i}" for i in range(k)]) for k in (1, 2, 3, 4, 5, 20)]
    texts += [" ".join(f"v{i}" for i in range(60)) + " go go go go" * k for k in (1, 2)] + [" ".join(f"{w} " + " ".join([f"r{w}"] * 4) for w in prose(42, 1, 20)[0].split())]
    got = {x.doc_id: x for x in rules.op8_quality_rules(spark, saved(spark, tmp_path, texts)).collect()}
    assert len(got) == len(texts)
    verdicts = set()
    for i, text in enumerate(texts):
        x = got[i]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) == judged(text), (i, text)
        verdicts.add((x.base_failed, x.kept))
    assert verdicts == {(True, False), (False, False), (False, True)}


def test_rules_on_more_words_than_packed_windows_hold(spark, tmp_path):
    r = random.Random(43)
    words = [f"w{r.randint(0, 10**6)}" for _ in range((1 << 20) + 50)]
    words[-10:] = words[:10]
    text = " ".join(words)
    x = rules.op8_quality_rules(spark, saved(spark, tmp_path, [text, "short"])).where("doc_id = 0").first()
    assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed, x.kept) == judged(text)


# Very long texts


def test_near_duplicates_of_very_long_texts(spark, tmp_path):
    long = prose(51, 1, 120_000, 10**6)[0].split()
    change = lambda k: " ".join("changed" if i % k == 0 else w for i, w in enumerate(long))
    texts = [" ".join(long), change(2_000), change(60), change(25), *prose(52, 5, 80), " ".join(long).upper(), None, ""]
    got = {x.doc_id: x for x in near.op7_near_duplicates(spark, saved(spark, tmp_path, texts)).collect()}
    want = near.brute_force(list(enumerate(texts)), percent=85)
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(0, len(w) - 4))}
    for i, text in enumerate(texts):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(shingles(text)), want[i][1], want[i][1] == i), i
    # Changing each 60th word leaves 0.846 of the union, each 25th far less.
    assert [got[i].component_id for i in (0, 1, 2, 3, 9)] == [0, 0, 2, 3, 0]


def test_passages_of_a_very_long_text(spark, tmp_path):
    long = prose(61, 1, 120_000, 10**6)[0]
    r = random.Random(62)
    cuts = [r.randint(0, len(long) - 400) for _ in range(6)]
    parts = [long[c : c + n] for c, n in zip(cuts, (49, 50, 51, 120, 300, 400), strict=True)]
    texts = [long, *[f"<{p}>" for p in parts], "<" + "><".join(parts) + ">", long[1000:-1000], None, ""]
    got = {x.doc_id: x for x in suffixes.op10_suffix_dedup(spark, saved(spark, tmp_path, texts)).collect()}
    seen = set()
    for i, text in enumerate(texts):
        data = (text or "").encode()
        starts = [data[p : p + 50] for p in range(len(data) - 49)]
        covered = np.zeros(len(data) + 1, int)
        for p, s in enumerate(starts):
            if s in seen:
                covered[p : p + 50] = 1
        seen.update(starts)
        kept = bytes(np.frombuffer(data, np.uint8)[covered[:-1] == 0])
        spans = int((np.diff(covered, prepend=0) == 1).sum())
        x = got[i]
        assert (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) == (len(data), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest()), i
    assert [got[i].n_removed for i in (1, 2)] == [0, 50]
