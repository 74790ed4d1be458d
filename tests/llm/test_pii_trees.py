"""What the boosted trees decide: planted spans in forms that the base patterns do not know, and numbers that only look like them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from verdance.llm import pii


def luhn(digits):
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def planted(seed, n):
    """(text, kind, start, end or None for harmless ones)."""
    r = random.Random(seed)
    num = lambda k: "".join(str(r.randint(0, 9)) for _ in range(k))
    word = lambda: "".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(2, 4)))
    filler = lambda k: " ".join(word() for _ in range(k))
    out = []
    for _ in range(n):
        user, host, end = word() + r.choice([".", "_", ""]) + word(), word() + r.choice(["", "-" + word()]), r.choice(["com", "org", "net", "de"])
        at, dot = r.choice([(" (at) ", " (dot) "), (" [at] ", "."), ("(at)", "."), (" @ ", "."), (" {AT} ", " {DOT} "), ("<at>", ".")])
        out.append(("email", r.choice(["write to", "ask", "reach me under", "mail"]), f"{user}{at}{host}{dot}{end}", True))
        digits = r.choice("45") + num(14)
        digits += next(d for d in "0123456789" if luhn(digits + d))
        sign = r.choice([".", "/", "_", " - "])
        out.append(("card", r.choice(["pay by", "card", "my visa is", "use"]), sign.join(digits[i : i + 4] for i in range(0, 16, 4)), True))
        wrong = digits[:-1] + str((int(digits[-1]) + r.randint(1, 9)) % 10)
        out.append(("card", r.choice(["pay by", "card", "number"]), sign.join(wrong[i : i + 4] for i in range(0, 16, 4)), False))
        area = str(r.randint(2, 9)) + num(2)
        out.append(("phone", r.choice(["call", "phone:", "tel.", "fax"]), r.choice([f"{area}-{num(3)}-{num(4)}", f"({area}) {num(3)}-{num(4)}", f"00{r.randint(30, 49)} {num(2)} {num(7)}", f"{area} {num(3)} {num(4)}"]), True))
        out.append(("phone", r.choice(["order", "invoice", "serial", "account"]), r.choice([f"{area}{num(7)}", f"{area}-{num(3)}-{num(4)}"]), False))
        out.append(("phone", "on", f"20{r.randint(10, 29)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} 20{r.randint(10, 29)}-01-05", False))
        octets = [str(r.randint(1, 255)) for _ in range(4)]
        out.append(("ip", r.choice(["the server", "host", "ip", "address"]), " . ".join(octets), True))
        out.append(("ip", r.choice(["the server", "host"]), " . ".join([*octets[:3], str(r.randint(256, 999))]), False))
    rows = []
    for kind, before, value, real in out:
        head = f"{filler(r.randint(1, 6))} {before} "
        rows.append((head + value + r.choice([" ", ". ", ", "]) + filler(3), kind, len(head), len(head) + len(value), real))
    return rows


def spans_of(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = pii.find_pii(docs, **options).select("doc_id", pii.written("spans").alias("s")).collect()
    return {x.doc_id: [(k, int(a), int(b)) for k, a, b in (y.split(":") for y in x.s.split(",") if x.s)] for x in found}


@pytest.fixture(scope="module")
def results(spark):
    rows = planted(31, 60)
    return rows, spans_of(spark, [x[0] for x in rows])


@pytest.mark.parametrize("kind", pii.KINDS)
def test_recall_on_planted_spans(results, kind):
    rows, got = results
    real = [(i, x) for i, x in enumerate(rows) if x[1] == kind and x[4]]
    hit = sum(any(k == kind and a < x[3] and x[2] < b for k, a, b in got[i]) for i, x in real)
    assert hit >= 0.9 * len(real), (kind, hit, len(real))


def test_harmless_numbers_stay(results):
    rows, got = results
    harmless = [(i, x) for i, x in enumerate(rows) if not x[4]]
    wrong = [(x[0], got[i]) for i, x in harmless if any(a < x[3] and x[2] < b for _, a, b in got[i])]
    assert len(wrong) <= 0.1 * len(harmless), wrong[:5]


def test_without_trees_nothing_but_the_base_is_found(spark, monkeypatch):
    """The trees decide: with margins of nothing no hidden span is found."""
    rows = planted(32, 3)
    monkeypatch.setattr(pii, "boosted", lambda model, row: F.lit(float("-inf")))
    monkeypatch.setattr(pii, "fit", lambda rows, **_: (None, dict.fromkeys(pii.KINDS, 0.0)))
    got = spans_of(spark, [x[0] for x in rows])
    assert not any(got.values())


def test_exact_ends_of_spans(spark):
    texts = ["mail a.b@c.de or x@y.z.w.", "a@b.c._x@d.e", "ip 1.2.3.4 and 300.1.1.1 and 1.2.3.4.5", "é\U0001f600 mail a@b.co", "call +1 (555) 123-4567, +1 (555) 123-4568"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: x.s for x in pii.find_pii(docs).select("doc_id", pii.written("base").alias("s")).collect()}
    assert got == {0: "email:5:13,email:17:24", 1: "email:0:5,email:5:12", 2: "ip:3:10,ip:29:36", 3: "email:8:14", 4: "phone:5:22,phone:24:41"}
    for i, s in got.items():
        for one in s.split(","):
            kind, a, b = one.split(":")
            assert re.fullmatch({"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+){3}", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}[kind], texts[i][int(a) : int(b)])


def test_a_text_full_of_spans_takes_linear_time(spark):
    def took(n):
        text = " ".join(f"mail u{i}@h{i}.com or u{i} (at) h{i}.org" for i in range(n))
        rows = spark.createDataFrame([(1, text)], "doc_id long, text string")
        spaces = pii.with_spans(rows, "doc_id", "text")
        masked = pii.redacted(F.col("text"), F.array_sort(F.concat(*[F.transform(f"base_{k}", lambda s, j=j: F.struct(s["start"].alias("start"), F.lit(j).alias("kind_id"), s["end"].alias("end"))) for j, k in enumerate(pii.KINDS)])))
        began = time.perf_counter()
        out = spaces.select(F.size("base_email"), F.size("cand_email"), F.length(masked)).first()
        assert out[0] == n and out[1] == n
        return time.perf_counter() - began

    took(200)
    small, large = took(2000), took(16_000)
    assert large < 24 * small + 5


def test_all_documents_take_part_in_fitting(spark, monkeypatch):
    """Every candidate of more than 20,000 documents counts, in the trees and in the thresholds."""
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("ip 10.0.0."), (F.col("id") % 250).cast("string"), F.lit(" of "), F.col("id").cast("string")).alias("text"))
    seen = []
    monkeypatch.setattr(pii, "fit", lambda found, **_: (seen.append(found.where("kind = 'ip' AND known").count()), (None, {}))[1])
    pii.find_pii(docs)
    assert seen == [21_000]


def test_the_pipeline_fits_on_all_documents_that_reach_it(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("mail a"), (F.col("id") % 90).cast("string"), F.lit("@b.org")).alias("text"))
    seen = []
    monkeypatch.setattr(pii, "fit", lambda found, **_: (seen.append(found.where("kind = 'email' AND known").count()), (None, {}))[1])
    assert corpus_pipeline.pii_stage(spark, docs, "").columns == ["doc_id", "text"]
    assert seen == [21_000]


def test_what_the_driver_plans_does_not_grow_with_kinds_and_partitions(spark, monkeypatch):
    """Candidates are looked for in one plan, trees are written out once for thresholds and once for all kinds, and fitted in as few tasks as their rows need."""
    calls, fitted = [], []

    def counted(name):
        f = getattr(pii, name)
        monkeypatch.setattr(pii, name, lambda *a: (calls.append(name), f(*a))[1])

    def watched(self, train):
        fitted.append((train.rdd.getNumPartitions(), train.agg(F.sum("weight")).first()[0]))
        return fit(self, train)

    counted("with_spans"), counted("boosted")
    fit = pii.GBTClassifier.fit
    monkeypatch.setattr(pii.GBTClassifier, "fit", watched)
    docs = spark.createDataFrame(list(enumerate(x[0] for x in planted(33, 20))), "doc_id long, text string")
    want = pii.training(pii.places(pii.with_spans(docs, "doc_id", "text"))).where("pmod(draw, 4) != 0").count()
    calls.clear()
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = pii.find_pii(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(calls) == ["boosted", "boosted", "with_spans"]
    assert fitted == [(1, want)]
    assert found.where(F.size("spans") > F.size("base")).count() > 20
