"""The pipeline's stages against brute force, each on what its predecessor kept."""

import os
import re

import duckdb
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

import corpus_pipeline
from verdance.llm import decontaminate, mixing, near, quality

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        before, docs = docs, spark.read.parquet(str(tmp_path / name))
        kept[name] = (before.toPandas(), docs.toPandas())
        assert docs.columns == columns + (["epoch"] if name == "mix" else [])

    before, after = kept["quality_classifier"]
    assert 0.6 * len(before) < len(after) < len(before)

    before, after = kept["near_dedup"]
    want = near.brute_force(list(zip(before.doc_id, before.text, strict=True)))
    assert set(after.doc_id) == {i for i, v in want.items() if v[2]}

    before, after = kept["decontaminate"]
    items = spark.read.parquet(f"{SF}/benchmark.parquet").toPandas()
    want = decontaminate.brute_force(list(zip(before.doc_id, before.text, strict=True)), list(zip(items.item_id, items.text, strict=True)))
    assert set(after.doc_id) == {i for i, v in want.items() if not v[1]}

    before, after = kept["pii"]
    texts = dict(zip(after.doc_id, after.text, strict=True))
    for i, text in zip(before.doc_id, before.text, strict=True):
        assert not re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", texts[i])
        assert text == texts[i] or re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", texts[i])
    assert (after.n_chars == after.text.str.len()).all()

    before, after = kept["mix"]
    con = duckdb.connect()
    con.register("documents", before)
    want = {i: n for i, n in con.execute(f"SELECT doc_id, repeats FROM ({mixing.ORACLE})").fetchall() if n}
    assert after.groupby("doc_id").size().to_dict() == want


def test_run_gives_the_same_documents(spark):
    first = corpus_pipeline.run(spark, SF).select("doc_id", "epoch")
    again = corpus_pipeline.run(spark, SF).select("doc_id", "epoch")
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))


def test_stages_with_nulls_repeats_and_empty_tables(spark):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, "a text without an id", "en", "s1", 20), (None, "a text without an id", "en", "s1", 20), (1, None, "en", None, None), (2, "", None, "s1", 0), (3, long, "en", "s2", len(long)), (4, "mail a@b.co now", "en", "s2", 15), (4, "mail a@b.co now", "en", "s2", 15)]
    docs = spark.createDataFrame([r[: len(schema)] for r in rows], schema)
    empty = spark.createDataFrame([], schema)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        kept[name] = sorted(str((r.doc_id, None if r.text is None else r.text[:20])) for r in out.collect())
        assert set(docs.columns) <= set(out.columns)
        assert stage(spark, empty, SF).count() == 0
    every = sorted(str((r[0], None if r[1] is None else r[1][:20])) for r in rows)
    # Labels of the smallest tables speak of other documents: what the classifier keeps is some of the rows.
    assert set(kept["quality_classifier"]) <= set(every)
    # Of rows of one id one stays, rows without an id stay.
    assert kept["near_dedup"] == sorted(every[: every.index(str((4, "mail a@b.co now")))] + every[every.index(str((4, "mail a@b.co now"))) + 1 :])
    assert kept["decontaminate"] == every
    assert kept["pii"] == sorted(x.replace("a@b.co", "[EMAIL]") for x in every)
    assert set(kept["mix"]) <= set(every)


def test_the_classifier_is_fitted_on_all_labels(spark, monkeypatch):
    class Fitted(Exception):
        pass

    def fit(self, own):
        seen.append(own.count())
        raise Fitted

    seen = []
    docs = spark.range(21_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    monkeypatch.setattr(quality.LogisticRegression, "fit", fit)
    with pytest.raises(Fitted):
        quality.good_documents(docs, labels)
    assert seen == [21_000]


def test_the_classifier_is_the_same_with_many_labels(spark, monkeypatch):
    """Labels that are joined by shuffle give what broadcast ones give."""
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "buy now ###").otherwise("a calm text of words").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    labels = docs.where("doc_id % 2 = 0").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    runs = []
    for most in (100_000, 10):
        monkeypatch.setattr(quality, "BROADCAST_ROWS", most)
        runs.append({r._row.doc_id: r.p_quality for r in quality.classify(docs, labels).collect()})
    assert runs[0] == pytest.approx(runs[1], abs=1e-6)
    assert runs[0][3] < 0.2 and runs[0][1] > 0.8


def test_documents_without_labels_are_not_shuffled(spark, monkeypatch):
    """With many labels, all labelled documents and few others go to the join; ids of any type keep their labels."""
    moved, fitted = [], []
    vectors, fit = quality.vectors, quality.LogisticRegression.fit

    def counted(rows):
        moved.append(rows.count())
        return vectors(rows)

    def watched(self, own):
        fitted.append(own.count())
        return fit(self, own)

    monkeypatch.setattr(quality, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(quality, "vectors", counted)
    monkeypatch.setattr(quality.LogisticRegression, "fit", watched)
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionAll(docs.where("doc_id < 40")).unionAll(spark.createDataFrame([(None, "no id")], "doc_id long, text string"))
    labels = docs.where("doc_id % 20 = 0").select("doc_id", (F.col("doc_id") % 40 == 0).cast("int").alias("quality"))
    for kind, other, filtered in (("long", "long", True), ("int", "long", True), ("string", "string", True), ("double", "long", False)):
        moved.clear(), fitted.clear()
        quality.Evidence(docs.withColumn("doc_id", F.col("doc_id").cast(kind)), labels.withColumn("doc_id", F.col("doc_id").cast(other)), "doc_id", "text", ("quality",))
        # 200 labels, two of them for repeated rows.
        assert fitted == [202]
        assert (202 <= moved[0] <= 202 + 4000 / 8) if filtered else moved == [4041], (kind, moved)


def test_the_classifier_scores_after_an_observation(spark):
    """As other queries of a session make them: op12 and the JSON-lines reader do."""
    seen = Observation()
    spark.range(3).observe(seen, F.count("*").alias("n")).collect()
    assert seen.get == {"n": 3}
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "buy now ###").otherwise("a calm text").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    labels = docs.select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    assert sorted(r.doc_id for r in quality.good_documents(docs, labels).collect()) == [i for i in range(40) if i % 3]
