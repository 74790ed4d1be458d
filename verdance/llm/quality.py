"""Quality classifier with hierarchical empirical Bayes over hosts and paths."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, lookup, scratch, stored, table

HASHED = 1 << 14
NUMERIC = ("length", "word_length", "symbols", "shouts", "bars", "capitals", "digits", "variety", "fresh")
#: How many documents' worth a prior may count at least and at most.
STRENGTH = (1.0, 1e6)
CUT = 0.5
#: Bits a label in the bitmap of labelled ids, and bits of it at most (32 MB); more labels only let more documents through to the join.
LABEL_BITS, MOST_BITS = 16, 1 << 28


def _numbers(text: Column, words: Column) -> list[Column]:
    n = F.greatest(F.size(words), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    without = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))
    a_word = lambda count: F.least(F.lit(1.0), count / n)
    distinct = F.size(F.array_distinct(words))
    return [
        F.log1p(n.cast("double")) / 10,
        F.least(F.lit(2.0), chars / n / 10),
        a_word(F.regexp_count(text, F.lit("[#*$%&<>]"))),
        a_word(without("!")),
        a_word(without("|")),
        F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        F.regexp_count(text, F.lit("[0-9]")) / chars,
        distinct / n,
        F.least(F.lit(1.0), distinct / F.pow(n.cast("double"), F.lit(0.85))),
    ]


def vectors(rows: DataFrame) -> DataFrame:
    """Adds _features (hashed words and numbers) to rows with _text."""
    rows = rows.withColumn("_words", F.array_remove(F.split(F.lower("_text"), r"[^\p{L}\p{M}]+"), ""))
    numbers = [F.coalesce(c.cast("double"), F.lit(0.0)).alias(f"_{n}") for n, c in zip(NUMERIC, _numbers(F.col("_text"), F.col("_words")), strict=True)]
    rows = rows.select("*", *numbers)
    rows = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=HASHED, binary=True).transform(rows)
    rows = VectorAssembler(inputCols=["_tf", *[f"_{n}" for n in NUMERIC]], outputCol="_features").transform(rows)
    return rows.drop("_words", "_tf", *[f"_{n}" for n in NUMERIC])


def packed(docs: DataFrame, text_col: str, host_col: str, path_col: str, carry: list[str]) -> DataFrame:
    """The columns of docs to carry as a struct _row, with _text (null: empty), _host and _path beside it."""
    col = lambda n: F.col(f"`{n}`")
    return docs.select(F.struct(*[col(n) for n in carry]).alias("_row"), F.coalesce(col(text_col), F.lit("")).alias("_text"), col(host_col).alias("_host"), col(path_col).alias("_path"))


def whole_or_text(kind: T.DataType) -> str | None:
    """The type as which ids of the kind are hashed; None where equal ids may be written differently."""
    if isinstance(kind, T.ByteType | T.ShortType | T.IntegerType | T.LongType):
        return "long"
    return "string" if kind == T.StringType() else None


def perhaps_labelled(rows: DataFrame, some: DataFrame, n: int) -> DataFrame:
    """All rows whose _id is one of the n ids _of in some, and at most about one in 16 of the others.

    Hashed ids are looked up in a broadcast bitmap of n labels; the join that follows is exact. Rows
    come back as they are where ids aren't both whole numbers or both plain text.
    """
    kind = whole_or_text(rows.schema["_id"].dataType)
    if kind is None or kind != whole_or_text(some.schema["_of"].dataType):
        return rows
    size = min(MOST_BITS, 1 << (LABEL_BITS * n - 1).bit_length())

    def place(name: str) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(F.col(name).cast(kind)), F.lit(size))
        return F.bitmap_bucket_number(at), F.bitmap_bit_position(at)

    of_page, of_bit = place("_of")
    page, bit = place("_id")
    pages = some.select(of_page.alias("_page"), of_bit.alias("_bit")).repartition("_page").groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = rows.join(F.broadcast(pages), page == F.col("_page"))
    return found.where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("_page", "_bits")


class Evidence:
    """Document classifiers for high quality and for toxicity, from labels 0 and 1."""

    def __init__(self, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, targets: tuple[str, ...]):
        agreed = [F.when(F.min(t) == F.max(t), F.min(t)).cast("double").alias(f"_label_{t}") for t in targets]
        some = cut(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_of")).agg(*agreed))
        rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_text"))
        on = F.col("_id") == F.col("_of")
        # Where labels are too many to be broadcast, features of documents that may have one are shuffled to them, not texts.
        n = some.count()
        train = vectors(rows.join(F.broadcast(some), on)).drop("_text") if n <= BROADCAST_ROWS else vectors(perhaps_labelled(rows, some, n)).drop("_text").join(some, on)
        train = stored(train.drop("_of"))
        self.models = {}
        for target in targets:
            own = train.select("_features", F.col(f"_label_{target}").alias("_label")).where("_label IN (0, 1)")
            if own.select("_label").distinct().count() == 2:
                fit = LogisticRegression(featuresCol="_features", labelCol="_label", predictionCol=f"_is_{target}", probabilityCol=f"_p_{target}", rawPredictionCol=f"_raw_{target}", maxIter=25, regParam=0.001, standardization=False)
                # Read back, a model is without its training summary, which holds the session and can't go to tasks once the session has an observation.
                path = scratch(docs.sparkSession, "model")
                fit.fit(own).save(path)
                self.models[target] = LogisticRegressionModel.load(path)

    def score(self, rows: DataFrame) -> DataFrame:
        """Adds p_<target>; 0.5 where the labels don't hold both classes."""
        rows = vectors(rows)
        for target, model in self.models.items():
            rows = model.transform(rows).withColumn(f"p_{target}", vector_to_array(f"_p_{target}")[1]).drop(f"_p_{target}", f"_raw_{target}", f"_is_{target}")
        return rows.drop("_features")


def strength(groups: DataFrame, parent: Column, mean: Column) -> float:
    """Prior strength by moments: how far group means lie from their parents beyond chance."""
    row = groups.where("n > 1").agg(F.avg(F.pow(mean - parent, 2) - F.col("var") / F.col("n")).alias("between"), F.avg(parent * (1 - parent)).alias("spread")).first()
    if row["between"] is None or row["between"] <= 0:
        return STRENGTH[1]
    return min(STRENGTH[1], max(STRENGTH[0], row["spread"] / row["between"] - 1))


def site_posteriors(scored: DataFrame) -> tuple[DataFrame, float, int]:
    """(sites, the global mean, the number of sites) from rows with _host, _path, p_doc.

    Counts and sums are grouped by path first; hosts sum up their paths. A site row holds what the posterior
    means need: sums and counts of path and host, and the prior strengths that moments give for each level.
    """
    paths = cut(scored.groupBy("_host", "_path").agg(F.count("*").alias("n"), F.sum("p_doc").alias("s"), F.sum(F.col("p_doc") * F.col("p_doc")).alias("q")))
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.count("*").alias("paths")).first()
    mean = (total["s"] / total["n"]) if total["n"] else 0.5
    mean = min(1 - 1e-6, max(1e-6, mean))
    var = F.greatest(F.lit(0.0), F.col("q") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).withColumn("var", var)
    k_host = strength(hosts, F.lit(mean), F.col("s") / F.col("n"))
    hosts = hosts.select(F.col("_host").alias("_of"), F.col("n").alias("host_n"), F.col("s").alias("host_s"), ((F.lit(k_host * mean) + F.col("s")) / (F.lit(k_host) + F.col("n"))).alias("host_mean"))
    paths = cut(paths.withColumn("var", var).join(hosts, F.col("_host").eqNullSafe(F.col("_of"))).drop("_of"))
    k_path = strength(paths, F.col("host_mean"), F.col("s") / F.col("n"))
    sites = paths.select("_host", "_path", "host_n", "host_s", F.col("n").alias("path_n"), F.col("s").alias("path_s"), F.lit(k_host).alias("k_host"), F.lit(k_path).alias("k_path"))
    return sites, mean, total["paths"]


def posterior_means(own: Column, mean: float) -> tuple[Column, Column]:
    """(host_mean, path_mean) of a document's site without the document's own evidence (own), from the columns of a site row.

    Sparse paths shrink towards their host, sparse hosts towards the global mean; a site of one document is its prior.
    """
    host = (F.col("k_host") * F.lit(mean) + F.greatest(F.col("host_s") - own, F.lit(0.0))) / (F.col("k_host") + F.col("host_n") - 1)
    path = (F.col("k_path") * host + F.greatest(F.col("path_s") - own, F.lit(0.0))) / (F.col("k_path") + F.col("path_n") - 1)
    return host, path


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    path_col: str = "lang",
    cut_at: float = CUT,
    carry: list[str] | None = None,
) -> DataFrame:
    """Each row of docs as a struct _row (its columns named in carry, default all), with p_quality, p_toxic, p_doc, host_mean, path_mean, score, kept.

    Two logistic regressions on hashed words and simple numbers, fitted on all
    labelled documents, give p_doc: good and not toxic. Host and path (here source and
    language section) get posterior means of p_doc over all other documents, shrunk by empirical
    Bayes; the log odds of the path against the global mean are added to those of the document.
    Texts are scored once; their probabilities are written to the shared folder for the two passes that need them.

    Nulls: a null text is empty; null hosts and paths are sites of their own; null labels are not
    used, and without labels of both classes everything is kept. Repeated rows are rows of
    their own; repeated labels of a document count once,
    and one on which they disagree counts as null. A score equal to cut_at is kept. An empty table gives an
    empty result.
    """
    evidence = Evidence(docs, labels, id_col, text_col, ("quality", "toxic"))
    scored = evidence.score(packed(docs, text_col, host_col, path_col, docs.columns if carry is None else carry)).drop("_text")
    for target, default in (("quality", 1.0), ("toxic", 0.0)):
        if target not in evidence.models:
            scored = scored.withColumn(f"p_{target}", F.lit(default))
    scored = stored(scored.withColumn("p_doc", F.col("p_quality") * (1 - F.col("p_toxic"))))
    sites, mean, n_sites = site_posteriors(scored.select("_host", "_path", "p_doc"))
    sites = sites.withColumnsRenamed({"_host": "_h", "_path": "_p"})
    out = lookup(scored, sites, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")), "inner", n_sites)
    host, path = posterior_means(F.col("p_doc"), mean)
    out = out.withColumn("host_mean", host).withColumn("path_mean", path)
    odds = lambda p: F.log(F.greatest(p, F.lit(1e-9)) / F.greatest(1 - p, F.lit(1e-9)))
    score = 1 / (1 + F.exp(-(odds(F.col("p_doc")) + odds(F.col("path_mean")) - odds(F.lit(mean)))))
    out = out.withColumn("score", score)
    return out.select("_row", "p_quality", "p_toxic", "p_doc", "host_mean", "path_mean", "score", (F.col("score") >= cut_at).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, that the classifier keeps."""
    return classify(docs, labels, **options).where("kept").select([F.col("_row")[n].alias(n) for n in docs.columns])


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), carry=["doc_id"])
    return found.select(F.col("_row.doc_id").alias("doc_id"), *found.columns[1:])
