"""Quality rules as a short-circuit cascade ordered by rejection per cost."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SAMPLE_ROWS = 2_000
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def chars_of(text: Column, chars: str) -> Column:
    """How many characters of the text are among chars."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


#: Positions below this fit beside the hash of a window in one long.
PACKED_WORDS = 1 << 20


def windows_of(words: Column) -> Column:
    """The 3-word windows as sorted longs: 44 bits of hash above 20 bits of position; null beyond PACKED_WORDS words."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    packed = F.transform(starts, lambda w, i: F.shiftleft(F.shiftright(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)), 20), 20) + i.cast("long"))
    return F.when(F.size(words) < PACKED_WORDS, F.sort_array(packed))


def same_window(words: Column, p: Column, q: Column) -> Column:
    one = lambda k: F.get(words, (p + k).cast("int")) == F.get(words, (q + k).cast("int"))
    return one(0) & one(1) & one(2)


def mistaken(windows: Column, words: Column) -> Column:
    """Whether two neighbours of one hash are different windows; then the hashes of this text don't tell its windows apart."""
    at = lambda x: x.bitwiseAND(F.lit(PACKED_WORDS - 1))
    wrong = lambda x, i: F.coalesce((F.shiftright(F.get(windows, i + 1), 20) == F.shiftright(x, 20)) & ~same_window(words, at(x), at(F.get(windows, i + 1))), F.lit(False))
    return F.exists(F.transform(windows, wrong), lambda x: x)


def whole_windows_of(words: Column) -> Column:
    """The windows themselves with their positions, sorted."""
    starts = F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0)))
    return F.sort_array(F.transform(starts, lambda w, i: F.struct(F.concat_ws(" ", w, F.get(words, i + 1), F.get(words, i + 2)).alias("key"), i.cast("long").alias("at"))))


def repeated(windows: Column, key, at) -> Column:
    """Positions of the windows that equal a neighbour; `windows` must be a plain column."""
    same = lambda x, j: F.coalesce(key(F.get(windows, j)) == key(x), F.lit(False))
    return F.transform(F.filter(windows, lambda x, i: same(x, i + 1) | same(x, i - 1)), at)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and the measures the contract names. A null text counts as empty.

    n_repeat_words: equal 3-word windows of a document are neighbours once they are sorted by hash, and neighbours
    of one hash are compared by their words; a text where they differ, or of PACKED_WORDS words and more, is sorted by the windows.
    Each array that a lambda looks into is a column of its own, so that it is made once a row.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("words", words_of(F.col("text")))
    rows = rows.select(
        "doc_id",
        "text",
        "words",
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - chars_of(F.col("text"), SPACES)).cast("long").alias("word_chars"),
        chars_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        dup_lines(F.col("text")).alias("n_dup_lines"),
        windows_of(F.col("words")).alias("windows"),
    )
    exact = F.col("windows").isNull() | mistaken(F.col("windows"), F.col("words"))
    rows = rows.withColumn("whole_windows", F.when(exact, whole_windows_of(F.col("words"))))
    short = repeated(F.col("windows"), lambda x: F.shiftright(x, 20), lambda x: x.bitwiseAND(F.lit(PACKED_WORDS - 1)))
    whole = repeated(F.col("whole_windows"), lambda x: x["key"], lambda x: x["at"])
    covered = F.array_distinct(F.flatten(F.transform(F.when(F.col("whole_windows").isNull(), short).otherwise(whole), lambda p: F.array(p, p + 1, p + 2))))
    return rows.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("words", "windows", "whole_windows")


@dataclass(frozen=True)
class Rule:
    """A named test on a row of `measured`; true rejects the document."""

    name: str
    rejects: Column


def default_rules() -> list[Rule]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    lines = F.size(F.split("text", "\n"))
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 30 * words),
        Rule("word_length", (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 14 * F.col("n_words"))),
        Rule("dup_lines", 100 * F.col("n_dup_lines") > 40 * lines),
        Rule("repeat_words", 100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")),
        Rule("shouting", 100 * chars_of(F.col("text"), "!") > 40 * words),
        Rule("capitals", 100 * F.length(F.regexp_replace("text", r"[^\p{Lu}]", "")) > 60 * F.length("text")),
        Rule("word_runs", F.regexp_count(F.col("text"), F.lit(r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]++)(?:\x20\1(?![^\x20\x09-\x0D])){3,}+")) * 20 > words),
    ]


@dataclass(frozen=True)
class Estimate:
    rule: Rule
    rejected: float
    seconds: float

    @property
    def gain(self) -> float:
        return self.rejected / max(self.seconds, 1e-6)


def estimate(sample: DataFrame, rules: Sequence[Rule]) -> list[Estimate]:
    """Selectivity and time of each rule alone on a small cached sample, best first.

    The time of the empty pass is taken off, so that only a rule's own work counts.
    """
    def timed(test: Column) -> tuple[float, float]:
        began = time.perf_counter()
        row = sample.agg(F.count_if(test).alias("hits"), F.count("*").alias("n")).first()
        return time.perf_counter() - began, row["hits"] / max(row["n"], 1)

    timed(F.lit(False))
    empty, _ = timed(F.lit(False))
    found = []
    for rule in rules:
        seconds, rejected = timed(rule.rejects)
        found.append(Estimate(rule, rejected, max(seconds - empty, 1e-3)))
    return sorted(found, key=lambda e: (-e.gain, e.rule.name))


def cascade(order: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does. Later rules are not evaluated then."""
    chain = None
    for rule in order:
        chain = F.when(rule.rejects, F.lit(rule.name)) if chain is None else chain.when(rule.rejects, F.lit(rule.name))
    return chain if chain is not None else F.lit(None).cast("string")


def apply_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    rules: Sequence[Rule] | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """One row per document: doc_id, measures, base_failed, kept, rejected_by.

    Rules are ordered by rejection per cost, both estimated on a seeded draw of about sample_rows rows of
    the table; the verdict does not depend on the order, only the work and rejected_by do.

    A null text is an empty one and fails the base rules. Repeated rows give repeated rows,
    an empty table an empty result. Other columns are not read.
    """
    rules = list(default_rules() if rules is None else rules)
    rows = measured(docs, id_col, text_col)
    # A seeded draw that stays about sample_rows; a limit would read first rows and move them into one task.
    part = min(1.0, 0.95 * sample_rows / max(1, docs.count()))
    sample = measured(docs.sample(part, seed=8), id_col, text_col).persist()
    order = [e.rule for e in estimate(sample, rules)]
    sample.unpersist()
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", base)
    rows = rows.withColumn("rejected_by", F.when(F.col("base_failed"), F.lit("base")).otherwise(cascade(order)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rejected_by depends on measured times, so it is not part of the result."""
    return apply_rules(table(spark, sf_dir, "documents")).drop("rejected_by")
