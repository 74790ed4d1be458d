"""Counts that the Arrow helper takes in one go against the same measures as columns."""

import random

from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.functions import measures as M

NATIVE = {
    "n_chars": lambda t: F.length(t).cast("long"), "words": M.word_count, "mixed_words": M.mixed_word_count, "ws_words": M.ws_word_count, "sections": M.section_count, "list_items": M.item_list_count,
    "ordered_items": M.ordered_count, "paragraphs": M.paragraph_measure, "sentences": M.sentence_measure, "quotes": M.blockquote_measure, "code_blocks": M.code_block_measure,
    "heading_depth": M.heading_depth_measure, "has_table": M.has_table,
}
PARTS = ["# Head", "##x", "   ### deep", "    #### far", "- item", "-", "* b", "•\tc", "12) d", "3. e", "٣. f", "> quote", ">", "Label one:", "9. A & b/c :", "x:", "|a|b|", "| --- | :-: |", "|---|", "```", "**bold**", "** no", "word's a-b 'q'",
         "你好。再见！", "Short. Longer sentence here? Yes!", "e.g. this", "　wide", "\x85", "\x1c", " ", "é_1", "áb", "[ ] t", "", " ", "\t", "- - x", "1.", "?", "İß"]


def test_counts_equal_the_measures(spark):
    r = random.Random(8)
    texts = ["", None, "\n", " \n\n ", "#" * 7 + " x", "x" * 200_000, " " * 20_000 + "x"]
    texts += ["".join(r.choice(PARTS) + r.choice(["\n", "\n", "\n", "\n\n", "\r\n", " ", "  ", ""]) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(4)
    got = {x[0]: tuple(x)[1:] for x in table.select("i", *M.response_profile(F.col("t"))).collect()}
    want = {x[0]: tuple(x)[1:] for x in table.where("t is not null").select("i", *[NATIVE[n](F.col("t")).alias(n) for n in H.COUNTS]).collect()}
    wrong = [(texts[i], dict(zip(H.COUNTS, zip(got[i], w))), ) for i, w in want.items() if got[i] != w]
    assert not wrong, wrong[:2]
    assert got[1] == (None,) * len(H.COUNTS)


def test_patterns_are_stopped(spark):
    bad = "(a+)+$"
    assert H.regex_fact("a" * 10_000 + "b", bad, True, False, seconds=0.2)["error"] == H.STOPPED
    assert H.regex_fact("x" * 11, "x", True, False, chars=10)["error"] == H.STOPPED
    assert H.regex_fact("aab AB", "ab", False, True) == {"error": None, "n": 2, "first": "ab"}
    assert H.regex_fact("aab", "(", True, True)["error"] == "bad pattern"
    # What Python refuses is refused, though the bounded matcher would read it.
    assert H.regex_fact("ab", "a(?i)b", True, False)["error"] == "bad pattern"
