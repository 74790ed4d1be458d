"""Many terms by one automaton, few one by one: the same verdicts. Workers that nobody told where the package lies."""

import json
import os
import random
import subprocess
import sys

from verdance.functions import helpers as H
from verdance.operators import checkers as K


def test_terms_inside_equals_contains():
    r = random.Random(4)
    word = lambda: "".join(r.choice("abc é") for _ in range(r.randint(0, 4)))
    for _ in range(200):
        text, terms = "".join(word() for _ in range(30)), frozenset(word() for _ in range(40))
        assert H.terms_inside(text, terms) == {t for t in terms if t in text}
    assert H.terms_inside("x", frozenset()) == set()


def test_automaton_and_single_terms_agree(spark, monkeypatch):
    r = random.Random(9)
    words = ["Straße", "STRASSE", "aa", "a", "İx", "ΣΑΣ", "σας", "b c", "é", "", "Q"]
    answers = spark.createDataFrame([(i, " ".join(r.choice(words) for _ in range(6))) for i in range(12)], "item_id int, response string")
    rows = []
    for i in range(12):
        for k, (name, keys) in enumerate({"required_keyword": "keywords", "forbidden_phrase": "phrases", "keyword_presence": "required_keywords", "keyword_absence": "forbidden_keywords"}.items()):
            for exact in ("true", "false"):
                terms = [r.choice(words[:9]) for _ in range(r.randint(1, 4))]
                rows.append((i, 2 * k + (exact == "true"), "rule", name, {keys: json.dumps(terms, ensure_ascii=False), "case_sensitive": exact, "match_all": r.choice(["true", "false"])}))
    rules = spark.createDataFrame(rows, "item_id int, constraint_index long, check_type string, checker string, settings map<string,string>")
    verdicts = []
    for many in (0, 1000):
        monkeypatch.setattr(K, "MANY_TERMS", many)
        verdicts.append(sorted((x.item_id, x.constraint_index, x.score, x.reason) for x in K.evaluate(answers, rules).collect()))
    assert verdicts[0] == verdicts[1] and len(verdicts[0]) == 96
    assert {v[2] for v in verdicts[0]} == {0, 1}


def test_workers_find_the_package(tmp_path):
    """A session from another folder, without PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.local.dir", {str(tmp_path)!r}).getOrCreate()
from verdance.operators.checkers import check
from verdance.functions import helpers as H
df = spark.createDataFrame([("ab 1.5",)], "t string")
print([tuple(r) for r in df.select(check(F.col("t"), "simple_regex", {{"pattern": "a"}}).alias("a"), H.fix_decimals("t", F.lit(2)).alias("b")).collect()])
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    found = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "[(1, 'ab 1.50')]" in found.stdout, found.stderr[-2000:]
