"""Small Arrow-batched helpers for what column expressions cannot say. They never raise on bad data."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache, wraps

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from verdance.sources.shared import on_workers

try:
    import regex
except ImportError:  # patterns then run without a time limit
    regex = None
try:
    import ahocorasick
except ImportError:  # terms are then looked for one by one
    ahocorasick = None


def _shipped(helper: Callable[..., Column]) -> Callable[..., Column]:
    """A helper whose Python workers find this package, whoever started the session."""

    @wraps(helper)
    def call(*columns: Column) -> Column:
        on_workers(SparkSession.active())
        return helper(*columns)

    return call


@lru_cache(maxsize=4096)
def _compiled(pattern: str, flags: int = 0):
    try:
        return re.compile(pattern, flags)
    except re.error:
        return None


def _parsed(text: str | None):
    """(error, value) of the whole text, a code fence around it aside, as JSON; error is null if it is."""
    if text is None:
        return "no text", None
    body = text.strip()
    if body.startswith("```"):
        body = re.sub(r"\n?```$", "", re.sub(r"^```\w*\n?", "", body)).strip()
    try:
        return None, json.loads(body)
    except json.JSONDecodeError as wrong:
        return wrong.msg, None
    except (ValueError, RecursionError) as wrong:
        return str(wrong), None


@_shipped
@F.pandas_udf(T.BooleanType())
def valid_json(text: pd.Series) -> pd.Series:
    return text.map(lambda x: _parsed(x)[0] is None).astype(bool)


JSON_FACTS = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("is_object", T.BooleanType()),
        T.StructField("missing", T.ArrayType(T.StringType())),
        T.StructField("size", T.LongType()),
        T.StructField("is_list", T.BooleanType()),
        T.StructField("too_long", T.LongType()),
        T.StructField("chars", T.LongType()),
    ]
)


def json_fact(text: str | None, field: str | None, fields: list[str] | None, most: int | None) -> dict | None:
    """What the JSON checks ask of an answer.

    missing: the fields that the top object lacks. size: entries of the field (without a field or an object: of the
    whole), null where that is no list or object. is_list, too_long: whether the field is a list and how many of its
    items are longer than most. chars: length of the field's value, null where it is absent.
    """
    if text is None:
        return None
    error, value = _parsed(text)
    if error is not None:
        return {"error": error, "is_object": None, "missing": None, "size": None, "is_list": None, "too_long": None, "chars": None}
    top = isinstance(value, dict)
    own = value.get(field) if top and field is not None else None
    target = own if field and top else value
    return {
        "error": None,
        "is_object": top,
        "missing": [f for f in fields if f not in value] if top and fields is not None else None,
        "size": len(target) if isinstance(target, list | dict) else None,
        "is_list": isinstance(own, list),
        "too_long": sum(len(str(x)) > most for x in own) if isinstance(own, list) and most is not None else None,
        "chars": None if own is None else len(str(own)),
    }


def _ints(values: pd.Series) -> list[int | None]:
    return [None if pd.isna(x) else int(x) for x in values]


def _rows(rows: list[dict | None], kind: T.StructType) -> pd.DataFrame:
    names = kind.fieldNames()
    return pd.DataFrame({n: pd.Series([None if r is None else r[n] for r in rows], dtype=object) for n in names})


@_shipped
@F.pandas_udf(JSON_FACTS)
def json_facts(text: pd.Series, field: pd.Series, fields: pd.Series, most: pd.Series) -> pd.DataFrame:
    rows = [json_fact(t, f, None if fs is None else list(fs), m) for t, f, fs, m in zip(text, field, fields, _ints(most), strict=True)]
    return _rows(rows, JSON_FACTS)


#: A pattern runs on one answer for this long, and on answers of at most this many characters; beyond, the verdict is open. What is stopped by time
#: depends on the machine, so the limit is far above what sane patterns take.
REGEX_SECONDS, REGEX_CHARS = 2.0, 4_000_000
STOPPED = "pattern stopped at its limits"

REGEX_FACTS = T.StructType([T.StructField("error", T.StringType()), T.StructField("n", T.LongType()), T.StructField("first", T.StringType())])


@lru_cache(maxsize=4096)
def _bounded(pattern: str, flags: int):
    """(pattern that can be stopped or None, pattern as Python reads it or None). The second decides what is a pattern, so that the dialect is Python's."""
    plain = _compiled(pattern, flags)
    if plain is None or regex is None:
        return None, plain
    try:
        return regex.compile(pattern, (regex.I if flags & re.I else 0) | regex.V0), plain
    except regex.error:
        return None, plain


def regex_fact(text: str, pattern: str, exact: bool, counted: bool, seconds: float = REGEX_SECONDS, chars: int = REGEX_CHARS) -> dict:
    """error, n and first match of a pattern in Python's dialect; n is 0 or 1 unless counted. A pattern that passes the limits is stopped."""
    bounded, plain = _bounded(pattern, 0 if exact else re.I)
    if plain is None:
        return {"error": "bad pattern", "n": None, "first": None}
    if len(text) > chars:
        return {"error": STOPPED, "n": None, "first": None}
    n, first = 0, None
    try:
        found = plain.finditer(text) if bounded is None else bounded.finditer(text, timeout=seconds)
        for m in found:
            n, first = n + 1, m[0] if first is None else first
            if not counted:
                break
    except TimeoutError:
        return {"error": STOPPED, "n": None, "first": None}
    return {"error": None, "n": n, "first": first}


@_shipped
@F.pandas_udf(REGEX_FACTS)
def regex_facts(text: pd.Series, pattern: pd.Series, case_sensitive: pd.Series, counted: pd.Series) -> pd.DataFrame:
    """regex_fact of each row; null without text or pattern."""
    return _rows([None if x is None or p is None else regex_fact(x, p, bool(e), bool(n)) for x, p, e, n in zip(text, pattern, case_sensitive, counted, strict=True)], REGEX_FACTS)


def heading_offset(text: str | None, heading: str | None, case_sensitive: bool) -> int | None:
    """Where a line that is the heading begins: a markdown heading first, else a line of it alone with an optional number and colon."""
    name = re.escape((heading or "").strip())
    if text is None or not name:
        return None
    for pattern in (rf"^\s*#{{1,6}}\s+{name}\s*$", rf"^\s*(?:\d+[.)]\s*)?{name}\s*:?\s*$"):
        if (m := _compiled(pattern, re.M if case_sensitive else re.M | re.I).search(text)) is not None:
            return m.start()
    return None


@_shipped
@F.pandas_udf(T.ArrayType(T.LongType()))
def heading_positions(text: pd.Series, headings: pd.Series, case_sensitive: pd.Series) -> pd.Series:
    """The offsets of some headings; null where one is missing."""
    return pd.Series([None if x is None or hs is None else [heading_offset(x, h, bool(c)) for h in hs] for x, hs, c in zip(text, headings, case_sensitive, strict=True)], dtype=object)


def heading_position(text: Column, heading: Column, case_sensitive: Column | None = None) -> Column:
    return heading_positions(text, F.array(heading), F.lit(False) if case_sensitive is None else case_sensitive)[0]


def missing_labels(text: str, names: list[str]) -> list[str]:
    """The labels that neither open a line with a colon or bar behind them (in any case) nor occur as they are."""
    return [n for n in names if n not in text and _compiled(rf"^\s*(?:[-*]\s*)?{re.escape(n)}\s*[:|]", re.I | re.M).search(text) is None]


@_shipped
@F.pandas_udf(T.ArrayType(T.StringType()))
def labels_missing(text: pd.Series, labels: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or names is None else missing_labels(x, list(names)) for x, names in zip(text, labels, strict=True)], dtype=object)


@lru_cache(maxsize=256)
def _automaton(terms: frozenset[str]):
    """One automaton for all terms; None where there is nothing to look for."""
    found = ahocorasick.Automaton()
    for term in terms:
        found.add_word(term, term)
    if len(found):
        found.make_automaton()
        return found
    return None


def terms_inside(text: str, terms: frozenset[str]) -> set[str]:
    """The terms that occur in the text, all of them looked for in one pass over it. An empty term is in every text."""
    if ahocorasick is None:
        return {t for t in terms if t in text}
    automaton = _automaton(terms - {""})
    return (terms & {""}) | ({t for _, t in automaton.iter(text)} if automaton is not None else set())


ANSWER_FACTS = T.StructType([
    *REGEX_FACTS.fields, *JSON_FACTS.fields[1:], T.StructField("places", T.ArrayType(T.LongType())), T.StructField("unlabelled", T.ArrayType(T.StringType())), T.StructField("present", T.ArrayType(T.BooleanType())),
])
_FACTS = to_arrow_type(T.ArrayType(ANSWER_FACTS))
_NO_FACTS = dict.fromkeys(ANSWER_FACTS.fieldNames())


def answer_fact(text: str, ask: dict | None) -> dict | None:
    """What one constraint asks of an answer: a pattern (search, count, or before a heading), the places of headings, JSON, or fields as JSON and as labels."""
    if ask is None:
        return None
    kind, exact = ask["kind"], bool(ask["exact"])
    if kind == "places":
        return _NO_FACTS | {"places": [heading_offset(text, h, exact) for h in ask["headings"] or []]}
    if kind in ("json", "fields"):
        found = json_fact(text, ask["field"], ask["fields"], ask["most"])
        return _NO_FACTS | found | ({"unlabelled": missing_labels(text, ask["fields"] or [])} if kind == "fields" else {})
    if ask["pattern"] is None:
        return None
    at = heading_offset(text, ask["headings"][0], exact) if kind == "before" else None
    return _NO_FACTS | regex_fact(text if at is None else text[:at], ask["pattern"], exact, kind == "count")


def facts_of(text: str, asks: list[dict | None]) -> list[dict | None]:
    """answer_fact of each ask; the terms of all of them are looked for together, once in the text and once in the casefolded one."""
    inside, out = {}, []
    for exact in (True, False):
        terms = frozenset(t if exact else t.casefold() for a in asks if a is not None and a["kind"] == "terms" and bool(a["exact"]) == exact for t in a["fields"] or [] if t is not None)
        inside[exact] = terms_inside(text if exact else text.casefold(), terms) if terms else set()
    for a in asks:
        if a is not None and a["kind"] == "terms":
            own = inside[bool(a["exact"])]
            out.append(_NO_FACTS | {"present": [t is not None and (t if a["exact"] else t.casefold()) in own for t in a["fields"] or []]})
        else:
            out.append(answer_fact(text, a))
    return out


_NOTHING = dict.fromkeys(("kind", "exact", "pattern", "field", "fields", "most", "headings"))


@lru_cache(maxsize=512)
def ask_of(written: str) -> dict | None:
    """What one constraint asks, written as JSON; empty for nothing. Few are distinct, so they are read once."""
    return _NOTHING | json.loads(written) if written else None


@_shipped
@F.arrow_udf(T.ArrayType(ANSWER_FACTS))
def answer_facts(text: pa.Array, asks: pa.Array) -> pa.Array:
    """Facts of each answer, one for each of its constraints (null for those that ask nothing). asks: a line of JSON for each constraint.

    Asks come as one text and not as nested columns: Spark works out a batch's size after each row, which for lists of structs takes longer than the checks."""
    return pa.array([None if t is None or own is None else facts_of(t, [ask_of(x) for x in own.split("\n")]) for t, own in zip(text.to_pylist(), asks.to_pylist(), strict=True)], _FACTS)


#: A number counted in one of these units is no measured value.
COUNTED = "年月日号期季届次个条只家人份款项批组套件篇章节段点步"
_DECIMAL = re.compile(r"(\d[\d,]*)\.(\d+)(\s*)(%|％|[^\d\s,.;:!?。，；：！？\n])?")


def fixed_decimals(text: str | None, places: int | None) -> str | None:
    """Decimals padded or cut (never rounded) to a number of places.

    Headings, table separators, counted units and what looks like a section number (at most two digits on either side,
    before Chinese text) stay. Where a number changes, the space between it and its unit goes.
    """
    if text is None or places is None:
        return text

    def line_fixed(line: str) -> str:
        if re.match(r"\s*#{1,6}\s", line) or re.match(r"\s*\|[\s\-:]+\|", line):
            return line

        def number(m: re.Match) -> str:
            whole, part, _, unit = m.groups()
            follows = line[m.end() : m.end() + 5]
            section = len(whole) <= 2 and len(part) <= 2 and re.match(r"\s*[一-鿿]", follows)
            if (unit and unit in COUNTED) or section or len(part) == places:
                return m[0]
            return f"{whole}.{part[:places].ljust(places, '0')}{unit or ''}"

        return _DECIMAL.sub(number, line)

    return "\n".join(line_fixed(x) for x in text.split("\n"))


@_shipped
@F.pandas_udf(T.StringType())
def fix_decimals(text: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([fixed_decimals(x, n) for x, n in zip(text, _ints(places), strict=True)], dtype=object)


#: Label, number and unit, in the order in which they are looked for.
LABELLED = (
    r"([一-鿿]{2,10}(?:为|达|约|共计|合计|共|累计))\s*([-+]?[\d,]+\.?\d*)\s*(万元|亿元|万股|%|％|元)",
    r"([一-鿿]{2,8})[：:]\s*([-+]?[\d,]+\.?\d*)\s*(万元|亿元|万股|%|％|元)",
    r"\|\s*([一-鿿]{2,10})\s*\|\s*([-+]?[\d,]+\.?\d*)\s*(万元|亿元|%|％|元)?\s*\|",
    r"([一-鿿]{2,6})\s+([-+]?[\d,]+\.?\d*)\s*(万元|亿元|万股|%|％)",
    r"([一-鿿]{2,8})\s*([\d,]{4,})\s*(股|万元|亿元|元)",
    r"([一-鿿]{2,8}(?:比例|占比|持股))[^\d]{0,5}([\d.]+)\s*(%|％)",
)


def labelled(text: str | None, most: int = 15) -> dict[str, str]:
    """Label to number and unit. A later match overwrites; the search ends with the match that makes `most` labels."""
    found: dict[str, str] = {}
    for pattern in LABELLED:
        for m in _compiled(pattern).finditer(text or ""):
            value = m[2].replace(",", "")
            if m[1].strip() and value:
                found[m[1].strip()] = value + (m[3] or "")
            if len(found) >= most:
                return found
    return found


@_shipped
@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def labelled_values(text: pd.Series) -> pd.Series:
    return text.map(labelled)


JUDGED = T.StructType(
    [
        T.StructField("error", T.StringType()),
        T.StructField("scores", T.ArrayType(T.StructType([T.StructField("constraint_index", T.LongType()), T.StructField("score", T.LongType()), T.StructField("reason", T.StringType())]))),
        T.StructField("quality_score", T.LongType()),
        T.StructField("quality_reason", T.StringType()),
    ]
)


def _whole(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool)


def parse_judge(raw: str | None, expected: list[int]) -> dict:
    """Strict reading of a judge's answer; the first thing wrong with it is its error."""
    error, value = _parsed(raw)
    wrong = lambda why: {"error": why, "scores": None, "quality_score": None, "quality_reason": None}
    if error is not None:
        return wrong("not_json")
    if not isinstance(value, dict):
        return wrong("not_object")
    rows = value.get("constraint_scores")
    if not isinstance(rows, list):
        return wrong("no_list")
    seen: dict[int, dict] = {}
    for row in rows:
        if not isinstance(row, dict) or not _whole(row.get("constraint_index")):
            return wrong("bad_index")
        index, score, reason = row["constraint_index"], row.get("score"), row.get("reason")
        if index not in expected:
            return wrong("unexpected_index")
        if index in seen:
            return wrong("duplicate_index")
        if isinstance(score, bool) or score not in (0, 1):
            return wrong("bad_score")
        if not isinstance(reason, str) or not reason.strip():
            return wrong("empty_reason")
        seen[index] = {"constraint_index": index, "score": int(score), "reason": reason.strip()}
    if set(expected) - set(seen):
        return wrong("missing_index")
    quality = value.get("quality_score")
    if not _whole(quality) or not 0 <= quality <= 10:
        return wrong("bad_quality")
    why = value.get("quality_reason")
    if not isinstance(why, str) or not why.strip():
        return wrong("empty_quality_reason")
    return {"error": None, "scores": [seen[i] for i in sorted(seen)], "quality_score": quality, "quality_reason": why.strip()}


@_shipped
@F.pandas_udf(JUDGED)
def judged(raw: pd.Series, expected: pd.Series) -> pd.DataFrame:
    rows = [parse_judge(r, [] if e is None else [int(i) for i in e]) for r, e in zip(raw, expected, strict=True)]
    return pd.DataFrame(rows, columns=[f.name for f in JUDGED.fields])


@_shipped
@F.pandas_udf(T.BooleanType())
def judge_lenient(raw: pd.Series) -> pd.Series:
    """The pass flag of a judge's answer, by pattern where the JSON is broken; null if there is none."""

    def one(x):
        error, value = _parsed(x)
        if error is None and isinstance(value, dict) and "pass" in value:
            return bool(value["pass"])
        m = re.search(r'"pass"\s*:\s*(true|false)', x or "", re.I)
        return m[1].lower() == "true" if m else None

    return pd.Series([one(x) for x in raw], dtype="boolean")


def balanced_cuts(sizes: list[int], least: int, most: int) -> list[int]:
    """Where to cut a row of paragraphs: the end (exclusive) of each piece.

    Of all cuts into pieces of at most `most` (a larger paragraph is a piece of its own) those with the fewest pieces outside least..most; of these the ones
    with the smallest sum of squares of what they lack; of these the fewest pieces; of these the earliest ends. From back to front, each start looks at the ends within reach.
    """
    n = len(sizes)
    best: list[tuple] = [(0, 0, 0, n)] * (n + 1)
    for i in range(n - 1, -1, -1):
        total, found = 0, None
        for j in range(i + 1, n + 1):
            total += sizes[j - 1]
            if total > most and j > i + 1:
                break
            lack = max(0, least - total)
            rest = best[j]
            one = (rest[0] + (not least <= total <= most), rest[1] + lack * lack, rest[2] + 1, j)
            found = one if found is None or one < found else found
        best[i] = found
    out, at = [], 0
    while at < n:
        at = best[at][3]
        out.append(at)
    return out


def cuts_within(least: int, most: int):
    """A function of a column of sizes: balanced_cuts of each."""

    @_shipped
    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def cuts(sizes: pa.Array) -> pa.Array:
        return pa.array([None if x is None else balanced_cuts(x, least, most) for x in sizes.to_pylist()], pa.list_(pa.int32()))

    return cuts


_CODES = {n: re.compile(p) for n, p in {
    "words": r"\w[\w'-]*",
    "mixed_words": r"[一-鿿]|[A-Za-z]+",
    "headings": r"(?m)^\s{0,3}#{1,6}\s+\S+",
    "labels": r"(?m)^\s*(?:\d+[.)]\s*)?\w[\w\s/&-]{1,80}:\s*$",
    "list_items": r"(?m)^\s*(?:[-*•]|\d+[.)])\s+\S+",
    "ordered_items": r"(?m)^\s*\d+[.)]\s+\S+",
    "quotes": r"(?m)^\s*>\s+\S+",
    "sentence_ends": r"[。！？!?]+|(?<=[A-Za-z0-9][.])\s+",
    "blank": r"\n\s*\n",
    "alone": r"#{1,6}\s+\S|\*\*[^*].*\*\*$",
    "depth": r"\s{0,3}(#{1,6})\s+\S",
    "separator": r"\|\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?$",
}.items()}


def _counted(name: str):
    return lambda text: len(_CODES[name].findall(text))


def _paragraphs(text: str) -> int:
    n = 0
    for block in _CODES["blank"].split(text.strip()):
        own = [x for x in map(str.strip, block.splitlines()) if x]
        n += bool(own) and not (len(own) == 1 and _CODES["alone"].match(own[0]))
    return n


def _has_table(text: str) -> bool:
    own = [x for x in map(str.strip, text.splitlines()) if x[:1] == "|" and x[-1:] == "|"] if "|" in text else []
    return len(own) >= 2 and any(map(_CODES["separator"].match, own))


#: What measures.py says of an answer as columns, counted in one go.
COUNTS = {
    "n_chars": len,
    "words": _counted("words"),
    "mixed_words": _counted("mixed_words"),
    "ws_words": lambda text: len(text.split()),
    "sections": lambda text: _counted("headings")(text) or _counted("labels")(text),
    "list_items": _counted("list_items"),
    "ordered_items": _counted("ordered_items"),
    "paragraphs": _paragraphs,
    "sentences": lambda text: sum(len(x.strip()) > 5 for x in _CODES["sentence_ends"].split(text)),
    "quotes": _counted("quotes"),
    "code_blocks": lambda text: text.count("```") // 2,
    "heading_depth": lambda text: len({m[1] for m in map(_CODES["depth"].match, text.splitlines()) if m}) if "#" in text else 0,
    "has_table": _has_table,
}


@lru_cache(maxsize=256)
def counts_of(*names: str):
    """A function of a text column: a struct of the named COUNTS, null for a null text. Java's patterns with Unicode classes take some ten times as long."""
    fields = [T.StructField(n, T.BooleanType() if n == "has_table" else T.LongType()) for n in names]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    @_shipped
    @F.arrow_udf(T.StructType(fields))
    def counted(text: pa.Array) -> pa.Array:
        texts = text.to_pylist()
        columns = [pa.array([None if x is None else COUNTS[n](x) for x in texts], k) for n, k in zip(names, kinds, strict=True)]
        return pa.StructArray.from_arrays(columns, names=list(names), mask=text.is_null())

    return counted
