"""The checkers: name -> verdict on an answer by the settings of a constraint.

A verdict is a struct of score (1 pass, 0 fail, null: a judge must decide), reason and method. Settings are a map column,
so every constraint brings its own; one plan serves them all. Limits follow three readings: a chain of
settings in which 0 is unset, plain settings where 0 counts, and none at all, which leaves the verdict open.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.functions import measures as M
from verdance.sources.shared import cut

from .keys import has_explicit_config, layered_config, named_checker, route_constraints
from .settings import EMPTY, ReadSettings, Settings, Slots, as_map, python_text

#: Phrases, terms and units that checkers look for where no setting names others.
REPORT_PHRASES = ("本报告", "本文", "本分析", "本研究", "报告认为", "分析认为")
RISK_LINE = "以上内容仅供参考，不构成投资建议"
RISK_TERMS = ("风险提示", "免责声明", "仅供参考", "不构成投资建议")
CURRENCY_UNITS = ("万元", "亿元", "百万元", "千万元", "元", "万亿元", "万亿", "百万", "千万")
PERCENT_TARGETS = ("percent", "percentage", "percentages", "percent_only")


class Answer:
    """An answer's text and what is measured on it; measures that a table has as columns are taken from there."""

    def __init__(self, text: Column, columns: Mapping[str, Column] | None = None):
        self.text = F.coalesce(text, F.lit(""))
        self.columns = columns or {}

    def __getattr__(self, name: str) -> Column:
        if name in MEASURES:
            return self.columns[name] if name in self.columns else MEASURES[name][0](self.text)
        raise AttributeError(name)

    def headings(self, level: Column) -> Column:
        return M.heading_level_measure(self.text, level)

    def regex(self, kind: str, text: Column, pattern: Column, case_sensitive: Column) -> Column:
        return self.columns["facts"] if "facts" in self.columns else H.regex_facts(text, pattern, case_sensitive, F.lit(kind == "count"))

    def regex_before(self, pattern: Column, heading: Column, case_sensitive: Column) -> Column:
        """The pattern in the text before a heading; in all of it where there is none."""
        if "facts" in self.columns:
            return self.columns["facts"]
        at = self.places(F.array(heading), case_sensitive)[0]
        return self.regex("search", F.when(at.isNull(), self.text).otherwise(F.substring(self.text, F.lit(1), at.cast("int"))), pattern, case_sensitive)

    def json(self, field: Column, fields: Column, most: Column) -> Column:
        return self.columns["facts"] if "facts" in self.columns else H.json_facts(self.text, field, fields, most.cast("long"))

    def places(self, headings: Column, case_sensitive: Column) -> Column:
        return self.columns["facts"]["places"] if "facts" in self.columns else H.heading_positions(self.text, headings, case_sensitive)

    def unlabelled(self, labels: Column) -> Column:
        return self.columns["facts"]["unlabelled"] if "facts" in self.columns else H.labels_missing(self.text, labels)


#: name -> (measure, the checkers that look at it)
MEASURES: dict[str, tuple[Callable[[Column], Column], tuple[str, ...]]] = {
    "folded": (M.fold, ("required_keyword", "forbidden_phrase", "conditional_trigger")),
    "words": (M.word_count, ("min_words", "max_words")),
    "mixed_words": (M.mixed_word_count, ("word_range",)),
    "sections": (M.section_count, ("min_sections", "max_sections")),
    "items": (M.item_list_count, ("item_count",)),
    "ordered": (M.ordered_count, ("ordered_list_count",)),
    "paragraphs": (M.paragraph_measure, ("paragraph_count",)),
    "sentences": (M.sentence_measure, ("sentence_count",)),
    "quotes": (M.blockquote_measure, ("blockquote_count",)),
    "lines": (M.nonblank, ("first_line", "first_line_format", "last_line", "first_last_line", "risk_disclaimer")),
    "table": (M.table_lines, ("markdown_table", "no_table", "table_columns", "table_row_count")),
    "flat": (M.canonical_number, ("contains_number", "threshold", "deadline", "exact_value")),
    "numbers": (M.extract_numbers, ("contains_number", "threshold")),
    "depth": (M.heading_depth_measure, ("heading_depth",)),
}

#: Measures that are counts -> their name among helpers.COUNTS, which takes all that are wanted in one go.
COUNTED = {"words": "words", "mixed_words": "mixed_words", "sections": "sections", "items": "list_items", "ordered": "ordered_items", "paragraphs": "paragraphs", "sentences": "sentences", "quotes": "quotes", "depth": "heading_depth"}

Checker = Callable[[Answer, Settings], Column]
CHECKERS: dict[str, Checker] = {}
#: Checkers of one's own, which read the map of settings themselves.
CUSTOM: set[str] = set()


def register_checker(name: str):
    """Adds a checker of one's own: fn(response, config) -> boolean Column, null where a judge must decide."""

    def add(fn: Callable[[Column, Column], Column]):
        CUSTOM.add(name)
        CHECKERS[name] = lambda a, c: verdict(fn(a.text, c.config).isNotNull(), fn(a.text, c.config), F.lit(name))
        return fn

    return add


def _checker(*names: str):
    def add(fn: Checker) -> Checker:
        for name in names:
            CHECKERS[name] = fn
        return fn

    return add


def text_of(x: Column | str | int) -> Column:
    return x.cast("string") if isinstance(x, Column) else F.lit(str(x))


def say(*parts: Column | str | int) -> Column:
    """Parts one after the other; null ones are empty."""
    return F.concat(*[F.coalesce(text_of(p), F.lit("")) for p in parts])


def verdict(ready: Column | None, passed: Column, detail: Column) -> Column:
    """Open until ready; the reason gives what was measured or missing."""
    ok = F.coalesce(passed, F.lit(False))
    out = F.struct(ok.cast("int").alias("score"), F.concat(F.when(ok, "met: ").otherwise("not met: "), F.coalesce(detail, F.lit(""))).alias("reason"))
    return out if ready is None else F.when(ready, out)


def within(value: Column, exact: Column, low: Column, high: Column, what: str) -> Column:
    """All limits that are given must hold; none given leaves the verdict open."""
    ready = F.coalesce(exact, low, high).isNotNull()
    ok = F.coalesce(value == exact, F.lit(True)) & F.coalesce(value >= low, F.lit(True)) & F.coalesce(value <= high, F.lit(True))
    wanted = F.concat_ws(", ", F.concat(F.lit("exactly "), exact.cast("string")), F.concat(F.lit("at least "), low.cast("string")), F.concat(F.lit("at most "), high.cast("string")))
    return verdict(ready, ok, say(value, f" {what}, wanted ", wanted))


def limited(value: Column, c: Settings, what: str) -> Column:
    return within(value, c.either("exact_count", "exact"), c.either("min_count", "min"), c.either("max_count", "max"), what)


def none_of(listed: Column, ready: Column | None, what: str) -> Column:
    """Passes if the list of faults is empty."""
    judged = M.bind(listed, lambda faults: verdict(None, F.size(faults) == 0, F.when(F.size(faults) == 0, f"no {what}").otherwise(say(f"{what}: ", F.array_join(faults, ", ")))))
    return judged if ready is None else F.when(ready, judged)


#: A constraint with more terms than this has them looked for by one automaton, in one pass over the answer; fewer are faster one by one.
MANY_TERMS = 32


def with_presence(a: Answer, c: Settings, name: str, terms: Callable[[Settings], Column], one_by_one: Callable[[Column], Column], use: Callable[[Column], Column]) -> Column:
    """use(present), an array of whether each term occurs: one_by_one(terms), or the automaton's facts where these are known."""
    own = c.derived("lists", name, terms)
    if "facts" not in a.columns:
        return M.bind(one_by_one(own), use)
    return M.bind(F.coalesce(a.columns["facts"]["present"], one_by_one(own)), use)


def keyword_list(*keys: str) -> Callable[[Settings], Column]:
    return lambda s: s.listed(*keys)


def folded_search(a: Answer, c: Settings, name: str, terms: Callable[[Settings], Column], absent: bool) -> Column:
    """The terms that are absent (or present), case-folded unless case_sensitive."""
    needles = c.derived("lists", f"{name} to find", lambda s: F.when(s.flag("case_sensitive"), terms(s)).otherwise(F.transform(terms(s), M.fold)))
    hay = F.when(c.flag("case_sensitive"), a.text).otherwise(a.folded)
    one_by_one = lambda _: M.bind(hay, lambda h: F.transform(needles, lambda n: h.contains(n)))
    own = c.derived("lists", name, terms)
    return with_presence(a, c, name, terms, one_by_one, lambda present: F.filter(own, lambda _, i: F.get(present, i) != F.lit(absent)))


def exact_search(a: Answer, c: Settings, name: str, terms: Callable[[Settings], Column], absent: bool) -> Column:
    """The terms that are absent (or present) as they are written."""
    own = c.derived("lists", name, terms)
    return with_presence(a, c, name, terms, lambda ts: F.transform(ts, lambda t: a.text.contains(t)), lambda present: F.filter(own, lambda _, i: F.get(present, i) != F.lit(absent)))


#: The terms that checkers look for: name of the slot and where they are read.
TERMS: dict[str, tuple[str, Callable[[Settings], Column]]] = {
    "required_keyword": ("keywords", lambda s: s.listed_or_quoted("keywords", "keyword")),
    "forbidden_phrase": ("phrases", lambda s: s.listed_or_quoted("phrases", "phrase", "keywords")),
    "keyword_presence": ("present", keyword_list("required_keywords", "keywords")),
    "keyword_absence": ("forbidden", keyword_list("forbidden_keywords", "forbidden", "phrases")),
}


def any_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests)


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


@_checker("required_keyword")
def _(a: Answer, c: Settings) -> Column:
    terms = TERMS["required_keyword"]
    return none_of(folded_search(a, c, *terms, True), F.size(c.derived("lists", *terms)) > 0, "missing keyword")


@_checker("forbidden_phrase")
def _(a: Answer, c: Settings) -> Column:
    terms = TERMS["forbidden_phrase"]
    return none_of(folded_search(a, c, *terms, False), F.size(c.derived("lists", *terms)) > 0, "forbidden phrase")


@_checker("min_words")
def _(a: Answer, c: Settings) -> Column:
    none = F.lit(None).cast("long")
    return within(a.words, none, c.derived("numbers", "least", lambda s: F.coalesce(F.nullif(s.number("min"), F.lit(0)), M.infer_min_words(s.wording))), none, "words")


@_checker("max_words")
def _(a: Answer, c: Settings) -> Column:
    none = F.lit(None).cast("long")
    return within(a.words, none, none, c.derived("numbers", "most", lambda s: F.coalesce(F.nullif(s.number("max"), F.lit(0)), M.infer_max_words(s.wording))), "words")


@_checker("word_range")
def _(a: Answer, c: Settings) -> Column:
    has = lambda s, x: F.map_contains_key(s.config, F.lit(x))
    first = lambda x, y: c.derived("numbers", x, lambda s: F.when(has(s, x), s.number(x)).otherwise(s.number(y)))
    given = lambda x, y: c.derived("flags", x, lambda s: F.when(has(s, x), s.raw(x)).otherwise(s.raw(y)).isNotNull())
    low, high = first("min_words", "min"), first("max_words", "max")
    unread = (given("min_words", "min") & low.isNull()) | (given("max_words", "max") & high.isNull())
    return F.when(~unread, within(a.mixed_words, F.lit(None).cast("long"), low, high, "words and CJK characters"))


@_checker("min_sections")
def _(a: Answer, c: Settings) -> Column:
    none = F.lit(None).cast("long")
    return within(a.sections, none, F.coalesce(c.number("min"), F.nullif(F.size(c.quoted()), F.lit(0)).cast("long")), none, "sections")


@_checker("max_sections")
def _(a: Answer, c: Settings) -> Column:
    none = F.lit(None).cast("long")
    return within(a.sections, none, none, c.number("max"), "sections")


@_checker("section_titles")
def _(a: Answer, c: Settings) -> Column:
    own = lambda s: F.filter(F.transform(s.listed("required_titles", "headings", "fields"), M.strip), lambda t: t != "")
    titles = c.derived("lists", "titles", lambda s: F.when(F.size(own(s)) > 0, own(s)).otherwise(s.quoted()))
    return none_of(F.filter(titles, lambda t: ~a.text.contains(t)), F.size(titles) > 0, "missing title")


@_checker("item_count")
def _(a: Answer, c: Settings) -> Column:
    own = c.either("count", "min")
    said = rf"(?iu)(exactly|at least){M.S}+({M.D}+){M.S}+(?:items?|findings?|bullets?|points?)"
    target = F.coalesce(own, c.derived("numbers", "said", lambda s: F.nullif(F.regexp_extract(s.wording, said, 2), F.lit("")).cast("long")))
    mode = F.when(own.isNotNull(), F.lower(F.coalesce(c.given("mode"), F.lit("exact")))).otherwise(c.derived("texts", "said", lambda s: F.lower(F.regexp_extract(s.wording, said, 1))))
    least = mode.isin("at_least", "minimum", "min", "at least")
    return verdict(target.isNotNull(), F.when(least, a.items >= target).otherwise(a.items == target), say(a.items, " items, wanted ", F.when(least, "at least ").otherwise("exactly "), target))


@_checker("ordered_list_count")
def _(a: Answer, c: Settings) -> Column:
    return limited(a.ordered, c, "numbered items")


@_checker("no_list")
def _(a: Answer, c: Settings) -> Column:
    return verdict(None, ~a.text.rlike(M.BULLET), F.lit("list items"))


@_checker("paragraph_count")
def _(a: Answer, c: Settings) -> Column:
    return limited(a.paragraphs, c, "paragraphs")


@_checker("sentence_count")
def _(a: Answer, c: Settings) -> Column:
    return limited(a.sentences, c, "sentences")


def no_field() -> Column:
    return F.lit(None).cast("string")


def no_fields() -> Column:
    return F.expr(EMPTY)


def json_field(c: Settings) -> tuple[Column, Column]:
    """(field, most characters) of the checks of one JSON field."""
    return c.raw("field"), c.either("max_chars", "max")


def required_fields(c: Settings) -> Column:
    return c.listed_or_quoted("required_fields", "fields")


@_checker("valid_json")
def _(a: Answer, c: Settings) -> Column:
    facts = a.json(no_field(), no_fields(), F.lit(None))
    return verdict(None, facts["error"].isNull(), say("JSON: ", F.coalesce(facts["error"], F.lit("valid"))))


@_checker("required_fields")
def _(a: Answer, c: Settings) -> Column:
    fields = required_fields(c)
    ready = F.size(fields) > 0
    facts = a.json(no_field(), fields, F.lit(None))
    as_json = F.when(facts["error"].isNotNull() | ~facts["is_object"], verdict(ready, F.lit(False), say("no JSON object: ", facts["error"]))).otherwise(none_of(facts["missing"], ready, "missing field"))
    is_json = F.coalesce((c.raw("format") == "json") | (named_checker(c.given("type", "checker_type", "name", "method")) == "valid_json"), F.lit(False))
    return F.when(is_json, as_json).otherwise(none_of(a.unlabelled(fields), ready, "missing field"))


@_checker("json_field_count")
def _(a: Answer, c: Settings) -> Column:
    exact = c.either("exact_count", "exact")
    facts = a.json(c.given("field"), no_fields(), F.lit(None))
    return verdict(exact.isNotNull(), facts["size"] == exact, say("JSON target of ", F.coalesce(facts["size"].cast("string"), facts["error"], F.lit("no")), " entries, wanted ", exact))


@_checker("json_field_item_limit")
def _(a: Answer, c: Settings) -> Column:
    field, most = json_field(c)
    facts = a.json(field, no_fields(), most)
    return verdict(field.isNotNull() & most.isNotNull(), facts["is_list"] & (facts["too_long"] == 0), say(F.coalesce(facts["error"], facts["too_long"].cast("string"), F.lit("no list, not")), " items of ", field, " above ", most, " characters"))


@_checker("json_field_word_limit")
def _(a: Answer, c: Settings) -> Column:
    field, most = json_field(c)
    facts = a.json(field, no_fields(), most)
    fits = facts["error"].isNull() & (facts["chars"].isNull() | (facts["chars"] <= most))
    return verdict(field.isNotNull() & most.isNotNull(), fits, say(field, " of ", F.coalesce(facts["error"], facts["chars"].cast("string"), F.lit("no")), " characters, wanted at most ", most))


@_checker("markdown_table")
def _(a: Answer, c: Settings) -> Column:
    return verdict(None, M.is_table(a.table), F.lit("Markdown table"))


@_checker("no_table")
def _(a: Answer, c: Settings) -> Column:
    return verdict(None, ~M.is_table(a.table), F.lit("no Markdown table"))


@_checker("table_columns")
def _(a: Answer, c: Settings) -> Column:
    def named(s: Settings) -> Column:
        own = s.listed_or_quoted("required_columns", "columns")
        return M.bind(own, lambda names: F.when(F.size(names) > 0, names).otherwise(F.coalesce(M.infer_table_columns(s.wording), F.expr(EMPTY))))

    def judged(table: Column, wanted: Column) -> Column:
        # Where settings are not read before, the names are those at hand.
        plain = c.derived("lists", "plain columns", lambda s: F.transform(wanted if s is c else named(s), M.plain))
        ready = F.size(wanted) > 0
        missing = M.bind(plain, lambda names: M.bind(M.header_of(table), lambda header: F.filter(wanted, lambda w, i: ~F.array_contains(header, F.get(names, i)))))
        return F.when(M.is_table(table), none_of(missing, ready, "missing column")).otherwise(verdict(ready, F.lit(False), F.lit("no Markdown table")))

    return M.bind(c.derived("lists", "columns", named), lambda wanted: M.bind(a.table, lambda table: judged(table, wanted)))


@_checker("table_row_count")
def _(a: Answer, c: Settings) -> Column:
    exact, low, high = c.number("exact_rows"), c.number("min_rows"), c.number("max_rows")
    none = verdict(F.coalesce(exact, low, high).isNotNull(), F.lit(False), F.lit("no Markdown table"))
    judged = lambda rows: within(rows, exact, low, high, "table rows")
    return M.bind(a.table, lambda table: F.when(M.is_table(table), M.bind(F.size(M.body_of(table)).cast("long"), judged)).otherwise(none))


@_checker("checkbox")
def _(a: Answer, c: Settings) -> Column:
    return verdict(None, a.text.rlike(M.CHECKBOX), F.lit("checkbox item"))


@_checker("code_block")
def _(a: Answer, c: Settings) -> Column:
    none = F.lit(None).cast("long")
    least = F.coalesce(F.nullif(c.number("min_count"), F.lit(0)), F.nullif(c.number("min"), F.lit(0)), F.lit(1).cast("long"))
    return within(M.code_block_measure(a.text), none, least, none, "code blocks")


@_checker("blockquote_count")
def _(a: Answer, c: Settings) -> Column:
    return limited(a.quotes, c, "quoted lines")


def missing_values(a: Answer, c: Settings, numbers: bool, *keys: str) -> Column:
    wanted = c.derived("lists", "canonical", lambda s: F.transform(s.listed(*keys), M.canonical_number))
    return F.filter(wanted, lambda v: ~((F.array_contains(a.numbers, v) | a.flat.contains(v)) if numbers else a.flat.contains(v)))


@_checker("contains_number")
def _(a: Answer, c: Settings) -> Column:
    values = c.listed("numbers", "number")
    return none_of(missing_values(a, c, True, "numbers", "number"), F.size(values) > 0, "missing number")


@_checker("threshold")
def _(a: Answer, c: Settings) -> Column:
    values = c.listed("thresholds", "number")
    return none_of(missing_values(a, c, True, "thresholds", "number"), F.size(values) > 0, "missing threshold")


@_checker("deadline")
def _(a: Answer, c: Settings) -> Column:
    values = c.listed("deadlines", "deadline")
    return none_of(missing_values(a, c, False, "deadlines", "deadline"), F.size(values) > 0, "missing deadline")


@_checker("exact_value")
def _(a: Answer, c: Settings) -> Column:
    def pairs(s: Settings) -> Column:
        given = s.given("expected_values")
        return F.map_entries(F.from_json(F.when(F.ltrim(given).startswith("{"), given), "map<string,string>"))

    shown = c.derived("lists", "pairs", lambda s: F.transform(pairs(s), lambda p: F.concat_ws("=", p["key"], p["value"])))
    names = c.derived("lists", "names", lambda s: F.transform(pairs(s), lambda p: M.fold(p["key"])))
    values = c.derived("lists", "values", lambda s: F.transform(pairs(s), lambda p: M.canonical_number(F.coalesce(python_text(p["value"]), F.lit("none")))))
    missing = F.filter(shown, lambda _, i: ~(a.flat.contains(F.get(names, i)) & a.flat.contains(F.get(values, i))))
    return none_of(missing, F.size(shown) > 0, "missing value")


@_checker("decimal_places")
def _(a: Answer, c: Settings) -> Column:
    said = c.derived("numbers", "said", lambda s: F.nullif(F.regexp_extract(s.wording, rf"(?iu)({M.D}+){M.S}+decimal places?", 1), F.lit("")).cast("long"))
    n = F.coalesce(F.nullif(c.number("places"), F.lit(0)), c.number("count"), c.number("exact"), said)
    percent = F.lower(F.coalesce(c.given("target", "mode"), F.lit("all"))).isin(*PERCENT_TARGETS)
    found = F.when(percent, F.regexp_extract_all(a.text, F.lit(M.PERCENTAGE), F.lit(0))).otherwise(F.regexp_extract_all(a.text, F.lit(M.DECIMAL), F.lit(0)))

    def judged(numbers: Column) -> Column:
        wrong = F.filter(numbers, lambda x: F.length(F.regexp_extract(x, rf"\.({M.D}+)", 1)) != n)
        return F.when(F.size(numbers) == 0, verdict(None, percent, F.lit("no such numbers"))).otherwise(none_of(F.slice(wrong, 1, 5), None, "number of other places"))

    return F.when(n.isNotNull(), M.bind(found, judged))


def first_of(a: Answer) -> Column:
    return F.coalesce(F.get(a.lines, F.lit(0)), F.lit(""))


def last_of(a: Answer) -> Column:
    return F.coalesce(F.try_element_at(a.lines, F.lit(-1)), F.lit(""))


@_checker("first_line")
def _(a: Answer, c: Settings) -> Column:
    wanted = c.word_or_quoted("line", "word")
    return verdict(wanted != "", first_of(a).startswith(wanted), say("first line opens with ", wanted))


@_checker("first_line_format")
def _(a: Answer, c: Settings) -> Column:
    kind = F.lower(c.word("format"))
    patterns = {"bold": r"(?d)^\*\*.+\*\*", "heading": rf"^#{{1,6}}{M.S}+{M.NS}", "numbered": rf"^1[.)]{M.S}+{M.NS}"}
    test = F.lit(False)
    for name, pattern in patterns.items():
        test = F.when(kind == name, first_of(a).rlike(pattern)).otherwise(test)
    ready = kind.isin(*patterns) | ((kind != "") & (first_of(a) == ""))
    return verdict(ready, test & (first_of(a) != ""), say("first line as ", kind))


@_checker("last_line")
def _(a: Answer, c: Settings) -> Column:
    wanted = c.word_or_quoted("line", "word")
    return verdict(wanted != "", last_of(a).contains(wanted), say("last line holds ", wanted))


@_checker("conditional_trigger")
def _(a: Answer, c: Settings) -> Column:
    trigger, followup = c.word("trigger"), c.word("followup", "required_if_present")
    absent = lambda name, *keys: F.size(folded_search(a, c, name, lambda s: F.array(s.word(*keys)), True)) > 0
    return verdict((trigger != "") & (followup != ""), absent("trigger", "trigger") | ~absent("followup", "followup", "required_if_present"), say("with ", trigger, " also ", followup))


def pattern_of(c: Settings, forbidden: bool) -> Column:
    return c.given("forbidden_regex", "pattern", "regex") if forbidden else c.given("pattern", "regex")


def unless_stopped(facts: Column, found: Column) -> Column:
    """Open where a pattern hit its limits: a judge must decide."""
    return F.when(F.coalesce(facts["error"] != H.STOPPED, F.lit(True)), found)


@_checker("simple_regex")
def _(a: Answer, c: Settings) -> Column:
    pattern = pattern_of(c, False)
    facts = a.regex("search", a.text, pattern, c.flag("case_sensitive"))
    return unless_stopped(facts, verdict(pattern.isNotNull(), facts["n"] > 0, say(F.coalesce(facts["error"], F.lit("pattern")), " ", pattern)))


@_checker("forbidden_regex")
def _(a: Answer, c: Settings) -> Column:
    pattern = pattern_of(c, True)
    facts = a.regex("search", a.text, pattern, c.flag("case_sensitive"))
    return unless_stopped(facts, verdict(pattern.isNotNull(), facts["n"] == 0, say(F.coalesce(facts["error"], F.lit("forbidden pattern, first match")), " ", facts["first"])))


@_checker("regex_count")
def _(a: Answer, c: Settings) -> Column:
    pattern = pattern_of(c, False)
    facts = a.regex("count", a.text, pattern, c.flag("case_sensitive"))
    wrong = verdict(pattern.isNotNull(), F.lit(False), facts["error"])
    return unless_stopped(facts, F.when(facts["error"].isNotNull(), wrong).otherwise(F.when(pattern.isNotNull(), limited(facts["n"], c, "matches"))))


@_checker("forbidden_regex_before_heading")
def _(a: Answer, c: Settings) -> Column:
    pattern, heading = pattern_of(c, True), c.word("heading")
    facts = a.regex_before(pattern, heading, c.flag("case_sensitive"))
    found = verdict(pattern.isNotNull() & (heading != ""), facts["n"] == 0, say(F.coalesce(facts["error"], F.lit("forbidden pattern before the heading, first match")), " ", facts["first"]))
    return unless_stopped(facts, found)


@_checker("first_word")
def _(a: Answer, c: Settings) -> Column:
    wanted = c.word_or_quoted("word")
    opened = F.regexp_replace(M.strip(a.text), rf"^(?:\*{{1,2}}|#{{1,6}}{M.S}*)", "")
    return verdict(wanted != "", opened.startswith(wanted), say("opens with ", wanted))


@_checker("first_last_line")
def _(a: Answer, c: Settings) -> Column:
    first, last = c.word("first_line"), c.word("last_line")
    ok = (F.size(a.lines) > 0) & first_of(a).contains(first) & last_of(a).contains(last)
    return verdict((first != "") | (last != ""), ok, say("first line ", first, ", last line ", last))


def ordered_headings(c: Settings) -> Column:
    own = lambda s: F.filter(F.transform(s.listed("headings", "fields"), M.strip), lambda h: h != "")
    return c.derived("lists", "ordered headings", lambda s: F.when(F.size(own(s)) > 0, own(s)).otherwise(s.quoted()))


@_checker("heading_order")
def _(a: Answer, c: Settings) -> Column:
    wanted = ordered_headings(c)
    at = a.places(wanted, c.flag("case_sensitive"))
    pairs = F.greatest(F.size(at) - 1, F.lit(0))
    rising = F.forall(F.zip_with(F.slice(at, F.lit(1), pairs), F.slice(at, F.lit(2), pairs), lambda x, y: F.coalesce(x < y, F.lit(False))), lambda x: x)
    return verdict(F.size(wanted) > 0, ~F.exists(at, lambda p: p.isNull()) & rising, say("headings at ", F.array_join(F.transform(at, lambda p: p.cast("string")), ", ", "nowhere")))


@_checker("heading_level")
def _(a: Answer, c: Settings) -> Column:
    level = c.number("level")
    return F.when(level.isNotNull(), limited(a.headings(level), c, "headings"))


@_checker("heading_depth")
def _(a: Answer, c: Settings) -> Column:
    none = F.lit(None).cast("long")
    return within(a.depth, none, c.either("min_depth", "min"), none, "heading levels")


@_checker("keyword_presence")
def _(a: Answer, c: Settings) -> Column:
    words = c.derived("lists", *TERMS["keyword_presence"])
    missing = exact_search(a, c, *TERMS["keyword_presence"], True)
    some = F.when(c.flag("match_all", True), F.size(missing) == 0).otherwise(F.size(missing) < F.size(words))
    return verdict(F.size(words) > 0, some, say("absent keywords: ", F.array_join(missing, ", ")))


@_checker("keyword_absence")
def _(a: Answer, c: Settings) -> Column:
    words = c.derived("lists", *TERMS["keyword_absence"])
    return none_of(exact_search(a, c, *TERMS["keyword_absence"], False), F.size(words) > 0, "forbidden keyword")


@_checker("first_person")
def _(a: Answer, c: Settings) -> Column:
    own = c.listed("forbidden_phrases", "forbidden_keywords")
    phrases = F.when(F.size(own) > 0, own).otherwise(strings(REPORT_PHRASES))
    return none_of(F.filter(phrases, lambda w: a.text.contains(w)), None, "report phrase")


@_checker("risk_disclaimer")
def _(a: Answer, c: Settings) -> Column:
    own = F.coalesce(c.given("risk_line"), F.lit(RISK_LINE))
    last = lambda lines: F.slice(lines, F.greatest(F.size(lines) - 4, F.lit(1)), F.lit(5))
    found = M.bind(F.array_join(M.bind(a.lines, last), "\n"), lambda tail: (tail != "") & any_of([tail.contains(t) for t in (*RISK_TERMS, own)]))
    # Lines are looked at only where the text has a term at all; one with line ends may come together from several lines.
    somewhere = any_of([a.text.contains(t) for t in (*RISK_TERMS, own)]) | own.contains("\n")
    return verdict(None, somewhere & found, F.lit("risk line near the end"))


@_checker("currency_format")
def _(a: Answer, c: Settings) -> Column:
    unit, forbidden = c.word("unit"), c.listed("forbidden_units")
    lacks = F.exists(strings(CURRENCY_UNITS), lambda u: a.text.contains(u)) & ~a.text.contains(unit)
    found = F.filter(forbidden, lambda u: a.text.contains(u))
    return verdict((unit != "") | (F.size(forbidden) > 0), ~lacks & (F.size(found) == 0), say("unit ", unit, ", forbidden ", F.array_join(found, ", ")))


@_checker("no_percent")
def _(a: Answer, c: Settings) -> Column:
    return verdict(None, ~a.text.rlike("[%％]"), F.lit("no percent sign"))


@_checker("no_arabic_numerals")
def _(a: Answer, c: Settings) -> Column:
    rest = F.regexp_replace(F.regexp_replace(a.text, rf"(?dm)^#{{1,6}}{M.S}.*$", ""), r"(?dm)^\|.*\|$", "")
    return verdict(None, ~rest.rlike("[0-9]"), F.lit("no digits outside of headings and tables"))


def _ask(kind: str, c: Settings, **own: Column) -> Column:
    """What Python is asked about an answer for one constraint."""
    kinds = {"pattern": "string", "field": "string", "fields": "array<string>", "most": "bigint", "headings": "array<string>"}
    return F.struct(F.lit(kind).alias("kind"), c.flag("case_sensitive").alias("exact"), *[own.get(n, F.lit(None)).cast(k).alias(n) for n, k in kinds.items()])


#: The checkers that need Python: user patterns, headings in Python's dialect, JSON.
ASKS: dict[str, Callable[[Settings], Column]] = {
    "simple_regex": lambda c: _ask("search", c, pattern=pattern_of(c, False)),
    "forbidden_regex": lambda c: _ask("search", c, pattern=pattern_of(c, True)),
    "regex_count": lambda c: _ask("count", c, pattern=pattern_of(c, False)),
    "forbidden_regex_before_heading": lambda c: _ask("before", c, pattern=pattern_of(c, True), headings=F.array(c.word("heading"))),
    "heading_order": lambda c: _ask("places", c, headings=ordered_headings(c)),
    "valid_json": lambda c: _ask("json", c),
    "required_fields": lambda c: _ask("fields", c, fields=required_fields(c)),
    "json_field_count": lambda c: _ask("json", c, field=c.given("field")),
    "json_field_item_limit": lambda c: _ask("json", c, field=json_field(c)[0], most=json_field(c)[1]),
    "json_field_word_limit": lambda c: _ask("json", c, field=json_field(c)[0], most=json_field(c)[1]),
}
def _ask_terms(name: str) -> Callable[[Settings], Column]:
    """The terms of a constraint that has many of them; null for others."""

    def ask(c: Settings) -> Column:
        own = c.derived("lists", *TERMS[name])
        exact = F.lit(True) if name.startswith("keyword_") else c.flag("case_sensitive")
        return F.when(F.size(own) > MANY_TERMS, _ask("terms", c, fields=own).withField("exact", exact))

    return ask


ASKS |= {name: _ask_terms(name) for name in TERMS}
#: Distinct constraints of which so many may be broadcast.
BROADCAST_SPECS = 10_000


def with_method(found: Column, name: str) -> Column:
    """The verdict with its method; open verdicts have no reason."""
    return F.struct(found["score"].alias("score"), found["reason"].alias("reason"), F.lit(f"rule_aided:{name}").alias("method"))


def checked(response: Column, name: str, config: Mapping | Column, wording: Column | None = None) -> Column:
    """score, reason and method of one checker for all rows; settings as a Python dict or a map column."""
    if name not in CHECKERS:
        return F.struct(F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("reason"), F.lit("rule_aided:unresolved").alias("method"))
    settings = Settings(config if isinstance(config, Column) else as_map(config), wording)
    return with_method(CHECKERS[name](Answer(response), settings), name)


def check(response: Column, name: str, config: Mapping | Column, wording: Column | None = None) -> Column:
    """1, 0 or null for one checker; an unknown name is left to a judge."""
    return checked(response, name, config, wording)["score"]


def evaluate(responses: DataFrame, constraints: DataFrame, *, key: str = "item_id", checkers: Sequence[str] | None = None) -> DataFrame:
    """One row for each answer and constraint of its item: the answer's columns but its text, then constraint_index,
    constraint_id, constraint, check_type, tag, family, checker, score, status, reason, method, error.

    responses: key, response and any other columns (such as model). constraints: key and constraint_index, and what there is of id,
    constraint_id, constraint, check_type, tag, family, checker (a name), settings (a map of top-level settings) and
    the maps evaluator, checker_config, rule, params, each overriding those before it.

    Each constraint has its own checker and settings; names are resolved through aliases and, where there is none, inferred
    from the wording. Settings and wordings are read once for each distinct constraint, into small typed arrays. An answer meets all constraints of its item in one row:
    a measure is taken once, and only if one of them looks at it; Python is asked once for all its patterns, fields and headings; the verdicts are worked out
    beside the text, and only they are exploded. A text moves once, to its item's constraints. error names what strict scoring rejects: a rule without
    settings, a rule that gives no verdict (also where a pattern was stopped, see helpers.REGEX_SECONDS), an unknown check type (score 0, method schema).

    checkers: the names that occur, so that the plan holds no others; unless given they are read from the distinct constraints
    first, which are then written to the checkpoint folder; at most one row for each checker there is comes to the driver. Counts, patterns, headings and JSON go through Arrow helpers; plans without such checkers have no Python.

    Nulls: a null response is empty; null settings are none. An item without constraints gives no rows; empty tables give none.
    """
    own, specs = distinct_constraints(constraints, key)
    few = False
    if checkers is None:
        specs = cut(specs)
        few = specs.count() <= BROADCAST_SPECS
        checkers = [r[0] for r in specs.where(F.col("checker").isin(*CHECKERS)).select("checker").distinct().collect()]
    slots = Slots(Settings(F.col("config"), F.col("constraint")))

    def settings(name: str, c: Column) -> Settings:
        return ReadSettings(slots, name, c["read"], c["config"])

    # Verdicts are built here once for nothing but the slots that they ask for.
    for n in checkers:
        CHECKERS[n](Answer(F.lit(""), {"facts": F.col("facts")}), settings(n, F.col("c")))
        if n in ASKS:
            ASKS[n](settings(n, F.col("c")))
    fields = ("constraint", "check_type", "tag", "family", "checker", "route", "reject_reason")
    # The map goes along only where a checker of one's own reads it.
    whole = F.col("config") if set(checkers) & CUSTOM else F.lit(None).cast("map<string,string>")
    read = specs.select("spec", *fields, slots.column(F.col("checker")).alias("read"), whole.alias("config"))
    asking = [n for n in checkers if n in ASKS]
    asked = F.lit(None).cast("string")
    for n in asking:
        asked = F.when(F.col("checker") == n, F.to_json(ASKS[n](settings(n, {"read": F.col("read"), "config": F.col("config")})))).otherwise(asked)
    read = read.withColumn("ask", asked)
    met = own.join(F.broadcast(read) if few else read, "spec")
    per_item = met.groupBy("_key").agg(F.collect_list(F.struct("constraint_index", "constraint_id", *fields, "read", "config", "ask")).alias("_constraints"))
    carried = [c for c in responses.columns if c != "response"]
    rows = responses.select(F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), F.coalesce("response", F.lit("")).alias("_text"), F.col(f"`{key}`").alias("_of"))
    rows = rows.join(per_item, F.col("_of") == F.col("_key")).drop("_of", "_key")
    uses = lambda names: F.exists("_constraints", lambda c: c["checker"].isin(*names))
    measured = {m: (measure, names) for m, (measure, names) in MEASURES.items() if set(names) & set(checkers)}
    counted = [m for m in measured if m in COUNTED]
    helped = []
    if counted:
        some = uses([n for m in counted for n in measured[m][1]])
        helped.append(H.counts_of(*[COUNTED[m] for m in counted])(F.when(some, F.col("_text"))).alias("_counts"))
    if asking:
        # Texts of which nothing is asked stay where they are.
        own_asks = F.when(F.exists("_constraints", lambda c: c["ask"].isNotNull()), F.array_join(F.transform("_constraints", lambda c: F.coalesce(c["ask"], F.lit(""))), "\n"))
        rows = rows.withColumn("_asks", own_asks)
        helped.append(H.answer_facts(F.when(F.col("_asks").isNotNull(), F.col("_text")), F.col("_asks")).alias("_facts"))
    rows = rows.select("_row", "_text", "_constraints", *helped)
    own_columns = [F.col("_counts")[COUNTED[m]] if m in COUNTED else F.when(uses(names), measure(F.col("_text"))) for m, (measure, names) in measured.items()]
    rows = rows.select("_row", "_text", "_constraints", *(["_facts"] if asking else []), *[x.alias(f"_m_{m}") for m, x in zip(measured, own_columns, strict=True)])

    def judged(c: Column, i: Column) -> Column:
        known = {m: F.col(f"_m_{m}") for m in measured} | ({"facts": F.get(F.col("_facts"), i)} if asking else {})
        answer, name, none = Answer(F.col("_text"), known), c["checker"], F.lit(None).cast("string")
        found = F.when(F.lit(False), F.struct(F.lit(None).cast("int").alias("score"), none.alias("reason")))
        for n in checkers:
            found = found.when(name == n, CHECKERS[n](answer, settings(n, c)))
        # Worked out once, then named.
        found = F.when(name.isin(checkers), M.bind(found, lambda v: F.struct(v["score"].alias("score"), v["reason"].alias("reason"), F.concat(F.lit("rule_aided:"), name).alias("method"))))
        plain = lambda score, reason, method: F.struct(F.lit(score).cast("int").alias("score"), F.lit(reason).cast("string").alias("reason"), F.lit(method).alias("method"))
        given = F.when(c["route"] == "LLM", plain(None, None, "judge")).when(c["reject_reason"] == "unknown check_type", plain(0, "unknown check_type", "schema"))
        given = given.otherwise(F.coalesce(found, plain(None, None, "rule_aided:unresolved")))
        return F.struct(*[c[n].alias(n) for n in ("constraint_index", "constraint_id", *fields)], given.alias("v"))

    rows = rows.select("_row", F.explode(F.transform("_constraints", judged)).alias("_c"))
    score = F.col("_c.v.score")
    error = F.coalesce(F.col("_c.reject_reason"), F.when((F.col("_c.route") == "rule") & score.isNull(), "rule gave no verdict"))
    return rows.select(
        *[F.col("_row")[c_].alias(c_) for c_ in carried],
        *[F.col(f"_c.{n}").alias(n) for n in ("constraint_index", "constraint_id", "constraint", "check_type", "tag", "family", "checker")],
        score.alias("score"),
        F.when(score == 1, "pass").when(score == 0, "fail").otherwise("needs_judge").alias("status"),
        F.col("_c.v.reason").alias("reason"),
        F.col("_c.v.method").alias("method"),
        error.alias("error"),
    )


def rejects(results: DataFrame) -> DataFrame:
    """The rows that strict scoring refuses, with the error of each."""
    return results.where("error IS NOT NULL")


def distinct_constraints(constraints: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(_key, constraint_index, constraint_id, spec of each constraint; the distinct ones: spec, constraint, check_type, tag, family, checker, config, route,
    reject_reason). A spec is all that decides a verdict but the answer; it goes by the md5 of its JSON, and settings are merged and names resolved once for each."""
    from .rollups import family

    kinds = {"constraint": "string", "check_type": "string", "tag": "string", "family": "string", "checker": "string"}
    maps = ("settings", "evaluator", "checker_config", "rule", "params")
    have = set(constraints.columns)
    column = lambda n, k: (F.col(n) if n in have else F.lit(None)).cast(k)
    parts = F.struct(*[column(n, k).alias(n) for n, k in kinds.items()], *[column(n, "map<string,string>").alias(n) for n in maps])
    index = column("constraint_index", "long")
    name = F.coalesce(*[F.nullif(column(n, "string"), F.lit("")) for n in ("id", "constraint_id")], F.concat(F.col(key).cast("string"), F.lit("#C"), (index + 1).cast("string")))
    rows = constraints.select(F.col(f"`{key}`").alias("_key"), index.alias("constraint_index"), name.alias("constraint_id"), F.to_json(parts).alias("_json"))
    own = rows.select("_key", "constraint_index", "constraint_id", F.unhex(F.md5(F.col("_json").cast("binary"))).alias("spec"))
    found = rows.select("_json").distinct()
    schema = ", ".join([f"{n} {k}" for n, k in kinds.items()] + [f"{n} map<string,string>" for n in maps])
    specs = found.select(F.unhex(F.md5(F.col("_json").cast("binary"))).alias("spec"), F.from_json("_json", schema).alias("s")).select("spec", "s.*")
    specs = specs.withColumn("config", layered_config(F.col("settings"), *[F.col(n) for n in maps[1:]]))
    specs = specs.withColumn("has_config", has_explicit_config(F.col("settings"), F.col("checker"), *[F.col(n) for n in maps[1:]]))
    specs = route_constraints(specs)
    given = Settings(F.col("config")).given("type", "checker_type", "name", "method")
    resolved = named_checker(F.coalesce(given, F.col("checker")), F.col("constraint"), F.col("tag"), aliases=True)
    return own, specs.select(
        "spec",
        F.coalesce("constraint", F.lit("")).alias("constraint"),
        F.when(F.col("route") == "reject", F.lower(F.trim(F.coalesce("check_type", F.lit(""))))).otherwise(F.col("route")).alias("check_type"),
        "tag",
        F.coalesce("family", family(F.col("tag"))).alias("family"),
        F.when(F.col("route") == "rule", resolved).alias("checker"),
        "config",
        "route",
        "reject_reason",
    )
