"""Text measures as column expressions, computed once per answer and shared by all checks.

Python's regex classes are Unicode and its line ends are only \\n, so patterns spell the classes
out (its white space, digits, word characters) and carry (?d) where . or ^ $ matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space, inside a class.
PS = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
S, NS, D, W = f"[{PS}]", f"[^{PS}]", r"\p{Nd}", r"[\p{L}\p{N}_]"
#: Counting these counts the words: a run that opens with a word character holds one.
WORD = rf"{W}[\p{{L}}\p{{N}}_'-]*+"
MARK = rf"(?:[-*•]|{D}+[.)])"
BULLET = rf"(?dm)^{S}*{MARK}{S}+{NS}+"
ORDERED = rf"(?dm)^{S}*{D}+[.)]{S}+{NS}+"
HEADING = rf"(?dm)^{S}{{0,3}}#{{1,6}}{S}+{NS}+"
LABEL = rf"(?dm)^{S}*(?:{D}+[.)]{S}*)?{W}[\p{{L}}\p{{N}}_{PS}/&-]{{1,80}}:{S}*$"
QUOTE = rf"(?dm)^{S}*>{S}+{NS}+"
CHECKBOX = rf"(?dm)^{S}*(?:[-*]{S}*)?\[[ xX]?\]{S}+{NS}"
FENCE = "```"
#: Line ends, and white space within a line, inside a class.
LE = r"\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029"
IN_LINE = r"\t\x1F\x20\xA0\u1680\u2000-\u200A\u202F\u205F\u3000"
LINE_END = rf"\r\n|[{LE}]"
#: Python's white space, and its line ends but \n, as they are.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
OTHER_ENDS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
SEPARATOR = rf"^\|{S}*:?-{{3,}}:?{S}*(?:\|{S}*:?-{{3,}}:?{S}*)+\|?$"
NUMBER = rf"(?iu)(?<!{W})[$€£]?{D}[{D},]*(?:\.{D}+)?{S}*(?:%|percent|days?|calendar-days?|years?)?"
DECIMAL = rf"(?<!{W})[+-]?{D}[{D},]*(?:\.{D}+)?%?"
PERCENTAGE = rf"(?iu)(?<!{W})[+-]?{D}[{D},]*(?:\.{D}+)?(?:%|{S}+percent(?:age)?(?:{S}+points?)?(?!{W}))"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, for expressions that look at it many times."""
    return F.transform(F.array(value), use)[0]


def count(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0)).cast("long")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{S}+|{S}+$", "")


def fold(text: Column) -> Column:
    """Texts that Python's casefold makes equal become equal, and no others.

    Upper and lower case between them unfold what has several letters (ß, ligatures); a dotless i stays what it is, and
    both forms of the small sigma are one. The translation in the middle changes nothing: it keeps the optimizer from
    taking lower(upper(x)) for lower(x), which is wrong for such letters.
    """
    upper = F.upper(F.translate(F.lower(text), "ı", "\ue000"))
    return F.translate(F.lower(F.translate(upper, "\ue001", "\ue001")), "ς\ue000", "σı")


def lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def raw_lines(text: Column) -> Column:
    """Lines as they are; \\r\\n makes an empty one. Split at one character, which takes no pattern; other line ends become \\n before, where there are any."""
    return F.split(F.when(text.rlike(r"[\r\x0B\x0C\x1C\x1D\x1E\x85\u2028-\u2029]"), F.translate(text, OTHER_ENDS, "\n" * len(OTHER_ENDS))).otherwise(text), "\n")


def trim(text: Column) -> Column:
    """What strip does, without a pattern."""
    return F.btrim(text, F.lit(SPACES))


def trimmed(lines_: Column) -> Column:
    """Each line without white space around it; blank ones drop out."""
    return F.filter(F.transform(lines_, trim), lambda x: x != "")


def nonblank(text: Column) -> Column:
    """Trimmed lines that are not empty: from the first to the last character of a line that is no white space."""
    return trimmed(raw_lines(text))


def word_count(text: Column) -> Column:
    return count(text, WORD)


def mixed_word_count(text: Column) -> Column:
    """CJK characters and runs of Latin letters."""
    return F.when(F.octet_length(text) == F.length(text), F.lit(0).cast("long")).otherwise(count(text, r"[一-鿿]")) + count(text, "[A-Za-z]++")


def ws_word_count(text: Column) -> Column:
    return count(text, f"{NS}++")


def section_count(text: Column) -> Column:
    """Headings; if there is none, lines that are a label with a colon."""
    return bind(count(text, HEADING), lambda n: F.when(n > 0, n).otherwise(count(text, LABEL)))


def item_list_count(text: Column) -> Column:
    return count(text, BULLET)


def ordered_count(text: Column) -> Column:
    return count(text, ORDERED)


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines that are more than a lone heading or bold line."""
    alone = lambda own: (F.size(own) == 1) & (own[0].rlike(rf"^#{{1,6}}{S}+{NS}") | own[0].rlike(r"(?s)^\*\*[^*].*\*\*$"))
    return F.filter(F.split(strip(text), rf"\n{S}*\n"), lambda b: bind(nonblank(b), lambda own: (F.size(own) > 0) & ~alone(own)))


def paragraph_measure(text: Column) -> Column:
    return F.size(paragraphs(text)).cast("long")


def sentence_measure(text: Column) -> Column:
    pieces = F.split(text, rf"[。！？!?]+|(?<=[A-Za-z0-9][.]){S}+")
    return F.size(F.filter(pieces, lambda p: F.length(strip(p)) > 5)).cast("long")


def blockquote_measure(text: Column) -> Column:
    return count(text, QUOTE)


def code_block_measure(text: Column) -> Column:
    return F.floor(count(text, FENCE) / 2).cast("long")


def heading_level_measure(text: Column, level: int | Column) -> Column:
    """Headings of a level; 0 for levels that do not exist."""
    one = lambda n: count(text, rf"(?dm)^{S}{{0,3}}#{{{n}}}{S}+{NS}+")
    if isinstance(level, int):
        return one(level) if 1 <= level <= 6 else F.lit(0).cast("long")
    chain = F.when(level == 1, one(1))
    for n in range(2, 7):
        chain = chain.when(level == n, one(n))
    return chain.otherwise(F.lit(0).cast("long"))


def heading_depth_measure(text: Column) -> Column:
    """How many levels of headings the lines have."""
    marks = F.regexp_extract_all(text, F.lit(rf"(?:^|[{LE}])[{IN_LINE}]{{0,3}}(#{{1,6}})[{IN_LINE}]+{NS}"), F.lit(1))
    return F.size(F.array_distinct(marks)).cast("long")


def table_lines(text: Column) -> Column:
    return F.filter(trimmed(F.filter(raw_lines(text), lambda x: x.contains("|"))), lambda x: x.startswith("|") & x.endswith("|"))


def is_table(rows: Column) -> Column:
    """Whether such lines make a table: two at least, one of them a separator of two columns or more."""
    return (F.size(rows) >= 2) & F.exists(rows, lambda x: x.rlike(SEPARATOR))


def has_table(text: Column) -> Column:
    return bind(table_lines(text), is_table)


def plain(cell: Column) -> Column:
    """A cell's text without emphasis and code marks, trimmed and folded."""
    return fold(strip(F.regexp_replace(cell, "[`*_]", "")))


def header_of(rows: Column) -> Column:
    return F.transform(F.split(F.regexp_replace(F.get(rows, F.lit(0)), r"^\|+|\|+$", ""), r"\|"), plain)


def table_header(text: Column) -> Column:
    return bind(table_lines(text), header_of)


def body_of(rows: Column) -> Column:
    """The lines from the third on that are no separators."""
    return F.filter(rows, lambda x, i: (i >= 2) & ~x.rlike(SEPARATOR))


def table_rows(text: Column) -> Column:
    return bind(table_lines(text), lambda rows: F.size(body_of(rows)).cast("long"))


def table_cells(text: Column) -> Column:
    """The first table's cells, row by row, header first."""
    cells = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\|+|\|+$", ""), r"\|"), strip)
    return bind(table_lines(text), lambda rows: F.when(is_table(rows), F.transform(F.concat(F.slice(rows, 1, 1), body_of(rows)), cells)))


def strip_fence(text: Column) -> Column:
    """Without the code fence around it, its language tag included."""
    return bind(strip(text), lambda t: F.when(t.startswith(FENCE), strip(F.regexp_replace(F.regexp_replace(t, rf"^```{W}*\n?", ""), r"\n?```$", ""))).otherwise(t))


def canonical_number(text: Column) -> Column:
    """Trimmed, folded, without commas, single spaces, percent as a sign."""
    return F.replace(F.regexp_replace(F.replace(fold(strip(text)), F.lit(","), F.lit("")), f"{S}+", " "), F.lit("percent"), F.lit("%"))


def extract_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), canonical_number)


def decimals_of(numbers: Column) -> Column:
    """Digits after the point of each number."""
    return F.transform(numbers, lambda x: F.length(F.regexp_extract(x, rf"\.({D}+)", 1)))


def quoted_terms(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit("\"[^\"]+\"|“[^”]+”|'[^']+'"), F.lit(0))
    return F.transform(found, lambda x: strip(F.substring(x, F.lit(2), F.length(x) - 2)))


def first_match(text: Column, *patterns: str) -> Column:
    """Group 1 of the first pattern that is found; null if none is."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in patterns])


def infer_min_words(text: Column) -> Column:
    return first_match(text, rf"(?iu)at least{S}+({D}+){S}+words?", rf"(?iu)minimum of{S}+({D}+){S}+words?").cast("long")


def infer_max_words(text: Column) -> Column:
    return first_match(text, *[rf"(?iu){k}{S}+({D}+){S}+words?" for k in ("no more than", "maximum of", "under", "fewer than")]).cast("long")


def infer_word_limit(text: Column) -> Column:
    """struct(min, max): the limits that the wording names."""
    return F.struct(infer_min_words(text).alias("min"), infer_max_words(text).alias("max"))


def _columns_named(segment: Column, by_and: bool) -> Column:
    clean = lambda x: strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "[`*_]", ""), f"{S}+", " "), r"^[ .;:|]+|[ .;:|]+$", ""), rf"(?iu)^(?:and|or){S}+", ""))

    def listed(segment: Column) -> Column:
        whole = F.regexp_replace(F.regexp_replace(segment, f"{S}+", " "), r"^[ .;:]+|[ .;:]+$", "")
        parts = bind(whole, lambda w: F.when(w.contains(","), F.split(w, ",")).otherwise(F.split(w, rf"(?iu){S}+and{S}+") if by_and else F.array(w)))
        names = F.filter(F.transform(parts, clean), lambda x: (x != "") & (ws_word_count(x) <= 6))
        return F.when(segment != "", bind(names, lambda found: F.when(F.size(found) >= 2, found)))

    return bind(segment, listed)


def infer_table_columns(text: Column) -> Column:
    """Columns that the wording names: two or more of at most six words each; null if there are none."""
    rest = rf"{S}+(.+?)(?:\.|;|$)"
    return F.coalesce(
        _columns_named(F.regexp_extract(text, rf"(?iud)(?:columns?|headers?){S}+(?:named{S}+)?(.+?)(?:\.|;|$)", 1), False),
        _columns_named(F.regexp_extract(text, rf"(?iud)two-column table of{rest}", 1), True),
        _columns_named(F.regexp_extract(text, rf"(?iud)table with{rest}", 1), False),
    )


def response_profile(text: Column) -> list[Column]:
    """All counts of an answer side by side, taken in one go by an Arrow helper; null for a null text."""
    from . import helpers

    found = helpers.counts_of(*helpers.COUNTS)(text)
    return [found[n].alias(n) for n in helpers.COUNTS]
