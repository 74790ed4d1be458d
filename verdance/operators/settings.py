"""Settings of a constraint, read from a map column by the rules of the checkers.

A map column holds every setting as text: lists and objects as JSON, numbers and booleans as written.
Settings that Python calls false (empty text, list or object, null, false) count as not set.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdance.functions import measures as M

#: Settings that are read as whole numbers.
NUMBERS = "min max count exact min_count max_count exact_count min_rows max_rows exact_rows level min_depth max_chars min_words max_words places".split()
NOT_SET = ("", "[]", "{}", "null", "false")
EMPTY = "cast(array() as array<string>)"


def as_map(config: Mapping) -> Column:
    """Settings of a Python dict as a literal map column."""
    text = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    pairs = [F.lit(x) for k, v in config.items() if v is not None for x in (str(k), text(v))]
    return F.create_map(*pairs) if pairs else F.expr("cast(map() as map<string,string>)")


def items_of(value: Column) -> Column:
    """A JSON list as its items, any other text as one item; null stays null."""
    listed = F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>"))
    return F.coalesce(listed, F.when(value.isNotNull(), F.array(value)))


def python_text(value: Column) -> Column:
    """A JSON list or object as Python writes it: spaces behind commas and colons, single quotes, None. Other texts, and quotes and backslashes inside texts, stay."""
    outside = r'(?=(?:[^"]*"[^"]*")*[^"]*$)'
    spaced = F.regexp_replace(F.regexp_replace(value, rf"([,:])\s*{outside}", "$1 "), rf"null{outside}", "None")
    return F.when(F.ltrim(value).rlike(r"^[\[{]"), F.regexp_replace(spaced, r"\"([^\"'\\]*)\"", "'$1'")).otherwise(value)


class Settings:
    """The settings of a constraint (a map column) and its wording, which some checkers fall back to.

    numbers: whole numbers that a table has as columns already.
    """

    def __init__(self, config: Column, wording: Column | None = None, numbers: Mapping[str, Column] | None = None):
        self.config = config
        self.numbers = numbers or {}
        self.wording = F.coalesce(wording if wording is not None else F.lit(None).cast("string"), F.lit(""))

    def raw(self, key: str) -> Column:
        return F.try_element_at(self.config, F.lit(key))

    def given(self, *keys: str) -> Column:
        """The first setting that is set, as text; null if none is."""
        return F.coalesce(*[F.when(~self.raw(k).isin(*NOT_SET), self.raw(k)) for k in keys])

    def word(self, *keys: str) -> Column:
        """The same, trimmed; empty if none is set."""
        return M.strip(F.coalesce(self.given(*keys), F.lit("")))

    def listed(self, *keys: str) -> Column:
        """The first setting that is set, as a list; empty if none is."""
        return F.coalesce(items_of(self.given(*keys)), F.expr(EMPTY))

    def quoted(self) -> Column:
        return M.quoted_terms(self.wording)

    def listed_or_quoted(self, *keys: str) -> Column:
        own = self.listed(*keys)
        return F.when(F.size(own) > 0, own).otherwise(self.quoted())

    def word_or_quoted(self, *keys: str) -> Column:
        """A word, else the first quoted term of the wording."""
        own = self.word(*keys)
        return F.when(own != "", own).otherwise(F.coalesce(F.get(self.quoted(), F.lit(0)), F.lit("")))

    def flag(self, key: str, default: bool = False) -> Column:
        return F.coalesce(~self.raw(key).isin(*NOT_SET, "0"), F.lit(default))

    def derived(self, kind: str, name: str, build: Callable[[Settings], Column]) -> Column:
        """What build makes of the settings and the wording alone; kind is one of KINDS."""
        return build(self)

    def number(self, key: str) -> Column:
        """A whole number (decimals are cut), null for anything else; without count, exact stands for it."""
        if key in self.numbers:
            return self.numbers[key]
        text = F.trim(F.coalesce(self.raw(key), self.raw("exact")) if key == "count" else self.raw(key))
        return F.when(text.rlike(r"^[+-]?[0-9]+(?:\.[0-9]+)?$"), F.regexp_replace(text, r"\..*$", "").try_cast("long"))

    def either(self, *keys: str) -> Column:
        """The first of the numbers that is set and not 0; the last may be 0."""
        return F.coalesce(*[F.nullif(self.number(k), F.lit(0)) for k in keys[:-1]], self.number(keys[-1]))


#: What a setting is read as.
KINDS = {"numbers": "array<bigint>", "texts": "array<string>", "lists": "array<array<string>>", "flags": "array<boolean>"}


class Slots:
    """Settings read once for each distinct constraint, before it meets an answer.

    Whatever a checker asks for while its verdict is built gets a slot of its own; column() then holds, for each constraint, the values of its
    checker's slots in one small array a kind.
    """

    def __init__(self, base: Settings):
        self.base = base
        self.asked: dict[str, dict[str, dict[str, Column]]] = {}

    def place(self, checker: str, kind: str, name: str, build: Callable[[Settings], Column]) -> int:
        own = self.asked.setdefault(checker, {}).setdefault(kind, {})
        if name not in own:
            own[name] = build(self.base)
        return list(own).index(name)

    def column(self, checker: Column) -> Column:
        def one(kind: str) -> Column:
            chain = F.when(F.lit(False), F.expr(f"cast(null as {KINDS[kind]})"))
            for name, own in self.asked.items():
                if kind in own:
                    chain = chain.when(checker == name, F.array(*own[kind].values()).cast(KINDS[kind]))
            return chain.alias(kind)

        return F.struct(*[one(kind) for kind in KINDS])


class ReadSettings(Settings):
    """The settings of one checker as they lie in slots; read is the struct that Slots.column makes, config the map itself (for checkers of one's own)."""

    def __init__(self, slots: Slots, checker: str, read: Column, config: Column):
        self.slots, self.checker, self.read, self.config = slots, checker, read, config

    def derived(self, kind: str, name: str, build: Callable[[Settings], Column]) -> Column:
        return F.get(self.read[kind], F.lit(self.slots.place(self.checker, kind, name, build)))

    def raw(self, key: str) -> Column:
        return self.derived("texts", f"raw {key}", lambda s: s.raw(key))

    def given(self, *keys: str) -> Column:
        return self.derived("texts", f"given {keys}", lambda s: s.given(*keys))

    def word(self, *keys: str) -> Column:
        return self.derived("texts", f"word {keys}", lambda s: s.word(*keys))

    def word_or_quoted(self, *keys: str) -> Column:
        return self.derived("texts", f"word or quoted {keys}", lambda s: s.word_or_quoted(*keys))

    def listed(self, *keys: str) -> Column:
        return self.derived("lists", f"listed {keys}", lambda s: s.listed(*keys))

    def quoted(self) -> Column:
        return self.derived("lists", "quoted", lambda s: s.quoted())

    def listed_or_quoted(self, *keys: str) -> Column:
        return self.derived("lists", f"listed or quoted {keys}", lambda s: s.listed_or_quoted(*keys))

    def flag(self, key: str, default: bool = False) -> Column:
        return self.derived("flags", f"{key} {default}", lambda s: s.flag(key, default))

    def number(self, key: str) -> Column:
        return self.derived("numbers", key, lambda s: s.number(key))

    def either(self, *keys: str) -> Column:
        return self.derived("numbers", f"either {keys}", lambda s: s.either(*keys))
