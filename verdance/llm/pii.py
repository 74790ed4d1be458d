"""Personal data by candidate generation and gradient-boosted trees, in Spark expressions only."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

KINDS = ("email", "ip", "card", "phone")

#: The base patterns. Quantifiers that cannot give back anything useful are possessive, which
#: keeps the matches and spares the engine's stack on long runs; an email can begin only where a
#: run of its first part begins or where the previous match ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators' patterns, wider than the base: spelled-out at signs, spaced or dashed
#: addresses, other separators in card numbers, phone numbers without a plus.
AT, DOT = r"(?i:@|[(\[{<]\x20?at\x20?[)\]}>])", r"(?i:[(\[{<]\x20?dot\x20?[)\]}>])"
WIDE = {
    "email": rf"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?{DOT}\x20?[A-Za-z0-9._%+-]++)*+\x20?{AT}\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?{DOT}\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}+(?:\x20?[.]\x20?[0-9]{1,3}+){3}+(?![0-9]|\x20?[.]\x20?[0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,3}+[0-9]){12,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00|\()?+[0-9][\x20()./0-9-]{5,24}[0-9](?![0-9])",
}
NEEDS = {"email": AT, "ip": r"[0-9]\x20?[.]", "card": "[0-9]", "phone": "[0-9]"}
BASE_NEEDS = {"email": "@", "ip": ".", "phone": "+"}

TREES, DEPTH = 10, 3
#: Weighted rows that a task takes when trees are fitted; more rows make more tasks.
FIT_ROWS = 2000
PRECISION = 0.98
#: Characters of context on either side.
CONTEXT = 24
#: Words on the left that speak for a kind, or against a phone number.
SPEAKS = {
    "ip": r"(?i)(?<!\p{L})(?:ip|ipv4|host|server|addr|address|adresse)(?!\p{L})",
    "card": r"(?i)(?<!\p{L})(?:card|visa|mastercard|amex|credit|debit|karte|kreditkarte|carte|tarjeta)(?!\p{L})",
    "phone": r"(?i)(?<!\p{L})(?:phone|telephone|telefon|téléphone|teléfono|tel|call|fax|mobile|mobil|móvil|cell|contact|dial|whatsapp|sms|handy|rufnummer)(?!\p{L})",
}
NO_PHONE = r"(?i)(?<!\p{L})(?:order|invoice|isbn|issn|ean|ref|reference|serial|account|konto|iban|tracking|version|id|token|part|sku|doi)(?!\p{L})[\s.:#=]*$"
DATE = r"(?<![0-9])(?:(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2})(?![0-9])"
CUES = r"(?i)mail|phone|tel|call|fax|mobile|contact|card|visa|credit|host|address|ip\b"


def digits_of(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    """The check sum of card numbers; digits from the right, every second doubled."""
    digits = F.filter(F.split(F.reverse(digits_of(x)), ""), lambda c: c != "")
    double = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    total = F.aggregate(F.transform(digits, lambda c, i: F.when(i % 2 == 1, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda a, b: a + b)
    return total % 10 == 0


def passes(kind: str, x: Column) -> Column:
    """The base's own test of a match."""
    n = F.length(digits_of(x))
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(x, r"\."), lambda p: F.coalesce(F.substring(F.regexp_replace(p, "^0+", ""), 1, 4).try_cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return n.between(14, 19) & luhn(x)
    if kind == "phone":
        return n.between(10, 15)
    return F.lit(True)


#: Items that a running sum takes at once: arrays grow by copying, so long ones are put together from blocks.
BLOCK = 256


def running(items: Column, start: Column, kind: str, step) -> Column:
    """An array of what step(at, x) emits for each item, in order: step gives (the next at, an array). Time grows with the number of items."""
    none_yet = F.expr(f"cast(array() as array<{kind}>)")

    def inner(acc: Column, x: Column) -> Column:
        after, out = step(acc["at"], x)
        return F.struct(after.alias("at"), F.concat(acc["out"], out).alias("out"))

    def outer(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["at"].alias("at"), none_yet.alias("out")), inner)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out")))[0]

    def over(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size(own) - 1, F.lit(0)), F.lit(BLOCK)), lambda i: F.slice(own, i + 1, F.lit(BLOCK)))
        return F.aggregate(blocks, F.struct(start.alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out")), outer, lambda acc: F.flatten(acc["out"]))

    # Bound, so that the items are worked out once and not for each block.
    return F.transform(F.array(items), over)[0]


SPAN = "struct<start:int,end:int,value:string>"


def located(text: Column, pattern: str, keep) -> Column:
    """Spans (start, end, value) of the matches that keep() accepts; code points, end exclusive.

    The pieces between the matches, and the matches, give the places by running sums.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        begin = at + x["gap"]
        end = begin + F.length(x["value"])
        span = F.array(F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"), x["value"].alias("value")))
        return F.coalesce(end, begin).cast("int"), F.when(x["value"].isNotNull() & keep(x["value"]), span).otherwise(none())

    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("value"))
    return running(F.transform(zipped, lambda z: F.struct(z["gap"].alias("gap"), z["value"].alias("value"))), F.lit(0), SPAN, step)


def none() -> Column:
    return F.expr(f"cast(array() as array<{SPAN}>)")


#: Characters of a piece of text: a span's surroundings are cut from its piece, for cutting from a whole text counts characters from its start.
PIECE = 4096


def pieces(text: Column) -> Column:
    """The text in pieces of PIECE characters."""
    return F.when(F.length(text) <= PIECE, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))


def cut_out(parts: Column, start: Column, n: Column) -> Column:
    """n characters from start on of a text in pieces."""
    first = F.floor(start / PIECE).cast("int")
    near = F.slice(parts, first + 1, F.floor((start + n) / PIECE).cast("int") - first + 1)
    return F.substring(F.array_join(near, ""), start - first * PIECE + 1, n)


def around(span: Column, parts: Column) -> tuple[Column, Column]:
    """The context on the left, and the next character on the right, in a text in pieces."""
    begin = F.greatest(span["start"] - CONTEXT, F.lit(0))
    return cut_out(parts, begin, span["start"] - begin), cut_out(parts, span["end"], F.lit(1))


def in_context(span: Column, parts: Column) -> Column:
    """kind, value, left and right of a span with its kind, cut out once for all that looks at them."""
    left, right = around(span, parts)
    return F.struct(span["kind"].alias("kind"), span["value"].alias("value"), left.alias("left"), right.alias("right"))


def by_kind(kind: Column, of) -> Column:
    """of(k) for the k that kind names: one expression for all kinds."""
    out = F.when(kind == KINDS[0], of(KINDS[0]))
    for k in KINDS[1:-1]:
        out = out.when(kind == k, of(k))
    return out.otherwise(of(KINDS[-1]))


def bound(x: Column, use) -> Column:
    """use(x), with x worked out once. The driver generates no code for what is inside."""
    return F.transform(F.array(x), use)[0]


def signs(kind: str, c: Column) -> dict[str, Column]:
    """What a value says once it is undone, and the words and characters around it, as booleans.

    sound: an address with a domain, octets in range, a check sum that fits, 10 to 15 digits that are no date, row of numbers or address. marked: at and dot signs,
    an address in one piece, card groups, an international prefix or area code in brackets. cue, denied: a word before it speaks for the kind, or names
    a number as something else. glued: a letter, digit or underscore next to it.
    """
    value, left, right = c["value"], c["left"], c["right"]
    n, yes, no = F.length(digits_of(value)), F.lit(True), F.lit(False)
    glued = left.rlike(r"[\p{L}\p{N}_]$") | right.rlike(r"^[\p{L}\p{N}_]")
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, AT, "@"), DOT, "."), " ", "")
        return {"sound": plain.rlike(r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,24}$"), "marked": yes, "cue": left.rlike(CUES), "denied": no, "glued": glued}
    cue = left.rlike(SPEAKS[kind])
    if kind == "ip":
        in_range = F.forall(F.split(F.regexp_replace(value, " ", ""), r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(999)) <= 255)
        return {"sound": in_range, "marked": ~value.contains(" "), "cue": cue, "denied": no, "glued": glued}
    if kind == "card":
        grouped = value.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}(?:[^0-9]{1,3}[0-9]{4}){2,3}(?:[^0-9]{1,3}[0-9]{1,4})?|[0-9]{4}[^0-9]{1,3}[0-9]{6}[^0-9]{1,3}[0-9]{4,5})$")
        return {"sound": luhn(value), "marked": (n >= 14) & grouped, "cue": cue, "denied": no, "glued": glued}
    mixed = value.contains(".") & value.contains(" ")
    numbers = value.rlike(r"^[1-9][0-9]?(?:[\x20./-][0-9]{1,2})+$") | value.rlike(r"^(?:(?:19|20)[0-9]{2}[\x20./-]*)+$") | value.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$")
    return {"sound": n.between(10, 15) & ~mixed & ~numbers & ~value.rlike(DATE), "marked": value.rlike(r"^(?:\+|00[1-9]|\([0-9]{2,5}\))"), "cue": cue, "denied": left.rlike(NO_PHONE), "glued": glued}


def evidence(kind: str, c: Column) -> Column:
    """A weak label: 1 for a sound value that is marked or has a cue, 0 for one that is not sound, glued or denied, null where neither speaks.
    For fitting only; nothing is selected by it."""
    own = signs(kind, c)
    return F.when(~own["sound"] | own["glued"] | own["denied"], 0).when(own["marked"] | own["cue"], 1)


FEATURES = (
    "kind_id", "n_chars", "n_digits", "n_letters", "n_separators", "n_groups", "distinct", "left_word", "right_word", "left_punct", "right_punct",
    "sound", "marked", "cue", "denied", "glued",
)


def features(c: Column) -> Column:
    """Format of a value (in_context) and its context, as an array of doubles in the order of FEATURES; whether the base pattern matches is not among them."""
    value, left, right = c["value"], c["left"], c["right"]
    digits, own = digits_of(value), {k: signs(k, c) for k in KINDS}
    return F.array(
        by_kind(c["kind"], lambda k: F.lit(float(KINDS.index(k)))),
        *[x.cast("double") for x in (
            F.length(value),
            F.length(digits),
            F.length(F.regexp_replace(value, "[^A-Za-z]", "")),
            F.length(F.regexp_replace(value, "[A-Za-z0-9+]", "")),
            F.size(F.split(value, "[^A-Za-z0-9]+")),
            F.size(F.array_distinct(F.split(digits, ""))),
            left.rlike(r"[\p{L}\p{N}]$"),
            right.rlike(r"^[\p{L}\p{N}]"),
            left.rlike(r"[^\p{L}\p{N}\s]$"),
            right.rlike(r"^[^\p{L}\p{N}\s]"),
            *[by_kind(c["kind"], lambda k, n=n: own[k][n]) for n in ("sound", "marked", "cue", "denied")],
            own[KINDS[0]]["glued"],
        )],
    )


def masked(text: Column, parts: Column, spans: Column) -> Column:
    """The text with each span (start, end, in order of start) overwritten by as many characters that no pattern takes; parts is the text in pieces."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        begin = F.greatest(at, s["start"])
        return F.greatest(at, s["end"]), F.array(cut_out(parts, at, begin - at), F.repeat(F.lit("\x00"), F.greatest(s["end"] - begin, F.lit(0))))

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(running(spans, F.lit(0), "string", step), ""), F.substring(text, last + 1, F.length(text))))


def with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, parts (the text in pieces), base_<kind> and cand_<kind>: arrays of spans. Candidates may overlap each other; what the base has is masked before they are looked for."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    needs = {k: text.contains(BASE_NEEDS[k]) for k in BASE_NEEDS} | {"card": text.rlike("[0-9]")}
    base = {k: F.when(needs[k], located(text, PATTERNS[k], lambda x, k=k: passes(k, x))).otherwise(none()).alias(f"base_{k}") for k in KINDS}
    rows = rows.select("doc_id", "text", pieces(text).alias("parts"), *base.values())
    rows = rows.withColumn("_rest", masked(text, F.col("parts"), F.array_sort(F.concat(*[F.col(f"base_{k}") for k in KINDS]))))
    rest = F.col("_rest")
    wide = {k: F.when(rest.rlike(NEEDS[k]), located(rest, WIDE[k], lambda x: F.length(x) < 80)).otherwise(none()).alias(f"cand_{k}") for k in KINDS}
    return rows.select("doc_id", "text", "parts", *[f"base_{k}" for k in KINDS], *wide.values())


def variants(kind: str, value: Column, left: Column, right: Column) -> list[tuple[Column, Column, Column, Column]]:
    """(label, value, left, right) of ways to write a known value that the base patterns do not know (1), and of what only looks like it (0)."""
    one, zero, digits = F.lit(1), F.lit(0), digits_of(value)
    keep = lambda v, label=one, before=left, after=right: (label, v, before, after)
    if kind == "email":
        at = lambda sign, dot: F.regexp_replace(F.regexp_replace(value, "@", sign), r"\.", dot)
        wrong = F.concat(F.substring_index(value, "@", 1), F.lit("@"), F.length(value).cast("string"), F.lit(".5"))
        return [keep(value), keep(at(" (at) ", " (dot) ")), keep(at(" [AT] ", ".")), keep(at(" @ ", ".")), keep(at("(at)", ".")), keep(at(" [at] ", " [dot] ")), keep(wrong, zero), keep(F.regexp_replace(wrong, "@", " (at) "), zero)]
    if kind == "ip":
        spaced, wrong = F.regexp_replace(value, r"\.", " . "), F.concat(F.lit("7"), F.lpad(F.substring_index(value, ".", 1), 2, "0"), F.substring(value, F.locate(".", value), F.lit(20)))
        return [keep(value), keep(spaced), keep(F.regexp_replace(value, r"\.", ". ")), keep(wrong, zero), keep(F.regexp_replace(wrong, r"\.", " . "), zero), keep(value, zero, F.concat(left, F.lit("x")))]
    if kind == "card":
        grouped = lambda sign, d=digits: F.regexp_replace(d, r"(?<=[0-9])(?=(?:[0-9]{4})+$)", sign)
        wrong = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((F.substring(digits, -1, 1).cast("int") + 1) % 10).cast("string"))
        return [keep(value), keep(grouped(".")), keep(grouped("/")), keep(grouped("_")), keep(wrong, zero), keep(grouped(".", wrong), zero), keep(grouped(" ", wrong), zero), keep(digits, zero, F.concat(left, F.lit("a")), F.concat(F.lit("f"), right))]
    tail = F.substring(F.concat(F.lit("5550"), digits), -10, 10)
    parts = [F.substring(tail, a, n) for a, n in ((1, 3), (4, 3), (7, 4))]
    dashed, bracketed = F.concat_ws("-", *parts), F.concat(F.lit("("), parts[0], F.lit(") "), parts[1], F.lit("-"), parts[2])
    told = left.rlike(SPEAKS["phone"]).cast("int")
    pairs = F.concat_ws(" ", *[F.concat(F.lit(str(k)), F.substring(tail, k, 1)) for k in range(1, 8)])
    year = lambda k: F.concat(F.lit("20"), F.substring(tail, k, 2))
    days = F.concat_ws(" ", F.concat(year(1), F.lit("-01-15")), F.concat(year(3), F.lit("-02-15")))
    other = F.get(F.array(*[F.lit(x) for x in ("order ", "invoice no. ", "ref: ", "account ", "serial ")]), F.pmod(F.length(left), F.lit(5)).cast("int"))
    return [
        keep(value), keep(F.concat(F.lit("00"), F.substring(digits, 1, 2), F.lit(" "), F.substring(digits, 3, 2), F.lit(" "), F.substring(digits, F.lit(5), F.length(digits)))), keep(bracketed), keep(dashed, told), keep(F.concat_ws(" ", *parts), told), keep(tail, told),
        keep(tail, zero, other), keep(dashed, zero, other), keep(tail, zero, F.lit("it was ")), keep(pairs, zero), keep(F.concat_ws(" ", year(1), year(3), year(5)), zero), keep(days, zero), keep(tail, zero, F.concat(left, F.lit("x_")), F.concat(F.lit("_y"), right)),
    ]


#: Made-up values of each kind that take part in fitting beside the corpus's own, so that a corpus with few of a kind has trees for it, too.
SEEDS = 96
BEFORE = {
    "email": ("write to ", "mail: ", "contact ", "by ", "please ask "), "ip": ("the server ", "host ", "from ", "ip ", "address: "), "card": ("pay by ", "card ", "it is ", "visa: ", "by credit card "),
    "phone": ("call ", "tel. ", "the office is at ", "from abroad ", "phone: "),
}
AFTER = (" now", ".", " today, please", "", " answers")


def seeds(spark: SparkSession) -> DataFrame:
    """kind, value, left, right of SEEDS values a kind, from hashes of their numbers."""
    digits = F.translate(F.md5(F.concat(F.lit("seed"), F.col("id").cast("string")).cast("binary")), "abcdef", "012345")
    part = lambda a, n: F.substring(digits, a, n)
    octet = lambda a: (part(a, 3).cast("int") % 256).cast("string")
    names = F.array(*[F.lit(x) for x in ("jane.doe", "info", "j_smith", "mary-ann", "a.b.c", "sales99")])
    ends = F.array(*[F.lit(x) for x in ("com", "org", "de", "co.uk", "example.net", "fr")])
    pick = lambda xs, a: F.get(xs, (part(a, 2).cast("int") % F.size(xs)).cast("int"))
    first = F.concat(F.lit("4"), part(1, 14))
    values = {
        "email": F.concat(pick(names, 1), F.lit("@host"), part(3, 2), F.lit("."), pick(ends, 5)),
        "ip": F.concat_ws(".", octet(1), octet(4), octet(7), octet(10)),
        "card": F.concat(first, F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(first, d.cast("string"))))[0].cast("string")),
        "phone": F.concat(F.lit("+"), (part(1, 1).cast("int") + 30).cast("string"), F.lit(" "), part(3, 2), F.lit(" "), part(5, 8)),
    }
    turn = lambda xs, step: F.get(F.array(*[F.lit(x) for x in xs]), (F.floor(F.col("id") / step) % len(xs)).cast("int"))
    of = lambda k: F.struct(F.lit(k).alias("kind"), values[k].alias("value"), turn(BEFORE[k], 1).alias("left"), turn(AFTER, len(BEFORE[k])).alias("right"))
    every = bound(F.col("id"), lambda _: F.array(*[of(k) for k in KINDS]))
    return spark.range(SEEDS).select(F.xxhash64("id").alias("draw"), F.explode(every).alias("s")).select("s.*", "draw")


def places(rows: DataFrame) -> DataFrame:
    """kind, known (by the base), value, left, right (CONTEXT characters each) and draw of all that the base and the generators found in rows of with_spans,
    in one pass over the texts. draw is one for all of a document."""

    def placed(kind: str, known: bool):
        def one(s: Column) -> Column:
            left, _ = around(s, F.col("parts"))
            return F.struct(F.lit(kind).alias("kind"), F.lit(known).alias("known"), s["value"].alias("value"), left.alias("left"), cut_out(F.col("parts"), s["end"], F.lit(CONTEXT)).alias("right"))

        return one

    own = F.concat(*[F.transform(f"{name}_{kind}", placed(kind, name == "base")) for kind in KINDS for name in ("base", "cand")])
    return rows.select(F.xxhash64("text").alias("draw"), F.explode(own).alias("p")).select("draw", "p.*")


def at_hand() -> Column:
    """in_context of a place: CONTEXT characters on the left and one on the right."""
    return F.struct("kind", "value", F.substring("left", -CONTEXT, CONTEXT).alias("left"), F.substring("right", 1, 1).alias("right"))


def labelled(found: DataFrame, unknown: bool) -> DataFrame:
    """kind, label, draw and features of rows (kind, value, left, right, draw, perhaps label); a null label is evidence's. Where that does not speak a
    candidate is left out, or (unknown) counts as none."""
    found = found if "label" in found.columns else found.withColumn("label", F.lit(None).cast("double"))
    told = bound(F.col("c"), lambda c: by_kind(c["kind"], lambda k: evidence(k, c))).cast("double")
    rows = found.select("kind", "draw", "label", at_hand().alias("c")).withColumn("label", F.coalesce("label", told, F.lit(0.0)) if unknown else F.coalesce("label", told))
    return rows.where("label IS NOT NULL").select("kind", "label", "draw", bound(F.col("c"), features).alias("features"))


def candidates(rows: DataFrame, unknown: bool = False) -> DataFrame:
    """What the base and the generators found in rows of with_spans, labelled by evidence; where it does not speak a candidate is left out, or (unknown)
    counts as none. draw is one for all candidates of a document."""
    return labelled(places(rows), unknown)


def training(found: DataFrame) -> DataFrame:
    """All candidates of places, labelled, and the known values of their base and of the seeds in all variants, in one pass."""
    way = lambda label, v, a, b: F.struct(label.cast("double").alias("label"), v.alias("value"), a.alias("left"), b.alias("right"))
    nothing = F.expr("cast(array() as array<struct<label:double,value:string,left:string,right:string>>)")

    def ways(x: Column) -> Column:
        rewritten = by_kind(x["kind"], lambda k: F.array(*[way(*v) for v in variants(k, x["value"], x["left"], x["right"])]))
        own = F.when(x["own"], F.array(way(F.lit(None), x["value"], x["left"], x["right"]))).otherwise(nothing)
        return F.concat(own, F.when(x["known"], rewritten).otherwise(nothing))

    made_up = seeds(found.sparkSession).withColumns({"known": F.lit(True), "own": F.lit(False)})
    rows = found.withColumn("own", F.lit(True)).unionByName(made_up)
    rows = rows.select("kind", "draw", F.explode(bound(F.struct("kind", "value", "left", "right", "known", "own"), ways)).alias("w")).select("kind", "draw", "w.*")
    return labelled(rows, unknown=True)


def tree_expression(node, row: Column) -> Column:
    """A node of a fitted tree, and what is below it, as nested conditions over an array of features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(row[split.featureIndex()] <= F.lit(float(split.threshold())), tree_expression(node.leftChild(), row)).otherwise(tree_expression(node.rightChild(), row))


def boosted(model, row: Column) -> Column:
    """The margin of the boosted trees for an array of features."""
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights, strict=True):
        total = total + F.lit(float(weight)) * tree_expression(tree._java_obj.rootNode(), row)
    return total


def fit(found: DataFrame, *, precision: float = PRECISION) -> tuple[object | None, dict[str, float]]:
    """Trees from all labelled candidates of places, and for each kind the least
    margin at which the held-out documents' part of them reaches the precision (none reaches it: no threshold).

    Candidates of equal features are one weighted row, so the table that is fitted hardly grows with the corpus."""
    all_of = training(found).withColumn("held", F.pmod(F.col("draw"), F.lit(4)) == 0)
    table_ = cut(all_of.groupBy("kind", "held", "label", "features").agg(F.count("*").cast("double").alias("weight")))
    n = table_.agg(F.count("*").alias("rows"), *[F.count_if(~F.col("held") & (F.col("label") == v)).alias(n) for n, v in (("yes", 1), ("no", 0))]).first()
    if not n["yes"] or not n["no"]:
        return None, {}
    # Each level of each tree is a job: with a task for each shuffle partition the driver would hold more about tasks than the table has rows.
    table_ = table_.coalesce(math.ceil(n["rows"] / FIT_ROWS))
    train = table_.where("NOT held").select(array_to_vector("features").alias("features"), "label", "weight")
    # With so many bins the places of splits come from all rows: beyond 10,000 of them they come from a sample of bins * bins.
    bins = 32 if n["rows"] <= 10_000 else math.isqrt(n["rows"]) + 1
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, maxBins=bins, seed=7, labelCol="label", weightCol="weight").fit(train)
    margin = boosted(model, F.col("features"))
    # Calibration: how many held-out candidates at or above each margin are right; few distinct margins.
    levels = table_.where("held").groupBy("kind", F.round(margin, 6).alias("margin")).agg(F.sum(F.col("label") * F.col("weight")).alias("yes"), F.sum("weight").alias("n"))
    thresholds: dict[str, float] = {}
    sums: dict[str, list[float]] = {}
    for r in levels.orderBy("kind", F.desc("margin")).collect():
        own = sums.setdefault(r["kind"], [0.0, 0.0])
        own[0] += r["yes"]
        own[1] += r["n"]
        if own[0] >= precision * own[1]:
            thresholds[r["kind"]] = r["margin"]
    return model, thresholds


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", precision: float = PRECISION) -> DataFrame:
    """One row per document: doc_id, text, base and spans, arrays of (start, kind_id, end).

    base holds the matches of the four base patterns that pass their tests; spans adds
    the candidates whose boosted margin reaches the threshold of their kind and that overlap no earlier one of these: the trees decide on
    every candidate. They are fitted on the candidates of all documents, labelled by evidence, and on the known values of the base, and some made-up
    ones, rewritten as people rewrite them to hide them from patterns and as numbers that only look like them; thresholds are the least margins at which a
    quarter of the documents, held out, gives the precision. Trees are evaluated inside the row as nested conditions,
    so documents are read in place and never shuffled. Time grows with the number of spans.

    Of candidates that begin at one place the kind listed first counts; a margin equal to its threshold is selected.
    A null text is empty. Repeated rows give repeated rows; an empty table an empty result. Scoring covers all documents.
    """
    rows = with_spans(docs, id_col, text_col)
    model, thresholds = fit(places(rows), precision=precision)
    placed = "struct<start:int,kind_id:int,end:int>"
    empty = F.expr(f"cast(array() as array<{placed}>)")
    shape = lambda kind: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind_id"), s["end"].alias("end"))
    base = F.array_sort(F.concat(*[F.transform(f"base_{k}", shape(k)) for k in KINDS]))
    rows = rows.withColumn("base", F.coalesce(base.cast(f"array<{placed}>"), empty))

    def selected() -> Column:
        # Bound step by step: a node of a tree looks at an array of numbers, not at how they came about. One set of trees for the candidates of all kinds:
        # what the driver plans does not grow with their number.
        told = lambda k: lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind_id"), s["end"].alias("end"), F.lit(k).alias("kind"), s["value"].alias("value"))
        every = F.concat(*[F.transform(f"cand_{k}", told(k)) for k in KINDS if k in thresholds])
        score = lambda s: bound(in_context(s, F.col("parts")), lambda c: bound(features(c), lambda row: F.round(boosted(model, row), 6)))
        least = lambda s: by_kind(s["kind"], lambda k: F.lit(float(thresholds.get(k, math.inf))))
        chosen = F.filter(every, lambda s: score(s) >= least(s))
        placed_only = lambda s: F.struct(s["start"].alias("start"), s["kind_id"].alias("kind_id"), s["end"].alias("end"))
        return F.when(F.size(every) > 0, F.transform(chosen, placed_only)).otherwise(empty)

    rows = rows.withColumn("extra", F.array_sort(selected()) if thresholds else empty)

    def earliest(upto: Column, s: Column) -> tuple[Column, Column]:
        free = s["start"] >= upto
        return F.when(free, s["end"]).otherwise(upto), F.when(free, F.array(s)).otherwise(empty)

    first = running(F.col("extra"), F.lit(0), placed, earliest)
    spans = F.when(F.size("extra") == 0, F.col("base")).otherwise(F.array_sort(F.concat("base", first)))
    return rows.select("doc_id", "text", "base", spans.alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind_id"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans the first stands for both."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def all_of(parts: Column) -> Column:
        def step(at: Column, s: Column) -> tuple[Column, Column]:
            own = F.array(cut_out(parts, at, s["start"] - at), F.get(names, s["kind_id"]))
            return F.greatest(at, s["end"]), F.when(s["start"] >= at, own).otherwise(F.expr("cast(array() as array<string>)"))

        return F.array_join(running(spans, F.lit(0), "string", step), "")

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    return F.concat(F.transform(F.array(pieces(text)), all_of)[0], F.substring(text, last + 1, F.length(text)))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with their columns; selected spans in the text are replaced by [KIND]. A null text stays null.

    The text travels with its row, so nothing is joined back.
    """
    names = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    found = find_pii(packed, id_col="_row", text_col="_text", **options)
    text = F.when(F.col("doc_id")[text_col].isNull(), F.lit(None)).when(F.size("spans") == 0, F.col("text")).otherwise(redacted(F.col("text"), F.col("spans")))
    return found.select(*[text.alias(n) if n == text_col else F.col("doc_id")[n].alias(n) for n in names])


def of_kind(i: int):
    return lambda k: F.when(k == i, k)


def op6_find_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    found = found.withColumn("kinds", F.transform("base", lambda s: s["kind_id"]))
    counts = [F.size(F.array_compact(F.transform("kinds", of_kind(i)))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))
