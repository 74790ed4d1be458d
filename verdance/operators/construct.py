"""Building prompts and fine-tuning data: cleaning, sampling, trimming, choosing, repairing, exporting."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdance.functions import helpers as H
from verdance.functions import measures as M
from verdance.sources.shared import cut, ranked, stored

from .checkers import evaluate, say
from .rollups import sample_pass_rate
from .settings import Settings

#: Lines of sites, page marks, and words of a query that conflict with a checker.
NAVIGATION = r"^(?:首页|登录|注册|网站地图|联系我们|版权所有|ICP备)"
PAGE_MARK = rf"^第{M.S}*{M.D}+{M.S}*页"
CONFLICTS = {
    "check_no_table": ["表格", "制表", "表格形式", "表格呈现", "列表形式呈现"],
    "check_no_list": ["列表", "清单形式", "用列表", "以列表"],
}
#: Constraints that exclude each other, those that JSON excludes, tags drawn more often.
EXCLUSIONS = [("check_markdown_table", "check_no_table"), ("check_ordered_list_count", "check_no_list")]
JSON_FORMAT = "check_json_format"
JSON_EXCLUDES = [
    "check_markdown_table", "check_ordered_list_count", "check_section_count", "check_heading_level", "check_heading_depth", "check_blockquote_count", "check_no_table", "check_no_list",
]
TAG_BOOST = {"N3": 3.0, "S3": 3.0, "F4": 3.0}
#: Constraints that cannot be acted on beside JSON.
BESIDE_JSON = ["check_first_word", "check_first_last_line", "check_first_line_format"]
#: What opens the block of constraints in a prompt, and constraints whose texts are parameterized.
BLOCK_HEAD = "请在回答时严格遵守以下附加要求："
BLOCK_MARK = "附加要求"
PARAMETERIZED = ("F6", "F7", "F8", "F9", "F10", "F11", "F12")


def draw(seed: str, *keys: Column) -> Column:
    """A seeded draw of 48 bits that depends on the keys only."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *keys).cast("binary")), 1, 12), 16, 10).cast("long")


def uniform(seed: str, *keys: Column) -> Column:
    """A seeded draw from (0, 1) that depends on the keys only."""
    return (draw(seed, *keys).cast("double") + 1) / F.lit(2.0**48 + 2)


def clean_context_text(raw: Column) -> Column:
    """Trimmed lines without those that open with a link, page numbers and marks, scraps without Chinese, and site navigation."""
    out = lambda x: x.rlike("^https?://") | x.rlike(rf"^{M.D}+{M.S}*/{M.S}*{M.D}+$") | x.rlike(PAGE_MARK) | ((F.length(x) < 3) & ~x.rlike("[一-鿿]")) | x.rlike(NAVIGATION)
    return F.array_join(F.filter(M.nonblank(raw), lambda x: ~out(x)), "\n")


def context_pool(raw: DataFrame, *, least: int = 100, most: int = 6000) -> DataFrame:
    """Cleaned contexts of (name, l2, raw), numbered in name order over all that are kept: context_id is EXT-<l2>-nnn.

    Numbers have three digits at least. The cut at `most` characters is part of the pool's definition. Only names are
    sorted and numbered, in ranges; texts are joined back. Names are unique.
    """
    kept = raw.select("name", "l2", clean_context_text(F.col("raw")).alias("text")).where(F.length("text") >= least)
    numbers = ranked(kept.select(F.col("name").alias("_name"), F.col("l2").alias("_l2")), F.col("_name"), F.col("_l2"))
    number = (F.col("rank") + 1).cast("string")
    numbers = numbers.select("_name", "_l2", F.when(F.col("rank") < 999, F.lpad(number, 3, "0")).otherwise(number).alias("_number"))
    rows = kept.select("name", "l2", F.substring("text", 1, most).alias("text")).join(numbers, (F.col("name") == F.col("_name")) & F.col("l2").eqNullSafe(F.col("_l2")))
    return rows.select("name", "l2", "text", F.concat(F.lit("EXT-"), "l2", F.lit("-"), "_number").alias("context_id"), F.length("text").cast("long").alias("char_count"), extract_labelled_values(F.col("text")).alias("extracted_values"))


def extract_labelled_values(text: Column) -> Column:
    """Label to number and unit by six patterns in order; at most 15 labels."""
    return H.labelled_values(text)


def query_conflicts(query: Column) -> Column:
    """The checkers that a query's words speak against."""
    speaks = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: query.contains(w))
    return F.array_compact(F.array(*[F.when(speaks(words), F.lit(name)) for name, words in CONFLICTS.items()]))


def pool_candidates(samples: DataFrame, pool: DataFrame) -> DataFrame:
    """sample_id and constraint_id of the constraints allowed for a sample: its tier is applicable (none given: all are) and
    its query's words neither conflict with the checker nor are among blocked_by.

    samples: sample_id, l1, query. pool: constraint_id, applicable (tiers), blocked_by (words, may be null). Joined on the tier.
    """
    tiers = F.when(F.size("applicable") > 0, F.col("applicable")).otherwise(F.array(F.lit("*")))
    entries = pool.select("constraint_id", F.coalesce("blocked_by", F.expr("cast(array() as array<string>)")).alias("_blocked"), F.explode(F.array_distinct(tiers)).alias("_tier"))
    rows = samples.select("sample_id", F.coalesce("query", F.lit("")).alias("_query"), F.explode(F.array(F.col("l1"), F.lit("*"))).alias("_tier"))
    joined = rows.withColumn("_against", query_conflicts(F.col("_query"))).join(entries, "_tier")
    fine = ~F.exists("_blocked", lambda w: F.lower("_query").contains(w)) & ~F.array_contains("_against", F.col("constraint_id"))
    return joined.where(fine).select("sample_id", "constraint_id")


def conflict_audit(sampled: DataFrame, samples: DataFrame) -> DataFrame:
    """constraint_id and the samples in which a drawn checker conflicts with the query. sampled: sample_id, constraint_id; samples: sample_id, query."""
    against = samples.select("sample_id", F.explode(query_conflicts(F.coalesce("query", F.lit("")))).alias("constraint_id"))
    return sampled.join(against, ["sample_id", "constraint_id"], "left_semi").groupBy("constraint_id").agg(F.countDistinct("sample_id").alias("conflicts"))


def sample_constraint_count(key: Column, weights: Sequence[int] = (10, 20, 30, 25, 15), seed: str = "count") -> Column:
    """1 to len(weights) by weight."""
    u, total, upto = uniform(seed, key) * sum(weights), 0, None
    for i, w in enumerate(weights):
        total += w
        upto = F.when(u < total, i + 1) if upto is None else upto.when(u < total, i + 1)
    return upto.otherwise(len(weights)).cast("long")


def exclusions() -> dict[str, list[str]]:
    """Each constraint with those it cannot stand beside, both ways."""
    found: dict[str, set[str]] = {}
    for a, b in [*EXCLUSIONS, *[(JSON_FORMAT, x) for x in JSON_EXCLUDES]]:
        found.setdefault(a, set()).add(b)
        found.setdefault(b, set()).add(a)
    return {k: sorted(v) for k, v in found.items()}


_NONE = "cast(array() as array<string>)"
_HELD = "array<struct<turn:int,o:double,id:string,p:bigint,excludes:array<string>>>"


def proposed(samples: DataFrame, turn: int) -> DataFrame:
    """samples with `new`: what each asks for beyond what it holds. It goes through its candidates in order, up to n in all, and passes over
    those that turned it away and those that exclude, or are excluded by, one it has."""
    start = F.struct(
        F.transform("held", lambda h: h["id"]).alias("ids"),
        F.flatten(F.transform("held", lambda h: h["excludes"])).alias("barred"),
        F.expr(f"cast(array() as {_HELD})").alias("new"),
    )

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["ids"]) < F.col("n")) & ~F.array_contains(acc["ids"], x["id"]) & ~F.array_contains("closed", x["id"])
        fits &= ~F.array_contains(acc["barred"], x["id"]) & ~F.arrays_overlap(acc["ids"], F.concat(x["excludes"], x["later"]))
        taken = F.struct(F.lit(turn).alias("turn"), x["o"].alias("o"), x["id"].alias("id"), x["p"].alias("p"), x["excludes"].alias("excludes"))
        return F.when(fits, F.struct(F.array_append(acc["ids"], x["id"]).alias("ids"), F.concat(acc["barred"], x["excludes"]).alias("barred"), F.array_append(acc["new"], taken).alias("new"))).otherwise(acc)

    return samples.withColumn("new", F.aggregate("c", start, step, lambda acc: acc["new"]))


def cut_offs(asking: DataFrame, most: DataFrame, bits: int = 16) -> DataFrame:
    """id, p, s: of each constraint that more samples ask for than it may have, the last (p, s) it keeps. asking: id, p, s; most: id, most.

    Draws are counted by their leading bits; only those in the bucket in which the count passes `most` are put in order.
    """
    bucket = F.shiftright("p", 48 - bits)
    counts = asking.groupBy("id", bucket.alias("bucket")).agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("id").orderBy("bucket"))  # at most 2 ** bits rows of a constraint
    counts = counts.withColumn("upto", upto).join(most, "id").where("upto > most AND upto - k <= most")
    edge = counts.groupBy("id").agg(F.min(F.struct("bucket", (F.col("most") - F.col("upto") + F.col("k")).alias("left"))).alias("e")).select("id", "e.bucket", "e.left")
    near = asking.withColumn("bucket", bucket).join(edge, ["id", "bucket"])
    order = F.row_number().over(Window.partitionBy("id").orderBy("p", "s"))
    kept = near.withColumn("at", order).where("at <= left").groupBy("id").agg(F.max(F.struct("p", "s")).alias("last"))
    # Where the bucket's first draw is already beyond, all of the bucket is.
    return edge.join(kept, "id", "left").select("id", F.coalesce("last.p", F.shiftleft("bucket", 48 - bits) - 1).alias("p"), F.coalesce("last.s", F.lit("")).alias("s"))


def beyond(full: dict[str, tuple[int, str]], key: Column) -> Callable[[Column], Column]:
    """Whether a held constraint is full with samples of lesser (p, key)."""
    ends = F.create_map(*[x for k, (p, s) in full.items() for x in (F.lit(k), F.struct(F.lit(p).alias("p"), F.lit(s).alias("s")))])

    def over(h: Column) -> Column:
        end = F.try_element_at(ends, h["id"])
        return F.coalesce((h["p"] > end["p"]) | ((h["p"] == end["p"]) & (key > end["s"])), F.lit(False))

    return over


def sample_constraints(candidates: DataFrame, counts: DataFrame, *, seed: str = "draw", rounds: int | None = None) -> DataFrame:
    """A weighted draw without replacement for each sample: sample_id, constraint_id, position.

    candidates: sample_id, constraint_id, and what there is of weight (1), tag (some are drawn more often), type, inv, cap (uses
    per 100 samples), excludes (an array; excluded both ways, besides the fixed pairs and what JSON excludes) and template_excludes (kept
    from standing after these). counts: sample_id, n. Hard constraints are capped where inv, soft ones always; a capped one is used at
    most max(1, cap * samples / 100) times.

    Deferred acceptance: each sample goes through its candidates in the order of -ln(u) / weight and asks for the first n that
    exclude none of the others; a capped constraint keeps the samples of the least seeded draws, earlier ones or new, and turns the rest away for good; these ask for
    their next ones, until nobody is turned away (or for `rounds` rounds, if given: what is over then stays out). A constraint that is full stays full, so in the end a sample has fewer than n
    only if each other candidate of its own is full with samples of lesser draws or excluded by what it has. Draws depend on keys only, not on partitions; sequential weights of
    the form 1 / (uses + 1) are replaced by equal ones under these caps. A round takes one pass over the samples, and only the cut-offs, one a capped constraint at
    most, come to the driver. Samples of counts without candidates, or with n of 0 or null, have no rows; a constraint listed twice for a sample is one, of its lesser order.
    """
    have = lambda c, default: F.col(c) if c in candidates.columns else F.lit(None).cast(default)
    boost = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TAG_BOOST.items() for x in kv]), have("tag", "string")), F.lit(1.0))
    fixed = F.create_map(*[x for k, v in exclusions().items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])
    name, key, none = F.col("constraint_id").cast("string"), F.col("sample_id").cast("string"), F.expr(_NONE)
    capped = F.when((have("type", "string") == "soft") | F.coalesce(have("inv", "boolean"), F.lit(False)), have("cap", "long"))
    entry = F.struct(
        (-F.ln(uniform(seed, key, name)) / (F.coalesce(have("weight", "double"), F.lit(1.0)) * boost)).alias("o"),
        name.alias("id"),
        F.when(capped.isNotNull(), draw(f"{seed}-cap", name, key)).alias("p"),
        F.concat(F.coalesce(F.try_element_at(fixed, name), none), F.coalesce(have("excludes", "array<string>"), none)).alias("excludes"),
        F.coalesce(have("template_excludes", "array<string>"), none).alias("later"),
    )
    # A sample's candidates are at most the pool.
    own = candidates.groupBy("sample_id").agg(F.array_sort(F.collect_list(entry)).alias("c"))
    samples = own.join(counts.select("sample_id", "n"), "sample_id").select("sample_id", "n", "c", F.expr(f"cast(array() as {_HELD})").alias("held"), none.alias("closed"))
    placed = lambda df: df.select("sample_id", F.posexplode(F.array_sort("held"))).select("sample_id", F.col("col.id").alias("constraint_id"), (F.col("pos") + 1).alias("position"))
    if "cap" not in candidates.columns:
        return placed(proposed(samples, 0).withColumn("held", F.col("new")))
    samples, total, turn = cut(samples), counts.count(), 0
    most = candidates.select(name.alias("id"), capped.alias("cap")).where("cap IS NOT NULL").groupBy("id").agg(F.greatest(F.lit(1), F.floor(F.max("cap") * total / 100)).alias("most"))
    most = cut(most)
    while True:
        asked = cut(proposed(samples, turn).select("sample_id", "n", "c", "closed", F.concat("held", "new").alias("held")))
        asking = asked.select(key.alias("s"), F.explode("held").alias("h")).where("h.p IS NOT NULL").select("h.id", "h.p", "s")
        full = {r["id"]: (r["p"], r["s"]) for r in cut_offs(asking, most).toLocalIterator()}
        if not full:
            return placed(asked)
        over = beyond(full, key)
        away = F.transform(F.filter("held", over), lambda h: h["id"])
        samples = asked.select("sample_id", "n", "c", F.filter("held", lambda h: ~over(h)).alias("held"), F.concat("closed", away).alias("closed"))
        turn += 1
        if turn == rounds:
            return placed(samples)


PARAM = (
    "type string, range array<bigint>, step bigint, options array<string>, relative_to string, offset array<bigint>, pool array<string>, default string, examples array<string>, "
    "optional boolean, pool_by_trigger map<string,array<string>>"
)
#: Parts of samples that leave an optional parameter out, and what follows a trigger without a pool of its own (a fixed value).
OPTIONAL_DROP, FOLLOWUP = 0.4, "风险"


def sample_int_param(key: Column, low: Column | int, high: Column | int, step: Column | int = 1, seed: str = "param") -> Column:
    """A value of low, low + step, ... up to high; low where there is none."""
    low, high, step = (x if isinstance(x, Column) else F.lit(x) for x in (low, high, step))
    n = F.floor((high - low) / step) + 1
    return F.when(n > 0, low + step * F.floor(uniform(seed, key) * n)).otherwise(low).cast("long")


def chosen(key: Column, values: Column, seed: str) -> Column:
    """One of an array by a seeded draw."""
    return F.get(values, F.floor(uniform(seed, key) * F.size(values)).cast("int"))


def sample_params(key: Column, checker: Column, space: Column, defaults: Column, tier: Column) -> Column:
    """Parameters of a drawn constraint as a map, from its param_space and task_defaults (JSON objects).

    Whole numbers come from options or a range with a step (a range of the task's tier wins), or lie at an offset from another parameter;
    texts from a pool, options, a default or examples; lists from a pool or a default (as JSON); booleans are their default. Optional ones
    are left out for 40 % of keys. The follow-up of a conditional trigger comes from the trigger's own pool.
    Draws depend on the key and the parameter's name only.
    """
    specs = F.map_entries(F.coalesce(F.from_json(space, "map<string,string>"), F.expr("cast(map() as map<string,string>)")))
    own = F.try_element_at(F.from_json(defaults, "map<string,map<string,array<bigint>>>"), tier)
    spec = lambda e: F.from_json(e["value"], PARAM)
    draw = lambda e: F.concat_ws("|", key, checker, e["key"])
    kept = F.filter(specs, lambda e: ~(F.coalesce(spec(e)["optional"], F.lit(False)) & (uniform("optional", draw(e)) < OPTIONAL_DROP)))
    parsed = F.transform(kept, lambda e: F.struct(e["key"].alias("key"), spec(e).alias("s"), draw(e).alias("d")))

    def whole(e: Column) -> Column:
        given = F.try_element_at(own, e["key"])
        bounds = F.coalesce(given, e["s"]["range"])
        return F.coalesce(chosen(e["d"], e["s"]["options"], "option"), sample_int_param(e["d"], bounds[0], bounds[1], F.coalesce(e["s"]["step"], F.lit(1))).cast("string"))

    def text(e: Column) -> Column:
        s = e["s"]
        return F.coalesce(chosen(e["d"], s["pool"], "pool"), chosen(e["d"], s["options"], "option"), s["default"], chosen(e["d"], s["examples"], "example"), F.lit(""))

    def value(e: Column) -> Column:
        kind = F.coalesce(e["s"]["type"], F.lit("string"))
        listed = F.coalesce(chosen(e["d"], e["s"]["pool"], "pool"), e["s"]["default"], F.lit("[]"))
        return F.when(kind == "int", whole(e)).when(kind == "string_list", listed).when(kind == "bool", F.coalesce(e["s"]["default"], F.lit("true"))).otherwise(text(e))

    base = F.map_from_entries(F.transform(F.filter(parsed, lambda e: e["s"]["relative_to"].isNull()), lambda e: F.struct(e["key"].alias("key"), value(e).alias("value"))))

    def placed(first: Column) -> Column:
        def relative(e: Column) -> Column:
            at = F.try_element_at(first, e["s"]["relative_to"]).try_cast("long")
            bounds = F.coalesce(F.try_element_at(own, F.concat(e["key"], F.lit("_offset"))), F.try_element_at(own, e["key"]), e["s"]["offset"])
            return sample_int_param(e["d"], at + bounds[0], at + bounds[1], F.coalesce(e["s"]["step"], F.lit(1))).cast("string")

        more = F.map_from_entries(F.transform(F.filter(parsed, lambda e: e["s"]["relative_to"].isNotNull()), lambda e: F.struct(e["key"].alias("key"), relative(e).alias("value"))))
        return F.map_concat(first, more)

    def followed(params: Column) -> Column:
        trigger = F.try_element_at(params, F.lit("trigger"))
        pools = F.get(F.transform(F.filter(specs, lambda e: e["key"] == "followup"), lambda e: spec(e)["pool_by_trigger"]), F.lit(0))
        pool = F.coalesce(F.try_element_at(pools, trigger), F.array(F.lit(FOLLOWUP)))
        new = F.create_map(F.lit("followup"), chosen(F.concat_ws("|", key, checker, F.lit("followup")), pool, "pool"))
        rest = F.map_filter(params, lambda k, _: k != "followup")
        return F.when((checker == "check_conditional_trigger") & trigger.isNotNull(), F.map_concat(rest, new)).otherwise(params)

    return M.bind(M.bind(base, placed), followed)


def filled_hint(hint: Column, params: Column) -> Column:
    """{name} filled from a map, lists joined; {forbidden_desc} and {kw1}, {kw2} from the lists they stand for; what stays unfilled is dropped."""
    listed = lambda v: F.when(F.ltrim(v).startswith("["), F.from_json(v, "array<string>"))
    shown = lambda v: F.coalesce(F.array_join(listed(v), "、"), v)
    filled = F.aggregate(F.map_entries(params), hint, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), shown(e["value"])))
    words = lambda k: listed(F.try_element_at(params, F.lit(k)))
    quoted = F.array_join(F.transform(words("forbidden"), lambda w: F.concat(F.lit("“"), w, F.lit("”"))), "、")
    one = F.get(words("required_keywords"), F.lit(0))
    two = F.coalesce(F.get(words("required_keywords"), F.lit(1)), one)
    for mark, value in (("{forbidden_desc}", quoted), ("{kw1}", one), ("{kw2}", two)):
        filled = F.when(value.isNotNull(), F.replace(filled, F.lit(mark), value)).otherwise(filled)
    bare = F.regexp_replace(F.regexp_replace(filled, rf'[，,]{M.S}*{M.NS}*"\{{[a-z_]+\}}"', ""), r"\{[a-z_]+\}", "")
    return F.regexp_replace(M.strip(bare), "[，,]+$", "")


def render_constraint_text(constraints: Column) -> Column:
    """The block of constraints of a prompt: a head line and numbered texts. constraints: structs of type, description (soft), text_hint and params (hard)."""
    text = lambda c: F.when(c["type"] == "soft", F.coalesce(c["description"], F.lit(""))).otherwise(filled_hint(F.coalesce(c["text_hint"], F.lit("")), c["params"]))
    return F.array_join(F.concat(F.array(F.lit(BLOCK_HEAD)), F.transform(constraints, lambda c, i: F.concat(bracketed(i + 1), text(c)))), "\n")


def bracketed(number: Column) -> Column:
    return F.concat(F.lit("（"), number.cast("string"), F.lit("）"))


def numbered(texts: Column) -> Column:
    """An array of texts as a numbered block."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


#: How many cases of each size keep how many constraints, in this order; the last takes what is left.
TRIM_QUOTAS = {3: [(3, None)], 4: [(1, 15), (2, 7), (3, None)], 5: [(2, 13), (3, 4), (4, None)], 6: [(4, 13), (5, None)]}


def trim_targets(cases: DataFrame, quotas: dict[int, list[tuple[int, int | None]]] | None = None, *, seed: str = "trim") -> DataFrame:
    """keep for each case (item_id, n): within its size a seeded order is cut into slices by quota; sizes without quotas keep all.

    The order is over sizes and draws in ranges, so no size is sorted in one task; only the first rank of each size is looked up.
    """
    quotas = TRIM_QUOTAS if quotas is None else quotas
    placed = ranked(cases, F.col("n"), uniform(seed, F.col("item_id").cast("string")), F.col("item_id"))
    first = placed.groupBy(F.col("n").alias("_n")).agg(F.min("rank").alias("_first"))
    within = F.col("rank") - F.col("_first")
    keep = None
    for size, slices in quotas.items():
        upto, chain = 0, None
        for target, quota in slices:
            upto += quota or 0
            test = F.lit(True) if quota is None else within < upto
            chain = F.when(test, target) if chain is None else chain.when(test, target)
        keep = F.when(F.col("n") == size, chain) if keep is None else keep.when(F.col("n") == size, chain)
    return placed.join(first, F.col("n") == F.col("_n")).select("item_id", "n", F.coalesce(keep, F.col("n")).cast("long").alias("keep"))


def trim_constraints(constraints: DataFrame, targets: DataFrame) -> DataFrame:
    """Keeps `keep` constraints of each case: second ones of a tag go first, then tags most frequent overall (counted before trimming)."""
    freq = constraints.groupBy(F.col("tag").alias("_tag")).agg(F.count("*").alias("_freq"))
    rows = constraints.join(freq, F.col("tag").eqNullSafe(F.col("_tag"))).drop("_tag")
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("item_id", "tag").orderBy("constraint_index")))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.when(F.col("_nth") > 1, 1).otherwise(0), "_freq", "constraint_index"))
    return rows.withColumn("_rank", rank).join(targets.select("item_id", "keep"), "item_id").where("_rank <= keep").select("item_id", "constraint_index", "tag")


def renumber_prompt(prompt: Column, keep: Column) -> Column:
    """The prompt with only the kept (zero-based) of its numbered requirement lines, numbered anew.

    They are the lines （n）text after the line that speaks of additional requirements, up to the first other line that is not blank. A prompt without such a line stays.
    """
    item = rf"^{M.S}*（{M.D}+）."
    lines = F.split(prompt, "\n")
    start = F.struct(F.lit(0).alias("state"), F.lit(0).alias("seen"), F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        # state: 0 before the requirements' line, 1 behind it, 2 among them, 3 after them
        among = acc["state"].isin(1, 2) & x.rlike(item)
        after = F.when((acc["state"] == 0) & x.contains(BLOCK_MARK), 1).when(among, 2).when((acc["state"] == 2) & (M.strip(x) != ""), 3).otherwise(acc["state"])
        kept = ~among | F.array_contains(keep, acc["seen"])
        n = acc["n"] + (among & kept).cast("int")
        line = F.when(among, F.concat(F.regexp_extract(x, rf"^({M.S}*)（", 1), bracketed(n), F.regexp_extract(x, rf"^{M.S}*（{M.D}+）(.*)$", 1))).otherwise(x)
        return F.struct(after.alias("state"), (acc["seen"] + among.cast("int")).alias("seen"), n.alias("n"), F.when(kept, F.array_append(acc["out"], line)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda acc: F.array_join(acc["out"], "\n"))


def trim_coverage(before: DataFrame, after: DataFrame, least: float = 40.0) -> DataFrame:
    """dimension (tag, or type: hard and soft), value, counts before and after, kept share in percent, low (a tag's under `least`)."""

    def counts(df: DataFrame, name: str) -> DataFrame:
        kinds = F.explode(F.array(F.struct(F.lit("tag").alias("d"), F.coalesce("tag", F.lit("unknown")).alias("v")), F.struct(F.lit("type").alias("d"), F.col("type").alias("v"))))
        return df.select(kinds.alias("k")).groupBy(F.col("k.d").alias("dimension"), F.col("k.v").alias("value")).agg(F.count("*").alias(name))

    out = counts(before, "before").join(counts(after, "after"), ["dimension", "value"], "full_outer").select("dimension", "value", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    kept = F.when(F.col("before") > 0, 100.0 * F.col("after") / F.col("before"))
    return out.withColumn("kept_percent", F.round(kept, 1)).withColumn("low", F.coalesce((F.col("dimension") == "tag") & (kept < least), F.lit(False)))


def parameterize_constraints(samples: DataFrame, mapping: DataFrame, *, level: str | None = None, targets: Sequence[str] | None = PARAMETERIZED, rebuild: bool = True, separator: str = "\n") -> DataFrame:
    """Constraint texts replaced from a map by (key, constraint_id), where key is the sample's or its case's id; the prompt is rebuilt where one was.

    samples: sample_id, case_id, l1, context_text, query_text, prompt, constraints (array of structs with id and rendered_text). level keeps the samples of one l1;
    targets are the ids that may be replaced (None: all). separator stands between context, query and constraints (two before the query's and
    the block's first line, as blank lines). The map is joined once for each sample and constraint, by shuffle or as Spark sees fit.
    """
    rows = samples if level is None else samples.where(F.col("l1") == level)
    texts = mapping.groupBy("key", "constraint_id").agg(F.max("rendered_text").alias("_new"))
    wanted = F.col("c.id").isin(*targets) if targets is not None else F.lit(True)
    each = rows.select("sample_id", "case_id", F.posexplode("constraints").alias("pos", "c")).select("sample_id", "case_id", "pos", F.col("c.id").alias("id"), F.when(wanted, F.col("c.id")).alias("constraint_id"))
    by = lambda key: texts.select(F.col("key").alias(key), "constraint_id", F.col("_new").alias(f"_by_{key}"))
    each = each.join(by("sample_id"), ["sample_id", "constraint_id"], "left").join(by("case_id"), ["case_id", "constraint_id"], "left")
    new = each.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("_by_sample_id", "_by_case_id").alias("t")))), lambda x: x["t"]).alias("_texts"))
    joined = rows.join(new, "sample_id", "left")
    names = samples.schema["constraints"].dataType.elementType.names
    text = lambda c, i: F.coalesce(F.get("_texts", i), c["rendered_text"])
    changed = F.transform("constraints", lambda c, i: F.struct(*[(text(c, i) if n == "rendered_text" else c[n]).alias(n) for n in names]))
    joined = joined.withColumn("constraints", changed).withColumn("replaced", F.coalesce(F.size(F.array_compact("_texts")), F.lit(0)).cast("long")).drop("_texts")
    if rebuild:
        sep = F.lit(separator)
        block = F.array_join(F.concat(F.array(F.lit(BLOCK_HEAD)), F.transform("constraints", lambda c, i: F.concat(bracketed(i + 1), c["rendered_text"]))), separator)
        full = F.concat(F.col("context_text"), sep, sep, F.col("query_text"), F.when(F.size("constraints") > 0, F.concat(sep, sep, block)).otherwise(F.lit("")))
        joined = joined.withColumn("prompt", F.when(F.col("replaced") > 0, full).otherwise(F.col("prompt")))
    return joined


def parameterize_missing(samples: DataFrame, mapping: DataFrame, targets: Sequence[str] = PARAMETERIZED) -> DataFrame:
    """sample_id, case_id and constraint_id of constraints to be replaced for which the map has neither the sample's nor the case's text."""
    each = samples.select("sample_id", "case_id", F.explode("constraints").alias("c")).select("sample_id", "case_id", F.col("c.id").alias("constraint_id")).where(F.col("constraint_id").isin(*targets))
    keys = mapping.select("key", "constraint_id").distinct()
    for own in ("sample_id", "case_id"):
        each = each.join(keys.withColumnRenamed("key", own), [own, "constraint_id"], "left_anti")
    return each.select("sample_id", "case_id", "constraint_id")


def hidden_checker_score(candidates: DataFrame, samples: DataFrame) -> DataFrame:
    """sample_id, index, response, passed, total, score of each candidate by its sample's hidden checkers; none: 1.0.

    samples: sample_id, hidden_checkers (array of structs of checker and params). A checker that is unknown or gives no verdict counts as not passed.
    """
    rules = samples.select(F.col("sample_id").alias("item_id"), F.posexplode("hidden_checkers").alias("constraint_index", "c"))
    rules = rules.select("item_id", "constraint_index", F.lit("rule").alias("check_type"), F.col("c.checker").alias("checker"), F.col("c.params").alias("params"))
    answers = candidates.select(F.col("sample_id").alias("item_id"), "index", "response")
    found = evaluate(answers, rules).groupBy("item_id", "index").agg(F.count_if(F.col("score") == 1).alias("passed"), F.count("*").alias("total"))
    out = answers.join(found, ["item_id", "index"], "left")
    score = F.coalesce(F.col("passed") / F.col("total"), F.lit(1.0))
    return out.select(F.col("item_id").alias("sample_id"), "index", "response", F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("total", F.lit(0)).alias("total"), score.alias("score"))


def best_of_n(candidates: DataFrame) -> DataFrame:
    """The best candidate of each sample: highest score, then shortest, then first."""
    best = F.max_by(F.struct("index", "response", "score"), F.struct(F.col("score"), -F.length("response"), -F.col("index")))
    return candidates.groupBy("sample_id").agg(best.alias("b")).select("sample_id", "b.index", "b.response", "b.score")


def candidate_details(candidates: DataFrame) -> DataFrame:
    """n and the candidates of each sample in order, without their texts: index, score, passed, total, chars."""
    have = [c for c in ("index", "score", "passed", "total") if c in candidates.columns]
    listed = F.array_sort(F.collect_list(F.struct(*have, F.length("response").cast("long").alias("chars"))))
    return candidates.groupBy("sample_id").agg(F.count("*").alias("n"), listed.alias("candidates"))


def candidate_summary(candidates: DataFrame) -> DataFrame:
    best = candidates.groupBy("sample_id").agg(F.max("score").alias("s"))
    return best.agg(F.count("*").alias("samples"), F.round(F.avg("s"), 4).alias("mean_score"), F.round(F.avg((F.col("s") == 1).cast("int")), 4).alias("perfect"), F.round(F.avg((F.col("s") >= 0.5).cast("int")), 4).alias("half"))


def assemble_final(samples: DataFrame, best: DataFrame, model: str) -> DataFrame:
    """The best response as a last assistant turn, with teacher_model and teacher_score; samples without one drop out. samples: sample_id, messages[role, content], other columns stay."""
    turn = F.array(F.struct(F.lit("assistant").alias("role"), F.col("_response").alias("content")))
    joined = samples.join(best.select("sample_id", F.col("response").alias("_response"), F.col("score").alias("teacher_score")), "sample_id")
    return joined.withColumn("messages", F.concat("messages", turn)).withColumn("teacher_model", F.lit(model)).drop("_response")


def export_threshold(results: DataFrame, prompts: DataFrame, responses: DataFrame, *, system: str, threshold: float = 0.9) -> DataFrame:
    """sample_id, pass_rate and the chat of the samples whose pass rate reaches the threshold: system, human and gpt turns.

    results: constraint results of one model (item_id is the sample). prompts: sample_id, prompt; responses: sample_id, response.
    """
    kept = sample_pass_rate(results).where(F.col("pass_rate") >= threshold).select(F.col("item_id").alias("sample_id"), "pass_rate")
    rows = kept.join(prompts, "sample_id").join(responses, "sample_id")
    return rows.select("sample_id", "pass_rate", sharegpt(F.lit(system), F.col("prompt"), F.col("response")).alias("conversations"))


def sharegpt(system: Column, prompt: Column, response: Column) -> Column:
    """system, human and gpt turns; the answer opens with an empty thought."""
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    return F.array(turn("system", system), turn("human", prompt), turn("gpt", F.concat(F.lit("<think>\n\n</think>\n\n"), response)))


def sharegpt_pairs(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Prompt and response as two turns; missing and blank ones drop out."""
    rows = prompts.join(responses, "sample_id").where(F.trim("response") != "")
    turns = F.array(F.struct(F.lit("human").alias("from"), F.col("prompt").alias("value")), F.struct(F.lit("gpt").alias("from"), F.col("response").alias("value")))
    return rows.select("sample_id", turns.alias("conversations"))


def repair_tasks(results: DataFrame, constraints: DataFrame) -> DataFrame:
    """Answers not all-pass, with what failed (index, text and reason) and the texts of all constraints, in order.

    results: model, item_id, constraint_index, score, and reason where there is one. constraints: item_id, constraint_index, constraint.
    """
    failed = F.coalesce("score", F.lit(0)) != 1
    reason = F.col("reason") if "reason" in results.columns else F.lit(None).cast("string")
    rows = results.join(constraints.select("item_id", "constraint_index", F.col("constraint").alias("_text")), ["item_id", "constraint_index"], "left")
    one = F.struct("constraint_index", F.coalesce("_text", F.lit("")).alias("constraint"), reason.alias("reason"))
    out = rows.groupBy("model", "item_id").agg(F.array_sort(F.collect_list(F.when(failed, one))).alias("failed"), F.transform(F.array_sort(F.collect_list(F.struct("constraint_index", F.coalesce("_text", F.lit("")).alias("t")))), lambda x: x["t"]).alias("every"), F.count("*").alias("total"))
    return out.where(F.size("failed") > 0)


def diagnose_failure(response: Column, checker: Column | str, params: Column) -> Column:
    """What is measured against what is required, for the fifteen checkers that a repair can be told about; null where there is nothing to say.

    params is a map of settings. The measures are the diagnosis's own: lists may be marked by （）、 too, blocks count headings, sentences end at full-width marks only.
    """
    checker = F.lit(checker) if isinstance(checker, str) else checker
    c = Settings(params)
    text, lines = F.coalesce(response, F.lit("")), M.nonblank(response)
    number = lambda key, default: F.coalesce(c.number(key), F.lit(default).cast("long"))
    shown = lambda n: F.coalesce(n.cast("string"), F.lit("any"))
    told = lambda *parts: say(*parts)
    mixed = M.mixed_word_count(text)
    low, high = number("min_words", 0), number("max_words", 99_999)
    blocks = F.size(F.filter(F.split(M.strip(text), rf"\n{M.S}*\n"), lambda b: M.strip(b) != "")).cast("long")
    fewest, most = number("min_count", 1), c.number("max_count")
    items = M.count(text, rf"(?dm)^{M.D}+[.、)）]{M.S}")
    exact = F.nullif(c.number("exact_count"), F.lit(0))
    first, last = F.coalesce(F.get(lines, F.lit(0)), F.lit("")), F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))
    # Each text is worked out once, where its checker is told about.
    held = lambda wanted, own, what: F.when(wanted.isNotNull(), M.bind(own, lambda x: F.when(~x.contains(wanted), told(what, wanted, ", is ", F.substring(x, 1, 50)))))
    ends = F.concat_ws("; ", held(c.given("first_line"), first, "first line must hold "), held(c.given("last_line"), last, "last line must hold "))
    word = F.coalesce(c.raw("word"), F.lit(""))
    opened = lambda t: F.regexp_replace(t, rf"^(?:\*{{1,2}}|#{{1,6}}{M.S}*)", "")
    places = number("places", 2)
    wrong = F.filter(F.regexp_extract_all(text, F.lit(rf"{M.D}[{M.D},]*\.{M.D}+"), F.lit(0)), lambda x: F.length(F.regexp_extract(x, r"\.(.*)$", 1)) != places)
    sentences = F.size(F.filter(F.split(text, "[。！？!?]+"), lambda x: F.length(M.strip(x)) > 5)).cast("long")
    sections = M.count(text, rf"(?dm)^#{{1,4}}{M.S}")
    headings = F.filter(M.trimmed(F.filter(M.raw_lines(response), lambda x: x.contains("#"))), lambda x: x.startswith("#"))
    levels = F.size(F.array_distinct(F.filter(F.transform(headings, lambda x: F.regexp_extract(x, rf"^(#{{1,6}}){M.S}", 1)), lambda m: m != ""))).cast("long")
    boxes = F.when(text.contains("["), M.count(text, rf"(?dm)^{M.S}*[-*]{M.S}*\[[ xX]\]")).otherwise(F.lit(0).cast("long"))
    ranged = lambda n: F.when(n < low, told(n, " words, wanted ", low, " to ", high, ": add ", low - n)).when(n > high, told(n, " words, wanted ", low, " to ", high, ": cut ", n - high))
    paragraphs = lambda n: F.when((most > 0) & (n > most), told(n, " paragraphs, wanted ", fewest, " to ", most, ": join some")).when(n < fewest, told(n, " paragraphs, wanted ", fewest, " to ", shown(most), ": split some"))
    is_ = lambda *names: checker.isin(*names, *[n.removeprefix("check_") for n in names])
    return (
        F.when(is_("check_word_range"), M.bind(mixed, ranged))
        .when(is_("check_word_limit"), M.bind(mixed, lambda n: F.when(n > high, told(n, " words, at most ", high, ": cut ", n - high))))
        .when(is_("check_paragraph_count"), M.bind(blocks, paragraphs))
        .when(is_("check_first_last_line"), M.bind(ends, lambda e: F.when(e != "", e)))
        .when(is_("check_first_word"), M.bind(M.trim(text), lambda t: F.when(~opened(t).startswith(word), told("must open with ", word, ", opens with ", F.substring(t, 1, 30)))))
        .when(is_("check_first_line_format"), told("first line must be ", F.coalesce(c.given("format"), F.lit("bold")), ", is ", F.substring(first, 1, 50)))
        .when(is_("check_decimal_places"), M.bind(wrong, lambda own: F.when(F.size(own) > 0, told("numbers must have ", places, " places: ", F.array_join(F.slice(own, 1, 5), ", ")))))
        .when(is_("check_ordered_list_count"), F.when(exact.isNotNull(), told(items, " numbered items, wanted exactly ", exact)).otherwise(told(items, " numbered items, wanted ", shown(c.number("min_count")), " to ", shown(most))))
        .when(is_("check_sentence_count"), told(sentences, " sentences, wanted at least ", fewest))
        .when(is_("check_json_format"), F.lit("must be valid JSON as a whole, without Markdown"))
        .when(is_("check_section_count"), told(sections, " section headings, wanted at least ", number("min_sections", 2)))
        .when(is_("check_heading_depth"), told(levels, " heading levels, wanted at least ", number("min_depth", 2)))
        .when(is_("check_checkbox_format"), told(boxes, " checkboxes, wanted at least ", fewest))
        .when(is_("check_forbidden_pattern"), told("must not match ", F.coalesce(c.raw("pattern"), F.lit(""))))
        .when(is_("check_conditional_trigger"), told("with ", F.coalesce(c.given("trigger_word", "trigger"), F.lit("")), " also ", F.coalesce(c.given("required_phrase", "followup"), F.lit(""))))
    )


def verify_repairs(responses: DataFrame, repairs: DataFrame, constraints: DataFrame) -> DataFrame:
    """Only repaired answers, all their rules again: item_id, checks and those passed before and after, all_pass, failing.

    failing lists the rules that still fail: index, checker and diagnosis. responses: item_id, response; repairs: item_id, text; constraints as for evaluate().
    """
    texts = responses.join(repairs.withColumnRenamed("text", "_repair"), "item_id")
    both = texts.select("item_id", F.explode(F.array(F.struct(F.lit("before").alias("phase"), F.col("response")), F.struct(F.lit("after").alias("phase"), F.col("_repair").alias("response")))).alias("x")).select("item_id", "x.phase", "x.response")
    found = evaluate(both, constraints.where(F.lower("check_type").isin("rule", "rule_aided")))
    ok, is_after = F.col("score") == 1, F.col("phase") == "after"
    what = F.struct("constraint_index", F.coalesce("checker", F.lit("")).alias("checker"), F.coalesce("reason", F.lit("")).alias("diagnosis"))
    out = found.groupBy("item_id").agg(F.count_if(is_after).alias("checks"), F.count_if(ok & ~is_after).alias("passed_before"), F.count_if(ok & is_after).alias("passed_after"), F.array_sort(F.collect_list(F.when(is_after & ~F.coalesce(ok, F.lit(False)), what))).alias("failing"))
    return out.select("item_id", "checks", "passed_before", "passed_after", (F.col("passed_after") == F.col("checks")).alias("all_pass"), "failing")


def conflicting_constraints(checkers: DataFrame) -> DataFrame:
    """Where an answer must be JSON, constraints on its opening and closing conflict with that: neither they nor JSON can be acted on.

    checkers: item_id, names (array, with or without check_). blocked and actionable are the names that cannot and can.
    """
    bare = lambda names: [F.lit(n) for x in names for n in (x, x.removeprefix("check_"))]
    json_names, beside = F.array(*bare([JSON_FORMAT]), F.lit("valid_json")), F.array(*bare(BESIDE_JSON))
    both = F.arrays_overlap("names", json_names) & F.arrays_overlap("names", beside)
    stuck = F.concat(json_names, beside)
    none = F.expr("cast(array() as array<string>)")
    return checkers.select("item_id", F.when(both, F.filter("names", lambda n: F.array_contains(stuck, n))).otherwise(none).alias("blocked"), F.when(both, F.filter("names", lambda n: ~F.array_contains(stuck, n))).otherwise(F.col("names")).alias("actionable"))


def repair_prompts(failed: Column, every: Column, response: Column) -> Column:
    """What failed (structs of tag, constraint, checker, params, reason) with its diagnosis, all constraints (structs of tag and constraint) numbered, and the response."""
    line = lambda head, value: F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"- {head}: "), value))
    one = lambda f: F.concat_ws("\n", F.concat(F.lit("### ["), F.coalesce(f["tag"], F.lit("")), F.lit("]")), line("Constraint", f["constraint"]), line("Checker", f["checker"]), line("Settings", F.to_json(f["params"])), line("Why it fails", f["reason"]))
    kept = numbered(F.transform(every, lambda c: F.concat(F.lit("["), F.coalesce(c["tag"], F.lit("")), F.lit("] "), F.coalesce(c["constraint"], F.lit("")))))
    return F.concat_ws("\n\n", F.lit("## Constraints not met"), F.array_join(F.transform(failed, one), "\n\n"), F.lit("## All constraints (keep those that are met)"), kept, F.lit("## Response"), response)


def excerpt_chunks(docs: DataFrame, *, least: int = 2000, most: int = 5000) -> DataFrame:
    """Verbatim excerpts of least to most tokens (runs without white space) at paragraph bounds: doc_id, chunk, tokens, text.

    Paragraphs are gathered until an excerpt has `least` tokens; one that would pass `most` begins the next. A paragraph of more than `most` is an
    excerpt of its own, for it is not cut. The last excerpt may be shorter. Worked out inside the row: no text is shuffled.
    """
    paragraphs = F.filter(F.split("text", rf"\n{M.S}*\n|\n"), lambda p: M.strip(p) != "")
    sized = F.transform(paragraphs, lambda p: F.struct(p.alias("p"), F.regexp_count(p, F.lit(f"{M.NS}+")).alias("n")))
    kind = "array<struct<n:int,t:array<string>>>"
    start = F.struct(F.expr(f"cast(array() as {kind})").alias("done"), F.lit(0).alias("n"), F.expr("cast(array() as array<string>)").alias("t"))

    def step(acc: Column, x: Column) -> Column:
        closed = F.array_append(acc["done"], F.struct(acc["n"].alias("n"), acc["t"].alias("t")))
        full = (acc["n"] >= least) | ((acc["n"] > 0) & (acc["n"] + x["n"] > most))
        return F.when(full, F.struct(closed.alias("done"), x["n"].alias("n"), F.array(x["p"]).alias("t"))).otherwise(F.struct(acc["done"].alias("done"), (acc["n"] + x["n"]).alias("n"), F.array_append(acc["t"], x["p"]).alias("t")))

    ended = lambda acc: F.when(F.size(acc["t"]) > 0, F.array_append(acc["done"], F.struct(acc["n"].alias("n"), acc["t"].alias("t")))).otherwise(acc["done"])
    chunks = F.aggregate(sized, start, step, ended)
    out = docs.select("doc_id", F.posexplode(chunks).alias("chunk", "c"))
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.col("c.n").cast("long").alias("tokens"), F.array_join("c.t", "\n").alias("text"))


def balanced_excerpts(docs: DataFrame, *, least: int = 2000, most: int = 5000) -> DataFrame:
    """Verbatim excerpts at paragraph bounds of which as few as can be lie outside least..most tokens: doc_id, chunk, tokens, text.

    excerpt_chunks leaves what is left at the end, however short; this one searches all cuts of a document (helpers.balanced_cuts), so that every excerpt has its size wherever any
    cut does it. Only the sizes of paragraphs go to the helper; texts stay in their rows. A paragraph of more than `most` is an excerpt of its own. Documents without
    text have no excerpts; repeated rows are cut alike.
    """
    paragraphs = F.filter(F.split("text", rf"\n{M.S}*\n|\n"), lambda p: M.strip(p) != "")
    rows = docs.select("doc_id", paragraphs.alias("p")).withColumn("n", F.transform("p", lambda p: F.regexp_count(p, F.lit(f"{M.NS}+"))))
    rows = rows.withColumn("ends", H.cuts_within(least, most)(F.col("n")))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))))
    bounds = F.zip_with(starts, F.col("ends"), lambda a, b: F.struct(a.alias("a"), (b - a).alias("n")))
    out = rows.where(F.size("ends") > 0).select("doc_id", "p", F.col("n").alias("sizes"), F.posexplode(bounds).alias("chunk", "b"))
    piece = lambda x: F.slice(x, F.col("b.a") + 1, F.col("b.n"))
    return out.select("doc_id", F.col("chunk").cast("long").alias("chunk"), F.aggregate(piece(F.col("sizes")), F.lit(0).cast("long"), lambda acc, x: acc + x).alias("tokens"), F.array_join(piece(F.col("p")), "\n").alias("text"))


def repair_rounds(responses: DataFrame, constraints: DataFrame, repair: Callable[[DataFrame], DataFrame], path: str, *, rounds: int = 3) -> DataFrame:
    """Checking, repairing and checking again, each round in folders of its own under path: round, item_id, response, checks, passed, all_pass of each item's last version.

    responses: item_id, response. repair gets the items that still fail (item_id, response, failing: index, checker and reason of each rule) and returns item_id and text.
    Round 0 checks all answers. A later round checks only answers whose text has changed, by its hash, and writes only these; the versions before stay as they are, so that a lost
    round is run again from them alone: its folders are replaced as a whole. It ends early when nothing fails or nothing changes. Repairs of
    unknown items are left out, null texts change nothing, of several repairs of an item one counts. Items without rules pass with 0 checks.
    """
    spark = responses.sparkSession
    rules = constraints.where(F.lower("check_type").isin("rule", "rule_aided"))
    version = "item_id string, response string, hash binary, checks long, passed long, failing array<struct<constraint_index:long,checker:string,reason:string>>, all_pass boolean"

    def checked_round(texts: DataFrame, n: int) -> DataFrame:
        ok = F.coalesce(F.col("score") == 1, F.lit(False))
        what = F.struct("constraint_index", F.coalesce("checker", F.lit("")).alias("checker"), F.coalesce("reason", F.lit("")).alias("reason"))
        found = evaluate(texts.select("item_id", "response"), rules.withColumn("item_id", F.col("item_id").cast("string"))).groupBy(F.col("item_id").alias("_of")).agg(F.count("*").alias("checks"), F.count_if(ok).alias("passed"), F.array_sort(F.collect_list(F.when(~ok, what))).alias("failing"))
        rows = texts.join(found, F.col("item_id") == F.col("_of"), "left")
        none = F.expr("cast(array() as array<struct<constraint_index:bigint,checker:string,reason:string>>)")
        out = rows.select("item_id", "response", F.unhex(F.md5(F.col("response").cast("binary"))).alias("hash"), F.coalesce("checks", F.lit(0)).alias("checks"), F.coalesce("passed", F.lit(0)).alias("passed"), F.coalesce("failing", none).alias("failing"))
        out.withColumn("all_pass", F.col("passed") == F.col("checks")).write.mode("overwrite").parquet(f"{path}/round={n}")
        return spark.read.schema(version).parquet(f"{path}/round={n}").withColumn("round", F.lit(n))

    current = checked_round(responses.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("response", F.lit("")).alias("response")), 0)
    for n in range(1, rounds + 1):
        failing = current.where("NOT all_pass")
        if failing.isEmpty():
            break
        repaired = cut(repair(failing.select("item_id", "response", "failing")).where("text IS NOT NULL").select(F.col("item_id").cast("string").alias("_of"), "text").dropDuplicates(["_of"]))
        changed = repaired.join(failing, F.col("_of") == F.col("item_id")).where(F.unhex(F.md5(F.col("text").cast("binary"))) != F.col("hash"))
        changed = cut(changed.select("item_id", F.col("text").alias("response")))
        if changed.isEmpty():
            break
        fresh = checked_round(changed, n)
        current = current.join(fresh.select(F.col("item_id").alias("_f")), F.col("item_id") == F.col("_f"), "left_anti").unionByName(fresh)
    return current.select("round", "item_id", "response", "checks", "passed", "all_pass")


#: Hashes of passages of which so many may be broadcast, 8 bytes each.
BROADCAST_HASHES = 1_000_000


def shared_passages(train: DataFrame, test: DataFrame, *, least: int = 0) -> DataFrame:
    """The membership table: passage_id, passage, side (train or test), doc_id, one row for each document that holds a passage which both sides have.

    Passages are trimmed lines that are not blank, of `least` characters or more; passage_id is the md5 of the text. What both sides have is first found by a
    hash of 64 bits, counted in each task before it moves, so that a footer in every document is a row a task; the hashes that both sides have are written to the checkpoint folder
    and broadcast where they are few, so that the text of these candidates alone then moves (is written there, too) and
    verifies the hash. A passage in m + n documents makes m + n rows, never m * n. Null texts have no passages; documents without an id are
    one document; repeated rows of a document count once; empty tables give an empty result.
    """
    def lines(df: DataFrame, side: str) -> DataFrame:
        own = df.select(F.lit(side == "test").alias("is_test"), "doc_id", F.explode(M.nonblank(F.coalesce(F.col("text"), F.lit("")))).alias("passage"))
        return own.where(F.length("passage") >= least) if least > 0 else own

    # Sides are compared as booleans, whose least and largest need no sorting.
    on_both = (F.min("is_test").alias("a"), F.max("is_test").alias("b"))
    rows = lines(train, "train").unionByName(lines(test, "test")).withColumn("h", F.xxhash64("passage"))
    both = stored(rows.groupBy("h").agg(*on_both).where("a <> b").select("h"))
    few = both.count() <= BROADCAST_HASHES
    members = stored(rows.join(F.broadcast(both) if few else both, "h", "left_semi").select("passage", "is_test", "doc_id").distinct())
    # Passages of one hash but of one side only are no shared ones. Hardly ever there are any, so members are not dealt out by passage to look for them.
    alone = stored(members.groupBy(F.col("passage").alias("_p")).agg(*on_both).where("a = b").select("_p"))
    found = members if alone.isEmpty() else members.join(alone, F.col("passage") == F.col("_p"), "left_anti")
    return found.select(F.md5(F.col("passage").cast("binary")).alias("passage_id"), "passage", F.when(F.col("is_test"), "test").otherwise("train").alias("side"), "doc_id")


def source_disjoint_check(train: DataFrame, test: DataFrame, *, least: int = 0) -> DataFrame:
    """One row for each passage that train and test share: passage_id, chars, the documents on both sides that hold it, and the smallest id of each.

    Empty means that the sides are disjoint. shared_passages has the documents themselves; edge cases are as there.
    """
    own = lambda side: F.col("side") == side
    members = shared_passages(train, test, least=least)
    return members.groupBy("passage_id", F.length("passage").cast("long").alias("chars")).agg(
        F.count_if(own("train")).alias("train_docs"),
        F.count_if(own("test")).alias("test_docs"),
        F.min(F.when(own("train"), F.col("doc_id"))).alias("train_first"),
        F.min(F.when(own("test"), F.col("doc_id"))).alias("test_first"),
    )


def disjoint_links(train: DataFrame, test: DataFrame, *, least: int = 0) -> DataFrame:
    """One row for each document of a passage that train and test share: passage_id, chars, side, doc_id, links (the documents of the other side that hold it)
    and first (the smallest id among these).

    A train and a test document are linked by a passage exactly if both have a row for it, so all pairs are there without being written out. Edge cases are as in shared_passages.
    """
    members = cut(shared_passages(train, test, least=least).select("passage_id", F.length("passage").cast("long").alias("chars"), "side", "doc_id"))
    other = members.groupBy(F.col("passage_id").alias("_of"), F.when(F.col("side") == "train", "test").otherwise("train").alias("_side")).agg(F.count("*").alias("links"), F.min("doc_id").alias("first"))
    return members.join(other, (F.col("passage_id") == F.col("_of")) & (F.col("side") == F.col("_side"))).drop("_of", "_side")
