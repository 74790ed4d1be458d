"""Keys, joins and routing of items, responses and constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions import measures as M


def first_set(*columns: Column) -> Column:
    """The first that is not null and not blank, as text."""
    return F.coalesce(*[F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns])


def with_item_key(items: DataFrame, row: str = "row") -> DataFrame:
    """item_key from id, item_id, case_id, line_number, line or the row number, whichever the table has first."""
    have = [F.col(c) for c in ("id", "item_id", "case_id", "line_number", "line", row) if c in items.columns]
    return items.withColumn("item_key", first_set(*have))


def duplicate_keys(items: DataFrame) -> DataFrame:
    """Keys that several items have; strict reading refuses them."""
    return items.groupBy("item_key").agg(F.count("*").alias("n")).where("n > 1")


def unique_items(items: DataFrame) -> DataFrame:
    """items, with an error at run time if two of them have one key."""
    counted = items.groupBy(F.col("item_key").alias("_key")).agg(F.count("*").alias("_n"))
    same = items.join(counted, F.col("item_key").eqNullSafe(F.col("_key")))
    fine = F.assert_true(F.col("_n") == 1, F.concat(F.lit("duplicate item key "), F.coalesce("item_key", F.lit("null"))))
    return same.where(fine.isNull()).drop("_key", "_n")


PRIMARY, LINES = ("id", "item_id", "case_id"), ("line_number", "line")


def match_keys(df: DataFrame, primary: Sequence[str] = PRIMARY, lines: Sequence[str] = LINES, row: str | None = None, always_row: bool = False) -> Column:
    """The keys a row is matched by, in order: its primary ids, and only where it has none its line numbers. The
    row number stands where nothing else does, or (always_row) behind the line numbers."""
    texts = lambda names: F.array_distinct(F.array_compact(F.array(*[first_set(F.col(c)) for c in names if c in df.columns]).cast("array<string>")))
    ids, others = texts(primary), texts(lines)
    if row is not None and row in df.columns:
        number = F.array(F.col(row).cast("string"))
        others = F.array_distinct(F.concat(others, number)) if always_row else F.when(F.size(others) > 0, others).otherwise(number)
    return F.when(F.size(ids) > 0, ids).otherwise(others)


def latest_responses(responses: DataFrame, order: str, *, primary: Sequence[str] = PRIMARY, lines: Sequence[str] = LINES, text: str = "response", fallback: str = "output") -> DataFrame:
    """key and response: a row registers under each of its keys; the last row of a key wins."""
    body = F.coalesce(*[F.col(c) for c in (text, fallback) if c in responses.columns])
    every = match_keys(responses, primary, lines, order)
    rows = responses.select(F.explode(every).alias("key"), F.struct(F.col(order).alias("o"), body.alias("response")).alias("r"))
    return rows.groupBy("key").agg(F.max_by("r.response", "r.o").alias("response"))


def match_response(items: DataFrame, responses: DataFrame, *, primary: Sequence[str] = PRIMARY, lines: Sequence[str] = LINES, row: str | None = None) -> DataFrame:
    """item_key and the response under the first of its keys that has one. An item with primary ids never falls back to line numbers."""
    rows = items.select("item_key", F.posexplode(match_keys(items, primary, lines, row, True)).alias("pos", "key"))
    return rows.join(responses, "key").groupBy("item_key").agg(F.min_by("response", "pos").alias("response"))


def missing_responses(items: DataFrame, matched: DataFrame) -> DataFrame:
    return items.join(matched, "item_key", "left_anti")


def explode_constraints(items: DataFrame, key: str = "item_id", constraints: str = "constraints") -> DataFrame:
    """One row for each constraint with its zero-based index; its id is id, else constraint_id, else item#C<index+1>."""
    rows = items.select(key, F.posexplode(constraints).alias("_pos", "c"))
    names = items.schema[constraints].dataType.elementType.names
    own = [F.nullif(F.col(f"c.{n}").cast("string"), F.lit("")) for n in ("id", "constraint_id") if n in names]
    name = F.coalesce(*own, F.concat(F.col(key).cast("string"), F.lit("#C"), (F.col("_pos") + 1).cast("string")))
    return rows.select(key, F.col("_pos").cast("long").alias("constraint_index"), name.alias("constraint_id"), *[F.col(f"c.{n}").alias(n) for n in names if n not in ("id", "constraint_id", "constraint_index")])


def route_constraints(constraints: DataFrame, check_type: str = "check_type", has_config: str = "has_config") -> DataFrame:
    """route: rule, LLM or reject, with the reason of a rejection."""
    kind = F.lower(F.coalesce(F.nullif(F.trim(check_type), F.lit("")), F.lit("llm")))
    route = F.when(kind.isin("rule", "rule_aided"), F.when(F.col(has_config), "rule").otherwise("reject")).when(kind.isin("llm", "judge"), "LLM").otherwise("reject")
    reason = F.when(kind.isin("rule", "rule_aided") & ~F.col(has_config), "rule without settings").when(~kind.isin("rule", "rule_aided", "llm", "judge"), "unknown check_type")
    return constraints.withColumn("route", route).withColumn("reject_reason", reason)


def join_scored_pairs(responses: DataFrame, constraints: DataFrame, key: str) -> DataFrame:
    return responses.join(constraints, key)


def group_by_case(constraints: DataFrame, key: str = "constraint_key") -> DataFrame:
    """Constraints of a case from the key's prefix, ordered by number."""
    parts = F.split(key, "#C")
    rows = constraints.select(parts[0].alias("case_id"), parts[1].cast("int").alias("n"), key)
    return rows.groupBy("case_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", key))), lambda x: x[key]).alias("constraint_keys"))


def resume_todo(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done, list(keys), "left_anti")


def merge_override(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of old, with the columns of new where it has the key."""
    fresh = new.select(key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = old.join(fresh, key, "left")
    return joined.select(key, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns])


def apply_repairs(responses: DataFrame, repairs: DataFrame, key: str) -> DataFrame:
    """Repaired text replaces or adds a response."""
    return responses.join(repairs.withColumnRenamed("text", "_repair"), key, "full_outer").select(key, F.coalesce("_repair", "response").alias("response"), F.col("_repair").isNotNull().alias("repaired"))


#: Settings that may stand at the top level of a constraint.
TOP_LEVEL = (
    "type checker_type keywords phrases numbers thresholds deadlines pattern regex min max count mode case_sensitive format fields required_fields headings columns "
    "required_columns exact min_count max_count exact_count min_rows max_rows exact_rows level min_depth word line position trigger followup required_if_present "
    "tolerance expected_values forbidden_regex heading field first_line last_line max_chars min_words max_words required_keywords forbidden_keywords required_titles "
    "risk_line unit forbidden_units places"
).split()
#: Those of them that make a rule explicit.
EXPLICIT = (
    "type checker_type keywords phrases numbers thresholds deadlines pattern regex min max count mode case_sensitive format fields required_fields headings columns "
    "required_columns exact min_count max_count exact_count min_rows max_rows exact_rows level min_depth word line position trigger followup required_if_present "
    "tolerance expected_values forbidden_regex heading"
).split()


def resolve_config(layers: Sequence[Column], top_level: Column) -> Column:
    """Settings merged: later layers win over earlier ones, top-level keys count only where no layer has them."""
    empty = F.expr("map()").cast("map<string,string>")
    merged = F.map_filter(F.coalesce(top_level, empty), lambda k, _: k.isin(*TOP_LEVEL))

    def over(below: Column, own: Column) -> Column:
        return F.map_concat(F.map_filter(below, lambda k, _: ~F.map_contains_key(own, k)), own)

    for layer in layers:
        merged = over(merged, F.coalesce(layer, empty))
    return merged


def layered_config(settings: Column, *layers: Column) -> Column:
    """The same from a top-level map and the maps evaluator, checker, rule and params, which may be null."""
    return resolve_config(layers, settings)


def has_explicit_config(settings: Column, checker: Column, evaluator: Column, checker_config: Column, rule: Column, params: Column) -> Column:
    """Whether a rule says how it is checked: a map of its own, a checker's name, or one of the EXPLICIT settings."""
    named = F.trim(F.coalesce(checker, F.lit(""))) != ""
    top = F.arrays_overlap(F.map_keys(F.coalesce(settings, F.expr("map()").cast("map<string,string>"))), F.array(*[F.lit(k) for k in EXPLICIT]))
    return evaluator.isNotNull() | checker_config.isNotNull() | rule.isNotNull() | params.isNotNull() | named | F.coalesce(top, F.lit(False))


#: Other names of checkers.
ALIASES = {
    "check_required_keyword": "required_keyword",
    "required_keywords": "required_keyword",
    "keyword": "required_keyword",
    "keywords": "required_keyword",
    "check_keyword_presence": "keyword_presence",
    "check_keyword_absence": "keyword_absence",
    "check_forbidden_pattern": "keyword_absence",
    "forbidden_pattern": "keyword_absence",
    "check_forbidden_phrase": "forbidden_phrase",
    "forbidden": "forbidden_phrase",
    "forbidden_phrases": "forbidden_phrase",
    "check_word_limit": "max_words",
    "check_word_range": "word_range",
    "min_word_count": "min_words",
    "max_word_count": "max_words",
    "minimum_words": "min_words",
    "maximum_words": "max_words",
    "word_limit": "max_words",
    "check_section_count": "min_sections",
    "check_section_titles": "section_titles",
    "section_count_min": "min_sections",
    "section_count_max": "max_sections",
    "section_count": "min_sections",
    "check_item_count": "item_count",
    "items": "item_count",
    "exact_item_count": "item_count",
    "at_least_item_count": "item_count",
    "check_ordered_list_count": "ordered_list_count",
    "ordered_list": "ordered_list_count",
    "numbered_list": "ordered_list_count",
    "check_no_list": "no_list",
    "check_paragraph_count": "paragraph_count",
    "paragraphs": "paragraph_count",
    "check_sentence_count": "sentence_count",
    "check_blockquote_count": "blockquote_count",
    "blockquote": "blockquote_count",
    "check_json_format": "valid_json",
    "json": "valid_json",
    "json_format": "valid_json",
    "check_json_structure": "valid_json",
    "check_required_fields": "required_fields",
    "required_field": "required_fields",
    "fields": "required_fields",
    "field_coverage": "required_fields",
    "check_json_field_count": "json_field_count",
    "check_json_field_item_limit": "json_field_item_limit",
    "check_json_field_word_limit": "json_field_word_limit",
    "check_markdown_table": "markdown_table",
    "table": "markdown_table",
    "markdown_table_format": "markdown_table",
    "check_no_table": "no_table",
    "no_markdown_table": "no_table",
    "check_table_column_names": "table_columns",
    "check_header_row": "table_columns",
    "required_columns": "table_columns",
    "check_table_row_count": "table_row_count",
    "table_rows": "table_row_count",
    "check_checkbox_format": "checkbox",
    "checkbox_format": "checkbox",
    "check_code_block": "code_block",
    "number": "contains_number",
    "numbers": "contains_number",
    "check_value_exact": "exact_value",
    "value_exact": "exact_value",
    "check_first_word": "first_word",
    "opening": "first_line",
    "check_first_line_format": "first_line_format",
    "check_first_last_line": "first_last_line",
    "closing": "last_line",
    "check_conditional_trigger": "conditional_trigger",
    "conditional": "conditional_trigger",
    "check_risk_disclaimer": "risk_disclaimer",
    "check_first_person": "first_person",
    "check_currency_format": "currency_format",
    "check_no_percent": "no_percent",
    "check_no_arabic_numerals": "no_arabic_numerals",
    "check_decimal_places": "decimal_places",
    "check_first_line": "first_line",
    "check_last_line": "last_line",
    "check_heading_order": "heading_order",
    "check_heading_level": "heading_level",
    "check_heading_depth": "heading_depth",
    "regex": "simple_regex",
    "required_regex": "simple_regex",
    "check_forbidden_regex": "forbidden_regex",
    "check_regex_count": "regex_count",
}


def named_checker(name: Column, wording: Column | None = None, tag: Column | None = None, *, aliases: bool = False) -> Column:
    """A checker's name in lower case with underscores; where it is blank, inferred from the wording."""
    plain = F.translate(F.lower(M.strip(F.coalesce(name, F.lit("")))), "- ", "__")
    plain = F.nullif(plain, F.lit(""))
    if wording is not None:
        plain = F.coalesce(plain, infer_checker(wording, F.lit("") if tag is None else tag))
    if aliases:
        pairs = [F.lit(x) for kv in ALIASES.items() for x in kv]
        plain = F.coalesce(F.try_element_at(F.create_map(*pairs), plain), plain)
    return plain


def resolve_checker(*names: Column) -> Column:
    """The checker's name: first one given, lower case with underscores, aliases resolved."""
    return named_checker(first_set(*names), aliases=True)


def infer_checker(text: Column, tag: Column) -> Column:
    """A checker from wording and tag where none is named; null if nothing fits."""
    t, tag = M.fold(F.coalesce(text, F.lit(""))), F.upper(F.coalesce(tag, F.lit("")))

    def has(*terms: str) -> Column:
        out = F.lit(False)
        for term in terms:
            out = out | t.contains(term)
        return out

    form, table = tag.startswith("FP"), has("table", "matrix")
    listed = has("column", "headers") | t.rlike(rf"(?<!{M.W})table with(?!{M.W})[^.]*,")
    return (
        F.when(has("valid json") | (has("json") & has("format")), "valid_json")
        .when(has("forbidden", "do not use", "must not use", "avoid the phrase"), "forbidden_phrase")
        .when(has("deadline", "within", "days", "calendar-day", "annual") & ((tag == "QV5") | has("timing", "deadline")), "deadline")
        .when(has("threshold", "$", "%", "at least", "minimum", "maximum") & ((tag == "QV4") | t.rlike(M.D)), "contains_number")
        .when(form & table & listed, "table_columns")
        .when(form & table, "markdown_table")
        .when(form & has("checklist", "checkbox"), "checkbox")
        .when(form & has("section", "heading"), "min_sections")
        .when(form & has("word") & has("no more than", "maximum", "under", "fewer than"), "max_words")
        .when(form & has("word"), "min_words")
    )
