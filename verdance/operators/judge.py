"""Tables to and from a judge: requests out, raw answers in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdance.functions import helpers as H
from verdance.functions import measures as M


def present(name: str, df: DataFrame) -> Column:
    """A text column, empty where the table has none or it is null."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def judge_requests(items: DataFrame, pending: DataFrame, key: str = "item_id") -> DataFrame:
    """One request for each item with constraints that wait for a judge: key, constraints (JSON), prompt.

    items: key, response and what there is of workflow, task, query, full_prompt, documents (array of structs). pending:
    key, constraint_index, constraint and what there is of tag and family. The prompt names the item, its workflow and task, the query, the full
    prompt or else the documents as JSON, the constraints in index order as JSON, and the response; empty parts are left out.
    """
    listed = F.struct("constraint_index", F.coalesce("constraint", F.lit("")).alias("constraint"), present("tag", pending).alias("tag"), present("family", pending).alias("family"))
    asked = pending.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(listed))).alias("constraints"))
    workflow, task, query, full = (present(n, items) for n in ("workflow", "task", "query", "full_prompt"))
    documents = F.when((full == "") & (F.size("documents") > 0), F.to_json("documents")) if "documents" in items.columns else F.lit(None).cast("string")
    headed = lambda head, body: F.concat(F.lit(head + "\n"), body)
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Item: "), F.col(key).cast("string")),
        F.when((workflow != "") | (task != ""), F.concat(F.lit("Workflow and task: "), F.concat_ws(" / ", workflow, task))),
        F.when(query != "", headed("Query:", query)),
        F.when(full != "", headed("Prompt:", full)),
        headed("Documents:", documents),
        headed("Constraints to judge, by zero-based index:", F.col("constraints")),
        headed("Response:", F.coalesce("response", F.lit(""))),
    )
    return items.join(asked, key).select(key, "constraints", text.alias("prompt"))


def judge_prompt_single(constraint: Column, documents: Column, response: Column) -> Column:
    """One prompt for one constraint: the question, the constraint, documents (id, title, content) if any, the response. Texts are trimmed."""
    trimmed = lambda c: M.strip(F.coalesce(c, F.lit("")))
    head = lambda d: F.concat(F.lit("["), F.when(trimmed(d["id"]) == "", "DOC").otherwise(trimmed(d["id"])), F.when(trimmed(d["title"]) != "", F.concat(F.lit(" - "), trimmed(d["title"]))).otherwise(F.lit("")), F.lit("]\n"))
    docs = F.array_join(F.transform(documents, lambda d: F.concat(head(d), trimmed(d["content"]))), "\n\n")
    with_docs = F.coalesce(F.size(documents) > 0, F.lit(False))
    question = F.when(with_docs, "Does the response meet the constraint, with the documents as the only source of facts?").otherwise("Does the response meet the constraint?")
    return F.concat_ws(
        "\n\n",
        F.concat(question, F.lit(" Answer pass or fail with a short reason.")),
        F.concat(F.lit("Constraint:\n"), trimmed(constraint)),
        F.when(with_docs, F.concat(F.lit("Documents:\n"), docs)),
        F.concat(F.lit("Response:\n"), trimmed(response)),
    )


def parse_judge_item(raw: DataFrame) -> DataFrame:
    """Adds parsed: error, or scores and quality, of the strict reading of raw against expected (an array of indexes)."""
    return raw.withColumn("parsed", H.judged(F.col("raw"), F.col("expected")))


def first_valid_attempt(parsed: DataFrame) -> DataFrame:
    """The first attempt of each repeat that parses."""
    good = parsed.where("parsed.error IS NULL")
    return good.groupBy("item_id", "repeat").agg(F.min("attempt").alias("attempt"), F.min_by("parsed", "attempt").alias("parsed"))


def majority_vote(votes: DataFrame) -> DataFrame:
    """Score of (item_id, constraint_index) by most votes over repeats; a tie goes to the last one. The reason is the last of the winners'."""
    out = votes.groupBy("item_id", "constraint_index").agg(
        F.count("*").alias("votes"),
        F.sum("score").alias("yes"),
        F.max_by("score", "repeat").alias("last"),
        F.max_by("reason", F.when(F.col("score") == 1, F.col("repeat"))).alias("reason_1"),
        F.max_by("reason", F.when(F.col("score") == 0, F.col("repeat"))).alias("reason_0"),
    )
    score = F.when(2 * F.col("yes") > F.col("votes"), 1).when(2 * F.col("yes") < F.col("votes"), 0).otherwise(F.col("last")).cast("int")
    return out.select("item_id", "constraint_index", "votes", score.alias("score"), F.when(score == 1, F.col("reason_1")).otherwise(F.col("reason_0")).alias("reason"))


def quality_mean(votes: DataFrame) -> DataFrame:
    """Mean quality over repeats, halves to even, and the last reason."""
    return votes.groupBy("item_id").agg(F.bround(F.avg("quality")).cast("long").alias("quality"), F.max_by("reason", "repeat").alias("reason"))
