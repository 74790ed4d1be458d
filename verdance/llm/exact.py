"""Exact duplicates by merging sorted runs of digests in a tree of exchanges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, long_ids, named_ids, on_workers, table

#: Entries of a run that a task sorts at once, and those that a merged range holds on average.
RUN_ROWS = 1 << 18
#: Binomial rounds that one exchange takes: 2 ** ROUNDS partners swap their runs and each merges as many.
ROUNDS = 3

#: White space but for a single space, which stays as it is.
_SPACES = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"

#: key: SHA-256, length in bytes, and a second hash, by which equal digests are verified; lost: no id.
RUN = np.dtype([("key", "S48"), ("lost", "u1"), ("id", "<i8"), ("tie", "<i8"), ("n", "<i8")])


def normalised(text: Column) -> Column:
    """Runs of ASCII white space become one space each; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, " ")


def text_key(text: Column) -> Column:
    """48 bytes of a normalised text: SHA-256, length, xxhash64."""
    digits = [F.lpad(F.hex(c.cast("long")), 16, "0") for c in (F.octet_length(text), F.xxhash64(text))]
    return F.unhex(F.concat(F.sha2(text.cast("binary"), 256), *digits))


def sorted_run(entries: np.ndarray) -> np.ndarray:
    """Entries in order of their key, one a key: the smallest id and the sum of n."""
    entries = entries[np.lexsort((entries["tie"], entries["id"], entries["lost"]))]
    entries = entries[np.argsort(entries["key"], kind="stable")]
    first = np.flatnonzero(np.concatenate([[True], entries["key"][1:] != entries["key"][:-1]])[: len(entries)])
    out = entries[first]
    if len(out):
        out["n"] = np.add.reduceat(entries["n"], first)
    return out


def merged_two(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Two runs as one; of entries with the same key the smallest identifier stays, and their n add up."""
    if not len(x) or not len(y):
        return x if len(x) else y
    at = np.searchsorted(x["key"], y["key"])
    near = np.minimum(at, len(x) - 1)
    same = (at < len(x)) & (x["key"][near] == y["key"])
    x, a, b = x.copy(), near[same], y[same]
    own = x[a]
    less = b["lost"] < own["lost"]
    tied = b["lost"] == own["lost"]
    less |= tied & ((b["id"] < own["id"]) | ((b["id"] == own["id"]) & (b["tie"] < own["tie"])))
    total = own["n"] + b["n"]
    own[less] = b[less]
    own["n"] = total
    x[a] = own
    rest, at = y[~same], at[~same]
    out = np.empty(len(x) + len(rest), RUN)
    to = at + np.arange(len(rest))
    free = np.ones(len(out), bool)
    free[to] = False
    out[to], out[free] = rest, x
    return out


def merged(runs: list[np.ndarray]) -> np.ndarray:
    """Many runs as one, two by two."""
    while len(runs) > 1:
        runs = [merged_two(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
    return runs[0] if runs else np.empty(0, RUN)


def _runs(slim: DataFrame, run_rows: int) -> DataFrame:
    """part, run: the sorted runs of each partition of (key, lost, id, tie)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            packed = sorted_run(np.concatenate(held)).tobytes()
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([packed], pa.binary())], names=["part", "run"])

        part = 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            part = batch.column(0)[0].as_py()
            entries = np.empty(n, RUN)
            entries["key"] = np.frombuffer(b"".join(batch.column(1).to_pylist()), "S48")
            for k, name in ((2, "lost"), (3, "id"), (4, "tie")):
                entries[name] = batch.column(k).to_numpy(zero_copy_only=False)
            entries["n"] = 1
            held.append(entries)
            size += n
            if size >= run_rows:
                yield out()
                held, size = [], 0
        if held:
            yield out()

    return slim.select("part", "key", F.col("id").isNull().cast("byte").alias("lost"), F.coalesce("id", F.lit(0)).alias("id"), "tie").mapInArrow(run, "part int, run binary")


def _exchanged(runs: DataFrame, done: int, take: int, bits: int) -> DataFrame:
    """node, run after `take` more binomial rounds of `bits`: nodes that differ in these bits of their number swap
    the parts of their runs, which are slices as runs are sorted, and each merges what it gets."""

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(packed, RUN)
                lead = np.frombuffer(own["key"].tobytes(), ">u8").reshape(-1, 6)[:, 0].astype(np.uint64)
                digit = (lead >> np.uint64(64 - done - take) & np.uint64((1 << take) - 1)).astype(np.int64) if take else np.zeros(len(own), np.int64)
                low = bits - done - take
                ends = np.searchsorted(digit, np.arange((1 << take) + 1))
                found = [(d, own[ends[d] : ends[d + 1]].tobytes()) for d in range(1 << take) if ends[d] < ends[d + 1]]
                to = [node & ~(((1 << take) - 1) << low) | d << low for d, _ in found]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([x for _, x in found], pa.binary())], names=["node", "run"])

    def merge(key: tuple, runs: pa.Table) -> pa.Table:
        out = merged([np.frombuffer(x, RUN) for x in runs.column("run").to_pylist()])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["node", "run"])

    return runs.mapInArrow(slices, "node int, run binary").groupBy("node").applyInArrow(merge, "node int, run binary")


def _entries(runs: DataFrame, least: int) -> DataFrame:
    """part, key, keep_id, keep_tie, n of all entries of the runs with an n of `least` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(packed, RUN)
                own = own[own["n"] >= least]
                data, width = own["key"].tobytes(), RUN["key"].itemsize
                keys = pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(np.arange(0, len(data) + 1, width, dtype=np.int32).tobytes()), pa.py_buffer(data)])
                ids = pa.array(own["id"], mask=own["lost"].astype(bool))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), part, np.int32)), keys, ids, pa.array(own["tie"]), pa.array(own["n"])], names=["part", "key", "keep_id", "keep_tie", "n"])

    return runs.mapInArrow(run, "part int, key binary, keep_id long, keep_tie long, n long")


def exact_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, run_rows: int = RUN_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are identical after each run of ASCII white space has become one space. Each partition
    sorts its digests into runs of one entry a digest. Partition numbers of b bits then go through b binomial
    rounds, `rounds` of them in one exchange: partners that differ in these bits swap slices of their runs by
    the same bits of the digest, merge the runs they get and keep the smallest id of each digest, whose length and second
    hash verify it. Texts never move, and a group of copies is one entry a partition from the start, fewer after each exchange. The answer
    goes back to the partitions' entries and from them to the rows, so that no group gathers.

    Nulls: a text of null counts as empty. Rows without an id come after all others, so keep_id is null only
    where no equal row has an id. Ties: of rows with one id and equal texts the first in the table stays; exactly one row
    of each group is kept. Ids of any type, compared in their own order. An empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows, names = long_ids(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id")
    slim = cut(rows.select("id", text_key(normalised(F.col("text"))).alias("key"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("tie")))
    size = slim.agg(F.max("part").alias("last"), F.count("*").alias("n")).first()
    bits = max(math.ceil(math.log2((size["last"] or 0) + 1)), math.ceil(math.log2(max(1, size["n"] / run_rows))))
    own = _runs(slim, run_rows)
    tree = own.select(F.col("part").bitwiseAND(F.lit((1 << bits) - 1)).alias("node"), "run")
    for done in range(0, max(1, bits), rounds):
        tree = _exchanged(tree, done, min(rounds, bits - done), bits)
    groups = _entries(tree, 2).drop("part")
    mates = _entries(own, 1).select("part", "key").join(groups, "key")
    out = slim.join(mates, ["part", "key"], "left").select(
        F.col("id").alias("doc_id"),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("tie") == F.col("keep_tie"))).alias("kept"),
        F.lower(F.hex(F.substring("key", 1, 32))).alias("text_sha256"),
    )
    return named_ids(out, names, "doc_id", "keep_id")


def without_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    found = exact_duplicates(docs, **options)
    stays = found.where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    # The row travels as one column, so that no name of its own can clash.
    text = normalised(F.col(f"`{options.get('text_col', 'text')}`"))
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"), F.col(f"`{options.get('id_col', 'doc_id')}`").alias("_of"), F.sha2(text.cast("binary"), 256).alias("_text"))
    left = rows.join(stays, F.col("_of").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_sha")), "left_semi")
    if not found.where("NOT kept AND doc_id <=> keep_id").isEmpty():
        left = left.groupBy("_text").agg(F.first("_row").alias("_row"))
    return left.select([F.col("_row")[n].alias(n) for n in docs.columns])


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM d
"""
