"""Benchmark decontamination with a broadcast hash set of test n-grams."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, on_workers, table

WINDOW = 10
#: So many windows at most are broadcast at once (some 60 MB in a task); a larger benchmark is scanned in blocks.
BLOCK_WINDOWS = 200_000

OUT = "doc_id {id}, n_words long, hits array<int>, items array<string>"


def windows_of(items: DataFrame, n: int) -> DataFrame:
    """size, hash, key (the words, separated by spaces) and item_id of every window of the items (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            for lo, _, data, offsets in B.text_chunks(batch.column(1)):
                data = B.LOWER[data]
                starts, ends, first = B.words(data, offsets, B.ALNUM)
                hashes = B.word_hashes(data, starts, ends)
                raw = data.tobytes()
                out: list[tuple] = []
                for i in range(len(offsets) - 1):
                    a, b = int(first[i]), int(first[i + 1])
                    size = min(n, b - a)
                    of = B.gram_hashes(hashes[a:b], size) if size else []
                    for j in range(len(of)):
                        out.append((size, int(of[j].view(np.int64)), b" ".join(raw[starts[k] : ends[k]] for k in range(a + j, a + j + size)), names[lo + i]))
                columns = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.string()), strict=True)], names=["size", "hash", "key", "item_id"])

    return items.mapInArrow(run, "size int, hash long, key binary, item_id string")


class WindowSet:
    """A block of windows: sorted hashes, their words and the items that have them."""

    def __init__(self, rows: pa.Table):
        size, of = np.asarray(rows.column("size")), np.asarray(rows.column("hash")).view(np.uint64)
        self.hashes = {int(n): np.sort(of[size == n]) for n in np.unique(size)}
        self.items: dict[bytes, list[str]] = dict(zip(rows.column("key").to_pylist(), rows.column("items").to_pylist(), strict=True))


def _members(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Indexes of the values that are in the sorted table; a bitmap settles most of them."""
    bits = 22
    seen = np.zeros(1 << bits, bool)
    seen[(table >> np.uint64(64 - bits)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(values >> np.uint64(64 - bits)).astype(np.int64)])
    at = np.searchsorted(table, values[maybe])
    at[at == len(table)] = 0
    return maybe[table[at] == values[maybe]]


def scan_batches(batches: Iterator[pa.RecordBatch], windows: WindowSet, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """hits: the indexes of the document's words inside an occurrence; items: ids of the items found."""
    for batch in batches:
        counts, hits, items = [], [], []
        for _, _, data, offsets in B.text_chunks(batch.column(1)):
            data = B.LOWER[data]
            starts, ends, first = B.words(data, offsets, B.ALNUM)
            counts.append(np.diff(first))
            by_doc: dict[int, tuple[set, set]] = {}
            hashes = B.word_hashes(data, starts, ends)
            for n, of in windows.hashes.items():
                at = _members(B.gram_hashes(hashes, n), of)
                at = at[B.runs_inside(first, n, len(starts))[at]]
                for j in at.tolist():
                    key = b" ".join(data[starts[k] : ends[k]].tobytes() for k in range(j, j + n))
                    if key in windows.items:
                        doc = int(np.searchsorted(first, j, side="right")) - 1
                        own = by_doc.setdefault(doc, (set(), set()))
                        own[0].update(range(j - int(first[doc]), j - int(first[doc]) + n))
                        own[1].update(windows.items[key])
            for doc in range(len(offsets) - 1):
                own = by_doc.get(doc)
                hits.append(sorted(own[0]) if own else [])
                items.append(sorted(own[1]) if own else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.concatenate(counts) if counts else np.zeros(0), pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))],
            schema=schema,
        )


def find_windows(
    docs: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    n: int = WINDOW,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """One row per document: doc_id, n_words, hits (indexes of its words inside windows), items.

    Words are ASCII-lower-cased runs of letters, digits and non-ASCII characters. A window is
    n consecutive words of an item, or all of a shorter item. Window hashes select candidates,
    which the words themselves confirm. Tasks make the windows; the documents are scanned where they lie, without a
    shuffle, against a broadcast set of at most block_windows distinct windows. A larger benchmark is cut into blocks, each
    scanned against all documents; then hits are united by the text's digest and given back to all its rows.

    Nulls: a null document or item has no words; a null id stays null; a null item id is named
    "null". Repeated items add no windows, repeated documents give repeated rows, with one block and with
    several. Empty tables give no rows or no hits. Ids of any type; other columns are not read.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    bench = items.select(F.coalesce(F.col(f"`{item_id_col}`").cast("string"), F.lit("null")).alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).where("text IS NOT NULL")
    windows = cut(windows_of(bench, n).groupBy("size", "hash", "key").agg(F.collect_set("item_id").alias("items")))
    n_blocks = max(1, -(-windows.count() // block_windows))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def scanned(table: DataFrame, block: int, id_type: str) -> DataFrame:
        part = windows if n_blocks == 1 else windows.where(F.pmod("hash", F.lit(n_blocks)) == block)
        held = spark.sparkContext.broadcast(WindowSet(part.toArrow()))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                if out is None:
                    out = pa.schema([("doc_id", batch.schema.field(0).type), ("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
                yield from scan_batches(iter([batch]), held.value, out)

        return table.mapInArrow(scan, OUT.format(id=id_type))

    if n_blocks == 1:
        return scanned(rows, 0, kind)
    keyed = rows.select("doc_id", digest(F.col("text")).alias("digest"), "text")
    found = None
    for block in range(n_blocks):
        one = scanned(keyed.select("digest", "text"), block, "binary").withColumn("block", F.lit(block))
        found = one if found is None else found.unionByName(one)
    # Rows of one text agree; the partial aggregate keeps one of them in each task.
    single = found.groupBy(F.col("doc_id").alias("of"), "block").agg(F.first("n_words").alias("n_words"), F.first("hits").alias("hits"), F.first("items").alias("items"))
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = single.groupBy("of").agg(F.max("n_words").alias("n_words"), union("hits").alias("hits"), union("items").alias("items"))
    return keyed.select("doc_id", "digest").join(merged, F.col("digest") == F.col("of")).select("doc_id", "n_words", "hits", "items")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def clean_documents(docs: DataFrame, items: DataFrame, *, text_col: str = "text", max_share: float = 0.0, **options) -> DataFrame:
    """The rows of docs, all columns, whose share of hit words is at most max_share.

    Rows travel whole through the scan, so nothing is joined back; repeated rows stay as often as they came. A document
    without words stays. With several blocks of windows the rows travel packed beside their text's digest.
    """
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    found = find_windows(rows, items, id_col="_row", text_col="_text", **options)
    return found.where(F.size("hits") <= F.lit(max_share) * F.col("n_words")).select([F.col("doc_id")[n].alias(n) for n in docs.columns])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_windows(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple], items: list[tuple], n: int = WINDOW) -> dict:
    """The same result by plain loops, for tests: id -> (n_words, n_hit, n_items, sha256)."""
    import re

    def split(text):
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)

    windows: dict[tuple, set] = {}
    for item_id, text in items:
        w = split(text)
        size = min(n, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item_id))
    out = {}
    for doc_id, text in docs:
        w = split(text)
        hit, ids = set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    ids |= own
        out[doc_id] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
    return out
