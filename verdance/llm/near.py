"""Near-duplicate documents by min-max hashing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, long_ids, named_ids, on_workers, table
from .graph import components

SHINGLE = 5
#: Links need 100 * intersection >= LINK_PERCENT * union.
LINK_PERCENT = 80
#: What op7's contract says.
OP7_PERCENT = 85
#: Bands have ROWS values each; a permutation gives two values, its minimum and its maximum.
ROWS = 5
#: The chance to miss a pair at the link threshold; it sets the number of bands.
MISS = 1e-7
#: Classes that a task compares at once; larger groups are cut into blocks and compared block by block.
BLOCK = 256

_SEEDS = np.random.Generator(np.random.PCG64(77)).integers(0, 2**64, 4096, dtype=np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """For each text of a chunk the sorted distinct 64-bit hashes of its n-word shingles (all words if fewer)."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offsets, B.NOT_SPACE)
    hashes = B.word_hashes(data, starts, ends)
    grams = B.gram_hashes(hashes, n)
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= n:
            own = np.unique(grams[a : b - n + 1])
        else:
            own = B.gram_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)
        out.append(own)
    return out


def min_max(shingles: np.ndarray, permutations: int, block: int = 1 << 10) -> np.ndarray:
    """Minimum and maximum of the set under each permutation (an odd factor modulo 2^64), side by side."""
    factors = _SEEDS[:permutations] | np.uint64(1)
    low, high = np.full(permutations, 2**64 - 1, np.uint64), np.zeros(permutations, np.uint64)
    for at in range(0, len(shingles), block):
        x = np.multiply.outer(shingles[at : at + block], factors)
        np.minimum(low, x.min(axis=0), out=low)
        np.maximum(high, x.max(axis=0), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def bands_for(percent: int, rows: int, miss: float = MISS) -> int:
    """The least number of bands with which a pair at the threshold shares none with a chance of `miss` at most."""
    one = (percent / 100) ** rows
    if one <= 0:
        raise ValueError("percent must be above 0: sets that share nothing cannot be found by bands")
    return 1 if one >= 1 else math.ceil(math.log(miss) / math.log1p(-one))


def bands_of(signature: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One signed 64-bit hash a band; the band's number is part of it."""
    values = signature[: rows * bands].reshape(bands, rows) * (_SEEDS[-rows:] | np.uint64(1))
    return B.mix64(values.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits of the set."""
    return int(B.mix64(shingles).sum(dtype=np.uint64)).to_bytes(8, "big") + int(B.mix64(shingles ^ _SEEDS[0]).sum(dtype=np.uint64)).to_bytes(8, "big")


def profiles(docs: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set (fingerprint), bands. One pass over the texts."""
    on_workers(docs.sparkSession)
    permutations = -(-rows * bands // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, prints, keys = [], [], []
            for _, _, data, offsets in B.text_chunks(batch.column(1)):
                for own in shingle_sets(data, offsets, n):
                    sizes.append(len(own))
                    prints.append(fingerprint(own))
                    keys.append(bands_of(min_max(own, permutations), rows, bands) if len(own) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "set", "bands"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, set binary, bands array<long>")


def sets_of(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, shingles: the full sets as sorted hashes in a binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [s.tobytes() for _, _, data, offsets in B.text_chunks(batch.column(1)) for s in shingle_sets(data, offsets, n)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    at = np.searchsorted(x, y)
    at[at == len(x)] = 0
    both = int((x[at] == y).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = pa.array([similar(np.frombuffer(left[i].as_buffer(), np.uint64), np.frombuffer(right[i].as_buffer(), np.uint64), percent) for i in range(batch.num_rows)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left")), "a")
    joined = joined.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right")), "b")
    return joined.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def classes(docs: DataFrame, *, n: int, rows: int, bands: int) -> tuple[DataFrame, DataFrame]:
    """(members: doc_id, n_shingles, set, root; buckets: key, root). Documents of equal sets
    are one class, named by its smallest doc_id; buckets of one class are dropped."""
    members = cut(profiles(docs, n, rows, bands))
    roots = members.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("root"))
    keys = members.join(roots, (members["set"] == roots["set"]) & (members["doc_id"] == roots["root"])).select(F.explode("bands").alias("key"), "root")
    shared = keys.groupBy("key").agg(F.min("root").alias("leader"), F.max("root").alias("last")).where("leader < last").drop("last")
    buckets = cut(keys.join(shared, "key").distinct())
    return members, buckets


def _block_links(members: pa.Table, percent: int) -> pa.Table:
    """Links that join clusters, among the members of a block that share a bucket. One per joined pair of clusters."""
    roots, groups = members.column("root").to_pylist(), members.column("cluster").to_pylist()
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.column("shingles").combine_chunks()]
    parent = {g: g for g in groups}

    def top(g: int) -> int:
        while parent[g] != g:
            parent[g] = parent[parent[g]]
            g = parent[g]
        return g

    sharing: dict[int, list[int]] = {}
    for i, keys in enumerate(members.column("keys").to_pylist()):
        for key in keys:
            sharing.setdefault(key, []).append(i)
    found, tried = [], set()
    for own in sharing.values():
        for k, i in enumerate(own):
            for j in own[k + 1 :]:
                if (i, j) in tried or top(groups[i]) == top(groups[j]):
                    continue
                tried.add((i, j))
                if similar(sets[i], sets[j], percent):
                    found.append((roots[i], roots[j]))
                    parent[top(groups[i])] = top(groups[j])
    return pa.table([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def links(docs: DataFrame, buckets: DataFrame, *, n: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Confirmed links (a, b) between classes that join all classes linked in any bucket.

    First every class of a bucket is compared with the bucket's smallest, which joins a group of copies
    into few clusters. Then only pairs in one bucket and of different clusters can matter. The classes
    of such buckets are grouped by reachability, so that each set travels once, and a task compares
    the pairs of a group that share a bucket, skipping pairs joined meanwhile. A group of more than
    `block` classes is cut into blocks, and each pair of blocks is a task's work, so nothing is capped.
    """
    texts = docs.join(buckets.select(F.col("root").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    sets = cut(sets_of(texts, n))
    stars = buckets.where("root <> leader").select(F.col("leader").alias("a"), F.col("root").alias("b")).distinct()
    found = cut(confirmed(stars, sets, percent))
    named = components(found).select(F.col("node").alias("root"), F.col("component").alias("cluster"))
    placed = cut(buckets.join(named, "root", "left").select("key", "root", F.coalesce("cluster", "root").alias("cluster")))
    open_ = placed.groupBy("key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.min("root").alias("leader")).where("low <> high").select("key", "leader")
    mixed = cut(placed.join(open_, "key"))
    groups = components(mixed.select(F.col("leader").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("root"), F.col("component").alias("group"))
    sizes = groups.groupBy("group").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    keyed = mixed.groupBy("root", "cluster").agg(F.collect_set("key").alias("keys")).join(groups, "root").join(sizes, "group")
    own = F.pmod(F.xxhash64("root"), F.col("blocks")).cast("int")
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda other: F.struct(F.least(F.col("own"), other).alias("i"), F.greatest(F.col("own"), other).alias("j")))
    dealt = keyed.withColumn("own", own).withColumn("pair", F.explode(pair)).join(sets.withColumnRenamed("doc_id", "root"), "root")
    dealt = dealt.select("group", "pair.i", "pair.j", "root", "cluster", "keys", "shingles")

    def compare(members: pa.Table) -> pa.Table:
        return _block_links(members, percent)

    return found.unionByName(dealt.groupBy("group", "i", "j").applyInArrow(compare, "a long, b long"))


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = SHINGLE,
    percent: int = LINK_PERCENT,
    rows: int = ROWS,
    bands: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are ASCII-lower-cased runs of non-space; a document's set holds its distinct
    n-word shingles, or all its words if fewer. Each permutation gives its minimum and its maximum, so
    rows * bands values take half as many hash passes; documents that share a band are
    candidates, and full sets confirm a link. Without `bands` there are as many as bring the
    chance to miss a pair at `percent` to MISS or less (41 of 5 at 80, 28 of 5 at 85); one at higher
    similarity is missed less often.

    Documents of equal sets are one class before any pair is made, so a group of copies costs
    one member. The component is named by the smallest doc_id in it; kept marks that one.

    Nulls: a document without words or text is empty, linked to nothing and kept. Rows without an
    id have component null and are kept. Repeated rows of one id share its component; all of
    them come back. Ties: a pair exactly at `percent` is linked. Ids of any type, compared in their own order. An
    empty table gives an empty result; other columns are not read.
    """
    bands = bands_for(percent, rows) if bands is None else bands
    rows_, names = long_ids(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    known = rows_.where("doc_id is not null")
    members, buckets = classes(known, n=n, rows=rows, bands=bands)
    named = components(links(known, buckets, n=n, percent=percent))
    roots = members.where("n_shingles > 0").groupBy("set").agg(F.min("doc_id").alias("root"))
    roots = roots.join(named.select(F.col("node").alias("root"), "component"), "root", "left").select("set", F.coalesce("component", "root").alias("component"))
    # An empty set is no class: its key is made its own, so that empty documents don't meet in one task.
    keyed = members.withColumn("set", F.when(F.col("n_shingles") > 0, F.col("set")).otherwise(F.col("doc_id").cast("string").cast("binary")))
    out = keyed.join(roots, "set", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    lost = profiles(rows_.where("doc_id is null"), n, rows, 1).select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return named_ids(out.unionByName(lost), names, "doc_id", "component_id")


def without_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns, without documents that have a smaller one in their component.

    Of repeated rows of one id one stays; rows without an id stay.
    """
    id_col = f"`{options.get('id_col', 'doc_id')}`"
    gone = near_duplicates(docs, **options).where("NOT kept").select(F.col("doc_id").alias("_of")).distinct()
    # The row travels as one column, so that no name of its own can clash.
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in docs.columns]).alias("_row"), F.col(id_col).alias("_id"))
    left = rows.join(gone, F.col("_id") == F.col("_of"), "left_anti")
    ids = docs.agg(F.count(id_col).alias("n"), F.countDistinct(id_col).alias("distinct")).first()
    if ids["n"] != ids["distinct"]:
        left = left.where("_id IS NOT NULL").groupBy("_id").agg(F.first("_row").alias("_row")).select("_row", "_id").unionByName(left.where("_id IS NULL"))
    return left.select([F.col("_row")[n].alias(n) for n in docs.columns])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=OP7_PERCENT)


def brute_force(docs: list[tuple], n: int = SHINGLE, percent: int = LINK_PERCENT) -> dict[int, tuple]:
    """The same by comparing all pairs, for tests: id -> (n_shingles, component_id, kept)."""
    import re

    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def top(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and percent * max(len(x), len(y)) <= 100 * min(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = top(a), top(b)
                    parent[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), top(i), top(i) == i) for i in ids}
