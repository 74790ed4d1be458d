"""Language-model scores from a hierarchical Pitman-Yor model."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdance.sources.shared import scratch, shuffles_removed

from . import bytesops as B
from .common import cut, deleted, long_ids, named_ids, on_workers, table
from .suffixes import dealt, home, pack, unpack

#: The most frequent words of a sample: as contexts so many travel in two bytes, all others in eight.
CONTEXTS = (1 << 16) - 1
#: So many of them are dealt out by word and context, so that none gathers in one bucket.
HOT = 1_024
#: So many of its most frequent pairs are only counted, and scored where the documents lie.
HOT_PAIRS = 1 << 16
#: Buckets whose restaurants' sizes are added up in one task.
HOME_BUCKETS = 4
SAMPLE_DOCS = 1_000
BUCKET_BYTES = 12 << 20
BATCH_BYTES = 8 << 20
BURN_IN, SAMPLES = 1, 3
STRENGTH = 1.0
SEED = 20
END = np.uint64(0x5EED0E0D0E0D5EED)
#: Parts of a document's sums are whole numbers of such units, so that their order changes nothing.
BASE_UNIT, SCORE_UNIT = 2.0**-32, 2.0**-24


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hash, context, text) of all tokens of a chunk: each text's words, then one end; a context is the previous token's hash, the first one an end."""
    data = B.LOWER[data]
    starts, ends, first = B.words(data, offsets, B.NOT_SPACE)
    hashes = B.word_hashes(data, starts, ends)
    n_texts = len(offsets) - 1
    counts = np.diff(first)
    owner = np.repeat(np.arange(n_texts), counts + 1)
    out = np.full(len(owner), END, np.uint64)
    out[np.arange(len(hashes)) + np.repeat(np.arange(n_texts), counts)] = hashes
    context = np.full(len(out), END, np.uint64)
    context[1:] = out[:-1]
    return out, context, owner


def pair_hashes(words: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    return B.mix64(B.mix64(contexts) + words)


def found(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place among the sorted known ones, whether it is one of them) of each value."""
    if not len(known):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def coded(known: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(two-byte codes of hashes, CONTEXTS for unknown ones; the unknown ones; how many of them are before each place)."""
    code, is_known = found(known, hashes)
    return np.where(is_known, code, CONTEXTS).astype(np.uint16), hashes[~is_known], np.concatenate([[0], np.cumsum(~is_known)])


def decoded(known: np.ndarray, code: np.ndarray, rare: np.ndarray) -> np.ndarray:
    out = known[np.minimum(code, len(known) - 1)]
    out[code == CONTEXTS] = rare
    return out


class Frequent:
    """What a sample knows to be frequent. It decides where pairs are counted and how contexts are written, never what is counted."""

    def __init__(self, words: np.ndarray, pair_words: np.ndarray, pair_contexts: np.ndarray, buckets: int):
        """words by falling frequency."""
        self.buckets = buckets
        self.words = np.unique(np.append(words[: HOT - 1], END))
        self.contexts = np.unique(np.append(words[: CONTEXTS - 1], END))
        hashes = pair_hashes(pair_words, pair_contexts)
        self.pairs, first = np.unique(hashes, return_index=True)
        self.pair_words, self.pair_contexts = pair_words[first], pair_contexts[first]
        self.pair_bucket = self.bucket(self.pair_words, self.pairs)

    def bucket(self, words: np.ndarray, pairs: np.ndarray) -> np.ndarray:
        """Buckets go by word, those of hot words by pair."""
        by = np.where(found(self.words, words)[1], pairs, words)
        return ((by >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int32)


def seat(customers: np.ndarray, inflow: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of a dish after seating its customers by the Chinese restaurant process.

    inflow is (strength + discount * tables of the restaurant) * the parent's probability of
    the dish: customer n+1 takes a new table with chance inflow / (inflow + n - discount * tables).
    The first 32 customers sit down one by one, then groups of an eighth of those seated.
    """
    tables = (customers > 0).astype(np.int64)
    at = np.flatnonzero(customers > 1)
    n = 1
    while len(at):
        step = np.ones(len(at), np.int64) if n < 32 else np.minimum(customers[at] - n, n // 8)
        chance = inflow[at] / (inflow[at] + n - discount * tables[at])
        tables[at] += rng.random(len(at)) < chance if n < 32 else rng.binomial(step, chance)
        # All of one round are at the same n; those that end within a group leave.
        n += 1 if n < 32 else n // 8
        at = at[customers[at] > n]
    return tables


class Shape:
    """What a sweep knows of the whole corpus: training counts of the hot words, discounts, totals."""

    def __init__(self, counts: np.ndarray, scalars: dict[str, float]):
        self.counts = counts
        self.n, self.v = scalars["n"], scalars["v"]
        discount = lambda a, b: float(np.clip(a / max(1.0, a + 2 * b), 0.1, 0.95))
        self.low, self.high = discount(scalars["ones"], scalars["twos"]), discount(scalars["up_ones"], scalars["up_twos"])
        #: For each sweep, the first being the start: the hot words' customers and tables in the parent, customers and tables of the parent.
        self.sweeps: list[tuple[np.ndarray, float, float]] = []

    def parent(self, customers: np.ndarray, tables: np.ndarray, sweep: int) -> np.ndarray:
        """The parent's probability of words; 0 customers: of an unknown word."""
        _, all_customers, all_tables = self.sweeps[sweep]
        return (customers - self.high * tables + (STRENGTH + self.high * all_tables) / (self.v + 1)) / (STRENGTH + all_customers)

    def seat_parent(self, customers: np.ndarray, sweep: int, rng: np.random.Generator) -> np.ndarray:
        """The parent's tables of words, given the sweep before."""
        return seat(customers, np.full(len(customers), (STRENGTH + self.high * self.sweeps[sweep - 1][2]) / (self.v + 1)), self.high, rng)


class Types:
    """The word-context pairs of a bucket with their training counts. Of a hot word other buckets have pairs, too."""

    def __init__(self, blob: bytes, frequent: Frequent):
        self.words, lengths, self.context, self.count, self.at_hand, self.pair = unpack(blob)
        self.word = np.repeat(np.arange(len(self.words)), lengths)
        self.total = np.bincount(self.word, self.count, len(self.words))
        rank, is_hot = found(frequent.words, self.words)
        self.hot, self.rank = np.flatnonzero(is_hot), rank[is_hot]

    def up(self, tables: np.ndarray) -> np.ndarray:
        return np.bincount(self.word, tables, len(self.words)).astype(np.int64)

    def own(self, of_words: np.ndarray) -> np.ndarray:
        """of_words without those of hot words, which the driver knows."""
        out = of_words.copy()
        out[self.hot] = 0
        return out

    def of_hot(self, of_words: np.ndarray) -> np.ndarray:
        return np.bincount(self.rank, of_words[self.hot], HOT).astype(np.int64)

    def parent(self, shape: Shape, customers: np.ndarray, upper: np.ndarray, sweep: int) -> np.ndarray:
        customers, upper = customers.copy(), upper.copy()
        customers[self.hot], upper[self.hot] = shape.sweeps[sweep][0][:, self.rank]
        return shape.parent(customers, upper, sweep)

    def chain(self, shape: Shape, bucket: int, sizes: list[np.ndarray], sweeps: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(sweep, tables, parent's customers, parent's tables) of the sweeps from 1; the same whenever it is run.
        sizes holds, for the start and each sweep, the tables of the restaurants of the bucket's contexts."""
        tables = (self.count > 0).astype(np.int64)
        customers = self.up(tables)
        upper = (customers > 0).astype(np.int64)
        for sweep in range(1, sweeps + 1):
            rng = np.random.Generator(np.random.PCG64([SEED, bucket, sweep]))
            inflow = (STRENGTH + shape.low * sizes[sweep - 1][self.context]) * self.parent(shape, customers, upper, sweep - 1)[self.word]
            tables = seat(self.count, inflow, shape.low, rng)
            customers = self.up(tables)
            upper = shape.seat_parent(self.own(customers), sweep, rng)
            yield sweep, tables, customers, upper


def _count_blobs(batches: Iterator[pa.RecordBatch], frequent: Frequent) -> Iterator[pa.RecordBatch]:
    """Deals tokens out by bucket. Hot pairs go as training counts only."""
    held: list[tuple] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids, tags, train, words, contexts, owner = (np.concatenate(x) for x in zip(*held, strict=True))
        pairs = pair_hashes(words, contexts)
        rank, hand = found(frequent.pairs, pairs)
        counts = np.bincount(rank[hand], train[owner[hand]], len(frequent.pairs)).astype(np.int64)
        cold = ~hand
        w, c, o = words[cold], contexts[cold], owner[cold]
        t = frequent.bucket(w, pairs[cold])
        # Stable, so that owners stay in order.
        order = np.lexsort((w, t))
        w, c, o, t = w[order], c[order], o[order], t[order]
        code, rare, before = coded(frequent.contexts, c)
        counted = np.flatnonzero(counts)
        counted = counted[np.argsort(frequent.pair_bucket[counted], kind="stable")]
        rows, targets = [], np.union1d(t, frequent.pair_bucket[counted])
        for to in targets:
            i, j = np.searchsorted(t, [to, to + 1])
            k, m = np.searchsorted(frequent.pair_bucket[counted], [to, to + 1])
            own, start = np.unique(w[i:j], return_index=True)
            names, name = np.unique(o[i:j], return_inverse=True)
            rows.append(
                pack(
                    *coded(frequent.contexts, own)[:2], np.diff(np.append(start, j - i)).astype(np.int32), code[i:j], rare[before[i] : before[j]], name.astype(np.int32),
                    ids[names], tags[names], train[names], counted[k:m].astype(np.int32), counts[counted[k:m]],
                )
            )
        yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "blob"])

    base = 0
    for batch in batches:
        ids, tags, train = (np.asarray(batch.column(i)) for i in range(3))
        for lo, hi, data, offsets in B.text_chunks(batch.column(3)):
            words, contexts, owner = tokens(data, offsets)
            held.append((ids[lo:hi], tags[lo:hi], train[lo:hi], words, contexts, owner + base))
            base += hi - lo
            size += len(data)
            if size > BATCH_BYTES:
                yield from flush()
                held.clear()
                size = base = 0
    yield from flush()


def _gathered(bucket: int, blobs: list[bytes], frequent: Frequent) -> tuple[bytes, bytes, bytes]:
    """(types, contexts, occurrences) of a bucket: occurrences hold, by document, the types it has; contexts are sorted, and types name their places."""
    parts = [unpack(b) for b in blobs]
    parts = [(decoded(frequent.contexts, *p[:2]), p[2], decoded(frequent.contexts, *p[3:5]), *p[5:]) for p in parts]
    hand = np.flatnonzero(frequent.pair_bucket == bucket)
    words = np.unique(np.concatenate([*[p[0] for p in parts], frequent.pair_words[hand]]))
    contexts, context = np.unique(np.concatenate([*[p[2] for p in parts], frequent.pair_contexts[hand]]), return_inverse=True)
    word = np.concatenate([*[np.repeat(np.searchsorted(words, p[0]), p[1]) for p in parts], np.searchsorted(words, frequent.pair_words[hand])])
    types, of = np.unique(word.astype(np.int64) * len(contexts) + context, return_inverse=True)
    base = np.cumsum([0] + [len(p[4]) for p in parts])
    doc = np.concatenate([p[3] + b for p, b in zip(parts, base, strict=False)])
    ids, tags, train = (np.concatenate([p[i] for p in parts]) for i in (4, 5, 6))
    of, at_hand = of[: len(doc)], of[len(doc) :]
    count = np.bincount(of, train[doc], len(types)).astype(np.int64)
    of_pair = np.bincount(np.concatenate([p[7] for p in parts]), np.concatenate([p[8] for p in parts]), len(frequent.pairs)).astype(np.int64)
    count[at_hand] += of_pair[hand]
    order = np.argsort(doc, kind="stable")
    occurrences = pack(ids, tags, np.bincount(doc, minlength=len(ids)).astype(np.int32), of[order].astype(np.int32))
    lengths = np.bincount(types // max(1, len(contexts)), minlength=len(words)).astype(np.int32)
    return pack(words, lengths, (types % max(1, len(contexts))).astype(np.int32), count, at_hand.astype(np.int32), hand.astype(np.int32)), pack(contexts), occurrences


def _added_up(group: pa.Table) -> pa.Table:
    """The start's sizes of a home's restaurants: to each bucket go numbers, customers and tables of those it has. Home -1 adds up scalars."""
    parts = [unpack(b.as_py()) for b in group.column("blob")]
    names = ["bucket", "home", "ids", "customers", "tables"]
    at = group.column("home")[0].as_py()
    if at < 0:
        total = pack(np.sum([p[0] for p in parts], axis=0))
        return pa.table([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), *[pa.array([x], pa.binary()) for x in (None, None, total)]], names=names)
    contexts, of = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    customers, tables = (np.bincount(of, np.concatenate([p[i] for p in parts]), len(contexts)).astype(np.int64) for i in (1, 2))
    own = np.split(of, np.cumsum([len(p[0]) for p in parts])[:-1])
    blobs = [[pack(np.diff(x, prepend=0).astype(np.int32)) for x in own], [pack(customers[x]) for x in own], [pack(tables[x].astype(np.int32)) for x in own]]
    return pa.table([group.column("bucket").combine_chunks(), group.column("home").combine_chunks(), *[pa.array(b, pa.binary()) for b in blobs]], names=names)


def _tables_added_up(group: pa.Table) -> pa.Table:
    """As _added_up for a sweep's tables, by the restaurants' numbers."""
    parts = [unpack(b.as_py()) for b in group.column("blob")]
    names = ["bucket", "home", "tables"]
    if group.column("home")[0].as_py() < 0:
        return pa.table([pa.array([-1], pa.int32()), pa.array([-1], pa.int32()), pa.array([pack(np.sum([p[0] for p in parts], axis=0))], pa.binary())], names=names)
    own = [np.cumsum(p[0]) for p in parts]
    tables = np.bincount(np.concatenate(own), np.concatenate([p[1] for p in parts])).astype(np.int32)
    return pa.table([group.column("bucket").combine_chunks(), group.column("home").combine_chunks(), pa.array([pack(tables[x]) for x in own], pa.binary())], names=names)


def _sizes(replies: pa.Table, sweeps: int) -> tuple[list[tuple[int, np.ndarray]], np.ndarray | None, list[np.ndarray]]:
    """((home, steps of numbers) of the homes, customers where they were sent, tables of the start and of each sweep) of a bucket's restaurants, in the order of its contexts."""
    rows = sorted(replies.select(["sweep", "home", "ids", "customers", "tables"]).to_pylist(), key=lambda r: (r["sweep"], r["home"]))
    first = [r for r in rows if r["sweep"] == 0]
    tables = [np.concatenate([unpack(r["tables"])[0] for r in rows if r["sweep"] == s]) for s in range(sweeps)]
    customers = np.concatenate([unpack(r["customers"])[0] for r in first]) if first[0]["customers"] else None
    return [(r["home"], unpack(r["ids"])[0]) for r in first], customers, tables


def _predictive(types: Types, shape: Shape, bucket: int, customers: np.ndarray, sizes: list[np.ndarray]) -> np.ndarray:
    """Probability of each type, averaged over the sampled seatings."""
    total = np.zeros(len(types.count))
    for sweep, tables, up, upper in types.chain(shape, bucket, sizes, BURN_IN + SAMPLES):
        if sweep > BURN_IN:
            flow = STRENGTH + shape.low * sizes[sweep][types.context]
            total += (types.count - shape.low * tables + flow * types.parent(shape, up, upper, sweep)[types.word]) / (STRENGTH + customers[types.context])
    return total / SAMPLES


def score_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held=held_out, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Level one has a restaurant for each previous word, level two one restaurant for all, above
    a uniform base over the training words and one unknown. Documents that are not held out
    are the customers. Tokens are dealt out by word, so that a task holds all customers and tables of its words;
    a Gibbs sweep seats them anew, given the last sweep's restaurant sizes, which are added up in homes by context
    and sent back to the buckets that have the context. Predictive probabilities are averaged over SAMPLES sweeps after
    BURN_IN; discounts come from the counts of ones and twos. The HOT most frequent words of a
    sample are dealt out by word and context, and the driver adds up and seats their customers in the parent (HOT numbers); its HOT_PAIRS most frequent pairs
    are sent as counts only and scored where the documents lie, so a word or pair that makes up a third of the corpus gathers nowhere.

    Nulls: a null text is empty and has one token, its end; a null id counts as the empty text for the split and gives null.
    Repeated rows come back as often as they came. Ids of any type. An empty table gives an empty result; other columns are not read.
    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows, names_of = long_ids(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), (~held(F.col(f"`{id_col}`"))).alias("train")))
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids")).first()
    unique = facts["n"] == facts["ids"]
    # A null id is told apart by its tag, as are rows of one id.
    tag = F.lit(0).cast("long") if unique else F.xxhash64(F.coalesce("text", F.lit("")), F.col("doc_id").isNull())
    ready = rows.select(F.coalesce("doc_id", F.lit(0)).alias("id"), tag.alias("tag"), "train", "text")
    n_buckets = max(1, -(-(facts["bytes"] or 0) // bucket_bytes))

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in B.text_chunks(batch.column(0)):
                words, contexts, _ = tokens(data, offsets)
                _, first, count = np.unique(pair_hashes(words, contexts), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(contexts[first].view(np.int64)), pa.array(count)], names=["word", "context", "n"])

    some = rows.sample(min(1.0, SAMPLE_DOCS / max(1, facts["n"])), seed=5).limit(2 * SAMPLE_DOCS).select("text")
    some = cut(some.mapInArrow(sampled, "word long, context long, n long").groupBy("word", "context").agg(F.sum("n").alias("n")))
    top = some.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(CONTEXTS - 1).select("word").toArrow()
    top_pairs = some.orderBy(F.desc("n"), "word", "context").limit(HOT_PAIRS).select("word", "context").toArrow()
    hashes = lambda t, c: np.asarray(t.column(c)).astype(np.int64).view(np.uint64)
    frequent = spark.sparkContext.broadcast(Frequent(hashes(top, "word"), hashes(top_pairs, "word"), hashes(top_pairs, "context"), n_buckets))

    def count_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _count_blobs(batches, frequent.value)

    def gather(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        found_ = _gathered(bucket, [b.as_py() for b in group.column("blob")], frequent.value)
        return pa.table([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in found_]], names=["bucket", "types", "contexts", "occurrences"])

    # Written in buckets, so that what comes back to them is brought to where they lie.
    path, name = scratch(spark, "lm"), f"lm_{uuid.uuid4().hex}"
    gathered = ready.mapInArrow(count_blobs, "bucket int, blob binary").groupBy("bucket").applyInArrow(gather, "bucket int, types binary, contexts binary, occurrences binary")
    with shuffles_removed(spark):
        gathered.write.bucketBy(max(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket").option("path", path).saveAsTable(name)
    buckets = spark.table(name)
    types = buckets.select("bucket", "types")
    n_homes = -(-n_buckets // HOME_BUCKETS)
    replies: list[DataFrame] = []
    paths = [path]

    def shared(sent: DataFrame, add, schema: str) -> np.ndarray:
        """Adds up what the buckets sent and keeps the replies to them; returns the scalars."""
        paths.append(scratch(spark, "lm-sizes"))
        with shuffles_removed(spark):
            sent.groupBy("home").applyInArrow(add, schema).write.parquet(paths[-1])
        back = spark.read.schema(schema).parquet(paths[-1])
        for column in ("ids", "customers"):
            back = back if column in back.columns else back.withColumn(column, F.lit(None).cast("binary"))
        replies.append(back.where("bucket >= 0").select("bucket", "home", "ids", "customers", "tables", F.lit(len(replies)).alias("sweep")))
        scalars = [unpack(r[0])[0] for r in back.where("bucket < 0").select("tables").collect()]
        return scalars[0] if scalars else np.zeros(7 + 2 * HOT, np.int64)

    def with_replies(left: DataFrame, work, schema: str) -> DataFrame:
        all_of = functools.reduce(DataFrame.unionByName, replies)
        if len(replies) <= BURN_IN + SAMPLES:
            all_of = all_of.withColumn("customers", F.lit(None).cast("binary"))
        return left.groupBy("bucket").cogroup(all_of.groupBy("bucket")).applyInArrow(work, schema)

    sent = "home int, bucket int, blob binary"
    names = ["home", "bucket", "blob"]

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob, own in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                t, contexts = Types(blob, frequent.value), unpack(own)[0]
                one = (t.count > 0).astype(np.int64)
                up = t.up(one)
                cold = t.own(up)
                scalars = np.array([t.count.sum(), (t.own(t.total) > 0).sum(), (t.count == 1).sum(), (t.count == 2).sum(), (cold == 1).sum(), (cold == 2).sum(), one.sum()], np.int64)
                to, blobs = [-1], [pack(np.concatenate([scalars, t.of_hot(t.total), t.of_hot(up)]))]
                customers, tables = (np.bincount(t.context, x, len(contexts)) for x in (t.count, one))
                at = ((contexts >> np.uint64(32)) * np.uint64(n_homes) >> np.uint64(32)).astype(np.int64)
                for h in np.unique(at):
                    i, j = np.searchsorted(at, [h, h + 1])
                    to.append(int(h))
                    blobs.append(pack(contexts[i:j], customers[i:j].astype(np.int64), tables[i:j].astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([bucket] * len(to), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    x = shared(buckets.select("bucket", "types", "contexts").mapInArrow(start, sent), _added_up, "bucket int, home int, ids binary, customers binary, tables binary")
    hot_counts, hot_types = x[7 : 7 + HOT], x[7 + HOT :]
    scalars = dict(zip(("n", "v", "ones", "twos", "up_ones", "up_twos"), map(int, x[:6]), strict=True))
    scalars["v"] += int((hot_counts > 0).sum())
    scalars["up_ones"] += int((hot_types == 1).sum())
    scalars["up_twos"] += int((hot_types == 2).sum())
    shape = Shape(hot_counts, scalars)
    # A type with customers has one table at first, so the parent has a customer a type and a table a word.
    shape.sweeps.append((np.stack([hot_types, hot_types > 0]).astype(np.int64), float(x[6]), float(shape.v)))
    for sweep in range(1, BURN_IN + SAMPLES + 1):

        def one_sweep(left: pa.Table, right: pa.Table) -> pa.Table:
            bucket, t = left.column("bucket")[0].as_py(), Types(left.column("types")[0].as_py(), frequent.value)
            homes, _, sizes = _sizes(right, sweep)
            *_, (_, tables, customers, upper) = t.chain(shape, bucket, sizes, sweep)
            of_contexts = np.bincount(t.context, tables, len(sizes[0])).astype(np.int32)
            to, blobs, at = [-1], [pack(np.concatenate([[customers.sum(), upper.sum()], t.of_hot(customers)]).astype(np.int64))], 0
            for h, steps in homes:
                to.append(h)
                blobs.append(pack(steps, of_contexts[at : at + len(steps)]))
                at += len(steps)
            return pa.table([pa.array(to, pa.int32()), pa.array([bucket] * len(to), pa.int32()), pa.array(blobs, pa.binary())], names=names)

        x = shared(with_replies(types, one_sweep, sent), _tables_added_up, "bucket int, home int, tables binary")
        hot = x[2 : 2 + HOT]
        hot_upper = shape.seat_parent(hot, sweep, np.random.Generator(np.random.PCG64([SEED, n_buckets, sweep])))
        shape.sweeps.append((np.stack([hot, hot_upper]), float(x[0]), float(x[1] + hot_upper.sum())))

    def packed_sums(ids: np.ndarray, tags: np.ndarray, total: np.ndarray, known: np.ndarray, base: np.ndarray, score: np.ndarray, copies: np.ndarray) -> Iterator[pa.RecordBatch]:
        base, score = (np.rint(x / unit).astype(np.int64) for x, unit in ((base, BASE_UNIT), (score, SCORE_UNIT)))
        yield from dealt(home(ids, tags, n_buckets), ids, tags, total, known, base, -score, copies, name="home")

    def by_word(left: pa.Table, right: pa.Table) -> pa.Table:
        """Parts of the documents' sums, and (home -1) count and score of the hot pairs."""
        bucket, t = left.column("bucket")[0].as_py(), Types(left.column("types")[0].as_py(), frequent.value)
        _, customers, sizes = _sizes(right, BURN_IN + SAMPLES + 1)
        p = np.log10(_predictive(t, shape, bucket, customers, sizes))
        t.total[t.hot] = shape.counts[t.rank]
        ids, tags, lengths, of = unpack(left.column("occurrences")[0].as_py())
        doc = np.repeat(np.arange(len(ids)), lengths)
        own = t.total[t.word[of]]
        n, zero = len(ids), np.zeros(len(ids), np.int64)
        sums_ = list(packed_sums(ids, tags, zero, np.bincount(doc, own > 0, n).astype(np.int64), np.bincount(doc, np.log10(own + 1), n), np.bincount(doc, p[of], n), zero)) if n else []
        pairs = pack(t.pair, t.total[t.word[t.at_hand]].astype(np.int64), p[t.at_hand])
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([pairs], pa.binary())], names=["home", "blob"]), *sums_])

    # A word's task sends its part of a document's sums packed, one row for a group of documents.
    blob = "home int, blob binary"
    parts_path = scratch(spark, "lm-parts")
    with shuffles_removed(spark):
        with_replies(buckets.select("bucket", "types", "occurrences"), by_word, blob).write.parquet(parts_path)
    spark.sql(f"DROP TABLE {name}")
    for done in paths:
        deleted(spark, done)
    parts = spark.read.schema(blob).parquet(parts_path)
    log_p, counts = np.zeros(len(frequent.value.pairs)), np.zeros(len(frequent.value.pairs))
    for r in parts.where("home < 0").collect():
        pairs, count, p = unpack(r["blob"])
        log_p[pairs], counts[pairs] = p, count
    scores = spark.sparkContext.broadcast((log_p, counts))

    def at_hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p, counts = scores.value
        for batch in batches:
            ids, tags = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            parts = []
            for lo, hi, data, offsets in B.text_chunks(batch.column(3)):
                words, contexts, owner = tokens(data, offsets)
                n = hi - lo
                rank, mine = found(frequent.value.pairs, pair_hashes(words, contexts))
                rank, o = rank[mine], owner[mine]
                parts.append((np.bincount(owner, minlength=n), np.bincount(o, counts[rank] > 0, n), np.bincount(o, np.log10(counts[rank] + 1), n), np.bincount(o, log_p[rank], n)))
            if parts:
                total, known, base, score = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield from packed_sums(ids, tags, total.astype(np.int64), known.astype(np.int64), base, score, np.ones(len(total), np.int64))

    columns = ["id", "tag", "tokens", "known", "base", "score", "copies"]

    def sums(group: pa.Table) -> pa.Table:
        """The parts of each document of a home added up."""
        parts = [np.concatenate(x) for x in zip(*[unpack(b.as_py()) for b in group.column("blob")], strict=True)]
        order = np.lexsort((parts[1], parts[0]))
        parts = [x[order] for x in parts]
        new = np.ones(len(order), bool)
        new[1:] = (parts[0][1:] != parts[0][:-1]) | (parts[1][1:] != parts[1][:-1])
        starts = np.flatnonzero(new)
        ids, tags, total, known, base, score, copies = [x[starts] for x in parts[:2]] + [np.add.reduceat(x, starts) for x in parts[2:]]
        return pa.table([pa.array(c) for c in (ids, tags, total, known, base * BASE_UNIT, score * -SCORE_UNIT, copies)], names=columns)

    partial = ready.mapInArrow(at_hand, blob).unionByName(parts.where("home >= 0"))
    total = partial.groupBy("home").applyInArrow(sums, "id long, tag long, tokens long, known long, base double, score double, copies long")
    if not unique:
        # Which ids were null is found again from their tags.
        lost = cut(rows.where("doc_id IS NULL").select(F.xxhash64(F.coalesce("text", F.lit("")), F.lit(True)).alias("tag"), F.lit(0).cast("long").alias("id"), F.lit(True).alias("lost")).distinct())
        total = total.join(lost, ["id", "tag"], "left").withColumn("doc_id", F.when(F.col("lost").isNull(), F.col("id")))
        total = total.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    else:
        total = total.withColumn("doc_id", F.col("id"))
    total = named_ids(total, names_of, "doc_id")
    norm = float(np.log10(shape.n + shape.v + 1))
    n_tokens = F.expr("tokens div copies")
    score = F.col("score") / F.col("copies")
    return total.select(
        "doc_id",
        held(F.col("doc_id")).alias("held_out"),
        n_tokens.alias("n_tokens"),
        F.expr("known div copies").alias("n_known"),
        F.lit(int(shape.n)).cast("long").alias("train_tokens"),
        (F.col("base") / F.col("copies") - n_tokens * F.lit(norm)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / n_tokens).alias("perplexity"),
    )


def op2_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
