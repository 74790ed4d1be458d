"""Token counts without token ids."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import long_ids, named_ids, on_workers, table
from .suffixes import flat, home, pack, unpack

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
#: So many of a sample's most frequent pre-tokens are counted first and broadcast with their pieces.
HOT = 200_000
#: Longest pre-token that may be among the broadcast ones, so that their size is bounded.
HOT_BYTES = 64
SAMPLE_DOCS = 20_000
#: Bytes of text a bucket of pre-tokens stands for, and a map task gathers before it deals them out.
BUCKET_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
#: Pre-tokens handed to the tokenizer at once.
AT_ONCE = 20_000
#: Space, tab and line ends: no piece of this tokenizer spans them.
PRE_TOKEN = np.ones(256, bool)
PRE_TOKEN[[9, 10, 13, 32]] = False


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def pieces_of(path: str, words: pa.Array) -> np.ndarray:
    """The number of pieces of each of some distinct pre-tokens."""
    out = []
    for at in range(0, len(words), AT_ONCE):
        some = words.slice(at, AT_ONCE).cast(pa.large_string()).to_pylist()
        out += [len(e) for e in _tokenizer(path).encode_batch(some, add_special_tokens=False)]
    return np.array(out, np.int64)


def strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte strings that lie one after the other, as an Arrow array."""
    at = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))])


def bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes one after the other, lengths) of an Arrow array of byte strings."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    data = words.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """(text, distinct pre-tokens, pre-token, times) of a chunk: how often each text has each of its pre-tokens."""
    starts, ends, first = B.words(data, offsets, PRE_TOKEN)
    coded = strings(data[PRE_TOKEN[data]], ends - starts).dictionary_encode()
    words, code = coded.dictionary, np.asarray(coded.indices, np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    key, times = np.unique(owner * max(1, len(words)) + code, return_counts=True)
    return key // max(1, len(words)), words, key % max(1, len(words)), times


def count_tokens(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    path: str,
    hot: int = HOT,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens.

    A pre-token here is a run without ASCII white space; the tokenizer drops white space and
    never joins pieces across it, so the tokens of a text are those of its pre-tokens. Documents deal their
    pre-tokens with their frequencies out by hash; a bucket holds all of a distinct pre-token, counts its pieces once and joins
    them to the documents' frequencies, and the sums go back to the documents. The `hot` pre-tokens most
    frequent in a sample (each at most HOT_BYTES long, so at most some ten MB) are counted before and broadcast, so
    that none of them gathers anywhere. The sample steers the work only; both ways give the same sums.

    Nulls: a null text is empty, 0 tokens; null ids are kept. Repeated rows of one id and
    text come back as often as they came. Ids of any type. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows, names = long_ids(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")))
    facts = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.sum(F.octet_length("text")).alias("bytes")).first()
    # A tag tells rows of one id (or none) apart; it is 0 where ids don't repeat.
    unique = facts["n"] == facts["ids"]
    ready = rows.select("doc_id", (F.lit(0).cast("long") if unique else F.xxhash64("text")).alias("tag"), "text")
    n_buckets = max(1, -(-(facts["bytes"] or 0) // bucket_bytes))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in B.text_chunks(batch.column(0)):
                _, words, word, _ = pre_tokens(data, offsets)
                short = np.asarray(pc.binary_length(words)) <= HOT_BYTES
                yield pa.RecordBatch.from_arrays([words.cast(pa.string()).filter(pa.array(short)), pa.array(np.bincount(word, minlength=len(words))[short])], names=["word", "n"])

    some = ready.select("text").sample(min(1.0, 0.9 * SAMPLE_DOCS / max(1, facts["n"])), seed=9)
    top = some.mapInArrow(frequent, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(hot)

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces_of(path, batch.column(0).cast(pa.large_binary())))], names=["word", "pieces"])

    counted = top.select("word").repartition(16).mapInArrow(sized, "word string, pieces long").toArrow()
    known = spark.sparkContext.broadcast((counted.column("word").combine_chunks().cast(pa.large_binary()), np.asarray(counted.column("pieces"), np.int64)))

    def dealt_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_words, hot_pieces = known.value
        for batch in batches:
            ids, tags = np.asarray(batch.column(0).fill_null(0), np.int64), np.asarray(batch.column(1), np.int64)
            null = np.asarray(batch.column(0).is_null())
            for lo, hi, data, offsets in B.text_chunks(batch.column(2), BATCH_BYTES):
                text, words, word, times = pre_tokens(data, offsets)
                at = pc.index_in(words, value_set=hot_words)
                place = np.asarray(at.fill_null(-1), np.int64)
                pieces = np.where(place < 0, 0, hot_pieces[place]) if len(hot_pieces) else np.zeros(len(words), np.int64)
                total = np.bincount(text, pieces[word] * times, hi - lo).astype(np.int64)
                targets, blobs = [], []
                of = home(ids[lo:hi], tags[lo:hi], n_buckets)
                for h in np.unique(of):
                    s = np.flatnonzero(of == h) + lo
                    targets.append(n_buckets + int(h))
                    blobs.append(pack(ids[s], tags[s], null[s], total[s - lo], np.diff(offsets)[s - lo], np.ones(len(s), np.int64)))
                cold = np.flatnonzero(place < 0)
                raw, lengths = bytes_of(words)
                begin = np.zeros(len(lengths) + 1, np.int64)
                np.cumsum(lengths, out=begin[1:])
                hashes = B.word_hashes(raw, begin[:-1], begin[1:])
                to = np.full(len(words), -1, np.int64)
                to[cold] = ((hashes[cold] >> np.uint64(32)) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                pairs = np.flatnonzero(to[word] >= 0)
                pairs = pairs[np.lexsort((text[pairs], word[pairs], to[word[pairs]]))]
                bucket = to[word[pairs]]
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
                for p in np.split(pairs, cuts[1:]) if len(pairs) else []:
                    own, each = np.unique(word[p], return_counts=True)
                    docs_, doc = np.unique(text[p], return_inverse=True)
                    targets.append(int(to[own[0]]))
                    blobs.append(pack(raw[flat(begin[own], lengths[own])[0]], lengths[own].astype(np.int32), each.astype(np.int32), doc.astype(np.int32), times[p].astype(np.int32), ids[lo + docs_], tags[lo + docs_], null[lo + docs_]))
                yield pa.RecordBatch.from_arrays([pa.array(targets, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

    def joined(group: pa.Table) -> pa.Table:
        """The pieces of a bucket's distinct pre-tokens, counted once and summed up by document."""
        bucket = group.column("bucket")[0].as_py()
        if bucket >= n_buckets:  # what documents know of themselves
            return pa.table([pa.array([bucket - n_buckets] * group.num_rows, pa.int32()), group.column("blob")], names=["home", "blob"])
        parts = [unpack(b.as_py()) for b in group.column("blob")]
        coded = strings(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])).dictionary_encode()
        pieces = pieces_of(path, coded.dictionary)[np.asarray(coded.indices, np.int64)]
        sums, at = [], 0
        for _, lengths, each, doc, times, ids, tags, null in parts:
            own = np.repeat(pieces[at : at + len(lengths)], each)
            at += len(lengths)
            zero = np.zeros(len(ids), np.int64)
            sums.append((ids, tags, null, np.bincount(doc, own * times, len(ids)).astype(np.int64), zero, zero))
        ids, tags, null, total, size, copies = (np.concatenate(x) for x in zip(*sums, strict=True))
        to = home(ids, tags, n_buckets)
        order = np.argsort(to, kind="stable")
        cuts = np.flatnonzero(np.diff(to[order], prepend=-1))
        blobs = [pack(ids[s], tags[s], null[s], total[s], size[s], copies[s]) for s in np.split(order, cuts[1:])]
        return pa.table([pa.array(to[order][cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["home", "blob"])

    def summed(group: pa.Table) -> pa.Table:
        parts = [np.concatenate(x) for x in zip(*[unpack(b.as_py()) for b in group.column("blob")], strict=True)]
        order = np.lexsort(parts[2::-1])
        ids, tags, null, total, size, copies = (x[order] for x in parts)
        new = np.ones(len(order), bool)
        new[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (null[1:] != null[:-1])
        starts = np.flatnonzero(new)
        total, size, copies = (np.add.reduceat(x, starts) for x in (total, size, copies))
        rows = np.repeat(np.arange(len(starts)), copies)
        out = [pa.array(ids[starts][rows], mask=null[starts][rows]), pa.array((size // copies)[rows]), pa.array((total // copies)[rows])]
        return pa.table(out, names=["doc_id", "n_bytes", "n_tokens"])

    blob, home_blob = "bucket int, blob binary", "home int, blob binary"
    parts = ready.mapInArrow(dealt_out, blob).groupBy("bucket").applyInArrow(joined, home_blob)
    return named_ids(parts.groupBy("home").applyInArrow(summed, "doc_id long, n_bytes long, n_tokens long"), names, "doc_id")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = count_tokens(table(spark, sf_dir, "documents"), path=public_tokenizers.path(TOKENIZER))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
