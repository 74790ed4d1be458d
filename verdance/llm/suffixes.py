"""Removal of repeated passages by sorted suffixes."""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesops as B
from .common import cut, long_ids, named_ids, on_workers, table

LENGTH = 50
#: Bytes that choose an anchor; of every LENGTH bytes the same anchor is chosen.
ANCHOR = 16
#: Bytes of text a bucket stands for, and a map task gathers before it deals them out.
BUCKET_BYTES = 8 << 20
BATCH_BYTES = 8 << 20
SAMPLE_DOCS = 1_000
SAMPLE_EACH = 64
#: Most key hashes known from the sample to be in several documents; they need not be dealt out.
HOT = 200_000
HASH_BITS = 40

_R = np.random.Generator(np.random.PCG64(50)).integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)


def pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays, first bytes of all items before second bytes: high bytes of small or sorted numbers make runs."""
    raw = pickle.dumps([(a.dtype.str, np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()) for a in arrays])
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    return [np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(d).itemsize, -1).T).view(d).reshape(-1) for d, b in pickle.loads(raw)]


def home(ids: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    """The group of documents a row belongs to."""
    return (B.mix64(ids.astype(np.int64).view(np.uint64) ^ tags.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int32)


def flat(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indexes of all places of the ranges, one range after the other, and where each range begins among them."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=at[1:])
    return np.arange(at[-1]) + np.repeat(starts - at[:-1], lengths), at


def leftmost_min(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its smallest, the leftmost of equals."""
    place, have = np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        less = values[step:] < values[:-step]
        values, place = np.where(less, values[step:], values[:-step]), np.where(less, place[step:], place[:-step])
        have += step
    return place


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one number that sorts as they do; zeros behind the end."""
    d = np.zeros(len(data) + 7, np.uint64)
    d[: len(data)] = data
    d = d[:-1] << np.uint64(8) | d[1:]
    d = d[:-2] << np.uint64(16) | d[2:]
    return d[:-4] << np.uint64(32) | d[4:]


def places_of(length: int, start: int = 0) -> list[int]:
    """Offsets of eight-byte words that cover the bytes from start to length."""
    return [*range(start, length - 8, 8), length - 8]


def anchored(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Runs of starts of `length`-byte strings with one key: (text, first start, last start, key's place, side, key's hash, key's lead).

    The anchor of a string is its leftmost ANCHOR bytes of least hash, so equal strings have equal
    anchors at equal places, whatever stands around them. A string's key is its anchor with half of what
    remains of the string behind it (side 0), or before it (side 1), whichever the string holds:
    strings of one side with equal places of the key can be equal only if their keys are.
    """
    half = (length - ANCHOR) // 2
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none.astype(np.int32), none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    wide = words8(data)
    m = len(data) - ANCHOR + 1
    hashes = (B.mix64(wide[:m] * _R[0] + wide[8 : 8 + m] * _R[1]) >> np.uint64(32)).astype(np.uint32)
    anchor = leftmost_min(hashes, length - ANCHOR + 1)
    n = len(anchor)
    at = np.arange(n, dtype=np.int32)
    side = anchor - at >= half
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    valid = owner[:n] == owner[length - 1 : length - 1 + n]
    joined = valid[1:] & valid[:-1] & (anchor[1:] == anchor[:-1]) & (side[1:] == side[:-1])
    begins, ends = valid.copy(), valid.copy()
    begins[1:] &= ~joined
    ends[:-1] &= ~joined
    first, last = np.flatnonzero(begins), np.flatnonzero(ends)
    which = side[first].astype(np.int64)
    key = anchor[first].astype(np.int64) - which * half
    total = np.zeros(len(first), np.uint64) + which.astype(np.uint64)
    for i, step in enumerate(places_of(ANCHOR + half)):
        total += wide[key + step] * _R[2 + i]
    return owner[first], first, last, key, which, B.mix64(total), wide[key]


def multikey_groups(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of groups of equal keys): sorts by the first key, and only ties by the next ones."""
    n = len(keys[0])
    order = np.argsort(keys[0], kind="stable")
    new = np.ones(n, bool)
    new[1:] = keys[0][order][1:] != keys[0][order][:-1]
    for key in keys[1:]:
        tied = ~new
        tied[:-1] |= ~new[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(new)[at]
        inner = np.lexsort((key[order[at]], group))
        order[at] = order[at][inner]
        k = key[order[at]]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (group[1:] != group[:-1])
        new[at] |= fresh
    return order, np.flatnonzero(new)


def in_several(docs: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The members (in the given order) of groups that hold more than one document id."""
    if not len(order):
        return order
    d = docs[order]
    many = np.minimum.reduceat(d, starts) < np.maximum.reduceat(d, starts)
    return order[np.repeat(many, np.diff(np.append(starts, len(order))))]


def dealt(to: np.ndarray, *arrays: np.ndarray, name: str) -> Iterator[pa.RecordBatch]:
    """One packed row for each target that has entries."""
    if not len(to):
        return
    order = np.argsort(to, kind="stable")
    to = to[order]
    cuts = np.flatnonzero(np.diff(to, prepend=to[0] - 1))
    bounds = np.append(cuts, len(to))
    blobs = [pack(*[a[order[i:j]] for a in arrays]) for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    yield pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int32()), pa.array(blobs, pa.binary())], names=[name, "blob"])


def ids_of(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, tag, known) of the rows of a batch or table."""
    ids = batch.column("doc_id")
    return np.asarray(ids.fill_null(0), np.int64), np.asarray(batch.column("tag"), np.int64), ~np.asarray(ids.is_null())


def members_of(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values are in the sorted table."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def _hash_blobs(batches: Iterator[pa.RecordBatch], length: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Deals the key hashes of the documents out by hash range; those known to be in several documents stay at home."""
    held: list[tuple] = []
    size = 0
    shift = np.uint64(64 - HASH_BITS)

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        ids, tags, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        to = ((hashes >> np.uint64(8)) * np.uint64(buckets) >> np.uint64(HASH_BITS - 8)).astype(np.int32)
        yield from dealt(to, ids, tags, hashes, name="bucket")

    for batch in batches:
        ids, tags, known = ids_of(batch)
        for lo, hi, data, offsets in B.text_chunks(batch.column("text")):
            owner, _, _, _, _, hashes, _ = anchored(data, offsets, length)
            hashes = hashes >> shift
            fresh = ~members_of(hashes, hot)
            key = np.unique(owner[fresh].astype(np.uint64) << np.uint64(HASH_BITS) | hashes[fresh])
            owner = lo + (key >> np.uint64(HASH_BITS)).astype(np.int64)
            ok = known[owner]
            held.append((ids[owner[ok]], tags[owner[ok]], (key & np.uint64((1 << HASH_BITS) - 1))[ok]))
            size += len(data)
            if size > BATCH_BYTES:
                yield from flush()
                held.clear()
                size = 0
    yield from flush()


def _shared_hashes(blobs: pa.Table, homes: int) -> Iterator[pa.RecordBatch]:
    """Of a range of hashes those of more than one document, dealt back to the documents."""
    parts = [unpack(b.as_py()) for b in blobs.column("blob")]
    ids, tags, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
    order, starts = multikey_groups([hashes])
    keep = np.sort(in_several(ids, order, starts))
    yield from dealt(home(ids[keep], tags[keep], homes), ids[keep], tags[keep], hashes[keep], name="home")


def word_at(data: np.ndarray, at: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """The eight bytes from each place as one number that sorts as they do."""
    out = np.empty(len(at), np.uint64)
    for i in range(0, len(at), step):
        out[i : i + step] = data[at[i : i + step, None] + np.arange(8)].view(">u8").ravel()
    return out


def same_neighbours(data: np.ndarray, begin: np.ndarray, size: np.ndarray, order: np.ndarray, which: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Of each order[i] and order[i + 1], i in which, whether their bytes are equal."""
    out = size[order[which]] == size[order[which + 1]]
    pairs = np.flatnonzero(out)
    for k in range(0, len(pairs), step):
        i = pairs[k : k + step]
        a, b = order[which[i]], order[which[i] + 1]
        x, at = flat(begin[a], size[a])
        y, _ = flat(begin[b], size[a])
        out[i] = np.add.reduceat((data[x] != data[y]).astype(np.int32), at[:-1]) == 0
    return out


def content_groups(data: np.ndarray, begin: np.ndarray, size: np.ndarray, off: np.ndarray, side: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of groups) of contexts equal in bytes, key place and side; equal hashes are confirmed by the bytes."""
    total = size.astype(np.uint64) * _R[10] + off.astype(np.uint64) * _R[11] + side.astype(np.uint64) * _R[12]
    for i in places_of(length):
        total = B.mix64(total + word_at(data, begin + i) * _R[13])
    for i in range(8, (length - ANCHOR) // 2 + 16, 8):
        total = B.mix64(total + word_at(data, begin + size - i) * _R[14])
    order, starts = multikey_groups([total])
    joined = np.ones(len(order), bool)
    joined[starts] = False
    which = np.flatnonzero(joined) - 1
    a, b = order[which], order[which + 1]
    if not (same_neighbours(data, begin, size, order, which) & (off[a] == off[b]) & (side[a] == side[b])).all():  # two contents of one hash
        names: dict[tuple, int] = {}
        number = np.array([names.setdefault((data[x : x + n].tobytes(), int(o), int(k)), len(names)) for x, n, o, k in zip(begin, size, off, side, strict=True)], np.int64)
        return multikey_groups([number])
    return order, starts


def least_of(ids: np.ndarray, order: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each item the smallest id of its group."""
    out = np.empty(len(ids), np.int64)
    if len(order):
        out[order] = np.repeat(np.minimum.reduceat(ids[order], starts), np.diff(np.append(starts, len(order))))
    return out


def _contexts(docs: pa.Table, blobs: pa.Table, length: int, splitters: np.ndarray, hot: np.ndarray, buckets: int, homes: int) -> Iterator[pa.RecordBatch]:
    """The suffixes at shared keys with the bytes around them, range-partitioned by their leading bytes.

    Of contexts that are equal within this home only those of the smallest document go on: the others' strings
    all start in it, so what they lose is known here and goes straight to their home, in rows of buckets from `buckets` on.
    """
    if not docs.num_rows:
        return
    docs = docs.combine_chunks()
    ids, tags, known = ids_of(docs)
    parts = [unpack(b.as_py()) for b in blobs.column("blob")] if blobs.num_rows else []
    of, tag_of, hash_of = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    names = np.unique(np.stack([np.append(ids, of), np.append(tags, tag_of)], axis=1), axis=0, return_inverse=True)[1].ravel()
    own, wanted = names[: len(ids)], np.unique(names[len(ids) :].astype(np.uint64) << np.uint64(HASH_BITS) | hash_of)
    out: list[tuple] = []
    texts, base = [np.zeros(0, np.uint8)], 0
    for lo, _, data, offsets in B.text_chunks(unzipped(docs.column("z"))):
        owner, first, last, key, side, hashes, lead = anchored(data, offsets, length)
        short = hashes >> np.uint64(64 - HASH_BITS)
        keep = members_of(own[lo + owner].astype(np.uint64) << np.uint64(HASH_BITS) | short, wanted) | members_of(short, hot)
        keep = np.flatnonzero(keep & known[lo + owner])
        owner, first, last, key, side, lead = (x[keep] for x in (owner, first, last, key, side, lead))
        row = lo + owner
        out.append((ids[row], tags[row], (first - offsets[owner]).astype(np.int32), (last - first + length).astype(np.int32), (key - first).astype(np.int8), side.astype(np.int8), lead, first + base))
        texts.append(data)
        base += len(data)
    if not out:
        return
    ids_, tags_, first, size, off, side, lead, begin = (np.concatenate(x) for x in zip(*out, strict=True))
    if not len(ids_):
        return
    data = np.concatenate(texts)
    least = least_of(ids_, *content_groups(data, begin, size.astype(np.int64), off, side, length))
    gone = np.flatnonzero(ids_ > least)
    if len(gone):
        ranges = merged(ids_[gone], tags_[gone], first[gone].astype(np.int64), first[gone].astype(np.int64) + size[gone])
        yield from dealt(home(ranges[0], ranges[1], homes) + buckets, *ranges, name="bucket")
    s = np.flatnonzero(ids_ == least)
    to = np.searchsorted(splitters, lead[s], side="right").astype(np.int32)
    order = np.lexsort((lead[s], to))
    s, to = s[order], to[order]
    cuts = np.flatnonzero(np.diff(to, prepend=-1))
    rows = [pack(ids_[x], tags_[x], first[x], size[x], off[x], side[x], data[flat(begin[x], size[x].astype(np.int64))[0]]) for x in np.split(s, cuts[1:])]
    yield pa.RecordBatch.from_arrays([pa.array(to[cuts], pa.int32()), pa.array(rows, pa.binary())], names=["bucket", "blob"])


#: Strings compared at once.
AT_ONCE = 1 << 19


def _repeats(blobs: pa.Table, length: int, homes: int) -> Iterator[pa.RecordBatch]:
    """Of a range of suffixes the strings that also start in a smaller document, as byte ranges to remove.

    Suffixes are sorted by multikey sort on the bytes of their keys; within groups of equal ones the strings
    around them are sorted in turn, and neighbours are compared by their bytes: each group of equal
    strings spares its smallest document. Equal suffixes have equal leading bytes, so no group
    crosses the boundary of a range. Contexts that are equal as a whole are compared once.
    """
    parts = [unpack(b.as_py()) for b in blobs.column("blob")]
    ids, tags, first, size, off, side, data = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    first, size, off = first.astype(np.int64), size.astype(np.int64), off.astype(np.int64)
    begin = np.cumsum(size) - size
    least = least_of(ids, *content_groups(data, begin, size, off, side, length))
    gone = np.flatnonzero(ids > least)
    found: list[tuple] = [merged(ids[gone], tags[gone], first[gone], first[gone] + size[gone])]
    some = np.flatnonzero(ids == least)
    key = begin[some] + off[some]
    order, starts = multikey_groups([side[some].astype(np.uint64), *[word_at(data, key + i) for i in places_of(ANCHOR + (length - ANCHOR) // 2)]])
    group = np.zeros(len(some), np.int64)
    if len(some):
        group[order] = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(order))))
    keep = in_several(ids[some], order, starts)
    group, keep = group[keep], some[keep]
    # Slices of whole groups, so that as many strings are held at once as are needed.
    begins = np.flatnonzero(np.diff(group, prepend=-1))
    upto = np.cumsum(size[keep] - length + 1)
    at = 0
    while at < len(keep):
        limit = (upto[at - 1] if at else 0) + AT_ONCE
        later = begins[np.searchsorted(begins, at, side="right") :]
        fits = later[upto[later - 1] <= limit]
        end = int(fits[-1]) if len(fits) else int(later[0]) if len(later) else len(keep)
        if upto[-1] <= limit:
            end = len(keep)
        found.append(_equal_strings(data, keep[at:end], group[at:end], ids, tags, first, begin, size, off, length))
        at = end
    ids_, tags_, lo, hi = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(ids_):
        ids_, tags_, lo, hi = merged(ids_, tags_, lo, hi)
        yield from dealt(home(ids_, tags_, homes), ids_, tags_, lo, hi, name="home")


def _equal_strings(data: np.ndarray, keep: np.ndarray, group: np.ndarray, ids: np.ndarray, tags: np.ndarray, first: np.ndarray, begin: np.ndarray, size: np.ndarray, off: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(id, tag, from, to) of the strings of some contexts that also start in a smaller document among them."""
    places, at = flat(begin[keep], size[keep])
    wide = words8(data[places])
    count = size[keep] - length + 1
    inner, _ = flat(np.zeros(len(keep), np.int64), count)
    of = np.repeat(np.arange(len(keep)), count)
    place = at[of] + inner
    # Strings can be equal only with equal keys at equal places.
    where = group[of] * length + off[keep][of] - inner
    words = [wide[place + i] for i in places_of(length)]
    total = where.astype(np.uint64)
    for i, w in enumerate(words):
        total = B.mix64(total + w * _R[20 + i])
    order, starts = multikey_groups([total])
    joined = np.ones(len(order), bool)
    joined[starts] = False
    b = np.flatnonzero(joined)
    x, y = order[b - 1], order[b]
    alike = where[x] == where[y]
    for w in words:
        alike &= w[x] == w[y]
    if not alike.all():  # two strings of one hash: sort by all bytes
        order, starts = multikey_groups([where.astype(np.uint64), *words])
    docs = ids[keep][of]
    hit = np.flatnonzero(docs > least_of(docs, order, starts))
    lo = first[keep][of[hit]] + inner[hit]
    return merged(docs[hit], tags[keep][of[hit]], lo, lo + length)


def merged(ids: np.ndarray, tags: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
    """Ranges that touch or overlap, united for each document."""
    order = np.lexsort((lo, tags, ids))
    ids, tags, lo, hi = ids[order], tags[order], lo[order], hi[order]
    fresh = np.ones(len(ids), bool)
    fresh[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])
    # The largest end so far within the document.
    top = int(hi.max()) + 1 if len(hi) else 1
    group = np.cumsum(fresh)
    upto = np.maximum.accumulate(hi + group * top) - group * top
    new = fresh.copy()
    new[1:] |= lo[1:] > upto[:-1]
    starts = np.flatnonzero(new)
    return ids[starts], tags[starts], lo[starts], np.maximum.reduceat(hi, starts) if len(starts) else hi


def zipped(texts: pa.Array) -> pa.Array:
    return pa.array([None if x is None else len(x).to_bytes(8, "little") + pa.compress(x, codec="zstd", asbytes=True) for x in texts.cast(pa.binary()).to_pylist()], pa.binary())


def unzipped(blobs: pa.ChunkedArray | pa.Array) -> pa.Array:
    return pa.array([b"" if x is None else pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in blobs.to_pylist()], pa.large_binary()).cast(pa.large_string())


def _removed(docs: pa.Table, blobs: pa.Table, with_text: bool) -> Iterator[pa.RecordBatch]:
    """The documents of one home with what is removed from them."""
    if not docs.num_rows:
        return
    spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if blobs.num_rows:
        parts = [unpack(b.as_py()) for b in blobs.column("blob")]
        for i, t, lo, hi in zip(*(x.tolist() for x in merged(*(np.concatenate(x) for x in zip(*parts, strict=True)))), strict=True):
            spans.setdefault((i, t), []).append((lo, hi))
    rows: list[tuple] = []
    for i, t, z in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "tag", "z")), strict=True):
        text = b"" if z is None else pa.decompress(z[8:], decompressed_size=int.from_bytes(z[:8], "little"), codec="zstd", asbytes=True)
        own = spans.get((i, t), [])
        kept, at = [], 0
        for lo, hi in own:
            kept.append(text[at:lo])
            at = hi
        kept.append(text[at:])
        left = b"".join(kept)
        rows.append((i, len(text), len(text) - len(left), len(own), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in own] if with_text else None))
    columns = list(zip(*rows, strict=True))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _one(batches: Iterator[pa.RecordBatch], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    found = list(batches)
    return pa.Table.from_batches(found) if found else pa.table([pa.array([], k) for k in kinds], names=names)


_BLOB = [pa.int32(), pa.binary()]


def repeated_passages(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    bucket_bytes: int = BUCKET_BYTES,
    with_spans: bool = True,
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end).

    A byte is removed if a string of `length` bytes around it also starts in a document with a
    smaller id. Every string has an anchor chosen by its own bytes, and a key of half its length around that.
    First the keys' hashes are compared, which leaves the suffixes that can repeat; these are partitioned
    into ranges by sampled splitters on their leading bytes, sorted in their bucket, and equal strings are found
    among neighbours. Equal suffixes share their leading bytes, hence their bucket. Tasks
    exchange packed arrays, one row for a bucket and some MB of text. A group of copies is reduced to its smallest
    document in each home before it is dealt out, and a sample's frequent keys are not dealt out at all; the sample
    steers the work only, never the result.

    Nulls: a null text is empty; rows without an id lose nothing and cause nothing. Rows of one id
    never cause removals in each other. Ids that are no whole numbers are taken in their own order. An
    empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    on_workers(spark)
    rows, names = long_ids(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    facts = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count("*").alias("n"), F.count("doc_id").alias("known"), F.countDistinct("doc_id").alias("ids")).first()
    # A tag tells rows of one id apart, and spreads those without one; it is 0 where ids don't repeat.
    digest = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = rows.withColumn("tag", F.when(F.col("doc_id").isNotNull(), F.lit(0).cast("long")).otherwise(digest) if facts["known"] == facts["ids"] else digest)
    n_buckets = max(1, -(-(facts["bytes"] or 0) // bucket_bytes))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, _, data, offsets in B.text_chunks(batch.column("text")):
                owner, _, _, _, _, hashes, lead = anchored(data, offsets, length)
                row = ids_of(batch)[0][lo + owner]
                pair = np.unique(np.stack([row, (hashes >> np.uint64(64 - HASH_BITS)).view(np.int64)], axis=1), axis=0)
                step = max(1, len(lead) // max(1, SAMPLE_EACH * (len(offsets) - 1)))
                leads = lead[::step].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.append(leads, pair[:, 1])), pa.array(np.append(np.full(len(leads), None), pair[:, 0]), pa.int64())], names=["value", "id"])

    some = rows.where("doc_id IS NOT NULL").sample(min(1.0, SAMPLE_DOCS / max(1, facts["n"])), seed=3).limit(2 * SAMPLE_DOCS)
    seen = cut(some.mapInArrow(sample, "value long, id long"))
    leads = np.sort(np.array([r[0] for r in seen.where("id IS NULL").select("value").collect()], np.int64).view(np.uint64))
    splitters = leads[(np.arange(1, n_buckets) * len(leads)) // n_buckets] if len(leads) else np.zeros(0, np.uint64)
    splitters = np.unique(splitters)
    often = seen.where("id IS NOT NULL").groupBy("value").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("a < b").orderBy(F.desc("n"), "value").limit(HOT)
    hot = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in often.select("value").collect()], np.int64).view(np.uint64)))

    def pack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, _ = ids_of(batch)
            yield pa.RecordBatch.from_arrays([pa.array(home(ids, tags, n_buckets)), batch.column("doc_id"), batch.column("tag"), zipped(batch.column("text"))], names=["home", "doc_id", "tag", "z"])

    def hash_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _hash_blobs(batches, length, n_buckets, hot.value)

    blob, home_blob = "bucket int, blob binary", "home int, blob binary"

    def shared(group: pa.Table) -> pa.Table:
        return _one(_shared_hashes(group, n_buckets), ["home", "blob"], _BLOB)

    def contexts(left: pa.Table, right: pa.Table) -> pa.Table:
        return _one(_contexts(left, right, length, splitters, hot.value, n_buckets, n_buckets), ["bucket", "blob"], _BLOB)

    def repeats(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket >= n_buckets:  # already known
            return pa.table([pa.array([bucket - n_buckets] * group.num_rows, pa.int32()), group.column("blob")], names=["home", "blob"])
        return _one(_repeats(group, length, n_buckets), ["home", "blob"], _BLOB)

    def removed(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"]
            kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            return pa.table([pa.array([], k) for k in kinds], names=columns)
        return pa.Table.from_batches(list(_removed(left, right, with_spans)))

    packed = rows.mapInArrow(pack_docs, "home int, doc_id long, tag long, z binary")
    candidates = rows.mapInArrow(hash_blobs, blob).groupBy("bucket").applyInArrow(shared, home_blob)
    suffixes = packed.groupBy("home").cogroup(candidates.groupBy("home")).applyInArrow(contexts, blob)
    found = suffixes.groupBy("bucket").applyInArrow(repeats, home_blob)
    out = packed.groupBy("home").cogroup(found.groupBy("home")).applyInArrow(
        removed, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    )
    return named_ids(out, names, "doc_id")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"), with_spans=False).drop("spans")


def brute_force(docs: list[tuple], length: int = LENGTH) -> dict[int, tuple]:
    """The same by a dictionary of all strings, for tests."""
    least: dict[bytes, int] = {}
    texts = {i: (t or "").encode() for i, t in docs}
    for i in sorted(texts):
        for p in range(len(texts[i]) - length + 1):
            least.setdefault(texts[i][p : p + length], i)
    out = {}
    for i, text in texts.items():
        gone = bytearray(len(text))
        for p in range(len(text) - length + 1):
            if least[text[p : p + length]] < i:
                gone[p : p + length] = b"\x01" * length
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(text), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out
