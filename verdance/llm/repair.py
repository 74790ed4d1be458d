"""Repair of the structure of conversations by a parallel Viterbi search over their rows."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, on_workers, table

#: What came last in a conversation; (s?(ua)+)? says what may follow. After a row of a state only NEXT can be put in.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
#: States in which a row of the role s, u or a may stay as it is.
MAY_KEEP = ({START}, {START, SYSTEM, ASSISTANT}, {USER})
KEPT = (SYSTEM, USER, ASSISTANT)
#: A role of another initial.
OTHER = 3
NAMES = {USER: "user", ASSISTANT: "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Bits of a row's code above its role: it has to go; it is truncated.
MUST_GO, CUT_SHORT = 4, 8

Vector = tuple[int, int, int, int]
#: Where the cost is not known yet, a chunk starts from equal costs.
SPECULATIVE: Vector = (0, 0, 0, 0)

_SPACE = " \t\n\x0b\f\r"
_NO_ROWS = hashlib.sha256(b"").hexdigest()
_SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_LINES = "part int, at long, role string, text string, edit string"


def _with_inserts(costs: list[float]) -> list[float]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[NEXT[s]]) for s, c in enumerate(costs)]
    return costs


#: Least cost to the end of a conversation after its last row.
END: Vector = tuple(_with_inserts([0, math.inf, math.inf, 0]))
_AT_END = ("", "II", "I", "")


@lru_cache(maxsize=1 << 16)
def step(code: int, after: Vector) -> tuple[Vector, int, tuple]:
    """One row backwards: (cost vector before it with its least entry taken out, that entry, the least edits).

    The edits are for each state in which the row may be met (letters, state after the row). Of edits of
    equal cost those with the ASCII-least letters are taken: D, I, K, R. Vectors that differ by a constant are one.
    """
    role, late = code & 3, TRUNCATED if code & CUT_SHORT else 0
    ways: list[list[tuple[float, str, int]]] = []
    for s in range(4):
        own = [(DELETE + after[s], "D", s)]
        if not code & MUST_GO:
            if role != OTHER and s in MAY_KEEP[role]:
                own.append((late + after[KEPT[role]], "K", KEPT[role]))
            own.append((REROLE + late + after[NEXT[s]], "R", NEXT[s]))
        ways.append(own)
    costs = _with_inserts([min(own)[0] for own in ways])
    edits = []
    for s in range(4):
        letters, at = "", s
        while True:
            found = min([(x, to) for c, x, to in ways[at] if c == costs[at]] + ([("I", NEXT[at])] if INSERT + costs[NEXT[at]] == costs[at] else []))
            letters, at = letters + found[0], found[1]
            if found[0] != "I":
                break
        edits.append((letters, at))
    least = min(costs)
    return tuple(c - least for c in costs), least, tuple(edits)


def backward(codes: bytes, end: Vector) -> tuple[Vector, int, list]:
    """(cost vector before the first row, constant taken out, edits of each row)."""
    vector, constant, edits = end, 0, []
    for code in reversed(codes):
        vector, least, ways = step(code, vector)
        constant += least
        edits.append(ways)
    edits.reverse()
    return vector, constant, edits


def fixed_up(codes: bytes, old: Vector, new: Vector, start: Vector, constant: int) -> tuple[Vector, int, int]:
    """(start, constant, rows gone through) of a chunk whose end is `new` after all, given what `old` gave. Rows are gone through only until
    both vectors differ by a constant: from there on everything but the constant stands."""
    x, y = old, new
    for k, code in enumerate(reversed(codes)):
        if x == y:
            return start, constant, k
        x, a, _ = step(code, x)
        y, b, _ = step(code, y)
        constant += b - a
    return y, constant, len(codes)


def _code(initial: int, blank: bool, seen: bool, ended: bool) -> int:
    return initial | (MUST_GO if blank or seen else 0 if ended else CUT_SHORT)


def traced(edits: list, state: int, last: bool) -> tuple[list[str], int]:
    """Letters of each row's edits (with those after the last row at the end, if any), and the state after it."""
    out = []
    for ways in edits:
        letters, state = ways[state]
        out.append(letters)
    if last and _AT_END[state]:
        out.append(_AT_END[state])
        state = ASSISTANT
    return out, state


def _lines(rows: list[tuple], letters: list[str], state: int) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of the repaired rows; rows: (role, text)."""
    for k, own in enumerate(letters):
        for letter in own:
            if letter == "D":
                continue
            if letter == "K":
                role, text = rows[k]
                state = KEPT["sua".index(role[0])]
            else:
                state = NEXT[state]
                role, text = NAMES[state], "" if letter == "I" else rows[k][1]
            yield role, text, letter


def _measures(rows: list[tuple]) -> dict:
    """Counts over rows (turn, initial, blank, ended, seen) in order."""
    turns = [r[0] for r in rows if r[0] is not None]
    initials = [r[1] for r in rows]
    fine = {(0, 1), (1, 2), (2, 1)}
    return {
        "n_turns": len(set(turns)),
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "blank": sum(r[2] for r in rows),
        "duplicate": sum(r[4] and not r[2] for r in rows),
        "truncated": sum(not r[2] and not r[4] and not r[3] for r in rows),
        "illegal": sum(x not in fine for x in zip(initials, initials[1:], strict=False)),
        "first_role": initials[0] if initials else None,
        "last_role": initials[-1] if initials else None,
    }


def placed_rows(rows: DataFrame, conv: Column, turn: Column, role: Column, text: Column, present: Column) -> DataFrame:
    """Rows in sorted ranges of (conversation, turn, role, digest): conv, present, turn, role, text, initial, blank, ended, digest, part, seq.

    A range holds a stretch of rows, so that only a conversation at its edge, or larger than a range, goes on in the next one.
    """
    role, text = F.coalesce(role, F.lit(" ")), F.coalesce(text, F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(_SPACE)), -1, 1)
    base = rows.select(
        conv.alias("conv"),
        F.coalesce(present, F.lit(False)).alias("present"),
        turn.cast("long").alias("turn"),
        role.alias("role"),
        text.alias("text"),
        F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(OTHER).alias("initial"),
        (last == "").alias("blank"),
        last.isin(".", "!", "?").alias("ended"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.monotonically_increasing_id().alias("tie"),
    )
    order = ["conv", "turn", "role", "digest", "tie"]
    return cut(base.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}))


_ROW = ["conv", "present", "turn", "role", "text", "initial", "blank", "ended", "digest"]


def _whole(placed: DataFrame, kind: str, lines: bool) -> DataFrame:
    """Conversations that lie in one range, each gone through where it lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = chain.from_iterable(zip(*[c.to_pylist() for c in b.columns], strict=True) for b in batches)
        names, out = (schema.names, [])
        for conv, found in groupby(rows, key=lambda r: r[0]):
            own, met = [], set()
            for _, present, turn, role, text, initial, blank, ended, digest in found:
                if present:
                    own.append((turn, initial, blank, ended, digest in met, role, text))
                    met.add(digest)
            vector, constant, edits = backward(bytes(_code(r[1], r[2], r[4], r[3]) for r in own), END)
            letters, _ = traced(edits, START, True)
            repaired = list(_lines([r[5:] for r in own], letters, START))
            if lines:
                out += [(conv, 0, k, *x) for k, x in enumerate(repaired)]
            else:
                m = _measures(own)
                gaps = m["last_turn"] - m["first_turn"] + 1 - m["n_turns"] if m["n_turns"] else 0
                sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t, _ in repaired).encode()).hexdigest()
                out.append((conv, gaps, m["blank"], m["duplicate"], m["truncated"], m["illegal"], vector[START] + constant, "".join(letters), sha))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out = []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    wanted = f"conv {kind}, {_LINES if lines else _SUMMARY}"
    schema = to_arrow_schema(_parse_datatype_string(wanted))
    return placed.select(*_ROW).mapInArrow(run, wanted)


def _chunks(flagged: DataFrame, kind: str) -> DataFrame:
    """One row a conversation and range: codes of its rows and counts."""
    counts = "n_turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first_role int, last_role int"

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        own = list(zip(*[rows.column(c).to_pylist() for c in ("turn", "initial", "blank", "ended", "seen")], strict=True))
        codes = bytes(_code(r[1], r[2], r[4], r[3]) for r in own)
        start, constant, _ = backward(codes, SPECULATIVE)
        m = _measures(own)
        data = {"conv": rows.column("conv").slice(0, 1), "part": rows.column("part").slice(0, 1), "codes": [codes], "end": [list(SPECULATIVE)], "start": [list(start)], "constant": [constant]}
        return pa.table(data | {k: pa.array([v], pa.int32() if k.endswith("role") else pa.int64()) for k, v in m.items()})

    columns = ["conv", "part", "seq", "turn", "initial", "blank", "ended", "seen"]
    return flagged.select(*columns).groupBy("conv", "part").applyInArrow(run, f"conv {kind}, part int, codes binary, end array<long>, start array<long>, constant long, {counts}")


def converged(chunks: DataFrame) -> tuple[DataFrame, int]:
    """(chunks with their true end vectors up to a constant, number of passes): each pass hands the start vector of a chunk to the one
    before it and goes through those again where it is more than a constant off, until none is."""
    order, passes = Window.partitionBy("conv").orderBy("part"), 0
    last = F.array(*[F.lit(int(c)).cast("long") for c in END])
    columns = chunks.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                old, new = tuple(r["end"]), tuple(r["want"])
                if old != new:
                    start, r["constant"], _ = fixed_up(r["codes"], old, new, tuple(r["start"]), r["constant"])
                    r["start"], r["end"] = list(start), list(new)
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} for r in rows], pa.schema([batch.schema.field(c) for c in columns]))

    while True:
        # A conversation has one row a range here, without its codes.
        wanted = chunks.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), F.coalesce(F.lead("start").over(order), last).alias("want"))
        todo = chunks.join(wanted, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).drop("_c", "_p")
        if todo.where("want <> end").isEmpty():
            return chunks, passes
        chunks = cut(todo.mapInArrow(run, chunks.schema))
        passes += 1


def _starts(chunks: DataFrame, kind: str) -> DataFrame:
    """conv, part, end, state, last: the state in which each chunk begins. A chunk tells for each state where it leads; following these
    takes one small row a range."""

    def leads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to = []
            for codes, end in zip(batch.column("codes").to_pylist(), batch.column("end").to_pylist(), strict=True):
                edits = backward(codes, tuple(end))[2]
                to.append([traced(edits, s, False)[1] for s in range(4)])
            yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("part"), batch.column("end"), pa.array(to, pa.list_(pa.int32()))], names=["conv", "part", "end", "to"])

    def follow(rows: pa.Table) -> pa.Table:
        rows, state, states = rows.sort_by("part"), START, []
        for to in rows.column("to").to_pylist():
            states.append(state)
            state = to[state]
        last = [False] * (len(states) - 1) + [True]
        return rows.drop_columns(["to"]).append_column("state", pa.array(states, pa.int32())).append_column("last", pa.array(last))

    return chunks.select("conv", "part", "end", "codes").mapInArrow(leads, f"conv {kind}, part int, end array<long>, to array<int>").groupBy("conv").applyInArrow(follow, f"conv {kind}, part int, end array<long>, state int, last boolean")


def _traces(flagged: DataFrame, starts: DataFrame, kind: str, lines: bool) -> DataFrame:
    """Each chunk's repaired rows: as rows, or as its letters and its lines in one piece."""
    starts = F.broadcast(starts.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), "end", "state", "last"))  # one row a chunk: at most two a range
    rows = flagged.join(starts, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p"))).drop("_c", "_p")

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("seq")
        one = {c: rows.column(c)[0].as_py() for c in ("part", "end", "state", "last")}
        codes = bytes(_code(*r) for r in zip(*[rows.column(c).to_pylist() for c in ("initial", "blank", "seen", "ended")], strict=True))
        letters, _ = traced(backward(codes, tuple(one["end"]))[2], one["state"], one["last"])
        found = list(_lines(list(zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True)), letters, one["state"]))
        conv = rows.column("conv").slice(0, 1)
        if lines:
            conv = pa.chunked_array([conv.combine_chunks().take(pa.array([0] * len(found), pa.int32()))])
            columns = [[x[k] for x in found] for k in range(3)]
            return pa.table([conv, pa.array([one["part"]] * len(found), pa.int32()), pa.array(range(len(found)), pa.int64()), *[pa.array(c, pa.string()) for c in columns]], names=["conv", "part", "at", "role", "text", "edit"])
        piece = "\n".join(f"{r}:{t}" for r, t, _ in found).encode() if found else None
        return pa.table([conv, pa.array([one["part"]], pa.int32()), ["".join(letters)], pa.array([piece], pa.binary())], names=["conv", "part", "letters", "piece"])

    return rows.groupBy("conv", "part").applyInArrow(run, f"conv {kind}, {_LINES if lines else 'part int, letters string, piece binary'}")


def _digests(pieces: DataFrame, kind: str) -> DataFrame:
    """conv, audit, repaired_sha256: a conversation's pieces run through its digest one by one, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, sha, audit, any_, names = None, None, [], False, ["conv", "audit", "repaired_sha256"]

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([conv, pa.array(["".join(audit)]), pa.array([sha.hexdigest()])], names=names)

        for batch in batches:
            for i, (letters, piece) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if sha is None or batch.column(0)[i].as_py() != conv[0].as_py():
                    if sha is not None:
                        yield out()
                    conv, sha, audit, any_ = batch.column(0).slice(i, 1), hashlib.sha256(), [], False
                audit.append(letters)
                if piece is not None:
                    sha.update(b"\n" + piece if any_ else piece)
                    any_ = True
        if sha is not None:
            yield out()

    return pieces.repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(run, f"conv {kind}, audit string, repaired_sha256 string")


def _flagged(rows: DataFrame) -> DataFrame:
    """Rows with `seen`: the same role and text came earlier in the conversation. Copies are one row a range before they meet."""
    own = rows.where("present").groupBy(F.col("conv").alias("_c"), F.col("digest").alias("_d"), F.col("part").alias("_p")).agg(F.min("seq").alias("_seq"))
    first = own.groupBy(F.col("_c").alias("_fc"), F.col("_d").alias("_fd")).agg(F.min("_seq").alias("_first"))
    marked = own.join(first, F.col("_c").eqNullSafe(F.col("_fc")) & (F.col("_d") == F.col("_fd"))).select("_c", "_d", "_p", "_first")
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")) & (F.col("part") == F.col("_p"))
    return rows.where("present").join(marked, same).withColumn("seen", F.col("seq") > F.col("_first")).drop("_c", "_d", "_p", "_first")


def _searched(
    rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None, lines: bool
) -> DataFrame:
    on_workers(rows.sparkSession)
    quoted = [F.col(f"`{c}`") for c in (conv_col, turn_col, role_col, text_col)]
    placed = placed_rows(rows, *quoted, F.lit(True) if present is None else present)
    kind = placed.schema["conv"].dataType.simpleString()
    # A conversation goes on in the next range only at the edge between them, so there are fewer of these than ranges.
    split = cut(placed.select("conv", "part").distinct().groupBy("conv").count().where("count > 1").select(F.col("conv").alias("_c")))
    same = F.col("conv").eqNullSafe(F.col("_c"))
    whole = _whole(placed.join(F.broadcast(split), same, "left_anti"), kind, lines)
    if split.isEmpty():
        return whole
    flagged = cut(_flagged(placed.join(F.broadcast(split), same, "left_semi")))
    chunks, _ = converged(cut(_chunks(flagged, kind)))
    traces = _traces(flagged, _starts(chunks, kind), kind, lines)
    if lines:
        return whole.unionByName(traces)
    order = Window.partitionBy("conv").orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    role, turn = F.last("last_role", ignorenulls=True).over(earlier), F.last("last_turn", ignorenulls=True).over(earlier)
    fine = (F.concat_ws(",", role, "first_role")).isin("0,1", "1,2", "2,1")
    # One row a range from here on.
    edges = chunks.drop("codes").withColumns({
        "broken": (role.isNotNull() & F.col("first_role").isNotNull() & ~fine).cast("long"),
        "again": (turn.isNotNull() & (turn == F.col("first_turn"))).cast("long"),
        "begin": F.when(F.row_number().over(order) == 1, F.element_at("start", START + 1)),
    })
    span = F.max("last_turn") - F.min("first_turn") + 1 - F.sum("n_turns") + F.sum(F.coalesce("again", F.lit(0)))
    sums = edges.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")],
        (F.sum("illegal") + F.sum("broken")).alias("illegal"),
        (F.sum("constant") + F.max("begin")).alias("cost"),
    )
    digests = _digests(traces, kind)
    none = {"audit": F.lit(""), "repaired_sha256": F.lit(_NO_ROWS)}
    zero = {c: F.lit(0).cast("long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    both = sums.join(digests.withColumnRenamed("conv", "_d"), F.col("conv").eqNullSafe(F.col("_d"))).drop("_d")
    named = split.join(both, F.col("_c").eqNullSafe(F.col("conv")), "left")
    long = named.select(F.col("_c").alias("conv"), *[F.coalesce(F.col(c), v).alias(c) for c, v in (zero | none).items()])
    return whole.unionByName(long)


def repair_conversations(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None
) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The cheapest edits that give the role initials (s?(ua)+)? are searched: keep 0, re-role 1, delete 2 (a must for blank
    and repeated rows), insert an empty row 5, and 5 for a truncated row that stays; of equally cheap ones
    those with the ASCII-least letters. Rows are sorted in ranges. A conversation inside one range is gone through there; what a longer one has
    in each range is a chunk. Chunks go backwards from speculative cost vectors all at once, and fix-up
    passes go through them again, from the true vector of the next chunk, until vectors differ by constants only, which mostly is a few rows. The
    constants add up to the cost; the stitched vectors lead the letters from chunk to chunk. The digest of a long conversation takes its lines
    in order by definition: they stream through one task, chunk by chunk, and are never held together.

    Nulls: role and text count as one space, a null conversation is one of its own, null turns come first. Ties: rows of one turn are
    ordered by role, then by a digest of role and text. Repeated rows are rows as any others. Rows where `present` is not true are absent, but their
    conversations are returned: with zeros, an empty audit and the digest of nothing, if none is present. Gaps are turns
    missing between the least and the largest. Initials are the first characters of roles. An empty table gives an empty result; other columns are not read.
    """
    return _searched(rows, conv_col, turn_col, role_col, text_col, present, False).withColumnRenamed("conv", conv_col)


def repaired_rows(
    rows: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None
) -> DataFrame:
    """The repaired conversations themselves: conv_id, position (from 0), role, text, edit (K, R or I). Settings as in repair_conversations."""
    found = cut(_searched(rows, conv_col, turn_col, role_col, text_col, present, True))
    sizes = found.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("conv").alias("_c"), F.col("part").alias("_p"), before.alias("before"))
    out = found.join(offsets, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("part") == F.col("_p")))
    return out.select(F.col("conv").alias(conv_col), (F.col("before") + F.col("at")).alias("position"), "role", "text", "edit")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations, damaged by crc32(conv_id:turn) % 20, with `present` (false for dropped ones)."""
    none = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), none), F.lit(":"), F.coalesce(F.col("turn").cast("string"), none)).cast("binary")) % 20
    text = F.coalesce("text", none)
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.coalesce("role", none))
    out = rows.select("conv_id", "turn", "role", "text", kind.alias("_kind"))
    out = out.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_kind") != 0).alias("present"), F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"))
    return out.drop("_copy")


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(damaged(table(spark, sf_dir, "conversations")), present=F.col("present"))


def brute_force(rows: list[tuple]) -> tuple:
    """The result's columns for one conversation's rows (turn, role, text) in order, by search over (cost, letters), for tests."""
    after = {"": "su", "s": "u", "u": "a", "a": "u"}
    white = set(_SPACE)
    counts, met, kinds = [0, 0, 0], set(), []
    for _, role, text in rows:
        solid = [c for c in text if c not in white]
        fault = 0 if not solid else 1 if (role, text) in met else 2 if solid[-1] not in ".!?" else None
        met.add((role, text))
        kinds.append(fault)
        if fault is not None:
            counts[fault] += 1
    best = {"": (0, "", ())}

    def inserted(found: dict) -> dict:
        for _ in range(3):
            for s, (c, x, out) in list(found.items()):
                for t in after[s]:
                    if t != "s":
                        new = (c + 5, x + "I", (*out, f"{'user' if t == 'u' else 'assistant'}:"))
                        found[t] = min(found.get(t, new), new)
        return found

    for (_, role, text), fault in zip(rows, kinds, strict=True):
        new: dict = {}
        for s, (c, x, out) in inserted(best).items():
            ways = [(s, c + 2, "D", out)]
            if fault not in (0, 1):
                late = 5 if fault == 2 else 0
                if role[:1] and role[0] in after[s]:
                    ways.append((role[0], c + late, "K", (*out, f"{role}:{text}")))
                ways += [(t, c + 1 + late, "R", (*out, f"{'user' if t == 'u' else 'assistant'}:{text}")) for t in after[s] if t != "s"]
            for t, cost, letter, lines in ways:
                found = (cost, x + letter, lines)
                new[t] = min(new.get(t, found), found)
        best = new
    cost, audit, lines = min(v for s, v in inserted(best).items() if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()
