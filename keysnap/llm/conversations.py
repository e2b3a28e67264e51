"""Conversation structure repair by a run-length dynamic program over min-plus transitions.

Each row of a conversation is one of nine symbols (role initial and fault). Four states say what has
been emitted so far: nothing, a system turn, a user turn, an assistant turn. A symbol moves costs
from state to state by a 4 x 4 min-plus matrix, equal consecutive symbols are one run, and a run is
crossed by the cached binary powers of its matrix. From the costs behind each run the cheapest edits
are then unrolled, the least of ``D I K R`` first wherever several are cheapest.

Rows are dealt out by ranges of (conversation, turn, role, text, row), so a conversation with a third
of all rows lies in many tasks, and so do equal rows. A conversation that lies within one task and is
not long is repaired there. Those that reach a task's edge or are longer than ``SEGMENT`` rows are cut
into segments: one matrix each, a scan over segments (one small row each, constant memory) for the
costs behind and the state before each, and edits for each segment on its own. What remains sequential
is SHA-256, which streams through a long conversation's rows in order, a batch at a time.

Defined results: a null role or text is one space; a null conversation is a conversation, a null turn
comes first. Rows with the same turn are ordered by role, then text (by bytes); repeated rows are
duplicates. A role is known by its first character: one that is none of s, u, a (an empty role too)
can be reroled or deleted, never kept. An empty table gives no rows. Only the four named columns are
used, whatever others there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keysnap.llm.common import stored

# Rows, and characters of text, of a conversation that one task holds at a time.
SEGMENT = 4096
SEGMENT_CHARS = 8_000_000
SPACE = " \t\n\v\f\r"
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

# States: nothing emitted, then the initial of the last emitted turn.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
# After the last row: what completes the pattern from each state.
TAILS = ("", "IuIa", "Ia", "")
AT_END = (0, 2 * INSERT, INSERT, 0)

Vector = tuple[int, int, int, int]


def symbol(role: str, fault: str) -> str:
    """The role's initial (``x``: none of s, u, a), in upper case if truncated; ``-`` must go."""
    if fault in ("blank", "duplicate"):
        return "-"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return kind.upper() if fault == "truncated" else kind


def next_turn(state: int) -> int:
    """The state after a user or assistant turn, whichever may come."""
    return ASSISTANT if state == USER else USER


def kept_state(kind: str, state: int) -> int | None:
    if kind == "s":
        return SYSTEM if state == EMPTY else None
    if kind == "u":
        return None if state == USER else USER
    return ASSISTANT if kind == "a" and state == USER else None


def with_inserts(costs: list[int]) -> list[int]:
    """Costs when turns may be inserted first."""
    user = min(costs[USER], INSERT + costs[ASSISTANT])
    assistant = min(costs[ASSISTANT], INSERT + costs[USER])
    return [min(costs[EMPTY], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant]


@lru_cache(maxsize=4096)
def power(sym: str, k: int) -> tuple[Vector, ...]:
    """The transition of ``2 ** k`` equal symbols: costs from each state to each."""
    if k:
        half = power(sym, k - 1)
        return tuple(
            tuple(min(NEVER, *(half[i][m] + half[m][j] for m in range(4))) for j in range(4)) for i in range(4)
        )
    columns = []
    for to in range(4):
        after = [NEVER] * 4
        after[to] = 0
        columns.append(before_row(sym, tuple(after)))
    return tuple(tuple(min(columns[j][i], NEVER) for j in range(4)) for i in range(4))


def row_costs(sym: str, after: Vector) -> list[int]:
    """The cheapest way on from each state when the row itself comes next."""
    kind, more = sym.lower(), TRUNCATED * sym.isupper()
    out = []
    for state in range(4):
        best = DELETE + after[state]
        if sym != "-":
            best = min(best, REROLE + more + after[next_turn(state)])
            kept = kept_state(kind, state)
            if kept is not None:
                best = min(best, more + after[kept])
        out.append(best)
    return out


def before_row(sym: str, after: Vector) -> Vector:
    return tuple(with_inserts(row_costs(sym, after)))


def before_run(sym: str, length: int, after: Vector) -> Vector:
    """The costs before a run, from those after it, by the binary powers of its transition."""
    k = 0
    while length:
        if length & 1:
            m = power(sym, k)
            after = tuple(min(m[i][j] + after[j] for j in range(4)) for i in range(4))
        length, k = length >> 1, k + 1
    return after


@lru_cache(maxsize=1 << 16)
def unroll_row(sym: str, state: int, after: Vector) -> tuple[str, int]:
    """The edits before and of a row, least first among the cheapest, and the state behind it."""
    kind, more = sym.lower(), TRUNCATED * sym.isupper()
    costs = before_row(sym, after)
    edits = ""
    while True:
        left = costs[state]
        if DELETE + after[state] == left:
            return edits + "D", state
        turn = next_turn(state)
        name = "a" if turn == ASSISTANT else "u"
        if INSERT + costs[turn] == left:
            edits, state = edits + "I" + name, turn
            continue
        kept = kept_state(kind, state) if sym != "-" else None
        if kept is not None and more + after[kept] == left:
            return edits + "K", kept
        return edits + "R" + name, turn


def unroll_run(sym: str, length: int, state: int, after: Vector) -> tuple[list[str], int]:
    """The edits of each row of a run. Halves, so that only logarithmically many costs are held."""
    if length == 1:
        low = min(after)
        edits, state = unroll_row(sym, state, tuple(a - low for a in after))
        return [edits], state
    half = length // 2
    first, state = unroll_run(sym, half, state, before_run(sym, length - half, after))
    second, state = unroll_run(sym, length - half, state, after)
    return first + second, state


def runs_of(symbols: list[str]) -> list[tuple[str, int]]:
    runs: list[tuple[str, int]] = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1] = (s, runs[-1][1] + 1)
        else:
            runs.append((s, 1))
    return runs


def unroll(runs: list[tuple[str, int]], state: int, after: Vector) -> tuple[list[str], int]:
    """The edits of each row from ``state`` on, and the state behind the last."""
    behind = [after]
    for sym, n in reversed(runs[1:]):
        behind.append(before_run(sym, n, behind[-1]))
    edits: list[str] = []
    for (sym, n), costs in zip(runs, reversed(behind)):
        more, state = unroll_run(sym, n, state, costs)
        edits += more
    return edits, state


def repair_symbols(symbols: list[str]) -> list[str]:
    """The edits of each row of a whole conversation; turns inserted at its end follow the last."""
    edits, state = unroll(runs_of(symbols), EMPTY, AT_END)
    if edits:
        edits[-1] += TAILS[state]
    return edits


def own_fault(text: str) -> str:
    """The fault that a text has by itself; ``''`` if none."""
    body = text.rstrip(SPACE)
    return "blank" if not body else "" if body[-1] in ".!?" else "truncated"


class Tally:
    """Sums up one conversation's rows, given in order with their faults and edits."""

    def __init__(self, conv):
        self.conv, self.seen, self.turns, self.cost = conv, dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.low = self.high = self.initial = None
        self.illegal, self.place, self.audit, self.sha = 0, 0, [], sha256()

    def row(self, turn, role: str, text: str, fault: str, edits: str) -> Iterator[tuple]:
        """Yields the repaired messages: (conversation, place, turn, role, text, edit)."""
        if fault:
            self.seen[fault] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.initial = role[:1]
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.high
            self.high = turn
        at = 0
        while at < len(edits):
            edit = edits[at]
            name = ROLES[edits[at + 1]] if edit in "IR" else role
            at += 2 if edit in "IR" else 1
            self.audit.append(edit)
            self.cost += {"D": DELETE, "I": INSERT, "R": REROLE, "K": 0}[edit]
            if edit == "D":
                continue
            if edit != "I" and fault == "truncated":
                self.cost += TRUNCATED
            said = "" if edit == "I" else text
            self.sha.update(f"{'' if self.place == 0 else chr(10)}{name}:{said}".encode("utf-8", "surrogatepass"))
            yield self.conv, self.place, None if edit == "I" else turn, name, said, edit
            self.place += 1

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.seen["blank"], self.seen["duplicate"], self.seen["truncated"], self.illegal,
                self.cost, "".join(self.audit), self.sha.hexdigest())


def whole(conv, rows: list[tuple]) -> tuple[list[tuple], tuple]:
    """The repaired messages and the summary of a conversation, from its (turn, role, text) in order."""
    earlier: set = set()
    faults = []
    for _, role, text in rows:
        fault = own_fault(text)
        if fault != "blank" and (role, text) in earlier:
            fault = "duplicate"
        earlier.add((role, text))
        faults.append(fault)
    edits = repair_symbols([symbol(role, f) for (_, role, _), f in zip(rows, faults)])
    tally, messages = Tally(conv), []
    for (turn, role, text), fault, e in zip(rows, faults, edits):
        messages += tally.row(turn, role, text, fault, e)
    return messages, tally.result()


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[list[tuple]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield list(zip(*[c.to_pylist() for c in part.columns]))


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 512) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _emit(held, schema)
            held = []
    if held:
        yield _emit(held, schema)


class _Schemas:
    """Schemas of the steps, for a given type of the conversation column."""

    def __init__(self, conv: T.DataType):
        key, ddl = [T.StructField("conv_id", conv)], T.StructType.fromDDL
        self.message = T.StructType(key + ddl("place long, turn long, role string, text string, edit string").fields)
        self.summary = T.StructType(key + ddl(f"{RESULT}, repaired_sha256 string").fields)
        raw = ddl("idx long, turn long, role string, text string, fault string, same binary").fields
        self.raw = raw
        self.first = T.StructType(
            key + ddl("long boolean").fields + self.message.fields[1:2] + ddl("edit string").fields
            + self.summary.fields[1:] + raw
        )


def _first_pass(schemas: _Schemas, messages: bool, segment: int, chars: int):
    """Repairs what lies within a task; hands on the rows of what is long or touches an edge."""
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schemas.first)
    n_summary, n_raw = len(schemas.summary) - 1, len(schemas.raw)

    def handed(conv, at: int, row: tuple) -> tuple:
        turn, role, text = row
        same = sha256(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()
        return (conv, True, None, None, *[None] * n_summary, at, turn, role, text, own_fault(text), same)

    def done(conv, rows: list[tuple]) -> Iterator[tuple]:
        found, summary = whole(conv, rows)
        if messages:
            for _, place, turn, role, text, edit in found:
                yield (conv, False, place, edit, *[None] * n_summary, None, turn, role, text, None, None)
        else:
            yield (conv, False, None, None, *summary[1:], *[None] * n_raw)

    def rows(batches):
        none = object()
        conv, held, size, at, over, first = none, [], 0, 0, False, True
        for part in _slices(batches):
            for c, *row in part:
                if conv is none or c != conv:
                    if held:
                        if first or over:
                            yield from (handed(conv, at - len(held) + i, r) for i, r in enumerate(held))
                        else:
                            yield from done(conv, held)
                    first = conv is none
                    conv, held, size, over = c, [], 0, False
                held.append(tuple(row))
                size += len(row[2]) + 64
                at += 1
                if len(held) > segment or size > chars:
                    over = True
                if over:
                    yield from (handed(conv, at - len(held) + i, r) for i, r in enumerate(held))
                    held, size = [], 0
        # The last conversation of a task may go on in the next one.
        yield from (handed(conv, at - len(held) + i, r) for i, r in enumerate(held))

    return lambda batches: _batched(rows(batches), arrow)


def _segment_edits(raw: DataFrame, conv: T.DataType, segment: int) -> DataFrame:
    """(part, idx, fault, edits) of the rows of conversations that lie in several segments."""
    from pyspark.sql.pandas.types import to_arrow_schema

    key = [T.StructField("conv_id", conv)]
    firsts = (
        raw.where("fault <> 'blank'").groupBy("conv_id", "same").agg(F.min(F.struct("part", "idx")).alias("at"))
        .select(F.col("at.part").alias("part"), F.col("at.idx").alias("idx"), F.lit(True).alias("new"))
    )
    narrow = raw.select("conv_id", "part", "idx", F.substring("role", 1, 1).alias("initial"), "fault")
    faults = narrow.join(firsts, ["part", "idx"], "left").withColumn(
        "fault", F.when((F.col("fault") != "blank") & F.col("new").isNull(), "duplicate").otherwise(F.col("fault"))
    )
    block = F.floor(F.col("idx") / segment).cast("long")

    def summed(group):
        group = group.sort_values("idx")
        symbols = [symbol(r, f) for r, f in zip(group["initial"], group["fault"])]
        columns = []
        for to in range(4):
            after = tuple(0 if to == i else NEVER for i in range(4))
            for sym, n in reversed(runs_of(symbols)):
                after = before_run(sym, n, after)
            columns.append(after)
        matrix = [min(columns[j][i], NEVER) for i in range(4) for j in range(4)]
        out = group.iloc[:1][["conv_id", "part", "block"]].copy()
        out["first"], out["symbols"], out["matrix"] = [int(group["idx"].iloc[0])], ["".join(symbols)], [matrix]
        return out

    segment_schema = T.StructType(
        key + T.StructType.fromDDL("part long, block long, first long, symbols string, matrix array<long>").fields
    )
    segments = faults.withColumn("block", block).groupBy("conv_id", "part", "block").applyInPandas(summed, segment_schema)

    behind_schema = T.StructType(
        key + T.StructType.fromDDL("part long, block long, first long, symbols string, after array<long>, last boolean").fields
    )
    behind_arrow = to_arrow_schema(behind_schema)

    def backwards(batches):
        def rows():
            none = object()
            conv, after = none, AT_END
            for some in _slices(batches):
                for c, part, blk, first, symbols, matrix in some:
                    last = conv is none or c != conv
                    if last:
                        conv, after = c, AT_END
                    yield c, part, blk, first, symbols, list(after), last
                    after = tuple(min(matrix[4 * i + j] + after[j] for j in range(4)) for i in range(4))

        return _batched(rows(), behind_arrow)

    down = [F.col("conv_id").asc(), F.col("part").desc(), F.col("block").desc()]
    behind = segments.repartition("conv_id").sortWithinPartitions(*down).mapInArrow(backwards, behind_schema)

    exit_schema = T.StructType(behind_schema.fields + T.StructType.fromDDL("exits array<int>").fields)
    exit_arrow = to_arrow_schema(exit_schema)

    def leaving(batches):
        def rows():
            for some in _slices(batches):
                for *row, symbols, after, last in some:
                    runs = runs_of(list(symbols))
                    yield (*row, symbols, after, last, [unroll(runs, q, tuple(after))[1] for q in range(4)])

        return _batched(rows(), exit_arrow)

    exits = behind.repartition("part", "block").mapInArrow(leaving, exit_schema)
    enter_schema = T.StructType(behind_schema.fields + T.StructType.fromDDL("entry int").fields)
    enter_arrow = to_arrow_schema(enter_schema)

    def forwards(batches):
        def rows():
            none = object()
            conv, state = none, EMPTY
            for some in _slices(batches):
                for *row, exits in some:
                    if conv is none or row[0] != conv:
                        conv, state = row[0], EMPTY
                    yield (*row, state)
                    state = exits[state]

        return _batched(rows(), enter_arrow)

    entered = (
        exits.repartition("conv_id").sortWithinPartitions("conv_id", "part", "block").mapInArrow(forwards, enter_schema)
    )
    edit_schema = T.StructType.fromDDL("part long, idx long, edits string, dropped boolean")
    edit_arrow = to_arrow_schema(edit_schema)

    def edited(batches):
        def rows():
            for some in _slices(batches, 8):
                for _, part, _, first, symbols, after, last, entry in some:
                    edits, state = unroll(runs_of(list(symbols)), entry, tuple(after))
                    if last:
                        edits[-1] += TAILS[state]
                    yield from ((part, first + i, e, s == "-") for i, (e, s) in enumerate(zip(edits, symbols)))

        return _batched(rows(), edit_arrow)

    return entered.repartition("part", "block").mapInArrow(edited, edit_schema)


def _run(conversations: DataFrame, conv: str, turn: str, role: str, text: str, messages: bool, segment: int, chars: int):
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = conversations.sparkSession
    c = lambda name: conversations[f"`{name}`"]
    space = F.lit(" ")
    rows = conversations.select(
        c(conv).alias("conv_id"), c(turn).cast("long").alias("turn"), F.coalesce(c(role).cast("string"), space).alias("role"),
        F.coalesce(c(text).cast("string"), space).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    kind = rows.schema["conv_id"].dataType
    schemas = _Schemas(kind)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "turn", "role", "text", "row"]
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    passed = stored(
        dealt.mapInArrow(_first_pass(schemas, messages, segment, chars), schemas.first)
        .withColumn("part", F.spark_partition_id().cast("long")), "conversations",
    )
    done = passed.where("not long")
    raw = passed.where("long").select("conv_id", "part", *[f.name for f in schemas.raw])
    edits = _segment_edits(raw, kind, segment)
    fault = F.when(F.col("fault") == "blank", "blank").when(F.col("dropped"), "duplicate").otherwise(F.col("fault"))
    long = (
        raw.drop("same").join(edits, ["part", "idx"])
        .select("conv_id", "part", "idx", "turn", "role", "text", fault.alias("fault"), "edits")
        .repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx").drop("part", "idx")
    )
    schema = schemas.message if messages else schemas.summary
    arrow = to_arrow_schema(schema)

    def told(batches):
        def out():
            none = object()
            conv_id, tally = none, None
            for some in _slices(batches):
                for c_, turn_, role_, text_, fault_, edits_ in some:
                    if conv_id is none or c_ != conv_id:
                        if tally is not None and not messages:
                            yield tally.result()
                        conv_id, tally = c_, Tally(c_)
                    for message in tally.row(turn_, role_, text_, fault_, edits_):
                        if messages:
                            yield message
            if tally is not None and not messages:
                yield tally.result()

        return _batched(out(), arrow)

    return done.select(schema.names).unionByName(long.mapInArrow(told, schema))


def repaired_messages(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    segment: int = SEGMENT, chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """The messages of the repaired conversations: conv_id, place (from 0), turn (null where inserted),
    role, text and edit (K kept, R reroled, I inserted)."""
    return _run(conversations, conv, turn, role, text, True, segment, chars)


def repair(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    segment: int = SEGMENT, chars: int = SEGMENT_CHARS,
) -> DataFrame:
    """One row for each conversation: gaps and faults, cost and audit of the cheapest edits, and the
    SHA-256 of the repaired ``role:text`` lines."""
    return _run(conversations, conv, turn, role, text, False, segment, chars)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with planted faults, chosen by a checksum of conversation and turn."""
    space = F.lit(" ")
    said = lambda name: F.coalesce(F.col(name).cast("string"), space)
    code = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    text = F.when(code == 1, F.lit("")).when(code == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    role = F.when(code == 4, F.lit("user")).otherwise(said("role"))
    times = F.when(code == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        conversations.where(code != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("n"))
        .drop("n")
    )


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """Every conversation of the table after damage and repair, those left without rows included."""
    found = repair(damaged(conversations)).withColumnRenamed("conv_id", "repaired_id").withColumn("found", F.lit(True))
    ids = conversations.select("conv_id").distinct()
    out = ids.join(found, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    zeros = {c: F.coalesce(c, F.lit(0).cast("long")) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return out.select(
        "conv_id", *[v.alias(k) for k, v in zeros.items()], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
