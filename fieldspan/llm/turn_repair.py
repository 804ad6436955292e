"""Conversation structure repair: cheapest edits to legal turns by a parallel Viterbi whose chunks are fixed up until their costs differ only by constants."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspan.llm.common import Stages, map_arrow, utf8

#: Rows of a chunk, which starts from speculative costs.
CHUNK_ROWS = 2_048
#: Fix-up passes before the chunks still open answer for every vector at once.
FIX_UPS = 6
#: White space, and what ends a turn that is not cut off.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"

# Costs of the edits; a truncated row that stays adds one more.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Where a conversation stands: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state that an inserted or renamed turn leads to.
TURN = (USER, USER, ASSISTANT, USER)
#: The states that a kept turn leads to, by its initial.
KEEP = ({START: SYSTEM}, {START: USER, SYSTEM: USER, ASSISTANT: USER}, {USER: ASSISTANT}, {})
NAMES = {USER: "user", ASSISTANT: "assistant"}

Vector = tuple[int, int, int, int]


def _closed(costs: list[int]) -> Vector:
    """Costs to go when turns may be inserted first."""
    user, assistant = min(costs[USER], INSERT + costs[ASSISTANT]), min(costs[ASSISTANT], INSERT + costs[USER])
    return (min(costs[START], INSERT + user), min(costs[SYSTEM], INSERT + user), user, assistant)


#: Costs to go at the end: a turn of the user needs an answer, a system turn both.
END: Vector = (0, 2 * INSERT, INSERT, 0)


def symbol_of(initial: str, truncated: bool) -> int:
    """A row that need not be deleted, as far as costs go: its role's initial (others alike) and whether it is cut off."""
    place = "sua".find(initial) if initial else -1
    return (place if place >= 0 else 3) + 4 * truncated


def _options(after: Vector, symbol: int, state: int) -> dict[str, tuple[int, int]]:
    """(cost to go, next state) of every edit of a row, by its initial."""
    extra = TRUNCATED if symbol >= 4 else 0
    options = {"D": (DELETE + after[state], state), "R": (RENAME + extra + after[TURN[state]], TURN[state])}
    if state in KEEP[symbol % 4]:
        options["K"] = (extra + after[KEEP[symbol % 4][state]], KEEP[symbol % 4][state])
    return options


@cache
def _before(after: Vector, symbol: int) -> tuple[Vector, int]:
    """Costs to go before a row, less the least of them, and that least."""
    costs = _closed([min(c for c, _ in _options(after, symbol, state).values()) for state in range(4)])
    least = min(costs)
    return tuple(c - least for c in costs), least


def _vectors() -> list[Vector]:
    """All vectors, up to constants, that any rows make of the end's: insertions keep states within a few units, so they are few."""
    found, todo = [END], [END]
    while todo:
        vector = todo.pop()
        for symbol in range(8):
            before, _ = _before(vector, symbol)
            if before not in found:
                found.append(before)
                todo.append(before)
    return found


VECTORS = _vectors()
_NUMBER = {v: n for n, v in enumerate(VECTORS)}
#: The vector's number before a row, by the number after it and the row's symbol.
MOVES = [[_NUMBER[_before(v, symbol)[0]] for symbol in range(8)] for v in VECTORS]


@cache
def trace(number: int, symbol: int, state: int) -> tuple[str, int]:
    """(edits, next state): the least audit of a row and of what is inserted before it, when the vector after it has this number."""
    after = VECTORS[number]
    row = [_options(after, symbol, s) for s in range(4)]
    closed = _closed([min(c for c, _ in options.values()) for options in row])
    edits = ""
    while True:
        best = {edit for edit, (cost, _) in row[state].items() if cost == closed[state]}
        if INSERT + closed[TURN[state]] == closed[state]:
            best.add("I")
        edits += min(best)
        if edits[-1] != "I":
            return edits, row[state][edits[-1]][1]
        state = TURN[state]


def trace_end(state: int) -> str:
    """What is inserted at the end."""
    return "I" * (END[state] // INSERT)


def backward(symbols: list[int], into: int, before: list[int] | None = None) -> list[int]:
    """The vector's number after every row of a chunk, and first that before its first row; ``into`` is the one after its last.

    With the numbers of an earlier pass it stops where they agree: from there on the
    costs differ from the earlier ones by a constant only.
    """
    numbers = list(before) if before else [0] * (len(symbols) + 1)
    numbers[-1] = into
    for i in range(len(symbols) - 1, -1, -1):
        number = MOVES[numbers[i + 1]][symbols[i]]
        if before and numbers[i] == number:
            break
        numbers[i] = number
    return numbers


# --- rows -------------------------------------------------------------------

def damaged(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """Conversations with faults, for tests of the repair: by crc32 of ``conv_id:turn`` modulo 20 a row is
    dropped (0), emptied (1), loses its ends of sentences (2), is repeated (3) or becomes the user's (4). Nulls read as one blank.
    """
    blank = F.lit(" ")
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    kind = F.crc32(F.concat(F.coalesce(F.col(key).cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ENDS, "")).otherwise(text)
    times = F.when(kind == 3, 2).otherwise(1)
    faulty = rows.where(kind != 0).select(F.col(key), "turn", F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return faulty.drop("copy")


_ROW = ["conv", "turn", "role", "text"]


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal rows of a batch as one, so that a repeated row does not travel again and again."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(_ROW, use_threads=False).aggregate([([], "count_all")])
        yield from table.rename_columns([*_ROW, "times"]).to_batches()


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal neighbours of a sorted partition as one row, numbered through."""
    part, at, last = TaskContext.get().partitionId(), -1, None
    held: list[tuple] = []

    def written() -> pa.RecordBatch:
        columns = list(zip(*held)) if held else [[]] * 7
        types = (batch.schema.field("conv").type, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [*_ROW, "times", "part", "at"])

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv", "turn", "role")]
        for conv, turn, role, text, times in zip(*columns, utf8(batch.column("text")), batch.column("times").to_pylist()):
            row = (conv, turn, role, text.decode())
            if row == last:
                held[-1] = (*row, held[-1][4] + times, part, at)
                continue
            if len(held) >= 1_000:
                yield written()
                held = []
            at, last = at + 1, row
            held.append((*row, times, part, at))
    if held:
        yield written()


def _chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Neighbouring rows of a conversation as chunks, solved from the end's costs."""
    now, ats, symbols = None, [], []

    def written() -> pa.RecordBatch:
        numbers = backward(symbols, 0)
        columns = [pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([now[2]], pa.int64()), pa.array([list(ats)], pa.list_(pa.int64()))]
        columns += [pa.array([x], pa.list_(pa.int32())) for x in (list(symbols), numbers)]
        return pa.RecordBatch.from_arrays(columns, ["conv", "part", "slot", "ats", "symbols", "numbers"])

    for batch in batches:
        for conv, part, at, symbol in zip(*(batch.column(c).to_pylist() for c in ("conv", "part", "at", "symbol"))):
            place = (conv, part, at // rows)
            if place != now:
                if ats:
                    yield written()
                now, ats, symbols = place, [], []
            ats.append(at)
            symbols.append(symbol)
    if ats:
        yield written()


def _fixed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks whose next one starts from other costs than assumed, solved anew as far as that matters."""
    for batch in batches:
        numbers = [backward(s, into, n) if n[-1] != into else n for s, n, into in zip(*(batch.column(c).to_pylist() for c in ("symbols", "numbers", "into")))]
        columns = [batch.column(c) for c in _CHUNK[:-1]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(numbers, pa.list_(pa.int32()))], _CHUNK)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every vector after a chunk the one before it."""
    for batch in batches:
        answers = []
        for symbols in batch.column("symbols").to_pylist():
            own = list(range(len(VECTORS)))
            for symbol in reversed(symbols):
                own = [MOVES[n][symbol] for n in own]
            answers.append(own)
        columns = [batch.column(c) for c in ("conv", "place")]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(answers, pa.list_(pa.int32()))], ["conv", "place", "answers"])


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector after each chunk, from the answers of a conversation's chunks, last first."""
    now, into = None, 0
    for batch in batches:
        found = []
        for conv, answers in zip(batch.column("conv").to_pylist(), batch.column("answers").to_pylist()):
            if conv != now:
                now, into = conv, 0
            found.append(into)
            into = answers[into]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("place"), pa.array(found, pa.int32())], ["conv", "place", "into"])


_CHUNK = ["conv", "place", "part", "ats", "symbols", "numbers"]
_CHUNK_TYPES = "conv string, place int, part long, ats array<long>, symbols array<int>, numbers array<int>"


def _solved(chunks: DataFrame, stages: Stages, fix_ups: int) -> DataFrame:
    """All chunks with the numbers that follow from the true costs after them.

    A chunk is right once the chunk after it starts with the vector that it assumed. What is not
    is solved again with the other's present vector, from its end up to where nothing changes but
    a constant; real conversations forget their future within a few turns, so a pass or two will do.
    Rows that never forget it (one role for ever) would need a pass for each chunk: after ``fix_ups`` passes the open
    conversations' chunks give their answer to every vector, of which there are a handful, one
    scan per conversation follows those answers, and a last pass solves with what it found.
    """
    in_order = Window.partitionBy("conv").orderBy("place")
    own = Window.partitionBy("conv").orderBy("part", "slot")
    placed = chunks.select("*", F.row_number().over(own).alias("place"), F.lead("slot").over(own).isNull().alias("last"))
    placed = stages.keep(placed, "chunks")
    alone = (F.col("place") == 1) & F.col("last")
    done, open_ = placed.where(alone).select(*_CHUNK), stages.keep(placed.where(~alone).select(*_CHUNK), "open")
    for k in range(fix_ups + 1):
        wanted = open_.withColumn("into", F.coalesce(F.lead(F.col("numbers")[0]).over(in_order), F.lit(0)))
        if wanted.where(F.element_at("numbers", -1) != F.col("into")).isEmpty():
            break
        if k == fix_ups:
            answers = map_arrow(open_.select("conv", "place", "symbols"), _answers, "conv string, place int, answers array<int>")
            last_first = answers.repartition("conv").sortWithinPartitions("conv", F.col("place").desc())
            wanted = open_.join(map_arrow(last_first, _followed, "conv string, place int, into int"), ["conv", "place"])
        open_ = stages.keep(map_arrow(wanted, _fixed_up, _CHUNK_TYPES), "open")
    return done.union(open_.select(*_CHUNK))


class _Repair:
    """One conversation, row by row."""

    def __init__(self, conv: str):
        self.conv, self.state, self.edits, self.cost = conv, START, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.least = self.turn = self.initial = None
        self.hash, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: bytes) -> None:
        self.hash.update((b"\n" if self.lines else b"") + role.encode() + b":" + text)
        self.lines += 1

    def insert(self) -> None:
        self.state = TURN[self.state]
        self.cost += INSERT
        self.line(NAMES[self.state], b"")

    def delete(self, times: int) -> None:
        self.edits.append("D" * times)
        self.cost += DELETE * times

    def row(self, turn: int | None, role: str, text: bytes, times: int, blank: bool, truncated: bool, number: int | None) -> None:
        if turn is not None and (self.least is None or turn != self.turn):
            self.turns, self.turn = self.turns + 1, turn
            self.least = turn if self.least is None else self.least
        initial = role[:1]
        self.illegal += (self.initial is not None and self.initial + initial not in ("su", "ua", "au")) + times - 1
        self.initial = initial
        if number is None:
            self.blank += times * blank
            self.duplicate += times * (not blank)
            self.delete(times)
            return
        self.truncated += truncated
        self.duplicate += times - 1
        edits, _ = trace(number, symbol_of(initial, truncated), self.state)
        self.edits.append(edits)
        for _ in edits[:-1]:
            self.insert()
        if edits[-1] == "D":
            self.cost += DELETE
        else:
            self.state = KEEP["sua".find(initial)][self.state] if edits[-1] == "K" else TURN[self.state]
            self.cost += TRUNCATED * truncated + RENAME * (edits[-1] == "R")
            self.line(role if edits[-1] == "K" else NAMES[self.state], text)
        self.delete(times - 1)

    def end(self) -> tuple:
        rest = trace_end(self.state)
        self.edits.append(rest)
        for _ in rest:
            self.insert()
        gaps = 0 if self.least is None else self.turn - self.least + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.edits), self.hash.hexdigest())


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = {"conv": "string", **dict.fromkeys(_COUNTS, "long"), "audit": "string", "repaired_sha256": "string"}


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follow the backward costs through the sorted rows; only the audit of one conversation is held."""
    types = [pa.int64() if t == "long" else pa.string() for t in _RESULT.values()]

    def written(repair: _Repair) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(repair.end(), types)], list(_RESULT))

    now, number = None, None
    for batch in batches:
        names = ("conv", "number", "turn", "role", "times", "blank", "truncated")
        for (conv, given, *row), text in zip(zip(*(batch.column(c).to_pylist() for c in names)), utf8(batch.column("text"))):
            if now is None or conv != now.conv:
                if now is not None:
                    yield written(now)
                now = _Repair(conv)
            if given is not None:  # the vector after the row that follows
                number = given
                continue
            turn, role, times, blank, truncated = row
            now.row(turn, role, text, times, blank, truncated, number)
            number = None
    if now is not None:
        yield written(now)


def _trimmed(text: str) -> Column:
    return F.rtrim(F.col(text), F.lit(BLANKS))


def repair(rows: DataFrame, *, key: str = "conv_id", chunk_rows: int = CHUNK_ROWS, fix_ups: int = FIX_UPS) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for every conversation of ``rows`` (key, turn, role, text).

    Rows stand by turn (nulls first), then role and text. The first fault of a row counts: blank
    (white space only), duplicate (role and text seen earlier in the conversation), truncated (does not end
    with ``.``, ``!`` or ``?``). Edits: keep, rename to user or assistant (3), delete (4, forced for blank and
    duplicate rows), insert an empty turn of user or assistant (3); a truncated row that stays costs 3 more. The
    cheapest edits that leave the initials ``(s?(ua)+)?`` are found, of equal ones those with the least audit.

    Equal rows are counted as one before they move and again after a range shuffle, which
    splits a long conversation over tasks. Duplicates are found by their first place. Rows that need not go
    are cut into chunks; costs to go are solved backwards in all chunks at once, from the end's costs as
    a guess, and fixed up (``_solved``). Then each conversation's rows stream through one
    task, in order, where the numbers of the vectors after the rows drive the choice of edits and a running hash
    takes the text; SHA-256 has no parts, so this last pass is one stream for a conversation however long, of
    which nothing is held but its audit.

    Null turns come first and count in no gap; null roles and texts are read as one blank; a null key is a conversation. Any
    other columns are ignored. Roles are told by their first character. Runs jobs when called.
    """
    spark = rows.sparkSession
    stages = Stages(spark)
    conv = F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("conv")
    given = rows.select(conv, F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    types = "conv string, turn long, role string, text string, times long"
    # Starts of role and text settle which rows stand where, but need not be carried whole to find the bounds.
    bounds = ["conv", "turn", F.substring("role", 1, 32), F.substring("text", 1, 32)]
    dealt = map_arrow(given, _alike, types).repartitionByRange(*bounds).sortWithinPartitions(*_ROW)
    placed = map_arrow(dealt, _numbered, f"{types}, part long, at long")
    end = F.right(_trimmed("text"), F.lit(1))
    placed = placed.withColumns({"blank": _trimmed("text") == "", "truncated": ~end.isin(*ENDS), "digest": F.unhex(F.md5(F.col("text").cast("binary")))})
    placed = stages.keep(placed, "rows")

    same = ["conv", "role", "digest"]
    initial = F.left("role", F.lit(1))
    symbol = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(F.col("truncated"), 4).otherwise(0)
    narrow = placed.where(~F.col("blank")).select(*same, "part", "at", symbol.alias("symbol"))
    first = narrow.groupBy(*same).agg(F.min(F.struct("part", "at")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    left = narrow.join(first.select(*same, "first"), same, "left").where("first is null or first = struct(part, at)")
    slots = left.select("conv", "part", "at", "symbol", F.expr(f"at div {chunk_rows}").alias("slot"))
    sorted_slots = slots.repartition("conv", "part", "slot").sortWithinPartitions("conv", "part", "at")
    chunk_types = "conv string, part long, slot long, ats array<long>, symbols array<int>, numbers array<int>"
    chunks = _solved(map_arrow(sorted_slots, partial(_chunks, rows=chunk_rows), chunk_types), stages, fix_ups)

    after = F.slice("numbers", 2, F.greatest(F.size("ats"), F.lit(1)))
    solved = chunks.select("conv", "part", F.inline(F.arrays_zip("ats", after.alias("after"))).alias("at", "number"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("times", "long"), ("blank", "boolean"), ("truncated", "boolean"))]
    texts = placed.select("conv", "part", "at", F.lit(None).cast("int").alias("number"), "turn", "role", "text", "times", "blank", "truncated")
    # A row's number is sorted to stand right before it.
    both = solved.select("conv", "part", "at", "number", *nothing).union(texts)
    ordered = both.repartition("conv").sortWithinPartitions("conv", "part", "at", F.col("number").asc_nulls_last())
    found = map_arrow(ordered, _repaired, ", ".join(f"{name} {kind}" for name, kind in _RESULT.items()))
    kind = rows.schema[key].dataType
    return found.select(F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias(key), *list(_RESULT)[1:])


def repair_damaged(rows: DataFrame, *, key: str = "conv_id", **options) -> DataFrame:
    """``repair`` after ``damaged``, with a row for every conversation of ``rows``: one without rows left has zeros, no audit and the hash of nothing."""
    found = repair(damaged(rows, key), key=key, **options).withColumnRenamed(key, "found")
    every = rows.select(key).distinct()
    joined = every.join(found, every[key].eqNullSafe(F.col("found")), "left")
    empty = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit("").cast("binary"), 256)}
    return joined.select(key, *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in found.columns[1:]])
