"""Repair of conversations whose rows were lost, emptied, cut or given a wrong role.

The cheapest edits that make the roles of a conversation read ``(s?(ua)+)?`` are
searched by iterative-deepening A*. A state is a row, a state of that grammar and
the insertions made before the row. Under one bound on the cost the search goes
depth first and tries edits in the order of their letters, D, I, K, R; states
that failed keep the least cost they are now known to need, in this round and in
those that follow. A bound that fails is raised to the least cost beyond it. So
the first accepting path is the cheapest, and among those the first by letters.

A search needs one symbol a row. Stretches of STRETCH rows are searched from and
to each state of the grammar; the paths of a conversation are chained from
theirs. Every row takes exactly one of D, K and R, and insertions belong to the
row they precede, so no path over a stretch is the beginning of another and the
least chain consists of least parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 32  # rows searched at a time
REMEMBERED = 20_000  # stretches whose paths a worker remembers

# States of the grammar, what each takes, and what an inserted or changed row is there.
START, SYSTEM, USER, ASSISTANT = range(4)
TAKES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
NEEDED = ("user", "user", "assistant", "user")
ENDS = (START, ASSISTANT)
LEGAL = frozenset({"su", "ua", "au"})
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
AT_MOST = 2  # insertions before a row; a third repeats a state

_SPACE = r"\x20\x09-\x0D"


def damage(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv_id, turn, role, text) after damage by the checksum of ``conv_id:turn``.

    Null ids, turns, roles and texts count as one space; ids and turns stay null
    in the result. Of 20 remainders 0 drops the row, 1 empties its text, 2 takes
    out its ``[.!?]``, 3 repeats it, 4 makes its role user.
    """
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(part(conv_id), F.lit(":"), part(turn))) % 20
    text = F.when(F.col("_fate") == 1, "").when(F.col("_fate") == 2, F.translate(part("text"), ".!?", ""))
    twice = F.array_repeat(F.lit(0), F.when(F.col("_fate") == 3, 2).otherwise(1))
    return (
        rows.withColumn("_fate", fate)
        .where("_fate != 0")
        .withColumn("_copy", F.explode(twice))
        .select(
            F.col(conv_id).alias("conv_id"),
            F.col(turn).cast("long").alias("turn"),
            F.when(F.col("_fate") == 4, "user").otherwise(part("role")).alias("role"),
            text.otherwise(part("text")).alias("text"),
        )
    )


def repair(rows: DataFrame, every: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of every conversation.

    ``rows`` has (conv_id, turn, role, text), and ``every`` the conv_ids to
    report; other columns of either are not read. The result is a row per
    conv_id, null being one too: gaps, the faults blank, duplicate, truncated
    and illegal, the cost and letters of the repair, and the SHA-256 of the
    repaired ``role:text`` lines. A conversation without rows has zeros, no
    letters and the hash of nothing; no conv_ids give no rows.

    Rows stand by turn, nulls first, then by role and text. Null roles and texts
    count as one space. Whether a row repeats an earlier one is found by
    (conversation, role, text), apart from the rest. Then the rows of a
    conversation stream twice through a sorted task, which holds one stretch and
    the letters so far: once without texts for the letters, once to apply them.
    The hash is one of a whole conversation, so no more than one task can make
    it, however long the conversation; what it holds is bounded.
    """
    own = rows.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    )
    kind = own.schema["conv_id"].dataType.simpleString()
    same = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(F.col("turn").asc_nulls_first())
    fault = (
        F.when(~F.col("text").rlike(f"[^{_SPACE}]"), "b")
        .when(F.row_number().over(same) > 1, "d")
        .when(~F.col("text").rlike(rf"[.!?][{_SPACE}]*\z"), "t")
        .otherwise("k")
    )
    marked = own.withColumn("fault", fault)
    ids = every.select(F.col("conv_id").cast(kind).alias("conv_id")).distinct()
    order = ["conv_id", "part", "turn", "role", "text"]

    def streamed(heads: DataFrame, texts: Column) -> DataFrame:
        tail = marked.select("conv_id", F.lit(1).alias("part"), "turn", "role", "text", "fault", texts.alias("kept"))
        both = tail.unionByName(heads.withColumn("part", F.lit(0)), allowMissingColumns=True)
        return both.repartition("conv_id").sortWithinPartitions(*order)

    letters = (
        streamed(ids, F.lit(None).cast("string"))
        .select("conv_id", "part", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
        .mapInArrow(_judged, f"conv_id {kind}, {_FACTS}")
    )
    facts = F.struct(*[c.split()[0] for c in _FACTS.split(", ")])
    return (
        streamed(letters.select("conv_id", facts.alias("facts")), F.col("text"))
        .select("conv_id", "part", "facts", "role", F.col("kept").alias("text"))
        .mapInArrow(_applied, f"conv_id {kind}, {_FACTS}, repaired_sha256 string")
    )


_FACTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [c.split()[0] for c in _FACTS.split(", ")]


# the search


def _moves(symbol: str, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of a row, by letter; insertions apart."""
    initial, fault = symbol
    yield "D", DELETE, state
    if fault in "bd":
        return
    cut = CUT if fault == "t" else 0
    after = TAKES.get((state, initial))
    if after is not None:
        yield "K", cut, after
    wanted = TAKES[state, NEEDED[state][0]]
    if after != wanted:
        yield "R", cut + REROLE, wanted


def _reaches(symbols: tuple[str, ...], start: int, goal: int) -> bool:
    """Whether any edits of a stretch lead from one state to another."""
    if goal == START:
        return start == START
    if goal == SYSTEM:
        return start == SYSTEM or start == START and any(s[0] == "s" and s[1] not in "bd" for s in symbols)
    return True


@lru_cache(maxsize=REMEMBERED)
def search(symbols: tuple[str, ...], start: int = START, goal: int | None = None) -> tuple[int, str] | None:
    """The cost and letters of the cheapest edits of a stretch, ties to the first by letters.

    ``symbols`` holds the role's initial and the fault of each row. Without a
    goal the stretch is the end of a conversation and may end with insertions;
    with one it ends with its last row, in that state.
    """
    n = len(symbols)
    if goal is not None and not _reaches(symbols, start, goal):
        return None
    least = [0] * (n + 1)  # what the rows from each on cost in any case
    for i in range(n - 1, -1, -1):
        fault = symbols[i][1]
        least[i] = least[i + 1] + (DELETE if fault in "bd" else CUT if fault == "t" else 0)
    known: dict[tuple[int, int, int], int] = {}  # what a state needs at least, by failed searches

    def steps(i: int, state: int, inserted: int) -> list[tuple[str, int, tuple[int, int, int]]]:
        found = [(c, x, (i + 1, s, 0)) for c, x, s in _moves(symbols[i], state)] if i < n else []
        if inserted < AT_MOST and (i < n or goal is None):
            insertion = ("I", INSERT, (i, TAKES[state, NEEDED[state][0]], inserted + 1))
            found.insert(1 if i < n else 0, insertion)
        return found

    first = (0, start, 0)
    bound = least[0]
    while True:
        path: list[str] = []
        # frames: place, cost left, its steps, the next of them, the least cost beyond the bound
        stack = [[first, bound, steps(*first), 0, 1 << 60]]
        while stack:
            frame = stack[-1]
            place, left, options, at, beyond = frame
            if place[0] == n and (place[1] in ENDS if goal is None else place[1] == goal):
                return bound, "".join(path)
            if at == len(options):
                known[place] = max(beyond, known.get(place, 0))
                stack.pop()
                if stack:
                    path.pop()
                    over = stack[-1]
                    over[4] = min(over[4], over[2][over[3] - 1][1] + known[place])
                continue
            frame[3] += 1
            letter, cost, after = options[at]
            needs = cost + known.get(after, least[after[0]])
            if needs > left:
                frame[4] = min(beyond, needs)
                continue
            path.append(letter)
            stack.append([after, left - cost, steps(*after), 0, 1 << 60])
        bound = known[first]


class _Chain:
    """The least paths over the rows of a conversation so far, one to each state."""

    def __init__(self) -> None:
        self.paths: dict[int, tuple[int, str]] = {START: (0, "")}
        self.rows: list[str] = []

    def add(self, symbol: str) -> None:
        if len(self.rows) == STRETCH:  # a row follows, so it is not the last stretch
            self._close((START, SYSTEM, USER, ASSISTANT))
        self.rows.append(symbol)

    def _close(self, goals: tuple) -> None:
        symbols, best = tuple(self.rows), {}
        for goal in goals:
            ways = [
                (cost + found[0], letters + found[1])
                for state, (cost, letters) in self.paths.items()
                if (found := search(symbols, state, goal)) is not None
            ]
            if ways:
                best[goal] = min(ways)
        self.paths, self.rows = best, []

    def end(self) -> tuple[int, str]:
        self._close((None,))
        return self.paths[None]


# streams of sorted rows


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, tuple]]:
    """(whether a conversation begins, its row) in order; its head comes before its rows."""
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            yield row[1] == 0, row


def _rows_out(schema: list[tuple[str, pa.DataType]], rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = zip(*held, strict=True)
        return pa.record_batch({n: pa.array(c, t) for (n, t), c in zip(schema, columns, strict=True)})

    size = 0
    for row in rows:
        held.append(row)
        size += len(row[7])
        if len(held) == 2000 or size > 1 << 22:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _types(first: pa.DataType) -> list[tuple[str, pa.DataType]]:
    return [("conv_id", first), *((n, pa.string() if n == "audit" else pa.int64()) for n in _NAMES)]


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return

    def rows() -> Iterator[tuple]:
        conv = None
        for head, row in _runs(_again(first, batches)):
            if head:
                if conv is not None:
                    yield conv.result()
                conv = _Facts(row[0])
            elif conv is not None:
                conv.add(*row[2:])
        if conv is not None:
            yield conv.result()

    yield from _rows_out(_types(first.schema.field(0).type), rows())


class _Facts:
    """What is counted while the rows of a conversation pass."""

    def __init__(self, conv_id) -> None:
        self.conv_id = conv_id
        self.counts = dict.fromkeys("bdtk", 0)
        self.illegal = self.turns = 0
        self.low = self.high = self.initial = None
        self.chain = _Chain()

    def add(self, turn, initial: str, fault: str) -> None:
        if turn is not None and turn != self.high:  # turns come in order
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.counts[fault] += 1
        self.chain.add((initial or " ") + fault)

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        faults = (self.counts[x] for x in "bdt")
        return (self.conv_id, gaps, *faults, self.illegal, *self.chain.end())


def _again(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


class _Repaired:
    """The hash of a conversation while its rows pass and its letters are followed."""

    def __init__(self, conv_id, facts: dict) -> None:
        self.conv_id, self.facts = conv_id, facts
        self.letters, self.at, self.state, self.lines = facts["audit"], 0, START, 0
        self.hash = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.state = TAKES[self.state, role[0]]
        self.lines += 1

    def _insertions(self) -> None:
        while self.at < len(self.letters) and self.letters[self.at] == "I":
            self._line(NEEDED[self.state], "")
            self.at += 1

    def add(self, role: str, text: str) -> None:
        self._insertions()
        letter = self.letters[self.at]
        self.at += 1
        if letter != "D":
            self._line(role if letter == "K" else NEEDED[self.state], text)

    def result(self) -> tuple:
        self._insertions()
        return (self.conv_id, *(self.facts[n] for n in _NAMES), self.hash.hexdigest())


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = next(batches, None)
    if first is None:
        return

    def rows() -> Iterator[tuple]:
        conv = None
        for head, row in _runs(_again(first, batches)):
            if head:
                if conv is not None:
                    yield conv.result()
                conv = _Repaired(row[0], row[2])
            elif conv is not None:
                conv.add(*row[3:])
        if conv is not None:
            yield conv.result()

    names = [*_types(first.schema.field(0).type), ("repaired_sha256", pa.string())]
    yield from _rows_out(names, rows())
