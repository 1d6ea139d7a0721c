"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Every document has a rate, the number of times the mix takes it. Of all rates
that meet each source's target of words, the sought ones stay closest, in
relative entropy, to taking every document once. The dual of that problem is
convex with one multiplier a source; its solution tilts the rates
exponentially, rate = min(cap, exp(multiplier * size / mean size)). Newton steps
find the multipliers. All sums run over cells, the (source, size) groups of
documents, whose number the lengths of texts bound; the documents themselves
are read for the cells and once more for the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.workspace import Workspace

CAP = 3
WEIGHTS = (5, 2, 1)
STEPS = 80
EXACT = 1e-10
CHUNK = 20_000  # documents of one cell that are numbered in one task
UNIT = 10**9  # rates are rounded to this fraction, so that their sums have no order

RESULT = ("mix_size", "mix_source_size", "mix_target", "mix_copies", "mix_taken")
_INFINITY = float("inf")


def size_of(text: str = "text") -> Column:
    """The number of words of a text; null has none."""
    return F.regexp_count(
        F.coalesce(F.col(text).cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")
    ).cast("long")


def _key(source: str) -> Column:
    """The source as a value that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(key, n, source_size, target) of the sources (key, n, source_size).

    Sources in code point order, null last, weigh ``weights`` in turn. Raising
    one water level until all sizes are shared out, each source takes weight *
    level, but at most cap * size. The sources that are full at the final level
    come first in the order of size / weight, so sums along it find the level.
    One row a source is ordered as a whole here, documents are not.
    """
    full = F.col("source_size") * cap
    order = Window.orderBy(F.col("key") == "n", "key")
    weight = F.array(*map(F.lit, weights))[(F.row_number().over(order) - 1) % len(weights)]
    table = totals.withColumn("weight", weight.cast("double")).withColumn("fill", full / F.col("weight"))
    by = Window.orderBy("fill", "key")
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    onward = by.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0))
    level = left / F.sum("weight").over(onward)
    table = table.withColumn("level", level).withColumn(
        "level", F.min(F.when(F.col("fill") >= F.col("level"), F.struct("fill", "key", "level"))).over(everything)["level"]
    )
    return table.select(
        "key", "n", "source_size",
        F.when(F.col("fill") < F.col("level"), full.cast("double"))
        .otherwise(F.least(full.cast("double"), F.col("weight") * F.col("level")))
        .alias("target"),
    )


def _rate(cap: int) -> Column:
    """The tilted rate of a cell of a source with a multiplier."""
    tilt = F.exp(F.least(F.col("multiplier") * F.col("size") / F.col("mean"), F.lit(700.0)))
    return (
        F.when(F.col("target") >= F.col("source_size") * cap, F.lit(float(cap)))
        .when(F.col("target") <= 0, F.lit(0.0))
        .otherwise(F.least(tilt, F.lit(float(cap))))
    )


def multipliers(cells: DataFrame, sources: DataFrame, cap: int, ws: Workspace) -> DataFrame:
    """The sources with the multiplier that makes their cells meet the target.

    Words taken grow with the multiplier, so every evaluation narrows a bracket;
    a Newton step that leaves it, or has no slope, is replaced by bisection or,
    while one side is open, by doubling.
    """
    mean = F.greatest(F.col("source_size") / F.col("n"), F.lit(1.0))
    start = F.when((F.col("target") > 0) & (F.col("source_size") > 0), F.log(F.col("target") / F.col("source_size")))
    state = ws.write(
        sources.withColumns(
            {
                "mean": mean,
                "multiplier": F.coalesce(start, F.lit(0.0)),
                "low": F.lit(-_INFINITY),
                "high": F.lit(_INFINITY),
                "done": F.col("source_size") * cap <= F.col("target"),
            }
        ),
        "state",
    )
    words = F.col("count") * F.col("size")
    slope = F.when(_rate(cap) < cap, words * F.col("size") / F.col("mean") * _rate(cap)).otherwise(0.0)
    at, low, high = F.col("multiplier"), F.col("lower"), F.col("upper")
    newton = at - (F.log("taken") - F.log("target")) * F.col("taken") / F.col("slope")
    closed = (low > -_INFINITY) & (high < _INFINITY)
    other = (
        F.when(closed, (low + high) / 2)
        .when(high < _INFINITY, at - F.greatest(F.abs(at), F.lit(1.0)))
        .otherwise(at + F.greatest(F.abs(at), F.lit(1.0)))
    )
    for _ in range(STEPS):
        sums = (
            cells.join(state.where("not done"), "key")
            .groupBy("key")
            .agg(F.sum(words * _rate(cap)).alias("taken"), F.sum(slope).alias("slope"))
        )
        after = (
            state.join(sums, "key", "left")
            .withColumn("lower", F.when(F.col("taken") <= F.col("target"), at).otherwise(F.col("low")))
            .withColumn("upper", F.when(F.col("taken") > F.col("target"), at).otherwise(F.col("high")))
            .withColumn("near", F.abs(F.col("taken") / F.col("target") - 1) <= EXACT)
            .withColumn(
                "next",
                F.when((F.col("slope") > 0) & (F.col("taken") > 0) & (newton > low) & (newton < high), newton).otherwise(other),
            )
            .select(
                "key", "n", "source_size", "target", "mean",
                F.when(F.col("done") | F.col("near"), at).otherwise(F.col("next")).alias("multiplier"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                (F.col("done") | F.col("near") | F.col("taken").isNull()).alias("done"),
            )
        )
        after = ws.write(after, "state")
        ws.drop(state)
        state = after
        if state.where("not done").isEmpty():
            break
    return state


def _rounded(cells: DataFrame, cap: int) -> DataFrame:
    """The cells with whole numbers of copies near count * rate, each source near its target.

    Along falling sizes, running sums of the rates are rounded, which leaves each
    source less than its longest text from its target. Copies of the shortest
    texts, as many as fit into that rest, are then added or taken away.
    """
    falling = Window.partitionBy("key").orderBy(F.col("size").desc())
    so_far = falling.rowsBetween(Window.unboundedPreceding, 0)
    exact = F.sum("nanos").over(so_far)
    until = F.floor((exact + UNIT // 2) / UNIT).cast("long")
    whole = Window.partitionBy("key")
    rising = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.withColumn("until", until)
        .withColumn("copies", F.col("until") - F.coalesce(F.lag("until").over(falling), F.lit(0)))
        .withColumn("copies", F.least(F.greatest("copies", F.lit(0)), F.col("count") * cap))
        .withColumn("rest", F.col("target") - F.sum(F.col("copies") * F.col("size")).over(whole))
    )
    room = F.when(F.col("size") == 0, 0).when(F.col("rest") > 0, F.col("count") * cap - F.col("copies"))
    cells = cells.withColumn("room", room.otherwise(F.col("copies")))
    used = F.coalesce(F.sum(F.col("room") * F.col("size")).over(rising), F.lit(0))
    fits = F.floor((F.abs("rest") - F.col("used")) / F.greatest("size", F.lit(1))).cast("long")
    change = F.least(F.greatest(fits, F.lit(0)), F.col("room"))
    return cells.withColumn("used", used).withColumn(
        "copies", F.col("copies") + F.when(F.col("rest") > 0, change).otherwise(-change)
    )


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    doc_id: str = "doc_id",
    source: str = "source",
    columns: list[str] | None = None,
) -> DataFrame:
    """The rows with mix_size, mix_source_size, mix_target, mix_copies and mix_taken.

    ``columns`` are the columns of ``docs`` to carry, by default the id and the
    source; those that bear a name of the result are replaced. A null text has size 0; a null source is a source of its own, the
    last one. A text without words is taken once and gives no words. Within a
    cell the copies are dealt evenly, the odd ones by the hash of the doc_id, so
    reruns agree; equal rows are interchangeable, and so are rows of a cell
    without a doc_id. No rows give no rows. Nobody is taken more than ``cap``
    times.

    A cell with a third of all rows is numbered in chunks of hashes, a few
    ten thousand rows each.
    """
    ws = Workspace(docs.sparkSession, "mix")
    columns = [doc_id, source] if columns is None else [c for c in columns if c not in RESULT]
    order = F.xxhash64(F.lit(1), F.col(doc_id).cast("string"))
    named = {c: f"_{i}" for i, c in enumerate(columns)}
    rows = docs.select(
        *(F.col(c).alias(n) for c, n in named.items()),
        _key(source).alias("key"), size_of().alias("size"), order.alias("order"),
    )
    cells = ws.write(rows.groupBy("key", "size").agg(F.count("*").alias("count")), "cells")
    totals = cells.groupBy("key").agg(
        F.sum("count").alias("n"), F.sum(F.col("count") * F.col("size")).alias("source_size")
    )
    state = multipliers(cells, targets(totals, weights, cap), cap, ws)
    nanos = F.col("count") * F.round(_rate(cap) * UNIT).cast("long")
    rounded = _rounded(cells.join(state, "key").withColumn("nanos", nanos.cast("decimal(38,0)")), cap)
    rounded = ws.write(
        rounded.select("key", "size", "count", "source_size", "target", "copies"), "rounded"
    )
    ws.drop(cells, state)
    chunks = 1 + (rounded.agg(F.max("count")).first()[0] or 0) // CHUNK
    rows = rows.withColumn("chunk", F.pmod("order", F.lit(chunks)))
    inside = Window.partitionBy("key", "size", "chunk").orderBy("order", F.col(named[doc_id]) if doc_id in named else "order")
    numbered = rows.withColumn("place", F.row_number().over(inside))
    earlier = Window.partitionBy("key", "size").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("key", "size", "chunk").agg(F.count("*").alias("c"))
        .withColumn("offset", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
        .select("key", "size", "chunk", "offset")
        if chunks > 1
        else rounded.select("key", "size", F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("offset"))
    )
    dealt = offsets.join(rounded, ["key", "size"])
    each = F.floor(F.col("copies") / F.col("count"))
    more = F.col("offset") + F.col("place") <= F.col("copies") - each * F.col("count")
    copies = (each + more.cast("long")).cast("long")
    return numbered.join(dealt, ["key", "size", "chunk"]).select(
        *(F.col(n).alias(c) for c, n in named.items()),
        F.col("size").alias("mix_size"),
        F.col("source_size").alias("mix_source_size"),
        F.col("target").alias("mix_target"),
        copies.alias("mix_copies"),
        (copies * F.col("size")).alias("mix_taken"),
    )
