"""Alignment of two tokenizers over a corpus, with id pairs counted by external spills.

Each text is encoded by a byte-level BPE (A) and a piece BPE with byte fallback
(B). Where tokens of both end at one byte, a group ends and the two tokens are
linked. How often an id pair is linked in the whole corpus weighs the links.

One pass over the texts writes, for every RUN of documents, their own facts and
the pair-document records: dealt by the low bits of the B id, side-major (B, then
A), and compressed. A run counts its own pairs, so a pair that stands in every
document is one number a run. Counts of runs meet FAN at a time in a heap by B
id, level after level; the last merge has all pairs of a B id in a row, hence its
highest. Then the records of FAN runs stream past the counts of their part, and
what they add to each document goes back to its run.

**Cutting.** A space between two characters that are no white space begins a
token of A, because a pre-token starts there, and of B, because no piece holds a
space behind another character. Between two such spaces a text is a unit, which
has the same tokens, groups and links wherever it stands; a run encodes each of
its units once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bpe import _alphabet
from tidemark.llm.workspace import Workspace

RADIX = 32  # parts of the records, by the low bits of the B id
RUN = 5_000_000  # units, and eighths of the characters, of the documents of a run, about
FAN = 64  # runs that meet in one merge
MARK = "\u2581"  # a space in the pieces of B

# No character that any of the libraries takes for white space, before and after.
_CUT = re.compile(r"(?<=[^\s\u180e]) (?=[^\s\u180e])")


class Pair:
    """The two tokenizers, and the bytes of their ids."""

    def __init__(self, first: str, second: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(first)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        alphabet = _alphabet()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            known = all(c in alphabet for c in token)
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=second)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        if any(MARK in self.b.id_to_piece(i).lstrip(MARK) for i in range(len(self.bytes_b))):
            raise ValueError("a piece holds a space behind another character")
        if not (all(self.bytes_a[i] for i in vocabulary.values()) and all(self.bytes_b)):
            raise ValueError("a token has no bytes")
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        # an id inside a group, at the end of its side, and at the end of a unit
        self.shown_a, self.shown_b = (
            [np.array([f"{i}{end}" for i in range(n)], object) for end in ends]
            for n, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;\n"))
        )

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        if self.b.is_byte(i):
            return bytes([int(piece[3:-1], 16)])
        return piece.replace(MARK, " ").encode()

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]], np.ndarray]:
        """The ids of a space and each unit by both, and whether they spell it; if not, no ids."""
        firsts = [e.ids for e in self.a.encode_batch([" " + u for u in units], add_special_tokens=False)]
        seconds = self.b.encode(units, num_threads=1)
        wholes = [(" " + u).encode() for u in units]
        sizes = np.array(list(map(len, wholes)), np.int64)
        right = np.ones(len(units), bool)
        for ids, known, widths in ((firsts, self.bytes_a, self.sizes_a), (seconds, self.bytes_b, self.sizes_b)):
            flat, n = _flat(ids)
            of_unit = np.add.reduceat(np.append(widths[flat], 0), _begins(n)) * (n > 0)
            if (of_unit == sizes).all() and b"".join([known[i] for x in ids for i in x]) == b"".join(wholes):
                continue
            right &= np.array([b"".join([known[i] for i in x]) == w for x, w in zip(ids, wholes, strict=True)])
        if not right.all():
            firsts, seconds = ([x if r else [] for x, r in zip(ids, right, strict=True)] for ids in (firsts, seconds))
        return firsts, seconds, right

    def align(self, units: list[str]) -> tuple[list[str | None], np.ndarray, np.ndarray]:
        """The groups of each unit as text, None if its bytes differ; the links of all units
        in order, each (B id, A id) in one number; and of each unit how many tokens of A and B,
        groups and links it has."""
        firsts, seconds, right = self.encode(units)
        (a, n_a), (b, n_b) = _flat(firsts), _flat(seconds)
        ends_a, ends_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        # the token of A that ends where one of B does; a unit ends both
        meets = np.searchsorted(ends_a, ends_b)
        last_b = ends_a[np.minimum(meets, len(a) - 1)] == ends_b if len(a) else np.zeros(len(b), bool)
        last_a = np.zeros(len(a), bool)
        last_a[meets[last_b]] = True
        links = (b[last_b] << 32) | a[meets[last_b]]
        n_links = np.add.reduceat(np.append(last_b, False).astype(np.int64), _begins(n_b)) * (n_b > 0)
        # the tokens as text, groups in order and A before B in each
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        before_b = np.searchsorted(group_b, group_a)  # tokens of B in groups before one of A
        through_a = np.searchsorted(group_a, group_b, side="right")
        parts = np.empty(len(a) + len(b), object)
        parts[np.arange(len(a)) + before_b] = np.where(last_a, self.shown_a[1][a], self.shown_a[0][a])
        shown = np.where(last_b, self.shown_b[1][b], self.shown_b[0][b])
        ends = np.cumsum(n_b)[n_b > 0] - 1
        shown[ends] = self.shown_b[2][b[ends]]
        parts[np.arange(len(b)) + through_a] = shown
        texts = iter("".join(parts.tolist()).split("\n"))
        groups = [next(texts) if r else None for r in right.tolist()]
        return groups, links, np.stack([n_a, n_b, n_links, n_links], 1)


def _flat(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and how many each row has."""
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.fromiter((x for r in rows for x in r), np.int64, int(sizes.sum())), sizes


def _begins(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


@lru_cache(maxsize=2)
def _pair(first: str, second: bytes) -> Pair:
    return Pair(first, second)


# numbers in few bytes


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers that are not negative, each as narrow as its largest, compressed together."""
    parts = []
    for x in arrays:
        width = next(w for w in (1, 2, 4, 8) if int(x.max(initial=0)) < 1 << 8 * w)
        parts += [np.array([width, len(x)], np.int64).tobytes(), x.astype(f"<u{width}").tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _opened(packed: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(packed), 0, []
    while at < len(data):
        width, n = np.frombuffer(data, np.int64, 2, at).tolist()
        out.append(np.frombuffer(data, f"<u{width}", n, at + 16).astype(np.int64))
        at += 16 + width * n
    return out


def _steps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=0)


# the pass over the texts


class _Places(dict):
    """Units and their numbers, in order of arrival."""

    def __init__(self) -> None:
        self.fresh: list[str] = []  # not yet encoded

    def __missing__(self, unit: str) -> int:
        self.fresh.append(unit)
        at = self[unit] = len(self)
        return at


class _Run:
    """The documents of a run: their units, and the facts of each distinct unit."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.place = _Places()
        self.groups: list[str | None] = []  # None where the bytes differ
        self.facts = [np.empty((0, 4), np.int64)]
        self.links = [np.empty(0, np.int64)]
        self.ids: list = []
        self.units: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        place = self.place
        found = [place[u] for u in _CUT.split(text)] if text else []
        self.ids.append(doc_id)
        self.units.append(np.array(found, np.int32))
        self.size += len(found) + (len(text or "") >> 3)
        if len(place.fresh) >= 4096 or len(text or "") > 1 << 20:
            self.settle()

    def settle(self) -> None:
        if self.place.fresh:
            groups, links, facts = self.pair.align(self.place.fresh)
            self.groups += groups
            self.links.append(links)
            self.facts.append(facts)
            self.place.fresh.clear()

    def rows(self, run: int) -> Iterator[pa.RecordBatch]:
        self.settle()
        n = len(self.ids)
        of_unit = np.concatenate(self.facts)
        n_links = of_unit[:, 3]
        right = np.array([g is not None for g in self.groups], bool)
        facts, used = [], []
        for units in self.units:
            if not len(units) or not right[units].all():  # a unit's bytes differ, so the text's do
                facts.append((0, 0, 0, 0, ""))
                used.append(units[:0])
                continue
            texts = map(self.groups.__getitem__, units.tolist())
            digest = hashlib.sha256(";".join(texts).encode()).hexdigest()
            facts.append((*of_unit[units].sum(axis=0).tolist(), digest))
            used.append(units)
        for at in range(0, n, 10_000):
            part = facts[at : at + 10_000]
            yield self._batch(
                run, -1, range(at, at + len(part)), self.ids[at : at + 10_000],
                facts=[dict(zip(_FACT_NAMES, f, strict=True)) for f in part],
            )
        # (unit, document, how often), then (link, document, how often)
        doc = np.repeat(np.arange(n), list(map(len, used)))
        both, often = np.unique(np.concatenate(used).astype(np.int64) * n + doc, return_counts=True) if n else (doc, doc)
        unit, doc = both // max(1, n), both % max(1, n)
        first = np.concatenate([[0], np.cumsum(n_links)])
        every = np.concatenate(self.links)
        pairs, local = np.unique(every, return_inverse=True)
        # parts by the low bits of the B id, side-major inside
        rank = np.lexsort((pairs, (pairs >> 32) % RADIX))
        of_pair = np.empty(len(pairs), np.int64)
        of_pair[rank] = np.arange(len(pairs))
        local, pairs = of_pair[local], pairs[rank]
        reach = n_links[unit]
        at = np.repeat(first[unit] - np.concatenate([[0], np.cumsum(reach)[:-1]]), reach) + np.arange(reach.sum())
        record = local[at] * n + np.repeat(doc, reach)
        order = np.argsort(record, kind="stable")
        record, often = record[order], np.repeat(often, reach)[order]
        begin = np.flatnonzero(np.diff(record, prepend=-1))
        often = np.add.reduceat(often, begin) if len(begin) else often
        record = record[begin]
        pair, doc = record // max(1, n), record % max(1, n)
        borders = np.searchsorted((pairs >> 32) % RADIX, np.arange(RADIX + 1))
        cuts = np.searchsorted(pair, borders)
        for part in range(RADIX):
            a, b, x, y = borders[part], borders[part + 1], cuts[part], cuts[part + 1]
            if x == y:
                continue
            kept, docs_of = np.unique(pair[x:y] - a, return_counts=True)
            totals = np.bincount(pair[x:y] - a, often[x:y], b - a).astype(np.int64)[kept]
            keys = pairs[a:b][kept]
            # documents of a pair in order, each from the one before
            steps = np.diff(doc[x:y], prepend=0)
            heads = np.cumsum(docs_of) - docs_of
            steps[heads] = doc[x:y][heads]
            yield self._batch(
                run, part, [n], [None],
                counts=[_squeezed(_steps(keys), totals)], records=[_squeezed(docs_of, steps, often[x:y] - 1)],
            )

    def _batch(self, run, part, places, ids, facts=None, counts=None, records=None) -> pa.RecordBatch:
        n = len(ids)
        none = [None] * n
        return pa.record_batch(
            {
                "run": pa.array([run] * n, pa.int64()),
                "part": pa.array([part] * n, pa.int32()),
                "place": pa.array(list(places), pa.int64()),
                "doc_id": pa.array(ids, pa.int64()),
                "facts": pa.array(facts or none, pa.struct([(c, t) for c, t in zip(_FACT_NAMES, _FACT_TYPES)])),
                "counts": pa.array(counts or none, pa.binary()),
                "records": pa.array(records or none, pa.binary()),
            }
        )


_FACT_NAMES = ("n_a", "n_b", "n_groups", "n_links", "groups_sha256")
_FACT_TYPES = (*[pa.int64()] * 4, pa.string())
_FACTS = "n_a: bigint, n_b: bigint, n_groups: bigint, n_links: bigint, groups_sha256: string"
_SPILLED = f"run long, part int, place long, doc_id long, facts struct<{_FACTS}>, counts binary, records binary"


def _spilled(models):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*models.value)
        # an attempt that is repeated gives its runs the same numbers
        number = TaskContext.get().partitionId() << 24
        held = _Run(pair)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                held.add(doc_id, text.as_py())
                if held.size >= RUN or len(held.ids) >= RUN:
                    yield from held.rows(number)
                    held, number = _Run(pair), number + 1
        if held.ids:
            yield from held.rows(number)

    return run


# counting


def _ids(packed: bytes, source: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(B id, source, keys, counts) of a run's pairs, a B id at a time."""
    steps, counts = _opened(packed)
    keys = np.cumsum(steps)
    cuts = np.flatnonzero(np.diff(keys >> 32, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(keys)], strict=True):
        yield int(keys[a] >> 32), source, keys[a:b], counts[a:b]


def _merged(packed: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of each B id over all runs, in order."""
    streams = [_ids(p, i) for i, p in enumerate(packed)]
    b_id, keys, counts = None, [], []

    def settled() -> tuple[np.ndarray, np.ndarray]:
        found, at = np.unique(np.concatenate(keys), return_inverse=True)
        return found, np.bincount(at, np.concatenate(counts)).astype(np.int64)

    for head, _, k, c in heapq.merge(*streams, key=lambda x: x[:2]):
        if head != b_id and keys:
            yield settled()
            keys, counts = [], []
        b_id = head
        keys.append(k)
        counts.append(c)
    if keys:
        yield settled()


def _summed(key: tuple, table: pa.Table) -> pa.Table:
    """The counts of some runs of a part as those of one."""
    found = list(_merged(table.column("counts").to_pylist()))
    keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    part, group = (k.as_py() for k in key)
    return pa.table(
        {
            "part": pa.array([part], pa.int32()),
            "run": pa.array([group], pa.int64()),
            "counts": pa.array([_squeezed(_steps(keys), counts)], pa.binary()),
        }
    )


def _highest(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whether a pair's count is the highest of its B id; keys are side-major."""
    begin = np.flatnonzero(np.diff(keys >> 32, prepend=-1))
    return counts == np.repeat(np.maximum.reduceat(counts, begin), np.diff(np.append(begin, len(keys))))


def _returned(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """What the pairs of a part add to the documents of some runs."""
    runs, parts, packed = [], [], []
    if left.num_rows:
        steps, totals = _opened(right.column("counts")[0].as_py())
        known = np.cumsum(steps)
        best = _highest(known, totals)
        columns = [left.column(c).to_pylist() for c in ("run", "place", "counts", "records")]
        for run, n, counts, records in zip(*columns, strict=True):
            keys = np.cumsum(_opened(counts)[0])
            docs_of, steps, often = _opened(records)
            heads = np.cumsum(docs_of) - docs_of
            doc = np.cumsum(steps)
            doc -= np.repeat(doc[heads] - steps[heads], docs_of)
            at = np.repeat(np.searchsorted(known, keys), docs_of)
            often += 1
            sums = np.zeros(n, np.int64)
            np.add.at(sums, doc, often * totals[at])
            bests = np.bincount(doc, often * best[at], n).astype(np.int64)
            runs.append(run)
            parts.append(key[0].as_py())
            packed.append(_squeezed(bests, sums))
    return pa.table(
        {"run": pa.array(runs, pa.int64()), "part": pa.array(parts, pa.int32()), "added": pa.array(packed, pa.binary())}
    )


_RESULT = [
    ("doc_id", pa.int64()), *((c, pa.int64()) for c in (*_FACT_NAMES[:4], "n_best", "count_sum")),
    ("groups_sha256", pa.string()),
]


def _gathered(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """The documents of a run with what all parts add to them."""
    n = left.num_rows
    left = left.sort_by("place")
    bests, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for packed in right.column("added"):
        for total, x in zip((bests, sums), _opened(packed.as_py()), strict=True):
            total += x
    facts = left.column("facts").combine_chunks()
    columns = {c: facts.field(c) for c in _FACT_NAMES}
    columns |= {"doc_id": left.column("doc_id"), "n_best": pa.array(bests), "count_sum": pa.array(sums)}
    return pa.table({c: columns[c] for c, _ in _RESULT})


def align(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``first`` and ``second`` are the paths of a byte-level tokenizer file and of a
    piece model, which the driver reads and broadcasts; their sizes are bounded.
    Both encode a space and the text, special tokens being plain text. A text
    that is null or empty, or that the tokens do not spell, has zeros and an
    empty digest, and its tokens count nowhere. Repeated rows and null doc_ids
    are rows like any other; other columns are not read; no rows give no rows.

    A unit, text without a single space inside, is encoded as a whole by both
    libraries; everything else a task holds is bounded by RUN, and by the pairs
    of ids of a part in counting.
    """
    spark = docs.sparkSession
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        models = spark.sparkContext.broadcast((f.read(), g.read()))
    ws = Workspace(spark, "align")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spilled = ws.write(texts.mapInArrow(_spilled(models), _SPILLED), "runs")
    parts = spilled.where("part >= 0")
    # numbers of runs without gaps, so that FAN of them meet; a run has one row here
    numbers = spilled.where("part = -1 and place = 0").select("run")
    n_runs = numbers.count()
    group = F.pmod(F.xxhash64("run"), F.lit(max(1, -(-n_runs // FAN)))).cast("long")
    counts, level = parts.select("part", "run", "counts"), n_runs
    while True:
        level = -(-level // FAN)
        meets = F.pmod(F.xxhash64("run"), F.lit(max(1, level))).cast("long").alias("group")
        counts = counts.select("part", "counts", meets).groupBy("part", "group").applyInArrow(
            _summed, "part int, run long, counts binary"
        )
        if level <= 1:
            break
        counts = ws.write(counts, f"level{level}")
    counts = ws.write(counts, "counts")
    # each group of runs takes a copy of the counts of its part
    groups = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(1, -(-n_runs // FAN)) - 1).cast("long")))
    copies = counts.select("part", "counts", groups.alias("group"))
    records = parts.select("part", "run", "place", "counts", "records", group.alias("group"))
    added = (
        records.groupBy("part", "group")
        .cogroup(copies.groupBy("part", "group"))
        .applyInArrow(_returned, "run long, part int, added binary")
    )
    facts = spilled.where("part = -1").select("run", "place", "doc_id", "facts")
    longs = ", ".join(f"{c} long" for c, t in _RESULT if t == pa.int64())
    return facts.groupBy("run").cogroup(added.groupBy("run")).applyInArrow(
        _gathered, f"{longs}, groups_sha256 string"
    )
