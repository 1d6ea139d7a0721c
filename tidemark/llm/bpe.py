"""Byte-pair encoding and decoding of whole texts, long ones by tree concatenation.

A long text is cut into halves until the leaves are short. Leaves are encoded in
parallel, each as if it stood alone, and joined pairwise. Around a join the ids
of both sides may be wrong, because neither side saw the other. So a window
around it is encoded again and grows until its outer ends repeat what both sides
already have:

* between pre-tokens, the pre-tokenizer reads left to right without memory, so
  from the first common border on, the window and the right side agree for good;
* inside one pre-token (a long run of letters, say), a sequence of tokens is the
  encoding if every two neighbours are the encoding of their own text, so a
  window whose first and last token are those of the two sides is final.

The vocabulary is a tokenizer file of the public ``tokenizers`` library, with
the byte-level pre-tokenizer. A pre-token is encoded by that library once per
task and remembered, and so is what follows a single space. A text with a character whose class the two pattern
engines see differently is encoded by the library as a whole.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textkit
from tidemark.llm.workspace import Workspace

LEAF = 16_384  # characters of a leaf
LONG = 512  # characters of a pre-token above which it is encoded by halves
BACK = 3  # pre-tokens at the end of a left side that its missing neighbour may change
REMEMBERED = 120_000  # texts in a generation of what a worker remembers

# The byte-level pre-tokenizer's pattern, with the library's white space.
_SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|"
    rf" ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)


def _alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


Part = tuple[np.ndarray, np.ndarray]  # ids, and the places where pre-tokens begin


class _Disagreed(Exception):
    """A character stands in different classes of the two pattern engines."""


class _Memo(dict):
    """Text to ids. Of two generations the older is forgotten when the younger is full."""

    def __init__(self, make):
        self.make = make
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        ids = self.older.get(text) or self.make(text)
        if len(text) <= LONG:
            self[text] = ids
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
        return ids


def _offsets(sizes: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int64)


def _begins(token: bytes) -> bool:
    """Whether a token starts at a character's first byte."""
    return token[0] & 0xC0 != 0x80


class Codec:
    """One tokenizer, with what it has learnt about pre-tokens so far."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        parsed = json.loads(spec)
        pre = parsed["pre_tokenizer"] or {}
        added = parsed["added_tokens"]
        self.special = {t["content"]: t["id"] for t in added}
        self.plain = (
            parsed["model"]["type"] == "BPE"
            and parsed["normalizer"] is None
            and parsed["post_processor"] is None
            and pre.get("type") == "ByteLevel"
            and pre.get("use_regex", True)
            and not pre.get("add_prefix_space")
            and not any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added)
        )
        if not self.plain:
            raise ValueError("only byte-level BPE without normaliser or prefix space is supported")
        alphabet = _alphabet()
        vocab = self.library.get_vocab(with_added_tokens=True)
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in alphabet for c in token)
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if known else token.encode()
        self.shown = [str(i).encode() for i in range(len(self.bytes_of))]
        self._find = regex.compile(_PATTERN).findall
        longest = sorted(self.special, key=len, reverse=True)
        self._marks = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self.widest = max(map(len, longest), default=1)
        # a space that follows white space and precedes white space or the end
        self._run = regex.compile(r"\s (?=\s|$)").search
        self._letter = {b: c for c, b in alphabet.items()}
        self._sure: set[str] = set()
        self._tokenize = self.library.model.tokenize
        self.known = _Memo(self.piece)
        self.spaced = _Memo(self._after_space)

    # pre-tokens

    def _check(self, piece: str) -> None:
        """Whether the library puts every character into the class our pattern puts it into."""
        theirs = self.library.pre_tokenizer.pre_tokenize_str
        for c in set(piece) - self._sure:
            if any(len(self._find(x + c)) != len(theirs(x + c)) for x in ("a", "1", "!", "\n")):
                raise _Disagreed
            self._sure.add(c)

    def _after_space(self, rest: str) -> bytes:
        """The ids of a space and the text up to the next one."""
        if rest.isalpha():
            return self.piece(" " + rest)
        return b"".join([self.known[p] for p in self._find(" " + rest)])

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text; special tokens are pieces of their own."""
        if self._marks is None or not self._marks.search(text):
            return self._find(text)
        out, at = [], 0
        for m in self._marks.finditer(text):
            out += self._find(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self._find(text[at:])

    def piece(self, piece: str) -> bytes:
        """The ids of one pre-token as 32-bit integers."""
        if piece in self.special:
            return np.array([self.special[piece]], np.int32).tobytes()
        if not self._sure.issuperset(piece):
            self._check(piece)
        if len(piece) <= LONG:
            shown = piece.encode().decode("latin-1").translate(self._letter)
            return array("i", [t.id for t in self._tokenize(shown)]).tobytes()
        half = len(piece) // 2
        left, right = (np.frombuffer(self.piece(p), np.int32) for p in (piece[:half], piece[half:]))
        return self.within(left, right).tobytes()

    def runs(self, text: str) -> list[bytes]:
        """The ids of a text in stretches that each begin where a pre-token begins.

        A space between other characters always opens a pre-token, so a text
        without runs of white space and special tokens is cut there and few
        stretches are new. Other texts are cut into their pre-tokens.
        """
        if self._run(text) or self._marks is not None and self._marks.search(text):
            return [self.known[p] for p in self.pieces(text)]
        first, *rest = text.split(" ")
        return [self.known[p] for p in self._find(first)] + [self.spaced[r] for r in rest]

    # joins

    def forget(self) -> None:
        """Give back what pre-tokens took; a worker outlives its tasks and has other work."""
        for memo in (self.known, self.spaced):
            memo.clear()
            memo.older.clear()
        textkit.give_back()

    def text_of(self, ids: np.ndarray) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids.tolist()])

    def within(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ids of a pre-token from those of its two parts."""
        k = 4
        while True:
            a, b = max(0, len(left) - k), min(k, len(right))
            while a > 0 and not _begins(self.bytes_of[left[a]]):
                a -= 1
            while b < len(right) and not _begins(self.bytes_of[right[b]]):
                b += 1
            window = (self.text_of(left[a:]) + self.text_of(right[:b])).decode()
            if len(window) > LONG and (a or b < len(right)):
                middle = np.frombuffer(self.piece(window), np.int32)
            else:
                middle = np.array(self.library.encode(window, add_special_tokens=False).ids, np.int32)
            if (a == 0 or middle[0] == left[a]) and (b == len(right) or middle[-1] == right[b - 1]):
                return np.concatenate([left[:a], middle, right[b:]])
            k *= 2

    def leaf(self, text: str) -> Part:
        """The ids of a text that stands alone, and places where pre-tokens begin."""
        parts = self.runs(text)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return np.frombuffer(b"".join(parts), np.int32), (np.cumsum(sizes) - sizes)[sizes > 0]

    def join(self, left: Part, right: Part) -> Part:
        """The ids and pre-token places of two neighbouring parts of a text."""
        (a, a_starts), (b, b_starts) = left, right
        if not len(a) or not len(b):
            return right if not len(a) else left
        keep = self._settled(a, a_starts, b)
        at = int(a_starts[keep]) if keep else 0
        tail = self.text_of(a[at:])
        k = 2 * BACK
        while True:
            whole = k >= len(b_starts)
            stop = len(b) if whole else int(b_starts[k])
            head = self.text_of(b[:stop])
            if whole or len(head) >= 8 * self.widest:
                pieces = self.pieces((tail + head).decode())
                begins = _offsets([len(p.encode()) for p in pieces]) - len(tail)
                places = _offsets([len(self.bytes_of[i]) for i in b[:stop].tolist()])
                borders = {int(places[s]): int(s) for s in b_starts if s < stop}
                sure = len(pieces) if whole else len(pieces) - BACK
                meet = next((i for i in range(sure) if int(begins[i]) in borders), len(pieces))
                if meet < len(pieces) or whole:
                    break
            k *= 2
        parts = []
        for piece, begin, end in zip(pieces[:meet], begins, begins[1:], strict=False):
            first = int(b_starts[1]) if len(b_starts) > 1 else len(b)
            halves = (
                len(piece) > LONG
                and begin < 0 < end
                and -begin == len(self.text_of(a[a_starts[-1] :]))
                and first <= stop
                and end == places[first]
            )
            parts.append(
                self.within(a[a_starts[-1] :], b[:first])
                if halves
                else np.frombuffer(self.known[piece], np.int32)
            )
        begin_b = borders[int(begins[meet])] if meet < len(pieces) else len(b)
        new_starts = at + _offsets(list(map(len, parts)))
        rest = b_starts[b_starts >= begin_b] - begin_b + new_starts[-1]
        return (
            np.concatenate([a[:at], *parts, b[begin_b:]]),
            np.concatenate([a_starts[:keep], new_starts[:-1], rest]),
        )

    def _settled(self, a: np.ndarray, a_starts: np.ndarray, b: np.ndarray) -> int:
        """How many pre-tokens of the left side nothing to its right can change."""
        keep = max(0, len(a_starts) - BACK)
        if self._marks is None:
            return keep
        # a special token may straddle the join; what precedes it is then the end of a text
        wide = keep
        while wide and len(self.text_of(a[a_starts[wide] :])) < 4 * self.widest:
            wide -= 1
        tail = self.text_of(a[a_starts[wide] :]).decode()
        seen = tail + self.text_of(b[: 4 * self.widest]).decode(errors="ignore")
        if any(m.start() < len(tail) < m.end() for m in self._marks.finditer(seen)):
            return max(0, wide - BACK)
        return keep

    def tree(self, parts: list[Part]) -> np.ndarray:
        """The ids of a text from its parts in order, joined pairwise."""
        while len(parts) > 1:
            odd = [parts[-1]] if len(parts) % 2 else []
            parts = [self.join(*two) for two in zip(parts[::2], parts[1::2], strict=False)] + odd
        return parts[0][0]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text in one go."""
        try:
            return np.frombuffer(b"".join(self.runs(text)), np.int32)
        except _Disagreed:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def decode(self, ids: list[int]) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode(errors="replace")


@lru_cache(maxsize=4)
def codec(spec: str) -> Codec:
    return Codec(spec)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = _offsets([len(r) for r in rows])
    values = np.concatenate(rows) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(values, pa.int32()))


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers that are not negative in as few bytes each as the largest needs, after that count."""
    top = int(numbers.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)


Finish = Callable[[Codec, pa.Array, list[np.ndarray]], pa.RecordBatch]


def _with_ids(coder: Codec, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch({"doc_id": doc_ids, "ids": _lists(ids)})


def _with_digests(coder: Codec, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
    """Ids, how many, their digest, and that of the text they decode to."""
    lists = [x.tolist() for x in ids]
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return pa.record_batch(
        {
            "doc_id": doc_ids,
            "ids": _lists(ids),
            "n_tokens": pa.array([len(x) for x in lists], pa.int64()),
            "ids_sha256": pa.array([sha(b",".join([coder.shown[i] for i in x])) for x in lists], pa.string()),
            "decoded_sha256": pa.array([sha(coder.decode(x).encode()) for x in lists], pa.string()),
        }
    )


def _encoded(spec, finish: Finish, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(spec.value)
        for batch in batches:
            for part in textkit.groups(batch, "text"):
                ids = [coder.encode(t or "") for t in part.column("text").to_pylist()]
                yield finish(coder, part.column("doc_id"), ids).select(names)
        coder.forget()

    return run


def _cut(leaf_chars: int):
    """The leaves of long texts, each cut out once: as many as halving gives, a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column("text")):
                text = text.as_py()
                n = 1
                while n * leaf_chars < len(text):
                    n *= 2
                for at in range(0, n, 64):
                    leaves = range(at, min(n, at + 64))
                    yield pa.record_batch(
                        {
                            "row": pa.array([batch.column("row")[i].as_py()] * len(leaves), pa.int64()),
                            "doc_id": pa.array([batch.column("doc_id")[i].as_py()] * len(leaves), pa.int64()),
                            "leaf": pa.array(leaves, pa.int64()),
                            "text": pa.array(
                                [text[len(text) * k // n : len(text) * (k + 1) // n] for k in leaves], pa.string()
                            ),
                        }
                    )

    return run


def _leaves(spec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(spec.value)
        for batch in batches:
            for part in textkit.groups(batch, "text"):
                ids, starts, texts = [], [], []
                for text in part.column("text").to_pylist():
                    try:
                        found = coder.leaf(text)
                    except _Disagreed:
                        found = None
                    ids.append(_packed(found[0]) if found else None)
                    # the places where pre-tokens begin, each from the one before
                    starts.append(_packed(np.diff(found[1], prepend=0)) if found else None)
                    texts.append(None if found else text)
                yield pa.record_batch(
                    {
                        "row": part.column("row"),
                        "doc_id": part.column("doc_id"),
                        "leaf": part.column("leaf"),
                        "ids": pa.array(ids, pa.binary()),
                        "starts": pa.array(starts, pa.binary()),
                        "odd": pa.array(texts, pa.string()),
                    }
                )
        coder.forget()

    return run


def _joined(spec, finish: Finish, names: list[str]):
    def run(table: pa.Table) -> pa.Table:
        coder = codec(spec.value)
        table = table.sort_by("leaf")
        ids, starts, odd = (table.column(c).to_pylist() for c in ("ids", "starts", "odd"))
        try:
            if any(t is not None for t in odd):
                raise _Disagreed
            whole = coder.tree(
                [
                    (_unpacked(i).astype(np.int32), np.cumsum(_unpacked(s)))
                    for i, s in zip(ids, starts, strict=True)
                ]
            )
        except _Disagreed:
            text = "".join(
                t if t is not None else coder.decode(_unpacked(i).tolist())
                for t, i in zip(odd, ids, strict=True)
            )
            whole = coder.encode(text)
        doc_id = table.column("doc_id").slice(0, 1).combine_chunks()
        return pa.Table.from_batches([finish(coder, doc_id, [whole]).select(names)])

    return run


def encode(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", leaf_chars: int = LEAF) -> DataFrame:
    """(doc_id, ids) of every row's whole text, special tokens neither added nor skipped.

    ``vocabulary`` is the path of a tokenizer file the driver reads; its content
    is broadcast, which its size bounds. A null text counts as empty and has no
    ids; repeated rows and null doc_ids are encoded like any other; other
    columns are not read; no rows give no rows. A text of more than
    ``leaf_chars`` characters travels as leaves, which different tasks encode,
    and only its ids meet again in one task.
    """
    return _finished(docs, vocabulary, doc_id, leaf_chars, _with_ids, "doc_id long, ids array<int>")


def encode_digests(
    docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", leaf_chars: int = LEAF, keep_ids: bool = False
) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row's whole text, and ids if asked for.

    ``encode``, ``decode`` and ``digests`` in the worker that has the ids, which
    then need not leave it. Rows are as ``encode`` has them.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" if keep_ids else ""
    return _finished(docs, vocabulary, doc_id, leaf_chars, _with_digests, schema)


def _finished(docs, vocabulary: str, doc_id: str, leaf_chars: int, finish: Finish, schema: str) -> DataFrame:
    spark = docs.sparkSession
    textkit.whole_texts(spark)
    with open(vocabulary, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    ws = Workspace(spark, "bpe")
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("text").cast("string"))
    size = F.length("text")
    names = [c.split()[0] for c in schema.split(", ")]
    short = texts.where(F.coalesce(size, F.lit(0)) <= leaf_chars)
    long = ws.write(
        texts.where(size > leaf_chars).withColumn("row", F.monotonically_increasing_id()), "long"
    )
    leaves = (
        long.mapInArrow(_cut(leaf_chars), "row long, doc_id long, leaf long, text string")
        .repartition("row", "leaf")
        .mapInArrow(
            _leaves(spec),
            "row long, doc_id long, leaf long, ids binary, starts binary, odd string",
        )
    )
    whole = leaves.groupBy("row").applyInArrow(_joined(spec, finish, names), schema)
    return short.mapInArrow(_encoded(spec, finish, names), schema).union(whole)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text) of rows (doc_id, ids): the bytes of the ids, read as UTF-8.

    Null ids count as none; bytes that are no UTF-8 become U+FFFD.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(spec.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = [coder.decode(x or []) for x in part.column("ids").to_pylist()]
                yield pa.record_batch(
                    {
                        "doc_id": part.column("doc_id"),
                        "ids": part.column("ids"),
                        "text": pa.array(texts, pa.string()),
                    }
                )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")


def digests(decoded: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of decoded rows, with columns to keep."""
    ids = F.coalesce("ids", F.array().cast("array<int>"))
    return decoded.select(
        "doc_id",
        *keep,
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(ids.cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text"), 256).alias("decoded_sha256"),
    )
