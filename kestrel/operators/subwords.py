"""Sub-word ids behind the token limits of H12 and H17: ranked pair merging
over a published byte vocabulary.

A vocabulary is a file of ranks (base64 of the token's bytes, a space, its id
a line). Text is cut into words by the vocabulary's pattern; in each word the two
neighbours whose join has the lowest id are merged until no join is a token.
Words are encoded apart from each other, so a document needs no shuffle: rows
stay where they are read, and a worker remembers the words it has met, a
bounded number of them. The vocabulary, some 50,000 tokens whatever the
data, is broadcast.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

# Fixed value: the published pattern of the byte vocabularies of 50,000 tokens.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

REMEMBERED = 200_000  # words a worker remembers at most
HANDLED = 256  # texts of a batch that are Python objects at one time
LONGEST = 64  # characters of a remembered word


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, id) of a rank file on the driver's machine."""
    with open(path, "rb") as f:
        return [(base64.b64decode(token), int(rank)) for token, rank in (line.split() for line in f if line.strip())]


class PairMerger:
    """Ids of words, and their bytes back."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str = WORDS):
        self.rank = dict(ranks)
        self.token = {i: t for t, i in ranks}
        lacking = [b for b in range(256) if bytes([b]) not in self.rank]
        if lacking:
            raise ValueError(f"the vocabulary lacks {len(lacking)} of the 256 bytes")
        self.words = regex.compile(pattern)
        self.known: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Lowest id first, leftmost of equals. ``stop[i]`` is where the token
        that begins at ``i`` ends; 0 once it has gone into its left
        neighbour."""
        whole = self.rank.get(word)
        if whole is not None:
            return [whole]
        n, rank = len(word), self.rank
        stop, left = list(range(1, n + 1)), list(range(-1, n - 1))
        joins = [(rank[word[i:i + 2]], i, i + 2) for i in range(n - 1) if word[i:i + 2] in rank]
        heapq.heapify(joins)
        while joins:
            _, i, end = heapq.heappop(joins)
            j = stop[i]
            if not j or j >= n or stop[j] != end:
                continue  # one of the two has changed since
            stop[i], stop[j] = end, 0
            if end < n:
                left[end] = i
            for a, b in ((i, stop[end] if end < n else 0), (left[i], end)):
                if a >= 0 and b and (r := rank.get(word[a:b])) is not None:
                    heapq.heappush(joins, (r, a, b))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i:stop[i]]])
            i = stop[i]
        return out

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        for m in self.words.finditer(text):
            word = m.group()
            ids = self.known.get(word)
            if ids is None:
                ids = self.merge(word.encode())
                if len(word) <= LONGEST:
                    if len(self.known) >= REMEMBERED:
                        self.known.clear()
                    self.known[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8, as a cut inside a character leaves them,
        become U+FFFD."""
        return b"".join([self.token[i] for i in ids]).decode("utf-8", "replace")


_LOADED: dict[tuple, PairMerger] = {}


def _merger(ranks, mark: str, pattern: str) -> PairMerger:
    """The worker's only one: of the last vocabulary and pattern it met."""
    if (mark, pattern) not in _LOADED:
        _LOADED.clear()
        _LOADED[mark, pattern] = PairMerger(ranks.value, pattern)
    return _LOADED[mark, pattern]


def _with_column(batch: pa.RecordBatch, k: int, out: str, fn, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """The batch in parts, each with ``fn`` of its column ``k``."""
    for at in range(0, batch.num_rows, HANDLED):
        part = batch.slice(at, HANDLED)
        made = pa.array([None if x is None else fn(x) for x in part.column(k).to_pylist()], kind)
        yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])


def _mapped(df: DataFrame, col: str, out: str, kind: str, path: str, pattern: str, fn) -> DataFrame:
    if out in df.columns:
        raise ValueError(f"there is a column {out} already")
    tokens = read_ranks(path)
    mark = hashlib.sha256(repr(tokens).encode()).hexdigest()
    ranks = df.sparkSession.sparkContext.broadcast(tokens)
    arrow = {"array<int>": pa.list_(pa.int32()), "string": pa.string()}[kind]
    k = df.columns.index(col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _merger(ranks, mark, pattern)
        for batch in batches:
            yield from _with_column(batch, k, out, lambda x: fn(m, x), arrow)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*fields, f"`{out}` {kind}"]))


def encode_subwords(df: DataFrame, text: str, path: str, out: str = "tokens", pattern: str = WORDS) -> DataFrame:
    """``df`` plus the sub-word ids of ``text`` (array of int).

    Null text: null; empty text: no ids. Every row is handled by itself, so repeated
    rows get equal ids and an empty table stays empty. A column named as ``out``
    is an error."""
    return _mapped(df, text, out, "array<int>", path, pattern, PairMerger.encode)


def decode_subwords(df: DataFrame, ids: str, path: str, out: str = "text", pattern: str = WORDS) -> DataFrame:
    """``df`` plus the text of ``ids``: what ``encode_subwords`` was given, if
    all its ids are there. An id outside the vocabulary is an error."""
    return _mapped(df, ids, out, "string", path, pattern, PairMerger.decode)

