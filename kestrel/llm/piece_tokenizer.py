"""SentencePiece (merge type) encoding by backtracking, and decoding.

Merge-type encoding joins, again and again, the neighbouring symbols whose
concatenation has the best score. The result is the only token sequence in
which every token encodes to itself and every two neighbours, merged again
from their characters, come out as the same two. So a text is walked from
left to right: an Aho-Corasick automaton lists the tokens at each position;
the longest that is compatible with the token before it is taken; where none
is, the position is marked as failed in a bitfield and the last token is
replaced by its next shorter prefix. Compatibility of a pair is found by
re-merging and remembered.

Texts are cut first where no piece can cross: before a space mark that
follows another character, and around characters that no longer piece
contains (newlines, say). Parts repeat, so their ids are remembered in a
bounded table. Both cuts are derived from the vocabulary.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import fresh

SPACE = "▁"
MEMORY_PARTS = 150_000  # a worker remembers so many words, twice, and so many pairs, at most
LONGEST_PART = 48  # characters of a remembered part


#: Texts on which other normaliser settings than identity, kept white space and a leading mark show.
PROBES = ["", "a", " a", "a ", "  a  b  ", "ﬁ", "Ａ１", "é e\u0301", "a\tb\nc", "\u3000a\u00a0b", "\u200ba"]


def refuse_other_settings(m) -> None:
    """ValueError for a model that normalises in a way ``PieceTokenizer`` does
    not."""
    for text in PROBES:
        want, got = SPACE + text.replace(" ", SPACE) if text else "", m.normalize(text)
        if got != want:
            raise ValueError(f"the model makes {got!r} of {text!r}; only identity normalisation, kept white space and a leading mark are known")


def read_vocabulary(model_path: str) -> list[tuple[str, float, str]]:
    """(piece, score, kind) by id; kind: normal, byte, unknown or control.
    Models with other normaliser settings are refused."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_path)
    refuse_other_settings(m)
    kinds = [(m.is_byte, "byte"), (m.is_unknown, "unknown"), (m.is_control, "control"), (m.is_unused, "unused")]
    return [(m.id_to_piece(i), m.get_score(i), next((k for f, k in kinds if f(i)), "normal"))
            for i in range(m.get_piece_size())]


class PieceTokenizer:
    """For models of merge type with identity normalisation, byte fallback
    and a space mark put in front; white space is kept as it is."""

    def __init__(self, vocabulary: list[tuple[str, float, str]]):
        self.pieces = [p for p, _, _ in vocabulary]
        normal = {p: (i, s) for i, (p, s, k) in enumerate(vocabulary) if k == "normal"}
        self.ids = {p: i for p, (i, _) in normal.items()}
        self.score = {p: s for p, (_, s) in normal.items()}
        self.unknown = next((i for i, v in enumerate(vocabulary) if v[2] == "unknown"), 0)
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(vocabulary) if k == "byte"}
        self.high_byte = {i: b for b, i in self.byte_ids.items() if b >= 0x80}
        self.shown = [" " + p[1:].replace(SPACE, " ") if p.startswith(SPACE) else p.replace(SPACE, " ") for p in self.pieces]
        for i, (p, _, k) in enumerate(vocabulary):
            if k == "byte":  # an ASCII byte is a character wherever it stands
                self.shown[i] = chr(int(p[3:5], 16))
            elif k == "control":
                self.shown[i] = ""
            elif k == "unknown":
                self.shown[i] = " ⁇ "
        longer = [p for p in self.ids if len(p) > 1]
        self.cut_at_space = not any(SPACE in p.lstrip(SPACE) for p in longer)
        inside = set(chain.from_iterable(longer))
        self.cut_at_newline = "\n" not in inside
        self.pairs_inside = {p[i:i + 2] for p in longer for i in range(len(p) - 1)}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.decimal = [str(i) for i in range(len(vocabulary))]
        self.parts: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}  # of parts that are one mark and a word: by the word
        self.older: dict[str, tuple[int, ...]] = {}  # ``words`` before it was full and begun anew
        self.leading = {i for i, v in enumerate(vocabulary) if v[2] == "control"}
        self.automaton = ahocorasick.Automaton()
        for p in self.ids:
            if len(p) == 1 or self.merged(p) == [p]:  # others never come out of merging
                self.automaton.add_word(p, p)
        self.automaton.make_automaton()
        #: the next shorter token that a token begins with; at last its first character
        self.shorter: dict[str, str] = {}
        for p in self.automaton:
            if len(p) > 1:
                self.shorter[p] = next((p[:k] for k in range(len(p) - 1, 1, -1) if p[:k] in self.automaton), p[0])
        self._spaced = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")

    def merged(self, text: str) -> list[str]:
        """Merge the characters of a short text, best score first, leftmost
        of equals."""
        sym = list(text)
        nxt = list(range(1, len(sym) + 1))
        prv = list(range(-1, len(sym) - 1))
        heap: list[tuple[float, int, str]] = []
        score = self.score

        def offer(i: int, j: int) -> None:
            both = sym[i] + sym[j]
            if both in score:
                heapq.heappush(heap, (-score[both], i, both))

        for i in range(len(sym) - 1):
            offer(i, i + 1)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i] if sym[i] else len(sym)
            if j >= len(sym) or sym[i] + sym[j] != both:
                continue
            sym[i], sym[j] = both, ""
            nxt[i] = nxt[j]
            if nxt[j] < len(sym):
                prv[nxt[j]] = i
                offer(i, nxt[i])
            if prv[i] >= 0:
                offer(prv[i], i)
        return [s for s in sym if s]

    def compatible(self, pair: tuple[str, str]) -> bool:
        ok = self.pairs.get(pair)
        if ok is None:
            if len(self.pairs) >= MEMORY_PARTS:
                self.pairs.clear()
            ok = self.pairs[pair] = self.merged(pair[0] + pair[1]) == list(pair)
        return ok

    def backtrack(self, part: str) -> list[str]:
        """The merge encoding of ``part`` as pieces (unknown characters as
        themselves)."""
        n, pairs, matches = len(part), self.pairs.get, self.automaton.iter_long
        shorter, compatible = self.shorter.get, self.compatible
        open_ = bytearray(b"\xff" * (n // 8 + 1))  # a cleared bit: no encoding goes on from here
        taken: list[str] = []
        pos, before, t = 0, None, None
        while True:
            if t is None:  # a new position: its longest token, or the bare character if no token begins there
                end, t = next(matches(part, pos), (pos, ""))
                if end - len(t) + 1 != pos:
                    t = part[pos]
            while t is not None:
                end = pos + len(t)
                if (open_[end >> 3] >> (end & 7) & 1
                        and (before is None or pairs((before, t)) or compatible((before, t)))):
                    break
                t = shorter(t)
            if t is not None:
                taken.append(t)
                if end == n:
                    return taken
                pos, before, t = end, t, None
                continue
            while t is None:  # nothing fits: the last token gives way to its next shorter prefix
                open_[pos >> 3] &= ~(1 << (pos & 7))
                t = taken.pop()
                pos -= len(t)
                t = shorter(t)
            before = taken[-1] if taken else None

    def part_ids(self, part: str) -> tuple[int, ...]:
        ids = self.ids.get
        return tuple(chain.from_iterable([(i,) if (i := ids(t)) is not None else self._outside(t) for t in self.backtrack(part)]))

    def _outside(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode()] if self.byte_ids else [self.unknown]

    def _known(self, part: str) -> tuple[int, ...]:
        got = self.parts.get(part)
        if got is None:
            got = self.part_ids(part)
            if len(part) <= LONGEST_PART:
                if len(self.parts) >= MEMORY_PARTS // 4:
                    self.parts.clear()
                self.parts[part] = got
        return got

    def _known_word(self, word: str) -> tuple[int, ...]:
        """Of a space mark and ``word``."""
        if len(word) > LONGEST_PART:
            return self.part_ids(SPACE + word)
        got = self.older.get(word)
        if got is None:
            if len(word) > 1 and word[-2:] not in self.pairs_inside:  # no piece goes on into the last character
                got = (self.words.get(word[:-1]) or self._known_word(word[:-1])) + self._known(word[-1])
            else:
                got = self.part_ids(SPACE + word)
        if len(self.words) >= MEMORY_PARTS:
            self.words, self.older = {}, self.words
        self.words[word] = got
        return got

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``; the parts that merge on their own are taken from
        memory or encoded, in order."""
        if not text:
            return []
        if not self.cut_at_space:
            whole = SPACE + text.replace(" ", SPACE)
            parts = re.split("(\n)", whole) if self.cut_at_newline else [whole]
            return list(chain.from_iterable([self._known(p) for p in parts if p]))
        miss, flat = self._known_word, chain.from_iterable
        out: list[int] = []
        plain = SPACE not in text and "  " not in text
        for k, line in enumerate(text.split("\n") if self.cut_at_newline else [text]):
            if k:
                out += self._known("\n")
            words = line.split(" ")
            if plain and words[-1] and (words[0] or k):  # marks and words alternate
                if k:
                    if words[0]:
                        out += self._known(words[0])
                    del words[0]
                known = self.words.get
                out += flat([known(w) or miss(w) for w in words])
            else:
                line = line.replace(" ", SPACE)
                out += flat(map(self._known, self._spaced.findall(line if k else SPACE + line)))
        return out

    def listed(self, ids: list[int]) -> str:
        """Decimal ids joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """As the library does: byte pieces in a row are one UTF-8 string
        (what is not valid becomes U+FFFD a byte); the space mark that the
        text begins with goes."""
        out = "".join(map(self.shown.__getitem__, ids)) if self.high_byte.keys().isdisjoint(ids) else self._with_bytes(ids)
        if out.startswith(" "):
            first = next((i for i in ids if i not in self.leading), None)
            if first is not None and self.pieces[first].startswith(SPACE):
                return out[1:]
        return out

    def _with_bytes(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        shown, byte_of = self.shown, self.high_byte
        for i in ids:
            b = byte_of.get(i)
            if b is not None:
                run.append(b)
                continue
            if run:
                out.append(_utf8(run))
                run = bytearray()
            out.append(shown[i])
        if run:
            out.append(_utf8(run))
        return "".join(out)


def _utf8(run: bytearray) -> str:
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(run):  # longest valid character at each byte, else U+FFFD for the byte
            for k in (1, 2, 3, 4):
                try:
                    out.append(run[i:i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_LOADED: dict[int, PieceTokenizer] = {}


def _loaded(vocabulary) -> PieceTokenizer:
    """One tokenizer a worker and broadcast vocabulary."""
    key = vocabulary.id if hasattr(vocabulary, "id") else id(vocabulary)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = PieceTokenizer(vocabulary.value)
    return _LOADED[key]


def _broadcast(df: DataFrame, model_path: str):
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))


def map_tokens(df: DataFrame, model_path: str, fn, out_schema: str, keep_cols: list[str], text_col: str = "text") -> DataFrame:
    """``keep_cols`` of every row plus ``fn(tokenizer, ids)`` as the columns of
    ``out_schema``. The vocabulary (some 32,000 pieces, whatever the data) is
    broadcast."""
    vocabulary = _broadcast(df, model_path)
    src = df.select(*keep_cols, F.col(text_col).alias(fresh(keep_cols, "text__")))
    fields = [x.strip().split(" ") for x in out_schema.split(",")]
    types = {"bigint": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]), out_schema])
    k = len(keep_cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded(vocabulary)
        for batch in batches:
            texts = batch.column(k)
            rows = [fn(tok, tok.encode(texts[i].as_py() or "")) for i in range(len(texts))]
            made = [pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields)] if rows else [pa.array([], types[t]) for _, t in fields]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], [*keep_cols, *[n for n, _ in fields]])

    return src.mapInArrow(run, schema)


def encode(df: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` plus the ids of ``text_col`` (array of int, no begin or end ids).

    Null and empty texts have no ids. Rows are handled one by one: ids, ties
    and repeated rows do not matter, an empty table gives an empty one, other
    columns stay (a column named as ``out`` is told apart by underscores).
    """
    name = fresh(df.columns, out)
    return map_tokens(df, model_path, lambda tok, ids: (ids,), f"{name} array<int>", df.columns, text_col)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` plus the text of ``ids_col`` (null ids: empty; an id outside the
    vocabulary is an error, as in the library)."""
    vocabulary = _broadcast(df, model_path)
    name = fresh(df.columns, out)
    cols, k = df.columns, df.columns.index(ids_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), f"{name} string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _loaded(vocabulary)
        for batch in batches:
            texts = [tok.decode(x or []) for x in batch.column(k).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*cols, name])

    return df.mapInArrow(run, schema)
