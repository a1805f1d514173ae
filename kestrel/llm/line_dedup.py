"""Line dedup by one range-partitioned stream over line hashes.

1. Every document gives one record per distinct line key: a 128-bit hash, the
   document and the positions of the key's lines. No text moves.
2. Records are range-partitioned by (hash, document, first position) and
   sorted so inside each range. Document and position are part of the range
   key, so a key that a third of all documents share is split over ranges.
3. Each range is streamed once. Distinct documents of a run of equal hashes
   are counted as they come, holding back only a run's first records until
   it reaches the limit. Runs that touch a range's edge and are still below
   the limit (fewer records than the limit each) are settled by a small
   aggregate over the edge runs.
4. Records of dropped keys become one compressed keep bitmap per document;
   bitmaps, not texts, are grouped, and meet the texts in one join.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import WHITE, fresh, materialize, row_key

MIN_DOCS = 10
MIN_KEY_CHARS = 1
_STRIP = WHITE.encode()
_RECORD = "h1 bigint, h2 bigint, doc bigint, has_doc boolean, rk bigint, first int, lines binary"
_FOUND = "open boolean, many boolean, h1 bigint, h2 bigint, doc bigint, has_doc boolean, rk bigint, lines binary"


def line_key(line: bytes) -> bytes:
    """Stripped of white space at both ends, A-Z lower-cased (UTF-8 bytes)."""
    return line.strip(_STRIP).lower()


def _records(min_key_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, rk, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                at: dict[bytes, list[int]] = {}
                for i, line in enumerate((text or "").encode().lower().split(b"\n")):
                    key = line.strip(_STRIP)
                    if key and (min_key_chars <= 1 or len(key.decode()) >= min_key_chars):
                        at.setdefault(key, []).append(i)
                for key, lines in at.items():
                    h = xxhash.xxh3_128_intdigest(key)
                    out.append(((h >> 64) - 2**63, (h & (2**64 - 1)) - 2**63, doc or 0, doc is not None, rk, lines[0],
                                np.asarray(lines, np.int32).tobytes()))
                if len(out) >= 20_000:
                    yield _batch(out, _RECORD)
                    out = []
            if out:
                yield _batch(out, _RECORD)
    return run


_TYPES = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(cols, fields)], [n for n, _ in fields])


def _stream(min_docs: int):
    """One sorted range to the records of its dropped keys, and its undecided
    edge runs. At most ``min_docs`` - 1 documents of a run are held back."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, last, held, at_start, out = None, 0, None, [], True, []

        def close(at_end: bool) -> None:
            # (a run that reached the limit was sent on as it came; its edge flag tells the neighbours)
            if key is not None and (at_start or at_end):
                if docs >= min_docs:
                    out.append((True, True, *key, 0, False, 0, b""))
                else:
                    out.extend((True, False, *key, *r) for r in held)

        for batch in batches:
            for h1, h2, doc, has_doc, rk, _, lines in zip(*[c.to_pylist() for c in batch.columns]):
                if (h1, h2) != key:
                    if key is not None:
                        close(False)
                        at_start = False
                    key, docs, last, held = (h1, h2), 0, None, []
                if (doc, has_doc) != last:
                    docs, last = docs + 1, (doc, has_doc)
                    if docs == min_docs:
                        out.extend((False, True, *key, *r) for r in held)
                        held = []
                if docs >= min_docs:
                    out.append((False, True, *key, doc, has_doc, rk, lines))
                else:
                    held.append((doc, has_doc, rk, lines))
                if len(out) >= 20_000:
                    yield _batch(out, _FOUND)
                    out.clear()
        close(True)
        yield _batch(out, _FOUND)
    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, has_doc, rk, runs in zip(*[c.to_pylist() for c in batch.columns]):
            dropped = np.concatenate([np.frombuffer(x, np.int32) for x in runs])
            keep = np.ones(8 * (int(dropped.max()) // 8 + 1), bool)  # lines after these stay
            keep[dropped] = False
            out.append((doc, has_doc, rk, zlib.compress(np.packbits(keep).tobytes(), 1)))
        yield _batch(out, "doc bigint, has_doc boolean, rk bigint, keep binary")


def keep_bitmaps(df: DataFrame, min_docs: int = MIN_DOCS, min_key_chars: int = MIN_KEY_CHARS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(doc, has_doc, rk, keep) for each document that loses a line: ``keep``
    is a zlib-compressed bitmap with 0 for dropped lines, cut after the byte
    with the last of them; ``rk`` is ``row_key`` of the row.

    A line key is dropped if at least ``min_docs`` different ids have it (all
    rows without an id count as one). Lines without a key never go.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(id_col).cast("bigint").alias("doc"), row_key(id_col, text_col).alias("rk"),
                    F.col(text_col).alias("text"))
    order = ["h1", "h2", "doc", "has_doc", "first", "rk"]
    found = materialize(src.mapInArrow(_records(min_key_chars), _RECORD)
                        .repartitionByRange(n, *order).sortWithinPartitions(*order)
                        .mapInArrow(_stream(min_docs), _FOUND))
    edge = found.where("open")
    dropped = (edge.groupBy("h1", "h2").agg(F.max("many").alias("many"), F.countDistinct("doc", "has_doc").alias("docs"))
               .where(F.col("many") | (F.col("docs") >= min_docs)).select("h1", "h2"))
    late = edge.where("not many").join(dropped, ["h1", "h2"], "left_semi")
    own = ["doc", "has_doc", "rk", "lines"]
    return (found.where("not open").select(*own).unionByName(late.select(*own))
            .groupBy("doc", "has_doc", "rk").agg(F.array_distinct(F.collect_list("lines")).alias("runs"))
            .mapInArrow(_bitmaps, "doc bigint, has_doc boolean, rk bigint, keep binary"))


def kept_text(text: str | None, keep: bytes | None) -> tuple[str, int, int]:
    """(text without its dropped lines, lines, dropped lines)."""
    text = text or ""
    n = text.count("\n") + 1
    if keep is None:
        return text, n, 0
    flags = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).view(bool)
    lines = text.split("\n")
    if len(flags) < n:
        flags = np.concatenate([flags, np.ones(n - len(flags), bool)])
    left = [x for x, k in zip(lines, flags) if k]
    return "\n".join(left), n, n - len(left)


def map_kept(df: DataFrame, fn: Callable[[str, int, int], tuple], out_schema: str, keep_cols: list[str],
             min_docs: int = MIN_DOCS, min_key_chars: int = MIN_KEY_CHARS, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``keep_cols`` of every row of ``df`` plus ``fn`` (kept text, lines,
    dropped lines) as the columns of ``out_schema``."""
    used = list(keep_cols)
    for base in ("text", "rk", "doc", "m_doc", "m_has", "m_rk", "keep"):
        used.append(fresh(used, base))
    text, rk, doc, m_doc, m_has, m_rk, keep = used[len(keep_cols):]
    marks = keep_bitmaps(df, min_docs, min_key_chars, id_col, text_col).toDF(m_doc, m_has, m_rk, keep)
    src = df.select(*keep_cols, F.col(text_col).alias(text), F.col(id_col).cast("bigint").alias(doc),
                    row_key(id_col, text_col).alias(rk))
    same = ((F.coalesce(F.col(doc), F.lit(0)) == F.col(m_doc)) & (F.col(doc).isNotNull() == F.col(m_has)) & (F.col(rk) == F.col(m_rk)))
    joined = src.hint("shuffle_hash").join(marks.hint("shuffle_hash"), same, "left").select(*keep_cols, text, keep)
    kept = joined.select(*keep_cols).schema
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.fields), out_schema])
    k = len(keep_cols)
    types = [f.strip().split(" ") for f in out_schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fn(*kept_text(t, b)) for t, b in zip(batch.column(k).to_pylist(), batch.column(k + 1).to_pylist())]
            made = [pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows), types)] if rows else [pa.array([], _TYPES[t]) for _, t in types]
            yield pa.RecordBatch.from_arrays([*batch.columns[:k], *made], [*keep_cols, *[n for n, _ in types]])

    return joined.mapInArrow(run, schema)


def drop_shared_lines(df: DataFrame, min_docs: int = MIN_DOCS, min_key_chars: int = MIN_KEY_CHARS,
                      id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the lines of keys found in ``min_docs`` documents dropped
    from ``text_col``; all rows and other columns stay.

    Null texts become empty; rows with equal ids count as one document but
    each keeps its own lines; equal rows are treated alike; an empty table
    gives an empty one; a text that loses all its lines is empty.
    """
    rest = [c for c in df.columns if c != text_col]
    new = fresh(df.columns, "kept_text")
    out = map_kept(df, lambda text, n, d: (text,), f"{new} string", rest, min_docs, min_key_chars, id_col, text_col)
    return out.select(*[F.col(new).alias(c) if c == text_col else F.col(c) for c in df.columns])
