"""CSV and TSV whose quoted fields hold newlines, read in parts of a file.

Spark's multi-line reader gives a file to one task, because a newline may stand
inside quotes and only what comes before tells. What comes before is one bit:
whether the number of quotes so far is odd. So

1. a first job counts the quotes of every byte range (aggregated where the
   lines are read, a row a range); the parities of a file's ranges summed in
   order say which ranges begin inside a field;
2. a second job reads the same ranges, marks their lines with that bit by a
   broadcast join, and joins lines to records where they stand. What a range
   has of records that cross its bounds, two pieces at most, is put together by
   a shuffle of these pieces alone;
3. Spark's own CSV parser takes the records one by one (``from_csv``).

Quotes are the double quote, doubled inside a quoted field, and stand nowhere
else; a file that breaks this is refused. The two jobs run at once, under
settings that fix the ranges whatever executors come or go, and the records are
written to the checkpoint folder.

Defined cases: a carriage return before the newline of a record's end belongs to
that end, inside quotes it is kept; a byte order mark goes; empty lines between
records are no records; an empty file or folder has none; a compressed file is
one range.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.session import drop_table, materialize

#: A file system's ranges are at most so many (a marked range is some 20 bytes
#: of a broadcast table): larger inputs get longer ranges.
MOST_RANGES = 1_000_000
PLACE = ["_file", "_offset", "_mono"]
PIECES = "_file string, _offset bigint, _mono bigint, piece string, value string"
WHOLE, HEAD, TAIL, MIDDLE = "whole", "head", "tail", "middle"


def _fixed_ranges(spark: SparkSession, range_bytes: int):
    """Set what decides where Spark cuts files; returns what puts it back."""
    wanted = {"spark.sql.files.maxPartitionBytes": str(range_bytes), "spark.sql.files.minPartitionNum": "1",
              "spark.sql.files.openCostInBytes": str(min(range_bytes, 4 << 20))}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)

    def restore() -> None:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return restore


def _range_bytes(spark: SparkSession, path: str, wanted: int | None) -> int:
    """The wanted length, or a longer one where there would be too many ranges."""
    total = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.sum("length")).first()[0] or 0
    usual = wanted or int(spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(
        spark.conf.get("spark.sql.files.maxPartitionBytes")))
    return max(usual, -(-total // MOST_RANGES), 1)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_offset"), "value")


def _begins_inside(lines: DataFrame) -> DataFrame:
    """(_file, _offset) of the ranges that begin inside a quoted field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = lines.groupBy("_file", "_offset").agg((F.sum(quotes) % 2).alias("odd"))
    # a row a range: a million at most
    before = Window.partitionBy("_file").orderBy("_offset").rowsBetween(Window.unboundedPreceding, -1)
    marked = odd.withColumn("inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    return marked.where("inside").select("_file", "_offset", "inside")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of ranges, in order, to whole records and the pieces at the ends
    of each range."""
    place, held, n, inside, first = None, [], 0, False, False
    out: list[tuple] = []

    def close() -> None:
        if place is not None and held:
            out.append((*place, n, MIDDLE if first else TAIL, "\n".join(held)))

    for batch in batches:
        for file, offset, value, begins in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, offset) != place:
                close()
                place, held, n, inside = (file, offset), [], 0, begins
                first = begins  # the first record began in an earlier range
            held.append(value)
            inside ^= value.count('"') % 2 == 1
            if not inside:
                out.append((*place, n, HEAD if first else WHOLE, "\n".join(held)))
                held, first, n = [], False, n + 1
        yield _batch(out)
        out = []
    close()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = zip(*rows) if rows else [()] * 5
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [*PLACE, "piece", "value"])


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that cross ranges: at the place of their first piece. Pieces
    of one record follow each other; a record begins with a tail."""
    small = pieces.select(*PLACE, "piece")  # two rows a range, without the text
    upto = Window.partitionBy("_file").orderBy("_offset", "_mono").rowsBetween(Window.unboundedPreceding, 0)
    numbered = small.withColumn("record", F.sum((F.col("piece") == TAIL).cast("long")).over(upto)).drop("piece")
    parts = pieces.drop("piece").join(numbered, PLACE)
    whole = parts.groupBy("_file", "record").agg(F.array_sort(F.collect_list(F.struct("_offset", "_mono", "value"))).alias("p"))
    return whole.select("_file", F.col("p")[0]["_offset"].alias("_offset"), F.col("p")[0]["_mono"].alias("_mono"),
                        F.array_join(F.col("p.value"), "\n").alias("value"))


def _well_quoted(record: str, sep: str) -> Column:
    """Quotes open behind a separator, close before one, and are even. Doubled
    quotes say nothing here; without them what is between every other quote
    is outside."""
    bare = F.split(F.replace(F.col(record), F.lit('""'), F.lit("")), '"')
    last = F.size(bare) - 1

    def fits(x, i):
        opens = (i == last) | x.endswith(sep) | ((i == 0) & (x == ""))
        closes = (i == 0) | x.startswith(sep) | ((i == last) & (x == ""))
        return (i % 2 == 1) | (opens & closes)

    return (last % 2 == 0) & F.forall(F.transform(bare, fits), lambda x: x)


def read_records(spark: SparkSession, path: str, sep: str = ",", range_bytes: int | None = None, check: bool = True) -> DataFrame:
    """Records of all files under ``path`` as text: (_file, _offset, _mono,
    record). The three place columns order the records of a file; the record of a
    file's first line is at offset 0 and number 0.

    ``range_bytes`` is the length of a range (the session's
    ``spark.sql.files.maxPartitionBytes`` if not given). ``check`` refuses
    files with quotes in the midst of a field or left open."""
    restore = _fixed_ranges(spark, _range_bytes(spark, path, range_bytes))
    try:
        lines = _lines(spark, path)
        begins = materialize(_begins_inside(lines))
        marked = lines.join(F.broadcast(begins), ["_file", "_offset"], "left").select(
            "_file", "_offset", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
        pieces = materialize(marked.mapInArrow(_cut, PIECES))
    finally:
        restore()
    drop_table(begins)
    records = pieces.where(F.col("piece") == WHOLE).drop("piece").unionByName(_joined(pieces.where(F.col("piece") != WHOLE)))
    top = (F.col("_offset") == 0) & (F.col("_mono") == 0)
    records = records.withColumn("value", F.when(top, F.regexp_replace("value", "^﻿", "")).otherwise(F.col("value")))
    records = records.select(*PLACE, F.regexp_replace("value", "\r$", "").alias("record"))
    if check:
        bad = records.where(~_well_quoted("record", sep)).groupBy("_file").agg(F.min("_offset").alias("o")).orderBy("_file").limit(5).collect()
        if bad:
            raise ValueError("quotes inside a field or left open (split=False reads such files): " + ", ".join(f"{r['_file']} behind byte {r['o']}" for r in bad))
    return records


def read_quoted_csv(spark: SparkSession, path: str, schema: str | T.StructType, options: dict[str, str], sep: str = ",", header: bool = False,
                    range_bytes: int | None = None, check: bool = True) -> DataFrame:
    """Columns of ``schema`` and the three place columns, as the multi-line
    reader gives them with the same ``options`` of Spark's CSV parser. With
    ``header`` the first record of each file is left out."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    records = read_records(spark, path, sep, range_bytes, check).where(F.col("record") != "")
    if header:
        records = records.where((F.col("_offset") > 0) | (F.col("_mono") > 0))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    parsed = F.from_csv("record", fields, {**options, "sep": sep})
    return records.select(*PLACE, parsed.alias("_row")).select("_row.*", *PLACE)

