"""Sources and sinks.

Readers always take explicit schemas (no inference pass over 100 TB).
Row positions inside files — needed to pair files row by row — come from the
file name, the offset of the split in the file and
``monotonically_increasing_id`` (increasing inside a split), turned into dense
per-dataset positions by the two-level index. CSV with quoted newlines is one
task a file for Spark's own reader; ``quoted_csv`` reads it in byte ranges.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.operators.ordering import dense_index
from kestrel.operators.retrieval import CONTEXT_TYPE
from kestrel.session import ensure_checkpoint_dir
from kestrel.sources.quoted_csv import PLACE as _PLACE
from kestrel.sources.quoted_csv import read_quoted_csv

CSV_OPTS = {"quote": '"', "escape": '"', "multiLine": "true", "ignoreLeadingWhiteSpace": "false",
            "ignoreTrailingWhiteSpace": "false", "emptyValue": "", "nullValue": None}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/kestrel-io/{uuid.uuid4().hex}/{name}"


def _csv_opts() -> dict[str, str]:
    return {k: v for k, v in CSV_OPTS.items() if v is not None}


def _csv_reader(spark, schema, sep=",", header=False):
    r = spark.read.schema(schema).option("sep", sep).option("header", str(header).lower())
    for k, v in CSV_OPTS.items():
        if v is not None:
            r = r.option(k, v)
    return r


def _csv_writer(df, sep=",", header=True):
    w = df.write.option("sep", sep).option("header", str(header).lower())
    for k, v in CSV_OPTS.items():
        if v is not None and k != "multiLine":
            w = w.option(k, v)
    return w


# A1 ---------------------------------------------------------------------------

def read_passages(spark: SparkSession, path: str, fmt: str | None = None, id_type: str = "long", split: bool = True,
                  range_bytes: int | None = None) -> DataFrame:
    """Passage pool → (pid, title, text).

    TSV: columns id, text, title; doubled-quote escaping and quoted newlines;
    any row whose first cell is ``id`` is skipped. JSONL: one {id,title,text}
    object per line; ids may be numbers or strings. ``id_type`` "string"
    keeps ids as they are written; with "long" an id that is no number is an
    error.

    A TSV file is read in byte ranges of ``range_bytes``, quoted newlines or not, by
    two jobs that run at once (see ``quoted_csv``). Without ``split`` Spark's
    multi-line reader takes it: one lazy task a file, stray quotes allowed; but it guesses the
    line end from the first one it sees, and a bare carriage return in a
    quoted field before that costs rows."""
    fmt = fmt or ("jsonl" if path.rstrip("/").endswith(".jsonl") else "tsv")
    if fmt == "jsonl":
        df = spark.read.schema("id string, title string, text string").json(path)
        return df.select(F.col("id").cast(id_type).alias("pid"), "title", "text")
    columns = "id string, text string, title string"
    if split:
        df = read_quoted_csv(spark, path, columns, _csv_opts(), sep="\t", range_bytes=range_bytes)
    else:
        df = _csv_reader(spark, columns, sep="\t").csv(path)
    # like Python's csv module an empty field is "", never null
    return df.where(F.col("id") != "id").select(
        F.col("id").cast(id_type).alias("pid"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("text", F.lit("")).alias("text"))


def write_passages(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    out = df.select(F.col("pid").alias("id"), "text", "title")
    if fmt == "jsonl":
        out.select("id", "title", "text").write.mode("overwrite").json(path)
    else:
        _csv_writer(out, sep="\t", header=True).mode("overwrite").csv(path)


# A2 / A4 ------------------------------------------------------------------------

def dataset_key(name) -> F.Column:
    """Dataset key from a file name: the part after the first '_' up to the
    next '_' or '.' (``oe_nq.csv`` → ``nq``)."""
    return F.regexp_extract(name, r"^[^_]*_([^_.]*)", 1)


def with_positions(df: DataFrame, dataset_col: str = "dataset") -> DataFrame:
    """Add 0-based ``row_id`` = position inside the dataset's files
    (file path order, then order inside the file)."""
    return dense_index(_with_place(df), [F.col(c) for c in _PLACE], group_cols=[dataset_col], out="row_id").drop(*_PLACE)


def _with_place(df: DataFrame) -> DataFrame:
    """Where each row stands: file, offset of its split, order inside that."""
    return (df.withColumn("_file", F.col("_metadata.file_path")).withColumn("_offset", F.col("_metadata.file_block_start"))
            .withColumn("_mono", F.monotonically_increasing_id()))


def read_qa_dir(spark: SparkSession, path: str, schema: str | T.StructType, dropna: bool = True,
                dataset_from: str = "file", split: bool = True, range_bytes: int | None = None) -> DataFrame:
    """Every CSV under ``path`` with a ``dataset`` column (from the file name,
    or from a ``dataset=…`` partition folder); rows with any null dropped, then
    per-dataset ``row_id`` over the remaining rows. ``split`` and
    ``range_bytes`` as in ``read_passages``."""
    if split:
        df = read_quoted_csv(spark, path, schema, _csv_opts(), header=True, range_bytes=range_bytes)
        file_path, file_name = F.col("_file"), F.element_at(F.split("_file", "/"), -1)
    else:
        df = _csv_reader(spark, schema, header=True).csv(path)
        file_path, file_name = F.col("_metadata.file_path"), F.col("_metadata.file_name")
    if dataset_from == "partition":
        ds = F.regexp_extract(file_path, r"dataset=([^/]+)/", 1)
    else:
        ds = dataset_key(file_name)
    df = df.withColumn("dataset", ds)
    if dropna:
        df = df.na.drop("any")
    # positions count the rows that remain, like dropna + a fresh index
    if split:
        return dense_index(df, [F.col(c) for c in _PLACE], group_cols=["dataset"], out="row_id").drop(*_PLACE)
    return with_positions(df)


def pair_datasets(raw: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Align two tables of the same datasets row by row: equi-join on
    (dataset, row_id); the retrieval side may be shorter (inner join)."""
    return raw.join(retrieved, ["dataset", "row_id"], "inner")


# A3 ---------------------------------------------------------------------------

RETRIEVAL_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("q", T.StringType()),
    T.StructField("answer", T.StringType()), T.StructField("contexts", CONTEXT_TYPE)])


def write_retrievals(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_retrievals(spark: SparkSession, path: str, schema: T.StructType = RETRIEVAL_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


RETRIEVAL_ARRAY_SCHEMA = T.StructType([
    T.StructField("q", T.StringType()), T.StructField("y", T.StringType()), T.StructField("x", T.StringType()),
    T.StructField("contexts", T.ArrayType(T.StructType([
        T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
        T.StructField("text", T.StringType()), T.StructField("score", T.DoubleType())])))])


def _in_brackets(indent: int):
    """Objects of one task, a line each, to the lines of one JSON array."""
    def run(batches):
        held, pad = None, " " * indent
        for batch in batches:
            lines = []
            for value in batch.column(0).to_pylist():
                lines.append("[" if held is None else held + ",")
                held = pad + value
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines)], ["value"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held, "]"])], ["value"])
    return run


def write_retrieval_array(df: DataFrame, path: str, indent: int = 4) -> None:
    """Files that hold one JSON array each, an object a line.

    A task writes one file, and the brackets are put around what that very
    task writes (no shuffle in between), so the number of partitions and
    adaptive execution make no difference. Rows stream: a task holds one
    object. A table without rows gives a folder without arrays."""
    objects = df.select(F.to_json(F.struct(*df.columns)).alias("value"))
    lines = objects.mapInArrow(_in_brackets(indent), "value string")
    lines.write.mode("overwrite").option("maxRecordsPerFile", 0).text(path)


def _whole_arrays(spark: SparkSession, path: str) -> None:
    """ValueError if a file goes on behind its array: the JSON reader stops
    at the end of the first value and would not say so."""
    opened = spark.read.text(path).where(F.col("value").startswith("[")).groupBy(F.col("_metadata.file_path").alias("f")).count()
    bad = opened.where("count > 1").orderBy("f").limit(5).collect()
    if bad:
        raise ValueError("more than one JSON array in " + ", ".join(r["f"] for r in bad))


def _read_array(spark: SparkSession, path: str, schema: T.StructType, lines: bool, check: bool) -> DataFrame:
    if lines:
        text = _with_place(spark.read.text(path))
        value = F.rtrim(F.trim("value"), F.lit(","))
        objects = text.where(~value.isin("[", "]", "")).withColumn("o", F.from_json(value, schema, {"mode": "FAILFAST"}))
        return objects.select("o.*", *_PLACE)
    if check:
        _whole_arrays(spark, path)
    return _with_place(spark.read.schema(schema).option("multiLine", "true").json(path))


def read_retrieval_array(spark: SparkSession, path: str, schema: T.StructType = RETRIEVAL_ARRAY_SCHEMA, lines: bool = False,
                         check: bool = True) -> DataFrame:
    """Files that hold one JSON array of {q, y, x, contexts} each, plus
    ``row_id``: the position over all files. Scores may be written as strings.

    With ``lines`` every object stands on a line of its own, as
    ``write_retrieval_array`` writes them: files are split like any text, and a line that is no
    object is an error. Else objects may span lines, a file is one task, and
    ``check`` reads the files' lines first to refuse a second array in a file."""
    wanted = schema
    if schema is RETRIEVAL_ARRAY_SCHEMA:  # numbers are read as their text too
        context = [T.StructField(f.name, T.StringType()) for f in schema["contexts"].dataType.elementType]
        schema = T.StructType([*schema.fields[:-1], T.StructField("contexts", T.ArrayType(T.StructType(context)))])
    rows = dense_index(_read_array(spark, path, schema, lines, check), [F.col(c) for c in _PLACE], out="row_id").drop(*_PLACE)
    return rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted], "row_id")


# A5 ---------------------------------------------------------------------------

EXAMPLE_SCHEMA = T.StructType([
    T.StructField("qid", T.LongType()), T.StructField("question", T.StringType()),
    T.StructField("positive_ctxs", T.ArrayType(T.StructType([T.StructField("title", T.StringType()),
                                                            T.StructField("text", T.StringType())]))),
    T.StructField("negative_ctxs", T.ArrayType(T.StructType([T.StructField("title", T.StringType()),
                                                            T.StructField("text", T.StringType())]))),
    T.StructField("hard_negative_ctxs", T.ArrayType(T.StructType([T.StructField("title", T.StringType()),
                                                                 T.StructField("text", T.StringType())])))])


def read_train_examples(spark: SparkSession, paths: list[str], maxload: int | None = None,
                        schema: T.StructType = EXAMPLE_SCHEMA) -> DataFrame:
    """JSON lines (``.jsonl``) or files of one JSON array (``.json``) from
    several paths, in path order; ``maxload`` caps the cumulative number of
    examples (the cap is the feature)."""
    def load(path: str) -> DataFrame:
        if path.rstrip("/").endswith(".json"):
            return _read_array(spark, path, schema, lines=False, check=True)
        return _with_place(spark.read.schema(schema).json(path))

    parts = [load(p).withColumn("_src", F.lit(i)) for i, p in enumerate(paths)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    if maxload is not None and maxload > 0:
        x = dense_index(df, [F.col(c) for c in ("_src", *_PLACE)], out="_pos")
        df = x.where(F.col("_pos") < maxload).drop("_pos")
    return df.drop("_src", *_PLACE)


# A6 / A7 / A8 --------------------------------------------------------------------

def write_by_dataset(df: DataFrame, path: str, col: str = "dataset", fmt: str = "parquet") -> None:
    """One output folder per dataset value."""
    w = df.write.mode("overwrite").partitionBy(col)
    if fmt == "csv":
        _csv_writer(df, header=True).mode("overwrite").partitionBy(col).csv(path)
    else:
        w.parquet(path)


def skip_if_done(inputs: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``inputs`` whose keys are not in ``done`` yet."""
    return inputs.join(done.select(*keys).distinct(), keys, "left_anti")


def save_vectors(df: DataFrame, path: str, id_col: str = "vec_id", vec: str = "embedding") -> None:
    df.select(id_col, vec).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str, id_col: str = "vec_id", check: bool = True) -> DataFrame:
    """Read vectors back; with ``check`` assert one vector per distinct id."""
    df = spark.read.parquet(path)
    if check:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(id_col).alias("d")).first()
        if r["n"] != r["d"]:
            raise ValueError(f"{r['n']} vectors for {r['d']} ids")
    return df
