"""Costly calls for every distinct prompt (J1): in flight together, retried,
committed wave by wave.

``call_stage`` asks for each distinct prompt once. Prompts that have an answer
in the result folder are left out; the rest go in waves of bounded size. A task
keeps at most ``in_flight`` calls open, and a wave runs in ``tasks`` tasks, so at most
their product is open at once. A call that raises is made again after a wait
that doubles (with a share that hangs on prompt and attempt, so that retries
do not come together); after ``attempts`` calls the last error is the answer.

Each wave is a folder of its own and counts once its ``_SUCCESS`` mark is
there. A lost executor repeats its tasks of one wave, a lost driver the wave it was in;
what is committed is not asked again. Every distinct prompt ends with exactly
one row: a value, or an error.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import drop_table, materialize

WAVE_ROWS = 100_000


def _ask(call: Callable, prompt: str, attempts: int, wait: float, longest: float) -> tuple:
    """(value, error, calls made)."""
    import random
    import time

    error = ""
    for attempt in range(1, attempts + 1):
        try:
            return call(prompt, attempt), None, attempt
        except Exception as e:  # whatever a client raises is an answer to this prompt
            error = f"{type(e).__name__}: {e}"
        if attempt < attempts:
            share = random.Random(f"{prompt}-{attempt}").random()
            time.sleep(min(longest, wait * 2 ** (attempt - 1)) * (0.5 + share / 2))
    return None, error, attempts


def _calls(call: Callable, kind: pa.DataType, in_flight: int, attempts: int, wait: float, longest: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            for batch in batches:
                got = list(pool.map(lambda p: _ask(call, p, attempts, wait, longest), batch.column(1).to_pylist()))
                value, error, made = zip(*got) if got else ((), (), ())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value, kind), pa.array(error, pa.string()), pa.array(made, pa.int32())],
                                                 ["pkey", "value", "error", "calls"])
    return run


def committed(spark: SparkSession, folder: str, kind: str = "double") -> DataFrame:
    """(pkey, value, error, calls) of the folder's finished waves, one row
    for each prompt: a value before an error."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    waves = [str(s.getPath()) for s in fs.listStatus(path)] if fs.exists(path) else []
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    whole = sorted(w for w in waves if fs.exists(hadoop_path(f"{w}/_SUCCESS")))
    schema = f"pkey string, value {kind}, error string, calls int"
    if not whole:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*whole)
    first = F.min_by(F.struct("value", "error", "calls"), F.struct(F.col("error").isNotNull(), F.col("calls"), F.col("error")))
    return rows.groupBy("pkey").agg(first.alias("r")).select("pkey", "r.*")


def call_stage(df: DataFrame, prompt: str, call: Callable[[str, int], object], folder: str, out: str = "value", kind: str = "double",
               in_flight: int = 16, tasks: int | None = None, attempts: int = 4, wait: float = 0.5, longest: float = 30.0,
               wave_rows: int = WAVE_ROWS, again: bool = False) -> DataFrame:
    """``df`` plus ``out``, ``out_error`` and ``out_calls``: what ``call``
    (prompt, number of the attempt) gave for each row's prompt.

    Null prompts are not asked (three nulls). Answers of earlier runs in ``folder`` are kept;
    with ``again`` prompts that ended with an error are asked once more."""
    spark = df.sparkSession
    keyed = df.withColumn("_pkey", F.md5(F.col(prompt)))
    asked = keyed.where(F.col("_pkey").isNotNull()).select(F.col("_pkey").alias("pkey"), F.col(prompt).alias("prompt")).dropDuplicates(["pkey"])
    have = committed(spark, folder, kind)
    todo = materialize(asked.join(have.where("error is null") if again else have, "pkey", "left_anti"))
    waves = -(-todo.count() // wave_rows)
    tasks = tasks or spark.sparkContext.defaultParallelism
    for w in range(waves):
        part = todo.where(F.pmod(F.xxhash64("pkey"), F.lit(waves)) == w).repartition(tasks, "pkey")
        done = part.mapInArrow(_calls(call, _arrow(kind), in_flight, attempts, wait, longest), f"pkey string, value {kind}, error string, calls int")
        done.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{folder}/wave-{uuid.uuid4().hex}")
    drop_table(todo)
    answers = committed(spark, folder, kind).select(
        F.col("pkey").alias("_pkey"), F.col("value").alias(out), F.col("error").alias(f"{out}_error"), F.col("calls").alias(f"{out}_calls"))
    return keyed.join(answers, "_pkey", "left").drop("_pkey")


def _arrow(kind: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return to_arrow_type(StructType.fromDDL(f"v {kind}")["v"].dataType)
