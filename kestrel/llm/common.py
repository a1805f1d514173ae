"""Helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.session import materialize, ship_package

#: The white space of every contract: ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
WHITE_CLASS = r"[ \t\n\x0B\f\r]"

__all__ = ["WHITE", "WHITE_CLASS", "drop_table", "empty_if_null", "fresh", "materialize", "row_key",
           "table", "words_of"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name`` with underscores in front until no column has it (Spark
    compares names without case)."""
    have = {c.lower() for c in columns}
    while name.lower() in have:
        name = "_" + name
    return name


def empty_if_null(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c, F.lit(""))


def row_key(id_col: str, text_col: str) -> Column:
    """64-bit key of a row's id and text, to be joined together with the id:
    rows that share an id are told apart by their text, equal rows share it."""
    return F.xxhash64(F.col(id_col), F.col(text_col), F.col(text_col).isNull())


def words_of(text: Column) -> Column:
    """Array of the runs of non-white characters (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WHITE_CLASS + "+"), "")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
