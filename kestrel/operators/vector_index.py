"""A stored product-quantised index that takes additions.

A folder holds the codebooks, written once, and for every addition a folder
of packed codes (a byte for each sub-vector up to 256 centroids) beside the
number of vectors that went into it. Later vectors are encoded with the stored
books. Opening the index checks that all additions are whole and that no id
stands twice.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators.retrieval import pq_encode, pq_topk


@dataclass
class VectorIndex:
    """``codes`` (pid, codes) and the ``books`` (m, centroids, width)."""

    folder: str
    codes: DataFrame
    books: np.ndarray

    @property
    def spark(self) -> SparkSession:
        return self.codes.sparkSession

    def search(self, queries: DataFrame, k: int, qid: str = "qid", vec: str = "embedding") -> DataFrame:
        return pq_topk(self.codes, self.books, queries, k, qid, vec)

    def add(self, vectors: DataFrame, pid: str = "pid", vec: str = "embedding") -> "VectorIndex":
        """Encode ``vectors`` with the stored books and open the index anew.
        ValueError if an id is already there (or twice in ``vectors``): the
        addition is then not counted."""
        own, name = vectors.select(F.col(pid).alias("pid"), F.col(vec).alias("vec")).where("vec is not null"), uuid.uuid4().hex
        wide = self.books.shape[1] > 256
        codes = pq_encode(own, self.books, "pid", "vec")
        packed = codes if wide else codes.select("pid", F.unhex(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), "")).alias("codes"))
        path = f"{self.folder}/codes/{name}"
        packed.write.parquet(path)
        new = self.spark.read.parquet(path).select("pid")
        if new.count() != new.distinct().count() or not new.join(self.codes.select("pid"), "pid", "left_semi").isEmpty():
            raise ValueError("ids that the index already has")
        # counted last: an addition that was cut off does not belong to the index
        self.spark.createDataFrame([(name, new.count())], "addition string, n long").coalesce(1).write.mode("append").parquet(f"{self.folder}/additions")
        return open_vector_index(self.spark, self.folder)


def create_vector_index(spark: SparkSession, folder: str, books: np.ndarray) -> VectorIndex:
    """An empty index with these codebooks."""
    rows = [(s, c, [float(x) for x in books[s, c]]) for s in range(books.shape[0]) for c in range(books.shape[1])]
    spark.createDataFrame(rows, "part int, code int, centre array<double>").coalesce(1).write.parquet(f"{folder}/books")
    spark.createDataFrame([], "addition string, n long").coalesce(1).write.parquet(f"{folder}/additions")
    return open_vector_index(spark, folder)


def open_vector_index(spark: SparkSession, folder: str) -> VectorIndex:
    """ValueError if the codes of an addition are not as many as were
    counted, or an id stands twice."""
    rows = sorted(spark.read.parquet(f"{folder}/books").collect(), key=lambda r: (r["part"], r["code"]))  # m × centroids rows
    m = rows[-1]["part"] + 1
    books = np.array([r["centre"] for r in rows]).reshape(m, len(rows) // m, -1)
    added = spark.read.parquet(f"{folder}/additions").collect()  # a row for each addition
    wide = books.shape[1] > 256
    if not added:
        return VectorIndex(folder, spark.createDataFrame([], "pid long, codes array<int>"), books)
    stored = spark.read.parquet(*[f"{folder}/codes/{r['addition']}" for r in added])
    size = stored.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("pid").alias("ids")).first()
    if size["n"] != sum(r["n"] for r in added) or size["ids"] != size["n"]:
        raise ValueError(f"{size['n']} vectors and {size['ids']} ids, {sum(r['n'] for r in added)} were written under {folder}")
    place = F.sequence(F.lit(0), F.lit(m - 1))
    codes = stored if wide else stored.select("pid", F.transform(place, lambda i: F.conv(
        F.substr(F.hex("codes"), 2 * i + 1, F.lit(2)), 16, 10).cast("int")).alias("codes"))
    return VectorIndex(folder, codes, books)
