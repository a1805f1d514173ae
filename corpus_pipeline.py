"""Corpus cleaning pipeline over the ``documents`` table: toxicity → line
dedup → near-duplicates → source mixing → token ids.

Every stage is one corpus operator; each but the last returns the columns of
``documents``. A caller may write a stage's result and read it again as the
next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import line_dedup, mixing, near_dups, piece_tokenizer, toxicity
from kestrel.llm.catalog import MIX_EPOCHS, MIX_PERCENT, MIX_SEED, MIX_WEIGHTS, mix_levels, piece_model, token_digest
from kestrel.llm.common import drop_table, materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine, fitted on the labelled ones,
    does not call toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; ``n_chars`` follows."""
    out = line_dedup.drop_shared_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five words, similarity 0.8."""
    return near_dups.drop_near_duplicates(docs, width=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the target weights take it."""
    mixed = mixing.select_mix(docs, mix_levels(), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    return mixing.repeat_copies(mixed).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the text decoded from them."""
    return piece_tokenizer.map_tokens(docs, piece_model(), token_digest,
                                      "n_tokens bigint, ids_sha256 string, decoded_sha256 string",
                                      ["doc_id", "lang", "source"])


STAGES = [("toxicity", reject_toxic), ("line_dedup", drop_shared_lines), ("near_dups", drop_near_duplicates),
          ("mixing", mix_sources), ("sentencepiece", encode)]

#: The fitted first stage has no SQL; tests/llm compares a small fixture with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Stages read their input more than once, so each
    result is written before the next stage begins."""
    docs, written = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
        if written is not None:
            drop_table(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
