"""Corpus pipeline: the stages a training corpus goes through, in order.

Each stage works on every row its predecessor kept and is written as Parquet
before the next one reads it.  All but the last return the columns of
``documents``; the last adds the piece ids of every remaining text.

Defined results: rows with a null or empty text pass through whatever does not
reject them and end with no pieces; rows with a null id are nobody's duplicate;
of rows that repeat an id and a text one stays; an empty table gives an empty
result; further columns, whatever their names, are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlens.llm import neardup, pieces, quality, suffixes, templates
from leadlens.llm.common import written
from leadlens.llm.queries import tokenizer_file


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.keep_one(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere are cut out of the texts."""
    return suffixes.remove_repeats(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return templates.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded under merge-dropout; pieces and their number join the columns."""
    encoded = pieces.add_pieces(docs, tokenizer_file("piece_bpe_32k.model"))
    return encoded.select(*[F.col("row")[c].alias(c) for c in docs.columns], "pieces",
                          F.size("pieces").cast("long").alias("n_pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", suffix_stage),
    ("benchmark decontamination", decontamination_stage),
    ("SentencePiece encoding", encoding_stage),
]

# Classifier training, similarity components and merge-dropout have no SQL form.  tests/llm/test_pipeline.py
# holds every stage against brute force over the rows it was given (the classifier: against its own scores).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name.split()[0].lower()}")
    return docs
