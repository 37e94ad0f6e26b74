"""The corpus pipeline: five of the training-data operators, one after the other.

Each stage works on everything that its predecessor kept, keeps all columns, whatever their names,
and gives an empty table for an empty one. ``run`` writes each stage's result as
Parquet to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm.common import read_table, stored, temporaries
from lexweave.llm.exact_dedup import drop_exact_duplicates
from lexweave.llm.language_id import UNKNOWN, identify, learn
from lexweave.llm.mixing import mix
from lexweave.llm.ngram_join import drop_near_duplicates
from lexweave.llm.packing import pack
from lexweave.llm.queries import tokenizer_path

#: A document goes if no profile knows its n-grams: no letter at all, or a score below this.
LEAST_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus knows. Text without letters (null and empty, too), or far from every
    profile, goes; rows that repeat an id or a text are judged row by row. Profiles learn from rows with a lang; where
    none has one, nothing is known and nothing stays."""
    found = identify(docs, learn(docs.select("lang", "text")))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the most code points, then the smallest doc_id (null
    last), then the least row by its columns. Null and empty texts are equal; whole repeated rows leave one."""
    return drop_exact_duplicates(docs).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicate links, the one with the smallest doc_id (null last), then the
    smallest set hash and the least row. Documents without words, null texts among them, link with nothing and stay."""
    return drop_near_duplicates(docs).select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that calibrated sampling takes. A null source or lang is a value of its own with a target of its
    own; rows that repeat an id share their fate."""
    return mix(docs).where("sampled").select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of what is left, one row each. A null or empty text is its end id alone; rows that repeat an
    id are documents of their own; an empty table has no piece."""
    pieces = pack(docs, tokenizer_path(), memo_words=100_000)  # its workers stand beside those of the stages before
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Profiles, raking and the tokenizer have no SQL form; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporaries(spark) as outside:
            docs = outside(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
