"""Scoring answers as they arrive: a stream of answers against a table of articles.

The overlap of a row needs that row and its article alone, so the stream-static join is all the
state there is: no watermark, no late data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.operators.overlap import last_per_url, with_overlap
from lexweave.sources.config import ScoringConfig


def score_stream(answers: DataFrame, articles: DataFrame, config: ScoringConfig) -> DataFrame:
    """``answers`` (streaming; question_id, article_url, answer) with their scores; needs ``ordinal`` in ``articles``."""
    known = last_per_url(articles).select(F.col("url").alias("article_url"), F.col("text").alias("_source"))
    scored = with_overlap(answers.join(known, "article_url"), "answer", "_source", config)
    return scored.drop("_source").withColumn("score", F.bround("score", 6))
