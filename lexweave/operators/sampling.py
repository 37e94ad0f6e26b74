"""Stratified sample of scored results for labelling by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stratified_sample(results: DataFrame, key: str, count: int = 20, seed: int = 0) -> DataFrame:
    """At most ``count`` scorable rows spread over ``count`` equal-width score bands, by score.

    One row of each band that has any, then others until ``count`` is reached; which ones follows
    a seeded hash of ``key``, so a seed gives the same rows every time. If all scores are equal
    the sample is simple. Adds ``band``. Only ``count`` candidates of a band are ever ranked
    against each other across tasks.
    """
    rows = results.where("scorable")
    low, high = rows.agg(F.min("score"), F.max("score")).first()
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    if low is None or low == high:
        picked = rows.withColumns({"band": F.lit(0).cast("bigint"), "_draw": draw}).orderBy("_draw").limit(count)
        return picked.orderBy("score", key).drop("_draw")
    band = F.least(F.floor((F.col("score") - F.lit(low)) / F.lit(high - low) * F.lit(count)), F.lit(count - 1)).cast("bigint")
    dealt = rows.withColumns({"band": band, "_draw": draw})
    first = dealt.groupBy("band").agg(F.min("_draw").alias("_first")).withColumnRenamed("band", "_band")  # count rows at most
    marked = dealt.join(F.broadcast(first), (F.col("band") == F.col("_band")) & (F.col("_draw") == F.col("_first")), "left")
    picked = marked.orderBy(F.col("_first").isNull(), "_draw").limit(count)
    return picked.drop("_band", "_first", "_draw").orderBy("score", key)


def labelled_set(sample: DataFrame) -> DataFrame:
    """The sample as rows to label: renamed columns and an empty ``reproduces_source``."""
    return sample.select(
        "question_id", F.col("article_url").alias("source_url"), F.col("article_title").alias("source_title"),
        "question", "answer", "score", F.lit("").alias("reproduces_source"),
    )
