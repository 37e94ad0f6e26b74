"""Summary of results: one row per article and a grand total."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text import short_label
from lexweave.sources.config import ScoringConfig


def summarise(results: DataFrame, config: ScoringConfig) -> DataFrame:
    """label, article_url, n, scored, mean_score, max_score, over, unscorable, is_total, first_ordinal.

    Scores have six decimals, so they are summed as whole millionths: no split of the rows changes a
    mean. Articles keep the order of their first result and its title; the total has no URL. Mean,
    maximum and ``over`` are null where nothing is scorable. Needs ``ordinal`` in ``results``.
    """
    some = F.col("scorable")
    out = results.rollup("article_url").agg(
        F.grouping("article_url").alias("is_total"),
        F.min("ordinal").alias("first_ordinal"),
        F.min_by("article_title", "ordinal").alias("title"),
        F.count(F.lit(1)).alias("n"),
        F.count_if(some).alias("scored"),
        F.sum(F.when(some, F.bround(F.col("score") * 1_000_000).cast("bigint"))).alias("_millionths"),
        F.max(F.when(some, F.col("score"))).alias("max_score"),
        F.count_if(some & (F.col("score") >= F.lit(config.reuse_threshold))).alias("_over"),
        F.count_if(~some).alias("unscorable"),
    )
    out = out.withColumn("mean_score", F.col("_millionths") / (F.col("scored") * 1_000_000))  # one rounding, of an exact sum
    label = F.when(F.col("is_total") == 1, F.lit("ALL")).otherwise(short_label(F.col("title"), F.col("article_url")))
    out = out.withColumns({"label": label, "over": F.when(F.col("scored") > 0, F.col("_over")), "is_total": F.col("is_total") == 1})
    return out.select("label", "article_url", "n", "scored", "mean_score", "max_score", "over", "unscorable", "is_total", "first_ordinal")


#: What the printed table shows of an article: heading, width, and the cell of a summary row.
COLUMNS = (
    ("answers", 8, lambda r: str(r["n"])),
    ("scorable", 9, lambda r: str(r["scored"])),
    ("mean", 8, lambda r: _decimals(r["mean_score"])),
    ("highest", 8, lambda r: _decimals(r["max_score"])),
    ("reused", 7, lambda r: "-" if r["over"] is None else str(r["over"])),
)


def _decimals(x: float | None) -> str:
    return "-" if x is None else f"{x:.3f}"


def format_summary(results: DataFrame, config: ScoringConfig) -> str:
    """The summary as text for a terminal; rows are one per article."""
    rows = summarise(results, config).orderBy("is_total", "first_ordinal").collect()
    if not rows or rows[-1]["n"] == 0:
        return "No results to report."
    table = [["", *(heading for heading, _, _ in COLUMNS)]]
    table += [[r["label"], *(cell(r) for _, _, cell in COLUMNS)] for r in rows]
    first = max(len(row[0]) for row in table)
    lines = [row[0].ljust(first) + "".join(cell.rjust(width) for cell, (_, width, _) in zip(row[1:], COLUMNS)) for row in table]
    lines.insert(len(lines) - 1, "=" * len(lines[0]))
    notes = [f"Rule {config.version}: shared runs of {config.ngram_size} content words; reused means a score of {config.reuse_threshold:g} or more."]
    if short := rows[-1]["unscorable"]:
        notes.append(f"Without a score, as they have fewer than {config.ngram_size} content words: {short}.")
    return "\n".join([*lines, "", *notes])
