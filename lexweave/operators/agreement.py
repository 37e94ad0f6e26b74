"""Agreement between the reuse threshold and labels given by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.sources.config import ScoringConfig

#: What counts as yes and no in the label column.
YES = ["yes", "y", "true", "1"]
NO = ["no", "n", "false", "0"]


class NoLabels(Exception):
    """The labelled set has no label."""


def parsed_label(raw: Column) -> Column:
    """True, false, or null for anything else."""
    word = F.lower(F.trim(F.coalesce(raw.cast("string"), F.lit(""))))
    return F.when(word.isin(YES), F.lit(True)).when(word.isin(NO), F.lit(False))


def agreement(rows: DataFrame, threshold: float, label: str = "reproduces_source", score: str = "score") -> DataFrame:
    """One row: tp, fp, tn, fn, labelled, unlabelled, accuracy, precision, recall, kappa.

    Ratios without a denominator are NaN. Rows without a label are counted and left out.
    """
    said = parsed_label(F.col(label))
    over = F.col(score).cast("double") >= F.lit(float(threshold))
    counts = rows.agg(
        F.count_if(said & over).alias("tp"), F.count_if(~said & over).alias("fp"),
        F.count_if(~said & ~over).alias("tn"), F.count_if(said & ~over).alias("fn"), F.count_if(said.isNull()).alias("unlabelled"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    nan = F.lit(float("nan"))

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / F.nullif(b, F.lit(0))).otherwise(nan)

    # the chance that both say yes or both say no, as counts over n squared
    chance = (tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)
    kappa = F.when((n > 0) & (chance != n * n), ((tp + tn) * n - chance) / F.nullif(n * n - chance, F.lit(0))).otherwise(nan)
    return counts.select(
        "tp", "fp", "tn", "fn", n.alias("labelled"), "unlabelled", ratio(tp + tn, n).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), kappa.alias("kappa"),
    )


def format_agreement(rows: DataFrame, config: ScoringConfig) -> str:
    """Counts and ratios as text, one outcome a line."""
    a = agreement(rows, config.reuse_threshold).first()
    if not a["labelled"]:
        raise NoLabels("no label found; fill the reproduces_source column with yes or no")
    outcomes = (("tp", "reuse found, label yes"), ("fp", "reuse found, label no"), ("fn", "no reuse found, label yes"), ("tn", "no reuse found, label no"))
    counts = [f"{about:.<32}{a[name]:.>8}" for name, about in outcomes]
    ratios = [f"{name:.<32}{a[name]:.>8.3f}" for name in ("accuracy", "precision", "recall", "kappa")]
    head = f"Rule {config.version} against {a['labelled']} labels, reuse from {config.reuse_threshold:g} on"
    return "\n".join([f"{head} ({a['unlabelled']} rows have no label)" if a["unlabelled"] else head, *counts, *ratios])
