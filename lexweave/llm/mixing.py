"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic). Token mass per cell is scaled, one
marginal after the other, until the sums over each source, language and topic meet their
targets; what a cell gained or lost is the weight of its documents' tokens. Documents are then
sampled with probability ``min(1, lambda * weight)``, lambda calibrated so that the expected
tokens meet the budget. Everything after the first aggregation runs on the cell table, whose
size is the number of combinations and not of documents; it is cut from its lineage in the
shared folder after each round of sweeps.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import free_name, stored, whole_text

DIMENSIONS = ("source", "lang", "topic")
TEMPER = 0.7  # default targets: shares to this power, so large groups give way to small ones
BUDGET = 0.5  # expected share of all tokens that the sample holds
SWEEPS = 3  # per round
TOLERANCE = 1e-6  # largest relative distance of a marginal from its target
STALL = 0.995  # a round that leaves more than this of the distance gets nowhere: targets contradict each other
BROADCAST_CELLS = 50_000  # cells that are broadcast at most; beyond, the join shuffles
NONE = "(none)"


def n_words(text: str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def topic(text: str = "text") -> Column:
    """Stand-in for a topic column: the register of the whole text, by its letters and length."""
    whole, words = whole_text(text), n_words(text)
    symbols = F.length(F.regexp_replace(whole, r"[\p{L}\p{N}.,\s]+", ""))  # runs, not characters: few matches a text
    return (
        F.when(words == 0, "empty")
        .when(symbols * 8 > F.length(whole), "symbolic")
        .when(~whole.rlike(r"\p{Ll}") & whole.rlike(r"\p{Lu}"), "capitals")
        .when(words < 100, "note")
        .when(words < 1000, "article")
        .otherwise("long")
    )


def cell_table(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, mass, docs); null categories are ``(none)``."""
    return docs.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").cast("double").alias("mass"), F.count(F.lit(1)).alias("docs"))


def default_targets(cells: DataFrame, power: float = TEMPER) -> dict[str, DataFrame]:
    """For each dimension (value, share): tempered shares of the token mass."""
    out = {}
    for d in DIMENSIONS:
        sums = cells.groupBy(F.col(d).alias("value")).agg(F.sum("mass").alias("mass")).where("mass > 0")
        total = sums.agg(F.sum(F.pow("mass", F.lit(power)))).first()[0] or 1.0
        out[d] = sums.select("value", (F.pow("mass", F.lit(power)) / F.lit(total)).alias("share"))
    return out


class ContradictingTargets(ValueError):
    """No weights can meet all targets."""


def rake(cells: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE, strict: bool = True) -> DataFrame:
    """``cells`` with ``share``, the fitted share of each cell.

    A value that a target lacks gets share 0; targets are scaled to the values that occur. Cells
    without mass keep share 0. Sweeps go on until every marginal is within ``tolerance`` of its
    target. Where cells that don't occur make targets contradict each other, the distance stops
    falling: that raises :class:`ContradictingTargets`, or, if not ``strict``, warns and returns
    the last fit.
    """
    table = cells.where("mass > 0")
    for d in DIMENSIONS:
        named = targets[d].select(F.col("value").alias(d), F.col("share").alias(f"t_{d}"))
        table = table.join(named, d, "left").fillna({f"t_{d}": 0.0})
    table = stored(table.withColumn("share", F.col("mass")), "mix_cells")
    if table.isEmpty():
        return table
    totals = {}
    for d in DIMENSIONS:
        totals[d] = table.groupBy(d).agg(F.first(f"t_{d}").alias("t")).agg(F.sum("t")).first()[0] or 1.0
    goal = {d: F.col(f"t_{d}") / F.lit(totals[d]) for d in DIMENSIONS}
    before = None
    while True:
        for _ in range(SWEEPS):
            for d in DIMENSIONS:
                own = F.sum("share").over(Window.partitionBy(d))
                table = table.withColumn("share", F.when(own > 0, F.col("share") * goal[d] / own).otherwise(0.0))
        gaps = {f"gap_{d}": F.abs(F.sum("share").over(Window.partitionBy(d)) - goal[d]) / F.greatest(goal[d], F.lit(1e-12)) for d in DIMENSIONS[:-1]}
        table = stored(table.withColumns(gaps), "mix_round")  # the last dimension was met just now
        away = table.agg(F.max(F.greatest(*gaps))).first()[0] or 0.0
        table = table.drop(*gaps)
        if away <= tolerance:
            return table
        if before is not None and away > before * STALL:
            said = f"targets contradict each other: a marginal stays {away:.3g} of its target away"
            if strict:
                raise ContradictingTargets(said)
            warnings.warn(said, stacklevel=2)
            return table
        before = away


def calibrate(fitted: DataFrame, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, weight, probability): the budget met in expectation, no probability over 1.

    ``weight`` is 1 on average over tokens. Cells at probability 1 hand their surplus to the rest.
    """
    total = fitted.agg(F.sum("mass")).first()[0] or 0.0
    weighted = fitted.withColumn("weight", F.col("share") * F.lit(total) / F.col("mass"))
    goal, factor = total * min(max(budget, 0.0), 1.0), None
    while True:
        full = F.lit(False) if factor is None else F.col("weight") * factor >= 1
        fixed, free = weighted.agg(F.sum(F.when(full, F.col("mass"))), F.sum(F.when(~full, F.col("mass") * F.col("weight")))).first()
        new = max(0.0, goal - (fixed or 0.0)) / free if free else factor or 0.0
        if factor is not None and new <= factor * (1 + 1e-12):
            break
        factor = new
    return weighted.select(*DIMENSIONS, "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(factor)).alias("probability"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, budget: float = BUDGET, seed: int = 0) -> DataFrame:
    """``docs`` with n_tokens, topic, weight, probability and sampled.

    ``docs`` needs doc_id, text, source and lang; a ``topic`` column of its own is used, else the
    text's register stands in. Null source, language or topic is the category ``(none)``, a null
    text has no tokens. Documents of cells without tokens have weight 1 and the budget as their
    probability. Whether a document is sampled depends on its doc_id and the seed only, so
    repeated rows share their fate and a rerun gives the same sample. Columns that carry one of
    the new names are replaced. An empty table gives an empty result.
    """
    own_topic = F.col("topic") if "topic" in docs.columns else topic()
    base = docs.drop("n_tokens", "weight", "probability", "sampled").withColumns({"n_tokens": n_words(), "topic": own_topic})
    named = {d: free_name(base, f"cell_{d}") for d in DIMENSIONS}
    category = {named[d]: F.coalesce(F.col(d).cast("string"), F.lit(NONE)) for d in DIMENSIONS}
    cells = stored(cell_table(base.select("n_tokens", *[category[named[d]].alias(d) for d in DIMENSIONS])), "mix_mass")
    # tempered shares of a corpus can contradict each other; targets that a caller names mustn't
    fitted = rake(cells, targets or default_targets(cells), strict=targets is not None)
    rates = stored(calibrate(fitted, budget).select(*[F.col(d).alias(named[d]) for d in DIMENSIONS], "weight", "probability"), "mix_rates")
    if rates.count() <= BROADCAST_CELLS:
        rates = F.broadcast(rates)
    out = base.withColumns(category).join(rates, list(category), "left").drop(*category)
    chance = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    out = out.fillna({"weight": 1.0, "probability": float(min(max(budget, 0.0), 1.0))})
    return out.withColumn("sampled", chance < F.col("probability"))
