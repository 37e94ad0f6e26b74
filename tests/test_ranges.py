"""Order over ranges against plain Python: hot groups, repeated, null and text keys, empty tables."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lexweave.operators.ranges import Ranges, numbered


def rows(seed, n=400, text=False):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        group = rng.choice(["hot"] * 6 + [None, "a", "b", *map(str, range(30))])
        key = rng.randrange(-300, 300)
        out.append((group, f"k{key:04d}" if text else key, f"{i}"))
    return out


@pytest.mark.parametrize("text", [False, True])
def test_rows_before(spark, text):
    """Each row beside the one before it, whatever range that one is in."""
    from pyspark.sql import Window

    data = rows(3, text=text)
    df = spark.createDataFrame(data, f"g string, k {'string' if text else 'long'}, v string").repartition(3)
    ranges = Ranges.of(df, "g", "k")
    seated = ranges.with_guests(df, df)
    per_task = seated.groupBy("g", "_range").count().collect()
    hot = [r["count"] for r in per_task if r["g"] == "hot"]
    assert len(hot) > 4 and max(hot) < len(data) / 4  # the hot group is no single task
    order = Window.partitionBy("g", "_range").orderBy("k", "v")
    got = seated.withColumn("before", F.lag("v").over(order)).where("NOT _guest").select("g", "k", "v", "before").collect()
    want, last = [], {}
    for g, k, v in sorted(data, key=lambda r: (r[0] or "", r[1], r[2])):
        want.append((g, k, v, last.get(g)))
        last[g] = v
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_small_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 1), ("b", None)], "g string, k long")
    seated = Ranges.of(df, "g", "k").with_guests(df, df)
    assert sorted((r["g"], r["k"]) for r in seated.where("NOT _guest").collect()) == [("a", 1), ("b", None)]
    none = df.limit(0)
    assert Ranges.of(none, "g", "k").with_guests(none, none).count() == 0
    assert numbered(none, "k", "n").count() == 0


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_numbers(spark, monkeypatch, few):
    from lexweave.operators import ranges as R

    monkeypatch.setattr(R, "FEW", few)
    rng = random.Random(5)
    keys = [rng.randrange(150) for _ in range(300)] + [None, None]
    df = spark.createDataFrame([(k, f"text {i}", {"a": i}) for i, k in enumerate(keys)], "ordinal long, text string, m map<string,int>").repartition(4)
    got = sorted(numbered(df, "ordinal", "n").collect(), key=lambda r: r["n"])
    assert [r["n"] for r in got] == list(range(302)) and len({r["text"] for r in got}) == 302
    assert [r["ordinal"] for r in got] == sorted(keys, key=lambda k: (k is not None, k or 0))
    days = spark.createDataFrame([(date(2020, 1, 1) + timedelta(days=i),) for i in range(50)], "ordinal date").repartition(3)
    assert [r["n"] for r in numbered(days, "ordinal", "n").orderBy("ordinal").collect()] == list(range(50))


def test_numbering_leaves_texts_where_they_are(spark):
    """No window without a partition; what is sorted or dealt holds values and numbers alone."""
    df = spark.createDataFrame([(i, "long text " * 50) for i in range(100)], "ordinal long, text string").repartition(3)
    df.write.mode("overwrite").format("noop").save()
    plan = numbered(df, "ordinal", "n")._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        if "Window" in line or "Exchange" in line and "REPARTITION" not in line:
            assert "text#" not in line, line
    assert "windowspecdefinition(_value" not in plan and "SinglePartition" not in plan


def test_rows_that_repeat_a_key(spark):
    """Scores of repeated keys are the same however rows are dealt."""
    from lexweave.operators.overlap import previous_scores
    from lexweave.sources.config import ScoringConfig

    rule = ScoringConfig.load()
    data = [("s", 1, "one two three four five six"), ("s", 1, "seven eight nine ten eleven"), ("s", 2, "one two three four five six"), ("s", None, "left out"), (None, 3, "x"), (None, 4, "seven eight nine ten")]
    seen = set()
    for parts in (1, 2, 5):
        df = spark.createDataFrame(data, "g string, k long, t string").repartition(parts)
        out = previous_scores(df, "g", "k", "t", rule)
        seen.add(tuple(sorted(repr((r["g"], r["k"], r["source_key"], r["matched_ngrams"], r["total_ngrams"])) for r in out.collect())))
    assert len(seen) == 1 and len(next(iter(seen))) == 3
