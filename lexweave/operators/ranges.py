"""Order over many tasks: groups cut into ranges of their key, so no group and no order is one task.

Spark runs a window without a partition in one task, and one per group in a task per group. Here a
group with more than its share of rows is cut at quantiles of its key. How many cuts there are
follows the number of partitions and never the data, so they and the ranges' ends are broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_PARTITION = 4  # ranges for each shuffle partition, in all
FEW = 1_000_000  # rows of a key and a number that may be broadcast


def _parts(df: DataFrame) -> int:
    return PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _place(df: DataFrame, key: str) -> Column:
    """A number that grows with the key (not strictly): itself, or the first seven bytes of a text."""
    kind = dict(df.dtypes)[key]
    if kind == "string":
        head = F.rpad(F.hex(F.substring(F.encode(F.col(key), "UTF-8"), 1, 7)), 14, "0")
        return F.conv(head, 16, 10).cast("bigint")
    if kind in ("date", "timestamp"):
        return F.unix_micros(F.col(key).cast("timestamp"))
    return F.floor(F.col(key)).cast("bigint")


@dataclass
class Ranges:
    """Where the large groups of a table are cut. ``cuts``: (group, cuts ascending); null if none is large."""

    group: str
    key: str
    cuts: DataFrame | None

    @classmethod
    def of(cls, rows: DataFrame, group: str, key: str) -> Ranges:
        """From the group and key columns alone."""
        parts = _parts(rows)
        own = rows.select(group, _place(rows, key).alias("place"))
        sizes = own.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
        total = sizes.agg(F.sum("n")).first()[0] or 0
        large = sizes.where(F.col("n") > -(-total // parts)).select(group)  # fewer than ``parts`` groups
        many = large.count()
        if not many:
            return cls(group, key, None)
        q = max(2, min(parts, -(-4 * parts // many)))
        shares = [i / q for i in range(1, q)]
        named = large.withColumnRenamed(group, "_large")
        held = own.join(F.broadcast(named), F.col(group).eqNullSafe(F.col("_large")))
        cuts = held.groupBy(group).agg(F.percentile_approx("place", shares, 10 * q).alias("cuts"))
        cuts = cuts.select(F.col(group).alias("_large"), F.array_distinct("cuts").alias("_cuts"))
        return cls(group, key, rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema))

    def seated(self, df: DataFrame, name: str = "_range") -> DataFrame:
        """``df`` with the number of its range inside its group: how many cuts lie below its key."""
        if self.cuts is None:
            return df.withColumn(name, F.lit(0))
        place = _place(df, self.key)
        steps = [1 << b for b in range((2 * _parts(df)).bit_length(), -1, -1)]
        below = F.aggregate(
            F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: at + F.when(F.get("_cuts", at + step - 1) < place, step).otherwise(0)
        )
        found = df.join(F.broadcast(self.cuts), F.col(self.group).eqNullSafe(F.col("_large")), "left")
        return found.select(*df.columns, F.when(F.col("_cuts").isNotNull(), below).otherwise(0).alias(name))

    def with_guests(self, df: DataFrame, keys: DataFrame) -> DataFrame:
        """``df`` with ``_range`` and ``_guest``: the last rows of each range also stand, as guests, in front of the next.

        ``keys``: the same rows' group and key. Rows that share a range's last key are all guests.
        """
        seated = self.seated(df)
        if self.cuts is None:
            return seated.withColumn("_guest", F.lit(False))
        ends = self.seated(keys.select(self.group, self.key)).join(F.broadcast(self.cuts.select("_large")), F.col(self.group).eqNullSafe(F.col("_large")))
        ends = ends.groupBy("_large", "_range").agg(F.max(self.key).alias("_last"))  # a row for each range
        after = Window.partitionBy("_large").orderBy("_range")
        hosts = ends.withColumn("_host", F.lead("_range").over(after)).where("_host IS NOT NULL").select("_large", F.col("_range").alias("_from"), "_last", "_host")
        hosts = df.sparkSession.createDataFrame(hosts.collect(), hosts.schema)
        met = seated.join(F.broadcast(hosts), F.col(self.group).eqNullSafe(F.col("_large")) & (F.col("_range") == F.col("_from")) & (F.col(self.key) == F.col("_last")), "left")
        seat = lambda at, guest: F.struct(F.col(at).alias("_range"), F.lit(guest).alias("_guest"))
        seats = F.when(F.col("_host").isNull(), F.array(seat("_range", False))).otherwise(F.array(seat("_range", False), seat("_host", True)))
        return met.select(*df.columns, F.inline(seats))


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """``df`` with consecutive numbers from 0 by ``order``, nulls first; rows that share a value by a hash of their columns.

    Values are counted, cut into ranges and summed up; only values and numbers are shuffled for
    that. The numbers then join the rows, as a broadcast if there are few. No task sees all rows.
    """
    base = df.select(F.lit(0).alias("_all"), F.col(order).alias("_value"))
    ranges = Ranges.of(base, "_all", "_value")
    counted = base.groupBy("_all", "_value").agg(F.count(F.lit(1)).alias("_n"))
    seated = ranges.seated(counted)
    sums = seated.groupBy("_range").agg(F.sum("_n").alias("n"), F.max("_n").alias("most"), F.count(F.lit(1)).alias("values")).collect()  # a row for each range
    offsets, total = [], 0
    for r in sorted(sums, key=lambda r: r["_range"]):
        offsets.append((r["_range"], total))
        total += r["n"]
    start = df.sparkSession.createDataFrame(offsets, "_range int, _before long")
    order_in = Window.partitionBy("_range").orderBy(F.col("_value").asc_nulls_first())
    number = F.col("_before") + F.sum("_n").over(order_in) - F.col("_n")
    known = seated.join(F.broadcast(start), "_range").select("_value", number.alias("_first"), "_n")
    if sum(r["values"] for r in sums) <= FEW:
        known = F.broadcast(known)
    out = df.join(known, F.col(order).eqNullSafe(F.col("_value")))
    if max((r["most"] for r in sums), default=1) <= 1:
        return out.select(*df.columns, F.col("_first").alias(name))
    orderable = [c for c, kind in df.dtypes if not any(x in kind for x in ("map<", "variant"))]
    tie = Window.partitionBy("_value").orderBy(F.xxhash64(*orderable))
    alone = out.where("_n = 1").select(*df.columns, F.col("_first").alias(name))
    shared = out.where("_n > 1").withColumn("_tie", F.row_number().over(tie) - 1)
    return alone.unionByName(shared.select(*df.columns, (F.col("_first") + F.col("_tie")).alias(name)))
