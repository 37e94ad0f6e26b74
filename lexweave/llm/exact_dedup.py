"""Exact de-duplication over an extendible-hash index on shared files.

Four steps, all DataFrame expressions:

1. **Keys.** Every document gets the 64-bit hash of its text without white space, the SHA-256
   of the same, its length and its id. This narrow table goes to the shared folder. A *slot* is
   a distinct hash.
2. **Directory.** Slots are counted by hash prefix. A bucket that holds more slots than
   ``capacity`` is split by doubling its address space: one more bit of the hash, again and
   again until no bucket is overfull. Every round looks at overfull buckets only. A look-up
   finds the bucket of a hash through the directory's root, the first bits that all buckets share,
   and the page of buckets below it.
3. **Index.** Only texts of slots with several rows move, and once: each is routed through the
   directory where it is read, and dealt by bucket and slot. Equal texts of a slot are combined
   in each task before that, so copies arrive once per task. The owner compares the bytes of a
   slot's texts: different ones form the slot's collision chain, with the sizes that the keys
   give. Each bucket becomes a folder ``bits=../prefix=..`` of the index.
4. **Probe.** Each document is routed to its bucket, looks up its slot and walks the chain to
   its own text.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import SPACES, fresh_path, settle, shuffle_partitions, stored, whole_text, with_member

FIRST_BITS = 4
DOUBLINGS = 8  # bits that one directory round may add
MAX_BITS = 48
CAPACITY = 1 << 14  # slots of a bucket; a bucket is a folder of files, so raise it where slots go into billions
FEW_BUCKETS = 1 << 18  # of three numbers each, which may be broadcast
NULL_ID = Decimal(1 << 63)  # ranks behind every real id
STEP = Decimal(10**20)  # between two text lengths in a rank


def normalised(text: str = "text") -> Column:
    """The text without the six ASCII white-space characters; null counts as empty."""
    return F.translate(whole_text(text), SPACES, "")


def _rank(n_chars: Column, doc_id: Column) -> Column:
    """One sortable number: more code points first, then the smaller id, ids that are null last."""
    behind = F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(NULL_ID))
    return (n_chars.cast("decimal(11,0)") * F.lit(STEP) - behind).cast("decimal(38,0)")


def _id_of(rank: Column) -> Column:
    """The id inside a rank; null for documents without one."""
    step = F.lit(STEP)
    half = F.lit(STEP / 2)  # ids are far below half a step
    n_chars = F.floor((rank + half) / step)
    behind = (n_chars.cast("decimal(11,0)") * step - rank).cast("decimal(20,0)")
    return F.when(behind < F.lit(NULL_ID), behind.cast("bigint"))


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, 64 - bits)


def directory(slots: DataFrame, capacity: int) -> DataFrame:
    """(bits, prefix, slots): the buckets after all splits, one row each, no bucket over ``capacity``
    unless ``MAX_BITS`` bits can't tell its slots apart (it then stays whole: an overflow bucket).

    Rounds run until nothing is overfull; each adds up to ``DOUBLINGS`` bits and reads only the
    slots of overfull buckets. ``slots`` has one column, ``key``.
    """
    settled, pending, bits = None, slots, FIRST_BITS
    while True:
        last = min(bits + DOUBLINGS, MAX_BITS)
        cells = pending.groupBy(_prefix(F.col("key"), last).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
        levels = stored(
            cells.select(F.explode(F.sequence(F.lit(bits), F.lit(last))).alias("bits"), "cell", "n")
            .groupBy("bits", F.expr(f"shiftrightunsigned(cell, {last} - bits)").alias("prefix"))
            .agg(F.sum("n").alias("slots")),
            "directory_levels",
        )
        over = levels.where((F.col("slots") > capacity) & (F.col("bits") < MAX_BITS))
        parents = over.select((F.col("bits") + 1).alias("bits"), F.col("prefix").alias("parent"))
        own = levels.where((F.col("slots") <= capacity) | (F.col("bits") == MAX_BITS))
        # a bucket is live when its parent was overfull, or when it is one of the first buckets
        split = own.withColumn("parent", F.shiftrightunsigned("prefix", 1)).join(parents, ["bits", "parent"], "left_semi")
        live = own.where(F.col("bits") == bits).select("bits", "prefix", "slots")
        live = live.unionByName(split.where(F.col("bits") > bits).select("bits", "prefix", "slots"))
        settled = live if settled is None else settled.unionByName(live)
        still = levels.where((F.col("bits") == last) & (F.col("slots") > capacity) & F.lit(last < MAX_BITS))
        if still.isEmpty():
            return settled
        pending = pending.join(
            still.select(F.col("prefix").alias("cell")), _prefix(F.col("key"), last) == F.col("cell"), "left_semi"
        )
        # children of an overfull last level have one more bit
        bits = last + 1


def routed(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """``rows`` (with ``key``) and the ``bits`` and ``prefix`` of the bucket that the directory names for each."""
    root = buckets.agg(F.min("bits")).first()[0] or FIRST_BITS
    pages = buckets.groupBy(F.call_function("shiftrightunsigned", "prefix", F.col("bits") - root).alias("cell")).agg(
        F.collect_list(F.struct("bits", "prefix")).alias("page")  # buckets below one address of the root
    )
    own = F.filter("page", lambda b: F.call_function("shiftrightunsigned", F.col("key"), F.lit(64) - b["bits"]) == b["prefix"])
    pages = F.broadcast(pages) if buckets.limit(FEW_BUCKETS + 1).count() <= FEW_BUCKETS else pages
    found = rows.withColumn("cell", _prefix(F.col("key"), root)).join(pages, "cell").withColumn("bucket", F.get(own, 0))
    return found.select(*rows.columns, "bucket.bits", "bucket.prefix")


def key_of(text: Column, key_bits: int = 64) -> Column:
    """The slot of a normalised text. Fewer than 64 bits make texts collide; for tests."""
    if not key_bits:
        return F.lit(0).cast("bigint")
    return F.shiftleft(F.xxhash64(text), 64 - key_bits) if key_bits < 64 else F.xxhash64(text)


def build_index(docs: DataFrame, keys: DataFrame, capacity: int, key_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(index, directory). The index as read from its shared files: key, rows, chain, bits, prefix.

    ``chain`` has an element (sha, size, best) for each different text of the slot.
    """
    spark = docs.sparkSession
    ranks = keys.select("key", "sha", _rank(F.col("n_chars"), F.col("doc_id")).alias("rank"))
    entries = stored(ranks.groupBy("key", "sha").agg(F.count(F.lit(1)).alias("size"), F.max("rank").alias("best")), "exact_entries")
    slots = stored(entries.groupBy("key").agg(F.sum("size").alias("rows"), F.max("best").alias("best"), F.max("sha").alias("sha")), "exact_slots")
    buckets = stored(directory(slots.select("key"), capacity), "directory")
    alone = slots.where("rows = 1").select("key", "rows", F.array(F.struct("sha", F.col("rows").alias("size"), "best")).alias("chain"))
    text = normalised()
    bodies = docs.select(key_of(text, key_bits).alias("key"), text.alias("body"))
    bodies = with_member(bodies, F.col("key"), slots.where("rows > 1").select("key"), "several").where("several").drop("several")
    # owners: a slot's texts meet in the task that its bucket and key name, which tells them apart by their bytes
    owned = routed(bodies, buckets).groupBy("bits", "prefix", "key").agg(F.collect_set("body").alias("texts"))
    texts = owned.select("bits", "prefix", "key", F.explode("texts").alias("body")).select("bits", "prefix", "key", F.unhex(F.sha2("body", 256)).alias("sha"))
    chains = texts.join(entries, ["key", "sha"]).groupBy("bits", "prefix", "key").agg(
        F.sum("size").alias("rows"), F.collect_list(F.struct("sha", "size", "best")).alias("chain")
    ).where("rows > 1")  # the others are slots of one row that the filter let through
    columns = ["key", "rows", "chain", "bits", "prefix"]
    whole = routed(alone, buckets).select(columns).unionByName(chains.select(columns))
    path = fresh_path(spark, "exact_index")
    (
        whole.repartition(shuffle_partitions(spark), "bits", "prefix").sortWithinPartitions("bits", "prefix", "key")
        .write.partitionBy("bits", "prefix").parquet(path)
    )
    return spark.read.schema(whole.schema).parquet(path), buckets


def _found(docs: DataFrame, capacity: int, key_bits: int = 64) -> DataFrame:
    """The stored keys of all documents, with their group's size and winning rank (null: alone), and whether they stay."""
    text = normalised()
    docs = docs.select("doc_id", "text")
    keys = stored(
        docs.select("doc_id", key_of(text, key_bits).alias("key"), F.unhex(F.sha2(text, 256)).alias("sha"), F.length(whole_text()).alias("n_chars")),
        "exact_keys",
    )
    index, buckets = build_index(docs, keys, capacity, key_bits)
    entries = index.where("rows > 1").select("bits", "prefix", "key", F.explode("chain").alias("c"))
    entries = entries.select("bits", "prefix", "key", "c.sha", "c.size", "c.best").where("size > 1")
    mine = _rank(F.col("n_chars"), F.col("doc_id"))
    probe = routed(keys, buckets).join(entries, ["bits", "prefix", "key", "sha"], "left")
    return probe.withColumn("kept", F.col("size").isNull() | (F.col("best") == mine))


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, key_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without white space. Of equals the row with the most code
    points stays, then the smallest doc_id. Null texts count as empty (all empties are one
    group); a null doc_id never wins against a real one; repeated (doc_id, text) rows are rows
    of one group, and each of them that ties with the winner says ``kept``; an empty table gives
    an empty result. Other columns are ignored.
    """
    return _found(docs, capacity, key_bits).select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(_id_of(F.col("best"))).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("bigint")).alias("group_size"),
        "kept",
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The documents that stay, one per group, with all their columns.

    A row is known by doc_id (null is a value), text hash and length together, so different texts
    under one id all stay, and a dropped copy goes even if another row with its id stays. Of rows
    that tie for one place the least by its columns, in their order, stays.
    """
    same = ["doc_id", "sha", "n_chars"]
    groups = _found(docs, capacity).where("size > 1").groupBy(*same).agg(F.count(F.lit(1)).alias("rows"), F.max("kept").alias("kept"))
    decided = stored(groups.where("NOT kept OR rows > 1").select(*same, "kept"), "exact_decided")
    return settle(docs, decided, {"sha": F.unhex(F.sha2(normalised(), 256)), "n_chars": F.length(whole_text())})
