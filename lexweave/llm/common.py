"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = "\x20\t\n\x0b\x0c\r"
FALLBACK_DIR = "/tmp/checkpoints/lexweave"
FILTER_BITS = 27  # of a broadcast membership bitmap: 16 MB, twice that with its rows
PAGE_BITS = 11  # of one row of the bitmap
SMALL_ROWS = 1_000_000  # of a few numbers each: about 64 MB as a broadcast


_scope: ContextVar[str] = ContextVar("scope", default="")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session may go without one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (named or FALLBACK_DIR).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/lexweave/{_scope.get()}{re.sub(r'[^A-Za-z0-9_]', '_', name)}-{uuid.uuid4().hex}"


@contextmanager
def temporaries(spark: SparkSession) -> Iterator:
    """Deletes, at the end, what :func:`stored` wrote inside; gives a ``stored`` whose tables stay.

    Nothing goes before the end, so a lost executor's work can be done again until its result is
    stored.
    """
    scope = f"{_scope.get()}scope-{uuid.uuid4().hex}/"
    folder = f"{shared_dir(spark)}/lexweave/{scope}"
    before = _scope.set(scope)

    def outside(df: DataFrame, name: str) -> DataFrame:
        inner = _scope.set(scope.rpartition("scope-")[0])
        try:
            return stored(df, name)
        finally:
            _scope.reset(inner)

    try:
        yield outside
    finally:
        _scope.reset(before)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a lineage cut that outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """A stored table of a few numbers a row, to be broadcast if it is counted at ``rows`` or fewer, else to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def with_member(df: DataFrame, hashed: Column, members: DataFrame, name: str) -> DataFrame:
    """``df`` with a boolean ``name``: whether ``hashed`` may be among ``members`` (one bigint column of hashes).

    A bitmap of the members' hashes is broadcast: 16 bits a member, ``FILTER_BITS`` at most, so
    its size has a bound whatever the input. No member is ever missed; what is marked without
    being one has to be told apart by the caller.
    """
    (value,) = members.columns
    n = members.count()
    bits = min(max(n * 16, 1 << 15), 1 << FILTER_BITS).bit_length() - 1
    slot = lambda h: F.shiftrightunsigned(h, 64 - bits)
    page_of, place_of = lambda h: F.shiftright(slot(h), PAGE_BITS), lambda h: slot(h).bitwiseAND(F.lit((1 << PAGE_BITS) - 1))
    whole = F.bitmap_construct_agg(place_of(F.col(value)))  # always 4 kB, the rest of which is empty
    pages = members.groupBy(page_of(F.col(value)).alias("_page")).agg(F.substring(whole, 1, 1 << PAGE_BITS - 3).alias("_bits"))
    at = place_of(hashed)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0, F.lit(False))
    joined = df.join(F.broadcast(pages), page_of(hashed) == F.col("_page"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(name))


def give_back() -> None:
    """Free memory of this process goes back to the system; Python workers live on between stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def given_back(rows: Iterator) -> Iterator:
    """``rows``, and :func:`give_back` at their end."""
    try:
        yield from rows
    finally:
        import gc

        gc.collect()
        give_back()


def free_name(df: DataFrame, name: str) -> str:
    """``name`` with underscores in front until no column of ``df`` has it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def settle(docs: DataFrame, decided: DataFrame, identity: dict[str, Column]) -> DataFrame:
    """``docs`` without the rows that ``decided`` drops, all columns kept, whatever their names.

    ``decided``: ``doc_id``, the columns of ``identity`` (expressions over ``text``) and ``kept``,
    one row for each identity that is dropped, or kept but held by several rows: of those the
    least by column order stays. Rows that ``decided`` lacks stay. Only rows whose doc_id occurs
    in ``decided`` are shuffled.
    """
    orderable = [f.name for f in docs.schema if not any(x in f.dataType.simpleString() for x in ("map<", "variant"))]
    base = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(*[F.col(f"`{c}`") for c in orderable]).alias("order"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"),
    )
    ids = decided.select(F.xxhash64(F.col("doc_id").cast("bigint")).alias("h")).distinct()
    marked = with_member(base, F.xxhash64("doc_id"), ids, "suspect")
    clear = marked.where(~F.col("suspect")).select("row.*")
    names = ["doc_id", *identity]
    known = decided.select(*[F.col(c).alias(f"of_{c}") for c in names], F.col("kept").alias("stays"))
    own = marked.where("suspect").select("row", "order", *[e.alias(f"is_{c}") for c, e in ({"doc_id": F.col("doc_id")} | identity).items()])
    match = F.lit(True)
    for c in names:
        match = match & F.col(f"is_{c}").eqNullSafe(F.col(f"of_{c}"))
    joined = own.join(small(known), match, "left")
    once = joined.where("stays").groupBy(*[f"is_{c}" for c in names]).agg(F.min_by("row", "order").alias("row"))
    return clear.unionByName(joined.where(F.col("stays").isNull()).select("row.*")).unionByName(once.select("row.*"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(col: str = "text") -> Column:
    """The text, null counting as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
