"""Document fingerprints by order MinHash, in array expressions only.

The k-mers of a text (runs of ``K`` words) are numbered by occurrence, so a repeated k-mer counts
each time, and hashed onto a circle that has ``BINS`` bins. Each bin that has k-mers takes the
``PICKED`` minimal ones from its start on; if it has too few, the next ones on the circle follow.
They are put back into text order, and the hash of the tuple is one coordinate of the signature.
Two texts share a coordinate only where the same k-mers occur *in the same order*, which makes
the share of equal coordinates follow edit distance rather than set overlap alone. One sort per
text serves all bins; nothing is exploded, and each text is signed once.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import shuffle_partitions, whole_text

K = 3
BIN_BITS = 6
PICKED = 2
POS_BITS = 30  # a text of 2**31 bytes, the longest there is, has no more than 2**30 words
WORD = r"[\x20\x09-\x0D]+"


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Evaluate expressions once a row: a generator over one struct, which the optimizer doesn't inline."""
    kept = [c for c in df.columns if c not in columns]
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select(*kept, F.inline(one))


def _hash_part(x: Column) -> Column:
    return F.shiftrightunsigned(x, POS_BITS)


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _packed(hash64: Column, pos: Column) -> Column:
    return hash64.bitwiseAND(F.lit(-(1 << POS_BITS))).bitwiseOR(pos.cast("bigint"))


def _upto(n: Column) -> Column:
    """[0, n), empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def add_signature(df: DataFrame, text: str, out: str, k: int = K) -> DataFrame:
    """``df`` with ``out``: array of bigint, one coordinate per bin that has k-mers, ascending.

    A text with fewer than ``k`` words is one k-mer; one without words (null too) has no coordinate.
    """
    w, s, b, sel = f"_{out}_w", f"_{out}_s", f"_{out}_b", f"_{out}_sel"
    df = _held(df, **{w: F.filter(F.split(whole_text(text), WORD), lambda x: x != "")})
    n = F.size(w)
    kmers = F.transform(_upto(n - F.lit(k - 1)), lambda i: _packed(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), i))
    short = F.array(_packed(F.xxhash64(F.array_join(w, " ")), F.lit(0)))
    df = _held(df, **{s: F.sort_array(F.when(n >= k, kmers).when(n > 0, short).otherwise(F.array().cast("array<bigint>")))}).drop(w)
    # occurrence numbers: equal k-mers are neighbours now, in text order
    starts = F.filter(_upto(F.size(s)), lambda i: (i == 0) | (_hash_part(F.get(s, i)) != _hash_part(F.get(s, i - 1))))
    df = _held(df, **{b: starts})
    numbered = F.flatten(
        F.transform(
            b,
            lambda at, g: F.transform(
                F.sequence(at, F.coalesce(F.get(b, g + 1), F.size(s)) - 1),
                lambda i: F.when(i == at, F.get(s, i)).otherwise(
                    _packed(F.xxhash64(_hash_part(F.get(s, i)), i - at), F.get(s, i).bitwiseAND(F.lit((1 << POS_BITS) - 1)))
                ),
            ),
        )
    )
    df = _held(df, **{s: F.when(F.size(b) == F.size(s), F.col(s)).otherwise(F.sort_array(numbered))}).drop(b)
    picked = F.filter(s, lambda x, i: (i < PICKED) | (_bin(F.get(s, i - PICKED)) != _bin(x)))
    df = _held(df, **{sel: picked}).drop(s)
    # a bin's tuple starts at its first k-mer and may run on into the next bins, around the circle
    ring, many = f"_{out}_ring", F.least(F.lit(PICKED), F.size(sel))
    df = _held(df, **{ring: F.concat(F.col(sel), F.slice(sel, F.lit(1), F.lit(PICKED - 1)))})
    first = F.filter(_upto(F.size(sel)), lambda i: (i == 0) | (_bin(F.get(sel, i)) != _bin(F.get(sel, i - 1))))

    def coordinate(i: Column) -> Column:
        turned = F.sort_array(
            F.transform(F.slice(ring, i + 1, many), lambda y: F.shiftleft(y.bitwiseAND(F.lit((1 << POS_BITS) - 1)), 64 - POS_BITS - 1).bitwiseOR(F.shiftrightunsigned(y, POS_BITS + 1)))
        )
        tuple_hash = F.xxhash64(F.transform(turned, lambda y: y.bitwiseAND(F.lit((1 << (63 - POS_BITS)) - 1))))
        return F.shiftleft(_bin(F.get(sel, i)), 32).bitwiseOR(tuple_hash.bitwiseAND(F.lit((1 << 32) - 1)))

    return _held(df, **{out: F.sort_array(F.transform(first, coordinate))}).drop(sel, ring)


def fingerprint(signature: Column) -> Column:
    """A signature as text: ten hexadecimal digits per coordinate."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Equal coordinates by bins that either signature has; 1 for two texts without words."""
    bins = lambda s: F.transform(s, lambda x: F.shiftright(x, 32))
    either = F.size(F.array_union(bins(a), bins(b)))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def _constant(values, kind: str) -> Column:
    """A list as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), kind)


def with_next(docs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``next_<column>`` of the document that follows by doc_id; the last is followed by the first.

    ``ids``: the doc_id column alone, so that looking for ranges reads nothing else. Documents are
    dealt into ranges of doc_id, four a partition, whose bounds are quantiles; a row finds its
    range by binary search. The first of each range is also sent to the range before it as a
    guest, so each range finds its neighbours alone. A null doc_id sorts first, equal ids by the
    hash of their text. No range is hot unless one doc_id is.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63)))
    n = 4 * shuffle_partitions(spark)
    ids = ids.select(key.alias("key"))
    cuts = ids.agg(F.percentile_approx("key", _constant([i / n for i in range(1, n)], "array<double>"), F.lit(10 * n))).first()[0] or []
    cuts = sorted(set(cuts))
    bounds, steps = _constant(cuts, "array<bigint>"), [1 << b for b in range(len(cuts).bit_length() - 1, -1, -1)]

    def bucket_of(key: Column) -> Column:
        """How many bounds are below ``key``."""
        if not steps:
            return F.lit(0)
        return F.aggregate(
            _constant(steps, "array<int>"), F.lit(0), lambda at, step: at + F.when(F.get(bounds, at + step - 1) < key, step).otherwise(0)
        )

    found = ids.groupBy(bucket_of(F.col("key")).alias("bucket")).agg(F.min("key").alias("key")).collect()  # one row a range
    found = sorted((r["bucket"], r["key"]) for r in found)
    guests = [(first, found[i - 1][0]) for i, (_, first) in enumerate(found)]
    guests = spark.createDataFrame(guests, "first_key bigint, host int")
    seats = F.when(F.col("host").isNull(), F.array(F.struct(bucket_of(key).alias("bucket"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(bucket_of(key).alias("bucket"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest")))
    )
    seated = docs.join(F.broadcast(guests), key == F.col("first_key"), "left").select(*docs.columns, F.inline(seats))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    nexts = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return seated.withColumns(nexts).where("guest = 0").drop("bucket", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with its fingerprint and that of its edited text.

    The edited text has the last quarter of its code points (rounded down) replaced by as many
    of the next document's first (all, if that is shorter). Columns: doc_id, n_chars,
    edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. A null text is
    empty, equal texts have equal fingerprints, repeated rows stay, an empty table gives an
    empty result; other columns are ignored.
    """
    base = docs.select("doc_id", whole_text().alias("text"))
    signed = with_next(add_signature(base, "text", "own"), docs.select("doc_id"), ["text", "own"])
    n = F.length("text")
    tail = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - tail), F.substring(F.col("next_text"), F.lit(1), tail))
    signed = signed.select("doc_id", n.cast("bigint").alias("n_chars"), "own", "next_own", edited.alias("edited"))
    both = add_signature(signed.withColumn("edited_sha256", F.sha2("edited", 256)), "edited", "other")
    return both.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )
