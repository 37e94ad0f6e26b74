"""Benchmark passages in documents: a prefix-filtered set join, verified word by word.

A *window* is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window). As
a set it holds its shingles, runs of ``SHINGLE`` words. Containment has to be exact, so of a
window's shingles in order of rarity a prefix of one is necessary: a text without a window's rarest
shingle can't hold the window.

1. *Rarity.* Shingles of all windows are counted over all documents.
2. *Prefix.* Each window keeps its rarest shingle and the shingle's place in it. Windows that agree
   in shingle, place and length form one *shape*, so one place in a text asks once for a shape,
   however many windows have it.
3. *Join.* Documents' shingles meet the shapes. By position, the window would have to start as many
   words earlier; by length, it has to fit into the text. What remains is cut out of the text and
   compared with whole windows as a string.
4. *Coverage.* Spans that agree are united per document, and windows lead to their items.

Both look-up tables come from the benchmark and are broadcast only if they are counted to be small.
Beyond that, places that a bitmap of bounded size lets through are shuffled, each with the few
words around it; documents never are. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import stored, whole_text, with_member

WINDOW = 10
SHINGLE = 3
BROADCAST_ROWS = 200_000  # of shapes, or of windows with their words: some 30 MB
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # fixed: what is no word, once A-Z are lower case
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """The words, A-Z in lower case and other letters as they are; null has none."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)  # ASCII alone, which lower() maps as the rule does
    return F.array_remove(F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER)), BREAKS), "")


def windows_of(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, text, n): every window of every item, as its words joined by blanks; each once per item."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - F.lit(size - 1), F.lit(1))
    cut = words.select("item_id", "words", F.explode(F.sequence(F.lit(1), last)).alias("at"))
    cut = cut.select("item_id", F.slice("words", F.col("at"), F.lit(size)).alias("w"))
    return cut.select("item_id", F.array_join("w", " ").alias("text"), F.size("w").alias("n")).distinct()


def _shingle(words: Column, at: Column, k: int) -> Column:
    """The hash of ``k`` words from place ``at`` (from 0) on."""
    return F.xxhash64(F.lit(k), *[F.get(words, at + j) for j in range(k)])


def _places(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, doc_id, words, at, shingle): every place of every text, a row for each shingle size that windows have.

    ``key`` stands for the id and the text. Each text also has one row at -1, without a shingle,
    which stands for the text itself.
    """
    doc_id = F.col("doc_id").cast("bigint")
    key = F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), whole_text()).cast("binary")))
    base = docs.select(key.alias("key"), doc_id.alias("doc_id"), words_of(F.col("text")).alias("words"))
    each = base.select("key", "doc_id", "words", F.explode(F.sequence(F.lit(-1), F.size("words") - 1)).alias("at"))
    fits = lambda k: (F.col("at") >= 0) & (F.col("at") + k <= F.size("words"))
    own = [F.when(fits(k), _shingle(F.col("words"), F.col("at"), k)) for k in sizes]
    if len(own) == 1:
        return each.withColumn("shingle", own[0])
    nothing = F.array(F.lit(None).cast("bigint"))
    return each.withColumn("shingle", F.explode(F.when(F.col("at") < 0, nothing).otherwise(F.array(*own))))


def _few(table: DataFrame) -> bool:
    return table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _if_few(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if _few(table) else table


def rarest_shingles(windows: DataFrame, docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(shingle, back, n): the shapes of windows. ``back``: how many words into the window its rarest shingle begins.

    A window with a shingle that no document has is left out, as it occurs nowhere.
    """
    w, n = F.split("text", " "), F.col("n")
    inside = windows.select("text", "n", w.alias("w"), F.explode(F.sequence(F.lit(0), n - F.least(n, F.lit(SHINGLE)))).alias("back"))
    by_size = F.coalesce(*[F.when(F.least(n, F.lit(SHINGLE)) == k, _shingle(F.col("w"), F.col("back"), k)) for k in sizes])
    inside = stored(inside.select("text", "n", "back", by_size.alias("shingle")), "window_shingles")
    asked = inside.select("shingle").distinct()
    places = _places(docs, sizes).select("shingle")
    if _few(asked):
        said = places.join(F.broadcast(asked), "shingle")
    else:
        said = with_member(places, F.col("shingle"), asked, "maybe").where("maybe")
    counts = stored(said.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")), "shingle_counts")
    counted = inside.join(_if_few(counts), "shingle", "left")
    order = F.struct(F.coalesce("times", F.lit(0).cast("bigint")).alias("times"), "shingle", "back")
    first = counted.groupBy("text", "n").agg(F.min(order).alias("first"))
    return first.where("first.times > 0").select("first.shingle", "first.back", "n").distinct()


def _candidates(docs: DataFrame, shapes: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, doc_id, n_words, start, n, text): stretches of texts that a shape asks about, and one row per text where ``n`` is null."""
    places, itself = _places(docs, sizes), F.col("at") < 0
    start = F.col("at") - F.col("back")
    fits = (start >= 0) & (start + F.col("n") <= F.col("n_words"))

    def cut(words: Column, first: Column) -> list:
        text = F.array_join(F.slice(words, start - first + 1, F.col("n")), " ")
        return ["key", "doc_id", "n_words", F.when(~itself, start).alias("start"), "n", F.when(~itself, text).alias("text")]

    places = places.withColumn("n_words", F.size("words"))
    if _few(shapes):
        met = places.join(F.broadcast(shapes), "shingle", "left").where(itself | fits)
        return stored(met.select(*cut(F.col("words"), F.lit(0))), "window_candidates")
    first = F.greatest(F.col("at") - (WINDOW - 1), F.lit(0))
    near = with_member(places, F.col("shingle"), shapes.select("shingle").distinct(), "maybe").where(itself | F.col("maybe"))
    near = near.select("key", "doc_id", "n_words", "at", "shingle", first.alias("first"), F.slice("words", first + 1, F.lit(2 * WINDOW)).alias("around"))
    near = stored(near, "window_places")
    alone = near.where(itself).select("key", "doc_id", "n_words", *[F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("n", "int"), ("text", "string"))])
    met = near.where(~itself).join(shapes, "shingle").where(fits).select(*cut(F.col("around"), F.col("first")))
    return stored(met.unionByName(alone), "window_candidates")


def find_windows(docs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(texts, hits, owners): (key, doc_id, n_words) of each document; (key, start, n, window) of each
    occurrence; (window, item_id)."""
    owned = stored(windows_of(items), "item_windows")
    windows = stored(owned.select("text", "n").distinct().withColumn("window", F.monotonically_increasing_id()), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least("n", F.lit(SHINGLE))).distinct().collect()) or [SHINGLE]
    found = _candidates(docs, stored(rarest_shingles(windows, docs, sizes), "window_shapes"), sizes)
    texts = found.where("n IS NULL").select("key", "doc_id", "n_words")
    hits = found.where("n IS NOT NULL").select("key", "start", "n", "text").join(_if_few(windows.select("text", "window")), "text")
    owners = owned.join(_if_few(windows), ["text", "n"]).select("window", "item_id")
    return texts, stored(hits.select("key", "start", "n", "window"), "window_hits"), owners


def covered(spans: Column) -> Column:
    """How many words lie in any of the spans (start, n)."""

    def more(at, s):
        end = s["start"] + s["n"]
        return F.struct(F.greatest(at["until"], end).alias("until"), (at["total"] + F.greatest(end - F.greatest(at["until"], s["start"]), F.lit(0))).alias("total"))

    return F.aggregate(F.array_sort(spans), F.struct(F.lit(0).alias("until"), F.lit(0).alias("total")), more)["total"]


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans (start, n), item_ids (strings, sorted).

    ``docs``: doc_id, text. ``items``: item_id, text. Words are runs of letters and digits and of
    anything beyond ASCII. A null or empty text has no words: such a document is clean and such an
    item is nowhere. Rows that repeat an item_id are one item, and rows without one are one item
    named by the empty string; repeated documents stay row by row. Empty tables give an empty
    result, or clean documents. Other columns are ignored.
    """
    texts, hits, owners = find_windows(docs, items)
    spans = hits.groupBy("key").agg(F.collect_set(F.struct("start", "n")).alias("spans"))
    named = hits.select("key", "window").distinct().join(_if_few(owners), "window")
    named = named.groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    out = texts.join(spans.join(named, "key"), "key", "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>"))
    return out.select(
        "doc_id", F.col("n_words").cast("bigint").alias("n_words"), covered(spans).cast("bigint").alias("n_hit"),
        F.array_sort(spans).alias("spans"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
    )
