"""N-gram overlap: how much of an answer's wording its source holds.

Answers meet their articles in one join on the URL; the grams of both sides are then compared
inside the row. No gram is ever shuffled. A gram is the tuple of the 64-bit hashes of its words,
hashed again, so it is a number from the start: no gram is ever joined to a string, sets are of
numbers, and texts that are both answer and source are tokenised once and travel as arrays. Two
different grams of one pair get one number with a chance of about their pairs over 2**64.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text import ngrams, tokens, utc_seconds
from lexweave.operators.ranges import FEW, Ranges
from lexweave.sources.config import ScoringConfig

BROADCAST_BYTES = 32 << 20  # of items' grams that are broadcast; beyond, the join shuffles
LONG_BYTES = 16 << 20  # of a text that is compared in one row


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns and evaluate each once per row: a generator that the optimizer doesn't inline."""
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def gram_hashes(words: Column, n: int) -> Column:
    """The hash of each run of ``n`` words, in order; empty if there are fewer."""
    count = F.size(words) - F.lit(n - 1)
    runs = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))
    return F.when(count >= 1, runs).otherwise(F.array().cast("array<bigint>"))


def _with_matches(df: DataFrame) -> DataFrame:
    """Add matched_ngrams: how many grams of ``_ag``, each time they occur, are in ``_sg``.

    Set operations are hashed. Where every gram occurs once, or every gram is shared, sizes say it
    all. Else the answer's grams are sorted and counted in runs, and one walk over the runs and the
    sorted shared grams adds up; no look-up is a scan. Each array that a lambda looks into is a
    column of its own, else it would be built anew per element.
    """
    none = F.array().cast("array<bigint>")
    df = evaluated(df, _shared=F.array_intersect("_ag", "_sg"), _kinds=F.size(F.array_distinct("_ag")))
    once, whole = F.col("_kinds") == F.size("_ag"), F.col("_kinds") == F.size("_shared")
    counted = F.when(once, F.size("_shared")).when(whole, F.size("_ag")).when(F.size("_shared") == 0, F.lit(0)).cast("bigint")
    df = evaluated(df, _counted=counted)
    walks = F.col("_counted").isNull()
    df = evaluated(df, _shared=F.when(walks, F.array_sort("_shared")).otherwise(none), _sorted=F.when(walks, F.array_sort("_ag")).otherwise(none))
    every = F.when(walks, F.sequence(F.lit(0), F.size("_sorted") - 1)).otherwise(F.array().cast("array<int>"))
    df = evaluated(df, _starts=F.filter(every, lambda i: (i == 0) | (F.get("_sorted", i) != F.get("_sorted", i - 1))))
    runs = F.transform("_starts", lambda at, k: F.struct(F.get("_sorted", at).alias("gram"), (F.coalesce(F.get("_starts", k + 1), F.size("_sorted")) - at).alias("n")))
    df = evaluated(df, _runs=runs).drop("_sorted", "_starts")

    def walk(acc, run):
        hit = F.coalesce(F.get("_shared", acc["next"]) == run["gram"], F.lit(False)).cast("int")
        return F.struct((acc["next"] + hit).alias("next"), (acc["found"] + hit * run["n"]).alias("found"))

    start = F.struct(F.lit(0).alias("next"), F.lit(0).cast("bigint").alias("found"))
    walked = F.aggregate("_runs", start, walk)["found"]
    return df.withColumn("matched_ngrams", F.coalesce("_counted", walked)).drop("_shared", "_runs", "_kinds", "_counted")


def with_grams(texts: DataFrame, text: str, out: str, config: ScoringConfig) -> DataFrame:
    """``texts`` with the gram hashes of a text, null counting as empty, instead of the text."""
    df = evaluated(texts, _words=tokens(F.col(text), config))
    df = evaluated(df, **{f"{out}_new": gram_hashes(F.col("_words"), config.ngram_size)})
    return df.drop("_words", text).withColumnRenamed(f"{out}_new", out)


def scored_grams(pairs: DataFrame, config: ScoringConfig) -> DataFrame:
    """Pairs with ``_ag`` and ``_sg``, the grams of answer and source: the score columns in their place."""
    df = evaluated(pairs, total_ngrams=F.size("_ag").cast("bigint"))
    return _with_score(_with_matches(df).drop("_sg", "_ag"), config)


def _with_score(counts: DataFrame, config: ScoringConfig) -> DataFrame:
    some = F.col("total_ngrams") > 0
    return counts.withColumns(
        {
            "score": F.when(some, F.col("matched_ngrams") / F.nullif("total_ngrams", F.lit(0))).otherwise(0.0),
            "scorable": some,
            "scoring_version": F.lit(config.version),
        }
    )


def with_overlap(pairs: DataFrame, answer: str, source: str, config: ScoringConfig) -> DataFrame:
    """``pairs`` with score (not rounded), matched_ngrams, total_ngrams, scorable and scoring_version.

    A null text is empty. An answer too short for one n-gram scores 0.0 and is not scorable.
    """
    df = evaluated(pairs, _aw=tokens(F.col(answer), config), _sw=tokens(F.col(source), config))
    df = evaluated(df, _ag=gram_hashes(F.col("_aw"), config.ngram_size), _sg=gram_hashes(F.col("_sw"), config.ngram_size)).drop("_aw", "_sw")
    return scored_grams(df, config)


def gram_table(texts: DataFrame, key: str, text: str, config: ScoringConfig, distinct: bool = False) -> DataFrame:
    """(key, pos, gram) of each text, or the distinct (key, gram)."""
    words = evaluated(texts.select(key, F.col(text).alias("_t")), _w=tokens(F.col("_t"), config)).drop("_t")
    grams = ngrams(F.col("_w"), config.ngram_size)
    if distinct:
        return words.select(key, F.explode(F.array_distinct(grams)).alias("gram")).distinct()
    return words.select(key, F.posexplode(grams).alias("pos", "gram")).withColumn("pos", F.col("pos").cast("bigint"))


def item_hits(items: DataFrame, item: str, docs: DataFrame, doc: str, text: str, config: ScoringConfig) -> DataFrame:
    """(item, doc, matched_ngrams, total_ngrams) for each item and document that share a gram.

    Documents' grams are told from the items' in the task that made them where the items' fit a
    broadcast (counted), so only hits are shuffled.
    """
    own = with_grams(items.select(item, F.col(text).alias("_t")), "_t", "_g", config)
    total = own.select(item, F.size("_g").cast("bigint").alias("total_ngrams"))
    asked = own.select(item, F.explode("_g").alias("gram")).groupBy(item, "gram").agg(F.count(F.lit(1)).alias("times"))
    if asked.limit(BROADCAST_BYTES // 64 + 1).count() <= BROADCAST_BYTES // 64:
        asked = F.broadcast(asked)
    held = with_grams(docs.select(doc, F.col(text).alias("_t")), "_t", "_g", config)
    hits = held.select(doc, F.explode(F.array_distinct("_g")).alias("gram")).join(asked, "gram")
    once = hits.groupBy(item, doc, "gram").agg(F.max("times").alias("times"))  # a doc_id may have several rows
    return once.groupBy(item, doc).agg(F.sum("times").alias("matched_ngrams")).join(total, item)


def _last_rows(articles: DataFrame, ordinal: str, url: str) -> DataFrame:
    """The rows of the last ordinal of each URL, found on narrow columns before a text moves.

    Of several that share it those with the greatest hash of their columns stay, which are equal.
    """
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c, kind in articles.dtypes if not any(x in kind for x in ("map<", "variant"))])
    mark = F.struct(F.col(ordinal).alias("o"), hashed.alias("h"))
    known = articles.where(F.col(url).isNotNull() & F.col(ordinal).isNotNull()).withColumn("_mark", mark)
    last = known.groupBy(F.col(url).alias("_u")).agg(F.max("_mark").alias("_last"))
    return known.join(last, (F.col(url) == F.col("_u")) & (F.col("_mark") == F.col("_last")), "left_semi").drop("_mark")


def last_per_url(articles: DataFrame, ordinal: str = "ordinal", url: str = "url") -> DataFrame:
    """One row per URL: the last one by ``ordinal``, of several the one with the greatest hash of its columns.

    Rows without a URL or an ordinal are no articles. However rows are dealt, the result is the same.
    """
    return _last_rows(articles, ordinal, url).dropDuplicates([url])


def _long_urls(answers: DataFrame, articles: DataFrame) -> DataFrame | None:
    """(_long, _parts) of URLs with a text of more than ``LONG_BYTES``; none if there is none. Reads lengths only."""
    sizes = answers.select(F.col("article_url").alias("_long"), F.octet_length("answer").alias("bytes"))
    sizes = sizes.unionByName(articles.select(F.col("url").alias("_long"), F.octet_length("text").alias("bytes")))
    long = sizes.where(F.col("bytes") > LONG_BYTES).groupBy("_long").agg(F.ceil(F.max("bytes") / F.lit(LONG_BYTES)).cast("int").alias("_parts"))
    n = long.limit(FEW + 1).count()
    return None if not n else F.broadcast(long) if n <= FEW else long


def _cut(df: DataFrame, url: str, grams: str, long: DataFrame) -> DataFrame:
    """Rows of long URLs, each as several: a part has the grams of its share of all numbers, each as often as it occurs."""
    own = evaluated(df.join(long, F.col(url) == F.col("_long")), _whole=F.col(grams)).drop("_long", grams)
    each = own.select("*", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
    mine = F.filter("_whole", lambda x: F.pmod(x, F.col("_parts").cast("bigint")) == F.col("_part"))
    return evaluated(each, **{grams: mine}).drop("_whole", "_parts")


def _scored_parts(asked: DataFrame, known: DataFrame, config: ScoringConfig) -> DataFrame:
    """Scores of answers whose grams and whose article's come in parts: parts meet in tasks of their own and counts are added up."""
    met = asked.join(known, (asked["article_url"] == known["_url"]) & (asked["_part"] == known["_kpart"]), "inner").drop("_url", "_kpart")
    parts = _with_matches(evaluated(met, total_ngrams=F.size("_ag").cast("bigint"))).drop("_sg", "_ag")
    kept = [c for c in parts.columns if c not in ("_part", "_row", "matched_ngrams", "total_ngrams")]
    first = F.any_value(F.when(F.col("_part") == 0, F.struct(*kept)), True).alias("_kept")
    sums = parts.groupBy("_row").agg(F.sum("matched_ngrams").alias("matched_ngrams"), F.sum("total_ngrams").alias("total_ngrams"), first)
    return _with_score(sums.select("_kept.*", "matched_ngrams", "total_ngrams"), config)


def score_answers(answers: DataFrame, articles: DataFrame, config: ScoringConfig) -> DataFrame:
    """A result row for each answer whose article is known; answers without one are dropped.

    ``answers`` and ``articles`` have their record columns, and ``ordinal`` where order matters:
    the last article of a URL wins (without an ordinal the one with the greatest hash of its
    columns), results keep the answers' ordinal. Only winners are tokenised. Spark broadcasts the
    articles' grams if it finds them small once they are there, and splits an article that many
    answers ask for. Texts beyond ``LONG_BYTES`` are compared in parts, each in a task of its own.
    """
    if "ordinal" not in articles.columns:
        articles = articles.withColumn("ordinal", F.lit(0))
    articles = articles.select("url", "title", "text", "text_sha256", "ordinal")
    long = _long_urls(answers, articles)
    last = _last_rows(articles, "ordinal", "url")

    def known(rows: DataFrame) -> DataFrame:
        held = with_grams(rows, "text", "_sg", config).dropDuplicates(["url"])  # equal rows; dealt as the join needs them
        return held.select(F.col("url").alias("_url"), F.col("title").alias("article_title"), F.col("text_sha256").alias("article_sha256"), "_sg")

    def asked(rows: DataFrame) -> DataFrame:
        return with_grams(rows.withColumn("_ag", F.col("answer")), "_ag", "_ag", config)

    def whole(rows: DataFrame, sources: DataFrame) -> DataFrame:
        a, k = asked(rows), known(sources)
        return scored_grams(a.join(k, a["article_url"] == k["_url"], "inner").drop("_url"), config)

    if long is None:
        scored = whole(answers, last)
    else:
        named = long.select("_long")
        short = whole(answers.join(named, F.col("article_url") == F.col("_long"), "left_anti"), last.join(named, F.col("url") == F.col("_long"), "left_anti"))
        a = _cut(asked(answers.join(named, F.col("article_url") == F.col("_long"), "left_semi").withColumn("_row", F.monotonically_increasing_id())), "article_url", "_ag", long)
        k = _cut(known(last.join(named, F.col("url") == F.col("_long"), "left_semi")), "_url", "_sg", long).withColumnRenamed("_part", "_kpart")
        scored = short.unionByName(_scored_parts(a, k, config))
    order = [c for c in ("ordinal",) if c in answers.columns]
    return scored.select(
        *order,
        "question_id", "article_url", "article_title", "article_sha256", "question", "answer",
        F.bround("score", 6).alias("score"), "matched_ngrams", "total_ngrams", "scorable", "scoring_version",
        "model_requested", "model_served", F.col("system_prompt").alias("answer_system_prompt"),
        F.col("user_prompt").alias("answer_user_prompt"), F.col("created_at").alias("answered_at"), utc_seconds().alias("scored_at"),
    )


def previous_scores(docs: DataFrame, group: str, key: str, text: str, config: ScoringConfig) -> DataFrame:
    """(key, group, source_key, score columns): each document scored against the one before it in its group.

    Documents are in order of ``key``, rows that repeat a key in the order of a hash of their grams;
    a row without a key has no place and is left out. Each text is tokenised once and its grams are
    shuffled once, to a range of keys of its group (:class:`Ranges`), where the row before it stands
    too, be it as a guest. No group is one task.
    """
    rows = docs.where(F.col(key).isNotNull())
    keys = rows.select(group, key)
    ranges = Ranges.of(keys, group, key)
    seated = ranges.with_guests(with_grams(rows.select(key, group, F.col(text).alias("_ag")), "_ag", "_ag", config), keys)
    order = Window.partitionBy(group, "_range").orderBy(key, "_tie")
    near = seated.withColumn("_tie", F.xxhash64("_ag"))
    near = near.select(key, group, "_ag", "_guest", F.lag(key).over(order).alias("source_key"), F.lag("_ag").over(order).alias("_sg"))
    return scored_grams(near.where("NOT _guest AND source_key IS NOT NULL").drop("_guest"), config)
