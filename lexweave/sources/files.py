"""Files in and out: record arrays, the article cache, labelled sets, replies."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.html import page_text
from lexweave.functions.text import cache_name, utc_seconds
from lexweave.plans import schemas
from lexweave.sources.config import SourceConfig


class RecordError(Exception):
    """A record file is missing, malformed or of another shape."""


class FetchError(Exception):
    """A page or the article cache can't serve."""


def _strings(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def read_records(spark: SparkSession, path: str, what: str, schema: T.StructType) -> DataFrame:
    """A JSON array (or JSON lines folder) of records; a missing or unknown key is an error."""
    if not _exists(spark, path):
        raise RecordError(f"no {what} found at {path}; run that stage first")
    try:
        found = set(spark.read.option("multiLine", _is_array(spark, path)).option("mode", "FAILFAST").json(str(path)).columns)
    except Exception as error:
        raise RecordError(f"{path} is not valid JSON") from error
    wanted = set(schema.fieldNames())
    if found and found != wanted:
        raise RecordError(f"{path}: {what} lack {sorted(wanted - found)} or have {sorted(found - wanted)}")
    return in_file_order(spark.read.schema(_strings(schema)).option("multiLine", _is_array(spark, path)).option("mode", "FAILFAST").json(str(path)))


def in_file_order(rows: DataFrame, name: str = "ordinal") -> DataFrame:
    """``rows``, read from files, with a number that grows from file to file (by path) and inside a file from its start.

    Numbers have gaps; their order is the same however Spark deals the files: the stretch of a file
    that a row is read from ranks first, and inside a stretch rows are numbered as they are read.
    """
    stretch = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")]
    found = sorted((r["_file"], r["_block"]) for r in rows.select(*stretch).distinct().collect())  # as many as the scan has splits
    ranks = rows.sparkSession.createDataFrame([(f, b, i) for i, (f, b) in enumerate(found)], "_f string, _b long, _rank long")
    seen = rows.select(*[F.col(f"`{c}`") for c in rows.columns], *stretch, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"))
    placed = seen.join(F.broadcast(ranks), (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    return placed.select(*[F.col(f"`{c}`") for c in rows.columns], (F.shiftleft("_rank", 33) + F.col("_row")).alias(name))


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(str(path))
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session may go without one."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RecordError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(named or tempfile.gettempdir()).rstrip('/')}/lexweave/{name}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str) -> str:
    """``path`` with its scheme: without one it lies on the session's default file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(str(path))
    full = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toASCIIString()
    return full.replace("file:/", "file:///", 1) if full.startswith("file:/") and not full.startswith("file://") else full


def _open(place: str):
    """A binary stream to a new file at ``place``, its folder made; usable on the driver and in tasks.

    The file system must be one that Arrow can open.
    """
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(place)
    system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(inner)


def _is_array(spark: SparkSession, path: str) -> bool:
    return str(path).endswith(".json") and not Path(str(path)).is_dir()


def write_records(rows: DataFrame, path: str, order: str | None = None) -> int:
    """One JSON array in one file, indented; for results that people read. Returns the row count."""
    ordered = rows.orderBy(order) if order else rows
    names = [c for c in rows.columns if c != order]
    n = 0
    with _open(_place(rows.sparkSession, path)) as f:
        f.write(b"[")
        for row in ordered.select(*names).toLocalIterator():  # a row at a time: the file is the bound, not the driver
            body = json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2).replace("\n", "\n  ")
            f.write((("," if n else "") + "\n  " + body).encode())
            n += 1
        f.write(b"\n]" if n else b"]")
    return n


def write_lines(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder, written by the executors: the form for large results."""
    rows.write.mode("overwrite").json(path)


def url_table(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, url) of a URL list; blanks and # lines dropped, duplicates kept."""
    lines = in_file_order(spark.read.text(str(path))).select(F.trim("value").alias("url"), "ordinal")
    return lines.where((F.col("url") != "") & ~F.col("url").startswith("#")).select("ordinal", "url")


def _article(raw: bytes | None) -> tuple:
    """The fields of a cached article and an error: null fields for an absent one, an error for one that can't be read."""
    names = schemas.ARTICLE.fieldNames()
    if raw is None:
        return (None,) * len(names) + (None,)
    try:
        got = json.loads(raw)
        if not isinstance(got, dict) or set(got) != set(names):
            raise ValueError("other keys than an article's")
        return tuple(got[n] for n in names) + (None,)
    except ValueError as error:
        return (None,) * len(names) + (str(error),)


def cache_bytes(folder: str, url: str) -> bytes | None:
    """What the cache holds under a URL; null if nothing. Opens the one file that the URL's hash names."""
    import hashlib

    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(f"{folder}/{hashlib.sha256(url.encode()).hexdigest()[:16]}.json")
    try:
        with system.open_input_file(inner) as f:
            return f.readall()
    except FileNotFoundError:
        return None


def load_article(spark: SparkSession, folder: str, url: str) -> dict | None:
    """A point read: the cached article of a URL, or none. A file that can't be read is an error."""
    *fields, error = _article(cache_bytes(_place(spark, folder), url))
    if error:
        raise FetchError(f"the cached article of {url} in {folder} is corrupt ({error}); delete it and fetch again")
    return dict(zip(schemas.ARTICLE.fieldNames(), fields)) if fields[0] is not None else None


def read_cache(spark: SparkSession, folder: str, urls: DataFrame | None = None) -> DataFrame:
    """Cached articles, in the order of ``urls`` if given (its duplicates repeat rows); none is an error.

    With ``urls`` only their files are opened, each once, by the tasks that hold the URLs; the
    folder is never listed. What was read is kept, so that nothing is opened again.
    """
    none = FetchError("no articles in the cache; run the fetch stage first")
    if urls is None:
        try:
            found = spark.read.schema(_strings(schemas.ARTICLE)).option("multiLine", True).option("mode", "FAILFAST").json(f"{folder}/*.json")
        except Exception as error:
            raise none from error
        try:
            empty = found.isEmpty()
        except Exception as error:
            raise FetchError(f"a cached article in {folder} is corrupt; delete it and fetch again") from error
        if empty:
            raise none
        return found
    place, names = _place(spark, folder), schemas.ARTICLE.fieldNames()

    def load(batches):
        import pandas as pd

        for batch in batches:
            rows = [(u, *_article(cache_bytes(place, u))) for u in batch["_url"]]
            yield pd.DataFrame(rows, columns=["_url", *names, "error"], dtype=object)

    wanted = urls.select(F.col("url").alias("_url")).where("_url IS NOT NULL").distinct()
    read = wanted.mapInPandas(load, "_url string, " + ", ".join(f"{n} string" for n in names) + ", error string").persist(StorageLevel.DISK_ONLY)
    bad = read.where("error IS NOT NULL").select("_url", "error").first()
    if bad:
        raise FetchError(f"the cached article of {bad['_url']} in {folder} is corrupt ({bad['error']}); delete it and fetch again")
    held = read.where("url IS NOT NULL").drop("error", "url")
    if held.isEmpty():
        raise none
    known = urls.select("ordinal", "url")
    return known.join(held, known["url"] == held["_url"]).select("ordinal", *names)


def write_cache(articles: DataFrame, folder: str) -> None:
    """One JSON file per URL, named by its hash; tasks write their own rows to the given folder.

    On a cluster the folder must be a shared one. A task that runs again writes the same files anew.
    """
    names = schemas.ARTICLE.fieldNames()
    to = _place(articles.sparkSession, folder)

    def store(rows):
        for r in rows:
            with _open(f"{to}/{r['_name']}") as f:
                f.write(json.dumps({n: r[n] for n in names}, ensure_ascii=False, indent=2).encode())

    articles.withColumn("_name", cache_name(F.col("url"))).foreachPartition(store)


def split_cached(urls: DataFrame, articles: DataFrame, by: str = "url") -> tuple[DataFrame, DataFrame]:
    """(hits, misses): cached articles of ``urls`` and URLs without one.

    ``by`` names the column that tells entries apart, where pages that share an address are entries of their own.
    """
    held = articles.drop(*[c for c in urls.columns if c != by])
    return urls.join(held, by, "inner"), urls.join(articles.select(by).distinct(), by, "left_anti")


def articles_from_pages(pages: DataFrame, config: SourceConfig, closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(articles, failures) of a page table with url, html and, if fetched, status and error. ``closed`` as in ``html.parse``."""
    ok = F.lit(True)
    reason = F.lit(None).cast("string")
    if "status" in pages.columns:
        ok = F.coalesce(F.col("status") == 200, F.lit(False))
        reason = F.when(~ok, F.concat(F.lit("returned HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("nothing"))))
    if "error" in pages.columns:
        reason = F.coalesce(F.col("error"), reason)
    done = pages.withColumns({"_why": reason, "_page": page_text(F.when(ok, F.col("html")), config.main_text_selector, closed)})
    why = F.coalesce("_why", "_page.error")
    order = [c for c in ("ordinal",) if c in pages.columns]
    text = F.col("_page.text")
    good = done.where(why.isNull()).select(*order, "url", F.col("_page.title").alias("title"), text.alias("text"), F.sha2(text, 256).alias("text_sha256"), utc_seconds().alias("fetched_at"))
    return good, done.where(why.isNotNull()).select(*order, "url", why.alias("error"))


def read_through(urls: DataFrame, cached: DataFrame, pages: DataFrame, config: SourceConfig, by: str = "url", closed: bool = False) -> tuple[DataFrame, DataFrame]:
    """(articles, failures): cached ones pass, the rest is taken from ``pages``; a URL without a page fails.

    ``by`` as in :func:`split_cached`, ``closed`` as in ``html.parse``.
    """
    hits, misses = split_cached(urls, cached, by)
    fresh, failed = articles_from_pages(misses.join(pages.drop(*[c for c in ("ordinal", "url") if c != by]), by), config, closed)
    lost = misses.join(pages.select(by).distinct(), by, "left_anti").select("ordinal", "url", F.lit("could not fetch").alias("error"))
    columns = ["ordinal", *schemas.ARTICLE.fieldNames()]
    return hits.select(columns).unionByName(fresh.select(columns)), failed.unionByName(lost)


def write_csv(rows: DataFrame, path: str) -> int:
    """A labelled set as one CSV file with a header; quotes are doubled, rows end in a line feed."""
    import csv
    import io

    names = schemas.LABELLED.fieldNames()
    n = 0
    with io.TextIOWrapper(_open(_place(rows.sparkSession, path)), encoding="utf-8", newline="") as f:
        out = csv.writer(f, lineterminator="\n")
        out.writerow(names)
        for row in rows.select(*names).toLocalIterator():
            out.writerow(list(row))
            n += 1
    return n


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with header, all strings; fields may hold quotes and line feeds."""
    if not _exists(spark, path):
        raise RecordError(f"no labelled set at {path}; sample one first")
    return spark.read.csv(str(path), header=True, multiLine=True, escape='"', quote='"', inferSchema=False)
