"""Reads by key, rows in file order, and pages over HTTP as a Spark source."""

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lexweave.functions.text import cache_name
from lexweave.plans import schemas
from lexweave.sources import files
from lexweave.sources.pages import PoliteReader, register


def article(i):
    return {"url": f"https://h/{i}", "title": f"t{i}", "text": f"text {i}", "text_sha256": "h", "fetched_at": "now"}


@pytest.fixture()
def cache(spark, tmp_path):
    folder = str(tmp_path / "articles")
    files.write_cache(spark.createDataFrame([article(i) for i in range(20)], schemas.ARTICLE), folder)
    return folder


def test_point_read_opens_one_file(spark, cache, monkeypatch):
    opened = []
    plain = files.cache_bytes
    monkeypatch.setattr(files, "cache_bytes", lambda folder, url: opened.append(url) or plain(folder, url))
    assert files.load_article(spark, cache, "https://h/3") == article(3)
    assert files.load_article(spark, cache, "https://h/none") is None
    assert opened == ["https://h/3", "https://h/none"]


def test_list_read_opens_the_listed_files_alone(spark, cache, tmp_path):
    """All other files are broken, so opening one would show; a listed one that is broken does."""
    wanted = [("https://h/4", 0), ("https://h/none", 1), ("https://h/2", 2), ("https://h/4", 3), (None, 4)]
    urls = spark.createDataFrame(wanted, "url string, ordinal long")
    name = spark.createDataFrame([(f"https://h/{i}",) for i in range(20)], "url string").select("url", cache_name(F.col("url")).alias("n"))
    for r in name.collect():
        if r["url"] not in ("https://h/4", "https://h/2"):
            (tmp_path / "articles" / r["n"]).write_text("{broken")
    got = files.read_cache(spark, cache, urls).orderBy("ordinal").collect()
    assert [(r["ordinal"], r["text"]) for r in got] == [(0, "text 4"), (2, "text 2"), (3, "text 4")]
    with pytest.raises(files.FetchError, match="corrupt"):
        files.read_cache(spark, cache, spark.createDataFrame([("https://h/5", 0)], "url string, ordinal long"))
    with pytest.raises(files.FetchError, match="corrupt"):
        files.load_article(spark, cache, "https://h/5")
    with pytest.raises(files.FetchError, match="no articles"):
        files.read_cache(spark, cache, spark.createDataFrame([("https://h/none", 0)], "url string, ordinal long"))


def test_order_of_files_however_they_are_dealt(spark, tmp_path):
    folder = tmp_path / "lines"
    folder.mkdir()
    want = []
    for f in range(5):
        rows = [{k: f"{f}-{i}-{'x' * (i % 40)}" for k in schemas.REPLY.fieldNames()} for i in range(200)]
        (folder / f"part-{f}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
        want += [r["text"] for r in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size, cost in (("128m", "4m"), ("4k", "1"), ("23k", "1"), ("300k", "1")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", cost)
            rows = files.read_records(spark, str(folder), "replies", schemas.REPLY)
            assert [r["text"] for r in rows.orderBy("ordinal").collect()] == want
            assert rows.select("ordinal").distinct().count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    one = tmp_path / "array.json"
    one.write_text(json.dumps([{k: f"{i}" for k in schemas.REPLY.fieldNames()} for i in range(50)]))
    assert [r["text"] for r in files.read_records(spark, str(one), "replies", schemas.REPLY).orderBy("ordinal").collect()] == [str(i) for i in range(50)]


@pytest.fixture()
def site():
    """A host on this machine that counts its requests."""
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append((self.path, self.headers["User-Agent"], time.monotonic()))
            known = {"/robots.txt": "User-agent: *\nDisallow: /private\nCrawl-delay: 1\n", "/a": "<p>ä</p>", "/b": "<p>b</p>"}
            body = known.get(self.path, "").encode()
            self.send_response(200 if self.path in known else 404)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()
    server.server_close()


def test_pages_as_a_source(spark, site, tmp_path):
    root, asked = site
    path = tmp_path / "urls.txt"
    closed = "http://127.0.0.1:9/x"
    path.write_text("\n".join(["# list", f"{root}/a", closed, f"{root}/private/x", f"{root}/missing", "", f"{root}/b"]))
    register(spark)
    df = spark.read.format("polite_pages").option("userAgent", "tester/1").option("delay", "0.1").load(str(path))
    assert df.columns == ["ordinal", "url", "html", "status", "error"] and df.rdd.getNumPartitions() == 2
    asked.clear()
    rows = {r["ordinal"]: r for r in df.collect()}
    assert [rows[i]["html"] for i in range(5)] == ["<p>ä</p>", None, None, None, "<p>b</p>"]
    assert [rows[i]["status"] for i in range(5)] == [200, None, None, 404, 200]
    assert "could not fetch" in rows[1]["error"] and "robots.txt" in rows[2]["error"] and rows[3]["error"] == "returned HTTP 404"
    paths = [p for p, _, _ in asked]
    assert paths == ["/robots.txt", "/a", "/missing", "/b"] and {a for _, a, _ in asked} == {"tester/1"}
    gaps = [b[2] - a[2] for a, b in zip(asked, asked[1:])]
    assert min(gaps) > 0.95  # the host's Crawl-delay is more than ours


def test_hosts_are_partitions(tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("http://a/1\nhttp://b/1\nhttp://a/2\nhttp://a:81/1\nhttp://a/1\n")
    parts = PoliteReader({"path": str(path)}).partitions()
    assert [(p.host, p.robots, p.urls) for p in parts] == [
        ("a", "http://a/robots.txt", [(0, "http://a/1"), (2, "http://a/2"), (4, "http://a/1")]),
        ("b", "http://b/robots.txt", [(1, "http://b/1")]), ("a:81", "http://a:81/robots.txt", [(3, "http://a:81/1")]),
    ]
