"""Queries beside their SQL on pages of which some share an address, as the larger tables have them."""

import pytest

from lexweave.plans import queries as Q

HTML = "<html><body><article><h1>Page {i}</h1><p>Prose &amp; more of page {i}.</p></article></body></html>"


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    """Twelve addresses, each of three pages whose numbers differ in what the queries do with them."""
    folder = tmp_path_factory.mktemp("shared_addresses")
    rows = [(i, f"http://h.example.org/en/{i // 3}", HTML.format(i=i)) for i in range(36)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


def beside_sql(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    rows = Q.queries()[name](spark, folder)
    found = db.execute(Q.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(rows.columns)
    want = sorted(repr(tuple(r[names.index(c)] for c in rows.columns)) for r in found.fetchall())
    assert sorted(repr(tuple(r)) for r in rows.collect()) == want


@pytest.mark.parametrize("name", ["cache_hit_miss", "fetch_through_cache", "question_stage"])
def test_pages_that_share_an_address(spark, pages, name):
    beside_sql(spark, pages, name)


#: Headlines that end inside a reference, as cut ones do; a name that only begins like one; numbers without an end.
CUT = ("ends in &amp;&amp", "ends in &am", "open &lt and &quot; closed", "no &ampere; here", "&#65 and &copy", "R&D &gt;")


@pytest.mark.parametrize("name", ["fetch_through_cache", "page_extract", "page_layouts"])
def test_references_without_an_end(spark, tmp_path, name):
    """The SQL of the pages knows references by their semicolons."""
    rows = [(i, f"http://h.example.org/{i}", f"<html><body><article><h1>{CUT[i % 6]}</h1><p><b>{CUT[i // 12]}</b> prose</p></article></body></html>") for i in range(72)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    beside_sql(spark, str(tmp_path), name)


def test_references_as_browsers_have_them():
    from lexweave.functions.html import extract, parse, select

    page = "<article><p a='x&amp'>A &amp &copy 1 &ampx; &uuml; &#65 &#66;</p><noframes>R&amp</noframes></article>"
    assert extract(page)[1] == "A & \u00a9 1 &x; \u00fc A B"
    assert extract(page, closed=True)[1] == "A &amp &copy 1 &ampx; \u00fc &#65 B"
    assert select(parse(page, closed=True), "p").attrs == {"a": "x&amp"}
    assert extract("<article><p>\ufdd0 &amp</p></article>", closed=True)[1] == "\ufdd0 &amp"
