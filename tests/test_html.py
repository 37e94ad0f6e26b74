import pytest

from lexweave.functions.html import SelectorError, extract, page_text, parse, select

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li>menu</ul></nav>
<article><h1>Nets and &amp; knots</h1><p>First&nbsp;part <b>bold</b>.<p>Second part.<ul><li>bare item<li><p>item with paragraph</p></ul><aside>aside</aside>
<script>var a = "<p>no</p>";</script></article><footer>foot</footer></body></html>"""
SOUP = """<body><div id="side"><p>short note</p></div><div class="wrap"><div class="main text"><p>%s</p><p>%s</p></div></div></body>""" % ("long words " * 20, "more words " * 20)


def test_article():
    title, text, error = extract(PAGE)
    assert (title, error) == ("Nets and & knots", None)
    assert text == "Nets and & knots\nFirst part bold .\nSecond part.\nbare item\nitem with paragraph"


def test_densest_and_selector():
    assert "short note" not in extract(SOUP)[1] and extract(SOUP)[1].startswith("long words")
    assert extract(SOUP, "#side")[1] == "short note"
    assert extract(SOUP, "div.wrap .main p")[1] == ("long words " * 20).strip()
    assert extract(SOUP, ".unknown") == extract(SOUP)


def test_errors_and_bare_text():
    assert extract("")[2] == "no document body in page"
    assert extract("<body><nav>menu</nav><footer>f</footer></body>")[2] == "page has no extractable prose"
    assert extract("<body><div>bare text</div></body>")[1] == "bare text"
    assert extract("<main><p>Käse &uuml;ber</p></main>")[1] == "Käse über"


def test_column(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(PAGE,), (None,)], "h string").select(page_text(F.col("h")).alias("p")).select("p.*").collect()
    assert rows[0]["title"] == "Nets and & knots" and rows[1]["error"] == "no document body in page"


TREE = """<div id=a lang=en-GB><p>one</p><p class="x y">two</p><span>three</span><section><p data-k="deep value">four</p></section></div>
<div id=b><section><div><p>five</p></div></section></div>"""


@pytest.mark.parametrize(
    ("selector", "text"),
    [
        ("#a > p + p", "two"), ("p ~ span", "three"), ("[data-k]", "four"), ("[data-k~=value]", "four"), ("[data-k='deep value']", "four"),
        ("p[data-k^=deep]", "four"), ("p[data-k$=value]", "four"), ("p[data-k*='p v']", "four"), ("[lang|=en] > p", "one"), ("p:nth-child(2)", "two"),
        ("p:nth-child(2n)", "two"), ("p:nth-of-type(odd)", "one"), ("p:nth-last-of-type(1)", "two"), ("p:not(:first-child)", "two"),
        ("section > p:only-child", "four"), ("#b p", "five"), ("div > section > div > p", "five"), ("div section div p", "five"),
        ("h1, .y", "two"), ("*.x", "two"), ("#b section > p", None), ("p:last-child", "four"), ("#b section p:not(.x)", "five"),
    ],
)
def test_selectors(selector, text):
    found = select(parse(TREE), selector)
    assert (found.text() if found else None) == text


@pytest.mark.parametrize("selector", ["p >", ", p", "p:hover", "p[", "> p", "p:nth-child(x)"])
def test_unreadable_selectors(selector):
    with pytest.raises(SelectorError):
        select(parse(TREE), selector)


def test_pages_without_a_body_have_one():
    assert extract("<title>T</title><div>bare</div>") == ("T", "bare", None)  # the head is no prose
    assert extract("<div><p>one</p></div><div><p>two</p></div>")[1] == "one\ntwo"
    assert extract("<html><head><title>T</title></head><p>a</p><section><p>long enough</p></section></html>")[1] == "long enough"


def test_what_starts_inside_chrome_stays_there():
    assert extract("<article><p>kept <noscript><p>gone</p></noscript></article>")[1] == "kept"
    assert extract("<article><p>kept <button><li>gone</button> on</article>")[1] == "kept on"


def test_layouts_hold_on_any_page(spark, tmp_path):
    """Layouts and their SQL on pages of another make than the given ones, an empty article among them."""
    import duckdb

    from lexweave.plans import layouts as L
    from lexweave.plans.queries import page_extract, page_layouts

    assert len({x.name for x in L.LAYOUTS}) == len(L.LAYOUTS) >= 35
    html = ["<article><h1>On &quot;nets&quot; &amp; knots</h1><p>One <i>two</i>.<p>Three &copy;</p></article>", "<title>x</title><article><h1>A &lt;b&gt;</h1><p>p  q\n r</p></article>"]
    spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    for query, sql in ((page_extract, L.pages_sql()), (page_layouts, L.layouts_sql())):
        rows = query(spark, str(tmp_path))
        found = db.execute(sql)
        names = [d[0] for d in found.description]
        want = sorted(repr(tuple(dict(zip(names, r))[c] for c in rows.columns)) for r in found.fetchall())
        assert sorted(repr(tuple(r)) for r in rows.collect()) == want
