"""Main text of hand-written layouts: ten page frames around five articles, each with its expected text."""

import time

import pytest

from lexweave.llm import html_extract as H

#: (html, expected text), written by hand; none comes from the training generator.
ARTICLES = {
    "plain": (
        "<h1>Bridges of the old town</h1><p>The first bridge was built of oak. It burned down twice before stone came.</p>"
        "<p>A second one followed in the next century, and traders paid a toll to cross it.</p><p>Today both carry trams. Nobody pays.</p>",
        "Bridges of the old town\nThe first bridge was built of oak. It burned down twice before stone came.\n"
        "A second one followed in the next century, and traders paid a toll to cross it.\nToday both carry trams. Nobody pays.",
    ),
    "sections": (
        "<h1>Growing beans</h1><p>Beans like warm soil and a good deal of light. Wait until May.</p><h2>What you need</h2>"
        "<ul><li>A sunny bed with loose soil that drains well.</li><li>Poles of two metres, one for each plant.</li></ul>"
        "<blockquote>My grandmother soaked them overnight. She never lost a seed.</blockquote><p>Water them in the morning. Evening invites slugs.</p>",
        "Growing beans\nBeans like warm soil and a good deal of light. Wait until May.\nWhat you need\n"
        "A sunny bed with loose soil that drains well.\nPoles of two metres, one for each plant.\n"
        "My grandmother soaked them overnight. She never lost a seed.\nWater them in the morning. Evening invites slugs.",
    ),
    "short": (
        "<h1>Lost cat</h1><p>A grey cat with one white paw is missing since Tuesday. Please look in your sheds.</p>",
        "Lost cat\nA grey cat with one white paw is missing since Tuesday. Please look in your sheds.",
    ),
    "inline": (
        "<h1>Prices &amp; wages</h1><p>Prices <b>rose</b> by 3&nbsp;%,<br>wages <i>did\n  not</i>. So says <a href='/r'>the report</a> of the bank.</p>"
        "<p>Two &lt; three, the author notes. Few would argue with that.</p>",
        "Prices & wages\nPrices rose by 3 %, wages did not. So says the report of the bank.\nTwo < three, the author notes. Few would argue with that.",
    ),
    "unclosed": (
        "<h1>Night trains</h1><p>They run again between the two capitals, every night but Sunday.<p>Berths are cheap. Breakfast is not included.<p>Book early, as the cars fill up quickly in summer.",
        "Night trains\nThey run again between the two capitals, every night but Sunday.\nBerths are cheap. Breakfast is not included.\nBook early, as the cars fill up quickly in summer.",
    ),
}
NAV = "<nav><ul><li><a href='/'>Home</a></li><li><a href='/n'>News</a></li><li><a href='/c'>Contact</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2020 The Daily Paper. All rights reserved.</p></footer>"
FRAMES = {
    "bare article": "{nav}<article>{a}</article>{foot}",
    "wrapped": "<div class='page has-sidebar'><header class='site-header'><p>The Daily Paper</p></header>{nav}<div class='layout with-header'><article class='post print'>{a}</article></div>"
    "<aside class='sidebar'><h3>Popular</h3><ul><li><a href='/1'>Ten ways to peel an egg</a></li><li><a href='/2'>Rain again</a></li></ul></aside></div>{foot}",
    "modal": "<div class='modal-open'><div class='cookie-notice'><p>We use cookies to make this site better. Accept them?</p><button>Accept</button></div>{nav}<main>{a}</main>{foot}</div>",
    "comments": "{nav}<div class='entry has-comments'><article>{a}</article><section id='comments'><h3>Two comments</h3><article class='comment'><p>I saw this coming for years. Well written!</p></article>"
    "<article class='comment'><p>Nonsense from start to end. I want my money back.</p></article></section></div>{foot}",
    "teasers": "{nav}<main><article>{a}</article></main><aside class='related'><article><h2>Another story</h2><p>Read what happened next door. It will amaze you.</p></article>"
    "<article><h2>One more</h2><p>Our readers liked this one. You may, too.</p></article></aside>{foot}",
    "soup": "<div id='top'><div class='menu'><a href='/'>Home</a> <a href='/a'>About</a></div></div><div class='content'>{a}</div><div id='footer'>Copyright by us. Imprint.</div>",
    "advert inside": "{nav}<article>{a}<div class='advert'>Buy two lamps and get a third one free. Only today!</div></article>{foot}",
    "newsletter": "{nav}<article>{a}</article><form class='newsletter'><label>Mail</label><p>Subscribe to our letter. It comes every Friday.</p><input name=m><button>Send</button></form>{foot}",
    "scripts": "<script>var a='<p>not text</p>';</script><style>p{{color:red}}</style>{nav}<!-- <p>gone</p> --><noscript>Please turn on scripts. Thank you.</noscript><article>{a}</article>"
    "<svg><title>x</title><text>Drawn words. Here.</text></svg>{foot}",
    "site title": "<header><h1 class='logo'>The Daily Paper</h1></header>{nav}<div role='main'><div class='col-md-8 main-column'><article id='post-7'>{a}</article></div></div>"
    "<div class='share-buttons'><a href='/f'>Share</a> <a href='/t'>Post</a></div>{foot}",
}


@pytest.fixture(scope="module")
def weights():
    return H.train()


@pytest.mark.parametrize("frame", FRAMES)
@pytest.mark.parametrize("article", ARTICLES)
def test_layout(weights, frame, article):
    html, want = ARTICLES[article]
    page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + FRAMES[frame].format(a=html, nav=NAV, foot=FOOT) + "</body></html>"
    assert H.main_text(page, weights)[0] == want


BODY = "<h1>The title of it</h1>" + "".join(f"<p>This is paragraph number {i} of the article. It has two sentences.</p>" for i in range(6))


@pytest.mark.parametrize("name", ["page has-sidebar", "layout with-header", "post print", "entry has-comments", "modal-open", "search-results", "site related", "right-sidebar"])
@pytest.mark.parametrize("shape", ["<div class='{0}'><article>{1}</article></div>", "<article class='{0}'>{1}</article>", "<div class='{0}'><main>{1}</main></div>", "<div class='{0}'>{1}</div>", "<main><div class='{0}'>{1}</div></main>"])
def test_wrapper_names_lose_nothing(weights, name, shape):
    text, _, kept = H.main_text(f"<html><body>{NAV}{shape.format(name, BODY)}{FOOT}</body></html>", weights)
    assert kept == 7 and text.startswith("The title of it\nThis is paragraph number 0")


@pytest.mark.parametrize(
    "inner, want",
    [
        ("<p>See <svg width=1 height=1 /> here it goes on.</p><p>And here is more of it.</p>", "See here it goes on.\nAnd here is more of it."),
        ("<p>A film <iframe src='x'/> was shown. We liked it.</p><p>And here is more of it.</p>", "A film was shown. We liked it.\nAnd here is more of it."),
        ("<p>Unclosed <svg><g> graphics eat nothing. It is so.</p><p>And here is more of it.</p>", "Unclosed graphics eat nothing. It is so.\nAnd here is more of it."),
        ("<p>A <video-player src=1>player of its own kind</video-player> is no video. Text stays.</p>", "A player of its own kind is no video. Text stays."),
        ("<p>We have <math><mi>x</mi>=<mn>1</mn></math> by the rule. It holds.</p>", "We have x=1 by the rule. It holds."),
        ("<p title=it's>A quote in a bare value. All is well.</p>", "A quote in a bare value. All is well."),
        ("<p title='a > b'>A sign in a value. All is well.</p>", "A sign in a value. All is well."),
        ("<SCRIPT>x('</p>')</Script ><p>Case does not matter. All is well.</p>", "Case does not matter. All is well."),
        ("<p>One is 5 < 6 as they say. All is well.</p>", "One is 5 < 6 as they say. All is well."),
    ],
)
def test_markup(weights, inner, want):
    assert H.main_text(f"<article><h1>Title of it</h1>{inner}</article>", weights)[0] == f"Title of it\n{want}"


def test_hostile_markup_takes_linear_time():
    for piece in ('<a href="x ', "<svg>", "<iframe ", "<b>", "</i>", "<!--", "<p =", "<SVG></svgx>", "<div><span>"):
        spent = []
        for n in (20_000, 80_000):
            began = time.process_time()
            H.blocks_of(piece * n)
            spent.append(time.process_time() - began)
        assert spent[1] < 10 * spent[0] + 0.5, piece


def test_unclosed_inline_tags_take_linear_time():
    for page in ("<b>" * 20_000 + "<p>x.</p>" * 2_000, "<i><p>" + "<b>" * 20_000 + "</i>" * 2_000, "<p>x" + "<b>" * 20_000 + "<p>y" * 2_000, "<div>x. " * 20_000, "<article><h1>x. " * 3_000):
        began = time.process_time()
        for b in H.blocks_of(page):
            H.features(b)
        assert time.process_time() - began < 2


PARAGRAPH = "Prices rose again in the spring of that year. Nobody was sure for how long they would."


@pytest.mark.parametrize("name", ["share-price", "ad-hoc", "legal-analysis", "comment-intro", "form-of-address", "notice-period", "related-work", "header-bidding", "social-history", "searchLight"])
def test_compound_names_of_content(weights, name):
    page = f"<html><body>{NAV}<article>{BODY}<p class='{name}'>{PARAGRAPH}</p></article>{FOOT}</body></html>"
    assert H.main_text(page, weights)[0].splitlines()[-1] == PARAGRAPH


@pytest.mark.parametrize("name", ["cookie-notice", "siteFooter", "comment-list", "newsletter-signup", "share-buttons", "ad-slot", "related-posts", "reader-comments", "site-header"])
def test_compound_names_of_boilerplate(weights, name):
    page = f"<html><body>{NAV}<article>{BODY}</article><div class='{name}'><p>Buy two lamps and get a third one free. Only today!</p></div>{FOOT}</body></html>"
    assert "lamps" not in H.main_text(page, weights)[0]


#: (page, with {b} for the article's body; what stands around it must go): everyday layouts, none from the generator.
REAL = {
    "form around the page": "<form id=aspnetForm action=x>{nav}<div id=ctl00_main>{b}</div>{foot}</form>",
    "form around an article": "<form method=post>{nav}<article>{b}</article>{foot}</form>",
    "form around main, search inside": "<form id=f>{nav}<main>{b}</main><form class=search><label>Find</label><input><button>Go</button></form>{foot}</form>",
    "search results as a section": "{nav}<article><section class='search-results'>{b}</section></article>{foot}",
    "wiki": "<div id=mw-head>{nav}</div><div id=content class=mw-body role=main><div id=bodyContent>{b}</div></div><div id=mw-panel><ul><li><a href=/a>Random page</a></li></ul></div>{foot}",
    "blog": "<div id=page class=hfeed><header id=masthead class=site-header><p class=site-title>A blog</p></header><div id=primary><main id=main><article class='post type-post hentry'><div class=entry-content>{b}</div></article></main></div><div id=secondary class=widget-area><h2>Archives</h2><ul><li><a href=/1>May</a></li></ul></div></div>{foot}",
    "table layout": "<table><tr><td colspan=2>{nav}</td></tr><tr><td class=sidebar><a href=/>Home</a> <a href=/x>Links</a></td><td class=content>{b}</td></tr></table>{foot}",
    "news": "<header><div class=topbar>{nav}</div></header><main><article itemscope><div itemprop=articleBody>{b}</div></article><aside><h3>Most read</h3><ol><li><a href=/1>Storm</a></li></ol></aside></main>{foot}",
    "divs with data names": "<div data-react-root><div class=x1a2>{nav}</div><div class=x9z8><article>{b}</article></div><div class=x3c4>{foot}</div></div>",
    "paywall notice": "{nav}<main>{b}</main><div class='modal'><p>You have read three articles this month. Subscribe to go on!</p></div>{foot}",
    "comments behind": "{nav}<article>{b}</article><div id=disqus><p>First! I have waited for this.</p><p>Second. So have I.</p></div>{foot}",
    "share bar inside": "{nav}<article><div class=share><a href=/f>Share</a> <a href=/t>Tweet</a></div>{b}</article>{foot}",
    "breadcrumbs": "{nav}<div class=breadcrumbs><a href=/>Home</a> / <a href=/n>News</a></div><article>{b}</article>{foot}",
    "hidden text": "{nav}<article>{b}<p hidden>Nobody should see this. Not even once.</p></article>{foot}",
    "template": "{nav}<template><p>A card that is filled in later. It has no text yet.</p></template><article>{b}</article>{foot}",
    "role names": "<div role=navigation><a href=/>Home</a></div><div role=main>{b}</div><div role=contentinfo><p>Copyright by us. All of it.</p></div>",
    "skip link": "<a class=skip href=#m>Skip to content</a>{nav}<main id=m>{b}</main>{foot}",
    "language menu": "{nav}<div class=menu><a href=/de>Deutsch</a><a href=/fr>Fran\u00e7ais</a></div><article>{b}</article>{foot}",
    "advert between": "{nav}<div class='ad-slot'>Shoes at half the price. Order them now.</div><article>{b}</article>{foot}",
    "unclosed layout": "<div class=wrap>{nav}<div class=content><article>{b}</article>{foot}",
    "old tags": "<center>{nav}</center><div align=left><font size=2><article>{b}</article></font></div>{foot}",
}


@pytest.mark.parametrize("layout", REAL)
def test_everyday_layouts(weights, layout):
    page = "<!DOCTYPE html><html><head><title>t</title></head><body>" + REAL[layout].format(b=BODY, nav=NAV, foot=FOOT) + "</body></html>"
    want = ["The title of it"] + [f"This is paragraph number {i} of the article. It has two sentences." for i in range(6)]
    assert H.main_text(page, weights)[0].splitlines() == want


def test_title_in_the_header_above_main(weights):
    inner = BODY.replace("<h1>The title of it</h1>", "")
    text = H.main_text(f"<header><h1>The title of it</h1></header>{NAV}<main>{inner}</main>{FOOT}", weights)[0]
    assert text.startswith("The title of it\nThis is paragraph number 0")
    logo = H.main_text(f"<header><h1 class=logo>The Daily Paper</h1></header>{NAV}<main>{inner}</main>{FOOT}", weights)[0]
    assert logo.startswith("This is paragraph number 0")
