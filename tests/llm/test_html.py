"""Main text of pages that were labelled by hand and not trained on; none of them marks its article."""

import re
import time
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import htmltext

A = "The council met on Tuesday evening to talk about the new bridge, which has been closed since the flood of last spring."
B = "Most of the members agreed that the repairs cannot wait. The mayor said that the money will be there by the end of the year!"
C = "Work starts in May."
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li><li><a href="/s">Sport today</a></li><li><a href="/c">Contact</a></li></ul>'
MENU_ZH = '<ul><li><a href="/">首页</a></li><li><a href="/n">新闻</a></li><li><a href="/s">体育</a></li></ul>'
ZH = "市议会星期二晚上开会讨论新桥的问题。这座桥自去年春天的洪水以来一直关闭，居民们等了很久。"
RU = "Совет собрался во вторник вечером, чтобы поговорить о новом мосте. Мост закрыт с прошлой весны, и жители долго ждали."
#: (page, main text)
HELD_OUT = [
    (f"<html><body><p>{A}</p><p>{B}</p><p>{A}</p></body></html>", f"{A} {B} {A}"),
    (f'<html><body><div class="topnav">{MENU}</div><div class="blog-post"><h1>A new bridge for the town</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div class="site-footer"><p>&copy; 2020 The Paper</p></div></body></html>', f"A new bridge for the town {A} {B} {C}"),
    (f"<body><table><tr><td>{MENU}</td><td><h2>A new bridge</h2><p>{A}</p><p>{B}</p></td></tr></table></body>", f"A new bridge {A} {B}"),
    (f'<body><header><p>{C}</p>{MENU}</header><div id="content"><p>{A}</p><p>{B}</p></div><footer><p>{B}</p></footer></body>', f"{A} {B}"),
    (f'<body><div id="page"><div id="left-sidebar"><h3>Recent</h3>{MENU}</div><div id="body-text"><h1>Bridge</h1><p>{A}</p><ul><li>{C}</li><li>{B}</li></ul></div></div></body>', f"Bridge {A} {C} {B}"),
    (f'<body><nav>{MENU}</nav><section><h1>A new bridge</h1><p>{A}</p><p>{B}</p></section><section class="comments"><h2>Two comments</h2><div><p>{B}</p></div></section></body>', f"A new bridge {A} {B}"),
    (f'<body><div class="cookie-banner"><p>{B}</p><button>OK</button></div><div class="entry"><p>{A}</p><div class="ad-box"><p>{C}</p></div><p>{B}</p></div></body>', f"{A} {B}"),
    (f"<body><div>{MENU}</div><div><h1>A new bridge for the town</h1><div>{A}</div><div>{B}</div></div></body>", f"A new bridge for the town {A} {B}"),
    (f'<body><nav>{MENU}</nav><h1>A new bridge</h1><p>{A}<br>{C}</p><blockquote>{B}</blockquote><footer>All rights reserved.</footer></body>', f"A new bridge {A} {C} {B}"),
    (f'<body><div class="story-body"><h1>A new bridge</h1><p>{A}</p><p>{B}</p></div><div class="related-links"><h3>More</h3><p>{B}</p></div><form><p>{C}</p><input name=q></form></body>', f"A new bridge {A} {B}"),
    (f'<body><div role="navigation">{MENU}</div><div class="post-content"><p>{A}</p><figure><img src=x><figcaption>{C}</figcaption></figure><p>{B}</p></div><div class="newsletter-signup"><p>{B}</p></div></body>', f"{A} {C} {B}"),
    (f'<body><div class="menu">{MENU}</div><div class="main-content"><h2>Part one</h2><p>{A}</p><table><tr><th>When</th><td>{C}</td></tr></table><h2>Part two</h2><p>{B}</p></div><aside><p>{B}</p></aside></body>', f"Part one {A} When {C} Part two {B}"),
    (f'<body><div class="topnav">{MENU}</div><div class="social-history"><h1>Old trades</h1><p>{A}</p><p>{B}</p></div></body>', f"Old trades {A} {B}"),
    (f'<body><nav>{MENU}</nav><div class="main-with-side"><p>{A}</p><p>{B}</p></div></body>', f"{A} {B}"),
    (f"<body><nav>{MENU_ZH}</nav><div><p>今天天气很好。我们去公园散步。</p><p>明天会下雨。</p></div></body>", "今天天气很好。我们去公园散步。 明天会下雨。"),
    (f'<body><div class="menu">{MENU_ZH}</div><div class="post"><h1>新桥</h1><p>{ZH}</p><p>{ZH}</p></div><div class="footer"><p>版权所有 © 2020</p></div></body>', f"新桥 {ZH} {ZH}"),
    (f'<body><header>{MENU_ZH}</header><table><tr><td>{MENU_ZH}</td><td><h2>新桥</h2><p>{ZH}</p></td></tr></table></body>', f"新桥 {ZH}"),
    (f'<body><nav>{MENU}</nav><div class="entry"><h1>Мост</h1><p>{RU}</p><p>{RU}</p></div><div class="sidebar"><p>{RU}</p></div></body>', f"Мост {RU} {RU}"),
    (f'<body><div id="nav">{MENU}</div><section id="search-for-truth"><h1>The search</h1><p>{A}</p><p>{B}</p><p>{C}</p></section></body>', f"The search {A} {B} {C}"),
    (f'<body><ul class="breadcrumb"><li><a href="/">Home</a></li></ul><div class="story"><p>{A}</p><p>{B}</p></div><div class="recommended"><h3>Next</h3><p>{B}</p></div></body>', f"{A} {B}"),
    (f'<body><div class="cookie-consent"><p>{B}</p></div><div class="page"><div class="body-copy"><h1>Bridge</h1><p>{A}</p><p>{B}</p></div></div></body>', f"Bridge {A} {B}"),
    (f'<body><nav>{MENU}</nav><div class="text"><p>{A}</p><ol><li>{B}</li><li>{C}</li></ol><p>{B}</p></div><div class="comments"><ol><li><p>{A}</p></li></ol></div></body>', f"{A} {B} {C} {B}"),
    (f'<body><div class="popup"><p>{C}</p></div><div id="main"><h1>Bridge</h1><p>{A}</p><blockquote><p>{B}</p></blockquote></div><div class="pager"><a href="/2">Next</a></div></body>', f"Bridge {A} {B}"),
    (f'<body><div class="login-form"><p>{C}</p></div><div class="article-text"><h1>Bridge</h1><p>{A}</p><h2>Money</h2><p>{B}</p></div></body>', f"Bridge {A} Money {B}"),
    (f'<body><div>{MENU}</div><div><p>{A}</p><p>{B}</p><p>{A}</p></div><div><a href="/a">About</a> <a href="/b">Terms</a></div></body>', f"{A} {B} {A}"),
    (f'<body><div class="wrap"><div class="col-left">{MENU}</div><div class="col-right"><h1>Bridge</h1><p>{A}</p><p>{B}</p></div></div></body>', f"Bridge {A} {B}"),
    (f'<body><nav>{MENU}</nav><pre>{A}</pre><p>{B}</p></body>', f"{A} {B}"),
    (f'<body><div class="banner"><p>{C}</p></div><div class="prose"><dl><dt>When</dt><dd>{A}</dd><dt>Where</dt><dd>{B}</dd></dl></div></body>', f"When {A} Where {B}"),
    (f'<body><nav>{MENU}</nav><div class="entry-content"><p>{A}</p><div class="ads"><p>{C}</p></div><p>{B}</p><div class="share-bar"><a href="/s">Share</a></div></div></body>', f"{A} {B}"),
    (f'<body><div role="banner"><p>{C}</p></div><div><h1>Bridge</h1><p>{A}</p><p>{B}</p></div><div role="contentinfo"><p>{C}</p></div></body>', f"Bridge {A} {B}"),
    (f'<body><aside><p>{B}</p></aside><div class="post-text"><p>{A}</p><p>{C}</p><p>{B}</p></div></body>', f"{A} {C} {B}"),
    (f'<body><div class="newsletter"><h3>Letters</h3><p>{B}</p></div><div class="story-text"><h1>Bridge</h1><p>{A}</p><p>{B}</p></div></body>', f"Bridge {A} {B}"),
    (f'<body><nav>{MENU}</nav><div class="advertising-history"><h1>Posters</h1><p>{A}</p><p>{B}</p></div><footer><p>{C}</p></footer></body>', f"Posters {A} {B}"),
    (f'<body><div class="sidebar-left">{MENU}</div><div class="related-rates"><h1>Calculus</h1><p>{A}</p><p>{B}</p><p>{A}</p></div></body>', f"Calculus {A} {B} {A}"),
    (f'<body><nav>{MENU}</nav><div class="legal-notice"><p>{B}</p></div><div><h1>Bridge</h1><p>{A}</p><p>{B}</p></div></body>', f"Bridge {A} {B}"),
    (f'<body><div class="widget-area"><div class="widget"><p>{B}</p></div></div><div class="body"><p>{A}</p><p>{B}</p></div></body>', f"{A} {B}"),
    (f'<body><nav>{MENU}</nav><div><h1>Bridge</h1><table><tr><th>When</th><th>What</th></tr><tr><td>{C}</td><td>{A}</td></tr></table><p>{B}</p></div></body>', f"Bridge When What {C} {A} {B}"),
    (f'<body><nav>{MENU_ZH}</nav><div class="comment-section"><p>{ZH}</p></div><div class="text"><p>{ZH}</p></div></body>', ZH),
    (f'<body><div class="alert-box"><p>{C}</p></div><form><p>{A}</p></form><footer><p>{B}</p></footer></body>', ""),
    (f"<body><nav>{MENU}</nav><form><p>{A}</p></form><footer><p>{B}</p></footer></body>", ""),
]
#: Pages that mark their article: paragraphs that are links stay, a header is none of the text.
MARKED = [
    (f'<body><nav>{MENU}</nav><article><h1>Bridge</h1><p>{A}</p><p><a href="/x">{B}</a></p><p>{B}</p></article></body>', f"Bridge {A} {B} {B}"),
    (f'<body><nav>{MENU}</nav><article><p><a href="/x">{A}</a></p><p>{B}</p></article><footer>{C}</footer></body>', f"{A} {B}"),
    (f'<body><nav>{MENU}</nav><article><header><h1>Bridge</h1></header><p>{A}</p><p>{B}</p></article></body>', f"{A} {B}"),
]
BROKEN = [
    (f"<body><article><p title=it's>{A}</p><p>{B}</p><p class='x'>{C}</p></article></body>", f"{A} {B} {C}"),
    (f'<body><article><p title="x>{A}</p><p class="y">{B}</p></article></body>', f"{A} {B}"),
    (f'<body><article><p title="a > b">{A}</p><p data-x=\'<b>"\'>{B}</p><p =x a = >{C}</article>', f"{A} {B} {C}"),
    (f"<body><article><p>{A} <math><mi>x</mi></math></p><object><p>{B}</p></object><p>{C} <canvas>drawn</canvas></p></article></body>", f"{A} x {B} {C} drawn"),
    (f"<body><article><p>{A}</p><script>if (a < b) '</p>'</script foo><style>p</style\n><p>{B}</p><!-- <p>no</p> --><p>1 < 2 &amp; 3 > 2</p>", f"{A} {B} 1 < 2 & 3 > 2"),
]


@pytest.fixture(scope="module")
def model():
    return htmltext.train()


@pytest.mark.parametrize("page, main", HELD_OUT + MARKED + BROKEN)
def test_main_text(model, page, main):
    assert not (page, main) in HELD_OUT or not re.search(r"<article|<main|role=.main", page)
    assert htmltext.extract(model, [page]) == [main]


def test_messages_matter(model):
    """The model is more than its nodes: without messages, some of the pages come out wrong."""
    alone = htmltext.Model(model.weights, np.zeros((2, 2)))
    pages = [p for p, _ in HELD_OUT]
    assert sum(a != m for a, (_, m) in zip(htmltext.extract(alone, pages), HELD_OUT)) >= 3


def test_training_is_repeatable(model):
    again = htmltext.train.__wrapped__()
    assert (again.weights == model.weights).all() and (again.pair == model.pair).all()


def test_pages_of_any_size(model):
    body = "".join(f"<p>{A} {k}</p><b><font>" for k in range(20_000))
    began = time.time()
    assert htmltext.extract(model, [f"<nav>{MENU}</nav><article>{body}</article>"]) == [" ".join(f"{A} {k}" for k in range(20_000))]
    assert htmltext.extract(model, ["<div>" * 20 + f"<p>{A}</p><p>{B}</p>"]) == [f"{A} {B}"]
    assert htmltext.extract(model, ["<article>" + "<div>" * 5000 + f"<p>{A}</p>"] * 3) == [A] * 3
    assert time.time() - began < 60
    assert htmltext.extract(model, [None, "", "<p", "<!doctype html>", "<", "plain words"])[:4] == [""] * 4


def test_table(spark, model):
    """Nulls, repeated rows, other columns of clashing names, an empty table."""
    page = f"<nav>{MENU}</nav><article><h1>Title &amp; more</h1><p>{A}<p>{B}</article>"
    rows = [(1, "u", page, 7), (1, "u", page, 7), (2, None, None, None), (None, "u", page, 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    got = htmltext.main_text(pages, model)
    assert got.columns == ["page_id", "url", "text"]
    main = f"Title & more {A} {B}"
    assert Counter(tuple(r) for r in got.collect()) == Counter({(1, "u", main): 2, (2, None, ""): 1, (None, "u", main): 1})
    assert htmltext.main_text(pages.where("false"), model).count() == 0


def test_messages_are_exact():
    rng = np.random.default_rng(3)
    parent = np.array([-1, 0, 0, 1, 1, 2, 5, -1, 7])
    x = rng.normal(size=(9, htmltext.FEATURES))
    model = htmltext.Model(rng.normal(size=htmltext.FEATURES), rng.normal(size=(2, 2)))
    own = np.stack([np.zeros(9), x @ model.weights], 1)
    total, each, pairs = 0.0, np.zeros(9), np.zeros((2, 2))
    child = [k for k in range(9) if parent[k] >= 0]
    for k in range(512):
        y = [k >> i & 1 for i in range(9)]
        p = np.exp(sum(own[i, y[i]] for i in range(9)) + sum(model.pair[y[parent[i]], y[i]] for i in child))
        total += p
        each += p * np.array(y)
        for i in child:
            pairs[y[parent[i]], y[i]] += p
    got = htmltext.messages(model, parent, x)
    assert np.allclose(got.content, each / total) and np.allclose(got.pairs, pairs / total) and np.isclose(got.log_total, np.log(total))


def test_table_of_pages(spark, model):
    """All given pages mark their article; its text, without what its frames hold, is told here by another parser."""
    from html.parser import HTMLParser
    from pathlib import Path

    from corpusloom.llm import queries

    path = "/root/testdata/sf0.001"
    if not Path(path).exists():
        pytest.skip("no test tables")

    class Article(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.parts = [], [[]]

        def handle_starttag(self, tag, attrs):
            if tag in ("p", "div", "h1", "h2", "h3", "li", "ul", "article", "br"):
                self.parts.append([])
            if tag in ("article", "script", "style", "nav", "footer") or tag == "div":
                self.open.append((tag, dict(attrs).get("class") == "ad"))

        def handle_endtag(self, tag):
            if self.open and self.open[-1][0] == tag:
                self.open.pop()
            if tag in ("p", "div", "h1", "h2", "h3", "li", "ul", "article"):
                self.parts.append([])

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.open) and not any(ad or t in ("script", "style", "nav", "footer") for t, ad in self.open):
                self.parts[-1].append(data)

    want = {}
    for r in spark.read.parquet(f"{path}/pages.parquet").collect():
        p = Article()
        p.feed(r["html"])
        p.close()
        want[r["page_id"]] = " ".join(x for x in (" ".join("".join(part).split()) for part in p.parts) if x)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in queries.QUERIES["op8_html"](spark, path).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}
