"""Main text of web pages by a tree-structured graphical model.

A page's block elements are the nodes of a tree; each is content or boilerplate. A node's own features (kind of element,
words of its class and id, share of link text, length, marks of sentences and of notices, and whether it lies in the page's
marked article, if it has one) give its potential, a parent and its child share one, and sum-product messages upward and
downward give every node's marginal. Text whose nearest block is content by its marginal is kept. All pages of a batch are
passed through together, one depth of their trees after the other.

Elements that are headers or footers are none of the text, also inside an article. The model is trained on hand-labelled pages, ``LAYOUTS``: what is content there is said by a mark on the element, which is no
feature, and by no rule. Their texts are filled in at random with a fixed seed. Potentials of nodes and pairs maximise the
likelihood of all labels of a page together, by the same messages. No row of the table is used in training, and every page is
read whole.

Null pages and pages without content give an empty text. Tags may be broken: an attribute's value that is not closed ends
with its tag, and one that is not quoted may hold quotes. Repeated rows give repeated results; an empty table gives an empty
result; other columns are kept, but for one named like the new text.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose text is none of the page's: programs, forms' parts and graphics.
RAW = {"script", "style", "template", "svg", "iframe", "textarea", "select", "button", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = (
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption "
    "nav header footer aside form fieldset figure figcaption address details summary dialog center menu noscript hr"
).split()
BLOCK = set(BLOCKS)
#: Elements whose open ones end where one of these begins (beside their parents' ends).
ENDS_P = BLOCK - {"html", "body"}
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"ul", "ol", "dl", "table", "menu"}
GROUPS = {
    "article": "article main", "section": "section", "prose": "p blockquote pre figure figcaption dl dt dd", "heading": "h1 h2 h3 h4 h5 h6",
    "list": "ul ol li menu", "table": "table thead tbody tfoot tr td th caption", "frame": "nav header footer aside form fieldset dialog address", "root": "html body",
}
GROUP_OF = {tag: k for k, tags in enumerate(GROUPS.values()) for tag in tags.split()}
#: Parts of names of classes that tell of a frame, of text, and of neither.
FRAME_WORDS = re.compile(
    r"(?:nav|navbar|navigation|topnav|menu|header|footer|foot|sidebar|side|aside|ad|ads|advert\w*|banner|promo\w*|sponsor\w*|cookie\w*|consent|notice|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|form|search|share|sharing|social|related|recommend\w*|comment\w*|replies|reply|disqus|breadcrumbs?|pagination|pager|toolbar|widget|copyright|legal|disclaimer|complementary|contentinfo)"
)
TEXT_WORDS = re.compile(r"(?:article|post|entry|story|content|main|body|text|prose)")
PLAIN_WORDS = set(
    "area bar block bottom box buttons cell center col column container cta group holder icons inner item items left link links list module panel posts primary region right row section secondary site slot stories "
    "strip title top unit wrap wrapper js is has no ui page global block1 sub".split()
)
PARTS = re.compile(r"[a-z]+|[^\W\d_a-z]+")
CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff]")
#: A tag's attributes: a quoted value ends at a quote that something may follow, else (and without quotes) before white space
#: or the tag's end.
VALUE = r"=\s*+(?:\"[^\"]*+\"(?=[\s/>])|'[^']*+'(?=[\s/>])|[^\s>]*+)"
#: Comments, tags and declarations. A tag that never ends is dropped with what follows it.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|{VALUE})*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTR = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
LABEL = re.compile(r"\s([yn])(?=\s|$)")
SENTENCE = re.compile(r"[.!?…][\"'”’)]*(?:\s|$)|[。！？]")
NOTICE = re.compile(r"©|\(c\)|copyright|all rights reserved|cookie|subscribe|sign up|log in|newsletter|advertis|sponsored|click here|read more|share this|javascript", re.I)
FEATURES = len(GROUPS) + 1 + 4 + 4 + 4 + 2 + 2 + 1  # element, names, link share, length, marks, article, bias


class Page(NamedTuple):
    parent: np.ndarray
    features: np.ndarray
    runs: list[tuple[int, str]]  # (node, text) in page order
    labels: np.ndarray  # of a hand-labelled page: whether a node is content


def parse(html: str | None, labelled: bool = False) -> Page:
    """Block tree, features and runs of text of a page."""
    html = html or ""
    tags, parent, words, labels = ["html"], [-1], [0], [False]
    inside, length, linked, marks, notice = [False], [0], [0], [0], [0]
    stack: list[tuple[str, int]] = [("html", 0)]  # open elements, each with its nearest block
    is_open: defaultdict[str, int] = defaultdict(int)
    runs: list[tuple[int, str]] = []
    held: list[str] = []
    links = 0

    def close() -> None:
        if held:
            text = " ".join(html_lib.unescape("".join(held)).split())
            if text:
                node = stack[-1][1]
                runs.append((node, text))
                length[node] += len(text) + 2 * len(CJK.findall(text))  # a character of these scripts says as much as three
                marks[node] += bool(SENTENCE.search(text))
                notice[node] += len(text) < 300 and bool(NOTICE.search(text))
            held.clear()

    def pop_to(k: int) -> None:
        nonlocal links
        while len(stack) > k:
            name, _ = stack[-1]
            if name in BLOCK:
                close()
            links -= name == "a"
            is_open[name] -= 1
            stack.pop()

    def last_open(name: str) -> int:
        return next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name) if is_open[name] else 0

    at, end_of = 0, len(html)
    while at < end_of:
        m = TOKEN.search(html, at)
        text = html[at : m.start() if m else end_of]
        if text:
            held.append(text)
            if links:
                linked[stack[-1][1]] += len(text)
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name or name == "head":
            continue
        if m[1]:
            if depth := last_open(name):
                pop_to(depth)
            continue
        if name in RAW:
            if not m[3].rstrip().endswith("/"):
                end = _end_of(name).search(html, at)
                at = end.end() if end else (end_of if name in ("script", "style") else at)
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in VOID and name != "hr":
            continue
        if name in ENDS_P and (depth := last_open("p")) and not any(s in BLOCK for s, _ in stack[depth + 1 :]):
            pop_to(depth)
        if name in ENDS and any(is_open[x] for x in ENDS[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in ENDS[name]:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPES:
                    break
        is_open[name] += 1
        if name not in BLOCK:
            links += name == "a"
            stack.append((name, stack[-1][1]))
            continue
        close()
        if name == "hr":
            is_open[name] -= 1
            continue
        attrs = " ".join(x or y or z for _, x, y, z in ATTR.findall(m[3])).lower() if m[3] else ""
        up = stack[-1][1]
        parent.append(up)
        tags.append(name)
        words.append(_names(attrs))
        inside.append(inside[up] or name in ("article", "main") or "main" in attrs.split())
        said = LABEL.search(m[3]) if labelled else None
        labels.append(said[1] == "y" if said else labels[up])
        for column in (length, linked, marks, notice):
            column.append(0)
        stack.append((name, len(tags) - 1))
    pop_to(1)
    close()
    columns = map(np.array, (words, inside, length, linked, marks, notice))
    return Page(np.array(parent), _features(tags, *columns), runs, np.array(labels))


@lru_cache(4096)
def _names(attrs: str) -> int:
    """What the names of classes, id and role say, as a set of bits: a frame (1), perhaps one (2: a name that has other words
    beside a frame's, as in social-history), text (4), both (8)."""
    sure = perhaps = text = False
    for name in attrs.split():
        parts = PARTS.findall(name)
        frames = sum(bool(FRAME_WORDS.fullmatch(p)) for p in parts)
        if frames:
            rest = sum(not FRAME_WORDS.fullmatch(p) and p not in PLAIN_WORDS for p in parts)
            sure, perhaps = sure or not rest, perhaps or rest > 0
        text = text or any(TEXT_WORDS.fullmatch(p) for p in parts)
    return sure * 1 | (perhaps and not sure) * 2 | (text and not sure and not perhaps) * 4 | (text and (sure or perhaps)) * 8


@lru_cache(32)
def _end_of(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I)


def _features(tags: list[str], words: np.ndarray, inside: np.ndarray, length: np.ndarray, linked: np.ndarray, marks: np.ndarray, notice: np.ndarray) -> np.ndarray:
    n = len(tags)
    x = np.zeros((n, FEATURES), np.float64)
    rows = np.arange(n)
    x[rows, [GROUP_OF.get(t, len(GROUPS)) for t in tags]] = 1
    at = len(GROUPS) + 1
    for k in range(4):
        x[:, at + k] = words >> k & 1
    at += 2
    share = np.minimum(1.0, linked / np.maximum(length, 1))
    x[rows, at + 2 + np.digitize(share, [0.05, 0.3, 0.7])] = length > 0
    x[rows, at + 6 + np.digitize(length, [1, 25, 120])] = 1
    x[:, at + 10], x[:, at + 11] = marks > 0, notice > 0
    x[:, at + 12], x[:, at + 13] = inside, ~inside & inside.any()
    x[:, -1] = 1
    return x


class Model(NamedTuple):
    weights: np.ndarray  # log-odds of content by feature
    pair: np.ndarray  # log-potential of (parent, child)


class Messages(NamedTuple):
    content: np.ndarray  # marginal of each node
    pairs: np.ndarray  # joint marginals (parent, child), added up over all nodes that have a parent
    log_total: float  # logarithm of the sum over all labellings


def messages(model: Model, parent: np.ndarray, features: np.ndarray) -> Messages:
    """Sum-product messages over a forest whose parents come before their children."""
    n = len(parent)
    level = np.flatnonzero(parent < 0)
    order = [level]
    order_of = np.argsort(parent, kind="stable")
    starts = np.searchsorted(parent[order_of], np.arange(n + 1))
    while len(level):
        count = starts[level + 1] - starts[level]
        at = np.repeat(starts[level] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
        level = order_of[at]
        order.append(level)
    below, up = np.zeros((n, 2)), np.zeros((n, 2))
    below[:, 1] = features @ model.weights
    for level in reversed(order[1:-1]):
        up[level] = np.logaddexp.reduce(model.pair[None] + below[level][:, None, :], axis=2)
        np.add.at(below, parent[level], up[level])
    down, pairs = np.zeros((n, 2)), np.zeros((2, 2))
    for level in order[1:-1]:
        p = parent[level]
        rest = below[p] + down[p] - up[level]
        joint = model.pair[None] + rest[:, :, None] + below[level][:, None, :]
        joint -= joint.max((1, 2), keepdims=True)
        joint = np.exp(joint)
        pairs += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        down[level] = np.logaddexp.reduce(model.pair[None] + rest[:, :, None], axis=1)
        down[level] -= down[level].max(1, keepdims=True)
    b = below + down
    return Messages(1 / (1 + np.exp(np.clip(b[:, 0] - b[:, 1], -50, 50))), pairs, float(np.logaddexp.reduce(below[order[0]], axis=1).sum()))


#: Hand-labelled pages. An element marked y is content, one marked n is none, and so is what is inside, up to another mark.
#: P stands for a paragraph, S for a short sentence, T for a title, W for a word or two, L for a list of links, I for a link, N for
#: the words of a notice, K for a sentence that is a link.
LAYOUTS = (
    "<nav>L</nav><div class='ad'>S</div><article y><h1>T</h1><p>P<br>P<p>P</p></article><footer>&copy; S</footer>",
    "<nav>L</nav><div class='ad'>P</div><article y><h1>T</h1><p>S</p><p>P</p><div class='ad' n>S</div><p>P</p></article><aside><h2>T</h2>L</aside><footer>W I W</footer>",
    "<header><h2>T</h2><p>S</p></header><div class='wrapper'><div class='sidebar'><h3>T</h3>L</div><article y><h1>T</h1><p>P</p><ul><li>S</li><li>P</li></ul></article></div>",
    "<div class='cookie-notice'><p>P</p></div><main y><h1>T</h1><p>P</p><blockquote>P</blockquote><pre>S</pre><form n><label>W</label><p>S</p></form></main><div class='related'><p>P</p></div>",
    "<article y><section><h2>T</h2><p>P</p></section><section><p>P</p><table><tr><td>W</td><td>S</td></tr></table></section><section class='comments' n><h3>T</h3><div class='comment'><p>P</p></div></section></article><aside><p>P</p></aside>",
    "<div class='menu'>I I I</div><article y><h1>T</h1><p>W.</p><p>P</p><p>S</p></article><div class='newsletter'><p>P</p></div>",
    "<article y><h1>T</h1><div class='ad' n>S</div><p>P</p><div class='promo' n><p>P</p></div><p>P</p><div id='comments' n><p>P</p><p>S</p></div></article>",
    "<article y><p>P</p><div class='advert' n>P</div><p>S</p><form class='search' n><p>S</p></form><div class='related-posts' n><h3>T</h3><p>P</p></div><aside n><p>P</p></aside></article><section class='comments'><div><p>P</p></div></section>",
    "<body y><p>P</p><p>P</p><p>P</p></body>",
    "<body y><h1>T</h1><p>P</p><p>S</p><h2>T</h2><p>P</p></body>",
    "<body y>P<br>P<br>S</body>",
    "<body y><div n>I I I</div><h1>T</h1><p>P</p><p>P</p><hr><div n>&copy; S</div></body>",
    "<body y><nav n>L</nav><h1>T</h1><p>P</p><ul><li>S</li><li>S</li></ul><p>P</p><footer n>S I</footer></body>",
    "<div id='header'><h2>T</h2>S</div><div id='nav'>L</div><div id='content' y><h1>T</h1><p>P</p><p>P</p><p>S</p></div><div id='footer'><p>P</p></div>",
    "<div class='container'><div class='menu'>L</div><div class='text' y>P<br><br>P<br>S</div></div>",
    "<div class='post' y><h2>T</h2><p>P</p><p>S</p><p>P</p><div class='share' n>I I</div></div><div class='comment-list'><div class='comment'><p>P</p></div><div class='comment'><p>S</p></div></div>",
    "<div><div>L</div><div y><h2>T</h2><div>P</div><div>P</div><div>S</div></div><div>W I I</div></div>",
    "<div>I I I I</div><div y><h1>T</h1><p>P</p><p>P</p></div><div>I W I</div>",
    "<table><tr><td>L</td><td y><h1>T</h1><p>P</p><p>P</p></td></tr><tr><td>&copy; S</td></tr></table>",
    "<table><tr><td>I<br>I<br>I</td><td y>P<br>P</td><td>I<br>I</td></tr></table>",
    "<div class='wrapper'><div class='post-body entry-content' y><p>P</p><h3>T</h3><p>P</p><figure><figcaption>S</figcaption></figure></div><div class='sidebar'><h3>T</h3><p>P</p>L</div></div>",
    "<div role='banner'><p>S</p></div><div role='navigation'>L</div><div role='main' y><h1>T</h1><p>P</p><p>P</p></div><div role='complementary'><p>P</p></div><div role='contentinfo'>S</div>",
    "<header>L</header><main y><h1>T</h1><dl><dt>W</dt><dd>P</dd><dt>W</dt><dd>S</dd></dl></main><footer><p>P</p></footer>",
    "<main y><h1>T</h1><p>S</p><ul><li>S</li><li>W W</li><li>S</li></ul><ol><li>P</li><li>S</li></ol></main><div class='subscribe'><h3>T</h3><p>P</p></div>",
    "<noscript><p>Please enable JavaScript. S</p></noscript><div class='story' y><p>S</p><p>P</p><noscript>P</noscript><div class='promo' n><p>P</p></div><p>P</p></div>",
    "<div class='breadcrumbs'>I I W</div><section y><h1>T</h1><p>P</p><p>P</p></section><div class='pagination'>I I I</div><section class='related'><h4>T</h4><p>P</p></section>",
    "<div class='alert'><p>S</p></div><div role='dialog'><p>P</p></div><section class='main-text' y><h1>T</h1><p>P</p><div><p>P</p></div></section>",
    "<article y><h2>T</h2><p>P</p></article><article y><h2>T</h2><p>P</p><table><tr><th>W</th><th>W</th></tr><tr><td>S</td><td>P</td></tr></table></article><aside>L</aside>",
    "<nav>L</nav><form><p>P</p><p>S</p></form><footer><p>P</p></footer>",
    "<div class='navbar'>L</div><div class='login'><p>S</p></div><div class='footer'>I I S</div>",
    "<body y><pre>P</pre></body>",
    "<body y><div>P</div></body>",
    "<body y><div><div><div><div><div><div><p>P</p><p>P</p><p>S</p></div></div></div></div></div></div></body>",
    "<body y><div><div><div><div><div><div><div><div><div>P</div><div>P</div></div></div></div></div></div></div></div></div></body>",
    "<div><div><div><div><div>L</div></div></div></div><div><div><div y><div><div><div><h1>T</h1><p>P</p><p>P</p></div></div></div></div></div></div><div><div><div><p>I W I</p></div></div></div></div>",
    "<body y><pre>P</pre><p>S</p></body>",
    "<nav>L</nav><div class='ad'>N</div><article y><h1>T</h1><p>N</p><p>P</p><p>N</p></article><footer>N</footer>",
    "<nav>L</nav><article y><p>N</p><p>P</p><div class='ad' n>N</div></article><footer><p>N</p></footer>",
    "<div class='ad'>S</div><article y><p>N</p><p>S</p></article><div>N</div>",
    "<div>L</div><div class='post' y><h1>T</h1><p>P</p><p>N</p><p>P</p></div><div>N I</div>",
    "<div class='page'><div class='top'>I I I</div><div class='body' y><h1>T</h1><p>P</p><blockquote><p>P</p></blockquote><p>S</p></div><div class='widget'><p>P</p></div></div>",
    "<section y><p>P</p><p>P</p></section><section class='comments'><h2>T</h2><ol><li><p>P</p></li><li><p>S</p></li></ol></section>",
    "<div><p>I I</p></div><div y><p>P</p><p>P</p><p>W</p></div><div><p>Subscribe to our newsletter. S</p></div><div><p>Copyright W. All rights reserved.</p></div>",
    "<div id='main' y><h1>T</h1><div class='entry'><p>P</p><div class='banner' n>P</div><p>P</p></div></div><div id='sidebar'><div class='widget'><h3>T</h3><p>P</p></div></div>",
    "<nav>L</nav><div class='social-studies' y><h1>T</h1><p>P</p><p>P</p></div><div class='social-links'>I I I</div>",
    "<div class='top-menu'>L</div><div class='share-prices' y><p>P</p><p>P</p><p>S</p></div><div class='share-buttons'>I I W</div><div class='site-footer'>S</div>",
    "<div id='menu-planner' y><h1>T</h1><p>P</p><ul><li>S</li><li>P</li></ul></div><div id='page-footer'><p>W I</p></div>",
    "<nav>L</nav><div class='content-with-aside' y><h2>T</h2><p>P</p><p>P</p></div><div class='right-aside'><p>P</p></div>",
    "<div class='page-header'>L</div><div class='legal-advice-text' y><p>P</p><p>P</p></div><div class='legal'><p>P</p></div>",
    "<nav>L</nav><article y><h1>T</h1><p>P</p><div class='promo-spring' n><p>P</p></div><p>P</p><div class='related-reading' n><p>S</p></div></article>",
    "<div y><p>P</p><p>P</p></div><div class='sponsor-of-day'><p>S</p></div><div class='comment-by-guest'><p>P</p></div>",
    "<nav>L</nav><article y><h1>T</h1><p>P</p><p>K</p><p>P</p></article><footer>I I</footer>",
    "<div class='nav'>L</div><article y><p>K</p><p>P</p><p>K</p><p>S</p><div class='share' n>I I</div></article>",
    "<nav>L</nav><main y><p>P</p><p>K</p><ul><li>K</li><li>S</li></ul></main><aside>L</aside>",
    "<nav>L</nav><div y><p>P</p><p>S</p></div><footer>S</footer>",
    "<nav>L</nav><div y><p>S</p><p>P</p></div>",
    "<nav>L</nav><div y><h1>T</h1><p>S</p><p>P</p><p>S</p></div><div>I W</div>",
    "<nav>L</nav><article y>" + "<div>" * 40 + "<p>P</p></article>",
    "<nav>L</nav><main y>" + "<div>" * 20 + "<p>P</p><p>S</p></main>",
    "<div y><p>P</p><p>P</p><p>P</p></div><div>I I</div>",
    "<div class='page'><div y><h1>T</h1><p>P</p><p>P</p></div><div>I I I</div></div>",
    "<main y><h1>T</h1><p>P</p></main><section class='comments'><h3>T</h3><div><p>P</p></div><div><p>S</p></div></section>",
    "<body y><header n><h1>T</h1><p>P</p></header><h2>T</h2><p>P</p><p>P</p><div class='sponsor' n><p>P</p></div></body>",
)
FILLS, ROUNDS, SEED = 10, 400, 1


def _filled(layout: str, rng: random.Random) -> str:
    """A labelled page, its texts made of random words: of Latin or Cyrillic letters, or of Chinese characters without spaces."""
    script = rng.choice(("latin",) * 5 + ("cyrillic", "han", "han"))
    letters = ("бвгдклмнпрст", "аеиоуы") if script == "cyrillic" else ("bcdfglmnprstv", "aeiou")
    latin = lambda: "".join(rng.choice(letters[0]) + rng.choice(letters[1]) for _ in range(rng.randint(1, 4)))
    han = lambda: "".join(chr(rng.randint(0x4E00, 0x8FFF)) for _ in range(rng.randint(1, 2)))
    word, space, stop, between = (han, "", "。", "") if script == "han" else (latin, " ", ".", " ")
    some = lambda a, b: space.join(word() for _ in range(rng.randint(a, b))).capitalize()
    link = lambda: f"<a href='/x'>{some(1, 4)}</a> "
    made = {
        "P": lambda: between.join(some(4, 20) + stop for _ in range(rng.choice((1, 2, 4, 8)))),
        "S": lambda: some(2, 7) + stop, "T": lambda: some(2, 9), "W": lambda: some(1, 2), "I": link,
        "K": lambda: f"<a href='/x'>{some(4, 14)}{stop}</a>",
        "N": lambda: rng.choice(("All rights reserved.", "Copyright 2020 %s.", "Subscribe to %s.", "Sign up at %s.", "Read more of %s.", "%s uses cookies.")).replace("%s", some(1, 3)),
        "L": lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randint(3, 8))) + "</ul>",
    }
    return re.sub(r"(?<![\w&])[PSTWLINK](?![\w=])", lambda m: made[m[0]](), layout)


@lru_cache(4)
def train(layouts: tuple[str, ...] = LAYOUTS, *, fills: int = FILLS, rounds: int = ROUNDS, prior: float = 0.02) -> Model:
    """Weights and pair potentials of the greatest likelihood of the labels, with a Gaussian prior, by Adam's steps."""
    rng = random.Random(SEED)
    parsed = [parse(_filled(x, rng), labelled=True) for x in layouts for _ in range(fills)]
    parent, x = _forest(parsed)
    y = np.concatenate([p.labels for p in parsed]).astype(int)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[parent[child]], y[child]), 1)
    theta, mean, square = np.zeros(FEATURES + 4), 0.0, 0.0
    for k in range(1, rounds + 1):
        got = messages(Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2)), parent, x)
        g = np.r_[x.T @ (y - got.content), (seen - got.pairs).ravel()] / len(y) - prior / len(parsed) * theta
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        theta = theta + 0.1 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)
    return Model(theta[:FEATURES], theta[FEATURES:].reshape(2, 2))


def _forest(pages: list[Page]) -> tuple[np.ndarray, np.ndarray]:
    """Parents and features of all nodes of some pages, one page after the other."""
    sizes = np.array([len(p.parent) for p in pages])
    first = np.cumsum(sizes) - sizes
    return np.concatenate([np.where(p.parent >= 0, p.parent + f, -1) for p, f in zip(pages, first)]), np.concatenate([p.features for p in pages])


def extract(model: Model, pages: list[str | None]) -> list[str]:
    """The main texts of some pages."""
    parsed = [parse(h) for h in pages]
    if not parsed:
        return []
    keep, first, out = messages(model, *_forest(parsed)).content > 0.5, 0, []
    for p in parsed:
        out.append(" ".join(t for node, t in p.runs if keep[first + node]))
        first += len(p.parent)
    return out


def main_text(pages: DataFrame, model: Model, *, html: str = "html", batch: int = 64) -> DataFrame:
    """The rows without ``html``, with their main ``text`` (in place of a column of that name). Map-only."""
    columns = [c for c in pages.columns if c not in (html, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(k, batch) for k in range(0, b.num_rows, batch)):
                texts = extract(model, part.column(html).to_pylist())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(texts, pa.string())], names=[*columns, "text"])

    schema = ", ".join(f"`{c}` {t}" for c, t in pages.dtypes if c in columns)
    return pages.mapInArrow(run, f"{schema}, text string")
