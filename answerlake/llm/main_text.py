"""Main text of web pages: flat blocks, described with their neighbours, kept by a tree.

A page is cut at block tags into blocks of text; inline tags, comments, scripts, styles and
other elements whose content is no prose leave no text. A block is described by its word
count and link density, those of the blocks before and after it (an article's blocks have
neighbours in the article alone), whether it stands in the article, whether the page has
one, whether it ends like a sentence, and how firmly an element around it (inside the
article, if it is in one) is a menu, header, footer, sidebar, notice, advert, form or
comment list by its tag, role, class or id: 1 for a tag or a name of such words alone (site-
footer), 0.5 for a name that also has others (header-image), of which the tree decides by
words, links and neighbours. A name that only says that something is there or not (no-
sidebar, has-comments, comments-open) marks nothing. A form marks neither an article that it
holds nor blocks of which it has over half of the page's words. What else is around an
``article`` or ``main`` by class or id marks it only on pages that have another that nothing
marks. A decision tree decides which blocks stay. It is trained on a small table of labelled
blocks: pages with hand-set labels (labelled_pages.txt), in several sizes, and pages that
are built from rules below.

Character references are decoded, white space inside a block becomes one blank, blocks
are trimmed and joined by one blank in page order.

Cases: null and empty html give ''; unclosed elements end with their parent or the page;
an unclosed comment, script or style runs to the end; broken references stay as they are;
repeated rows are extracted each; null ids and urls are carried; extra columns are not read.
"""

import html as references
import itertools
import pkgutil
import re

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession

from answerlake.llm import query
from answerlake.llm.common import col, per_text, table

FEATURES = ("n_words", "link_density", "words_before", "links_before", "words_after", "links_after",
            "in_article", "has_article", "marked", "heading", "item", "sentence")
MAX_DEPTH, SIZES = 12, (0.5, 1, 1.6, 2.5)

_attributes = r"""[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*"""
_tag = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|math|textarea|select|iframe|object|canvas|title|button)(?=[\s/>])"
    rf"(?:(?<=svg){_attributes}/>|(?<=math){_attributes}/>|{_attributes}>.*?(?:</\1\s*>|\Z)|[^>]*>.*?(?:</\1\s*>|\Z))"
    r"|<[!?][^>]*>"
    rf"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)({_attributes}|[^>]*)>", re.S | re.I)
_attribute = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_part = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_end = re.compile(r"""[.!?:;\u2026\u3002\uff01\uff1f\u0964\u06d4\u061f\u1362]["'\u2019\u201d\u00bb)\]]*\Z""")
_placeholder = re.compile(r"\{(\d+)(?::(\d+))?(\.?)\}")

# Elements that end a block, and those of them that hold others.
CONTAINERS = frozenset("""html body div section article main nav header footer aside form ul ol dl table
fieldset figure dialog details menu center blockquote""".split())
BLOCKS = CONTAINERS | frozenset("""p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption figcaption pre hr br address
summary legend option thead tbody tfoot head link meta""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("br hr img input link meta area base col embed source track wbr".split())
ARTICLE_TAGS = frozenset(("article", "main"))
MARKED_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
# Words of class, id and role that name what is not the article.
MARKS = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion nav navbar
navigation menu breadcrumb breadcrumbs header masthead banner topbar footer foot copyright colophon sidebar side
aside complementary contentinfo widget related recommended recommendations cookie cookies consent gdpr notice
alert popup modal overlay newsletter subscribe subscription signup login form search share sharing social comment
comments reply replies respond disqus discussion pagination pager toolbar hidden teaser outbrain taboola
disclaimer""".split())
# Words of names that describe a layout or state, not the element's role.
STATES = frozenset("""no not non without has have with is open opened on off closed enabled disabled layout template
theme columns""".split())
# Words of names that add nothing to a mark beside them.
PLAIN = frozenset("""wrapper wrap container inner outer block box area section zone region group holder panel pane
module list item items link links bar top bottom left right site page main global primary secondary row col column
content text title thread button slot unit post entry story article body view large small mobile desktop sticky
fixed message""".split())
ARTICLE_MARKS = frozenset("article content post entry story main maincontent articlebody".split())


def _named(attributes: str) -> tuple:
    """The words of class, id and role, how firmly they mark, and whether the element is hidden."""
    words, mark, hidden = set(), 0.0, False
    for name, value in _attribute.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for one in value.split():
                parts = {w.lower() for w in _part.findall(one)}
                words |= parts
                marks = parts & MARKS
                if marks and not parts & STATES and not (marks == {"header"} and parts & ARTICLE_MARKS):
                    mark = max(mark, 1.0 if parts <= MARKS | PLAIN else 0.5)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            hidden = True
    return words, mark, hidden


def blocks(page: str) -> list:
    """(text, words, words in links, in article, marked, heading, item) of each block."""
    out, parts, state = [], [], {"links": 0, "heading": 0, "item": 0}
    # open containers: (tag, in article, marked by tag and by name, by names around the article only, in a form)
    stack, nothing = [], ("", False, (False, 0.0), 0.0, False)
    in_link = 0

    def flush():
        nonlocal parts
        text = " ".join(references.unescape("".join(t for t, _ in parts)).split())
        if text:
            linked = sum(len(t.split()) for t, in_a in parts if in_a)
            _, article, marked, around, form = stack[-1] if stack else nothing
            out.append((text, len(text.split()), linked, article, marked, state["heading"], state["item"], around, form))
        parts = []

    at = 0
    for m in _tag.finditer(page):
        if m.start() > at:
            parts.append((page[at:m.start()], in_link > 0))
        at = m.end()
        tag = (m.group(3) or "").lower()
        if not tag:
            if m.group(1):
                parts.append((" ", False))
            continue
        closing = bool(m.group(2))
        if tag == "a":
            in_link = 0 if closing else 1
        if tag not in BLOCKS:
            continue
        flush()
        state["heading"] = int(tag in HEADINGS and not closing)
        if tag in ("li", "dt", "dd"):
            state["item"] = int(not closing)
        if tag not in CONTAINERS:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
            in_link = 0
            continue
        _, article, (firm, soft), around, form = stack[-1] if stack else nothing
        words, named, hidden = _named(m.group(4) or "")
        own = tag in MARKED_TAGS and tag != "form" or tag == "header" and not article or hidden
        in_form = form or tag == "form"
        enters = not article and not own and named < 1 and tag != "form" and (
            tag in ARTICLE_TAGS or not named and (
                "main" in words or bool(words & ARTICLE_MARKS and tag in ("div", "section"))))
        if tag in ("body", "html"):
            own, named, enters = False, 0.0, False
        if enters:
            in_form = False
            if tag in ARTICLE_TAGS or "main" in words:
                soft, around = 0.0, soft
        stack.append((tag, article or enters, (firm or own, max(soft, named)), around, in_form))
    if at < len(page):
        parts.append((page[at:], in_link > 0))
    flush()
    clear = any(b[3] and not any(b[4]) and not b[7] for b in out)
    whole = 2 * sum(b[1] for b in out if b[8] and not b[3]) > sum(b[1] for b in out)
    return [(*b[:4], max(*map(float, b[4]), b[7] if clear else 0.0, float(b[8] and (b[3] or not whole))), *b[5:7])
            for b in out]


def described(found: list) -> list:
    """The features of each block."""
    has_article = float(any(b[3] for b in found))
    size = [(float(b[1]), min(1.0, b[2] / b[1])) for b in found]

    def beside(i, k):
        return size[k] if 0 <= k < len(found) and found[k][3] == found[i][3] else (0.0, 0.0)

    return [(*size[i], *beside(i, i - 1), *beside(i, i + 1),
             float(b[3]), has_article, b[4], float(b[5]), float(b[6]),
             float(bool(_end.search(b[0])))) for i, b in enumerate(found)]


def _prose(n: int, links: int = 0, end: str = ".") -> str:
    words = ("river stone market early walks under clouds while people carry paper lamps toward old "
             "houses near quiet fields").split()
    text = [words[(7 * i + n) % len(words)] for i in range(n)]
    return " ".join(f'<a href="/{i}">{w}</a>' if i < links else w for i, w in enumerate(text)) + end


def hand_labelled_pages():
    """Pages as lists of (html, whether its blocks are main text): the layouts of the file, in several sizes."""
    lines = pkgutil.get_data(__package__, "labelled_pages.txt").decode().splitlines()
    layouts = [list(g) for full, g in itertools.groupby((x for x in lines if not x.startswith("#")), bool) if full]
    for layout, size in itertools.product(layouts, SIZES):
        def prose(m, size=size):
            n, linked = (int(m.group(1)), int(m.group(2) or 0))
            words = max(1, round(n * size)) if n > 1 else n
            return _prose(words, words if linked == n else round(linked * size), m.group(3))

        yield [(_placeholder.sub(prose, html), sign[0] == "+") for sign, html in (x.split(" ", 1) for x in layout)
               for _ in range(int(sign[1:] or 1))]


def labelled_pages():
    """Pages as lists of (html, whether its blocks are main text), built from rules."""
    linked = "".join(f'<li><a href="/{i}">{_prose(2)}</a></li>' for i in range(6))
    menus = [f"<nav><ul>{linked}</ul></nav>", f'<div class="menu"><ul>{linked}</ul></div>', f"<ul>{linked}</ul>"]
    heads = [f"<header><h1>{_prose(4)}</h1><p>{_prose(9)}</p></header>", f'<div id="masthead">{_prose(6)}</div>']
    noise = [f'<div class="ad">{_prose(n)}</div>' for n in (3, 9, 30)]
    noise += [f'<aside><h3>{_prose(3)}</h3><p>{_prose(n)}</p></aside>' for n in (8, 40)]
    noise += [f'<div class="cookie-notice"><p>{_prose(25)}</p></div>', f"<form><p>{_prose(12)}</p></form>",
              f'<div class="related"><ul>{linked}</ul></div>']
    ends = [f'<section id="comments"><p>{_prose(n)}</p><p>{_prose(18)}</p></section>' for n in (5, 60)]
    feet = [f"<footer>{_prose(8)}</footer>", f'<div class="footer"><p>{_prose(14)}</p></div>']
    around = [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"),
              ("<div>", "</div>"), ("<table><tr><td>", "</td></tr></table>")]
    sizes = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144)
    for i, (opens, closes) in itertools.product(range(22), around):
        size = lambda k: sizes[(i * k + k) % len(sizes)]  # noqa: B023, E731
        body = [f"<h1>{_prose(size(3))}</h1>", f"<p>{_prose(size(1))}</p>", f"<p>{_prose(size(2), size(2) // 4)}</p>",
                f"<h2>{_prose(3)}</h2>", f"<ul><li>{_prose(size(4))}</li><li>{_prose(size(5))}</li></ul>",
                f"<p><b>{_prose(size(6))}<br><p>{_prose(size(7))}</p>", f"<blockquote><p>{_prose(size(8))}</p></blockquote>"]
        body = body[i % 3:] + body[:i % 3]
        bare = opens in ("<div>", "<table><tr><td>")
        loose = [menus[2], f"<p>{_prose(2 + i % 3, 1 + i % 2)}</p>", menus[2]] if bare else [
            f"<div>{_prose(size(9))}</div>"]
        late = [menus[2]] if bare else [f"<p>{_prose(size(10))}</p>", menus[2]]
        yield [("<body>", False), *[(x, False) for x in loose], (menus[i % 3], False), (heads[i % 2], False),
               (noise[i % len(noise)], False), (opens, True), *[(x, True) for x in body[:4]],
               (noise[(3 * i + 1) % len(noise)], False), *[(x, True) for x in body[4:]], (closes, True),
               *[(x, False) for x in late], (ends[i % 2], False), (noise[(5 * i + 2) % len(noise)], False),
               (feet[i // 2 % 2], False)]


def labelled_blocks() -> list:
    """(features, label) of every block of the labelled pages."""
    rows = []
    for page in itertools.chain(hand_labelled_pages(), labelled_pages()):
        html = "".join(part for part, _ in page)
        labels, done = [], 0
        for k in range(1, len(page) + 1):
            n = len(blocks("".join(part for part, _ in page[:k])))
            labels += [float(page[k - 1][1])] * (n - done)
            done = n
        rows += list(zip(described(blocks(html)), labels))
    return rows


def train(spark: SparkSession, rows: list = None, max_depth: int = MAX_DEPTH):
    """The tree as nested (feature, threshold, left, right) with labels as leaves."""
    data = spark.createDataFrame([(Vectors.dense(f), y) for f, y in rows or labelled_blocks()],
                                 ["features", "label"])
    model = DecisionTreeClassifier(maxDepth=max_depth, minInstancesPerNode=3, seed=0).fit(data.coalesce(1))

    def read(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        split = node.split()
        return split.featureIndex(), split.threshold(), read(node.leftChild()), read(node.rightChild())

    return read(model._java_obj.rootNode())


def decide(tree, features) -> bool:
    while isinstance(tree, tuple):
        feature, threshold, left, right = tree
        tree = left if features[feature] <= threshold else right
    return tree > 0.5


def main_text(page: str, tree) -> str:
    found = blocks(page)
    return " ".join(b[0] for b, f in zip(found, described(found)) if decide(tree, f))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
            tree=None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    tree = tree or train(pages.sparkSession)

    def texts():
        def apply(given):
            out = [main_text(h.decode("utf-8", "replace"), tree) if h else "" for h in given]
            return {"text": pa.array(out, pa.string()), "n_chars": pa.array([len(t) for t in out], pa.int64())}
        return apply

    return per_text(pages, html, texts, "text string, n_chars long",
                    {page_id: col(page_id), url: col(url)})


@query("op4_html_main_text")
def op4(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
