"""Main text of web pages from flat blocks and a decision tree.

A page is cut into flat blocks at its block-level tags.  A block's features are
its own, its predecessor's and its successor's word count and link density, and
as weaker evidence what the elements around it are and call themselves.  A
decision tree, grown here on a small labelled table of pages, tells main text
from the rest.  Pages are independent rows: nothing is shuffled.
"""

from __future__ import annotations

import functools
import html
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import load, slices

#: Elements whose content is never text of the page.
DROPPED = {"script", "style", "noscript", "template", "svg", "head", "iframe", "canvas", "audio", "video", "select", "textarea", "title", "datalist"}
#: Of these the content is no markup and ends at the first end tag of the same name.
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt",
    "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "math", "mfrac", "mi", "mn", "mo", "mrow", "msqrt", "msub", "msup", "mtext", "object",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that hold what surrounds a main text.
AROUND = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MAIN = {"article", "main"}
#: Words in class, id and role that often name such parts, those that name readers' comments, those that say little, and those of main texts.
NAMES = (
    "ad ads adbox adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs byline consent contentinfo cookie cookies copyright disclaimer footer gdpr masthead menu menubar modal nav "
    "navbar navigation newsletter pager pagination popup promo promoted promotion related share sharing sidebar signup sponsor sponsored subscribe tagcloud toolbar"
).split()
COMMENTS = "comment comments commentlist disqus reactions replies respond".split()
HINTS = "alert alertdialog complementary form header login notice notices privacy reader reply response search social tags teaser toc warning widget widgets".split()
MAIN_WORDS = "article body content entry main post story text".split()
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)", re.S
)
NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
FEATURES = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "edge", "named", "hinted", "main", "called", "heading"]
#: What the elements around a block say: edge element, named as such a part (2 for comments), hinted at, main element, called main text.
OUTSIDE = (0, 0, 0, 0, 0)


class Block:
    __slots__ = ("heading", "linked", "parts", "said", "text", "words")

    def __init__(self, said: tuple, heading: int):
        self.parts: list[str] = []
        self.linked = self.words = 0
        self.said, self.heading, self.text = said, heading, ""


def _inside(name: str, attrs: str, said: tuple) -> tuple:
    """What holds inside an element, given what holds around it."""
    edge, named, hinted, main, called = said
    own = 0
    if name in AROUND or name == "header" and not main:
        edge = 1
    if "=" in attrs and name not in ("html", "body"):
        words = {w for m in NAMED.finditer(attrs) for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1] or m[2] or m[3] or "").lower())}
        own = 2 if not words.isdisjoint(COMMENTS) else int(not words.isdisjoint(NAMES))
        named = max(named, own)
        hinted = max(hinted, int(not words.isdisjoint(HINTS)))
        called = max(called, int(not words.isdisjoint(MAIN_WORDS)))
    if name in MAIN and not edge and not own and named < 2:
        main, named, hinted = 1, 0, 0
    return edge, named, hinted, main, called


def blocks(page: str) -> list[Block]:
    """The page's non-empty flat blocks in order; the page may be malformed in any way."""
    out: list[Block] = []
    stack: list[tuple[str, tuple]] = []
    block, links, dropped = Block(OUTSIDE, 0), 0, 0
    at, n = 0, len(page)

    def close() -> None:
        nonlocal block
        block.text = " ".join("".join(block.parts).split())
        if block.text:
            block.words = block.text.count(" ") + 1
            out.append(block)
        block = Block(stack[-1][1] if stack else OUTSIDE, int(bool(stack) and len(stack[-1][0]) == 2 and stack[-1][0][0] == "h" and stack[-1][0][1].isdigit()))

    while at < n:
        m = TOKEN.match(page, at)
        at = m.end()
        text, name = m["text"] or m["cdata"], m["name"]
        if text is not None:
            if not dropped:
                plain = html.unescape(text) if "&" in text else text
                block.parts.append(plain)
                if links:
                    block.linked += len(plain.split())
            continue
        if name is None:
            continue
        name = name.lower()
        if m["end"]:
            if any(x[0] == name for x in stack):
                if name not in INLINE:
                    close()
                while stack:
                    gone = stack.pop()[0]
                    dropped -= gone in DROPPED
                    links -= gone == "a"
                    if gone == name:
                        break
                if name not in INLINE:
                    close()
            continue
        attrs = m["attrs"] or ""
        if name in RAW and not attrs.endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if name in VOID or attrs.endswith("/"):
            if name == "br":
                block.parts.append(" ")
            elif name not in INLINE:
                close()
            continue
        if name == "a" and links:
            links, stack = 0, [x for x in stack if x[0] != "a"]
        if name in ("p", "li", "dt", "dd", "option", "tr", "td", "th"):
            _leave_open(stack, name)
            links = sum(x[0] == "a" for x in stack)
        said = _inside(name, attrs, stack[-1][1] if stack else OUTSIDE)
        stack.append((name, said))
        dropped += name in DROPPED
        links += name == "a"
        if name not in INLINE:
            close()
        elif not block.parts:
            block.said = said
    close()
    return out


def _leave_open(stack: list, name: str) -> None:
    """An opening p, li or cell ends an open one of its kind, with what is open in it, up to the nearest container."""
    for i in range(len(stack) - 1, -1, -1):
        if stack[i][0] == name:
            del stack[i:]
            return
        if stack[i][0] not in INLINE and stack[i][0] not in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            return


def vectors(found: list[Block]) -> list[list[float]]:
    edge = (0.0, 0.0)
    own = [(float(b.words), b.linked / b.words) for b in found]
    return [
        [*own[i], *(own[i - 1] if i else edge), *(own[i + 1] if i + 1 < len(own) else edge), *b.said, b.heading]
        for i, b in enumerate(found)
    ]


def grow(rows: list[list[float]], labels: list[int], depth: int = 12, least: int = 3) -> tuple | float:
    """A binary decision tree by Gini impurity, leaves of at least so many rows: (feature, threshold, at most, above) or the share of main text."""
    share, n = sum(labels) / len(labels), len(rows)
    if depth == 0 or share in (0.0, 1.0) or n < 2 * least:
        return share
    best = None
    for f in range(len(rows[0])):
        order = sorted(range(n), key=lambda i: rows[i][f])
        left, total = 0, sum(labels)
        for k, (i, j) in enumerate(zip(order, order[1:], strict=False), 1):
            left += labels[i]
            if rows[i][f] == rows[j][f] or k < least or n - k < least:
                continue
            impurity = left * (k - left) / k + (total - left) * (n - k - total + left) / (n - k)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, (rows[i][f] + rows[j][f]) / 2)
    if best is None:
        return share
    _, f, cut = best
    sides = [[i for i in range(n) if (rows[i][f] <= cut) == side] for side in (True, False)]
    return (f, cut, *(grow([rows[i] for i in s], [labels[i] for i in s], depth - 1, least) for s in sides))


def decide(tree: tuple | float, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def labelled_pages(seed: int = 1, n: int = 1000) -> list[str]:
    """The labelled table's pages: "+" begins a block of main text and "-" any other, with as many words as such blocks have.

    Layouts are semantic, by class or plain; main texts have headings, long and
    short paragraphs, lists, tables and links; around them stand menus, notices,
    adverts, sidebars, forms, comments and footers, named or not.  Names lie at
    times: a reader's view holds an article, and a box called content has links.
    """
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    words = lambda low, high: " ".join(["w"] * rng.randint(low, high))
    link = lambda low=1, high=4: f"<a>{words(low, high)}</a>"

    def menu() -> str:
        items = [f"<a>-{words(0, 2)}</a>" for _ in range(rng.randint(3, 30))]
        box = pick(["<ul>{}</ul>", "<div>{}</div>", "<p>{}</p>"])
        return box.format("".join(f"<li>{i}</li>" for i in items) if "ul" in box else f"<{(t := pick(['div', 'p']))}>" + f"</{t}><{t}>".join(items) + f"</{t}>")

    def paragraph(first: bool) -> str:
        kind = rng.random()
        if kind < 0.12 and not first:
            return f"<h2>+{words(1, 8)}</h2>"
        if kind < 0.22 and not first:
            return "<ul>" + "".join(f"<li>+{words(1, 14)}" for _ in range(rng.randint(2, 5))) + "</ul>"
        if kind < 0.28:
            return f"<p>+{words(5, 30)} {link(1, 5)} {words(3, 20)}</p>"
        if kind < 0.32 and not first:
            return "<table><tr>" + "".join(f"<td>+{words(0, 4)}" for _ in range(rng.randint(2, 4))) + "</table>"
        low, high = pick([(1, 6), (8, 30), (30, 90), (60, 200), (60, 200)]) if not first else (35, 160)
        return f"<{(t := pick(['p', 'p', 'p', 'blockquote', 'div']))}>+{words(low, high)}</{t}>"

    def main(inside: str) -> str:
        parts = [f"<h1>+{words(2, 11)}</h1>"] if chance(0.6) else []
        n = rng.randint(1, 9)
        if inside == "semantic" and chance(0.4):
            parts += [f"<{(t := pick(['p', 'p', 'li', 'div']))}>+{words(0, 9)}</{t}>" for _ in range(rng.randint(0 if parts else 1, 5))]
        else:
            parts += [paragraph(k == 0) for k in range(n)]
        if inside != "plain" and chance(0.2):
            parts.insert(rng.randrange(1, len(parts) + 1), f"<div class={pick(['ad', 'advert', 'share', 'related', 'newsletter'])}>-{words(1, 40)}</div>")
        if inside == "semantic" and chance(0.25):
            parts.append(pick([f"<p>+{link(1, 12)}</p>", f"<p>+{words(0, 3)}</p>", f"<form><p>-{words(1, 12)}</p></form>", f"<aside>-{words(5, 40)}</aside>"]))
        body = "".join(parts)
        if inside == "semantic":
            body = pick(["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<article><header>{}</header></article>"]).format(body)
            return f"<div class={pick(['reader', 'sidebar-left', 'widget', 'page'])}>{body}</div>" if chance(0.2) else body
        if inside == "class":
            return f"<div class={pick(['content', 'post', 'entry', 'story', 'main-text', 'reader-view', 'search-result', 'widget-box', 'response', 'tags-page', 'alert-page', 'header-less'])}>{body}</div>"
        return pick(["{}", "<div>{}</div>"]).format(body)

    def before(inside: str) -> str:
        named = [
            f"<header><h1>-{words(1, 4)}</h1><p>-{words(2, 12)}</p></header>", f"<nav>{menu()}</nav>", f"<div class={pick(['cookie-notice', 'consent', 'banner'])}><p>-{words(5, 60)}</p></div>",
            f"<div class={pick(['ad', 'sponsored', 'promo'])}>-{words(3, 60)}</div>", f"<div class={pick(['alert', 'notice', 'search', 'login', 'social'])}>-{words(1, 12)}</div>", f"<aside>-{words(2, 70)}</aside>",
            f"<div class=breadcrumbs>-{link()} {link()}</div>", f"<div class={pick(['widget', 'content', 'tags', 'header'])}>{menu()}</div>", f"<form><p>-{words(1, 6)}</p></form>",
        ]
        plain = [menu(), menu(), f"<div>{link().replace('>', '>-', 1)}</div>", f"<p>-{words(0, 2)} {link(2, 4)}</p>"]
        return "".join(pick(plain if inside == "plain" or chance(0.25) else named) for _ in range(rng.randint(0, 4)))

    def after(inside: str) -> str:
        named = [
            f"<footer>-{words(3, 40)}</footer>", f"<div class={pick(['footer', 'copyright'])}><p>-{words(3, 40)}</p></div>", f"<div class={pick(['related', 'tagcloud'])}>{menu()}</div>",
            f"<section class={pick(['comments', 'replies', 'respond'])}><h3>-{words(1, 3)}</h3>" + "".join(f"<{(t := pick(['p', 'article']))}>-{words(3, 120)}</{t}>" for _ in range(rng.randint(1, 4))) + "</section>",
            f"<div class=sidebar><p>-{words(5, 80)}</p>{menu()}</div>", f"<div class=newsletter>-{words(3, 30)}</div>", f"<div class={pick(['tags', 'social', 'widget'])}>{menu()}</div>",
        ]
        plain = [menu(), f"<div>{link().replace('>', '>-', 1)}</div><div>-{words(0, 4)}</div>", f"<p>-{words(0, 3)} {link(2, 4)}</p>"]
        return "".join(pick(plain if inside == "plain" or chance(0.2) else named) for _ in range(rng.randint(0, 3)))

    out = []
    for _ in range(n):
        inside = pick(["semantic", "semantic", "class", "plain"])
        out.append(("" if chance(0.25) else before(inside)) + (main(inside) if chance(0.93) else "") + after(inside))
    return out


def labelled_table(seed: int = 1, n: int = 1000) -> tuple[list[list[float]], list[int]]:
    rows, labels = [], []
    for page in labelled_pages(seed, n):
        found = blocks(page)
        rows += vectors(found)
        labels += [int("+" in b.text[:1]) for b in found]
    return rows, labels


@functools.lru_cache(maxsize=1)
def tree() -> tuple | float:
    return grow(*labelled_table())


def main_text(page: str | None, using: tuple | float) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, v in zip(found, vectors(found), strict=True) if decide(using, v))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    White space inside a block is one space, blocks are joined by an empty line.
    Null and empty html give an empty text; malformed pages give what their
    blocks give; repeated rows and null ids each have a row; other columns are
    ignored.
    """
    grown = tree()

    def run(batches):
        for b in slices(batches):
            texts = [main_text(t, grown) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    three = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return three.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(load(spark, sf_dir, "pages"))
