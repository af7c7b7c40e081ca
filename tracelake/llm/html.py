"""Operator 3: main text of web pages by tree scoring.

The markup is read in one pass into a tree of block elements. Each block of text passes points for
its length and commas to the elements around it: all to the nearest container, half to the next,
less further up. A container's points are discounted by its link density. The best container is kept
with those of its siblings that score or read alike, less parts that are not the article: menus,
headers, footers, sidebars, notices, adverts, forms, scripts, comments, and lists of links. A form, a
container whose names articles may have too, or speak both for and against one, is in doubt: it goes if
it holds less than ``SHARE`` of the page's unlinked text. Where nothing is left, or nothing but such
elements beside much more that went by its names, the page is read again and names and forms only
lower the score.

Rows: null html is empty and gives an empty text. Unclosed, wrongly nested and cut-off markup is read
as far as it goes. Repeated rows are extracted alike. An empty table gives no rows. Only the id, url
and html columns are read.
"""

from __future__ import annotations

import html
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelake.llm.common import map_arrow, strings

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)(?:>|\Z))", re.S)
_ATTRIBUTES = re.compile(r"""(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

_RAW = {"script", "style", "textarea", "title", "xmp", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_OFF = {"nav", "aside", "footer", "form", "button", "select", "option", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "map", "dialog", "menu", "head", "fieldset"}
_SOFT = {"form", "fieldset"}
_TEXT = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dt", "dd", "pre", "figcaption", "caption", "summary", "address"}
_BOXES = {"html", "body", "div", "section", "article", "main", "header", "ul", "ol", "dl", "table", "thead", "tbody", "tfoot", "tr", "blockquote", "figure", "details", "center", "hgroup", "search"}
_BLOCKS = _TEXT | _BOXES | (_OFF - {"option"})
#: What an opening tag closes first, and the element that stops the search.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_WEIGHT = {"article": 30, "main": 20, "div": 5, "section": 5, "blockquote": 3, "td": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "table": -3, "th": -5}
_NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored promo promotion banner breadcrumb breadcrumbs comment comments disqus replies reply respond cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription signup signin login register footer foot masthead menu menus nav navbar navigation pager pagination popup modal overlay related recommended recommendations sharing social "
    "sidebar sidebars widget widgets toolbar topbar outbrain taboola tags shoutbox".split()
)
#: Names that an article's own container may have as well.
_UNSURE = frozenset("alert contact copyright disclaimer feedback form legal rating ratings search share skip".split())
_ARTICLE = frozenset("article body content entry main page post text blog story hentry".split())
_OFF_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}

#: Less of the page's unlinked text makes a doubtful element no article.
SHARE = 0.4
#: How an element is in doubt: by form, unsure or mixed names, or by names against it alone.
OPEN, NAMED = 1, 2


class _Tree:
    __slots__ = ("parent", "tag", "points", "chars", "linked", "blocks", "doubts", "unread")

    def __init__(self):
        self.parent, self.tag, self.points, self.chars, self.linked = [-1], ["html"], [0.0], [0], [0]
        self.blocks: list[tuple[int, str]] = []  # owner, text
        self.doubts: list[tuple[int, int]] = []  # node, place in the page
        self.unread = 0  # unlinked characters of elements left out by their names


def _judge(tag: str, attributes: str, in_article: bool) -> tuple[bool, int, float]:
    """Whether an element is no part of an article, or that is in doubt or by its names only, and its weight."""
    weight = float(_WEIGHT.get(tag, 0))
    named = good = unsure = False
    doubt = tag in _SOFT
    off = (tag in _OFF and not doubt) or (tag == "header" and not in_article)
    if attributes and "=" in attributes or "hidden" in attributes:
        for m in _ATTRIBUTES.finditer(attributes):
            name, value = m.group(1).lower(), m.group(2) or m.group(3) or m.group(4) or ""
            if name == "role":
                doubt |= value.lower() == "form"
                off |= value.lower() in _OFF_ROLES and value.lower() != "form"
            elif name in ("hidden", "aria-hidden"):
                off |= name == "hidden" or value.lower() == "true"
            elif name == "style":
                off |= "display:none" in value.replace(" ", "").lower()
            elif name in ("class", "id") and tag not in ("html", "body"):
                parts = {x.lower() for x in _NAME_PARTS.findall(value)}
                article = not parts.isdisjoint(_ARTICLE)
                if not parts.isdisjoint(_NOT_ARTICLE) and tag not in ("article", "main"):
                    named = True
                elif "header" in parts and not in_article and not article:
                    named = True
                unsure |= not parts.isdisjoint(_UNSURE) and tag not in ("article", "main")
                good |= article
                weight += 25 * article
            elif name == "itemprop":
                weight += 25 * (value.lower() == "articlebody")
                good |= value.lower() == "articlebody"
    return off, OPEN if doubt or (named and good) else NAMED if named else OPEN if unsure else 0, weight


def _read(page: str, drop: frozenset[int] = frozenset(), vetoes: bool = True) -> _Tree:
    """The tree of a page, without the elements at the places in ``drop`` and, with ``vetoes``, those of names against them."""
    tree = _Tree()
    stack: list[tuple[str, int]] = [("html", 0)]  # tag, node of the nearest block element
    opened: Counter[str] = Counter()  # elements on the stack by tag: what isn't open is never looked for
    text: list[str] = []
    linked = 0  # characters of text so far that are in links
    links = off = articles = 0
    breaks = at = 0
    by_name = False  # what is off is so by its names

    def flush() -> None:
        nonlocal linked, breaks
        if text:
            s = "".join(text)
            if "&" in s:
                s = html.unescape(s)
            s = " ".join(s.split())
            if s:
                _add(tree, stack[-1][1], s, min(linked, len(s)))
            text.clear()
        linked = breaks = 0

    def write(s: str) -> None:
        nonlocal linked, breaks
        if by_name and not links:
            tree.unread += len(s.strip())
        if s and not off:
            text.append(s)
            if links:
                linked += len(s)
            if not s.isspace():
                breaks = 0

    def close(k: int) -> None:
        """Ends the elements from the k-th on."""
        nonlocal off, links, articles, by_name
        if any(t in _BLOCKS for t, _ in stack[k:]):
            flush()
        for t, _ in stack[k:]:
            opened[t] -= 1
            links -= t == "a"
            articles -= t in ("article", "main")
        del stack[k:]
        if off and len(stack) <= off:
            off, by_name = 0, False

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            write(page[at:])
            break
        if m.start() > at:
            write(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(1):
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k][0] == tag:
                    close(k)
                    break
            continue
        if tag in _RAW:
            stop = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "br":
            breaks += 1
            if breaks >= 2:
                flush()
            else:
                write(" ")
                breaks = 1
            continue
        if tag in _VOID:
            if tag == "hr":
                flush()
            continue
        if tag in _BLOCKS:
            flush()
            for k in range(len(stack) - 1, 0, -1) if opened["p"] else ():  # a block ends an open paragraph
                if stack[k][0] == "p":
                    close(k)
                    break
                if stack[k][0] in _BOXES:
                    break
            if tag in _CLOSES:
                ends, stops = _CLOSES[tag]
                for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in ends) else ():
                    if stack[k][0] in ends:
                        last = stack[k][0]
                        close(k)
                        if last != "td" and last != "th" or not opened["tr"] or tag != "tr":
                            break
                    elif stack[k][0] in stops:
                        break
            if tag == "body":
                off, by_name = 0, False
            bad, doubt, weight = _judge(tag, m.group(3), articles > 0) if not off else (False, 0, 0.0)
            if doubt and not bad:
                if not vetoes:
                    weight -= 25
                elif doubt == NAMED or m.start() in drop:
                    bad, by_name = True, not off
                else:
                    tree.doubts.append((len(tree.tag), m.start()))
            tree.parent.append(stack[-1][1])
            tree.tag.append(tag)
            tree.points.append(weight)
            tree.chars.append(0)
            tree.linked.append(0)
            stack.append((tag, len(tree.tag) - 1))
            if bad and not off:
                off = len(stack) - 1
        else:
            bad = False
            if not off and m.group(3):
                bad, doubt, _ = _judge(tag, m.group(3), articles > 0)
                bad |= doubt > 0 and vetoes
            stack.append((tag, stack[-1][1]))
            if bad:
                off = len(stack) - 1
        opened[tag] += 1
        links += tag == "a"
        articles += tag in ("article", "main")
    flush()
    for i in range(len(tree.tag) - 1, 0, -1):  # children come after their parents
        tree.chars[tree.parent[i]] += tree.chars[i]
        tree.linked[tree.parent[i]] += tree.linked[i]
    return tree


def _add(tree: _Tree, owner: int, text: str, linked: int) -> None:
    """A block of text: its points go to the containers around it."""
    tree.blocks.append((owner, text))
    n = len(text)
    tree.chars[owner] += n  # what lies around it gets its sums at the end
    tree.linked[owner] += linked
    points = (1 if n >= 25 else n / 25) + text.count(",") + text.count("，") + text.count("、") + min(n / 100, 3)
    node = tree.parent[owner] if tree.tag[owner] in _TEXT else owner
    level = 0
    while node >= 0 and level < 5:
        tree.points[node] += points / (1, 2, 6, 9, 12)[level]
        node, level = tree.parent[node], level + 1


def extract(page: str) -> str:
    tree = first = _read(page)
    plain = tree.chars[0] - tree.linked[0]
    slight = lambda whole: frozenset(at for i, at in first.doubts if first.chars[i] - first.linked[i] < SHARE * whole)
    drop = slight(plain)
    if drop:
        tree = _read(page, drop)
    text = _main(tree)
    if text and (more := slight(plain + first.unread)) != drop and not _main(_read(page, more)):
        text = ""  # only doubtful elements are left, and what went by its names is most of the page
    return text or _main(_read(page, vetoes=False))


def _main(tree: _Tree) -> str:
    if not tree.blocks:
        return ""
    parent, tag, n = tree.parent, tree.tag, len(tree.tag)
    density = [tree.linked[i] / tree.chars[i] if tree.chars[i] else 0.0 for i in range(n)]
    score = [tree.points[i] * (1 - density[i]) if tree.chars[i] else -1e9 for i in range(n)]
    boxes = [i for i in range(n) if tag[i] not in _TEXT and tag[i] not in ("html", "ul", "ol", "dl", "tr", "thead", "tbody", "tfoot", "table") and tree.chars[i]]
    best = max(boxes, key=lambda i: (score[i], i), default=0)
    keep = {best}
    least = max(10.0, 0.2 * score[best])
    for i in range(n):
        if best and i != best and parent[i] == parent[best] and tree.chars[i]:
            long = tree.chars[i] > 80 and density[i] < 0.25
            if tag[i] in ("p", "pre", "blockquote") and long or tag[i] in _BOXES and score[i] >= least and density[i] < 0.25:
                keep.add(i)
    inside, poor = [False] * n, [False] * n
    for i in range(n):  # parents come before children
        up = parent[i]
        inside[i] = i in keep or (up >= 0 and inside[up])
        poor[i] = (up >= 0 and poor[up]) or (i not in keep and inside[i] and tag[i] in _BOXES and density[i] > 0.5)
    return "\n".join(text for owner, text in tree.blocks if inside[owner] and not poor[owner])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, the url, ``text`` and ``n_chars``."""
    id_type = pages.schema[id_col].dataType.simpleString()

    def run(batch):
        texts = [extract(x) for x in strings(batch, "html")]
        yield {id_col: batch.column("id"), url_col: batch.column("url"), "text": texts, "n_chars": [len(x) for x in texts]}

    return map_arrow(pages, {"id": F.col(id_col), "url": F.col(url_col).cast("string"), "html": F.col(html_col).cast("string")}, f"`{id_col}` {id_type}, `{url_col}` string, text string, n_chars bigint", run)
