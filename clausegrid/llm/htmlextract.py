"""Main text of web pages by consensus paths of their hosts.

Pass 1 parses every page, scores its containers and lets each vote, in Spark, for its
generalised tag-class path within the page's host. Pass 2 reads the text of each page from
its container on the host's winning path. A page that lacks that path, or has a container
more than twice as good, is laid out unlike its host and keeps its own best.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, cut
from .urlfilter import host_of

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
_BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul").split())
_CONTAINER = frozenset("article main section div td body center root".split())
#: A start tag closes an open element of these names, up to the nearest of the boundaries.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
           "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set())}
_CLOSES_P = _BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend"}
_NEVER = frozenset((
    "head nav footer aside form script style noscript template iframe button select option datalist textarea input svg math canvas object embed audio video map dialog menu "
    "noembed noframes xmp title").split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form tooltip status".split())
#: Parts of class names and ids that mark what is not the article.
_COMMENTS = frozenset("comment comments commentlist commenters disqus reply replies respond discussion guestbook usercomments ugc".split())
_OTHER = frozenset((
    "ad ads adbox adslot adunit adsense advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos banner "
    "nav navbar navigation menu menus submenu sidebar sidebars aside footer masthead topbar breadcrumb breadcrumbs crumbs pagination pager "
    "cookie cookies consent gdpr notice notices notification popup modal lightbox newsletter subscribe subscription signup signin login paywall "
    "sharing teaser teasers widget widgets toolbar hidden copyright tagcloud outbrain taboola").split())
#: These mark it only in a name that says nothing else: its other parts are neutral, or mark it too.
_MAYBE = frozenset("related recommended recommendations trending popular follow social legal disclaimer search print skip tools tags share rail foot promotion overlay alert".split())
_NEUTRAL = frozenset((
    "post posts article articles story stories page site link links list lists box block blocks bar area item items section sections wrap wrapper container content contents group inner outer "
    "main top bottom left right news video videos more also module panel region zone unit button buttons btn icon icons count title heading col column row grid card cards form field text").split())
#: A header is no part of the article unless it stands in it, or its name says that it is the article's own.
_HEADER = frozenset("header pageheader siteheader".split())
_OWN = frozenset("article entry post story".split())
_WITHOUT = frozenset("has with no without is show hide toggle".split())
_ARTICLE = frozenset("article articlebody content entry post story body text main maincontent".split())


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(raw):
        out.setdefault((name or bare).lower(), a or b or c)
    return out


def _parts(value: str) -> list[str]:
    return [p.lower() for p in _NAME_PARTS.findall(value)]


class _Node:
    __slots__ = ("tag", "parent", "path", "junk", "inside", "items", "mass", "links", "n_links", "waste", "bonus", "depth")

    def __init__(self, tag, parent, path, junk, inside, bonus, depth):
        self.tag, self.parent, self.path, self.junk, self.bonus, self.depth = tag, parent, path, junk, bonus, depth
        self.inside = inside  # an article, or an element of one
        self.items: list = []  # child nodes and strings, in order
        self.mass = self.links = self.n_links = self.waste = 0


def _step(tag: str, attrs: dict[str, str]) -> str:
    """The element's name in a path: its tag and classes, numbers and order taken out."""
    classes = sorted({re.sub(r"[0-9]+", "#", c) for c in attrs.get("class", "").split()})
    return tag + "".join("." + c for c in classes[:4])


def _is_junk(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in _NEVER or (tag == "header" and not in_article):
        return True
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in _ROLES or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    for value in (attrs.get("class", ""), attrs.get("id", "")):
        for word in value.split():
            own = _parts(word)
            if own and own[0] in _WITHOUT:
                continue
            joined = "".join(own)
            if not _COMMENTS.isdisjoint(own) or joined in _COMMENTS:
                return True
            if tag in ("article", "main"):
                continue
            if not _OTHER.isdisjoint(own) or joined in _OTHER:
                return True
            if (not _MAYBE.isdisjoint(own) or joined in _MAYBE) and all(p in _MAYBE or p in _NEUTRAL or p.isdigit() or joined in _MAYBE for p in own):
                return True
            if not in_article and (not _HEADER.isdisjoint(own) or joined in _HEADER) and _OWN.isdisjoint(own):
                return True
    return False


def parse(html: str) -> _Node:
    """The page as a tree. Any input gives one: unclosed, crossed and cut-off markup is closed as it comes."""
    root = _Node("root", None, "", False, False, 1.0, 0)
    stack = [root]
    at, end = 0, len(html)

    def text(value: str) -> None:
        if value:
            stack[-1].items.append(value)

    while at < end:
        m = _MARKUP.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        if closing:
            if tag in ("html", "body"):
                continue  # what follows them still belongs to the page
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in ("article", "main", "body", "table") and tag not in _BLOCK:
                    break  # a stray inline end tag closes no container
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        close, stop = _CLOSES.get(tag, ((), ()))
        if tag in _CLOSES_P:
            close, stop = {*close, "p"}, {*stop, "td", "th", "article", "div", "section", "blockquote", "main", "body", "li", "button"} - {tag if tag in ("li",) else ""}
        if close:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in close:
                    del stack[k:]
                    break
                if stack[k].tag in stop:
                    break
        up = stack[-1]
        attrs = _attributes(m[3] or m[6] or "") if (m[3] or m[6] or "").strip(" /\t\r\n") else {}
        step = _step(tag, attrs)
        bonus = 1.3 if tag == "article" or attrs.get("itemprop", "").lower() == "articlebody" else 1.15 if tag == "main" or attrs.get("role") == "main" else 1.0
        if bonus == 1.0 and attrs and tag in _CONTAINER and not _ARTICLE.isdisjoint(_parts(attrs.get("class", "") + " " + attrs.get("id", ""))):
            bonus = 1.1
        deep = up.depth < 32
        inside = up.inside or bonus == 1.3 or bonus == 1.1 and not _OWN.isdisjoint(_parts(attrs.get("class", "") + " " + attrs.get("id", "")))
        node = _Node(tag, up, f"{up.path}/{step}" if deep else up.path, up.junk or _is_junk(tag, attrs, up.inside), inside, bonus, up.depth + 1)
        up.items.append(node)
        if tag in _VOID or (m[3] or m[6] or "").endswith("/") and tag not in _BLOCK and tag not in _RAW:
            continue
        if tag in _RAW:
            shut = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = shut.end() if shut else end
            continue
        stack.append(node)
    return root


def measure(root: _Node) -> list[_Node]:
    """Fills in each node's article mass, link mass and waste (characters); the containers, in page order."""
    order, todo = [], [root]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += [c for c in reversed(n.items) if isinstance(c, _Node)]
    linked: dict[int, bool] = {}
    for n in order:
        linked[id(n)] = n.tag == "a" or (n.parent is not None and linked[id(n.parent)])
        size = sum(len(c.strip()) for c in n.items if isinstance(c, str))
        if n.junk:
            n.waste = size
        else:
            n.mass = size
            n.links = size if linked[id(n)] else 0
        n.n_links = int(n.tag == "a")
    for n in reversed(order):
        up = n.parent
        if up is not None:
            up.mass += n.mass
            up.links += n.links
            up.waste += n.waste
            up.n_links += n.n_links
    return [n for n in order if n.tag in _CONTAINER and not n.junk]


def score(n: _Node) -> float:
    """Characters of running text, times their share of all that the container holds."""
    own = n.mass - n.links
    return own * own / (n.mass + n.waste) * n.bonus if own > 0 else 0.0


def votes(html: str) -> list[tuple[str, float]]:
    """(path, score relative to the page's best) of the containers that score a fifth of it or more."""
    best: dict[str, float] = {}
    for n in measure(parse(html)):
        best[n.path] = max(best.get(n.path, 0.0), score(n))
    top = max(best.values(), default=0.0)
    return [(p, s / top) for p, s in best.items() if top and s >= 0.2 * top]


def _is_menu(n: _Node) -> bool:
    """Three links or more, short ones, and hardly anything else; a paragraph is none."""
    return n.tag in ("ul", "ol", "div", "section", "table") and n.n_links >= 3 and n.links > 0.8 * n.mass and n.links < 40 * n.n_links


def blocks(container: _Node) -> list[str]:
    """The container's text blocks in page order, white space made single, without what is no part of an article."""
    out: list[str] = []
    own: list[str] = []

    def close() -> None:
        if own:
            joined = " ".join(unescape("".join(own)).split())
            if joined:
                out.append(joined)
            own.clear()

    todo: list = [container]
    while todo:
        n = todo.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            own.append(n)
        elif n.tag == "br":
            own.append(" ")
        elif n is container or not (n.junk or _is_menu(n)):
            if n.tag in _BLOCK:
                close()
                todo.append(None)
            todo += reversed(n.items)
    close()
    return out


def extract(html: str | None, path: str | None = None) -> tuple[str, str, bool]:
    """(text, the container's path, whether that is ``path``)."""
    found = measure(parse(html or ""))
    best = max(found, key=lambda n: (score(n), n.depth), default=None)
    if best is None or not score(best):
        return "", "", False
    voted = max((n for n in found if n.path == path), key=score, default=None) if path else None
    if voted is not None and 2 * score(voted) >= score(best):
        return "\n\n".join(blocks(voted)), voted.path, True
    return "\n\n".join(blocks(best)), best.path, False


def consensus_paths(pages: DataFrame) -> DataFrame:
    """(host, path): each host's path with the most votes (ties: the least path). Sums per (host, path) are partial
    aggregates, so a host may hold any share of the pages."""
    bounded_batches(pages.sparkSession)
    named = pages.select(host_of(F.col("url")).alias("host"), "html").where("html is not null")

    def run(batches):
        for b in batches:
            hosts, paths, scores = [], [], []
            for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                for p, s in votes(html):
                    hosts.append(host)
                    paths.append(p)
                    scores.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(scores, pa.float64())], names=["host", "path", "score"])

    cast = named.mapInArrow(run, "host string, path string, score double").groupBy("host", "path").agg(F.sum("score").alias("votes"))
    return cast.groupBy("host").agg(F.min_by("path", F.struct((-F.round("votes", 6)).alias("v"), "path")).alias("path"))


def main_text(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars, path, consensus.

    A null or empty html, or a page without running text, gives the empty string, path '' and consensus false. Pages
    without a host vote together. Repeated rows give a row each. Other columns are not looked at.
    """
    winners = cut(consensus_paths(pages), "host-paths")
    joined = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(winners, "host", "left").select("page_id", "url", "html", "path")
    schema = T.StructType([joined.schema["page_id"], joined.schema["url"], *(T.StructField(n, t) for n, t in (
        ("text", T.StringType()), ("n_chars", T.LongType()), ("path", T.StringType()), ("consensus", T.BooleanType())))])

    def run(batches):
        for b in batches:
            rows = [extract(h, p) for h, p in zip(b.column("html").to_pylist(), b.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([
                b.column("page_id"), b.column("url"), pa.array([r[0] for r in rows], pa.string()), pa.array([len(r[0]) for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.bool_())], names=schema.names)

    return joined.mapInArrow(run, schema)
