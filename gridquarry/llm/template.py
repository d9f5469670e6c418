"""Main text of web pages by removing site templates.

Each page is parsed leniently into a tree, and each block element that holds text
gets a hash of its place (the tags and classes around it), its tags and its text.
Spark counts, per host, the pages of different articles on which each hash occurs.
A subtree that recurs at a place where most of what stands there recurs, on many
pages of the host, is that site's template and is deleted; text that merely repeats
among articles stands at places where most does not. Within the element that holds
most of the text, where copies of an article look like that too, only boxes go that
are on most pages. Of what is left, the article is the marked element (article,
main) that holds enough of the text, else everything. Menus, forms, footers, scripts
and the like also go by their tags and roles, unless they hold most of the page's
text, as a form around a whole page does. Adverts, comments and notices go by class
names that say nothing else, but in an article only where that place, whatever
its text, is a fixture of the host: it stands on half of its pages, and on
``LEAST_PAGES`` at least. A header outside the article is the site's, one inside is the article's.
"""

from __future__ import annotations

import html
import re
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Container
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from ._shared import ROW, cut, map_rows, numbered

#: A subtree is a template at a place where at least this share of what stands there recurs, if it occurs on at least so
#: many pages of its host, or recurs at all and what recurs there does so on COMMON_PAGES ...
LEAST_PAGES, LEAST_SHARE = 4, 0.5
#: ... or if it occurs on so many pages that are at least this share of the host's.
COMMON_PAGES, COMMON_SHARE = 20, 0.5
#: What holds more than this share of a page's text is its heart, unless marked elements are.
MOST_TEXT = 0.5
#: Marked elements are the heart, or the article, if they hold at least this share of the text, or of what is left.
LEAST_TEXT = 0.25

#: Templates of all hosts that are broadcast (8 bytes each); more are joined.
BROADCAST = 1_000_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
#: Elements without text of the page, and those that by their tags are no part of an article.
SILENT = frozenset("head script style noscript template iframe object svg canvas audio video map select textarea input title datalist".split())
DROPPED = SILENT | frozenset("nav aside footer form button menu dialog fieldset".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr li dd dt summary".split()) | {"hr"}
#: What an opening tag closes first, and where that search stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
INLINE_SCOPE = frozenset("html body div section article main aside nav header footer table td th li ul ol form blockquote button".split())
#: Elements that are never templates by themselves: parts of a text, list or table.
PARTS = frozenset("html body head h1 h2 h3 h4 h5 h6 li dd dt tr td th tbody thead tfoot caption figcaption summary".split())
#: Elements that class names and ids can mark as no part of the article.
MARKABLE = frozenset("div section ul ol dl details figure p span".split())
#: Words of class names that mark an element as no part of the article; those that an article may use for its own
#: boxes count outside it only; and words that may stand beside them in a name ("comment-list", "ad_box").
UNWANTED = frozenset("ad ads adv advert adverts advertisement advertisements advertising breadcrumb breadcrumbs comment comments commentlist cookie cookies consent gdpr disqus footer navbar navigation newsletter pager pagination promo promoted related replies respond share sharing sidebar social sponsor sponsored subscribe subscription".split())
OUTER = frozenset("alert alerts banner disclaimer header masthead menu menubar modal nav notice notices notification notifications popup recommended search signup skip toolbar topbar widget widgets".split())
NEUTRAL = frozenset("area articles bar block box buttons container content form group inner item items links list main module panel posts section site thread top bottom left right wrap wrapper".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|![^>]*(?:>|\Z)|\?[^>]*(?:>|\Z)|(/?)([A-Za-z][^\s/>]*)((?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|[\"'])*)(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?", re.S)
HOST = r"(?i)^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    names: str = ""
    id: str = ""
    role: str = ""
    hidden: bool = False
    children: list = field(default_factory=list)
    slot: int = 0
    hash: int = 0
    text: int = 0


class Stack(list):
    """The open elements, and how many there are of each tag, so that stray tags cost nothing however deep the page is."""

    def __init__(self, nodes: list[Node]):
        super().__init__(nodes)
        self.open: dict[str, int] = defaultdict(int)

    def cut(self, k: int) -> None:
        while len(self) > k:
            self.open[self.pop().tag] -= 1


def parse(source: str) -> Node:
    """A tree of elements and decoded texts; unclosed and stray tags are borne with as browsers do, roughly."""
    root = Node("#root")
    stack, at, size = Stack([root]), 0, len(source)
    while at < size:
        m = TAG.search(source, at)
        if m is None:
            stack[-1].children.append(html.unescape(source[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br"))
            for k in range(len(stack) - 1, 0, -1) if stack.open[tag] else ():
                if stack[k].tag == tag:
                    stack.cut(k)
                    break
                if tag not in BLOCKS and stack[k].tag in INLINE_SCOPE:
                    break  # an inline end tag doesn't close blocks
            continue
        if tag in ENDS_P:
            _close(stack, {"p"}, INLINE_SCOPE)
        if tag in CLOSES:
            _close(stack, *CLOSES[tag])
        node = Node(tag)
        if m[3] and not m[3].isspace():
            for name, value in ATTRIBUTE.findall(m[3]):
                name = name.lower()
                if name in ("class", "id", "role"):
                    setattr(node, {"class": "names"}.get(name, name), html.unescape(value.strip("\"'")).lower())
                elif name == "hidden" or name == "aria-hidden" and "true" in value.lower() or name == "style" and re.search(r"display\s*:\s*none", value.lower()):
                    node.hidden = True
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(source, at)
            if tag in ("title", "textarea"):
                node.children.append(html.unescape(source[at : end.start() if end else size]))
            at = end.end() if end else size
            continue
        stack.open[tag] += 1
        stack.append(node)
    return root


def _close(stack: Stack, tags: set, stop) -> None:
    for k in range(len(stack) - 1, 0, -1) if any(map(stack.open.get, tags)) else ():
        if stack[k].tag in tags:
            stack.cut(k)
            return
        if stack[k].tag in stop:
            return


def marked(name: str, inside: bool) -> bool:
    """Whether a class name or id says that the element is no part of the article, and nothing else."""
    words = [w for w in re.split("[^a-z0-9]+", name) if w]
    known = [w in UNWANTED or w in OUTER and not inside for w in words]
    return any(known) and all(k or w in NEUTRAL or w in OUTER for k, w in zip(known, words, strict=True))


def named(node: Node, inside: bool) -> bool:
    """Whether the element's class names, or a box's id, mark it."""
    if node.tag not in MARKABLE or not (node.names or node.id):
        return False
    return any(marked(name, inside) for name in node.names.split()) or node.tag in ("div", "section", "ol", "ul") and node.id not in OUTER and marked(node.id, inside)


def unwanted(node: Node, inside: bool, most: float, fixtures: Container[int]) -> bool:
    """Whether the element never holds an article's text.

    inside: within the article, where headers and notices are the article's own. most: the length of text beyond which
    an element that shows is kept whatever its tag and role. fixtures: hashes of the marked places that are fixtures.
    """
    if node.hidden or node.tag in SILENT:
        return True
    if node.text <= most:
        if node.tag in DROPPED or node.tag == "header" and not inside:
            return True
        if node.role and not inside and node.tag not in ("html", "body", "main", "article") and node.role in ROLES or node.role in ("complementary", "navigation"):
            return True
    return named(node, inside) and (not inside or fixture_hash(node) in fixtures)


def fixture_hash(node: Node) -> int:
    """Of the place and the names of an element, without its text."""
    return xxh3_64_intdigest(f"fixture {node.slot} {node.tag} {node.names} {node.id}".encode("utf-8", "surrogatepass")) >> 1 | 1


def measured(root: Node) -> int:
    """Sets the place, hash and length of text of the elements that hold text, menus and the like too; returns the page's length."""
    order, todo = [], [(root, 0)]
    while todo:
        x, around = todo.pop()
        if x.hidden or x.tag in SILENT:
            continue
        x.slot = xxh3_64_intdigest(f"{around} {x.tag} {x.names}".encode("utf-8", "surrogatepass")) if x.tag in BLOCKS else around
        order.append(x)
        todo += [(c, x.slot) for c in x.children if not isinstance(c, str)]
    for x in reversed(order):
        parts = [c.strip() if isinstance(c, str) else str(c.hash) if c.hash else "" for c in x.children]
        x.text = sum(len(p) if isinstance(c, str) else c.text for p, c in zip(parts, x.children, strict=True))
        if x.text:
            content = "\x00".join(parts)
            x.hash = xxh3_64_intdigest(f"{x.slot} {x.tag} {content}".encode("utf-8", "surrogatepass")) >> 1 | 1
    return root.text


def kind_of(x: Node) -> str:
    return "article" if x.tag == "article" else "main" if x.tag == "main" or x.role == "main" and x.tag != "body" else ""


def hearts(root: Node) -> tuple[list[Node], bool]:
    """The marked elements that hold enough of the text, else the innermost element that holds most of it; and whether they are marked."""
    for kind in ("article", "main"):
        found, todo = [], [root]
        while todo:
            x = todo.pop()
            if kind_of(x) == kind and x.hash:
                found.append(x)
            else:
                todo += [c for c in x.children if not isinstance(c, str) and c.hash]
        if found and sum(x.text for x in found) >= LEAST_TEXT * root.text:
            return found, True
    x = root
    while deeper := [c for c in x.children if not isinstance(c, str) and c.hash and c.tag in BLOCKS and c.text > MOST_TEXT * root.text]:
        x = deeper[0]
    return [x], False


#: How often an element must occur to be a template: at a place where most recurs, on half of a few pages, on half of
#: many; and a marked place within an article, on half of a few.
FREE, LARGE, STRICT, FIXTURE = 0, 1, 2, 3


def removable(root: Node) -> list[tuple[Node, int]]:
    """The elements of a measured page that may be templates, and how often each must occur to be one.

    What holds marked elements is none; what holds most of a page's text is LARGE. Boxes inside a heart are STRICT and
    paragraphs are none; but if a page's body is its heart, paragraphs are STRICT and boxes FREE, as they are outside.
    """
    found, named = hearts(root)
    heart, holds, out = {id(x) for x in found}, set(), []
    whole = not named and found[0].tag in ("#root", "html", "body")
    todo: list = [(root, False, ())]
    while todo:
        x, inside, path = todo.pop()
        box = x.tag in BLOCKS and x.tag not in PARTS
        if id(x) in heart:
            for y in (x, *_up(path)):
                holds.add(id(y))
            inside = True
            if box and not named:
                out.append((x, LARGE))
        elif box and not (inside and not whole and x.tag == "p"):
            large = not inside and x.text > MOST_TEXT * root.text
            out.append((x, LARGE if large else STRICT if inside and (not whole or x.tag == "p") else FREE))
        todo += [(c, inside, path if inside else (x, path)) for c in x.children if not isinstance(c, str) and c.hash]
    return [(x, how) for x, how in out if not (named and id(x) in holds)]


def hearth(found: list[Node], by_mark: bool) -> set[int]:
    """The hearts in which names alone decide nothing: marked ones, or one that is not the whole page."""
    return set() if not by_mark and found[0].tag in ("#root", "html", "body") else {id(x) for x in found}


def marked_inside(root: Node) -> list[Node]:
    """The elements of a measured page whose names mark them and that lie within its hearts."""
    within, out = hearth(*hearts(root)), []
    todo = [(root, False)]
    while todo:
        x, inside = todo.pop()
        inside = inside or id(x) in within
        if inside and x.hash and named(x, True):
            out.append(x)
        todo += [(c, inside) for c in x.children if not isinstance(c, str) and c.hash]
    return out


def _up(path: tuple):
    while path:
        x, path = path
        yield x


def subtrees(source: str | None) -> tuple[int, list[tuple[int, int, int]]]:
    """A hash of the page's article as marked, else of the page; and (hash, place, how often it must occur) of the subtrees that may be templates, each once."""
    root = parse(source or "")
    measured(root)
    found, named = hearts(root)
    article = xxh3_64_intdigest(" ".join(str(x.hash) for x in (found if named else [root])).encode()) >> 1
    elements = {x.hash: (x.hash, x.slot >> 1, how) for x, how in removable(root)}
    places = {h: (h, h, FIXTURE) for h in map(fixture_hash, marked_inside(root))}
    return article, sorted((elements | places).values())


class Known:
    """The templates of a host among those of all, which are sorted and hold the host in their hash."""

    def __init__(self, keys: array, host: int):
        self.keys, self.host = keys, host

    def __len__(self) -> int:
        return len(self.keys)

    def __contains__(self, hash: int) -> bool:
        k = bisect_left(self.keys, hash ^ self.host)
        return k < len(self.keys) and self.keys[k] == hash ^ self.host


def host_hash(host: str) -> int:
    return xxh3_64_intdigest(host.encode("utf-8", "surrogatepass")) >> 1


def left(root: Node, template: Container[int]) -> list[tuple[Node, str]]:
    """Deletes the templates, then what is unwanted; sets the length of the text that is left. Returns the elements marked as article or main that are in no other of their kind, with the kind."""
    whole = measured(root)
    gone = {id(x) for x, _ in removable(root) if x.hash in template} if template else set()
    within_heart = hearth(*hearts(root))
    order, outermost, todo = [], [], [(root, frozenset(), False)]
    while todo:
        x, within, inside = todo.pop()
        order.append(x)
        kind = kind_of(x)
        if kind and kind not in within:
            outermost.append((x, kind))
            within |= {kind}
        inside = inside or bool(kind) or id(x) in within_heart
        x.children = [c for c in x.children if isinstance(c, str) or not (id(c) in gone or unwanted(c, inside, MOST_TEXT * whole, template))]
        todo += [(c, within, inside) for c in reversed(x.children) if not isinstance(c, str)]
    for x in reversed(order):
        x.text = sum(len(c.strip()) if isinstance(c, str) else c.text for c in x.children)
    return outermost


def main_nodes(root: Node, template: Container[int] = frozenset()) -> list[Node]:
    """The elements that hold the article once templates are deleted; none where that is the whole page."""
    outermost = left(root, template)
    for kind in ("article", "main"):
        found = [x for x, k in outermost if k == kind and x.text]
        if found and sum(x.text for x in found) >= LEAST_TEXT * root.text:
            return found
    return []


def texts(nodes: list[Node]) -> list[str]:
    """The blocks of text in page order."""
    blocks: list[str] = []
    held: list[str] = []

    def flush():
        if block := " ".join("".join(held).split()):
            blocks.append(block)
        held.clear()

    # depth first without recursion: trees of broken pages may be deep
    todo: list = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            held.append(x)
        elif x.tag == "br":
            held.append(" ")
        else:
            if x.tag in BLOCKS or x.tag == "hr":
                flush()
                todo.append(None)
            todo += reversed(x.children)
    flush()
    return blocks


def main_text(source: str | None, template: Container[int] = frozenset()) -> str:
    """The page's main text, without the subtrees whose hashes are given."""
    root = parse(source or "")
    return " ".join(texts(main_nodes(root, template) or [root]))


def templates(trees: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, hash) of the templates and fixtures among ``trees`` (host, article, found: the subtrees of a page of each article)."""
    many = trees.groupBy("host").agg(F.count("*").alias("pages"))
    each = trees.select("host", F.inline("found"))
    counts = each.groupBy("host", "slot", "how", "hash").agg(F.count("*").alias("n"))
    again = F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0))
    slots = counts.groupBy("host", "slot", "how").agg(again.alias("again"), (again / F.sum("n")).alias("share"))
    counts = counts.where("n > 1").join(slots, ["host", "slot", "how"]).join(many.hint("rebalance"), "host")  # rebalanced, so that both sides are shuffled and a host can be split
    n, half = F.col("n"), F.col("n") >= COMMON_SHARE * F.col("pages")
    free = (F.col("how") == FREE) & (F.col("share") >= LEAST_SHARE) & ((n >= least_pages) | (F.col("again") >= COMMON_PAGES))
    return counts.where(free | half & (n >= COMMON_PAGES) | half & (n >= least_pages) & F.col("how").isin(LARGE, FIXTURE)).select("host", "hash").distinct()


def extracted(pages: DataFrame, id: str = "page_id", url: str = "url", source: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """For each row of ``pages``: its row number, id, url, text and n_chars.

    Null or empty pages have empty text. Pages whose url has no host are of the
    host "". Only pages of different articles count toward a template, so copies of one
    delete nothing. Ids may be null or repeat; an empty table gives no rows; other
    columns are not read. Pages of any length and depth are read whole; one tree is
    held at a time. Marked elements that hold equally much count alike: all of them
    are the article, in page order. Hosts with fewer than ``least_pages`` pages of
    different articles have no templates.
    """
    rows = numbered(pages, F.col(id).alias("id"), F.col(url).alias("url"), F.col(source).alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)))
    rows = rows.withColumn("page", F.md5(F.concat_ws("\n", "host", F.coalesce("html", F.lit("")))))

    def parts(columns):
        number, names, hosts, sources = columns
        pages = [subtrees(s) for s in sources]
        found = [[{"hash": h ^ mix, "slot": p, "how": k} for h, p, k in found] for mix, (_, found) in zip(map(host_hash, hosts), pages, strict=True)]
        return [number, names, hosts, [article for article, _ in pages], found]

    trees = cut(map_rows(rows.select(ROW, "page", "host", "html"), f"{ROW} long, page string, host string, article long, found array<struct<hash: long, slot: long, how: int>>", parts))
    found = cut(templates(trees.groupBy("host", "article").agg(F.min_by("found", ROW).alias("found")), least_pages))  # of pages of one article, the first counts
    kind = f"{ROW} long, id {rows.schema['id'].dataType.simpleString()}, url string, text string, n_chars long"
    if found.count() <= BROADCAST:
        keys = rows.sparkSession.sparkContext.broadcast(array("q", sorted(r[0] for r in found.select("hash").distinct().collect())))
        rows = rows.withColumn("own", F.lit(None).cast("array<long>"))
    else:  # each page gets those of its own subtrees that are templates
        each = trees.groupBy("page").agg(F.first("host").alias("host"), F.first("found").alias("found")).select("page", "host", F.explode("found.hash").alias("hash"))
        own = each.join(found.hint("rebalance"), ["host", "hash"]).groupBy("page").agg(F.collect_list("hash").alias("own"))
        keys, rows = None, rows.join(own.hint("rebalance"), "page", "left")

    def read(columns):
        number, ids, urls, sources, hosts, own = columns
        known = [Known(keys.value if keys else array("q", sorted(x or ())), host_hash(h)) for x, h in zip(own, hosts, strict=True)]
        out = [main_text(s, t) for s, t in zip(sources, known, strict=True)]
        return [number, ids, urls, out, [len(t) for t in out]]

    return map_rows(rows.select(ROW, "id", "url", "html", "host", "own"), kind, read).withColumnRenamed("id", id).withColumnRenamed("url", url)
