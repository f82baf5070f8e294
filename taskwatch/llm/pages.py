"""Main text of web pages by a site style tree (operator 9).

All pages of a host are merged into one style tree: a node is a path of tags
with their class names, and it gathers the *presentations* seen there (the
sequence of child elements) and the *contents* (hash of the node's own text).
Per node and host Spark sums how often each presentation and content occurs,
over the host's distinct pages (copies of one article, whatever menus surround
them, are one page), so a host with a third of all pages is spread over all
tasks until its nodes are counted. The entropies of these counts, normalised by
the number of pages, are the node's importance, the larger one of the two: a
menu or notice that looks and reads the same everywhere has an importance near
0, an article's paragraphs near 1. The text of nodes of low importance is
removed from each page; the branches below such a node are judged each by its
own importance. A heading goes with the branch it heads: its text is removed only
if nothing else is left in its parent on that page, so "Ingredients" on all
recipes stays. Inside an article or main element a node of low importance must be
a notice besides: one and the same text, once a page, on nearly all pages of the
host (``NEARLY``). Fewer values than pages alone (alternating labels, cells that
repeat) do not remove anything there.

Entropy alone cannot remove everything the result must not have: a menu whose
entries differ from page to page is as diverse as an article, and a host with
one page has no entropy at all. So the tags and class names that say what a
branch is (``DROPPED``, ``NOISE``) are a prior: those branches go in any case,
and an ``article`` or ``main`` element, if there is one, is the content, from which
only the tree removes more.

Defined results: null, empty or markup-only html gives empty text; broken and
cut-off markup is read as far as it goes; a null url is a host of its own;
repeated pages are returned as often as they come; input columns other than
the key, url and html are not carried along.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from taskwatch.operators.joins import measured
from taskwatch.session import ship_package

#: pages a host needs before its entropies count, and the importance below which a branch goes
MIN_PAGES = 8
LOW = 0.25
#: share of a host's pages that hold a notice inside an article
NEARLY = 0.9
#: a path of more characters continues from its hash, so deep nodes stay apart at a bounded length
MAX_PATH = 512

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

#: elements that are never text of an article (fixed names)
DROPPED = set("nav footer aside form script style noscript template iframe svg canvas button select option "
              "textarea input dialog menu head title object embed audio video map datalist".split())
#: words in class, id or role that mark such branches (fixed words)
NOISE = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner nav navbar "
            "navigation menu breadcrumb breadcrumbs footer sidebar sidebars aside widget widgets cookie cookies consent "
            "notice notices gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social "
            "comment comments respond disqus reply replies related recommended recommendations pagination pager "
            "toolbar masthead search skip alert toast contentinfo complementary".split())
#: words that may stand beside those in one name: "main-nav", "cookie-bar" (fixed words)
PLACES = set("site main top bottom left right page global primary secondary box bar list item link links inner".split())
#: elements that are the page itself and never such a branch (fixed names)
PAGE = {"html", "body", "main"}
#: elements that no form of its own holds: a form around them is wrapped around the page (fixed names)
WRAPPED = {"article", "main", "header", "nav", "footer"}
#: elements that start and end a block of text (fixed names)
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption "
             "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section "
             "summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
#: a start tag of the first kind ends an open element of the second kinds (fixed pairs)
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
          "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
LISTS = set("ul ol dl table tbody thead tfoot select body article main section div td th blockquote".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|\Z)|=\s*'[^']*(?:'|\Z)|[^>=]+|=)*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s\"'=/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none", re.I)
SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "path", "noise", "items")

    def __init__(self, tag: str, path: str, noise: bool):
        self.tag, self.path, self.noise, self.items = tag, path, noise, []


def parse(text: str | None) -> Node:
    """Element tree of ``text``; ``items`` of a node are its children in order,
    nodes and strings of text with references decoded."""
    root = Node("#", "", False)
    if not text:
        return root
    stack, at, size = [root], 0, len(text)
    while at < size:
        m = _TOKEN.search(text, at)
        if m is None:
            _add(stack[-1], text[at:])
            break
        if m.start() > at:
            _add(stack[-1], text[at:m.start()])
        at, tag = m.end(), m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            _end(stack, tag)
            continue
        for gone in ({"p"} if tag in BLOCKS else set()) | CLOSES.get(tag, set()):
            _end_within(stack, gone)
        node = Node(tag, f"{_short(stack[-1].path)}/{_style(tag, m[3])}", _is_noise(tag, m[3]))
        stack[-1].items.append(node)
        if tag in WRAPPED:
            for holder in stack:
                if holder.tag == "form":
                    holder.noise = False
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)", re.I).search(text, at)
            if end is None:
                break
            close = text.find(">", end.end())
            at = size if close < 0 else close + 1
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
    _unwrap(root)
    return root


def _short(path: str) -> str:
    return path if len(path) <= MAX_PATH else f"~{_hash(path) & (2 ** 64 - 1):x}"


def _unwrap(root: Node) -> None:
    """A form that is all there is in the body is the page, not a part of it."""
    node = root
    while True:
        parts = [c for c in node.items if (c.tag not in RAW and c.tag not in VOID and c.tag != "head" if isinstance(c, Node) else c.strip())]
        if len(parts) != 1 or not isinstance(parts[0], Node) or parts[0].tag not in ("html", "body", "form", "div"):
            return
        if parts[0].tag == "form" and node.tag != "#":
            parts[0].noise = False
        node = parts[0]


def _add(node: Node, text: str) -> None:
    node.items.append(_html.unescape(text))


def _end(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag not in BLOCKS and stack[i].tag in BLOCKS:
            return


def _end_within(stack: list[Node], tag: str) -> None:
    """Close an open ``tag`` unless a container stands in between."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if stack[i].tag in LISTS:
            return


def _attributes(attrs: str) -> list[tuple[str, str]]:
    return [(m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in _ATTR.finditer(attrs)]


def _names(attrs: str) -> list[str]:
    """The names in class, id and role."""
    return [t for k, v in _attributes(attrs) if k in ("class", "id", "role") for t in v.split()]


def _style(tag: str, attrs: str) -> str:
    return ".".join([tag, *(w for t in _names(attrs) for w in _WORD.findall(t))]) if "=" in attrs else tag


def _is_noise(tag: str, attrs: str) -> bool:
    """Whether the prior removes such an element. A name counts as a whole: it
    is noise if each word of it is, words of place aside ("cookie-notice" and
    "main-nav", but not "no-sidebar" or "search-results")."""
    if tag in PAGE:
        return False
    if tag in DROPPED:
        return True
    if not attrs or attrs.isspace():
        return False
    if any(k == "hidden" or k == "style" and _HIDDEN.search(v) for k, v in _attributes(attrs)):
        return True
    for t in _names(attrs):
        w = set(_WORD.findall(t))
        if w & NOISE and w <= NOISE | PLACES:
            return True
    return False


def _nodes(node: Node):
    """All nodes that the prior leaves, parents first."""
    pending = [node]
    while pending:
        n = pending.pop()
        if not n.noise:
            yield n
            pending.extend(c for c in reversed(n.items) if isinstance(c, Node))


def content(root: Node) -> list[Node]:
    """The outermost articles or mains outside noise; if there are none, those
    within it, which is then around the page; else the whole tree."""
    for noisy in (False, True):
        for tag in ("article", "main"):
            found, pending = [], [root]
            while pending:
                n = pending.pop()
                if n.noise and not noisy:
                    continue
                if n.tag == tag:
                    found.append(n)
                else:
                    pending.extend(c for c in reversed(n.items) if isinstance(c, Node))
            if found:
                return found
    return [root]


def _gone(part: Node, low: frozenset) -> set[int]:
    """Ids of the nodes below ``part`` whose own text goes: those of ``low``
    paths, headings only where their parent holds no other text that stays."""
    order, alive, gone = [], set(), set()
    pending = [(part, None)]
    while pending:
        node, parent = pending.pop()
        order.append((node, parent))
        pending.extend((c, node) for c in node.items if isinstance(c, Node) and not c.noise)
    for node, parent in reversed(order):  # children before parents
        if node.tag not in HEADINGS and node.path not in low and any(isinstance(c, str) and c.strip() for c in node.items):
            alive.add(id(node))
        if parent is not None and id(node) in alive:
            alive.add(id(parent))
    for node, parent in order:
        if node.path in low and not (node.tag in HEADINGS and id(parent) in alive):
            gone.add(id(node))
    return gone


def blocks(root: Node, low: frozenset = frozenset(), notices: frozenset = frozenset()) -> list[str]:
    """Blocks of text of the page's content. ``low`` holds the paths of nodes
    whose own text goes, ``notices`` those whose text goes inside an article
    or main; a page header outside the content goes, too."""
    parts = content(root)
    whole = parts == [root]
    low = low if whole else notices
    out, run = [], []

    def close():
        text = SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    for part in parts:
        gone = _gone(part, low) if low else ()
        pending: list = [part]
        while pending:
            item = pending.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                run.append(item)
            elif item.noise and item is not part or whole and item.tag == "header":
                if item.tag in BLOCKS:
                    close()
            elif item.tag == "br":
                run.append(" ")
            else:
                block = item.tag in BLOCKS or item.tag == "#"
                if block:
                    close()
                    pending.append(None)
                pending.extend(c for c in reversed(item.items) if id(item) not in gone or isinstance(c, Node))
        close()
    return out


def features(root: Node) -> list[tuple[str, str, int]]:
    """``(path, kind, hash)`` of each node of a page once: ``p`` for the
    presentation, ``c`` for its own text, ``m`` if several nodes of the path have text."""
    out, texts = set(), {}
    for n in _nodes(root):
        shape = ">".join(dict.fromkeys(c.tag for c in n.items if isinstance(c, Node)))
        own = SPACE.sub(" ", "".join(c for c in n.items if isinstance(c, str))).strip()
        out.add((n.path, "p", _hash(shape)))
        if own:
            out.add((n.path, "c", _hash(own)))
            texts[n.path] = texts.get(n.path, 0) + 1
    out.update((path, "m", 0) for path, k in texts.items() if k > 1)
    return list(out)


def _hash(text: str) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def host(url) -> "F.Column":
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


def style_tree(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(host, path, n, presentation, content, texts, most, multi)``: distinct
    pages with the node, the normalised entropies of its presentations and
    contents, contents in all, those of the commonest one, and pages on which
    several such nodes have text. The row of the empty path counts all pages. Of
    the copies of one page the one with the largest nodes stands for all."""
    ship_package(pages.sparkSession)

    names = ["path", "kind", "value"]

    def run(batches):
        for b in batches:
            hosts, pages_, found, ends, seen = [], [], [], [0], set()
            for h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root = parse(text)
                page = (h, _hash("\n\n".join(blocks(root))))
                if page not in seen:
                    seen.add(page)
                    hosts.append(page[0])
                    pages_.append(page[1])
                    found.extend(features(root))
                    ends.append(len(found))
            columns = zip(*found) if found else ([], [], [])
            nodes = pa.StructArray.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(pages_, pa.int64()), pa.ListArray.from_arrays(
                pa.array(ends, pa.int32()), nodes)], names=["host", "page", "nodes"])

    counted = (pages.select(host(F.col(url)).alias("host"), F.col(html).alias("html"))
               .mapInArrow(run, "host string, page long, nodes array<struct<path: string, kind: string, value: long>>")
               .groupBy("host", "page").agg(F.max("nodes").alias("nodes"))
               .select("host", F.inline("nodes"))
               .groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n")))
    # entropy of the values: ln(total) - sum(n ln n) / total
    by = counted.groupBy("host", "path", "kind").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nln"), F.max("n").alias("most"))
    entropy = F.when(F.col("total") > 1, (F.log("total") - F.col("nln") / F.col("total")) / F.log("total")).otherwise(1.0)
    return by.groupBy("host", "path").agg(
        F.max(F.when(F.col("kind") == "p", F.col("total"))).alias("n"),
        F.max(F.when(F.col("kind") == "p", entropy)).alias("presentation"),
        F.max(F.when(F.col("kind") == "c", entropy)).alias("content"),
        F.max(F.when(F.col("kind") == "c", F.col("total"))).alias("texts"),
        F.max(F.when(F.col("kind") == "c", F.col("most"))).alias("most"),
        F.coalesce(F.max(F.when(F.col("kind") == "m", F.col("total"))), F.lit(0)).alias("multi"))


def unimportant(tree: DataFrame, min_pages: int = MIN_PAGES, low: float = LOW) -> DataFrame:
    """``(host, paths, notices)``: text-bearing nodes of low importance, whose
    presentation and own text hardly vary over enough pages, and those of them
    that are notices inside an article, too: one text, once a page, nearly everywhere."""
    weak = tree.where((F.col("texts") >= min_pages) & (F.greatest("presentation", "content") < low))
    weak = weak.groupBy("host").agg(F.collect_list(F.struct("path", "texts", "most", "multi")).alias("weak"))
    pages = tree.where("path = ''").select("host", F.col("n").alias("pages"))
    once = lambda w: ((w["most"] >= NEARLY * F.col("pages")) & (w["most"] >= NEARLY * w["texts"])
                      & (w["multi"] <= (1 - NEARLY) * w["texts"]))
    return weak.join(pages, "host").select(
        "host", F.col("weak.path").alias("paths"), F.filter("weak", once)["path"].alias("notices"))


#: a table of low branches up to this size goes to all tasks, a larger one is joined by host
BROADCAST_BYTES = 16 << 20


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``key``, ``url``, ``text`` and ``n_chars`` per page."""
    found, rows, _ = measured(unimportant(style_tree(pages, url, html)).select(F.col("host").alias("_host"), "paths", "notices"))
    size = found.agg(F.sum(F.length(F.array_join("paths", " ")))).first()[0] or 0
    source = pages.select(F.col(key), F.col(url), host(F.col(url)).alias("_host"), F.col(html).alias("_html"))
    joined = source.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, "_host", "left").select(
        key, url, "_html", "paths", "notices")
    key_type, url_type = pages.schema[key].dataType.simpleString(), pages.schema[url].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = ["\n\n".join(blocks(parse(t), frozenset(p or ()), frozenset(q or ())))
                     for t, p, q in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())],
                                             names=[key, url, "text"])

    return joined.mapInArrow(run, f"`{key}` {key_type}, `{url}` {url_type}, text string").withColumn(
        "n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    from taskwatch.llm.common import read
    return extract(read(spark, sf_dir, "pages"))
