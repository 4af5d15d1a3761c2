"""Main text of web pages: site templates are found by counting element subtrees per host."""

from __future__ import annotations

import html as entities
import re
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, ship

#: A subtree is a template's when this many differently titled pages of a host have it,
#: and this share of them.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: So many differently titled pages suffice on a host of any size.
MANY_PAGES = 100
#: Template subtrees that may be broadcast; with more, pages are joined with them.
BROADCAST_ROWS = 100_000

#: An element with this part of a page's text is no box.
MOST_TEXT = 0.5

# fixed values: element names of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = set("head script style noscript template iframe object svg canvas audio video form button select textarea input nav aside footer menu dialog title".split())
#: Of these, the ones that stand within a line.
WITHIN = set("script style noscript template iframe object svg canvas audio video button select textarea input".split())
#: Names in class or id of what is not the article, as a word of a name.
_OTHER = re.compile(
    r"(?:^|[_-])(ads?|adverts?|advertisement|advertising|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side-bar|menu|nav|navbar|navigation|breadcrumbs?|cookies?|consent|gdpr|notices?|alert|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|comments?|commentlist|disqus|replies|respond|popup|modal|overlay|footer|masthead|widget|toolbar|pagination|pager|search|copyright|legal|disclaimer)(?:$|[_-])",
    re.I,
)
#: Names that tell what a page has or lacks, not what an element is.
_ABOUT = re.compile(r"(?:with|without|has|have|no|not|non|is|if|show|hide|enable|disable)[_-]", re.I)
_FINE_PRINT = {"legal", "copyright", "disclaimer"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "menu", "menubar", "form"}
_QUOTE_OR_END = re.compile(r"[>\"']")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


_BARRIERS = {"table", "article", "main", "body"}
_KEEPS_ITEMS = {"ul", "ol", "dl", "table", "select", "article", "main", "body", "div"}


class Node:
    """An element: `size` is the length of its text, `marks` the number of articles and main elements in it, `key` its subtree's hash, once measured."""

    __slots__ = ("tag", "attrs", "kids", "size", "marks", "key")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


class _Open:
    """The open elements, with the places of each tag, so that nothing is searched for."""

    def __init__(self, root: Node):
        self.nodes, self.at, self.barriers, self.blocks, self.keeps = [root], {}, [0], [0], [0]

    def push(self, node: Node) -> None:
        n = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(n)
        for tracked, own in ((self.barriers, node.tag in _BARRIERS), (self.blocks, node.tag not in INLINE), (self.keeps, node.tag in _KEEPS_ITEMS)):
            if own:
                tracked.append(n)

    def last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else 0

    def cut(self, at: int) -> None:
        while len(self.nodes) > at:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            for tracked in (self.barriers, self.blocks, self.keeps):
                if tracked[-1] == len(self.nodes):
                    tracked.pop()


class _Tags:
    """Ends of tags, found in time linear in the page."""

    def __init__(self, page: str):
        self.page, self.quotes = page, True
        self.last = {c: page.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """Place of the > that ends a tag; quoted attribute values may hold one; -1 if there is none.

        A quote that nothing closes, and all quotes after a tag that would never end by them, are plain characters.
        """
        if at > self.last[">"]:
            return -1
        i = at
        while self.quotes:
            m = _QUOTE_OR_END.search(self.page, i)
            if not m:
                self.quotes = False
            elif m[0] == ">":
                return m.start()
            elif i <= m.start() < self.last[m[0]] and self.page[max(at, m.start() - 64) : m.start()].rstrip().endswith("="):
                i = self.page.find(m[0], m.end()) + 1
            else:
                i = m.end()
        return self.page.find(">", at)


def parse(page: str) -> tuple[Node, list[Node]]:
    """A lenient tree and its elements in page order: unknown closings are ignored, open elements end with their parent.

    Takes time linear in the page, however deep or broken the markup. What begins a tag that never ends is no text.
    """
    root = Node("#root")
    nodes, stack, tags = [root], _Open(root), _Tags(page)
    at, n, low, kept = 0, len(page), None, 0

    def text(end: int) -> None:
        if end > kept:
            stack.nodes[-1].kids.append(entities.unescape(page[kept:end]))

    while True:
        at = page.find("<", at)
        if at < 0 or at + 1 >= n:
            text(n)
            return root, nodes
        c = page[at + 1]
        if page.startswith("<!--", at):
            text(at)
            end = page.find("-->", at + 4)
            at = kept = end + 3 if end >= 0 else n
            continue
        if page.startswith("<![CDATA[", at):
            text(at)
            end = page.find("]]>", at + 9)
            stack.nodes[-1].kids.append(page[at + 9 : end if end >= 0 else n])
            at = kept = end + 3 if end >= 0 else n
            continue
        closing = c == "/"
        m = _NAME.match(page, at + 1 + closing)
        if not m and c not in "!?":
            at += 1
            continue
        text(at)
        end = tags.end(m.end()) if m else (page.find(">", at) if at <= tags.last[">"] else -1)
        if end < 0:
            return root, nodes
        inside, at = page[m.end() : end] if m else "", end + 1
        kept = at
        if not m:
            continue
        tag = m[0].lower()
        if closing:
            i = stack.last(tag)
            if i and not (tag in INLINE and stack.barriers[-1] > i):
                stack.cut(i)
            elif not i and tag == "br":
                stack.nodes[-1].kids.append(Node("br"))
                nodes.append(stack.nodes[-1].kids[-1])
            continue
        if ends := _CLOSES.get(tag):
            i = max(stack.last(t) for t in ends)
            if i > stack.keeps[-1]:
                stack.cut(i)
        elif tag not in INLINE and tag not in VOID and tag not in RAW and tag not in WITHIN:  # a block ends an open paragraph
            i = stack.last("p")
            if i and stack.blocks[-1] == i:
                stack.cut(i)
        attrs = {}
        if inside.strip(" /"):
            attrs = {a[1].lower(): entities.unescape(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(inside)}
        node = Node(tag, attrs)
        stack.nodes[-1].kids.append(node)
        nodes.append(node)
        if tag in RAW:
            low = page.lower() if low is None else low
            if len(low) != n:  # a few letters change their number of characters
                low = page.translate(_LOWER)
            begin, end = at, low.find(f"</{tag}", at)
            while end >= 0 and low[end + len(tag) + 2 : end + len(tag) + 3] not in ("", ">", "/", " ", "\t", "\n", "\f", "\r"):
                end = low.find(f"</{tag}", end + 2)
            closed = page.find(">", end) if end >= 0 else -1
            body = page[begin : end if end >= 0 else n]
            at = kept = closed + 1 if closed >= 0 else n
            if tag in ("title", "textarea"):
                node.kids.append(entities.unescape(body))
        elif tag not in VOID and not inside.endswith("/"):
            stack.push(node)


_LOWER = {c: c + 32 for c in range(65, 91)}


def size_up(nodes: list[Node]) -> None:
    """Text lengths and marks of all elements, from the last to the first: children before their parents."""
    for node in reversed(nodes):
        size, marks = 0, node.tag in ("article", "main") or node.attrs.get("role") == "main"
        for k in node.kids:
            if isinstance(k, str):
                size += len(k)
            else:
                size += k.size + 1
                marks += k.marks
        node.size, node.marks = size, marks


def measure(nodes: list[Node]) -> None:
    """Subtree hashes of all elements, likewise."""
    for node in reversed(nodes):
        out = blake2b(f"<{node.tag}>".encode("utf-8", "surrogatepass"), digest_size=8)
        for k in node.kids:
            out.update(" ".join(k.split()).encode("utf-8", "surrogatepass") if isinstance(k, str) else b"<" + k.key + b">")
        node.key = out.digest()


def _name_says(node: Node, inside: bool) -> str:
    """`whole` if a class or the id is the name of what is no article, `part` if it contains one, else nothing."""
    found = ""
    for name in f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".split():
        m = _OTHER.search(name)
        if not m or _ABOUT.match(name) or inside and node.tag == "p" and m[1].lower() in _FINE_PRINT:
            continue
        if m[1] == name:
            return "whole"
        found = "part"
    return found


def boilerplate(node: Node, inside: bool, page: Node) -> bool:
    """Whether an element by itself is no part of an article.

    What holds all articles of the page is never taken out by its name or as a form, and by a part
    of its name, or as a form, nothing with most of the page's text is; an article itself only by its whole name.
    """
    if node.tag in ("html", "body", "main", "#root"):
        return False
    a = node.attrs
    if a and ("hidden" in a or a.get("role", "").lower() in _ROLES and node.tag != "form" or "display:none" in a.get("style", "").replace(" ", "").lower()):
        return True
    if node.tag in NEVER and node.tag != "form":
        return True
    if node.tag == "header" and not inside:
        return True
    says = _name_says(node, inside) if a else ""
    if not says and node.tag != "form":
        return False
    if node.tag == "article":
        return says == "whole"
    if page.marks and node.marks == page.marks:
        return False
    return says == "whole" or node.size < MOST_TEXT * page.size


def roots(tree: Node) -> tuple[list[Node], bool]:
    """Articles, else main elements, else everything; whether they are marked as such."""
    found: dict[str, list[Node]] = {"article": [], "main": []}
    todo = [(tree, False)]
    while todo:
        node, inside = todo.pop()
        if node is not tree:
            if boilerplate(node, inside, tree):
                continue
            kind = "article" if node.tag == "article" else "main" if node.tag == "main" or node.attrs.get("role") == "main" else ""
            if kind:
                found[kind].append(node)
                inside = True
            if kind == "article":
                continue
        todo += [(k, inside) for k in reversed(node.kids) if not isinstance(k, str)]
    for kind in ("article", "main"):
        if found[kind]:
            return found[kind], True
    return [tree], False


def _text(node: Node) -> str:
    out, todo = [], [node]
    while todo:
        k = todo.pop()
        if isinstance(k, str):
            out.append(k)
        else:
            todo += [" ", *reversed(k.kids)]
    return "".join(out)


def subtree(node: Node) -> int:
    """Hash of an element with all that is below it; white space does not count."""
    return int.from_bytes(node.key, "little", signed=True)


def candidates(tops: list[Node], marked: bool, page: Node) -> list[Node]:
    """Elements that a template may own: blocks outside a marked article, and boxes inside it.

    Paragraphs, headings and lists' items of a marked article never are, so that copies of an
    article on one host keep their text; neither is a box with half of the article's text.
    """
    out: list[Node] = []
    for top in tops:
        todo = [k for k in top.kids if not isinstance(k, str)]
        while todo:
            k = todo.pop()
            if boilerplate(k, marked, page):
                continue
            own = k.tag not in INLINE and k.tag not in VOID
            if marked:
                own = k.tag in ("div", "section", "ul", "ol", "table", "figure", "details", "header", "center") and k.size < top.size / 2
            if own and k.tag not in ("html", "body"):
                out.append(k)
            todo += [x for x in k.kids if not isinstance(x, str)]
    return out


def extract(page: str | None, templates: frozenset | set = frozenset()) -> str:
    """Blocks of the article in page order, joined by two line feeds."""
    if not page:
        return ""
    tree, nodes = parse(page)
    size_up(nodes)
    tops, marked = roots(tree)
    drop = set()
    if templates:
        measure(nodes)
        drop = {id(n) for n in candidates(tops, marked, tree) if subtree(n) in templates}
    blocks: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for top in tops:
        todo: list = list(reversed(top.kids))
        while todo:
            k = todo.pop()
            if k is None:  # the end of a block
                flush()
            elif isinstance(k, str):
                now.append(k)
            elif k.tag == "br":
                now.append(" ")
            elif boilerplate(k, marked, tree) or id(k) in drop:
                if k.tag in WITHIN:
                    now.append("" if k.tag in RAW else " ")
                elif k.tag not in INLINE:
                    flush()
            elif k.tag in INLINE or k.tag in ("td", "th"):
                if k.tag not in INLINE:
                    now.append(" ")
                todo += reversed(k.kids)
            else:
                flush()
                todo += [None, *reversed(k.kids)]
        flush()
    return "\n\n".join(blocks)


def _title(nodes: list[Node]) -> str:
    """The first heading with text, else the last title element."""
    title = ""
    for n in nodes:
        if n.tag == "h1" and (t := " ".join(_text(n).split())):
            return t
        if n.tag == "title":
            title = " ".join(_text(n).split())
    return title


def _subtrees(batches):
    for b in batches:
        host, tree_hash, title = [], [], []
        for h, page in zip(b.column(0).to_pylist(), b.column(1)):
            tree, nodes = parse(page.as_py() or "")
            size_up(nodes)
            measure(nodes)
            found = {subtree(n) for n in candidates(*roots(tree), tree)} | {0}  # 0 stands for the page itself
            t = int.from_bytes(blake2b(_title(nodes).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
            host += [h] * len(found)
            tree_hash += found
            title += [t] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(tree_hash, pa.int64()), pa.array(title, pa.int64())], ["host", "subtree", "title"])


def _extracted(templates):
    """Text of each page; templates: by host, or None where each row brings its own."""

    def run(batches):
        known = templates.value if templates is not None else None
        for b in batches:
            own = b.column("subtrees").to_pylist() if known is None else [known.get(h) for h in b.column("host").to_pylist()]
            texts = [extract(p.as_py(), frozenset(o or ())) for p, o in zip(b.column("html"), own)]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return run


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Main text of each page (page_id, url, html): page_id, url, text, n_chars.

    Element subtrees are hashed and counted per host by the number of differently titled pages
    that have them; subtrees on min_pages such pages and min_share of the host's (on a
    large host: on many_pages) are templates and are deleted with menus, headers, footers, forms, notices, adverts and comments, which are known
    by element, role, class and id. Counting is aggregated before the shuffle, a large host's
    pages are not brought together. Templates go to all tasks only when they are few
    (`broadcast_rows`); beyond that pages are joined with them by host.

    Null html is empty text; a null url is a host of its own; repeated rows are extracted each;
    extra columns are ignored; an empty table gives no rows.
    """
    spark = pages.sparkSession
    ship(spark)
    space = Workspace(spark, "html")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    seen = rows.select("host", "html").mapInArrow(_subtrees, "host string, subtree long, title long").distinct().groupBy("host", "subtree").agg(F.count("*").alias("n"))
    seen = space.save(seen.where(f"subtree = 0 or n >= {min_pages}"), "subtrees")
    all_pages = seen.where("subtree = 0").select("host", F.col("n").alias("total"))
    found = space.save(seen.where("subtree <> 0").join(all_pages, "host").where(F.col("n") >= F.least(min_share * F.col("total"), F.lit(many_pages))).select("host", "subtree"), "templates")
    if found.count() <= broadcast_rows:
        by_host: dict[str, set] = {}
        for r in found.collect():
            by_host.setdefault(r["host"], set()).add(r["subtree"])
        out = rows.mapInArrow(_extracted(spark.sparkContext.broadcast(by_host)), "page_id long, url string, text string")
    else:
        out = rows.join(found.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")), "host", "left").mapInArrow(_extracted(None), "page_id long, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("long"))
