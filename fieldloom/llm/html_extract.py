"""Main-text extraction from web pages by site template removal.

Every page is read once into its element tree; block subtrees are hashed and Spark counts,
per host, on how many pages each hash occurs. Subtrees that recur across many pages of a
host are its template and are deleted. Within an article only whole containers can be
template: a recurring paragraph is text (a quoted passage, a licence line). Menus and
adverts differ in wording from page to page, so containers that hold nothing but links, and
those that name themselves so, are also hashed by their shape (tags and classes without
text); a name alone deletes nothing within an article.

Forms, menus, scripts and reader comments are no text wherever they stand. On pages without
an article the whole body is taken, and there what a container calls itself counts, too.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_type, map_rows, materialize
from .url_filter import host_path

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
#: Elements whose content is no markup, by the pattern of their end.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template textarea svg iframe object title".split()}
_MARKS = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Za-z]+")
#: Parts that the pages with one template are dealt into.
SALTS = 16
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img wbr br picture source ruby rt rp".split())
_CONTAINER = frozenset("div section ul ol dl nav footer header aside form table figure main menu details".split())
_NOT_TEXT = frozenset("nav footer aside form menu button select option input dialog head canvas audio video map".split())
#: Words in a class, id or role by which a page marks what is not its article.
_MARKED = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars footer masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments disqus reply replies respond share sharing social related recommended "
    "recommendations widget widgets toolbar pagination pager search contentinfo complementary".split()
)
#: Names of containers of what readers wrote, or of other articles.
_COMMENTS = frozenset("comment comments comment-list commentlist comments-area replies reply respond disqus disqus_thread related teaser".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BOUNDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "p": {"article", "body", "section", "div", "td", "li", "blockquote"}}


class Node:
    __slots__ = ("block", "children", "marks", "parent", "tag")

    def __init__(self, tag: str, marks: tuple, parent: Node | None):
        self.tag, self.marks, self.parent, self.children = tag, marks, parent, []
        self.block = parent.block if parent and tag in _INLINE else self  # the nearest that is not inline


def tag_end(html: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, beyond quoted values; -1 if there is none. A quote that never closes is an ordinary character."""
    while m := _STOP.search(html, at):
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while html[before].isspace():
            before -= 1
        close = html.find(m[0], m.end()) if html[before] == "=" else -1
        at = close + 1 if close >= 0 else m.end()
    return -1


def tokens(html: str) -> Iterator[tuple[int, int, str, str, bool]]:
    """(start, end, tag, attributes, whether it ends the element) of tags; comments, declarations and raw elements have no tag.

    One pass: where quotes leave a tag without an end, quotes count no more, and where no ``>``
    follows all else is text.
    """
    at, quotes = html.find("<"), True
    while at >= 0:
        end, tag, attrs, closes = at + 1, None, "", False
        if html.startswith("<!--", at):
            found = html.find("-->", at + 4)
            end, tag = (found + 3 if found >= 0 else len(html)), ""
        elif html.startswith(("<!", "<?"), at):
            found = html.find(">", at)
            if found < 0:
                return
            end, tag = found + 1, ""
        elif m := _NAME.match(html, at):
            found = tag_end(html, m.end()) if quotes else -1
            if found < 0:
                quotes, found = False, html.find(">", m.end())
                if found < 0:
                    return
            end, tag, attrs, closes = found + 1, m[2].lower(), html[m.end() : found], bool(m[1])
            if tag in _RAW and not closes:
                last = _RAW[tag].search(html, end)
                end, tag = (last.end() if last else len(html)), ""
        if tag is not None:
            yield at, end, tag, attrs, closes
        at = html.find("<", end)


def parse(html: str) -> Node:
    """A tree of elements and texts that takes any input in linear time; unclosed elements end with their parent, unmatched ends count for nothing."""
    root = top = Node("#root", (), None)
    opened: Counter[str] = Counter()
    last = 0

    def close(node: Node) -> Node:
        """What is open once the node has ended, with all it holds."""
        n = top
        while n is not node.parent:
            opened[n.tag] -= 1
            n = n.parent
        return n

    for start, end, tag, attrs, closes in tokens(html):
        if start > last:
            top.children.append(html[last:start])
        last = end
        if not tag:
            continue
        if closes:
            if opened[tag] > 0:
                node = top
                while node.tag != tag:
                    node = node.parent
                top = close(node)
            continue
        if tag in _CLOSES_P and opened["p"] > 0 or tag in _CLOSES:
            ends, bounds = _CLOSES.get(tag, frozenset()), _BOUNDS.get(tag, frozenset())
            node = top.block
            while node.parent and (node.tag not in bounds or node is top and node.tag in ends):
                if node.tag in ends or node.tag == "p" and tag in _CLOSES_P:
                    top = close(node)
                    break
                if node.tag != "p":
                    break
                node = node.parent.block
        marks = tuple((a.lower(), b or c or d) for a, b, c, d in _MARKS.findall(attrs)) if "=" in attrs else ()
        node = Node(tag, marks, top)
        top.children.append(node)
        if tag not in _VOID and not attrs.endswith("/"):
            top = node
            opened[tag] += 1
    if last < len(html):
        top.children.append(html[last:])
    return root


def _names(node: Node) -> bool:
    """Whether a container's class, id or role has a word for what is no article."""
    return node.tag in _CONTAINER and any(w.lower() in _MARKED for _, v in node.marks for w in _WORD.findall(v))


def _is_comment(node: Node) -> bool:
    """A container (or article) of reader comments or teasers, by a whole name among its marks."""
    return (node.tag in _CONTAINER or node.tag == "article") and any(t in _COMMENTS for _, v in node.marks for t in v.lower().split())


def _unmarked(node: Node, inside: bool = False) -> bool:
    """Whether a node can be text. ``inside`` an article names other than those of comments don't count."""
    if node.tag in _NOT_TEXT or _is_comment(node):
        return False
    return inside or not _names(node)


def _walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, Node)]


def roots(tree: Node) -> list[Node]:
    """The outermost articles; without any, what is marked as the main part; else the whole body."""

    def outermost(fits) -> list[Node]:
        found, todo = [], [tree]
        while todo:
            n = todo.pop()
            if not _unmarked(n):
                continue
            if fits(n):
                found.append(n)
            else:
                todo += [c for c in reversed(n.children) if isinstance(c, Node)]
        return found

    return outermost(lambda n: n.tag == "article") or outermost(lambda n: n.tag == "main" or ("role", "main") in n.marks) or outermost(lambda n: n.tag == "body") or [tree]


def subtree_hashes(tree: Node, main: list[Node]) -> dict[int, list[int]]:
    """Hashes by which each block subtree can be a template, keyed by ``id`` of its node.

    All that it holds, in order; for containers of links alone and for those that name
    themselves, also the shape. What holds a root isn't a template.
    """
    inside = {id(n) for r in main for n in _walk(r)}
    holds = set()
    for r in main:
        n = r
        while n:
            holds.add(id(n))
            n = n.parent
    articles = bool(main) and main[0].tag in ("article", "main")
    full: dict[int, int] = {}
    shape: dict[int, int] = {}
    plain: dict[int, bool] = {}  # whether it holds text that is no link
    out: dict[int, list[int]] = {}
    for n in reversed(list(_walk(tree))):
        head = n.tag + "|" + " ".join(v for _, v in n.marks)
        kids = [c for c in n.children if isinstance(c, Node)]
        shape[id(n)] = xxhash.xxh64_intdigest("S" + head + ",".join(sorted({str(shape[id(c)]) for c in kids if c.tag not in _INLINE})))
        full[id(n)] = xxhash.xxh64_intdigest("F" + head + ",".join(str(full[id(c)]) if isinstance(c, Node) else " ".join(c.split()) for c in n.children))
        plain[id(n)] = n.tag != "a" and any(plain[id(c)] if isinstance(c, Node) else not c.isspace() for c in n.children)
        if id(n) in holds or n.tag in _INLINE or n.tag in _VOID or n.tag not in _CONTAINER and articles and id(n) in inside:
            continue
        by_shape = n.tag in _CONTAINER and (not plain[id(n)] or _names(n)) or articles and id(n) not in inside
        out[id(n)] = [full[id(n)], shape[id(n)]] if by_shape else [full[id(n)]]
    return out


def _signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def page_hashes(html: str | None) -> list[int]:
    tree = parse(html or "")
    return list({_signed(h) for hs in subtree_hashes(tree, roots(tree)).values() for h in hs})


def main_text(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text, without subtrees of the given hashes: blocks joined by an empty line."""
    tree = parse(html or "")
    main = roots(tree)
    articles = bool(main) and main[0].tag in ("article", "main")
    gone: set[int] = set()
    if template:
        gone = {n for n, hs in subtree_hashes(tree, main).items() if any(_signed(h) in template for h in hs)}
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join(unescape("".join(line)).split())
        line.clear()
        if text:
            blocks.append(text)

    for root in main:
        todo: list = [root]
        while todo:
            n = todo.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                line.append(n)
            elif n is not root and (id(n) in gone or not _unmarked(n, articles)):
                flush()
            elif n.tag in ("br", "wbr"):
                line.append(" " if n.tag == "br" else "")
            elif n.tag in _INLINE:
                todo += reversed(n.children)
            else:
                flush()
                todo.append(None)
                todo += reversed(n.children)
        flush()
    return "\n\n".join(blocks)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = 5, share: float = 0.2) -> DataFrame:
    """(id, url, text, n_chars) of every page.

    A subtree is template if its hash occurs on at least ``min_pages`` pages and ``share``
    of the pages of its host; a host has at most (subtrees of a page / share) of them. A
    null or empty html, or one without main text, gives an empty text; a null url belongs
    to the host "". Repeated rows each give a row (and count as pages). Character references
    are decoded once, white space becomes one space, blocks are joined by an empty line.
    Counts are partial sums by (host, hash), so a host with a third of all rows needs no
    large task; the join back is by page, not by host.
    """
    src = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html")).withColumn("_key", F.xxhash64("_id", "_url", "_html"))

    def hashed(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for keys, hosts, htmls in batches:
            yield [keys, hosts, [page_hashes(h) for h in htmls]]

    host, _ = host_path(F.col("_url"))
    # read once: hashes are small against the pages
    marks = materialize(map_rows(src.select("_key", host.alias("_host"), "_html"), hashed, "_key long, _host string, _hashes array<long>"), "page-hashes")
    sizes = marks.groupBy("_host").agg(F.count("*").alias("_of"))
    seen = marks.select("_key", "_host", F.explode("_hashes").alias("_hash"))
    often = seen.groupBy("_host", "_hash").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_pages)
    template = often.join(sizes, "_host").where(F.col("_n") >= share * F.col("_of")).select("_host", "_hash")
    # a template of a large host is on very many pages, so its rows are dealt by page too
    copies = template.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    met = seen.withColumn("_salt", F.pmod("_key", F.lit(SALTS).cast("long"))).join(copies, ["_host", "_hash", "_salt"])
    of_page = met.groupBy("_key").agg(F.collect_set("_hash").alias("_template"))

    def extracted(batches: Iterator[list[list]]) -> Iterator[list[list]]:
        for ids, urls, htmls, templates in batches:
            yield [ids, urls, [main_text(h, frozenset(t or ())) for h, t in zip(htmls, templates, strict=True)]]

    joined = src.join(of_page, "_key", "left").select("_id", "_url", "_html", "_template")
    out = map_rows(joined, extracted, f"_id {id_type(src, '_id')}, _url string, text string")
    return out.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
