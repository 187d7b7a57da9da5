"""Main text of web pages by removal of site templates.

Every element's subtree is hashed. Spark counts for each host on how many different pages a
subtree occurs (copies of a whole page count once); subtrees that recur on many of a host's pages
are its template. A page then loses its template subtrees, the elements whose tag says that they are no
content (menus, headers, footers, forms, scripts, styles), the boxes whose class, role or, outside
of articles, id says so (sidebars, notices, adverts, comments), and everything outside its article.
Names of headings, paragraphs and inline elements say nothing, nor does a box's id in an article, as
sections have ids to be linked to; only ids that wholly name readers' comments count there.

Inside an article a template subtree goes if it is a box: a division, section, list, table or
figure, whatever its name. Paragraphs, headings, quotations and the article itself are prose and
stay: a sentence or paragraph that many articles of a host share is still part of each of them.
Outside of articles any block-level template subtree goes.

Without an article the main element is taken, and without one the body. Blocks are the texts
between block-level tags, with character references decoded and white space as one space;
they are joined by one newline. Null, empty and text-less pages give an empty text. Pages are
never cut. Unclosed and stray tags are read as browsers read them, roughly. page_id ties the
steps together: pages that share one share their template, and a null page_id loses only the template
step. Repeated rows each get their text. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenledger.llm.arrowtext import blocks, checkpoint, give_back, join_keys, small_batches

#: A subtree is a template if it is on MIN_PAGES of a host, and on such a share of them or on MANY_PAGES.
MIN_PAGES, MIN_SHARE, MANY_PAGES = 5, 0.2, 200

#: A tag without quotes whole, or the beginning of another one, of a comment or of a declaration.
_TOKEN = re.compile(r"<(?:(/?[a-zA-Z][^\s/<>]*)(?:([^\"'<>]*)(>))?|!--|[!?])")
#: What may end a tag, or hide its end.
_MARK = re.compile("[\"'>]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Character references beyond all code points; Python refuses to read very long numbers.
_TOO_FAR = re.compile(r"&#(?:[0-9]{12,}|[xX][0-9a-fA-F]{12,});?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe svg math object".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: What a template may have inside an article.
_BOXES = frozenset("aside details div dl figure footer form header menu nav ol section table ul".split())
_DROPPED = frozenset("head nav footer aside form button select option label input menu dialog".split()) | _RAW
#: What an open element is not closed across.
_CONTAINERS = frozenset("div ul ol table article section main body td blockquote dl".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|sponsored|promo|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|site-header|page-header|"
    r"footer|cookies?|consent|notice|gdpr|popup|modal|newsletter|subscribe|share|sharing|social|related|comments?|disqus|replies|respond|login|search|"
    r"complementary|contentinfo)(?:$|[\s_-])",
    re.I,
)
#: Of which elements an opening tag ends one: a block ends a paragraph, an item another item.
_CLOSING = {t: tuple(x for x in (("p",) if t in _BLOCK else (), tuple(sorted(_CLOSES.get(t, ())))) if x) for t in _BLOCK | _CLOSES.keys()}
#: Ids that name readers' comments, wherever they stand.
_COMMENTS = frozenset("comments comment-list disqus_thread respond".split())


class Node:
    __slots__ = ("tag", "name", "id", "parent", "children", "depth", "container")

    def __init__(self, tag: str, name: str, own_id: str, parent: Node | None):
        self.tag, self.name, self.id, self.parent, self.children = tag, name, own_id, parent, []
        self.depth = parent.depth + 1 if parent else 0
        self.container = self if parent is None or tag in _CONTAINERS else parent.container


class Tags:
    """Where tags end: at the first > outside quotes. The marks of a page are read once, however many tags never end."""

    def __init__(self, page: str):
        self.page, self.next, self.known = page, -1, None

    def end(self, place: int) -> int:
        """The > of the tag whose name ends at place, or -1. Places must not fall."""
        if self.next < place:
            found = _MARK.search(self.page, place)
            self.next = found.start() if found else len(self.page)
        if self.next == len(self.page):
            return -1
        if self.page[self.next] == ">":
            return self.next
        if self.known is None:
            self._read()
        return self.known[self.next]

    def _read(self) -> None:
        """For each mark from here on, the > that ends a tag in which it is the first one; backwards, as a quote goes on after its partner."""
        marks = [(m.start(), m[0]) for m in _MARK.finditer(self.page, self.next)]
        self.known, last, after = {}, {}, -1
        for place, mark in reversed(marks):
            if mark == ">":
                now = place
            else:
                now = last.get(mark, -1)  # what follows this quote's partner
                last[mark] = after
            self.known[place] = after = now


def _decoded(text: str) -> str:
    return html.unescape(_TOO_FAR.sub("\ufffd", text) if "&#" in text else text)


def _closed(at: Node, node: Node, opened: dict[str, list[Node]]) -> Node:
    """Closes all elements from the current one to node; what is current then."""
    while at is not node.parent:
        opened[at.tag].pop()
        at = at.parent
    return at


def parse(page: str) -> Node:
    """The element tree; children are nodes and, decoded, texts. In time that grows with the page, whatever it holds."""
    root = at = Node("", "", "", None)
    tags, opened, place, text = Tags(page), defaultdict(list), 0, 0

    while m := _TOKEN.search(page, place):
        start, name, end = m.start(), m[1], m.end()
        if name is None:
            found = page.find("-->" if m[0] == "<!--" else ">", end)
            if found < 0 and m[0] != "<!--":
                break
            place = found + (3 if m[0] == "<!--" else 1) if found >= 0 else len(page)
        elif m[3]:
            attributes, place = m[2], end
        else:
            found = tags.end(end)
            if found < 0:
                place = start + 1
                continue
            attributes, place = page[end:found], found + 1
        if start > text:
            at.children.append(_decoded(page[text:start]))
        text = place
        if name is None:
            continue
        tag = name.lower()
        if tag[0] == "/":
            if opened[tag[1:]]:
                at = _closed(at, opened[tag[1:]][-1], opened)
            continue
        for closing in _CLOSING.get(tag, ()):
            # The innermost open element of these, unless a container stands between.
            inner = None
            for t in closing:
                if opened[t] and (inner is None or opened[t][-1].depth > inner.depth):
                    inner = opened[t][-1]
            if inner is not None and inner.depth >= at.container.depth:
                at = _closed(at, inner, opened)
        named = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)} if attributes else {}
        node = Node(tag, " ".join(named[k] for k in ("class", "role") if named.get(k)), named.get("id", ""), at)
        at.children.append(node)
        whole = attributes.endswith("/")
        if tag in _RAW and not whole:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, place)
            node.children.append(page[place : close.start() if close else len(page)])
            text = place = close.end() if close else len(page)
        elif tag not in _VOID and not whole:
            at = node
            opened[tag].append(node)
    if text < len(page):
        at.children.append(_decoded(page[text:]))
    return root


def hashes(root: Node) -> dict[int, int]:
    """A signed 64-bit hash of each element's subtree: tags, names, texts with white space as one space."""
    out: dict[int, int] = {}
    stack = [(root, False)]
    while stack:
        node, done = stack.pop()
        if not done:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]
            continue
        h = hashlib.blake2b(f"{node.tag}\0{node.name}\0{node.id}\0".encode("utf-8", "replace"), digest_size=8)
        for c in node.children:
            h.update(out[id(c)].to_bytes(8, "little", signed=True) if isinstance(c, Node) else " ".join(c.split()).encode("utf-8", "replace") + b"\0")
        out[id(node)] = int.from_bytes(h.digest(), "little", signed=True)
    return out


def _no_content(node: Node, inside: bool) -> bool:
    """Whether an element is no content: by its tag, or, if it is a box, by its class or role, and outside of articles by its id."""
    if node.tag in _DROPPED or (node.tag == "header" and not inside):
        return True
    return node.tag in _BOXES and bool(_NAMED.search(node.name) or (node.id in _COMMENTS if inside else _NAMED.search(node.id)))


def content(root: Node) -> list[Node]:
    """The page's articles that lie in nothing that is no content, else its main elements, else all of it."""
    for tags in (("article",), ("main",)):
        found, stack = [], [root]
        while stack:
            node = stack.pop()
            if node.tag in tags or (tags == ("main",) and node.name == "main"):
                found.append(node)
            elif not (node.tag and _no_content(node, False)):
                stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        if found:
            return found
    return [root]


def extract(root: Node, template: frozenset[int] = frozenset()) -> str:
    """The blocks of the page's content, without the template's subtrees."""
    tops = content(root)
    first, guarded = {id(n) for n in tops}, tops != [root]
    hashed = hashes(root) if template else {}
    may_go = _BOXES if guarded else _BLOCK
    lines, line = [], []

    def end() -> None:
        text = " ".join("".join(line).split())
        if text:
            lines.append(text)
        line.clear()

    stack: list = list(reversed(tops))
    while stack:
        node = stack.pop()
        if node is None:
            end()
        elif isinstance(node, str):
            line.append(node)
        elif node.tag == "br":
            line.append(" ")
        elif id(node) in first or not (node.tag and _no_content(node, guarded) or node.tag in may_go and hashed.get(id(node)) in template):
            if node.tag in _BLOCK or not node.tag:
                end()
                stack.append(None)
            stack += reversed(node.children)
    end()
    return "\n".join(lines)


def subtrees(root: Node) -> tuple[int, set[int]]:
    """The hashes of the page and of the block-level elements that a template may have; in an article, of its boxes.

    An inline element that recurs is a common word or phrase, not a part of a template.
    """
    tops = {id(n) for n in content(root)}
    hashed = hashes(root)
    out, stack = set(), [(root, False)]
    while stack:
        node, inside = stack.pop()
        if id(node) in tops and node is not root:
            inside = True
        elif node.tag in (_BOXES if inside else _BLOCK | _DROPPED) and node.tag not in ("html", "body", "head"):
            out.add(hashed[id(node)])
        stack += [(c, inside) for c in node.children if isinstance(c, Node)]
    return hashed[id(root)], out


def template_subtrees(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """page_id, template: the hashes of each page's subtrees that its host's pages share."""

    def list_subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20, "html"):
            found = [subtrees(parse(h or "")) for h in block["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [block["page_id"].cast(pa.int64()), block["host"], pa.array([p for p, _ in found], pa.int64()), pa.array([sorted(x) for _, x in found], pa.list_(pa.int64()))],
                ["page_id", "host", "page", "found"],
            )
        give_back()

    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))
    listed = pages.select("page_id", F.xxhash64(host).alias("host"), "html").mapInArrow(list_subtrees, "page_id long, host long, page long, found array<long>")
    listed = checkpoint(listed)
    # Of pages that are copies of each other one counts.
    first = listed.groupBy("host", "page").agg(F.min("page_id").alias("page_id"))
    of_host = first.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = listed.select("page_id", "host", "page", F.explode("found").alias("subtree"))
    total = each.count()
    counts = each.join(first, ["host", "page", "page_id"], "left_semi").groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    shared = join_keys(counts, of_host, "host", "pages", listed.count()).where((F.col("n") >= F.col("pages") * min_share) | (F.col("n") >= many_pages))
    shared = checkpoint(shared.select("host", "subtree", "n"))
    return join_keys(each, shared, ["host", "subtree"], "n", total).groupBy("page_id").agg(F.collect_set("subtree").alias("template"))


def extract_text(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE, many_pages: int = MANY_PAGES) -> DataFrame:
    """page_id, url, text of every row of pages."""
    small_batches(pages.sparkSession)
    template = template_subtrees(pages, min_pages, min_share, many_pages)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, 4 << 20, "html"):
            packed = [zlib.compress((h or "").encode(), 1) for h in block["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([block["page_id"].cast(pa.int64()), block["url"], pa.array(packed, pa.binary())], ["page_id", "url", "packed"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [
                extract(parse(zlib.decompress(p).decode()), frozenset(t or ()))
                for p, t in zip(batch["packed"].to_pylist(), batch["template"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(text, pa.string())], ["page_id", "url", "text"])
        give_back()

    packed = pages.select("page_id", "url", "html").mapInArrow(pack, "page_id long, url string, packed binary")
    return packed.join(template, "page_id", "left").mapInArrow(read, "page_id long, url string, text string")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages with the text of their articles."""
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
