"""Main text of web pages by paths that the pages of a host agree on.

Every page scores its containers by the text of its own blocks less what is
linked.  Their paths, as tags with the letters of their classes and ids, are
votes; Spark sums them by host, and each page is read again at the winning
paths of its host.  A page that has none of them is read at its own best
container.  Menus, headers, footers, sidebars, notices, adverts, forms, scripts
and comments are left out by tag, role, class or id wherever they stand.  In an
article or main, and for ids made from a heading, a name that only may mean one
of these leaves an element out only if it is mostly links (or, by its class, short).
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clickloom.llm.common import checked_broadcast, materialize, ship_package, table
from clickloom.plans.registry import Query

#: A path wins with this share of its host's votes; so there are at most 1/SHARE of them.
SHARE = 0.1

# Tags of HTML by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg annotation annotation-xml object canvas audio video select".split())
LEFT_OUT = frozenset("nav footer aside form button menu dialog head label fieldset".split()) | RAW
CONTAINERS = frozenset("article main section div body td blockquote".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of running text: in an article, a part of a class does not make them noise, however short they are.
PROSE = frozenset("p section li blockquote pre dt dd td figcaption".split()) | HEADINGS
#: Elements that pages are laid out with; the id of another need not name its place in the page.
LAYOUT = frozenset("div ul ol dl table tr td".split())
#: An element of so many characters is short.
SHORT = 100
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert\w*|banner\w*|sponsor\w*|promo\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|side|sidebar\w*|widget\w*|"
    r"footer\w*|masthead|site-?header|page-?header|top-?bar|cookies?|consent|gdpr|notices?|notification\w*|alert\w*|popup|modal|overlay|"
    r"comments?|comment-\w+|respond|disqus\w*|replies|reply|share|sharing|social\w*|related|recommend\w*|newsletter|subscribe|subscription|"
    r"signup|login|search|toolbar|pagination|pager|tags|copyright|legal|disclaimer|skip-?link)(?=$|[\s_-])|(?:^|\s)header(?=$|\s)", re.I)  # fmt: skip
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())

_markup = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)  # a quote never closed ends with its tag
_tag = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_attribute = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|itemprop)(?=[\s=/>]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I | re.S)
_raw_end = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*(?:>|\Z)|\Z", re.I) for t in RAW}
_space = re.compile(r"\s+")
_own_heading = re.compile(r"\s*(?:<(?:div|header|a|span)\b[^>]*>\s*)*<h([1-6])\b[^>]*>(.{0,500}?)</h\1\s*>", re.I | re.S)
_no_word = re.compile(r"(?:<[^>]*>|[\W_])+")


def heading_id(name: str, page: str, at: int) -> bool:
    """Whether an id was made from the heading that the element at this place begins with."""
    found = _own_heading.match(page, at)
    plain = _no_word.sub("-", html.unescape(found[2])).strip("-").lower() if found else ""
    own = _no_word.sub("-", name).strip("-").lower()
    return bool(plain) and plain in (own, re.sub(r"-\d+$", "", own))


def named_noise(tag: str, classes: list[str], name: str, in_article: bool, page: str, at: int) -> str:
    """What the class and id of an element say: it is noise, it may be noise (by its "class" or "id"), or nothing ("")."""
    if tag in ("body", "html", "article", "main"):
        return ""
    by_class = any(NOISE.search(c) for c in classes)
    by_id = tag not in HEADINGS and NOISE.search(name) is not None
    if by_class and (not in_article or any(NOISE.fullmatch(c) for c in classes)):
        return "noise"
    if by_id and not in_article and (NOISE.fullmatch(name.strip()) or tag in LAYOUT and not heading_id(name, page, at)):
        return "noise"
    return "class" if by_class and not (in_article and tag in PROSE) else "id" if by_class or by_id else ""


class Node:
    """An element that may hold the main text."""

    __slots__ = ("label", "depth", "parent", "good", "linked", "first", "last")

    def __init__(self, label: str, parent: "Node | None", first: int):
        self.label, self.parent, self.first = label, parent, first
        self.depth = parent.depth + 1 if parent else 1
        self.good, self.linked, self.last = 0, 0, None

    @property
    def path(self) -> str:
        labels, node = [], self
        while node is not None:
            labels.append(node.label)
            node = node.parent
        return ">".join(reversed(labels))

    def is_at(self, labels: list[str]) -> bool:
        """Whether these are the labels of the element's path; most differ in number or in the last one."""
        if self.depth != len(labels):
            return False
        node = self
        for label in reversed(labels):
            if node.label != label:
                return False
            node = node.parent
        return True


def read(page: str) -> tuple[list[str], list[Node], list[tuple[Node | None, int, bool]]]:
    """(blocks of text that are no noise, containers with the blocks they span, (container, linked, heading) of every block), in page order."""
    blocks: list[str] = []
    facts: list[tuple[Node | None, int, bool]] = []
    nodes: list[Node] = []
    stack: list[tuple[str, bool, Node | None, tuple | None]] = []  # (tag, left out, nearest container, what stood before if it may be noise)
    text: list[str] = []
    linked, links = 0, 0
    heading, headings = False, 0
    standing: Counter[str] = Counter()  # open elements by tag
    inside: Node | None = None
    out = False

    def close_block() -> None:
        nonlocal linked, heading
        if text:
            block = _space.sub(" ", "".join(text)).strip()
            text.clear()
            if block:
                blocks.append(block)
                facts.append((inside, linked, heading))
                if inside:
                    inside.good += len(block)
                    inside.linked += linked
        linked, heading = 0, False

    def settle(by: str, first: int, begun: int, linked_before: int, node: int) -> None:
        """Take back all of an element that may be noise, if it is mostly links or, by its class, short."""
        nonlocal linked
        if len(blocks) > first:
            begun, linked_before = 0, 0
        size = sum(map(len, blocks[first:])) + len("".join(text[begun:]).strip())
        in_links = sum(k for _, k, _ in facts[first:]) + linked - linked_before
        if 2 * in_links > size or by == "class" and size <= SHORT:
            for block, (at, k, _) in zip(blocks[first:], facts[first:]):
                if at:
                    at.good -= len(block)
                    at.linked -= k
            del blocks[first:], facts[first:], text[begun:], nodes[node:]
            linked = linked_before

    def pop() -> None:
        nonlocal inside, out, links, headings
        tag, _, node, doubt = stack.pop()
        standing[tag] -= 1
        if tag in BLOCKS:
            close_block()
        if doubt:
            settle(*doubt)
        if tag in HEADINGS:
            headings -= 1
        if tag == "a":
            links = max(0, links - 1)
        if node is not None and (not stack or stack[-1][2] is not node):
            node.last = len(blocks)
        inside = stack[-1][2] if stack else None
        out = stack[-1][1] if stack else False

    def words(raw: str) -> None:
        nonlocal linked, heading
        if raw and not out:
            piece = html.unescape(raw)
            text.append(piece)
            heading = heading or headings > 0
            if links:
                linked += len(piece)

    at = 0
    while True:
        m = _markup.search(page, at)
        words(page[at : m.start()] if m else page[at:])
        if m is None:
            break
        at = m.end()
        if m[0].startswith("<![CDATA["):
            continue
        found = _tag.match(m[0])
        if found is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if standing[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            elif tag == "p":
                close_block()
            continue
        if tag == "br":
            if not out:
                text.append(" ")
            continue
        if tag in BLOCKS:
            close_block()
            while stack and stack[-1][0] in ("p", "b", "i", "em", "strong", "span", "u", "font", "a") and any(s[0] == "p" for s in stack[-8:]):
                pop()  # a block ends a paragraph left open, with what stands open in it
        if tag in CLOSED_BY:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] in ("ul", "ol", "dl", "table"):
                    break
                if stack[depth][0] in CLOSED_BY[tag]:
                    while len(stack) > depth:
                        pop()
                    break
        if tag in VOID or m[0].endswith("/>") and tag not in BLOCKS:
            continue
        names = {k.lower(): next((v for v in vs if v), "") for k, *vs in _attribute.findall(m[0][found.end() :])}
        marks = f"{names.get('class', '')} {names.get('id', '')}"
        in_article = standing["article"] + standing["main"] > 0
        named = named_noise(tag, names.get("class", "").split(), names.get("id", ""), in_article, page, at)
        noise = (
            tag in LEFT_OUT
            or tag == "header" and not in_article
            or named == "noise"
            or names.get("role", "").lower() in ROLES
            or "hidden" in names
            or names.get("aria-hidden", "").lower() == "true"
        )
        if tag in RAW:
            at = _raw_end[tag].search(page, at).end()
            continue
        node = inside
        doubt = (named, len(blocks), len(text), linked, len(nodes)) if named and not out and not noise else None
        if tag in CONTAINERS and not out and not noise:
            label = tag + "".join(sorted({"." + re.sub(r"\d+", "#", x).lower() for x in marks.split()}))
            node = Node(label.replace(">", ""), inside, len(blocks))
            nodes.append(node)
        stack.append((tag, out or noise, node, doubt))
        standing[tag] += 1
        inside, out = node, out or noise
        if tag == "a":
            links += 1
        if tag in HEADINGS:
            headings += 1
    while stack:
        pop()
    close_block()
    for node in nodes:
        node.last = len(blocks) if node.last is None else node.last
    return blocks, nodes, facts


def score(nodes: list[Node]) -> list[tuple[float, Node]]:
    """Containers with their scores: unlinked text of their own blocks, and a share of that of the containers in them."""
    total = {id(n): float(max(0, n.good - 2 * n.linked)) for n in nodes}
    for n in reversed(nodes):  # children stand after their parents
        if n.parent is not None:
            total[id(n.parent)] += 0.75 * total[id(n)]
    bonus = {"article": 3.0, "main": 1.5}
    return [(total[id(n)] * bonus.get(_tag_of(n), 1.0), n) for n in nodes if total[id(n)] > 0]


def _tag_of(node: Node) -> str:
    return node.label.split(".")[0]


def _belongs(inner: Node, outer: Node, blocks: list[str], facts: list[tuple[Node | None, int, bool]]) -> bool:
    """Whether all that the outer container adds to the inner one is part of its text: titles, leads, sibling sections.

    Mostly linked blocks are not.  Before the inner one, the page's body itself may only add from a heading
    on; after it, only blocks of the outer container's own, headings, sections and containers of the same name are.
    """
    page = _tag_of(outer) in ("body", "td")
    before, after = range(outer.first, inner.first), range(inner.last, outer.last)
    if any(2 * facts[i][1] > len(blocks[i]) for i in (*before, *after)):
        return False
    if page and before and not facts[before[0]][2]:
        return False
    for i in after:
        at, _, heading = facts[i]
        while at is not None and at is not outer and at.parent is not outer:
            at = at.parent
        if heading or at is None or at is outer or _tag_of(at) == "section":
            continue
        if at.label != inner.label or page and "." not in at.label:
            return False
    return True


def climb(node: Node, blocks: list[str], facts: list[tuple[Node | None, int, bool]]) -> Node:
    """The outermost container that adds only what belongs to this one's text, at most its article or main."""
    most, inner = node, node
    while inner.parent is not None and _tag_of(inner) not in ("article", "main") and _belongs(inner, inner.parent, blocks, facts):
        inner = inner.parent
        if (inner.first, inner.last) != (most.first, most.last):
            most = inner
    return most


def best(blocks: list[str], nodes: list[Node], facts: list[tuple[Node | None, int, bool]]) -> tuple[Node, float] | None:
    """The best container with what belongs to its text, and its score; the outer one of equals."""
    scored = score(nodes)
    if not scored:
        return None
    most = max(s for s, _ in scored)
    return climb(next(n for s, n in scored if s == most), blocks, facts), most


def best_path(page: str) -> tuple[str, float] | None:
    """The path of the best container, and its score."""
    found = best(*read(page))
    return found and (found[0].path, found[1])


def extract(page: str, paths: list[str]) -> tuple[str, str]:
    """(text, path): at the first path that the page has text at, with what belongs to it, else at its own best container, else all of it."""
    blocks, nodes, facts = read(page)
    for path in paths:
        found: list[Node] = []
        labels = path.split(">")
        for n in nodes:
            if n.is_at(labels) and n.last > n.first and not (found and found[-1].first <= n.first and n.last <= found[-1].last):
                found.append(climb(n, blocks, facts))
        if found:
            return _joined(blocks, sorted((n.first, n.last) for n in found)), found[0].path
    own = best(blocks, nodes, facts)
    if own:
        return _joined(blocks, [(own[0].first, own[0].last)]), own[0].path
    return "\n".join(blocks), ""


def _joined(blocks: list[str], spans: list[tuple[int, int]]) -> str:
    out, done = [], 0
    for a, b in spans:  # in page order; one inside another adds nothing
        out += blocks[max(a, done) : b]
        done = max(done, b)
    return "\n".join(out)


def _vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [best_path(x) for x in batch["html"].to_pylist()]
        paths = [f[0] if f else None for f in found]
        yield pa.RecordBatch.from_arrays([batch["host"], pa.array(paths, pa.string()), pa.array([f[1] if f else 0.0 for f in found], pa.float64())], ["host", "path", "score"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [extract(page, paths or []) for page, paths in zip(batch["html"].to_pylist(), batch["paths"].to_pylist())]
        texts, paths = zip(*found) if found else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(paths, pa.string())],
            ["page_id", "url", "text", "n_chars", "path"],
        )


def host_paths(pages: DataFrame, share: float = SHARE) -> DataFrame:
    """(host, paths): the paths with at least ``share`` of their host's pages, most pages first, then the longest text."""
    votes = pages.select("host", "html").mapInArrow(_vote, "host string, path string, score double").where("path IS NOT NULL")
    counted = votes.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    all_of = Window.partitionBy("host")
    winners = counted.withColumn("pages", F.sum("n").over(all_of)).where(F.col("n") >= share * F.col("pages"))
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("score")).alias("score"), "path")))
    return winners.groupBy("host").agg(ranked["path"].alias("paths")).select("host", F.array_join("paths", "\n").alias("paths"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars and path of every row.

    A null or empty page has an empty text, a null or odd url a host of its
    own kind.  Rows that repeat are kept.  Other columns are left out.
    """
    ship_package(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    paths = checked_broadcast(materialize(host_paths(pages), "host-paths"))
    known = pages.join(paths, "host", "left").select("page_id", "url", "html", F.split("paths", "\n").alias("paths"))
    return known.mapInArrow(_extract, "page_id long, url string, text string, n_chars long, path string")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, tuple[Query, str | None]] = {"op3_main_text": (op3_main_text, None)}
