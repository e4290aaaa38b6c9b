"""Main text of web pages by a tree-structured graphical model over the DOM.

Each block element of a page is a node that is content or not. Node potentials come from its tag, the words of its
class and id, and its own text (length, share of links, punctuation); potentials between parent and child
depend on what the parent is. Sum-product messages, up the tree and down again, give each node's marginal, and the
text of nodes that are more likely content than not is returned.

Potentials are trained: counts on pages labelled by their own markup (what one `article` or `main` element holds
is content), on at most `SAMPLE` pages with the least hash of their id. Counts of a small sample of layouts
say nothing about markup it doesn't hold, so well-known tags of menus, notes and the like enter as prior evidence
(`BOILER`), and names of notices, adverts, comments and so on as bounded evidence (`NAMED`) for an element and each
one inside it, so that many comments stay comments. Names say nothing where they are no names of a part: ids of
headings, names of what a page has or hasn't (`ABOUT`), names of an element that holds most of the page's text
(and its title, if it isn't named by a layout; or is in the main element and named as a notice), and names of long
paragraphs without links in the main element. A line of rights outside of it has twice that evidence against it, a block
of several links and nothing else half of it. A form that holds most of the text is the page; captions and headers
with a heading count as other parts only outside of an `article` or `main` element that the page has.

Pages are parsed and solved one by one in the tasks, whole. Defined results: null and empty pages, and pages
without content, give an empty text. Broken markup is repaired as browsers do in simple cases: paragraphs, list
items and cells close each other, unknown end tags are skipped, what is open at the end is closed. Text outside
any tag belongs to the page's root. Line breaks (`br`) count as white space. Without any labelled page the
potentials are the prior ones. Repeated rows are extracted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from math import exp, log, log1p

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import read_table, text_batches
from tapewatch.session import stage

#: Labelled pages in the training, at most.
SAMPLE = 2_000
#: Nats of evidence: for what is known not to be content, for marked content and the page itself, the most that a
#: trained feature has, as the sample holds few layouts, and against each element in a part named as another one.
KNOWN, MARKED, LIMIT, OTHER = 1e6, 1e5, 2.5, 5.0
#: Pseudo-counts of the trained tables, and that of content in other parts.
PSEUDO, NEVER = 5.0, 1e-40
# Elements of HTML by role.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr "
                   "math merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub "
                   "msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title svg annotation annotation-xml select object canvas audio "
                "video".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "p": {"p"}, "body": {"head"}}
SCOPE = frozenset("html body table ul ol dl td th article section main div nav aside header footer form".split())
KEEPS_P = frozenset("li dt dd option tr td th".split())  # inside a paragraph only in broken markup
BOILER = frozenset("head nav aside footer button menu dialog input label".split())
WRAPS = frozenset("form fieldset".split())  # other parts, unless they hold most of the text
TITLES = frozenset("header figcaption".split())  # other parts outside the main element, if there is one
MAIN = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ANY = frozenset("html body div section center table tbody thead tfoot tr td th ul ol li dl dt dd".split())  # hold anything
#: Words of classes and ids of parts that are not main text.
NAMED = frozenset(
    "ad ads alert banner complementary consent contentinfo copyright dialog disclaimer footer gdpr header hidden login masthead "
    "menu menus modal nav notice notices notification overlay pager pagination popup promo promoted promotion recommended related "
    "reply replies respond search share sharing signup skip social toolbar topbar widget widgets".split())
#: Beginnings of such words.
STEMS = ("advert", "breadcrumb", "comment", "cookie", "disqus", "navbar", "navigation", "newsletter", "sidebar", "sponsor", "subscri")
#: Of these, those that also name layouts; the others name a page only if its title is in it, as comments can be most of it.
LAYOUT = frozenset("banner footer header masthead menu menus nav search toolbar topbar widget widgets".split())
LAYOUT_STEMS = ("breadcrumb", "navbar", "navigation", "sidebar")
#: Of these, those of readers' comments; and a word that names them only as a class.
REPLIES, REPLIES_STEMS, REPLIES_CLASS = frozenset("reply replies respond".split()), ("comment", "disqus"), "discussion"
#: Names that a section of the main element with most of the text may have.
SECTIONS = frozenset("alert banner disclaimer notice notices promo promoted promotion".split())
#: Lines of rights that stand in no named part.
RIGHTS = re.compile(r"\ball rights reserved\b|^(?:©|copyright\b|\(c\) )", re.I)
RIGHTS_CHARS = 200
#: Characters of a paragraph that is taken for one of the main element's in spite of its name.
PROSE = 60
#: Beginnings of names that tell what a page or post has, hasn't or is about.
ABOUT = re.compile(r"(?:has|no|with|without|overflow|tag|category)(?=[-_A-Z])")
HIDDEN = re.compile(r"\shidden(?=[\s>=/]|$)|display\s*:\s*none", re.I)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z))|<[!?][^>]*(?:>|\Z)""",
                   re.S)
END_OF = {tag: re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I) for tag in RAW}


@dataclass
class Node:
    tag: str
    parent: int
    names: frozenset[str] = frozenset()  # words of its names that mark other parts
    inside_main: bool = False
    boiler: bool = False  # known not to be content, by more than its tag
    other: bool = False  # named as another part than the main text, or inside of such or known boiler
    rights: bool = False  # holds a line of rights
    chars: int = 0
    linked: int = 0
    links: int = 0


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block elements in page order (the root first), and the text blocks in page order with their owner."""
    nodes = [Node("html", -1)]
    open_: list[tuple[str, int]] = []  # elements not yet closed: tag, node (inline ones: that of their block)
    blocks: list[tuple[int, str]] = []
    run: list[str] = []
    links = 0

    def owner() -> int:
        return open_[-1][1] if open_ else 0

    def text(piece: str) -> None:
        if piece:
            run.append(piece)
            plain = len(piece.strip())
            node = nodes[owner()]
            node.chars += plain
            node.linked += plain if links else 0

    def flush(at: int) -> None:
        if run:
            block = " ".join(unescape("".join(run)).split())
            run.clear()
            if block:
                blocks.append((at, block))

    def close(count: int) -> None:
        nonlocal links
        for tag, node in reversed(open_[len(open_) - count:]):
            if tag == "a":
                links = max(0, links - 1)
            if tag not in INLINE:
                flush(node)
            open_.pop()

    def close_implied(tag: str) -> None:
        wanted = CLOSES.get(tag, set())
        if tag not in INLINE and tag not in KEEPS_P:
            wanted = wanted | {"p"}
        for i in range(len(open_) - 1, -1, -1):
            if open_[i][0] in wanted:
                close(len(open_) - i)
                return
            if open_[i][0] in SCOPE:
                return

    at = 0
    while True:
        token = TOKEN.search(html, at)
        if token is None:
            text(html[at:])
            break
        text(html[at:token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    close(len(open_) - i)
                    break
            continue
        if tag in RAW:
            # Only elements of foreign markup are closed by a slash; others are if nothing else closes them.
            closed = token[3].endswith("/>")
            if not (closed and tag == "svg"):
                end = END_OF[tag].search(html, at)
                at = end.end() if end else at if closed else len(html)
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag == "html":
            continue  # the root stands for it
        close_implied(tag)
        if tag in INLINE:
            if tag not in VOID:
                open_.append((tag, owner()))
                links += tag == "a"
                nodes[owner()].links += tag == "a"
            continue
        here = owner()
        flush(here)
        names = part_names(tag, token[3]) if "=" in token[3] else frozenset()
        hidden = ("hidden" in token[3] or "none" in token[3]) and HIDDEN.search(token[3]) is not None
        nodes.append(Node(tag, here, names, boiler=hidden))
        if tag not in VOID and not token[3].endswith("/>"):
            open_.append((tag, len(nodes) - 1))
    flush(owner())
    for i, block in blocks:
        nodes[i].rights |= len(block) <= RIGHTS_CHARS and RIGHTS.search(block) is not None
    find_parts(nodes)
    return nodes, blocks


def part_names(tag: str, attributes: str) -> frozenset[str]:
    """The words of an element's class, id and role that mark other parts. Ids of headings are made of their text."""
    if tag in ("html", "body"):
        return frozenset()
    words = [w.lower() for m in ATTRIBUTE.finditer(attributes) if tag not in HEADINGS or m[1].lower() != "id"
             for name in (m[2] or m[3] or m[4] or "").split() if not ABOUT.match(name) for w in NAME.findall(name)
             if w.lower() != REPLIES_CLASS or m[1].lower() == "class"]
    return frozenset(w for w in words if w in NAMED or w == REPLIES_CLASS or w.startswith(STEMS))


def of_layout(names: frozenset[str]) -> bool:
    return all(w in LAYOUT or w.startswith(LAYOUT_STEMS) for w in names)


def of_replies(names: frozenset[str]) -> bool:
    return any(w in REPLIES or w == REPLIES_CLASS or w.startswith(REPLIES_STEMS) for w in names)


def find_parts(nodes: list[Node]) -> None:
    """Set what a node is by those around it: inside the main element, inside other parts, holder of most of the text."""
    held = [0 if known_boiler(n) else n.chars - n.linked for n in nodes]  # text without links, of other parts no text
    heading = [int(n.tag[1]) if n.tag in HEADINGS else 7 for n in nodes]  # the highest one held
    for i in range(len(nodes) - 1, 0, -1):
        if not known_boiler(nodes[i]):
            held[nodes[i].parent] += held[i]
            heading[nodes[i].parent] = min(heading[nodes[i].parent], heading[i])
    for i, node in enumerate(nodes[1:], 1):
        up = nodes[node.parent]
        most = 2 * held[i] > held[0]
        node.inside_main = up.inside_main or (up.tag in MAIN and not up.other)
        page = heading[i] == 1 or of_layout(node.names) or (node.inside_main and node.names <= SECTIONS)
        # A paragraph of the main element is one whatever it is called, if it reads like one.
        prose = node.tag == "p" and node.inside_main and node.chars >= PROSE and not node.linked and not of_replies(node.names)
        named = node.names and not (most and page) and not prose
        node.boiler |= node.tag in WRAPS and not most
        node.other = bool(up.other or named or known_boiler(node))
    marked = any(n.tag in MAIN and not n.other for n in nodes)
    for i, node in enumerate(nodes):
        if node.tag in TITLES and not node.inside_main:
            node.boiler |= marked or (node.tag == "header" and heading[i] > 6)


def known_boiler(node: Node) -> bool:
    """Prior knowledge: tags that mark other parts of a page."""
    return node.boiler or node.tag in BOILER


def prior(node: Node) -> float:
    """Nats of evidence for content that are known beforehand."""
    if known_boiler(node):
        return -KNOWN
    if node.rights and not node.inside_main:
        return -2 * OTHER
    if node.other:
        return -OTHER
    if node.links > 1 and node.linked == node.chars and not node.inside_main:
        return -OTHER / 2
    return MARKED if node.tag in MAIN or node.parent < 0 else 0.0


def node_features(node: Node) -> list[str]:
    found = [] if node.tag in ANY else [f"tag {node.tag}"]
    if node.chars:
        # Together, as short texts are menus where they are links, and items of a list where they are not.
        found.append(f"chars {min(4, node.chars.bit_length() // 2)} links {min(3, 4 * node.linked // node.chars)}")
    return found


def parent_kind(node: Node) -> str:
    if node.tag in ("html", "body"):
        return "page"
    return "main" if node.tag in MAIN or node.inside_main else "part"


def pair_kind(parent: Node, child: Node) -> str:
    """The kind of the parent; that an element is within the main one says little if it is named as another part."""
    return "other" if child.other and not parent.other else parent_kind(parent)


def label(nodes: list[Node]) -> list[int] | None:
    """Content (1) or not by the page's own markup, if it marks one main element; holders of content are content."""
    marked = [i for i, n in enumerate(nodes) if n.tag in MAIN and not n.inside_main and not n.other]
    if len(marked) != 1:
        return None
    y = [0] * len(nodes)
    for i, n in enumerate(nodes):
        y[i] = int((i == marked[0] or (n.inside_main and y[n.parent])) and not (n.other or known_boiler(n)))
    up = nodes[marked[0]].parent
    while up >= 0:
        y[up] = 1
        up = nodes[up].parent
    return y


@dataclass
class Potentials:
    """Log evidence per feature for content against not, and log P(child | parent) per kind of parent (and of a part in it)."""

    evidence: dict[str, float]
    pair: dict[str, tuple[tuple[float, float], tuple[float, float]]]

    @classmethod
    def trained(cls, counts: dict[str, int]) -> Potentials:
        evidence = {}
        total = [counts.get(f"{y} nodes", 0) + 2 * PSEUDO for y in (0, 1)]
        for name in {k[2:] for k in counts if k[0] in "01"} - {"nodes"}:
            no, yes = (counts.get(f"{y} {name}", 0) + PSEUDO for y in (0, 1))
            evidence[name] = max(-LIMIT, min(LIMIT, log(yes / total[1]) - log(no / total[0])))
        pair = {}
        for kind in ("page", "main", "part", "other"):
            table = []
            for p in (0, 1):
                # A part of something that isn't content is no content.
                a, b = (PSEUDO, NEVER) if not p else {"page": (PSEUDO, PSEUDO), "other": (PSEUDO, PSEUDO), "part": (1.0, 9.0),
                                                         "main": (1e-2, PSEUDO)}[kind]
                no, yes = counts.get(f"> {kind} {p}0", 0) + a, counts.get(f"> {kind} {p}1", 0) + b
                table.append((log(no / (no + yes)), log(yes / (no + yes))))
            pair[kind] = (table[0], table[1])
        return cls(evidence, pair)


def count_page(html: str) -> Counter:
    """What a labelled page adds to the counts; empty for others."""
    nodes, _ = parse(html)
    y = label(nodes)
    found: Counter = Counter()
    if y is None:
        return found
    for i, node in enumerate(nodes):
        found.update(f"{y[i]} {name}" for name in ["nodes", *node_features(node)])
        if node.parent >= 0:
            found[f"> {pair_kind(nodes[node.parent], node)} {y[node.parent]}{y[i]}"] += 1
    return found


def _log_add(a: float, b: float) -> float:
    return a + log1p(exp(b - a)) if a > b else b + log1p(exp(a - b))


def marginals(nodes: list[Node], model: Potentials) -> list[float]:
    """P(content) of each node by sum-product messages, leaves to root and back."""
    n = len(nodes)
    local = [[0.0, 0.0] for _ in range(n)]
    for i, node in enumerate(nodes):
        local[i][1] = prior(node) + sum(model.evidence.get(f, 0.0) for f in node_features(node))
    pairs = [model.pair[pair_kind(nodes[node.parent], node)] if node.parent >= 0 else None for node in nodes]
    below = [x[:] for x in local]  # local evidence and messages from the children
    up = [(0.0, 0.0)] * n
    for i in range(n - 1, 0, -1):  # children come after their parents
        (p00, p01), (p10, p11) = pairs[i]
        b0, b1 = below[i]
        up[i] = (_log_add(p00 + b0, p01 + b1), _log_add(p10 + b0, p11 + b1))
        parent = below[nodes[i].parent]
        parent[0] += up[i][0]
        parent[1] += up[i][1]
    whole = [x[:] for x in below]  # and the message from the parent
    for i in range(1, n):
        (p00, p01), (p10, p11) = pairs[i]
        parent = whole[nodes[i].parent]
        r0, r1 = parent[0] - up[i][0], parent[1] - up[i][1]
        whole[i][0] = below[i][0] + _log_add(r0 + p00, r1 + p10)
        whole[i][1] = below[i][1] + _log_add(r0 + p01, r1 + p11)
    return [1 / (1 + exp(min(700.0, max(-700.0, w[0] - w[1])))) for w in whole]


def main_text(html: str | None, model: Potentials) -> str:
    if not html:
        return ""
    nodes, blocks = parse(html)
    content = marginals(nodes, model)
    return "\n".join(block for at, block in blocks if content[at] > 0.5)


def train(pages: DataFrame, page_id: str = "page_id", html: str = "html", limit: int = SAMPLE) -> Potentials:
    """Count features and parent-child pairs on a sample of labelled pages. Few names of features: all fit a row each."""
    key = pages.select(F.col(page_id).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    picked = F.broadcast(stage(key.orderBy(F.xxhash64("_id"), "_id").limit(limit), "picked"))
    sample = pages.select(F.col(page_id).alias("_id"), F.col(html).alias("_html")).join(picked, "_id").where(
        F.col("_html").rlike(r"(?i)<(article|main)\b"))

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                total.update(count_page(text.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())],
                                         ["name", "n"])

    sums = sample.select("_html").mapInArrow(count, "name string, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return Potentials.trained({r["name"]: r["n"] for r in sums.collect()})


def extract(pages: DataFrame, model: Potentials, html: str = "html") -> DataFrame:
    """Replace the html column by `text` and `n_chars`, also where such columns are there; others pass through."""
    rest = [c for c in pages.columns if c not in (html, "text", "n_chars")]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(t.as_py(), model) for t in batch.column(html)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in rest), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                [*rest, "text", "n_chars"])

    text_batches(pages.sparkSession)
    schema = pages.select(*rest).schema
    for name, kind in (("text", "string"), ("n_chars", "long")):
        schema = schema.add(name, kind)
    return pages.select(*rest, html).mapInArrow(run, schema)


def op3_dom_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages))
