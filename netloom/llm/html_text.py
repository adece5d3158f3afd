"""Main text of web pages by composite text density.

A tag scanner builds the node tree.  Nodes that by element hold no article are
cut first, then those that a word of class, id or role names as such, unless they
hold an article or main element or most of the body's text outside links.  Words
that also name parts of articles, such as header or social, cut a node only where
its density is below the body's and it has no main headline.  Every node that stays
has a density, its characters for each tag, reduced where its text lies in links; a
node's sum adds its children's densities.  The node with the largest sum, which may be the body, is
the article's core.  The smallest density on the path from it up to and with the
body is the threshold: below each node that reaches it the node with the largest
sum is kept.  Of equal sums that of an article or main element goes first.  A
core that is a paragraph, a heading or in a line of text gives way to its parent.
A node whose own text reaches the threshold is kept whole, and a heading goes
with the kept node that follows it.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from netloom.plans.shared import quoted

_NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
# A quote opens a value only behind an equals sign; nothing here goes back over what it has read.
_REST = re.compile(r"((?:=\s*+(?:\"[^\"]*\"|'[^']*')|[^>])*+)>")
_LONG_REFERENCE = re.compile(r"&#(?:([0-9]{8,})|[xX]([0-9a-fA-F]{7,}));?")
_NAMES = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!-)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
# Element kinds.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes".split())
_DROP = _RAW | frozenset("head nav footer aside form button select option input label fieldset dialog menu object canvas audio video".split())
_BLOCK = frozenset("address article blockquote body br caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
_ENDS_P = _BLOCK - {"br"} | {"form", "nav", "footer", "aside", "fieldset", "menu"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol dl table select body div article section main".split())
# Elements that hold in what is open, and names whose end tags go through them.
_BARS = frozenset({"body", "td", "th"})
_THROUGH = frozenset("html body table tr tbody div section article main".split())
# Words in class, id or role names of what is not an article.
_BOILER = frozenset(
    "ad ads advert advertisement adverts advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer colophon copyright contentinfo complementary "
    "sidebar aside widget comment comments respond reply replies disqus notice notices cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search share sharing social related "
    "recommended pagination pager toolbar skip form".split()
)
# Those of them that also name parts of an article.
_WEAK = frozenset("header banner social share sharing form notice notices menu search related recommended reply replies respond copyright aside skip promotion overlay".split())
# Words for remarks of readers, and headings above them.
_REMARK = frozenset("comment comments reply replies respond disqus".split())
_COMMENTS_TITLE = re.compile(r"(?:\d+ )?(?:reader |user |latest |all )?comments?(?: ?[(:]? ?\d*\)?)?|(?:leave|post|write|add) a (?:comment|reply)|join the (?:discussion|conversation)|\d+ (?:replies|responses|thoughts) ?(?:to .*|on .*)?")
_PARTS = re.compile(r"[^a-z]+")
_LEADS = re.compile(r"([a-z])([A-Z])")
_ARTICLE = frozenset({"article", "main"})
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "children", "boiler", "named", "chars", "tags", "link_chars", "link_tags", "density", "total", "loose", "peak", "kept", "depth", "lift")

    def __init__(self, tag: str, parent: Node | None, boiler: bool = False, named: int = 0):
        self.tag, self.parent, self.boiler, self.named = tag, parent, boiler, named
        self.children: list[Node | str] = []
        self.kept = False
        # The innermost node from here up, this one included, that may be a core; None inside of the topmost line.
        alone = tag == "p" or tag in _HEADING or tag not in _BLOCK
        self.depth = parent.depth + 1 if parent else 0
        self.lift: Node | None = (parent.lift if parent else None) if alone else self


def _is_boiler(tag: str, attributes: str, path: _Open) -> bool:
    if tag in _DROP:
        return True
    if tag == "header":
        return path.depth(*_ARTICLE) < 0
    if not attributes or tag in ("html", "body"):
        return False
    return bool(_HIDDEN.search(attributes))


def _is_named(tag: str, attributes: str) -> int:
    """Whether words of class, id and role tell of boilerplate.

    2 where they tell of nothing else, 4 where besides one of them names no part
    of an article; 1 where there are other words too, 3 if those that tell are weak.
    Article and main elements only have 4, also for a class of words for reader comments.
    """
    found, comment = set(), False
    for m in _NAMES.finditer(attributes):
        value = _LEADS.sub(r"\1-\2", m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "itemprop":
            comment |= value.strip() == "comment"
            continue
        words = set(_PARTS.split(value)) - {""}
        if tag in _ARTICLE:
            comment |= any((parts := set(_PARTS.split(c)) - {""}) and parts <= _REMARK for c in value.split())
        if tag in _ARTICLE or "article" not in words:
            found |= words
    told = found & _BOILER
    alone = bool(told) and found == told and not told <= _WEAK
    if comment or alone:
        return 4
    return 0 if not told or tag in _ARTICLE else 2 if found == told else 3 if told <= _WEAK else 1


def _decoded(text: str) -> str:
    """``text`` with its character references decoded; a number beyond all characters gives U+FFFD."""

    def short(m: re.Match) -> str:
        digits = (m[1] or m[2]).lstrip("0") or "0"
        return "\ufffd" if len(digits) > 7 else f"&#{'x' if m[2] else ''}{digits};"

    return html.unescape(_LONG_REFERENCE.sub(short, text) if "&#" in text else text)


def _tags(page: str) -> Generator[tuple[str, str, str, str, int], int | None, None]:
    """Text before each tag, its slash, name and attributes, and where it ends; at last the text after all.

    Comments and declarations have no name.  A tag that no unquoted ``>`` ends
    stops at the first ``>``; from then on quotes count for nothing, so a page
    is read in time proportional to its length.
    """
    at = begin = 0
    last, quotes = page.rfind(">"), True
    while (low := page.find("<", at)) >= 0:
        at = low + 1
        if page.startswith("!--", at):
            end = page.find("-->", at + 3)
            end = len(page) if end < 0 else end + 3
            yield page[begin:low], "", "", "", end
            at = begin = end
        elif low > last:
            break
        elif page[at] in "!?":
            end = page.index(">", at) + 1
            yield page[begin:low], "", "", "", end
            at = begin = end
        elif m := _NAME.match(page, at):
            rest = _REST.match(page, m.end()) if quotes else None
            quotes = rest is not None
            end = rest.end() if rest else page.index(">", m.end()) + 1
            skip = yield page[begin:low], m[1], m[2].lower(), page[m.end() : end - 1], end
            at = begin = skip or end
    yield page[begin:], "", "", "", -1


class _Open:
    """The open elements, with the depths at which each name, a scope and a table cell or the body are open.

    What an end tag or an implied end refers to is looked up, never searched for, so
    that a page with many open elements is read in time proportional to its length.
    """

    def __init__(self, root: Node):
        self.nodes = [root]
        self.at: dict[str, list[int]] = {root.tag: [0]}
        self.scopes: list[int] = []
        self.bars: list[int] = []

    def push(self, node: Node) -> None:
        depth = len(self.nodes)
        self.nodes.append(node)
        self.at.setdefault(node.tag, []).append(depth)
        if node.tag in _SCOPE:
            self.scopes.append(depth)
        if node.tag in _BARS:
            self.bars.append(depth)

    def close(self, depth: int) -> None:
        """Close what is open from ``depth`` on."""
        while len(self.nodes) > depth:
            tag = self.nodes.pop().tag
            self.at[tag].pop()
            if tag in _SCOPE:
                self.scopes.pop()
            if tag in _BARS:
                self.bars.pop()

    def depth(self, *names: str) -> int:
        """Depth of the innermost open element of these names, -1 if there is none."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def scope(self) -> int:
        return self.scopes[-1] if self.scopes else -1

    def bar(self) -> int:
        return self.bars[-1] if self.bars else -1


def parse(page: str) -> Node:
    """Node tree of a page; unclosed and stray tags are repaired as browsers do in simple cases."""
    root = Node("html", None)
    path = _Open(root)
    tags = _tags(page)
    text, slash, name, attributes, at = next(tags)
    while True:
        skip = None
        current = path.nodes[-1]
        if text:
            current.children.append(_decoded(text))
        if at < 0:
            return root
        if not name:
            pass
        elif slash:
            depth = path.depth(name)
            # Cells and the body hold in what is not closed inside of them.
            if path.bar() > depth and name not in _THROUGH:
                depth = -1
            if name == "p" and depth < 0:
                current.children.append(Node("p", current))
            if depth > 0:
                path.close(depth)
        elif name in ("html", "body"):
            if name == "body" and path.depth("body") < 0:
                path.close(1)
                root.children.append(body := Node("body", root))
                path.push(body)
        else:
            if name in _ENDS_P and path.depth("p") > path.scope():
                path.close(path.depth("p"))
            if name in _CLOSES and (depth := path.depth(*_CLOSES[name])) > path.scope():
                path.close(depth)
            current = path.nodes[-1]
            node = Node(name, current, _is_boiler(name, attributes, path), 0 if name in ("header", "body") else _is_named(name, attributes))
            current.children.append(node)
            if name in _RAW:
                found = re.compile(rf"</{re.escape(name)}\b", re.I).search(page, at)
                end = page.find(">", found.end()) + 1 if found else 0
                skip = end or len(page)
            elif name not in _VOID and not (attributes.endswith("/") and name not in _BLOCK):
                path.push(node)
        text, slash, name, attributes, at = tags.send(skip)


def _says_comments(node: Node) -> bool:
    """Whether the first thing in a node is a heading such as 3 Comments."""
    first = next((c for c in node.children if not isinstance(c, str) or c.strip()), None)
    if not isinstance(first, Node) or first.tag not in _HEADING:
        return False
    words = " ".join("".join(c if isinstance(c, str) else "".join(x for x in c.children if isinstance(x, str)) for c in first.children[:8])[:80].split())
    return bool(_COMMENTS_TITLE.fullmatch(words.lower()))


def _cut_named(root: Node) -> None:
    """Boilerplate by name.

    Anchors tell where the article is: article and main elements that neither
    have a name of boilerplate themselves nor lie in a node that has nothing
    else, or, where there are none, main headlines.  A node whose words all name
    boilerplate, at least one of them of a kind that no part of an article has,
    goes whatever its size if an anchor lies elsewhere: comments beside or in
    an article, also if each is an article element of its own, and adverts.

    Other nodes go if they hold no anchor (without anchors: no article or main
    element) nor most of the body's text outside links.  Where all words name boilerplate,
    only text in blocks inside counts.  Nodes of weak words need a density below
    the body's too, and no main headline.
    """
    order, stack, body = [], [root], root
    inside: dict[Node, bool] = {root: False}
    within: dict[Node, bool] = {root: False}
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag == "body":
            body = node
        # Only an article element in it, or its place outside of articles, makes a region by its heading alone.
        if node.tag in ("section", "div") and _says_comments(node) and (not within[node] or any(isinstance(c, Node) and c.tag == "article" for c in node.children)):
            node.named = 4
        for c in node.children:
            if isinstance(c, Node) and not c.boiler:
                inside[c] = inside[node] or node.named == 4
                within[c] = within[node] or node.tag in _ARTICLE
                stack.append(c)
    free = [n for n in order if n.named != 4 and not inside[n] and n.chars]
    articles = {n for n in free if n.tag in _ARTICLE}
    anchors = articles or {n for n in free if n.tag == "h1"}
    plain, wrapped, article, headline, holds = {}, {}, {}, {}, {}
    for node in reversed(order):
        inner = [c for c in node.children if isinstance(c, Node) and not c.boiler]
        plain[node] = 0 if node.tag == "a" else sum(len(c.strip()) for c in node.children if isinstance(c, str)) + sum(plain[c] for c in inner)
        wrapped[node] = sum(plain[c] if c.tag in _BLOCK else wrapped[c] for c in inner)
        article[node] = any(article[c] or c.tag in _ARTICLE for c in inner)
        headline[node] = node.tag == "h1" or any(headline[c] for c in inner)
        holds[node] = node in anchors or any(holds[c] for c in inner)
    for node in order:
        if node.named == 4 and anchors and not holds[node] and (articles or node.tag not in _ARTICLE):
            node.boiler = True
            continue
        held = wrapped[node] if node.named in (2, 4) else plain[node]
        named = bool(node.named) and node.tag not in _ARTICLE and not (node.named == 3 and (headline[node] or node.density >= body.density))
        kept = holds[node] if articles else article[node]
        node.boiler = named and not kept and 2 * held <= plain[body]


def _measure(root: Node) -> tuple[Node, int]:
    """Counts of each node that stays, bottom up; the body (or root) and its characters."""
    order, stack, body = [], [root], root
    while stack:
        node = stack.pop()
        order.append(node)
        if node.tag == "body":
            body = node
        stack.extend(c for c in node.children if isinstance(c, Node) and not c.boiler)
    for node in reversed(order):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                chars += len(c.strip())
            elif not c.boiler:
                chars += c.chars
                tags += c.tags + 1
                link_chars += c.link_chars
                link_tags += c.link_tags + (c.tag == "a")
        if node.tag == "a":
            link_chars = chars
        node.chars, node.tags, node.link_chars, node.link_tags = chars, tags, link_chars, link_tags
    whole, linked = body.chars, body.link_chars

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        base = math.log(c * lc / max(c - lc, 1) + linked * c / max(whole, 1) + math.e)
        return c / t * math.log(c * t / (max(lc, 1) * lt) + 1.0) / math.log(base + 1.0)

    for node in reversed(order):
        inner = [x for x in node.children if isinstance(x, Node) and not x.boiler]
        node.density = density(node.chars, max(node.tags, 1), node.link_chars, max(node.link_tags, 1))
        node.loose = 0.0 if node.tag == "a" else density(sum(len(x.strip()) for x in node.children if isinstance(x, str)), 1, 0, 1)
        node.total = sum(x.density for x in inner)
        node.peak = node
        for x in inner:
            if x.chars and (x.peak.total, x.peak.tag in _ARTICLE) > (node.peak.total, node.peak.tag in _ARTICLE):
                node.peak = x.peak
    return body, whole


def _keep(body: Node) -> None:
    """Mark what belongs to the article."""

    def raised(top: Node) -> Node:
        lift = top.peak.lift
        return lift if lift is not None and lift.depth >= top.depth else top

    node = raised(body)
    node.kept, threshold = True, node.density
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    stack = [body]
    while stack:
        node = stack.pop()
        if node.chars and node.density >= threshold:
            (node if node.loose >= threshold else raised(node)).kept = True
        if not node.kept:
            stack.extend(c for c in node.children if isinstance(c, Node) and not c.boiler)


def _blocks(body: Node) -> list[str]:
    """Text of the kept nodes, block by block."""
    out, held, heading = [], [], []

    def close() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    stack: list[tuple[Node | str, bool, bool]] = [(body, False, False)]
    while stack:
        x, inside, done = stack.pop()
        if isinstance(x, str):
            if inside:
                held.append(x)
            elif x.strip():
                heading.clear()
            continue
        if done:
            close()
            continue
        if x.boiler:
            if inside and x.tag in _BLOCK:
                close()
            continue
        if not inside and x.kept:
            inside = True
            close()
            out.extend(heading)
            heading.clear()
            stack.append((x, True, True))
        elif not inside and x.tag in _HEADING and x.chars:
            heading.extend(_blocks_of(x))
            continue
        elif inside:
            if x.tag in _BLOCK:
                close()
            if x.tag in _BLOCK:
                stack.append((x, True, True))
        stack.extend((c, inside, False) for c in reversed(x.children))
    close()
    return out


def _blocks_of(node: Node) -> list[str]:
    node.kept = True
    return _blocks(node)


def main_text(page: str | None) -> str:
    """Main text of one page; empty for null, empty and text-free pages."""
    if not page:
        return ""
    root = parse(page)
    _measure(root)
    _cut_named(root)
    body, chars = _measure(root)
    if not chars:
        return ""
    _keep(body)
    return " ".join(_blocks(body))


def extract_main_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (its code points) to the columns ``keep`` of ``pages``.

    Character references are decoded, white space inside a block becomes one
    blank, blocks are joined in page order by one blank.  A page without main
    text has an empty one; repeated rows each give a row; nothing is shuffled.
    Columns of ``pages`` named ``text`` or ``n_chars`` give way to the new ones.
    """
    keep = [c for c in (pages.columns if keep is None else keep) if c not in ("text", "n_chars") and (keep or c != html_col)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], plain)

    # Plain names on the way through, whatever the columns are called.
    plain = [f"c{i}" for i in range(len(keep) + 2)]
    schema = StructType([StructField(n, k) for n, k in zip(plain, [*(pages.schema[c].dataType for c in keep), StringType(), LongType()])])
    rows = pages.select(*[F.col(quoted(c)).alias(n) for c, n in zip(keep, plain)], F.col(quoted(html_col)).alias("html"))
    return rows.mapInArrow(extract, schema).toDF(*keep, "text", "n_chars")
