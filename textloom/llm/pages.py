"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged by path: an element node is known by the tags (and
classes, without digits) from the root to it.  For each node the tree keeps how many pages
have it, the presentations (sequences of child tags) and the contents (hashed texts) it had.
Its importance combines the entropy of presentations and, for content, one minus the mean
entropy of its texts over the host's pages; a text on all pages counts 0, a text on one
page 1.  Every element takes part, articles, their paragraphs and named furniture included,
if at least ``LEAST_PAGES`` different pages show it: rows of one host and html are one page.
A branch of a page goes if its root and all that is below it stay under ``IMPORTANT``.
Branches that together hold more than half of an article's text stay, as that is what
articles shared by pages look like; where nothing would be left, the node with most text
stays.  Only sums by node and hashes of repeated pages are shuffled.

What entropy cannot tell (adverts and comments differ from page to page, and hosts of few
pages tell nothing) goes by what elements say they are: nav, footer, aside, form, script,
comments, adverts..., and a page with an article (or main) element gives only what is inside
it.  A class or id counts as a whole, without digits at its end; names that content has too
are left to the tree.  An article inside furniture that is so only by name, comments apart,
is read where the rest of the page has no article and less text.

Blocks: text between the borders of block elements, character references decoded, white
space made one space, joined by newlines.  br is white space.

Cases: null or empty html gives an empty text; unclosed, cut and wrongly nested tags are
read as browsers do roughly (end tags close what is open, a new paragraph or item closes
the last), in time and memory linear in the page, however deeply nested; a null url is a
host of its own; repeated rows give repeated results; other columns are left out.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from typing import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.shared import written

LEAST_PAGES = 4
IMPORTANT = 0.2
#: Share of an article's text that branches of low importance may hold.
MOST_OF_ARTICLE = 0.5
#: Parts into which a host's pages are dealt to meet its branches.
SALTS = 32
#: Weight of what is below a node for each presentation that it has.
DAMPING = 0.9

#: Element kinds of HTML and the usual names of page furniture.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "canvas", "title", "textarea"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br",
}
NOISE_TAGS = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "head", "input", "fieldset", "datalist", "audio", "video"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar", "alertdialog"}
NOISE_NAMES = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo",
    "cookie", "cookies", "gdpr", "sidebar", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment",
    "comments", "disqus", "share", "sharing", "newsletter", "subscribe", "signup", "login", "popup", "modal", "toolbar", "pagination", "pager",
    "topbar", "hidden", "header", "cookie-notice", "cookie-banner", "cookie-bar", "cookie-consent", "site-footer", "page-footer", "site-header",
    "site-nav", "main-nav", "nav-menu", "main-menu", "share-buttons", "social-share", "social-links", "related-posts", "comment-list", "skip-link",
}
COMMENTS = {"comment", "comments", "comment-list", "disqus"}
CLOSED_BY = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|([^<]+)|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+", re.I)
_END = re.compile(r"[-\d]+$")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PARAGRAPH_ENDS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"}


class Element:
    __slots__ = ("tag", "node", "noise", "article", "main", "children", "block", "parent", "named", "doubtful", "alive")

    def __init__(self, tag: str, node: int, parent: Element | None, noise: bool, article: bool, main: bool, block: bool):
        self.tag, self.node, self.noise, self.article, self.main, self.block = tag, node, noise, article, main, block
        self.parent = parent  # the block element around it
        self.children: list[str] = []
        self.named = False  # whether it is noise by a name only
        self.doubtful = False  # whether an article or main around it is in noise by name
        self.alive = False  # whether it or something below it is important


def child_node(parent: int, name: str) -> int:
    """The node of an element, from its parent's and its own tag and classes."""
    return xxhash.xxh3_64_intdigest(name, parent) >> 1


def node_of(path: str) -> int:
    """The node of a path such as /html/body/div.top."""
    node = 0
    for name in path.split("/")[1:]:
        node = child_node(node, name)
    return node


def _open(tag: str, attributes: str, parent: Element) -> Element:
    classes, named, main = "", parent.named, parent.main
    noise, article, doubtful = parent.noise and not named, parent.article, parent.doubtful
    resets = tag in ("article", "main")
    if attributes and not attributes.isspace():
        found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
        classes = "".join("." + w for w in _NAME.findall(_CAMEL.sub(" ", f"{found.get('class', '')} {found.get('id', '')}"))).lower()
        style = found.get("style", "").replace(" ", "").lower()
        role = found.get("role", "").lower()
        names = {_END.sub("", name) for name in f"{found.get('class', '')} {found.get('id', '')}".lower().replace("_", "-").split()}
        resets |= role == "main"
        noise |= role in NOISE_ROLES or bool(names & COMMENTS)
        noise |= "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in style
        if not resets and tag not in ("html", "body"):
            named |= bool(names & (NOISE_NAMES - {"header"}))
            named |= "header" in names and not (article or main or tag == "h1")
        main |= role == "main"
    noise |= tag in NOISE_TAGS or (tag == "header" and not (article or main))
    article |= tag == "article"
    main |= tag == "main"
    if resets and named:
        named, doubtful = False, True
    named &= not noise
    around = parent if parent.block else parent.parent
    block = tag not in INLINE
    element = Element(tag, child_node(around.node, tag + classes) if block else around.node, around, noise or named, article, main, block)
    element.named, element.doubtful = named, doubtful
    return element


class _Stack:
    """Open elements, with the places of each tag and of the blocks among them."""

    def __init__(self, root: Element):
        self.open = [root]
        self.places: dict[str, list[int]] = {}
        self.blocks = [0]

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.open))
        if element.block:
            self.blocks.append(len(self.open))
        self.open.append(element)

    def close(self, k: int) -> None:
        """Closes place k and all after it."""
        while len(self.open) > k:
            element = self.open.pop()
            self.places[element.tag].pop()
            if element.block:
                self.blocks.pop()

    def last(self, tag: str) -> int:
        """The innermost open element of the tag, or 0."""
        places = self.places.get(tag)
        return places[-1] if places else 0


def parse(html: str) -> tuple[list[tuple[str, Element]], list[Element]]:
    """Blocks of text in page order, each with its element, and all block elements, parents first."""
    root = Element("", 0, None, False, False, False, True)
    root.alive = True
    stack, elements, blocks, pieces = _Stack(root), [], [], []
    owner = root

    def flush() -> None:
        if pieces:
            text = "".join(pieces)
            pieces.clear()
            if "&" in text:
                text = entities.unescape(text)
            text = " ".join(text.split())
            if text:
                blocks.append((text, owner))

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        text = m[7]
        if text is not None or m[0] == "<":
            top = stack.open[-1]
            if not pieces:
                owner = top
            if top.noise != owner.noise:  # an inline element that is noise
                flush()
                owner = top
            pieces.append(text or "<")
            continue
        tag = m[2] or m[5]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                pieces.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            k = stack.last(tag)
            if k:
                # an inline end tag doesn't close blocks
                over_block = stack.blocks[-1] >= k
                if tag in INLINE and over_block:
                    continue
                if over_block:
                    flush()
                stack.close(k)
            elif tag not in INLINE:
                flush()
            continue
        if tag == "br":
            pieces.append(" ") if pieces else None
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}\\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            if tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
            closing = CLOSED_BY.get(tag, "p" if tag in _PARAGRAPH_ENDS else "").split()
            if stack.blocks[-1] and stack.open[stack.blocks[-1]].tag in closing:
                stack.close(stack.blocks[-1])
        element = _open(tag, m[3] if m[3] is not None else m[6], stack.open[-1])
        if element.block:
            element.parent.children.append(tag)
            elements.append(element)
        if not m[0].endswith("/>") or tag not in ("svg", "math"):
            stack.push(element)
    flush()
    return blocks, elements


def _in_scope(blocks: list[tuple[str, Element]]) -> list[tuple[str, Element]]:
    """Blocks of the articles, or else of main; none without either."""
    for scope in ("article", "main"):
        if found := [(t, e) for t, e in blocks if getattr(e, scope)]:
            return found
    return []


def main_text(html: str | None, low: set[int]) -> str:
    """Blocks of the article, or of the page, without furniture and branches of low nodes."""
    return "\n".join(t for t, _ in _kept(_judged(html, low)))


def removed_by(html: str | None, low: set[int]) -> Counter:
    """How many blocks stay (kept), and how many go because the tree says so (tree), else because of what their elements are called (name), else because they lie outside the article (scope)."""
    blocks = _judged(html, low)
    stay = Counter(id(e) for _, e in _kept(blocks))
    reasons: Counter = Counter()
    for _, e in blocks:
        if stay[id(e)]:
            stay[id(e)] -= 1
            reasons["kept"] += 1
        else:
            reasons["name" if (e if e.block else e.parent).alive and e.noise else "tree" if not (e if e.block else e.parent).alive else "scope"] += 1
    return reasons


def _judged(html: str | None, low: set[int]) -> list[tuple[str, Element]]:
    """Blocks of a page; elements with nothing important in them, by the tree, are not alive."""
    blocks, elements = parse(html or "")
    for e in reversed(elements):
        e.alive |= e.node not in low
        e.parent.alive |= e.alive
    return blocks


def _kept(blocks: list[tuple[str, Element]]) -> list[tuple[str, Element]]:
    sure = [(t, e) for t, e in blocks if not e.noise and not e.doubtful]
    kept = _in_scope(sure)
    if not kept:
        inside = _in_scope([(t, e) for t, e in blocks if not e.noise and e.doubtful])
        kept = max(sure, inside, key=lambda part: sum(len(t) for t, _ in part))
    return _important(kept)


def _important(kept: list[tuple[str, Element]]) -> list[tuple[str, Element]]:
    """Blocks outside branches of low importance."""
    alive = [(t, e) for t, e in kept if (e if e.block else e.parent).alive]
    in_article = bool(kept) and all(e.article or e.main for _, e in kept)
    if in_article and sum(len(t) for t, _ in alive) < (1 - MOST_OF_ARTICLE) * sum(len(t) for t, _ in kept):
        return kept
    if alive or not kept:
        return alive
    sizes: Counter = Counter()
    for t, e in kept:
        sizes[e.node] += len(t)
    most = max(sizes.values())
    node = min(n for n, size in sizes.items() if size == most)
    return [(t, e) for t, e in kept if e.node == node]


def host(url):
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][\w+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def _tree_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """host, node, kind (0 presentation, 1 content), feature and the batch's pages that have it, a row of n copies as 1 / n."""
    for batch in batches:
        counts: Counter = Counter()
        for site, html, copies in zip(batch.column(0), batch.column(1), batch.column(2).to_pylist()):
            blocks, elements = parse(html.as_py() or "")
            site = site.as_py()
            features = {(e.node, 0, xxhash.xxh3_64_intdigest(" ".join(e.children)) >> 1) for e in elements}
            features |= {(e.node, 1, xxhash.xxh3_64_intdigest(t) >> 1) for t, e in blocks}
            for f in features:
                counts[(site, *f)] += 1 / copies
        rows = [(*k, c) for k, c in counts.items()]
        columns = list(zip(*rows)) or [[]] * 5
        kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "node", "kind", "feature", "pages"])


def importance(pages: DataFrame) -> DataFrame:
    """host, node and the importance of each node that enough pages of its host have."""
    read = pages.select(host(F.col("url")).alias("host"), F.col("html").cast("string").alias("html"))
    body = F.xxhash64("html")
    repeated = written(read.groupBy("host", body.alias("body")).count().filter("count > 1").withColumnsRenamed({"host": "_host", "body": "_body"}))
    once = read.withColumn("body", body).join(repeated, (F.col("host") == F.col("_host")) & (F.col("body") == F.col("_body")), "left")
    rows = once.select("host", "html", F.coalesce("count", F.lit(1)).alias("copies")).mapInArrow(_tree_rows, "host string, node long, kind int, feature long, pages double")
    features = rows.groupBy("host", "node", "kind", "feature").agg(F.round(F.sum("pages")).alias("n"))
    style, content = F.col("kind") == 0, F.col("kind") == 1
    nodes = features.groupBy("host", "node").agg(
        F.sum(F.when(style, F.col("n"))).alias("pages"),
        F.count(F.when(style, 1)).alias("styles"),
        F.sum(F.when(style, F.col("n") * F.log("n"))).alias("style_log"),
        F.count(F.when(content, 1)).alias("texts"),
        F.sum(F.when(content, F.log("n"))).alias("text_log"),
    )
    scale = F.log(F.col("pages"))
    presentation = F.greatest(F.lit(0.0), 1 - F.col("style_log") / (F.col("pages") * scale))
    below = F.coalesce(F.greatest(F.lit(0.0), 1 - F.col("text_log") / (F.col("texts") * scale)), F.lit(0.0))
    damped = F.pow(F.lit(DAMPING), F.col("styles"))
    return nodes.filter(F.col("pages") >= LEAST_PAGES).select("host", "node", ((1 - damped) * presentation + damped * below).alias("importance"))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    nodes = importance(pages).filter(F.col("importance") < IMPORTANT).groupBy("host").agg(F.collect_list("node").alias("low"))
    low = written(nodes)  # its size is known before the join is planned
    # a host with many pages is many keys
    salted = low.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
    read = pages.select("page_id", "url", F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    read = read.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
    joined = read.join(salted, ["host", "salt"], "left").select("page_id", "url", "html", "low", "host")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one set for all pages of a host in the batch
            of_host: dict[str, set[int]] = {}
            texts = []
            for h, p, site in zip(batch.column(2), batch.column(3), batch.column(4).to_pylist()):
                if site not in of_host:
                    of_host[site] = set(p.as_py() or ())
                texts.append(main_text(h.as_py(), of_host[site]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")
