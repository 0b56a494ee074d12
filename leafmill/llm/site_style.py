"""HTML extraction with a site style tree.

The pages of a host are merged into one tree. A node is an element's path (tags, with classes without digits); beside
the paths a host has one node for each kind of element that HTML or a whole class name marks (`nav`, `footer`, `ad`,
`comments`, ...), and one for text that stands beside an article. For each node the pages' presentations (the sequence
of its child elements) and contents (the text right in it) are counted. A node's importance is a mix of the entropies
of the two, as shares of the largest entropy that so many pages could have, times the prior of its kind: what looks and
reads the same on every page has importance 0, and so has a menu, whose entries would otherwise give it an article's.
The priors are in PRIORS; paths have 1. What leaves a page is decided by the tree alone: with an empty tree all text
stays.

A branch is as important as the most important node that a page has in it, and is removed if that is below LEAST. A
path needs LEAST_PAGES pages and a LEAST_SHARE of the host's for that, and a host some path with text that is
important: where nothing is, as for copies of one page, entropies don't tell parts apart. Inside of an article a path's
branch goes only where its content is one that many pages repeat word for word, and a class name is no more than a
prior there: only with enough pages that look alike in it, or a second mark of its family inside, is it removed. A mark
on an element that holds the page's article, or nearly all of the text of a page without one, is void.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship_code
from .shared import discard, text_or_empty, written

LEAST, CONTENT_SHARE, LEAST_PAGES, LEAST_SHARE = 0.2, 0.9, 10, 0.2
#: Share of a page's text that makes its articles the page's text, and share that voids a mark on a page without one.
MAIN_SHARE, WHOLE_SHARE = 0.5, 0.8
#: Pages of a (host, salt) at most, and hosts that can have several salts.
ROWS_A_SALT, HOT_HOSTS = 4096, 1000

_token = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)()[^>]*>|<[!?/][^>]*>""", re.S
)
_attribute = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
_part = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
#: Elements whose text isn't text of the page.
UNREAD = frozenset(
    "script style noscript template head select option input textarea iframe object embed canvas svg audio video map applet noembed noframes title".split()
)
#: Elements and roles that HTML itself sets apart from a page's text; a header is one outside of articles.
MARKED = frozenset("nav footer aside form button dialog menu".split())
MARKED_OUTSIDE = frozenset(["header"])
MARKED_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Class names and ids that mark an element, alone or joined with PLAIN_WORDS; values are their families.
MARK_WORDS = {
    w: line.split()[0]
    for line in (
        "ad ads advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion",
        "menu nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager",
        "sidebar widget", "footer", "masthead header", "cookie cookies consent gdpr notice notices alert popup modal",
        "newsletter subscribe login signup", "comment comments commentlist reply replies disqus", "share sharing social", "related recommended",
    )
    for w in line.split()
}
PLAIN_WORDS = frozenset("site page top bottom left right list item items box area section wrapper wrap container block bar links inner outer main primary secondary global".split())
MAIN = frozenset(["article", "main"])
#: Prior of a kind by where its mark comes from; see above.
PRIORS = {"path": 1.0, "element": 0.0, "word": 0.15, "beside": 0.15, "word in article": 0.2}
#: A start tag that closes an open element of these names, up to the given boundary.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "thead": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tbody": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th".split()), frozenset(["table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_P = frozenset(["p"])
_P_STOPS = frozenset("div section article main td th li table body blockquote aside nav header footer button".split())


class Node:
    """An element. Inline ones belong to the block that holds them, `block`; only blocks are numbered."""

    __slots__ = ("block", "inside", "label", "main", "mute", "number", "origin", "outer", "tag", "word")

    def __init__(self, tag: str, label: str, outer: Node | None, mute: bool, inside: bool):
        self.tag, self.label, self.outer, self.mute, self.inside = tag, label, outer, mute, inside
        self.block: Node = self
        self.main, self.number, self.origin, self.word = False, 0, "", ""


def mark_word(names: str) -> str:
    """The family of the first of these class names that is a mark, or "": all parts of such a name are marks or plain
    words, so that `site-header` and `ad-box` are marks and `share-price` and `has-sidebar` aren't."""
    for name in names.lower().split():
        parts = [p for p in re.split(r"[-_\d]+", name) if p]
        if parts and all(p in MARK_WORDS or p in PLAIN_WORDS for p in parts):
            for p in parts:
                if p in MARK_WORDS:
                    return MARK_WORDS[p]
    return ""


def parse(html: str) -> tuple[list[Node], list[tuple[Node, str]]]:
    """The block elements of a page, the root first, and its texts in order (the block element, its text).

    Unclosed elements are closed as HTML does for paragraphs, list items and table parts, others where an outer
    element ends; end tags without an open element are dropped. Time and memory are linear in the page, however deep.
    """
    root = Node("", "", None, False, False)
    stack, nodes, blocks, pending = [root], [root], [], []
    is_open: Counter = Counter()
    opened: set[str] = set()
    at, size = 0, len(html)

    def flush() -> None:
        if pending:
            text = "".join(pending)
            if "&" in text:
                text = entities.unescape(text)
            pending.clear()
            if text := " ".join(text.split()):
                blocks.append((stack[-1].block, text))

    def close(count: int) -> None:
        for _ in range(count):
            if stack[-1].tag not in INLINE:
                flush()
            tag = stack.pop().tag
            is_open[tag] -= 1
            if not is_open[tag]:
                opened.discard(tag)

    def close_open(names: frozenset, stops: frozenset) -> None:
        while not names.isdisjoint(opened):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in names:
                    close(len(stack) - i)
                    break
                if stack[i].tag in stops:
                    return
            if len(names) == 1:
                return

    while at < size:
        m = _token.search(html, at)
        text = html[at : m.start() if m else size]
        if text and not stack[-1].mute:
            pending.append(text)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:  # an end tag
            if tag in opened:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == tag:
                        close(len(stack) - i)
                        break
            elif tag not in INLINE and not stack[-1].mute:
                flush()
            continue
        if tag == "br" or tag == "wbr" or tag == "img":
            if tag == "br" and not stack[-1].mute:
                pending.append("\n")
            continue
        inline = tag in INLINE
        if not inline:
            close_open(_P, _P_STOPS)
            if rule := CLOSES.get(tag):
                close_open(*rule)
            flush()
        outer = stack[-1]
        node = Node(tag, tag, outer, outer.mute or tag in UNREAD, outer.inside)
        if tag in MARKED or (tag in MARKED_OUTSIDE and not outer.inside):
            node.origin, node.word = "element", tag
        if rest := m[3]:
            for a in _attribute.finditer(rest):
                key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
                if key in ("class", "id") and value:
                    if key == "class" and (found := _part.findall(value.lower())):
                        node.label = f"{tag}.{'.'.join(found)}"
                    if not node.origin and tag not in ("html", "body", "main") and (word := mark_word(value)):
                        node.origin, node.word = "word", word
                elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                    node.mute = True
                elif key == "role" and value.lower() in MARKED_ROLES:
                    node.origin, node.word = "element", value.lower()
        if inline:
            node.block, node.origin = outer.block, ""
        else:
            node.outer = outer.block
            node.number = len(nodes)
            nodes.append(node)
            if tag in MAIN and not node.origin:
                node.main = node.inside = True
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            stop = end.start() if end else size
            if not node.mute:
                pending.append(html[at:stop])
            at = stop
        if tag not in VOID:
            stack.append(node)
            is_open[tag] += 1
            opened.add(tag)
    close(len(stack) - 1)
    flush()
    return nodes, blocks


def _id(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(parts)) >> 1


def kind_id(origin: str, word: str) -> int:
    return _id("kind", origin, word)


BESIDE = kind_id("beside", "")


def repeated_id(path: int, content: int) -> int:
    return path ^ content


class Page:
    """What the tree needs of a page, and what is left of the page itself when its HTML isn't needed any more.

    outer, path, kind (0: none), inside: of each block element; owner, text, beside: of each text; node, prior, show,
    say: of each node of the tree that the page has, its id, prior, presentation and content.
    """

    __slots__ = ("beside", "inside", "kind", "node", "outer", "owner", "path", "prior", "say", "show", "text")

    def __init__(self, html: str):
        nodes, blocks = parse(html)
        count = len(nodes)
        self.outer = [n.outer.number if n.outer else -1 for n in nodes]
        self.owner, self.text = [n.number for n, _ in blocks], [t for _, t in blocks]
        length, in_main, below = [0] * count, [0] * count, [0] * count
        hard = [False] * count  # in an element that HTML sets apart; a form may hold the whole page
        for i, n in enumerate(nodes):
            hard[i] = (n.origin == "element" and n.word != "form") or (i > 0 and hard[self.outer[i]])
        for i, text in zip(self.owner, self.text, strict=True):
            if not hard[i]:
                length[i] += len(text)
                in_main[i] += len(text) if nodes[i].inside else 0
        bit: dict[str, int] = {"form": 1}
        for i in range(count - 1, 0, -1):
            o, n = self.outer[i], nodes[i]
            length[o] += length[i]
            in_main[o] += in_main[i]
            below[o] |= below[i] | (bit.setdefault(n.word, 1 << len(bit)) if n.origin else 0)  # marks inside
        self.kind, labels, priors = [0] * count, [n.label for n in nodes], {}
        for i, n in enumerate(nodes):
            origin = n.origin
            if not origin or ((origin == "word" or n.word == "form") and self._void(origin, i, length, in_main)):
                continue
            if origin == "word" and n.inside and not below[i] & (bit.get(n.word, 0) | bit["form"]):
                origin = "word in article"
            self.kind[i] = kind_id(origin, n.word)
            priors[self.kind[i]] = PRIORS[origin]
            labels[i] += f"!{n.word}"
        self.inside = [n.inside for n in nodes]
        self.path = [0] * count
        for i in range(1, count):
            self.path[i] = xxhash.xxh3_64_intdigest(labels[i], self.path[self.outer[i]]) >> 1
        marked = [False] * count
        for i in range(count):
            marked[i] = self.kind[i] != 0 or (i > 0 and marked[self.outer[i]])
        plain = sum(len(t) for i, t in zip(self.owner, self.text, strict=True) if not marked[i])
        articles = sum(len(t) for i, t in zip(self.owner, self.text, strict=True) if not marked[i] and nodes[i].inside)
        main = articles > 0 and articles >= MAIN_SHARE * plain
        self.beside = [main and not nodes[i].inside for i in self.owner]
        self._count(labels, priors)

    @staticmethod
    def _void(origin: str, i: int, length: list[int], in_main: list[int]) -> bool:
        """Whether a mark stands on what holds the page's text."""
        if in_main[0]:
            return in_main[i] >= MAIN_SHARE * in_main[0]
        return origin == "word" and 0 < length[i] >= WHOLE_SHARE * length[0]

    def _count(self, labels: list[str], priors: dict[int, float]) -> None:
        shows: dict[int, list] = {p: [] for p in self.path}
        says: dict[int, list] = {p: [] for p in self.path}
        last: dict[int, str] = {}
        for i in range(1, len(self.path)):
            o = self.outer[i]
            if last.get(o) != labels[i]:
                shows[self.path[o]].append(labels[i])
            last[o] = labels[i]
            if k := self.kind[i]:
                shows.setdefault(k, []).append(labels[i])
                says.setdefault(k, [])
        for i, text, beside in zip(self.owner, self.text, self.beside, strict=True):
            says[self.path[i]].append(text)
            if self.kind[i]:
                says[self.kind[i]].append(text)
            if beside:
                shows.setdefault(BESIDE, []).append(labels[i])
                says.setdefault(BESIDE, []).append(text)
        priors[BESIDE] = PRIORS["beside"]
        self.node = list(shows)
        self.prior = [priors.get(node, PRIORS["path"]) for node in shows]
        self.show = [_id(*show) for show in shows.values()]
        self.say = [_id(*says[node]) for node in shows]


def left_of(outer, path, kind, inside, owner, text, beside, says, removed: frozenset[int]) -> list[str]:
    """The texts of a Page() that stay. removed: ids of nodes without importance of the host's tree, and repeated_id()s."""
    count = len(outer)
    gone, low = [False] * count, [False] * count
    for i in range(count):
        gone[i] = (kind[i] != 0 and kind[i] in removed) or (i > 0 and gone[outer[i]])
        low[i] = path[i] in removed
    for i in range(count - 1, 0, -1):  # a branch is as important as its most important node
        if not low[i] and not gone[i]:
            low[outer[i]] = False
    kept = []
    for i, t, b in zip(owner, text, beside, strict=True):
        if gone[i] or (b and BESIDE in removed):
            continue
        if low[i] and (not inside[i] or (repeated_id(path[i], says[path[i]]) in removed and not _article_low(i, outer, low, inside))):
            continue
        kept.append(t)
    return kept


def _article_low(i: int, outer, low, inside) -> bool:
    """Whether the article around a node is a branch without importance as a whole."""
    while outer[i] >= 0 and inside[outer[i]]:
        i = outer[i]
    return low[i]


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


_LISTS = {
    "outer": pa.int32(), "path": pa.int64(), "kind": pa.int64(), "inside": pa.bool_(), "owner": pa.int32(), "text": pa.string(), "beside": pa.bool_(),
    "node": pa.int64(), "prior": pa.float64(), "show": pa.int64(), "say": pa.int64(),
}
_TYPES = {pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean", pa.string(): "string", pa.float64(): "double"}
_PAGE = ", ".join(f"{name} array<{_TYPES[kind]}>" for name, kind in _LISTS.items())


def _lists(parts: list[list], kind: pa.DataType) -> pa.Array:
    bounds = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(list(chain.from_iterable(parts)), type=kind))


#: Pages that a worker has parsed at a time.
PAGES_AT_ONCE = 64


def parsed_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, host, html) with what Page() makes of each one's html in its place: the only parse."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(at, PAGES_AT_ONCE)
                made = [Page(h) for h in batch.column(3).to_pylist()]
                columns = [_lists([getattr(p, name) for p in made], kind) for name, kind in _LISTS.items()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=["page_id", "url", "host", *_LISTS])

    return pages.select("page_id", "url", "host", "html").mapInArrow(work, f"page_id {kind}, url string, host string, {_PAGE}")


def style_tree(parsed: DataFrame) -> DataFrame:
    """host, node, prior, importance, n_pages of every node of the hosts' style trees."""
    each = parsed.select("host", F.explode(F.arrays_zip("node", "prior", "show", "say")).alias("v"))
    two = F.array(F.struct(F.lit(0).alias("what"), F.col("v.show").alias("value")), F.struct(F.lit(1).alias("what"), F.col("v.say").alias("value")))
    each = each.select("host", F.col("v.node").alias("node"), F.col("v.prior").alias("prior"), F.explode(two).alias("x"))
    counted = each.groupBy("host", "node", "prior", F.col("x.what").alias("what"), F.col("x.value").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    share = F.when(n > 1, (F.log(n) - F.sum(F.col("n") * F.log("n")) / n) / F.log(n)).otherwise(1.0)
    kinds = counted.groupBy("host", "node", "prior", "what").agg(share.alias("share"), n.alias("n_pages"))
    weight = F.when(F.col("what") == 1, CONTENT_SHARE).otherwise(1 - CONTENT_SHARE)
    mixed = F.round(F.sum(F.col("share") * weight) * F.col("prior"), 9)
    return kinds.groupBy("host", "node", "prior").agg(mixed.alias("importance"), F.max("n_pages").alias("n_pages"))


def removed_branches(parsed: DataFrame) -> DataFrame:
    """host, of_pages, removed: the nodes without importance of each host's tree, and repeated_id()s of its paths. A
    written table.

    A page has each path once, so a host has at most the nodes of a page / LEAST_SHARE of them, however many pages; a
    path has at most 1 / LEAST_SHARE repeated contents, and kinds are few.
    """
    tree = written(style_tree(parsed), "style-tree")
    is_path = F.col("prior") == PRIORS["path"]
    hosts = tree.groupBy("host").agg(F.max("n_pages").alias("of_pages"), F.max(F.when(is_path & (F.col("node") != 0), F.col("importance"))).alias("most"))
    low = tree.join(hosts, "host").where((F.col("importance") < LEAST) & (F.col("node") != 0))
    often = (F.col("n_pages") >= F.greatest(F.lit(LEAST_PAGES), F.col("of_pages") * LEAST_SHARE)) & (F.col("most") >= LEAST)
    enough = F.when(is_path, often).when(F.col("prior") == PRIORS["word in article"], F.col("n_pages") >= LEAST_PAGES).otherwise(True)
    low = written(low.where(enough).select("host", "of_pages", "node", "prior", "n_pages"), "low")
    says = parsed.select("host", F.explode(F.arrays_zip("node", "say")).alias("v")).select("host", F.col("v.node").alias("node"), F.col("v.say").alias("say"))
    repeated = (
        says.join(low.where(is_path).drop("prior"), ["host", "node"]).groupBy("host", "of_pages", "node", "n_pages", "say").agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= LEAST_PAGES) & (F.col("n") >= F.col("n_pages") * LEAST_SHARE))
    )
    keys = low.select("host", "of_pages", "node").union(repeated.select("host", "of_pages", F.col("node").bitwiseXOR(F.col("say"))))
    removed = written(keys.groupBy("host", "of_pages").agg(F.array_sort(F.collect_list("node")).alias("removed")), "removed")
    discard(tree)
    discard(low)
    return removed


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars.

    Null html counts as empty, and its text is empty; a null url is a host of its own; repeated rows and null ids are
    rows like others. A page on which nothing is important has an empty text. No row, no result. Other columns of pages
    are not looked at.
    """
    ship_code(pages.sparkSession)
    named = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), text_or_empty(html_col).alias("html"))
    parsed = written(parsed_pages(named), "parsed")
    return _left(parsed, removed_branches(parsed))


def _left(parsed: DataFrame, removed: DataFrame) -> DataFrame:
    """What the hosts' trees leave of their pages."""
    # a host may hold a third of all pages: its one row is copied to salts. Such hosts are HOT_HOSTS at most, so they
    # are broadcast whatever the data
    many = max(ROWS_A_SALT, parsed.count() // HOT_HOSTS)
    salts = F.ceil(F.col("of_pages") / ROWS_A_SALT).cast("int")
    hot = F.broadcast(removed.where(F.col("of_pages") > many).select(F.col("host").alias("hot"), salts.alias("salts")))
    copies = F.when(F.col("of_pages") > many, salts).otherwise(1)
    salted = removed.select("host", "removed", F.explode(F.sequence(F.lit(0), copies - 1)).alias("salt"))
    placed = parsed.join(hot, F.col("host") == F.col("hot"), "left")
    placed = placed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1)).cast("long")).cast("int"))
    columns = ["page_id", "url", "outer", "path", "kind", "inside", "owner", "text", "beside", "node", "say", "removed"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, PAGES_AT_ONCE):
                batch = whole.slice(at, PAGES_AT_ONCE)
                parts = [batch.column(i).to_pylist() for i in range(2, len(columns))]
                texts = ["\n\n".join(left_of(*page[:7], dict(zip(*page[7:9], strict=True)), frozenset(page[9] or ()))) for page in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    kind = parsed.schema["page_id"].dataType.simpleString()
    joined = placed.join(salted, ["host", "salt"], "left").select(*columns)
    return joined.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
