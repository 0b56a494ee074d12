"""HTML documents: cleaning, and Markdown in document order."""

from __future__ import annotations

import re
from html import escape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LABELS
from ..functions.dom import Element, parse
from ..functions.text import IMAGE_SCHEMES, LINK_SCHEMES
from ..functions.arrow import arrow
from ..ship import ship_code

#: Elements that cleaning removes, and the attributes that it leaves.
NOISE = frozenset("script style noscript template iframe object embed".split())
ATTRIBUTES = {
    "a": {"href", "title"}, "img": {"src", "alt", "title", "width", "height"}, "td": {"rowspan", "colspan"}, "th": {"rowspan", "colspan", "scope"},
    "ol": {"start"}, "code": {"class"}, "pre": {"class"},
}
CONTAINERS = frozenset("html body main article section div header footer aside nav".split())
SILENT = frozenset("script style noscript template".split())


def safe(url: str, image: bool = False) -> str:
    url = (url or "").strip()
    try:
        scheme = urlsplit(url).scheme.lower()
    except ValueError:
        return ""
    return url if scheme in (IMAGE_SCHEMES if image else LINK_SCHEMES) else ""


def clean(html: str) -> tuple[Element, int]:
    """The body without noise, hidden elements, comments, unsafe links and attributes that nothing reads; the number of
    comments. Of an image with an unsafe source its alternative text is left."""
    root, comments = parse(html)

    def visit(at: Element) -> None:
        kept: list = []
        for n in at.nodes:
            if isinstance(n, str):
                kept.append(n)
                continue
            if n.tag in NOISE or "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true":
                continue
            n.attrs = {k: v for k, v in n.attrs.items() if k in ATTRIBUTES.get(n.tag, ())}
            if n.tag == "a" and "href" in n.attrs:
                if href := safe(n.attrs["href"]):
                    n.attrs["href"] = href
                else:
                    del n.attrs["href"]
            elif n.tag == "img":
                if not (src := safe(n.attrs.get("src", ""), image=True)):
                    kept.append(n.attrs.get("alt", "").strip())
                    continue
                n.attrs["src"] = src
            visit(n)
            kept.append(n)
        at.nodes = [n for n in kept if n != ""]

    visit(root)
    body = next((e for e in root.walk() if e.tag == "body"), root)
    return body, comments


def is_empty(body: Element) -> bool:
    return not body.text().strip() and not any(e.tag == "img" for e in body.walk())


def tidy_inline(text: str) -> str:
    return re.sub(r" *\n *", "\n", re.sub(r"[ \t\r\f\v]+", " ", text)).strip()


def blocks(parts: list[str]) -> str:
    return "\n\n".join(s for p in parts if (s := p.strip()))


class Markdown:
    """Markdown of a tree. `table` says what stands for a table: its number in the document, and the headings above it."""

    def __init__(self, table, first_table: int = 1, headings: list[str] | None = None):
        self.table, self.next_table, self.headings = table, first_table, list(headings or [])
        self.images = 0

    def block(self, n) -> str:
        if isinstance(n, str):
            return tidy_inline(n)
        tag = n.tag
        if tag in CONTAINERS or not tag:
            return blocks([self.block(x) for x in n.nodes])
        if re.fullmatch("h[1-6]", tag):
            return self.heading(n, int(tag[1]))
        if tag in ("ul", "ol"):
            return self.listing(n)
        if tag in SILENT:
            return ""
        simple = {"p": self.inside, "pre": self.code, "blockquote": self.quote, "img": self.image, "figure": self.figure, "code": self.span}
        if tag in simple:
            return simple[tag](n)
        if tag in ("br", "hr"):
            return "\n" if tag == "br" else "---"
        if tag == "table":
            number, self.next_table = self.next_table, self.next_table + 1
            return self.table(n, f"table-{number:03d}", [h for h in self.headings if h])
        return self.inside(n) or blocks([self.block(x) for x in n.nodes])

    def heading(self, n: Element, level: int) -> str:
        if not (text := self.inside(n)):
            return ""
        above = self.headings[: level - 1]
        self.headings = above + [""] * (level - 1 - len(above)) + [text]
        return "#" * level + " " + text

    def inside(self, n: Element) -> str:
        return tidy_inline("".join(map(self.inline, n.nodes)))

    def inline(self, n) -> str:
        if isinstance(n, str):
            return n
        tag = n.tag
        if tag == "br":
            return "\n"
        if tag in SILENT:
            return ""
        if tag in ("img", "code"):
            return self.image(n) if tag == "img" else self.span(n)
        text = self.inside(n)
        if tag == "a":
            href = safe(n.attrs.get("href", ""))
            return f"[{text}]({href})" if href else text
        mark = {"strong": "**", "b": "**", "em": "*", "i": "*", "s": "~~", "strike": "~~", "del": "~~"}.get(tag, "")
        return mark + text + mark if text else ""

    def span(self, n: Element) -> str:
        text = tidy_inline(n.text(" "))
        return f"`{text}`" if text else ""

    def image(self, n: Element) -> str:
        self.images += 1
        alt = " ".join(n.attrs.get("alt", "").split())
        if not (src := safe(n.attrs.get("src", ""), image=True)):
            return alt
        return "![" + alt.replace("[", "\\[").replace("]", "\\]") + f"]({src})"

    def figure(self, n: Element) -> str:
        captions = [c for c in n.elements() if c.tag == "figcaption"]
        body = blocks([self.block(x) for x in n.nodes if not (isinstance(x, Element) and x.tag == "figcaption")])
        said = self.inside(captions[0]) if captions else ""
        return blocks([body, LABELS["caption"] + said if said else ""])

    def listing(self, n: Element) -> str:
        out = []
        for k, item in enumerate((e for e in n.elements() if e.tag == "li"), 1):
            first, *rest = blocks([self.block(x) for x in item.nodes]).splitlines() or [""]
            out.append(f"{k}. {first.strip()}" if n.tag == "ol" else f"- {first.strip()}")
            out += [f"  {line}".rstrip() for line in rest]
        return "\n".join(out)

    def quote(self, n: Element) -> str:
        """Blocks behind a bar; code stands between them without one."""
        out: list[str] = []
        said: list[str] = []
        for x in [*n.nodes, None]:
            if x is not None and not (isinstance(x, Element) and x.tag == "pre"):
                said.append(self.block(x))
                continue
            if text := blocks(said):
                out.append("\n".join(f"> {line}" if line else ">" for line in text.splitlines()))
            said = []
            if x is not None:
                out.append(self.code(x))
        return blocks(out)

    def code(self, n: Element) -> str:
        inner = next((e for e in n.walk() if e.tag == "code"), None)
        names = inner.attrs.get("class", "").split() if inner else []
        language = next((c[len("language-") :] for c in names if c.startswith("language-")), "")
        return f"```{escape(language)}\n{(inner or n).text().rstrip()}\n```"


def _place(table: Element, table_id: str, headings: list[str]) -> str:
    return f"\x00{table_id}\x00"


_OUT = pa.struct(
    [("markdown", pa.string()), ("comments", pa.int32()), ("images", pa.int32()), ("tables", pa.int32()), ("error", pa.string()),
     ("headings", pa.list_(pa.struct([("table_id", pa.string()), ("path", pa.list_(pa.string()))])))]
)
_DDL = "struct<markdown:string,comments:int,images:int,tables:int,error:string,headings:array<struct<table_id:string,path:array<string>>>>"


def to_markdown(html: str | None) -> dict:
    """Markdown of one page, with a mark where each table stands, and the headings above it."""
    if not (html or "").strip():
        return {"error": "WORD_PARSE_FAILED"}
    body, comments = clean(html)
    if is_empty(body):
        return {"error": "WORD_PARSE_FAILED", "comments": comments}
    above: list[dict] = []

    def place(table: Element, table_id: str, headings: list[str]) -> str:
        above.append({"table_id": table_id, "path": headings})
        return _place(table, table_id, headings)

    out = Markdown(place)
    text = out.block(Element("body") if body is None else body) if body.tag else blocks([out.block(n) for n in body.nodes])
    return {"markdown": text, "comments": comments, "images": out.images, "tables": out.next_table - 1, "error": None, "headings": above}


@arrow(_DDL)
def _rendered(pages: pa.Array) -> pa.Array:
    return pa.array([to_markdown(h) for h in pages.to_pylist()], type=_OUT)


@arrow("string")
def clean_html(pages: pa.Array) -> pa.Array:
    """The cleaned page as HTML; null if nothing is left of it."""
    return pa.array([None if is_empty(b := clean(h)[0]) else "".join(n if isinstance(n, str) else n.html() for n in b.nodes).strip() if h else None for h in (x or "" for x in pages.to_pylist())], type=pa.string())


def documents(pages: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """doc, markdown, comments, images, tables, error of every page; tables are rendered as DataFrame operations and put
    where they stand. A page without content has an error and no Markdown."""
    from .tables import cells_of, render

    ship_code(pages.sparkSession)
    drawn = pages.select(F.col(doc).cast("long").alias("doc_id"), clean_html(F.col(html)).alias("html"), _rendered(F.col(html)).alias("r"))
    rendered = render(cells_of(drawn.where("r.tables > 0"), html="html"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("table_id", "markdown"))), lambda s: s["markdown"]), "\n\n")
    outer = rendered.withColumn("top", F.substring("table_id", 1, 9)).groupBy("doc_id", "top").agg(whole.alias("block"))
    placed = outer.groupBy("doc_id").agg(F.collect_list(F.struct(F.concat(F.lit("\x00"), "top", F.lit("\x00")).alias("src"), F.col("block").alias("url"))).alias("tables"))
    text = F.aggregate(F.coalesce("t.tables", F.array().cast("array<struct<src:string,url:string>>")), F.col("r.markdown"), lambda acc, x: F.replace(acc, x["src"], x["url"]))
    return drawn.alias("d").join(placed.alias("t"), F.col("d.doc_id") == F.col("t.doc_id"), "left").select(
        F.col("d.doc_id").alias(doc), text.alias("markdown"), "r.comments", "r.images", "r.tables", "r.error"
    )


_PAGE = pa.list_(_OUT)


@arrow(f"array<{_DDL}>")
def _rendered_pages(documents: pa.Array) -> pa.Array:
    out = []
    for pages in documents.to_pylist():
        headings: list[str] = []
        tables, done = 0, []
        for html in pages or []:
            above: list[dict] = []

            def place(table: Element, table_id: str, path: list[str], above=above) -> str:
                above.append({"table_id": table_id, "path": path})
                return _place(table, table_id, path)

            body, comments = clean(html or "")
            drawn = Markdown(place, tables + 1, headings)
            text = drawn.block(body) if body.tag else blocks([drawn.block(n) for n in body.nodes])
            done.append({"markdown": text, "comments": comments, "images": drawn.images, "tables": drawn.next_table - 1 - tables, "error": None, "headings": above})
            headings, tables = drawn.headings, drawn.next_table - 1
        out.append(done)
    return pa.array(out, type=_PAGE)


def paged_documents(pages: DataFrame, doc: str = "doc_id", page: str = "page", html: str = "html") -> DataFrame:
    """doc, page, markdown, tables, headings of the pages of a document: headings and table numbers go on from page to
    page. A document's pages meet in one row; documents have a bounded number of pages."""
    ship_code(pages.sparkSession)
    ordered = F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(html).alias("h"))))
    joined = pages.groupBy(doc).agg(ordered.alias("all")).select(doc, "all", _rendered_pages(F.transform("all", lambda s: s["h"])).alias("out"))
    each = joined.select(doc, F.explode(F.arrays_zip(F.transform("all", lambda s: s["p"]).alias("p"), "out")).alias("e"))
    return each.select(doc, F.col("e.p").alias("page"), F.col("e.out.markdown").alias("markdown"), F.col("e.out.tables").alias("tables"), F.col("e.out.headings").alias("headings"))


def with_page_markers(pages: DataFrame, doc: str = "doc_id", name: str = "WORD_PAGE") -> DataFrame:
    """doc, markdown: the pages of paged_documents() behind their markers."""
    marked = F.concat(F.lit(f"<!-- {name}:"), F.col("page").cast("string"), F.lit(" -->\n\n"), F.coalesce("markdown", F.lit("")))
    return pages.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("t")))), lambda s: s["t"]), "\n\n").alias("markdown"))
