"""Word archives: rules of the container, formulas as LaTeX, and pages of blocks."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from html import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import WORD_MAIN_TYPE, ZIP_MEMBER_BYTES, ZIP_MEMBERS, ZIP_RATIO, ZIP_REQUIRED, ZIP_TOTAL_BYTES
from ..functions.arrow import arrow
from ..ship import ship_code

MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
BREAK = "\x0c"


def zip_rules(members: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, error: the first rule that an archive's members (doc, seq, name, flag_bits, file_size, compress_size) break,
    or null; rules of one member go member by member."""
    name = F.replace("name", F.lit("\\"), F.lit("/"))
    m = members.select(doc, "seq", name.alias("name"), "flag_bits", "file_size", "compress_size")
    unsafe = (F.col("name") == "") | F.col("name").startswith("/") | (F.substring("name", 2, 1) == ":") | F.array_contains(F.split("name", "/"), "..")
    per = m.groupBy(doc).agg(
        F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("total"), F.collect_set("name").alias("names"),
        F.sort_array(F.collect_list(F.struct("seq", "name", unsafe.alias("unsafe"), (F.col("flag_bits").bitwiseAND(1) == 1).alias("locked"),
            (F.col("file_size") > ZIP_MEMBER_BYTES).alias("large"),
            ((F.col("file_size") > 0) & ((F.col("compress_size") == 0) | (F.col("file_size") / F.nullif("compress_size", F.lit(0)) > ZIP_RATIO))).alias("dense"),
            "file_size"))).alias("all"),
    )
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(None).cast("string").alias("error"))

    def check(acc, x):
        total = acc["total"] + x["file_size"]
        earlier = F.filter("all", lambda o: (o["seq"] < x["seq"]) & (o["name"] == x["name"]))
        error = (
            F.when(acc["error"].isNotNull(), acc["error"]).when(x["unsafe"], "unsafe member path").when(F.size(earlier) > 0, "duplicate members")
            .when(x["locked"], "encrypted").when(x["large"], "member exceeds the limit").when(total > ZIP_TOTAL_BYTES, "exceeds the uncompressed limit")
            .when(x["dense"], "suspicious compression ratio")
        )
        return F.struct(total.alias("total"), error.alias("error"))

    found = F.aggregate("all", start, check)["error"]
    missing = F.size(F.array_except(F.array(*[F.lit(x) for x in ZIP_REQUIRED]), "names")) > 0
    return per.select(doc, F.when(F.col("n") > ZIP_MEMBERS, "too many members").otherwise(F.coalesce(found, F.when(missing, "not a word document"))).alias("error"))


def zip_members(files: DataFrame, doc: str = "doc_id", content: str = "content") -> DataFrame:
    """doc, seq, name, flag_bits, file_size, compress_size, is_word of every member; a damaged archive has one row without a name."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        infos = z.infolist()[: ZIP_MEMBERS + 1]
                        types = next((i for i in infos if i.filename == ZIP_REQUIRED[0] and i.file_size <= ZIP_MEMBER_BYTES), None)
                        word = types is not None and any(
                            e.get("PartName") == "/word/document.xml" and e.get("ContentType") == WORD_MAIN_TYPE for e in ET.fromstring(z.read(types)).iter()
                        )
                        rows += [(doc_id, n, i.filename, i.flag_bits, i.file_size, i.compress_size, word) for n, i in enumerate(infos)]
                except (zipfile.BadZipFile, zipfile.LargeZipFile, ET.ParseError, OSError, RuntimeError, NotImplementedError):
                    rows.append((doc_id, 0, None, 0, 0, 0, False))
            names = [doc, "seq", "name", "flag_bits", "file_size", "compress_size", "is_word"]
            types_ = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types_, strict=True)], names=names)

    ship_code(files.sparkSession)
    kind = files.schema[doc].dataType.simpleString()
    return files.select(doc, content).mapInArrow(work, f"{doc} {kind}, seq int, name string, flag_bits int, file_size long, compress_size long, is_word boolean")


class FormulaError(ValueError):
    """A formula that has no LaTeX form here."""


# The output format's LaTeX names, each list whole and in the order of its characters.

#: Accents above, accents below, groups above, groups below.
ACCENTS = {
    "\u0300": "grave", "\u0301": "acute", "\u0302": "hat", "\u0303": "tilde", "\u0304": "bar", "\u0305": "overbar", "\u0306": "breve", "\u0307": "dot",
    "\u0308": "ddot", "\u0309": "ovhook", "\u030a": "ocirc", "\u030c": "check", "\u0310": "candra", "\u0312": "oturnedcomma", "\u0315": "ocommatopright",
    "\u031a": "droang", "\u0338": "not", "\u20d0": "leftharpoonaccent", "\u20d1": "rightharpoonaccent", "\u20d2": "vertoverlay", "\u20d6": "overleftarrow",
    "\u20d7": "vec", "\u20db": "dddot", "\u20dc": "ddddot", "\u20e1": "overleftrightarrow", "\u20e7": "annuity", "\u20e9": "widebridgeabove", "\u20f0": "asteraccent",
    "\u0330": "wideutilde", "\u0331": "underbar", "\u20e8": "threeunderdot", "\u20ec": "underrightharpoondown", "\u20ed": "underleftharpoondown",
    "\u20ee": "underledtarrow", "\u20ef": "underrightarrow",
    "\u23b4": "overbracket", "\u23dc": "overparen", "\u23de": "overbrace",
    "\u23b5": "underbracket", "\u23dd": "underparen", "\u23df": "underbrace",
}
OPERATORS = {
    "⅀": "\\Bbbsum", "∏": "\\prod", "∐": "\\coprod", "∑": "\\sum", "∫": "\\int", "⋀": "\\bigwedge", "⋁": "\\bigvee",
    "⋂": "\\bigcap", "⋃": "\\bigcup", "⨀": "\\bigodot", "⨁": "\\bigoplus", "⨂": "\\bigotimes",
}
FUNCTIONS = "sin cos tan arcsin arccos arctan arccot sinh cosh tanh coth sec csc".split()
LIMITS = ("lim", "max", "min")
#: From U+1D6FC: Greek letters in italics, and their variants.
GREEK = (
    "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho varsigma sigma tau upsilon phi chi psi omega "
    "partial varepsilon vartheta varkappa varphi varrho varpi"
).split()
SIGNS = {
    "←": "leftarrow", "↑": "uparrow", "→": "rightarrow", "↓": "downarrow", "↔": "leftrightarrow", "↕": "updownarrow", "↖": "nwarrow", "↗": "nearrow",
    "↘": "searrow", "↙": "swarrow", "⋮": "vdots", "⋯": "cdots", "⋰": "adots", "⋱": "ddots", "≠": "ne", "≤": "leq", "≥": "geq", "≦": "leqq", "≧": "geqq",
    "≨": "lneqq", "≩": "gneqq", "≪": "ll", "≫": "gg", "∈": "in", "∉": "notin", "∋": "ni", "∌": "nni", "∞": "infty", "±": "pm", "∓": "mp",
}

#: What a character of a run is in LaTeX, if not itself. Letters in italics are plain ones; an italic h has no place there.
SYMBOLS = {chr(0x1D6FC + n): f"\\{name} " for n, name in enumerate(GREEK)} | {c: f"\\{name} " for c, name in SIGNS.items()}
SYMBOLS |= {chr(0x1D434 + n): chr(65 + n) for n in range(26)} | {chr(0x1D44E + n): chr(97 + n) for n in range(26) if n != 7}


def escape_latex(text: str) -> str:
    return re.sub(r"(?<!\\)([{}_^#&$%~])", r"\\\1", text.replace("\\\\", "\\"))


def latex(e: ET.Element) -> str:
    """LaTeX of a formula element and what is in it; unknown elements and pre-scripts say nothing."""
    kind = e.tag.removeprefix(MATH)
    parts = [(c.tag.removeprefix(MATH), c) for c in e if c.tag.startswith(MATH)]
    first = {k: c for k, c in reversed(parts)}
    properties = next((c for k, c in parts if k.endswith("Pr")), None)

    def prop(name: str) -> str | None:
        found = properties.find(MATH + name) if properties is not None else None
        return None if found is None else found.get(MATH + "val", "")

    def of(name: str) -> str:
        return "".join(latex(c) for k, c in parts if k == name)

    def every(*names: str) -> str:
        return "".join(latex(c) for k, c in parts if k in names) if names else "".join(latex(c) for k, c in parts if not k.endswith("Pr"))

    if kind == "r":
        return escape_latex("".join(SYMBOLS.get(c, c) for t in e.findall(MATH + "t") for c in t.text or "")) if not parts or "t" in first else ""
    if kind in ("sub", "sup"):
        return ("_" if kind == "sub" else "^") + "{" + every() + "}"
    if kind in ("acc", "groupChr"):
        char = prop("chr")
        name = ACCENTS.get(char, "hat" if kind == "acc" else "underbrace")
        return f"\\{name}{{{of('e')}}}"
    if kind == "bar":
        return ("\\underline" if prop("pos") == "bot" else "\\overline") + f"{{{of('e')}}}"
    if kind == "d":
        left, right = prop("begChr"), prop("endChr")
        side = lambda given, default: default if given is None else escape_latex(SYMBOLS.get(given, given)) or "."
        inner = [latex(c) for k, c in parts if k == "e"]
        return f"\\left{side(left, '(')}{'|'.join(inner)}\\right{side(right, ')')}"
    if kind == "f":
        num, den = of("num"), of("den")
        forms = {"skw": f"^{{{num}}}/_{{{den}}}", "lin": f"{{{num}}}/{{{den}}}", "noBar": f"\\genfrac{{}}{{}}{{0pt}}{{}}{{{num}}}{{{den}}}"}
        return forms.get(prop("type") or "", f"\\frac{{{num}}}{{{den}}}")
    if kind == "func":
        name = of("fName")
        return name.replace("{fe}", of("e")) if "{fe}" in name else name + of("e")
    if kind == "fName":
        said = []
        for k, c in parts:
            text = latex(c)
            if k == "r" and text not in FUNCTIONS:
                raise FormulaError(f"function {text}")
            said.append(f"\\{text}({{fe}})" if k == "r" else text)
        return "".join(said)
    if kind == "rad":
        degree = of("deg")
        return f"\\sqrt[{degree}]{{{of('e')}}}" if degree else f"\\sqrt{{{of('e')}}}"
    if kind == "eqArr":
        return "\\begin{array}{c}" + "\\\\".join(latex(c) for k, c in parts if k == "e") + "\\end{array}"
    if kind == "limLow":
        base = of("e")
        if base not in LIMITS:
            raise FormulaError(f"limit of {base}")
        return f"\\{base}_{{{of('lim')}}}"
    if kind == "limUpp":
        return f"\\overset{{{of('lim')}}}{{{of('e')}}}"
    if kind == "lim":
        return every().replace("\\rightarrow", "\\to")
    if kind == "m":
        return "\\begin{matrix}" + "\\\\".join(latex(c) for k, c in parts if k == "mr") + "\\end{matrix}"
    if kind == "mr":
        return "&".join(latex(c) for k, c in parts if k == "e")
    if kind == "nary":
        char = prop("chr")
        return ("\\int" if char is None else OPERATORS.get(char, char)) + every()
    if kind in ("sPre", "t") or kind.endswith("Pr"):
        return ""
    return every()


def formula(xml: str) -> str:
    root = ET.fromstring(xml)
    return "".join(latex(c) for c in root) if root.tag in (MATH + "oMathPara",) else latex(root)


@arrow("struct<latex:string,error:string>")
def omml_to_latex(xml: pa.Array) -> pa.Array:
    """LaTeX of a formula's XML, or why there is none: a formula fails alone."""
    out = []
    for x in xml.to_pylist():
        try:
            out.append({"latex": None if x is None else formula(x), "error": None})
        except (FormulaError, ET.ParseError) as e:
            out.append({"latex": None, "error": str(e)})
    return pa.array(out, type=pa.struct([("latex", pa.string()), ("error", pa.string())]))


def _run(run: ET.Element) -> str:
    said = []
    for n in run:
        if n.tag == WORD + "t":
            said.append(escape(n.text or "", quote=False))
        elif n.tag == WORD + "tab":
            said.append(" ")
        elif n.tag == WORD + "lastRenderedPageBreak" or (n.tag == WORD + "br" and n.get(WORD + "type") == "page"):
            said.append(BREAK)
        elif n.tag == WORD + "br":
            said.append("<br/>")
    text = "".join(said)
    style = run.find(WORD + "rPr")
    if style is not None and text.strip(BREAK + " "):
        for tag, mark in (("b", "strong"), ("i", "em"), ("strike", "s")):
            flag = style.find(WORD + tag)
            if flag is not None and flag.get(WORD + "val", "1") not in ("0", "false"):
                text = f"<{mark}>{text}</{mark}>"
    return text


def _inline(p: ET.Element, links: dict[str, str], warnings: list[str]) -> str:
    said = []
    for n in p:
        if n.tag == WORD + "r":
            said.append(_run(n))
            for blip in n.iter(DRAWING + "blip"):
                said.append(f'<img src="{escape(links.get(blip.get(RELATION + "embed", ""), ""))}" alt=""/>')
        elif n.tag == WORD + "hyperlink":
            href = links.get(n.get(RELATION + "id", ""), "")
            said.append(f'<a href="{escape(href)}">{_inline(n, links, warnings)}</a>' if href else _inline(n, links, warnings))
        elif n.tag in (MATH + "oMath", MATH + "oMathPara"):
            try:
                around = "$" if n.tag == MATH + "oMath" else "$$"
                said.append(around + escape("".join(latex(c) for c in n) if around == "$$" else latex(n), quote=False) + around)
            except FormulaError as e:
                warnings.append(str(e))
        elif n.tag in (WORD + "ins", WORD + "smartTag", WORD + "sdt", WORD + "sdtContent"):
            said.append(_inline(n, links, warnings))
    return "".join(said)


def _table(t: ET.Element, links: dict[str, str], warnings: list[str]) -> str:
    grid: list[list[dict]] = []
    for row in t.findall(WORD + "tr"):
        at, cells = 0, []
        for cell in row.findall(WORD + "tc"):
            p = cell.find(WORD + "tcPr")
            span = p.find(WORD + "gridSpan") if p is not None else None
            merge = p.find(WORD + "vMerge") if p is not None else None
            width = int(span.get(WORD + "val", "1")) if span is not None else 1
            follows = merge is not None and merge.get(WORD + "val", "continue") != "restart"
            cells.append({"at": at, "width": width, "follows": follows, "html": body_html(cell, links, warnings), "down": 1})
            at += width
        grid.append(cells)
    for r in range(len(grid) - 1, 0, -1):
        for cell in grid[r]:
            if cell["follows"]:
                above = next((c for c in grid[r - 1] if c["at"] == cell["at"]), None)
                if above is not None:
                    above["down"] += cell["down"]
    span = lambda c: (f' rowspan="{c["down"]}"' if c["down"] > 1 else "") + (f' colspan="{c["width"]}"' if c["width"] > 1 else "")
    rows = ("".join(f"<td{span(c)}>{c['html']}</td>" for c in cells if not c["follows"]) for cells in grid)
    return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"


def body_html(body: ET.Element, links: dict[str, str], warnings: list[str]) -> str:
    """Semantic HTML of paragraphs, lists and tables. Page breaks are form feeds."""
    out: list[str] = []
    open_lists: list[str] = []

    def lists(depth: int, kind: str) -> None:
        while len(open_lists) > depth:
            out.append(f"</{open_lists.pop()}>")
        while len(open_lists) < depth:
            open_lists.append(kind)
            out.append(f"<{kind}>")

    for n in body:
        if n.tag == WORD + "p":
            p = n.find(WORD + "pPr")
            style = p.find(WORD + "pStyle") if p is not None else None
            name = style.get(WORD + "val", "") if style is not None else ""
            number = p.find(f"{WORD}numPr/{WORD}ilvl") if p is not None else None
            inner = _inline(n, links, warnings)
            item = re.fullmatch(r"List\s?(Bullet|Number)\s?([23])?", name)
            heading = re.fullmatch(r"[Hh]eading\s?([1-6])", name)
            if item or number is not None:
                depth = int(item[2] or 1) if item else int(number.get(WORD + "val", "0")) + 1
                lists(depth, "ol" if item and item[1] == "Number" else "ul")
                out.append(f"<li>{inner}</li>")
                continue
            lists(0, "ul")
            tag = f"h{heading[1]}" if heading else "p"
            if inner:
                out.append(f"<{tag}>{inner}</{tag}>")
        elif n.tag == WORD + "tbl":
            lists(0, "ul")
            out.append(_table(n, links, warnings))
    lists(0, "ul")
    return "".join(out)


def read_docx(data: bytes) -> tuple[list[str], dict[str, int], list[str]]:
    """HTML of each page, layout counts (1 at least for sections) and warnings. Empty paragraphs at page ends go."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        document = ET.fromstring(z.read("word/document.xml"))
        links = {}
        if "word/_rels/document.xml.rels" in names:
            links = {r.get("Id", ""): r.get("Target", "") for r in ET.fromstring(z.read("word/_rels/document.xml.rels"))}
    warnings: list[str] = []
    body = document.find(WORD + "body")
    html = body_html(body, links, warnings) if body is not None else ""
    pages = [re.sub(r"<(p|h[1-6]|strong|em|s)>\s*</\1>", "", x) for x in _split_pages(html)]
    explicit = sum(b.get(WORD + "type") == "page" for b in document.iter(WORD + "br"))
    layout = {"explicit": explicit, "rendered": sum(1 for _ in document.iter(WORD + "lastRenderedPageBreak")), "sections": max(1, sum(1 for _ in document.iter(WORD + "sectPr")))}
    return pages, layout, warnings


def _split_pages(html: str) -> list[str]:
    """Pages at form feeds; elements that are open at a break are closed before and opened again after it."""
    pages, stack, now = [], [], []
    for token in re.findall(rf"{BREAK}|<[^>]+>|[^<{BREAK}]+", html):
        if token == BREAK:
            pages.append("".join(now) + "".join(f"</{re.match(r'<(\w+)', t)[1]}>" for t in reversed(stack)))
            now = list(stack)
            continue
        now.append(token)
        if token.startswith("</"):
            stack.pop()
        elif token.startswith("<") and not token.endswith("/>"):
            stack.append(token)
    return [*pages, "".join(now)]


def pages_of(files: DataFrame, doc: str = "doc_id", content: str = "content") -> DataFrame:
    """doc, page, html, explicit_breaks, rendered_breaks, n_sections, warnings, error of every page of word files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pages, layout, warnings = read_docx(data or b"")
                    rows += [(doc_id, n, h, layout["explicit"], layout["rendered"], layout["sections"], warnings, None) for n, h in enumerate(pages, 1)]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, OSError, RuntimeError) as e:
                    rows.append((doc_id, 1, None, 0, 0, 1, [], f"WORD_PARSE_FAILED: {e}"))
            types = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string()), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=[doc, "page", "html", "explicit_breaks", "rendered_breaks", "n_sections", "warnings", "error"])

    ship_code(files.sparkSession)
    kind = files.schema[doc].dataType.simpleString()
    return files.select(doc, content).mapInArrow(work, f"{doc} {kind}, page int, html string, explicit_breaks int, rendered_breaks int, n_sections int, warnings array<string>, error string")


#: Image types that are taken from word files, and their bounds.
IMAGE_STARTS = {b"\x89PNG\r\n\x1a\n": "image/png", b"\xff\xd8\xff": "image/jpeg", b"GIF8": "image/gif", b"BM": "image/bmp"}
IMAGE_BYTES, IMAGE_PIXELS = 20 << 20, 40_000_000


def image_size(data: bytes) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF, BMP or JPEG."""
    if data.startswith(b"\x89PNG") and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data.startswith(b"GIF8") and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data.startswith(b"BM") and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        return width, abs(height)
    at = 2
    while data.startswith(b"\xff\xd8") and at + 9 < len(data) and data[at] == 0xFF:
        kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + length
    return None


def images_of(files: DataFrame, doc: str = "doc_id", content: str = "content") -> DataFrame:
    """doc, name, media_type, sha, size_bytes, omitted of the images in word files: one row for each content of a file,
    under the first name that has it. Unknown types and images beyond the bounds are omitted, with the reason."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen = set()
                try:
                    with zipfile.ZipFile(io.BytesIO(data or b"")) as z:
                        for info in sorted((i for i in z.infolist() if i.filename.startswith("word/media/")), key=lambda i: i.filename):
                            if info.file_size > IMAGE_BYTES:
                                rows.append((doc_id, info.filename, None, None, info.file_size, "too large"))
                                continue
                            raw = z.read(info)
                            sha = hashlib.sha256(raw).hexdigest()
                            if sha in seen:
                                continue
                            seen.add(sha)
                            media = next((m for s, m in IMAGE_STARTS.items() if raw.startswith(s)), None)
                            shape = image_size(raw) if media else None
                            reason = "unknown type" if media is None else "too many pixels" if shape is None or shape[0] * shape[1] > IMAGE_PIXELS else None
                            rows.append((doc_id, info.filename, media, sha, len(raw), reason))
                except (zipfile.BadZipFile, OSError, RuntimeError):
                    continue
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=[doc, "name", "media_type", "sha", "size_bytes", "omitted"])

    ship_code(files.sparkSession)
    kind = files.schema[doc].dataType.simpleString()
    return files.select(doc, content).mapInArrow(work, f"{doc} {kind}, name string, media_type string, sha string, size_bytes long, omitted string")
