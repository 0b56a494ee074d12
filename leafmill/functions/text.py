"""Text functions as column expressions; what no built-in can say is an Arrow function."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow

#: Unicode white space, for patterns.
WS = r"(?U)\s"


def collapse_space(x: Column) -> Column:
    """Every run of white space becomes one space; none at the ends."""
    return F.regexp_replace(F.regexp_replace(x, r"(?U)\s+", " "), r"^ | $", "")


def strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_inline(x: Column) -> Column:
    """Runs of blanks become one space, line ends stay and lose the blanks around them."""
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t\r\f\x0B]+", " "), r" *\n *", "\n"))


def html_escape(x: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(raw), F.lit(escaped))
    return x


def markdown_to_text(x: Column) -> Column:
    x = F.regexp_replace(x, r"(?s)<!--.*?-->", "")
    x = F.regexp_replace(x, r"!\[([^\]]*)\]\([^)]*\)", "$1")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    x = F.regexp_replace(x, r"[#*_`>|~-]", "")
    return strip(F.regexp_replace(x, r"\n{3,}", "\n\n"))


def fill_text(text: Column, markdown: Column) -> Column:
    """The text output: as given, else the text or Markdown without marks."""
    source = F.coalesce(F.nullif(text, F.lit("")), F.nullif(markdown, F.lit("")), F.lit(""))
    return F.coalesce(text, strip(F.regexp_replace(source, r"[#*_`>-]", "")))


def as_html_paragraph(x: Column) -> Column:
    return F.concat(F.lit("<p>"), F.replace(html_escape(x), F.lit("\n"), F.lit("<br>")), F.lit("</p>"))


def join_blocks(parts: Column) -> Column:
    return F.array_join(F.filter(F.transform(parts, strip), lambda p: p != ""), "\n\n")


def split_table_row(line: Column) -> Column:
    """The cells of a GFM table row; outer pipes go, escaped ones stay."""
    inner = F.regexp_replace(strip(line), r"^\|+|\|+$", "")
    return F.transform(F.split(inner, r"(?<!\\)\|"), lambda c: collapse_space(F.replace(c, F.lit("\\|"), F.lit("|"))))


def is_table_separator(line: Column) -> Column:
    return line.rlike(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$")


def escape_table_cell(x: Column) -> Column:
    return F.replace(collapse_space(x), F.lit("|"), F.lit("\\|"))


def escape_field(x: Column) -> Column:
    return F.replace(x, F.lit(" | "), F.lit(" \\| "))


def image_reference(alt: Column, src: Column) -> Column:
    """Markdown of an image; of an unsafe source only the alternative text is left."""
    escaped = F.replace(F.replace(collapse_space(alt), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))
    safe = safe_url(src, image=True)
    return F.when(safe == "", collapse_space(alt)).otherwise(F.concat(F.lit("!["), escaped, F.lit("]("), safe, F.lit(")")))


#: Schemes of links and images.
LINK_SCHEMES, IMAGE_SCHEMES = ("", "http", "https", "mailto", "tel"), ("", "http", "https")


def safe_url(url: Column, image: bool = False) -> Column:
    """The trimmed url, or nothing if its scheme isn't allowed. Tabs and line ends inside don't hide a scheme."""
    trimmed = strip(F.coalesce(url, F.lit("")))
    scheme = F.lower(F.regexp_extract(F.regexp_replace(trimmed, r"[\t\r\n]", ""), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when(scheme.isin(*(IMAGE_SCHEMES if image else LINK_SCHEMES)), trimmed).otherwise("")


def safe_id(x: Column, most: int = 128) -> Column:
    return F.substring(F.regexp_replace(x, r"[^A-Za-z0-9._-]", "_"), 1, most)


def encode_key(key: Column) -> Column:
    """Url-safe base64 without padding."""
    return F.regexp_replace(F.translate(F.base64(F.encode(key, "UTF-8")), "+/\r\n", "-_"), "=+$", "")


def decode_key(token: Column) -> Column:
    """The key, or null if it is empty, absolute or climbs up."""
    padded = F.rpad(F.translate(token, "-_", "+/"), (F.ceil(F.length(token) / 4) * 4).cast("int"), F.lit("="))
    key = F.decode(F.unbase64(padded), "UTF-8")
    bad = (key == "") | key.startswith("/") | F.array_contains(F.split(key, "/"), "..")
    return F.when(~bad, key)


def percent_encode(key: Column) -> Column:
    """Percent-encoding that keeps the slash."""
    return F.replace(F.replace(F.replace(F.url_encode(key), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/")), F.lit("*"), F.lit("%2A"))


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"[^./\\](\.[^./\\]+)$", 1))


def base_name(name: Column) -> Column:
    return F.element_at(F.split(F.regexp_replace(name, "/+$", ""), "/"), -1)


def marker_attributes(x: Column) -> Column:
    """Every key="value" of a marker, as a map; of equal keys the last counts."""
    keys, values = F.regexp_extract_all(x, F.lit(r'([\w-]+)="[^"]*"')), F.regexp_extract_all(x, F.lit(r'[\w-]+="([^"]*)"'))
    last = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda e: e["k"].isNotNull())
    kept = F.aggregate(
        last, F.from_json(F.lit("{}"), "map<string,string>"),
        lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e["k"]), F.create_map(e["k"], e["v"])),
    )
    return kept


def split_fields(row: Column) -> Column:
    """Name and value of the fields of a row line; a field without a name is left out."""
    colon = F.lit("：")
    parts = F.filter(F.split(row, r" \| "), lambda f: F.instr(f, "：") > 1)
    return F.transform(
        parts,
        lambda f: F.struct(strip(F.substring_index(f, "：", 1)).alias("name"), strip(F.substr(f, F.locate("：", f) + F.length(colon))).alias("value")),
    )


def _fold(value: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKC", value).casefold() if not c.isspace())


@arrow("string")
def _folded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t if t.isascii() and t.islower() and t.isalnum() else _fold(t) for t in texts.to_pylist()], type=pa.string())


def effective_text(x: Column) -> Column:
    """The characters that count in a comparison: no images, tags, marks or white space, compatibility forms folded."""
    x = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?is)!\[[^\]]*\]\([^)]*\)|<img\b[^>]*>", "")
    x = F.regexp_replace(F.regexp_replace(x, r"<[^>]+>", ""), r"[#*_`>\[\]()|~-]", "")
    return _folded(x)
