"""Queries over documents of pages and over HTML pages, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import docx, html_doc, quality, sections
from ..ship import ship_code
from ..sources import engines
from .surrogates import damaged_docs, marked_docs, pages, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""
SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS seq, CAST(turn + 1 AS INTEGER) AS page, chr(10) || coalesce(text, '') || chr(10) AS body
FROM conversations
""")
def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(marked_docs(spark, sf_dir))


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, conv_id % 7 AS k, max(turn + 1) OVER (PARTITION BY conv_id) AS n FROM conversations),
m AS (SELECT doc_id, page, k, n, CASE WHEN k = 0 AND page = 2 THEN NULL WHEN k = 1 AND page = 2 THEN 1 ELSE page END AS marker FROM p)
SELECT doc_id, string_agg(CAST(marker AS VARCHAR), ',' ORDER BY page) AS markers,
       NOT ((k IN (0, 1) AND n >= 2) OR k = 2) AS page_provenance_valid,
       concat_ws(';', CASE WHEN k = 2 THEN 'CONTENT_BEFORE_FIRST_PAGE_MARKER' END, CASE WHEN k = 1 AND n >= 2 THEN 'DUPLICATE_PAGE_MARKER:page=1' END,
           CASE WHEN k IN (0, 1) AND n >= 2 THEN 'PAGE_MARKER_SEQUENCE_MISMATCH:expected=[' || string_agg(CAST(page AS VARCHAR), ', ' ORDER BY page)
               || '],actual=[' || string_agg(CAST(marker AS VARCHAR), ', ' ORDER BY page) || ']' END) AS warnings
FROM m GROUP BY doc_id, k, n
""")
def page_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sections.provenance(damaged_docs(spark, sf_dir), "page_count")
    return found.select("doc_id", F.array_join("page_markers", ",").alias("markers"), "page_provenance_valid", F.array_join("warnings", ";").alias("warnings"))


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, coalesce(text, '') AS text FROM conversations)
SELECT doc_id, sha256(trim(string_agg(CASE WHEN page % 2 = 0
    THEN trim('<!-- LEAF_PAGE:' || page || ' -->' || chr(10) || text || chr(10), ' ' || chr(9) || chr(10) || chr(13)) || chr(10) || chr(10) || '<!-- PAGE_FALLBACK:OCR -->'
         || chr(10) || chr(10) || 'seen ' || page || chr(10) || chr(10)
    ELSE '<!-- LEAF_PAGE:' || page || ' -->' || chr(10) || text || chr(10) END, '' ORDER BY page), ' ' || chr(9) || chr(10) || chr(13))) AS merged_sha
FROM p GROUP BY doc_id
""")
def sections_merge_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = pages(spark, sf_dir).where("page % 2 = 0").select("doc_id", "page", F.concat(F.lit("seen "), F.col("page").cast("string")).alias("text"))
    return sections.merge_fallback(marked_docs(spark, sf_dir), seen).select("doc_id", F.sha2("merged", 256).alias("merged_sha"))


_OUTPUTS = "WITH p AS (SELECT conv_id AS doc_id, turn + 1 AS page, text FROM conversations WHERE coalesce(text, '') <> '') "


@query(_OUTPUTS + "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page) AS text FROM p GROUP BY doc_id")
def pages_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.outputs_from_pages(pages(spark, sf_dir)).select("doc_id", "text")


@query(_OUTPUTS + "SELECT doc_id, string_agg('## Page ' || page || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY page) AS markdown FROM p GROUP BY doc_id")
def pages_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.outputs_from_pages(pages(spark, sf_dir)).select("doc_id", "markdown")


_ESCAPE = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


@query(_OUTPUTS + f"""SELECT doc_id, string_agg('<section data-page="' || page || '"><h2>Page ' || page || '</h2><p>' ||
    replace({_ESCAPE.format('text')}, chr(10), '<br>') || '</p></section>', '' ORDER BY page) AS html FROM p GROUP BY doc_id""")
def pages_to_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.outputs_from_pages(pages(spark, sf_dir)).select("doc_id", "html")


@query("""
SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<!--.*?-->', '', 'g'),
    '!\\[([^\\]]*)\\]\\([^)]*\\)', '\\1', 'g'), '<[^>]+>', '', 'g'), '[#*_`>|~-]', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text_sha
FROM documents
""")
def markdown_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(X.markdown_to_text(F.col("text")), 256).alias("text_sha"))


@query(f"""
SELECT doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '[#*_`>-]', '', 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text_sha,
       sha256('<p>' || replace({_ESCAPE.format('text')}, chr(10), '<br>') || '</p>') AS html_sha
FROM documents
""")
def fill_missing_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = X.fill_text(F.lit(None).cast("string"), F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(filled, 256).alias("text_sha"), F.sha2(X.as_html_paragraph(F.col("text")), 256).alias("html_sha"))


@query()
def effective_text_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return table(spark, sf_dir, "documents").select("doc_id", F.length(X.effective_text(F.col("text"))).alias("effective_len"))


@query("""
WITH p AS (SELECT conv_id AS doc_id, CAST(turn + 1 AS INTEGER) AS page FROM conversations),
r AS (SELECT doc_id, page, 'img/p' || page || '.png' AS source FROM p UNION ALL SELECT doc_id, page, 'shared image ' || (doc_id % 3) || '.png' FROM p)
SELECT doc_id, source, min(page) AS page FROM r GROUP BY doc_id, source
""")
def image_page_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page").cast("string")
    lines = F.concat(F.lit("see ![a]("), F.lit("./img/p"), page, F.lit(".png) and ![b]( <shared image "), (F.col("doc_id") % 3).cast("string"), F.lit(".png>)"))
    found = pages(spark, sf_dir).withColumn("text", lines)
    return sections.image_pages(sections.mark_pages(found, "doc_id", "page", "text"))


@query("""
WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, CASE WHEN regexp_extract(href, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) IN ('', 'http', 'https', 'mailto', 'tel') THEN href ELSE '' END AS safe_href,
       count(*) AS n FROM a GROUP BY page_id, href
""")
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'))).alias("href"))
    return links.groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n")).withColumn("safe_href", X.safe_url(F.col("href")))


@query("""
SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, CAST(sum(len(regexp_extract_all(html, '<a href="([^"]*)"', 1))) AS BIGINT) AS n_links, count(*) AS n_pages
FROM pages GROUP BY 1
""")
def link_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "pages").select(F.substring_index(F.element_at(F.split("url", "://"), 2), "/", 1).alias("host"), F.size(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'))).alias("k"))
    return per.groupBy("host").agg(F.sum("k").alias("n_links"), F.count(F.lit(1)).alias("n_pages"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '(?s)<!--.*?-->')) AS INTEGER) AS n_comments FROM pages")
def html_comment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    return table(spark, sf_dir, "pages").select("page_id", html_doc._rendered("html")["comments"].alias("n_comments"))


@query("""
SELECT page_id, sha256(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript|template|iframe|object)\\b.*?</(script|style|noscript|template|iframe|object)\\s*>', '', 'g'),
    '(?s)<!--.*?-->', '', 'g')) AS html_sha FROM pages
""")
def html_noise_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = F.regexp_replace("html", r"(?is)<(script|style|noscript|template|iframe|object)\b.*?</\1\s*>", "")
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(F.regexp_replace(stripped, r"(?s)<!--.*?-->", ""), 256).alias("html_sha"))


@query()
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_doc.documents(table(spark, sf_dir, "pages"), "page_id", "html")


@query("""
SELECT page_id, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) = '' AS untitled, CAST(len(regexp_extract_all(html, '<h1>')) AS INTEGER) AS n_headings FROM pages
""")
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    lines = F.filter(F.split(html_doc._rendered("html")["markdown"], "\n"), lambda x: x.rlike("^# ."))
    return table(spark, sf_dir, "pages").select("page_id", lines.alias("lines")).select("page_id", (F.size("lines") == 0).alias("untitled"), F.size("lines").alias("n_headings"))


_GRID = """
WITH g AS (SELECT i AS id, (i % 3) * 6 AS source_len, [0, 7, 25][i // 3 % 3 + 1] AS output_len, [0, 19, 20][i // 9 % 3 + 1] AS ocr_len, i // 27 % 2 AS image_count,
    [0.59, 0.6][i // 54 % 2 + 1] AS coverage, [0.96, 0.97][i // 108 % 2 + 1] AS retention, [0.969999, 1.0][i // 216 % 2 + 1] AS precision_, i // 432 % 2 = 1 AS ocr_present,
    [NULL, 0.79, 0.8][i // 864 % 3 + 1] AS conf, i // 2592 % 2 = 1 AS missing FROM range(5184) r(i)),
h AS (SELECT *, image_count > 0 AND coverage >= 0.6 AND source_len <= 8 AS image_only, source_len > 0 AND NOT (retention >= 0.97 AND precision_ >= 0.97) AS low FROM g),
k AS (SELECT *, (image_only AND ocr_len < 20) OR low OR (image_count > 0 AND output_len < 20 AND ocr_len = 0) AS needs, ocr_present AND NOT coalesce(conf >= 0.8, false) AS unsure FROM h)
SELECT id, image_only AS is_image_only, low AS text_fidelity_low, needs AS ocr_required, unsure AS low_confidence,
    concat_ws(';', CASE WHEN missing THEN 'MARKDOWN_SECTION_MISSING' END, CASE WHEN low THEN 'ODL_TEXT_INSUFFICIENT' END, CASE WHEN image_only THEN 'IMAGE_ONLY' END,
        CASE WHEN needs THEN 'OCR_REQUIRED' END, CASE WHEN unsure THEN 'OCR_LOW_CONFIDENCE' END) AS warnings FROM k
"""


@query(_GRID)
def quality_gate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda values, step: F.get(F.array(*[F.lit(v) for v in values]), (F.floor(F.col("id") / step) % len(values)).cast("int"))
    grid = spark.range(5184).select(
        "id", ((F.col("id") % 3) * 6).alias("source_len"), at([0, 7, 25], 3).alias("output_len"), at([0, 19, 20], 9).alias("ocr_len"), at([0, 1], 27).alias("image_count"),
        at([0.59, 0.6], 54).alias("coverage"), at([0.96, 0.97], 108).alias("retention"), at([0.969999, 1.0], 216).alias("precision"), at([False, True], 432).alias("ocr_present"),
        at([None, 0.79, 0.8], 864).cast("double").alias("ocr_confidence"), at([False, True], 2592).alias("section_missing"),
    )
    return quality.page_gate(grid).select("id", "is_image_only", "text_fidelity_low", "ocr_required", "low_confidence", F.array_join("warnings", ";").alias("warnings"))


@query()
def quality_gate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the page pipeline: pages of even documents lose their second half before they are marked, and the
    stub reader has the whole texts of page 1."""
    all_pages = pages(spark, sf_dir)
    source = all_pages.select("doc_id", "page", F.col("text").alias("source_text"), F.lit(0).alias("image_count"), F.lit(0.0).alias("coverage"))
    cut = all_pages.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.expr("substring(text, 1, cast(length(text) / 2 as int))")).otherwise(F.col("text")))
    docs = sections.mark_pages(cut, "doc_id", "page", "text").join(all_pages.groupBy("doc_id").agg(F.max("page").alias("page_count")), "doc_id")
    reader = engines.StubReader(all_pages.where("page = 1").select("doc_id", "page", "text", F.lit(0.9).alias("confidence")))
    ship_code(spark)
    _, status = engines.parse_pages(source, docs, reader)
    return status.select("doc_id", "status", F.array_join("ocr_required_pages", ",").alias("ocr_required_pages"), "ocr_page_count")


@query("""
WITH b AS (SELECT vec_id, [round(abs(CAST(x AS DOUBLE)), 6) FOR x IN embedding] AS c FROM embeddings)
SELECT vec_id, len(c) AS n_blocks, round(CAST(list_sum([CAST(x AS DECIMAL(18, 6)) FOR x IN c]) AS DOUBLE) / len(c), 6) AS confidence FROM b
""")
def ocr_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("scores"))
    point = lambda i: F.array(F.array(i.cast("double"), F.lit(0.0)), F.array(i + 1.0, F.lit(1.0)))
    blocks = quality.ocr_blocks(F.transform("scores", lambda x, i: i.cast("string")), F.col("scores"), F.transform("scores", lambda x, i: point(i)))
    found = rows.select("vec_id", blocks.alias("blocks"))
    return found.select("vec_id", F.size("blocks").cast("long").alias("n_blocks"), quality.ocr_page(F.col("blocks"))[1].alias("confidence"))


@query("""
SELECT page_id, sha256(replace(replace(html, '/the', 'https://cdn.example/a/1'), 'https://cdn.example/a/1', 'https://cdn.example/b/2')) AS html_sha FROM pages
""")
def replace_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(a).alias("src"), F.lit(b).alias("url")) for a, b in (("/the", "https://cdn.example/a/1"), ("https://cdn.example/a/1", "https://cdn.example/b/2"))])
    return table(spark, sf_dir, "pages").select("page_id", F.sha2(sections.replace_assets(F.col("html"), pairs), 256).alias("html_sha"))


_M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
_R = "<m:r><m:t>{}</m:t></m:r>"


def _of(tag: str, *inside: str, **properties: str) -> str:
    """A formula element; a text stands for a run."""
    held = "".join(x if x.startswith("<") else _R.format(x) for x in inside)
    said = "".join(f'<m:{k} m:val="{v}"/>' for k, v in properties.items())
    return f"<m:{tag}>" + (f"<m:{tag}Pr>{said}</m:{tag}Pr>" if properties else "") + held + f"</m:{tag}>"


#: A formula of each handler, and each of its forms.
FORMULAS = {
    "run": "𝑥≤𝛼_&amp;", "accent": _of("acc", _of("e", "𝑥"), chr="⃗"), "accent plain": _of("acc", _of("e", "𝑥")), "accent below": _of("acc", _of("e", "y"), chr="̰"),
    "bar": _of("bar", _of("e", "x"), pos="top"), "bar below": _of("bar", _of("e", "x"), pos="bot"), "bar plain": _of("bar", _of("e", "x")),
    "delimiter": _of("d", _of("e", "x"), begChr="[", endChr=""), "delimiter plain": _of("d", _of("e", "x")),
    "sub": _of("sSub", _of("e", "x"), _of("sub", "i")), "sup": _of("sSup", _of("e", "x"), _of("sup", "2")), "both": _of("sSubSup", _of("e", "x"), _of("sub", "i"), _of("sup", "2")),
    "fraction": _of("f", _of("num", "a"), _of("den", "b")), "fraction skewed": _of("f", _of("num", "a"), _of("den", "b"), type="skw"),
    "fraction in line": _of("f", _of("num", "a"), _of("den", "b"), type="lin"), "fraction without bar": _of("f", _of("num", "a"), _of("den", "b"), type="noBar"),
    "function": _of("func", _of("fName", "sin"), _of("e", "x")), "function unknown": _of("func", _of("fName", "log"), _of("e", "x")),
    "group": _of("groupChr", _of("e", "x"), chr="⏞"), "group plain": _of("groupChr", _of("e", "x")),
    "root": _of("rad", _of("deg", "3"), _of("e", "y")), "square root": _of("rad", _of("deg"), _of("e", "y")),
    "equations": _of("eqArr", _of("e", "a"), _of("e", "b")), "limit": _of("limLow", _of("e", "lim"), _of("lim", "n→∞")), "limit unknown": _of("limLow", _of("e", "sup"), _of("lim", "n")),
    "above": _of("limUpp", _of("e", "x"), _of("lim", "y")), "matrix": _of("m", _of("mr", _of("e", "a"), _of("e", "b")), _of("mr", _of("e", "c"), _of("e", "d"))),
    "sum": _of("nary", _of("sub", "i"), _of("sup", "n"), _of("e", "i"), chr="∑"), "integral": _of("nary", _of("sub", "0"), _of("sup", "1"), _of("e", "x")),
    "prescript": _of("sPre", _of("sub", "1"), _of("sup", "2"), _of("e", "x")), "nested": _of("f", _of("num", _of("rad", _of("deg"), _of("e", "𝜋"))), _of("den", _of("sSup", _of("e", "𝑟"), _of("sup", "2")))),
}


@query(r"""
SELECT * FROM (VALUES ('run', 'x\leq \alpha \_\&'), ('accent', '\vec{x}'), ('accent plain', '\hat{x}'), ('accent below', '\wideutilde{y}'),
    ('bar', '\overline{x}'), ('bar below', '\underline{x}'), ('bar plain', '\overline{x}'), ('delimiter', '\left[x\right.'), ('delimiter plain', '\left(x\right)'),
    ('sub', 'x_{i}'), ('sup', 'x^{2}'), ('both', 'x_{i}^{2}'), ('fraction', '\frac{a}{b}'), ('fraction skewed', '^{a}/_{b}'), ('fraction in line', '{a}/{b}'),
    ('fraction without bar', '\genfrac{}{}{0pt}{}{a}{b}'), ('function', '\sin(x)'), ('function unknown', NULL), ('group', '\overbrace{x}'), ('group plain', '\underbrace{x}'),
    ('root', '\sqrt[3]{y}'), ('square root', '\sqrt{y}'), ('equations', '\begin{array}{c}a\\b\end{array}'), ('limit', '\lim_{n\to \infty }'), ('limit unknown', NULL),
    ('above', '\overset{y}{x}'), ('matrix', '\begin{matrix}a&b\\c&d\end{matrix}'), ('sum', '\sum_{i}^{n}i'), ('integral', '\int_{0}^{1}x'), ('prescript', ''),
    ('nested', '\frac{\sqrt{\pi }}{r^{2}}')) t(name, latex)
""")
def omml_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_code(spark)
    rows = spark.createDataFrame([(k, f"<m:oMath {_M}>{v if v.startswith('<') else _R.format(v)}</m:oMath>") for k, v in FORMULAS.items()], "name string, xml string")
    return rows.select("name", docx.omml_to_latex("xml")["latex"].alias("latex"))


@query("""
WITH l AS (SELECT conv_id AS doc_id, turn + 1 AS page, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')) AS words FROM conversations)
SELECT doc_id, CAST(page AS INTEGER) AS page, CAST(words AS INTEGER) AS n_words FROM l
""")
def docx_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as word files of one page a turn, and read again."""
    ship_code(spark)
    files = marked_pages_as_docx(pages(spark, sf_dir))
    text = F.regexp_replace("html", "<[^>]+>", " ")
    return docx.pages_of(files).select("doc_id", "page", F.size(F.regexp_extract_all(text, F.lit(r"([^\s]+)"))).alias("n_words"))


def marked_pages_as_docx(rows: DataFrame) -> DataFrame:
    """doc_id, content: a word file for each document, a page break between pages."""
    import pyarrow as pa

    def write(texts: pa.Array) -> pa.Array:
        import io
        import zipfile
        from html import escape

        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        out = []
        for parts in texts.to_pylist():
            page = '<w:p><w:r><w:br w:type="page"/></w:r></w:p>'
            body = page.join("".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in (p or "").split("\n")) for p in parts)
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
                z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
            out.append(data.getvalue())
        return pa.array(out, type=pa.binary())

    write.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda s: s["text"])
    return rows.groupBy("doc_id").agg(ordered.alias("parts")).select("doc_id", F.arrow_udf(write, "binary")("parts").alias("content"))
