import io
import zipfile

import pytest

from leafmill.operators import docx, html_doc
from leafmill.operators.html_doc import to_markdown
from leafmill.ship import ship_code


@pytest.mark.parametrize(
    ("html", "markdown"),
    [
        ("<h1>T</h1><p>a <b>b</b> <i>c</i> <del>d</del> <code>e</code></p>", "# T\n\na **b** *c* ~~d~~ `e`"),
        ('<p><a href="javascript:x">bad</a> <a href="/u">good</a></p>', "bad [good](/u)"),
        ("<ul><li>a<li>b<ol><li>c</li></ol></ul>", "- a\n- b\n\n  1. c"),
        ('<blockquote>q<pre><code class="language-py">x = 1\n</code></pre>r</blockquote>', "> q\n\n```py\nx = 1\n```\n\n> r"),
        ('<figure><img src="i.png" alt="x"><figcaption>cap</figcaption></figure>', "![x](i.png)\n\n图注：cap"),
        ("<p><b>open<p>next", "**open**\n\nnext"),
        ('<div hidden>no</div><div aria-hidden="true">no</div><script>no</script><!-- c -->yes', "yes"),
    ],
)
def test_markdown(html, markdown):
    assert to_markdown(html)["markdown"] == markdown


def test_headings_above_a_table():
    got = to_markdown("<h1>A</h1><h3>C</h3><table></table><h2>B</h2><table></table>")
    assert [h["path"] for h in got["headings"]] == [["A", "C"], ["A", "B"]]


def test_pages_without_content_are_errors():
    assert to_markdown(None)["error"] == to_markdown("<p> </p>")["error"] == "WORD_PARSE_FAILED"


def test_tables_stand_in_documents(spark):
    pages = spark.createDataFrame([(1, "<p>a</p><table><tr><th>h</th></tr><tr><td>v</td></tr></table><p>b</p>"), (2, None)], "doc_id long, html string")
    got = {r.doc_id: r for r in html_doc.documents(pages).collect()}
    assert got[1].markdown.startswith("a\n\n<!-- LEAF_TABLE_START") and got[1].markdown.endswith("-->\n\nb") and "| v |" in got[1].markdown
    assert got[2].error == "WORD_PARSE_FAILED" and got[2].markdown is None


M = 'xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math"'
R = "<m:r><m:t>{}</m:t></m:r>".format


@pytest.mark.parametrize(
    ("inner", "latex"),
    [
        (f"<m:sSub><m:e>{R('x')}</m:e><m:sub>{R('i')}</m:sub></m:sSub>", "x_{i}"),
        (f'<m:acc><m:accPr><m:chr m:val="⃗"/></m:accPr><m:e>{R("v")}</m:e></m:acc>', "\\vec{v}"),
        (f"<m:acc><m:e>{R('v')}</m:e></m:acc>", "\\hat{v}"),
        (f'<m:bar><m:barPr><m:pos m:val="bot"/></m:barPr><m:e>{R("x")}</m:e></m:bar>', "\\underline{x}"),
        (f'<m:d><m:dPr><m:begChr m:val="["/><m:endChr m:val=""/></m:dPr><m:e>{R("x")}</m:e></m:d>', "\\left[x\\right."),
        (f'<m:f><m:fPr><m:type m:val="lin"/></m:fPr><m:num>{R("a")}</m:num><m:den>{R("b")}</m:den></m:f>', "{a}/{b}"),
        (f"<m:rad><m:e>{R('x')}</m:e></m:rad>", "\\sqrt{x}"),
        (f"<m:eqArr><m:e>{R('a')}</m:e><m:e>{R('b')}</m:e></m:eqArr>", "\\begin{array}{c}a\\\\b\\end{array}"),
        (f"<m:limLow><m:e>{R('lim')}</m:e><m:lim>{R('n→∞')}</m:lim></m:limLow>", "\\lim_{n\\to \\infty }"),
        (f"<m:limUpp><m:e>{R('x')}</m:e><m:lim>{R('y')}</m:lim></m:limUpp>", "\\overset{y}{x}"),
        (f"<m:m><m:mr><m:e>{R('a')}</m:e><m:e>{R('b')}</m:e></m:mr></m:m>", "\\begin{matrix}a&b\\end{matrix}"),
        (f"<m:groupChr><m:e>{R('x')}</m:e></m:groupChr>", "\\underbrace{x}"),
        (R("50%_𝛼"), "50\\%\\_\\alpha "),
        (R("𝜛≠≫∌ℎα×"), "\\varpi \\ne \\gg \\nni ℎα×"),
    ],
)
def test_formulas(inner, latex):
    assert docx.formula(f"<m:oMath {M}>{inner}</m:oMath>") == latex


def test_a_formula_fails_alone(spark):
    ship_code(spark)
    bad = f"<m:oMath {M}><m:func><m:fName>{R('log')}</m:fName><m:e>{R('x')}</m:e></m:func></m:oMath>"
    rows = spark.createDataFrame([(bad,), (f"<m:oMath {M}>{R('x')}</m:oMath>",), ("<",), (None,)], "x string")
    got = [(r.y.latex, r.y.error is None) for r in rows.select(docx.omml_to_latex("x").alias("y")).collect()]
    assert got == [(None, False), ("x", True), (None, False), (None, True)]


def word_file(body, types=True):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" {M}><w:body>{body}</w:body></w:document>')
        if types:
            z.writestr("[Content_Types].xml", f'<Types><Override PartName="/word/document.xml" ContentType="{docx.WORD_MAIN_TYPE}"/></Types>')
    return data.getvalue()


def test_word_blocks_and_pages(spark):
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r>{t}</w:r></w:p>'
    body = (
        p("<w:t>Head</w:t>", "Heading1") + p("<w:rPr><w:b/></w:rPr><w:t>bold</w:t>") + p("<w:t>one</w:t>", "ListBullet") + p("<w:t>two</w:t>", "ListBullet2")
        + f"<w:p><m:oMath><m:sSup><m:e>{R('x')}</m:e><m:sup>{R('2')}</m:sup></m:sSup></m:oMath></w:p>" + p('<w:br w:type="page"/>')
        + '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
    )
    files = spark.createDataFrame([(1, word_file(body)), (2, b"junk"), (3, None)], "doc_id long, content binary")
    got = {(r.doc_id, r.page): r for r in docx.pages_of(files).collect()}
    assert got[1, 1].html == "<h1>Head</h1><p><strong>bold</strong></p><ul><li>one</li><ul><li>two</li></ul></ul><p>$x^{2}$</p>"
    assert got[1, 2].html == '<table><tr><td colspan="2"><p>c</p></td></tr></table>'
    assert (got[1, 1].explicit_breaks, got[1, 1].n_sections) == (1, 1)
    assert got[2, 1].error and got[3, 1].error
    members = docx.zip_members(files).collect()
    assert {(r.doc_id, r.name, r.is_word) for r in members} == {(1, "word/document.xml", True), (1, "[Content_Types].xml", True), (2, None, False), (3, None, False)}
