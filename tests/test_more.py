import io
import json
import os
import struct
import zipfile

import pytest

from leafmill.functions.json_tree import attach_pages, image_nodes
from leafmill.operators import docx, html_doc, tables
from leafmill.ship import ship_code
from leafmill.sources.settings import SettingsStore, capabilities
from pyspark.sql import functions as F


def test_image_nodes_at_any_depth(spark):
    ship_code(spark)
    text = json.dumps({"kids": [{"type": "image", "source": "a.png", "page number": 2, "kids": [{"type": "image", "source": "b.png", "page number": 3}]}, {"type": "image", "source": 1}]})
    rows = spark.createDataFrame([(text,), ("{",), (None,)], "x string").select(image_nodes("x").alias("y")).collect()
    assert [[tuple(n) for n in r.y] for r in rows] == [[("a.png", 2), ("b.png", 3)], [], []]


def test_pages_are_attached(spark):
    rows = spark.createDataFrame([('{"a": 1}',), ("{}",), ("[1]",), (None,)], "x string")
    pages = F.array(F.struct(F.lit(1).alias("page")))
    got = [json.loads(r.y) for r in rows.select(attach_pages(F.col("x"), pages).alias("y")).collect()]
    assert got == [{"a": 1, "ocr_fallback_pages": [{"page": 1}]}, {"ocr_fallback_pages": [{"page": 1}]}, {"structured": [1], "ocr_fallback_pages": [{"page": 1}]}, {"structured": None, "ocr_fallback_pages": [{"page": 1}]}]


def test_headings_and_tables_go_on_over_pages(spark):
    table = "<table><tr><td>x</td></tr></table>"
    rows = [(1, 1, f"<h1>A</h1>{table}"), (1, 2, f"<h2>B</h2>{table}<h1>C</h1>{table}")]
    got = html_doc.paged_documents(spark.createDataFrame(rows, "doc_id long, page int, html string")).orderBy("page").collect()
    assert [[(h.table_id, h.path) for h in r.headings] for r in got] == [[("table-001", ["A"])], [("table-002", ["A", "B"]), ("table-003", ["C"])]]
    whole = html_doc.with_page_markers(spark.createDataFrame(got)).first().markdown
    assert whole.startswith("<!-- WORD_PAGE:1 -->\n\n# A") and "<!-- WORD_PAGE:2 -->\n\n## B" in whole


def test_images_of_word_files(spark):
    png = lambda w, h, tail=b"": b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", w, h) + tail
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, raw in (("a.png", png(2, 3)), ("b.png", png(2, 3)), ("c.png", png(9000, 9000)), ("d.txt", b"hello")):
            z.writestr(f"word/media/{name}", raw)
    files = spark.createDataFrame([(1, data.getvalue()), (2, b"junk"), (3, None)], "doc_id long, content binary")
    got = [(r.doc_id, r.name, r.omitted) for r in docx.images_of(files).orderBy("name").collect()]
    assert got == [(1, "word/media/a.png", None), (1, "word/media/c.png", "too many pixels"), (1, "word/media/d.txt", "unknown type")]
    assert docx.image_size(b"\xff\xd8\xff\xe0\0\x04\0\0\xff\xc0\0\x11\x08\0\x05\0\x07xxxxx") == (7, 5)


def test_table_serialisation_and_grid(spark):
    cells = tables.cells_of(spark.createDataFrame([(1, "<table><tr><th>h</th><th>i</th></tr><tr><td>1</td><td>2</td></tr></table>")], "doc_id long, html string"))
    whole = json.loads(tables.as_json(cells).first().json)
    assert (whole["row_count"], whole["column_count"], [c["text"] for c in whole["cells"]]) == (2, 2, ["h", "i", "1", "2"])
    rows = tables.grid(tables.preview_cells(cells)).orderBy("row").collect()
    assert [[c.markdown for c in r.cells] for r in rows] == [["h", "i"], ["1", "2"]]
    text = tables.render(cells).select("doc_id", F.concat(F.lit("a\n"), "markdown", F.lit("\nb")).alias("markdown"))
    found = tables.tables_of_markdown(text).first()
    assert (found.table_id, found.format) == ("table-001", "markdown") and "| 1 | 2 |" in found.body


def test_settings_store(tmp_path, spark):
    store = SettingsStore(str(tmp_path / "s.json"))
    assert store.update(ocr_concurrency=5).ocr_concurrency == 5
    assert oct(os.stat(store.path).st_mode & 0o777) == "0o600"
    assert store.update(word_concurrency=3).ocr_concurrency == 5
    with pytest.raises(ValueError):
        store.update(no_such=1)
    assert store.reset().ocr_concurrency == 1
    (tmp_path / "s.json").write_text("{")
    assert store.effective().ocr_concurrency == 1
    assert capabilities(spark).first().limits["max_pdf_pages"] == 50.0
