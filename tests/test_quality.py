from leafmill.operators.quality import _ratios, document_status, image_coverage, ocr_blocks, ocr_page, page_gate
from pyspark.sql import functions as F


def test_ratios():
    assert _ratios("", "x") == {"retention": None, "precision": None}
    assert _ratios("abcd", "abcd") == {"retention": 1.0, "precision": 1.0}
    assert _ratios("abcd", "abxd") == {"retention": 0.75, "precision": 0.75}
    assert _ratios("abc", "") == {"retention": 0.0, "precision": 0.0}


COLUMNS = "doc_id long, page int, section_missing boolean, source_len int, output_len int, ocr_len int, image_count int, coverage double, retention double, precision double, ocr_present boolean, ocr_confidence double"


def test_gate_and_priority(spark):
    rows = [
        (1, 1, False, 100, 100, 0, 0, 0.0, 1.0, 1.0, False, None),
        (2, 1, False, 8, 0, 19, 1, 0.6, None, None, True, 0.9),
        (3, 1, False, 0, 0, 30, 1, 1.0, None, None, True, 0.79),
        (4, 1, True, 100, 0, 0, 0, 0.0, 0.0, 0.0, False, None),
    ]
    gated = page_gate(spark.createDataFrame(rows, COLUMNS))
    got = {r.doc_id: r.warnings for r in gated.collect()}
    assert got[1] == []
    assert got[2] == ["ODL_TEXT_INSUFFICIENT", "IMAGE_ONLY", "OCR_REQUIRED"]
    assert got[3] == ["IMAGE_ONLY", "OCR_LOW_CONFIDENCE"]
    assert got[4] == ["MARKDOWN_SECTION_MISSING", "ODL_TEXT_INSUFFICIENT", "OCR_REQUIRED"]
    marks = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "doc_id long, page_provenance_valid boolean")
    status = {r.doc_id: r.status for r in document_status(gated, marks).collect()}
    assert status == {1: "PASSED", 2: "OCR_REQUIRED", 3: "LOW_CONFIDENCE", 4: "PAGE_PROVENANCE_INVALID"}


def test_coverage_and_ocr(spark):
    row = spark.createDataFrame([([[0.0, 0.0, 5.0, 10.0], [5.0, 5.0, 0.0, 0.0]],)], "b array<array<double>>")
    assert row.select(image_coverage(F.col("b"), F.lit(10.0), F.lit(10.0)).alias("c")).first().c == 0.5
    raw = spark.createDataFrame([(["a", "b"], [0.5, 0.25], [[[1.0, 2.0], [3.0, 1.0]], [[0.0, 0.0], [1.0, 1.0]]])], "t array<string>, s array<double>, p array<array<array<double>>>")
    blocks = raw.select(ocr_blocks(F.col("t"), F.col("s"), F.col("p")).alias("b"))
    text, confidence = ocr_page(F.col("b"))
    r = blocks.select("b", text.alias("t"), confidence.alias("c")).first()
    assert (r.t, r.c, r.b[0].bbox) == ("a\nb", 0.375, [1.0, 1.0, 3.0, 2.0])
