"""The page-level quality gate."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..functions.arrow import arrow


def image_coverage(boxes: Column, width: Column, height: Column) -> Column:
    """Share of a page that images (x0, y0, x1, y1) cover, overlaps counted twice, 1 at most."""
    area = F.aggregate(
        F.coalesce(boxes, F.array().cast("array<array<double>>")), F.lit(0.0),
        lambda acc, b: acc + F.greatest(F.lit(0.0), F.get(b, F.lit(2)) - F.get(b, F.lit(0))) * F.greatest(F.lit(0.0), F.get(b, F.lit(3)) - F.get(b, F.lit(1))),
    )
    page = width * height
    return F.least(F.lit(1.0), area / F.when(page == 0, 1.0).otherwise(page))


def _ratios(source: str | None, output: str | None) -> dict:
    if not source:
        return {"retention": None, "precision": None}
    if source == output:
        return {"retention": 1.0, "precision": 1.0}
    common = sum(b.size for b in SequenceMatcher(None, source, output or "", autojunk=False).get_matching_blocks())
    return {"retention": round(common / len(source), 6), "precision": round(common / len(output), 6) if output else 0.0}


_RATIOS = pa.struct([("retention", pa.float64()), ("precision", pa.float64())])


@arrow("struct<retention:double,precision:double>")
def fidelity(source: pa.Array, output: pa.Array) -> pa.Array:
    """How much of source is in output and the other way, by matching blocks; null without a source. Quadratic in the
    length of a page where the two differ, so it is for pages, not documents."""
    return pa.array([_ratios(a, b) for a, b in zip(source.to_pylist(), output.to_pylist(), strict=True)], type=_RATIOS)


def page_gate(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """pages with is_image_only, text_fidelity_low, ocr_required, low_confidence, warnings.

    pages: section_missing, source_len, output_len, ocr_len, image_count, coverage, retention, precision, ocr_present,
    ocr_confidence.
    """
    s = settings
    raster = (F.col("image_count") > 0) & (F.col("coverage") >= s.image_only_coverage)
    image_only = raster & (F.col("source_len") <= s.image_only_text_chars)
    enough = lambda c: F.coalesce(F.col(c) >= s.min_fidelity, F.lit(False))
    low = (F.col("source_len") > 0) & ~(enough("retention") & enough("precision"))
    gated = pages.withColumns({"is_image_only": image_only, "text_fidelity_low": low})
    needs = (
        (F.col("is_image_only") & (F.col("ocr_len") < s.min_text_chars))
        | F.col("text_fidelity_low")
        | ((F.col("image_count") > 0) & (F.col("output_len") < s.min_text_chars) & (F.col("ocr_len") == 0))
    )
    unsure = F.col("ocr_present") & ~F.coalesce(F.col("ocr_confidence") >= s.min_confidence, F.lit(False))
    gated = gated.withColumns({"ocr_required": needs, "low_confidence": unsure})
    flags = [
        ("section_missing", "MARKDOWN_SECTION_MISSING"), ("text_fidelity_low", "ODL_TEXT_INSUFFICIENT"), ("is_image_only", "IMAGE_ONLY"),
        ("ocr_required", "OCR_REQUIRED"), ("low_confidence", "OCR_LOW_CONFIDENCE"),
    ]
    return gated.withColumn("warnings", F.array_compact(F.array(*[F.when(F.col(c), F.lit(w)) for c, w in flags])))


def document_status(gated: DataFrame, provenance: DataFrame, doc: str = "doc_id") -> DataFrame:
    """doc, status, ocr_required_pages, low_confidence_pages, ocr_page_count, page_provenance_valid."""
    pages = lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col("page"))))
    rolled = gated.groupBy(doc).agg(
        pages("ocr_required").alias("ocr_required_pages"), pages("low_confidence").alias("low_confidence_pages"),
        F.count_if("ocr_present").alias("ocr_page_count"),
    )
    status = (
        F.when(~F.col("page_provenance_valid"), "PAGE_PROVENANCE_INVALID")
        .when(F.size("low_confidence_pages") > 0, "LOW_CONFIDENCE")
        .when(F.size("ocr_required_pages") > 0, "OCR_REQUIRED")
        .otherwise("PASSED")
    )
    return rolled.join(provenance.select(doc, "page_provenance_valid"), doc).withColumn("status", status)


def ocr_blocks(txts: Column, scores: Column, boxes: Column) -> Column:
    """Blocks of an OCR result: text, confidence, and the box around the polygon."""
    side = lambda pick, k: lambda z: pick(F.transform(z["boxes"], lambda p: F.get(p, F.lit(k))))
    zipped = F.arrays_zip(txts.alias("txts"), scores.alias("scores"), boxes.alias("boxes"))
    return F.transform(
        zipped,
        lambda z: F.struct(
            F.lit("text").alias("type"), z["txts"].alias("text"), F.round(z["scores"], 6).alias("confidence"),
            F.array(side(F.array_min, 0)(z), side(F.array_min, 1)(z), side(F.array_max, 0)(z), side(F.array_max, 1)(z)).alias("bbox"),
        ),
    )


def ocr_page(blocks: Column) -> tuple[Column, Column]:
    """The text and confidence of a page's blocks; the confidence is null without blocks."""
    confidence = F.transform(blocks, lambda b: b["confidence"])
    total = F.aggregate(confidence, F.lit(0).cast("decimal(18,6)"), lambda a, x: (a + x.cast("decimal(9,6)")).cast("decimal(18,6)"))  # exact
    mean = total.cast("double") / F.size(blocks)
    return F.array_join(F.transform(blocks, lambda b: b["text"]), "\n"), F.when(F.size(blocks) > 0, F.round(mean, 6))
