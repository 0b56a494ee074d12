"""What an extraction engine is to the plans. There is no OCR, PDF or office library here: Stub engines read prepared
texts and are named so."""

from __future__ import annotations

from importlib.util import find_spec
from shutil import which
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..operators.quality import document_status, fidelity, page_gate
from ..operators.sections import merge_fallback, page_sections, provenance
from ..functions.text import effective_text


class PageExtractor(Protocol):
    """Structured extraction: doc_id, markdown (with page markers) and page_count of documents."""

    def extract(self, files: DataFrame) -> DataFrame: ...


class PageReader(Protocol):
    """The fallback: doc_id, page, text, confidence of the pages that it is given."""

    def read(self, pages: DataFrame) -> DataFrame: ...


class StubReader:
    """Not OCR: gives back the texts of a table (doc_id, page, text, confidence)."""

    def __init__(self, texts: DataFrame):
        self.texts = texts

    def read(self, pages: DataFrame) -> DataFrame:
        return self.texts.join(pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi")


def available(modules: dict[str, str], programs: dict[str, str]) -> dict[str, bool]:
    """Which engines can be planned with: by Python module, by program."""
    return {k: find_spec(m) is not None for k, m in modules.items()} | {k: which(p) is not None for k, p in programs.items()}


def within_page_cap(docs: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """docs (page_count) with error: unreadable files have no page count."""
    return docs.withColumn("error", F.when(F.col("page_count").isNull(), "PDF_RENDER_FAILED").when(F.col("page_count") > settings.max_pdf_pages, "PDF_TOO_MANY_PAGES"))


def selected_pages(pages: DataFrame, selection: DataFrame | None) -> DataFrame:
    """The pages to render; no selection means all."""
    return pages if selection is None else pages.join(selection.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")


def measured(sources: DataFrame, docs: DataFrame, ocr: DataFrame | None, settings: Settings = DEFAULTS) -> DataFrame:
    """Pages through the gate. sources: doc_id, page, source_text, image_count, coverage; docs: doc_id, markdown;
    ocr: doc_id, page, text, confidence of pages that were read again."""
    cut = page_sections(docs).select("doc_id", "page", "body")
    both = sources.join(cut, ["doc_id", "page"], "left")
    if ocr is None:
        both = both.withColumns({"ocr_text": F.lit(None).cast("string"), "ocr_confidence": F.lit(None).cast("double"), "ocr_present": F.lit(False)})
    else:
        seen = ocr.select("doc_id", "page", F.col("text").alias("ocr_text"), F.col("confidence").alias("ocr_confidence"), F.lit(True).alias("seen"))
        both = both.join(seen, ["doc_id", "page"], "left").withColumn("ocr_present", F.coalesce("seen", F.lit(False))).drop("seen")
    said = both.withColumns({"a": effective_text(F.col("source_text")), "b": effective_text(F.col("body")), "c": effective_text(F.col("ocr_text"))})
    ratios = said.withColumn("f", fidelity(F.col("a"), F.col("b")))
    return page_gate(
        ratios.select(
            "doc_id", "page", F.col("body").isNull().alias("section_missing"), F.length("a").alias("source_len"), F.length("b").alias("output_len"),
            F.length("c").alias("ocr_len"), "image_count", "coverage", F.col("f.retention").alias("retention"), F.col("f.precision").alias("precision"),
            "ocr_present", "ocr_confidence",
        ), settings,
    )


def parse_pages(sources: DataFrame, docs: DataFrame, reader: PageReader, settings: Settings = DEFAULTS) -> tuple[DataFrame, DataFrame]:
    """The page pipeline: gate, read the flagged pages again, merge, gate once more. Gives doc_id, merged, and the final
    status of each document. docs: doc_id, markdown, page_count. Only flagged pages of documents with valid markers reach the reader."""
    marked = provenance(docs, "page_count")
    first = measured(sources, docs, None, settings)
    wanted = first.where("ocr_required").join(marked.where("page_provenance_valid").select("doc_id"), "doc_id", "left_semi")
    again = reader.read(wanted)
    merged = merge_fallback(docs, again).withColumnRenamed("merged", "markdown")
    final = measured(sources, merged, again, settings)
    return merged, document_status(final, marked)
