"""Settings, limits and the fixed values of the output formats."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Markers in texts; the name can be any.
MARKER = "LEAF_PAGE"
TABLE_MARKER = "LEAF_TABLE"
FALLBACK_MARKER = "<!-- PAGE_FALLBACK:OCR -->"


def page_marker(page, name: str = MARKER) -> str:
    return f"<!-- {name}:{page} -->"


def marker_pattern(name: str = MARKER) -> str:
    return rf"<!--\s*{name}:(\d+)\s*-->"


#: Words of the output formats.
LABELS = {
    "title": "表格：", "section": "章节：", "page": "页码：第 {} 页", "header": "表头：", "data": "数据：", "content": "内容：",
    "row": "- 行{}：", "column": "列{}", "colon": "：", "list": "、", "part": "；", "image": "表格图片{}", "link": "链接：", "bare_link": "链接",
    "nested": "嵌套表格：", "caption": "图注：",
}

#: Media types, the engine that reads each, and extensions.
MEDIA = {
    "application/pdf": ("opendataloader_ocr", ".pdf"),
    "application/msword": ("mammoth_word", ".doc"),
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ("mammoth_word", ".docx"),
    "image/png": ("rapidocr", ".png"),
    "image/jpeg": ("rapidocr", ".jpg"),
    "image/webp": ("rapidocr", ".webp"),
    "image/tiff": ("rapidocr", ".tiff"),
}
FORMATS = ("text", "json", "markdown", "html")

#: Error codes and their status.
ERRORS = {
    "INVALID_ARGUMENT": 422, "FILE_TOO_LARGE": 413, "UNSUPPORTED_FILE_TYPE": 415, "INVALID_WORD_DOCUMENT": 422, "PDF_TOO_MANY_PAGES": 413,
    "PDF_RENDER_FAILED": 422, "PDF_RESOURCE_LIMIT": 413, "ENGINE_TIMEOUT": 504, "PDF_QUALITY_FAILED": 422, "PDF_PAGE_PROVENANCE_INVALID": 422,
    "OCR_FAILED": 422, "WORD_PARSE_FAILED": 422, "DOC_CONVERSION_TIMEOUT": 504, "STORAGE_UNAVAILABLE": 503, "ENGINE_UNAVAILABLE": 503,
    "CONCURRENCY_LIMIT_REACHED": 429, "PARSE_TIMEOUT": 504, "JOB_NOT_FOUND": 404, "JOB_NOT_READY": 409, "RESULT_EXPIRED": 410,
    "DATABASE_UNAVAILABLE": 503,
}

#: Bounds of a word archive.
ZIP_MEMBERS, ZIP_MEMBER_BYTES, ZIP_TOTAL_BYTES, ZIP_RATIO = 10_000, 128 << 20, 256 << 20, 500
ZIP_REQUIRED = ("[Content_Types].xml", "word/document.xml")
WORD_MAIN_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
MOST_SPAN = 256


@dataclass(frozen=True)
class Settings:
    """Thresholds and limits; with_overrides() lays runtime values over them."""

    max_upload_bytes: int = 50 << 20
    max_pdf_pages: int = 50
    task_time_limit_seconds: int = 300
    result_ttl_hours: int = 24
    cleanup_interval_minutes: int = 30
    asset_url_ttl_hours: int = 24
    assets_public: bool = False
    ocr_concurrency: int = 1
    structured_concurrency: int = 3
    word_concurrency: int = 2
    engine_output_files: int = 2000
    engine_output_bytes: int = 512 << 20
    min_text_chars: int = 20
    image_only_text_chars: int = 8
    image_only_coverage: float = 0.6
    min_confidence: float = 0.8
    min_fidelity: float = 0.97
    render_dpi: int = 280
    max_active_keys: int = 10

    def with_overrides(self, stored: dict | None) -> Settings:
        """Known, non-null overrides win; anything else is ignored."""
        known = {k: v for k, v in (stored or {}).items() if k in self.__dataclass_fields__ and v is not None}
        return replace(self, **known)

    @property
    def stale_seconds(self) -> int:
        return max(3600, 2 * self.task_time_limit_seconds, 120 * self.cleanup_interval_minutes)

    @property
    def lease_ms(self) -> int:
        return max(90_000, (self.task_time_limit_seconds + 60) * 1000)

    @property
    def asset_ttl_hours(self) -> int:
        return max(self.asset_url_ttl_hours, self.result_ttl_hours + 24)

    def limit_of(self, engine: str) -> int:
        return {"ocr": self.ocr_concurrency, "structured": self.structured_concurrency, "word": self.word_concurrency}[engine]


DEFAULTS = Settings()
