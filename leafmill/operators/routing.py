"""What a file is, who reads it, and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, FORMATS, MEDIA, Settings
from ..functions.text import base_name, suffix_of

_BY_SUFFIX = {suffix: media for media, (_, suffix) in MEDIA.items()}


def media_type(header: Column, name: Column) -> Column:
    """The type that the first bytes show, with the name's suffix where they show only a container; else null."""
    starts = lambda *hexes: F.substring(F.hex(header), 1, len(hexes[0])).isin(*hexes)
    webp = starts("52494646") & (F.substring(F.hex(header), 17, 8) == "57454250")
    suffix = suffix_of(F.coalesce(name, F.lit("")))
    return (
        F.when(starts("255044462D"), F.lit(_BY_SUFFIX[".pdf"])).when(starts("89504E470D0A1A0A"), F.lit(_BY_SUFFIX[".png"]))
        .when(starts("FFD8FF"), F.lit(_BY_SUFFIX[".jpg"])).when(starts("49492A00", "4D4D002A"), F.lit(_BY_SUFFIX[".tiff"]))
        .when(webp, F.lit(_BY_SUFFIX[".webp"])).when(starts("D0CF11E0A1B11AE1") & (suffix == ".doc"), F.lit(_BY_SUFFIX[".doc"]))
        .when(starts("504B0304", "504B0506", "504B0708") & (suffix == ".docx"), F.lit(_BY_SUFFIX[".docx"]))
    )


def engine_of(media: Column) -> Column:
    routed = F.lit(None).cast("string")
    for name, (engine, _) in MEDIA.items():
        routed = F.when(media == name, F.lit(engine)).otherwise(routed)
    return F.coalesce(routed, F.lit("unsupported"))


def safe_name(name: Column, media: Column) -> Column:
    suffix = F.lit("")
    for kind, (_, end) in MEDIA.items():
        suffix = F.when(media == kind, F.lit(end)).otherwise(suffix)
    base = base_name(F.coalesce(name, F.lit("")))
    return F.when(base.isin("", ".", "..") | base.isNull(), F.concat(F.lit("upload"), suffix)).otherwise(base)


def upload_error(length: Column, media: Column, settings: Settings = DEFAULTS) -> Column:
    return F.when(length > settings.max_upload_bytes, "FILE_TOO_LARGE").when(media.isNull(), "UNSUPPORTED_FILE_TYPE")


def detected_type(media: Column, ocr_pages: Column, page_count: Column) -> Column:
    pdf = F.when(F.size(ocr_pages) == 0, "text_pdf").when(F.size(ocr_pages) == page_count, "scanned_pdf").otherwise("mixed_pdf")
    return (
        F.when(media == _BY_SUFFIX[".pdf"], pdf).when(media == _BY_SUFFIX[".docx"], "docx").when(media == _BY_SUFFIX[".doc"], "doc")
        .when(media.startswith("image/"), "image")
    )


def parse_formats(value: Column) -> Column:
    """The formats that a comma list names, or null if it names none or an unknown one."""
    asked = F.array_distinct(F.filter(F.transform(F.split(F.lower(value), ","), lambda f: F.trim(f)), lambda f: f != ""))
    unknown = F.array_except(asked, F.array(*[F.lit(f) for f in FORMATS]))
    return F.when((F.size(asked) > 0) & (F.size(unknown) == 0), F.array_sort(asked))


def engine_formats(formats: Column) -> Column:
    """What the PDF engine is asked for: the formats, and what later steps read."""
    return F.array_sort(F.array_union(formats, F.array(F.lit("markdown"), F.lit("json"))))


def only_asked(outputs: dict[str, Column], formats: Column, media: Column) -> list[Column]:
    """Outputs that weren't asked for are null; word files give Markdown alone, whatever is asked."""
    word = media.isin(_BY_SUFFIX[".doc"], _BY_SUFFIX[".docx"])
    return [F.when(F.when(word, F.lit(f == "markdown")).otherwise(F.array_contains(formats, f)), c).alias(f) for f, c in outputs.items()]
