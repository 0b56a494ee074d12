"""Raw engine JSON, which has no schema: image nodes at any depth, and pages attached to it."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrow import arrow

_NODES = pa.list_(pa.struct([("source", pa.string()), ("page", pa.int32())]))


def _images(text: str | None) -> list[dict]:
    try:
        root = json.loads(text or "null")
    except ValueError:
        return []
    found: dict[str, int] = {}
    todo = [root]
    while todo:  # in document order; of equal sources the last counts
        node = todo.pop()
        if isinstance(node, dict):
            source, page = node.get("source"), node.get("page number")
            if node.get("type") == "image" and isinstance(source, str) and isinstance(page, int):
                found[source] = page
            todo += reversed(list(node.values()))
        elif isinstance(node, list):
            todo += reversed(node)
    return [{"source": s, "page": p} for s, p in found.items()]


@arrow("array<struct<source:string,page:int>>")
def image_nodes(texts: pa.Array) -> pa.Array:
    """source and page of the image nodes in a JSON text; none of one that isn't JSON."""
    return pa.array([_images(t) for t in texts.to_pylist()], type=_NODES)


def attach_pages(text: Column, pages: Column) -> Column:
    """The JSON object with the pages that were read again; anything else is wrapped first."""
    inner = F.coalesce(text, F.lit("null"))
    added = F.concat(F.lit('"ocr_fallback_pages":'), F.to_json(pages))
    is_object = F.trim(inner).startswith("{")
    body = F.regexp_replace(F.trim(inner), r"^\{\s*|\s*\}$", "")
    return F.when(is_object, F.concat(F.lit("{"), body, F.when(body == "", "").otherwise(","), added, F.lit("}"))).otherwise(
        F.concat(F.lit('{"structured":'), inner, F.lit(","), added, F.lit("}"))
    )
