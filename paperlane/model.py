"""The record model: extracted values as one struct type, evidence, and their constructors.

``confidence`` is missing exactly where there is no value.  Of the five value
columns the one that ``value_type`` names is set, all others are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

CONFIRMED, REVIEW, MISSING = "confirmed", "needs_review", "missing"
CONFIDENCES = (CONFIRMED, REVIEW, MISSING)
TABULAR, TEXT_LAYER, RASTER, HANDWRITING = "tabular", "text_layer_document", "raster_scan", "handwriting"
INPUT_KINDS = (TABULAR, TEXT_LAYER, RASTER, HANDWRITING)
TYPES = {"text": "string", "number": "double", "integer": "decimal(38,0)", "date": "date", "boolean": "boolean"}
EVIDENCE = "struct<relative_path:string,content_hash:string,locator:string>"
EXTRACTED = f"struct<value_type:string,{','.join(f'{n}:{t}' for n, t in TYPES.items())},confidence:string,note:string,evidence:{EVIDENCE}>"
RECORD = f"contract_version string, input_kind string, evidence {EVIDENCE}, fields map<string,{EXTRACTED}>, rows array<map<string,{EXTRACTED}>>, diagnostics array<string>, needs_human boolean"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def no_evidence() -> Column:
    return F.lit(None).cast(EVIDENCE)


def evidence(path: Column, content_hash: Column, locator: Column | None = None) -> Column:
    return F.struct(path.alias("relative_path"), content_hash.alias("content_hash"), (F.lit(None).cast("string") if locator is None else locator).alias("locator"))


def located(source: Column | None, locator: Column) -> Column:
    """``source`` evidence at another place of the same file; null stays null."""
    if source is None:
        return no_evidence()
    return F.when(source.isNotNull(), evidence(source["relative_path"], source["content_hash"], locator))


def extracted(value_type: str, value: Column | None, confidence: Column, note: Column | None = None, source: Column | None = None) -> Column:
    """An extracted struct; where ``value`` is null, it is missing whatever ``confidence`` says."""
    there = F.lit(False) if value is None else value.isNotNull()
    parts = [F.when(there, F.lit(value_type)).alias("value_type")]
    for name, kind in TYPES.items():
        parts.append((value.cast(kind) if value is not None and name == value_type else F.lit(None).cast(kind)).alias(name))
    parts.append(F.when(there, confidence).otherwise(F.lit(MISSING)).alias("confidence"))
    parts.append((F.lit(None).cast("string") if note is None else note).alias("note"))
    parts.append((no_evidence() if source is None else source).alias("evidence"))
    return F.struct(*parts)


def confirmed(value_type: str, value: Column, source: Column | None = None, note: Column | None = None) -> Column:
    return extracted(value_type, value, F.lit(CONFIRMED), note, source)


def review(value_type: str, value: Column, note: Column, source: Column | None = None) -> Column:
    return extracted(value_type, value, F.lit(REVIEW), note, source)


def missing(note: Column, source: Column | None = None) -> Column:
    return extracted("text", None, F.lit(MISSING), note, source)


def changed(item: Column, **parts: Column) -> Column:
    """``item`` with other fields."""
    names = ["value_type", *TYPES, "confidence", "note", "evidence"]
    return F.struct(*[parts.get(n, item[n]).alias(n) for n in names])


def append_note(old: Column, new: Column) -> Column:
    return F.concat_ws(" | ", old, new)


def has_value(item: Column) -> Column:
    return F.coalesce(item["confidence"] != MISSING, F.lit(False))


def numeric(item: Column) -> Column:
    """The number of a value, null for texts, booleans and dates."""
    return F.coalesce(item["number"], item["integer"].cast("double"))


def value_text(item: Column) -> Column:
    """The value as text whatever its type, null where it is missing."""
    return F.coalesce(item["text"], item["number"].cast("string"), item["integer"].cast("string"), item["date"].cast("string"), item["boolean"].cast("string"))


def needs_human(*items: Column) -> Column:
    """Whether any of the values isn't confirmed; nothing is averaged."""
    out = F.lit(False)
    for item in items:
        out = out | (item["confidence"] != CONFIRMED)
    return out
