"""The published JSON form of records."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, functions as F

from paperlane.model import CONFIDENCES, EXTRACTED, INPUT_KINDS, RECORD, let

VERSION = "1.0.0"
_WIRE_ITEM = "struct<value:string,confidence:string,value_type:string,note:string>"
_KEEP = {"ignoreNullFields": "false"}


def _json_value(item: Column) -> Column:
    """The value as JSON text: quoted for text, dates and numbers that JSON lacks."""
    number = item["number"]
    plain = F.to_json(F.struct(number.alias("v")))
    finite = F.when(F.isnan(number) | (F.abs(number) == float("inf")), F.concat(F.lit('"'), number.cast("string"), F.lit('"'))).otherwise(F.regexp_extract(plain, r"^\{\"v\":(.*)\}$", 1))
    quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce(item["text"], item["date"].cast("string")).alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)
    kind = item["value_type"]
    return (
        F.when(kind.isin("text", "date"), quoted)
        .when(kind == "number", finite)
        .when(kind == "integer", item["integer"].cast("string"))
        .when(kind == "boolean", item["boolean"].cast("string"))
        .otherwise("null")
    )


def _rest(item: Column) -> Column:
    """All of the value but ``value`` itself, as the inside of a JSON object."""
    body = F.to_json(F.struct(item["confidence"].alias("confidence"), item["value_type"].alias("value_type"), item["note"].alias("note"), item["evidence"].alias("evidence")), _KEEP)
    return F.substring(body, 2, 1 << 30)


def _object(fields: Column) -> Column:
    name = lambda k: F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    parts = F.transform(F.map_entries(fields), lambda e: F.concat(name(e["key"]), F.lit(':{"value":'), _json_value(e["value"]), F.lit(","), _rest(e["value"])))
    return F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))


def record_json(record: Column) -> Column:
    """A record struct as one line of JSON; null members are written, values keep their types."""
    head = F.to_json(F.struct(F.lit(VERSION).alias("contract_version"), record["input_kind"].alias("input_kind"), record["evidence"].alias("evidence")), _KEEP)
    tail = F.to_json(F.struct(record["diagnostics"].alias("diagnostics"), record["needs_human"].alias("needs_human")), _KEEP)
    rows = F.array_join(F.transform(record["rows"], _object), ",")
    cut = F.substring(head, 1, F.length(head) - 1)
    return F.concat(cut, F.lit(',"fields":'), _object(record["fields"]), F.lit(',"rows":['), rows, F.lit("],"), F.substring(tail, 2, 1 << 30))


def recompute_needs_human(wire: Column) -> Column:
    """``needs_human`` from the JSON alone."""
    parsed = F.from_json(wire, f"fields map<string,{_WIRE_ITEM}>, rows array<map<string,{_WIRE_ITEM}>>")
    unsure = lambda m: F.exists(F.map_values(m), lambda v: ~v["confidence"].eqNullSafe(F.lit("confirmed")))
    return let(parsed, lambda p: F.coalesce(unsure(p["fields"]), F.lit(False)) | F.coalesce(F.exists(p["rows"], unsure), F.lit(False)))


def contract_problems(record: Column) -> Column:
    """What of a record breaks the contract, as an array of codes; empty where nothing does."""
    items = F.concat(F.map_values(record["fields"]), F.flatten(F.transform(record["rows"], F.map_values)))
    bad = lambda v: ~v["confidence"].isin(*CONFIDENCES) | ((v["confidence"] == "missing") != v["value_type"].isNull())
    sure = ~F.exists(items, lambda v: v["confidence"] != "confirmed")
    checks = [
        (record["input_kind"].isNull() | ~record["input_kind"].isin(*INPUT_KINDS), "input_kind"),
        (~F.coalesce(F.regexp_like(record["evidence"]["content_hash"], F.lit("^sha256:[0-9a-f]{64}$")), F.lit(False)), "content_hash"),
        (F.exists(items, bad), "value"),
        (record["needs_human"] == sure, "needs_human"),
    ]
    return F.filter(F.array(*[F.when(wrong, F.lit(code)) for wrong, code in checks]), lambda c: c.isNotNull())


def contract_digest() -> str:
    """A digest of the record's type: it changes when the contract does."""
    return hashlib.sha256(json.dumps([VERSION, RECORD, EXTRACTED]).encode()).hexdigest()
