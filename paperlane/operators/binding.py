"""Headers are bound to declared columns by alias, with uniqueness checks.

The schema is known when the plan is made, so each table's header is bound by
array expressions in its own row: no join and no shuffle for any number of files.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, functions as F

from paperlane.config import TableSchema, TabularOptions
from paperlane.errors import AmbiguousHeader, SchemaMismatch
from paperlane.functions.text import casefold, collapse, is_blank, normalize, strip, without_marks
from paperlane.model import let


def split_unit(header: Column, brackets: tuple[tuple[str, str], ...]) -> Column:
    """Struct (label, unit): the unit is a bracket at the end of the header that leaves a label before it."""

    def of(plain: Column) -> Column:
        out = F.struct(plain.alias("label"), F.lit(None).cast("string").alias("unit"))
        for a, b in reversed(brackets):
            pattern = rf"(?s)^(.+){re.escape(a)}([^{re.escape(a)}]*){re.escape(b)}$"
            parts = F.struct(strip(F.regexp_extract(plain, pattern, 1)).alias("label"), strip(F.regexp_extract(plain, pattern, 2)).alias("unit"))
            split = let(parts, lambda p: F.when((p["label"] != "") & (p["unit"] != ""), p))
            out = F.coalesce(F.when(plain.endswith(b), split), out)
        return out

    return let(strip(header), of)


def normal_header(label: Column, options: TabularOptions) -> Column:
    if options.strip_header_accents and options.casefold_headers:
        return normalize(label)
    if options.strip_header_accents:
        return collapse(without_marks(label))
    return casefold(collapse(label)) if options.casefold_headers else collapse(label)


def _normal(text: str, options: TabularOptions) -> str:
    text = " ".join(text.split())
    if options.strip_header_accents:
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.casefold() if options.casefold_headers else text


def header_cells(headers: Column, options: TabularOptions) -> Column:
    """Array of (idx, raw, unit, normal) over header cells; null counts as ''."""

    def of(raw: Column, idx: Column) -> Column:
        parts = let(F.coalesce(raw, F.lit("")), lambda r: split_unit(r, options.unit_brackets))
        return let(parts, lambda p: F.struct(idx.alias("idx"), F.coalesce(raw, F.lit("")).alias("raw"), p["unit"].alias("unit"), normal_header(p["label"], options).alias("normal")))

    return F.transform(headers, of)


def bind(headers: Column, schema: TableSchema, options: TabularOptions) -> Column:
    """A struct of what a table's headers bind to.

    found (key, idx, raw, unit) of every match; unmatched (idx, raw) of headers
    that no column uses and that aren't blank; missing, the optional columns
    without a header; notes on these three in this order; error_class and
    reason of the first column in the schema's order that has two headers,
    has one that another column has too, or is required and has none; and,
    where there is no error, columns (key -> index) and units (key -> unit).
    """

    def of_cells(cells: Column) -> Column:
        each = []
        for c in schema.columns:
            names = sorted({_normal(h, options) for h in c.headers} - {""}) or [None]
            each.append(_matches(cells, c.key, names))
        return let(F.struct(cells.alias("cells"), F.array(*each).alias("each")), of_hits)

    def of_hits(h: Column) -> Column:
        cells, found = h["cells"], F.flatten(h["each"])
        problems, lacking = [], []
        for k, c in enumerate(schema.columns):
            own = F.get(h["each"], F.lit(k))
            before = F.flatten(F.slice(h["each"], 1, k)) if k else None
            none = F.size(own) == 0
            out = F.when(F.size(own) > 1, _problem(AmbiguousHeader, F.lit(f"header_twice: {c.key}")))
            if c.required:
                out = out.when(none, _problem(SchemaMismatch, F.lit(f"required_column_missing: {c.key}")))
            else:
                lacking.append(F.when(none, F.lit(c.key)))
            if before is not None:
                taken = F.array_contains(F.transform(before, lambda b: b["idx"]), F.get(own, F.lit(0))["idx"])
                out = out.when(~none & taken, _problem(AmbiguousHeader, F.concat(F.lit("header_of_two_columns: "), (F.get(own, F.lit(0))["idx"] + 1).cast("string"))))
            problems.append(out)
        unused = F.filter(cells, lambda x: ~is_blank(x["raw"]) & ~F.exists(found, lambda f: f["idx"] == x["idx"]))
        missing = F.filter(F.array(*lacking).cast("array<string>"), lambda k: k.isNotNull())
        parts = F.struct(found.alias("found"), F.transform(unused, lambda x: F.struct(x["idx"].alias("idx"), x["raw"].alias("raw"))).alias("unmatched"), missing.alias("missing"), F.coalesce(*problems).alias("problem"))
        return let(parts, whole)

    def whole(p: Column) -> Column:
        with_unit = F.filter(p["found"], lambda f: f["unit"].isNotNull())
        notes = F.concat(
            F.transform(p["unmatched"], lambda u: F.concat(F.lit("unmatched_header: "), u["raw"])),
            F.transform(p["missing"], lambda k: F.concat(F.lit("optional_column_missing: "), k)),
            F.transform(with_unit, lambda f: F.concat(F.lit("unit: "), f["key"], F.lit(" = "), f["unit"])),
        )
        good = p["problem"].isNull()
        columns = F.map_from_entries(F.transform(p["found"], lambda f: F.struct(f["key"].alias("key"), f["idx"].alias("value"))))
        units = F.map_from_entries(F.transform(with_unit, lambda f: F.struct(f["key"].alias("key"), f["unit"].alias("value"))))
        return F.struct(
            p["found"].alias("found"), p["unmatched"].alias("unmatched"), p["missing"].alias("missing"), notes.alias("notes"),
            p["problem"]["error_class"].alias("error_class"), p["problem"]["reason"].alias("reason"), F.when(good, columns).alias("columns"), F.when(good, units).alias("units"),
        )

    return let(header_cells(headers, options), of_cells)


def _matches(cells: Column, key: str, names: list[str]) -> Column:
    hits = F.filter(cells, lambda x: x["normal"].isin(names))
    return F.transform(hits, lambda x: F.struct(F.lit(key).alias("key"), x["idx"].alias("idx"), x["raw"].alias("raw"), x["unit"].alias("unit")))


def _problem(kind: type, reason: Column) -> Column:
    return F.struct(F.lit(kind.__name__).alias("error_class"), reason.alias("reason"))
