"""Cells become typed values: refuse what is ambiguous, never guess.

A raw cell is text; ``native`` says what a typed source held (``number``,
``boolean`` or ``date``, null for text), ``unreadable`` why a cell that has
content can't be read.  Numbers come as Python would print them, so that a
number in a text column shows its digits.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, functions as F

from paperlane.config import ColumnSpec, FieldSpec, TabularOptions
from paperlane.errors import Configuration
from paperlane.functions.text import casefold, is_blank, strip
from paperlane.model import CONFIRMED, REVIEW, confirmed, extracted, let, missing, no_evidence, review

_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf(inity)?)$"
EXACT = float(1 << 53)


def is_blank_cell(raw: Column, unreadable: Column | None = None) -> Column:
    blank = is_blank(raw)
    return blank if unreadable is None else blank & unreadable.isNull()


def _as_double(text: Column) -> Column:
    special = F.regexp_like(text, F.lit(_SPECIAL))
    bare = F.lower(F.regexp_replace(text, "^[+-]", ""))
    value = F.when(bare == "nan", F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    signed = F.when(text.startswith("-"), -value).otherwise(value)
    return F.when(F.regexp_like(text, F.lit(_FLOAT)), text.try_cast("double")).when(special, signed)


def _canonical(body: Column, options: TabularOptions) -> Column:
    """The digits with a point for decimals and without groups; null where either reading is possible."""
    without = lambda c: F.replace(body, F.lit(c), F.lit(""))
    comma_point = F.replace(body, F.lit(","), F.lit("."))
    one_dot, one_comma = body.contains("."), body.contains(",")
    last_is_dot = F.length(F.substring_index(body, ".", -1)) < F.length(F.substring_index(body, ",", -1))
    both = F.when(last_is_dot, without(",")).otherwise(F.replace(without("."), F.lit(","), F.lit(".")))
    if options.decimal_separator == ".":
        plain = without(",")
    elif options.decimal_separator == ",":
        plain = F.when(one_dot, without(".")).otherwise(comma_point)
    else:
        several = lambda c: F.regexp_like(body, F.lit(rf"[{c}].*[{c}]"))
        ambiguous = F.regexp_like(body, F.lit(r"^[0-9]{1,3}[.,][0-9]{3}$"))
        plain = F.when(ambiguous, F.lit(None).cast("string")).when(several("."), without(".")).when(several(","), without(",")).otherwise(comma_point)
    return F.when(one_dot & one_comma, both).otherwise(plain)


def parse_number(raw: Column, options: TabularOptions) -> Column:
    """Struct (number, problem): a double, or null and the reason: no_number or ambiguous_number."""

    def of_text(text: Column) -> Column:
        body = F.when(F.regexp_like(text, F.lit("^[+-]")), strip(F.substring(text, 2, 1 << 30))).otherwise(text)
        body = F.translate(body, options.group_separators, "") if options.group_separators else body
        return let(F.struct(text.startswith("-").alias("negative"), let(body, lambda b: _canonical(b, options)).alias("plain")), of_plain)

    def of_plain(c: Column) -> Column:
        return let(F.struct(c["negative"].alias("negative"), c["plain"].isNull().alias("unsure"), _as_double(c["plain"]).alias("size")), signed)

    def signed(c: Column) -> Column:
        value = F.when(c["negative"], -c["size"]).otherwise(c["size"])
        problem = F.when(c["unsure"], "ambiguous_number").when(c["size"].isNull(), "no_number")
        return F.struct(value.alias("number"), problem.alias("problem"))

    return let(strip(raw), of_text)


_DIRECTIVES = {"Y": ("y", "[0-9]{4}"), "m": ("m", "[0-9]{1,2}"), "d": ("d", "[0-9]{1,2}"), "y": ("s", "[0-9]{2}"), "H": ("", "[0-9]{1,2}"), "M": ("", "[0-9]{1,2}"), "S": ("", "[0-9]{1,2}")}


def _format(fmt: str) -> tuple[str, list[str]]:
    """A strptime format as a pattern with one group for each of year, month and day."""
    out, groups, i = "", [], 0
    while i < len(fmt):
        if fmt[i] == "%" and i + 1 < len(fmt):
            i += 1
            if fmt[i] == "%":
                out += "%"
            elif fmt[i] in _DIRECTIVES:
                name, pattern = _DIRECTIVES[fmt[i]]
                out += f"({pattern})" if name else pattern
                groups += [name] * bool(name)
            else:
                raise Configuration(f"date format {fmt}: %{fmt[i]} isn't supported")
        else:
            out += re.escape(fmt[i])
        i += 1
    if sorted(groups) not in (["d", "m", "y"], ["d", "m", "s"]):
        raise Configuration(f"date format {fmt}: year, month and day once each")
    return f"^{out}$", groups


def parse_date(raw: Column, formats: tuple[str, ...]) -> Column:
    """The date of a stripped text by the first format that fits; null where none does or there is no such day."""
    text, found = raw, []
    for fmt in formats:
        pattern, groups = _format(fmt)
        part = {g: F.regexp_extract(text, pattern, k + 1) for k, g in enumerate(groups)}
        short = part.get("s")
        year = part["y"] if short is None else F.concat(F.when(short < "69", "20").otherwise("19"), short)
        iso = F.concat_ws("-", year, F.lpad(part["m"], 2, "0"), F.lpad(part["d"], 2, "0"))
        found.append(F.when(F.regexp_like(text, F.lit(pattern)), iso.try_cast("date")))
    return F.coalesce(*found)


def _text(raw: Column, native: Column | None, source: Column) -> Column:
    if native is None:
        return confirmed("text", strip(raw), source)
    whole = F.regexp_like(raw, F.lit(r"^-?[0-9]+(\.0)?$"))
    note = F.when(native == "number", F.when(F.regexp_like(raw, F.lit("[eE]")), "scientific_number_in_text").when(whole & (F.abs(raw.try_cast("double")) >= EXACT), "digits_may_be_lost").when(whole, "leading_zeros_may_be_lost"))
    shown = F.when((native == "number") & whole, F.regexp_replace(raw, r"\.0$", "")).otherwise(strip(raw))
    both = F.struct(shown.alias("shown"), note.alias("note"))
    return let(both, lambda c: extracted("text", c["shown"], F.when(c["note"].isNull(), CONFIRMED).otherwise(REVIEW), c["note"], source))


def _number(raw: Column, native: Column | None, options: TabularOptions, source: Column, integer: bool) -> Column:
    parsed = parse_number(raw, options)
    if native is not None:
        none = F.lit(None)
        typed = F.struct(_as_double(raw).alias("number"), none.cast("string").alias("problem"))
        refused = F.struct(none.cast("double").alias("number"), F.lit("boolean_is_no_number").alias("problem"))
        parsed = F.when(native == "boolean", refused).when(native == "number", typed).otherwise(parsed)

    def of(c: Column) -> Column:
        value = c["number"]
        if not integer:
            return extracted("number", value, F.lit(CONFIRMED), c["problem"], source)
        whole = F.coalesce(value % 1 == 0, F.lit(False))
        return (
            F.when(whole & (F.abs(value) < 1e38), confirmed("integer", _exact(value), source))
            .when(whole & (F.abs(value) < float("inf")), review("number", value, F.lit("integer_beyond_38_digits"), source))
            .when(value.isNotNull(), review("number", value, F.lit("fraction_in_integer"), source))
            .otherwise(missing(c["problem"], source))
        )

    return let(parsed, of)


def _exact(value: Column) -> Column:
    """A double without a fraction as the integer that it is, to the last digit."""
    large = F.abs(value) >= float(1 << 62)  # a multiple of 1024 then
    step = float(1 << 64)  # dividing by a power of two loses nothing
    high = F.floor(F.when(large, value) / step)
    low = ((F.when(large, value) - high.cast("double") * step) / 1024).cast("bigint")
    whole = high.cast("decimal(19,0)") * F.lit(Decimal(1 << 64)).cast("decimal(20,0)") + low.cast("decimal(19,0)") * F.lit(1024).cast("decimal(4,0)")
    return F.when(large, whole.cast("decimal(38,0)")).otherwise(value.try_cast("bigint").cast("decimal(38,0)"))


def _boolean(raw: Column, native: Column | None, options: TabularOptions, source: Column) -> Column:
    low = lambda v: [x.strip().casefold() for x in v]

    def of(text: Column) -> Column:
        value = F.when(text.isin(low(options.true_values)), F.lit(True)).when(text.isin(low(options.false_values)), F.lit(False))
        return value if native is None else F.when(native == "boolean", text == "true").otherwise(value)

    return let(let(casefold(strip(raw)), of), lambda v: extracted("boolean", v, F.lit(CONFIRMED), F.when(v.isNull(), "no_boolean"), source))


def _date(raw: Column, native: Column | None, options: TabularOptions, source: Column) -> Column:
    value = let(strip(raw), lambda t: parse_date(t, options.date_formats))
    if native is not None:
        value = F.when(native == "number", F.lit(None).cast("date")).when(native == "date", strip(raw).try_cast("date")).otherwise(value)
    return let(value, lambda v: extracted("date", v, F.lit(CONFIRMED), F.when(v.isNull(), "no_date"), source))


def interpret_cell(raw: Column, spec: ColumnSpec | FieldSpec, options: TabularOptions, source: Column | None = None, *, human_only: bool = False, native: Column | None = None, unreadable: Column | None = None) -> Column:
    """The extracted value of a cell: human-only fields first, then unreadable and blank cells, then by type."""
    kind = getattr(spec, "column_type", None) or getattr(spec, "value_type", "")
    source = no_evidence() if source is None else source
    if human_only:
        return missing(F.lit("human_only"), source)
    parts = {"raw": raw, "source": source} | {k: v for k, v in (("native", native), ("unreadable", unreadable)) if v is not None}

    def of(c: Column) -> Column:
        text, own, proof = c["raw"], None if native is None else c["native"], c["source"]
        if kind == "text":
            typed = _text(text, own, proof)
        elif kind in ("number", "integer"):
            typed = _number(text, own, options, proof, kind == "integer")
        elif kind == "date":
            typed = _date(text, own, options, proof)
        elif kind == "boolean":
            typed = _boolean(text, own, options, proof)
        else:
            typed = missing(F.lit("unknown_type"), proof)
        out = F.when(is_blank(text), missing(F.lit("blank_cell"), proof)).otherwise(typed)
        return out if unreadable is None else F.when(c["unreadable"].isNotNull(), missing(F.concat(F.lit("unreadable: "), c["unreadable"]), proof)).otherwise(out)

    out = let(F.struct(*[v.alias(k) for k, v in parts.items()]), of)
    if kind in ("number", "integer") and not human_only and native is None and unreadable is None:
        plain = (F.replace(raw, F.lit(","), F.lit(".")) if kind == "number" and options.decimal_separator == "," else raw).try_cast("double")
        known = confirmed("integer", plain.cast("decimal(38,0)"), source) if kind == "integer" else confirmed("number", plain, source)
        return F.when(F.regexp_like(raw, F.lit(_plain_pattern(kind == "integer", options))), known).otherwise(out)
    return out


def _plain_pattern(integer: bool, options: TabularOptions) -> str:
    """Cells that are a number by every rule as they stand, which most are: these need no reading of signs and groups."""
    digits = "-?[0-9]{1,15}"
    if not integer and options.decimal_separator == "," and "," not in options.group_separators:
        return rf"^{digits}(,[0-9]{{1,9}})?$"
    if integer or "." in options.group_separators or options.decimal_separator == ",":
        return f"^{digits}$"
    return rf"^{digits}(\.[0-9]{{1,9}})?$" if options.decimal_separator == "." else rf"^{digits}(\.([0-9]{{1,2}}|[0-9]{{4,9}}))?$"


__all__ = ["interpret_cell", "is_blank_cell", "parse_date", "parse_number"]
