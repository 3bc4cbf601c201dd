"""Labelled fields from lines: the longest label claims a line, its value follows on the line or on the next with text.

Lines stay one array for each document and all of it is array expressions:
there is no join and no shuffle, and documents of any number are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperlane.config import FieldSpec, TabularOptions
from paperlane.functions.text import fold, is_blank, label_position, normalize, strip, value_after
from paperlane.functions.values import interpret_cell
from paperlane.model import REVIEW, append_note, changed, has_value, let, located, missing

HIT = "struct<line_no:int,value:string,label:string>"


def label_used(normal: Column, spec: FieldSpec) -> Column:
    """Of a field's labels, in declared order, the number of the first that stands in the line; null without one."""
    out = F.lit(None).cast("int")
    for k, label in reversed(list(enumerate(spec.labels))):
        needle = fold(label)
        if needle:
            out = F.when(label_position(normal, needle) >= 0, k).otherwise(out)
    return out


def _length(used: Column, spec: FieldSpec) -> Column:
    return F.coalesce(F.element_at(F.array(*[F.lit(len(fold(x))) for x in spec.labels]), used + 1), F.lit(0))


def claims(lines: Column, specs: tuple[FieldSpec, ...], how: str = "native", normal: Column | None = None) -> Column:
    """For each line a struct: normal, used (label number of each field, null) and best (length of the longest label there); ``normal`` are the lines normalised, if they are at hand."""
    normals = F.transform(lines, lambda x: normalize(x, how)) if normal is None else normal

    def used(normal: Column) -> Column:
        return F.struct(normal.alias("normal"), F.array(*[label_used(normal, s) for s in specs]).alias("used"))

    def sized(c: Column) -> Column:
        sizes = F.array(*[_length(F.get(c["used"], F.lit(k)), s) for k, s in enumerate(specs)])
        return F.struct(c["normal"].alias("normal"), c["used"].alias("used"), sizes.alias("sizes"))

    def best(c: Column) -> Column:
        return F.struct(c["normal"].alias("normal"), c["used"].alias("used"), c["sizes"].alias("sizes"), F.array_max(c["sizes"]).alias("best"))

    return F.transform(F.transform(F.transform(normals, used), sized), best)


def hits(lines: Column, claimed: Column, k: int, spec: FieldSpec) -> Column:
    """The values found for field ``k``, in the order of their lines."""
    labels, needles = (F.array(*[F.lit(x) for x in v]) for v in (spec.labels, [fold(x) for x in spec.labels]))

    def of_line(c: Column, i: Column) -> Column:
        used = F.get(c["used"], F.lit(k)) + 1
        label = F.element_at(labels, used)
        own = value_after(F.get(lines, i), c["normal"], label, F.element_at(needles, used))
        hit = lambda no, value: F.struct(no.cast("int").alias("line_no"), value.alias("value"), label.alias("label"))
        following = F.slice(lines, i + 2, F.size(lines))
        nxt = F.get(F.filter(F.transform(following, lambda x, j: F.struct(j.alias("j"), x.alias("x"))), lambda p: ~is_blank(p["x"])), F.lit(0))
        found = let(own, lambda v: F.when(v != "", hit(i + 1, v)).otherwise(let(nxt, lambda n: hit(i + n["j"] + 2, strip(n["x"])))))
        return F.when((F.get(c["sizes"], F.lit(k)) == c["best"]) & (c["best"] > 0), found)

    return F.filter(F.transform(claimed, of_line), lambda h: h.isNotNull() & h["value"].isNotNull())


def field(found: Column, spec: FieldSpec, options: TabularOptions, source: Column | None = None, human_only: bool = False, locator: str = "L%d") -> Column:
    """The extracted value of a field from its hits: the first counts, others that differ make it one to review."""
    first = F.get(found, F.lit(0))
    place = F.format_string(locator, first["line_no"])
    read = interpret_cell(first["value"], spec, options, located(source, place), human_only=human_only)
    several = F.size(F.array_distinct(F.transform(found, lambda h: h["value"]))) > 1
    listed = F.array_join(F.transform(found, lambda h: F.format_string("L%d=%s", h["line_no"], h["value"])), "; ")

    def of(item: Column) -> Column:
        note = append_note(item["note"], F.concat(F.lit("label_with_several_values: "), listed))
        return F.when(several & has_value(item), changed(item, confidence=F.lit(REVIEW), note=note)).otherwise(item)

    return F.when(F.size(found) == 0, missing(F.lit("label_not_found"), source)).otherwise(let(read, of))


def field_note(found: Column, item: Column, spec: FieldSpec) -> Column:
    """What is said about a field: a required one that isn't there, or one with several values; null otherwise."""
    values = F.size(F.array_distinct(F.transform(found, lambda h: h["value"])))
    several = F.concat(F.lit(f"ambiguous_field: {spec.key} "), F.array_join(F.transform(found, lambda h: F.format_string("L%d", h["line_no"])), ", "))
    out = F.when((values > 1) & has_value(item), several)
    return F.when(F.size(found) == 0, f"required_field_missing: {spec.key}").otherwise(out) if spec.required else out
