"""Document types by anchors: every profile is scored, a tie is refused."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from paperlane.config import Profile
from paperlane.functions.text import fold, normalize
from paperlane.model import CONFIRMED, REVIEW, extracted, let

MATCH = "struct<profile_id:string,matched_required:array<string>,matched_optional:array<string>,missing_required:array<string>,score:int,eligible:boolean>"


def haystack(lines: Column, how: str = "native", normal: Column | None = None) -> Column:
    """All lines as one normalised text; an anchor may span lines.  ``normal`` are the lines normalised, if they are at hand."""
    if normal is not None:
        return F.array_join(F.filter(normal, lambda n: n != ""), " ")
    return normalize(F.array_join(lines, "\n"), how)


def _hits(text: Column, anchors: tuple[str, ...], there: bool) -> Column:
    flags = [F.when((F.contains(text, F.lit(fold(a))) if fold(a) else F.lit(False)) == there, F.lit(a)) for a in anchors]
    found = F.array(*flags) if flags else F.array().cast("array<string>")
    return F.filter(found.cast("array<string>"), lambda a: a.isNotNull())


def score_profiles(text: Column, profiles: list[Profile]) -> Column:
    """The score sheet of a normalised text: one struct for each profile, as literal expressions without a join."""
    return let(text, lambda t: _sheet(t, profiles))


def _sheet(text: Column, profiles: list[Profile]) -> Column:
    sheets = []
    for p in profiles:
        required, optional, lacking = _hits(text, p.required_anchors, True), _hits(text, p.optional_anchors, True), _hits(text, p.required_anchors, False)
        score = (F.size(required) + F.size(optional)).cast("int")
        sheets.append(F.struct(F.lit(p.profile_id).alias("profile_id"), required.alias("matched_required"), optional.alias("matched_optional"), lacking.alias("missing_required"), score.alias("score"), (F.size(lacking) == 0).alias("eligible")))
    return F.array(*sheets).cast(f"array<{MATCH}>") if sheets else F.array().cast(f"array<{MATCH}>")


def decide(sheet: Column, source: Column | None = None) -> Column:
    """The profile as an extracted text: confirmed where it is the only candidate, to review where it beat others, missing on a tie or without any."""

    def of_eligible(eligible: Column) -> Column:
        top = F.array_max(F.transform(eligible, lambda m: m["score"]))
        return let(top, lambda t: let(F.filter(eligible, lambda m: m["score"] == t), lambda best: of_best(F.size(eligible), t, best)))

    def of_best(n: Column, top: Column, best: Column) -> Column:
        one = F.size(best) == 1
        names = F.array_join(F.array_sort(F.transform(best, lambda m: m["profile_id"])), ", ")
        note = (
            F.when(n == 0, F.lit("no_profile"))
            .when(~one, F.concat(F.lit("profile_tie: "), names))
            .when(n > 1, F.concat(F.lit("most_evidence_of_several: "), top.cast("string")))
        )
        return extracted("text", F.when(one, F.get(best, F.lit(0))["profile_id"]), F.when(n == 1, CONFIRMED).otherwise(REVIEW), note, source)

    return let(F.filter(sheet, lambda m: m["eligible"]), of_eligible)


def score_notes(sheet: Column) -> Column:
    """The score sheet as text: a count, then the profiles by falling score and rising id."""
    order = F.array_sort(F.transform(sheet, lambda m: F.struct((-m["score"]).alias("s"), m["profile_id"].alias("p"), m.alias("m"))))
    line = lambda x: F.concat(x["p"], F.lit(": "), F.when(x["m"]["eligible"], "candidate").otherwise("excluded"), F.lit(", anchors "), x["m"]["score"].cast("string"), F.when(F.size(x["m"]["missing_required"]) > 0, F.concat(F.lit(", lacking "), F.array_join(x["m"]["missing_required"], ", "))).otherwise(""))
    head = F.concat(F.size(sheet).cast("string"), F.lit(" profiles, "), F.size(F.filter(sheet, lambda m: m["eligible"])).cast("string"), F.lit(" candidates"))
    return F.concat(F.array(head), F.transform(order, line))
