"""Arithmetic rules over extracted fields: verify, derive or back-compute, never correct.

A rule is folded over columns: later rules see what earlier ones derived.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from paperlane.config import Rule
from paperlane.model import MISSING, REVIEW, append_note, changed, extracted, has_value, let, numeric

NEAR_ZERO = 1e-12
OUTCOME = "struct<rule_name:string,status:string,detail:string>"
OK, VIOLATION, DERIVED, NOT_RUN = "ok", "violation", "derived", "not_run"


def combine(values: list[Column], operation: str) -> Column:
    if operation == "product":
        return reduce(lambda a, b: a * b, values)
    if len(values) == 2:
        return values[0] + values[1]
    # compensated, so that a sum of several doubles doesn't depend on their order
    total, lost = values[0], F.lit(0.0)
    for v in values[1:]:
        nxt = total + v
        lost = lost + F.when(F.abs(total) >= F.abs(v), (total - nxt) + v).otherwise((v - nxt) + total)
        total = nxt
    return total + lost


def invert(left: Column, known: list[Column], operation: str) -> Column:
    """The operand that is missing; null where it would be a division by nothing."""
    if operation == "sum":
        return left - combine(known, "sum") if len(known) > 1 else left - known[0]
    by = combine(known, "product")
    return F.when(F.abs(by) >= NEAR_ZERO, left / by)


def number_text(x: Column) -> Column:
    """A number with six significant digits, without the zeros that end it, rounded by its exact binary value as C's ``%.6g`` does.

    Of numbers from a million on, one exactly between two others may take the other.
    """
    shown = lambda pattern: F.call_function("format_number", x, F.lit(pattern))

    def long(scientific: Column) -> Column:
        parts = F.struct(F.substring_index(scientific, "E", 1).alias("digits"), F.substring_index(scientific, "E", -1).try_cast("int").alias("size"))
        return let(parts, lambda c: sized(c["digits"], c["size"]))

    def sized(digits: Column, size: Column) -> Column:
        exponent = F.concat(F.when(size < 0, "e-").otherwise("e+"), F.when(F.abs(size) < 100, F.lpad(F.abs(size).cast("string"), 2, "0")).otherwise(F.abs(size).cast("string")))
        out = F.when(size < -4, F.concat(digits, exponent))
        for k in range(-4, 6):
            out = out.when(size == k, shown("0." + "#" * (5 - k) if k < 5 else "0"))
        return out.otherwise(F.concat(digits, exponent))

    out = F.when(F.isnan(x), "nan").when(x == float("inf"), "inf").when(x == float("-inf"), "-inf").when(x == 0, F.when(x.cast("string").startswith("-"), "-0").otherwise("0"))
    out = out.when((F.abs(x) < 1e6) & (x % 1 == 0), x.try_cast("bigint").cast("string"))  # most are
    return out.when(x.isNotNull(), let(shown("0.#####E0"), long))


def flagged(item: Column, note: Column) -> Column:
    """To review with ``note``; what is missing stays missing."""
    return changed(item, confidence=F.when(item["confidence"] == MISSING, MISSING).otherwise(REVIEW), note=append_note(item["note"], note))


def derived(item: Column, value: Column, note: Column) -> Column:
    """A computed number in place of ``item``: always to review, with the evidence that was there."""
    return extracted("number", value, F.lit(REVIEW), note, item["evidence"])


def apply_rule(df: DataFrame, rule: Rule, tolerance: float, prefix: str = "", outcome: str = "outcome") -> DataFrame:
    """``df`` with the rule applied to its columns of extracted values, and a column of its outcome."""
    at = lambda k: F.col(f"`{prefix}{k}`")
    operands = list(dict.fromkeys(rule.operands))  # one that is named twice counts once
    left, values = numeric(at(rule.left)), [numeric(at(k)) for k in operands]
    absent = reduce(lambda a, b: a + b, [F.when(v.isNull(), 1).otherwise(0) for v in values])
    limit = rule.tolerance if rule.tolerance is not None else tolerance
    right = combine(values, rule.operation)
    gap = F.abs(left - right)
    known = left.isNotNull() & (absent == 0)
    breaks = known & (gap > limit) & ~F.isnan(gap)
    name = F.lit(rule.name)
    state = (
        F.when(breaks, VIOLATION)
        .when(known, OK)
        .when(F.lit(not rule.derive), "off")
        .when(left.isNull() & (absent == 0), "left")
        .when(left.isNotNull() & (absent == 1), "operand")
        .otherwise("many")
    )
    judged = df.withColumns({"__state": state, "__left": left, "__right": right, "__gap": gap, "__absent": F.coalesce(*[F.when(v.isNull(), F.lit(k)) for k, v in zip(operands, values, strict=True)])})
    back = [invert(F.col("__left"), [v for j, v in enumerate(values) if j != i], rule.operation) for i in range(len(operands))] if len(operands) > 1 else [F.col("__left")]
    judged = judged.withColumn("__back", F.coalesce(*[F.when((F.col("__state") == "operand") & v.isNull(), b) for v, b in zip(values, back, strict=True)]))
    status, found = F.col("__state"), F.col("__back")
    cols = {}
    how = (" x " if rule.operation == "product" else " + ").join(operands)
    sums = F.concat(name, F.lit(": left="), number_text(F.col("__left")), F.lit(", right="), number_text(F.col("__right")), F.lit(", gap="), number_text(F.col("__gap")), F.lit(f" (tolerance {limit:g}), not corrected"))
    item = at(rule.left)
    cols[f"{prefix}{rule.left}"] = F.when(status == VIOLATION, flagged(item, sums)).when(status == "left", derived(item, F.col("__right"), F.lit(f"{rule.name}: derived from {how}, not read"))).otherwise(item)
    for k, v in zip(operands, values, strict=True):
        item = at(k)
        cols[f"{prefix}{k}"] = (
            F.when(status == VIOLATION, flagged(item, F.lit(f"{rule.name}: part of an equation that doesn't hold")))
            .when((status == "operand") & v.isNull() & found.isNotNull(), derived(item, found, F.lit(f"{rule.name}: computed back from {rule.left}, not read")))
            .otherwise(item)
        )
    shown = (
        F.when(status == VIOLATION, F.concat(F.lit(f"{rule.left}="), number_text(F.col("__left")), F.lit(f" vs {how}="), number_text(F.col("__right")), F.lit(", gap "), number_text(F.col("__gap")), F.lit(f" > {limit:g}")))
        .when(status == OK, F.concat(F.lit(f"{rule.left}="), number_text(F.col("__left")), F.lit(", gap "), number_text(F.col("__gap"))))
        .when(status == "off", "a value is missing and deriving is off")
        .when(status == "left", F.concat(F.lit(f"{rule.left} = "), number_text(F.col("__right"))))
        .when((status == "operand") & found.isNull(), F.concat(F.lit("division by zero for "), F.col("__absent")))
        .when(status == "operand", F.concat(F.col("__absent"), F.lit(" = "), number_text(found)))
        .otherwise("too many values are missing")
    )
    final = F.when(status.isin(VIOLATION, OK), status).when((status == "left") | ((status == "operand") & found.isNotNull()), DERIVED).otherwise(NOT_RUN)
    cols[outcome] = F.struct(name.alias("rule_name"), final.alias("status"), shown.alias("detail")).cast(OUTCOME)
    return judged.withColumns(cols).drop("__state", "__left", "__right", "__gap", "__absent", "__back")


def apply_rules(df: DataFrame, rules: tuple[Rule, ...], tolerance: float, prefix: str = "", outcomes: str = "outcomes") -> DataFrame:
    """All rules in order; ``outcomes`` is the array of theirs."""
    names = []
    for k, rule in enumerate(rules):
        names.append(f"__outcome{k}")
        df = apply_rule(df, rule, tolerance, prefix, names[-1])
    return df.withColumn(outcomes, (F.array(*names) if names else F.array()).cast(f"array<{OUTCOME}>")).drop(*names)


def outcome_notes(outcomes: Column) -> Column:
    """Outcomes as text, violations first."""
    line = lambda o: F.concat(o["rule_name"], F.lit(": "), o["status"], F.lit(" ("), o["detail"], F.lit(")"))
    bad = F.filter(outcomes, lambda o: o["status"] == VIOLATION)
    rest = F.filter(outcomes, lambda o: o["status"] != VIOLATION)
    return F.transform(F.concat(bad, rest), line)


__all__ = ["apply_rule", "apply_rules", "combine", "derived", "flagged", "has_value", "invert", "number_text", "outcome_notes"]
