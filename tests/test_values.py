import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from paperlane.config import ColumnSpec, TabularOptions
from paperlane.errors import Configuration
from paperlane.functions import text as T
from paperlane.functions.values import interpret_cell, is_blank_cell, parse_number

NBSP = " "
PLAIN = TabularOptions()


def cells(spark, rows, kind, options=PLAIN, native=False, unreadable=False, **how):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, raw string, native string, unreadable string")
    item = interpret_cell(F.col("raw"), ColumnSpec("k", ("K",), kind), options, native=F.col("native") if native else None, unreadable=F.col("unreadable") if unreadable else None, **how)
    return [r.item for r in df.withColumn("item", item).orderBy("i").collect()]


def numbers(spark, texts, options=PLAIN):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, raw string").withColumn("p", parse_number(F.col("raw"), options))
    return [(r.p.number, r.p.problem) for r in df.orderBy("i").collect()]


def reference_number(text, options):
    """The rules, step by step."""
    text = text.strip()
    sign = 1
    if text[:1] in "+-" and text:
        sign = -1 if text[0] == "-" else 1
        text = text[1:].strip()
    for c in options.group_separators:
        text = text.replace(c, "")
    dots, commas = text.count("."), text.count(",")
    if dots and commas:
        decimal = "." if text.rfind(".") > text.rfind(",") else ","
        text = text.replace("," if decimal == "." else ".", "").replace(decimal, ".")
    elif dots or commas:
        own, many = (".", dots) if dots else (",", commas)
        if options.decimal_separator:
            text = text.replace(own, "." if own == options.decimal_separator else "")
        elif many > 1:
            text = text.replace(own, "")
        else:
            head, tail = text.split(own)
            if head.isdigit() and tail.isdigit() and 1 <= len(head) <= 3 and len(tail) == 3:
                return None
            text = text.replace(own, ".")
    if "_" in text or not text.isascii():
        return None
    try:
        return sign * float(text)
    except ValueError:
        return None


def test_golden_numbers(spark):
    ambiguous = ["1,234", "12,345", "123,456", "1.234"]
    assert numbers(spark, ambiguous) == [(None, "ambiguous_number")] * 4
    assert numbers(spark, ["1,234"], TabularOptions(decimal_separator=",")) == [(1.234, None)]
    assert numbers(spark, ["1,234"], TabularOptions(decimal_separator=".")) == [(1234.0, None)]
    good = {"1.234,56": 1234.56, "1,234.56": 1234.56, "1.234.567,89": 1234567.89, "1.234.567": 1234567.0, "1 234 567": 1234567.0, "1'234'567": 1234567.0, f"1{NBSP}234": 1234.0, "12,5": 12.5, "1234.567": 1234.567, "-1.234,5": -1234.5, "+ 5": 5.0, "--5": 5.0, "1e5": 100000.0, ".5": 0.5, "5.": 5.0}
    assert numbers(spark, list(good)) == [(v, None) for v in good.values()]
    assert numbers(spark, ["kb. 5", "12%", "N/A", "1 234 Ft", "", "5d", "0x1", "1_000", "e5", "."]) == [(None, "no_number")] * 10
    (nan, _), (inf, _) = numbers(spark, ["nan", "-Infinity"])
    assert math.isnan(nan) and inf == -math.inf


@pytest.mark.parametrize("decimal", ["", ".", ","])
def test_random_numbers_against_the_rules(spark, decimal):
    rng = random.Random(decimal)
    options = TabularOptions(decimal_separator=decimal)
    texts = ["".join(rng.choice("0123456789.,,.  -+e'x") for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    for text, (got, _) in zip(texts, numbers(spark, texts, options), strict=True):
        assert got == reference_number(text, options), text


def test_integers(spark):
    a, b, c, d, e = cells(spark, [("42", None, None), ("12,5", None, None), ("1e30", None, None), ("inf", None, None), ("x", None, None)], "integer", TabularOptions(decimal_separator=","))
    assert (a.value_type, a.integer, a.confidence) == ("integer", 42, "confirmed")
    assert (b.value_type, b.number, b.confidence) == ("number", 12.5, "needs_review")
    assert c.integer == int(1e30) and d.confidence == "needs_review" and e.confidence == "missing"


def test_native_cells(spark):
    rows = [("1.2345678901234567e+20", "number", None), ("9007199254740993", "number", None), ("123.0", "number", None), ("12.5", "number", None), ("True", "boolean", None), (" x ", None, None), ("2026-07-30", "date", None)]
    got = cells(spark, rows, "text", native=True)
    assert [g.text for g in got] == ["1.2345678901234567e+20", "9007199254740993", "123", "12.5", "True", "x", "2026-07-30"]
    assert [g.confidence for g in got] == ["needs_review"] * 3 + ["confirmed"] * 4
    number = cells(spark, rows, "number", native=True)
    assert number[3].number == 12.5 and number[4].note == "boolean_is_no_number" and number[6].confidence == "missing"
    assert cells(spark, [("0", "number", None)], "number", native=True)[0].number == 0.0
    assert cells(spark, [("False", "boolean", None)], "boolean", native=True)[0].boolean is False
    assert cells(spark, [("2026-07-30", "date", None)], "date", native=True)[0].date == dt.date(2026, 7, 30)


def test_dates_and_booleans(spark):
    day = dt.date(2026, 7, 5)
    assert [c.date for c in cells(spark, [("2026-07-05", None, None), ("2026-7-5", None, None), ("05.07.2026", None, None), ("2026-02-30", None, None), ("20260705", None, None)], "date")] == [day, day, None, None, None]
    two = TabularOptions(date_formats=("%d.%m.%Y", "%Y/%m/%d", "%y%m%d"))
    assert [c.date for c in cells(spark, [("5.7.2026", None, None), (" 2026/07/05 ", None, None), ("260705", None, None), ("990705", None, None)], "date", two)] == [day, day, day, dt.date(1999, 7, 5)]
    with pytest.raises(Configuration):
        cells(spark, [], "date", TabularOptions(date_formats=("%B",)))
    words = TabularOptions(true_values=("igen", "x"), false_values=("nem",))
    assert [c.boolean for c in cells(spark, [("IGEN", None, None), (" nem", None, None), ("true", None, None)], "boolean", words)] == [True, False, None]


def test_order_of_refusals(spark):
    rows = [("secret", None, "why"), ("x", None, "why"), (None, None, "why"), (f" {NBSP}\t", None, None), (None, None, None)]
    assert {c.note for c in cells(spark, rows, "text", unreadable=True, human_only=True)} == {"human_only"}
    assert [c.note for c in cells(spark, rows, "text", unreadable=True)] == ["unreadable: why"] * 3 + ["blank_cell"] * 2
    for kind in ("text", "number", "integer", "date", "boolean"):
        for c in cells(spark, rows, kind):
            assert (c.confidence == "missing") == (c.value_type is None) == all(c[k] is None for k in ("text", "number", "integer", "date", "boolean"))
    df = spark.createDataFrame([("",), ("0",), (None,)], "raw string")
    assert [r[0] for r in df.select(is_blank_cell(F.col("raw"))).collect()] == [True, False, True]


def test_text_functions(spark):
    texts = ["Ádó  ALAP\n\tx", "Straße ﬁn", "ÅNGSTRÖM ½", "", None, "plain Text", "été"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for how in ("native", "exact"):
        got = [r[1] for r in df.select("i", T.normalize(F.col("t"), how)).orderBy("i").collect()]
        assert got == [None if t is None else T.fold(t) for t in texts]
    lines = spark.createDataFrame([("ado: 27000",), ("adoalap: 100000",), ("kiadoi koltseg: 5",), ("netto ado osszege: 5",), ("kiado ado",)], "t string")
    assert [r[0] for r in lines.select(T.label_position(F.col("t"), "ado")).collect()] == [0, -1, -1, 6, 6]
    many = "a\r\nb\rc d\u0085e\x0bf\n"
    assert spark.createDataFrame([(many,), ("",)], "t string").select(T.lines_of(F.col("t"))).collect()[0][0] == many.splitlines()
    for glob, name, fits in (("~$*", "~$a.xlsx", True), ("*.bak", "a.csv.bak", True), ("[!a]?", "bx", True), ("*.tmp", "a.tmp/b", False), ("x/*", "x/y/z", True)):
        import re

        assert bool(re.match(T.glob_pattern(glob), name)) == fits
