"""Text and numbers that have to be exactly those of the definition."""

import random
import unicodedata

from pyspark.sql import functions as F

from paperlane.config import ColumnSpec, TabularOptions, TextLayerOptions
from paperlane.functions import text as T, values as V
from paperlane.operators.rules import number_text
from paperlane.plans.pages import read_lines


def test_number_text(spark):
    rng = random.Random(1)
    xs = [0.0123456, 0.00012345, 99999.95, 1e400, -1e400, float("nan"), 0.0, -0.0, 999999.5, 1e6, 123456.0, 1e-5, 1e100, -1.5e-7, 0.1 + 0.2, 2.5]
    xs += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 12) for _ in range(2000)] + [round(rng.uniform(0, 10**6), rng.randint(0, 6)) for _ in range(2000)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", number_text(F.col("x")).alias("s")).collect()
    assert [r.s for r in got] == [f"{r.x:.6g}" for r in got]


def test_casefold_of_every_code_point_and_folding_of_the_first_plane(spark):
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    got = spark.createDataFrame([("a" + c + "b",) for c in chars], "t string").select("t", T.casefold(F.col("t")).alias("c"), T.normalize(F.col("t")).alias("n")).collect()
    assert [r.c for r in got] == [r.t.casefold() for r in got]

    def native(char):
        plain = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).casefold()
        return ord(char) < 0x10000 and (len(plain) <= 1 or 0xAC00 <= ord(char) < 0xD7A4)

    checked = [r for r in got if native(r.t[1:-1])]
    assert [r.n for r in checked] == [T.fold(r.t) for r in checked] and len(checked) > 60_000


def test_integers_to_the_last_digit(spark):
    xs = [1e30, -1e30, 2.0**62, -(2.0**62), 2.0**63, 9.99e37, -9.99e37, 42.0, -3.0, 2.0**53 + 2, 1e22, -(2.0**64)]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(V._exact(F.col("x")).alias("d")).collect()
    assert [int(r.d) for r in got] == [int(x) for x in xs]
    cell = V.interpret_cell(F.lit("1e39"), ColumnSpec("n", ("N",), "integer"), TabularOptions(decimal_separator="."))
    got = spark.range(1).select(cell.alias("v")).first().v
    assert (got.value_type, got.number, got.confidence, got.note) == ("number", 1e39, "needs_review", "integer_beyond_38_digits")


def test_plain_cells_read_as_the_long_way_reads_them(spark):
    cells = ["7", "-7", "007", "1.5", "1.234", "12.3456", "1234.567", "-0", "1.", ".5", "123456789012345", "1234567890123456", "1,5", "+3", " 4", "1.2.3"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string")
    for separator in ("", ".", ","):
        for groups in (" \'", " ."):
            if separator and separator in groups:
                continue
            options = TabularOptions(decimal_separator=separator, group_separators=groups)
            for kind in ("number", "integer"):
                spec = ColumnSpec("n", ("N",), kind)
                fast, slow = V.interpret_cell(F.col("c"), spec, options), V.interpret_cell(F.col("c"), spec, options, unreadable=F.lit(None).cast("string"))
                for r in rows.select("c", fast.alias("a"), slow.alias("b")).collect():
                    assert r.a == r.b, (r, options, kind)


def test_a_document_with_a_broken_rectangle_is_not_read(spark):
    page = (1, 600.0, 800.0)
    rows = [("u", *page, 10.0, 10.0, 100.0, 20.0, "long enough to be usable " * 4), ("u", *page, 50.0, 30.0, 50.0, 40.0, "broken"), ("v", *page, 10.0, 10.0, 100.0, 20.0, "long enough to be usable " * 4)]
    parts = spark.createDataFrame(rows, "doc string, page int, width double, height double, x_left double, y_top double, x_right double, y_bottom double, text string")
    lines, merged, refused = read_lines(parts, TextLayerOptions())
    assert [r.doc for r in lines.collect()] == ["v"] and [(r.relative_path, r.reason) for r in refused.collect()] == [("u", "empty_rectangle")]
