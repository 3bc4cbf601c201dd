"""Queries against their SQL over tables that hold what the given ones don't, and the short ways of common texts against the long ones."""

from pyspark.sql import functions as F

from paperlane.config import ColumnSpec, TabularOptions
from paperlane.functions import text as T, values as V
from paperlane.functions.text import lines_of
from paperlane.queries import ORACLE, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def test_line_scan_of_other_line_borders(spark, tmp_path):
    texts = ["", "\n", "\n\n", "a", "a\n", "a\n\n", "a\r\nb", "a\rb\r", "\r", "a\x0bb", "a\x0cb\x0c", "a\x1cb\x1dc\x1ed", "a\x85b", "a b ", " \n ", None, "a\nb\r\n\r\nc"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "d"))
    next((tmp_path / "d").glob("*.parquet")).rename(tmp_path / "documents.parquet")
    compare(spark, "line_scan", QUERIES["line_scan"], ORACLE["line_scan"], str(tmp_path))
    # what is read from files keeps every line border of Python
    got = docs.filter("text is not null").select("text", lines_of(F.col("text")).alias("l")).collect()
    assert [r.l for r in got] == [r.text.splitlines() for r in got]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_table_is_bound_once_for_each_result(spark):
    rows, files = (_plan(QUERIES[q](spark, SF)) for q in ("table_rows", "table_files"))
    bound = "required_column_missing: code"
    assert rows.count(bound) == 1 and files.count(bound) <= 2, (rows.count(bound), files.count(bound))


def test_json_is_made_and_parsed_once(spark):
    plan = _plan(QUERIES["wire_needs_human"](spark, SF))
    assert plan.count("from_json") == 1, plan.count("from_json")


def test_lines_are_normalised_once_for_detection_and_all_profiles(spark):
    plan = _plan(QUERIES["analyze_orders"](spark, SF))
    assert plan.count("lower(lambda") == 1 and "array_join(lines" not in plan, plan.count("lower(lambda")


def test_white_space_is_what_python_says(spark):
    spaces = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["​", "\x00", "\x7f"]
    texts = ["", "a", "  ", "a b", "a  b"] + [t for c in spaces for t in (c, f"{c}a", f"a{c}", f"a{c}b", f"é{c}{c}b{c}", f"{c}{c}", f"a {c}b")]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.strip(F.col("t")).alias("s"), T.collapse(F.col("t")).alias("c"), T.is_blank(F.col("t")).alias("b")).collect()
    assert [(r.s, r.c, r.b) for r in got] == [(r.t.strip(), " ".join(r.t.split()), not r.t.strip()) for r in got]


def test_labels_are_words_wherever_they_stand(spark):
    cases = {"tax: 1": 0, "tax": 0, "tax1": -1, "taxes, tax": 7, "a tax.": 2, "no": -1, "tax-": 0, "taxé": -1, "taxi tax": 5, "tax_1": 0}
    got = spark.createDataFrame([(t,) for t in cases], "t string").select("t", T.label_position(F.col("t"), "tax").alias("at")).collect()
    assert {r.t: r["at"] for r in got} == cases


def test_plain_cells_with_a_decimal_comma(spark):
    rows = spark.createDataFrame([(c,) for c in ["1,5", "-0,25", "12,345", "123456789012345,123456789", "1,2,3", ",5", "1,", "1.234,5", "-7", "1 234,5", "+1,5"]], "c string")
    for groups in (" '", " ."):
        options, spec = TabularOptions(decimal_separator=",", group_separators=groups), ColumnSpec("n", ("N",), "number")
        fast, slow = V.interpret_cell(F.col("c"), spec, options), V.interpret_cell(F.col("c"), spec, options, unreadable=F.lit(None).cast("string"))
        for r in rows.select("c", fast.alias("a"), slow.alias("b")).collect():
            assert r.a == r.b, (r, options)
