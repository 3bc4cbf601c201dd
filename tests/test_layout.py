import pytest

from paperlane.config import TextLayerOptions
from paperlane.errors import SourceUnreadable
from paperlane.operators import layout as L
from paperlane.plans.pages import read_lines

FRAGMENT = "doc string, page int, width double, height double, x_left double, y_top double, x_right double, y_bottom double, text string"


def frame(spark, *rows):
    return spark.createDataFrame([(d, p, 600.0, 800.0, x, y, x + w, y + 10.0, t) for d, p, x, y, w, t in rows], FRAGMENT)


def test_lines_of_usable_documents(spark):
    long = "x" * 40
    f = frame(spark, ("a", 2, 0.0, 5.0, 10.0, "third"), ("a", 1, 50.0, 5.0, 10.0, "second"), ("a", 1, 0.0, 5.0, 10.0, long), ("a", 3, 0.0, 0.0, 600.0, None), ("b", 1, 0.0, 0.0, 400.0, "stamp of a scanner 12"), ("c", 1, 0.0, 0.0, 9.0, None), ("d", 1, 0.0, 0.0, 0.0, "flat"))
    lines, suspicions, refused = read_lines(f, TextLayerOptions())
    assert [(r.doc, r.lines) for r in lines.collect()] == [("a", [long, "second", "third"])]
    assert {(r.relative_path, r.reason) for r in refused.collect()} == {("b", "text_layer_ambiguous"), ("c", "text_layer_absent"), ("d", "empty_rectangle")}
    assert suspicions.count() == 0
    v = {r.doc: r for r in L.verdict(L.page_probe(f), TextLayerOptions()).collect()}
    assert v["a"].mixed and v["a"].pages == 3 and v["b"].total_chars == 17 and v["b"].most_chars == 17


def test_merged_columns(spark):
    f = frame(spark, ("a", 1, 0.0, 0.0, 360.0, "wide"), ("a", 1, 0.0, 0.0, 359.0, "narrow"))
    assert [r.text for r in L.merged_columns(f, TextLayerOptions()).collect()] == ["wide"]


def test_page_files_need_their_library(spark):
    from paperlane.sources.pages import fragments

    try:
        import pypdfium2  # noqa: F401
    except ImportError:
        with pytest.raises(SourceUnreadable):
            fragments(spark.createDataFrame([], "relative_path string, content_hash string, content binary"))
