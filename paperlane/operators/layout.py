"""Page layout: reading order, columns that may have been merged, and whether a text layer can be used.

Fragments have doc, page, width, height, x_left, y_top, x_right, y_bottom and
text, in points from the top left corner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperlane.config import TextLayerOptions
from paperlane.errors import SourceUnreadable
from paperlane.functions.text import SPACE

ORDER = ("y_top", "x_left", "y_bottom", "x_right", "text")
USABLE, AMBIGUOUS, ABSENT = "usable", "ambiguous", "absent"


def flip(height: Column, y_low: Column, y_high: Column) -> tuple[Column, Column]:
    """(y_top, y_bottom) from coordinates that rise from the bottom of the page."""
    return height - y_high, height - y_low


def geometry_problem(df: DataFrame) -> Column:
    """What is wrong with a rectangle or its page, null where nothing is."""
    dpi = F.coalesce(F.col("source_dpi") <= 0, F.lit(False)) if "source_dpi" in df.columns else F.lit(False)
    return F.when(~((F.col("width") > 0) & (F.col("height") > 0)), "page_without_size").when(~((F.col("x_left") < F.col("x_right")) & (F.col("y_top") < F.col("y_bottom"))), "empty_rectangle").when(dpi, "no_resolution")


def reading_order(fragments: DataFrame) -> DataFrame:
    """``fragments`` with ``line_no`` from 1 on each page: from the top, then from the left."""
    return fragments.withColumn("line_no", F.row_number().over(W.partitionBy("doc", "page").orderBy(*ORDER)))


def merged_columns(fragments: DataFrame, options: TextLayerOptions) -> DataFrame:
    """Fragments that span so much of the page that they may hold two columns; flagged, never split."""
    ratio = (F.col("x_right") - F.col("x_left")) / F.col("width")
    return fragments.withColumn("span_ratio", ratio).filter(F.col("span_ratio") >= options.merged_span_ratio)


def page_probe(fragments: DataFrame) -> DataFrame:
    """(doc, page, chars, rects): characters that aren't white space, and rectangles; a null text is a page without any."""
    chars = F.length(F.regexp_replace("text", f"[{SPACE}]", ""))
    return fragments.groupBy("doc", "page").agg(F.coalesce(F.sum(chars), F.lit(0)).alias("chars"), F.count("text").alias("rects"))


def verdict(pages: DataFrame, options: TextLayerOptions) -> DataFrame:
    """(doc, verdict, mixed, pages, usable_pages, total_chars, total_rects, most_chars) of each document's text layer."""
    usable, some = F.col("chars") >= options.min_usable_chars, F.col("chars") >= options.ambiguous_from
    by_doc = pages.groupBy("doc").agg(
        F.count("page").alias("pages"),
        F.count_if(usable).alias("usable_pages"),
        F.count_if(some).alias("some"),
        F.sum("chars").alias("total_chars"),
        F.sum("rects").alias("total_rects"),
        F.max("chars").alias("most_chars"),
    )
    state = F.when(F.col("usable_pages") > 0, USABLE).when(F.col("some") > 0, AMBIGUOUS).otherwise(ABSENT)
    mixed = (F.col("usable_pages") > 0) & (F.col("usable_pages") < F.col("pages"))
    return by_doc.select("doc", state.alias("verdict"), mixed.alias("mixed"), "pages", "usable_pages", "total_chars", "total_rects", "most_chars")


def usable_only(fragments: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragments of usable documents, refused): what isn't clearly usable doesn't pass."""
    bad = verdicts.filter(F.col("verdict") != USABLE)
    refused = bad.select(F.col("doc").alias("relative_path"), F.lit(SourceUnreadable.__name__).alias("error_class"), F.concat(F.lit("text_layer_"), "verdict").alias("reason"))
    return fragments.join(verdicts.filter(F.col("verdict") == USABLE).select("doc"), "doc", "left_semi"), refused
