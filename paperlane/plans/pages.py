"""From page fragments to ordered lines: probe, gate, order, flatten."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from paperlane.config import TextLayerOptions
from paperlane.operators import layout as L


def read_lines(fragments: DataFrame, options: TextLayerOptions) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, suspicions, refused) of ``fragments``.

    lines: doc and the texts of all its pages in reading order, for documents
    of which the text layer can be used; suspicions: fragments that may hold
    merged columns; refused: the other documents.  A document with a broken
    rectangle is refused whole and not read.
    """
    problem = L.geometry_problem(fragments)
    judged = fragments.withColumn("problem", problem)
    broken = judged.filter("problem is not null").select(F.col("doc").alias("relative_path"), F.lit("SourceUnreadable").alias("error_class"), F.col("problem").alias("reason")).distinct()
    sound = fragments.join(broken.select(F.col("relative_path").alias("doc")).distinct(), "doc", "left_anti")
    verdicts = L.verdict(L.page_probe(sound), options)
    usable, refused = L.usable_only(sound, verdicts)
    texts = usable.filter("text is not null")
    at = F.struct("page", "y_top", "x_left", "y_bottom", "x_right", "text")
    lines = texts.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(at)), lambda f: f["text"]).alias("lines"))
    return lines, L.merged_columns(texts, options), refused.unionByName(broken)
