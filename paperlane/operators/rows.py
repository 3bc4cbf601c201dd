"""Rows of bound tables: blank rows go, a limit is declared, cells become typed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from paperlane.config import TableSchema, TabularOptions
from paperlane.functions.values import interpret_cell, is_blank_cell
from paperlane.model import EVIDENCE, needs_human

CELL = "struct<raw:string,native:string,unreadable:string>"


def as_cells(cells: Column) -> Column:
    """Plain text cells in the form that typed sources give."""
    none = F.lit(None).cast("string")
    return F.transform(cells, lambda c: F.struct(c.alias("raw"), none.alias("native"), none.alias("unreadable")))


def raw_rows(bound: DataFrame) -> DataFrame:
    """One row for each data row of each bound table: its number, its cells, where the columns are."""
    keep = [c for c in ("relative_path", "content_hash", "sheet") if c in bound.columns]
    return bound.select(*keep, F.col("binding.columns").alias("columns"), F.explode("data").alias("d")).select(*keep, "columns", "d.row_no", "d.cells")


def cell_of(key: str) -> Column:
    """The cell of a key, null where the column isn't in the file or the row is short."""
    return F.get("cells", F.try_element_at("columns", F.lit(key)))


def is_blank_row(schema: TableSchema) -> Column:
    """Whether all identity cells are blank as read; without identity keys no row is, and keys that the file lacks don't count."""
    if not schema.identity_keys:
        return F.lit(False)
    blank = F.lit(True)
    for key in schema.identity_keys:
        cell = cell_of(key)
        blank = blank & (F.try_element_at("columns", F.lit(key)).isNull() | is_blank_cell(cell["raw"], cell["unreadable"]))
    return blank


def limited(rows: DataFrame, max_rows: int) -> tuple[DataFrame, DataFrame]:
    """(kept, counts): rows that aren't blank, up to ``max_rows`` of each file; counts: relative_path, kept, skipped, first_unread.

    ``rows`` has ``blank``.  A file is truncated where a row of any kind comes
    after its last kept one at the limit; blank rows count as skipped up to there.
    """
    if not max_rows:
        counts = rows.groupBy("relative_path").agg(F.count_if(~F.col("blank")).alias("kept"), F.count_if("blank").alias("skipped"), F.lit(None).cast("int").alias("first_unread"))
        return rows.filter(~F.col("blank")), counts
    order = W.partitionBy("relative_path").orderBy("row_no")
    full = F.sum(F.when(F.col("blank"), 0).otherwise(1)).over(order.rowsBetween(W.unboundedPreceding, -1)) >= max_rows
    seen = rows.withColumn("unread", F.coalesce(full, F.lit(False)))
    read = ~F.col("unread")
    counts = seen.groupBy("relative_path").agg(
        F.count_if(read & ~F.col("blank")).alias("kept"), F.count_if(read & F.col("blank")).alias("skipped"), F.min(F.when(F.col("unread"), F.col("row_no"))).alias("first_unread")
    )
    return seen.filter(read & ~F.col("blank")).drop("unread"), counts


def interpreted(rows: DataFrame, schema: TableSchema, options: TabularOptions, human_only: tuple[str, ...] = (), locator: str = "R%dC%d", typed: bool = True) -> DataFrame:
    """``rows`` with a struct ``values`` of one extracted value for each declared column that its file has, and ``needs_human``.

    Without ``typed`` all cells are text, as those of delimited files are, and are read as such.
    """
    items = []
    for c in schema.columns:
        at, cell = F.try_element_at("columns", F.lit(c.key)), cell_of(c.key)
        place = F.format_string(locator, F.col("row_no"), at + 1)
        proof = F.struct(F.col("relative_path").alias("relative_path"), F.col("content_hash").alias("content_hash"), place.alias("locator")).cast(EVIDENCE)
        source = {"native": cell["native"], "unreadable": cell["unreadable"]} if typed else {}
        value = interpret_cell(cell["raw"], c, options, proof, human_only=bool(c.field_type) and c.field_type in human_only, **source)
        items.append(F.when(at.isNotNull(), value).alias(c.key))
    done = rows.withColumn("values", F.struct(*items))
    sure = [F.coalesce(needs_human(F.col(f"values.`{c.key}`")), F.lit(False)) for c in schema.columns]
    unsure = sure[0]
    for s in sure[1:]:
        unsure = unsure | s
    return done.withColumn("needs_human", unsure)
