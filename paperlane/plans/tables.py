"""From table files to records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from paperlane.config import CaptureConfig, TableSchema
from paperlane.errors import SourceUnreadable
from paperlane.functions.wire import VERSION
from paperlane.model import EXTRACTED, TABULAR, confirmed, evidence
from paperlane.operators import rows as R
from paperlane.operators.binding import bind
from paperlane.sources import selection
from paperlane.sources.text import delimited
from paperlane.sources.workbook import workbook

UNIT = "unit:"
_REFUSED = "relative_path string, error_class string, reason string"


@dataclass(frozen=True)
class Tables:
    """What a table load gives: ``rows`` (typed values), ``files`` (counts, units, diagnostics) and ``refused`` files."""

    rows: DataFrame
    files: DataFrame
    refused: DataFrame


def read_grid(grid: DataFrame, refused: DataFrame, schema: TableSchema, config: CaptureConfig, sheeted: bool = False) -> Tables:
    """A grid of header and data cells, bound, filtered, limited and interpreted."""
    options = config.tabular
    judged = grid.withColumn("binding", F.explode_outer(F.array(bind(F.col("headers"), schema, options))))  # conditions on it aren't pushed below, which would bind again
    unbound = judged.filter("binding.reason is not null").select("relative_path", "binding.error_class", "binding.reason")
    bound = judged.filter("binding.reason is null")
    data = R.raw_rows(bound)
    if not sheeted:
        data = data.withColumn("cells", R.as_cells(F.col("cells")))
    kept, counts = R.limited(data.withColumn("blank", R.is_blank_row(schema)), options.max_rows)
    done = R.interpreted(kept, schema, options, config.human_only_field_types, typed=sheeted)
    if sheeted:
        for c in schema.columns:
            item = F.col(f"values.`{c.key}`")
            place = F.concat(F.col("sheet"), F.lit("!"), item["evidence"]["locator"])
            moved = item.withField("evidence", item["evidence"].withField("locator", place))
            done = done.withColumn("values", F.col("values").withField(f"`{c.key}`", moved))
    notes = [
        F.col("notes"),
        F.col("binding_notes"),  # of the header
        F.array(F.when(F.col("first_unread").isNotNull(), F.concat(F.lit("truncated_before_row: "), F.col("first_unread").cast("string")))),
        F.array(F.when(F.col("skipped") > 0, F.concat(F.lit("blank_rows_skipped: "), F.col("skipped").cast("string")))),
    ]
    about = bound.select("relative_path", "content_hash", "notes", F.col("binding.notes").alias("binding_notes"), F.col("binding.columns").alias("columns"), F.col("binding.units").alias("units"), *(["sheet"] if sheeted else []))
    files = about.join(counts, "relative_path", "left")
    files = files.withColumns({"kept": F.coalesce("kept", F.lit(0)), "skipped": F.coalesce("skipped", F.lit(0))})
    files = files.withColumn("diagnostics", F.filter(F.concat(*notes), lambda n: n.isNotNull())).withColumn("truncated", F.col("first_unread").isNotNull())
    return Tables(done, files.drop("notes", "binding_notes"), refused.unionByName(unbound))


def load(spark: SparkSession, schema: TableSchema, config: CaptureConfig, paths: list[str] | None = None) -> Tables:
    """Every table file below the root (or the named ones): gated, read by its format, bound and interpreted."""
    named = selection.listed(config.input_root) if paths is None else [selection.require_relative(p) for p in paths]
    accepted, refused = selection.gate(spark.createDataFrame([(p,) for p in named], "relative_path string"), config, TABULAR)
    names = [r.relative_path for r in accepted.select("relative_path").collect()]  # file names only
    books = [n for n in names if n.lower().endswith(selection.WORKBOOKS)]
    texts = [n for n in names if n not in set(books)]
    empty = [n for n in texts if selection.is_empty(config.input_root, n)]  # Spark's file sources pass over these
    texts = [n for n in texts if n not in set(empty)]
    refused = refused.unionByName(spark.createDataFrame([(n, SourceUnreadable.__name__, "header_beyond_file") for n in empty], _REFUSED))
    parts = []
    if texts:
        parts.append(read_grid(*delimited(selection.files(spark, config.input_root, texts), config.tabular), schema, config))
    if books:
        grid, bad = workbook(spark, config.input_root, books, config.tabular, config.run_active_content)
        parts.append(read_grid(grid, bad, schema, config, sheeted=True))
    if not parts:
        nothing = spark.createDataFrame([], "relative_path string, content_hash string, headers array<string>, notes array<string>, data array<struct<row_no:int,cells:array<string>>>")
        parts.append(read_grid(nothing, spark.createDataFrame([], _REFUSED), schema, config))
    rows, files = parts[0].rows, parts[0].files
    for p in parts[1:]:
        rows, files = rows.unionByName(p.rows, allowMissingColumns=True), files.unionByName(p.files, allowMissingColumns=True)
    for p in parts:
        refused = refused.unionByName(p.refused)
    return Tables(rows, files, refused)


def records(tables: Tables, schema: TableSchema, header_row: int = 1) -> DataFrame:
    """One record for each file, its rows in order; units are fields with the header as evidence."""
    named = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c.key) for c in schema.columns]), F.array(*[F.col(f"values.`{c.key}`") for c in schema.columns])), lambda _, v: v.isNotNull())
    by_file = tables.rows.select("relative_path", "row_no", named.alias("row"), "needs_human").groupBy("relative_path")
    # maps don't sort; rows are put in order by number and then taken
    ordered = by_file.agg(F.collect_list(F.struct("row_no", "row")).alias("r"), F.bool_or("needs_human").alias("unsure"))
    sorted_rows = F.transform(F.array_sort("r", lambda a, b: a["row_no"] - b["row_no"]), lambda x: x["row"])
    files = tables.files.join(ordered.select("relative_path", sorted_rows.alias("rows"), "unsure"), "relative_path", "left")
    proof = evidence(F.col("relative_path"), F.col("content_hash"), F.lit(f"R{header_row}"))
    units = F.coalesce("units", F.create_map().cast("map<string,string>"))
    fields = F.transform_values(F.transform_keys(units, lambda k, _: F.concat(F.lit(UNIT), k)), lambda _, u: confirmed("text", u, proof, F.lit("unit_from_header")))
    return files.select(
        F.lit(VERSION).alias("contract_version"),
        F.lit(TABULAR).alias("input_kind"),
        evidence(F.col("relative_path"), F.col("content_hash")).alias("evidence"),
        fields.alias("fields"),
        F.coalesce("rows", F.array().cast(f"array<map<string,{EXTRACTED}>>")).alias("rows"),
        "diagnostics",
        F.coalesce("unsure", F.lit(False)).alias("needs_human"),
    )
