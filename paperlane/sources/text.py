"""Plain text and delimited files: decoding, lines, delimiters and cells, without leaving the JVM for UTF-8."""

from __future__ import annotations

import codecs

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from paperlane.config import TabularOptions
from paperlane.errors import SourceUnreadable
from paperlane.functions.text import lines_of


def decode(content: Column, encodings: tuple[str, ...]) -> Column:
    """The text by the first encoding that decodes strictly, null where none does."""
    names = [codecs.lookup(e).name for e in encodings]
    if set(names) <= {"utf-8", "utf-8-sig"}:
        text = F.try_validate_utf8(content.cast("string"))
        if "utf-8-sig" in names and (names.index("utf-8-sig") == 0):
            text = F.regexp_replace(text, r"\A\x{FEFF}", "")
        return text

    @F.arrow_udf("string")
    def run(blobs: pa.Array) -> pa.Array:
        out = []
        for blob in blobs.to_pylist():
            text = None
            for name in names if blob is not None else ():
                try:
                    text = blob.decode(name)
                    break
                except UnicodeDecodeError:
                    continue
            out.append(text)
        return pa.array(out, pa.string())

    return run(content)


def lines(files: DataFrame, encodings: tuple[str, ...] = TabularOptions().encoding_candidates) -> DataFrame:
    """(relative_path, content_hash, lines, reason): the lines of every file, or why there are none."""
    text = decode(F.col("content"), encodings)
    return files.select("relative_path", "content_hash", text.alias("text")).select("relative_path", "content_hash", lines_of(F.col("text")).alias("lines"), F.when(F.col("text").isNull(), "undecodable").alias("reason"))


def delimiter_counts(header: Column, candidates: tuple[str, ...]) -> list[Column]:
    return [F.length(header) - F.length(F.replace(header, F.lit(c), F.lit(""))) for c in candidates]


def detect_delimiter(header: Column, candidates: tuple[str, ...]) -> tuple[Column, Column, Column]:
    """(delimiter, problem, others): the most frequent candidate of a header line, refused where two tie or none is there."""
    counts = delimiter_counts(header, candidates)
    most = F.greatest(*counts) if len(counts) > 1 else counts[0]
    ties = sum((F.when(c == most, 1).otherwise(0) for c in counts[1:]), F.when(counts[0] == most, 1).otherwise(0))
    problem = F.when(header.isNull() | (most == 0), "no_delimiter").when(ties > 1, "delimiter_tie")
    chosen = F.coalesce(*[F.when(c == most, F.lit(d)) for c, d in zip(counts, candidates, strict=True)])
    delimiter = F.when(problem.isNull(), chosen)
    others = F.filter(F.array(*[F.when((c > 0) & (F.lit(d) != delimiter), F.lit(d)) for c, d in zip(counts, candidates, strict=True)]), lambda x: x.isNotNull())
    return delimiter, problem, others


def split_cells(line: Column, delimiter: Column) -> Column:
    """The cells of one line; a cell in quotes may hold the delimiter, and two quotes for one."""
    quoted = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    pattern = F.concat(quoted, F.lit('("(?:[^"]|"")*+"(?='), quoted, F.lit("|$)|[^"), quoted, F.lit("]*+)"))
    cells = F.regexp_extract_all(F.concat(delimiter, line), pattern, 1)
    plain = lambda c: F.when((F.length(c) >= 2) & c.startswith('"') & c.endswith('"'), F.replace(F.substring(c, 2, F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.when(line == "", F.array().cast("array<string>")).otherwise(F.transform(cells, plain))


def delimited(files: DataFrame, options: TabularOptions) -> tuple[DataFrame, DataFrame]:
    """(grid, refused): each file's header cells, notes and data rows, one line for one row.

    grid: relative_path, content_hash, headers, notes, data (row_no, cells).
    Rows are numbered from 1 over the file's lines.
    """
    read = lines(files, options.encoding_candidates)
    header = F.get(F.col("lines"), F.lit(options.header_row - 1))
    if options.delimiter:
        mark, problem, others = F.lit(options.delimiter), F.lit(None).cast("string"), F.array().cast("array<string>")
    else:
        mark, problem, others = detect_delimiter(header, options.delimiter_candidates)
    begun = read.withColumns({"header": header, "mark": mark, "others": others, "problem": problem})
    begun = begun.withColumn("headers", split_cells(F.col("header"), F.col("mark")))
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("header").isNull(), "header_beyond_file")
        .when(F.col("problem").isNotNull(), F.col("problem"))
        .when(F.size("headers") < 2, "single_column")
    )
    judged = begun.withColumn("why", reason)
    refused = judged.filter("why is not null").select("relative_path", F.lit(SourceUnreadable.__name__).alias("error_class"), F.col("why").alias("reason"))
    skip = options.header_row + options.data_starts_after_header
    rest = F.slice("lines", F.lit(skip + 1), F.greatest(F.size("lines") - skip, F.lit(0)))
    data = F.transform(rest, lambda line, k: F.struct((k + skip + 1).alias("row_no"), split_cells(line, F.col("mark")).alias("cells")))
    notes = F.transform("others", lambda c: F.concat(F.lit("also_in_header: "), c))
    grid = judged.filter("why is null").select("relative_path", "content_hash", "headers", notes.alias("notes"), data.alias("data"))
    return grid, refused
