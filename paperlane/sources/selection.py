"""Which files are taken, by which way, and how they are identified."""

from __future__ import annotations

import posixpath
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from paperlane.config import CaptureConfig
from paperlane.errors import Configuration, SourceUnreadable
from paperlane.functions.text import glob_pattern

WORKBOOKS = (".xlsx", ".xlsm", ".xltx", ".xltm")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def is_excluded(path: Column, patterns: tuple[str, ...]) -> Column:
    """Whether a name pattern fits the file's name or its whole relative path; case counts."""
    whole = F.replace(path, F.lit("\\"), F.lit("/"))
    out = F.lit(False)
    for glob in patterns:
        pattern = F.lit(glob_pattern(glob))
        out = out | F.regexp_like(base_name(path), pattern) | F.regexp_like(whole, pattern)
    return out


def extension(path: Column) -> Column:
    """The last suffix in lower case, '' where there is none; a leading dot begins no suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def route(path: Column, routing: dict[str, str]) -> Column:
    """The input kind of a file by its extension, null where it isn't supported."""
    out = F.lit(None).cast("string")
    for suffix, kind in routing.items():
        out = F.when(extension(path) == suffix, kind).otherwise(out)
    return out


def gate(files: DataFrame, config: CaptureConfig, kind: str, path: str = "relative_path") -> tuple[DataFrame, DataFrame]:
    """(accepted, refused): refused rows have error_class and reason."""
    name = F.col(path)
    way = route(name, config.extension_routing)
    reason = F.when(is_excluded(name, config.excluded_name_patterns), "excluded_name").when(way.isNull(), "unsupported_extension").when(way != kind, F.concat(F.lit("routed_to_"), way))
    judged = files.withColumn("reason", F.when(name.isNull(), "no_path").otherwise(reason))
    refused = judged.filter("reason is not null").select(name.alias("relative_path"), F.lit(SourceUnreadable.__name__).alias("error_class"), "reason")
    return judged.filter("reason is null").drop("reason"), refused


def require_relative(path: str) -> str:
    """``path`` with forward slashes; absolute paths, drives and parent steps are refused."""
    plain = path.replace("\\", "/")
    if not plain or plain.startswith("/") or re.match(r"^[A-Za-z]:", plain) or ".." in plain.split("/"):
        raise Configuration("a source path is relative and stays below its root")
    return posixpath.normpath(plain)


def resolve_source(root: str, path: str) -> str:
    """The file that a relative path names below ``root``; links that lead out of it are refused."""
    top = Path(root).resolve()
    found = (top / require_relative(path)).resolve()
    if not found.is_relative_to(top):
        raise SourceUnreadable("the path leads out of its root")
    if not found.is_file():
        raise SourceUnreadable("there is no such file")
    return str(found)


def listed(root: str) -> list[str]:
    """The relative paths of all files below ``root``, in order."""
    top = Path(root).resolve()
    return sorted(p.relative_to(top).as_posix() for p in top.rglob("*") if p.is_file())


def is_empty(root: str, path: str) -> bool:
    return Path(resolve_source(root, path)).stat().st_size == 0


def content_hash(content: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(content, 256))


def files(spark: SparkSession, root: str, paths: list[str] | None = None, glob: str = "*") -> DataFrame:
    """(relative_path, content_hash, content) of the files below ``root``, or of the named ones; hashed once, in the scan."""
    top = str(Path(root).resolve())
    if paths is None:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(top)
    else:
        found = spark.read.format("binaryFile").load([resolve_source(root, p).replace("[", "\\[").replace("{", "\\{").replace("*", "\\*").replace("?", "\\?") for p in paths])
    inside = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(top.rstrip("/") + "/"), "")
    return found.select(inside.alias("relative_path"), content_hash(F.col("content")).alias("content_hash"), "content")
