"""Files analysed as they arrive: the same plans over a stream, each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from paperlane.config import CaptureConfig, Profile
from paperlane.functions.wire import record_json
from paperlane.model import TEXT_LAYER
from paperlane.plans.documents import analyze
from paperlane.sources.selection import content_hash
from paperlane.sources.text import lines


def arrivals(spark: SparkSession, folder: str, glob: str = "*.txt", most_files: int = 1000) -> DataFrame:
    """(relative_path, content_hash, content, arrived) of new files in ``folder`` and below; the path is relative to it."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    read = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).load(folder)
    plain = F.regexp_replace("path", "^file:/+", "/")
    base = folder.removeprefix("file://").rstrip("/") + "/"
    at = F.instr(plain, F.lit(base))
    name = F.when(at > 0, F.substring(plain, at + len(base), 1 << 30)).otherwise(F.element_at(F.split("path", "/"), -1))
    return read.select(name.alias("relative_path"), content_hash(F.col("content")).alias("content_hash"), "content", F.col("modificationTime").alias("arrived"))


def documents(stream: DataFrame, profiles: list[Profile], config: CaptureConfig, delay: str = "1 day") -> DataFrame:
    """Records of a stream of files; a content that came within ``delay`` before is dropped."""
    fresh = stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["content_hash"])
    return analyze(lines(fresh, config.tabular.encoding_candidates), profiles, config, TEXT_LAYER)


def write_json(records: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Records as lines of JSON below ``folder``, exactly once."""
    line = record_json(F.struct(*[F.col(c) for c in records.columns])).alias("value")
    return records.select(line).writeStream.format("text").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").start()
