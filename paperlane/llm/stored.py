"""Tables written to shared storage, where lineage has to be cut.

A lost executor loses nothing that was written here: the files lie in the
folder that ``spark.checkpoint.dir`` names, which all executors share.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder where that is unset and the master is local."""
    said = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if said:
        return said.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            folder = tempfile.mkdtemp(prefix="paperlane-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL[app] = f"file://{folder}"
        return _LOCAL[app]
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def settle(spark: SparkSession, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder, in a folder for each value of ``by``, and read from there."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
