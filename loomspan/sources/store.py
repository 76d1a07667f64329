"""A project's tables as Parquet. A save writes a new version beside the last and then points to it, so readers never see half of one; the
last KEEP versions stay, for those that still read them."""

from __future__ import annotations

import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("files", "symbols", "calls", "imports", "re_exports", "local_types", "local_bindings", "inline_returns", "warnings", "links", "type_refs")
KEEP = 2


def save(spark: SparkSession, path: str, tables: dict[str, DataFrame], root: str = "") -> str:
    """Replaces the store at path with tables; returns the version's name."""
    version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark.createDataFrame([(version, root)], "version string, root string").coalesce(1).write.mode("append").parquet(f"{path}/versions")
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    written = sorted(x.getPath().getName() for x in fs.listStatus(top) if x.isDirectory() and x.getPath().getName()[:1].isdigit())
    for old in written[:-KEEP]:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old}"), True)
    return version


def load(spark: SparkSession, path: str) -> dict[str, DataFrame] | None:
    """The tables of the last version, None if there is none."""
    try:
        last = spark.read.parquet(f"{path}/versions").agg(F.max("version")).first()[0]
    except AnalysisException:
        return None
    out = {}
    for name in TABLES:
        try:
            out[name] = spark.read.parquet(f"{path}/{last}/{name}")
        except AnalysisException:
            continue
    return out
