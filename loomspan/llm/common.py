"""What the training-data operators share: the cluster's shared folder, tables cut off from their lineage, names that can't clash."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark deletes a query's shuffle files when it ends, not when the driver's garbage is collected.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where that is unset on one machine."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        root = getattr(sc, "_loomspan_dir", None)
        if not root:
            if not sc.master.split("[")[0] == "local":
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            root = sc._loomspan_dir = tempfile.mkdtemp(prefix="loomspan-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def _path(spark: SparkSession, at: str) -> tuple[object, object]:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that is deleted when the application ends, if it hasn't been before."""
    sc = spark.sparkContext
    home = f"{shared_dir(spark).rstrip('/')}/loomspan/{sc.applicationId}"
    if getattr(sc, "_loomspan_home", None) != home:
        fs, path = _path(spark, home)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        sc._loomspan_home = home
    return f"{home}/{uuid.uuid4().hex}/{label}"


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df, written as Parquet to the shared folder and read again: lost executors cost nothing that was done before this point. Texts go
    best as zstd; of tables of numbers Spark takes the files' size for that of the rows, so they stay less dense."""
    spark = df.sparkSession
    path, old = fresh_path(spark, label), spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, old)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomspan_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialized tables that nothing reads any more."""
    for df in frames:
        fs, path = _path(df.sparkSession, df._loomspan_path)
        fs.delete(path, True)


def join_spread(rows: DataFrame, table: DataFrame, keys: str | list[str], how: str = "inner", total: int | None = None, share: int = 1000) -> DataFrame:
    """rows joined by keys (inner, left or left_semi) with table, whose n says how many rows each of its keys has; both are written down.
    Keys with over a share of all rows (total; if not given, those of table), fewer than `share` by that, are joined where the rows are, so
    that no task gets all rows of such a key."""
    keys = [keys] if isinstance(keys, str) else keys
    least = (table.agg(F.sum("n")).first()[0] or 0 if total is None else total) / share
    hot = F.broadcast(table.where(F.col("n") > least))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(table.where(F.col("n") <= least), keys, how)
    return rows.join(hot, keys, "inner" if how == "left" else how).unionByName(rest)


def each(column: pa.Array, many: int = 64) -> Iterator[Any]:
    """The values of a column, a few at a time, so that a batch of texts isn't held twice."""
    for lo in range(0, len(column), many):
        yield from column.slice(lo, many).to_pylist()


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """The bytes of a column of texts."""
    return each(batch.column(name).cast(pa.binary()))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """A null text is an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def crc_bucket(name: str, parts: int) -> Column:
    """crc32 of the value as text, modulo parts; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("null")).cast("binary")) % parts


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then refers to it, also within lambdas: as a lambda's argument it is never
    copied into the places that use it, as the optimiser does with columns."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), 0)


def named(**fields: Column) -> Column:
    """A struct; names given this way stay within lambdas, too."""
    return F.named_struct(*(x for k, v in fields.items() for x in (F.lit(k), v)))


def with_struct(rows: DataFrame, value: Column) -> DataFrame:
    """rows with the struct's fields as columns; as a generator's they are computed once, and no filter is moved below them."""
    return rows.select("*", F.inline(F.array(value)))
