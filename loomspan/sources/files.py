"""Trees of source files as DataFrames, content hashes, and differences of snapshots.

Spark's file sources pass over names that begin with _ or a dot, which are ordinary names of source files; so names are listed by the file
system itself, and contents of such files are read by the executors from it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that are not entered.
SKIPPED = ("node_modules", ".git", "dist", "build", "out", ".next", "coverage")


def included(path: Column) -> Column:
    """Of a path relative to the root: TypeScript, no declarations, in no skipped folder."""
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return path.rlike(r"\.tsx?$") & ~path.endswith(".d.ts") & ~F.exists(folders, lambda x: x.isin(*SKIPPED))


def relative(path: Column, root: str) -> Column:
    """path (a file's URI) relative to root."""
    plain = root.split(":", 1)[1] if ":" in root.split("/", 1)[0] else root
    return F.regexp_replace(F.regexp_replace(path, r"^[a-z]+:/*", "/"), "^" + "".join(f"\\{c}" if not c.isalnum() and c not in "/_" else c for c in "/" + plain.strip("/") + "/"), "")


_LISTED = "uri string, path string, modified long, length long"


def listing(spark: SparkSession, root: str, everything: bool = False) -> DataFrame:
    """uri, path (relative), modified, length of the source files under root; everything: of all files, in skipped folders too."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        raise FileNotFoundError(f"no folder {root}")
    home, todo, rows = fs.makeQualified(top).toString().rstrip("/") + "/", [top], []
    while todo:
        for x in fs.listStatus(todo.pop()):
            at = x.getPath()
            if x.isDirectory():
                if at.getName() != ".git" and (everything or at.getName() not in SKIPPED):
                    todo.append(at)
            else:
                uri = at.toString()
                rows.append((uri, uri.removeprefix(home), x.getModificationTime(), x.getLen()))
    found = spark.createDataFrame(rows, _LISTED)
    return found if everything else found.where(included(F.col("path")))


def _hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda x: x.rlike("^[_.]"))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    for batch in batches:
        for k, uri in enumerate(batch.column("uri").to_pylist()):
            if uri.startswith("file:"):
                at, path = fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
            else:
                at, path = fs.FileSystem.from_uri(uri)
            with at.open_input_stream(path) as f:
                content = f.read()
            yield pa.RecordBatch.from_arrays([batch.column("path").slice(k, 1), pa.array([content], pa.binary()), pa.array([len(content)], pa.int64())], ["path", "content", "length"])


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), content, content_hash, length of the source files under root."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,tsx}").load(root)
    own = raw.select(relative(F.col("path"), root).alias("path"), "content", "length")
    hidden = listing(spark, root).where(_hidden(F.col("path"))).select("uri", "path").mapInArrow(_contents, "path string, content binary, length long")
    return own.where(included(F.col("path")) & ~_hidden(F.col("path"))).unionByName(hidden).withColumn("content_hash", F.sha2("content", 256))


def signature(spark: SparkSession, root: str) -> tuple[int, int]:
    """A number that changes with any name, time or size of the source files under root, and how many there are."""
    row = listing(spark, root).agg(F.count("*"), F.bit_xor(F.xxhash64("path", "modified", "length"))).first()
    return int(row[0]), int(row[1] or 0)


def read_text(spark: SparkSession, path: str) -> str | None:
    """One small file, from whatever file system it is in; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
        return None
    stream = fs.open(at)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def hashes(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    return files.select(path, F.sha2(content, 256).alias("content_hash"))


def diff(old: DataFrame, new: DataFrame, key: str = "path", value: str = "content_hash") -> DataFrame:
    """key and status (added, changed, removed, unchanged) of two snapshots."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_a")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_b"))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def summary(differences: DataFrame) -> DataFrame:
    """One row: how many are added, changed, removed, unchanged."""
    return differences.agg(*(F.count_if(F.col("status") == x).alias(x) for x in ("added", "changed", "removed", "unchanged")))
