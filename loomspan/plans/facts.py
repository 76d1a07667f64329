"""Fact tables of a tree of TypeScript files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scanner import scan
from ..operators.graph import shared_folder
from ..sources import modules

_NAMED = "array<struct<name:string,type:string>>"
_IDS = "array<struct<local_name:string,remote_name:string,is_type_only:boolean>>"
SCHEMAS = {
    "symbols": f"id:string,kind:string,name:string,file:string,start_byte:bigint,end_byte:bigint,body_start_byte:bigint,is_default_export:boolean,return_type:string,parameters:{_NAMED},abstract:boolean,extends:array<string>,implements:array<string>,properties:{_NAMED},methods:array<struct<name:string,parameters:{_NAMED},return_type:string>>,alias_value:string",
    "calls": "call_id:string,caller_id:string,callee:string,receiver:string,expression:string,is_constructor:boolean,file:string,start_byte:bigint,end_byte:bigint",
    "imports": f"file:string,path:string,kind:string,namespace:string,identifiers:{_IDS},start_byte:bigint,end_byte:bigint",
    "re_exports": f"file:string,path:string,kind:string,namespace:string,bindings:{_IDS},start_byte:bigint,end_byte:bigint",
    "local_types": "symbol_id:string,file:string,local:string,type:string,origin:string",
    "local_bindings": "symbol_id:string,file:string,local:string,form:string,receiver:string,callee:string,property:string",
    "inline_returns": "symbol_id:string,property:string,new_type:string,local_var:string",
}


@dataclass
class Facts:
    """One project. files: path, content, content_hash, length; imports and re_exports have resolved."""

    files: DataFrame
    symbols: DataFrame
    calls: DataFrame
    imports: DataFrame
    re_exports: DataFrame
    local_types: DataFrame
    local_bindings: DataFrame
    inline_returns: DataFrame
    warnings: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


def _arrow(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """The facts of each file of files (path, content): tables by name, warnings among them. A file is scanned once; the tables are
    cut from one row per file."""
    spark = files.sparkSession
    shared_folder(spark)
    ddl = "path string, warnings array<string>, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in SCHEMAS.items())
    schema = _arrow(spark, ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path, **scan(content or b"", path)}], schema)

    whole = files.select("path", "content").mapInArrow(run, ddl).checkpoint()
    out = {k: whole.select(F.inline(k)) for k in SCHEMAS}
    return out | {"warnings": whole.select("path", F.explode("warnings").alias("warning"))}


def build(files: DataFrame, by: modules.Resolver, known: DataFrame | None = None, facts: dict[str, DataFrame] | None = None) -> Facts:
    """All facts of files, with specifiers resolved among the paths of files and known (path)."""
    got = facts or extract(files)
    paths = files.select("path") if known is None else files.select("path").union(known.select("path")).distinct()
    specs = got["imports"].select("file", "path").union(got["re_exports"].select("file", "path"))
    found = modules.resolve(specs, paths, by).checkpoint()
    edges: dict[str, Any] = {k: got[k].drop("resolved").join(found, ["file", "path"]) for k in ("imports", "re_exports")}
    return Facts(files=files, **(got | edges))
