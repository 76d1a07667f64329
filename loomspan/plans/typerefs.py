"""Where symbols name types, and which declarations those names mean."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.typeexpr import PRIMITIVES, parse
from .facts import Facts
from .resolve import Resolution

_NODES = "symbol_id string, file string, slot string, node_path string, raw string, base_name string, is_array boolean, origin string"


def slots(facts: Facts, local_types: DataFrame) -> DataFrame:
    """symbol_id, file, slot, raw, origin: parameters, returns and locals of functions, parents, fields and values of the rest."""
    s = facts.symbols
    own = [F.col("id").alias("symbol_id"), "file"]

    def rows(kind: str, slot: F.Column, raw: F.Column, expanded: DataFrame | None = None) -> DataFrame:
        base = s.where(F.col("kind") == kind) if expanded is None else expanded
        return base.select(*own, slot.alias("slot"), raw.alias("raw"), F.lit("annotation").alias("origin"))

    def each(kind: str, column: str) -> DataFrame:
        return s.where(F.col("kind") == kind).select("id", "file", F.posexplode(column).alias("i", "x"))

    at = F.col("i").cast("string")
    parts = [
        rows("function", F.concat(F.lit("param:"), F.col("x.name")), F.col("x.type"), each("function", "parameters")),
        rows("function", F.lit("return"), F.col("return_type")),
        rows("class", F.lit("extends"), F.get("extends", F.lit(0))),
        rows("class", F.concat(F.lit("implements:"), at), F.col("x"), each("class", "implements")),
        rows("class", F.concat(F.lit("property:"), F.col("x.name")), F.col("x.type"), each("class", "properties")),
        rows("interface", F.concat(F.lit("extends:"), at), F.col("x"), each("interface", "extends")),
        rows("interface", F.concat(F.lit("property:"), F.col("x.name")), F.col("x.type"), each("interface", "properties")),
        rows("type_alias", F.lit("value"), F.col("alias_value")),
        local_types.select("symbol_id", "file", F.concat(F.lit("local:"), "local").alias("slot"), F.col("type").alias("raw"), "origin"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.where("raw is not null and trim(raw) != ''")


def nodes(refs: DataFrame) -> DataFrame:
    """A row for each node of the types' trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"symbol_id": r["symbol_id"], "file": r["file"], "slot": r["slot"], "node_path": n.path, "raw": n.raw, "base_name": n.base_name, "is_array": n.is_array, "origin": n.origin} for r in batch.to_pylist() for n in parse(r["raw"], r["origin"])]
            names = ("symbol_id", "file", "slot", "node_path", "raw", "base_name", "is_array", "origin")
            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], pa.bool_() if k == "is_array" else pa.string()) for k in names})

    return refs.mapInArrow(run, _NODES)


def type_refs(resolution: Resolution) -> DataFrame:
    """nodes() with targets: every declaration that a base name means as a class, interface, alias or enum, in this order."""
    tree = nodes(slots(resolution.facts, resolution.local_types)).checkpoint()
    asked = tree.where((F.col("base_name") != "") & ~F.col("base_name").isin(*PRIMITIVES)).select(F.concat_ws("|", "file", "base_name").alias("ref"), "file", F.col("base_name").alias("name")).distinct().checkpoint()
    found = None
    for k, kind in enumerate(("class", "interface", "type_alias", "enum")):
        own = resolution.find(asked, kind).select("ref", F.struct(F.lit(k).alias("k"), "target").alias("t"))
        found = own if found is None else found.unionByName(own)
    targets = found.groupBy("ref").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["target"]).alias("targets"))
    joined = tree.withColumn("ref", F.concat_ws("|", "file", "base_name")).join(targets, "ref", "left")
    return joined.select("symbol_id", "slot", "node_path", "raw", "base_name", "is_array", "origin", F.coalesce("targets", F.array().cast("array<string>")).alias("targets"))
