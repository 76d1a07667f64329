"""Keeping a store up to date: only files whose hash changed are scanned again; names are resolved anew over the whole project, so an
incremental pass gives what a full one does."""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder
from ..sources import files, modules, store
from . import facts as fact_tables
from .facts import Facts
from .resolve import Resolution
from .typerefs import type_refs


@dataclass
class Result:
    added: int
    changed: int
    removed: int
    unchanged: int
    saved: bool
    counts: dict[str, int]

    def __str__(self) -> str:
        return f"{self.added} added, {self.changed} changed, {self.removed} removed, {self.unchanged} unchanged"


def packages(spark: SparkSession, root: str, every: DataFrame | None = None) -> dict[str, dict[str, Any]]:
    """Every package.json under root, by its folder; they are configuration, and few."""
    out = {}
    every = files.listing(spark, root, everything=True) if every is None else every
    for r in every.where(F.col("path").rlike(r"(^|/)package\.json$")).select("uri", "path").collect():
        try:
            out[modules.parent(r.path)] = json.loads(files.read_text(spark, r.uri) or "")
        except ValueError:
            continue
    return out


def known(spark: SparkSession, root: str) -> DataFrame:
    """The paths of all files under root, which imports may name."""
    return files.listing(spark, root, everything=True).select("path")


def resolver(spark: SparkSession, root: str, tsconfig: str | None) -> modules.Resolver:
    """From the configuration in the tree, whatever file system it is in."""
    return modules.resolver(tsconfig, lambda path: files.read_text(spark, f"{root.rstrip('/')}/{path}"), packages(spark, root))


def resolved(f: Facts) -> dict[str, DataFrame]:
    """f's tables, with links and type_refs."""
    r = Resolution(f)
    return f.tables() | {"links": r.calls(), "type_refs": type_refs(r)}


_PLAIN = ("symbols", "calls", "imports", "re_exports", "local_types", "local_bindings", "inline_returns")


def index_pass(spark: SparkSession, now: DataFrame, path: str, by: modules.Resolver, always: bool = False, known: DataFrame | None = None) -> Result:
    """now: the files (path, content, content_hash, length); known: paths that imports may name besides. Brings the store at path up to
    them; without a change nothing is saved, unless always."""
    old = store.load(spark, path)
    before = old["files"] if old else now.limit(0)
    shared_folder(spark)
    status = files.diff(before, now).checkpoint()  # a cache would be taken again by a later pass over the same paths
    s = files.summary(status).first()
    changed = s.added + s.changed + s.removed > 0
    if not changed and not always and old:
        return Result(s.added, s.changed, s.removed, s.unchanged, False, {})
    fresh = now.join(status.where("status in ('added', 'changed')").select("path"), "path", "left_semi")
    tables = fact_tables.extract(fresh)
    if old:
        stays = status.where("status = 'unchanged'").select(F.col("path").alias("_p"))
        for k in _PLAIN:
            own = F.regexp_replace("symbol_id", r"#[^#]*$", "") if k == "inline_returns" else F.col("file")
            kept = old[k].join(stays, own == F.col("_p"), "left_semi")
            tables[k] = tables[k].unionByName(kept.select(*tables[k].columns))
        tables["warnings"] = tables["warnings"].unionByName(old["warnings"].join(stays, F.col("path") == F.col("_p"), "left_semi"))
    built = resolved(fact_tables.build(now, by, known, facts=tables))
    store.save(spark, path, built)
    got = store.load(spark, path) or {}
    return Result(s.added, s.changed, s.removed, s.unchanged, True, {k: got[k].count() for k in ("symbols", "calls", "imports")})


def load_facts(tables: dict[str, DataFrame]) -> Facts:
    return Facts(**{k: v for k, v in tables.items() if k not in ("links", "type_refs")})
