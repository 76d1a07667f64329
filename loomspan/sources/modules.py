"""Which file an import's specifier names: candidates in order of precedence, of which the first that is a file counts.

Relative specifiers are final. Then '#' subpath imports, path aliases (longest pattern first), and packages. All paths are relative to the
project's root; in Spark, candidates are rows that join the table of paths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_path
from .jsonc import loads

#: Fixed values, in order: what a specifier may lack, and what a folder's file is called.
EXTENSIONS = ("", ".ts", ".tsx", ".d.ts", ".cts", ".mts", ".js", ".jsx", ".cjs", ".mjs")
CONDITIONS = ("types", "import", "default")


def parent(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else ""


def join(*parts: str) -> str:
    return clean_path("/".join(x for x in parts if x))


def probes(base: str) -> list[str]:
    """The files that base may stand for."""
    return [base + x for x in EXTENSIONS] + [join(base, "index" + x) for x in EXTENSIONS[1:]]


def _filled(pattern: str, star: str | None) -> str:
    return pattern if star is None else pattern.replace("*", star)


def _by_pattern(table: dict[str, Any], key: str) -> tuple[Any, str | None] | None:
    """The entry of key: an exact one, or the pattern with the longest text before its star."""
    if key in table:
        return table[key], None
    best = None
    for pattern, value in table.items():
        before, star, after = pattern.partition("*")
        if star and key.startswith(before) and key.endswith(after) and len(key) >= len(before) + len(after) and (best is None or len(before) > best[0]):
            best = (len(before), value, key[len(before) : len(key) - len(after)])
    return None if best is None else (best[1], best[2])


def _conditional(value: Any) -> str | None:
    """The first of the conditions that leads to a path."""
    if isinstance(value, str):
        return value
    if isinstance(value, list):
        return next((x for x in map(_conditional, value) if x), None)
    if isinstance(value, dict):
        return next((x for c in CONDITIONS if c in value and (x := _conditional(value[c]))), None)
    return None


def by_exports(exports: Any, subpath: str) -> str | None:
    """Where a package's exports field leads for '.' or './sub'."""
    if isinstance(exports, dict) and any(k.startswith(".") for k in exports):
        found = _by_pattern(exports, subpath)
        target = _conditional(found[0]) if found else None
        return None if target is None else _filled(target, found[1])
    return _conditional(exports) if subpath == "." else None


@dataclass
class Resolver:
    """base: the folder that path targets are relative to; paths: alias patterns; packages: folder -> its package.json."""

    base: str = ""
    paths: dict[str, list[str]] = field(default_factory=dict)
    packages: dict[str, dict[str, Any]] = field(default_factory=dict)

    def candidates(self, file: str, spec: str) -> list[str]:
        here = parent(file)
        if spec.startswith(("./", "../")) or spec in (".", ".."):
            return probes(join(here, spec))
        if spec.startswith("#"):
            at: str | None = here
            while at is not None:
                imports = self.packages.get(at, {}).get("imports")
                if imports and (found := _by_pattern(imports, spec)) and (target := _conditional(found[0])):
                    return probes(join(at, _filled(target, found[1])))
                at = parent(at) if at else None
            return []
        out: list[str] = []
        for pattern in sorted(self.paths, key=lambda p: (-len(p), p)):
            before, star, after = pattern.partition("*")
            if spec == pattern if not star else spec.startswith(before) and spec.endswith(after) and len(spec) >= len(before) + len(after):
                middle = spec[len(before) : len(spec) - len(after)] if star else None
                for target in self.paths[pattern]:
                    out += probes(join(self.base, target.replace("*", middle, 1) if middle is not None else target))
        return out + self._package(here, spec)

    def _package(self, here: str, spec: str) -> list[str]:
        parts = spec.split("/")
        name = "/".join(parts[: 2 if spec.startswith("@") else 1])
        rest, out, at = spec[len(name) + 1 :], [], here
        while True:
            home = join(at, "node_modules", name)
            package = self.packages.get(home)
            if package is not None and package.get("exports") is not None:
                target = by_exports(package["exports"], f"./{rest}" if rest else ".")
                out += probes(join(home, target)) if target else []
            else:
                if package is not None and not rest:
                    out += [x for k in ("types", "typings", "main") if isinstance(package.get(k), str) for x in probes(join(home, package[k]))]
                out += probes(join(home, rest))
            if not at:
                return out
            at = parent(at)


def read_config(path: str, read: Any, seen: frozenset[str] = frozenset()) -> dict[str, Any]:
    """baseUrl and paths of a tsconfig and those it extends; the child's win; a missing parent or a cycle is ignored.
    read(path) gives a file's text, or None."""
    text = read(path)
    if text is None or path in seen:
        return {}
    try:
        raw = loads(text)
    except ValueError:
        return {}
    out: dict[str, Any] = {}
    parents = raw.get("extends") or []
    for x in [parents] if isinstance(parents, str) else parents:
        for at in (join(parent(path), x), join(parent(path), x + ".json"), join("node_modules", x), join("node_modules", x, "tsconfig.json")):
            if read(at) is not None:
                out |= read_config(at, read, seen | {path})
                break
    options = raw.get("compilerOptions") or {}
    if "baseUrl" in options:
        out["base"] = join(parent(path), options["baseUrl"])
    if "paths" in options:
        out |= {"paths": options["paths"], "base": out.get("base", parent(path)) if "baseUrl" in options or "base" in out else parent(path)}
    return out


def resolver(config: str | None, read: Any, packages: dict[str, dict[str, Any]] | None = None) -> Resolver:
    found = read_config(config, read) if config else {}
    return Resolver(found.get("base", ""), found.get("paths", {}), packages or {})


def resolve(specs: DataFrame, paths: DataFrame, by: Resolver) -> DataFrame:
    """Distinct (file, path) of specs with resolved, the file among paths (path) that it names, '' if none."""

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files, names = batch.column("file").to_pylist(), batch.column("path").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("path"), pa.array([by.candidates(f, p) for f, p in zip(files, names, strict=True)], pa.list_(pa.string()))], ["file", "path", "candidates"])

    own = specs.select("file", "path").distinct()
    rows = own.mapInArrow(ranked, "file string, path string, candidates array<string>").select("file", "path", F.posexplode("candidates").alias("rank", "resolved"))
    found = rows.join(paths.select(F.col("path").alias("resolved")), "resolved").groupBy("file", "path").agg(F.min_by("resolved", "rank").alias("resolved"))
    return own.join(found, ["file", "path"], "left").fillna("", ["resolved"])
