"""The part of a project that matters for one symbol: what it calls, what calls it, the types it reaches, and how files import it.

Searches run in Spark, level by level; of a level at most `max_per_level` symbols are kept, so a slice is bounded and is put together on the
driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..operators import graph
from .facts import Facts


@dataclass(frozen=True)
class Options:
    caller_depth: int = 1
    callee_depth: int = 1
    type_depth: int = 0
    caller_body_depth: int = 1
    callee_body_depth: int = 1
    max_per_level: int = 50

    def __post_init__(self) -> None:
        if min(vars(self).values()) < 0:
            raise ValueError("depth and cap flags must be non-negative")


@dataclass
class Entry:
    symbol: dict[str, Any]
    depth: int
    sites: list[dict[str, Any]] = field(default_factory=list)
    body: bool = False
    origins: list[str] = field(default_factory=list)


@dataclass
class Chain:
    """How a file imports the target: its name there, the target's own, and the statements along the way."""

    file: str
    local: str
    target: str
    trail: list[dict[str, Any]]


@dataclass
class Slice:
    target: dict[str, Any]
    enclosing: dict[str, Any] | None
    imports: list[dict[str, Any]] | None
    callees: list[Entry]
    callers: list[Entry]
    types: list[Entry]
    chains: list[Chain]
    sources: dict[str, bytes]
    functions: dict[str, list[dict[str, Any]]]
    classes: dict[str, list[dict[str, Any]]]

    def text(self, file: str, start: int, end: int) -> str:
        return self.sources[file][start:end].decode("utf-8", "replace")

    def source_of(self, s: dict[str, Any]) -> str:
        return self.text(s["file"], s["start_byte"], s["end_byte"])

    def signature(self, s: dict[str, Any]) -> str:
        """A function's head; any other symbol's name."""
        if s["kind"] == "function" and s["start_byte"] < s["body_start_byte"] <= s["end_byte"]:
            return self.text(s["file"], s["start_byte"], s["body_start_byte"]).strip()
        return str(s["name"])

    def class_of(self, s: dict[str, Any]) -> dict[str, Any] | None:
        held = [c for c in self.classes.get(s["file"], []) if c["start_byte"] <= s["start_byte"] and s["end_byte"] <= c["end_byte"]]
        return min(held, key=lambda c: (c["end_byte"] - c["start_byte"], c["start_byte"])) if held else None


def _dicts(rows: list[Row]) -> list[dict[str, Any]]:
    return [r.asDict(True) for r in rows]


def class_header(c: dict[str, Any]) -> str:
    """A class without its code."""
    head = ("abstract " if c["abstract"] else "") + f"class {c['name']}"
    head += f" extends {c['extends'][0]}" if c["extends"] and c["extends"][0] else ""
    head += f" implements {', '.join(c['implements'])}" if c["implements"] else ""
    typed = lambda x: x["name"] + (f": {x['type']}" if x["type"] else "")
    fields = [f"    {typed(p)};" for p in c["properties"]]
    methods = [f"    {m['name']}({', '.join(map(typed, m['parameters']))}){': ' + m['return_type'] if m['return_type'] else ''};" for m in c["methods"]]
    return "\n".join([head + " {", *fields, *methods, "}"])


def mentions(text: str, name: str) -> bool:
    """name occurs in text as a whole identifier."""
    mark = lambda c: c.isascii() and (c.isalnum() or c in "_$")
    at = text.find(name) if name else -1
    while at >= 0:
        end = at + len(name)
        if not (at and mark(text[at - 1])) and not (end < len(text) and mark(text[end])):
            return True
        at = text.find(name, at + 1)
    return False


def _search(edges: DataFrame, symbols: DataFrame, target: str, depth: int, cap: int, functions: bool) -> list[tuple[str, int]]:
    on = symbols.where("kind = 'function'").select("id") if functions else symbols.select("id")
    return [(r["id"], r["depth"]) for r in graph.reach(edges, [target], depth, cap, goes_on=on).collect()] if depth else []


def _entries(found: list[tuple[str, int]], symbols: DataFrame, target: str, links: DataFrame, near: str, far: str, calls: DataFrame, body_depth: int) -> list[Entry]:
    if not found:
        return []
    by_id = {r["id"]: r for r in _dicts(symbols.where(F.col("id").isin([i for i, _ in found])).collect())}
    level = dict(found) | {target: 0}
    pairs = links.where(F.col(far).isin(list(level)) & F.col(near).isin(list(level))).join(calls.drop("caller_id"), "call_id").collect()
    out = []
    for i, depth in found:
        if i in by_id:
            sites = {r["call_id"]: r.asDict(True) for r in sorted(pairs, key=lambda r: (r[near], r["start_byte"])) if r[far] == i and level[r[near]] == depth - 1}
            out.append(Entry(by_id[i], depth, list(sites.values()), depth <= body_depth))
    return sorted(out, key=lambda e: (e.depth, e.symbol["id"]))


def _exports(facts: Facts, files: set[str]) -> dict[str, list[dict[str, Any]]]:
    """Re-exports, in source order, of files and of all that these lead to; a query a hop."""
    found: dict[str, list[dict[str, Any]]] = {}
    while files:
        found |= {f: [] for f in files}
        for r in _dicts(facts.re_exports.where(F.col("file").isin(sorted(files)) & (F.col("resolved") != "")).orderBy("file", "start_byte").collect()):
            found[r["file"]].append(r)
        files = {x["resolved"] for f in files for x in found[f]} - set(found)
    return found


def _trail(exports: dict[str, list[dict[str, Any]]], file: str, name: str, target: dict[str, Any]) -> list[dict[str, Any]] | None:
    """The statements of the first way, in depth and in source order, from file's name to the target; None if there is none."""
    names = {target["name"], "default"} if target["is_default_export"] else {target["name"]}
    seen: set[tuple[str, str]] = set()
    way: list[dict[str, Any]] = []

    def steps(at: str, own: str) -> Iterator[tuple[dict[str, Any], str]]:
        for x in exports.get(at, []):
            if x["bindings"]:
                remote = next((b["remote_name"] for b in x["bindings"] if b["local_name"] == own), None)
            else:
                remote = None if x["namespace"] else own
            if remote is not None:
                yield x, remote

    open_ = [iter([({"resolved": file}, name)])]
    while open_:
        hop = next(open_[-1], None)
        if hop is None:
            open_.pop()
            if way:
                way.pop()
            continue
        at, own = hop[0]["resolved"], hop[1]
        if (at, own) in seen:
            continue
        seen.add((at, own))
        way.append(hop[0])
        if at != target["file"]:
            open_.append(steps(at, own))
        elif own in names:
            return [{"file": x["file"], "start_byte": x["start_byte"], "end_byte": x["end_byte"]} for x in way[1:]]
        else:
            way.pop()
    return None


def _chains(facts: Facts, target: dict[str, Any], files: list[str]) -> list[Chain]:
    """For each file the first import, in source order, that leads to the target, over re-exports of any kind; of an import its names come
    before its namespace."""
    if not files:
        return []
    imports = _dicts(facts.imports.where(F.col("file").isin(files) & (F.col("resolved") != "")).orderBy("file", "start_byte").collect())
    exports = _exports(facts, {x["resolved"] for x in imports})
    out: dict[str, Chain] = {}
    for x in imports:
        asked = [(b["local_name"], b["remote_name"]) for b in x["identifiers"]] + [(x["namespace"], target["name"])] * bool(x["namespace"])
        for local, remote in asked if x["file"] not in out else []:
            rest = _trail(exports, x["resolved"], remote, target)
            if rest is not None:
                out[x["file"]] = Chain(x["file"], local, target["name"], [{"file": x["file"], "start_byte": x["start_byte"], "end_byte": x["end_byte"]}, *rest])
                break
    return [out[f] for f in sorted(out)]


def extract(facts: Facts, links: DataFrame, target_id: str, options: Options = Options(), type_refs: DataFrame | None = None) -> Slice:  # noqa: B008
    """links: call_id, caller_id, target_id. Unknown ids and modules are errors."""
    got = _dicts(facts.symbols.where(F.col("id") == target_id).collect())
    if not got:
        raise ValueError(f"no symbol {target_id}")
    target = got[0]
    if target["kind"] == "module":
        raise ValueError(f"{target_id} is a module, not a symbol to extract")
    forth = links.select(F.col("caller_id").alias("src"), F.col("target_id").alias("dst"))
    back = links.select(F.col("target_id").alias("src"), F.col("caller_id").alias("dst"))
    callees = _entries(_search(forth, facts.symbols, target_id, options.callee_depth, options.max_per_level, True), facts.symbols, target_id, links, "caller_id", "target_id", facts.calls, options.callee_body_depth) if target["kind"] == "function" else []
    callers = _entries(_search(back, facts.symbols, target_id, options.caller_depth, options.max_per_level, True), facts.symbols, target_id, links, "target_id", "caller_id", facts.calls, options.caller_body_depth)
    types: list[Entry] = []
    if options.type_depth and type_refs is not None:
        edges = type_refs.select(F.col("symbol_id").alias("src"), F.explode("targets").alias("dst"), F.when(F.col("origin") == "", "annotation").otherwise(F.col("origin")).alias("origin"))
        found = graph.reach(edges, [target_id], options.type_depth, options.max_per_level, ["origin"]).collect()
        by_id = {r["id"]: r for r in _dicts(facts.symbols.where(F.col("id").isin([r["id"] for r in found])).collect())} if found else {}
        types = [Entry(by_id[r["id"]], r["depth"], origins=list(r["origin"])) for r in sorted(found, key=lambda r: (r["depth"], r["id"])) if r["id"] in by_id]
    near = {e.symbol["file"] for e in [*callees, *callers, *types]} - {target["file"]}
    chains = _chains(facts, target, sorted(near))
    needed = sorted(near | {target["file"]} | {h["file"] for c in chains for h in c.trail})
    sources = {r["path"]: bytes(r["content"]) for r in facts.files.where(F.col("path").isin(needed)).select("path", "content").collect()}
    inside = _dicts(facts.symbols.where(F.col("file").isin(needed) & F.col("kind").isin("function", "class")).orderBy("file", "start_byte").collect())
    by_kind = {k: {f: [s for s in inside if s["file"] == f and s["kind"] == k] for f in needed} for k in ("function", "class")}
    out = Slice(target, None, None, callees, callers, types, chains, sources, by_kind["function"], by_kind["class"])
    out.enclosing = out.class_of(target) if target["kind"] == "function" else None
    imports = _dicts(facts.imports.where(F.col("file") == target["file"]).orderBy("start_byte").collect())
    if imports:
        text = out.source_of(target) + ("\n" + class_header(out.enclosing) if out.enclosing else "")
        out.imports = [x for x in imports if x["kind"] == "side-effect" or any(mentions(text, n) for n in [x["namespace"], *(b["local_name"] for b in x["identifiers"])])]
    return out
