"""The code operators on a small project of our own; the SQL holds the expected rows, worked out by hand."""

from __future__ import annotations

import contextlib
import io
import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources import files, jsonc, store
from ..sources.modules import Resolver
from . import context, facts, fixture, index, render
from .resolve import Resolution
from .typerefs import type_refs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_built: dict[str, tuple[facts.Facts, Resolution, DataFrame, DataFrame]] = {}


def query(columns: str, rows: list[tuple[object, ...]] | None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def text(x: object) -> str:
        return f"'{x}'" if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else f"{x}"

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        if rows is not None:
            SQL[f.__name__] = f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) v({columns})"
        return f

    return add


def project(spark: SparkSession) -> tuple[facts.Facts, Resolution, DataFrame, DataFrame]:
    """The fixture's facts, resolution, links and type references; built once a session, as long as the fixture is the same."""
    key = f"{spark.sparkContext.applicationId} {hash((tuple(fixture.SOURCES.items()), repr(fixture.CONFIG)))}"
    if key not in _built:
        f = facts.build(fixture.files(spark), Resolver(**fixture.CONFIG))
        r = Resolution(f)
        _built[key] = (f, r, r.calls().checkpoint(), type_refs(r).checkpoint())
    return _built[key]


@query("file, kind, name", [("src/main.ts", "function", "run"), ("src/main.ts", "function", "makePair"), ("src/main.ts", "module", "src/main.ts"), ("src/depot.ts", "function", "constructor"), ("src/depot.ts", "function", "keep"), ("src/depot.ts", "function", "all"), ("src/depot.ts", "function", "check"), ("src/depot.ts", "class", "Depot"), ("src/depot.ts", "class", "Scale"), ("src/crate.ts", "function", "constructor"), ("src/crate.ts", "function", "describe"), ("src/crate.ts", "function", "constructor"), ("src/crate.ts", "function", "weigh"), ("src/crate.ts", "function", "title"), ("src/crate.ts", "function", "of"), ("src/crate.ts", "function", "crate"), ("src/crate.ts", "function", "heaviest"), ("src/crate.ts", "class", "Holder"), ("src/crate.ts", "class", "Crate"), ("src/shapes.ts", "interface", "Tagged"), ("src/shapes.ts", "interface", "Labelled"), ("src/shapes.ts", "enum", "Size"), ("src/shapes.ts", "type_alias", "Label"), ("src/shapes.ts", "type_alias", "Unused"), ("src/text.ts", "function", "line"), ("src/text.ts", "function", "render")])
def ts_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark)[0].symbols.select("file", "kind", "name")


@query("caller, callee, target", [("constructor", "super", "constructor"), ("title", "describe", "describe"), ("title", "tag", "Tagged"), ("of", "Crate", "Crate"), ("crate", "Crate", "Crate"), ("heaviest", "of", "of"), ("keep", "check", "check"), ("run", "Depot", "Depot"), ("run", "makeCrate", "crate"), ("run", "keep", "keep"), ("run", "makePair", "makePair"), ("run", "weigh", "weigh"), ("run", "heaviest", "heaviest"), ("run", "all", "all"), ("run", "all", "all"), ("run", "render", "render"), ("makePair", "makeCrate", "crate"), ("src/main.ts", "run", "run"), ("render", "line", "line")])
def ts_calls_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, links, _ = project(spark)
    s = f.symbols.select("id", "name")
    rows = links.join(f.calls.drop("caller_id"), "call_id").join(s.toDF("caller_id", "caller"), "caller_id").join(s.toDF("target_id", "target"), "target_id")
    return rows.select("caller", F.when(F.col("callee") == "", F.col("receiver")).otherwise(F.col("callee")).alias("callee"), "target")


@query("file, path, resolved, kind", [("src/main.ts", "./depot", "src/depot.ts", "value"), ("src/main.ts", "@/barrel", "src/barrel.ts", "value"), ("src/main.ts", "./text", "src/text.ts", "value"), ("src/main.ts", "./shapes", "src/shapes.ts", "value"), ("src/main.ts", "./shapes", "src/shapes.ts", "type"), ("src/depot.ts", "./crate", "src/crate.ts", "value"), ("src/crate.ts", "./shapes", "src/shapes.ts", "value"), ("src/text.ts", "./crate", "src/crate.ts", "value")])
def ts_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark)[0].imports.select("file", "path", "resolved", "kind")


@query("file, resolved, namespace, n", [("src/barrel.ts", "src/crate.ts", "", 2), ("src/barrel.ts", "src/crate.ts", "", 0), ("src/barrel.ts", "src/text.ts", "Texts", 0)])
def ts_reexports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return project(spark)[0].re_exports.select("file", "resolved", "namespace", F.size("bindings").alias("n"))


@query("symbol, slot, target", [("run", "param:label", "Label"), ("run", "local:depot", "Depot"), ("run", "local:box", "Crate"), ("run", "local:inner", "Crate"), ("run", "local:top", "Crate"), ("makePair", "local:inner", "Crate"), ("keep", "param:crate", "Crate"), ("all", "return", "Crate"), ("check", "param:crate", "Crate"), ("Depot", "property:crates", "Crate"), ("Depot", "property:scale", "Scale"), ("constructor", "param:scale", "Scale"), ("constructor", "param:label", "Label"), ("constructor", "param:label", "Label"), ("Holder", "property:label", "Label"), ("Crate", "extends", "Holder"), ("Crate", "implements:0", "Labelled"), ("of", "param:label", "Label"), ("of", "return", "Crate"), ("crate", "param:label", "Label"), ("crate", "return", "Crate"), ("heaviest", "param:all", "Crate"), ("heaviest", "return", "Crate"), ("Labelled", "extends:0", "Tagged"), ("Labelled", "property:label", "Label"), ("Unused", "value", "Label"), ("Unused", "value", "Size"), ("line", "param:crate", "Crate"), ("render", "param:all", "Crate")])
def ts_type_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, _, refs = project(spark)
    s = f.symbols.select("id", "name")
    return refs.select("symbol_id", "slot", F.explode("targets").alias("t")).join(s.toDF("symbol_id", "symbol"), "symbol_id").join(s.toDF("t", "target"), "t").select("symbol", "slot", "target")


@query("name, depth", [("Depot", 1), ("crate", 1), ("keep", 1), ("makePair", 1), ("weigh", 1), ("heaviest", 1), ("all", 1), ("render", 1), ("check", 2), ("Crate", 2), ("of", 2), ("line", 2)])
def ts_callees_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, links, _ = project(spark)
    start = f.symbols.where("name = 'run'").first().id
    found = graph.reach(links.select(F.col("caller_id").alias("src"), F.col("target_id").alias("dst")), [start], 2, 50, goes_on=f.symbols.where("kind = 'function'"))
    return found.join(f.symbols.select("id", "name"), "id").select("name", "depth")


@query("file, first, last", [("src/main.ts", 1, 3), ("src/main.ts", 5, 5), ("src/main.ts", 7, 15), ("src/main.ts", 17, 22), ("src/crate.ts", 10, 17), ("src/crate.ts", 24, 24), ("src/crate.ts", 26, 28), ("src/crate.ts", 30, 32), ("src/depot.ts", 3, 15), ("src/text.ts", 7, 9)])
def ts_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, _, links, refs = project(spark)
    s = context.extract(f, links, f.symbols.where("name = 'run'").first().id, type_refs=refs)
    rows = [(x["file"], y["start"], y["end"]) for x in render.spans(s) for y in x["spans"]]
    return spark.createDataFrame(rows, "file string, first int, last int")


@query("id, json", [(1, '{"a":1,"b":"x // y"}'), (2, '["#",2]'), (3, "{}")])
def jsonc_translate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(1, '{ // one\n "a": 1, /* two */ "b": "x // y" }'), (2, '[ "#", # three\n 2 ]'), (3, "/* all */ {\n}\t")]
    return spark.createDataFrame(rows, "id int, raw string").select("id", jsonc.translated(F.col("raw")).alias("json"))


def _linked(spark: SparkSession, sources: dict[str, str]) -> tuple[facts.Facts, DataFrame]:
    f = facts.build(fixture.files(spark, sources), Resolver())
    return f, Resolution(f).calls()


def _named_links(f: facts.Facts | dict[str, DataFrame], links: DataFrame) -> DataFrame:
    """caller, callee as written, target and its file."""
    t = f if isinstance(f, dict) else f.tables()
    s = t["symbols"].select("id", "name", "file")
    rows = links.join(t["calls"].drop("caller_id", "file"), "call_id").join(s.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
    return rows.join(s.select(F.col("id").alias("target_id"), F.col("name").alias("target"), "file"), "target_id").select("caller", "callee", "target", "file")


@query("ord, kind, name, file, first, last", [(0, "class", "Crate", "src/crate.ts", 11, 24), (1, "class", "Depot", "src/depot.ts", 3, 15), (2, "interface", "Labelled", "src/shapes.ts", 5, 7)])
def ts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line lists, in its order."""
    from ..cli import listed

    rows = listed(project(spark)[0].tables(), "class,interface", None, "^(C|L|D)")
    return spark.createDataFrame([(k, r["kind"], r["name"], r["file"], r["start_line"], r["end_line"]) for k, r in enumerate(rows)], "ord int, kind string, name string, file string, first int, last int")


def _slice(spark: SparkSession, name: str, **options: int) -> context.Slice:
    f, _, links, refs = project(spark)
    return context.extract(f, links, f.symbols.where(F.col("name") == name).first().id, context.Options(**options), refs)


@query("section, name, depth, text", [("target", "check", 0, "check(crate: Crate): boolean {"), ("enclosing", "Scale", 0, "class Scale {"), ("import", "./crate", 0, 'import { Crate } from "./crate";'), ("caller", "keep", 1, "keep(crate: Crate): void"), ("site", "check", 1, "this.scale.check(crate)"), ("caller", "run", 2, "function run(label: Label): void"), ("site", "keep", 2, "depot.keep(box)")])
def ts_extract_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = json.loads(render.as_json(_slice(spark, "check", caller_depth=2)))
    first = lambda text: text.split("\n")[0]
    rows = [("target", x["Target"]["Symbol"]["name"], 0, first(x["Target"]["Source"])), ("enclosing", x["EnclosingType"]["Symbol"]["name"], 0, first(x["EnclosingType"]["Header"]))]
    rows += [("import", i["Edge"]["path"], 0, i["Source"]) for i in x["Imports"]]
    for kind, entries in (("caller", x["Callers"]), ("callee", x["Callees"])):
        for e in entries or []:
            rows += [(kind, e["Symbol"]["name"], e["Depth"], e["Signature"])] + [("site", c["callee"], e["Depth"], c["expression"]) for c in e["CallSites"]]
    return spark.createDataFrame(rows, "section string, name string, depth int, text string")


_LINE = ["// callers: render (depth=1, body)", '1: import { Crate } from "./crate";', render.CUT, "3: export const line = (crate: Crate): string => {", "4:   return crate.title();", "5: };", render.CUT, "7: export function render(all: Crate[]): string {", '8:   return all.map((c) => line(c)).join("\\n");', "9: }"]


@query("ord, text", list(enumerate(["# src/text.ts", *_LINE, ""])))
def ts_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(render.redacted(_slice(spark, "line")).split("\n"))), "ord int, text string")


@query("ord, text", list(enumerate(["# Extracted context: `src/text.ts#47`", "", "## file: src/text.ts", "", "```ts", *_LINE, "```", ""])))
def ts_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(render.markdown(_slice(spark, "line")).split("\n"))), "ord int, text string")


@query("file, local, trail", [("m1.ts", "all", "m1.ts"), ("m2.ts", "g", "m2.ts,c.ts,b.ts"), ("m4.ts", "G", "m4.ts")])
def ts_import_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the files that call the target import it."""
    f, links = _linked(spark, fixture.CHAINS)
    s = context.extract(f, links, f.symbols.where("name = 'goal'").first().id)
    return spark.createDataFrame([(c.file, c.local, ",".join(h["file"] for h in c.trail)) for c in s.chains], "file string, local string, trail string")


@query("caller, callee, target, file", [("run", "x", "dup", "b.ts"), ("run", "make", "make", "a.ts"), ("run", "go", "go", "a.ts"), ("run", "Box", "Box", "a.ts"), ("run", "wide", "wide", "a.ts"), ("run", "go", "go", "a.ts")])
def ts_inferred_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of two imports of a name counts; types come from inherited properties of what calls return."""
    return _named_links(*_linked(spark, fixture.INFERENCE))


@query("fact, name, detail", [("symbol", "A", "1"), ("symbol", "b", "2"), ("symbol", "C", "4"), ("symbol", "m", "5"), ("symbol", "(iife)", "2"), ("symbol", "(arrow)", "3"), ("symbol", "load", "4"), ("symbol", "named", "5"), ("call", "f", "module"), ("call", "h", "module"), ("call", "go", "(iife)"), ("call", "map", "module"), ("call", "m", "load"), ("call", "tag", "named"), ("call", "dec", "module"), ("call", "memo", "m"), ("local", "d", "e.m"), ("warning", "d.ts", "2 symbols flagged as default export")])
def ts_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and ranges of what has none, decorators, awaits, elements, and the warning of two defaults."""
    f = facts.build(fixture.files(spark, fixture.RULES), Resolver())
    before = F.length(F.regexp_replace(F.decode(F.substring("content", F.lit(1), F.col("start_byte").cast("int")), "utf-8"), "[^\n]", "")) + 1
    symbols = f.symbols.where("kind != 'module'").join(f.files.select(F.col("path").alias("file"), "content"), "file").select(F.lit("symbol").alias("fact"), "name", before.cast("string").alias("detail"))
    owner = f.symbols.select(F.col("id").alias("caller_id"), F.when(F.col("kind") == "module", "module").otherwise(F.col("name")).alias("detail"))
    calls = f.calls.where("callee != ''").join(owner, "caller_id").select(F.lit("call").alias("fact"), F.col("callee").alias("name"), "detail")
    bound = f.local_bindings.select(F.lit("local").alias("fact"), F.col("local").alias("name"), F.concat_ws(".", "receiver", "callee").alias("detail"))
    warned = f.warnings.select(F.lit("warning").alias("fact"), F.col("path").alias("name"), F.regexp_extract("warning", "[0-9]+ symbols flagged as default export", 0).alias("detail"))
    return symbols.unionByName(calls).unionByName(bound).unionByName(warned)


@query("path, resolved", [("./near", "src/near/index.ts"), ("./types", "src/types.d.ts"), ("./plain", "src/plain.js"), ("@lib/x", "lib/x.ts"), ("@lib/special", "lib/other.ts"), ("pkg", "node_modules/pkg/lib/main.d.ts"), ("pkg/sub/a", "node_modules/pkg/lib/a.js"), ("pkg/hidden", ""), ("old", "node_modules/old/main.js"), ("old/deep", "node_modules/old/deep.d.ts"), ("#in", "src/inner.ts"), ("#out", ""), ("none", ""), ("@s/p", "src/node_modules/@s/p/index.d.ts"), ("../inner", "src/inner.ts")])
def ts_module_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of files with its configuration, scanned, resolved among all its files and read back from a store."""
    root = fixture.write(spark, fixture.MODULES)
    by = index.resolver(spark, root, "tsconfig.json")
    index.index_pass(spark, files.scan(spark, root), f"{root}/.loomspan", by, known=index.known(spark, root))
    return (store.load(spark, f"{root}/.loomspan") or {})["imports"].select("path", "resolved")


def _edited(spark: SparkSession) -> tuple[list[index.Result], str]:
    """Three passes over a tree: new, the same, and with a file changed, one removed and one added."""
    small = {k: fixture.SOURCES[k] for k in ("src/crate.ts", "src/shapes.ts", "src/text.ts")}
    root, by = fixture.write(spark, small), Resolver(**fixture.CONFIG)
    passes = [index.index_pass(spark, files.scan(spark, root), f"{root}/.loomspan", by) for _ in range(2)]
    fixture.write(spark, {"src/text.ts": small["src/text.ts"] + "export function more(c: Crate) { return render([c]); }\n", "src/extra.ts": 'import { more } from "./text";\nexport const go = () => { more(null); };\n'}, root)
    fixture.remove(spark, f"{root}/src/shapes.ts")
    return [*passes, index.index_pass(spark, files.scan(spark, root), f"{root}/.loomspan", by)], f"{root}/.loomspan"


@query("pass, added, changed, removed, unchanged, saved", [(1, 3, 0, 0, 0, True), (2, 0, 0, 0, 3, False), (3, 1, 1, 1, 1, True)])
def ts_index_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(k, r.added, r.changed, r.removed, r.unchanged, r.saved) for k, r in enumerate(_edited(spark)[0], 1)], "pass int, added int, changed int, removed int, unchanged int, saved boolean")


@query("caller, target", [("constructor", "constructor"), ("title", "describe"), ("of", "Crate"), ("crate", "Crate"), ("heaviest", "of"), ("render", "line"), ("more", "render"), ("go", "more")])
def ts_incremental_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links in the store after the last of these passes."""
    got = store.load(spark, _edited(spark)[1]) or {}
    return _named_links(got, got["links"]).select("caller", "target")


@query("command, code", [("index", 0), ("list", 0), ("list --kind nope", 1), ("list --db none", 1), ("list --db x --rebuild", 2), ("extract nope#1", 1), ("extract module", 1), ("extract --caller-depth -1", 1), ("index without tsconfig", 2), ("", 2)])
def cli_exit_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..cli import run

    root = fixture.write(spark, {"a.ts": "export function a() { return 1; }\na();\n", "tsconfig.json": "{}"})
    commands = {"index": ["index", "--tsconfig", "tsconfig.json", root], "list": ["list", root], "list --kind nope": ["list", "--kind", "nope", root], "list --db none": ["list", "--db", f"{root}/none", root], "list --db x --rebuild": ["list", "--db", "x", "--rebuild", root], "extract nope#1": ["extract", root, "nope#1"], "extract module": ["extract", root, "a.ts#module"], "extract --caller-depth -1": ["extract", "--caller-depth", "-1", root, "a.ts#7"], "index without tsconfig": ["index", root], "": []}
    rows = []
    for name, argv in commands.items():
        with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
            rows.append((name, run(spark, argv)))
    return spark.createDataFrame(rows, "command string, code int")


@query("pass, added, changed, removed", [(1, 2, 0, 0), (2, 1, 1, 0), (3, 0, 0, 1)])
def watch_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a running watch tells of: the tree, then an edit with a new folder, then a removal; other files wake nothing."""
    from ..streaming.watch import watch

    root = fixture.write(spark, {"src/a.ts": "export function a() {}\n", "src/b.ts": "export function b() {}\n", "tsconfig.json": "{}"})
    told: list[index.Result] = []
    home = f"{root}-watch"
    stream = watch(spark, f"{root}/src", f"{home}/store", Resolver(), f"{home}/checkpoint", interval_ms=100, tell=told.append)

    def wait(n: int) -> None:
        end = time.time() + 120
        while len(told) < n and time.time() < end and stream.isActive:
            time.sleep(0.1)

    try:
        wait(1)
        fixture.write(spark, {"src/a.ts": "export function other() {}\n", "src/new/deep/c.ts": "export function c() {}\n", "src/note.txt": "x"}, root)
        wait(2)
        fixture.remove(spark, f"{root}/src/b.ts")
        wait(3)
    finally:
        stream.stop()
        fixture.remove(spark, home)
    return spark.createDataFrame([(k, r.added, r.changed, r.removed) for k, r in enumerate(told, 1)], "pass int, added int, changed int, removed int")


@query("path", [(x,) for x in ("src/main.ts", "src/depot.ts", "src/crate.ts", "src/shapes.ts", "src/barrel.ts", "src/text.ts")])
def stream_index_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture as files, brought into a store by a stream that runs once; the paths in the store."""
    from ..streaming.watch import watch

    home = fixture.write(spark, {f"root/{k}": v for k, v in fixture.SOURCES.items()})
    watch(spark, f"{home}/root", f"{home}/store", Resolver(**fixture.CONFIG), f"{home}/checkpoint", once=True).awaitTermination()
    return (store.load(spark, f"{home}/store") or {})["files"].select("path")
