from __future__ import annotations

import json
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from loomspan import cli
from loomspan.plans import code_queries, context, facts, fixture, generated, index, render
from loomspan.sources import files, store
from loomspan.plans.resolve import Resolution
from loomspan.sources.modules import Resolver
from loomspan.streaming.watch import watch


@pytest.mark.parametrize("name", [k for k in code_queries.SQL])
def test_code_queries(spark, name):
    got = code_queries.QUERIES[name](spark, "")
    want = duckdb.sql(code_queries.SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", list(generated.SQL))
def test_project_queries(spark, tmp_path, name):
    """On small tables; the driver has larger ones."""
    con = duckdb.connect()
    con.sql("CREATE TABLE region AS SELECT range AS r_regionkey FROM range(2); CREATE TABLE nation AS SELECT range AS n_nationkey, range % 2 AS n_regionkey FROM range(5); CREATE TABLE customer AS SELECT range AS c_custkey, range % 5 AS c_nationkey FROM range(40)")
    for t in ("region", "nation", "customer"):
        con.sql(f"COPY {t} TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    got, want = generated.QUERIES[name](spark, str(tmp_path)), con.sql(generated.SQL[name])
    cols = sorted(got.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in got.collect()) == sorted(tuple(r[i] for i in order) for r in want.fetchall())


def _slice(spark, name, **options):
    f, _, links, refs = code_queries.project(spark)
    return context.extract(f, links, f.symbols.where(f"name = '{name}'").first().id, context.Options(**options), refs)


def test_spans_are_the_lines_that_redacted_prints(spark):
    s = _slice(spark, "crate", caller_depth=2, type_depth=1)
    shown, file = {}, ""
    for line in render.redacted(s).split("\n"):
        if line.startswith("# "):
            file = line[2:]
        elif line.split(":")[0].isdigit():
            shown.setdefault(file, set()).add(int(line.split(":")[0]))
    assert shown == {x["file"]: {k for y in x["spans"] for k in range(y["start"], y["end"] + 1)} for x in render.spans(s)}


def test_slice_as_json(spark):
    s = json.loads(render.as_json(_slice(spark, "weigh")))
    assert s["EnclosingType"]["Symbol"]["name"] == "Crate" and s["EnclosingType"]["Header"].startswith("class Crate extends Holder implements Labelled {")
    assert [c["Symbol"]["name"] for c in s["Callers"]] == ["run"] and s["Callees"] is None
    assert [x["Edge"]["path"] for x in s["Imports"]] == ["./shapes"]  # the class's header names what it implements
    assert [x["Edge"]["path"] for x in json.loads(render.as_json(_slice(spark, "check")))["Imports"]] == ["./crate"]  # a parameter's type
    with pytest.raises(ValueError):
        context.Options(caller_depth=-1)
    f, _, links, _ = code_queries.project(spark)
    for bad in ("nope#1", "src/main.ts#module"):
        with pytest.raises(ValueError):
            context.extract(f, links, bad)


def _write(root, sources):
    for k, v in sources.items():
        (root / k).parent.mkdir(parents=True, exist_ok=True)
        (root / k).write_text(v)


def test_incremental_passes_equal_a_full_one(spark, tmp_path):
    root, by = tmp_path / "root", Resolver(**fixture.CONFIG)
    small = {k: v for k, v in fixture.SOURCES.items() if k in ("src/crate.ts", "src/shapes.ts", "src/text.ts")}
    _write(root, small)
    one = index.index_pass(spark, files.scan(spark, str(root)), str(tmp_path / "a"), by)
    assert (one.added, one.changed, one.removed, one.unchanged, one.saved) == (3, 0, 0, 0, True)
    again = index.index_pass(spark, files.scan(spark, str(root)), str(tmp_path / "a"), by)
    assert (again.unchanged, again.saved) == (3, False)
    _write(root, {"src/text.ts": small["src/text.ts"] + "export function more(c: Crate) { return render([c]); }\n"})
    (root / "src/shapes.ts").unlink()
    two = index.index_pass(spark, files.scan(spark, str(root)), str(tmp_path / "a"), by)
    assert (two.added, two.changed, two.removed, two.unchanged) == (0, 1, 1, 1)
    index.index_pass(spark, files.scan(spark, str(root)), str(tmp_path / "b"), by)
    a, b = store.load(spark, str(tmp_path / "a")), store.load(spark, str(tmp_path / "b"))
    for k in ("symbols", "links", "type_refs", "imports"):
        assert sorted(map(str, a[k].select(sorted(a[k].columns)).collect())) == sorted(map(str, b[k].select(sorted(b[k].columns)).collect()))


def test_command_line(spark, tmp_path, capsys):
    root = tmp_path / "root"
    _write(root, {"src/a.ts": 'import { b } from "./b";\nexport function a() { return b(); }\n', "src/b.ts": "export function b() { return 1; }\n", "tsconfig.json": "{}"})
    assert cli.run(spark, ["index", "--tsconfig", "tsconfig.json", str(root)]) == 0
    assert "indexed 2 symbols, 1 calls, 1 imports" in capsys.readouterr().out
    assert cli.run(spark, ["list", "--kind", "function", "--name", "^a", "--format", "json", str(root)]) == 0
    assert [(r["name"], r["start_line"]) for r in json.loads(capsys.readouterr().out)] == [("a", 2)]
    assert cli.run(spark, ["extract", "--format", "redacted", str(root), "src/b.ts#7"]) == 0
    assert "// callers: a (depth=1, body)" in capsys.readouterr().out
    assert cli.run(spark, ["list", "--kind", "nope", str(root)]) == 1
    assert cli.run(spark, ["list"]) == 2
    assert cli.run(spark, ["list", "--db", str(tmp_path / "none"), str(root)]) == 1


def _project(spark, sources, known=None):
    rows = spark.createDataFrame([(k, bytearray(v.encode()), "", len(v)) for k, v in sources.items()], "path string, content binary, content_hash string, length long")
    return facts.build(rows, Resolver(), None if known is None else spark.createDataFrame([(k,) for k in known], "path string"))


def _calls(spark, sources):
    f = _project(spark, sources)
    s = f.symbols.select("id", "name", "file")
    return {(r.name, r.callee, r.file) for r in Resolution(f).calls().join(f.calls.drop("caller_id", "file"), "call_id").join(s.select(F.col("id").alias("caller_id"), F.col("name")), "caller_id").join(s.select(F.col("id").alias("target_id"), "file"), "target_id").collect()}


def test_re_exports_of_any_length_and_in_cycles(spark):
    n = 32
    sources = {f"b{k}.ts": f'export * from "./none{k}";\nexport {{ x{k + 1} as x{k} }} from "./b{k + 1}";\n' for k in range(n)} | {f"b{n}.ts": f"export function x{n}() {{}}\n"}
    sources |= {"r0.ts": 'export * from "./r1";\nexport * from "./r2";\n', "r1.ts": 'export * from "./r0";\n', "r2.ts": "export function y() {}\nexport function z() {}\n"}
    sources["main.ts"] = 'import { x0 } from "./b0";\nimport { y } from "./r0";\nimport { nope } from "./r0";\nfunction run() { x0(); y(); nope(); }\n'
    assert _calls(spark, sources) == {("run", "x0", f"b{n}.ts"), ("run", "y", "r2.ts")}


def test_interfaces_of_any_depth(spark):
    n = 70
    sources = {"i.ts": "\n".join(f"export interface I{k} extends I{k + 1} {{ }}" for k in range(n)) + f"\nexport interface I{n} {{ deep(): void }}\n", "c.ts": 'import { I0 } from "./i";\nclass C implements I0 { run() { this.deep(); } }\n'}
    assert _calls(spark, sources) == {("run", "deep", "i.ts")}


def test_import_chains(spark):
    f = _project(spark, {
        "t.ts": "export default function goal() {}\n",
        "b.ts": 'export * as inner from "./t";\nexport { default as goal } from "./t";\n',
        "c.ts": 'export * from "./c";\nexport * from "./b";\n',
        "m1.ts": 'import * as all from "./c";\nall.goal();\n',
        "m2.ts": 'import other, { x, goal as g } from "./b";\ng();\n',
        "m3.ts": 'import { inner } from "./b";\n',
        "m4.ts": 'import G from "./t";\nimport * as all from "./b";\n',
    })
    target = f.symbols.where("name = 'goal'").first().asDict(True)
    got = {c.file: (c.local, [h["file"] for h in c.trail]) for c in context._chains(f, target, [f"m{k}.ts" for k in range(1, 5)])}
    assert got == {"m1.ts": ("all", ["m1.ts", "c.ts", "b.ts"]), "m2.ts": ("g", ["m2.ts", "b.ts"]), "m4.ts": ("G", ["m4.ts"])}


def test_files_that_spark_passes_over_and_files_beyond_the_sources(spark, tmp_path):
    _write(tmp_path, {
        "src/_app.ts": 'import { t } from "./types";\nimport p from "pkg";\nimport q from "#in";\nimport d from "./data.json";\nimport j from "./plain";\nexport function app() { return helper(); }\nfunction helper() {}\n',
        "src/__tests__/a.ts": "export function a() {}\n", "src/types.d.ts": "export declare const t: number;\n", "src/data.json": "{}", "src/plain.js": "", "src/dist/skip.ts": "",
        "node_modules/pkg/package.json": '{"exports": {".": {"types": "./lib/main.d.ts", "default": "./lib/main.js"}}}', "node_modules/pkg/lib/main.d.ts": "", "package.json": '{"imports": {"#in": "./src/__tests__/a.ts"}}',
    })
    root = str(tmp_path)
    assert sorted(r.path for r in files.scan(spark, root).select("path").collect()) == ["src/__tests__/a.ts", "src/_app.ts"]
    index.index_pass(spark, files.scan(spark, root), str(tmp_path / "db"), index.resolver(spark, root, None), known=index.known(spark, root))
    got = {r.path: r.resolved for r in store.load(spark, str(tmp_path / "db"))["imports"].collect()}
    assert got == {"./types": "src/types.d.ts", "pkg": "node_modules/pkg/lib/main.d.ts", "#in": "src/__tests__/a.ts", "./data.json": "src/data.json", "./plain": "src/plain.js"}


def test_watching_a_tree(spark, tmp_path):
    root, told = tmp_path / "root", []
    _write(root, {"a.ts": "export function a() {}\n", "b.ts": "export function b() {}\n", "tsconfig.json": "{}"})
    query = watch(spark, str(root), str(tmp_path / "db"), None, str(tmp_path / "ck"), interval_ms=100, tell=told.append, tsconfig="tsconfig.json")

    def names():
        return {r.name for r in store.load(spark, str(tmp_path / "db"))["symbols"].where("kind = 'function'").collect()}

    def wait(n):
        end = time.time() + 120
        while len(told) < n and time.time() < end and query.isActive:
            time.sleep(0.2)
        assert len(told) == n, query.exception()

    try:
        wait(1)
        assert names() == {"a", "b"}
        _write(root, {"a.ts": "export function a2() {}\n", "new/deep/c.ts": "export function c() {}\n"})
        wait(2)
        assert names() == {"a2", "b", "c"} and (told[1].added, told[1].changed, told[1].removed) == (1, 1, 0)
        (root / "b.ts").unlink()
        wait(3)
        assert names() == {"a2", "c"} and told[2].removed == 1
        _write(root, {"node_modules/x/y.ts": "export function y() {}\n", "note.txt": ""})
        time.sleep(1)
        assert len(told) == 3 and query.isActive
    finally:
        query.stop()
    assert len([x for x in (tmp_path / "db").iterdir() if x.name[0].isdigit()]) == store.KEEP
