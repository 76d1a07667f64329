from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomspan.functions.text import clean_path, strip_generics
from loomspan.operators import graph, intervals, names
from loomspan.plans import render
from loomspan.sources import files, jsonc, modules


def test_intervals_against_sets(spark):
    rng = random.Random(3)
    rows = [(k, kind, a, a + rng.randint(0, 9)) for k in (1, 2) for kind in "ab" for a in (rng.randint(0, 60) for _ in range(12))]
    df = spark.createDataFrame(rows, "k int, kind string, start int, end int")

    def points(kind, k):
        return {x for kk, kd, a, b in rows if kk == k and kd == kind for x in range(a, b)}

    merged = intervals.merge(df.where("kind = 'a' and start < end"), ["k"]).collect()
    assert sorted(merged) == sorted(intervals.merge(df.where("kind = 'a' and start < end"), ["k"], width=7).collect())
    asked, spans = df.where("kind = 'a'").selectExpr("k", "start * 100 + k as id", "start as ps", "start + 1 as pe").distinct(), df.where("kind = 'b'").withColumn("tie", F.col("start") * 100 + F.col("end"))
    least = [intervals.smallest_enclosing(asked, spans, ["k"], ("ps", "pe"), ("start", "end"), "id", "tie", width=w).select("id", "tie").collect() for w in (None, 4)]
    assert sorted(map(str, least[0])) == sorted(map(str, least[1])) and any(r.tie for r in least[0]) and any(r.tie is None for r in least[0])
    left = intervals.subtract(df.where("kind = 'a'"), df.where("kind = 'b'"), ["k"]).collect()
    for k in (1, 2):
        assert {x for r in merged if r.k == k for x in range(r.start, r.end)} == points("a", k)
        assert {x for r in left if r.k == k for x in range(r.start, r.end)} == points("a", k) - points("b", k)
        own = sorted((r.start, r.end) for r in merged if r.k == k)
        assert all(b < c for (_, b), (c, _) in zip(own, own[1:], strict=False))


def test_line_algebra():
    at = render.Lines(b"ab\ncd\n")
    assert at.starts == [0, 3, 6] and [at.of(x) for x in (0, 2, 3, 6)] == [1, 1, 2, 3]
    assert at.whole((1, 4)) == (0, 6) and at.whole((2, 2)) == (2, 2)
    assert render.subtract([(0, 10)], [(2, 3), (5, 7)]) == [(0, 2), (3, 5), (7, 10)]
    assert render.merge([(3, 4), (0, 2), (2, 3)]) == [(0, 4)]
    assert render.visible(b"a\n\n\nb\n", [(0, 1), (3, 4)]) == [(0, 2)]


@pytest.mark.parametrize(
    "source, expected",
    [("/** d */\nexport function f", 0), ("x;\n// a\n// b\nfunction f", 3), ("x;\nfunction f", 3), ("/* a */ y();\nfunction f", 13), ("/* a */ export default async function f", 0), ("/* " + "long " * 6000 + "*/\nfunction f", 0), ("x;\n" + "// line\n" * 4000 + "export function f", 3), ("exports function f", 8)],
)
def test_comments_belong_to_declarations(source, expected):
    assert render.with_comment(source.encode(), source.index("function")) == expected


def test_reach_keeps_a_cap_and_lets_cut_ids_come_back(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("a", "a"), ("b", "c"), ("b", "d"), ("d", "a")], "src string, dst string")
    got = lambda **k: {(r.id, r.depth) for r in graph.reach(edges, ["a"], 3, **k).collect()}
    assert got(cap=1) == {("b", 1), ("c", 2)}
    assert got(cap=0) == got(cap=50) == {("b", 1), ("c", 1), ("d", 2)}
    on = spark.createDataFrame([("a",), ("c",)], "id string")
    assert {(r.id, r.depth) for r in graph.reach(edges, ["a"], 3, 50, goes_on=on).collect()} == {("b", 1), ("c", 1)}


def test_chain_closure_ends_in_cycles(spark):
    parents = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", None), ("x", "y"), ("y", "x")], "node string, parent string")
    got = {(r.node, r.ancestor, r.depth) for r in graph.chain_closure(parents).collect()}
    assert got == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("b", "b", 0), ("b", "c", 1), ("c", "c", 0), ("x", "x", 0), ("x", "y", 1), ("y", "y", 0), ("y", "x", 1)}


def test_labels_spread_to_the_end_of_any_chain(spark):
    labels = spark.createDataFrame([(0, "b"), (0, "a"), (300, "c"), (900, None)], "node int, label string")
    chain = [(k, k - 1) for k in range(1, 701)] + [(800, 801), (801, 802), (802, 800), (810, 811), (811, None), (901, 900), (5, 4)]
    want = {k: "a" if k < 300 else "c" for k in range(701)} | {900: None, 901: None}
    got = graph.propagate(labels, spark.createDataFrame(chain, "node int, source int")).collect()
    assert len(got) == len(want) and {r.node: r.label for r in got} == want


def test_labels_of_several_sources(spark):
    labels = spark.createDataFrame([("a", "2"), ("b", "1"), ("c", "0")], "node string, label string")
    bindings = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "x"), ("y", "c"), ("a", "c"), ("z", "y"), ("y", "z"), ("p", "q"), ("q", "p")], "node string, source string")
    assert {(r.node, r.label) for r in graph.propagate(labels, bindings).collect()} == {("a", "2"), ("b", "1"), ("c", "0"), ("x", "1"), ("y", "0"), ("z", "0")}


def test_names(spark):
    df = spark.createDataFrame([("Promise<Promise<A<b>>>",), ("B[]",), ("C<D>",), (" E ",), ("Promise<A> | B",), ("Promise<\n Promise<A> | null>",), ("Promise<",), (None,)], "raw string")
    assert [r[0] for r in df.select(strip_generics(F.col("raw"))).collect()] == ["A", "B[]", "C", "E", "Promise", "Promise", "Promise", None]
    texts = spark.createDataFrame([("a foo b",), ("foobar",), ("x.foo()",), ("$foo",)], "t string")
    assert [r[0] for r in texts.select(names.whole_word(F.col("t"), "foo")).collect()] == [True, False, True, False]
    rows = spark.createDataFrame([("class", "A"), ("enum", "B")], "kind string, name string")
    assert names.matching(rows, []).count() == 0 and names.matching(rows, ["class"], name="A").count() == 1


def test_snapshots(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content_hash string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, content_hash string")
    assert {(r.path, r.status) for r in files.diff(old, new).collect()} == {("a", "unchanged"), ("b", "changed"), ("c", "removed"), ("d", "added")}
    assert tuple(files.summary(files.diff(old, new)).first()) == (1, 1, 1, 1)


def test_included_paths(spark):
    paths = ["a.ts", "b.tsx", "c.d.ts", "d.js", "node_modules/x.ts", "src/dist/y.ts", "src/z.mts", "dist.ts"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r.p for r in df.where(files.included(F.col("p"))).collect()] == ["a.ts", "b.tsx", "dist.ts"]


def test_json_with_comments(spark):
    text = '{ "a//b": /* c */ "x # y", // d\n "n": [1, 2] # e\n}'
    assert jsonc.loads(text) == {"a//b": "x # y", "n": [1, 2]}
    assert spark.createDataFrame([(text,)], "t string").select(jsonc.translated(F.col("t"))).first()[0] == jsonc.to_json(text)
    assert not jsonc.valid('{"a": 1,}')


def test_module_candidates():
    tree = {"src/a.ts", "src/b/index.ts", "lib/x.ts", "node_modules/p/dist/main.d.ts", "node_modules/q/src/sub.ts", "src/internal.ts"}
    packages = {"node_modules/p": {"types": "dist/main.d.ts"}, "node_modules/q": {"exports": {".": "./src/none.ts", "./*": {"types": "./src/*.ts"}}}, "": {"imports": {"#in": "./src/internal.ts"}}}
    r = modules.Resolver("", {"@/*": ["missing/*", "src/*"], "@/special": ["lib/x"]}, packages)
    find = lambda f, s: next((c for c in r.candidates(f, s) if c in tree), "")
    assert [find("src/m.ts", s) for s in ("./a", "./b", "./a.ts", "@/a", "@/special", "p", "q/sub", "q", "#in", "./none", "zzz")] == ["src/a.ts", "src/b/index.ts", "src/a.ts", "src/a.ts", "lib/x.ts", "node_modules/p/dist/main.d.ts", "node_modules/q/src/sub.ts", "", "src/internal.ts", "", ""]
    assert clean_path("a/./b/../c") == "a/c" and clean_path("../x") == "../x"


def test_config_chain():
    tree = {"tsconfig.json": '{ // c\n "extends": "./base", "compilerOptions": {"paths": {"a": ["b"]}} }', "base.json": '{"extends": "./tsconfig.json", "compilerOptions": {"baseUrl": "src", "paths": {"z": ["z"]}}}'}
    r = modules.resolver("tsconfig.json", tree.get)
    assert (r.base, r.paths) == ("src", {"a": ["b"]})
    assert modules.resolver("none.json", tree.get).paths == {}


def test_lines_of_texts(spark):
    texts = ["", "a", "a\n", "\n\nbé\nc", None]
    df = spark.createDataFrame([(k, t, [0, 1, 2, 5]) for k, t in enumerate(texts)], "k int, t string, at array<int>")
    got = {(r.k, r.line): (r.start, r.n_bytes) for r in intervals.lines(df, "k", "t").collect()}
    assert got == {(0, 1): (0, 0), (1, 1): (0, 1), (2, 1): (0, 1), (2, 2): (2, 0), (3, 1): (0, 0), (3, 2): (1, 0), (3, 3): (2, 3), (3, 4): (6, 1)}
    at = intervals.lines_at(df.where("k = 3"), "k", "t", "at").collect()
    assert [(r.offset, r.line) for r in at] == [(0, 1), (1, 2), (2, 3), (5, 3)]
    offsets = df.where("k = 3").select("k", F.explode("at").alias("offset"))
    assert sorted(map(tuple, intervals.offsets_to_lines(offsets, intervals.lines(df, "k", "t"), "k").collect())) == sorted(map(tuple, at))
