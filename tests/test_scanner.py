from __future__ import annotations

import pytest

from loomspan.functions.lexer import Tokens
from loomspan.functions.scanner import scan
from loomspan.functions.typeexpr import parse


def calls(source: str, path: str = "a.ts") -> list[tuple[str, str, bool]]:
    return [(c["callee"], c["receiver"], c["is_constructor"]) for c in scan(source.encode(), path)["calls"]]


def symbols(source: str, path: str = "a.ts") -> list[tuple[str, str]]:
    return [(s["kind"], s["name"]) for s in scan(source.encode(), path)["symbols"] if s["kind"] != "module"]


@pytest.mark.parametrize(
    "source, expected",
    [
        ("go();", [("go", "", False)]),
        ("a.b.c();", [("c", "a.b", False)]),
        ("a?.b();", [("b", "a", False)]),
        ("new Box(1);", [("Box", "", True)]),
        ("new ns.Box();", [("Box", "ns", True)]),
        ("new Bare;", [("Bare", "", True)]),
        ("(go)();", [("go", "", False)]),
        ("xs[0]();", [("", "xs[0]", False)]),
        ("f()();", [("", "f()", False), ("f", "", False)]),
        ("a.b().c();", [("c", "a.b()", False), ("b", "a", False)]),
        ("pick<Item>(x);", [("pick", "", False)]),
        ("if (a < b && c > (d)) {}", []),
        ("for (const x of list()) {}", [("list", "", False)]),
        ("const t = `x ${g(1)} y`;", [("g", "", False)]),
        ("const r = /g\\(1\\)/; h();", [("h", "", False)]),
        ("// g()\n/* h() */ k();", [("k", "", False)]),
        ("type F = (x: A) => B; go();", [("go", "", False)]),
        ("class A extends B { constructor() { super(1); super.m(); } }", [("", "super", False), ("m", "super", False)]),
        ("tag`x ${g(1)}`;", [("tag", "", False), ("g", "", False)]),
        ("a.tag`x`; a.b()`y`;", [("tag", "a", False), ("", "a.b()", False), ("b", "a", False)]),
        ("const t = `x`; return `y`; f(`z`);", [("f", "", False)]),
        ("type T = `a${string}`; x as `b${string}`; go();", [("go", "", False)]),
        ("/a\\(b/.test(s);", [("test", "/a\\(b/", False)]),
        ("'a,b'.split(',');", [("split", "'a,b'", False)]),
        ('import x = require("y"); z();', [("z", "", False)]),
        ("make<{" + "; ".join(f"f{k}: string" for k in range(100)) + "}>(1);", [("make", "", False)]),
        ("make<" + " | ".join(f"T{k}<A>" for k in range(100)) + ">(1);", [("make", "", False)]),
        ("const xs = [" + ", ".join(f"a > ({k})" for k in range(3000)) + "]; f();", [("f", "", False)]),
    ],
)
def test_calls(source, expected):
    assert calls(source) == expected


@pytest.mark.parametrize(
    "source, expected",
    [
        ("function a() {}", [("function", "a")]),
        ("export async function a<T>(x: T): Promise<T> { return x; }", [("function", "a")]),
        ("const a = () => 1;", [("function", "a")]),
        ("const a = async (x) => { };", [("function", "a")]),
        ("xs.map(x => { return x; });", [("function", "(arrow)")]),
        ("xs.map(x => x);", []),
        ("(() => { go(); })();", [("function", "(iife)")]),
        ("const f = function named() {};", []),
        ("function* gen() {}", []),
        ("class A { m() {} #p() {} ['c']() {} f = () => 1; get v() { return 1; } }", [("function", "m"), ("function", "f"), ("function", "v"), ("class", "A")]),
        ("abstract class A { abstract m(): void; }", [("class", "A")]),
        ("interface I { m(): void } enum E { A, B } type T = I | E;", [("interface", "I"), ("enum", "E"), ("type_alias", "T")]),
        ("const o = { run() { return 1; } };", [("function", "run")]),
    ],
)
def test_symbols(source, expected):
    assert symbols(source) == expected


def test_ranges_start_at_the_keyword_the_name_or_the_decorator():
    s = {x["name"]: x for x in scan(b"export function a() {}\nexport const b = () => { };\n@dec()\nexport class C {\n  @memo()\n  m() {}\n}\n", "a.ts")["symbols"]}
    assert (s["a"]["start_byte"], s["a"]["end_byte"]) == (7, 22)
    assert s["b"]["start_byte"] == 36
    assert s["C"]["id"].startswith("a.ts#") and s["m"]["end_byte"] > s["m"]["start_byte"]
    src = b"@dec()\nexport class C {\n  @memo()\n  m() {}\n}\n"
    m = next(x for x in scan(src, "a.ts")["symbols"] if x["name"] == "m")
    assert src[m["start_byte"] :].startswith(b"@memo()")


def test_offsets_are_bytes():
    src = "const s = 'äöü€';\nfunction f() { g(); }\n".encode()
    f = next(x for x in scan(src, "a.ts")["symbols"] if x["name"] == "f")
    assert src[f["start_byte"] : f["end_byte"]] == b"function f() { g(); }"


@pytest.mark.parametrize(
    "source, expected",
    [
        ('import "./a";', ("side-effect", "", [])),
        ('import D from "a";', ("value", "", [("D", "default", False)])),
        ('import * as N from "a";', ("value", "N", [])),
        ('import { x, y as z, type T } from "a";', ("value", "", [("x", "x", False), ("z", "y", False), ("T", "T", True)])),
        ('import type { T } from "a";', ("type", "", [("T", "T", True)])),
        ('import D, { x } from "a";', ("value", "", [("D", "default", False), ("x", "x", False)])),
        ('const r = require("a");', ("value", "", [("r", "default", False)])),
    ],
)
def test_imports(source, expected):
    (found,) = scan(source.encode(), "a.ts")["imports"]
    assert (found["kind"], found["namespace"], [(i["local_name"], i["remote_name"], i["is_type_only"]) for i in found["identifiers"]]) == expected


def test_re_exports_and_defaults():
    got = scan(b'export { a, b as c } from "x"; export * from "y"; export * as N from "z"; export type { T } from "t"; export { local };', "a.ts")["re_exports"]
    assert [(x["path"], x["kind"], x["namespace"], len(x["bindings"])) for x in got] == [("x", "value", "", 2), ("y", "value", "", 0), ("z", "value", "N", 0), ("t", "type", "", 1)]
    assert [x["name"] for x in scan(b"export default class A {}\nfunction b() {}", "a.ts")["symbols"] if x["is_default_export"]] == ["A"]
    assert scan(b"function a() {}\nclass a {}\nexport default a;", "a.ts")["warnings"]


def test_locals_and_returns():
    got = scan(b"function f() { const a: A = x; const b = new B(); const c = g(); const d = await e.m(); const { p, q: r } = h(); return { a, k: new K() }; }\nfunction t() { if (1) { return 1; } return new T(); }", "a.ts")
    assert {(x["local"], x["type"], x["origin"]) for x in got["local_types"]} == {("a", "A", "annotation"), ("b", "B", "inferred:new")}
    assert {(x["local"], x["form"], x["receiver"], x["callee"], x["property"]) for x in got["local_bindings"]} == {("c", "call", "", "g", ""), ("d", "method", "e", "m", ""), ("p", "destructure", "", "h", "p"), ("r", "destructure", "", "h", "q")}
    assert {(x["property"], x["new_type"], x["local_var"]) for x in got["inline_returns"]} == {("a", "", "a"), ("k", "K", "")}
    assert next(x for x in got["symbols"] if x["name"] == "t")["return_type"] == "T"


def test_tsx_elements_hold_code():
    assert calls("const v = <A b={f(1)}>text g() {h(2)}</A>; k();", "a.tsx") == [("f", "", False), ("h", "", False), ("k", "", False)]


@pytest.mark.parametrize("source", ["", "(((", "}}}", "class {", "import {", "`${", "function (", "const = => <", "export default", "\x00\xff", "a ? b : (c) => d", "<T>(x", "interface I { (x): "])
def test_nothing_raises(source):
    scan(source.encode("latin-1"), "a.ts")
    scan(source.encode("latin-1"), "a.tsx")
    assert Tokens(source.encode("latin-1")).text is not None


def test_type_expressions():
    assert [(n.path, n.base_name, n.is_array, n.origin) for n in parse("Map<string, Item[]> | null", "annotation")] == [("", "", False, "annotation"), ("/u0", "Map", False, ""), ("/u0/a0", "string", False, ""), ("/u0/a1", "Item", True, ""), ("/u1", "null", False, "")]
    assert [n.base_name for n in parse("A & ns.B", "")] == ["", "A", "ns.B"]
    assert [n.base_name for n in parse("(x: A) => Promise<B>", "")] == ["(x: A) => Promise", "B"]
    assert [n.base_name for n in parse("readonly T[]", "")] == [""]
    assert parse("  ", "") == []


def test_owners_of_many_functions():
    n = 4000
    got = scan("\n".join(f"function f{k}() {{ const g = () => {{ h({k}); }}; k(); }}" for k in range(n)).encode(), "a.ts")
    names = {x["id"]: x["name"] for x in got["symbols"]}
    assert [names[c["caller_id"]] for c in got["calls"]] == [x for k in range(n) for x in ("g", f"f{k}")]
