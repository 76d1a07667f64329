"""A small TypeScript project of our own, for queries and tests that need code."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import shared_folder

CONFIG = {"base": "", "paths": {"@/*": ["src/*"]}}
SOURCES = {
    "src/main.ts": """import Depot from "./depot";
import { crate as makeCrate, heaviest } from "@/barrel";
import * as Text from "./text";
import { Unused } from "./shapes";
import type { Label } from "./shapes";

export function run(label: Label): void {
  const depot = new Depot();
  const box = makeCrate(label, 3);
  depot.keep(box);
  const { inner } = makePair();
  inner.weigh();
  const top = heaviest(depot.all());
  console.log(Text.render(depot.all()));
}

function makePair() {
  const inner = makeCrate("pair", 1);
  return { inner };
}

run("first");
""",
    "src/depot.ts": """import { Crate } from "./crate";

export default class Depot {
  private crates: Crate[] = [];
  constructor(private readonly scale: Scale) {
    this.crates = [];
  }
  keep(crate: Crate): void {
    this.crates.push(crate);
    this.scale.check(crate);
  }
  all(): Crate[] {
    return this.crates;
  }
}

export class Scale {
  check(crate: Crate): boolean {
    return crate.weight > 0;
  }
}
""",
    "src/crate.ts": """import { Labelled, Label } from "./shapes";

export abstract class Holder {
  constructor(public label: Label) {}
  describe(): string {
    return this.label;
  }
}

/** A crate has a weight. */
export class Crate extends Holder implements Labelled {
  constructor(label: Label, public weight: number) {
    super(label);
  }
  weigh(): number {
    return this.weight;
  }
  title(): string {
    return super.describe() + this.tag();
  }
  static of(label: Label): Crate {
    return new Crate(label, 1);
  }
}

export function crate(label: Label, weight: number): Crate {
  return new Crate(label, weight);
}

export function heaviest(all: Crate[]): Crate {
  return Crate.of("none");
}
""",
    "src/shapes.ts": """export type Label = string;
export interface Tagged {
  tag(): string;
}
export interface Labelled extends Tagged {
  label: Label;
}
export enum Size { Small, Large }
export type Unused = Label | Size;
""",
    "src/barrel.ts": """export { crate, Crate as Box } from "./crate";
export * from "./crate";
export * as Texts from "./text";
""",
    "src/text.ts": """import { Crate } from "./crate";

export const line = (crate: Crate): string => {
  return crate.title();
};

export function render(all: Crate[]): string {
  return all.map((c) => line(c)).join("\\n");
}
""",
    "node_modules/skip/index.ts": "export function skipped() {}\n",
    "src/types.d.ts": "declare const x: number;\n",
}


#: What modules resolve to: configuration with a parent, packages with and without exports, declarations, JavaScript.
MODULES = {
    "tsconfig.json": '{ // the paths are those of the parent\n "extends": "./config/base" }',
    "config/base.json": '{ "compilerOptions": { "baseUrl": "..", "paths": { "@lib/*": ["gone/*", "lib/*"], "@lib/special": ["lib/other"] } } }',
    "package.json": '{ "imports": { "#in": "./src/inner.ts" } }',
    "lib/x.ts": "", "lib/other.ts": "", "lib/special.ts": "", "src/near/index.ts": "", "src/types.d.ts": "", "src/plain.js": "", "src/inner.ts": "", "src/__tests__/_t.ts": 'import "../inner";',
    "node_modules/pkg/package.json": '{ "exports": { ".": { "types": "./lib/main.d.ts", "default": "./lib/main.js" }, "./sub/*": "./lib/*.js" } }',
    "node_modules/pkg/lib/main.d.ts": "", "node_modules/pkg/lib/main.js": "", "node_modules/pkg/lib/a.js": "", "node_modules/pkg/hidden.ts": "",
    "node_modules/old/package.json": '{ "main": "main.js" }', "node_modules/old/main.js": "", "node_modules/old/deep.d.ts": "",
    "node_modules/@s/p/index.d.ts": "", "src/node_modules/@s/p/index.d.ts": "",
    "src/main.ts": "\n".join(f'import "{x}";' for x in ("./near", "./types", "./plain", "@lib/x", "@lib/special", "pkg", "pkg/sub/a", "pkg/hidden", "old", "old/deep", "#in", "#out", "none", "@s/p")),
}
RULES = {
    "d.ts": "export default class A {}\nexport default function b() {}\n@dec()\nexport class C {\n  @memo()\n  m() {}\n}\n",
    "r.tsx": "const v = <A b={f(1)}>text g() {h(2)}</A>;\n(() => { go(); })();\nxs.map(x => { return x; });\nasync function load(e: E) { const d = await e.m(); }\nconst named = () => { tag`x`; };\n",
}
INFERENCE = {
    "a.ts": "export class A { go(): void {} }\nexport interface Base { inner: A }\nexport interface Wide extends Base { other: string }\nexport class Box {\n  item: A;\n  wide(): Wide { return null; }\n}\nexport function make(): Wide { return null; }\nexport function dup() {}\n",
    "b.ts": "export function dup() {}\n",
    "m.ts": 'import { A, Box, make, dup as x } from "./a";\nimport { dup as x } from "./b";\nfunction run() {\n  x();\n  const { inner } = make();\n  inner.go();\n  const box = new Box();\n  const { inner: other } = box.wide();\n  other.go();\n}\n',
}
CHAINS = {
    "t.ts": "export default function goal() {}\n",
    "b.ts": 'export * as inner from "./t";\nexport { default as goal } from "./t";\n',
    "c.ts": 'export * from "./c";\nexport * from "./b";\n',
    "m1.ts": 'import * as all from "./t";\nfunction one() { all.goal(); }\n',
    "m2.ts": 'import other, { x, goal as g } from "./c";\nfunction two() { g(); }\n',
    "m3.ts": 'import { inner } from "./b";\n',
    "m4.ts": 'import G from "./t";\nimport * as all from "./b";\nfunction four() { G(); }\n',
}


def write(spark: SparkSession, sources: dict[str, str], root: str | None = None) -> str:
    """Writes sources as files under root, or under a new folder in the shared one that goes when the application ends."""
    jvm = spark._jvm
    if root is None:
        root = f"{shared_folder(spark).rstrip('/')}/tree-{uuid.uuid4().hex}"
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.deleteOnExit(top)
    for k, v in sources.items():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/{k}"), True)
        out.write(bytearray(v.encode()))
        out.close()
    return root


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def files(spark: SparkSession, sources: dict[str, str] = SOURCES) -> DataFrame:  # noqa: B006
    """path, content, content_hash, length of sources, as a scan of a folder gives them."""
    from ..sources.files import included

    rows = spark.createDataFrame([(k, bytearray(v.encode())) for k, v in sources.items()], "path string, content binary")
    return rows.where(included(F.col("path"))).withColumns({"content_hash": F.sha2("content", 256), "length": F.octet_length("content").cast("bigint")})
