"""python -m loomspan.cli list | extract | index | watch. Exit codes: 0 done, 1 failed, 2 wrong use."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import names
from .plans import context, facts, index, render
from .sources import files, store

KINDS = ("function", "class", "interface", "enum", "type_alias", "module")


def default_store(root: str) -> str:
    return str(Path(root) / ".loomspan" / "index")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomspan")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, source: bool) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--tsconfig", required=not source)
        if source:
            g = c.add_mutually_exclusive_group()
            g.add_argument("--db")
            g.add_argument("--rebuild", action="store_true")
            c.add_argument("--no-stale-check", action="store_true")
        c.add_argument("root")
        return c

    c = command("list", True)
    c.add_argument("--format", choices=("table", "json"), default="table")
    for x in ("--kind", "--file", "--name"):
        c.add_argument(x)
    c = command("extract", True)
    c.add_argument("--format", choices=("json", "redacted", "markdown", "spans"), default="json")
    for k, v in vars(context.Options()).items():
        c.add_argument("--" + k.replace("_", "-"), type=int, default=v)
    c.add_argument("symbol")
    command("index", False).add_argument("--output")
    c = command("watch", False)
    c.add_argument("--db")
    c.add_argument("--debounce-ms", type=int, default=200)
    return p


def _open(spark: SparkSession, a: argparse.Namespace) -> dict[str, DataFrame]:
    now = files.scan(spark, a.root)
    if a.rebuild:
        if not a.tsconfig:
            raise ValueError("--rebuild needs --tsconfig")
        tables = index.resolved(facts.build(now, index.resolver(spark, a.root, a.tsconfig), index.known(spark, a.root)))
        for r in tables["warnings"].orderBy("warning").collect():
            print(r.warning, file=sys.stderr)
        return tables
    found = store.load(spark, a.db or default_store(a.root))
    if found is None:
        raise ValueError(f"no index at {a.db or default_store(a.root)}; run index, or use --rebuild")
    if not a.no_stale_check:
        s = files.summary(files.diff(found["files"], now)).first()
        if s.added + s.changed + s.removed:
            print(f"warning: index is stale ({s.added} added, {s.changed} changed, {s.removed} removed); run index to bring it up to date", file=sys.stderr)
    return found


def listed(tables: dict[str, DataFrame], kind: str | None, file: str | None, name: str | None) -> list[dict[str, Any]]:
    kinds = None if kind is None else [k for k in kind.split(",") if k]
    if unknown := set(kinds or ()) - set(KINDS):
        raise ValueError(f"unknown kind {', '.join(sorted(unknown))}")
    rows = names.matching(tables["symbols"], kinds, file=file, name=name).orderBy("file", "start_byte", "id").select("id", "kind", "name", "file", "start_byte", "end_byte").collect()
    lines = {r.path: render.Lines(bytes(r.content)) for r in tables["files"].where(F.col("path").isin(sorted({r.file for r in rows}))).select("path", "content").collect()}
    return [r.asDict() | dict(zip(("start_line", "end_line"), lines[r.file].numbers((r.start_byte, r.end_byte)), strict=True)) for r in rows]


def run(spark: SparkSession, argv: list[str]) -> int:
    try:
        a = parser().parse_args(argv)
    except SystemExit as e:
        return 2 if e.code else 0
    try:
        if a.command == "list":
            rows = listed(_open(spark, a), a.kind, a.file, a.name)
            if a.format == "json":
                print(json.dumps(rows, indent=2, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026"))
            else:
                cells = [("ID", "KIND", "NAME", "FILE"), *((r["id"], r["kind"], r["name"], r["file"]) for r in rows)]
                wide = [max(len(c[k]) for c in cells) for k in range(4)]
                print("\n".join("  ".join(x.ljust(w) for x, w in zip(c, wide, strict=True)).rstrip() for c in cells))
        elif a.command == "extract":
            options = context.Options(**{k: getattr(a, k) for k in vars(context.Options())})
            tables = _open(spark, a)
            s = context.extract(index.load_facts(tables), tables["links"], a.symbol, options, tables["type_refs"])
            out = {"json": render.as_json, "redacted": render.redacted, "markdown": render.markdown, "spans": lambda x: json.dumps(render.spans(x), indent=2)}[a.format](s)
            print(out)
        elif a.command == "index":
            path = a.output or default_store(a.root)
            r = index.index_pass(spark, files.scan(spark, a.root), path, index.resolver(spark, a.root, a.tsconfig), always=True, known=index.known(spark, a.root))
            print(f"indexed {r.counts['symbols']} symbols, {r.counts['calls']} calls, {r.counts['imports']} imports → {path}\nfiles: {r}")
        else:
            from .streaming.watch import watch

            path = a.db or default_store(a.root)
            query = watch(spark, a.root, path, None, path + "-stream", interval_ms=a.debounce_ms, tell=lambda r: print(f"indexed: {r}", flush=True), tsconfig=a.tsconfig)
            try:
                query.awaitTermination()
            except KeyboardInterrupt:
                query.stop()
    except (ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


def main() -> None:
    spark = SparkSession.builder.appName("loomspan").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    code = run(spark, sys.argv[1:])
    spark.stop()
    sys.exit(code)


if __name__ == "__main__":
    main()
