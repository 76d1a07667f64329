"""The code operators on a project of many files, written from the given tables: a file for each region, nation and customer. Its facts and links
follow from the tables' keys, so SQL says what they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.modules import Resolver
from . import facts
from .resolve import Resolution
from .typerefs import type_refs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_BY = {"base": "", "paths": {"@/*": ["src/*"]}}


def _text(template: str, **values: str) -> Column:
    """template with {name} for a column."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.col(v).cast("string"))
    return out


_REGION = "export abstract class Region{r} {\n  area(): number {\n    return {r};\n  }\n}\n\nexport function near{r}(): void {}\n"
_NATION = 'import { Region{r} } from "@/regions/r{r}";\n\nexport default class Nation{n} extends Region{r} {\n  static of(): Nation{n} {\n    return new Nation{n}();\n  }\n  greet(): number {\n    return this.area();\n  }\n}\n'
_CUSTOMER = 'import { N{n} } from "../nations";\nimport * as region from "../regions/r{r}";\n\nexport function customer{c}(at: N{n}): number {\n  const nation = new N{n}();\n  N{n}.of();\n  region.near{r}();\n  return nation.greet();\n}\n'


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content, content_hash, length."""
    region, nation, customer = (spark.read.parquet(f"{sf_dir}/{x}.parquet") for x in ("region", "nation", "customer"))
    of = nation.select(F.col("n_nationkey").alias("n"), F.col("n_regionkey").alias("r"))
    rows = region.select(_text("src/regions/r{r}.ts", r="r_regionkey").alias("path"), _text(_REGION, r="r_regionkey").alias("text"))
    rows = rows.unionByName(of.select(_text("src/nations/n{n}.ts", n="n").alias("path"), _text(_NATION, n="n", r="r").alias("text")))
    barrel = of.agg(F.array_join(F.array_sort(F.collect_list(_text('export { default as N{n} } from "./n{n}";', n="n"))), "\n").alias("text"))
    rows = rows.unionByName(barrel.select(F.lit("src/nations/index.ts").alias("path"), "text"))
    own = customer.select(F.col("c_custkey").alias("c"), F.col("c_nationkey").alias("n")).join(of, "n")
    rows = rows.unionByName(own.select(_text("src/customers/c{c}.ts", c="c").alias("path"), _text(_CUSTOMER, c="c", n="n", r="r").alias("text")))
    return rows.select("path", F.col("text").cast("binary").alias("content"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("long").alias("length"))


def query(sql: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _facts(spark: SparkSession, sf_dir: str) -> facts.Facts:
    return facts.build(sources(spark, sf_dir), Resolver(**_BY))


_C = "(SELECT c_custkey AS c, n_nationkey AS n, n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(
    f"""SELECT 'src/customers/c' || c || '.ts' AS file, 'function' AS kind, 'customer' || c AS name, (strlen('import {{ N' || n || ' }} from "../nations";') + strlen('import * as region from "../regions/r' || r || '";') + 10)::BIGINT AS start FROM {_C}
UNION ALL SELECT 'src/nations/n' || n_nationkey || '.ts', unnest(['class', 'function', 'function']), unnest(['Nation' || n_nationkey, 'of', 'greet']), unnest([0, 1, 2])::BIGINT FROM nation
UNION ALL SELECT 'src/regions/r' || r_regionkey || '.ts', unnest(['class', 'function', 'function']), unnest(['Region' || r_regionkey, 'area', 'near' || r_regionkey]), unnest([0, 1, 2])::BIGINT FROM region"""
)
def project_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every symbol; of customers with its place in bytes, of others with a number by kind and name."""
    s = _facts(spark, sf_dir).symbols
    order = F.when(F.col("kind") == "class", 0).when(F.col("name").isin("of", "area"), 1).otherwise(2)
    return s.select("file", "kind", "name", F.when(F.col("name").startswith("customer"), F.col("start_byte")).otherwise(order).cast("long").alias("start"))


@query(
    f"""SELECT 'src/customers/c' || c || '.ts' AS file, '../nations' AS path, 'src/nations/index.ts' AS resolved FROM {_C}
UNION ALL SELECT 'src/customers/c' || c || '.ts', '../regions/r' || r, 'src/regions/r' || r || '.ts' FROM {_C}
UNION ALL SELECT 'src/nations/n' || n_nationkey || '.ts', '@/regions/r' || n_regionkey, 'src/regions/r' || n_regionkey || '.ts' FROM nation"""
)
def project_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark, sf_dir).imports.select("file", "path", "resolved")


_CALLS = f"""SELECT 'customer' || c AS caller, unnest(['Nation' || n, 'of', 'near' || r, 'greet']) AS target, unnest(['src/nations/n' || n || '.ts', 'src/nations/n' || n || '.ts', 'src/regions/r' || r || '.ts', 'src/nations/n' || n || '.ts']) AS file FROM {_C}
UNION ALL SELECT unnest(['of', 'greet']), unnest(['Nation' || n_nationkey, 'area']), unnest(['src/nations/n' || n_nationkey || '.ts', 'src/regions/r' || n_regionkey || '.ts']) FROM nation"""


@query(_CALLS)
def project_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with what it reaches: constructions and methods of locals by way of a barrel of defaults, static methods, namespaces, inherited
    methods."""
    f = _facts(spark, sf_dir)
    s = f.symbols.select("id", "name", "file")
    links = Resolution(f).calls().join(s.select(F.col("id").alias("caller_id"), F.col("name").alias("caller")), "caller_id")
    return links.join(s.select(F.col("id").alias("target_id"), F.col("name").alias("target"), "file"), "target_id").select("caller", "target", "file")


@query(
    f"""SELECT 'customer' || c AS symbol, unnest(['param:at', 'local:nation']) AS slot, unnest(['Nation' || n, 'Nation' || n]) AS target FROM {_C}
UNION ALL SELECT unnest(['of', 'Nation' || n_nationkey]), unnest(['return', 'extends']), unnest(['Nation' || n_nationkey, 'Region' || n_regionkey]) FROM nation"""
)
def project_type_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = Resolution(f := _facts(spark, sf_dir))
    s = f.symbols.select("id", "name")
    refs = type_refs(r).select("symbol_id", "slot", F.explode("targets").alias("t"))
    return refs.join(s.toDF("symbol_id", "symbol"), "symbol_id").join(s.toDF("t", "target"), "t").select("symbol", "slot", "target")


@query(
    f"""WITH g AS (SELECT n_nationkey AS n FROM nation WHERE n_regionkey = (SELECT min(n_regionkey) FROM nation))
SELECT 'src/nations/n' || n || '.ts' AS file, 'greet' AS name, 1 AS depth FROM g
UNION ALL SELECT 'src/customers/c' || c || '.ts', 'customer' || c, 2 FROM {_C} JOIN g USING (n)"""
)
def project_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What calls the first region's method, at two levels, without a cap."""
    f = _facts(spark, sf_dir)
    links = Resolution(f).calls()
    r = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.min("n_regionkey")).first()[0]
    start = f.symbols.where(f"name = 'area' and file = 'src/regions/r{r}.ts'").first().id
    found = graph.reach(links.select(F.col("target_id").alias("src"), F.col("caller_id").alias("dst")), [start], 2, 0)
    return found.join(f.symbols.select("id", "name", "file"), "id").select("file", "name", "depth")
