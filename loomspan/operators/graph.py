"""Bounded reachability and closures over edge tables.

Recursive SQL can't drop what was visited or keep the first k of a level, so levels are a loop on the driver. With a cap, a frontier has
at most that many ids, which is all the driver ever holds: they go back as an IN list; where ids are made from columns, near() puts it on these, so that Parquet scans can prune by it. Without a cap, levels
stay DataFrames and are checkpointed."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """Where checkpoints go: spark.checkpoint.dir; where that is unset, a folder of this machine, if all runs on one."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_loomspan_folder", None)
    if not root:
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = sc._loomspan_folder = tempfile.mkdtemp(prefix="loomspan-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(root)
    return root


def reach(edges: DataFrame, seeds: Sequence[str], depth: int, cap: int = 50, extra: Sequence[str] = (), goes_on: DataFrame | None = None, near: Callable[[list[str]], DataFrame] | None = None) -> DataFrame:
    """Level by level from seeds along edges (src, dst, and extra columns): id, depth, and for each extra column its distinct
    values on the edges that found the id at that level, sorted.

    Of a level, the cap least ids are kept (0: all); only these count as visited, so an id that was cut off may come back deeper. With
    goes_on (id), only ids in it are expanded. near, if given, says which edges leave some ids, so that a level reads only those."""
    spark = edges.sparkSession
    found = {x: F.array_sort(F.collect_set(x)).alias(x) for x in extra}
    visited, frontier, levels = set(seeds), sorted(set(seeds)), []
    schema = edges.select(F.col("dst").alias("id"), F.lit(0).alias("depth"), *(F.array(x).alias(x) for x in extra)).schema
    if cap > 0:
        for level in range(1, depth + 1):
            if not frontier:
                break
            front = edges.where(F.col("src").isin(frontier)) if near is None else near(frontier)
            rows = front.where(~F.col("dst").isin(sorted(visited))).groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n"), *found.values()).orderBy("id").limit(cap).drop("_n").collect()
            levels += [(r["id"], level, *(r[x] for x in extra)) for r in rows]
            ids = [r["id"] for r in rows]
            visited.update(ids)
            frontier = ids if goes_on is None else [r["id"] for r in goes_on.where(F.col("id").isin(ids)).select("id").distinct().collect()]
        return spark.createDataFrame(levels, schema)
    shared_folder(spark)
    seen = spark.createDataFrame([(x,) for x in frontier], "id string").withColumn("id", F.col("id").cast(schema["id"].dataType))
    front, out = seen, spark.createDataFrame([], schema)
    for level in range(1, depth + 1):
        met = edges.join(front.select(F.col("id").alias("src")), "src").join(seen.select(F.col("id").alias("dst")), "dst", "left_anti")
        rows = met.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("_n"), *found.values()).drop("_n").select("id", F.lit(level).alias("depth"), *extra).checkpoint()
        if rows.isEmpty():
            break
        out = out.unionByName(rows)
        seen = seen.union(rows.select("id")).distinct().checkpoint()
        front = rows.select("id") if goes_on is None else rows.select("id").join(goes_on.select("id").distinct(), "id", "left_semi")
    return out


def chain_closure(parents: DataFrame, node: str = "node", parent: str = "parent") -> DataFrame:
    """node, ancestor, depth: every ancestor on single-parent chains, itself at depth 0; a cycle ends where it would repeat.

    Pointer doubling: round k reaches 2 ** k further, so a chain of n needs log2(n) joins."""
    spark = parents.sparkSession
    shared_folder(spark)
    one = parents.where(F.col(parent).isNotNull()).select(F.col(node).alias("node"), F.col(parent).alias("ancestor"), F.lit(1).alias("depth"))
    nodes = parents.select(F.col(node).alias("node")).distinct()
    own = nodes.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))
    reached, step = one, 1
    before = -1
    while True:
        top = reached.where(F.col("depth") == step).select(F.col("node").alias("_n"), F.col("ancestor").alias("node"))
        more = top.join(reached, "node").select(F.col("_n").alias("node"), "ancestor", (F.col("depth") + step).alias("depth"))
        reached = reached.unionByName(more).where("node != ancestor").groupBy("node", "ancestor").agg(F.min("depth").alias("depth")).checkpoint()
        now = reached.count()
        if now == before:
            break
        before, step = now, step * 2
    return own.unionByName(reached)


def propagate(labels: DataFrame, bindings: DataFrame) -> DataFrame:
    """A fixpoint: labels (node, label) spread along bindings (node takes the label of source) until nothing changes; a node that has a
    label keeps it, and of several offered in one round it takes the least.

    Where no node has two sources, by pointer doubling: round k looks 2 ** k sources ahead, so a chain of n needs log2(n) joins. Else a
    round for each binding of the longest way."""
    shared_folder(labels.sparkSession)
    known = labels.groupBy("node").agg(F.min("label").alias("label")).checkpoint()
    open_ = bindings.select("node", "source").where("node is not null and source is not null").distinct().join(known.select("node"), "node", "left_anti").checkpoint()
    if open_.groupBy("node").count().where("count > 1").isEmpty():
        return known.unionByName(_doubled(known, open_))
    fresh = known
    while not fresh.isEmpty():
        offered = open_.join(fresh.select(F.col("node").alias("source"), "label"), "source").join(known.select("node"), "node", "left_anti")
        fresh = offered.groupBy("node").agg(F.min("label").alias("label")).checkpoint()
        known = known.unionByName(fresh).checkpoint()
    return known


def _doubled(known: DataFrame, open_: DataFrame) -> DataFrame:
    """node, label of what a label reaches along single sources. Nodes leave where their pointer ends, at a label or without one; as long
    as a way ends anywhere, each round ends some, so that what is left after a round without are cycles."""
    found, left = known.where("false"), open_.count()
    while left:
        here, ends = F.col("l.label"), F.col("o.source")
        step = open_.alias("n").join(known.alias("l"), F.col("n.source") == F.col("l.node"), "left").join(open_.alias("o"), F.col("n.source") == F.col("o.node"), "left")
        step = step.select(F.col("n.node").alias("node"), F.col("l.node").isNotNull().alias("done"), here.alias("label"), ends.alias("source")).checkpoint()
        fresh = step.where("done").select("node", "label")
        found, known = found.unionByName(fresh), known.unionByName(fresh)
        open_ = step.where("not done and source is not null").select("node", "source")
        before, left = left, open_.count()
        if left == before:
            break
    return found
