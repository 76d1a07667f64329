"""The operators on ordinary tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip_generics
from ..operators import graph, intervals, names
from ..sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- snapshots


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.hashes(t(spark, sf_dir, "documents"), "doc_id", "text")


@query("SELECT sha256(text) AS content_hash, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.more_than_one(files.hashes(t(spark, sf_dir, "documents"), "doc_id", "text"), ["content_hash"])


_SNAPSHOTS = """WITH o AS (SELECT doc_id, sha256(text || CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 11 <> 0),
d AS (SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' WHEN o.h IS NOT DISTINCT FROM n.h THEN 'unchanged' ELSE 'changed' END AS status
FROM o FULL OUTER JOIN n ON o.doc_id = n.doc_id) """


@query(_SNAPSHOTS + "SELECT doc_id, status FROM d")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents")
    edited = docs.where("doc_id % 7 <> 0").withColumn("text", F.concat("text", F.when(F.col("doc_id") % 5 == 0, "x").otherwise("")))
    return files.diff(files.hashes(edited, "doc_id", "text"), files.hashes(docs.where("doc_id % 11 <> 0"), "doc_id", "text"), "doc_id")


@query(_SNAPSHOTS + "SELECT " + ", ".join(f"count(*) FILTER (status = '{x}') AS {x}" for x in ("added", "changed", "removed", "unchanged")) + " FROM d")
def stale_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.summary(snapshot_diff(spark, sf_dir))


@query("SELECT 'customer' AS kind, c_custkey AS k FROM customer UNION SELECT 'supplier', s_suppkey FROM supplier UNION SELECT 'customer', o_custkey FROM orders UNION SELECT 'supplier', l_suppkey FROM lineitem")
def path_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [("customer", "customer", "c_custkey"), ("supplier", "supplier", "s_suppkey"), ("customer", "orders", "o_custkey"), ("supplier", "lineitem", "l_suppkey")]
    rows = [t(spark, sf_dir, x).select(F.lit(kind).alias("kind"), F.col(c).alias("k")) for kind, x, c in parts]
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3]).distinct()


# ---- lines and intervals

_LINES = """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
s AS (SELECT doc_id, i::INT AS line, (sum(strlen(l) + 1) OVER (PARTITION BY doc_id ORDER BY i) - strlen(l) - 1)::BIGINT AS start, strlen(l)::BIGINT AS n_bytes FROM p) """


@query(_LINES + "SELECT doc_id, line, start, n_bytes FROM s")
def line_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.lines(t(spark, sf_dir, "documents"), "doc_id", "text")


@query(_LINES + ", o AS (SELECT doc_id, unnest(range(0, strlen(text), 97))::BIGINT AS \"offset\" FROM documents) SELECT o.doc_id, o.\"offset\", s.line FROM o ASOF JOIN s ON o.doc_id = s.doc_id AND o.\"offset\" >= s.start")
def offset_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents")
    size = F.octet_length("text")
    return intervals.lines_at(docs.where(size > 0).withColumn("offsets", F.sequence(F.lit(0), size - 1, F.lit(97))), "doc_id", "text", "offsets")


#: In microseconds.
_DAY = 86_400_000_000
_EVENT_SPANS = """WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS s, epoch_us(ts) + (event_id % 50 + 1) * 600000000 AS x FROM events) """


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    return t(spark, sf_dir, "events").select("user_id", "event_id", "event_type", at.alias("start"), (at + (F.col("event_id") % 50 + 1) * 600000000).alias("end"))


_MERGE = "SELECT user_id, min(s) AS \"start\", max(x) AS \"end\" FROM (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY s, x ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN s <= max(x) OVER (PARTITION BY user_id ORDER BY s, x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS f FROM {0})) GROUP BY user_id, g"


@query(_EVENT_SPANS + _MERGE.format("e"))
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.merge(_spans(spark, sf_dir), ["user_id"], width=_DAY)


@query(
    _EVENT_SPANS
    + """, b AS (SELECT user_id, s AS p FROM e WHERE event_type IN ('purchase', 'error') UNION SELECT user_id, x FROM e WHERE event_type IN ('purchase', 'error')),
c AS (SELECT user_id, p AS s, lead(p) OVER (PARTITION BY user_id ORDER BY p) AS x FROM b),
k AS (SELECT * FROM c WHERE x IS NOT NULL AND EXISTS (SELECT 1 FROM e WHERE e.user_id = c.user_id AND event_type = 'purchase' AND e.s <= c.s AND c.x <= e.x) AND NOT EXISTS (SELECT 1 FROM e WHERE e.user_id = c.user_id AND event_type = 'error' AND e.s <= c.s AND c.x <= e.x)) """
    + _MERGE.format("k")
)
def interval_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    return intervals.subtract(spans.where("event_type = 'purchase'"), spans.where("event_type = 'error'"), ["user_id"])


@query(
    _EVENT_SPANS
    + """, p AS (SELECT user_id, event_id AS point_id, s AS ps, s + 1 AS pe FROM e WHERE event_type = 'click'),
r AS (SELECT p.*, e.event_id AS span_id, row_number() OVER (PARTITION BY p.point_id ORDER BY e.x - e.s, e.event_id) AS k FROM p LEFT JOIN e ON e.user_id = p.user_id AND e.event_type = 'view' AND e.s <= ps AND pe <= e.x)
SELECT point_id, user_id, ps, pe, span_id FROM r WHERE k = 1"""
)
def smallest_enclosing(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = _spans(spark, sf_dir)
    points = spans.where("event_type = 'click'").select("user_id", F.col("event_id").alias("point_id"), F.col("start").alias("ps"), (F.col("start") + 1).alias("pe"))
    views = spans.where("event_type = 'view'").withColumnRenamed("event_id", "span_id")
    return intervals.smallest_enclosing(points, views, ["user_id"], ("ps", "pe"), ("start", "end"), "point_id", "span_id", width=_DAY)


# ---- names

_WORDS = ("the", "und", "que", "les", "clown", "$x")


@query("SELECT doc_id, w AS word FROM documents, (VALUES " + ", ".join(f"('{w}', '{w.replace('$', chr(92) + '$')}')" for w in _WORDS) + ") v(w, q) WHERE regexp_matches(text, '(^|[^A-Za-z0-9_$])' || q || '([^A-Za-z0-9_$]|$)')")
def whole_word_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents")
    found = F.array_compact(F.array(*(F.when(names.whole_word(F.col("text"), w), w) for w in _WORDS)))
    return docs.select("doc_id", F.explode(found).alias("word"))


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type IN (SELECT min(p_type) FROM part UNION SELECT max(p_type) FROM part) AND regexp_matches(p_name, '(ring|bolt)') AND regexp_matches(p_brand, '[0-9]')")
def symbol_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = t(spark, sf_dir, "part")
    ends = part.agg(F.min("p_type"), F.max("p_type")).first()
    return names.matching(part, list(ends), "p_type", p_name="(ring|bolt)", p_brand="[0-9]").select("p_partkey", "p_name", "p_type")


_HREFS = "WITH h AS (SELECT page_id, url, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages) "


def _hrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href"))


@query(_HREFS + "SELECT page_id, href, count(*) AS n FROM h GROUP BY ALL")
def link_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hrefs(spark, sf_dir).groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query(
    _HREFS
    + """, r AS (SELECT DISTINCT page_id || '|' || href AS ref, url, href FROM h), c AS (
SELECT ref, 0 AS rank, page_id AS target FROM r JOIN pages p ON p.url = r.href UNION ALL
SELECT ref, 1, page_id FROM r JOIN pages p ON starts_with(r.href, '/') AND p.url = regexp_extract(r.url, '^[a-z]+://[^/]+') || r.href UNION ALL
SELECT ref, 2, page_id FROM r JOIN pages p ON starts_with(r.href, '/') AND regexp_extract(p.url, '^[a-z]+://[^/]+') = regexp_extract(r.url, '^[a-z]+://[^/]+')),
b AS (SELECT ref, rank, min(target) AS target, row_number() OVER (PARTITION BY ref ORDER BY rank) AS k FROM c GROUP BY ref, rank)
SELECT r.ref, b.target, b.rank::INT AS rank FROM r LEFT JOIN b ON b.ref = r.ref AND k = 1"""
)
def link_resolve_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = r"^[a-z]+://[^/]+"
    pages = t(spark, sf_dir, "pages").select(F.col("url").alias("at"), F.regexp_extract("url", host, 0).alias("at_host"), F.col("page_id").alias("target"))
    refs = _hrefs(spark, sf_dir).select(F.concat_ws("|", "page_id", "href").alias("ref"), "url", "href").distinct()
    rooted = refs.where(F.col("href").startswith("/")).withColumn("host", F.regexp_extract("url", host, 0))
    exact = refs.join(pages, refs["href"] == pages["at"])
    own = rooted.join(pages, F.concat("host", "href") == pages["at"])
    firsts = pages.groupBy("at_host").agg(F.min("target").alias("target"))
    near = rooted.join(firsts, rooted["host"] == firsts["at_host"])
    return names.resolve_ranked(refs.select("ref"), "ref", [exact, own, near])


_SYMBOLS = "WITH s AS (SELECT s_suppkey, s_nationkey, n_regionkey, s_suppkey % 40 AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey), c AS (SELECT c_custkey, c_nationkey, n_regionkey, c_custkey % 60 AS name FROM customer JOIN nation ON c_nationkey = n_nationkey) "


@query(
    _SYMBOLS
    + """, k AS (SELECT c_custkey, 0 AS rank, s_suppkey AS target FROM c JOIN s ON s.name = c.name AND s_nationkey = c_nationkey UNION ALL
SELECT c_custkey, 1, s_suppkey FROM c JOIN s ON s.name = c.name AND s.n_regionkey = c.n_regionkey UNION ALL
SELECT c_custkey, 2, u FROM c JOIN (SELECT name, min(s_suppkey) AS u FROM s GROUP BY name HAVING count(*) = 1) g ON g.name = c.name),
b AS (SELECT c_custkey, rank, min(target) AS target, row_number() OVER (PARTITION BY c_custkey ORDER BY rank) AS i FROM k GROUP BY c_custkey, rank)
SELECT c.c_custkey, b.target, b.rank::INT AS rank FROM c LEFT JOIN b ON b.c_custkey = c.c_custkey AND i = 1"""
)
def name_resolution_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    s = t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("target"), F.col("s_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), (F.col("s_suppkey") % 40).alias("name"))
    c = t(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("c_nationkey").alias("nation"), F.col("n_regionkey").alias("region"), (F.col("c_custkey") % 60).alias("name"))
    scopes = [s.groupBy("name", x).agg(F.min("target").alias("target")) for x in ("nation", "region")]
    return names.resolve_ranked(c.select("c_custkey"), "c_custkey", [c.join(scopes[0], ["name", "nation"]), c.join(scopes[1], ["name", "region"]), c.join(names.unique_by(s, ["name"], "target"), "name")])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1")
def default_first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.first_by(t(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_totalprice"])


@query("SELECT o_custkey, CAST(year(o_orderdate) AS INT) AS y, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1")
def multi_default_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.more_than_one(t(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate")), ["o_custkey", "y"])


@query("SELECT h AS content_hash, doc_id FROM (SELECT sha256(text) AS h, doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY lang IS NULL, lang, doc_id) AS k FROM documents) WHERE k = 1")
def prefer_named_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t(spark, sf_dir, "documents").select(F.sha2("text", 256).alias("content_hash"), F.col("lang").isNull().alias("none"), "lang", "doc_id")
    return names.first_by(docs, ["content_hash"], ["none", "lang", "doc_id"], ["doc_id"])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_details_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT o_orderkey, 'order ' || o_orderkey || ' {' || chr(10) || string_agg('    ' || l_linenumber || ': ' || l_partkey || ';', chr(10) ORDER BY l_linenumber, l_partkey) || chr(10) || '}' AS header FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def header_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("m"))
    own = t(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    members = F.transform("m", lambda x: F.concat(F.lit("    "), x["l_linenumber"].cast("string"), F.lit(": "), x["l_partkey"].cast("string"), F.lit(";")))
    return own.select("o_orderkey", F.concat(F.lit("order "), F.col("o_orderkey").cast("string"), F.lit(" {\n"), F.array_join(members, "\n"), F.lit("\n}")).alias("header"))


@query("WITH v(kind) AS (VALUES ('A'), ('B')) SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'Promise<Promise<' || c_mktsegment || '<x>>>' WHEN 1 THEN c_mktsegment || '[]' WHEN 2 THEN 'Promise<' || c_mktsegment || '>' WHEN 3 THEN 'Promise<' || c_mktsegment || '> | B' ELSE c_mktsegment END AS raw, CASE c_custkey % 5 WHEN 1 THEN c_mktsegment || '[]' WHEN 3 THEN 'Promise' ELSE c_mktsegment END AS base FROM customer")
def generic_stripping(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, x = F.col("c_custkey") % 5, F.col("c_mktsegment")
    raw = F.when(k == 0, F.concat(F.lit("Promise<Promise<"), x, F.lit("<x>>>"))).when(k == 1, F.concat(x, F.lit("[]"))).when(k == 2, F.concat(F.lit("Promise<"), x, F.lit(">"))).when(k == 3, F.concat(F.lit("Promise<"), x, F.lit("> | B"))).otherwise(x)
    return t(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")).withColumn("base", strip_generics(F.col("raw")))


# ---- graphs

_EDGES = "WITH g AS (SELECT 'c#' || o_custkey AS src, 'o#' || o_orderkey AS dst, o_orderstatus AS flag FROM orders UNION ALL SELECT 'o#' || l_orderkey, 'p#' || l_partkey, l_returnflag FROM lineitem UNION ALL SELECT 'p#' || l_partkey, 's#' || l_suppkey, l_returnflag FROM lineitem)"


#: What edges are made of: kinds of source and target, table, their columns, the flag's.
_PARTS = (("c#", "o#", "orders", "o_custkey", "o_orderkey", "o_orderstatus"), ("o#", "p#", "lineitem", "l_orderkey", "l_partkey", "l_returnflag"), ("p#", "s#", "lineitem", "l_partkey", "l_suppkey", "l_returnflag"))


def _edges(spark: SparkSession, sf_dir: str, ids: list[str] | None = None) -> DataFrame:
    """All edges, or those that leave ids: tables without any of their kind aren't read, the others by their own columns."""
    out = None
    for src, dst, table, a, b, flag in _PARTS:
        rows = t(spark, sf_dir, table)
        if ids is not None:
            own = [int(x[2:]) for x in ids if x.startswith(src)]
            if not own:
                continue
            rows = rows.where(F.col(a).isin(own))
        rows = rows.select(F.concat(F.lit(src), F.col(a).cast("string")).alias("src"), F.concat(F.lit(dst), F.col(b).cast("string")).alias("dst"), F.col(flag).alias("flag"))
        out = rows if out is None else out.unionByName(rows)
    return spark.createDataFrame([], "src string, dst string, flag string") if out is None else out


def _levels(seeds: str, src: str, dst: str, depth: int, cap: int, flags: bool = False) -> str:
    out, seen, sql = f"SELECT unnest([{seeds}]) AS id", "SELECT id FROM l0", _EDGES + ", l0 AS ("
    sql += out + ")"
    for k in range(1, depth + 1):
        limit = f" LIMIT {cap}" if cap else ""
        f = ", list_sort(list(DISTINCT flag)) AS flag" if flags else ""
        sql += f", l{k} AS (SELECT {dst} AS id{f} FROM g WHERE {src} IN (SELECT id FROM l{k - 1}) AND {dst} NOT IN ({seen}) GROUP BY {dst} ORDER BY 1{limit})"
        seen += f" UNION ALL SELECT id FROM l{k}"
    return sql + " " + " UNION ALL ".join(f"SELECT id, {k}::INT AS depth{', flag' if flags else ''} FROM l{k}" for k in range(1, depth + 1))


@query(_levels("'c#1', 'c#2'", "src", "dst", 3, 50))
def reach_callees_d3_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), ["c#1", "c#2"], 3, 50, near=lambda ids: _edges(spark, sf_dir, ids))


@query(_levels("'p#3'", "dst", "src", 2, 0))
def reach_callers_d2(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = _edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(back, ["p#3"], 2, 0)


@query(_levels("'c#4'", "src", "dst", 3, 20, True))
def type_reach_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reach(_edges(spark, sf_dir), ["c#4"], 3, 20, ["flag"], near=lambda ids: _edges(spark, sf_dir, ids))


@query(
    """WITH RECURSIVE p AS (SELECT conv_id || '/' || turn AS node, CASE WHEN turn > 0 THEN conv_id || '/' || (turn - 1) END AS parent FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
r AS (SELECT node, node AS ancestor, 0 AS depth FROM p UNION ALL SELECT r.node, p.parent, r.depth + 1 FROM r JOIN p ON p.node = r.ancestor WHERE p.parent IS NOT NULL) SELECT node, ancestor, depth FROM r"""
)
def class_chain_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    own = F.concat_ws("/", "conv_id", "turn")
    parent = F.when(F.col("turn") > 0, F.concat_ws("/", F.col("conv_id"), F.col("turn") - 1))
    return graph.chain_closure(rows.select(own.alias("node"), parent.alias("parent")))


@query(
    """WITH RECURSIVE e AS (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type FROM events),
r AS (SELECT event_id AS node, event_type AS label FROM e WHERE event_type IN ('signup', 'error') UNION ALL
SELECT e.event_id, r.label FROM r JOIN e ON e.source = r.node WHERE e.event_type NOT IN ('signup', 'error')) SELECT node, label FROM r"""
)
def fixpoint_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("node"), F.lag("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("source"), "event_type")
    known = F.col("event_type").isin("signup", "error")
    return graph.propagate(e.where(known).select("node", F.col("event_type").alias("label")), e.where(~known & F.col("source").isNotNull()).select("node", "source"))
