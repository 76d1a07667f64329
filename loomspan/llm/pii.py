"""Personal data by fixed patterns, and information-theoretic sanitisation of the terms around it. Spark expressions only.

Base spans are matches of the patterns below that pass their check; a match that fails it is dropped and not tried again. Places are code
points: a text's parts between matches and the matches themselves, in turn, have lengths that add up to them.

A base match's kind and value (of cards and phones the digits) are a protected entity. Terms are words of three or more letters, anywhere
in a text. Over all documents, n(e,t) documents have both term t and entity e, n(t) have t, n(e) have e; of N, the pointwise mutual
information log2(N n(e,t) / (n(e) n(t))) says how many of the log2(N / n(e)) bits that tell e from others are told by t. A term that
tells a share of `disclosure` or more of them, in `support` or more different texts, gives the entity away: wherever it occurs in a
document that holds the entity, outside base spans, it is a span of kind "term". It is generalised to its class, the terms with its first
STEM letters, if the class doesn't tell as much of the entity; else (and if it has no more letters) it is removed. A class's n(c) and n(e,c)
are the sums of its terms' n(t) and n(e,t).
An entity of fewer than `support` different texts has no such term, whatever it occurs with.

Defined results: a null text is empty; repeated rows get a row each and count each, but not towards support; an empty table gives
no rows; other columns are ignored, and kept by redact().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, named, with_struct

# Kinds and their patterns, in order. Loops that nothing follows are possessive, so that long texts need no stack; a look
# behind (or the end of the last match) stops a search from starting anew within a run that has failed.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?=[0-9\x20-]{15})(?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
TERM = r"(?<![\p{L}\p{N}])\p{L}{3,}+(?![\p{L}\p{N}])"
KINDS = (*PATTERNS, "term")
STEM = 4
_SPAN = "struct<start:int,end:int,value:string>"


def _may_have(kind: str, t: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {"email": F.contains(t, F.lit("@")), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), "phone": F.contains(t, F.lit("+"))}[kind]


def _valid(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(8, 15)


def _matches(t: Column, pattern: str) -> Column:
    """All matches as (start, end, value)."""
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))

    def placed(values: Column) -> Column:
        def of(parts: Column) -> Column:
            def step(a: Column, x: Column) -> Column:
                start = a["at"] + F.length(x["part"])
                end = start + F.length(x["value"])
                return named(at=end, out=F.concat(a["out"], F.array(named(start=start, end=end, value=x["value"]))))

            zipped = F.arrays_zip(F.slice(parts, 1, F.size(values)).alias("part"), values.alias("value"))
            zero = named(at=F.lit(0), out=F.array().cast(f"array<{_SPAN}>"))
            return F.aggregate(zipped, zero, step, lambda a: a["out"])

        return F.when(F.size(values) > 0, let(F.split(t, pattern, -1), of)).otherwise(F.array().cast(f"array<{_SPAN}>"))

    return let(found, placed)


def _base(t: Column) -> dict[str, Column]:
    none = F.array().cast(f"array<{_SPAN}>")

    def of(k: str, p: str) -> Column:
        return F.when(_may_have(k, t), F.filter(_matches(t, p), lambda x: _valid(k, x["value"]))).otherwise(none)

    return {k: of(k, p) for k, p in PATTERNS.items()}


def _words(t: str) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(t, F.lit(TERM), F.lit(0)), F.lower))


def _common(found: DataFrame, support: int) -> DataFrame:
    """entity, n_e of entities in support or more different texts."""
    entities = F.array_distinct(F.concat(*(_entities(k) for k in PATTERNS)))
    by_text = found.select("h", F.explode(entities).alias("entity")).groupBy("entity", "h").agg(F.count("*").alias("n"))
    return by_text.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("n").alias("n_e")).where(F.col("texts") >= support).drop("texts")


def _holders(found: DataFrame, entities: DataFrame, salts: int = 16) -> DataFrame:
    """Rows of found (doc_id, h, held) for each of the entities they hold, with the columns of entities; hot entities are dealt by a salt."""
    own = F.array_distinct(F.concat(*(_entities(k) for k in PATTERNS)))
    rows = found.where("held is not null").select("doc_id", "h", "held", F.explode(own).alias("entity"), F.pmod("h", F.lit(salts)).alias("salt"))
    dealt = entities.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return rows.join(dealt, ["entity", "salt"]).drop("salt")


def _places(found: DataFrame, told: DataFrame) -> DataFrame:
    """doc_id, h, terms: where the terms told (doc_id, h, term, by) occur outside base spans. A row a word, as texts may be long."""
    key = ["doc_id", "h"]
    every = F.concat(*(F.transform(k, lambda x: named(a=x["start"], b=x["end"])) for k in PATTERNS))
    some = told.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h")).distinct()
    texts = found.where("held is not null").select(*key, "held", every.alias("base")).dropDuplicates(key)
    texts = texts.join(some, (texts["h"] == some["_h"]) & texts["doc_id"].eqNullSafe(some["_d"]), "left_semi")
    values = F.regexp_extract_all("held", F.lit(TERM), F.lit(0))
    zipped = let(values, lambda v: F.arrays_zip(F.slice(F.split("held", TERM, -1), 1, F.size(v)).alias("part"), v.alias("value")))
    words = texts.select(*key, "base", F.posexplode(zipped).alias("at", "x")).select(*key, "base", "at", F.length("x.part").alias("gap"), F.length("x.value").alias("n"), F.lower("x.value").alias("word"))
    before = Window.partitionBy(*key).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words = words.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(before).cast("int")).withColumn("start", F.col("end") - F.col("n"))
    free = ~F.exists("base", lambda b: (b["a"] < F.col("end")) & (F.col("start") < b["b"]))
    marks = told.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("term").alias("word"), "by")
    on = (words["h"] == marks["_h"]) & (words["word"] == marks["word"]) & words["doc_id"].eqNullSafe(marks["_d"])
    spans = words.where(free).join(marks, on).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end", "by"))).alias("terms"))
    return spans


def _tells(n: Column, both: str, entity: str, other: str, disclosure: float) -> Column:
    """Whether the other tells as much of the entity as gives it away."""
    told = F.log2(n * F.col(both) / (F.col(entity) * F.col(other)))
    return (told >= disclosure * F.log2(n / F.col(entity))) & (told > 0)


def disclosing(found: DataFrame, texts: DataFrame, *, support: int, disclosure: float) -> DataFrame:
    """entity, term, by (what the term is replaced by, '' if it is removed), and the counts n_e, n_et, n_term. found: as find() has it; texts: text."""
    spark = found.sparkSession
    n = F.lit(float(found.count()))
    entities = materialize(_common(found, support), "entities")
    by_text = _holders(found, entities).select("h", "entity", "n_e", F.explode(_words("held")).alias("term")).groupBy("entity", "n_e", "term", "h").agg(F.count("*").alias("n"))
    pairs = materialize(by_text.groupBy("entity", "n_e", "term").agg(F.count("*").alias("texts"), F.sum("n").alias("n_et")), "pairs")
    out = "entity string, term string, by string, n_e long, n_et long, n_term long"
    if pairs.where(F.col("texts") >= support).isEmpty():  # nothing to look up in the texts
        return spark.createDataFrame([], out)
    terms = materialize(texts.select(F.explode(_words("text")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "vocabulary")
    stem = F.when(F.length("term") >= STEM, F.substring("term", 1, STEM)).alias("class")
    told = pairs.where(F.col("texts") >= support).join(terms, "term").where(_tells(n, "n_et", "n_e", "n_term", disclosure))
    told = materialize(told.select("entity", "term", "n_e", "n_et", "n_term", F.when(F.length("term") > STEM, stem).alias("class")), "told")
    asked = told.where("class is not null").select("entity", "n_e", "class").distinct()
    n_classes = terms.select(stem, "n_term").where("class is not null").groupBy("class").agg(F.sum("n_term").alias("n_class"))
    both = pairs.select("entity", stem, "n_et").where("class is not null").groupBy("entity", "class").agg(F.sum("n_et").alias("n_ec"))
    general = asked.join(both, ["entity", "class"]).join(n_classes, "class").where(~_tells(n, "n_ec", "n_e", "n_class", disclosure)).select("entity", "class", F.lit(True).alias("general"))
    by = F.when(F.col("general"), F.concat("class", F.lit("*"))).otherwise("")
    return told.join(general, ["entity", "class"], "left").select("entity", "term", by.alias("by"), "n_e", "n_et", "n_term")


def find(docs: DataFrame, *, support: int = 3, disclosure: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(one row per row of docs: doc_id, h (hash of the text), a column of base spans (start, end, value) for each kind; for each doc_id and h
    with any: terms (start, end, by), terms that touch no base span)."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    staged = with_struct(texts.select("doc_id", F.xxhash64("text").alias("h"), "text"), let(F.col("text"), lambda t: F.struct(*(v.alias(k) for k, v in _base(t).items()))))
    held = F.when(sum((F.size(k) for k in PATTERNS), F.lit(0)) > 0, F.col("text")).alias("held")
    found = materialize(staged.select("doc_id", "h", *PATTERNS, held), "found", "zstd")
    told = materialize(disclosing(found, texts.select("text"), support=support, disclosure=disclosure), "terms")
    by_entity = told.groupBy("entity").agg(F.collect_list(F.struct("term", "by")).alias("told"))
    marked = _holders(found, by_entity).select("doc_id", "h", F.inline("told")).groupBy("doc_id", "h", "term").agg(F.min("by").alias("by"))
    return found.drop("held"), _places(found, materialize(marked, "marked"))


def _entities(kind: str) -> Column:
    plain = (lambda v: F.regexp_replace(v, "[^0-9]", "")) if kind in ("card", "phone") else F.lower
    return F.transform(kind, lambda x: F.concat(F.lit(f"{kind}:"), plain(x["value"])))


def _tagged(kind: str) -> Column:
    return F.transform(kind, lambda x: named(start=x["start"], end=x["end"], by=F.lit(f"[{kind.upper()}]")))


def _named(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda x: F.concat_ws(":", F.lit(kind), x["start"], x["end"]))


def report(docs: DataFrame, **options: float) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms."""
    found, terms = find(docs, **options)
    none = F.array().cast("array<struct<start:int,end:int,by:string>>")
    rows = found.join(terms, (found["h"] == terms["h"]) & found["doc_id"].eqNullSafe(terms["doc_id"]), "left").select(found["doc_id"], *PATTERNS, F.coalesce("terms", none).alias("term"))
    base = F.concat(*(_named(k, F.col(k)) for k in PATTERNS))
    return rows.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in PATTERNS),
        F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _named("term", F.col("term"))), ",").alias("spans"),
        F.size("term").cast("long").alias("n_terms"),
    )


def redact(docs: DataFrame, **options: float) -> DataFrame:
    """docs with base spans replaced by [KIND] and terms by their class (first letters and a star) or nothing; n_chars, where there is one, is that of the new text."""
    p = "__own_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    found, terms = find(docs, **options)
    # Spans are collected for the few texts that have any; equal rows have equal spans.
    tagged = F.concat(*(_tagged(k) for k in PATTERNS))
    base = found.select(F.col("doc_id").alias(p + "id"), F.col("h").alias(p + "h"), tagged.alias("spans")).where(F.size("spans") > 0).groupBy(p + "id", p + "h").agg(F.first("spans").alias("spans"))
    other = terms.select("doc_id", "h", F.transform("terms", lambda x: named(start=x["start"], end=x["end"], by=x["by"])).alias("more"))
    base = base.join(other, (F.col(p + "h") == other["h"]) & F.col(p + "id").eqNullSafe(other["doc_id"]), "left")
    spans = F.concat("spans", F.coalesce("more", F.array().cast("array<struct<start:int,end:int,by:string>>")))
    base = materialize(base.select(p + "id", p + "h", F.array_sort(spans).alias(p + "spans")), "spans")

    def step(a: Column, x: Column) -> Column:
        """Overlapping spans are replaced as one, by the first's name."""
        start, end = F.greatest(x["start"], a["at"]), F.greatest(x["end"], a["at"])
        return named(at=end, out=F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, start - a["at"]), F.when(x["start"] >= a["at"], x["by"]).otherwise("")))

    zero = named(at=F.lit(0), out=F.lit(""))
    new = F.aggregate(p + "spans", zero, step, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    keyed = docs.withColumn(p + "k", F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(base, (keyed[p + "k"] == base[p + "h"]) & keyed["doc_id"].eqNullSafe(base[p + "id"]), "left")
    joined = joined.withColumn(p + "t", F.when(F.col(p + "spans").isNotNull(), new).otherwise(F.col("text")))
    changed = {"text": F.col(p + "t")} | ({"n_chars": F.when(F.col(p + "spans").isNotNull(), F.length(p + "t").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return joined.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns))
