"""Each operator against a plain version, on whole small tables with nulls, empty and long texts, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomspan.llm import common, decontaminate, packing, pii, quality_fm, quality_rules, simhash, suffix_dedup, token_count, token_orc, toxicity
from loomspan.llm.components import components
from loomspan.llm.tokens import ByteBpe, default_path

RNG = random.Random(5)
WORDS = ["alpha", "Beta", "gämma", "delta", "x1", "the", "of", "RUN", "naïve", "日本", "end."]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS) + RNG.choice(["", ",", "\n", ""]) for _ in range(n))


COPY = prose(90)
ITEM = "which ONE of these seven words is not in the list of ten"
TEXTS: list[str | None] = [
    None, "", " \t\n", "one", "one two", COPY, COPY, COPY + " tail", "head " + COPY, prose(300), prose(3000), "a" * 1000, "ab " * 400, "日" * 500,
    f"{prose(20)} {ITEM.lower()} {prose(20)}", f"x {ITEM}", "short item", "mail jo.e+x@ex-a.co.uk, 10.0.0.255 and 10.0.0.256 or 1.2.3.4.5.6.7.8 card 4111 1111 1111 1111 or 4111-1111-1111-1112 call +1 (212) 555-0100.",
    "+" + "1 " * 5000, "1 " * 9000, "a@b" + ".c" * 9000, "@" * 50 + "a@b.c_d@e.f.", "line\n" * 30 + "other\nother \nline", "# * $ %\n" * 10,
    "tok <|endoftext|> en <s> ▁▁ x  y\r\n\x00 \x85 z don't I'LL ½²", "😀 ﬁ ­​" * 20,
]
ROWS = [(k, t) for k, t in enumerate(TEXTS)] + [(5, COPY), (None, "no id here"), (None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src", len(t or ""), 1, 0.5, True, "k", 7) for i, t in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words int, score double, kept boolean, key string, start int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df, *columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.select(*columns).collect())))


def lower(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_decontamination(spark, docs, none):
    items = [(1, ITEM), (2, "Short, ITEM"), (3, None), (4, "!!"), (5, COPY), (5, COPY), (10, ITEM)]
    table = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def plain(t):
        ws, hit, own = word.findall(lower(t)), set(), set()
        for i, x in items:
            xs = word.findall(lower(x))
            for w in {tuple(xs[k : k + 10]) for k in range(max(1, len(xs) - 9))} if xs else ():
                for k in range(len(ws) - len(w) + 1):
                    if tuple(ws[k : k + len(w)]) == w:
                        hit.update(range(k, k + len(w)))
                        own.add(str(i))
        return len(ws), len(hit), len(own), hashlib.sha256(",".join(sorted(own)).encode()).hexdigest(), bool(hit)

    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = sorted(repr((i, *plain(t))) for i, t in ROWS)
    assert rows(decontaminate.report(docs, table), *columns) == want
    assert rows(decontaminate.report(docs, table, block_bytes=200), *columns) == want  # many blocks
    spans = {r.doc_id: r.spans for r in decontaminate.scan(docs, table).collect()}
    assert TEXTS[15][spans[15][0].start : spans[15][0].end] == ITEM
    clean = [i for i, t in ROWS if not plain(t)[-1]]
    assert Counter(r.doc_id for r in decontaminate.keep_clean(docs, table).collect()) == Counter(clean)
    odd = table.withColumn("hits", F.lit(1)).withColumn("doc_id", F.lit("x"))  # clashing columns
    assert Counter(r.doc_id for r in decontaminate.keep_clean(docs, odd, block_bytes=200).collect()) == Counter(clean)
    assert rows(decontaminate.report(docs, odd), *columns) == want
    assert decontaminate.report(none, table).count() == 0 and decontaminate.report(docs, table.limit(0)).where("contaminated").count() == 0


def luhn(d: str) -> bool:
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0


def test_personal_data(spark, docs, none):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def valid(kind, v):
        d = re.sub("[^0-9]", "", v)
        return {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in v.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    def plain(t):
        found = [(k, m.start(), m.end()) for k, p in patterns.items() for m in re.finditer(p, t or "") if valid(k, m.group())]
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        return *(sum(f[0] == k for f in found) for k in patterns), hashlib.sha256(text.encode()).hexdigest()

    got = pii.report(docs)
    assert rows(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(repr((i, *plain(t))) for i, t in ROWS)
    assert pii.report(none).count() == 0
    clean = pii.redact(docs)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    text = clean.where("doc_id = 17").first().text
    assert all(x in text for x in ("[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "10.0.0.256", "4111-1111-1111-1112")) and not any(x in text for x in ("ex-a", "10.0.0.255", "4111 1111", "555-0100"))


@pytest.mark.parametrize("sep", [" ", "-", ""])
def test_cards_with_a_separator_after_every_digit(spark, sep):
    card = sep.join("4111111111111111")
    df = spark.createDataFrame([(1, f"pay with {card} now")], "doc_id long, text string")
    got = pii.report(df).first()
    assert got.n_card == 1 and got.spans == f"card:9:{9 + len(card)}"
    assert got.base_sha256 == hashlib.sha256(got.spans.encode()).hexdigest()
    assert pii.redact(df).first().text == "pay with [CARD] now"


def test_terms_that_give_an_entity_away(spark):
    rows_ = [(k, f"word{k} ask zorblax at z@example.org please {prose(5)}") for k in range(6)] + [(k, f"please word{k} {prose(30)}") for k in range(6, 60)]
    df = spark.createDataFrame(rows_, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert all("term:" in got[k].spans for k in range(6)) and not any(got[k].spans for k in range(6, 60))
    a = rows_[0][1].index("zorblax")
    assert f"term:{a}:{a + 7}" in got[0].spans and f"term:{rows_[0][1].index('please')}" not in got[0].spans
    assert "zorblax" not in pii.redact(df).where("doc_id = 0").first().text


def test_terms_count_and_are_marked_in_the_whole_document(spark):
    far = "Then a sentence follows that is longer than any window around the match would be. "
    numbers = ["+1 212 555 0100", "+1 (212) 555-0100", "+1-212-555-0100"]
    texts = [f"Word{k} Quuxly came. {far * k}{prose(4)} Call {numbers[k]} now. {far}And quuxly 😀 left, quuxlyx." for k in range(3)]
    texts += [f"{far}{prose(30)} Call me now." for _ in range(30)] + [None]
    ids = [1, None, 3, *range(4, 35)]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    for i, t in list(zip(ids, texts, strict=True))[:3]:
        at = [m.start() for m in re.finditer(r"(?i)\bquuxly\b", t)]
        assert len(at) == 2 and {f"term:{a}:{a + 6}" for a in at} <= set(got[i].spans.split(","))
        assert f"term:{t.index('Then a')}:" not in got[i].spans and f"term:{t.index('Word')}:" not in got[i].spans
    assert not any(got[i].spans for i in ids[3:])
    assert not any(re.search(r"(?i)\bquuxly\b|555", r.text or "") for r in pii.redact(df).collect())


def test_terms_and_counts_against_a_plain_version(spark):
    rng = random.Random(13)
    common, marks = [f"word{k}" for k in range(12)], ["quuxly", "quuxen", "zorblax", "abcd", "vexed"]
    mails = ["ann@x.org", "bob@x.org", "cy@x.org"]
    rows_ = []
    for k in range(90):
        words = [rng.choice(common) for _ in range(rng.randrange(3, 9))]
        who = rng.randrange(9)
        if who < 3:
            words += [mails[who], marks[who], marks[who].upper() + "s"] + ["abcd"] * (who == 1)
        if who in (3, 4):
            words += ["quuxing"] + ["vexed"] * (k % 2)
        rng.shuffle(words)
        rows_.append((k if k % 7 else None, " ".join(words)))
    rows_ += [rows_[3], rows_[3], (500, None), (501, "")]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    support, disclosure, n = 3, 0.9, len(rows_)
    texts = [t or "" for _, t in rows_]
    mail, word = re.compile(pii.PATTERNS["email"].replace("\\G", "^")), re.compile(r"(?<![^\W_])[^\W\d_]{3,}(?![^\W_])")
    entities = [{f"email:{m.group().lower()}" for m in mail.finditer(t)} for t in texts]
    terms = [{w.lower() for w in word.findall(t)} for t in texts]
    classes = [[w[: pii.STEM] for w in ws if len(w) >= pii.STEM] for ws in terms]

    def tells(e, x, of):
        n_e, n_x, n_ex = sum(e in a for a in entities), sum(list(b).count(x) for b in of), sum((e in a) * list(b).count(x) for a, b in zip(entities, of, strict=True))
        told = np.log2(n * n_ex / (n_e * n_x))
        return told > 0 and told >= disclosure * np.log2(n / n_e), n_e, n_ex, n_x

    want, by = set(), {}
    for e in set().union(*entities):
        for t in set().union(*terms):
            if len({x for x, a, b in zip(texts, entities, terms, strict=True) if e in a and t in b}) >= support and (got := tells(e, t, terms))[0]:
                by[e, t] = f"{t[: pii.STEM]}*" if len(t) > pii.STEM and not tells(e, t[: pii.STEM], classes)[0] else ""
                want.add((e, t, by[e, t], *got[1:]))
    found, _ = pii.find(df)
    held = df.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.coalesce("text", F.lit("")).alias("held")).distinct()
    whole = found.join(held, (found["h"] == held["h"]) & found["doc_id"].eqNullSafe(held["doc_id"])).select(found["*"], F.when(F.size("email") > 0, F.col("held")).alias("held"))
    got = pii.disclosing(common_materialize(whole), df.select(F.coalesce("text", F.lit("")).alias("text")), support=support, disclosure=disclosure)
    assert {tuple(r) for r in got.collect()} == want and {x[2] for x in want} >= {"", "quux*"}
    spans, clean = [], []
    for t, own in zip(texts, entities, strict=True):
        base = [(m.start(), m.end(), "[EMAIL]", "email") for m in mail.finditer(t)]
        more = [(m.start(), m.end(), min(x), "term") for m in word.finditer(t) if (x := [by[e, m.group().lower()] for e in own if (e, m.group().lower()) in by]) and not any(a < m.end() and m.start() < b for a, b, _, _ in base)]
        spans.append(",".join(f"{k}:{a}:{b}" for a, b, _, k in base + more))
        at, new = 0, ""
        for a, b, x, _ in sorted(base + more):
            new, at = new + t[at:a] + x, b
        clean.append(new + t[at:])
    assert sorted((repr(r.doc_id), r.spans) for r in pii.report(df).collect()) == sorted((repr(i), x) for (i, _), x in zip(rows_, spans, strict=True))
    assert sorted((repr(r.doc_id), r.text or "") for r in pii.redact(df).collect()) == sorted((repr(i), x) for (i, _), x in zip(rows_, clean, strict=True))


def common_materialize(df):
    return common.materialize(df, "test")


def test_simhash(spark, docs, none):
    def plain(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 3]).encode(), 42) for k in range(max(1, len(ws) - 2))] if ws else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0

    prints = [(i, plain(t)) for i, t in ROWS]
    group = list(range(len(prints)))

    def find(x):
        return x if group[x] == x else find(group[x])

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 3:
                group[find(a)] = find(b)
    least: dict[int, int | None] = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    want = sorted(repr((i, f"{p:016x}", least.get(find(k)))) for k, (i, p) in enumerate(prints))
    assert rows(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(k) for k in range(len(prints))})


@pytest.mark.parametrize("options", [{}, {"chunk": 7}, {"chunk": 2, "cells": 3}])
def test_links_within_clusters_and_hot_buckets(spark, options):
    rng = np.random.default_rng(2)
    fps = set()
    for c in rng.integers(0, 1 << 63, 6):
        x = int(c)
        for _ in range(60):  # walks, so that links chain
            x ^= 1 << int(rng.integers(64))
            fps.add(x)
    fps |= {int(x) for x in rng.integers(0, 1 << 63, 300)}
    own = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(x).astype(np.int64)),) for x in own], "fp long")
    got = {r.node: r.root for r in components(simhash.link(df, **options)).collect()}
    group = {x: x for x in own}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in own:
        for b in own:
            if b < a and (a ^ b).bit_count() <= 3:
                group[find(a)] = find(b)
    sign = lambda x: int(np.uint64(x).astype(np.int64))
    parts: dict[int, set[int]] = {}
    for x in own:
        parts.setdefault(find(x), set()).add(sign(x))
    want = {n: min(p) for p in parts.values() if len(p) > 1 for n in p}
    assert got == want


def test_cells_are_bounded():
    parts = simhash._parts(6, 3)
    assert len(parts) == 20 * 220 and max(64 - (m & (1 << 64) - 1).bit_count() for _, _, m in parts) <= 9


def test_coordinates_of_near_fingerprints_agree(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    y = x.copy()
    for _ in range(3):
        y ^= np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64)
    rows_ = [(int(a), int(b)) for a, b in zip(x.view(np.int64), y.view(np.int64), strict=True)]
    keys = simhash.bucket_keys
    df = spark.createDataFrame(rows_, "a long, b long").select(keys(F.col("a"), 6, 3).alias("p"), keys(F.col("b"), 6, 3).alias("q"), keys(F.reverse(F.array("a", "b"))[0], 6, 3).alias("r"))
    for r in df.collect():
        assert len(r.p) == 20 and any(p == q for p, q in zip(r.p, r.q, strict=True)) and r.q == r.r
    # Against the bits: a key holds, of each of its pairs of bits, in how many the fingerprint differs from the first pivot.
    differ = [int(x[0] ^ simhash._FIRST) >> 2 * k & 3 for k in range(32)]
    codes = []
    for own in simhash._group_of(6):
        code = 0
        for k in own:
            code = code * 3 + differ[k].bit_count()
        codes.append(code)
    assert df.first().p[0] == codes[0] + (codes[1] << 20) + (codes[2] << 40)


def test_a_hot_key_is_joined_where_its_rows_are(spark):
    df = spark.createDataFrame([(k % 50 if k % 3 else -1, k) for k in range(3000)], "key long, v long")
    counts = df.groupBy("key").agg(F.count("*").alias("n"))
    got = common.join_spread(df, counts, "key", share=10)
    assert sorted((r.key, r.v, r.n) for r in got.collect()) == sorted((r.key, r.v, r.n) for r in df.join(counts, "key").collect())


def _without_repeats(texts: list[bytes], depth: int = 200) -> list[tuple[int, int, int, str]]:
    times = Counter(hash(t[k : k + depth]) for t in texts for k in range(len(t) - depth + 1))
    out = []
    for t in texts:
        mark = bytearray(len(t))
        for k in range(len(t) - depth + 1):
            if times[hash(t[k : k + depth])] > 1:
                mark[k : k + depth] = b"\1" * depth
        kept = bytes(c for c, m in zip(t, mark, strict=True) if not m)
        out.append((len(t), sum(mark), len(re.findall(rb"\x01+", mark)), hashlib.sha256(kept).hexdigest()))
    return out


_REMOVED = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@pytest.mark.parametrize("room", [256, 1])
def test_repeated_substrings(spark, docs, none, room):
    want = sorted(repr((i, *x)) for (i, _), x in zip(ROWS, _without_repeats([(t or "").encode() for _, t in ROWS]), strict=True))
    assert rows(suffix_dedup.remove_repeats(docs, room=room), *_REMOVED) == want
    assert suffix_dedup.remove_repeats(none).count() == 0


@pytest.mark.parametrize("room", [512, 2])
def test_repeated_substrings_in_varying_surroundings(spark, room):
    """Passages that many texts share, cut at random, so that most windows of a gram differ."""
    rng = random.Random(21)
    shared = ["".join(rng.choice("abcdefgh ") for _ in range(700)) for _ in range(3)]
    texts = []
    for _ in range(120):
        a = rng.randrange(500)
        texts.append("".join(rng.choice("ijkl ") for _ in range(rng.randrange(200))) + rng.choice(shared)[a : a + rng.randrange(150, 500)] + "é" * rng.randrange(120))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, room=room, with_text=True)
    assert rows(got, *_REMOVED) == sorted(repr((i, *x)) for i, x in enumerate(_without_repeats([t.encode() for t in texts])))
    for r in got.collect():
        raw, at, kept = texts[r.doc_id].encode(), 0, b""
        for s in r.spans:
            kept, at = kept + raw[at : s.start], s.end
        assert kept + raw[at:] == r.kept


def test_repeats_in_equal_rows_and_in_texts_over_a_block(spark):
    rng = np.random.default_rng(4)
    long = bytes(rng.integers(97, 123, (1 << 20) + 150_000, dtype=np.uint8)).decode()
    long = long[:-1000] + long[(1 << 20) - 600 : (1 << 20) + 400]  # a repeat over the border of blocks
    one = bytes(rng.integers(97, 123, 3000, dtype=np.uint8)).decode()
    rows_ = [(1, long)] + [(2, one)] * 1000
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(4)
    (first,), equal = [suffix_dedup.remove_repeats(df).where(f"doc_id = {k}").collect() for k in (1, 2)]
    assert (first.n_removed, first.n_spans) == (2000, 2) and first.kept_sha256 == hashlib.sha256((long[: (1 << 20) - 600] + long[(1 << 20) + 400 : -1000]).encode()).hexdigest()
    assert len(equal) == 1000 and {(r.n_removed, r.n_spans, r.kept_sha256) for r in equal} == {(3000, 1, hashlib.sha256(b"").hexdigest())}


@pytest.mark.parametrize("depth", [32, 45, 200])
def test_radix_passes_find_equal_windows(depth):
    rng = random.Random(depth)
    pool = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(4)]
    regions = [(rng.choice(pool)[a : a + depth + rng.randrange(60)]).ljust(depth, "c").encode() for a in (rng.randrange(60) for _ in range(80))]
    group = np.array([k // 10 for k in range(80)])
    times = Counter((group[k], r[a : a + depth]) for k, r in enumerate(regions) for a in range(len(r) - depth + 1))
    want = {(k, a) for k, r in enumerate(regions) for a in range(len(r) - depth + 1) if times[group[k], r[a : a + depth]] > 1}
    own, place = suffix_dedup.repeated_windows(regions, group, depth)
    assert len(own) == len(want) and set(zip(own.tolist(), place.tolist(), strict=True)) == want


def test_rule_statistics(spark, docs, none):
    def plain(t):
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        own = [tuple(ws[k : k + 8]) for k in range(len(ws) - 7)]
        times, mark = Counter(own), [0] * len(ws)
        for k, w in enumerate(own):
            if times[w] > 1:
                mark[k : k + 8] = [1] * 8
        return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(mark), len(ws) < 20 or 100 * sum(mark) > 30 * len(ws)

    labels = spark.createDataFrame([(0, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels)
    assert rows(got, "doc_id", *quality_rules.COUNTS, "base_failed") == sorted(repr((i, *plain(t))) for i, t in ROWS)
    assert got.where("kept = base_failed").count() == 0  # no rules learned from one label
    assert quality_rules.judge(none, labels).count() == 0
    kept = quality_rules.keep(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not plain(t)[-1] for _, t in ROWS)


def test_rules_are_learned_and_leave_clean_rows():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_rules.FEATURES)))
    bad = (x[:, 2] > 0.9) | (x[:, 5] > 0.8) & (x[:, 1] < 0.3)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(len(x), bool)
    for r in rules:
        hit |= quality_rules._covered(r, x)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.02 * len(x)
    assert quality_rules.learn(x, rng.random(3000) < 0.1) == []


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    rows_ = []
    for k in range(700):
        body = [rng.choice(words) for _ in range(60)]
        junk, toxic = k % 6 == 0, k % 5 == 0
        if junk:
            body = [f"{w}###" for w in body]
        if toxic:
            body[rng.randrange(60)] = rng.choice(["vileword", "vileness"])
        text = "".join(f"{' '.join(body[a : a + 10])}. " for a in range(0, 60, 10))
        rows_.append((k, text, int(not junk), int(toxic)))
    df = spark.createDataFrame(rows_, "doc_id long, text string, quality int, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"), {r[0]: r for r in rows_}


def test_quality_classifier(spark, labelled, docs, none):
    df, labels, truth = labelled
    got = quality_fm.classify(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][2] for r in held) > 0.95 * len(held)
    odd = quality_fm.classify(docs, labels).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in odd)
    assert quality_fm.classify(none, labels).count() == 0
    assert {r.score for r in quality_fm.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_pairwise_sum_equals_all_pairs():
    m = quality_fm.Machine(np.zeros((len(quality_fm.STATISTICS), quality_fm.BINS - 1)))
    m.weight[:] = np.random.default_rng(1).normal(size=len(m.weight))
    at, value = np.array([3, 8, 9, 20]), np.array([0.5, 1, 2, 0.1], np.float32)
    score, _ = m.score(np.array([0, 4]), at, value)
    pairs = sum(float(m.vector[at[i]] @ m.vector[at[j]]) * value[i] * value[j] for i in range(4) for j in range(i))
    assert score[0] == pytest.approx(float(m.weight[at] @ value) + pairs, rel=1e-4)


def test_toxicity(spark, labelled, docs, none):
    df, labels, truth = labelled
    got = toxicity.classify(df, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id][3] for r in held) > 0.95 * len(held)
    found = next(r for r in held if r.predicted and r.sentences)
    assert "vile" in truth[found.doc_id][1][found.sentences[0].start : found.sentences[0].end]
    odd = toxicity.classify(docs, labels).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 for r in odd)
    assert toxicity.classify(none, labels).count() == 0


def test_noisy_or_and_its_gradient():
    rng = np.random.default_rng(3)
    m = toxicity.NoisyOr()
    m.bias = -2.0
    m.weight[:12] = rng.normal(size=12)
    sizes, counts, plain, y = np.array([2, 1, 3, 1, 2]), np.array([2, 0, 3]), np.array([1.0, 2.0, 0.0]), np.array([1.0, 0.0, 0.0])
    places = rng.integers(0, 12, sizes.sum())
    z = m.instances(places, sizes)
    at = np.concatenate(([0], np.cumsum(sizes)))
    p = [1 / (1 + np.exp(-(m.bias + sum(m.weight[x] for x in places[a:b])))) for a, b in zip(at, at[1:], strict=False)]
    p0 = 1 / (1 + np.exp(2.0))
    want = [1 - (1 - p[0]) * (1 - p[1]) * (1 - p0), 1 - (1 - p0) ** 2, 1 - (1 - p[2]) * (1 - p[3]) * (1 - p[4])]
    assert m.score(z, counts, plain) == pytest.approx(want)
    loss, touched, gw, gb = m.gradient(places, sizes, counts, plain, y)
    assert loss == pytest.approx(-(np.log(want[0]) + np.log(1 - want[1]) + np.log(1 - want[2])) / 3)

    def numeric(move):
        move(1e-5)
        up = m.gradient(places, sizes, counts, plain, y)[0]
        move(-2e-5)
        down = m.gradient(places, sizes, counts, plain, y)[0]
        move(1e-5)
        return (up - down) / 2e-5

    for place, g in zip(touched, gw, strict=True):
        assert numeric(lambda d, k=place: m.weight.__setitem__(k, m.weight[k] + d)) == pytest.approx(g, abs=1e-7)
    assert numeric(lambda d: setattr(m, "bias", m.bias + d)) == pytest.approx(gb, abs=1e-7)


def test_evidence_and_sentences(spark):
    table = np.array([[30.0, 70.0], [5.0, 395.0]])  # toxic with, without; others with, without
    n = table.sum()
    want = 2 * sum(x * np.log(x * n / (table[i].sum() * table[:, j].sum())) for i, r in enumerate(table) for j, x in enumerate(r))
    got = spark.range(1).select(toxicity.evidence_of(F.lit(35), F.lit(30), 500, 100).alias("g"), toxicity.evidence_of(F.lit(500), F.lit(100), 500, 100).alias("z")).first()
    assert got.g == pytest.approx(want) and got.z == pytest.approx(0, abs=1e-6)
    text = "One. two!? ... \n  \n#\nthree"
    assert [text[a:b] for a, b in toxicity.sentences(text)] == ["One.", " two!?", "three"]
    assert toxicity.sentences("# " * 500_000) == []


@pytest.mark.parametrize("column, classify", [("quality", quality_fm.classify), ("toxic", toxicity.classify)])
def test_odd_labels(spark, labelled, column, classify):
    """Null labels and ids, ids with several rows, clashing columns."""
    df, labels, _ = labelled
    odd = labels.withColumn("text", F.lit("x")).withColumn("score", F.lit("y")).unionByName(spark.createDataFrame([(1, None, None, "t", "s"), (None, 1, 1, "t", "s"), (2, 0, 1, "t", "s"), (2, 1, 0, "t", "s")], "doc_id long, quality int, toxic int, text string, score string"))
    got = classify(df.withColumn("quality", F.lit(3)).withColumn("label", F.lit(1)).withColumn("toxic", F.lit(2)), odd).collect()
    assert len(got) == 700 and all(0 <= r.score <= 1 for r in got)
    assert classify(df, labels.where(f"{column} = 1")).count() == 700  # one label only
    assert {r.score for r in classify(df, labels.where("false")).collect()} == {0.5}


def _ids(library, t):
    return [*library.encode(t or "", add_special_tokens=False).ids, 2]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(default_path("byte_bpe_50k.json"))


def test_ids_are_the_library_s(library):
    own = ByteBpe(default_path("byte_bpe_50k.json"))
    texts = [t for t in TEXTS if t is not None] + [prose(50) for _ in range(50)]
    rng = random.Random(9)
    texts += ["".join(rng.choice(" \n\t'abézß日12.!s") for _ in range(200)) for _ in range(300)]
    texts += [" ".join("".join(rng.choice("abcdefgéß19-") for _ in range(rng.randrange(1, 9))) for _ in range(40_000))]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing(spark, docs, none, library):
    got = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]), with_ids=True).collect()
    rooms: dict[int, list[tuple[int, int]]] = {}
    by: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
        by.setdefault(r.doc_id, []).append(r)
    for own in rooms.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    for i, own in by.items():
        ids = _ids(library, TEXTS[i])
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
        assert [x for r in own for x in r.ids] == ids and all(r.ids_crc32 == _crc(ids[r.start : r.start + r.length]) for r in own)
    total = sum(r.length for r in got)
    assert len(rooms) <= -(-total // 1024) + 2
    assert packing.pack(docs).count() >= len(ROWS) and packing.pack(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 7, 400, 20_000])
def test_plans_place_everything_once(n):
    lengths = np.minimum(1024, np.maximum(1, np.random.default_rng(n).lognormal(5.5, 1.2, n).astype(int)))
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    used: Counter = Counter()
    for length, ranks in ((x, sorted((r[1], r[2]) for r in plan_ if r[0] == x)) for plan_ in [packing.plan(counts, 1024)] for x in counts):
        at = 0
        for a, m in ranks:
            assert a == at
            at += m
        assert at == counts[length]
    for length, _, m, first, _ in packing.plan(counts, 1024):
        for k in range(m):
            used[first + k] += length
    assert all(x <= 1024 for x in used.values()) and len(used) <= 1.02 * lengths.sum() / 1024 + 3


def test_token_counts(spark, docs, none):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=default_path("piece_bpe_32k.model"))
    want = sorted(repr((i, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096)) for i, t in ROWS)
    assert rows(token_count.count_tokens(docs), "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_count.count_tokens(none).count() == 0
    merger = token_count.RankMerger(default_path("piece_bpe_32k.model"))
    texts = ["".join(RNG.choice("abcdeion t\n ▁é日12.") for _ in range(RNG.randint(1, 300))) for _ in range(300)]
    assert merger.count(texts) == [len(sp.encode(t)) for t in texts]


def test_orc_round_trip(spark, docs, none, library):
    want, at = [], 0
    single = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    for i, t in enumerate(TEXTS):
        ids = _ids(library, t)
        want.append((i, at, len(ids), _crc(ids)))
        at += len(ids)
    assert rows(token_orc.report(single), "doc_id", "start", "n_tokens", "ids_crc32") == sorted(map(repr, want))
    whole = token_orc.report(docs).collect()
    ends = sorted((r.start, r.n_tokens) for r in whole)
    assert len(whole) == len(ROWS) and all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:], strict=False))
    path = common.fresh_path(spark, "some.orc")
    token_orc.write(single, path)
    one = spark.read.orc(path).where("doc_id = 10").collect()
    assert len(one) == 1 and one[0].ids == _ids(library, TEXTS[10])
    assert token_orc.report(none).count() == 0


def test_shared_folder_is_the_session_s(spark):
    assert common.fresh_path(spark, "x").startswith(common.shared_dir(spark))
