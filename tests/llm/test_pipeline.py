from __future__ import annotations

import random

import corpus_pipeline
from loomspan.llm import queries, simhash


def test_stages_keep_columns_and_clean_documents(spark, tmp_path):
    clean = [" ".join(f"w{k}x{(j * 7 + k) % 97}" for j in range(80)) for k in range(12)]
    item = "this very sentence of ten words is a benchmark item now"
    texts = [*clean, clean[0], clean[1] + " extra", "too short", f"{clean[2][::-1]} {item}", clean[3].replace("w3x", "q") + " write to a@b.org", None]
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or ""), k) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, n_words int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, ids = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, at, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in at.select("doc_id").collect()})
    assert ids[0] == set(range(18)) - {14, 17}
    assert 12 not in ids[1] and set(range(12)) <= ids[1]
    assert ids[2] == ids[1] - {15}
    assert ids[3] == ids[2] == ids[4]
    texts_after = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "pii")).collect()}
    assert "[EMAIL]" in texts_after[16] and texts_after[4] == clean[4]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == ids[4]


def test_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, an empty benchmark, no labels; then only null texts; then no rows."""
    text = " ".join(f"w{j}" for j in range(40))
    kinds = "doc_id long, text string, lang string, source string, n_chars long, score double, key string"
    rows = [(1, text, "en", "s", 9, 0.5, "k"), (1, text, "en", "s", 9, 0.5, "k"), (2, None, None, None, None, None, None), (None, text.replace("w", "v"), None, None, None, None, None), (None, None, None, None, None, None, None)]
    empty = {"benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}
    for name, own, want in (("mixed", rows, {1, None}), ("null", [rows[2], rows[4]], set()), ("none", [], set())):
        home = tmp_path / name
        spark.createDataFrame(own, kinds).write.parquet(str(home / "documents.parquet"))
        for k, v in empty.items():
            spark.createDataFrame([], v).write.parquet(str(home / f"{k}.parquet"))
        got = corpus_pipeline.run(spark, str(home)).collect()
        assert {r.doc_id for r in got} == want and len(got) == len(want), name


def test_dedup_stage_keeps_one_of_texts_at_0_8(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(rng.randrange(40, 200))) for _ in range(40)]
    for t in texts[:30]:
        words = t.split()
        for _ in range(rng.randrange(1, 6)):  # each change touches five shingles
            words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], "  ".join(texts[1].upper().split()), "", " ", None, "one two", "One  two"]
    texts += ["the same long line in every text " * 3 + " ".join(str(rng.random()) for _ in range(40)) for _ in range(20)]

    def shingles(t):
        ws = (t or "").lower().split()
        return {" ".join(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()

    sets, group = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        return x if group[x] == x else find(group[x])

    for a in range(len(texts)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((find(a), find(b)))
                group[high] = low
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {find(k) for k in range(len(texts))}
    assert 50 < len(want) < len(texts) - 15
    assert {r.doc_id for r in corpus_pipeline.dedup_stage(spark, docs, "").collect()} == want
    small = simhash.keep_one(docs, width=5, most=24, alike=0.8, chunk=2)  # buckets dealt in chunks
    assert sorted(r.doc_id for r in small.collect()) == sorted(want)
    assert corpus_pipeline.dedup_stage(spark, docs.limit(0), "").count() == 0


def test_every_operator_is_registered():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.queries()) == list(range(1, 11))
