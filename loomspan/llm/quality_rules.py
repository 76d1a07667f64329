"""Quality rules: fixed base rules, then a learned decision list. Everything on texts is a Spark expression.

Statistics of a text (words are runs of other than ASCII white space):
n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_dup_lines (lines with a word, equal to an earlier line of
the text), n_repeat_words (words in 8-word windows that are found twice or more, the first included). Windows are compared by a
64-bit hash within their text.

Learning is by sequential covering: from labelled statistics, a rule grows as a conjunction of thresholds that tells low from high
quality best, on two thirds of what the rules before leave; it is pruned from the end on the other third, and is kept only while its
precision there holds. The list ends when no rule is good enough; what no rule rejects is kept. The list is one ordered CASE.

At most `sample` labelled rows are learned from (those with the least hash of their doc_id), so what the driver gets is bounded; the
parameter is the documented bound.

Defined results: a null or blank text has no words and fails the base rules; repeated rows get a row each; without labels of both
kinds there are no learned rules; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, with_struct

WINDOW = 8
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _repeat_words(windows: Column) -> Column:
    """Words in windows (an array of hashes, by place) that are found twice or more."""

    def covered(own: Column) -> Column:
        # (hash, place) in order; a window repeats if its neighbour on either side has its hash.
        again = F.filter(own, lambda x, k: (F.get(own, k - 1)["h"] == x["h"]) | (F.get(own, k + 1)["h"] == x["h"]))
        return F.aggregate(
            F.array_sort(F.transform(again, lambda x: x["i"])),
            F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda a, i: F.struct((a["n"] + F.least(i - a["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
            lambda a: a["n"],
        )

    pairs = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(pairs, covered))


def _counts(t: Column, prefix: str) -> Column:
    def less(x: Column) -> Column:
        return F.length(t) - F.length(x)

    def of(words: Column, lines: Column) -> Column:
        n = F.size(words)
        windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
        counts = {
            "n_words": n,
            "word_chars": F.length(F.translate(t, SPACES, "")),
            "n_symbols": less(F.translate(t, SYMBOLS, "")),
            "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_repeat_words": let(windows, _repeat_words),
            "n_distinct": F.size(F.array_distinct(words)),
            "n_lines": F.size(F.split(t, "\n")),
            "n_chars_text": F.length(t),
            "n_upper": less(F.regexp_replace(t, "\\p{Lu}", "")),
            "n_digits": less(F.translate(t, "0123456789", "")),
            "n_marks": less(F.translate(t, ".,;:!?", "")),
        }
        return F.struct(*(v.cast("long").alias(prefix + k) for k, v in counts.items()))

    words = F.array_remove(F.split(t, "[ \\t-\\r]+"), "")
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACES, "") != "")
    return let(words, lambda w: let(lines, lambda x: of(w, x)))


def with_counts(rows: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """rows with the statistics of the text column added, under prefix."""
    return with_struct(rows, let(F.coalesce(F.col(text), F.lit("")), lambda t: _counts(t, prefix)))


def base_failed(prefix: str = "") -> Column:
    n = F.col(f"{prefix}n_words")
    return (n < 20) | (100 * F.col(f"{prefix}n_repeat_words") > 30 * n)


#: What thresholds are put on: name, numerator, denominator (1 at least), both of them statistics.
FEATURES = (
    ("words", "n_words", None), ("word_length", "word_chars", "n_words"), ("symbol_share", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeat_share", "n_repeat_words", "n_words"),
    ("upper_share", "n_upper", "n_chars_text"), ("digit_share", "n_digits", "n_chars_text"), ("mark_share", "n_marks", "n_words"), ("distinct_share", "n_distinct", "n_words"), ("line_words", "n_words", "n_lines"),
)


def feature(k: int, prefix: str = "") -> Column:
    _, top, below = FEATURES[k]
    value = F.col(f"{prefix}{top}").cast("double")
    return value if below is None else value / F.greatest(F.col(f"{prefix}{below}"), F.lit(1))


@dataclass(frozen=True)
class Condition:
    feature: int
    over: bool  # over the threshold, or not over it
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        return (x[:, self.feature] > self.threshold) == self.over

    def column(self, prefix: str = "") -> Column:
        value = feature(self.feature, prefix)
        return value > self.threshold if self.over else value <= self.threshold

    def __str__(self) -> str:
        return f"{FEATURES[self.feature][0]} {'>' if self.over else '<='} {self.threshold:.4g}"


Rule = tuple[Condition, ...]


def _covered(rule: Sequence[Condition], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: np.ndarray, bad: np.ndarray, most: int, cuts: int) -> list[Condition]:
    """Adds the condition with the largest gain of information about the bad rows covered, until none is left that isn't."""
    rule: list[Condition] = []
    inside = np.ones(len(x), bool)
    while len(rule) < most:
        p0, n0 = bad[inside].sum(), (~bad[inside]).sum()
        if not p0 or not n0:
            break
        best, gain0 = None, np.log2(p0 / (p0 + n0))
        for f in range(x.shape[1]):
            v, b = x[inside, f], bad[inside]
            for t in np.unique(np.quantile(v[b], np.linspace(0, 1, cuts))):
                for over, held in ((True, v > t), (False, v <= t)):
                    p, n = (b & held).sum(), (~b & held).sum()
                    if p and (g := p * (np.log2(p / (p + n)) - gain0)) > (best[0] if best else 1e-9):
                        best = (g, Condition(f, over, float(t)))
        if best is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return rule


def learn(x: np.ndarray, bad: np.ndarray, *, precision: float = 0.85, least: int = 8, rules: int = 12, conditions: int = 3, cuts: int = 24) -> list[Rule]:
    """Ordered rules that reject. x: a row of FEATURES each; bad: label 0."""
    out: list[Rule] = []
    fold = np.arange(len(x)) % 3 == 2  # rows come in the order of a hash
    left = np.ones(len(x), bool)
    while len(out) < rules:
        grow, prune = left & ~fold, left & fold
        rule = _grow(x[grow], bad[grow], conditions, cuts) if bad[grow].sum() >= least else []

        def worth(r: Sequence[Condition], rows: np.ndarray = prune) -> float:
            c = _covered(r, x[rows])
            p, n = (bad[rows] & c).sum(), (~bad[rows] & c).sum()
            return (p - n) / (p + n) if p + n else -1

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        hit = _covered(rule, x) & left if rule else np.zeros(len(x), bool)
        p, n = (bad & hit).sum(), (~bad & hit).sum()
        # Both on all that is left and on the rows that it wasn't grown on, with one doubtful row counted against it.
        q, m = (bad & hit & fold).sum(), (~bad & hit & fold).sum()
        if p < least or p / (p + n) < precision or q / (q + m + 1) < precision - 0.1:
            break
        out.append(tuple(rule))
        left &= ~hit
    return out


def rejects(rules: Sequence[Rule], prefix: str = "") -> Column:
    """The number of the first rule that holds, null if none does: the decision list as an ordered CASE."""
    out = None
    for k, rule in enumerate(rules):
        held = rule[0].column(prefix)
        for c in rule[1:]:
            held = held & c.column(prefix)
        out = F.when(held, F.lit(k)) if out is None else out.when(held, F.lit(k))
    return F.lit(None).cast("int") if out is None else out


def learn_from(docs: DataFrame, labels: DataFrame, *, sample: int = 12_000, **options: float) -> list[Rule]:
    """Rules from docs (doc_id, text) that labels (doc_id, quality) covers and the base rules don't reject."""
    marked = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # counts as many rows, whatever the tables' sizes
    rows = with_counts(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    got = rows.where(~base_failed()).select(F.xxhash64("doc_id").alias("o"), "quality", F.array(*(feature(k) for k in range(len(FEATURES)))).alias("x")).collect()
    got.sort(key=lambda r: (r.o, r.x))
    x = np.array([r.x for r in got], float).reshape(-1, len(FEATURES))
    return learn(x, np.array([r.quality == 0 for r in got], bool), **options)


def judge(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """Per row of docs: doc_id, the statistics, base_failed, kept, rule (the number of the learned rule that rejects)."""
    rules = learn_from(docs, labels, **options)
    counted = with_counts(docs.select("doc_id", "text"))
    out = counted.select("doc_id", *COUNTS, base_failed().alias("base_failed"), rejects(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def keep(docs: DataFrame, labels: DataFrame, **options: float) -> DataFrame:
    """The rows of docs that no rule rejects, with their own columns only."""
    rules = learn_from(docs, labels, **options)
    p = "__own_"
    while any(c.startswith(p) for c in docs.columns):
        p += "_"
    counted = with_counts(docs, prefix=p)
    return counted.where(~base_failed(p) & rejects(rules, p).isNull()).select(*docs.columns)
