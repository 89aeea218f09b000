"""Quality rules: base statistics and a learned decision list, as Spark expressions only.

A decision list is learned by sequential covering: each rule grows as a conjunction of thresholds on two thirds of the
labelled statistics, is pruned on the rest, and is kept if it is precise enough; what it covers is then set aside. The
ordered rules become one conditional expression. Fitting uses a bounded sample of labelled rows (``MAX_LABELLED``);
statistics and verdicts cover every row and the whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import WORD_BREAK, table

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Words among which distinct ones are counted, so that their share doesn't fall with the length of a text.
CHUNK = 200
#: Bound of the labelled rows that a list is fitted on; a hash of doc_id chooses them when there are more.
MAX_LABELLED = 20_000
FEATURES = ("symbol_rate", "dup_line_rate", "repeat_rate", "mean_word", "upper_rate", "distinct_rate")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def with_stats(df: DataFrame, text: str = "text") -> DataFrame:
    """df and the base counts (long) and FEATURES (double) of each whole text.

    Words are runs of anything but space and the controls 9 to 13. A null text counts as empty; an empty one has zero
    counts and rates. Repeated windows are found by 64-bit hashes of hashed words. Columns of these names are replaced.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, WORD_BREAK), "")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    made = [*BASE, *FEATURES, "_h", "_w", "_s", "_lines", "_distinct", "_upper"]
    kept = [c for c in df.columns if c not in made]
    out = df.select(
        *kept,
        F.transform(words, lambda x: F.xxhash64(x)).alias("_h"),
        F.length(F.regexp_replace(t, WORD_BREAK, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))).alias("_upper"),
        lines.alias("_lines"),
    )
    h, n = F.col("_h"), F.size("_h")
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    near = F.aggregate(chunks, F.lit(0), lambda acc, i: acc + F.size(F.array_distinct(F.slice(h, i * CHUNK + 1, CHUNK))))
    near = F.when(n > 0, near).otherwise(0)
    out = out.select(
        *kept,
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "_upper",
        near.alias("_distinct"),
        F.size("_lines").alias("_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")).alias("_w"),
    )
    w = F.col("_w")
    paired = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    out = out.withColumn("_s", F.when(F.size(F.array_distinct(w)) < F.size(w), paired)).drop("_w")
    s = F.col("_s")
    twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
    starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(
        starts,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n")),
        lambda acc: acc["n"],
    )
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_s")
    many = F.greatest("n_words", F.lit(1))
    rates = {
        "symbol_rate": F.col("n_symbols") / many,
        "dup_line_rate": F.col("n_dup_lines") / F.greatest("_lines", F.lit(1)),
        "repeat_rate": F.col("n_repeat_words") / many,
        "mean_word": F.col("word_chars") / many,
        "upper_rate": F.col("_upper") / F.greatest("word_chars", F.lit(1)),
        "distinct_rate": F.col("_distinct") / many,
    }
    made_here = F.struct(*BASE, *[x.cast("double").alias(c) for c, x in rates.items()])
    # A generator, so that a filter on these columns isn't pushed below the arrays and makes them anew for each element.
    return out.select(*kept, F.inline(F.array(made_here)))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] > self.threshold if self.above else x[self.feature] <= self.threshold

    def column(self) -> Column:
        c = F.col(self.feature)
        return c > self.threshold if self.above else c <= self.threshold


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, dtype=bool)
    for condition in rule:
        held &= condition.holds(x)
    return held


def _grow(x: dict[str, np.ndarray], y: np.ndarray, longest: int) -> Rule:
    """Adds the condition of the greatest FOIL gain until only positives are covered."""
    rule: Rule = ()
    held = np.ones(len(y), dtype=bool)
    while len(rule) < longest and (~y[held]).any() and y[held].any():
        p, n, best = y[held].sum(), held.sum(), (1e-9, None)
        for feature, values in x.items():
            v, own = values[held], y[held]
            order = np.argsort(v, kind="stable")
            v, hits = v[order], np.cumsum(own[order])
            cuts = np.flatnonzero(v[1:] > v[:-1])
            if not len(cuts):
                continue
            low_p, low_n = hits[cuts], cuts + 1
            for above, q, m in ((False, low_p, low_n), (True, p - low_p, n - low_n)):
                gain = np.where(q > 0, q * (np.log2(np.maximum(q, 1) / m) - np.log2(p / n)), 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], Condition(feature, above, float((v[cuts[k]] + v[cuts[k] + 1]) / 2)))
        if best[1] is None:
            break
        rule += (best[1],)
        held &= best[1].holds(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], y: np.ndarray) -> Rule:
    """The shortest prefix of the greatest (p - n) / (p + n) on rows that the rule wasn't grown on."""

    def worth(k: int) -> float:
        held = covers(rule[:k], x, len(y))
        return (2 * y[held].sum() - held.sum()) / held.sum() if held.any() else -1.0

    return rule[: max(range(1, len(rule) + 1), key=lambda k: (worth(k), -k))] if rule else rule


def learn(rows: list[tuple], features: tuple[str, ...] = FEATURES, most: int = 8, longest: int = 3, precision: float = 0.9, least: int = 3) -> list[Rule]:
    """An ordered decision list for the rows whose last entry is true; the others are features in order.

    A rule is kept if it covers ``least`` true rows and at least ``precision`` of what it covers is true. No rows, or
    rows of one class, give no rules.
    """
    data = np.array([r[:-1] for r in rows], dtype=float).reshape(len(rows), len(features))
    x, y = dict(zip(features, data.T, strict=True)), np.array([bool(r[-1]) for r in rows], dtype=bool)
    part = np.arange(len(y)) % 3 == 2
    free, rules = np.ones(len(y), dtype=bool), []
    for _ in range(most):
        grown, held_back = free & ~part, free & part
        if not y[grown].any() or y[grown].all():
            break
        rule = _grow({c: v[grown] for c, v in x.items()}, y[grown], longest)
        rule = _prune(rule, {c: v[held_back] for c, v in x.items()}, y[held_back])
        held = covers(rule, x, len(y)) & free
        if not rule or y[held].sum() < least or y[held].mean() < precision:
            break
        rules.append(rule)
        free &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule, in order, rejects."""
    out = None
    for rule in rules:
        held = rule[0].column()
        for condition in rule[1:]:
            held = held & condition.column()
        out = F.when(held, F.lit(False)) if out is None else out.when(held, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def labelled_sample(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, label) of about ``most`` labelled documents at most, one row each: the smallest label of a document.

    The share that a hash of doc_id lets in follows from the number of labels, so the same rows come in any order.
    """
    once = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).alias(label))
    share = min(1.0, most / max(1, once.count()))
    return once.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> list[Rule]:
    """The list that finds documents of quality 0, from a bounded sample of labelled ones."""
    sample = labelled_sample(labels, "quality", most)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("quality").alias("quality"))
    stats = with_stats(chosen).where("n_words >= 10 and 100 * n_repeat_words <= 20 * n_words")
    rows = stats.select("doc_id", *FEATURES, (F.col("quality") == 0).alias("bad")).collect()
    return learn([tuple(r)[1:] for r in sorted(rows)])


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """docs with statistics, base_failed and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = with_stats(docs.drop("base_failed", "kept")).withColumn("base_failed", failed)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the base counts, base_failed and kept for every row of documents.

    Null and empty texts have no words and fail the base rules. Rows without an id are judged but not learned from; of
    several texts of a labelled id the one of the smallest hash is learned from. Repeated rows stay repeated; without
    labels the base rules decide alone; an empty table gives an empty result; other columns are not read.
    """
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = judge(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", *BASE, "base_failed", "kept")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, with the columns of docs."""
    named = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return judge(named, fit(docs, labels)).where("kept").select("row.*")
