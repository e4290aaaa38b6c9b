"""Toxicity by a counterfactually regularised classifier.

A logistic model over the words of a text, how words begin, and beginnings that recur. It is fit on labelled documents; for each
labelled sentence that names a group of people, the name is also swapped for others of its kind, and the
difference that the swap makes to the score is penalised. So a score can't lean on which group is named, and
neutral mentions are not taken for toxic ones.

The fit uses at most `SAMPLE` labelled documents per class (those with the least hash of their id), weighted
back to the true share of their class. Swaps that change the same features are one pair with their number as its
weight; the `PAIRS` most frequent pairs take part (ties: least hash), all if there are no more. Features are the `FEATURES` that are most significantly more frequent in
toxic ones, and all group names. Weights are not negative: harmless words can't make up for toxic ones in a long
text. Scoring covers every whole text, with the weights (bounded by
`FEATURES`) sent along with the tasks. Labels, language, source and ids are no inputs of a score.

Defined results: null and empty texts have no words and get the score of the intercept. A document id that is
repeated in the labels counts as toxic if any of its rows says so; rows without id or label are not used. Of a
labelled document id that is repeated the text of the least hash takes part in the fit (null only if all are).
Without any labelled row, or with one class only, every score is the share of toxic labels (0 without any).
Null ids are not held out. Repeated documents are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import read_table, text_batches
from tapewatch.llm.tokens import utf8
from tapewatch.session import stage

#: Labelled documents per class in the fit, features besides group names, and their least significance.
SAMPLE, FEATURES, SIGNIFICANT = 15_000, 2_000, 2.0
#: Distinct pairs of what a swap adds and removes in the fit, at most; the driver holds them.
PAIRS = 50_000
#: Features that a task counts before it hands on the counts.
HELD = 100_000
#: Bytes of a word's beginning that are features, in ascending order.
BEGINNINGS = (4, 5, 6, 7, 8)
RIDGE, FAIR, STEPS = 1e-5, 1.0, 400
#: The intercept stays at or above this: without any toxic word a text still scores 3 %.
FLOOR = -3.5
THRESHOLD = 0.7
#: Names of groups of people by kind. Fixed values.
GROUPS = (
    ("women", "men", "girls", "boys", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "heterosexual", "homosexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic", "sikh"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics", "sikhs"),
    ("black", "white", "asian", "latino", "hispanic", "african", "european", "indigenous"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "elderly", "teenagers"),
    ("disabled", "blind", "deaf", "autistic", "paralyzed"),
)
KIND = {name.encode(): [x.encode() for x in kind if x != name] for kind in GROUPS for name in kind}
#: A-Z to a-z, other ASCII but letters to spaces.
LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 97 <= i <= 122 else 32 for i in range(256))
SENTENCE = re.compile(rb"[.!?\n]+")


def words(text: bytes | None) -> Counter:
    """How often each word occurs."""
    return Counter((text or b"").translate(LETTERS).split())


def features(bag: Counter, known: frozenset[bytes] | None = None) -> set[bytes]:
    """The words of a bag, the beginnings of its words (`^`), and those that occur more than once (`2`).

    With `known`, only beginnings among these are looked at.
    """
    stems: dict[bytes, int] = {}
    for word, n in bag.items():
        for size in BEGINNINGS:
            if size > len(word):
                break
            stem = word[:size]
            if known is None or stem in known:
                stems[stem] = stems.get(stem, 0) + n
    found = {b"^" + stem for stem in stems}
    found.update([b"2" + stem for stem, n in stems.items() if n > 1])
    return found.union(bag)


def stems_of(names: Iterable[bytes]) -> frozenset[bytes]:
    return frozenset(n[1:] for n in names if n[:1] in (b"^", b"2"))


@dataclass
class Model:
    weights: dict[bytes, float]
    intercept: float

    def __post_init__(self):
        self.stems = stems_of(self.weights)

    def score(self, text: bytes | None) -> float:
        found = features(words(text), self.stems) & self.weights.keys()
        total = self.intercept + sum(sorted(self.weights[name] for name in found))
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, limit: int) -> tuple[DataFrame, dict[int, float]]:
    """Labelled documents (text, toxic) outside the held-out fold, at most `limit` per class, and class weights."""
    usable = labels.where(F.col(doc_id).isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col(doc_id)))
    one = usable.groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in one.groupBy("toxic").count().collect()}
    picked = None
    for toxic in (0, 1):
        part = one.where(F.col("toxic") == toxic).orderBy(F.xxhash64("_id"), "_id").limit(limit)
        picked = part if picked is None else picked.union(part)
    # At most 2 x limit ids: bounded by a parameter, and one text for each. Repeats meet after partial minima.
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text")).join(
        F.broadcast(stage(picked, "picked")), "_id")
    rows = found.groupBy("_id", "toxic").agg(
        F.min(F.struct(F.isnull("text").alias("none"), F.xxhash64("text").alias("hash"), "text")).alias("_least")
    ).select("_least.text", "toxic")
    total = sum(counts.values()) or 1
    return (stage(rows, "labelled"),
            {toxic: counts.get(toxic, 0) / total for toxic in (0, 1)})


def _choose(rows: DataFrame, n_rows: dict[int, int], limit: int) -> list[bytes]:
    """The features that are most significantly more frequent in toxic documents, by their log odds."""
    def count(batches):
        import pyarrow as pa

        def counted():
            names = list(seen[0].keys() | seen[1].keys())
            return pa.RecordBatch.from_arrays([
                pa.array(names, pa.binary()), *[pa.array([c[n] for n in names], pa.int64()) for c in seen]],
                ["name", "clean", "toxic"])

        seen = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                seen[toxic].update(features(words(text)))
                if len(seen[0]) + len(seen[1]) > HELD:
                    yield counted()
                    seen = (Counter(), Counter())
        yield counted()

    sums = rows.mapInArrow(count, "name binary, clean long, toxic long").groupBy("name").agg(
        (F.sum("clean") + F.lit(0.5)).alias("c"), (F.sum("toxic") + F.lit(0.5)).alias("t"))
    odds = F.log(F.col("t") / (n_rows[1] + 1 - F.col("t"))) - F.log(F.col("c") / (n_rows[0] + 1 - F.col("c")))
    z = odds / F.sqrt(1 / F.col("t") + 1 / F.col("c"))
    best = sums.select("name", z.alias("z")).where(F.col("z") >= SIGNIFICANT).orderBy(F.desc("z"), "name").limit(limit)
    return [bytes(r["name"]) for r in best.collect()]


def _examples(rows: DataFrame, names: list[bytes], limit: int = PAIRS) -> tuple[list, list, Counter]:
    """Per labelled document its class and features; how many swaps of sentences add and remove which features."""
    index = {name: i for i, name in enumerate(names)}
    stems = stems_of(names)

    def ids(bag: Counter) -> set[int]:
        return {index[f] for f in features(bag, stems) if f in index}

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            kind, plus, minus = [], [], []
            for text, toxic in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                bag = words(text)
                kind.append(toxic), plus.append(sorted(ids(bag))), minus.append([])
                if not KIND.keys().isdisjoint(bag.keys()):
                    for sentence in SENTENCE.split(text):
                        here = words(sentence)
                        for name in sorted(KIND.keys() & here.keys()):
                            for other in KIND[name]:
                                swapped = here + Counter({other: here[name]})
                                del swapped[name]
                                a, b = ids(here), ids(swapped)
                                kind.append(2), plus.append(sorted(a - b)), minus.append(sorted(b - a))
            yield pa.RecordBatch.from_arrays([
                pa.array(kind, pa.int32()), *[pa.array(x, pa.list_(pa.int32())) for x in (plus, minus)]],
                ["kind", "plus", "minus"])

    table = rows.mapInArrow(encode, "kind int, plus array<int>, minus array<int>")
    pairs = table.where("kind = 2").groupBy("plus", "minus").agg(F.count("*").alias("n")).orderBy(
        F.desc("n"), F.xxhash64("plus", "minus"), "plus", "minus").limit(limit)
    got = table.where("kind < 2").toArrow()
    swaps = pairs.toArrow()
    return got.column("kind").to_pylist(), got.column("plus").to_pylist(), Counter(
        {(tuple(a), tuple(b)): n for a, b, n in zip(*(swaps.column(c).to_pylist() for c in ("plus", "minus", "n")))})


def _sparse(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    at = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    return at, np.fromiter((i for x in lists for i in x), np.int64, len(at))


def fit_weights(y: np.ndarray, lists: Sequence[Sequence[int]], swaps: Sequence[tuple], n: int, share: dict[int, float],
                ridge: float = RIDGE, fair: float = FAIR, steps: int = STEPS, times: Sequence[int] | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression by Adam on all examples at once, with a ridge and the counterfactual penalty.

    A pair of `swaps` counts as often in the penalty as `times` says, once without it.
    After each step weights below zero are set to zero and the intercept to `FLOOR` at least.
    """
    at, col = _sparse(lists)
    weight = np.where(y == 1, share[1] / max(y.mean(), 1e-12), share[0] / max(1 - y.mean(), 1e-12)) / len(y)
    pa_, pc = _sparse([a for a, _ in swaps])
    ma, mc = _sparse([b for _, b in swaps])
    often = np.ones(len(swaps)) if times is None else np.array(times, float)
    w = np.zeros(n + 1)
    w[n] = np.log(share[1] / share[0])
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        logit = np.bincount(at, w[col], len(y)) + w[n]
        r = weight * (1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y)
        g = np.bincount(col, r[at], n + 1).astype(float)
        g[n] = r.sum()
        g[:n] += ridge * w[:n]
        if swaps:
            change = np.bincount(pa_, w[pc], len(swaps)) - np.bincount(ma, w[mc], len(swaps))
            change *= 2 * fair * often / often.sum()
            g += np.bincount(pc, change[pa_], n + 1) - np.bincount(mc, change[ma], n + 1)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-10)
        np.maximum(w[:n], 0, out=w[:n])
        w[n] = max(w[n], FLOOR)
    return w[:n], float(w[n])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE,
        fair: float = FAIR) -> Model:
    """Fit on the labelled documents outside the held-out fold. `labels` has the document id and `toxic` 0/1."""
    text_batches(docs.sparkSession)
    rows, share = _sample(docs, labels, doc_id, text, limit)
    n_rows = {0: 0, 1: 0} | {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n_rows[0] or not n_rows[1]:
        return Model({}, 500.0 if n_rows[1] else -500.0)
    names = sorted({*_choose(rows, n_rows, FEATURES), *KIND})
    y, lists, swaps = _examples(rows, names)
    weights, intercept = fit_weights(np.array(y, float), lists, list(swaps), len(names), share, fair=fair,
                                     times=list(swaps.values()))
    return Model({n: float(w) for n, w in zip(names, weights) if w}, intercept)


def with_scores(rows: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Replace the text column by `score`, also where there is such a column; others pass through."""
    rest = [c for c in rows.columns if c not in (text, "score")]

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            scores = pa.array([model.score(t) for t in utf8(batch.column(text))], pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), scores], [*rest, "score"])

    text_batches(rows.sparkSession)
    return rows.select(*rest, F.col(text).cast("string").alias(text)).mapInArrow(
        score, rows.select(*rest).schema.add("score", "double"))


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
               threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with all their columns; each goes to Python once and back if it stays."""
    model = fit(docs, labels, doc_id, text)
    at = docs.columns.index(text)

    def keep(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in utf8(batch.column(at))], pa.bool_()))

    text_batches(docs.sparkSession)
    return docs.mapInArrow(keep, docs.schema)


def op9_fair_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    return with_scores(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
