"""Toxicity: held-out accuracy, the fold, whole texts, and the counterfactual penalty."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tapewatch.llm import toxicity

SYLLABLES = "ba ke lo mi nu ra so te vu wy".split()


def sentence(rng, n=12):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = int(i % 6 == 0)
        parts = [sentence(rng) for _ in range(rng.randint(1, 30))]
        if toxic:
            for _ in range(2):
                parts.insert(rng.randint(0, len(parts)), rng.choice(["you Moron", "what an idiot!", "grumbl" + rng.choice(SYLLABLES)]))
        rows.append((i, ". ".join(parts)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def fitted(spark, make_docs):
    rows, labels = corpus()
    docs, table = make_docs(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return docs, table, toxicity.fit(docs, table)


def test_held_out_accuracy(fitted):
    docs, _, model = fitted
    rows = toxicity.with_scores(docs.select("doc_id", "text"), model).withColumn(
        "out", toxicity.held_out(F.col("doc_id"))).collect()
    out = [r for r in rows if r.out]
    assert {r.doc_id for r in out} == {i for i in range(900) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert all((r.score >= 0.7) == (r.doc_id % 6 == 0) for r in rows)


def test_labels_of_the_held_out_fold_are_not_read(spark, fitted):
    docs, table, model = fitted
    turned = table.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, turned) == model


def test_toxic_words_count_wherever_they_are(fitted):
    model = fitted[2]
    clean = sentence(random.Random(9), 20_000)
    assert model.score(clean.encode()) < 0.5
    assert model.score((clean + " you moron, idiot, moron").encode()) >= 0.7
    assert model.score("GRUMBLXX and grumblyy".encode()) >= 0.7  # unseen endings


def test_group_names_do_not_carry_the_score():
    """Biased labels: toxic texts name one group. With the penalty its neutral mentions score as those of others."""
    names = ["women", "men", "girls", "boys"]
    lists, y = [], []
    for i in range(400):
        toxic = i % 2
        lists.append([4] if toxic and i % 4 == 1 else [])
        lists[-1] = sorted({*lists[-1], 0} if toxic else {*lists[-1], *([1 + i % 3] if i % 8 == 0 else [])})
        y.append(toxic)
    swaps = [([a], [b]) for a in range(4) for b in range(4) if a != b]
    share = {0: 0.5, 1: 0.5}
    biased, _ = toxicity.fit_weights(np.array(y, float), lists, [], 5, share, fair=0.0)
    fair, base = toxicity.fit_weights(np.array(y, float), lists, swaps, 5, share, fair=10.0)
    assert biased[0] - max(biased[1:4]) > 3
    assert max(fair[:4]) - min(fair[:4]) < 0.5
    assert fair[4] > fair[:4].max() + 1
    model = toxicity.Model({n.encode(): w for n, w in zip(names, fair)}, base)
    neutral = [model.score(f"the {n} went home".encode()) for n in names]
    assert max(neutral) - min(neutral) < 0.15


def test_swaps_come_from_labelled_sentences(spark, make_docs):
    docs = make_docs([(1, "Some Muslims went. The end"), (2, "no group here")]).withColumn("toxic", F.lit(0))
    names = sorted(toxicity.KIND)
    kinds, _, swaps = toxicity._examples(docs.select("text", "toxic"), names)
    assert kinds.count(0) == 2
    assert len(swaps) == len(toxicity.KIND[b"muslims"])
    assert all(names[a[0]] == b"muslims" and names[b[0]] in toxicity.KIND[b"muslims"] for a, b in swaps)


def test_swaps_count_as_often_as_they_occur(spark, make_docs):
    docs = make_docs([(k, "Some Muslims went. The end") for k in range(5)] + [(9, "The elderly. The old")]).withColumn("toxic", F.lit(0))
    names = sorted(toxicity.KIND)
    _, _, swaps = toxicity._examples(docs.select("text", "toxic"), names)
    by = {name: [n for (a, _), n in swaps.items() if names[a[0]] == name] for name in (b"muslims", b"elderly", b"old")}
    assert by == {b"muslims": [5] * len(toxicity.KIND[b"muslims"]), b"elderly": [1] * 3, b"old": [1] * 3}
    assert sum(swaps.values()) == 5 * len(by[b"muslims"]) + 6
    few = toxicity._examples(docs.select("text", "toxic"), names, limit=len(by[b"muslims"]))[2]
    assert few == {pair: 5 for pair in few} and len(few) == len(by[b"muslims"])  # the frequent ones


def test_a_weighted_pair_is_a_repeated_one():
    rng = random.Random(2)
    lists = [sorted(rng.sample(range(5), rng.randint(0, 3))) for _ in range(200)]
    y, share = np.array([float(0 in x) for x in lists]), {0: 0.5, 1: 0.5}
    pairs, times = [([0], [1]), ([1], [2]), ([3], [0])], [7, 1, 2]
    weighted, base = toxicity.fit_weights(y, lists, pairs, 5, share, fair=0.1, times=times)
    repeated, same = toxicity.fit_weights(y, lists, [p for p, n in zip(pairs, times) for _ in range(n)], 5, share, fair=0.1)
    assert np.allclose(weighted, repeated, atol=1e-6) and np.isclose(base, same, atol=1e-6)


def test_repeated_ids_take_part_once(spark, make_docs, fitted):
    """A third of all rows under one labelled id, with several texts, and null ones."""
    rows, labels = corpus(300)
    hot = next(i for i, _, toxic in labels if toxic and zlib.crc32(str(i).encode()) % 3 != 1)
    more = [(hot, None)] * 3 + [(hot, f"again {k % 7}") for k in range(150)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got, share = toxicity._sample(make_docs(rows + more), table, "doc_id", "text", 1000)
    got = got.collect()
    used = [r for r in labels if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    assert len(got) == len(used) and sum(r.toxic for r in got) == sum(r[2] for r in used)
    assert share[1] == sum(r[2] for r in used) / len(used)
    texts = {t for i, t in rows + more if i == hot and t}
    assert sum(r.text in texts for r in got) == 1 and all(r.text is not None for r in got)
    reversed_ = toxicity._sample(make_docs((rows + more)[::-1]), table, "doc_id", "text", 1000)[0].collect()
    assert sorted(got) == sorted(reversed_)


def test_odd_documents(spark, odd_docs, fitted):
    model = fitted[2]
    scored = toxicity.with_scores(odd_docs.select("doc_id", "text"), model).collect()
    assert len(scored) == odd_docs.count()
    assert all(0 <= r.score <= 1 for r in scored)
    labels = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (2, None), (3, 0), (8, 0)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(odd_docs, labels)
    assert kept.columns == odd_docs.columns
    assert kept.count() <= odd_docs.count()


@pytest.mark.parametrize("labels,score", [([], 0.0), ([(1, 0), (3, 0)], 0.0), ([(3, 1)], 1.0)])
def test_one_class_only(spark, odd_docs, labels, score):
    model = toxicity.fit(odd_docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    usable = [l for l in labels if zlib.crc32(str(l[0]).encode()) % 3 != 1]
    assert round(model.score(b"anything"), 6) == (score if usable else 0.0)


def test_no_documents(spark, make_docs):
    empty = make_docs([])
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.drop_toxic(empty, labels).count() == 0
