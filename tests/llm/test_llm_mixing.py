"""Mixing: targets by definition, taken words near them, epochs first, the same on every run."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tapewatch.llm import mixing


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def expected(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    fixed, free, total = {}, set(order), 1.5 * sum(sizes.values())
    while free:
        level = (total - sum(fixed.values())) / sum(weight[s] for s in free)
        above = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not above:
            break
        for s in above:
            fixed[s] = 2.0 * sizes[s]
            free.discard(s)
    return fixed | {s: level * weight[s] for s in free}


def run(docs):
    rows = mixing.sized(docs, [F.col("doc_id")], "doc_id", "text", "source")
    return mixing.mix(rows, mixing.source_targets(rows))


@pytest.fixture(scope="module")
def mixed_docs(make_docs):
    return make_docs([(i, " ".join(["w"] * (1 + i * 7 % 23)) + (" 123 $$$" if i % 5 == 0 else ""),
                       None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 6}é") for i in range(900)])


def test_targets_and_taken(mixed_docs):
    docs, rows = mixed_docs.collect(), run(mixed_docs).collect()
    sizes = Counter()
    for d in docs:
        sizes[d.source] += words(d.text)
    targets, taken = expected(sizes), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 25 / 2
    for s in sizes:  # complete epochs precede: no document is left out where the target is at least the size
        copies = {r.copies for r in rows if r.source == s}
        assert min(copies) >= targets[s] // sizes[s]


def test_repeats_are_equal(mixed_docs):
    one = Counter(run(mixed_docs).select("doc_id", "taken", "target").collect())
    two = Counter(run(mixed_docs.repartition(5)).select("doc_id", "taken", "target").collect())
    assert one == two


def test_better_documents_come_first(make_docs):
    docs = make_docs([(i, "plain words of text" if i % 2 else "12 34 $$ 56", "a" if i < 1000 else "b") for i in range(3000)])
    rows = run(docs).collect()
    part = [r for r in rows if r.source == "b"]
    assert {r.copies for r in part} == {0, 1} or {r.copies for r in part} == {1, 2}
    more = Counter(r.doc_id % 2 for r in part if r.copies == max(x.copies for x in part))
    assert more[1] > 3 * more[0]


def test_odd_documents(odd_docs):
    rows = run(odd_docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((d.doc_id, words(d.text)) for d in odd_docs.collect())
    mix = mixing.mixed_documents(odd_docs)
    assert mix.columns == odd_docs.columns
    assert mix.count() == sum(r.copies for r in rows)
    assert sum(words(r.text) for r in mix.collect()) == sum(r.taken for r in rows)


@pytest.mark.parametrize("rows", [[], [(1, ""), (2, None)], [(1, "a b", None)], [(1, "", "x"), (2, "a b c", "y")]])
def test_few_documents(make_docs, rows):
    docs = make_docs(rows)
    got = run(docs).collect()
    assert len(got) == len(rows)
    assert all(r.taken <= 2 * r.size for r in got)
    assert mixing.mixed_documents(docs).columns == docs.columns
