"""Exact and near dedup against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tapewatch.llm import exact_dedup, simhash
from helpers import plan

DROP = {ord(c): None for c in " \t\n\x0b\x0c\r"}


def groups(docs):
    return exact_dedup.radix_groups(docs, [F.col("doc_id"), F.col("text")])


def check_groups(rows, docs):
    members = defaultdict(list)
    for r in docs:
        members[(r.text or "").translate(DROP)].append((-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
    kept = Counter()
    for r in rows:
        own = members[(r.text or "").translate(DROP)]
        best = min(own)
        assert r.group_size == len(own)
        assert r.keep_id == (None if best[1] else best[2])
        if r.kept:
            kept[(r.text or "").translate(DROP)] += 1
            assert (-len(r.text or ""), r.doc_id is None, r.doc_id or 0) == best
    assert kept == dict.fromkeys(members, 1)
    assert len(rows) == len(docs)


def test_radix_groups_of_odd_documents(spark, odd_docs):
    check_groups(groups(odd_docs).collect(), odd_docs.collect())


def test_radix_groups_split_late(spark, make_docs):
    """Texts that part at, before and after the ends of digits, a hot group, and texts that are prefixes of others."""
    random.seed(2)
    base = "".join(random.choices("ab", k=70_000))
    rows = [(i, base[:n] + tail) for i, (n, tail) in enumerate(
        (n, t) for n in (0, 1, 15, 16, 17, 1039, 1040, 1041, 66_575, 66_576, 66_577, 69_999) for t in ("", "a", "b", " a", "b ", "aa"))]
    rows += [(1000 + i, base) for i in range(60)]
    docs = make_docs(rows)
    check_groups(groups(docs).collect(), docs.collect())


def test_only_empty_texts(spark, make_docs):
    docs = make_docs([(1, ""), (2, None), (3, " \n")])
    rows = groups(docs).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in rows} == {(1, 3, False), (2, 3, False), (3, 3, True)}
    assert groups(make_docs([])).count() == 0
    assert groups(make_docs([(4, "")])).collect()[0].kept


def test_drop_copies_keeps_columns(spark, odd_docs):
    kept = exact_dedup.drop_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    texts = [(r.text or "").translate(DROP) for r in kept.collect()]
    assert sorted(texts) == sorted({(r.text or "").translate(DROP) for r in odd_docs.collect()})


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def test_fingerprints_are_those_of_the_definition(odd_docs):
    for r in odd_docs.collect():
        assert int.from_bytes(simhash.fingerprint((r.text or "").encode()), "big") == brute_print(r.text)


def brute_components(prints, distance=3):
    parent = {p: p for p in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= distance:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {p: root(p) for p in prints}


@pytest.mark.parametrize("tree", [3, 1024])
def test_links_connect_what_is_within_the_distance(spark, tree):
    """Chains, a dense ball and random prints; with trees so small that every shard is dealt over several."""
    random.seed(tree)
    prints = {random.getrandbits(64) for _ in range(150)}
    for center in random.sample(sorted(prints), 8):
        x = center
        for _ in range(12):
            for bit in random.sample(range(64), 3):
                x ^= 1 << bit
            prints.add(x)
    center = random.getrandbits(64)
    prints |= {center ^ 1 << a ^ 1 << b for a in range(12) for b in range(12)}
    nodes = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in sorted(prints)], "fp long")
    stars = simhash.components(simhash.links(nodes, tree=tree)).collect()
    got = {p: p for p in prints}
    got.update({r.a % 2**64: r.b % 2**64 for r in stars})
    want = brute_components(prints)
    assert len(set(want.values())) < len(prints) - 50
    assert {frozenset(p for p in prints if got[p] == g) for g in got.values()} == \
        {frozenset(p for p in prints if want[p] == g) for g in want.values()}


def test_bk_tree_search_is_exact():
    random.seed(1)
    values = list({random.getrandbits(12) for _ in range(300)})
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for x in range(0, 4096, 97):
        assert sorted(tree.within(x, 2)) == sorted(v for v in values if (v ^ x).bit_count() <= 2)


def test_near_groups_of_odd_documents(spark, odd_docs):
    rows = simhash.near_groups(odd_docs, [F.col("doc_id"), F.col("text")]).collect()
    prints = {brute_print(r.text) for r in rows}
    root = brute_components(prints)
    ids = defaultdict(list)
    for r in rows:
        ids[root[brute_print(r.text)]].append(r.doc_id)
    firsts = Counter()
    for r in rows:
        own = [i for i in ids[root[brute_print(r.text)]] if i is not None]
        assert r.fp % 2**64 == brute_print(r.text)
        assert r.component_id == min(own, default=None)
        firsts[root[brute_print(r.text)]] += r.first
    assert set(firsts.values()) == {1}
    assert len(rows) == odd_docs.count()
    kept = simhash.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert kept.count() == len(firsts)


def test_near_groups_of_nothing(spark, make_docs):
    assert simhash.near_groups(make_docs([]), [F.col("doc_id")]).count() == 0


def test_plans_have_no_cross_join(spark, odd_docs):
    for df in (groups(odd_docs), simhash.near_groups(odd_docs, [F.col("doc_id")])):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_digest_is_of_the_normalised_text(spark, odd_docs):
    digest = F.sha2(exact_dedup.normal_text(F.col("text")).cast("binary"), 256)
    for r in odd_docs.select("text", digest.alias("d")).collect():
        assert r.d == hashlib.sha256((r.text or "").translate(DROP).encode()).hexdigest()


def test_components_of_a_long_chain(spark):
    """A path is the worst case for the rounds; 300 nodes in a shuffled order."""
    order = np.random.default_rng(4).permutation(300).tolist()
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:])], "a long, b long")
    stars = simhash.components(edges).collect()
    assert {(r.a, r.b) for r in stars} == {(i, 0) for i in range(1, 300)}
