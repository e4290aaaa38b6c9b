"""Grammar extension queries and periodic runs against brute force."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tapewatch.llm import periodic_runs as pr
from tapewatch.llm.common import read_table
from tapewatch.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """Runs (start, length, period) by trying each period at each place."""
    least = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p):
                least.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in least.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc).encode())
    if doc is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs)]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    return (doc, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def sequences(count):
    rng = np.random.default_rng(5)
    for trial in range(count):
        line = rng.integers(0, rng.integers(1, 4), rng.integers(0, 90)).astype(np.int64)
        if trial % 2 and len(line) > 10:
            a, p = rng.integers(0, len(line)), rng.integers(1, 9)
            line[a:] = np.resize(line[a:a + p], len(line) - a)
        yield line


def test_extensions_are_exact():
    for line in sequences(120):
        n = len(line)
        a, b = np.nonzero(~np.eye(n, dtype=bool))
        grammar = Grammar(np.append(line, -1))

        def common(x, y):
            return next((i for i, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))

        assert grammar.forward(a, b).tolist() == [common(line[i:], line[j:]) for i, j in zip(a, b)]
        assert grammar.backward(a, b).tolist() == [common(line[:i][::-1], line[:j][::-1]) for i, j in zip(a, b)]


def test_extensions_stop_at_walls():
    grammar = Grammar(np.array([1, 2, 3, -1, 1, 2, 3, -2, 2, 3]))
    a, b = np.array([0, 1, 4, 5, 3, 10]), np.array([4, 8, 0, 8, 7, 3])
    assert grammar.forward(a, b).tolist() == [3, 2, 3, 2, 0, 0]
    assert grammar.backward(np.array([3, 7]), np.array([7, 10])).tolist() == [3, 2]


@pytest.mark.parametrize("candidates", [7, 1 << 20])
def test_runs_of_texts_side_by_side(monkeypatch, candidates):
    monkeypatch.setattr(pr, "CANDIDATES", candidates)
    lines = list(sequences(200))
    found = pr.runs_of(lines)
    got = [[tuple(r[1:].tolist()) for r in found if r[0] == i] for i in range(len(lines))]
    assert got == [brute_runs(line.tolist()) for line in lines]
    assert sum(map(len, got)) > 50


def test_grammar_of_a_power_is_small():
    grammar = Grammar(np.append(np.resize([5, 3, 8], 30_000), -1))
    assert len(grammar.levels) < 12
    assert pr.runs_of([np.zeros(100_000, np.int64)]).tolist() == [[0, 0, 100_000, 1]]


def test_runs_and_collapsed_texts(spark, make_docs):
    docs = make_docs([(1, "a b a b a b a b end"), (2, "x  x\tx x\nx x x"), (3, "a a a a a"), (4, None), (5, " \n"),
                      (5, "the the the the the the one two one two one two one two")])
    got = sorted((r.doc_id, r.collapsed, [tuple(x) for x in r.runs]) for r in pr.periodic_runs(docs).collect())
    assert got == [(1, "a b end", [(0, 8, 2)]), (2, "x", [(0, 7, 1)]), (3, "a a a a a", []), (4, "", []), (5, "", []),
                   (5, "the one two", [(0, 6, 1), (6, 8, 2)])]


def row(r):
    return (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


def key(r):
    return (r[0] is not None, r[0] or 0, *map(str, r[1:]))


def test_query_against_brute_force(spark):
    docs = read_table(spark, SF, "documents").select("doc_id", "text").collect()
    got = sorted(map(row, pr.op11_recompression_runs(spark, SF).collect()), key=key)
    assert got == sorted((brute_row(d.doc_id, d.text) for d in docs), key=key)
    assert any(r[1] for r in got)


def test_odd_documents(spark, odd_docs, tmp_path):
    power = odd_docs.limit(1).withColumns({"doc_id": F.lit(77), "text": F.lit("tick tock " * 20_000)})
    docs = odd_docs.unionByName(power)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(map(row, pr.op11_recompression_runs(spark, str(tmp_path)).collect()), key=key)
    want = sorted((brute_row(d.doc_id, d.text) for d in docs.collect() if d.doc_id not in (6, 7, 77)), key=key)
    assert [r for r in got if r[0] not in (6, 7, 77)] == want
    assert [r[1:5] for r in got if r[0] == 77] == [(1, 0, 40_000, 2)]
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert pr.op11_recompression_runs(spark, str(tmp_path / "none")).count() == 0
