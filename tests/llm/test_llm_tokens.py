"""Token operators against the tokenizer on whole texts: token counts, packing, binary output."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from tapewatch.llm import elias_fano, packing, token_counts, tokens
from tapewatch.session import new_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.vocabulary_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    """Also with a cache that is emptied all the time, marks, special tokens and odd white space."""
    monkeypatch.setattr(tokens, "GROUP_BYTES", 100)
    encoder = tokens.WordEncoder(limit=50)
    random.seed(5)
    pieces = [*"aAbZz,.'std LLvé̀eẹ \u0085\x1c\x1f  　ΣσςİIıß09½\n\t\x0b\r\x00﻿\x01",
              "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", " word ", "word, "]
    texts = ["".join(random.choices(pieces, k=random.randint(0, 30))) for _ in range(3000)]
    for text, got in zip(texts, encoder.each(t.encode() for t in texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(tokenizer, text), repr(text)


def test_capitals_with_marks_that_only_small_letters_compose_with(tokenizer, monkeypatch):
    """Also with marks of other scripts in between, which don't keep the letter from composing."""
    monkeypatch.setattr(tokens, "GROUP_BYTES", 100)
    encoder = tokens.WordEncoder(limit=50)
    random.seed(6)
    pairs = ["H\u0331", "T\u0308", "J\u030c", "W\u030a", "Y\u030a"]
    pieces = [*pairs, *(p[0] + m + p[1] for p in pairs for m in "\u05b0\u0323"), *"HTJWYhtjwy\u0331\u0308\u030c\u030a\u0344\u05b0é", *"  ,."]
    texts = pairs + [p.lower() for p in pairs] + ["".join(random.choices(pieces, k=random.randint(1, 30))) for _ in range(3000)]
    for text, got in zip(texts, encoder.each(t.encode() for t in texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(tokenizer, text), ascii(text)


def test_histogram_answers_for_every_limit(spark, odd_docs, tokenizer):
    sizes = [len(ids_of(tokenizer, r.text)) for r in odd_docs.collect()]
    histogram = token_counts.length_histogram(token_counts.document_lengths(odd_docs))
    got = {r.length: r for r in histogram.collect()}
    assert {k: r.n_docs for k, r in got.items()} == Counter(sizes)
    for k, r in got.items():
        assert r.docs_shorter == sum(s < k for s in sizes)
        assert r.docs_at_least == sum(s >= k for s in sizes)
        assert r.tokens_at_least == sum(s for s in sizes if s >= k)
        assert r.truncated_total == sum(min(s, k) for s in sizes)
    limits = [0, 1, 3, 100, 10**6]
    assert token_counts.truncated_totals(histogram, limits) == {x: sum(min(s, x) for s in sizes) for x in limits}
    ordered = sorted(sizes)
    assert token_counts.quantiles(histogram, [0.0, 0.5, 1.0]) == {
        0.0: ordered[0], 0.5: ordered[(len(ordered) + 1) // 2 - 1], 1.0: ordered[-1]}


def test_histogram_of_nothing(spark, make_docs):
    histogram = token_counts.length_histogram(token_counts.document_lengths(make_docs([])))
    assert histogram.count() == 0
    assert token_counts.truncated_totals(histogram, [5]) == {5: 0}


@pytest.mark.parametrize("room", [1, 7, 30])
def test_fullest_is_the_best_subset(room):
    random.seed(room)
    for _ in range(60):
        lengths = [random.randint(1, 12) for _ in range(random.randint(0, 9))]
        sums = {0}
        for x in lengths:
            sums |= {s + x for s in sums}
        chosen = packing.fullest(dict(Counter(lengths)), room)
        assert sum(k * n for k, n in chosen.items()) == max(s for s in sums if s <= room)
        assert not Counter(chosen) - Counter(lengths)


def best_fit_decreasing(lengths, capacity):
    room = []
    for x in sorted(lengths, reverse=True):
        i = bisect_left(room, x)
        left = capacity - x if i == len(room) else room.pop(i) - x
        insort(room, left)
    return len(room)


def test_repeated_combinations_are_those_of_single_steps():
    random.seed(3)
    histogram = Counter(random.randint(1, 64) for _ in range(400))
    found = packing.combinations(dict(histogram), 64)
    assert len(found) <= 64
    used = Counter()
    for content, times in found:
        assert sum(k * n for k, n in content.items()) <= 64
        used.update({k: n * times for k, n in content.items()})
    assert used == histogram
    assert sum(t for _, t in found) <= best_fit_decreasing(histogram.elements(), 64)


def check_packing(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_places_every_piece(spark, odd_docs, tokenizer):
    rows = packing.pack(packing.token_pieces(odd_docs, capacity=64), 64).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = [*ids_of(tokenizer, r.text), 0]
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = np.array(ids[at:at + 64], "<u4").tobytes()
            want[(r.doc_id, piece, at, len(part) // 4, zlib.crc32(part))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_packing(rows, 64)


def test_packing_a_hot_length(spark):
    """A third of all pieces of one length; no more sequences than best fit makes of the sorted lengths."""
    pieces = spark.range(3000).selectExpr("id as doc_id", "if(id % 3 = 0, 700, 1 + id * 7919 % 2048) as length")
    rows = packing.pack(pieces).collect()
    assert len(rows) == 3000
    assert check_packing(rows, 2048) <= best_fit_decreasing([r.length for r in rows], 2048)


def test_packing_nothing(spark, make_docs):
    assert packing.pack(packing.token_pieces(make_docs([]))).count() == 0


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [-2**63, 0, 2**63 - 1], [0, 1, 2, 3], list(range(0, 100_000, 37)),
                                    [7] * 500 + [10**12] * 3])
def test_elias_fano_round_trip(values):
    packed = elias_fano.EliasFano.encode(np.array(values, np.int64)).pack()
    read = elias_fano.EliasFano.unpack(packed)
    assert read.all().tolist() == values
    for i in {0, len(values) // 2, len(values) - 1} if values else ():
        assert read.select(i) == values[i]


def test_elias_fano_is_small():
    rng = np.random.default_rng(1)
    starts = np.cumsum(rng.integers(1, 1000, 20_000))
    assert 8 * len(elias_fano.EliasFano.encode(starts).pack()) / len(starts) < 2 + np.log2(starts[-1] / len(starts)) + 1.5


def test_written_ids_read_back(spark, odd_docs, tokenizer, monkeypatch):
    path = new_path(spark, "ids")
    elias_fano.write_ids(odd_docs, path)
    rows = sorted(elias_fano.read_ids(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd_docs.collect()), key=lambda x: (x is not None, x or 0))
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    want = Counter()
    for r in odd_docs.collect():
        ids = np.array([*ids_of(tokenizer, r.text), 1], "<u4").tobytes()
        want[(r.doc_id, len(ids) // 4, zlib.crc32(ids))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    two = elias_fano.read_documents(spark, path, [2, 9, 77]).collect()
    assert Counter(r.doc_id for r in two) == {2: 3, 9: 1}
    text = next(r.text for r in odd_docs.collect() if r.doc_id == 9)
    assert next(r.ids for r in two if r.doc_id == 9) == [*ids_of(tokenizer, text), 1]


def test_writing_no_documents(spark, make_docs):
    path = new_path(spark, "ids")
    elias_fano.write_ids(make_docs([]), path)
    assert elias_fano.read_ids(spark, path).count() == 0
