"""Runs of repeating words, found by extension queries on a run-length grammar.

A run is a stretch of words that repeats with its smallest period at least `REPEATS` times, has `SHORTEST` words or more
and cannot be made longer. A run of period p holds two equal places i and i + p at some multiple i of a step of
about (REPEATS - 1) * p; these multiples, for all periods that fit, are the candidates, about n ln n / 3 of them in a text
of n words. Each is extended to both sides as far as the words repeat, exactly, by the grammar of `recompression`. Of
equal stretches the least period counts: it divides the others.

Texts are compressed side by side, about `GROUP_WORDS` words together with a wall between them; a longer text is a
group of its own, and its candidates are taken `CANDIDATES` at a time.

Defined results: null, empty and blank texts have no words and no runs, their collapsed text is empty. Repeated rows and
ids are rows of their own. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import read_table, text_batches
from tapewatch.llm.recompression import Grammar
from tapewatch.llm.tokens import utf8

REPEATS, SHORTEST = 4, 6
GROUP_WORDS, CANDIDATES = 1 << 16, 1 << 20
RESULT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
Words = list[bytes]


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates (text, place, period) of texts that begin at `starts`; places count from the first text."""
    most = np.where(sizes >= SHORTEST, np.maximum(sizes // REPEATS, 1), 0)
    text = np.repeat(np.arange(len(sizes)), most)
    period = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    # A run of period p has so many places i with i and i + p inside, at least.
    step = np.maximum(SHORTEST, REPEATS * period) - period
    times = np.maximum(0, -(-(sizes[text] - period) // step))
    done = np.cumsum(times)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(done, done[at] - times[at] + CANDIDATES, "right")))
        own = slice(at, end)
        which = np.repeat(np.arange(at, end), times[own])
        nth = np.arange(len(which)) - np.repeat(np.cumsum(times[own]) - times[own], times[own])
        yield text[which], starts[text[which]] + nth * step[which], period[which]
        at = end


def _least(found: np.ndarray) -> np.ndarray:
    """Rows (text, start, length, period) in order, of equal stretches the one with the least period."""
    found = found[np.lexsort((found[:, 3], found[:, 2], found[:, 1], found[:, 0]))]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    return found[new]


def runs_of(texts: list[np.ndarray]) -> np.ndarray:
    """All runs (text, start, length, period) of texts given as numbers >= 0, by text, start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    walls = -1 - np.arange(len(texts))
    line = np.concatenate([np.append(t, w) for t, w in zip(texts, walls)]) if texts else np.zeros(0, np.int64)
    grammar, found = None, [np.zeros((0, 4), np.int64)]
    for text, place, period in _grid(starts, sizes):
        same = line[place] == line[place + period]
        text, place, period = text[same], place[same], period[same]
        if not len(text):
            continue
        grammar = grammar or Grammar(line)
        back = grammar.backward(place, place + period)
        length = back + period + grammar.forward(place, place + period)
        long = length >= np.maximum(SHORTEST, REPEATS * period)
        found.append(_least(np.stack([text, place - back - starts[text], length, period], axis=1)[long]))
    found = _least(np.concatenate(found))
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def collapsed(words: Words, runs: np.ndarray) -> bytes:
    """The words without those that lie in a run (start, length, period) after its first period."""
    if not len(runs):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)])


def _search(change: Callable[[int | None, Words], Words] | None):
    def groups(batch) -> Iterator[list[tuple[int | None, Words]]]:
        group, size = [], 0
        for doc, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text"))):
            words = (text or b"").split()
            words = change(doc, words) if change else words
            if group and size + len(words) > GROUP_WORDS:
                yield group
                group, size = [], 0
            group.append((doc, words))
            size += len(words)
        if group:
            yield group

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for group in groups(batch):
                names: dict[bytes, int] = {}
                fresh = count()
                texts = [np.fromiter(map(names.setdefault, words, islice(fresh, len(words))), np.int64, len(words))
                         for _, words in group]
                found = runs_of(texts)
                ends = np.searchsorted(found[:, 0], np.arange(len(group) + 1))
                own = [found[a:b, 1:] for a, b in zip(ends, ends[1:])]
                short = [collapsed(words, runs) for (_, words), runs in zip(group, own)]
                runs = pa.StructArray.from_arrays(
                    [pa.array(found[:, c]) for c in (1, 2, 3)], ["start", "length", "period"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc for doc, _ in group], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs),
                     pa.array(short, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  change: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): each text's runs by start and period, and its words without their repeats.

    `change` may put other words in place of a text's own, given its id; it runs where the text is split.
    """
    text_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        _search(change), RESULT)


def planted(doc: int | None, words: Words) -> Words:
    """A tenth of the documents repeat from some word on, as a fixed rule of the query's ids; null ids don't."""
    draw = 1 if doc is None else zlib.crc32(str(doc).encode())
    if draw % 10 or not words:
        return words
    g, n = draw // 10, len(words)
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    cycle = words[at:at + period]
    return words[:at] + (cycle * (-(-(n - at) // len(cycle))))[:n - at]


def op11_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of runs, the longest one, and digests of all runs and of the text without repeats."""
    found = periodic_runs(read_table(spark, sf_dir, "documents"), change=planted)
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.period")).alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
