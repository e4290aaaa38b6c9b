"""Approximate nearest neighbours by cosine: a hierarchical navigable small-world graph per shard.

Rows are dealt at random over shards of bounded size; the size follows the number of rows by `shard_rows`. Equal
vectors of a shard are one node with a list of ids, so copies neither crowd the graph nor hide other neighbours.

Graph: nodes are numbered in the order of insertion, those of higher levels first, so the nodes of a level are
a prefix of all. At each level a node is linked to the nearest and mutually most different of the nodes inserted before
it, and these back to it; lists that grow too long are thinned by the same rule. In a shard of bounded size the
candidates of an insertion come from one matrix product with all nodes before, which finds all that a search of the
half-built graph would. A node that no list leads to is added to the list of a neighbour, so all can be reached.
Neighbour lists are flat integer arrays of fixed width, padded with -1.

Index table: a row per node (shard, node, level, ids, v, links), `links` being its lists from level 0 up.

Search: every query goes to every shard, in groups as large as a shard. It descends the levels to the nearest node, then
keeps a beam of the best nodes of level 0 until all in it have been expanded; many queries move at once. The beam
holds the root of the shard's nodes, `BEAM` at least. Its cosines are computed anew in double precision, and the results of all shards are merged.

Defined results: null, zero and empty vectors, vectors with null or non-finite components and rows without id take
no part. Shorter vectors are padded with zeros. A candidate never answers a query of its own id. Repeated ids: every
row is a candidate, and each query row is answered by itself. Ties go to the smaller id. Fewer candidates than k give
fewer rows, an empty table none. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapewatch.llm.common import numbered, read_table, usable
from tapewatch.session import stage

K, EVERY = 5, 50
#: Neighbours chosen per node and level; lists hold so many, twice as many at level 0, plus spare places there.
LINKS, SPARE = 16, 4
#: Candidates that the choice is made from, least beam of a search, and nodes that a query expands at a time.
CANDIDATES, BEAM, EXPAND = 48, 64, 4
#: Rows in a shard: so many times the root of all rows, within these bounds.
ROOTS, SHARD_LEAST, SHARD_MOST = 16, 1024, 131_072
#: Numbers in a temporary matrix.
CELLS = 1 << 22
INDEX = "shard int, node int, level int, ids array<long>, v array<double>, links binary"


def shard_rows(rows: int) -> int:
    """Work grows with rows x shards, so shards grow with the root of the rows, as far as a task's memory allows."""
    return int(min(SHARD_MOST, max(SHARD_LEAST, ROOTS * math.sqrt(rows))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by a power of two first, so that no square overflows or vanishes."""
    scaled = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])
    return scaled / np.sqrt((scaled ** 2).sum(axis=1))[:, None]


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of (b, n, d) vectors with (b, d) queries, rows of any finite length."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=2))[1][..., None])
    q = np.ldexp(q, -np.frexp(np.abs(q).max(axis=1))[1][:, None])
    return np.einsum("bnd,bd->bn", x, q) / (np.sqrt((x ** 2).sum(axis=2)) * np.sqrt((q ** 2).sum(axis=1))[:, None])


def diverse(x: np.ndarray, near: np.ndarray, sim: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` of each row's candidates (nearest first, -1 for none), padded with -1.

    First those that are nearer to the node than to any candidate taken before, then the nearest of the rest.
    """
    width = near.shape[1]
    v = x[near]
    among = v @ v.transpose(0, 2, 1)
    taken = np.zeros(near.shape, bool)
    rival = np.full(near.shape, -np.inf, np.float32)  # largest similarity to one that was taken
    for c in range(width):
        taken[:, c] = (near[:, c] >= 0) & (taken.sum(axis=1) < count) & (rival[:, c] <= sim[:, c])
        rival = np.where(taken[:, c, None], np.maximum(rival, among[:, c]), rival)
    place = np.where(near < 0, 2 * width, np.where(taken, 0, width)) + np.arange(width)
    return np.take_along_axis(near, place.argsort(axis=1)[:, :count], axis=1)


def _padded(lists: np.ndarray, width: int) -> np.ndarray:
    out = np.full((len(lists), width), -1, np.int32)
    out[:, :min(width, lists.shape[1])] = lists[:, :width]
    return out


def _chosen_before(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node's neighbours among the nodes before it, and how similar they are."""
    n = len(x)
    lists, sims = np.full((n, LINKS), -1, np.int32), np.full((n, LINKS), -np.inf, np.float32)
    at = 1
    while at < n:
        end = min(n, at + max(1, min(512, CELLS // n)))
        sim = x[at:end] @ x[:end].T
        sim[np.arange(end)[None, :] >= np.arange(at, end)[:, None]] = -np.inf
        width = min(CANDIDATES, end - 1)
        near = np.argpartition(-sim, width - 1, axis=1)[:, :width]
        near = np.take_along_axis(near, (-np.take_along_axis(sim, near, axis=1)).argsort(axis=1, kind="stable"), axis=1)
        best = np.take_along_axis(sim, near, axis=1)
        chosen = _padded(diverse(x, np.where(best > -np.inf, near, -1), best, LINKS), LINKS)
        lists[at:end] = chosen
        sims[at:end] = np.where(chosen >= 0, np.take_along_axis(sim, np.maximum(chosen, 0), axis=1), -np.inf)
        at = end
    return lists, sims


def linked(x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists of one level, each node's choice and the nodes that chose it, `most` at the most; and the choices."""
    n = len(x)
    lists, sims = _chosen_before(x)
    node, place = np.nonzero(lists >= 0)
    other, sim = lists[node, place], sims[node, place]
    ends = np.concatenate([node, other]).astype(np.int64), np.concatenate([other, node]), np.concatenate([sim, sim])
    order = np.lexsort((ends[1], -ends[2], ends[0]))
    src, dst, sim = (e[order] for e in ends)
    size = np.bincount(src, minlength=n)
    place = np.arange(len(src)) - np.repeat(np.cumsum(size) - size, size)
    width = max(most, CANDIDATES)
    near, best = np.full((n, width), -1, np.int32), np.full((n, width), -np.inf, np.float32)
    first = place < width
    near[src[first], place[first]], best[src[first], place[first]] = dst[first], sim[first]
    out = near[:, :most].copy()
    crowded = np.flatnonzero(size > most)
    for at in range(0, len(crowded), 512):
        some = crowded[at:at + 512]
        out[some] = diverse(x, near[some], best[some], most)
    return out, lists


def reached_from(links: np.ndarray, start: int, reached: np.ndarray) -> None:
    edge = np.array([start])
    reached[start] = True
    while len(edge):
        near = np.unique(links[edge])
        edge = near[(near >= 0) & ~reached[near]]
        reached[edge] = True


def connect(links: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """Lists with spare places, in which nodes that cannot be reached from node 0 are put in a list of an earlier one."""
    links = np.concatenate([links, np.full((len(links), SPARE), -1, np.int32)], axis=1)
    reached = np.zeros(len(links), bool)
    if len(links):
        reached_from(links, 0, reached)
    for node in range(len(links)):
        if not reached[node]:
            near = [int(c) for c in choice[node] if c >= 0]
            room = (links[near, -SPARE:] < 0).any(axis=1)
            host = near[int(room.argmax())] if room.any() else int((links[:node, -SPARE:] < 0).any(axis=1).argmax())
            free = int((links[host] < 0).argmax())
            links[host, free] = node
            reached_from(links, node, reached)
    return links


class Graph:
    """Unit vectors in order of insertion and a neighbour array per level; the nodes of a level are a prefix."""

    def __init__(self, x: np.ndarray, lists: list[np.ndarray]):
        self.x, self.lists = x, lists

    @classmethod
    def build(cls, x: np.ndarray, levels: np.ndarray) -> Graph:
        """`levels` must not rise."""
        lists = []
        for level in range(int(levels.max(initial=0)) + 1):
            own = x[:int((levels >= level).sum())]
            found, choice = linked(own, LINKS if level else 2 * LINKS)
            lists.append(found if level else connect(found, choice))
        return cls(x, lists)

    def _descend(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, rows = np.zeros(len(q), np.int64), np.arange(len(q))
        best = q @ self.x[0]
        for lists in self.lists[:0:-1]:
            moving = rows
            while len(moving):
                near = lists[at[moving]]
                sim = np.where(near >= 0, np.einsum("bmd,bd->bm", self.x[near], q[moving]), -np.inf)
                pick = sim.argmax(axis=1)
                top = sim[np.arange(len(moving)), pick]
                better = top > best[moving]
                at[moving[better]] = near[better, pick[better]]
                best[moving[better]] = top[better]
                moving = moving[better]
        return at, best

    def search(self, q: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """The beam of each unit query, -1 where there are fewer nodes; not in order."""
        rows, n = np.arange(len(q)), len(self.x)
        near, sim = np.full((len(q), beam), -1, np.int64), np.full((len(q), beam), -np.inf, np.float32)
        near[:, 0], sim[:, 0] = self._descend(q)
        waiting, seen = np.zeros((len(q), beam), bool), np.zeros((len(q), n), bool)
        waiting[:, 0] = True
        seen[rows, near[:, 0]] = True
        while len(rows):
            open_ = np.where(waiting[rows], sim[rows], -np.inf)
            pick = np.argpartition(-open_, EXPAND - 1, axis=1)[:, :EXPAND]
            good = np.take_along_axis(open_, pick, axis=1) > -np.inf
            waiting[rows[:, None], pick] = False
            fresh = self.lists[0][np.where(good, near[rows[:, None], pick], 0)]
            fresh = np.where(good[:, :, None], fresh, -1).reshape(len(rows), -1)
            fresh.sort(axis=1)
            new = (fresh >= 0) & ~seen[rows[:, None], fresh]
            new[:, 1:] &= fresh[:, 1:] != fresh[:, :-1]
            line, column = np.nonzero(new)
            node = fresh[line, column]
            seen[rows[line], node] = True
            found = np.full(fresh.shape, -np.inf, np.float32)
            found[line, column] = np.einsum("nd,nd->n", self.x[node], q[rows[line]])
            all_sim = np.concatenate([sim[rows], found], axis=1)
            keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
            sim[rows] = np.take_along_axis(all_sim, keep, axis=1)
            near[rows] = np.take_along_axis(np.concatenate([near[rows], fresh], axis=1), keep, axis=1)
            waiting[rows] = np.take_along_axis(np.concatenate([waiting[rows], new], axis=1), keep, axis=1)
            rows = rows[(waiting[rows] & (sim[rows] > -np.inf)).any(axis=1)]
        return np.where(sim > -np.inf, near, -1)


def _vectors(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim).astype(np.float64)


def _built(dim: int):
    """All rows of a shard to its nodes."""
    def run(table):
        import pyarrow as pa

        table = table.combine_chunks().sort_by("rid")
        shard = table.column("shard")[0].as_py()
        x = _vectors(table.column("v").chunk(0), dim) + 0.0  # no negative zeros
        _, first, group = np.unique(x.view(f"V{8 * dim}").ravel(), return_index=True, return_inverse=True)
        ids = table.column("vec_id").to_numpy()
        members = np.lexsort((ids, group.ravel()))
        held = np.split(ids[members], np.cumsum(np.bincount(group.ravel()))[:-1])
        rng = np.random.default_rng(shard)
        levels = np.floor(rng.exponential(1 / np.log(LINKS), len(first))).astype(np.int32)
        order = np.lexsort((rng.random(len(first)), -levels))
        x, levels = x[first[order]], levels[order]
        graph = Graph.build(unit(x).astype(np.float32), levels)
        links = [b"".join(lists[i].astype("<i4").tobytes() for lists in graph.lists[:levels[i] + 1]) for i in range(len(x))]
        return pa.table({
            "shard": pa.array(np.full(len(x), shard, np.int32)), "node": pa.array(np.arange(len(x), dtype=np.int32)),
            "level": pa.array(levels), "ids": pa.array([held[i] for i in order], pa.list_(pa.int64())),
            "v": pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, dim), pa.int32()), pa.array(x.ravel())),
            "links": pa.array(links, pa.binary())})

    return run


def build_index(rows: DataFrame, dim: int, shards: int) -> DataFrame:
    """The index table of rows (rid, vec_id, v), written once; a shard is built by one task."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("rid"), F.lit(shards)).cast("int"))
    return stage(dealt.groupBy("shard").applyInArrow(_built(dim), INDEX), "graph")


class Shard:
    """A graph read back from rows of the index."""

    def __init__(self, x: np.ndarray, levels: np.ndarray, ids: list[np.ndarray], links: list[bytes]):
        self.x, self.ids = x, ids
        flat, widths = np.frombuffer(b"".join(links), "<i4"), [2 * LINKS + SPARE, LINKS]
        start = np.cumsum([0, *(len(b) // 4 for b in links)])[:-1]
        lists, at = [], 0
        for level in range(int(levels.max(initial=0)) + 1):
            width = widths[min(level, 1)]
            own = start[:int((levels >= level).sum())]
            lists.append(flat[(own + at)[:, None] + np.arange(width)])
            at += width
        self.graph = Graph(unit(x).astype(np.float32), lists)

    def nearest(self, q: np.ndarray, own: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query number, ids and cosines of the k best; `own` ids are passed over."""
        step = max(16, min(256, CELLS // max(1, len(self.x))))
        for at in range(0, len(q), step):
            some = q[at:at + step]
            near = self.graph.search(unit(some).astype(np.float32), max(BEAM, 2 * k, math.isqrt(len(self.x))))
            score = np.where(near >= 0, cosines(self.x[near], some), -np.inf)
            for i, line in enumerate((-score).argsort(axis=1, kind="stable")):
                line = line[score[i, line] > -np.inf]
                # Enough nodes for k ids besides the query's own, and all that tie with the last of them.
                line = line[score[i, line] >= score[i, line[min(k, len(line) - 1)]]]
                held = [self.ids[j][:k + np.count_nonzero(self.ids[j] == own[at + i])] for j in near[i, line]]
                found, value = np.concatenate(held), np.repeat(score[i, line], [len(h) for h in held])
                other = found != own[at + i]
                found, value = found[other], value[other]
                best = np.lexsort((found, -value))[:k]
                yield at + i, found[best], value[best]


def _searched(dim: int, k: int):
    """Rows sorted by (unit, kind, node), nodes before queries, to the k best of each query and unit."""
    def answers(shard: Shard, batch):
        import pyarrow as pa

        rid = batch.column("rid").to_numpy(zero_copy_only=False)
        own = np.array([i[0] for i in batch.column("ids").to_pylist()], np.int64)
        found = list(shard.nearest(_vectors(batch.column("v"), dim), own, k))
        times = [len(ids) for _, ids, _ in found]
        which = np.repeat([i for i, _, _ in found], times).astype(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(rid[which]), pa.array(own[which]), pa.array(np.concatenate([ids for _, ids, _ in found])),
             pa.array(np.concatenate([s for _, _, s in found]))], ["rid", "query_id", "vec_id", "score"])

    def run(batches):
        unit_, parts, shard = None, [], None
        for batch in batches:
            units, kinds = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "kind"))
            cuts = np.flatnonzero((np.diff(units) != 0) | (np.diff(kinds) != 0)) + 1
            for start, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if start == end:
                    continue
                part = batch.slice(start, end - start)
                if units[start] != unit_:
                    unit_, parts, shard = units[start], [], None
                if kinds[start] == 0:
                    parts.append(part)
                    continue
                if shard is None and parts:
                    shard = Shard(
                        np.concatenate([_vectors(p.column("v"), dim) for p in parts]),
                        np.concatenate([p.column("level").to_numpy(zero_copy_only=False) for p in parts]),
                        [np.array(i) for p in parts for i in p.column("ids").to_pylist()],
                        [b for p in parts for b in p.column("links").to_pylist()])
                    parts = []
                if shard is not None:  # else no row was dealt to it
                    yield answers(shard, part)

    return run


def search_index(index: DataFrame, queries: DataFrame, dim: int, shards: int, groups: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (rid, vec_id, v), each against all shards."""
    none = F.lit(None)
    nodes = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(
        (F.col("shard") * F.lit(groups) + F.col("group")).alias("unit"), F.lit(0).alias("kind"), "node",
        none.cast("long").alias("rid"), "ids", "v", "level", "links")
    group = F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(
        (F.col("shard") * F.lit(groups) + group).alias("unit"), F.lit(1).alias("kind"), none.cast("int").alias("node"),
        "rid", F.array("vec_id").alias("ids"), F.col("v").cast("array<double>").alias("v"), none.cast("int").alias("level"),
        none.cast("binary").alias("links"))
    met = nodes.unionByName(asked).repartition("unit").sortWithinPartitions("unit", "kind", "node")
    found = met.mapInArrow(_searched(dim, k), "rid long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest_neighbours(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding",
                       k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): about the k nearest rows by cosine of each row that satisfies `is_query`."""
    spark = vectors.sparkSession
    some = F.exists(vector, lambda x: x != 0)
    kept = vectors.where(F.col(vec_id).isNotNull() & usable(vector) & some).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v"))
    rows = numbered(kept)
    count, dim, asked = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(is_query)).first()
    if not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    zero = F.lit(0).cast(rows.schema["v"].dataType.elementType)
    padded = rows.withColumn("v", F.concat("v", F.array_repeat(zero, F.lit(dim) - F.size("v"))))
    size = shard_rows(count)
    shards, groups = -(-count // size), -(-asked // size)
    index = build_index(padded, dim, shards)
    return search_index(index, padded.where(is_query), dim, shards, groups, k)


def op13_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine for every vector whose id is divisible by 50, against all vectors."""
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
