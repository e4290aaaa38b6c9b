"""SimHash near-dedup with BK-trees.

Each text gets a 64-bit fingerprint from its word shingles. Fingerprints that differ in few bits are linked, linked
ones form components. Equal fingerprints collapse to one node first, so copies cost nothing more.

Search: the bits are cut into blocks, two more than the distance allows to be hit, so that two linked
fingerprints agree on at least two whole blocks. Every choice of two blocks is a shard key, and only nodes that
share a key can be linked. The nodes of a shard form a BK-tree, whose children hang at their integer distance
from the parent; a search follows only edges within the radius. Shards above `TREE` nodes are split by two more blocks,
cut from their other bits in the same way; those that are still above it are dealt over several trees, and each
tree is sent to each bounded group of searching nodes. (Sending every tree to all tasks would need a broadcast that
grows with the corpus; here a tree goes where its key is.) A task hands out a spanning forest of the links it finds,
never all pairs, and holds one tree and one group at a time.

Components come from alternating large-star and small-star rounds over written tables.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other. Texts shorter
than a shingle are one shingle. The component id is the smallest document id, null only if all are null.
Repeated document ids are separate rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate, combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewatch.llm.common import numbered, partitions, read_table, text_batches
from tapewatch.llm.tokens import utf8
from tapewatch.session import stage

SHINGLE, DISTANCE, SEED = 3, 3, 42
#: Nodes in one BK-tree, and in one group that searches it.
TREE = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE) -> bytes:
    """The SimHash of a UTF-8 text, eight bytes, highest bit first."""
    from xxhash import xxh64_digest

    words = text.lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = xxh64_digest(line, SEED)
    else:
        ends = list(accumulate(map(len, words), lambda at, n: at + 1 + n))
        starts = [0, *(e + 1 for e in ends)]
        hashes = b"".join([xxh64_digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1:])])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(bits)).tobytes()


def with_fingerprints(rows: DataFrame, text: str, shingle: int = SHINGLE) -> DataFrame:
    """Replace the text column by `fp`, the fingerprint as a signed long."""
    rest = [c for c in rows.columns if c != text]

    def prints(batches):
        import pyarrow as pa

        for batch in batches:
            data = b"".join(fingerprint(t or b"", shingle) for t in utf8(batch.column(text)))
            column = pa.array(np.frombuffer(data, ">i8").astype(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), column], [*rest, "fp"])

    schema = rows.select(*rest).schema.add("fp", "long")
    return rows.select(*rest, text).mapInArrow(prints, schema)


def _pairs_of_blocks(bits: Column, width: int, distance: int) -> tuple[list[tuple[Column, Column]], list[Column]]:
    """The blocks that a number of `width` bits is cut into, by twos; and for each choice the other blocks as one number."""
    blocks = distance + 2
    edges = [width * i // blocks for i in range(blocks + 1)]
    sizes = [b - a for a, b in zip(edges, edges[1:])]
    cut = [F.shiftrightunsigned(bits, a).bitwiseAND((1 << n) - 1) for a, n in zip(edges, sizes)]
    pairs, rest = [], []
    for pair in combinations(range(blocks), 2):
        pairs.append((cut[pair[0]], cut[pair[1]]))
        others = F.lit(0).cast("long")
        for i in range(blocks):
            if i not in pair:
                others = F.shiftleft(others, sizes[i]).bitwiseOR(cut[i])
        rest.append(others)
    return pairs, rest


def shard_keys(distance: int) -> list[Column]:
    """One key per choice of two blocks; fingerprints within the distance share at least one."""
    width = -(-64 // (distance + 2))
    pairs, _ = _pairs_of_blocks(F.col("fp"), 64, distance)
    return [F.lit(i << 2 * width).cast("long").bitwiseOR(F.shiftleft(a, width)).bitwiseOR(b) for i, (a, b) in enumerate(pairs)]


def finer_keys(distance: int) -> list[Column]:
    """Keys for the nodes of a crowded `key`: the bits outside of its two blocks are cut into blocks again, and by the
    same reason two linked fingerprints of the key share a choice of two of these."""
    width = -(-64 // (distance + 2))
    _, rest = _pairs_of_blocks(F.col("fp"), 64, distance)
    choice = F.shiftrightunsigned("key", 2 * width).cast("int")
    pairs, _ = _pairs_of_blocks(F.element_at(F.array(*rest), choice + 1), 64 - 2 * (64 // (distance + 2)), distance)
    return [F.xxhash64("key", F.lit(i), a, b) for i, (a, b) in enumerate(pairs)]


class BKTree:
    """Children are keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.nodes: list[tuple[int, dict[int, int]]] = []

    def add(self, value: int) -> None:
        at, new = 0, len(self.nodes)
        self.nodes.append((value, {}))
        while new:
            other, children = self.nodes[at]
            at = children.setdefault((value ^ other).bit_count(), new)
            if at == new:
                return

    def within(self, value: int, radius: int) -> list[int]:
        found, open_ = [], [0] if self.nodes else []
        while open_:
            other, children = self.nodes[open_.pop()]
            distance = (value ^ other).bit_count()
            if distance <= radius:
                found.append(other)
            for d, child in children.items():
                if distance - radius <= d <= distance + radius:
                    open_.append(child)
        return found


class _Forest:
    """Union-find that tells which links join two trees."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (up := self.parent.setdefault(x, x)) != x:
            self.parent[x] = x = self.parent[up]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.parent[a] = b
        return a != b


def _search(distance: int):
    """Rows sorted by unit, tree members before searching nodes, to the links of a spanning forest per unit."""
    mask = 2 ** 64 - 1

    def links(batches):
        import pyarrow as pa

        unit, tree, forest = None, BKTree(), _Forest()
        for batch in batches:
            a, b = [], []
            key, t, g, role, fp = (batch.column(i).to_pylist() for i in range(5))
            for now, searching, x in zip(zip(key, t, g), role, fp):
                if now != unit:
                    unit, tree, forest = now, BKTree(), _Forest()
                value = x & mask
                if searching or now[1] == now[2]:
                    for other in tree.within(value, distance):
                        if forest.join(value, other):
                            a.append(x)
                            b.append(other - 2 ** 64 if other >> 63 else other)
                if not searching:
                    tree.add(value)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links


def links(nodes: DataFrame, distance: int = DISTANCE, tree: int = TREE) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that connect all those within the distance."""
    keyed = nodes.select("fp", F.explode(F.array(*shard_keys(distance))).alias("key"))

    def shared(rows: DataFrame) -> DataFrame:
        """Keys that more than one node has, and how many."""
        return stage(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shards")

    several = shared(keyed)
    placed = keyed.join(several, "key")
    if not several.where(F.col("n") > tree).isEmpty():
        finer = placed.where(F.col("n") > tree).select("fp", F.explode(F.array(*finer_keys(distance))).alias("key"))
        placed = placed.where(F.col("n") <= tree).unionByName(finer.join(shared(finer), "key"))
    trees = F.ceil(F.col("n") / F.lit(tree))
    dealt = placed.select("key", "fp", trees.alias("trees"), F.pmod(F.xxhash64("fp"), trees).alias("own"))
    # Unit (key, t, g): the nodes of group g search tree t, for t <= g; for t = g the tree searches itself.
    as_member = F.transform(F.sequence("own", F.col("trees") - 1), lambda g: F.struct(
        F.col("own").alias("t"), g.alias("g"), F.lit(0).alias("role")))
    as_searching = F.when(F.col("own") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("own") - 1), lambda t: F.struct(
        t.alias("t"), F.col("own").alias("g"), F.lit(1).alias("role"))))
    units = dealt.select("key", "fp", F.explode(F.concat(
        as_member, F.coalesce(as_searching, F.array().cast("array<struct<t:bigint,g:bigint,role:int>>")))).alias("u"))
    return (units.select("key", "u.t", "u.g", "u.role", "fp")
            .repartition(partitions(nodes.sparkSession), "key", "t", "g").sortWithinPartitions("key", "t", "g", "role")
            .mapInArrow(_search(distance), "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (a, b) with b the least node of a's component, for all nodes but those least ones."""
    turned = F.struct(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).alias("e")
    edges = stage(edges.select(turned).select("e.*").where("a != b").distinct(), "links")
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            return edges
        seen = state
        # Large star: every larger neighbour is linked to the least neighbour.
        both = edges.union(edges.select("b", "a"))
        least = stage(both.groupBy("a").agg(F.min("b").alias("m"))
                      .select("a", F.least("a", "m").alias("m")), "least")
        large = stage(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                      .where("a != b").distinct(), "links")
        # Small star: a node and its smaller neighbours are linked to the least of them.
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a")
        edges = stage(small.select("a", F.col("m").alias("b")).union(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")).distinct(), "links")


def _decided(prints: DataFrame, distance: int, tree: int) -> DataFrame:
    """For each fingerprint `fp` of (fp, _id, _rid) rows the first row `best` of its component."""
    order = F.struct(F.col("_id").isNull().alias("unknown"), "_id", "_rid")
    nodes = stage(prints.groupBy("fp").agg(F.min(order).alias("best")), "nodes")
    stars = components(links(nodes, distance, tree))
    member = stage(stars.select(F.col("a").alias("fp"), F.col("b").alias("root")).union(
        stars.select(F.col("b").alias("fp"), F.col("b").alias("root")).distinct()), "members")
    firsts = stage(member.join(nodes, "fp").groupBy("root").agg(F.min("best").alias("first")), "firsts")
    found = stage(member.join(firsts, "root").select("fp", "first"), "found")
    return stage(nodes.join(found, "fp", "left").select(
        F.col("fp").alias("_fp"), F.coalesce("first", "best").alias("_best")), "decided")


def _prints(docs: DataFrame, payload: Sequence[Column], text: str, doc_id: str, shingle: int) -> DataFrame:
    text_batches(docs.sparkSession)
    rows = docs.select(*payload, F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_text"))
    return numbered(with_fingerprints(rows, "_text", shingle), "_rid")


def near_groups(docs: DataFrame, payload: Sequence[Column], text: str = "text", doc_id: str = "doc_id",
                shingle: int = SHINGLE, distance: int = DISTANCE, tree: int = TREE) -> DataFrame:
    """One row per document: the payload, `fp`, `component_id`, and `first`, true for one row per component.

    The payload's names must not begin with an underscore.
    """
    prints = _prints(docs, payload, text, doc_id, shingle)
    names = [c for c in prints.columns if not c.startswith("_") and c != "fp"]
    return prints.join(_decided(prints, distance, tree), F.col("fp") == F.col("_fp")).select(
        *names, "fp", F.col("_best._id").alias("component_id"),
        (F.col("_rid") == F.col("_best._rid")).alias("first"))


def drop_near_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE,
                     distance: int = DISTANCE, tree: int = TREE) -> DataFrame:
    """One document of each component, with all its columns.

    Only numbers of rows are joined with the decisions; the documents themselves then lose those that go.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    prints = _prints(docs, [whole], text, doc_id, shingle)
    narrow = prints.select("fp", "_id", "_rid")
    gone = stage(narrow.join(_decided(narrow, distance, tree), F.col("fp") == F.col("_fp"))
                 .where(F.col("_rid") != F.col("_best._rid")).select("_rid"), "gone")
    return prints.join(gone, "_rid", "left_anti").select("row.*")


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest document id it is linked to."""
    groups = near_groups(read_table(spark, sf_dir, "documents"), [F.col("doc_id")])
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
