"""Embedding near-duplicates with a forest of random-projection trees.

A tree splits the unit sphere again and again by the projection on a random direction, at the median of a sample;
vectors near a split go to both sides (spill).  Vectors that share a leaf and a label are compared in double precision;
over many trees a close pair shares a leaf almost surely.  It counts in the first leaf that it shares, so a leaf need
not pass on its pairs: each of its vectors gives one row, with its links and one vector that it reaches over them.
Those rows are summed and joined to components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, hash_order, map_rows
from .components import components

LEAST_COSINE = 0.98
TREES = 8
#: Vectors near a split go to both sides: within so much of the length by which two vectors of the least cosine differ,
#: as a random direction shows it.
SPILL = 0.8
#: Where splits are many, the spill is narrower, so that a tree makes about so many copies of a vector, whatever its depth.
TREE_COPIES = 4.5
#: Vectors of one label in a leaf, about.
LEAF_ROWS = 64
#: The splits of each dimension are set from so many vectors at most.
SAMPLE_ROWS = 16_384
#: A node whose split is set from the sample has two to the power of so many sampled vectors, about.
LEAST_SAMPLED = 3
#: A leaf with more vectors is compared in pairs of blocks of about so many.
BLOCK_ROWS = 1_024
#: A vector is common if it is more than one row in so many, hence there are fewer common vectors than that.
HOT = 1_000
SALTS = 64
SEED = 7


def spill(dimensions: int, depth: int) -> float:
    """How far from a split a unit vector may be projected and still go to both sides.

    A difference of length r shows as r / sqrt(dimensions) on a random direction, and so does a unit vector as
    1 / sqrt(dimensions): a spill of s / sqrt(dimensions) sends about 0.8 * s of all vectors to both sides of a split.
    """
    differ = np.sqrt(2 * (1 - LEAST_COSINE))
    return float(min(SPILL * differ, np.log(TREE_COPIES) / max(1, depth) / 0.8) / np.sqrt(dimensions))


class Tree:
    """Random directions, one for each level, and a threshold for each node; below the levels that the sample can set, nodes share those of their ancestor."""

    def __init__(self, directions: np.ndarray, thresholds: list[np.ndarray], known: int):
        self.directions, self.thresholds, self.known = directions, thresholds, known
        self.spill = spill(directions.shape[1], len(thresholds))

    @classmethod
    def grow(cls, sample: np.ndarray, depth: int, rng: np.random.Generator) -> Tree:
        directions = rng.standard_normal((depth, sample.shape[1]))
        directions /= np.linalg.norm(directions, axis=1, keepdims=True)
        known = max(1, int(np.log2(max(2, len(sample)))) - LEAST_SAMPLED)
        node, thresholds = np.zeros(len(sample), np.int64), []
        for level in range(depth):
            p, cut = sample @ directions[level], np.zeros(1 << min(level, known))
            order = np.argsort(node, kind="stable")
            ends = np.searchsorted(node[order], np.arange(len(cut) + 1))
            for k in range(len(cut)):
                inside = p[order[ends[k] : ends[k + 1]]]
                # A node without samples keeps the overall median.
                cut[k] = np.median(inside) if len(inside) else np.median(p)
            thresholds.append(cut)
            if level < known:
                node = node * 2 + (p > cut[node])
        return cls(directions, thresholds, known)

    def leaves(self, x: np.ndarray, depth: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the leaves they belong to; a row may be in several, and goes down as many levels as its own depth."""
        row, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        depth = np.full(len(x), len(self.thresholds)) if depth is None else depth
        for level, (direction, cut) in enumerate(zip(self.directions, self.thresholds, strict=True)):
            off = (x @ direction)[row] - cut[node >> max(0, level - self.known)]
            deep = depth[row] > level
            left, right = ~deep | (off <= self.spill), deep & (off > -self.spill)
            node = np.concatenate([np.where(deep[left], node[left] * 2, node[left]), node[right] * 2 + 1])
            row = np.concatenate([row[left], row[right]])
        return row, node


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """Vectors, stored as bytes of numbers of one kind, as doubles."""
    blob = b"".join(column.to_pylist())
    return np.frombuffer(blob, kind).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def earlier(rows: np.ndarray, leaf: np.ndarray) -> pa.ListArray:
    """For each place of a vector, the leaves of the same vector before it; both arrays come in order of row and leaf."""
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    start = np.repeat(starts, np.diff(starts, append=len(rows)))
    n = np.arange(len(rows)) - start
    ends = np.concatenate([[0], np.cumsum(n)])
    at = np.arange(ends[-1]) - np.repeat(ends[:-1], n) + np.repeat(start, n)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(leaf[at]))


def _route(trees: list[Tree], kind: str):
    def route(batch: pa.RecordBatch) -> dict[str, object]:
        x, depth = unit(_matrix(batch.column(2), kind)), np.asarray(batch.column(4))
        # Labels with few vectors are one leaf, of the first tree.
        found = [tree.leaves(x, depth) for tree in trees]
        found = [(r, n) if k == 0 else (r[depth[r] > 0], n[depth[r] > 0]) for k, (r, n) in enumerate(found)]
        rows = np.concatenate([r for r, _ in found])
        leaf = np.concatenate([node + (k << 40) for k, (_, node) in enumerate(found)])
        order = np.lexsort((leaf, rows))
        rows, leaf = rows[order], leaf[order]
        at = pa.array(rows)
        own = {n: batch.column(i).take(at) for i, n in enumerate(("label", "least", "v", "copies"))}
        return {"leaf": pa.array(leaf)} | own | {"leaves": earlier(rows, leaf)}

    return route


def _pack(kind: str):
    def pack(batch: pa.RecordBatch) -> dict[str, object]:
        v = [np.asarray(x, kind).tobytes() for x in batch.column(1).to_pylist()]
        return {"label": batch.column(0), "v": pa.array(v, pa.binary()), "vec_id": batch.column(2)}

    return pack


def met_before(lists: pa.ListArray, leaf: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows ``a`` and rows ``b`` share a leaf that comes before ``leaf``; lists may hold earlier leaves alone."""
    row = np.repeat(np.arange(len(lists)), np.diff(np.asarray(lists.offsets)))
    each = np.asarray(lists.flatten())
    row, each = row[each < leaf], each[each < leaf]
    names, column, counts = np.unique(each, return_inverse=True, return_counts=True)
    # Leaves of one row alone aren't shared.
    at = np.cumsum(counts > 1) - 1
    row, column = row[counts[column] > 1], at[column[counts[column] > 1]]
    met = np.zeros((len(a), len(b)), bool)
    for k in range(0, int((counts > 1).sum()), 1024):
        part = (column >= k) & (column < k + 1024)
        there = np.zeros((len(lists), 1024), np.float32)
        there[row[part], column[part] - k] = 1
        met |= there[a] @ there[b].T > 0
    return met


def roots(n: int, one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The least row that each of ``n`` rows reaches over links."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, one, root[other])
        np.minimum.at(low, other, root[one])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(kind: str):
    def compare(keys: tuple, table: pa.Table) -> pa.Table:
        """A row for each linked vector of two blocks: what it reaches, and how many it links with that it met first here."""
        table = table.combine_chunks()
        col = lambda name: table.column(name).chunk(0)
        x, ids, block, copies = _matrix(col("v"), kind), np.asarray(col("least")), np.asarray(col("block")), np.asarray(col("copies"))
        leaf, i, j = (k.as_py() for k in keys[1:])
        x = unit(x)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links = x[a] @ x[b].T >= LEAST_COSINE
        if i == j:
            np.fill_diagonal(links, False)
        links &= ~met_before(col("leaves"), leaf, a, b)
        near, copies = np.zeros(len(ids)), copies.astype(np.float64)
        near[a] += links.astype(np.float64) @ copies[b]
        if i != j:
            near[b] += links.T.astype(np.float64) @ copies[a]
        one, other = np.nonzero(links)
        root, linked = roots(len(ids), a[one], b[other]), np.flatnonzero(near)
        return pa.table({"a": ids[linked], "b": ids[root[linked]], "near": near[linked].astype(np.int64)})

    return compare


def usable(column: str = "embedding"):
    """Whether a vector can link: not null or empty, finite, and not zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def near_vectors(embeddings: DataFrame) -> DataFrame:
    """Links between vectors of equal labels with a cosine of 0.98 or more: one row per row of ``embeddings``.

    ``vec_id``, ``n_links`` (other rows linked directly), ``component_id`` (least id reachable) and ``kept``.
    Vectors that are null, empty or zero, or hold a null or non-finite number, and rows with a null label link with
    nothing; nor do vectors of different dimensions.  Rows with a null id take part, and stay null.  Equal vectors of
    a label are one in the forest, so a common vector costs one row; its copies are counted as links.

    Each dimension has trees of its own, set from ``SAMPLE_ROWS`` distinct vectors of it at most, drawn by hash; every
    vector is routed, as many levels down as its label has vectors for, so leaves keep their size as labels grow.
    Labels with few vectors have one leaf.  A leaf that splits couldn't part, as of very many near copies, is compared
    in pairs of blocks, all of them, so nothing is dropped.
    """
    scratch = Scratch(embeddings.sparkSession)
    rows = embeddings.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").alias("label")
    )
    good = rows.where(usable("e") & F.col("label").isNotNull())
    kind = rows.schema["label"].dataType.simpleString()
    # Single floats stay what they are on their way; all products are of doubles.
    number = "<f4" if "array<float>" in embeddings.schema["embedding"].dataType.simpleString() else "<f8"
    packed = map_rows(good.select("label", "e", "vec_id"), _pack(number), f"label {kind}, v binary, vec_id bigint")
    # A distinct vector is known by a number of its own, also where all its ids are null; it is fixed once it is written.
    same = packed.groupBy("label", "v").agg(F.min("vec_id").alias("vec"), F.count("*").alias("copies"))
    same = same.withColumn("least", F.monotonically_increasing_id())
    distinct = scratch.cut(same, "distinct")
    # Dimensions come from the whole table, so that none depends on what a sample holds.
    width = F.octet_length("v")
    levels = F.greatest(F.lit(0), F.ceil(F.log2(F.count("*") / LEAF_ROWS))).cast("int")
    counted = scratch.cut(distinct.groupBy(width.alias("width"), "label").agg(levels.alias("depth")), "depths")
    depths = {r.width: r.depth for r in counted.groupBy("width").agg(F.max("depth").alias("depth")).collect()}
    routed = []
    if flat := sorted(w for w, depth in depths.items() if not depth):
        leaf = width.cast("bigint")
        whole = distinct.where(width.isin(flat)).select(leaf.alias("leaf"), "label", "least", "v", "copies", F.array().cast("array<bigint>").alias("leaves"))
        routed.append(whole)
    for w, depth in sorted(depths.items()):
        if not depth:
            continue
        part = distinct.where(width == w)
        chosen = part.select("v").orderBy(hash_order("label", "v"), "label", "v").limit(SAMPLE_ROWS).toArrow().column("v").to_pylist()
        x = unit(np.frombuffer(b"".join(chosen), number).reshape(len(chosen), -1).astype(np.float64))
        rng = np.random.default_rng(SEED)
        trees = [Tree.grow(x, depth, rng) for _ in range(TREES)]
        schema = f"leaf bigint, label {kind}, least bigint, v binary, copies bigint, leaves array<bigint>"
        own = counted.where(F.col("width") == w).select("label", "depth")
        routed.append(map_rows(part.join(own, "label").select("label", "least", "v", "copies", "depth"), _route(trees, number), schema, 1 << 20))
    links = None
    for part in routed:
        found = _links(part, number)
        links = found if links is None else links.union(found)
    if links is None:
        links = embeddings.sparkSession.createDataFrame([], "a bigint, b bigint, near bigint")
    links = scratch.cut(links, "links")
    member = components(links.select("a", "b"), scratch)
    degree = links.groupBy(F.col("a").alias("least")).agg(F.sum("near").alias("near"))
    whole = distinct.select("label", "v", "vec", "copies", "least").join(degree, "least", "left")
    whole = whole.join(member.withColumnRenamed("node", "least"), "least", "left").withColumn("component", F.coalesce("component", "least"))
    roots = whole.groupBy("component").agg(F.min("vec").alias("root"))
    whole = whole.join(roots, "component").select(
        "label", "v", "copies", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("root").alias("component_id")
    )
    # Rows of common vectors, of which there are HOT at most, are dealt to SALTS tasks.
    total = distinct.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("n")).first().n
    common = F.col("copies") * HOT > total
    hot = F.broadcast(distinct.where(common).select("label", "v", F.lit(True).alias("hot")))
    salted = packed.join(hot, ["label", "v"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).otherwise(0).cast("int"))
    spread = whole.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(common, SALTS - 1).otherwise(0))))
    linked = salted.join(spread, ["label", "v", "salt"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~(usable("e") & F.col("label").isNotNull())).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(routed: DataFrame, number: str) -> DataFrame:
    """``a``, ``b`` and ``near`` for linked vectors of each leaf: ``b`` is reached from ``a``, ``near`` counts links."""
    sizes = routed.groupBy("label", "leaf").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK_ROWS)
    sizes = sizes.select("label", "leaf", F.ceil(F.col("n") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = routed.join(sizes, ["label", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("least"), F.col("blocks")).cast("int"))
    # Each block meets each other block of its leaf, and itself, in a task of two blocks at most.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(F.col("block"), k).alias("i"), F.greatest(F.col("block"), k).alias("j")),
    )
    dealt = placed.select("label", "leaf", "least", "v", "copies", "leaves", "block", F.explode(pairs).alias("p")).select("*", "p.i", "p.j").drop("p")
    return dealt.groupBy("label", "leaf", "i", "j").applyInArrow(_compare(number), "a bigint, b bigint, near bigint")
