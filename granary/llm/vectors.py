"""Near-duplicate vectors by a forest of random-projection trees with spill.

A tree splits by random directions at the median of a bounded sample (``SAMPLE`` vectors with the smallest hash
of their id; only the medians come from it). Every vector is sent down every tree. One that lies near a
split goes to both sides, so two close vectors are parted only if they lie on either side of the margin. A
node is not cut where the cut would send so many to both sides that no comparison is saved. A leaf over ``BOUND``
vectors is dealt by hash into blocks, and each pair of blocks is a cell of its own. In each leaf or cell all vectors of one label are compared with each other by matrix products in double precision.

Equal vectors with equal label are one class with a multiplicity, represented by the smallest id. A pair of
classes is counted in the first leaf that holds both, found from the leaf lists that each row carries, so links are
counted without emitting pairs; per leaf or cell only a count and one tree edge per vector leave the task. Edges of
all leaves are united by connected components.

Vectors that are null, empty, all zero, or hold null or non-finite components, and those with null label or
id, link with nothing. Vectors of different length are not compared. Rows with equal id have the links of all of
them, each row counting as another vector. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.store import stored
from granary.operators.graph import connected_components

SAMPLE = 20_000
LEAF = 300
BLOCK = 1024
BOUND = 2048
#: Two sides of (1 + share) / 2 of a node have as many pairs as the node at a share of 0.41.
MOST_ON_BOTH = 0.4


def grow(points: np.ndarray, depth: int, seed: int, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of the inner nodes of a complete binary tree, in heap order.

    A node that is not cut has an infinite threshold: all go to its left side.
    """
    rng = np.random.default_rng(seed)
    nodes = (1 << depth) - 1
    directions = rng.standard_normal((max(nodes, 1), points.shape[1]))
    directions /= np.linalg.norm(directions, axis=1, keepdims=True)
    cuts = np.zeros(max(nodes, 1))
    held = {0: np.arange(len(points))}
    for node in range(nodes):
        own = held.pop(node)
        along = points[own] @ directions[node]
        cuts[node] = np.median(along) if len(own) else 0.0
        if len(own) and (np.abs(along - cuts[node]) <= margin).mean() > MOST_ON_BOTH:
            cuts[node] = np.inf
        held[2 * node + 1], held[2 * node + 2] = own[along <= cuts[node]], own[along > cuts[node]]
    return directions[:nodes], cuts[:nodes]


def leaves(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that each point reaches."""
    directions, cuts = tree
    row, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    inner = len(cuts)
    while len(node) and node[0] < inner:  # all nodes are on one level
        along = np.einsum("ij,ij->i", points[row], directions[node]) - cuts[node]
        left, right = along <= margin, along >= -margin
        row, node = np.concatenate([row[left], row[right]]), np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
    return row, node - inner


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _placed(trees: list, margin: float):
    """One row per vector and leaf, with all its leaf codes (tree * 2^32 + leaf)."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                if not part.num_rows:
                    continue
                dim = len(part.column("embedding")[0])
                x = _unit(part.column("embedding"), dim)
                rows, codes = [], []
                for t, tree in enumerate(trees):
                    r, leaf = leaves(x, tree, margin)
                    rows.append(r)
                    codes.append((t << 32) + leaf)
                row, code = np.concatenate(rows), np.concatenate(codes)
                order = np.lexsort((code, row))
                row, code = row[order], code[order]
                bounds = np.append(0, np.cumsum(np.bincount(row, minlength=part.num_rows)))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(code, pa.int64()))
                who = pa.array(row)
                yield pa.record_batch(
                    [*(part.column(c).take(who) for c in ("rep", "label", "n", "embedding")), pa.array(code), lists.take(who)],
                    names=["rep", "label", "n", "embedding", "leaf", "leaves"],
                )

    return run


def first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest code in both padded sorted lists of each row (padding -1 in ``a``, -2 in ``b``)."""
    none = np.iinfo(np.int64).max
    out = np.full(len(a), none)
    for k in range(b.shape[1]):
        shared = (a == b[:, k : k + 1]).any(axis=1)
        out = np.minimum(out, np.where(shared, b[:, k], none))
    return out


def fold(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest position that each one reaches, with the edges (i, j) added."""
    while True:
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
        if not len(i):
            return root
        a, b = root[i], root[j]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def leaf_links(rep: np.ndarray, n: np.ndarray, unit: np.ndarray, codes: np.ndarray, leaf: int, least: float, block: np.ndarray | None = None):
    """Per vector of a leaf: links that are counted here, and the smallest position linked with it in the leaf.

    With ``block``, only vectors of different blocks are compared.
    """
    links = np.zeros(len(rep), dtype=np.int64)
    root = np.arange(len(rep))
    padded = np.where(codes < 0, -2, codes)
    for at in range(0, len(rep), BLOCK):
        close = unit[at : at + BLOCK] @ unit.T >= least
        if block is not None:
            close &= block[at : at + BLOCK, None] != block
        i, j = np.nonzero(close)
        i += at
        upper = rep[i] < rep[j]
        i, j = i[upper], j[upper]
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            own = first_shared(codes[a], padded[b]) == leaf
            links += np.bincount(a[own], weights=n[b[own]], minlength=len(rep)).astype(np.int64)
            links += np.bincount(b[own], weights=n[a[own]], minlength=len(rep)).astype(np.int64)
        root = fold(root, i, j)
    return links, root


CELL = ["label", "dim", "leaf", "i", "j"]


def _cells(placed: DataFrame) -> DataFrame:
    """Leaves over ``BOUND`` rows dealt by hash into blocks; each row goes to every cell of its block and another."""
    key = ["label", "dim", "leaf"]
    large = placed.groupBy(*key).agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > BOUND)
    blocks = F.broadcast(large.select(*key, F.ceil(F.col("k") / BOUND).alias("blocks")))
    dealt = placed.join(blocks, key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("blocks", "other")


def _compared(least: float):
    def solve(rows: pa.Table):
        rows = rows.combine_chunks()
        order = np.argsort(rows.column("rep").to_numpy(), kind="stable")
        rows = rows.take(pa.array(order)).combine_chunks()
        column = rows.column("embedding").combine_chunks()
        unit = _unit(column, len(column[0]))
        lists = rows.column("leaves").combine_chunks()
        size = np.diff(np.asarray(lists.offsets))
        codes = np.full((len(size), size.max()), -1, dtype=np.int64)
        codes[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
        rep = rows.column("rep").to_numpy()
        across = rows.column("i")[0].as_py() != rows.column("j")[0].as_py()
        block = rows.column("block").to_numpy() if across else None
        links, root = leaf_links(rep, rows.column("n").to_numpy(), unit, codes, rows.column("leaf")[0].as_py(), least, block)
        some = np.flatnonzero((links > 0) | (root != np.arange(len(rep))))
        return pa.record_batch([pa.array(rep[some]), pa.array(links[some]), pa.array(rep[root[some]])], names=["rep", "links", "root"])

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            change = np.zeros(table.num_rows - 1, dtype=bool)
            for k in CELL:
                x = table.column(k).to_numpy()
                change |= x[1:] != x[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield solve(table.slice(a, b - a))
            held = table.slice(cuts[-1])
        if held is not None:
            yield solve(held)

    return run


def _leaf_rows(classes: DataFrame, trees: int, least: float, seed: int) -> DataFrame:
    """Vectors with each of their leaves. Vectors of one length share a forest."""
    out = None
    sizes = classes.groupBy("dim", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("dim").agg(F.max("k"), F.sum("k"))
    for dim, largest, total in sorted(tuple(r) for r in sizes.collect()):
        own = classes.where(F.col("dim") == dim)
        # About twice the sample passes the filter, so that few rows are sorted.
        some = own.where(F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) <= (1 << 20) * min(1.0, 2 * SAMPLE / total))
        sample = some.orderBy(F.xxhash64("rep"), "rep").select("embedding").limit(SAMPLE).toArrow()
        points = _unit(sample.column("embedding").combine_chunks(), dim)
        depth = max(0, int(np.ceil(np.log2(largest / LEAF))))
        # 0.8 standard deviations of the difference that two vectors at the threshold have along a direction.
        margin = 0.8 * np.sqrt(2 * (1 - least) / dim)
        forest = [grow(points, depth, seed + t, margin) for t in range(trees)]
        rows = own.select("rep", "label", "n", "embedding").mapInArrow(
            _placed(forest, margin), "rep long, label long, n long, embedding array<double>, leaf long, leaves array<long>"
        )
        rows = rows.withColumn("dim", F.lit(dim))
        out = rows if out is None else out.unionByName(rows)
    return out


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.98, trees: int = 6, seed: int = 5
) -> DataFrame:
    """vec_id, n_links, component_id (smallest id reachable), kept (it is that id)."""
    base = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"), F.col(label_col).cast("long").alias("label")
    )
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    whole = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    usable = base.where(F.coalesce(whole, F.lit(False)))
    classes = usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.withColumn("dim", F.size("embedding")), "vectors")
    placed = _leaf_rows(classes, trees, least, seed)
    if placed is None:
        return _result(base.select("vec_id"), None, None)
    grouped = _cells(placed).repartition(*CELL).sortWithinPartitions(*CELL)
    found = stored(grouped.mapInArrow(_compared(least), "rep long, links long, root long"), "leaves")
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    members = usable.join(classes, ["label", "embedding"]).select("vec_id", "rep", "n")
    links = members.join(counted, "rep", "left").groupBy("vec_id").agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    edges = found.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    copies = members.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))
    components = connected_components(edges.unionByName(copies))
    return _result(base.select("vec_id"), links, components)


def _result(ids: DataFrame, links: DataFrame | None, components: DataFrame | None) -> DataFrame:
    if links is None:
        out = ids.withColumns({"n_links": F.lit(0).cast("long"), "component_id": F.col("vec_id")})
    else:
        out = (
            ids.join(links, "vec_id", "left")
            .join(components.withColumnRenamed("vertex", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
