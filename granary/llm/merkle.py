"""Merkle manifest of a table: one leaf per row, one tree per language, one tree over their roots, a proof per row.

A leaf is the SHA-256 of its fields, each written as ``-`` if null, else UTF-8 byte count, ``:``, value. The leaves of a
tree ascend by id (null first; equal ids by leaf, where the order of equal leaves changes nothing). While a tree has
several nodes, every ``FAN`` consecutive ones become the hash of their concatenated hex digests; a lone leaf is the
root itself. Trees are ordered by name, null first, and their roots form a tree of the same kind.

*Ranks* come from a range sort: the place inside a partition plus the rows of earlier partitions, so no tree is
one task. *Rollup*: the digits of the rank are grouped away one after another, nesting child structs, inside blocks
of ``FAN ** DIGITS`` leaves; after one shuffle by block, all digits of the block are grouped without another. Block roots
go on in the same way, ``DIGITS`` levels at a time. *Proofs* come from the nested structs by transform and explode, from
the outermost digit inwards. A block gets the proof of its own root by its unique number: to nest all blocks of a
tree in one struct would pass a whole language through one row.

Defined results: every row has a proof, repeated rows too; null ids, names and fields are values of their own; an empty
table gives no rows. Other columns are ignored unless carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.store import stored

FAN = 8
#: Digits nested in a block; a block holds at most FAN ** DIGITS leaves.
DIGITS = 3
PLACE_BITS = 33


def field(value: Column) -> Column:
    """The hashed form of a value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def ranked(nodes: DataFrame, by: list[str]) -> DataFrame:
    """``nodes`` with ``rank`` (from 0, in its ``tree``, by the columns ``by``) and ``height`` (levels of that tree).

    The salt only parts rows that are equal in all sort columns.
    """
    order = ["tree", *by, "salt"]
    spread = nodes.withColumn("salt", F.rand(7)).repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    spread = stored(spread.withColumn("place", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("place", PLACE_BITS)
    counts = spread.groupBy("tree", part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("k"))
    # One row per tree and sort partition.
    trees = Window.partitionBy("tree")
    before = F.sum("k").over(trees.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("k").over(trees)
    counts = counts.select(
        "tree", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.when(total == 1, 0).otherwise(F.length(F.conv((total - 1).cast("string"), 10, FAN))).alias("height"),
    )
    out = spread.withColumn("part", part).join(counts, ["tree", "part"])
    return out.withColumn("rank", F.col("place") + F.col("shift")).drop("place", "part", "shift")


def nested(nodes: DataFrame, level: int, payload: list[str]) -> DataFrame:
    """(tree, rank, height, node, kids): blocks of ``nodes``, which lie ``level`` levels above the leaves."""
    digits = [f"digit{k}" for k in range(DIGITS)]
    rest = [F.pmod(F.floor(F.col("rank") / F.lit(FAN**k)), F.lit(FAN)).cast("int").alias(d) for k, d in enumerate(digits)]
    block = F.floor(F.col("rank") / F.lit(FAN**DIGITS)).cast("long").alias("block")
    rows = nodes.select("tree", block, *rest, "height", "node", *payload).repartition("tree", "block")
    inner = payload
    for k in range(DIGITS):
        child = F.struct(F.col(digits[k]).alias("digit"), "node", *inner)
        rows = rows.groupBy("tree", "block", *digits[k + 1 :]).agg(F.max("height").alias("height"), F.sort_array(F.collect_list(child)).alias("kids"))
        whole = F.sha2(F.array_join("kids.node", ""), 256)
        rows = rows.withColumn("node", F.when(F.col("height") > level + k, whole).otherwise(F.col("kids")[0]["node"]))
        inner = ["kids"]
    return rows.select("tree", F.col("block").alias("rank"), "height", "node", "kids")


def opened(blocks: DataFrame, level: int, payload: list[str], kept: list[str]) -> DataFrame:
    """One row per node of the blocks, with ``rank`` and ``path``: the siblings of each level above it, lowest first."""
    names = F.col("kids.node")

    def step(kid: Column, i: Column) -> Column:
        left, right = F.array_join(F.slice(names, F.lit(1), i), ""), F.array_join(F.slice(names, i + 2, F.lit(FAN)), "")
        return F.struct(kid.alias("kid"), F.struct(left.alias("left"), right.alias("right")).alias("side"))

    rows = blocks.select("tree", "rank", "height", "path", "kids", *kept)
    for k in reversed(range(DIGITS)):
        rows = rows.select("tree", "rank", "height", "path", *kept, F.explode(F.transform("kids", step)).alias("at"))
        path = F.when(F.col("height") > level + k, F.concat(F.array("at.side"), "path")).otherwise(F.col("path"))
        inner = [F.col("at.kid.kids").alias("kids")] if k else [F.col(f"at.kid.{c}").alias(c) for c in ("node", *payload)]
        rank = (F.col("rank") * FAN + F.col("at.kid.digit")).alias("rank")
        rows = rows.select("tree", rank, "height", path.alias("path"), *kept, *inner)
    return rows


def proof_text(path: Column) -> Column:
    """All siblings, lowest level first, left to right."""
    return F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda acc, x: F.sha2(F.concat(x["left"], acc, x["right"]), 256))


def _blocks(nodes: DataFrame, payload: list[str]) -> list[DataFrame]:
    """Stored blocks, from the leaves up to one row per tree."""
    height = nodes.agg(F.max("height")).head()[0] or 0
    out, level = [], 0
    while True:
        out.append(stored(nested(nodes, level, payload), "blocks"))
        level += DIGITS
        if level >= height:
            return out
        nodes, payload = out[-1].select("tree", "rank", "height", "node"), []


def manifest(docs: DataFrame, fields: list[str], id_col: str = "doc_id", tree_col: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """id_col, leaf, subroot, root, path (array of (left, right) siblings), and the columns of ``carry``."""
    carry = carry or {}
    # A null name sorts before every other, the empty one too.
    tree = F.when(F.col(tree_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(tree_col).cast("string")))
    extra = {f"carry{i}": c for i, c in enumerate(carry.values())}
    base = docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf_hash([F.col(f) for f in fields]).alias("node"), *(c.alias(n) for n, c in extra.items()))
    payload = ["id", *extra]
    leaves = ranked(stored(base, "leaves"), ["id", "node"])
    blocks = _blocks(leaves, payload)
    tops = blocks[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "node")
    above = _blocks(ranked(tops, ["name"]), ["name"])
    path = above[-1].withColumns({"path": F.array().cast("array<struct<left:string,right:string>>"), "root": F.col("node")})
    for k in reversed(range(len(above))):
        path = opened(path, k * DIGITS, ["name"] if k == 0 else [], ["root"])
        if k:
            path = above[k - 1].join(path.select("tree", "rank", "path", "root"), ["tree", "rank"])
    path = path.select(F.col("name").alias("tree"), F.col("node").alias("subroot"), "path", "root", F.lit(0).cast("long").alias("rank"))
    for k in reversed(range(len(blocks))):
        path = blocks[k].join(path.select("tree", "rank", "path", "subroot", "root"), ["tree", "rank"])
        path = opened(path, k * DIGITS, payload if k == 0 else [], ["subroot", "root"])
    named = [F.col(n).alias(c) for n, c in zip(extra, carry)]
    return path.select(F.col("id").alias(id_col), F.col("node").alias("leaf"), "subroot", "root", "path", *named)
