"""Near-duplicate documents by HyperMinHash sketches, confirmed on whole shingle sets.

A document is the set of its distinct word shingles (ASCII letters lower-cased). Its sketch has ``BUCKETS``
registers of 16 bits: of the smallest hash in a bucket the number of leading zeros (6 bits) and the ten
bits after the leading one. Four registers make a band of 64 bits, which is its own key.

1. Equal sets are one class, represented by the smallest id; only classes go on.
2. *Stars.* In every bucket of a band each class is compared with the smallest one: a number of pairs linear in
   the bucket, however large a group of copies is.
3. *The rest.* Where a bucket still holds several components, classes of different components are compared in
   blocks of bounded size, by sketches and then, inside the block, by whole sets. Pairs inside a component
   cannot change the result and are left out; no pairs are emitted but links.

A pair is first judged by the estimated similarity, corrected for chance collisions of registers, then
confirmed by the exact counts. With 32 bands of 4 registers a pair at 0.75 is missed with probability
(1 - 0.75^4)^32 = 5e-6, and a component only if each of its paths is.

Null and wordless texts have no shingles and link with nothing. A text with fewer words than a shingle
is one shingle. Rows with equal id count as one document with all their links; rows without id link with
nothing and are kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.store import Scratch
from granary.llm.text import LOWER, Texts, Words, gram_hashes, mix, pieces
from granary.operators.graph import connected_components

BUCKET_BITS = 7
BUCKETS = 1 << BUCKET_BITS
MANTISSA = 10
BAND = 4
BLOCK = 512
#: Estimates this far below the threshold (five standard deviations at 0.75) are still verified.
SLACK = 0.20
#: Chance that two different minima share a register, times 2^(mantissa bits - bucket bits).
COLLISIONS = 0.169919487159739


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    texts = Texts(column)
    words = Words(texts, LOWER[texts.raw])
    hashes = words.hashes()
    grams = gram_hashes(hashes, size)
    bounds = words.doc.tolist()
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix(gram_hashes(hashes[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set: 0 for an empty bucket, else 1 + leading zeros and mantissa of the minimum."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    if len(hashes):
        bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        first = np.append(0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1)
        rest = (hashes[first] << np.uint64(BUCKET_BITS)) >> np.uint64(11)  # 53 bits are exact as a double
        part, exponent = np.frexp(rest.astype(np.float64))
        zeros = 53 - exponent
        mantissa = np.floor(np.maximum(part * 2 - 1, 0) * (1 << MANTISSA)).astype(np.int64)
        out[bucket[first]] = ((zeros + 1) << MANTISSA) | mantissa
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from registers (last axis) and set sizes, less the expected chance collisions."""
    used = ((a > 0) | (b > 0)).sum(-1)
    same = ((a == b) & (a > 0)).sum(-1)
    n, m = np.asarray(n, dtype=float), np.asarray(m, dtype=float)
    chance = COLLISIONS * 2.0 ** (BUCKET_BITS - MANTISSA) * 4 * n * m / np.maximum((n + m) ** 2, 1)
    return np.maximum(same - chance, 0) / np.maximum(used, 1)


def _signatures(size: int):
    def run(batches):
        for piece in pieces(batches, "text"):
            sets = shingle_sets(piece.column("text"), size)
            digests = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64) for s in sets]
            yield pa.record_batch(
                [
                    piece.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d[0] for d in digests], pa.int64()),
                    pa.array([d[1] for d in digests], pa.int64()),
                    pa.array([sketch(s).tobytes() for s in sets], pa.binary()),
                ],
                names=["doc_id", "n_shingles", "high", "low", "sketch"],
            )

    return run


def _bands(batches):
    """One row for each band that has a register in use."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            if not part.num_rows:
                continue
            values = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.int64).reshape(part.num_rows, -1)
            row, band = np.nonzero(values)
            take = pa.array(row)
            rest = [part.column(c).take(take) for c in part.schema.names if c != "sketch"]
            names = [c for c in part.schema.names if c != "sketch"]
            yield pa.record_batch([pa.array(band.astype(np.int32)), pa.array(values[row, band]), *rest], names=["band", "value", *names])


def _plausible(threshold: float):
    """Pairs whose estimate comes near the threshold."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
            b = np.frombuffer(b"".join(batch.column("hub_sketch").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
            n, m = batch.column("n").to_numpy(), batch.column("hub_n").to_numpy()
            good = (estimate(a, b, n, m) >= threshold - SLACK) & (np.minimum(n, m) >= threshold * np.maximum(n, m))
            kept = batch.filter(pa.array(good))
            yield pa.record_batch([kept.column("a"), kept.column("b")], names=["a", "b"])

    return run


def _verify(size: int, percent: int):
    """Rows come sorted by (hub, part), the hub's own text first; each other text is compared with it."""

    def run(batches):
        current, hubs = None, []
        for piece in pieces(batches, "text"):
            sets = shingle_sets(piece.column("text"), size)
            a, b, fine = [], [], []
            for hub, part, kind, doc, own in zip(*(piece.column(c).to_pylist() for c in ("hub", "part", "kind", "doc", "doc")), strict=True):
                mine = sets[len(fine)]
                fine.append(doc)
                if (hub, part) != current:
                    current, hubs = (hub, part), []
                if kind == 0:
                    hubs.append(mine)
                    continue
                for other in hubs:
                    both = len(np.intersect1d(mine, other, assume_unique=True))
                    if both and 100 * both >= percent * (len(mine) + len(other) - both):
                        a.append(own)
                        b.append(hub)
                        break
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int, spread: int = 256) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Hubs with many partners are split over parts."""
    counts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / spread).alias("parts"))
    dealt = pairs.join(counts, "b").select("a", F.col("b").alias("hub"), F.pmod(F.xxhash64("a"), "parts").alias("part"))
    members = dealt.join(texts, dealt["a"] == texts["doc"]).select("hub", "part", F.lit(1).alias("kind"), "doc", "text")
    heads = dealt.select("hub", "part").distinct().join(texts, F.col("hub") == F.col("doc"))
    heads = heads.select("hub", "part", F.lit(0).alias("kind"), "doc", "text")
    both = heads.unionByName(members).repartition("hub", "part").sortWithinPartitions("hub", "part", "kind")
    return both.mapInArrow(_verify(size, percent), "a long, b long")


KEYS = ["band", "value", "i", "j"]


def _groups(batches):
    """Whole blocks from batches sorted by block; no block has more rows than two sides of ``BLOCK``."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not table.num_rows:
            continue
        change = np.zeros(table.num_rows - 1, dtype=bool)
        for k in KEYS:
            x = table.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:]):
            yield table.slice(a, b - a)
        held = table.slice(cuts[-1])
    if held is not None:
        yield held


def _open_pairs(rows: pa.Table, threshold: float):
    """For each row of the first side the rows of the other that may be linked with it and nothing else yet tells.

    A pair belongs to the first band that it shares, so it comes up in one block only.
    """
    side = rows.column("side").to_numpy()
    component, n = rows.column("component").to_numpy(), rows.column("n").to_numpy()
    registers = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint16).reshape(-1, BUCKETS)
    bands = registers.view(np.int64)
    band = rows.column("band")[0].as_py()
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0).tolist():
        low, high = np.minimum(n[i], n[right]), np.maximum(n[i], n[right])
        near = right[(component[right] != component[i]) & (low >= threshold * high)]
        near = near[((bands[near] == bands[i]) & (bands[i] != 0)).argmax(axis=1) == band]
        near = near[estimate(registers[near], registers[i], n[near], n[i]) >= threshold - SLACK]
        if len(near):
            yield i, near


def _open_rows(threshold: float):
    """The rows of each block that have an open pair."""

    def run(batches):
        for rows in _groups(batches):
            used = np.zeros(rows.num_rows, dtype=bool)
            for i, near in _open_pairs(rows, threshold):
                used[i] = True
                used[near] = True
            if used.any():
                yield from rows.select([*KEYS, "side", "rep", "component"]).filter(pa.array(used)).combine_chunks().to_batches()

    return run


def _block_links(size: int, percent: int):
    """Exact comparison of the open pairs of a block: one link to each component that a row reaches."""

    def run(batches):
        for rows in _groups(batches):
            sets = []
            for piece in pieces(rows.combine_chunks().to_batches(), "text"):
                sets += shingle_sets(piece.column("text"), size)
            rep, component = rows.column("rep").to_numpy(), rows.column("component").to_numpy()
            length = np.array([len(s) for s in sets], dtype=np.int64)
            a, b = [], []
            for i, near in _open_pairs(rows, percent / 100):
                others = np.concatenate([sets[k] for k in near.tolist()])
                place = np.minimum(np.searchsorted(sets[i], others), max(len(sets[i]) - 1, 0))
                same = sets[i][place] == others if len(sets[i]) else np.zeros(len(others), dtype=bool)
                total = np.append(0, np.cumsum(same))
                ends = np.append(0, np.cumsum(length[near]))
                both = total[ends[1:]] - total[ends[:-1]]
                linked = near[100 * both >= percent * (length[near] + length[i] - both)]
                for k in linked[np.unique(component[linked], return_index=True)[1]].tolist():
                    a.append(max(rep[i], rep[k]))
                    b.append(min(rep[i], rep[k]))
            if a:
                yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _links_across(classes: DataFrame, components: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between classes that share a band but no component yet.

    Sketches first tell which rows of a block have an open pair; only their texts are fetched.
    """
    threshold = percent / 100
    named = classes.join(components, classes["rep"] == components["vertex"], "left").select(
        "rep", "n", F.coalesce("component", "rep").alias("component"), "sketch"
    )
    bands = named.mapInArrow(_bands, "band int, value long, rep long, n long, component long")
    sizes = bands.groupBy("band", "value", "component").agg(F.count(F.lit(1)).alias("k"))
    mixed = (
        sizes.groupBy("band", "value")
        .agg(F.max(F.struct("k", "component")).alias("main"), F.sum("k").alias("all"))
        .where("all > main.k")
        .select(
            "band", "value", F.col("main.component").alias("main"),
            F.ceil((F.col("all") - F.col("main.k")) / BLOCK).alias("few"), F.ceil(F.col("all") / BLOCK).alias("many"),
        )
    )
    inside = bands.join(mixed, ["band", "value"])
    spot = F.xxhash64("rep")
    left = inside.where("component <> main").select(
        "band", "value", F.pmod(spot, "few").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1)).alias("j"), F.lit(0).alias("side"), "rep"
    )
    right = inside.select(
        "band", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("few") - 1)).alias("i"), F.pmod(spot, "many").alias("j"), F.lit(1).alias("side"), "rep"
    )
    rows = left.unionByName(right).join(named, "rep").repartition(*KEYS).sortWithinPartitions(*KEYS)
    few = rows.mapInArrow(_open_rows(threshold), "band int, value long, i long, j long, side int, rep long, component long")
    whole = few.join(named.select("rep", "n", "sketch"), "rep").join(texts, F.col("rep") == texts["doc"])
    whole = whole.select(*KEYS, "side", "rep", "component", "n", "sketch", "text").repartition(*KEYS).sortWithinPartitions(*KEYS)
    return whole.mapInArrow(_block_links(size, percent), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, scratch: Scratch | None = None
) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (it is that id).

    Tables of finished steps are deleted on the way. The result reads the last ones; who has stored what he needs
    of it may drop the ``scratch``.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    stored = scratch.stored
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    threshold = percent / 100
    signs = stored(
        base.mapInArrow(_signatures(words), "doc_id long, n_shingles long, high long, low long, sketch binary"), "signatures"
    )
    usable = signs.where("n_shingles > 0 and doc_id is not null")
    classes = stored(
        usable.groupBy("high", "low").agg(
            F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch")
        ),
        "classes",
    )
    bands = classes.select("rep", "sketch").mapInArrow(_bands, "band int, value long, rep long")
    hubs = bands.groupBy("band", "value").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    stars = bands.join(hubs, ["band", "value"]).where("rep <> hub").select(F.col("rep").alias("a"), F.col("hub").alias("b"))
    stars = stored(stars.distinct(), "stars")
    # Only classes that share a band with another are ever compared again.
    shared = stored(stars.select(F.col("a").alias("doc")).unionByName(stars.select(F.col("b").alias("doc"))).distinct(), "shared")
    texts = stored(
        # The ids grow with the documents: never broadcast, however few they are.
        base.withColumnRenamed("doc_id", "doc").join(shared.hint("merge"), "doc", "left_semi").select("doc", "text"), "candidates"
    )
    close = classes.join(shared, classes["rep"] == shared["doc"], "left_semi")
    one = close.select(F.col("rep").alias("a"), "n", "sketch")
    two = close.select(F.col("rep").alias("b"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
    likely = stars.join(one, "a").join(two, "b").mapInArrow(_plausible(threshold), "a long, b long").distinct()
    likely = stored(likely, "likely")
    scratch.drop("stars")
    links = stored(confirmed(likely, texts, words, percent), "links")
    scratch.drop("likely")
    components = connected_components(links)
    more = stored(_links_across(close, components, texts, words, percent), "links")
    if not more.isEmpty():
        components = connected_components(links.unionByName(more))
    scratch.drop("links", "candidates", "shared")
    found = classes.select("high", "low", "rep").join(components, F.col("rep") == F.col("vertex"), "left")
    found = found.select("high", "low", F.coalesce("component", "rep").alias("component"))
    # Equal ids with different texts are one document: the smallest component that any of its rows has.
    rows = signs.select("doc_id", "n_shingles", "high", "low").join(found, ["high", "low"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    return rows.select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
