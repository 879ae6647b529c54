"""Removal of word sequences that occur more than once anywhere in the corpus.

A window is ``window`` consecutive words. Windows are the suffixes of the corpus cut at that depth: two
of them are equal exactly if they end in the same deep internal node of its suffix tree. The tree is
never built whole:

1. *Prefixes.* Every window has a smallest ``prefix``-word hash among those inside it; equal windows share
   it. Runs of windows with one such prefix are counted, and runs whose prefix occurs once in the corpus are
   dropped: their windows cannot repeat. This keeps a few rows per hundred words instead of one per word.
2. *Groups.* The text of the other runs goes to the group of its prefix. A prefix with more than
   ``group_rows`` runs is split over sub-groups, so every group fits in memory.
3. *Subtrees.* A task names the nodes of a group at depths 1, 2, 4, ... and ``window``, on the words
   themselves. A node at full depth with two or more windows is a repeat. In a sub-group a window without
   a partner, and one witness of each node, go on under the longest prefix, all ``window`` words; there
   at most one row of a node comes from each sub-group.
4. Covered words are removed document by document.

Null texts and texts without words give no words. Documents shorter than a window lose nothing. Rows
with equal id are separate documents; equal rows repeat each other. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.store import stored
from granary.llm.text import Texts, Words, gram_hashes, pieces, ranges

CHUNK_WORDS = 400_000


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def prefix_runs(doc: np.ndarray, hashes: np.ndarray, window: int, prefix: int):
    """Runs of windows with the same smallest prefix: document, first window, windows, prefix, occurrences."""
    none = np.zeros(0, dtype=np.int64)
    counts = np.maximum(np.diff(doc) - window + 1, 0)
    if not counts.sum():
        return none, none, none, none.astype(np.uint64), none
    grams = gram_hashes(hashes, prefix)
    least = window_minima(grams, window - prefix + 1)
    at = ranges(doc[:-1], counts)
    own = np.repeat(np.arange(len(counts)), counts)
    value = least[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    head = np.flatnonzero(new)
    size = np.diff(np.append(head, len(at)))
    spread = size + (window - prefix)
    same = grams[ranges(at[head], spread)] == np.repeat(value[head], spread)
    seen = np.add.reduceat(same.astype(np.int64), np.cumsum(spread) - spread)
    return own[head], at[head] - doc[own[head]], size, value[head], seen


def _runs(window: int, prefix: int):
    def run(batches):
        for piece in pieces(batches, "text"):
            words = Words(Texts(piece.column("text")))
            own, first, size, value, seen = prefix_runs(words.doc, words.hashes(), window, prefix)
            row = piece.column("row").to_numpy(zero_copy_only=False)
            yield pa.record_batch(
                [
                    pa.array(row[own], pa.int64()),
                    pa.array(value.view(np.int64), pa.int64()),
                    pa.array((first << 32) | size, pa.int64()),
                    pa.array(seen, pa.int64()),
                ],
                names=["row", "prefix", "place", "seen"],
            )

    return run


def _spans(window: int):
    """The text of each listed run, for its group."""

    def run(batches):
        for piece in pieces(batches, "text"):
            words = Words(Texts(piece.column("text")))
            lists = piece.column("runs")
            bounds = np.asarray(lists.offsets)
            flat = lists.flatten()
            place = flat.field("place").to_numpy()
            owner = np.repeat(np.arange(len(lists)), np.diff(bounds))
            first, size = place >> 32, place & 0xFFFFFFFF
            a = words.doc[owner] + first
            b = a + size + window - 2
            raw = words.raw.tobytes()
            spans = [raw[x:y] for x, y in zip(words.start[a].tolist(), words.end[b].tolist())]
            owners = pa.array(owner)
            yield pa.record_batch(
                [
                    piece.column("doc_id").take(owners),
                    piece.column("row").take(owners),
                    flat.field("prefix"),
                    flat.field("parts"),
                    pa.array(first, pa.int64()),
                    pa.array(spans, pa.binary()),
                ],
                names=["doc_id", "row", "prefix", "parts", "first", "span"],
            )

    return run


def node_names(codes: np.ndarray, window: int) -> np.ndarray:
    """A name for the ``window`` codes from each position; equal names exactly for equal codes.

    Names of twice the depth come from pairs of names, the last depth from two that overlap. Positions too
    near the end have no name.
    """
    depth, names = 1, codes.astype(np.int64)
    while depth * 2 <= window:
        names = pd.factorize((names[:-depth] << 32) | names[depth:])[0]
        depth *= 2
    rest = window - depth
    return pd.factorize((names[: len(names) - rest] << 32) | names[rest:])[0] if rest else names


def _label(words: list[bytes]) -> tuple[int, int]:
    digest = hashlib.blake2b(b" ".join(words), digest_size=16).digest()
    return tuple(np.frombuffer(digest, dtype=np.int64).tolist())


def _subtrees(window: int):
    """Repeated windows of whole groups; what single windows of split groups must still be compared with."""
    names = ["doc_id", "row", "start", "windows", "high", "low", "open"]

    def solve(rows: pa.Table):
        spans = rows.column("span").to_pylist()
        lists = [s.split() for s in spans]
        lengths = np.array([len(x) for x in lists], dtype=np.int64)
        words = [w for x in lists for w in x]
        codes = pd.factorize(np.array(words, dtype=object))[0]
        group = pd.factorize(pd.MultiIndex.from_arrays([rows.column("prefix").to_numpy(), rows.column("part").to_numpy()]))[0]
        begin = np.cumsum(lengths) - lengths
        size = lengths - window + 1
        at = ranges(begin, size)
        own = np.repeat(np.arange(len(size)), size)
        # A group is compared only with itself; equal windows of other groups have another prefix anyway.
        node = pd.factorize((group[own].astype(np.int64) << 32) | node_names(codes, window)[at])[0]
        many = np.bincount(node)[node] > 1
        split = rows.column("parts").to_numpy()[own] > 1
        doc, row = rows.column("doc_id"), rows.column("row")
        first = rows.column("first").to_numpy()
        start = first[own] + (at - begin[own])
        # Runs of repeated windows of one span.
        hit = np.flatnonzero(many)
        if len(hit):
            new = np.ones(len(hit), dtype=bool)
            new[1:] = (hit[1:] != hit[:-1] + 1) | (own[hit[1:]] != own[hit[:-1]])
            head = np.flatnonzero(new)
            long = np.diff(np.append(head, len(hit)))
            who = pa.array(own[hit[head]])
            none = pa.nulls(len(head), pa.int64())
            yield pa.table(
                [doc.take(who), row.take(who), pa.array(start[hit[head]], pa.int64()), pa.array(long, pa.int64()), none, none, pa.array(np.zeros(len(head), dtype=bool))],
                names=names,
            )
        one = np.flatnonzero(split)
        if len(one):
            one = one[np.unique(node[one], return_index=True)[1]]
            labels = [_label(words[i : i + window]) for i in at[one].tolist()]
            who = pa.array(own[one])
            yield pa.table(
                [doc.take(who), row.take(who), pa.array(start[one], pa.int64()), pa.array(np.ones(len(one), dtype=np.int64)), pa.array([x[0] for x in labels], pa.int64()), pa.array([x[1] for x in labels], pa.int64()), pa.array(~many[one])],
                names=names,
            )

    def run(batches):
        held, bytes_held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            bytes_held += batch.nbytes
            if bytes_held < CHUNK_WORDS * 8:
                continue
            table = pa.Table.from_batches(held)
            prefix, part = table.column("prefix").to_numpy(), table.column("part").to_numpy()
            change = np.flatnonzero((prefix[1:] != prefix[:-1]) | (part[1:] != part[:-1])) + 1
            if not len(change):
                continue
            # Whole groups go now, in chunks of bounded size; the last group may go on in the next batch.
            cuts, room = [0], 0
            ends = np.cumsum(np.asarray([len(s) for s in table.column("span").to_pylist()]))
            for c in change.tolist():
                if ends[c - 1] - room >= CHUNK_WORDS * 6:
                    cuts.append(c)
                    room = ends[c - 1]
            if cuts[-1] != change[-1]:
                cuts.append(int(change[-1]))
            for a, b in zip(cuts, cuts[1:]):
                for out in solve(table.slice(a, b - a)):
                    yield from out.combine_chunks().to_batches()
            held = table.slice(int(change[-1])).combine_chunks().to_batches()
            bytes_held = sum(b.nbytes for b in held)
        if held:
            for out in solve(pa.Table.from_batches(held)):
                yield from out.combine_chunks().to_batches()

    return run


def _removed(window: int, texts: bool):
    def run(batches):
        for piece in pieces(batches, "text"):
            words = Words(Texts(piece.column("text")))
            lists = piece.column("runs")
            raw = words.raw.tobytes()
            out = []
            flat = lists.flatten()
            counts = pc.list_value_length(lists).fill_null(0).to_pylist()
            start = flat.field("start").to_numpy() if len(flat) else np.zeros(0, dtype=np.int64)
            size = flat.field("windows").to_numpy() if len(flat) else start
            used = 0
            for i, n in enumerate(counts):
                a, b = words.doc[i], words.doc[i + 1]
                covered = np.zeros(b - a + 1, dtype=np.int64)
                s, z = start[used : used + n], size[used : used + n]
                used += n
                np.add.at(covered, s, 1)
                np.add.at(covered, s + z + window - 1, -1)
                keep = np.flatnonzero(np.cumsum(covered[:-1]) == 0) + a
                kept = b" ".join([raw[x:y] for x, y in zip(words.start[keep].tolist(), words.end[keep].tolist())])
                row = [int(b - a), int(b - a - len(keep)), hashlib.sha256(kept).hexdigest()]
                out.append(row + [kept.decode()] if texts else row)
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.string()] * texts
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * texts
            yield pa.record_batch([piece.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return run


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 35,
    prefix: int = 12,
    group_rows: int = 4096,
    texts: bool = False,
) -> DataFrame:
    """Per document: words, removed words and the SHA-256 of the kept ones (with ``texts``, those too)."""
    if not 0 < prefix <= window:
        raise ValueError("prefix must be between 1 and window")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumn("row", F.xxhash64("doc_id", "text"))
    runs = base.select("row", "text").mapInArrow(_runs(window, prefix), "row long, prefix long, place long, seen long")
    shared = (
        runs.groupBy("prefix")
        .agg(F.sum("seen").alias("seen"), F.count(F.lit(1)).alias("n"))
        .where("seen > 1")
        .select("prefix", F.ceil(F.col("n") / group_rows).alias("parts"))
    )
    hits = runs.select("row", "prefix", "place").join(shared, "prefix")
    # Equal rows list their runs once.
    hits = stored(hits.groupBy("row").agg(F.collect_set(F.struct("prefix", "place", "parts")).alias("runs")), "runs")
    # Both joins below use this exchange of the texts.
    spans = base.join(hits.hint("merge"), "row").select("doc_id", "row", "text", "runs")
    spans = spans.mapInArrow(_spans(window), "doc_id long, row long, prefix long, parts long, first long, span binary")
    spans = spans.withColumn("part", F.pmod(F.xxhash64("row", "first"), "parts"))
    grouped = spans.repartition("prefix", "part").sortWithinPartitions("prefix", "part")
    found = stored(
        grouped.mapInArrow(_subtrees(window), "doc_id long, row long, start long, windows long, high long, low long, open boolean"),
        "windows",
    )
    late = (
        found.where("high is not null")
        .groupBy("high", "low")
        .agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("open"), F.struct("doc_id", "row", "start", "windows"))).alias("w"))
        .where("n > 1")
        .select(F.explode("w").alias("w"))
        .select("w.*")
    )
    repeats = found.where("high is null").select("doc_id", "row", "start", "windows").unionByName(late)
    repeats = repeats.groupBy(F.col("doc_id").alias("id"), F.col("row").alias("key")).agg(F.collect_set(F.struct("start", "windows")).alias("runs"))
    joined = base.join(repeats.hint("merge"), (F.col("row") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    return joined.select("doc_id", "text", "runs").mapInArrow(_removed(window, texts), schema)
