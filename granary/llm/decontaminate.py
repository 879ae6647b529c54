"""Documents that contain a benchmark item, up to a number of edits.

Texts and items are compared in lower case, as UTF-8 bytes, with ASCII punctuation and white space as single spaces. An
item of n bytes may differ by k = n // ``SPACING`` edits. Cut into k + 1 pieces, at least one piece of an
occurrence is untouched (pigeonhole), so exact hits of pieces, found by one automaton for all items, lead to
every occurrence. Around a hit the item is compared with the text by Myers' bit-parallel algorithm, one column per
byte, the occurrence free to start and end anywhere.

Items are split into blocks of bounded size; for ``report`` each block is one pass over the documents with its own
automaton. ``clean`` chains the blocks, one worker each, so a task of it holds the automata of the whole benchmark, and
the items pass through the driver: a benchmark is taken to be small against the documents. Items under ``SPACING``
bytes have no budget and are found exactly, inside words too.

Null and empty texts contain nothing; empty items are contained in nothing. Items with equal text are all
reported. Rows with equal id are separate documents. Other columns are kept by ``clean``.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.text import pieces

SPACING = 16
BLOCK_BYTES = 4 << 20
_FOLD = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def folded(text: str | None) -> bytes:
    return b" ".join(text.lower().encode().translate(_FOLD).split()) if text else b""


def budget(item: bytes) -> int:
    return len(item) // SPACING


def split_item(item: bytes) -> list[tuple[int, bytes]]:
    """(offset, piece): error budget plus one, of nearly equal length."""
    parts = budget(item) + 1
    cuts = [len(item) * i // parts for i in range(parts + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def masks(item: bytes) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def edits(peq: dict[int, int], size: int, text: bytes, limit: int) -> int:
    """Smallest edit distance between the item and any substring of ``text``; above ``limit`` any larger number."""
    whole, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score, least = whole, 0, size, size
    for c in text:
        eq = peq.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (whole & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < least:
                least = score
                if not least:
                    break
        up = up << 1 & whole
        down = down << 1 & whole
        plus = down | (whole & ~(vertical | up))
        minus = up & vertical
    return least


class Matcher:
    """All items of a block."""

    def __init__(self, items: list[tuple[int, str]]):
        import ahocorasick

        self.items = [(i, t) for i, t in ((i, folded(t)) for i, t in items) if t]
        self.masks = [masks(t) for _, t in self.items]
        where: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, text) in enumerate(self.items):
            for offset, part in split_item(text):
                where.setdefault(part, []).append((k, offset))
        self.automaton = ahocorasick.Automaton()
        for part, places in where.items():
            self.automaton.add_word(part.decode("latin-1"), (len(part), places))
        if where:
            self.automaton.make_automaton()

    def found(self, text: str | None) -> dict[int, int]:
        """Item ids and their edits in the text."""
        if not self.items or not text:
            return {}
        data = folded(text)
        tried: set[tuple[int, int]] = set()
        best: dict[int, int] = {}
        for last, (size, places) in self.automaton.iter(data.decode("latin-1")):
            for k, offset in places:
                name, item = self.items[k]
                if best.get(name) == 0:
                    continue
                limit = budget(item)
                start = last - size + 1 - offset
                if (k, start) in tried:
                    continue
                tried.add((k, start))
                if start >= 0 and data.startswith(item, start):
                    best[name] = 0
                    continue
                if limit:
                    near = data[max(0, start - limit) : max(0, start + len(item) + limit)]
                    n = edits(self.masks[k], len(item), near, limit)
                    if n <= limit and n < best.get(name, limit + 1):
                        best[name] = n
        return best


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``BLOCK_BYTES``, one collected at a time by the caller's loop."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    spot = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    return [items.where(spot == b).orderBy("item", "text") for b in range(blocks)]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, edits for every document and item it contains."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = []
    for block in _blocks(benchmark, "item_id", "text"):
        items = [(r.item, r.text) for r in block.collect()]

        def run(batches, items=items):
            matcher = Matcher(items)
            for piece in pieces(batches, "text"):
                rows = [(i, item, n) for i, text in enumerate(piece.column("text").to_pylist()) for item, n in sorted(matcher.found(text).items())]
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch(
                    [piece.column("doc_id").take(at), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int32())],
                    names=["doc_id", "item_id", "edits"],
                )

        out.append(base.mapInArrow(run, f"doc_id {kind}, item_id long, edits int"))
    return reduce(DataFrame.unionByName, out)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document that contains items: doc_id, n_items, item_ids, least edits."""
    found = matches(docs, benchmark)
    return found.groupBy("doc_id").agg(
        F.count_distinct("item_id").alias("n_items"), F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.min("edits").alias("min_edits")
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that contain no item, with all their columns."""
    for block in _blocks(benchmark, "item_id", "text"):
        items = [(r.item, r.text) for r in block.collect()]

        def run(batches, items=items):
            matcher = Matcher(items)
            for piece in pieces(batches, text_col):
                good = np.array([not matcher.found(t) for t in piece.column(text_col).to_pylist()], dtype=bool)
                yield piece.filter(pa.array(good))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
