"""Document quality by pairwise ranking (Bradley-Terry).

A document's worth is a linear function of style measures: shares of character classes, word and line
shapes, repetition. It is learnt from preference pairs, a labelled good document against a labelled bad one,
by logistic loss on the difference of their features. All learning rows take part: they are dealt into small blocks,
several times over, and every good row of a block is paired with every bad one; rows of the rarer label go to as many
blocks as it takes for each block to have some. Moments, bins and the threshold are exact over all learning rows. The
threshold is a quantile of the worths: as many learning rows lie below it as are labelled bad. The score maps worth to
0..1 so that the threshold falls on ``cut``.

Empty and null texts are scored like any other. Every row gives one row; labels with null id, null quality
or without a document are ignored; with several labels for an id the smallest counts. Without two classes to
compare every score is 0.5. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.order_stats import quantiles
from granary.llm.samples import fold
from granary.llm.store import Scratch, stored
from granary.llm.text import Texts, Words, pieces

BINS = 8
#: Rows of a block of pairs, how often every row is dealt, and rows of the rarer label for each block.
BLOCK, DEALS, RARE = 32, 4, 4
#: The prior weighs as much as against this many pairs, whatever the number of rows.
PAIRS = 40_000
#: Blocks whose features are in memory at once.
AT_ONCE = 256
_CLASSES = {
    "upper": bytes(range(65, 91)),
    "lower": bytes(range(97, 123)),
    "digit": b"0123456789",
    "blank": b" \t",
    "line": b"\n\r",
    "stop": b".",
    "comma": b",;:",
    "shout": b"!?",
    "bar": b"|",
    "mark": b"#$%&*@^~_=+<>/\\{}[]",
    "quote": b"\"'()-",
    "wide": bytes(range(128, 256)),
}
_MEMBER = np.zeros((256, len(_CLASSES)), dtype=np.uint8)
for _k, _chars in enumerate(_CLASSES.values()):
    _MEMBER[list(_chars), _k] = 1


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values, dtype=np.float64))
    return total[bounds[1:]] - total[bounds[:-1]]


def measures(column: pa.Array) -> np.ndarray:
    """One row of style measures for each text."""
    texts = Texts(column)
    raw, n = texts.raw, len(texts)
    size = np.diff(texts.bounds)
    some = np.maximum(size, 1)
    shares = [_sums(_MEMBER[raw, k], texts.bounds) / some for k in range(len(_CLASSES))]
    words = Words(texts)
    count = words.counts()
    many = np.maximum(count, 1)
    length = (words.end - words.start).astype(np.float64)
    mean = _sums(length, words.doc) / many
    spread = np.sqrt(np.maximum(_sums(length**2, words.doc) / many - mean**2, 0))
    upper = np.append(0, np.cumsum(_MEMBER[raw, 0], dtype=np.int64))
    lower = np.append(0, np.cumsum(_MEMBER[raw, 1], dtype=np.int64))
    ups, lows = upper[words.end] - upper[words.start], lower[words.end] - lower[words.start]
    mark = list(_CLASSES).index("mark")
    if len(words.start):
        capital = _MEMBER[raw[words.start], 0] > 0
        ends = _MEMBER[raw[words.end - 1], mark] > 0
    else:
        capital = ends = np.zeros(0, dtype=bool)
    hashes = words.hashes()
    distinct, top = np.zeros(n), np.zeros(n)
    neighbours = np.zeros(len(hashes))
    neighbours[1:] = hashes[1:] == hashes[:-1]
    lines, line_words, fresh = np.ones(n), np.zeros(n), np.ones(n)
    bounds = words.doc.tolist()
    joined = raw.tobytes()
    limits = texts.bounds.tolist()
    for i in range(n):
        own = np.sort(hashes[bounds[i] : bounds[i + 1]])
        if len(own):
            head = np.append(np.flatnonzero(np.append(True, own[1:] != own[:-1])), len(own))
            distinct[i] = (len(head) - 1) / len(own)
            top[i] = np.diff(head).max() / len(own)
        rows = joined[limits[i] : limits[i + 1]].split(b"\n")
        lines[i], fresh[i] = len(rows), len(set(rows)) / len(rows)
    return np.stack(
        [
            *shares, np.log1p(size), np.log1p(count), mean, spread,
            _sums(length > 12, words.doc) / many, _sums(length <= 3, words.doc) / many, distinct, top,
            _sums(capital, words.doc) / many, _sums((ups > 1) & (lows == 0), words.doc) / many, _sums(ends, words.doc) / many,
            np.log1p(lines), np.log1p(size / lines), fresh, _sums(neighbours, words.doc) / many,
        ],
        axis=1,
    )


@dataclass(frozen=True)
class QualityModel:
    middle: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    weights: np.ndarray
    threshold: float
    cut: float

    def features(self, x: np.ndarray) -> np.ndarray:
        """The measures, and in which of their quantile bins they fall."""
        linear = np.clip((x - self.middle) / self.scale, -5, 5)
        steps = (x[:, :, None] > self.edges[None]).reshape(len(x), -1)
        return np.concatenate([linear, steps], axis=1)

    def worths(self, x: np.ndarray) -> np.ndarray:
        """Rounded, so that the order of sums does not move a row over the threshold."""
        return np.round(self.features(x) @ self.weights, 9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        worth = self.worths(x) - self.threshold + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(worth, -40, 40)))


def _pair_sums(f: np.ndarray, good: np.ndarray, n: np.ndarray, bounds: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope, curvature and number of the pairs inside blocks of rows, in one vector; ``n``: how often a row counts."""
    worth = f @ w
    pull, weight, crossed = np.zeros(len(f)), np.zeros(len(f)), np.zeros_like(f)
    pairs = 0.0
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        best, worst = a + np.flatnonzero(good[a:b]), a + np.flatnonzero(~good[a:b])
        if not len(best) or not len(worst):
            continue
        p = 1 / (1 + np.exp(-np.clip(worth[best][:, None] - worth[worst][None], -40, 40)))
        count = n[best][:, None] * n[worst][None]
        pairs += count.sum()
        open_, curve = count * (1 - p), count * p * (1 - p)
        pull[best], pull[worst] = open_.sum(axis=1), -open_.sum(axis=0)
        weight[best], weight[worst] = curve.sum(axis=1), curve.sum(axis=0)
        crossed[best] = curve @ f[worst]
    both = f.T @ crossed
    return np.concatenate([f.T @ pull, ((f * weight[:, None]).T @ f - both - both.T).ravel(), [pairs]])


def _newton(width: int, sums: Callable[[np.ndarray], np.ndarray], ridge: float) -> np.ndarray | None:
    """Bradley-Terry weights by Newton's method; None without a pair."""
    w = np.zeros(width)
    for _ in range(12):
        found = sums(w)
        if not found[-1]:
            return None
        part = PAIRS / found[-1]
        slope = part * found[:width] - ridge * w
        step = np.linalg.solve(part * found[width:-1].reshape(width, width) + ridge * np.eye(width), slope)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return np.round(w, 9)


def _model(middle: np.ndarray, scale: np.ndarray, edges: np.ndarray, cut: float) -> QualityModel:
    return QualityModel(middle, np.where(scale > 1e-9, scale, 1.0), edges, np.zeros(len(middle) * BINS), 0.0, cut)


def fit(x: np.ndarray, good: np.ndarray, ridge: float = 3.0, cut: float = 0.3, seed: int = 11) -> QualityModel | None:
    """The model of rows in memory, from all of them."""
    if good.all() or not good.any():
        return None
    model = _model(x.mean(axis=0), x.std(axis=0), np.quantile(x, np.arange(1, BINS) / BINS, axis=0).T, cut)
    rng = np.random.default_rng(seed)
    blocks = -(-len(x) // BLOCK)
    rare = good.sum() * 2 < len(x)
    times = np.where(good == rare, max(1, -(-RARE * blocks // min(good.sum(), (~good).sum()))), 1)
    dealt = np.repeat(np.tile(np.arange(len(x)), DEALS), np.tile(times, DEALS))
    spot = np.repeat(np.arange(DEALS), times.sum()) * blocks + rng.integers(blocks, size=len(dealt))
    order = np.argsort(spot, kind="stable")
    rows, bounds = dealt[order], np.searchsorted(spot[order], np.arange(DEALS * blocks + 1))
    f = model.features(x)[rows]
    w = _newton(f.shape[1], lambda w: _pair_sums(f, good[rows], np.ones(len(rows)), bounds, w), ridge)
    if w is None:
        return None
    model = replace(model, weights=w)
    return replace(model, threshold=float(np.quantile(model.worths(x), (~good).mean())))


def _blocks(learnt: DataFrame, rare: int, sizes: dict[int, int]) -> DataFrame:
    """One row for each block of pairs: array of (quality, n, x). Rows with equal measures are one that counts n times."""
    blocks = -(-sum(sizes.values()) // BLOCK)
    times = max(1, -(-RARE * blocks // sizes[rare]))
    last = F.when(F.col("quality") == rare, times - 1).otherwise(0)
    dealt = learnt.select("*", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))).alias("deal"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), last)).alias("copy"))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("x", "deal", "copy"), F.lit(blocks)))
    return dealt.groupBy("deal", "block").agg(F.sort_array(F.collect_list(F.struct("quality", "n", "x"))).alias("rows")).select("rows")


def _summed(blocks: DataFrame, model: QualityModel, w: np.ndarray) -> np.ndarray:
    """``_pair_sums`` of all blocks: one partial sum a task, added up by position."""
    measured, width = len(model.middle), len(w)

    def run(batches):
        total = np.zeros(width + width * width + 1)
        for batch in batches:
            for at in range(0, batch.num_rows, AT_ONCE):
                lists = batch.column("rows").slice(at, AT_ONCE)
                bounds = np.append(0, np.cumsum(lists.value_lengths().to_numpy()))
                quality, n, x = lists.flatten().flatten()
                f = model.features(x.flatten().to_numpy().reshape(-1, measured))
                total += _pair_sums(f, quality.to_numpy() == 1, n.to_numpy().astype(float), bounds, w)
        if total[-1]:
            yield pa.record_batch([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["place", "value"])

    found = blocks.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width + width * width + 1)
    out[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return out


def measured(rows: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` and x, the style measures of the column text."""

    def run(batches):
        for piece in pieces(batches, "text"):
            x = measures(piece.column("text"))
            bounds = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.record_batch([*[piece.column(c) for c in kept], pa.ListArray.from_arrays(bounds, x.ravel())], names=[*kept, "x"])

    fields = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in kept)
    return rows.select(*kept, "text").mapInArrow(run, f"{fields}x array<double>")


def _vectors(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def train(rows: DataFrame, cut: float = 0.3, ridge: float = 3.0) -> QualityModel | None:
    """Learn from all rows (columns text, quality)."""
    return learn(measured(rows.withColumn("quality", F.col("quality").cast("int")), "quality"), cut, ridge)


def learn(rows: DataFrame, cut: float = 0.3, ridge: float = 3.0) -> QualityModel | None:
    """Learn from all rows (columns quality, x: see ``measured``)."""
    scratch = Scratch(rows.sparkSession)
    table = scratch.stored(rows.select("quality", "x"), "measures")
    totals = {r.quality: r.n for r in table.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(totals) < 2:
        scratch.drop()
        return None
    names = [f"m{i}" for i in range(len(table.select("x").first().x))]
    wide = table.select(F.lit("all").alias("scope"), *[F.col("x")[i].alias(c) for i, c in enumerate(names)])
    moments = wide.agg(*[f(c) for f in (F.avg, F.stddev_pop) for c in names]).first()
    bins = quantiles(wide, ["scope"], names, {f"q{k}": k / BINS for k in range(1, BINS)}).first()
    edges = np.array([[bins[f"{c}_q{k}"] for k in range(1, BINS)] for c in names])
    model = _model(np.array(moments[: len(names)]), np.array(moments[len(names) :]), edges, cut)
    learnt = table.groupBy("quality", "x").agg(F.count(F.lit(1)).alias("n"))
    sizes = {r.quality: r.n for r in learnt.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = scratch.stored(_blocks(learnt, min(sizes, key=lambda k: (sizes[k], k)), sizes), "blocks")
    w = _newton(len(model.weights), lambda w: _summed(blocks, model, w), ridge)
    if w is not None:
        model = replace(model, weights=w)

        def judged(batches):
            for batch in batches:
                if batch.num_rows:
                    yield pa.record_batch([pa.array(["all"] * batch.num_rows), pa.array(model.worths(_vectors(batch)))], names=["scope", "worth"])

        worths = table.select("x").mapInArrow(judged, "scope string, worth double")
        at = quantiles(worths, ["scope"], ["worth"], {"at": totals[0] / sum(totals.values())}).first()
        model = replace(model, threshold=at.worth_at)
    scratch.drop()
    return model if w is not None else None


def score(docs: DataFrame, model: QualityModel | None) -> DataFrame:
    """doc_id, held_out, score, predicted for rows with columns doc_id, held_out and text."""
    return scored(measured(docs, "doc_id", "held_out"), model)


def scored(rows: DataFrame, model: QualityModel | None) -> DataFrame:
    """``score`` of rows with columns doc_id, held_out and x."""
    cut = model.cut if model else 0.3

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                s = model.scores(_vectors(batch)) if model else np.full(batch.num_rows, 0.5)
                yield pa.record_batch(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= cut).astype(np.int32))],
                    names=["doc_id", "held_out", "score", "predicted"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.select("doc_id", "held_out", "x").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every document; only labels of folds 1 to 4 are learnt from.

    Every text is measured once, where it lies: only the measures are stored and joined with the labels.
    """
    held = F.coalesce(fold(id_col) == 0, F.lit(False)).alias("held_out")
    base = docs.select(F.col(id_col).alias("doc_id"), held, F.col(text_col).alias("text"))
    table = stored(measured(base, "doc_id", "held_out"), "measures")
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where((fold("doc_id") != 0) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    return scored(table, learn(table.join(marks, "doc_id")))
