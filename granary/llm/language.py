"""Language identification with error-correcting output codes.

Every language has a codeword of bits. For each bit a linear classifier over hashed byte trigrams, with the
square roots of their frequencies as features, is trained by regularised least squares on a bounded
sample. A text gets the language whose codeword has the smallest logistic loss over all bits, bits weighted
by how well they were learnt. A small lead over the second language marks the text as ambiguous.

A null text, or one without a letter, is ``und`` with score 0; so is every text if there is nothing to
learn from. Rows with null id are predicted, but count neither as held out nor as learning rows. Every row
gives one row. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.samples import fold, sampled_ids
from granary.llm.text import Texts, pieces

HASH_BITS = 13
UNKNOWN = "und"
#: ASCII letters without case are 1 to 26, bytes of other characters 27 and up, all else is a gap.
SYMBOL = np.zeros(256, dtype=np.uint32)
SYMBOL[65:91] = SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 27 + np.arange(128)
SHARPNESS = 2.0


def trigram_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of trigram frequencies, and whether a text has a letter."""
    texts = Texts(column)
    n = len(texts)
    lengths = np.diff(texts.bounds)
    # A gap before and after each text keeps trigrams inside it.
    codes = np.zeros(len(texts.raw) + 2 * n, dtype=np.uint32)
    shift = np.repeat(2 * np.arange(n) + 1, lengths)
    codes[np.arange(len(texts.raw)) + shift] = SYMBOL[texts.raw]
    bounds = texts.bounds + 2 * np.arange(n + 1)
    hashed = (codes[:-2] * np.uint32(155 * 155) + codes[1:-1] * np.uint32(155) + codes[2:] + np.uint32(1)) * np.uint32(2654435761)
    hashed >>= np.uint32(32 - HASH_BITS)
    used = codes[1:-1] > 0
    out = np.zeros((n, 1 << HASH_BITS), dtype=np.float32)
    letters = np.zeros(n, dtype=bool)
    ascii_letter = np.add.accumulate(np.append(0, (codes > 0) & (codes < 27)))
    for i in range(n):
        a, b = bounds[i], bounds[i + 1] - 2
        seen = np.bincount(hashed[a:b][used[a:b]], minlength=1 << HASH_BITS)
        total = seen.sum()
        if total:
            out[i] = np.sqrt(seen / total)
        letters[i] = ascii_letter[b + 2] > ascii_letter[a]
    for i in np.flatnonzero(~letters & (lengths > 0)).tolist():
        letters[i] = any(c.isalpha() for c in column[i].as_py())
    return out, letters


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """Rows of +1 and -1. All splits for a few classes; else the best of some random codes."""
    if classes <= 6:
        columns = [[1] + [1 if split >> c & 1 else -1 for c in range(classes - 1)] for split in range((1 << (classes - 1)) - 1)]
        return np.array(columns, dtype=float).T if columns else np.ones((classes, 1))
    rng = np.random.default_rng(seed)
    bits = int(np.ceil(10 * np.log2(classes)))
    best, least = None, -1
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (classes, bits))
        apart = (bits - code @ code.T) / 2 + np.eye(classes) * bits
        if apart.min() > least:
            best, least = code, apart.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    trust: np.ndarray

    def probabilities(self, features: np.ndarray) -> np.ndarray:
        """Per language, from the weighted loss of its codeword."""
        bits = features @ self.weights + self.offset
        loss = np.stack([np.log1p(np.exp(-SHARPNESS * bits * word)) @ self.trust for word in self.code], axis=1)
        gain = np.exp((loss.min(axis=1, keepdims=True) - loss) * SHARPNESS * len(self.trust) / max(1.0, len(self.languages) - 1))
        return gain / gain.sum(axis=1, keepdims=True)


def train(docs: DataFrame, lang_col: str = "lang", per_language: int = 300, ridge: float = 1e-3) -> LanguageModel | None:
    """Learn from at most ``per_language`` texts of each language (columns doc_id, text and ``lang_col``)."""
    known = docs.select("doc_id", F.col(lang_col).alias("lang"), "text").where("lang is not null and text is not null")
    ids = sampled_ids(known, "lang", per_language)
    if not ids:
        return None

    def features(batches):
        for piece in pieces(batches, "text"):
            x, letters = trigram_features(piece.column("text"))
            x = x[letters]
            where = [np.flatnonzero(r).astype(np.int32) for r in x]
            yield pa.record_batch(
                [
                    piece.column("lang").filter(pa.array(letters)),
                    pa.array(where, pa.list_(pa.int32())),
                    pa.array([r[w] for r, w in zip(x, where)], pa.list_(pa.float32())),
                ],
                names=["lang", "place", "value"],
            )

    rows = known.where(F.col("doc_id").isin(ids)).mapInArrow(features, "lang string, place array<int>, value array<float>")
    rows = rows.orderBy("lang", F.xxhash64("place", "value")).toArrow()
    if not rows.num_rows:
        return None
    names = rows.column("lang").to_pylist()
    languages = tuple(sorted(set(names)))
    # One dense matrix of the sample in single precision is all that the driver holds.
    z = np.zeros((len(names), 1 << HASH_BITS), dtype=np.float32)
    for i, (p, v) in enumerate(zip(rows.column("place"), rows.column("value"))):
        z[i, p.values.to_numpy()] = v.values.to_numpy()
    del rows
    code = codewords(len(languages))
    label = np.array([languages.index(name) for name in names])
    y = code[label]
    # Classes weigh the same, and the problem has as many unknowns as rows.
    weight = (len(label) / (len(languages) * np.bincount(label, minlength=len(languages))))[label]
    middle = (weight.astype(np.float32) @ z) / np.float32(weight.sum())
    target = (weight @ y) / weight.sum()
    z -= middle
    gram = (z @ z.T).astype(np.float64)
    gram[np.diag_indices(len(gram))] += ridge * len(label) / weight
    weights = z.T @ np.linalg.solve(gram, y - target).astype(np.float32)
    offset = target - middle @ weights
    # A bit counts by its accuracy on the learning rows, above chance.
    right = ((np.sign(z @ weights + target) == y) * weight[:, None]).sum(axis=0) / weight.sum()
    trust = np.maximum(right - 0.5, 1e-3)
    return LanguageModel(languages, code, weights, offset, trust / trust.sum())


def predict(
    docs: DataFrame, model: LanguageModel | None, lead: float = 0.2, added: tuple[str, str, str] = ("lang_pred", "score", "ambiguous")
) -> DataFrame:
    """All columns of ``docs`` (text among them), then predicted language, score and ambiguity under the names ``added``."""
    names = list(model.languages) if model else []

    def run(batches):
        for piece in pieces(batches, "text"):
            x, letters = trigram_features(piece.column("text"))
            if model is None:
                letters[:] = False
                chance = np.zeros((len(letters), 2))
            else:
                chance = model.probabilities(x)
            best = chance.argmax(axis=1)
            score = np.where(letters, chance.max(axis=1), 0.0)
            second = np.sort(chance, axis=1)[:, -2] if chance.shape[1] > 1 else np.zeros(len(letters))
            label = [names[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())]
            more = [pa.array(label, pa.string()), pa.array(score, pa.float64()), pa.array(letters & (score - second < lead))]
            yield pa.record_batch([*piece.columns, *more], names=[*piece.schema.names, *added])

    schema = T.StructType(list(docs.schema.fields))
    for name, kind in zip(added, (T.StringType(), T.DoubleType(), T.BooleanType())):
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 300) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous. Only rows of folds 1 to 4 are learnt from."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = train(base.where(fold("doc_id") != 0), "lang", per_language)
    held = F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out")
    return predict(base.select("doc_id", held, "text"), model).drop("text")
