"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

The normaliser that a model file may name is not applied; texts are taken as they are. The text is marked by one space in front, and spaces are the whitespace marker of the pieces. Among all ways
to cut it into pieces the one with the largest sum of scores is taken; among equal ones, at each end the
one whose last piece is longest. A character that is no piece itself may be cut off alone, at the smallest
score less ten; it becomes its UTF-8 bytes. Decoding joins pieces and bytes, turns markers into spaces and drops the
first one, so every text comes back exactly, a literal marker character included (it goes as bytes).

No piece goes on past the start of a word (checked when a model is loaded), so words are cut one by one and
remembered. All new words of a batch are walked and solved together, step by step.

Null texts have no ids and decode to null in ``tokenised``, the empty text to itself.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.chunks import ChunkTable, document_ids
from granary.llm.text import Texts, pieces, ranges

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Known words that a task remembers.
WORDS = 300_000


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value arrays: the child of s by byte c is t = base[s] + c + 1 if check[t] = s.

    ``value`` is the index of the key that ends in a state, or -1.
    """
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    ordered = [keys[i] for i in order]
    base: list[int] = [-1]
    check: list[int] = [0]
    value: list[int] = [-1]
    free, misses = 1, 0
    waiting = [(0, 0, len(ordered), 0)]
    while waiting:
        state, a, b, depth = waiting.pop()
        if a < b and len(ordered[a]) == depth:
            value[state] = order[a]
            a += 1
        if a == b:
            continue
        heads = [i for i in range(a, b) if i == a or ordered[i][depth] != ordered[i - 1][depth]]
        labels = [ordered[i][depth] for i in heads]
        at = free
        while True:
            if at + 600 > len(check):
                for column in (base, check, value):
                    column.extend([-1] * (1 << 14))
            start = at - labels[0] - 1
            if check[at] < 0 and start >= 0 and all(check[start + c + 1] < 0 for c in labels):
                break
            at += 1
            misses += 1
            if misses > 2000:  # leave gaps behind rather than search them again and again
                free, misses = at, 0
        base[state] = start
        for c, i, j in zip(labels, heads, [*heads[1:], b]):
            check[start + c + 1] = state
            waiting.append((start + c + 1, i, j, depth + 1))
    last = max(i for i, c in enumerate(check) if c >= 0) + 258
    for column in (base, check, value):
        column.extend([-1] * last)
    return tuple(np.array(column[:last], dtype=np.int64) for column in (base, check, value))


@dataclass
class PieceModel:
    pieces: list[bytes]  # marker as a space; bytes and unusable ids are empty
    scores: np.ndarray
    byte_ids: np.ndarray
    split: re.Pattern = field(repr=False)
    base: np.ndarray = field(repr=False)
    check: np.ndarray = field(repr=False)
    value: np.ndarray = field(repr=False)
    text: np.ndarray = field(repr=False)
    text_start: np.ndarray = field(repr=False)
    text_size: np.ndarray = field(repr=False)

    @classmethod
    def build(cls, pieces: list[bytes], scores: list[float], byte_ids: list[int]) -> PieceModel:
        usable = [i for i, p in enumerate(pieces) if p]
        if any(re.search(rb"[^ ] ", pieces[i]) for i in usable):
            raise ValueError("a piece goes on past the start of a word")
        lines = not any(b"\n" in pieces[i] and len(pieces[i]) > 1 for i in usable)
        base, check, value = double_array([pieces[i] for i in usable])
        ids = np.append(np.array(usable, dtype=np.int64), -1)
        shown = list(pieces)
        for b, i in enumerate(byte_ids):
            shown[i] = bytes([b])
        size = np.array([len(p) for p in shown], dtype=np.int64)
        text = np.frombuffer(b"".join(shown), dtype=np.uint8)
        pattern = r" *[^ \n]+|\n| +" if lines else r" *[^ ]+| +"
        return cls(
            pieces, np.array(scores, dtype=np.float64), np.array(byte_ids, dtype=np.int64), re.compile(pattern),
            base, check, ids[value], text, np.cumsum(size) - size, size,
        )

    @classmethod
    def load(cls, path: str) -> PieceModel:
        """From a model file with byte fallback. Its scores are taken as log scores whatever they were trained for."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces, scores, bytes_at = [], [], {}
        for i in range(model.get_piece_size()):
            name = model.id_to_piece(i)
            scores.append(model.get_score(i))
            if model.is_byte(i):
                bytes_at[int(name[3:5], 16)] = i
            skip = model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            pieces.append(b"" if skip else name.replace(MARKER, " ").encode())
        if len(bytes_at) < 256:
            raise ValueError("the model has no byte fallback")
        return cls.build(pieces, scores, [bytes_at[b] for b in range(256)])

    def chunks(self, text: str) -> list[str]:
        return self.split.findall(" " + text)

    def solve(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids and ids of each chunk: the best cut by dynamic programming over all chunks at once."""
        data = [c.encode() for c in chunks]
        size = np.array([len(d) for d in data], dtype=np.int64)
        raw = np.frombuffer(b"".join(data), dtype=np.uint8)
        begin = np.cumsum(size) - size
        owner_end = np.repeat(begin + size, size)
        chars = np.flatnonzero((raw & 0xC0) != 0x80)
        char_end = np.append(chars[1:], len(raw))
        # Walk the trie from every character at once.
        starts, ends, names = [], [], []
        at, state, depth = chars, np.zeros(len(chars), dtype=np.int64), 0
        while len(at):
            inside = at + depth < owner_end[at]
            at, state = at[inside], state[inside]
            branch = self.base[state]
            step = branch + raw[at + depth] + 1
            fits = (branch >= 0) & (self.check[np.minimum(step, len(self.check) - 1)] == state)
            at, state = at[fits], step[fits]
            depth += 1
            found = self.value[state] >= 0
            starts.append(at[found])
            ends.append(at[found] + depth)
            names.append(self.value[state[found]])
        start, end, name = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (starts, ends, names))
        # A character without a piece of its own may stand alone.
        single = np.zeros(len(raw) + 1, dtype=np.int64)
        single[chars] = char_end
        alone = np.zeros(len(raw) + 1, dtype=bool)
        alone[start[single[start] == end]] = True
        lost = chars[~alone[chars]]
        start = np.concatenate([start, lost])
        end = np.concatenate([end, single[lost]])
        name = np.concatenate([name, np.full(len(lost), -1, dtype=np.int64)])
        low = self.scores.min() - UNKNOWN_PENALTY
        gain = np.where(name >= 0, self.scores[name], low)
        # Ends in order of their distance from the start of the chunk; the longest piece first.
        first = np.repeat(begin, size)
        reach = end - first[start]
        order = np.lexsort((start, end, reach))
        start, end, name, gain, reach = (x[order] for x in (start, end, name, gain, reach))
        best = np.full(len(raw) + 1, -np.inf)
        best_at_start = np.zeros(len(raw) + 1, dtype=bool)
        best_at_start[begin] = True
        via = np.full(len(raw) + 1, -1, dtype=np.int64)
        cuts = np.append(np.flatnonzero(np.append(True, reach[1:] != reach[:-1])), len(reach)) if len(reach) else np.zeros(1, dtype=np.int64)
        for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
            s, e = start[a:b], end[a:b]
            sums = np.where(best_at_start[s], 0.0, best[s]) + gain[a:b]
            heads = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            top = np.maximum.reduceat(sums, heads)
            width = np.diff(np.append(heads, b - a))
            where = np.where(sums == np.repeat(top, width), np.arange(a, b), b)
            # The start of the next chunk is the end of this one: ends are kept apart from starts.
            best[e[heads]], via[e[heads]] = top, np.minimum.reduceat(where, heads)
        taken, here = [], (begin + size)[size > 0]
        while len(here):
            edge = via[here]
            taken.append(edge)
            here = start[edge]
            here = here[~best_at_start[here]]
        edge = np.concatenate(taken) if taken else np.zeros(0, dtype=np.int64)
        edge = edge[np.argsort(end[edge], kind="stable")]
        plain = name[edge] >= 0
        long = np.where(plain, 1, end[edge] - start[edge])
        out = np.repeat(name[edge], long)
        out[np.repeat(~plain, long)] = self.byte_ids[raw[ranges(start[edge][~plain], long[~plain])]]
        owner = np.searchsorted(begin + size, end[edge], side="left")
        return np.bincount(owner, weights=long, minlength=len(chunks)).astype(np.int64), out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The text of each run of ids; the space put in front is dropped."""
        size = self.text_size[ids]
        raw = self.text[ranges(self.text_start[ids], size)].tobytes()
        total = np.append(0, np.cumsum(size))
        bounds = total[np.append(0, np.cumsum(counts))].tolist()
        return [raw[a + 1 : b] if raw[a : a + 1] == b" " else raw[a:b] for a, b in zip(bounds, bounds[1:])]


def encode(model: PieceModel, texts: list[str], table: ChunkTable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has. ``table`` holds the words of earlier calls."""
    return document_ids(table or ChunkTable(model.solve, WORDS), texts, model.chunks)


def tokenised(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text decoded from its ids, with ids, n_tokens and round_trip."""
    model = PieceModel.load(path)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a vocabulary: its size does not grow with the input
    rest = [c for c in docs.columns if c not in (text_col, "ids", "n_tokens", "round_trip")]

    def run(batches):
        own = shared.value
        table = ChunkTable(own.solve, WORDS)
        for piece in pieces(batches, text_col):
            texts = piece.column(text_col).to_pylist()
            ids, counts = encode(own, texts, table)
            decoded = own.decode(ids, counts)
            same = [t is None or t.encode() == d for t, d in zip(texts, decoded)]
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
            back = pa.array([None if t is None else d.decode() for t, d in zip(texts, decoded)], pa.string())
            yield pa.record_batch(
                [*(piece.column(c) for c in rest), back, lists, pa.array(counts, pa.int64()), pa.array(same)],
                names=[*rest, text_col, "ids", "n_tokens", "round_trip"],
            )

    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest]
    schema = ", ".join([*fields, f"`{text_col}` string", "ids array<int>", "n_tokens long", "round_trip boolean"])
    return docs.select(*rest, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, schema)


def digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32 (little-endian 32-bit ids), round_trip (the decoded text is the text)."""
    model = PieceModel.load(path)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches):
        own = shared.value
        is_byte = np.zeros(len(own.pieces), dtype=np.int64)
        is_byte[own.byte_ids] = 1
        table = ChunkTable(own.solve, WORDS)
        for piece in pieces(batches, "text"):
            texts = piece.column("text").to_pylist()
            ids, counts = encode(own, texts, table)
            bounds = np.append(0, np.cumsum(counts))
            source = Texts(piece.column("text"))
            raw, limits = source.raw.tobytes(), source.bounds.tolist()
            same = [raw[a:b] == d for a, b, d in zip(limits, limits[1:], own.decode(ids, counts))]
            fallback = np.append(0, np.cumsum(is_byte[ids]))[bounds]
            wide = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.record_batch(
                [piece.column("doc_id"), pa.array(counts, pa.int64()), pa.array(np.diff(fallback), pa.int64()), pa.array(crc, pa.int64()), pa.array(same)],
                names=["doc_id", "n_tokens", "n_byte_tokens", "ids_crc32", "round_trip"],
            )

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_byte_tokens long, ids_crc32 long, round_trip boolean")
