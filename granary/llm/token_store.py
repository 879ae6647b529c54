"""Token ids in compact shard files with one shared zstandard dictionary.

A shard is one range of ids, in ascending order:

    magic "GTOK0001" | sha256 of the dictionary (32 bytes) | bytes per id (1 byte)
    one zstandard frame per document, compressed alone with the dictionary
    index: one row of four little-endian 64-bit integers per document: id, number of ids, offset, length
    index offset, number of documents, number of ids (64-bit each) | magic

The dictionary is trained on the serialised ids of a bounded sample of documents (``SAMPLE`` smallest hashes of
the id) and kept as one file beside the shards. A short document costs one index look-up and one frame.

Ids come from a byte-level BPE of the tokenizers library. A text is cut before spaces and around newlines
that follow a non-space, where no pre-token can cross; cuts seen before are remembered. Strings of special tokens are
ordinary text. The end id is appended to every document.

Null and empty texts have the end id alone. Rows with equal id stand in the order of their texts; null
ids come first and read back as null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.chunks import ChunkTable, document_ids
from granary.llm.store import shared_path
from granary.llm.text import pieces

MAGIC = b"GTOK0001"
SAMPLE = 1000
DICTIONARY_BYTES = 64 << 10
NO_ID = -(1 << 63)
#: Where one of these occurs, white space stands beside white space and the text is cut by the pattern instead.
_DOUBTFUL = ("\0", "  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
_WIDE_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_CUT = re.compile(r"(?<=\S)(?=[ \n])|(?<=\S\n)(?=\S)")
#: A word of Latin letters with the marks that follow it; an apostrophe could begin a contraction.
_WORD = re.compile("([\\n\0]?)([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
_PLAIN = "\0"


def cut(text: str) -> list[str]:
    """Chunks whose ids, one after another, are the ids of the text.

    A chunk that begins with a newline stands for itself, one that begins with ``_PLAIN`` for the rest of it,
    any other for itself after a space.
    """
    if any(x in text for x in _DOUBTFUL) or not text.isascii() and _WIDE_SPACE.search(text):
        return [_PLAIN + c for c in _CUT.split(text) if c]
    return (_PLAIN + text.replace("\n", " \n")).split(" ")


def literal(chunk: str) -> str:
    if chunk.startswith(_PLAIN):
        return chunk[1:]
    return chunk if chunk.startswith("\n") else " " + chunk


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {**{b: chr(b) for b in plain}, **{b: chr(256 + i) for i, b in enumerate(rest)}}


class Encoder:
    """Ids of chunks by the tokenizers library: plain words go to its model at once, the rest through the whole chain."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        #: Strings that the library gives an id of their own; a text with one of them is not cut into chunks.
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.symbols = byte_symbols()
        self.space = self.symbols[32]
        self.marks: dict[str, list[int]] = {"": []}
        self.begin = {"": self.space, "\n": "", _PLAIN: ""}
        self.table = ChunkTable(self.encode, limit=1_200_000)

    def _model_ids(self, shown: str) -> list[int]:
        """Ids of one pre-token, given in the symbols of the vocabulary."""
        return [t.id for t in self.model.tokenize(shown)]

    def _shown(self, part: str) -> str:
        return part if part.isascii() else part.encode().decode("latin-1").translate(self.symbols)

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found: list[list[int]] = [[]] * len(chunks)
        others = []
        line = self._model_ids(self.symbols[10])
        for i, c in enumerate(chunks):
            word = _WORD.fullmatch(c)
            if word is None:
                others.append(i)
                continue
            first, letters, marks = word.groups()
            ids = [t.id for t in self.model.tokenize(self.begin[first] + self._shown(letters))]
            if marks:
                if marks not in self.marks:
                    if len(self.marks) > 10_000:
                        self.marks = {}
                    self.marks[marks] = self._model_ids(marks)
                ids += self.marks[marks]
            found[i] = line + ids if first == "\n" else ids
        for i, e in zip(others, self.tokenizer.encode_batch([literal(chunks[i]) for i in others], add_special_tokens=False)):
            found[i] = e.ids
        size = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
        return size, np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(size.sum()))

    def documents(self, texts: list[str | None], end_id: int) -> list[np.ndarray]:
        whole = {i: t for i, t in enumerate(texts) if t and any(s in t for s in self.special)}
        ids, counts = document_ids(self.table, [None if i in whole else t for i, t in enumerate(texts)], cut)
        bounds = np.append(0, np.cumsum(counts)).tolist()
        end = np.array([end_id], dtype=np.int32)
        out = [np.concatenate([ids[a:b], end]) for a, b in zip(bounds, bounds[1:])]
        for i, text in whole.items():
            own = self.plain.encode(text, add_special_tokens=False).ids
            out[i] = np.concatenate([np.array(own, dtype=np.int32), end])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _files(folder: str):
    """The file system and plain path of a folder that Spark names by URI."""
    from pyarrow import fs

    uri = re.sub(r"^file:/+", "file:///", folder)
    return fs.FileSystem.from_uri(uri if ":" in uri else "file://" + os.path.abspath(uri))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples themselves."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _codec(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    options = {"dict_data": shared} if shared else {}
    return zstandard.ZstdCompressor(level=3, **options), zstandard.ZstdDecompressor(**options)


def _writer(folder: str, path: str, dictionary: bytes, width: int, end_id: int):
    kind = "<u2" if width == 2 else "<u4"

    def run(batches):
        files, place = _files(folder)
        shard = TaskContext.get().partitionId()
        press, _ = _codec(dictionary)
        # A repeated attempt writes anew; the name it ends with is the one that its row reports.
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.tok"
        index, at, tokens = [], len(MAGIC) + 33, 0
        out = None
        try:
            for piece in pieces(batches, "text"):
                if out is None:
                    out = files.open_output_stream(f"{place}/{name}")
                    out.write(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))
                docs = encoder(path).documents(piece.column("text").to_pylist(), end_id)
                for doc, ids in zip(piece.column("doc_id").to_pylist(), docs):
                    frame = press.compress(ids.astype(kind).tobytes())
                    out.write(frame)
                    index.append((NO_ID if doc is None else doc, len(ids), at, len(frame)))
                    at += len(frame)
                    tokens += len(ids)
            if out is None:
                return
            out.write(np.array(index, dtype="<i8").tobytes())
            out.write(np.array([at, len(index), tokens], dtype="<i8").tobytes() + MAGIC)
        finally:
            if out is not None:
                out.close()
        yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([tokens], pa.int64())], names=["shard", "name", "docs", "tokens"])

    return run


def write(docs: DataFrame, path: str, folder: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"):
    """Write the shards; returns the folder and the shard rows (shard, name, docs, tokens) in id order, one per task."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = base.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = [r.doc_id for r in order.limit(SAMPLE).collect()]
    own = encoder(path)
    width = 2 if max(own.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4

    def serialise(batches):
        for piece in pieces(batches, "text"):
            ids = encoder(path).documents(piece.column("text").to_pylist(), end_id)
            yield pa.record_batch([pa.array([i.astype("<u2" if width == 2 else "<u4").tobytes() for i in ids], pa.binary())], names=["ids"])

    rows = base.where(F.col("doc_id").isin(chosen)).select("text").mapInArrow(serialise, "ids binary").collect()
    dictionary = _dictionary(sorted(bytes(r.ids) for r in rows))
    files, place = _files(folder)
    files.create_dir(place, recursive=True)
    with files.open_output_stream(f"{place}/dictionary-{hashlib.sha256(dictionary).hexdigest()}.zdict") as out:
        out.write(dictionary)
    ranged = base.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    shards = ranged.mapInArrow(_writer(folder, path, dictionary, width, end_id), "shard long, name string, docs long, tokens long")
    return folder, sorted(shards.collect(), key=lambda r: r.shard)


class Shard:
    """Reads one shard file; ``get`` finds single documents without reading the others."""

    def __init__(self, folder: str, name: str):
        files, place = _files(folder)
        self.file = files.open_input_file(f"{place}/{name}")
        size = self.file.size()
        if self.file.read_at(8, 0) != MAGIC or self.file.read_at(8, size - 8) != MAGIC:
            raise ValueError(f"{name} is no whole shard")
        self.hash = self.file.read_at(32, 8)
        self.kind = "<u2" if self.file.read_at(1, 40)[0] == 2 else "<u4"
        at, docs, self.tokens = np.frombuffer(self.file.read_at(24, size - 32), dtype="<i8").tolist()
        self.index = np.frombuffer(self.file.read_at(docs * 32, at), dtype="<i8").reshape(docs, 4)
        with files.open_input_stream(f"{place}/dictionary-{self.hash.hex()}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != self.hash:
            raise ValueError("the dictionary is not the one of the shard")
        _, self.press = _codec(dictionary)

    def ids(self, frame: bytes) -> np.ndarray:
        return np.frombuffer(self.press.decompress(frame), dtype=self.kind).astype("<u4")

    def documents(self, block: int = 1 << 22):
        """(id, ids) of all documents in order, reading a few megabytes at a time."""
        at, data = 0, b""
        for doc, _, offset, length in self.index.tolist():
            if offset + length > at + len(data):
                at, data = offset, self.file.read_at(max(block, length), offset)
            yield doc, self.ids(data[offset - at : offset - at + length])

    def get(self, doc: int) -> list[np.ndarray]:
        """Ids of the documents with this id."""
        a, b = np.searchsorted(self.index[:, 0], [doc, doc + 1])
        return [self.ids(self.file.read_at(length, offset)) for _, _, offset, length in self.index[a:b].tolist()]


def read(spark: SparkSession, folder: str, shards) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    base = np.append(0, np.cumsum([r.tokens for r in shards])).tolist()
    listed = [(r.name, b) for r, b in zip(shards, base)]
    names = spark.createDataFrame(listed, "name string, base long").repartition(max(1, len(listed)), "name")

    def run(batches):
        for batch in batches:
            for name, start in zip(batch.column("name").to_pylist(), batch.column("base").to_pylist()):
                shard = Shard(folder, name)
                rows = []
                for doc, ids in shard.documents():
                    rows.append((None if doc == NO_ID else doc, start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                columns = list(zip(*rows))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return names.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
