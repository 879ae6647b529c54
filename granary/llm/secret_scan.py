"""Secrets in texts: three patterns, and random strings by the token-efficiency test.

*Patterns* (kinds ``assign``, ``access``, ``hex``), leftmost and non-overlapping for each kind; a match that is too
short is dropped and not searched again. A span is the whole match.

*Token efficiency* (kind ``random``): a byte-pair vocabulary has learnt what people write, so ordinary words and
names need one token for several characters and random strings one for hardly two. Runs of at least ``LEAST``
characters of the alphabet of keys are judged by their characters per token under a tiktoken vocabulary; at most
``RATIO`` exposes them. Left out before: runs that touch a span of a pattern (already found), known digests (hexadecimal
of a usual digest length, subresource integrity values), UUIDs, numbers, and identifiers, that is names, paths and
hosts made of words. A run over ``CHUNK`` characters is counted in pieces of that many.

Positions are code points, end exclusive. Null and empty texts have no spans; rows with equal id are separate;
other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.text import pieces

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: In these two a shorter run holds no longer match, so the length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12

LEAST = 20
RATIO = 2.2
CHUNK = 512
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST)
#: Hexadecimal digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
DIGESTS = {32, 40, 56, 64, 96, 128}
HEXADECIMAL = re.compile(r"[0-9A-Fa-f]+")
INTEGRITY = re.compile(r"sha(?:256|384|512)[-=][A-Za-z0-9+/]{43,86}={0,2}")
UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words of two letters or more and short numbers, with or without marks between them. Possessive, so it cannot backtrack.
IDENTIFIER = re.compile(r"(?:[+/_.=-]*+(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+[a-z]*+|[0-9]{1,8}+(?![0-9])))++[+/_.=-]*+")
NUMBER = re.compile(r"[0-9.+/_=-]+")


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    """The vocabulary of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """A digest, an identifier or a number."""
    if HEXADECIMAL.fullmatch(run) and len(run) in DIGESTS:
        return True
    return any(p.fullmatch(run) for p in (UUID, INTEGRITY, NUMBER, IDENTIFIER))


def ratio(run: str, vocabulary) -> float:
    """Characters per token."""
    return len(run) / sum(len(vocabulary.encode_ordinary(run[i : i + CHUNK])) for i in range(0, len(run), CHUNK))


def spans(text: str, vocabulary) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans, by start and kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    out += [(*m.span()[:1], 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(*m.span()[:1], 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    taken, at = _united(out), 0
    added = []
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if at < len(taken) and taken[at][0] < end:
            continue
        # Marks at the ends belong to the sentence.
        run = m.group().rstrip("./=-").lstrip("./=-") if not m.group().endswith("=") else m.group().lstrip("./=-")
        if len(run) >= LEAST and not known(run) and ratio(run, vocabulary) <= RATIO:
            begin = start + m.group().index(run)
            added.append((begin, 3, begin + len(run)))
    return sorted(out + added) if added else out


def _united(found: list[tuple[int, int, int]]) -> list[list[int]]:
    """Disjoint intervals that cover the spans."""
    out: list[list[int]] = []
    for start, _, end in found:
        if out and start < out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def scan(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``spans``: array of (kind, start, end), by start, then kind."""
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        vocabulary = encoding(path)
        for piece in pieces(batches, "text"):
            bounds, kind, start, end = [0], [], [], []
            for text in piece.column("text").to_pylist():
                for s, k, e in spans(text, vocabulary) if text else ():
                    kind.append(KINDS[k])
                    start.append(s)
                    end.append(e)
                bounds.append(len(kind))
            rows = pa.StructArray.from_arrays([pa.array(kind, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["kind", "start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rows)
            yield pa.record_batch([piece.column("id"), lists], names=["id", "spans"])

    kind = base.schema["id"].dataType.simpleString()
    found = base.mapInArrow(run, f"id {kind}, spans array<struct<kind: string, start: int, end: int>>")
    return found.withColumnRenamed("id", id_col)


def listed(found: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def number(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda x: x["kind"] == kind)).cast("long")
