"""Removal of boilerplate lines: lines that stand on many distinct sites.

Each line of a document (split at newlines, spaces U+0020 around it cut off, no other white space) gets a HyperLogLog sketch of the
sites it occurs on, built per partition and merged by the aggregation, so a line common to every document is
one small sketch per task. Sketches decide lines far from the threshold; lines near it, within the error
of the sketch, get exact distinct counts. The result is the same as by exact counts for all lines.

A line on at least ``min_sites`` sites is boilerplate and all its occurrences go. Lines with fewer than
``min_words`` words are no boilerplate. A document of which such lines make up more than half (in characters)
is a copy, not a page around boilerplate: it stays as it is, for the document-level stages to judge.

``whole`` lifts both exemptions: lines of one word count, and every occurrence goes, also from documents that are
mostly such lines (``mostly_shared`` only marks them). Copies then must not turn their own lines into boilerplate:
sites are counted on one document of each group of near-duplicate texts, the one with the smallest id.

Null texts stay null and have no lines. A null site counts as no site. Rows with equal id are separate
documents. Other columns are kept by ``clean`` and ignored by ``report``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import minhash
from granary.llm.store import Scratch, stored, unused

#: Registers 2^12: standard error 1.04 / 64; four errors on each side are counted exactly.
LOG_REGISTERS = 12
ERROR = 4 * 1.04 / 2 ** (LOG_REGISTERS / 2)


def _key(line: Column) -> Column:
    """128 bits of a line without the white space around it."""
    return F.unhex(F.md5(F.trim(line).cast("binary")))


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"[^ \t\x0B\f\r]+"))


def site_lines(docs: DataFrame, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """(key, site) of every line that could be boilerplate."""
    line = docs.where(F.col(text_col).isNotNull() & F.col(site_col).isNotNull()).select(
        F.col(site_col).cast("string").alias("site"), F.explode(F.split(text_col, "\n")).alias("line")
    )
    return line.where((F.trim("line") != "") & (_words(F.col("line")) >= min_words)).select(_key(F.col("line")).alias("key"), "site")


def boilerplate(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 10, min_words: int = 3) -> DataFrame:
    """(key) of the lines on at least ``min_sites`` distinct sites."""
    lines = site_lines(docs, text_col, site_col, min_words)
    spread = lines.groupBy("key").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"))
    spread = spread.select("key", F.hll_sketch_estimate("sketch").alias("sites"))
    margin = max(1.0, min_sites * ERROR)
    sure = spread.where(F.col("sites") > min_sites + margin).select("key")
    near = spread.where(F.abs(F.col("sites") - min_sites) <= margin).select("key")
    exact = lines.join(near, "key", "left_semi").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(exact.where(F.col("sites") >= min_sites).select("key"))


def originals(docs: DataFrame, text_col: str, id_col: str, site_col: str) -> DataFrame:
    """Text and site of one document of each group of near-duplicate texts. Only the ids of the others are stored."""
    scratch = Scratch(docs.sparkSession)
    near = minhash.near_duplicates(docs, id_col, text_col, scratch=scratch)
    dropped = stored(near.where(~F.col("kept")).select(F.col("doc_id").alias("id")).distinct(), "dropped")
    scratch.drop()
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_col, site_col)
    # The ids grow with the documents: never broadcast, however few they are.
    return own.join(dropped.hint("merge"), "id", "left_anti").select(text_col, site_col)


def _marked(
    docs: DataFrame, counted: DataFrame, text_col: str, site_col: str, min_sites: int, min_words: int, row: str, drop: str
) -> DataFrame:
    """``docs``, tagged in column ``row``, with ``drop``: the keys of the row's boilerplate lines, null if it has none."""
    found = boilerplate(counted, text_col, site_col, min_sites, min_words)
    line = docs.where(F.col(text_col).isNotNull()).select(F.col(row).alias("tag"), F.explode(F.split(text_col, "\n")).alias("line"))
    line = line.where(_words(F.col("line")) >= min_words).select("tag", _key(F.col("line")).alias("key"))
    hits = line.join(found, "key").groupBy(F.col("tag").alias(row)).agg(F.collect_set("key").alias(drop))
    return docs.join(hits, row, "left")


def _length(lines: Column) -> Column:
    return F.aggregate(F.transform(lines, lambda x: F.length(F.trim(x))), F.lit(0), lambda a, b: a + b)


def _decided(docs: DataFrame, text_col: str, id_col: str, site_col: str, min_sites: int, min_words: int, whole: bool):
    """``docs`` with three more columns, and their names: all lines, kept lines (null if nothing goes), mostly shared."""
    row, drop, lines, kept, copy = unused(docs.columns, "row", "drop", "lines", "kept_lines", "mostly_shared")
    # Any two rows with one tag have the same boilerplate lines, or the union of both, which is as good.
    tagged = docs.withColumn(row, F.xxhash64(id_col, text_col))
    counted, least = (originals(docs, text_col, id_col, site_col), 1) if whole else (docs, min_words)
    marked = _marked(tagged, counted, text_col, site_col, min_sites, least, row, drop).withColumn(lines, F.split(text_col, "\n"))
    rest = F.filter(lines, lambda x: ~F.coalesce(F.array_contains(drop, _key(x)), F.lit(False)))
    marked = marked.withColumn(kept, F.when(F.col(drop).isNotNull(), rest))
    shared = F.col(kept).isNotNull() & (2 * _length(F.col(kept)) < _length(F.col(lines)))
    marked = marked.withColumn(copy, F.coalesce(shared, F.lit(False)))
    if not whole:
        marked = marked.withColumn(kept, F.when(~F.col(copy), F.col(kept)))
    return marked.select(*docs.columns, lines, kept, copy), (lines, kept, copy)


def clean(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", site_col: str = "source", min_sites: int = 10, min_words: int = 3,
    whole: bool = False,
) -> DataFrame:
    """The same rows and columns, boilerplate lines gone from the text."""
    decided, (_, kept, _) = _decided(docs, text_col, id_col, site_col, min_sites, min_words, whole)
    text = F.when(F.col(kept).isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))
    return decided.withColumn(text_col, text).select(*docs.columns)


def report(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", site_col: str = "source", min_sites: int = 10, min_words: int = 3,
    whole: bool = False,
) -> DataFrame:
    """doc_id, n_lines, n_removed, mostly_shared (left as it is unless ``whole``), kept_sha256 of the remaining lines."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(site_col).alias("site"))
    decided, (lines, kept, copy) = _decided(base, "text", "doc_id", "site", min_sites, min_words, whole)
    rest = F.coalesce(kept, lines)
    return decided.select(
        "doc_id",
        F.when(F.col(lines).isNotNull(), F.size(lines)).otherwise(0).cast("long").alias("n_lines"),
        F.when(F.col(kept).isNotNull(), F.size(lines) - F.size(kept)).otherwise(0).cast("long").alias("n_removed"),
        F.col(copy).alias("mostly_shared"),
        F.sha2(F.coalesce(F.array_join(rest, "\n"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
