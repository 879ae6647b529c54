"""Documents to token ids: language, boilerplate lines, near-duplicates, benchmark leaks, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the
next one's documents. All but the last return the columns of the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import decontaminate, language, lines, minhash, pieces
from granary.llm.queries import vocabulary
from granary.llm.samples import fold
from granary.llm.store import Scratch, stored, unused


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``lang`` becomes the predicted one. Texts without a letter go.

    Ambiguous texts stay under the likeliest language: most are merely short.
    """
    model = language.train(docs.select("doc_id", "text", "lang").where(fold("doc_id") != 0))
    label, score, ambiguous = unused(docs.columns, "lang_pred", "score", "ambiguous")
    found = language.predict(docs, model, added=(label, score, ambiguous)).where(F.col(label) != language.UNKNOWN)
    return found.withColumn("lang", F.col(label)).select(*docs.columns)


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All boilerplate lines leave the texts; ``n_chars`` follows."""
    cleaned = lines.clean(docs, whole=True)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the smallest id."""
    scratch = Scratch(spark)
    dropped = stored(minhash.near_duplicates(docs, scratch=scratch).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    scratch.drop()
    # The ids grow with the documents: never broadcast, however few they are.
    return docs.join(dropped.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the text decoded from its ids, ids, n_tokens, round_trip."""
    return pieces.tokenised(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_lines),
    ("minhash_dedup", remove_near_duplicates),
    ("decontamination", remove_leaks),
    ("sentencepiece", encode_pieces),
]

#: Language identification and edit distances are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
