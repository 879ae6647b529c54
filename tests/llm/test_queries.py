"""The registered queries on the smallest tables: against SQL where there is some, else against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from granary.llm import decontaminate, queries, token_store
from tests.parity import DATA, connect, duck_rows

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def rows(df):
    order = sorted(df.columns)
    return sorted((tuple(r[c] for c in order) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF)
    names, want = duck_rows(con, queries.ORACLE_SQL[name])
    order = sorted(range(len(names)), key=lambda i: names[i])
    assert sorted(names) == sorted(got.columns)
    assert rows(got) == sorted((tuple(r[i] for i in order) for r in want), key=repr)


def texts(spark, column="text", table="documents", key="doc_id"):
    return {r[0]: r[1] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key, column).collect()}


def test_quality_on_held_out_rows(spark):
    got = {r.doc_id: r for r in queries.op2_quality_classifier(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert set(got) == set(texts(spark))
    held = [d for d in labels if got[d].held_out]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) for d in got)
    assert sum(got[d].predicted == labels[d] for d in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_languages_on_held_out_rows(spark):
    truth = texts(spark, "lang")
    got = queries.op8_language_id(spark, SF).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == len(truth) and held
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_token_files_against_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    want, start = [], 0
    for doc, text in sorted(texts(spark).items()):
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = queries.op4_token_store(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == want


def test_strings_of_special_tokens_are_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    path = queries.vocabulary("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = ["hello <|endoftext|> world", "<|endoftext|>", "a<|endoftext|>\n\n b <| endoftext |>", "<|endoftext|", None, "", "plain words"]
    got = token_store.encoder(path).documents(texts, 2)
    assert [g.tolist() for g in got] == [[*plain.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_pieces_round_trip(spark):
    got = queries.op3_sentencepiece(spark, SF)
    assert got.count() == got.where("round_trip and n_tokens > 0").count() == len(texts(spark))


def test_decontamination_against_dynamic_programming(spark):
    items = {i: decontaminate.folded(t) for i, t in texts(spark, "text", "benchmark", "item_id").items()}
    docs = {d: decontaminate.folded(t) for d, t in texts(spark).items()}
    got = {r.doc_id: r.item_ids for r in queries.op6_decontamination(spark, SF).collect()}
    want = {}
    for d, text in docs.items():
        inside = [i for i, item in items.items() if item in text]
        if inside:
            want[d] = sorted(inside)
    assert {d: [i for i in v if items[i] in docs[d]] for d, v in got.items() if d in want} == want
    for d, found in got.items():
        assert all(least_edits(items[i], docs[d]) <= decontaminate.budget(items[i]) for i in found)


def least_edits(item: bytes, text: bytes) -> int:
    """Plain dynamic programming, the occurrence anywhere in the text."""
    data = np.frombuffer(text, dtype=np.uint8)
    before = np.zeros(len(data) + 1, dtype=np.int64)
    places = np.arange(len(data) + 1)
    for i, c in enumerate(item):
        cost = np.minimum(before[:-1] + (data != c), before[1:] + 1)
        now = np.concatenate([[i + 1], cost])
        before = np.minimum.accumulate(now - places) + places
    return int(before.min())


def test_every_item_within_its_edits_is_found(spark):
    """Items with up to their budget of edits, and some more, planted in texts; dynamic programming says which must be found."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abdegiklmnorstu") for _ in range(rng.randrange(2, 9))) for _ in range(300)]
    items = {i: " ".join(rng.choice(words) for _ in range(rng.choice([1, 6, 15, 40]))) for i in range(24)}
    docs = {}
    for d in range(160):
        item = list(items[d % 24])
        for _ in range(rng.randrange(len(item) // decontaminate.SPACING + 3)):
            at = rng.randrange(len(item) + 1)
            item[at : at + rng.randrange(2)] = rng.choice(["", "x", "Q", "zz"])
        docs[d] = " ".join([*(rng.choice(words) for _ in range(20)), "".join(item), *(rng.choice(words) for _ in range(20))])
    table = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)
    found = decontaminate.report(table, spark.createDataFrame(list(items.items()), "item_id long, text string"))
    got = {r.doc_id: set(r.item_ids) for r in found.collect()}
    folded_items = {i: decontaminate.folded(t) for i, t in items.items()}
    want = {}
    for d, text in docs.items():
        own = decontaminate.folded(text)
        inside = {i for i, item in folded_items.items() if least_edits(item, own) <= decontaminate.budget(item)}
        if inside:
            want[d] = inside
    assert got == want and 40 < len(want)


def test_pages_against_their_markup(spark):
    import html
    import re

    got = {r.page_id: r for r in queries.op9_html_extraction(spark, SF).collect()}
    for page, source in texts(spark, "html", "pages", "page_id").items():
        inner = source[source.index("<article>") : source.index("</article>")]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<(?:/?p|/?h1|br)>", inner)]
        assert got[page].text == "\n".join(b for b in blocks if b)
        assert got[page].n_chars == len(got[page].text)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r for r in docs.collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert out and set(out) <= set(truth)
    leaked = {r.doc_id for r in queries.op6_decontamination(spark, SF).collect()}
    assert not leaked & set(out)
    near = {r.doc_id: r for r in queries.op5_minhash_dedup(spark, SF).collect()}
    alone = [d for d, r in near.items() if r.kept and d not in leaked]
    # Line removal may part near copies, but whatever was alone before stays.
    assert set(alone) <= set(out)
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in out.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
