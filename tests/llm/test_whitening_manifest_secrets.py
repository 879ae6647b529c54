"""Whitening, the Merkle manifest and the secret scan against plain versions, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from granary.llm import merkle, queries, secret_scan, whitening
from tests.parity import DATA

SF = f"{DATA}/sf0.001"


# Whitening


@pytest.mark.parametrize("seed", range(4))
def test_inertia_counts_positive_eigenvalues(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 3, 17, 40):
        a = rng.normal(size=(n, n))
        a = a + a.T
        if seed == 1:
            np.fill_diagonal(a, 0)
        for shift in rng.normal(size=5) * n**0.5:
            assert whitening.inertia(a - shift * np.eye(n)) == (np.linalg.eigvalsh(a) > shift).sum()


def some_covariances():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 24))
    yield np.cov(x.T)
    yield np.cov((x @ np.diag(np.arange(1, 25.0) ** 3)).T)
    yield np.eye(12) * 5.0
    yield np.diag([3.0, 3, 3, 2, 2, 1, 1, 1, 1, 0.5])
    q = np.linalg.qr(rng.normal(size=(20, 20)))[0]
    yield q @ np.diag([9.0, 9, 9 - 1e-9, 5, 5 - 1e-13, *np.ones(15)]) @ q.T
    yield np.cov(x[:4].T)
    yield np.zeros((5, 5))
    yield np.array([[2.0]])


@pytest.mark.parametrize("v", list(some_covariances()))
def test_leading_pairs(v):
    v = (v + v.T) / 2
    values, vectors = whitening.leading(v, 8)
    k = min(8, len(v))
    size = max(np.abs(v).max() * len(v), 1e-300)
    assert np.allclose(values, np.linalg.eigvalsh(v)[::-1][:k], atol=1e-13 * size)
    assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13
    assert np.abs(v @ vectors - vectors * values).max() <= 1e-12 * size


def plain_whitening(vectors):
    fit = np.array([[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors])
    n, sums = len(fit), fit.sum(axis=0)
    d = fit - sums / n
    values, q = np.linalg.eigh(d.T @ d / n)
    values, q = values[::-1], q[:, ::-1]
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)) for x in fit]
    return n, deviation, d @ q / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def test_whitening_query(spark):
    table = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None]
    n, deviation, whitened, explained = plain_whitening([r.embedding for r in table])
    place = {r.vec_id: i for i, r in enumerate(table)}
    got = queries.op11_embedding_whitening(spark, SF).collect()
    assert sorted((r.vec_id, r.component) for r in got) == sorted((v, k) for v in place for k in range(1, 9))
    turn = {}
    for r in sorted(got, key=lambda r: r.vec_id):
        i, k = place[r.vec_id], r.component - 1
        sign = turn.setdefault(k, np.sign(r.whitened * whitened[i, k]))
        assert (r.n, r.deviation) == (n, deviation[i])
        assert abs(r.whitened * sign - whitened[i, k]) < 1e-9 and abs(r.explained / explained[k] - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-9


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(5)
    good = rng.normal(size=(40, 3)).tolist()
    rows = [(i, v, 1, "x") for i, v in enumerate(good)]
    rows += [(90, None, 1, "x"), (91, [1.0, None, 2.0], 1, "x"), (92, [nan, 1.0, 1.0], 1, "x"), (93, [1.0, -inf, 1.0], 1, "x"), (94, [], 1, "x")]
    rows += [(95, [1.0, 2.0], 1, "x"), (95, [1.0, 2.0], 1, "x"), (None, good[0], None, None), (7, good[7], 1, "x")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n long, whitened string").repartition(5)
    got = whitening.whiten(table).collect()
    own = [r for r in got if len(r.whitened) == 3]
    n, deviation, whitened, explained = plain_whitening([*good, good[0], good[7]])
    assert len(own) == n == own[0].n and sorted(int(r.deviation) for r in own) == sorted(deviation)
    assert np.allclose(own[0].explained, explained) and own[0].identity_error < 1e-12
    at = {r.vec_id: r.whitened for r in own}
    assert np.allclose(np.abs([at[i] for i in range(40)]), np.abs(whitened[:40]))
    # Two equal vectors of another length have no variance.
    flat = [r for r in got if len(r.whitened) == 2]
    assert [(r.vec_id, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in flat] == [(95, 2, 0, [None, None], [None, None], None)] * 2
    assert [(r.vec_id, r.whitened) for r in got if not r.whitened] == [(94, [])]
    assert whitening.whiten(table.limit(0)).count() == 0


def test_deviation_past_long():
    fit = whitening.Fit(3_000_000_000, [0, 5], np.zeros((2, 0)), [])
    x = np.array([[100_000, -3], [whitening.LARGEST, 1]])
    assert fit.deviations(x) == [sum((fit.n * int(c) - s) ** 2 for c, s in zip(row, fit.sums)) for row in x]


# Merkle manifest


def plain_hash(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return plain_hash("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(nodes):
    """Root, and for each node its siblings by level as (left, right)."""
    paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for at in range(0, len(nodes), 8):
            run = nodes[at : at + 8]
            for k in range(len(run)):
                for leaf in groups[at + k]:
                    paths[leaf].append((run[:k], run[k + 1 :]))
            up.append(plain_hash("".join(run)))
            held.append([leaf for g in groups[at : at + 8] for leaf in g])
        nodes, groups = up, held
    return nodes[0], paths


def plain_manifest(rows):
    """(id, leaf, subroot, root, path) of rows (doc_id, source, lang, n_chars, text)."""
    trees = {}
    for r in rows:
        trees.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), plain_leaf(r), r))
    names = sorted(trees, key=lambda n: (n is not None, (n or "").encode()))
    done = {n: plain_tree([x[1] for x in sorted(trees[n], key=lambda x: x[:2])]) for n in names}
    root, above = plain_tree([done[n][0] for n in names])
    out = []
    for name, high in zip(names, above):
        subroot, paths = done[name]
        for (_, leaf, r), low in zip(sorted(trees[name], key=lambda x: x[:2]), paths):
            out.append((r[0], leaf, subroot, root, [("".join(a), "".join(b)) for a, b in low + high]))
    return out


def manifest_rows(spark, docs):
    found = merkle.manifest(docs, queries.MANIFEST).select("doc_id", "leaf", "subroot", "root", "path").collect()
    return [(r.doc_id, r.leaf, r.subroot, r.root, [(x.left, x.right) for x in r.path]) for r in found]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank long, node string, path int"


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_manifest_against_loops(spark, monkeypatch, digits):
    monkeypatch.setattr(merkle, "DIGITS", digits)
    rng = random.Random(2)
    langs = [None, "", "én", "en", "zz", "eight"] + [f"l{i}" for i in range(12)]
    sizes = {None: 9, "": 1, "én": 8, "en": 700, "zz": 65, "eight": 64}
    rows = [
        (rng.randrange(10_000), rng.choice([None, "", "s1", "ß"]), lang, rng.choice([None, 3]), rng.choice([None, "", "AbC", "é 漢"]), 1, "n", 2)
        for lang in langs for _ in range(sizes.get(lang, 2))
    ]
    rows += [(None, None, None, None, None, None, None, None), (5, "s", "en", 1, "same", 1, "n", 1), (5, "s", "en", 1, "same", 1, "n", 1), (5, "s", "en", 1, "other", 1, "n", 1)]
    rows.append((6, "s", "zz", 1, "long " * 200_000, 1, "n", 1))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(6)
    want = plain_manifest([r[:5] for r in rows])
    assert sorted(manifest_rows(spark, docs), key=repr) == sorted(want, key=repr)


def test_manifest_of_few_rows(spark):
    one = spark.createDataFrame([(1, "s", None, 2, "t", 0, "", 0)], SCHEMA)
    leaf = plain_leaf([1, "s", None, 2, "t"])
    assert manifest_rows(spark, one) == [(1, leaf, leaf, leaf, [])]
    assert merkle.manifest(one.limit(0), queries.MANIFEST).count() == 0


def test_one_shuffle_groups_all_digits_of_a_block(spark):
    nodes = spark.range(5000).selectExpr("concat('t', id % 2) as tree", "id div 2 as rank", "5 as height", "sha2(string(id), 256) as node", "id as name")
    plan = merkle.nested(nodes, 0, ["name"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SinglePartition" not in plan


def test_manifest_query_finds_the_tampered_rows(spark):
    got = queries.op12_merkle_manifest(spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(docs)
    for r in got:
        text = docs[r.doc_id]
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and text is not None and re.search("[A-Z]", text) is not None
        assert r.verified == (not changed) == (r.folded_root == r.root)


# Secret scan


def plain_base(text):
    """The three patterns by loops over characters."""
    letters = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    out, at = [], 0
    while at < len(text):
        end = None
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            part = text[at : at + len(word)]
            if part.isascii() and part.lower() == word:
                i = at + len(word)
                i += text[i : i + 1] in ('"', "'") and text[i : i + 1] != ""
                while text[i : i + 1] == " ":
                    i += 1
                if text[i : i + 1] not in (":", "="):
                    continue
                i += 1
                while text[i : i + 1] == " ":
                    i += 1
                i += text[i : i + 1] in ('"', "'") and text[i : i + 1] != ""
                j = i
                while j < len(text) and (text[j] in letters or text[j] in "+/_.=-"):
                    j += 1
                if j > i:
                    end = j
                    if j - i >= 12:
                        out.append((at, 0, j))
                    break
        at = end or at + 1
    for kind, start, more, least in ((1, "AKIA", set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"), 18), (2, "", set("0123456789abcdef"), 16)):
        at = 0
        while at < len(text):
            j = at + len(start)
            while text.startswith(start, at) and j < len(text) and text[j] in more:
                j += 1
            if text.startswith(start, at) and j > at + len(start):
                if j - at >= least:
                    out.append((at, kind, j))
                at = j
            else:
                at += 1
    return sorted(out)


@pytest.fixture(scope="module")
def vocabulary():
    return secret_scan.encoding(queries.vocabulary("byte_bpe_50k.tiktoken"))


def test_patterns_against_loops(vocabulary):
    rng = random.Random(9)
    parts = ["token", "Secret", "PASSWORD", "passwd", "api_key", "APIkey", "ſecret", "toKen", ":", "=", " ", '"', "'", "abc", "0123456789ab", "deadbeefdeadbeef", "AKIA", "AKIAQ", "X9Y8Z7W6V5U4T3S2", "\n", "é", "漢", "\t", "-", "g"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        assert [s for s in secret_scan.spans(text, vocabulary) if s[1] < 3] == plain_base(text), text


def test_first_match_is_not_searched_again(vocabulary):
    text = "secret: token:abcdefghijklmnop"
    assert not [s for s in secret_scan.spans(text, vocabulary) if s[1] == 0]


RANDOM = ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYzTq9Lk3v", "ghp_x7Kq92LmVbT4sNz8RcYw3JfHd6PgQa51", "eyJhbGciOiJIUzI1NiJ9kP3xV9qZ"]
KNOWN = [
    "550e8400-e29b-41d4-a716-446655440000", "D41D8CD98F00B204E9800998ECF8427E", "internationalization_of_names", "getHttpResponseCodeForUser",
    "MAX_CONNECTION_RETRIES_2024", "www.example.com/path/to/some/file", "anthrererendanhethere", "2024-01-02-03.04.05+0600", "sha256-" + "Ab3" * 14 + "x=",
    "----------------------------", "Undeinpfheitungenderen.",
]


@pytest.mark.parametrize("run", RANDOM)
def test_random_strings_are_found(vocabulary, run):
    text = f"é see ({run}). Then more words"
    assert secret_scan.spans(text, vocabulary) == [(7, 3, 7 + len(run))]


@pytest.mark.parametrize("run", KNOWN)
def test_digests_and_identifiers_are_left_alone(vocabulary, run):
    assert [s for s in secret_scan.spans(f"see {run} there", vocabulary) if s[1] == 3] == []


def test_random_strings_at_large(vocabulary):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    found = sum(bool(secret_scan.spans("".join(rng.choice(alphabet) for _ in range(32)), vocabulary)) for _ in range(500))
    assert found >= 490


def test_scan_edges(spark):
    long = "word " * 150_000 + RANDOM[0]
    rows = [(1, None, "s", 1), (1, "", "s", 1), (None, "api_key = 'abcdefghijkl'", "s", 1), (2, long, None, 1), (2, long, None, 1), (3, "x" * 50_000, "s", 1), (4, "aB3" * 10_000, "s", 1)]
    table = spark.createDataFrame(rows, "doc_id long, text string, spans string, kind int").repartition(3)
    path = queries.vocabulary("byte_bpe_50k.tiktoken")
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in secret_scan.scan(table, path).collect()), key=repr)
    hit = ("random", 750_000, 750_000 + len(RANDOM[0]))
    assert got == sorted([(1, []), (1, []), (None, [("assign", 0, 24 - 1)]), (2, [hit]), (2, [hit]), (3, []), (4, [("random", 0, 30_000)])], key=repr)
    assert secret_scan.scan(table.limit(0), path).count() == 0


def test_scan_query(spark, vocabulary):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op13_secret_scan(spark, SF).collect()
    assert len(got) == len(docs) and sum(r.n_hex for r in got) > 0
    for r in got:
        base = plain_base(docs[r.doc_id] or "")
        listed = ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in base) for x in range(3))
        assert r.base_sha256 == plain_hash(listed)
        assert [x for x in r.spans.split(",") if not x.startswith("random")] == listed.split(",") or not base
