"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator and stage."""

from __future__ import annotations

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from granary.llm import decontaminate, html_text, language, lines, minhash, pieces, quality, substring, token_store, vectors
from granary.llm.queries import vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, score string, component_id long, rep int"


def some_docs():
    rng = random.Random(4)
    words = [f"{a}{b}" for a, b in itertools.product(["ba", "lo", "ti", "Ru", "né"], ["na", "x", "so", "ß", "k"])]
    base = [rng.choice(words) for _ in range(90)]
    texts = [None, "", "   \n ", "one", "one", "two words", "a b c d e", "A  B\tc D e", " ".join(base), " ".join(base), "123 456 !!", "漢字 だけ ▁ \x00 é"]
    for k in range(12):
        copy = list(base)
        copy[k * 7] = "changed"
        texts.append(" ".join(copy) + f"\nline for all of you\nown {k}")
    texts += ["line for all of you\n" + " ".join(rng.choice(words) for _ in range(30)) for _ in range(20)]
    texts.append(" ".join(["same"] * 4000))  # long, periodic
    texts.append("x" * 50_000)  # one long word
    docs = [(i, t, [None, "en", "fr"][i % 3], f"s{i % 15}" if i % 7 else None, 0, i, "s", 1, 2) for i, t in enumerate(texts)]
    return docs + [(8, texts[8], "en", "s1", None, 1, None, None, None), (None, "text without an id", "en", "s2", 1, 1, "s", 1, 2)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return tuple((x is not None, x) for x in row)


def brute_windows(rows, size):
    lists = [(d, WORD.findall(t or "")) for d, t in rows]
    seen = collections.Counter(tuple(w[i : i + size]) for _, w in lists for i in range(len(w) - size + 1))
    out = []
    for d, w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("group_rows", [4096, 3])
def test_substring(docs, none, group_rows):
    want = brute_windows([(r.doc_id, r.text) for r in docs.collect()], 35)
    got = substring.remove_repeats(docs, group_rows=group_rows).collect()
    assert sorted(map(tuple, got), key=key) == want
    assert substring.remove_repeats(none).count() == 0


def test_substring_short_windows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randrange(30)))) for i in range(40)]
    for window, prefix in ((4, 2), (5, 5), (3, 1)):
        got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), window=window, prefix=prefix, group_rows=2)
        assert sorted(map(tuple, got.collect()), key=key) == brute_windows(rows, window)


def brute_sets(rows):
    sets = {}
    for d, t in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()
    root = {d: d for d in sets}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(sorted(sets), 2):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return {d: (len(s), root[d]) for d, s in sets.items()}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates(docs, none, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id is not null").collect()]
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_sets(rows)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    assert minhash.near_duplicates(none).count() == 0


def test_sketch_estimate():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.75, 0.95):
        errors = []
        for _ in range(60):
            pool = np.unique(rng.integers(0, 1 << 63, 3000, dtype=np.uint64) * np.uint64(2))
            both = int(1000 * share)
            a, b = np.sort(pool[:1000]), np.sort(np.concatenate([pool[:both], pool[1000 : 2000 - both]]))
            true = both / (2000 - both)
            errors.append(float(minhash.estimate(minhash.sketch(a), minhash.sketch(b), 1000, 1000)) - true)
        assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_lines(docs, none):
    got = lines.report(docs, min_sites=5).collect()
    assert len(got) == docs.count() and lines.report(none).count() == 0
    sites = collections.defaultdict(set)
    for r in docs.where("text is not null and source is not null").collect():
        for x in r.text.split("\n"):
            sites[x.strip(" ")].add(r.source)
    common = {x for x, s in sites.items() if len(s) >= 5 and len(re.findall(r"[^ \t\x0b\f\r]+", x)) >= 3}
    assert "line for all of you" in common
    cleaned = lines.clean(docs, min_sites=5)
    assert cleaned.columns == docs.columns
    after = sorted(((r.doc_id, r.text) for r in cleaned.collect()), key=key)
    want = []
    for r in docs.collect():
        own = (r.text or "").split("\n")
        kept = [x for x in own if x.strip(" ") not in common]
        size = [sum(len(x.strip(" ")) for x in y) for y in (kept, own)]
        want.append((r.doc_id, r.text if r.text is None or 2 * size[0] < size[1] else "\n".join(kept)))
    assert after == sorted(want, key=key)


def test_sites_near_the_threshold_are_counted(spark):
    rows = [(f"line number {n} of all", f"site{s}") for n in range(150, 251, 10) for s in range(n)]
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string")
    assert lines.boilerplate(docs, min_sites=200).count() == 6


def test_every_shared_line_goes_and_copies_keep_their_own(spark):
    rng = random.Random(11)
    own = [" ".join(f"w{rng.randrange(999)}" for _ in range(12)) for _ in range(20)]
    base = [" ".join(f"v{rng.randrange(999)}" for _ in range(30)) for _ in range(3)]
    short = [(i, f"read this shared line today\nMenu\nx{i} y", f"s{i}") for i in range(12)]
    pages = [(20 + i, f"Menu\n{own[i]}", f"s{i}") for i in range(12)]
    exact = [(40 + i, "\n".join(base), f"s{i}") for i in range(12)]
    near = [(60 + i, "\n".join([own[12], own[13], own[14], own[15], own[16], f"number {i}"]), f"s{i}") for i in range(12)]
    table = spark.createDataFrame([*short, *pages, *exact, *near], "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in lines.clean(table, whole=True).collect()}
    assert got == {**{i: f"x{i} y" for i, _, _ in short}, **{i: t.split("\n")[1] for i, t, _ in pages}, **{i: t for i, t, _ in [*exact, *near]}}
    report = {r.doc_id: r for r in lines.report(table, whole=True).collect()}
    assert (report[0].n_removed, report[0].mostly_shared, report[40].n_removed, report[60].n_removed) == (2, True, 0, 0)
    through = corpus_pipeline.remove_lines(spark, table.withColumn("n_chars", table.doc_id), "")
    assert {r.doc_id: r.text for r in through.collect()} == got


def test_language(docs, none, spark):
    got = language.identify(docs).collect()
    assert len(got) == docs.count() and language.identify(none).count() == 0
    by = {r.doc_id: r for r in got}
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (0, 1, 2, 10))
    assert by[11].lang_pred != "und" and not by[None].held_out
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", docs.lang.substr(9, 1)).where("lang is null")).collect()} == {"und"}
    for n in (1, 2, 3, 6, 9):
        code = language.codewords(n)
        assert len({tuple(w) for w in code.tolist()}) == n


def test_quality(docs, none, spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)] + [(None, 1, 0), (3, None, 0), (3, 0, 0), (999, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(none, labels).count() == 0


def test_quality_joins_measures_with_labels_not_texts(spark, monkeypatch):
    """A join of texts with labels would shuffle the learning texts whole."""
    rng = random.Random(8)
    words = ["stone", "river", "BUY", "now!!", "12", "a,b"]
    # First and last words of their own: a first word that equals the last one of the row before it would count as repeated.
    texts = [f"from{i} {' '.join(rng.choices(words, weights=[3, 3, i % 2 * 3, i % 2, 1, 1], k=3 + i % 11))} to{i}" for i in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)], "doc_id long, quality int")
    seen = []
    learn = quality.learn
    monkeypatch.setattr(quality, "learn", lambda rows, *more: seen.append(rows) or learn(rows, *more))
    got = sorted(((str(r.doc_id), r.score) for r in quality.classify(docs, labels).collect()))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and "text#" not in plan and "MapInArrow" not in plan
    marked = docs.join(labels, "doc_id").where(quality.fold("doc_id") != 0)
    held = docs.selectExpr("doc_id", "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false) as held_out", "text")
    model = quality.train(marked.select("text", "quality"))
    want = sorted((str(r.doc_id), r.score) for r in quality.score(held, model).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and np.allclose([s for _, s in got], [s for _, s in want], atol=1e-6)


def test_pairwise_ranking_recovers_an_order():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4))
    good = x[:, 0] - 2 * x[:, 1] > -1
    model = quality.fit(x, good)
    assert (model.scores(x) >= 0.3).mean() == pytest.approx(good.mean(), abs=0.01)
    assert ((model.scores(x) >= 0.3) == good).mean() > 0.93


def test_quality_learns_from_every_row(spark):
    """5,000 rows a label: the last ones count too, and moments, bins and threshold are those of all rows."""
    rng = random.Random(6)
    plain = [" ".join(rng.choice(["stone", "river", "cloud"]) for _ in range(rng.randint(3, 9))) + "." for _ in range(5000)]
    noisy = [" ".join(rng.choice(["BUY", "now!!", "$$$"]) for _ in range(rng.randint(3, 9))) for _ in range(300)]
    rows = spark.createDataFrame([(t, 1) for t in plain] + [(t, 0) for t in noisy], "text string, quality int")
    model = quality.train(rows)
    x = quality.measures(pa.array(plain + noisy))
    assert np.allclose(model.middle, x.mean(axis=0)) and np.allclose(model.edges, np.quantile(x, np.arange(1, 8) / 8, axis=0).T)
    assert model.threshold == pytest.approx(np.quantile(model.worths(x), 300 / 5300), abs=1e-9)
    right = (model.scores(x) >= 0.3) == np.array([True] * 5000 + [False] * 300)
    assert right.mean() > 0.99


def brute_viterbi(model, text):
    """Dynamic programming over the whole marked text, without chunks."""
    data = b" " + text.encode()
    index = {p: i for i, p in enumerate(model.pieces) if p}
    low = model.scores.min() - pieces.UNKNOWN_PENALTY
    starts = [i for i, b in enumerate(data) if b & 0xC0 != 0x80] + [len(data)]
    best = {0: (0.0, [])}
    for a, after in zip(starts, starts[1:]):
        score, ids = best[a]
        if data[a:after] not in index:
            if after not in best or score + low > best[after][0]:
                best[after] = (score + low, ids + [int(model.byte_ids[b]) for b in data[a:after]])
        for b in starts:
            if b > a and b - a <= 48 and data[a:b] in index:
                i = index[data[a:b]]
                if b not in best or score + model.scores[i] > best[b][0]:
                    best[b] = (score + model.scores[i], ids + [i])
    return best[len(data)][1] if text else []


def test_pieces(docs, none):
    path = vocabulary("piece_bpe_32k.model")
    model = pieces.PieceModel.load(path)
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab  \n\tÀé漢😀▁thexyz") for _ in range(rng.randrange(30))) for _ in range(150)]
    texts += ["the theme of these  things", " lead", "trail ", "\n\n", "▁", " "]
    ids, counts = pieces.encode(model, texts)
    bounds = np.append(0, np.cumsum(counts))
    for text, a, b in zip(texts, bounds, bounds[1:]):
        assert ids[a:b].tolist() == brute_viterbi(model, text), text
    assert [d.decode() for d in model.decode(ids, counts)] == texts
    assert pieces.digest(docs, path).where("round_trip").count() == docs.count()
    back = pieces.tokenised(docs, path).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=key) == sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)
    assert pieces.tokenised(none, path).count() == 0


def test_token_shards(docs, none, spark):
    path = vocabulary("byte_bpe_50k.json")
    folder, shards = token_store.write(docs, path)
    rows = token_store.read(spark, folder, shards).collect()
    assert len(rows) == docs.count()
    start = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == start and r.n_tokens >= 1
        start += r.n_tokens
    assert [r.doc_id for r in sorted(rows, key=lambda r: (r.start)) if r.doc_id is not None] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    found = [i for s in shards for i in token_store.Shard(folder, s.name).get(8)]
    want = token_store.encoder(path).documents([docs.where("doc_id = 8").first().text], 2)[0]
    assert len(found) == 2 and all((f == want).all() for f in found)
    folder, shards = token_store.write(none, path)
    assert token_store.read(spark, folder, shards).count() == 0


def test_token_cuts():
    encoder = token_store.encoder(vocabulary("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab  \n\tÀé's1,\xa0x<|endoftext|>") for _ in range(rng.randrange(40))) for _ in range(300)] + ["<|endoftext|>", " a", "a ", "  "]
    got = encoder.documents(texts, 2)
    assert [g.tolist() for g in got] == [[*e.ids, 2] for e in encoder.plain.encode_batch(texts, add_special_tokens=False)]


def test_decontamination(docs, none, spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bdfgkl" for b in ("ona", "ire", "ust")]
    item = " ".join(rng.choice(words) for _ in range(40))
    edited = item.upper().replace(" ", "  ")[:-3] + "zz!"
    far = " ".join(rng.choice(words) for _ in range(40))
    rows = [(1, f"before {item} after"), (2, f"before {edited} after"), (3, far), (4, None), (5, ""), (5, item), (None, item), (6, item[: len(item) // 2])]
    benchmark = spark.createDataFrame([(7, item), (8, ""), (9, None), (None, "x"), (7, item)], "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.item_ids, r.min_edits) for r in decontaminate.report(table, benchmark).collect()}
    assert set(got) == {1, 2, 5, None} and got[1] == ([7], 0) and got[2][1] > 0
    assert sorted(((r.doc_id, r.text) for r in decontaminate.clean(table, benchmark).collect()), key=key) == sorted([rows[i] for i in (2, 3, 4, 7)], key=key)
    assert decontaminate.report(none, benchmark).count() == 0
    assert decontaminate.clean(docs, benchmark.where("false")).count() == docs.count()


def test_many_benchmark_blocks(spark, monkeypatch):
    items = [(i, f"item number {i} with words enough to be found {i * 7919}") for i in range(40)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 600)
    table = spark.createDataFrame([(i, f"x {t} y") for i, t in items] + [(99, "clean")], "doc_id long, text string")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {r.doc_id for r in decontaminate.report(table, benchmark).collect()} == set(range(40))
    assert [r.doc_id for r in decontaminate.clean(table, benchmark).collect()] == [99]


def test_myers():
    rng = np.random.default_rng(8)
    for _ in range(200):
        a, b = bytes(rng.choice(list(b"abc"), rng.integers(1, 20))), bytes(rng.choice(list(b"abc"), rng.integers(0, 30)))
        before = [0] * (len(b) + 1)
        for i, c in enumerate(a):
            now = [i + 1]
            for j, d in enumerate(b):
                now.append(min(before[j] + (c != d), before[j + 1] + 1, now[j] + 1))
            before = now
        assert decontaminate.edits(decontaminate.masks(a), len(a), b, 99) == min(before)


def test_vectors(spark):
    rng = np.random.default_rng(9)
    center = rng.normal(size=(5, 16))
    rows = []
    for i in range(400):
        v = center[i % 5] + rng.normal(size=16) * (0.05 if i % 3 else 1.0)
        rows.append((i, v.tolist(), i % 2, 1))
    rows += [(400, rows[0][1], 0, 1), (401, rows[0][1], 1, 1), (402, rows[0][1], None, 1), (403, None, 0, 1), (404, [0.0] * 16, 0, 1)]
    rows += [(405, [float("nan")] * 16, 0, 1), (406, [None] * 16, 0, 1), (407, [], 0, 1), (408, [1.0, 2.0], 0, 1), (409, [2.0, 4.0], 0, 1), (410, [float("inf")] * 16, 0, 1)]
    got = {r.vec_id: r for r in vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, rep int")).collect()}
    assert len(got) == len(rows)
    usable = [r for r in rows if r[0] < 402 or r[0] in (408, 409)]
    links = collections.defaultdict(set)
    for a, b in itertools.combinations(usable, 2):
        if a[2] == b[2] and len(a[1]) == len(b[1]):
            x, y = np.array(a[1]), np.array(b[1])
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                links[a[0]].add(b[0])
                links[b[0]].add(a[0])
    for r in rows:
        seen, todo = {r[0]}, [r[0]]
        while todo:
            for n in links[todo.pop()] - seen:
                seen.add(n)
                todo.append(n)
        assert (got[r[0]].n_links, got[r[0]].component_id) == (len(links[r[0]]), min(seen)), r[0]
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_vectors(empty).count() == 0


def test_tight_groups_of_vectors_are_bounded(spark, monkeypatch):
    rng = np.random.default_rng(12)
    tight = rng.normal(size=16) + rng.normal(size=(700, 16)) * 0.01
    x = np.concatenate([tight, rng.normal(size=(1400, 16))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    margin = 0.8 * np.sqrt(2 * 0.02 / 16)
    # A cut through a tight group saves nothing, so its rows do not multiply level by level.
    assert len(vectors.leaves(tight / np.linalg.norm(tight, axis=1, keepdims=True), vectors.grow(x[:700], 8, 5, margin), margin)[0]) == 700
    monkeypatch.setattr(vectors, "BOUND", 100)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    cells = vectors._cells(
        table.selectExpr("vec_id as rep", "0L as label", "1L as n", "embedding", "0L as leaf", "array(0L) as leaves", "16 as dim")
    ).groupBy(*vectors.CELL).count().collect()
    assert len(cells) == 21 * 22 // 2 and max(r["count"] for r in cells) < 350
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(table).collect()}
    close = x @ x.T >= 0.98
    root = vectors.fold(np.arange(len(x)), *np.nonzero(close))
    assert got == {i: (int(close[i].sum()) - 1, int(root[i])) for i in range(len(x))}


def test_pages(spark):
    page = html_text.main_text
    assert page(None) == page("") == page("<script>x</script>") == page("<nav>menu</nav>") == ""
    assert page("plain &lt;text&gt;") == "plain <text>"
    assert page("<p>a<p>b<br>c  \n d") == "a\nb\nc d"
    assert page("<body><div class='cookie-notice'>x y</div><main><h1>T</h1><div id=comments>no</div><p>one <i>t</i>wo</p></main><footer>f</footer>") == "T\none two"
    assert page("<body class='with-sidebar'><div class=sidebar>s</div><div><p>long enough text here</p><p>and more of the text</p></div>") == "long enough text here\nand more of the text"
    assert page("<article>a<!-- b --><style>c</style><form>d</form><aside>e</aside>f") == "a\nf"
    assert page("<" * 5000 + "a") and page("<p " + "x='" * 3000) is not None
    rows = [(1, "u", None), (1, "u", "<p>x"), (None, None, ""), (2, "v", "<div>" * 3000 + "deep")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text for r in got) == ["", "", "deep", "x"] and all(r.n_chars == len(r.text) for r in got)


BODY = "".join(f"<p>Sentence number {i} of the article says a little more than the one before it.</p>" for i in range(20))
PLAIN_BODY = "\n".join(f"Sentence number {i} of the article says a little more than the one before it." for i in range(20))


@pytest.mark.parametrize(
    "page",
    [
        f"<div class='post'>{BODY}</div><article class='comment'>First! nice post</article><article class='comment'>commenter words here.</article>",
        f"<div id='content'>{BODY}</div><article><h2>Teaser one</h2><p>short teaser</p></article>",
        f"<main>{BODY}<div class='comments'><article>I think so too</article></div></main>",
        f"<main>{BODY}<ol class='comment-list'><li><article class='comment-body'>I think so too</article></li></ol></main>",
        f"<div class='with-sidebar'><div class='sidebar'>side text, side text</div><div class='entry'>{BODY}</div></div><div class='related-posts'>other things</div>",
        f"<nav>menu</nav><table><tr><td>{BODY}</td><td class='ads'>buy this</td></tr></table><footer>foot</footer>",
    ],
)
def test_pages_of_common_markup(page):
    assert html_text.main_text(f"<html><body>{page}</body></html>") == PLAIN_BODY


def test_parts_of_an_article_stay_whatever_their_class():
    page = f"<body><article>{BODY}<div class='related-work'><p>Earlier studies.</p></div><div class='share-buttons'>Share</div></article></body>"
    assert html_text.main_text(page) == PLAIN_BODY + "\nEarlier studies."


def plain_density(page, alive):
    """Density sums straight from the definition, walking the tree anew for every element."""
    n = len(page.tag)
    kids = [[j for j in range(1, n) if page.parent[j] == i and alive[j]] for i in range(n)]

    def under(i):
        return [i] + [x for k in kids[i] for x in under(k)]

    def linked(i):
        return page.tag[i] == "a" or (i > 0 and linked(page.parent[i]))

    own = collections.Counter()
    for node, _, text in page.runs:
        if alive[node]:
            own[node] += len("".join(text.split()))
    whole = sum(own[x] for x in under(0))
    whole_links = sum(own[x] for x in under(0) if linked(x))

    def density(i):
        inside = under(i)
        c, t = sum(own[x] for x in inside), max(len(inside) - 1, 1)
        lc, lt = sum(own[x] for x in inside if linked(x)), sum(page.tag[x] == "a" for x in inside[1:])
        if not c:
            return 0.0
        base = np.log(c / max(c - lc, 1) * lc + whole_links / max(whole, 1) * c + np.e)
        if base <= 1 + 1e-9:
            return c / t
        return c / t * max(np.log(c / max(lc, 1) * t / max(lt, 1)), 0.0) / np.log(base)

    return [density(i) if alive[i] else 0.0 for i in range(n)], [sum(density(k) for k in kids[i]) if alive[i] else 0.0 for i in range(n)]


def test_densities_against_the_definition():
    rng = random.Random(7)
    for _ in range(60):
        def part(depth):
            if depth == 0 or rng.random() < 0.3:
                return " ".join("word" * rng.randrange(1, 3) for _ in range(rng.randrange(6)))
            tag = rng.choice(["div", "p", "a", "span", "section", "nav", "article", "ul"])
            return f"<{tag}>" + "".join(part(depth - 1) for _ in range(rng.randrange(4))) + f"</{tag}>"

        page = html_text.Page("<body>" + "".join(part(4) for _ in range(4)) + "</body>")
        alive = html_text._alive(page)
        density, total = html_text.densities(page, alive)
        want, sums = plain_density(page, alive)
        assert np.allclose(density, want) and np.allclose(total, sums)


def test_stages(spark, docs, none, tmp_path):
    spark.createDataFrame([(1, "two words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs, none):
            out = stage(spark, table, str(tmp_path))
            assert out.count() <= table.count(), name
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name


def test_arrow_slices_are_read_from_their_place():
    from granary.llm.text import Texts, Words

    column = pa.array(["a b", None, "", "c d e", "f"]).slice(2)
    words = Words(Texts(column))
    assert words.counts().tolist() == [0, 3, 1]
