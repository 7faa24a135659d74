"""The language model, vector groups, components and the pipeline, against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, ngram, nndescent

from .test_text_operators import LONG, check_packing, components_by_force, words_of


# Elias-Fano and the trie ------------------------------------------------------------------------


def test_elias_fano():
    rng = np.random.default_rng(0)
    for n, top in ((0, 5), (1, 1), (1, 1 << 50), (1000, 1000), (5000, 1 << 40), (777, 800)):
        values = np.sort(rng.integers(0, top, n)).astype(np.uint64)
        ef = ngram.EliasFano.build(values, top)
        assert (ef.get(np.arange(n)) == values).all()
        if n:
            ask = rng.integers(0, top, 200).astype(np.uint64)
            lo = rng.integers(0, n, 200)
            hi = np.minimum(n, lo + rng.integers(0, n + 1, 200))
            want = [l + int(np.searchsorted(values[l:h], a)) for a, l, h in zip(ask, lo, hi)]
            assert ef.successor(ask, lo, hi).tolist() == want


def test_sequences_of_several_shares_map_from_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    parts = [np.unique(rng.integers(0, top, n)).astype(np.uint64) for n, top in ((700, 1 << 40), (0, 9), (90, 100), (5000, 1 << 62), (1, 5))]
    kind = ngram.Kind(("x",), {"y": "<u2"})
    metas = {i: ngram.write_share(str(tmp_path), i, {"x": ngram.EliasFano.build(v, (5 if i == 4 else 9 if i == 1 else 100 if i == 2 else 1 << 62))}, {"y": v.astype("<u2")}) for i, v in enumerate(parts) if i != 1}
    ngram.put_together(spark, str(tmp_path), kind, len(parts), metas)
    found, more = ngram._mapped(str(tmp_path), kind.sequences, tuple(kind.more.items()))
    ef, y = found["x"], more["y"]
    assert isinstance(ef.low.base.base if not isinstance(ef.low.base, np.memmap) else ef.low.base, np.memmap) and not list(tmp_path.glob("*.part"))
    share = np.repeat(np.arange(len(parts)), [len(v) for v in parts])
    flat = np.concatenate(parts)
    assert (ef.get(np.arange(len(flat)), share) == flat).all() and (y == flat.astype("<u2")).all()
    assert (ef.find(flat, ef.begin[share], ef.begin[share + 1], share) == np.arange(len(flat))).all()
    missing = np.setdiff1d(rng.integers(0, 1 << 62, 500).astype(np.uint64), parts[3])
    s = np.full(len(missing), 3)
    assert (ef.find(missing, ef.begin[s], ef.begin[s + 1], s) == -1).all()


def scores_by_force(rows, mu):
    train, pairs, triples, texts = Counter(), Counter(), Counter(), 0
    for text, held in rows:
        if not held:
            w = [*words_of(text), None]
            p = ["<s>", "<s>", *w]
            train.update(w)
            pairs.update(zip(p[1:], w))
            triples.update(zip(p, p[1:], w))
            texts += 1
    n, v = sum(train.values()), len(train)
    p1 = lambda w: (train[w] + 0.5) / (n + 0.5 * (v + 1))
    p2 = lambda h, w: (pairs[h, w] + mu[0] * p1(w)) / ((texts if h == "<s>" else train[h]) + mu[0])
    p3 = lambda g, h, w: (triples[g, h, w] + mu[1] * p2(h, w)) / ((texts if h == "<s>" else pairs[g, h]) + mu[1])
    out = []
    for text, _ in rows:
        w = [*words_of(text), None]
        p = ["<s>", "<s>", *w]
        out.append((len(w), sum(train[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), sum(math.log10(p3(*x)) for x in zip(p, p[1:], w))))
    return out


@pytest.mark.parametrize("share, chunk, vocabulary, mu", [(50, 64, 8, (100.0, 3.0)), (100_000, 2_000_000, 1 << 20, ngram.MU)])
def test_scores(spark, monkeypatch, share, chunk, vocabulary, mu):
    """Many small shares, hot words and hot pairs, and texts longer than a chunk; and none of these."""
    monkeypatch.setattr(ngram, "CHUNK", chunk)
    monkeypatch.setattr(ngram, "VOCABULARY", vocabulary)
    monkeypatch.setattr(ngram, "CHUNK_BYTES", chunk * 4)
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(["the", "The", "a", "x", "of the", "of the", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(30)))
    rows = [(text(), i % 5 == 1) for i in range(80)] + [(None, False), ("", True), ("never seen words", True), ("a\x1cb  \t c", False), (" ".join(f"z{i % 700} the" for i in range(1500)), False), (LONG[:9000], False)]
    rows += [rows[3]] * 3
    df = spark.createDataFrame([(i, t, h, "x") for i, (t, h) in enumerate(rows)], "doc_id long, text string, held_out boolean, batch string").repartition(3)
    if share == 50:
        corpus = ngram.corpus_of(df, share)
        assert len(corpus.hot) > 2 and corpus.bits > 3 and max(corpus.ways) > 5
    got = {r.doc_id: r for r in ngram.score(df, mu, share).collect()}
    for i, (n, known, total, base, model) in enumerate(scores_by_force(rows, mu)):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, rows[i][1])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(model, abs=4e-4 * n)


def test_held_out_scores(spark):
    rows = [r for r in ngram.op8_ngram_trie_scores(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) / sum(r.n_tokens for r in rows) > -3.4


def test_scores_without_rows(spark):
    df = spark.createDataFrame([(1, "a b", True)], "doc_id long, text string, held_out boolean")
    r = ngram.score(df).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and ngram.score(df.limit(0)).count() == 0
    assert ngram.score(spark.createDataFrame([(None, None, False)], df.schema)).first().n_known == 1


# Components and vectors -------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(500 + i, 501 + i) for i in range(60)] + [(900, 1000 + i) for i in range(50)]
    label = {}
    for a, b in edges:
        label.setdefault(a, a)
        label.setdefault(b, b)
    for a, b in edges:
        x, y = label[a], label[b]
        for k, v in label.items():
            if v in (x, y):
                label[k] = min(x, y)
    loose = {a for a, b in edges if a == b}
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[k] == v for k, v in label.items() if k in got) and set(label) - set(got) <= loose
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def links_by_force(vectors, threshold):
    x = np.array(vectors)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    label = list(range(len(x)))
    for i, j in zip(*np.nonzero(near)):
        a, b = label[i], label[j]
        if a != b:
            label = [min(a, b) if v in (a, b) else v for v in label]
    return near.sum(1).tolist(), label


def test_vector_groups(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 16))
    rows = [*rng.normal(size=(150, 16)), *(c + 0.08 * rng.normal(size=16) for c in centres for _ in range(25))]
    rows = [r.tolist() for r in rows]
    rows += [rows[160]] * 9 + [[3 * v for v in rows[10]], [1e-200 * v for v in rows[10]]]
    n_links, label = links_by_force([r if abs(r[0]) > 1e-150 else [v * 1e200 for v in r] for r in rows], 0.95)
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [float("inf")] * 16, [1.0, 2.0], [], [0.0] * 3000 + [1.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows + odd)], "id long, vector array<double>").withColumn("x", F.lit(1))
    got = {r.id: r for r in nndescent.vector_groups(df).collect()}
    assert [got[i].n_links for i in range(len(rows))] == n_links
    assert [got[i].component for i in range(len(rows))] == label
    assert all((got[i].n_links, got[i].component) == (0, i) for i in range(len(rows), len(rows) + len(odd)))
    assert nndescent.vector_groups(df.limit(0)).count() == 0
    assert [tuple(r) for r in nndescent.vector_groups(df.where("id = 0")).collect()] == [(0, 0, 0)]


def test_audit_doubles_lists(spark):
    """With lists of one the groups are found only after the audit has enlarged them."""
    rng = np.random.default_rng(3)
    centre = rng.normal(size=8)
    rows = [(i, (centre + 0.05 * rng.normal(size=8)).tolist()) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = nndescent.vector_groups(df, k=1, rounds=1).collect()
    n_links, label = links_by_force([v for _, v in rows], 0.95)
    assert sum(r.component == label[r.id] for r in got) / 60 >= 0.9


def tight_groups(rng, cosines, size, dims=64):
    """Groups of near copies (cosine about 0.998) around centres of the given cosines to the first."""
    base = np.linalg.qr(rng.normal(size=(dims, len(cosines) + 1)))[0].T
    centres = [c * base[0] + math.sqrt(1 - c * c) * base[i + 1] for i, c in enumerate(cosines)]
    return [(c + 0.004 * rng.normal(size=dims)).tolist() for c in centres for _ in range(size)]


def test_saturated_groups_find_each_other(spark, monkeypatch):
    """Two tight groups that link only with each other, found without the audit's help."""
    monkeypatch.setattr(nndescent, "CHUNK", 50)
    rng = np.random.default_rng(8)
    rows = tight_groups(rng, [1.0, 0.965, 0.3], 60) + rng.normal(size=(100, 64)).tolist()
    n_links, label = links_by_force(rows, 0.95)
    assert len({*label[:120]}) == 1 and min(n_links[:120]) > 60 and label[120] == 120
    df = spark.createDataFrame(list(enumerate(rows)), "id long, vector array<double>")
    got = {r.id: r for r in nndescent.vector_groups(df, recall=0.0).collect()}
    assert [got[i].component for i in range(len(rows))] == label
    assert [got[i].n_links for i in range(len(rows))] == n_links


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(10)
    rows = [v[:d] for d in (5, 5, 5, 9, 9) for v in (rng.normal(size=9).tolist(),)]
    rows += [[2 * x for x in rows[0]], [x + 1e-3 for x in rows[3]], [x + 1e-3 for x in rows[4]], rows[1]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)] + [(1, rows[2])], "id long, vector array<float>")
    got = sorted((r.id, r.n_links, r.component) for r in nndescent.vector_groups(df).collect())
    # Two rows have id 1: one is a copy of row 8, the other of row 2.
    assert got == [(0, 1, 0), (1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 4), (5, 1, 0), (6, 1, 3), (7, 1, 4), (8, 1, 1)]


def test_links_of_groups_of_many_sizes(spark):
    """Thousands of links, in pairs and in groups up to hundreds, loose and tight: nearly all pairs and all components."""
    rng = np.random.default_rng(11)
    rows = []
    for size, spread in ((2, 0.02), (3, 0.025), (5, 0.02), (12, 0.02), (40, 0.015), (90, 0.01), (300, 0.008)):
        for _ in range(max(1, 120 // size)):
            centre = rng.normal(size=64)
            centre /= np.linalg.norm(centre)
            rows += (centre + spread * rng.normal(size=(size, 64))).tolist()
    rows += rng.normal(size=(900, 64)).tolist()
    rows = [rows[i] for i in rng.permutation(len(rows))]
    rows += [rows[5]] * 400  # a class of copies
    n_links, label = links_by_force(rows, 0.95)
    df = spark.createDataFrame(list(enumerate(rows)), "id long, vector array<double>")
    got = {r.id: r for r in nndescent.vector_groups(df).collect()}
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert (found <= n_links).all() and sum(n_links) > 20_000 and found.sum() >= 0.999 * sum(n_links)
    linked = [i for i, n in enumerate(n_links) if n]
    assert sum(got[i].component == label[i] for i in linked) >= 0.999 * len(linked)


def test_audit_counts_vectors(spark):
    """A large whole group beside isolated pairs that were missed: each vector counts once, and draws count for their pool."""
    rng = np.random.default_rng(9)
    x = np.array(tight_groups(rng, [1.0], 150) + [v for _ in range(20) for v in tight_groups(rng, [1.0], 2)] + rng.normal(size=(400, 64)).tolist())
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, 1, v.tobytes(), 149 if i < 150 else 0, i < 150, False) for i, v in enumerate(x)]
    classes = spark.createDataFrame(rows, "m long, copies long, unit binary, links long, near boolean, dense boolean")
    assert nndescent.audit(classes, 64, 0.95) == pytest.approx(150 / 190)
    assert nndescent.audit(classes, 64, 0.95, most=100) == pytest.approx(150 / 190, abs=0.12)
    assert nndescent.audit(classes.withColumn("dense", F.col("m") < 150), 64, 0.95) == 0.0
    assert nndescent.audit(classes.where("m >= 190"), 64, 0.95) == 1.0


# The pipeline -----------------------------------------------------------------------------------


def clashing(spark, docs, rows):
    """Rows in the columns of documents, with more columns whose names the operators use."""
    df = spark.createDataFrame(rows, docs.schema)
    more = {"id": 1, "component": "x", "score": 0.5, "held_out": True, "line": 3, "coverage": "y", "n_lines": 7, "row": 1, "piece": 2, "length": 9, "offset": 0, "grp": 1}
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


def odd_rows():
    long = " ".join(f"w{i % 5000}x{i}" for i in range(60_000))
    rows = [(None, None, None, None, None), (None, "", None, None, 0), (3, None, "en", "a", None), (4, "", "en", "a", 0), (5, "12 34", None, None, 5), (6, long, "en", "b", len(long)), (6, long, "en", "b", len(long))]
    rows += [(7, "same words in a short text here", "en", "a", 31), (7, "same words in a short text here", "en", "a", 31), (8, "same words in a short text here", "de", "b", 31), (None, "same words in a short text here", "de", "b", 31)]
    return rows + [(100 + i, f"a shared line\nown line {i}", "en", f"site{i}", 20) for i in range(12)] + [(None, "a shared line", "en", "other", 13)]


def test_stages_meet_odd_rows(spark, sf_dir):
    """Every stage by itself on nulls, empty and very long texts, ties, repeated rows, clashing columns and no rows at all."""
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = odd_rows()
    df = clashing(spark, docs, rows)
    stages = dict(pipeline.STAGES)
    for name, stage in stages.items():
        empty = stage(spark, df.limit(0), sf_dir)
        assert empty.count() == 0 and (name == "best_fit_packing" or empty.columns == list(pipeline.COLUMNS))
    ids = lambda name: sorted((-1 if r.doc_id is None else r.doc_id for r in stages[name](spark, df, sf_dir).collect()))
    every = sorted(-1 if r[0] is None else r[0] for r in rows)
    # Language: what has no letters goes, the rest is learned from these rows and stays.
    assert not {3, 4, 5} & set(ids("language_id")) and {6, 7, 8} <= set(ids("language_id"))
    cleaned = stages["line_dedup"](spark, df, sf_dir).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in cleaned) == every
    by_id = {r.doc_id: r for r in cleaned if r.doc_id}
    assert by_id[100].text == "a shared line\nown line 0" and all((by_id[100 + i].text, by_id[100 + i].n_chars) == (f"own line {i}", len(f"own line {i}")) for i in range(1, 12))
    assert "a shared line" in {r.text for r in cleaned if r.doc_id is None} and by_id[3].text is None and by_id[4].text == ""
    gone = [8]
    label, _ = components_by_force([r[1] for r in rows if r[0] is not None])
    known = [r[0] for r in rows if r[0] is not None]
    least = {k: min(known[i] for i, x in enumerate(label) if x == k) for k in set(label)}
    want = [i for i, k in zip(known, label) if least[k] == i] + [-1] * sum(r[0] is None for r in rows)
    assert ids("minhash_near_dedup") == sorted(want) and not set(gone) & set(want)
    assert ids("benchmark_decontamination") == every
    packed = stages["best_fit_packing"](spark, df, sf_dir).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows) and check_packing(packed) > 0


def covered_by_force(texts, items, width=5, threshold=0.5):
    """Which texts cover an item, with tiles by the slow way."""
    from .test_text_operators import greedy_by_force

    found = []
    for text in texts:
        w = words_of(text)
        grams = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        near = [x for x in items if any(tuple(x[i : i + width]) in grams for i in range(len(x) - width + 1))]
        found.append(any(greedy_by_force(x, w, width) >= threshold * len(x) for x in near))
    return found


def test_pipeline_stages_by_force(spark, sf_dir):
    """Line removal and decontamination of the pipeline against brute force, on its own input."""
    pipeline = pytest.importorskip("corpus_pipeline")
    from .test_text_operators import lines_by_force

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    cleaned = {r.doc_id: r.text for r in pipeline.without_spread_lines(spark, docs, sf_dir).collect()}
    assert cleaned == lines_by_force(rows, 10)
    items = [words_of(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    short = [r for r in rows if len(words_of(r[1])) < 400]
    stay = {r.doc_id for r in pipeline.without_benchmark(spark, docs, sf_dir).collect()}
    assert [i not in stay for i, _, _ in short] == covered_by_force([t for _, t, _ in short], [x for x in items if len(x) >= 5])


def test_pipeline(spark, sf_dir):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(10**9, None, None, None, None), (10**9 + 1, "", "en", "a", 0), (10**9 + 2, "12 34", "en", "a", 5)], docs.schema)
    now = docs.unionByName(odd)
    counts = []
    for name, stage in pipeline.STAGES[:-1]:
        before, now = now, pipeline.kept(stage(spark, now, sf_dir), name)
        counts.append(now.count())
        assert now.columns == list(pipeline.COLUMNS)
        if name == "language_id":
            assert counts[0] == docs.count()  # every document of the table has a language; the odd ones go
        if name == "minhash_near_dedup":
            rows = sorted(before.collect(), key=lambda r: r.doc_id)
            label, _ = components_by_force([r.text for r in rows])
            want = {rows[i].doc_id for i, k in enumerate(label) if i == k}
            assert {r.doc_id for r in now.collect()} == want
        if name == "benchmark_decontamination":
            assert counts[-1] <= counts[-2]
    packed = pipeline.STAGES[-1][1](spark, now, sf_dir).collect()
    total = sum(r.length for r in packed)
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()} and check_packing(packed) <= -(-total // 2048) + 1
    assert all(r.ids_crc32 < 1 << 32 for r in packed) and zlib.crc32(b"") == 0
    assert pa.__version__
