"""Operators on whole texts: edge cases of each, and brute force where SQL cannot say it."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import hilbert, langid, licenses, line_dedup, minhash, packing, textcore, tiling, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30000


def docs(spark, texts, more=None):
    rows = [(i, t, "en", f"s{i % 12}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + (more or []), DOCS)


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# The tokeniser that the others share ----------------------------------------------------------


def test_words_agree_with_regular_expressions():
    rng = random.Random(0)
    texts = [None, "", " ", "a", "A b", "\tx\n", "é ß 中文 x", "a\x1cb", "x" * 999] + ["".join(rng.choice("aB é\n\t.,1") for _ in range(rng.randrange(60))) for _ in range(200)]
    for kind, pattern in ((textcore.BLANK_WORDS, "[^\x20\x09-\x0d]+"), (textcore.ALNUM_WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        w = textcore.Words(pa.array(texts, pa.string()), kind)
        got = [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end)]
        lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), t or "") for t in texts]
        want = [x for t in lowered for x in re.findall(pattern, t)]
        assert got == want and w.counts.tolist() == [len(re.findall(pattern, t)) for t in lowered]
        assert len(set(w.hash.tolist())) == len(set(want))
    pieces = [(at, len(c)) for at, c in textcore.slices(pa.array(texts, pa.string()), 50)]
    assert pieces[0][0] == 0 and sum(n for _, n in pieces) == len(texts)


# License scans ---------------------------------------------------------------------------------


def test_license_scan(spark):
    texts = [None, "", "no words here", "Released under the MIT License.", "this work is licensed under the GNU General Public License, version 3", "MIT-license mit license", "Apache  License", "licensed under the Apache License, Version 2.0.", "under the mit licenses", LONG + "mit license"]
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts + ["mit license"]).withColumn("labels", F.lit(1))).collect()}
    assert (rows[0].n_words, rows[0].first_word, rows[0].labels, rows[0].score) == (0, None, "", 0.0) and rows[1].n_words == 0
    assert rows[3].labels == "mit,mit-notice" and rows[3].base_labels == "mit" and rows[3].score == 1.0
    assert rows[4].labels == "gpl,gpl-3.0,gpl-notice" and [s.label for s in rows[4].spans if s.start == 0] == ["gpl-notice"]
    assert (rows[5].n_base, rows[5].first_word, rows[5].last_word) == (2, 0, 2)
    assert rows[6].base_labels == "apache" and rows[6].score == 0.5
    assert rows[7].labels == "apache,apache-2.0" and rows[8].labels == ""
    assert rows[9].first_word == 30000 and rows[9].n_words == 30002 and rows[10].n_base == 1
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


def license_text(template, names="The Example Authors"):
    """A template's wording with titles left out and names filled in."""
    text = re.sub(r"<<var;[^<>]*>>", names, template)
    while "<<beginOptional>>" in text:
        text = re.sub(r"<<beginOptional>>((?!<<beginOptional>>).)*?<<endOptional>>", "", text, flags=re.S)
    return text


def test_whole_licenses(spark):
    rng = random.Random(14)
    good = {x: license_text(t, "it").upper() for x, t in licenses.LICENSES.items()}
    texts, want = [], []
    for label, text in good.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
        texts.append(f"Preface.\n{text}\n\nprint(1)")
        want.append(True)
        for _ in range(6):  # a word left out, changed, or put in
            k = rng.randrange(3, len(words) - 8)
            how = rng.randrange(3)
            changed = words[:k] + ([] if how == 0 else ["never"] if how == 1 else [words[k], "never"]) + words[k + 1 :]
            texts.append(" ".join(changed))
            want.append(bool(re.search(licenses.template_pattern(licenses.LICENSES[label]) + " ", " " + " ".join(changed).lower() + " ")))
    assert sum(want) < len(good) + 12
    labels = [x for x in good for _ in range(7)]
    rows = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, texts)).collect()}
    assert [labels[i] in rows[i].labels.split(",") for i in range(len(texts))] == want
    start = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"
    altered = licenses.scan_licenses(docs(spark, [start + ". No one may sell or copy it. Warranty: full.", "All rights reserved.", start])).collect()
    assert [(r.labels, r.score) for r in sorted(altered)] == [("", 0.0), ("all-rights-reserved", 0.25), ("", 0.0)]


def test_automata_agree_with_regular_expressions():
    rng = random.Random(13)
    shapes = ["a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;name=x;match=2>> d", "<<beginOptional>>a <<var;name=x;match=3>><<endOptional>> b a", "a <<var;name=x;match=1>> <<beginOptional>>b<<endOptional>> a", *licenses.NOTICES.values()]
    for shape in shapes:
        automaton, pattern = licenses.compile_template(shape), re.compile(licenses.template_pattern(shape) + " ")
        pool = sorted({*re.findall("[a-z0-9]+", re.sub("<<[^<>]*>>", "", shape)), "z"})
        for _ in range(300):
            words = [rng.choice(pool) for _ in range(rng.randrange(1, 14))]
            if rng.random() < 0.5:
                words += license_text(shape, "z").split()
            assert any(automaton.match(words, i) > i for i in range(len(words))) == bool(pattern.search(" " + " ".join(words) + " "))


def test_op2_matches_sql(spark, duck, sf_dir):
    df = licenses.op2_license_scan(spark, sf_dir)
    found = duck.execute(licenses.ORACLE_SQL)
    assert [d[0] for d in found.description] == df.columns and sorted(map(tuple, df.collect())) == sorted(found.fetchall())


def test_template_automata():
    a = licenses.compile_template("one <<beginOptional>>two <<beginOptional>>three<<endOptional>><<endOptional>> <<var;name=x;match=2>> four")
    accepts = lambda text: a.match(text.split(), 0) == len(text.split())
    assert all(map(accepts, ["one four", "one two four", "one two three four", "one two three p q four", "one p four"]))
    assert not any(map(accepts, ["one", "one three p q r four", "two four", "one two three p q r four"]))
    for bad in ("<<beginOptional>>a", "a <<endOptional>>", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.compile_template(bad)


# Sharding --------------------------------------------------------------------------------------


def skilling(coords, bits):
    """Place on the Hilbert curve, step by step."""
    x, n = list(coords), len(coords)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = 2 * out + (v >> b & 1)
    return out


def test_hilbert_index(spark):
    for n, bits in ((2, 3), (3, 2), (4, 1), (1, 3)):
        df = spark.range(1 << (n * bits)).select(*[F.shiftright("id", bits * i).bitwiseAND((1 << bits) - 1).alias(f"c{i}") for i in range(n)])
        rows = df.withColumn("h", hilbert.hilbert_index([F.col(f"c{i}") for i in range(n)], bits)).collect()
        assert all(r.h == skilling(r[:n], bits) for r in rows)
        path = [r[:n] for r in sorted(rows, key=lambda r: r.h)]
        assert [r.h for r in sorted(rows, key=lambda r: r.h)] == list(range(1 << (n * bits)))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for p, q in zip(path, path[1:]))  # neighbours touch


def test_hilbert_shards(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, "en", "de"]), rng.choice(["src0", "src0", "src0", "src7"]), rng.randrange(99)) for i in range(1001)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, lang string, source string, size long")
    dims = {c: F.col(c) for c in ("lang", "source", "size", "doc_id")}
    got = hilbert.hilbert_shards(df, dims, ["doc_id", "size"], 8, part_rows=64).collect()
    assert len(got) == 1004
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append((r.slot, r.curve))
    assert sorted(len(v) for v in slots.values()) == [125] * 4 + [126] * 4 and sorted(slots) == list(range(8))
    assert all([s for s, _ in sorted(v)] == list(range(len(v))) for v in slots.values())
    order = [c for k in sorted(slots) for _, c in sorted(slots[k])]
    assert order == sorted(order)
    assert hilbert.hilbert_shards(df.limit(0), dims, ["doc_id"], 8).count() == 0


def test_op3_matches_sql(spark, duck, sf_dir):
    df = hilbert.op3_hilbert_sharding(spark, sf_dir)
    found = duck.execute(hilbert.ORACLE_SQL)
    assert [d[0] for d in found.description] == df.columns and sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))


def test_op3_contract(spark, sf_dir):
    rows = hilbert.op3_hilbert_sharding(spark, sf_dir).collect()
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(source)
    for r in rows:
        text = (source[r.doc_id] or "").encode()
        assert r.size == len(text) + 1 and r.text_crc32 == zlib.crc32(text)


# Language identification -----------------------------------------------------------------------


def test_language_id(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r.doc_id: r for r in langid.op4_language_id(spark, sf_dir).collect()}
    true = {r.doc_id: r.lang for r in table.collect()}
    assert set(got) == set(true) and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].lang_pred == true[i] for i in held) / len(held) > 0.95
    model = langid.train(table)
    odd = docs(spark, [None, "", "123 !!! \n", "the", LONG], [(None, "the and of", None, None, None)]).withColumn("score", F.lit(9))
    rows = langid.classify(odd, model).collect()
    assert [r.lang_pred for r in rows[:3]] == ["und"] * 3 and all(r.score == 0 for r in rows[:3])
    assert rows[3].lang_pred in model.labels and rows[5].doc_id is None and rows[5].held_out is False
    assert langid.classify(odd.limit(0), model).count() == 0
    assert langid.train(odd.limit(0)) is None and {r.lang_pred for r in langid.classify(odd, None).collect()} == {"und"}


def test_language_scores_by_force(spark):
    """Every score and label of a small table, from n-gram sets and one dense solution."""
    rng = random.Random(15)
    vocabulary = {x: ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(60)] for x, letters in (("aa", "abcdeé"), ("bb", "cdefgß"), ("cc", "efghij"))}
    rows = [(i, " ".join(rng.choices(vocabulary[x], k=rng.randrange(1, 30))), x) for i in range(240) for x in [rng.choice(list(vocabulary))]]
    df = spark.createDataFrame([(i, t, x if i % 7 else None) for i, t, x in rows] + [(None, rows[3][1], "aa"), (7, rows[7][1], None)], "doc_id long, text string, lang string").withColumn("code", F.lit(1))
    model = langid.train(df, 20)
    train = [(i, t, x) for i, t, x in rows if i % 7 and zlib.crc32(str(i).encode()) % 5]
    order = {r.doc_id: (r.h, r.doc_id) for r in df.select("doc_id", F.xxhash64("doc_id", F.lit(17)).alias("h")).collect() if r.doc_id is not None}
    own = sorted(r for x in vocabulary for r in sorted((r for r in train if r[2] == x), key=lambda r: order[r[0]])[:20])
    grams = lambda t: {b[i : i + k] for b in [t.lower().encode()] for k in (1, 2, 3) for i in range(len(b) - k + 1)}
    kernel = lambda a, b: np.array([[len(x & y) / max(1, len(x) * len(y)) ** 0.5 for y in b] for x in a])
    got = {r.doc_id: r for r in langid.classify(df, model).collect()}
    assert model.labels == ["aa", "bb", "cc"]
    sets = [grams(t) for _, t, _ in own]
    marks = [g for x in model.labels for g in [s for s, (_, _, y) in zip(sets, own) if y == x][: langid.LANDMARKS // 3]]
    among = kernel(marks, marks)
    value, vector = np.linalg.eigh(among)
    solid = value > value.max() * 1e-9
    root = vector[:, solid] / np.sqrt(value[solid])
    x, y = kernel(sets, marks) @ root, np.array([[float(r[2] == k) for k in model.labels] for r in own])
    centred = x - x.mean(0)
    w = np.linalg.solve(centred.T @ centred + langid.RIDGE * len(own) * np.eye(x.shape[1]), centred.T @ (y - y.mean(0)))
    s = (kernel([grams(t) for _, t, _ in rows], marks) @ root - x.mean(0)) @ w + y.mean(0)
    for (i, _, _), line in zip(rows, s):
        share = np.clip(line, 0, None)
        assert got[i].score == pytest.approx(share[line.argmax()] / share.sum(), abs=2e-3) and got[i].lang_pred == model.labels[line.argmax()]
    assert got[None].lang_pred == got[3].lang_pred


def test_kernel_is_shared_grams_over_geometric_mean():
    texts = ["abab", "abc", "xyz!", "ABAB"]
    model = langid.fit(texts, ["a", "a", "b", "b"], landmarks=4)
    grams = lambda t: {t.lower()[i : i + k] for k in (1, 2, 3) for i in range(len(t) - k + 1)}
    chosen = ["abab", "abc", "xyz!", "ABAB"]
    want = [[len(grams(t) & grams(c)) / (len(grams(t)) * len(grams(c))) ** 0.5 for c in chosen] for t in texts]
    assert np.allclose(model.kernel(pa.array(texts), model.table()), want, atol=1e-6)


# MinHash near-duplicates -----------------------------------------------------------------------


def components_by_force(texts, width=5, percent=75):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label, [len(s) for s in sets]


def test_near_components(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", "  \n", "one two", "One  TWO", "one two three"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 160))]
        texts.append(" ".join(base))
        for _ in range(rng.randrange(6)):
            copy = list(base)
            for _ in range(rng.randrange(1, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [texts[10]] * 4
    want, sizes = components_by_force(texts)
    df = docs(spark, texts).select(F.col("doc_id").alias("id"), "text")
    got = {r.id: r for r in minhash.near_components(df).collect()}
    assert [got[i].n_shingles for i in range(len(texts))] == sizes
    assert [got[i].component for i in range(len(texts))] == want


def test_near_components_of_a_chain(spark):
    """A chain whose ends are far apart is one group; one hub cannot see all of it."""
    words = [f"w{i}" for i in range(260)]
    texts = [" ".join(words[8 * k : 8 * k + 120]) for k in range(12)]
    want, _ = components_by_force(texts)
    got = {r.id: r.component for r in minhash.near_components(docs(spark, texts).select(F.col("doc_id").alias("id"), "text")).collect()}
    assert want == [0] * 12 and [got[i] for i in range(12)] == want


def test_near_components_of_equal_ids(spark):
    """Rows of one id and different texts are compared each."""
    rng = random.Random(12)
    a, b = (" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(2))
    df = spark.createDataFrame([(5, a), (5, b), (7, a + " x"), (8, b + " y"), (9, "z")], "id long, text string")
    assert sorted((r.id, r.component) for r in minhash.near_components(df).collect()) == [(5, 5), (5, 5), (7, 5), (8, 5), (9, 9)]


def test_very_long_texts_have_all_their_runs(spark, monkeypatch):
    """More runs in a range of hashes than 16 bits count."""
    monkeypatch.setattr(minhash, "RANGE_BITS", 1)
    words = [f"w{i}" for i in range(150_000)]
    texts = [" ".join(words), " ".join(words[:140_000]), " ".join(words[60_000:])]
    df = docs(spark, texts).select(F.col("doc_id").alias("id"), "text")
    parts = [np.frombuffer(r.parts, np.uint32) for r in minhash.set_table(df).collect()]
    assert all(p.max() > 1 << 16 for p in parts[:2]) and [p.sum() for p in parts] == [149_996, 139_996, 89_996]
    assert [r.component for r in minhash.near_components(df, hub_rounds=0).orderBy("id").collect()] == [0, 0, 2]


def test_keep_one(spark):
    df = docs(spark, ["a b c d e f", None, "a b c d e f", "z", ""], [(None, "a b c d e f", None, None, None), (3, "z", "en", "x", 1)]).withColumn("component", F.lit("own"))
    got = minhash.keep_one(df)
    assert got.columns == df.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in got.collect()) == [-1, 0, 1, 3, 3, 4]
    assert minhash.keep_one(df.limit(0)).count() == 0


# Packing ---------------------------------------------------------------------------------------


def check_packing(rows, capacity=packing.CAPACITY):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    rng = random.Random(5)
    end = "<|endoftext|>"
    texts = [end, f"in{end}side", f"{end}{end}", f" {end} ", f"a\n{end}\tb  {end}", f"hi {end} there", f"<|endoftext <|endoftext|", end * 3000]
    texts += [None, "", " a  b \n\n c <|endoftext|>", "x", "x", "é 中 it's 's\t\n  1234 ..  ", LONG] + ["".join(rng.choice("ab c \n1.'sé") for _ in range(rng.randrange(80))) for _ in range(150)]
    df = docs(spark, texts).withColumn("offset", F.lit(0))
    rows = packing.pack(packing.token_pieces(df, path)).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*plain.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted(by[i], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and sum(p.length for p in parts) == len(ids)
        assert all(p.length == 2048 for p in parts[1:]) and (len(ids) > 2048 or len(parts) == 1)
        for p in parts:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    total = sum(r.length for r in rows)
    assert check_packing(rows) == -(-total // 2048)
    assert packing.pack(packing.token_pieces(df.limit(0), path)).count() == 0


def test_swap_search_never_loses_and_helps():
    rng = random.Random(6)
    for _ in range(30):
        lengths = [rng.randrange(1, 60) for _ in range(rng.randrange(1, 80))]
        start = [[i] for i in range(len(lengths))]
        rng.shuffle(start)
        out = packing.swap_search(start, lengths, 100)
        assert sorted(i for b in out for i in b) == list(range(len(lengths))) and max(sum(lengths[i] for i in b) for b in out) <= 100
        assert len(out) <= len(start)
        fit = packing.pack_group(lengths, 100)
        assert sorted(i for b in fit for i in b) == list(range(len(lengths))) and len(fit) <= len(packing.best_fit(lengths, 100))
    # Sets of underfull bins that do not fit in one search are searched too.
    lengths = [rng.randrange(300, 900) for _ in range(900)]
    fit = packing.pack_group(lengths, 2048, scan=40)
    assert sorted(i for b in fit for i in b) == list(range(900)) and max(sum(lengths[i] for i in b) for b in fit) <= 2048 and len(fit) <= len(packing.best_fit(lengths, 2048))
    # Best fit leaves three bins where exchanges need two.
    lengths = [6, 5, 5, 4, 4, 4, 2]
    assert len(packing.swap_search([[0, 3], [1, 2], [4, 5, 6]], lengths, 15)) == 2


# Decontamination -------------------------------------------------------------------------------


def test_tiling(spark):
    item = " ".join(f"q{i}" for i in range(30))
    w = item.split()
    swapped = " ".join(["pad"] * 7 + w[15:] + ["x"] + w[:15] + ["pad"])
    half = " ".join(w[:14] + ["z"] * 40)
    texts = [None, "", item.upper(), swapped, half, "q0 q1 q2 q3", LONG, "tiny item here", item + " " + item]
    bench = spark.createDataFrame([(5, item), (6, None), (7, ""), (8, "tiny item"), (9, item)], "item_id long, text string")
    rows = {r.doc_id: r for r in tiling.contamination(docs(spark, texts).withColumn("coverage", F.lit("x")), bench).collect()}
    assert [rows[i].contaminated for i in range(9)] == [False, False, True, True, False, False, False, True, True]
    assert rows[2].coverage == 1.0 and rows[2].item_id == 5 and rows[3].coverage == 1.0 and rows[3].n_tiles == 2
    assert rows[4].coverage == pytest.approx(14 / 30) and rows[7].item_id == 8 and rows[8].n_tiles == 1
    blocks = {r.doc_id: r for r in tiling.contamination(docs(spark, texts), bench, block_bytes=10).collect()}
    assert all((blocks[i].coverage, blocks[i].item_id, blocks[i].contaminated) == (rows[i].coverage, rows[i].item_id, rows[i].contaminated) for i in rows)
    assert tiling.contamination(docs(spark, []), bench).count() == 0
    clean = tiling.contamination(docs(spark, texts), bench.limit(0)).collect()
    assert len(clean) == 9 and not any(r.contaminated for r in clean)
    left = tiling.remove_contaminated(docs(spark, texts, [(None, item, None, None, None), (4, item, "en", "s", 1)]), bench)
    assert left.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") and sorted(r.doc_id for r in left.collect()) == [0, 1, 4, 5, 6]


def greedy_by_force(item, doc, width):
    """Marks the longest match between unmarked words, first places first, until none is left."""
    mi, md, tiles = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and i + n not in mi and d + n not in md:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < width:
            return sum(t[2] for t in tiles)
        mi.update(range(i, i + n))
        md.update(range(d, d + n))
        tiles.append((i, d, n))


def test_tiles_agree_with_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.choice("abc") for _ in range(rng.randrange(6, 14))]
        doc = [rng.choice("abc") for _ in range(rng.randrange(6, 20))]
        table = tiling.SeedTable([1], [" ".join(item)], 3)
        w = textcore.Words(pa.array([" ".join(doc)]))
        h, _ = textcore.shingle_hashes(w, 3)
        share, _, _ = tiling.best_item(table, w.hash, h, table.seeds(h))
        assert round(share * len(item)) == greedy_by_force(item, doc, 3)


# Line dedup ------------------------------------------------------------------------------------


def lines_by_force(rows, least):
    sites, first = defaultdict(set), {}
    for i, text, source in rows:
        for line in {x.strip(" \t\r\x0b\x0c") for x in (text or "").split("\n")} - {""} if text is not None else set():
            sites[line].add(source)
            first[line] = min(first.get(line, i), i)
    gone = {x for x, s in sites.items() if len(s) >= least}
    out = {}
    for i, text, _ in rows:
        out[i] = None if text is None else "\n".join(x for x in text.split("\n") if x.strip(" \t\r\x0b\x0c") not in gone or first[x.strip(" \t\r\x0b\x0c")] == i)
    return out


def test_line_dedup(spark):
    rng = random.Random(9)
    pool = [f"line {i}" for i in range(14)] + ["", "  ", "shared\r", " shared"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 6))), f"s{rng.randrange(15)}") for i in range(120)]
    rows += [(200, None, "s1"), (201, "", "s2"), (202, "line 1\nown", None), (203, LONG, "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("line", F.lit(1)).withColumn("id", F.lit(2))
    for least in (3, 10, 16):
        got = {r.doc_id: r for r in line_dedup.dedup_lines(df, least).collect()}
        want = lines_by_force(rows, least)
        assert {i: r.text for i, r in got.items()} == want
        assert all(r.n_removed == (0 if r.text is None else r.n_lines - r.text.count("\n") - 1 if r.text or r.n_removed < r.n_lines else r.n_lines) for r in got.values())
    assert got[200].n_lines == 0 and got[201].n_lines == 1 and {"line", "id"} <= set(line_dedup.dedup_lines(df).columns)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    sent, joined = (sorted(map(str, line_dedup.dedup_lines(df, 3, few=few).collect())) for few in (10**6, 0))
    assert sent == joined
    # Rows without an id keep their lines, however many there are.
    nobody = spark.createDataFrame([(None, "common\nx", f"s{i}") for i in range(12)] + [(4, "common", "t"), (5, "common\ny", "u"), (5, "common", "u")], "doc_id long, text string, source string")
    for few in (10**6, 0):
        got = line_dedup.dedup_lines(nobody, 10, few=few).collect()
        assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, "common\nx")] * 12 + [(4, "common"), (5, ""), (5, "y")]


def test_op9_matches_sql(spark, duck, sf_dir):
    got = sorted(tuple(r) for r in line_dedup.op9_line_spread(spark, sf_dir).collect())
    assert got == sorted(duck.execute(line_dedup.ORACLE_SQL).fetchall())


# Toxicity --------------------------------------------------------------------------------------


def as_vectors(dense):
    row, word = np.nonzero(dense)
    return toxicity.Vectors(np.searchsorted(row, np.arange(len(dense) + 1)), word, dense[row, word])


def test_nearest_agrees_with_all_cosines():
    rng = np.random.default_rng(1)
    dense = rng.random((300, 12)) * (rng.random((300, 12)) < 0.3)
    dense[50:60] = dense[40:50]  # ties
    dense[:, :5] *= (np.arange(300) < 150)[:, None]
    dense[:, 5:] *= (np.arange(300) >= 140)[:, None]
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, out=np.zeros_like(dense), where=norm > 0)
    index = toxicity.BlockMaxIndex(as_vectors(dense), 12)
    assert sorted(index.order) == list(range(300)) and index.blocks == 5
    bounds = index.bounds(as_vectors(dense))
    for skip in (None, np.arange(300)):
        near, cosine = index.nearest(as_vectors(dense), 7, skip)
        for i in range(300):
            s = np.round(dense @ dense[i], 12)
            if skip is not None:
                s[i] = 0
            want = [j for j in np.lexsort((np.arange(300), -s)) if s[j] > 0][:7]
            assert near[i].tolist() == want + [-1] * (7 - len(want)) and np.allclose(cosine[i][: len(want)], s[want])
            assert all(bounds[i][k // 64] >= s[j] for k, j in enumerate(index.order))
    assert index.nearest(as_vectors(dense[:0]), 7)[0].shape == (0, 7)


def toxic_by_force(texts, examples, share, k=toxicity.K):
    """Scores and evidence of texts, from (id, text, label) in the order of ids."""
    split = lambda t: Counter(re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")))
    bags, y = [split(t) for _, t, _ in examples], np.array([x for _, _, x in examples])
    words = sorted({w for b in bags for w in b})
    n, n1, scale = len(y), y.sum(), {}
    for w in words:
        seen, ones = sum(w in b for b in bags), sum(w in b for b, x in zip(bags, y) if x)
        uneven = abs(np.log((ones + toxicity.PRIOR) / (n1 + 2 * toxicity.PRIOR)) - np.log((seen - ones + toxicity.PRIOR) / (n - n1 + 2 * toxicity.PRIOR)))
        scale[w] = (np.log((n + 1) / (seen + 1)) + 1) * (toxicity.EVEN + uneven)

    def vector(bag):
        v = np.array([(1 + np.log(bag[w])) * scale[w] if w in bag else 0.0 for w in words])
        return v / max(np.sqrt(v @ v), 1e-300)

    x = np.array([vector(b) for b in bags])

    def vote(v, skip=None):
        s = np.round(x @ v, 12)
        if skip is not None:
            s[skip] = 0
        near = [j for j in np.lexsort((np.arange(n), -s)) if s[j] > 0][:k]
        w = 1 / (1.05 - np.minimum(s[near], 1))
        return ((w * y[near]).sum() / w.sum() if near else 0.0), [examples[j][0] for j in near if y[j]]

    slope, shift = toxicity.logistic(np.array([vote(v, i)[0] for i, v in enumerate(x)]), y.astype(float), np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean())))
    found = [vote(vector(split(t))) for t in texts]
    return [1 / (1 + np.exp(-(slope * v + shift))) for v, _ in found], [e for _, e in found]


def test_toxicity(spark):
    rng = random.Random(2)
    filler = [f"w{i}" for i in range(400)]

    def text(bad):
        w = [rng.choice(filler) for _ in range(40)]
        if bad:
            w[rng.randrange(40)] = rng.choice(["scum,", "IDIOT", "trash!", "wörst", *[f"rare{rng.randrange(30)}"]])
        return " ".join(w)

    flags = [int(rng.random() < 0.3) for _ in range(500)]
    texts = [text(b) for b in flags] + [None, "", LONG + " idiot", "unheard of", " ".join(filler) + " x" * 50]
    df = docs(spark, texts, [(None, texts[3], None, None, None)])
    rows = [(i, None, b if i % 50 else None) for i, b in enumerate(flags)] + [(9999, 1, 1), (2, 0, 7), (3, 1, flags[3])]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    train = {i: b for i, _, b in rows if b in (0, 1) and zlib.crc32(str(i).encode()) % 5}
    counted = [b for i, _, b in rows if b in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    examples = [(i, texts[i], b) for i, b in sorted(train.items()) if i < 500]
    model = toxicity.train(df, labels)
    assert model.ids.tolist() == [i for i, _, _ in examples] and model.label.tolist() == [b for _, _, b in examples]
    got = {r.doc_id: r for r in toxicity.score(df.withColumn("score", F.lit("x")), model).collect()}
    score, evidence = toxic_by_force(texts, examples, float(np.mean(counted)))
    for i in range(len(texts)):
        assert got[i].score == pytest.approx(score[i], abs=1e-6) and got[i].evidence == evidence[i] and got[i].predicted == int(got[i].score >= 0.5)
    held = [i for i in range(500) if got[i].held_out]
    assert np.mean([got[i].predicted == flags[i] for i in held]) > 0.85 and len({round(r.score, 9) for r in got.values()}) > 20
    assert got[None].score == got[3].score and got[None].held_out is False and got[500].score == got[501].score == got[503].score
    assert toxicity.score(df.limit(0), model).count() == 0
    few = toxicity.train(df, labels, examples=20)
    assert few.label.sum() == 20 and len(few.label) == 40
    none = toxicity.train(df, labels.limit(0))
    assert {r.predicted for r in toxicity.score(df, none).collect()} == {0}
    assert {r.predicted for r in toxicity.score(df, toxicity.train(df, labels.where("toxic = 1"))).collect()} == {1}


def test_toxicity_of_held_out_documents(spark):
    """Calibration and decisions on rows that were not learned from."""
    sf = "/root/testdata/sf0.01"
    true = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").collect()}
    rows = [r for r in toxicity.op10_toxicity_neighbours(spark, sf).collect() if r.held_out and r.doc_id in true]
    assert np.mean([r.predicted == true[r.doc_id] for r in rows]) > 0.9
    assert np.mean([(r.score - true[r.doc_id]) ** 2 for r in rows]) < 0.08


def test_counts_of_words():
    h, d, c = toxicity.counted(pa.array(["b a B", None, "a", ""]))
    assert sorted(zip(d.tolist(), c.tolist())) == [(0, 1), (0, 2), (2, 1)] and len(set(h.tolist())) == 2
