"""Operators on documents: small tables against plain versions, with nulls, empty texts, ties, repeats and foreign columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from causeway.llm import bpe_reuse, license_scan, mix_budget, neural_lm, quality, sketch_dedup, token_coder

DOCS = "doc_id long, text string, source string, score double, v long, key string, component string, n long"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def words(rng, n, size=400):
    return " ".join(f"w{rng.randrange(size)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Groups of near copies, exact copies, a shared passage, short, empty, null and repeated rows."""
    rng, out = random.Random(3), []
    passage = words(rng, 60)
    for g in range(6):
        base = words(rng, 80 + 20 * g).split()
        for i in range(7):
            copy = list(base)
            for _ in range(i):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(copy) if i else " ".join(copy).upper())
    out += [passage + " " + words(rng, rng.randrange(3, 60)) for _ in range(25)]
    out += [passage] * 3 + ["", "   \n", None, None, "one two", "ONE two", "one two three four five", "é è 日本   x", "<|endoftext|> a  b\n\n c <|endoftext|>", "word " * 3000]
    table = [(i, t, f"s{i % 4}" if i % 5 else None, 0.5, 1, "k", "c", 9) for i, t in enumerate(out)]
    return [*table, table[0], (None, "one two", "s1", 0.5, 1, "k", "c", 9), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("hot", [64, 2])
def test_near_duplicates(docs, rows, hot):
    sets = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = sketch_dedup.near_duplicates(docs, hot=hot).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert sorted((r.n_shingles, r.component_id is None, r.kept) for r in got if r.doc_id is None) == [(0, True, True), (1, False, False)]
    assert len(set(want.values())) < len(want) - 20


def test_near_duplicates_of_nothing(none):
    assert sketch_dedup.near_duplicates(none).collect() == []


def test_language_model(docs, rows):
    tokens = {i: [*(r[1] or "").encode().lower().split(), None] for i, r in enumerate(rows)}
    held = [zlib.crc32(str(r[0]).encode() if r[0] is not None else b"") % 10 == 0 for r in rows]
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if rows[i][0] is None else rows[i][0], held[i], len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4))
                  for i, t in tokens.items())
    got = neural_lm.scores(docs).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)


def test_scores_do_not_depend_on_partitions(docs, monkeypatch):
    monkeypatch.setattr(neural_lm, "BUCKET", 1500)
    one, many = ([(r.doc_id, r.n_tokens, r.score) for r in neural_lm.scores(docs.repartition(n)).collect()] for n in (1, 7))
    keyed = [sorted((-1 if i is None else i, n, round(s, 3)) for i, n, s in got) for got in (one, many)]
    assert keyed[0] == keyed[1] and len(one) == docs.count()


def test_language_model_of_nothing(none):
    assert neural_lm.scores(none).collect() == []


def test_outputs_are_normalised():
    rng = np.random.default_rng(0)
    m = neural_lm.Model(rng.integers(0, 100, neural_lm.OUTPUTS).astype(float))
    for x in m.parameters():
        x += rng.standard_normal(x.shape).astype(np.float32) * 0.3
    w = np.arange(neural_lm.OUTPUTS)
    p = np.exp(m.log_probabilities(np.full_like(w, 5), np.full_like(w, neural_lm.START), w))
    assert abs(p.sum() - 1) < 1e-4


def test_training_learns_pairs():
    rng = np.random.default_rng(1)
    w = rng.integers(0, 8, 40_000)
    w[1::2] = (w[::2] + 1) % 8
    a, b = neural_lm._contexts(w, np.array([len(w)]))
    m = neural_lm.Model(np.bincount(w, minlength=neural_lm.OUTPUTS).astype(float))
    squares = [np.full_like(p, 1e-3) for p in m.parameters()]
    before = m.log_probabilities(a, b, w)[1::2].mean()
    for _ in range(3):
        m.train(a, b, w, squares, rng)
    assert m.log_probabilities(a, b, w)[1::2].mean() > before + 0.4


def test_bpe(docs, rows):
    t = Tokenizer.from_file(BYTE)
    want = collections.Counter()
    for r in rows:
        ids = t.encode(r[1] or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe_reuse.digests(bpe_reuse.encode(docs, BYTE)).collect())) == want


def test_bpe_of_nothing(none):
    assert bpe_reuse.encode(none, BYTE).collect() == []


def test_bpe_joins():
    codec, rng = bpe_reuse.Codec(BYTE), random.Random(5)
    parts = ["a", "Ab", " ", "  ", "\n", "\t", " ", "　", "é", "́", "12", "'s", "'", ".", "<|", "<|endoftext|>", "x y", "日", "😀", "\r\n", "\x85", "\x1c", "ÿ", "Ā", "ª"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(3000)] + ["".join(rng.choice(parts[:-12] + ["word", " the"]) for _ in range(5000)) for _ in range(10)]
    want = codec.tokenizer.encode_batch(texts, add_special_tokens=False)
    got = codec.encode([x.encode() for x in texts])
    assert [g.tolist() for g in got] == [w.ids for w in want]
    assert [codec.decode(g).decode() for g in got] == [codec.tokenizer.decode(w.ids, skip_special_tokens=False) for w in want]


def test_equal_passages_give_equal_chunks():
    rng = random.Random(9)
    shared, one, two = words(rng, 2000).encode(), words(rng, 50).encode(), words(rng, 90).encode()

    def chunks(text):
        at = [0, *bpe_reuse.cuts(text).tolist()]
        return {text[a:b] for a, b in zip(at, at[1:], strict=False)}

    assert len(chunks(one + shared) & chunks(two + shared)) >= len(chunks(shared)) - 3


def test_licences(spark, docs):
    texts = ["Licensed under the Apache License, Version 2.0.", "see the MIT-License; mit license", "GNU General Public License version 3", "Licensed under CC BY-NC 4.0.", "all rights reserved.",
             "license mit", "the general public", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", None, "", "x " * 500 + "MIT License"]
    table = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r.doc_id: r for r in license_scan.license_labels(table).collect()}
    phrases = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
    for i, t in enumerate(texts):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        at = [(j, k) for j in range(len(w)) for k, p in phrases.items() if w[j:j + len(p)] == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (
            len(w), len(at), min((j for j, _ in at), default=None), max((j for j, _ in at), default=None), ",".join(sorted({k for _, k in at})))
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert [got[i].labels for i in range(11)] == ["apache", "mit", "gpl", "cc-by-nc", "proprietary", "", "", "mit", "", "", "mit"]
    assert got[8].score == 0 and got[3].score > 0.9
    assert len(license_scan.license_labels(docs).collect()) == docs.count()


def test_licences_of_nothing(none):
    assert license_scan.license_labels(none).collect() == []


def plain_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in full]
        level = (total - sum(3 * sizes[s] for s in full)) / max(1, sum(weight[s] for s in free))
        over = {s for s in free if level * weight[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return {s: 3 * sizes[s] if s in full else level * weight[s] for s in sizes}
        full |= over


def test_mix(docs, rows):
    got = mix_budget.mix(docs).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len((r[1] or "").encode().split())
    want = plain_targets(sizes)
    assert len(got) == len(rows) and {r.source: r.source_size for r in got} == dict(sizes)
    for s in sizes:
        mine = [r for r in got if r.source == s]
        assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for r in mine)
        assert all(r.taken in (0, r.size, 2 * r.size, 3 * r.size) for r in mine)
        assert abs(sum(r.taken for r in mine) - want[s]) <= max(2, 0.02 * want[s])
    key = lambda r: (str(r.doc_id), r.size, str(r.source), r.taken)
    assert sorted(map(key, got)) == sorted(map(key, mix_budget.mix(docs.repartition(7)).collect()))


def test_mix_of_nothing(none):
    assert mix_budget.mix(none).collect() == []


def test_fit_counts():
    rng = random.Random(2)
    for _ in range(100):
        n = rng.sample(range(1, 50), rng.randrange(1, 9))
        m = [rng.randrange(1, 7) for _ in n]
        budget = rng.randrange(0, sum(a * b for a, b in zip(n, m, strict=True)) + 3)
        reach = {0}
        for a, b in zip(n, m, strict=True):
            reach = {x + a * j for x in reach for j in range(b + 1) if x + a * j <= budget}
        x = mix_budget.fit_counts(n, m, budget)
        assert all(0 <= a <= b for a, b in zip(x, m, strict=True)) and sum(a * b for a, b in zip(n, x, strict=True)) == max(reach)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r for r in quality.quality_scores(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count()
    for r in got.values():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [d for d in known if got[d].held_out]
    assert sum(got[d].predicted == known[d] for d in held) >= 0.9 * len(held)


def test_quality_of_odd_tables(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 0), (3, None, 0), (None, 1, 0), (5, 7, 0)], "doc_id long, quality int, text int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == docs.count() and all(r.score == 0 for r in got if r.doc_id in (70, 71, 72))
    assert all(r.score == 1 for r in quality.quality_scores(docs, labels.limit(0)).filter("score > 0").collect())
    assert quality.quality_scores(none, labels).collect() == []


def test_voters_are_bounded(spark):
    """Repeated ids give one voter each, and labels of absent documents take no places."""
    docs = spark.createDataFrame([(i % 4, f"text number {i}") for i in range(80)] + [(9, None), (9, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)] + [(9, 1)] + [(i, i % 2) for i in range(1000, 1400)], "doc_id long, y int")
    assert sorted(quality.fit(docs, labels, voters=2, dims=4).labels.tolist()) == [0, 0, 1, 1]
    assert sorted(quality.fit(docs, labels, voters=5, dims=4).labels.tolist()) == [0, 0, 1, 1, 1]


def test_token_files(docs, rows):
    t = Tokenizer.from_file(WORD)
    blocks = token_coder.write_blocks(docs, WORD)
    got = token_coder.with_checksums(token_coder.read_blocks(blocks)).orderBy("start").collect()
    ids = {r[1]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 1] for r in rows}
    want = collections.Counter((r[0], len(ids[r[1]]), zlib.crc32(np.array(ids[r[1]], "<u4").tobytes())) for r in rows)
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x))


def test_token_files_of_nothing(none):
    assert token_coder.read_blocks(token_coder.write_blocks(none, WORD)).collect() == []


def test_runs_are_encoded_like_whole_texts(rows, monkeypatch):
    """Also where runs are forgotten."""
    monkeypatch.setattr(token_coder, "MEMORY", 40)
    rng, t, w = random.Random(5), Tokenizer.from_file(WORD), token_coder.Words(WORD)
    odd = ["h", "H", "\u0331", "é", "E\u0301", "'s", "12", "x", " ", "\x0b", "\x1c", "\u00a0", "\u2003", "\x85", "<|endoftext|>", "日本", "!", "\x00"]
    texts = [r[1] for r in rows] + ["".join(rng.choices(odd, k=rng.randrange(12))) for _ in range(400)] + [None]
    got = []
    for at in range(0, len(texts), 20):
        got += [x.tolist() for x in w.encode([(x or "").encode() for x in texts[at:at + 20]])]
    assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    with pytest.raises(ValueError):
        token_coder.Words(BYTE)


def test_range_coder():
    rng = np.random.default_rng(4)
    for n, top in ((0, 2), (1, 5), (2048, 1 << 16), (2049, 300), (70_000, 1 << 20), (5000, 1), (40_960, 40)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        symbols, coded, check = token_coder.pack(ids)
        assert (token_coder.unpack(n, symbols, coded, check) == ids).all()
    assert sum(map(len, coded)) < 40_960
    broken = [bytes([coded[0][0] ^ 255]) + coded[0][1:], *coded[1:]]
    with pytest.raises(ValueError):
        token_coder.unpack(len(ids), symbols, broken, check)
    assert token_coder.unpack(len(ids), symbols, coded, check).tolist() == ids.tolist()


def test_rows_without_id_are_linked(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(None, text), (None, text), (None, text + " more"), (None, "alone among all the others here"), (3, "x y z"), (None, "x y z"), (None, ""), (5, text + " even more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sketch_dedup.near_duplicates(docs).collect()
    by_text = {}
    for r in got:
        by_text.setdefault((r.doc_id, r.n_shingles), set()).add((r.component_id, r.kept))
    assert by_text == {(None, 56): {(5, False)}, (None, 57): {(5, False)}, (5, 58): {(5, True)}, (None, 2): {(None, True)}, (3, 1): {(3, True)},
                       (None, 1): {(3, False)}, (None, 0): {(None, True)}}
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r.doc_id is None, r.text[:9]) for r in left.collect()) == [(False, "w0 w1 w2 "), (False, "x y z"), (True, ""), (True, "alone amo")]


def test_every_verified_phrase_gives_its_label(spark):
    keys = [(label, key) for label, _, key in license_scan.TEMPLATES]
    r = random.Random(4)
    words = sorted({w for _, t, _ in license_scan.TEMPLATES for w in t.split()})
    texts = [key for _, key in keys] + [" ".join(r.choice(words) for _ in range(8)) + " " + r.choice(keys)[1] + " " + " ".join(r.choice(words) for _ in range(8)) for _ in range(200)]
    texts += [" ".join(r.choice(words) for _ in range(30)) for _ in range(200)]
    got = license_scan.license_labels(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for x in got:
        want = {label for label, key in keys if f" {key} " in f" {texts[x.doc_id]} "}
        assert set(filter(None, x.labels.split(","))) == want | set(filter(None, x.base_labels.split(","))), texts[x.doc_id]
