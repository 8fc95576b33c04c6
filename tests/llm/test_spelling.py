"""Spelling variants against brute force, with cells and slabs so small that all of them are used."""

import random
import re
import zlib
from collections import Counter

import pytest

from causeway.llm import spelling as S

DOCS = "doc_id long, text string"


def plain_words(docs):
    found = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1:]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counted):
    out, forms = {}, {}
    by_length = {}
    for w in counted:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, []) if one_edit(w, v)] for w in counted}
    for w, n in counted.items():
        best = min(near[w], key=lambda v: (-counted[v], v), default=None)
        forms[w] = best if best is not None and counted[best] >= 10 * n else None
    for w, n in counted.items():
        root = w
        while forms[root] is not None:
            root = forms[root]
        out[w] = (forms[w], root, n, len(near[w]), counted[forms[w]] if forms[w] else None)
    return out


def got(df):
    rows = df.collect()
    assert len(rows) == len({r.word for r in rows})
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


@pytest.mark.parametrize("cell, slab, sample", [(4096, 16384, 200_000), (40, 64, 400), (30, 7, 200_000)])
def test_equals_brute_force(spark, monkeypatch, cell, slab, sample):
    monkeypatch.setattr(S, "CELL", cell)
    monkeypatch.setattr(S, "SLAB", slab)
    monkeypatch.setattr(S, "SAMPLE", sample)
    r = random.Random(cell)
    counted = {"".join(r.choice(a) for _ in range(r.randrange(7, 11))): r.choice([2, 3, 20, 25, 250, 4000]) for a in ("ab", "abcé", "abcdeÀÿ") for _ in range(300)}
    counted["anything" * 40] = 2
    counted["anything" * 40 + "x"] = 20
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    assert got(S.variants(df)) == plain_variants(counted)


def test_forms_are_followed_to_the_last(spark):
    chain = ["aaaaaaa" + "b" * i for i in range(6)]
    counted = {w: 2 * 10 ** i for i, w in enumerate(chain)}
    df = spark.createDataFrame(list(counted.items()), "word string, n long")
    assert got(S.variants(df)) == plain_variants(counted)
    assert {r.root for r in S.variants(df).collect()} == {chain[-1]}


def test_words_of_texts(spark):
    r = random.Random(3)
    stems = ["lettering", "Élancées", "wonderful", "SPELLING", "çàùéèêë"]
    docs = [(i, " ".join(r.choice(stems) for _ in range(200)) + ". short x×y" + "Āwide") for i in range(60)] + [(None, "lettering lettering"), (7, None), (8, "")]
    df = spark.createDataFrame([(*d, 1) for d in docs], DOCS + ", n long")
    assert {x.word: x.n for x in S.words(df).collect()} == plain_words(docs)
    assert got(S.spelling_variants(df)) == plain_variants(plain_words(docs))


def test_long_run_and_empty_tables(spark):
    assert S.spelling_variants(spark.createDataFrame([], DOCS)).count() == 0
    long = "q" * 300_000
    got_words = got(S.spelling_variants(spark.createDataFrame([(1, long), (2, long), (3, "x" + long), (4, "x" + long), (5, "")], DOCS)))
    want = plain_words([(1, long), (2, long), (3, "x" + long), (4, "x" + long)])
    assert {w: n for w, (_, _, n, _, _) in got_words.items()} == want
