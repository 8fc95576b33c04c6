"""Licence labels of texts by a positional index over the rare words of licence templates."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from causeway.llm.common import as_bytes

#: Phrases whose every place is reported, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, template, mandatory key phrase. A template may be a notice or the opening of a licence text.
TEMPLATES = (
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the "
            "software without restriction", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("gpl", "this work is licensed under the gnu general public license version 3", "general public license"),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
     "gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", "lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
     "redistribution and use in source and binary forms"),
    ("bsd", "released under the bsd license", "bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
     "permission to use copy modify and or distribute this software"),
    ("mpl", "subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software released into the public domain"),
    ("cc0", "released under cc0 1 0 universal public domain dedication", "cc0 1 0"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0 international"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("proprietary", "all rights reserved", "all rights reserved"),
)
#: Highest-IDF words of each key phrase that stand in the index; a text without them can't hold the phrase.
RARE = 3
#: Words that may be missing or inserted between the key phrase and the rest of its template.
SLACK = 2
BASE_SCORE = 0.5

_TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words: runs of digits, ASCII letters and all other characters outside ASCII."""
    return text.translate(_TO_WORDS).split()


@dataclass(frozen=True)
class Index:
    templates: tuple  # (label, words, key words, place of the key, idf per word)
    postings: dict  # rare word -> [(template, place in its key phrase)]
    needed: tuple  # postings per template
    order: dict  # rare word -> its rank, the highest IDF first
    anchors: frozenset  # rare words and first words of the base phrases
    phrases: tuple  # (words, label)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[int, dict[bytes, int]]:
    """Number of texts, and per template word the number of texts that hold it, over all rows."""
    vocabulary = frozenset(w for _, t, _ in TEMPLATES for w in t.encode().split())  # under 200 words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for batch in batches:
            for text in as_bytes(batch.column(0)):
                seen.update(vocabulary.intersection(words_of(text)))
                n += 1
        rows = [*seen.items(), (b"", n)]
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in rows]), pa.array([c for _, c in rows], pa.int64())], ["word", "df"])

    got = {r.word.encode(): r.df for r in docs.select(text_col).mapInArrow(run, "word string, df long").groupBy("word").agg(F.sum("df").alias("df")).collect()}
    return got.pop(b"", 0), got


def build_index(n: int, df: dict[bytes, int], rare: int = RARE) -> Index:
    """Positional postings of the rarest words of every key phrase; words count as rarer the fewer texts hold them."""
    templates, postings = [], defaultdict(list)
    for t, (label, text, key) in enumerate(TEMPLATES):
        words, key_words = text.encode().split(), key.encode().split()
        place = next(i for i in range(len(words)) if words[i:i + len(key_words)] == key_words)
        idf = [math.log((n + 1) / (df.get(w, 0) + 1)) + 1e-9 for w in words]
        templates.append((label, words, key_words, place, idf))
        for w in sorted(set(key_words), key=lambda w: (df.get(w, 0), w))[:rare]:
            postings[w] += [(t, i) for i, x in enumerate(key_words) if x == w]
    needed = Counter(t for places in postings.values() for t, _ in places)
    order = {w: i for i, w in enumerate(sorted(postings, key=lambda w: (df.get(w, 0), w)))}
    phrases = tuple((p.encode().split(), label) for p, label in PHRASES)
    return Index(tuple(templates), dict(postings), tuple(needed[t] for t in range(len(templates))), order, frozenset(postings) | {p[0] for p, _ in phrases}, phrases)


def scan(words: list[bytes], index: Index) -> tuple[list[int], set[str], dict[str, float]]:
    """Starts of all base places, their labels, and the score of every label found by templates."""
    if index.anchors.isdisjoint(words):
        return [], set(), {}
    hits = defaultdict(list)
    for i, w in enumerate(words):
        if w in index.anchors:
            hits[w].append(i)
    starts, base = [], set()
    for phrase, label in index.phrases:
        at = [i for i in hits.get(phrase[0], ()) if words[i:i + len(phrase)] == phrase]
        starts += at
        base |= {label} if at else set()
    # the text's own licence words, rarest first: where do all rare words of a template agree on one place?
    agreed: dict[int, set[int]] = {}
    met = Counter()
    for w in sorted(index.order.keys() & hits.keys(), key=index.order.get):
        for t, p in index.postings[w]:
            here = {i - p for i in hits[w]}
            agreed[t] = here if t not in agreed else agreed[t] & here
            met[t] += 1
    labels: dict[str, float] = {}
    for t, places in agreed.items():
        label, template, key, place, idf = index.templates[t]
        if met[t] < index.needed[t]:
            continue
        for at in places:
            if at < 0 or words[at:at + len(key)] != key:
                continue
            kept = sum(v for i, (w, v) in enumerate(zip(template, idf, strict=True))
                       if any(0 <= at - place + i + d < len(words) and words[at - place + i + d] == w for d in range(-SLACK, SLACK + 1)))
            labels[label] = max(labels.get(label, 0.0), min(1.0, kept / sum(idf)))
    return starts, base, labels


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row of ``docs``.

    Base places are all places of the fixed phrases. For the labels of the
    method, a text's licence words are looked up from the highest IDF down;
    where the rare words of a template agree on a place, its mandatory key
    phrase is verified there, and every verified phrase gives its label.
    ``score`` is the best share of a template's IDF found, at least 0.5 with a base place, 0 without any
    label. Null texts count as empty: no words, null places, empty labels.
    Other columns are ignored; equal rows give equal results.
    """
    index = build_index(*document_frequencies(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in as_bytes(batch.column(1)):
                words = words_of(text)
                starts, base, labels = scan(words, index)
                score = max([BASE_SCORE if base else 0.0, *labels.values()])
                rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels.keys())), score))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                             ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
