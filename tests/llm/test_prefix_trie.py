"""The prefix trie against a plain one built in Python, on short, long, shared and odd conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from causeway.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(t[2], t[3]) for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain_trie(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, of in members.items():
        here = (len(of) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += here
            leaves[node[:d]] += node not in kids
    return {(min(of), len(n), min(members[n[:-1]]) if n else None, len(of), kids.get(n, 0), leaves[n], saved[n],
             hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest()) for n, of in members.items()}


def rows_of(df):
    rows = [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_turns(seed):
    r = random.Random(seed)
    rows = []
    for c in range(-12, 60):
        n = r.choice([0, 1, 3, 7, 8, 9, 16, 17, 40]) if seed % 2 else r.randrange(12)
        for t in range(n):
            # the same first turns in many conversations, also far down
            text = "x" if r.random() < 0.9 else r.choice(["", "é", None, "abc"])
            rows.append((c, t, r.choice(["user", "user", "user", None]) if t > 5 else "user", text))
    rows += [(70, None, "a", "late"), (70, 0, "a", "b"), (70, 0, "a", "b"), (70, 0, None, None), (None, 1, "a", "b")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_plain_trie(spark, seed):
    rows = random_turns(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(T.prefix_trie(*T.rebuilt(df))) == plain_trie(plain_rebuilt(rows))


def test_long_and_identical_conversations(spark):
    rows = [(c, t, "u", f"turn {t}") for c in range(20, 24) for t in range(70 if c % 2 else 53)]
    rows += [(c, 0, "u", "one for all") for c in range(40000, 41000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("x", "y")
    convs = defaultdict(list)
    for c, _, role, text in rows:
        convs[c].append((role, text))
    assert rows_of(T.prefix_trie(*T.as_they_are(df))) == plain_trie(convs)


def test_empty_table(spark):
    assert T.prefix_trie(*T.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0
    assert T.prefix_trie(*T.rebuilt(spark.createDataFrame([(None, 1, "a", "b")], SCHEMA))).count() == 0


def test_extra_columns_are_ignored(spark):
    df = spark.createDataFrame([(5, 0, "u", "t", 1, "x")], SCHEMA + ", n long, before string")
    assert {r[:4] for r in rows_of(T.prefix_trie(*T.rebuilt(df)))} == {(5, 0, None, 1), (5, 1, 5, 1)}
