"""Personal data: base spans against the contract's plain patterns, checksums, context words, odd rows."""

import hashlib
import random
import re

from causeway.llm import private_data as P

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and plain_luhn(digits)
    return kind != "phone" or 8 <= len(digits) <= 15


def base_spans(text):
    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in PLAIN for m in re.finditer(PLAIN[k], text or "") if passes(k, m.group()))


def test_base_spans_equal_the_plain_patterns(spark):
    r = random.Random(5)
    letters = ["aB0129 .-@+()%_é😀", "0123456789" * 3 + " -.+", "ab.@-_"]
    texts = ["".join(r.choice(a) for _ in range(r.randrange(60))) for a in letters for _ in range(3000)]
    texts += [None, "", "0000255.1.1.01 256.1.1.1 00.0.0.0", "a@b" + ".c" * 30000, "1 " * 20000, "1.1.1.1" * 700, "x@y.zz " * 700, "4111 1111 1111 1111 x" * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x.doc_id: x for x in P.digests(P.find_private(docs)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        want = base_spans(text)
        assert ",".join(s for s in got[i].spans.split(",") if s.split(":")[0] in P.BASE) == want, text
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in P.BASE] == [len(re.findall(rf"\b{k}:", want)) for k in P.BASE]


def spans_of(spark, text):
    return [tuple(s) for s in P.find_private(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().private]


def test_checksums_decide(spark):
    assert spans_of(spark, "iban DE89 3704 0044 0532 0130 00, GB82WEST12345698765432 DE88370400440532013000") == [("iban", 5, 32, 1.0), ("iban", 34, 56, 0.8)]
    assert spans_of(spark, "a 4111 1111 1111 1111 b 4111 1111 1111 1112") == [("card", 2, 21, 0.7)]


def test_context_moves_the_score(spark):
    assert spans_of(spark, "my ssn is 123-45-6789") == [("ssn", 10, 21, 0.7)]
    assert spans_of(spark, "see 123-45-6789") == [] == spans_of(spark, "part 123-45-6789 ssn 000-45-6789")
    assert [s[3] for s in spans_of(spark, "server 10.0.0.1" + "." * 60 + " version 1.2.3.4")] == [0.8, 0.2]


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert P.digests(P.find_private(empty)).count() == 0
    rows = spark.createDataFrame([(1, "a@b.cd", "x"), (1, "a@b.cd", "x"), (None, None, None)], "doc_id long, text string, private string")
    got = P.digests(P.find_private(rows)).collect()
    assert sorted(r.spans for r in got) == ["", "email:0:6", "email:0:6"]


def test_plan_stays_native(spark):
    docs = spark.createDataFrame([(1, "a@b.cd")], "doc_id long, text string")
    plan = P.digests(P.find_private(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
