"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Everything is DataFrame functions, so a text never leaves the JVM and no row
is shuffled. A kind's matches and the pieces between them are two arrays of
the same text; running sums of their lengths give the places.

Patterns take possessive repeats and look-behinds where a plain repeat would
try every place of a long run again. They match the same strings:

* ``email``: all places of a run of name characters match or fail alike, so
  only its first place is tried, or the end of the match before (``\\G``).
* ``ip``: as emails, by runs of digits.
* ``card``: a match is a whole run of digits with single separators. Runs
  below 16 and above 19 digits can never pass, so only the others are matched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places are summed up in parts of so many matches.
PART = 256
#: Code points read before and after a match for words that tell what it is.
BEFORE, AFTER = 48, 24
#: What a word nearby adds to the score, and what a word that speaks against it takes.
BONUS, MALUS = 0.3, 0.3
#: Spans of the kinds beyond the base ones need this score.
THRESHOLD = 0.6

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
#: A text without this character holds no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
PRIOR = {"email": 0.7, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8, "ssn": 0.4}
FOR = {
    "email": "mail|e-mail|email|contact|write|address",
    "ip": "ip|host|server|client|address|login|from",
    "card": "card|visa|mastercard|credit|debit|payment|pay",
    "phone": "phone|tel|telephone|call|mobile|fax|cell|whatsapp",
    "iban": "iban|bank|account|transfer|konto|compte|cuenta",
    "ssn": "ssn|social|security|taxpayer|tin",
}
AGAINST = {
    "email": "noreply|no-reply|example",
    "ip": "version|release|section|chapter",
    "card": "isbn|order|serial|tracking",
    "phone": "version|serial|id",
    "iban": "serial|part",
    "ssn": "serial|part|order|isbn",
}


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total, i):
        digit = F.substr(digits, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(number: Column) -> Column:
    """Whether an account number without spaces leaves 1 modulo 97, letters read as 10 to 35."""
    turned = F.concat(F.substr(number, F.lit(5)), F.substr(number, F.lit(1), F.lit(4)))

    def step(rest, i):
        c = F.ascii(F.substr(turned, i, F.lit(1)))
        return F.when(c < 58, rest * 10 + c - 48).otherwise(rest * 100 + c - 55) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _confirmed(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]|[0-9]|(?<=0))(?:\.|$)){4}$")
    if kind == "card":
        digits = F.regexp_replace(value, r"[\x20-]", "")
        return F.length(digits).between(16, 19) & luhn(digits)
    if kind == "phone":
        return F.length(F.regexp_replace(value, "[^0-9]", "")).between(8, 15)
    if kind == "iban":
        number = F.replace(value, F.lit(" "), F.lit(""))
        return F.length(number).between(15, 34) & mod97(number)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-|-0000$")
    return F.lit(True)


def _near(context: Column, words: str) -> Column:
    return context.rlike(rf"(?<![a-z])(?:{words})(?![a-z])")


def _score(kind: str, before: Column, after: Column) -> Column:
    context = F.lower(F.concat_ws(" ", F.substr(before, F.lit(-BEFORE)), F.substr(after, F.lit(1), F.lit(AFTER))))
    score = F.lit(PRIOR[kind]) + F.when(_near(context, FOR[kind]), BONUS).otherwise(0.0) - F.when(_near(context, AGAINST[kind]), MALUS).otherwise(0.0)
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)


def _starts(found: Column, pieces: Column) -> Column:
    """First place of each match: sums of parts of ``PART`` matches, then running sums inside each part.

    A fold copies what it has gathered at every step, so none may gather the
    starts of a whole text.
    """
    longs = F.array().cast("array<long>")
    gap = lambda i: F.length(F.get(pieces, i)).cast("long")
    size = lambda i: F.length(F.get(found, i)).cast("long")
    inside = lambda first: F.sequence(first, F.least(first + PART, F.size(found)) - 1)
    firsts = F.sequence(F.lit(0), F.size(found) - 1, F.lit(PART))
    total = lambda first: F.aggregate(inside(first), F.lit(0).cast("long"), lambda at, i: at + gap(i) + size(i))
    begin = F.struct(F.lit(0).cast("long").alias("at"), longs.alias("out"))
    ahead = F.aggregate(F.transform(firsts, total), begin, lambda a, n: F.struct((a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    def part(base, k):
        def one(a, i):
            start = a["at"] + gap(i)
            return F.struct((start + size(i)).alias("at"), F.array_append(a["out"], start).alias("out"))

        return F.aggregate(inside(k * PART), F.struct(base.alias("at"), longs.alias("out")), one, lambda a: a["out"])

    return F.flatten(F.transform(ahead, part))


SPAN = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def _spans(kind: str, found: Column, pieces: Column) -> Column:
    """Confirmed spans of one kind with their scores."""
    def all_of(whole):
        found, pieces, starts = whole["found"], whole["pieces"], whole["starts"]

        def span(i):
            value, start = F.get(found, i), F.get(starts, i)
            held = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"),
                            _score(kind, F.get(pieces, i), F.get(pieces, i + 1)).alias("score"))
            return F.when(_confirmed(kind, value), held)

        return F.array_compact(F.transform(F.sequence(F.lit(0), F.size(found) - 1), span))

    # a list of one entry names the arrays, so that each is made once
    named = F.transform(F.array(F.struct(found.alias("found"), pieces.alias("pieces"))),
                        lambda w: F.struct(w["found"].alias("found"), w["pieces"].alias("pieces"), _starts(w["found"], w["pieces"]).alias("starts")))
    return F.when(F.size(found) > 0, F.get(F.transform(named, all_of), F.lit(0))).otherwise(F.array()).cast(SPAN)


def find_private(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the column ``private``: all confirmed spans as ``(kind, start, end, score)``.

    Spans lie in the order of ``KINDS``, then by ``start``; places count code
    points, ``end`` is exclusive. Matches of one kind never overlap, those of
    different kinds may. Base kinds are kept whatever their score, the others
    from ``THRESHOLD`` on. A null or empty text has an empty list; repeated
    rows are treated alike; other columns stay, but for one named ``private``.
    """
    kept = [c for c in docs.columns if c != "private"]
    text = F.coalesce(F.col("_text"), F.lit(""))
    out = docs.select(*kept, F.col(text_col).alias("_text"))
    empty = F.array().cast("array<string>")
    for kind in KINDS:
        all_of = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        out = out.withColumn(f"_{kind}", F.when(text.contains(NEEDS[kind]), all_of).otherwise(empty) if kind in NEEDS else all_of)
    for kind in KINDS:
        pieces = F.when(F.size(f"_{kind}") > 0, F.split(text, PATTERNS[kind], -1))
        out = out.withColumn(f"_{kind}", _spans(kind, F.col(f"_{kind}"), pieces))
    parts = [F.col(f"_{k}") if k in BASE else F.filter(f"_{k}", lambda s: s["score"] >= THRESHOLD) for k in KINDS]
    return out.select(*kept, F.concat(*parts).alias("private"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, digests and the list of spans per document."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    of = lambda kind: F.size(F.filter("private", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.transform(F.filter("private", lambda s: s["kind"].isin(*BASE)), name)
    return found.select(
        id_col, *[of(k) for k in KINDS], F.sha2(F.array_join(base, ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("private", name), ",").alias("spans"), F.coalesce(F.array_max(F.transform("private", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))
