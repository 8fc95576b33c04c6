"""Learning from the outcomes of past actions.

``executions`` has ``execution_id, action_type, action_title, success, ts``.
"Now" is always an argument, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import ordered
from causeway.functions.ordered import read_twice
from causeway.functions.values import round3
from causeway.operators.deep import met
from causeway.session import checkpointed


def _hours(now: Column, then: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 3.6e9


def success_rates(executions: DataFrame, by: str = "action_type") -> DataFrame:
    return executions.groupBy(by).agg(
        F.count("*").alias("n"), F.avg(F.col("success").cast("double")).alias("rate"), F.max("ts").alias("last_ts"))


def rate_or_default(actions: DataFrame, rates: DataFrame, by: str = "action_type") -> DataFrame:
    """Success rate of each action's kind, one half when it was never tried."""
    return actions.join(rates.select(by, "rate"), by, "left").withColumn("rate", F.coalesce("rate", F.lit(0.5)))


def extremes(rates: DataFrame, by: str = "action_type", k: int = 5, worst: bool = False) -> DataFrame:
    """The best or worst ``k`` kinds of action."""
    return rates.orderBy(F.col("rate").asc() if worst else F.col("rate").desc(), by).limit(k)


def outcome_deltas(executions: DataFrame) -> DataFrame:
    """What improved between the ``pre`` and ``post`` measures; positive is better."""
    d = {n: F.col(f"pre.{n}") - F.col(f"post.{n}") for n in ("steps", "violations", "calls", "depth", "ms")}
    shares = [
        F.when(F.col("pre.steps") > 0, F.least(F.lit(1.0), d["steps"] / F.greatest(F.lit(1), F.col("pre.steps")))),
        F.signum(d["violations"].cast("double")),
        F.when(F.col("pre.calls") > 0, F.least(F.lit(1.0), d["calls"] / F.greatest(F.lit(1), F.col("pre.calls")))),
    ]
    known = F.array_compact(F.array(*shares))
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known)
    return executions.select("*", *[v.alias(f"{n}_reduction") for n, v in d.items()], total.alias("improvement")).withColumn(
        "improved", F.col("improvement") > 0)


def adaptive_priorities(actions: DataFrame, executions: DataFrame, now: Column) -> DataFrame:
    """Base priority scaled by past success and by how long ago the like was last tried."""
    t = success_rates(executions).select("action_type", F.col("rate").alias("type_rate"), F.col("last_ts").alias("t1"))
    n = success_rates(executions, "action_title").select("action_title", F.col("rate").alias("title_rate"), F.col("last_ts").alias("t2"))
    j = actions.join(t, "action_type", "left").join(n, "action_title", "left")
    last = F.greatest("t1", "t2")
    age = _hours(now, last)
    recency = F.when(last.isNull(), 1.2).when(age < 1, 1.0).when(age < 24, 1.1).otherwise(1.2)
    rate = F.coalesce("title_rate", "type_rate", F.lit(0.5))
    value = F.col("priority") * (0.5 + rate) * recency + F.when(last.isNull(), 0.1).otherwise(0.0)
    return j.select(*actions.columns, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("adjusted"))


def recent(executions: DataFrame, size: int | None = None) -> DataFrame:
    """The experience: all outcomes, or only the latest ones where a size is asked for."""
    return executions if size is None else executions.orderBy(F.col("ts").desc(), F.col("execution_id").desc()).limit(size)


_CONCEPT = ["concept_id", "name", "action_type", "action_template", "confidence", "evidence_count", "success_rate", "tags", "last_used", "lifecycle"]


def _concept(df, cid, name, kind, template, tags, confidence=None) -> DataFrame:
    score = F.col("rate") if confidence is None else F.lit(confidence)
    return df.select(
        cid.alias("concept_id"), name.alias("name"), kind.alias("action_type"), template.alias("action_template"),
        score.alias("confidence"), F.col("n").cast("long").alias("evidence_count"), score.alias("success_rate"),
        tags.alias("tags"), F.col("last_ts").alias("last_used"), F.lit("emerging").alias("lifecycle"))


def extract_concepts(executions: DataFrame, now: Column, min_evidence: int = 3, min_success: float = 0.6,
                     size: int | None = None) -> DataFrame:
    """Kinds and titles of action that usually work, and kinds that succeed beside each other.

    The number of pairs of successes of two kinds is the product of their
    counts, so no pairs of outcomes are formed.
    """
    seen = recent(executions, size)
    good = (F.col("n") >= min_evidence) & (F.col("rate") >= min_success)
    t, kind = success_rates(seen).filter(good), F.col("action_type")
    types = _concept(t, F.concat(F.lit("type:"), kind), kind, kind, F.concat(kind, F.lit(": {title}")), F.array(kind))
    first = seen.groupBy("action_title").agg(F.min_by("action_type", F.struct("ts", "execution_id")).alias("action_type"))
    title = F.col("action_title")
    n = success_rates(seen, "action_title").filter(good).join(first, "action_title")
    titles = _concept(n, F.concat(F.lit("title:"), F.substring(F.md5(title), 1, 8)), title, kind, title, F.array(kind, F.lit("specific")))
    won = seen.filter("success").groupBy("action_type").agg(F.count("*").alias("w"))
    a = won.select(kind.alias("x"), F.col("w").alias("wx"), F.lit(1).alias("one"))
    b = won.select(kind.alias("y"), F.col("w").alias("wy"), F.lit(1).alias("one"))
    both = a.join(b, "one").filter("x < y").withColumn("n", F.col("wx") * F.col("wy")).filter(F.col("n") >= min_evidence)
    label = F.concat_ws(" + ", "x", "y")
    pairs = _concept(both.withColumn("last_ts", now), F.concat(F.lit("pair:"), F.concat_ws("+", "x", "y")), label, F.col("x"), label,
                     F.array("x", "y"), 0.8)
    return types.unionByName(titles).unionByName(pairs)


def remember(known: DataFrame, new: DataFrame, now: Column, size: int | None = None) -> DataFrame:
    """Merge new concepts into the known ones: weighted success, more evidence, a little more confidence.

    Where a capacity is given, the longest unused concepts leave the memory first.
    """
    old = known.select(*[F.col(c).alias(f"k_{c}") for c in _CONCEPT])
    j = old.join(new.select(*_CONCEPT), F.col("k_concept_id") == F.col("concept_id"), "full")
    met = F.col("k_concept_id").isNotNull() & F.col("concept_id").isNotNull()
    total = F.col("k_evidence_count") + F.col("evidence_count")
    mean = (F.col("k_success_rate") * F.col("k_evidence_count") + F.col("success_rate") * F.col("evidence_count")) / total
    merged = {
        "confidence": F.least(F.lit(0.95), F.col("k_confidence") + 0.01), "evidence_count": total, "success_rate": mean, "last_used": now}
    out = j.select(*[
        (F.when(met, merged[c]).otherwise(F.coalesce(f"k_{c}", c)) if c in merged else F.coalesce(f"k_{c}", c)).alias(c) for c in _CONCEPT])
    return out if size is None else out.orderBy(F.col("last_used").desc(), "concept_id").limit(size)


def relevant_concepts(concepts: DataFrame, contexts: DataFrame, now: Column, k: int = 5) -> DataFrame:
    """The ``k`` most relevant concepts of each context ``(context_id, action_type, tags)``.

    Only a concept of the same type or with a shared tag gains from the
    context, so besides those the best ``k`` without any context are enough.
    """
    age = _hours(now, F.col("last_used"))
    base = F.col("confidence") * F.when(age < 24, 1.2).when(age > 168, 0.8).otherwise(1.0) * F.when(F.col("evidence_count") > 10, 1.3).otherwise(1.0)
    c = read_twice(concepts.select("concept_id", F.col("action_type").alias("c_type"), F.col("tags").alias("c_tags"), base.alias("base")))
    top = c.orderBy(F.col("base").desc(), "concept_id").limit(k).collect()  # k rows
    # contexts alike in type and tags have the same concepts, so each kind of context is scored once
    asked = contexts.select("context_id", "action_type", "tags", F.to_json(F.struct("action_type", "tags")).alias("profile"))
    kinds = read_twice(asked.groupBy("profile").agg(F.first("action_type").alias("action_type"), F.first("tags").alias("tags")))
    by_type = kinds.join(c.withColumn("action_type", F.col("c_type")), "action_type")
    by_tag = kinds.withColumn("tag", F.explode("tags")).join(c.withColumn("tag", F.explode("c_tags")), "tag")
    fixed = F.array(*[F.struct(F.lit(r.concept_id).alias("concept_id"), F.lit(r.c_type).alias("c_type"), F.array(*map(F.lit, r.c_tags)).cast("array<string>").alias("c_tags"),
                               F.lit(r.base).cast("double").alias("base")) for r in top])
    always = kinds.withColumn("t", F.explode(fixed)).select("*", "t.*") if top else by_type.limit(0)
    cols = ["profile", "action_type", "tags", "concept_id", "c_type", "c_tags", "base"]
    found = by_type.select(*cols).unionByName(by_tag.select(*cols)).unionByName(always.select(*cols)).dropDuplicates(["profile", "concept_id"])
    shared = F.size(F.array_intersect("tags", "c_tags"))
    score = F.col("base") * F.when(F.col("c_type") == F.col("action_type"), 1.5).otherwise(1.0) * (1 + 0.2 * F.greatest(shared, F.lit(0)))
    best = checkpointed(_best(found.withColumn("score", round3(score)), "profile", k).select("profile", "concept_id", "score"))
    told = met(read_twice(asked.select("context_id", "profile")), best, "profile")
    # an identifier with several kinds of context has the best of all
    return _best(told.groupBy("context_id", "concept_id").agg(F.max("score").alias("score")), "context_id", k).select("context_id", "concept_id", "score", "rank")


def _best(scored: DataFrame, by: str, k: int) -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.col("score").desc(), "concept_id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """Every substring of ``size`` characters; none in a shorter or null text."""
    places = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: text.substr(i, F.lit(size)))


def titles_with(titles: DataFrame, concepts: DataFrame) -> DataFrame:
    """``action_title, concept_id`` of distinct titles that hold a concept's template.

    Each template is looked up by whichever of its substrings of three
    characters the fewest titles hold (its whole text if it is shorter), so
    common openings of titles and templates bring no candidates.
    """
    size = F.least(F.length("action_template"), F.lit(GRAM))
    sought = concepts.select("concept_id", "action_template", F.explode(F.array_distinct(
        F.coalesce(*[F.when(size == n, _grams(F.col("action_template"), n)) for n in range(1, GRAM + 1)]))).alias("gram"))
    held = titles.select("action_title", F.explode(F.array_distinct(
        F.concat(*[_grams(F.col("action_title"), n) for n in range(1, GRAM + 1)]))).alias("gram")).join(
        sought.select("gram").distinct(), "gram", "left_semi")
    rarest = sought.join(held.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("concept_id", "action_template").agg(
        F.count("*").alias("met"), F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    wanted = sought.groupBy("concept_id", "action_template").agg(F.count("*").alias("met"))
    whole = rarest.join(wanted, ["concept_id", "action_template", "met"])  # a template with a substring that no title holds is in none
    return held.join(whole, "gram").filter(F.expr("contains(action_title, action_template)")).select("action_title", "concept_id")


def matches(items: DataFrame, concepts: DataFrame, item: str) -> DataFrame:
    """Items (``item, action_type, action_title, tags``) and the concepts they fall under.

    By type, by tag, or by a template inside the title; an empty template is
    inside every title. All routes but the last are equi-joins; that one
    reads a single row of concepts.
    """
    c = concepts.select("concept_id", F.col("action_type").alias("c_type"), "action_template", F.col("tags").alias("c_tags"))
    by_type = items.join(c, items["action_type"] == c["c_type"]).select(item, "concept_id")
    by_tag = items.select(item, F.explode("tags").alias("tag")).join(c.select("concept_id", F.explode("c_tags").alias("tag")), "tag").select(item, "concept_id")
    inside = titles_with(items.select("action_title").distinct(), c.select("concept_id", "action_template"))
    by_title = items.join(inside, "action_title").select(item, "concept_id")
    blank = c.filter("action_template = ''").agg(F.collect_set("concept_id").alias("ids"))  # one row
    everywhere = items.filter("action_title IS NOT NULL").select(item, F.explode(blank.scalar()).alias("concept_id"))
    return by_type.unionByName(by_tag).unionByName(by_title).unionByName(everywhere).distinct()


def biased_priorities(actions: DataFrame, concepts: DataFrame) -> DataFrame:
    """Priorities scaled by the mean success of the concepts an action falls under."""
    met = matches(actions, concepts, "action_id").join(concepts.select("concept_id", "success_rate"), "concept_id")
    bias = met.groupBy("action_id").agg(F.avg("success_rate").alias("success"), F.count("*").alias("concepts"))
    return actions.join(bias, "action_id", "left").withColumn("biased", F.when(
        F.col("success").isNotNull(), F.least(F.lit(1.0), F.col("priority") * (0.5 + F.col("success")))).otherwise(F.col("priority"))
    ).na.fill(0, ["concepts"])


def suggestions(concepts: DataFrame) -> DataFrame:
    """Actions that concepts with much success and evidence speak for."""
    return concepts.filter("success_rate > 0.7 AND evidence_count > 5").select(
        "concept_id", "action_type", F.expr("replace(action_template, '{title}', name)").alias("action_title"),
        (F.col("confidence") * 0.9).alias("priority"))


def validate_concepts(concepts: DataFrame, executions: DataFrame, now: Column, counter_limit: int = 3) -> DataFrame:
    """Decayed confidence, counter-examples and next stage of every concept.

    Executions are counted per kind and title first, so a concept meets one row
    per title rather than one per execution.
    """
    counted = executions.groupBy("action_type", "action_title").agg(
        F.count_if("success").alias("won"), F.count_if(~F.col("success")).alias("lost"))
    items = counted.select(F.concat_ws("|", "action_type", "action_title").alias("item"), "*", F.array("action_type").alias("tags"))
    met = matches(items, concepts, "item").join(items.select("item", "won", "lost"), "item").groupBy("concept_id").agg(
        F.sum("won").alias("won"), F.sum("lost").alias("lost"))
    age = _hours(now, F.col("last_used"))
    decayed = F.when(age < 1, F.col("confidence")).otherwise(
        F.col("confidence") * (1 - F.least(0.01 * F.least(F.lit(1.0), age / 168), F.lit(0.5))))
    rows = concepts.join(met, "concept_id", "left").na.fill(0, ["won", "lost"]).withColumn("confidence", decayed).withColumn(
        "counter_examples", F.when(F.col("success_rate") > 0.5, F.col("lost")).when(F.col("success_rate") < 0.5, F.col("won")).otherwise(0))
    stale = (F.col("confidence") < 0.3) | (age > 720)
    stage = (
        F.when(F.col("counter_examples") >= counter_limit, "invalidated")
        .when(stale & (F.col("lifecycle") == "validated"), "deprecated").when(stale & (F.col("lifecycle") == "emerging"), "invalidated")
        .when((F.col("lifecycle") == "emerging") & (F.col("evidence_count") >= 10) & (F.col("success_rate") >= 0.7), "validated")
        .otherwise(F.col("lifecycle"))
    )
    return rows.withColumn("lifecycle", stage).drop("won", "lost")


# ---- latency of a query or stage log


def latency_rollup(log: DataFrame, by: str = "query_type", value: str = "duration_ms") -> DataFrame:
    """Count, mean and exact percentiles per kind: the value at position ``floor(n * q)``.

    Positions are found by counting inside whole milliseconds, so a kind with
    most of the rows is still spread over many tasks.
    """
    ranked = ordered.dense_index(log.select(by, value), [by], value, "_pos", bucket=F.floor(value).cast("long"))
    n = log.groupBy(by).agg(F.count("*").alias("count"), F.avg(value).alias("avg_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))
    at = ranked.join(n.select(by, "count"), by)

    def pick(q):
        spot = F.least(F.floor(F.col("count") * q), F.col("count") - 1)
        return F.max(F.when(F.col("_pos") == spot, F.col(value)))

    p = at.groupBy(by).agg(pick(0.5).alias("p50"), pick(0.95).alias("p95"), pick(0.99).alias("p99"))
    return n.join(p, by)


def latency_estimate(log: DataFrame, by: str = "query_type", value: str = "duration_ms") -> DataFrame:
    """Approximate percentiles in one pass."""
    p = F.percentile_approx(value, [0.5, 0.95, 0.99], 10000)
    return log.groupBy(by).agg(F.count("*").alias("count"), p.alias("p")).select(
        by, "count", *[F.element_at("p", i + 1).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


def cache_and_errors(log: DataFrame, by: str = "query_type") -> DataFrame:
    """Hit rate and errors per kind, from flags ``cache_hit`` and ``error``."""
    return log.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if("cache_hit").alias("hits"), F.count_if("error").alias("errors")
    ).withColumn("hit_rate", round3(F.col("hits") / F.greatest(F.col("total"), F.lit(1))))
