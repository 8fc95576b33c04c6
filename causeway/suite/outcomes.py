"""Outcome learning: events as executed actions, orders as contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.values import round3
from causeway.operators import outcomes as O
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.duck import cte

EX = """SELECT CAST(event_id AS VARCHAR) AS execution_id, event_type AS action_type, event_type || '-' || (k % 10) AS action_title, value > 20 AS success, ts, k, value
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)"""
NOW = "(SELECT max(ts) FROM events)"
RT = "SELECT action_type, count(*) AS n, avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0 END) AS rate, max(ts) AS last FROM ex GROUP BY action_type"
RN = "SELECT action_title, count(*) AS n, avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0 END) AS rate, max(ts) AS last FROM ex GROUP BY action_title"
RC = "SELECT * FROM ex"
CO = """
  SELECT 'type:' || action_type AS concept_id, action_type, action_type || ': {title}' AS action_template, rate AS confidence, n AS evidence_count, rate AS success_rate, [action_type] AS tags, last AS last_used, action_type AS name
  FROM (SELECT action_type, count(*) AS n, avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0 END) AS rate, max(ts) AS last FROM rc GROUP BY action_type) WHERE n >= 3 AND rate >= 0.6
  UNION ALL SELECT 'title:' || substr(md5(action_title), 1, 8), ty, action_title, rate, n, rate, [ty, 'specific'], last, action_title
  FROM (SELECT action_title, any_value(action_type) AS ty, count(*) AS n, avg(CASE WHEN success THEN 1.0::DOUBLE ELSE 0 END) AS rate, max(ts) AS last FROM rc GROUP BY action_title) WHERE n >= 3 AND rate >= 0.6
  UNION ALL SELECT 'pair:' || a.t || '+' || b.t, a.t, a.t || ' + ' || b.t, 0.8, a.w * b.w, 0.8, [a.t, b.t], (SELECT max(ts) FROM events), a.t || ' + ' || b.t
  FROM (SELECT action_type AS t, count(*) AS w FROM rc WHERE success GROUP BY 1) a JOIN (SELECT action_type AS t, count(*) AS w FROM rc WHERE success GROUP BY 1) b ON a.t < b.t WHERE a.w * b.w >= 3"""
ALL = {"ex": EX, "rt": RT, "rn": RN, "rc": RC, "co": CO}


def executions(spark, sf):
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int")
    return X.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("execution_id"), F.col("event_type").alias("action_type"),
        F.concat_ws("-", "event_type", (k % 10).cast("string")).alias("action_title"), (F.col("value") > 20).alias("success"), "ts",
        k.alias("k"), "value")


def now(spark, sf):
    """The moment of the last event: one value read from the table."""
    return F.lit(X.table(spark, sf, "events").agg(F.max("ts")).first()[0])


@query("l15_success_rates", cte("SELECT action_type AS name, n, round(rate, 3) AS rate FROM rt UNION ALL SELECT action_title, n, round(rate, 3) FROM rn", **ALL))
def l15(spark, sf):
    e = executions(spark, sf)
    out = None
    for by in ("action_type", "action_title"):
        part = O.success_rates(e, by).select(F.col(by).alias("name"), "n", round3(F.col("rate")).alias("rate"))
        out = part if out is None else out.unionByName(part)
    return out


@query("l15_best_worst", cte("""
  SELECT action_title, round(rate, 3) AS rate, 'best' AS end_of FROM (SELECT * FROM rn ORDER BY rate DESC, action_title LIMIT 5)
  UNION ALL SELECT action_title, round(rate, 3), 'worst' FROM (SELECT * FROM rn ORDER BY rate, action_title LIMIT 5)""", **ALL))
def l15b(spark, sf):
    r = O.success_rates(executions(spark, sf), "action_title")
    best = O.extremes(r, "action_title").withColumn("end_of", F.lit("best"))
    worst = O.extremes(r, "action_title", worst=True).withColumn("end_of", F.lit("worst"))
    return best.unionByName(worst).select("action_title", round3(F.col("rate")).alias("rate"), "end_of")


@query("l16_outcome_deltas", cte("""
  SELECT execution_id, k - k * 3 % 100 AS steps_reduction, k % 3 - k % 2 AS violations_reduction, k % 7 - k % 5 AS calls_reduction,
    round((coalesce(CASE WHEN k > 0 THEN least(1, (k - k * 3 % 100) * 1.0::DOUBLE / greatest(1, k)) END, 0) + sign(k % 3 - k % 2)
     + coalesce(CASE WHEN k % 7 > 0 THEN least(1, (k % 7 - k % 5) * 1.0::DOUBLE / greatest(1, k % 7)) END, 0)) / (1 + CASE WHEN k > 0 THEN 1 ELSE 0 END + CASE WHEN k % 7 > 0 THEN 1 ELSE 0 END), 3) AS improvement
  FROM ex""", **ALL))
def l16(spark, sf):
    k, v = F.col("k"), F.col("value")
    e = executions(spark, sf).select(
        "execution_id",
        F.struct(k.alias("steps"), (k % 3).alias("violations"), (k % 7).alias("calls"), (k % 4).alias("depth"), v.alias("ms")).alias("pre"),
        F.struct((k * 3 % 100).alias("steps"), (k % 2).alias("violations"), (k % 5).alias("calls"), (k % 6).alias("depth"), (v / 2).alias("ms")).alias("post"))
    return O.outcome_deltas(e).select("execution_id", "steps_reduction", "violations_reduction", "calls_reduction", round3(F.col("improvement")).alias("improvement"))


@query("l17_adaptive_priority", cte(f"""
  SELECT a.action_type, a.action_title, round(greatest(0, least(1, pr * (0.5 + coalesce(n.rate, t.rate, 0.5)) * CASE WHEN l IS NULL THEN 1.2 WHEN age < 1 THEN 1.0 WHEN age < 24 THEN 1.1 ELSE 1.2 END::DOUBLE
      + CASE WHEN l IS NULL THEN 0.1 ELSE 0 END)), 3) AS adjusted
  FROM (SELECT a.*, coalesce(greatest(n.last, t.last), n.last, t.last) AS l, date_diff('microsecond', coalesce(greatest(n.last, t.last), n.last, t.last), {NOW}) / 3.6e9 AS age
        FROM (SELECT p_type AS action_type, p_brand AS action_title, 0.3::DOUBLE AS pr FROM part UNION SELECT action_type, action_type || '-' || x, 0.6::DOUBLE FROM rt, unnest([3, 7, 77]) u(x)) a
        LEFT JOIN rn n USING (action_title) LEFT JOIN rt t USING (action_type)) a
  LEFT JOIN rn n USING (action_title) LEFT JOIN rt t USING (action_type)""", **ALL))
def l17(spark, sf):
    e = executions(spark, sf)
    untried = X.table(spark, sf, "part").select(F.col("p_type").alias("action_type"), F.col("p_brand").alias("action_title"), F.lit(0.3).alias("priority")).distinct()
    tried = e.select("action_type").distinct().select("action_type", F.explode(F.array(F.lit("3"), F.lit("7"), F.lit("77"))).alias("x")).select(
        "action_type", F.concat_ws("-", "action_type", "x").alias("action_title"), F.lit(0.6).alias("priority"))
    return O.adaptive_priorities(untried.unionByName(tried), e, now(spark, sf)).select("action_type", "action_title", round3(F.col("adjusted")).alias("adjusted"))


@query("l18_concepts", cte("SELECT concept_id, action_type, action_template, round(confidence, 3) AS confidence, evidence_count FROM co", **ALL))
def l18(spark, sf):
    return O.extract_concepts(executions(spark, sf), now(spark, sf)).select(
        "concept_id", "action_type", "action_template", round3(F.col("confidence")).alias("confidence"), "evidence_count")


@query("l18_concept_memory", cte("""
  SELECT concept_id, round(success_rate, 3) AS success_rate, evidence_count, round(confidence, 3) AS confidence FROM (
    SELECT coalesce(a.concept_id, b.concept_id) AS concept_id, CASE WHEN a.concept_id IS NOT NULL AND b.concept_id IS NOT NULL
        THEN (a.success_rate * a.evidence_count + b.success_rate * b.evidence_count) / (a.evidence_count + b.evidence_count) ELSE coalesce(a.success_rate, b.success_rate) END AS success_rate,
      coalesce(a.evidence_count, 0) + coalesce(b.evidence_count, 0) AS evidence_count,
      CASE WHEN a.concept_id IS NOT NULL AND b.concept_id IS NOT NULL THEN least(0.95, a.confidence + 0.01) ELSE coalesce(a.confidence, b.confidence) END AS confidence
    FROM co a FULL JOIN (SELECT 'type:' || action_type AS concept_id, n AS evidence_count, rate AS success_rate, rate AS confidence FROM rt) b USING (concept_id))""", **ALL))
def l18b(spark, sf):
    e, t = executions(spark, sf), now(spark, sf)
    whole = O.success_rates(e).select(
        F.concat(F.lit("type:"), "action_type").alias("concept_id"), F.col("action_type").alias("name"), "action_type", F.col("action_type").alias("action_template"),
        F.col("rate").alias("confidence"), F.col("n").alias("evidence_count"), F.col("rate").alias("success_rate"), F.array("action_type").alias("tags"),
        F.col("last_ts").alias("last_used"), F.lit("emerging").alias("lifecycle"))
    return O.remember(O.extract_concepts(e, t), whole, t).select(
        "concept_id", round3(F.col("success_rate")).alias("success_rate"), "evidence_count", round3(F.col("confidence")).alias("confidence"))


@query("l19_relevant_concepts", cte(f"""
  SELECT context_id, concept_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY context_id ORDER BY score DESC, concept_id) AS rank FROM (
    SELECT x.context_id, c.concept_id, round(c.confidence * CASE WHEN age < 24 THEN 1.2 WHEN age > 168 THEN 0.8 ELSE 1 END::DOUBLE * CASE WHEN evidence_count > 10 THEN 1.3 ELSE 1 END::DOUBLE
      * CASE WHEN c.action_type = x.action_type THEN 1.5 ELSE 1 END::DOUBLE * (1 + 0.2::DOUBLE * len(list_intersect(c.tags, x.tags))), 3) AS score
    FROM (SELECT *, date_diff('microsecond', last_used, {NOW}) / 3.6e9 AS age FROM co) c,
      (SELECT 'ctx' || user_id || event_type AS context_id, event_type AS action_type, [event_type, 'specific'] AS tags FROM events GROUP BY user_id, event_type) x)) WHERE rank <= 5""", **ALL))
def l19(spark, sf):
    t = now(spark, sf)
    ctx = X.table(spark, sf, "events").select("user_id", "event_type").distinct().select(
        F.concat(F.lit("ctx"), F.col("user_id").cast("string"), "event_type").alias("context_id"), F.col("event_type").alias("action_type"),
        F.array("event_type", F.lit("specific")).alias("tags"))
    return O.relevant_concepts(O.extract_concepts(executions(spark, sf), t), ctx, t)


MT = """
  SELECT a.action_id, c.concept_id, c.success_rate FROM (SELECT DISTINCT action_title AS action_id, action_type, action_title FROM ex
     UNION SELECT DISTINCT p_type || p_brand, p_type, p_brand FROM part) a
  JOIN co c ON c.action_type = a.action_type OR contains(a.action_title, c.action_template) OR list_contains(c.tags, a.action_type)"""


@query("l20_concept_bias", cte("""
  SELECT a.action_id, concepts, round(CASE WHEN s IS NULL THEN 0.5 ELSE least(1, 0.5 * (0.5 + s)) END, 3) AS biased FROM (
    SELECT DISTINCT action_title AS action_id FROM ex UNION SELECT DISTINCT p_type || p_brand FROM part) a
  LEFT JOIN (SELECT action_id, avg(success_rate) AS s FROM mt GROUP BY action_id) USING (action_id)
  JOIN (SELECT a2.action_id, count(mt.concept_id) AS concepts FROM (SELECT DISTINCT action_title AS action_id FROM ex UNION SELECT DISTINCT p_type || p_brand FROM part) a2
        LEFT JOIN mt USING (action_id) GROUP BY a2.action_id) USING (action_id)""", mt=MT, **ALL))
def l20(spark, sf):
    e = executions(spark, sf)
    tried = e.select(F.col("action_title").alias("action_id"), "action_type", "action_title").distinct()
    parts = X.table(spark, sf, "part").select(F.concat("p_type", "p_brand").alias("action_id"), F.col("p_type").alias("action_type"), F.col("p_brand").alias("action_title")).distinct()
    acts = tried.unionByName(parts).withColumn("tags", F.array("action_type")).withColumn("priority", F.lit(0.5))
    return O.biased_priorities(acts, O.extract_concepts(e, now(spark, sf))).select("action_id", "concepts", round3(F.col("biased")).alias("biased"))


@query("l20_suggestions", cte("SELECT concept_id, action_type, replace(action_template, '{title}', name) AS action_title, round(confidence * 0.9::DOUBLE, 3) AS priority FROM co "
                              "WHERE success_rate > 0.7 AND evidence_count > 5", **ALL))
def l20b(spark, sf):
    return O.suggestions(O.extract_concepts(executions(spark, sf), now(spark, sf))).withColumn("priority", round3(F.col("priority")))


@query("l21_validation", cte(f"""
  SELECT concept_id, round(CASE WHEN age < 1 THEN confidence ELSE confidence * (1 - 0.01::DOUBLE * least(1, age / 168)) END, 4) AS confidence, lost AS counter_examples,
    CASE WHEN lost >= 3 THEN 'invalidated' WHEN evidence_count >= 10 AND success_rate >= 0.7 THEN 'validated' ELSE 'emerging' END AS lifecycle
  FROM (SELECT c.*, date_diff('microsecond', last_used, {NOW}) / 3.6e9 AS age, (SELECT count(*) FROM ex e WHERE NOT success AND (e.action_type = c.action_type
          OR contains(e.action_title, c.action_template) OR list_contains(c.tags, e.action_type))) AS lost FROM co c)""", **ALL))
def l21(spark, sf):
    e = executions(spark, sf)
    return O.validate_concepts(O.extract_concepts(e, now(spark, sf)), e, now(spark, sf)).select(
        "concept_id", F.round("confidence", 4).alias("confidence"), "counter_examples", "lifecycle")


@query("l22_latency_rollup", """
  SELECT event_type AS query_type, count(*) AS count, round(avg(value), 3) AS avg_ms, min(value) AS min_ms, max(value) AS max_ms,
    list_sort(list(value))[CAST(floor(count(*) * 0.5) AS INTEGER) + 1] AS p50, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS INTEGER) + 1] AS p95,
    list_sort(list(value))[CAST(floor(count(*) * 0.99) AS INTEGER) + 1] AS p99 FROM events GROUP BY event_type""")
def l22(spark, sf):
    log = X.table(spark, sf, "events").select(F.col("event_type").alias("query_type"), F.col("value").alias("duration_ms"))
    return O.latency_rollup(log).withColumn("avg_ms", round3(F.col("avg_ms")))


@query("l22_cache_and_errors", """
  SELECT event_type AS query_type, count(*) AS total, count(*) FILTER (value < 10) AS hits, count(*) FILTER (value > 200) AS errors,
    round(count(*) FILTER (value < 10) * 1.0::DOUBLE / count(*), 3) AS hit_rate FROM events GROUP BY event_type""")
def l22b(spark, sf):
    log = X.table(spark, sf, "events").select(F.col("event_type").alias("query_type"), (F.col("value") < 10).alias("cache_hit"), (F.col("value") > 200).alias("error"))
    return O.cache_and_errors(log)


@query("l22_latency_estimate")
def l22c(spark, sf):
    log = X.table(spark, sf, "events").select(F.col("event_type").alias("query_type"), F.col("value").alias("duration_ms"))
    return O.latency_estimate(log)
