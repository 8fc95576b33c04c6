"""Similarity, search and clustering of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from causeway.functions.values import jaccard, round3
from causeway.operators import hierarchy as H
from causeway.operators import similarity as S
from causeway.sources import fixtures as X
from causeway.suite import query
from causeway.suite.archetypes import ID_CTES, fingerprints
from causeway.suite.duck import cte

# sets per user, read as fingerprints
SETS = """
  SELECT run_id, CASE WHEN u % 4 = 0 THEN 'unknown' ELSE 'a' || (u % 4) END AS algorithm, (u % 4) / 4.0 AS algorithm_confidence, 'c' || (u % 3) AS complexity,
    coalesce(list(DISTINCT w) FILTER (value > 180), []) AS structures, coalesce(list(DISTINCT w) FILTER (step < 3), []) AS control,
    coalesce(list(DISTINCT w || ':x' || (u % 5)) FILTER (value > 150), []) AS variable_roles,
    coalesce(list(DISTINCT 'x' || (u % 5)) FILTER (value > 150), []) AS roles, coalesce(list(DISTINCT w) FILTER (value > 150), []) AS names,
    coalesce(list(DISTINCT 'i' || (k % 7)) FILTER (k < 10), []) AS invariant_set, coalesce(list(DISTINCT 'b' || (k % 5)) FILTER (k > 95), []) AS behaviors
  FROM (SELECT *, user_id AS u FROM ev) GROUP BY run_id, u"""
J = "CASE WHEN len(list_distinct(list_concat(a.{0}, b.{0}))) = 0 THEN 0 ELSE len(list_intersect(a.{0}, b.{0})) * 1.0 / len(list_distinct(list_concat(a.{0}, b.{0}))) END"
MATCH = ("round((CASE WHEN a.algorithm = b.algorithm THEN 4 ELSE 0 END + 2 * (" + J.format("structures") + ") + 1.5 * (" + J.format("control")
         + ") + CASE WHEN a.complexity = b.complexity THEN 1 ELSE 0 END + 1.5 * (" + J.format("roles") + ") + (" + J.format("invariant_set") + ")) / 11.0, 3)")
PROF = "SELECT DISTINCT algorithm, complexity, list_sort(structures) AS structures, list_sort(control) AS control, list_sort(roles) AS roles, list_sort(invariant_set) AS invariant_set FROM sets"


def user_sets(spark, sf):
    from causeway.sources.fixtures import indexed_events
    ev = X.stored(spark, sf, "events", lambda: indexed_events(spark, sf))
    u, w, k, v = F.col("run_id").cast("long"), F.col("w"), F.col("k"), F.col("value")

    def found(value, cond):
        return F.array_sort(F.collect_set(F.when(cond, value)))

    return ev.groupBy("run_id", u.alias("u")).agg(
        found(w, v > 180).alias("structures"), found(w, F.col("step") < 3).alias("control"),
        found(F.concat(w, F.lit(":x"), (u % 5).cast("string")), v > 150).alias("variable_roles"),
        found(F.concat(F.lit("i"), (k % 7).cast("string")), k < 10).alias("invariant_set"),
        found(F.concat(F.lit("b"), (k % 5).cast("string")), k > 95).alias("behaviors"),
    ).withColumn("algorithm", F.when(F.col("u") % 4 == 0, "unknown").otherwise(F.concat(F.lit("a"), (F.col("u") % 4).cast("string")))
    ).withColumn("algorithm_confidence", (F.col("u") % 4) / 4.0).withColumn("complexity", F.concat(F.lit("c"), (F.col("u") % 3).cast("string"))).drop("u")


def neighbours(fp):
    """Each user with the next one, as a table of pairs."""
    return fp.select(F.col("run_id").alias("run_a"), (F.col("run_id").cast("long") + 1).cast("string").alias("run_b"))


@query("j1_match", cte(f"SELECT a.run_id AS run_a, b.run_id AS run_b, {MATCH} AS score FROM sets a JOIN sets b ON CAST(b.run_id AS INTEGER) = CAST(a.run_id AS INTEGER) + 1", sets=SETS))
def j1(spark, sf):
    fp = user_sets(spark, sf)
    return S.match_pairs(fp, neighbours(fp))


@query("j2_search", cte(f"""
  SELECT run_id, score, rank FROM (SELECT a.run_id, {MATCH} AS score, row_number() OVER (PARTITION BY a.run_id ORDER BY {MATCH} DESC) AS rank
    FROM sets a CROSS JOIN prof b) WHERE rank <= 5 AND score > 0""", sets=SETS, prof=PROF))
def j2(spark, sf):
    fp = user_sets(spark, sf)
    return S.search(fp, fp).filter("score > 0").select("run_id", "score", F.col("rank").cast("long").alias("rank"))


def _set_score(col):
    u, i = f"len(list_distinct(list_concat(a.{col}, b.{col})))", f"len(list_intersect(a.{col}, b.{col}))"
    return f"CASE WHEN {u} = 0 THEN 0.5 ELSE least({i} * 1.0 / {u}, 1) END"


VEC = f"""
  SELECT a.run_id AS run_a, b.run_id AS run_b,
    round(CASE WHEN a.algorithm = b.algorithm THEN 1.0 WHEN a.algorithm = 'unknown' OR b.algorithm = 'unknown' THEN 0.1 ELSE 0 END
          * (0.5 + 0.5 * (a.algorithm_confidence + b.algorithm_confidence) / 2), 3) AS algorithm,
    round({_set_score('structures')}, 3) AS structure, round({_set_score('control')}, 3) AS control,
    round(CASE WHEN len(a.names) > 0 AND len(b.names) > 0 THEN 0.7 * ({_set_score('roles')}) + 0.3 * ({J.format('names')}) ELSE {_set_score('roles')} END, 3) AS semantic_role,
    round({_set_score('invariant_set')}, 3) AS invariant, round({_set_score('behaviors')}, 3) AS behavior
  FROM sets a JOIN sets b ON CAST(b.run_id AS INTEGER) = CAST(a.run_id AS INTEGER) + 1"""


@query("j3_similarity", cte("""
  SELECT *, round((4 * algorithm + 2.5 * structure + 2 * control + 2 * semantic_role + invariant + 1.5 * behavior) / 13, 3) AS score FROM vec""", sets=SETS, vec=VEC))
def j3(spark, sf):
    fp = user_sets(spark, sf)
    return S.compare(fp, neighbours(fp))


# concepts a user's sets name, and their closeness
_CON = ["memo_table", "visited_set", "stack_dfs", "dynamic_programming", "greedy"]
CONCEPTS = {"click": "memo_table", "error": "visited_set", "purchase": "stack_dfs", "signup": "dynamic_programming", "view": "greedy"}
CSET = "SELECT run_id, list(DISTINCT CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CONCEPTS.items()) + " END) FILTER (value > 180) AS s FROM ev GROUP BY run_id"
CSC = """
  SELECT unnest(['memo_table', 'visited_set', 'dynamic_programming', 'greedy', 'memo_table', 'dynamic_programming', 'stack_dfs', 'dynamic_programming', 'stack_dfs', 'greedy', 'visited_set', 'stack_dfs']) AS x,
    unnest(['visited_set', 'memo_table', 'greedy', 'dynamic_programming', 'dynamic_programming', 'memo_table', 'dynamic_programming', 'stack_dfs', 'greedy', 'stack_dfs', 'stack_dfs', 'visited_set']) AS y,
    unnest([0.7, 0.7, 0.7, 0.7, 0.3, 0.3, 0, 0, 0, 0, 0, 0]) AS closeness"""


@query("j4_bridged_overlap", cte("""
  SELECT pair_id, round(avg(best), 3) AS bridge FROM (
    SELECT a.run_id || '|' || b.run_id AS pair_id, x.v, max(closeness) AS best FROM cset a JOIN cset b ON CAST(b.run_id AS INTEGER) = CAST(a.run_id AS INTEGER) + 1,
      unnest(list_filter(a.s, lambda q: NOT list_contains(coalesce(b.s, []), q))) x(v), unnest(list_filter(b.s, lambda q: NOT list_contains(coalesce(a.s, []), q))) y(v)
    JOIN csc ON csc.x = x.v AND csc.y = y.v GROUP BY ALL) WHERE best > 0.3 GROUP BY pair_id""", cset=CSET, csc=CSC))
def j4(spark, sf):
    from causeway.sources.fixtures import indexed_events
    ev = X.stored(spark, sf, "events", lambda: indexed_events(spark, sf))
    name = F.element_at(F.create_map(*[x for k, v in CONCEPTS.items() for x in (F.lit(k), F.lit(v))]), F.col("w"))
    s = ev.groupBy("run_id").agg(F.collect_set(F.when(F.col("value") > 180, name)).alias("s"))
    p = neighbours(s).join(s.withColumnsRenamed({"run_id": "run_a", "s": "a"}), "run_a").join(s.withColumnsRenamed({"run_id": "run_b", "s": "b"}), "run_b")
    only = p.select(F.concat_ws("|", "run_a", "run_b").alias("pair_id"), F.array_except("a", "b").alias("only_a"), F.array_except("b", "a").alias("only_b"))
    return S.bridged(only, S.concept_scores(H.concepts(spark))).withColumn("bridge", round3(F.col("bridge")))


@query("j3_similarity_with_taxonomy")
def j3b(spark, sf):
    fp = fingerprints(spark, sf)
    return S.compare(fp, neighbours(fp), H.concepts(spark))


@query("j5_profile_matrix", cte(f"""
  SELECT score, count(*) AS pairs FROM (SELECT {MATCH} AS score FROM prof a CROSS JOIN prof b) WHERE score > 0 GROUP BY score""", sets=SETS, prof=PROF))
def j5(spark, sf):
    distinct, _ = S.profiles(user_sets(spark, sf))
    return S.score_counts(distinct).filter("score > 0")


@query("j5_weekly_matrix", """
  WITH s AS (SELECT user_id, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS week, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY ALL)
  SELECT a.user_id, a.week, round(len(list_intersect(a.types, b.types)) * 1.0 / len(list_distinct(list_concat(a.types, b.types))), 3) AS score
  FROM s a JOIN s b ON a.user_id = b.user_id AND b.week = a.week + 1""")
def j5b(spark, sf):
    e = X.table(spark, sf, "events")
    week = F.floor(F.unix_timestamp("ts") / 604800)
    s = e.groupBy("user_id", week.alias("week")).agg(F.collect_set("event_type").alias("types"))
    nxt = s.select("user_id", (F.col("week") - 1).alias("week"), F.col("types").alias("next"))
    return s.join(nxt, ["user_id", "week"]).select("user_id", "week", round3(jaccard(F.col("types"), F.col("next"))).alias("score"))


@query("j6_clusters", cte("SELECT run_id, algorithm, count(*) OVER (PARTITION BY algorithm) AS size FROM sets", sets=SETS))
def j6(spark, sf):
    return S.clusters(user_sets(spark, sf))


@query("j6_by_structure", cte("SELECT run_id, canonical_id AS structure FROM can WHERE category = 'structure'", **ID_CTES))
def j6b(spark, sf):
    return S.by_structure(fingerprints(spark, sf))


@query("j6_index_stats", cte("SELECT algorithm, count(DISTINCT hash) AS fingerprints, count(*) AS runs FROM fp GROUP BY algorithm", **ID_CTES))
def j6c(spark, sf):
    return S.index_stats(fingerprints(spark, sf))


@query("j6_vector_labels", "SELECT vec_id, label, count(*) OVER (PARTITION BY label) AS size FROM embeddings")
def j6d(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("run_id"), "label")
    return S.clusters(e, "label").withColumnRenamed("run_id", "vec_id")


@query("j7_duplicates", cte("SELECT hash, count(*) AS runs, min(run_id) AS first_run FROM fp GROUP BY hash HAVING count(*) > 1", **ID_CTES))
def j7(spark, sf):
    return S.duplicates(fingerprints(spark, sf))
