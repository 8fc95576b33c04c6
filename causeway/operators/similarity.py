"""Comparing, searching and clustering fingerprints.

Runs with equal fingerprints compare alike, so pairs are formed between the
distinct profiles, block against block (``profile_blocks``); runs are joined
to their profile afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions.values import jaccard, round3
from causeway.operators import hierarchy as H
from causeway.operators import profile_blocks as B
from causeway.session import checkpointed

_SETS = ["structures", "control", "roles", "invariant_set"]
PROFILE = ["algorithm", "complexity", *_SETS]


def with_roles(fp: DataFrame) -> DataFrame:
    """Distinct roles and names behind ``variable_roles`` (``name:role`` texts)."""
    return fp.withColumn("roles", F.array_sort(F.array_distinct(F.transform(
        "variable_roles", lambda x: F.substring_index(x, ":", -1))))).withColumn(
        "names", F.array_sort(F.array_distinct(F.transform("variable_roles", lambda x: F.substring_index(x, ":", 1)))))


def match_score(a: str, b: str) -> Column:
    """Similarity of two fingerprints held in struct columns ``a`` and ``b``."""
    def c(side, name):
        return F.col(f"{side}.{name}")

    def eq(name):
        return F.when(c(a, name) == c(b, name), 1.0).otherwise(0.0)

    def j(name):
        return jaccard(c(a, name), c(b, name))

    total = 4 * eq("algorithm") + 2 * j("structures") + 1.5 * j("control") + eq("complexity") + 1.5 * j("roles") + j("invariant_set")
    return round3(total / 11)


def match_pairs(fp: DataFrame, pairs: DataFrame) -> DataFrame:
    """Match score of given pairs ``(run_a, run_b)``."""
    side = F.struct(*PROFILE)
    f = with_roles(fp)
    return pairs.join(f.select(F.col("run_id").alias("run_a"), side.alias("a")), "run_a").join(
        f.select(F.col("run_id").alias("run_b"), side.alias("b")), "run_b").select("run_a", "run_b", match_score("a", "b").alias("score"))


def profiles(fp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct profiles with their number of runs, and the profile of each run."""
    keyed = with_roles(fp).withColumn("profile", F.xxhash64(*PROFILE))
    distinct = keyed.groupBy("profile").agg(*[F.first(c).alias(c) for c in PROFILE], F.count("*").alias("runs"))
    return distinct, keyed.select("run_id", "profile")


def profile_pairs(distinct: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Scores of all pairs of profiles that share anything; other pairs score 0."""
    corpus = B.packed(distinct)
    asked = corpus if queries is None else B.packed(queries)
    return _scored(B.meet(asked, corpus, B.listed, "profile_a long, profile_b long, score long"))


def score_counts(distinct: DataFrame) -> DataFrame:
    """How many ordered pairs of profiles that share anything have each score, without listing the pairs."""
    blocks = B.packed(distinct)
    return _scored(B.meet(blocks, blocks, B.counted, "score long, pairs long", upper=True).groupBy("score").agg(F.sum("pairs").alias("pairs")))


def _scored(found: DataFrame) -> DataFrame:
    return found.withColumn("score", F.col("score") / 1000)


def search(fp: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` best profiles of the corpus for each query run, with their number of runs."""
    corpus, _ = profiles(fp)
    corpus = checkpointed(corpus)
    blocks = B.packed(corpus)
    asked, of_run = (corpus, profiles(queries)[1]) if queries is fp else profiles(queries)
    found = B.meet(blocks if queries is fp else B.packed(asked), blocks, B.best(k), "profile_a long, profile_b long, score long")
    w = Window.partitionBy("profile_a").orderBy(F.col("score").desc(), "profile_b")
    best = _scored(found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))
    named = best.join(corpus.select(F.col("profile").alias("profile_b"), "runs"), "profile_b")
    return of_run.withColumnRenamed("profile", "profile_a").join(named, "profile_a").select(
        "run_id", F.col("profile_b").alias("profile"), "score", "rank", "runs")


# Weights of the six vectors.
WEIGHTS = {"algorithm": 4.0, "structure": 2.5, "control": 2.0, "semantic_role": 2.0, "invariant": 1.0, "behavior": 1.5}


def concept_scores(taxonomy: DataFrame) -> DataFrame:
    """Closeness of different concepts, a table of at most thirty squared rows."""
    anc = H.ancestors_of(H.parent_edges(taxonomy)).groupBy("node_id").agg(
        F.collect_list(F.struct("ancestor", "depth")).alias("up"))
    c = taxonomy.join(anc, taxonomy["concept_id"] == anc["node_id"], "left").select(
        "concept_id", "category", "family", "parents", F.transform("related", lambda r: r["target"]).alias("links"),
        F.coalesce("up", F.array().cast("array<struct<ancestor:string,depth:int>>")).alias("up"), F.lit(1).alias("one"))
    a = c.select(F.struct("*").alias("a"), "one")
    b = c.select(F.struct("*").alias("b"), "one")
    pair = a.join(b, "one").filter("a.concept_id <> b.concept_id")
    shared = F.filter("a.up", lambda x: F.exists("b.up", lambda y: y["ancestor"] == x["ancestor"]))
    near = F.array_min(F.transform(shared, lambda x: x["depth"] + 1))
    same_family = F.col("a.family") == F.col("b.family")
    score = (
        F.when(same_family & F.arrays_overlap("a.parents", "b.parents"), 0.7)
        .when(same_family & (F.array_contains("b.parents", F.col("a.concept_id")) | F.array_contains("a.parents", F.col("b.concept_id"))), 0.5)
        .when(same_family, 0.4).when(F.col("a.category") == F.col("b.category"), 0.2)
        .when(F.array_contains("a.links", F.col("b.concept_id")) | F.array_contains("b.links", F.col("a.concept_id")), 0.3)
        .when(near.isNotNull(), F.greatest(F.lit(0.1), 0.5 - near * 0.1)).otherwise(0.0)
    )
    return pair.select(F.col("a.concept_id").alias("x"), F.col("b.concept_id").alias("y"), score.alias("closeness"))


def bridged(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean closeness of the elements of one set to their best partner in another.

    ``pairs`` has ``pair_id, only_a, only_b``; partners need a closeness above 0.3.
    """
    left = pairs.select("pair_id", F.explode("only_a").alias("x"), "only_b")
    near = left.select("pair_id", "x", F.explode("only_b").alias("y")).join(scores, ["x", "y"])
    best = near.groupBy("pair_id", "x").agg(F.max("closeness").alias("best")).filter("best > 0.3")
    return best.groupBy("pair_id").agg(F.avg("best").alias("bridge"))


def _overlap(a: Column, b: Column, bridge: Column) -> Column:
    """Shared over all, bridged elements counting in part; 0.5 when both are empty."""
    shared = F.size(F.array_intersect(a, b))
    union = F.size(F.array_union(a, b))
    partial = bridge * F.least(F.size(F.array_except(a, b)), F.size(F.array_except(b, a)))
    return F.when(union == 0, 0.5).otherwise(F.least((shared + partial) / union, F.lit(1.0)))


def compare(fp: DataFrame, pairs: DataFrame, taxonomy: DataFrame | None = None) -> DataFrame:
    """Six-vector similarity of given pairs ``(run_a, run_b)``.

    With a taxonomy, elements that differ but are close concepts count in part.
    """
    cols = ["algorithm", "algorithm_confidence", "structures", "control", "roles", "names", "invariant_set", "behaviors"]
    side = F.struct(*cols)
    f = with_roles(fp)
    p = pairs.join(f.select(F.col("run_id").alias("run_a"), side.alias("a")), "run_a").join(
        f.select(F.col("run_id").alias("run_b"), side.alias("b")), "run_b").withColumn(
        "pair_id", F.concat_ws("|", "run_a", "run_b"))
    sets = {"structure": "structures", "control": "control", "semantic_role": "roles", "invariant": "invariant_set", "behavior": "behaviors"}
    if taxonomy is not None:
        # written once: every vector reads both, and joins p to what it found
        scores, base = checkpointed(concept_scores(taxonomy)), checkpointed(p)
        p = base
        for name, col in sets.items():
            a, b = F.col(f"a.{col}"), F.col(f"b.{col}")
            only = base.select("pair_id", F.array_except(a, b).alias("only_a"), F.array_except(b, a).alias("only_b"))
            p = p.join(bridged(only, scores).withColumnRenamed("bridge", f"_{name}"), "pair_id", "left")
    same = F.col("a.algorithm") == F.col("b.algorithm")
    unknown = (F.col("a.algorithm") == "unknown") | (F.col("b.algorithm") == "unknown")
    trust = 0.5 + 0.5 * (F.col("a.algorithm_confidence") + F.col("b.algorithm_confidence")) / 2
    vectors = {"algorithm": F.when(same, 1.0).when(unknown, 0.1).otherwise(0.0) * trust}
    for name, col in sets.items():
        bridge = F.coalesce(F.col(f"_{name}"), F.lit(0.0)) if taxonomy is not None else F.lit(0.0)
        score = _overlap(F.col(f"a.{col}"), F.col(f"b.{col}"), bridge)
        if name == "semantic_role":
            both = (F.size("a.names") > 0) & (F.size("b.names") > 0)
            some = F.size(F.array_union("a.roles", "b.roles")) > 0
            score = F.when(some & both, F.least(0.7 * score + 0.3 * jaccard(F.col("a.names"), F.col("b.names")), F.lit(1.0))).otherwise(score)
        vectors[name] = score
    out = p.select("run_a", "run_b", *[round3(v).alias(n) for n, v in vectors.items()])
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return out.withColumn("score", round3(total))


def clusters(fp: DataFrame, by: str = "algorithm") -> DataFrame:
    """Members of each cluster as rows, with the size of the cluster."""
    sizes = fp.groupBy(by).agg(F.count("*").alias("size"))
    return fp.select("run_id", by).join(sizes, by)


def by_structure(fp: DataFrame) -> DataFrame:
    return fp.select("run_id", F.explode("structures").alias("structure"))


def index_stats(fp: DataFrame) -> DataFrame:
    return fp.groupBy("algorithm").agg(F.countDistinct("hash").alias("fingerprints"), F.count("*").alias("runs"))


def duplicates(fp: DataFrame) -> DataFrame:
    """Fingerprints shared by several runs."""
    return fp.groupBy("hash").agg(F.count("*").alias("runs"), F.min("run_id").alias("first_run")).filter("runs > 1")
