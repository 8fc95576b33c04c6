"""Nodes on which very many rows stand."""

from pyspark.sql import functions as F

from causeway.operators import deep


def test_rows_that_meet_at_one_node_stay_spread(spark):
    was = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for c, v in zip(was, ("-1", "false")):
            spark.conf.set(c, v)
        n = 40_000
        leaves = spark.range(n, numPartitions=8).select(F.lit("g").alias("graph_id"), F.concat(F.lit("leaf"), F.col("id").cast("string")).alias("from_node"), F.lit("hub").alias("to_node"))
        edges = leaves.unionByName(spark.createDataFrame([("g", "hub", "mid"), ("g", "mid", "root")], "graph_id string, from_node string, to_node string"))
        seeds = leaves.select("graph_id", F.col("from_node").alias("seed"), F.col("from_node").alias("node"))
        found = deep.lifted(edges, seeds, "graph_id")
        depths = {r["depth"]: r["count"] for r in found.groupBy("depth").count().collect()}
        assert depths == {0: n, 1: n, 2: n, 3: n}
        at_root = found.filter("node = 'root'").groupBy(F.spark_partition_id()).count()
        assert at_root.agg(F.max("count")).first()[0] < n / 2
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
