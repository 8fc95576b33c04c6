"""Rounds in which chains are counted."""

from causeway.operators import chains as C


def test_last_nodes_of_a_graph_are_not_looked_up_again(spark, monkeypatch):
    written = []
    monkeypatch.setattr(C, "checkpointed", lambda df: written.append("need" in df.columns and "met" in df.columns) or df.cache())
    edges = spark.createDataFrame([("g", "a", "b", "THROWS"), ("g", "b", "c", "THROWS"), ("g", "a", "c", "THROWS")], "graph_id string, src string, dst string, edge_type string")
    nodes = spark.createDataFrame([("g", x) for x in "bc"], "graph_id string, node_id string")
    assert {r["start"]: r["chains"] for r in C.count_chains(edges, nodes, local_work=0).collect()} == {"b": 1, "c": 2}
    assert sum(written) == 2
