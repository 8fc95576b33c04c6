import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from causeway.functions import ordered


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    # one key holds most of the rows
    data = [("hot", s, r.choice([None, 1, 2, 3])) for s in range(300)]
    data += [(f"k{i}", s, r.choice([None, 4, 5])) for i in range(5) for s in range(r.randint(1, 20))]
    return spark.createDataFrame(data, "run_id string, step long, v int")


def plain(df, kind, inclusive, reverse):
    w = Window.partitionBy("run_id").orderBy(F.col("step").desc() if reverse else F.col("step")).rowsBetween(
        Window.unboundedPreceding, 0 if inclusive else -1)
    fn = {"last": lambda: F.last("v", True), "sum": lambda: F.sum("v"), "max": lambda: F.max("v"), "min": lambda: F.min("v")}[kind]
    empty = 0 if kind == "sum" else None
    rows = df.select("run_id", "step", fn().over(w).alias("out")).collect()
    return {(x["run_id"], x["step"]): empty if x["out"] is None else x["out"] for x in rows}


@pytest.mark.parametrize("chunk", [None, 7, 64])
@pytest.mark.parametrize("reverse", [False, True])
@pytest.mark.parametrize("kind,inclusive", [("last", False), ("last", True), ("sum", True), ("sum", False), ("max", False), ("min", True)])
def test_running_equals_plain_window(rows, kind, inclusive, reverse, chunk):
    got = ordered.running(rows, ["run_id"], "step", {"out": (kind, F.col("v"), inclusive)}, reverse=reverse, chunk=chunk)
    assert {(x["run_id"], x["step"]): x["out"] for x in got.collect()} == plain(rows, kind, inclusive, reverse)


def test_previous_row_keeps_nulls(rows):
    got = ordered.previous_row(rows, ["run_id"], "step", {"p": F.col("v")}, chunk=9)
    w = Window.partitionBy("run_id").orderBy("step")
    want = rows.withColumn("p", F.lag("v").over(w))
    assert sorted(map(str, got.select("run_id", "step", "p").collect())) == sorted(map(str, want.select("run_id", "step", "p").collect()))


def test_dense_index(rows):
    sparse = rows.filter("step % 3 <> 1")
    got = ordered.dense_index(sparse, ["run_id"], "step", "n", chunk=8)
    w = Window.partitionBy("run_id").orderBy("step")
    want = sparse.withColumn("n", (F.row_number().over(w) - 1).cast("long"))
    assert sorted(map(str, got.select("run_id", "step", "n").collect())) == sorted(map(str, want.select("run_id", "step", "n").collect()))


@pytest.mark.parametrize("before,after", [(2, 0), (0, 3), (2, 3)])
def test_halo_frames(rows, before, after):
    d = ordered.with_halo(rows, "step", before, after, chunk=10)
    w = Window.partitionBy("run_id", "_chunk").orderBy("step").rowsBetween(-before, after)
    got = d.withColumn("s", F.sum("v").over(w)).filter("NOT _halo").select("run_id", "step", "s")
    plain_w = Window.partitionBy("run_id").orderBy("step").rowsBetween(-before, after)
    want = rows.withColumn("s", F.sum("v").over(plain_w)).select("run_id", "step", "s")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_fitting_chunk(rows):
    assert ordered.fitting_chunk(rows, "step", 1000) is None
    assert ordered.fitting_chunk(rows, "step", 100) == 100
