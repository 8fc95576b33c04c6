"""Reading recorded traces and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.schemas import STEP_JSON


def read_steps_json(spark: SparkSession, path: str) -> DataFrame:
    """Step records as dumped by a recorder, one JSON object per line."""
    return spark.read.schema(STEP_JSON).json(path)


def to_steps(records: DataFrame) -> DataFrame:
    none = F.array().cast("array<string>")
    return records.select(
        "run_id", F.col("index").alias("step"), F.lit(None).cast("timestamp").alias("ts"), "file", "line", "code", "func",
        "depth", "call_id", "indent", "block_id",
        F.coalesce("ast_reads", none).alias("reads"), F.coalesce("ast_writes", none).alias("writes"))


def to_snapshots(records: DataFrame) -> DataFrame:
    return records.select("run_id", F.col("index").alias("step"), F.explode("vars").alias("var", "v")).select(
        "run_id", "step", "var", "v.value", "v.type", "v.memory_id", F.lit(None).cast("array<string>").alias("container_keys"))


def read_trace(spark: SparkSession, path: str, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """Steps and snapshots of a recorded trace, from JSON lines or Parquet."""
    records = read_steps_json(spark, path) if fmt == "json" else spark.read.format(fmt).load(path)
    return to_steps(records), to_snapshots(records)


FILE_ROWS = 5_000_000


def write_result(df: DataFrame, path: str, fmt: str = "parquet", buckets: int = 64, key: str = "run_id") -> None:
    """Write a result partitioned by a bucket of its key.

    Buckets bound the number of folders however many runs there are. Spark
    splits buckets that are large, and a file holds a bounded number of rows,
    so neither the number of tasks nor the size of files is fixed here.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    df.withColumn("bucket", bucket).hint("rebalance", "bucket").write.option("maxRecordsPerFile", FILE_ROWS).mode(
        "overwrite").partitionBy("bucket").format(fmt).save(path)


def read_result(spark: SparkSession, path: str, schema: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schema + ", bucket int").format(fmt).load(path)
