"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.session import ensure_checkpoint_dir

_WORK = "work"


def cut(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back.

    The rows are computed once and found by every executor, so a lost one
    costs no earlier stage. ``release`` removes a table nobody needs any more.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{_WORK}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables made by ``cut``; only for those no lazy result still reads."""
    for df in tables:
        path = getattr(df, "_cut_path", None)
        if path is None:
            continue
        jvm = df.sparkSession.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def crc_remainder(doc_id, modulus: int):
    """``crc32(doc_id as text) mod modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads uint64 values evenly."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


def numbered(df: DataFrame, *order, name: str = "pos") -> DataFrame:
    """``df`` as a written table with the place of each row, from 0, in the given order.

    Rows are sorted by range partitions; only one row count per partition
    comes to the driver.
    """
    spark = df.sparkSession
    n = max(1, shuffle_width(spark))
    rows = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = sorted((r.p, r.n) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    ahead, starts = 0, []
    for p, m in sizes:
        starts.append((p, ahead))
        ahead += m
    offsets = F.broadcast(spark.createDataFrame(starts, "_p long, _ahead long"))  # one row per partition
    return rows.join(offsets, part == F.col("_p")).withColumn(name, F.col("_ahead") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_p", "_ahead", "_at")
