"""Reading code and configuration."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # reading YAML then raises where it is tried
    yaml = None

PYTHON = "*.py"
SCRIPT = "*.{js,ts,jsx,tsx}"


def read_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole files ``(file, text)`` under a folder whose names match a pattern."""
    return (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r?\n$", "").alias("text"))
    )


def to_lines(files: DataFrame, keys: tuple[str, ...] = ("file",), text: str = "text") -> DataFrame:
    """Lines with their 1-based number."""
    return files.select(*keys, F.posexplode(F.split(text, "\r?\n")).alias("_p", "line_text")).select(
        *keys, (F.col("_p") + 1).alias("line"), F.col("line_text").alias("text"))


def read_lines(spark: SparkSession, path: str, pattern: str = PYTHON) -> DataFrame:
    return to_lines(read_files(spark, path, pattern))


def _leaves(data, prefix: str = "") -> Iterator[tuple[str, str]]:
    if isinstance(data, dict):
        for k, v in data.items():
            yield from _leaves(v, f"{prefix}.{k}" if prefix else str(k))
    elif prefix:
        yield prefix, str(data)


def flatten_config(documents: DataFrame, key: str = "file", text: str = "text") -> DataFrame:
    """Leaves of JSON or YAML documents as ``(key, path, value, error)`` with dotted paths.

    A document is YAML when its key ends in ``.yml`` or ``.yaml``. A document
    that cannot be read, or is nested too deeply to be, gives one row with
    the reason in ``error`` and neither path nor value. Lone surrogates are
    replaced.
    """
    kind = documents.schema[key].dataType.simpleString()

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                is_yaml = str(k).endswith((".yml", ".yaml"))
                if is_yaml and yaml is None:
                    raise RuntimeError("PyYAML is needed to read YAML documents")
                try:
                    data = yaml.safe_load(t) if is_yaml else json.loads(t)
                    found = [(k, _clean(p), _clean(v), None) for p, v in _leaves(data)]
                except (ValueError, TypeError, RecursionError, *((yaml.YAMLError,) if yaml else ())) as e:
                    found = [(k, None, None, _clean(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"))]
                rows.extend(found)
            yield pd.DataFrame(rows, columns=[key, "path", "value", "error"])

    return documents.select(key, text).mapInPandas(parse, f"{key} {kind}, path string, value string, error string")


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode()


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return flatten_config(read_files(spark, path, "*.{json,yml,yaml}"))
