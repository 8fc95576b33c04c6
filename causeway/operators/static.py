"""Causal graphs of source code, configuration and tracebacks, over whole corpora.

Names are extracted line by line or file by file; the edges themselves are
ordered look-ups and joins in Spark.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from causeway.functions import code as C
from causeway.functions import ordered

_LABELS = {
    ast.Assign: "assignment", ast.If: "if-branch", ast.For: "for-loop", ast.While: "while-loop", ast.Try: "try-block",
    ast.ExceptHandler: "except-handler", ast.Return: "return", ast.Raise: "raise", ast.Import: "import", ast.ImportFrom: "import-from",
}


def _targets(t: ast.expr) -> list[str]:
    if isinstance(t, (ast.Tuple, ast.List)):
        return [n for e in t.elts for n in _targets(e)]
    name = getattr(t, "id", None) or (t.attr if isinstance(t, ast.Attribute) else None)
    return [name] if name else []


def python_names(text: str) -> list[tuple[int, str, str, str]]:
    """``(line, kind, name, label)`` of a file: definitions, uses, calls and labelled lines; one ``error`` row if it can't be parsed."""
    try:
        tree = ast.parse(text)
    except SyntaxError as e:
        return [(e.lineno or 1, "error", "", e.msg)]
    except (ValueError, RecursionError, MemoryError) as e:
        return [(1, "error", "", str(e))]
    out = []
    for n in ast.walk(tree):
        line = getattr(n, "lineno", None)
        if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
            out += [(line, "function", n.name, ""), (line, "label", "", f"function {n.name}")]
        elif isinstance(n, ast.Assign):
            out += [(line, "def", name, "") for t in n.targets for name in _targets(t)]
            out += [(line, "use", m.id, "") for m in ast.walk(n.value) if isinstance(m, ast.Name)]
        elif isinstance(n, ast.Call):
            name = getattr(n.func, "id", getattr(n.func, "attr", None))
            out += [(line, "call", name, "")] if name else []
        if type(n) in _LABELS:
            out.append((line, "label", "", _LABELS[type(n)]))
    return out


def scan_python(files: DataFrame) -> DataFrame:
    """Names and labels of every file ``(file, text)``; one file is parsed at a time."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, *r) for f, t in zip(pdf["file"], pdf["text"]) for r in python_names(t or "")]
            yield pd.DataFrame(rows, columns=["file", "line", "kind", "name", "label"])

    return files.select("file", "text").mapInPandas(scan, "file string, line int, kind string, name string, label string")


def node_id(file: Column, line: Column) -> Column:
    return F.concat_ws(":", file, line.cast("string"))


def _as_of(names: DataFrame, define: str, use: str, edge_type: str, **kw) -> DataFrame:
    """Edges from the last definition of a name at or before the line of each use."""
    rows = names.filter(F.col("kind").isin(define, use)).groupBy("file", "name", "line").agg(
        F.max(F.col("kind") == define).alias("_d"), F.max(F.col("kind") == use).alias("_u"))
    held = ordered.running(rows, ["file", "name"], "line", {"def_line": ("last", F.when(F.col("_d"), F.col("line")), True)}, **kw)
    return held.filter("_u AND def_line IS NOT NULL").select("file", "name", "def_line", F.col("line").alias("use_line"),
                                                              F.lit(edge_type).alias("edge_type"))


def python_edges(names: DataFrame, **kw) -> DataFrame:
    """Def-use edges between assignments and call edges to functions of the file."""
    data = _as_of(names, "def", "use", "DATA_DEPENDENCY", **kw)
    calls = _as_of(names, "function", "call", "CALL_RELATION", **kw)
    f = F.col("file")
    return data.select(
        "file", node_id(f, F.col("def_line")).alias("src"), node_id(f, F.col("use_line")).alias("dst"), "edge_type").unionByName(
        calls.select("file", node_id(f, F.col("use_line")).alias("src"), node_id(f, F.col("def_line")).alias("dst"), "edge_type")).distinct()


def python_nodes(names: DataFrame, lines: DataFrame, **kw) -> DataFrame:
    """Labelled lines, and lines that call a function of the file, with their text; the first label of a line by name wins."""
    called = _as_of(names, "function", "call", "CALL_RELATION", **kw).select(
        "file", F.col("use_line").alias("line"), F.lit(1).alias("rank"), F.concat(F.lit("calls "), "name").alias("label"))
    labels = names.filter("kind = 'label'").select("file", "line", F.lit(0).alias("rank"), "label").unionByName(called).groupBy("file", "line").agg(
        F.min(F.struct("rank", "label"))["label"].alias("semantic_label"))
    text = lines.select("file", "line", F.trim("text").alias("code_content"))
    return labels.join(text, ["file", "line"]).withColumn("node_id", node_id(F.col("file"), F.col("line"))).withColumn(
        "node_type", F.lit("CODE"))


# ---- scripts, by regular expressions

# Forms of functions, assignments, imports and calls in scripts.
JS_FUNCTION = (r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[a-zA-Z_]\w*)\s*=>"
               r"|(?:async\s+)?function\s+(\w+))")
JS_ASSIGN = r"(?:const|let|var)\s+(\w+)\s*="
JS_IMPORT = r"""(?:import\s+.*?from\s+['"](.+?)['"]|require\s*\(\s*['"](.+?)['"]\s*\))"""
JS_CONTROL = [
    (r"^\s*(?:if|else\s+if)\s*\(", "if-branch"), (r"^\s*(?:for|while)\s*\(", "loop"), (r"^\s*try\s*\{", "try-block"),
    (r"^\s*catch\s*\(", "catch-handler"), (r"^\s*throw\s+", "throw"), (r"^\s*return\s", "return"),
]


def classify_script(lines: DataFrame) -> DataFrame:
    """Kind and name of every line of a script: import, function, assignment or other."""
    t = F.col("text")
    fn = F.coalesce(*[F.nullif(F.regexp_extract(t, JS_FUNCTION, g), F.lit("")) for g in (1, 2, 3)])
    var = F.nullif(F.regexp_extract(t, JS_ASSIGN, 1), F.lit(""))
    kind = F.when(t.rlike(JS_IMPORT), "import").when(fn.isNotNull(), "function").when(var.isNotNull(), "assignment").otherwise("other")
    real = (F.trim(t) != "") & ~F.ltrim(t).startswith("//")
    return lines.filter(real).withColumn("kind", kind).withColumn(
        "name", F.when(F.col("kind") == "function", fn).when(F.col("kind") == "assignment", var)).withColumn("any_function", fn)


def script_graph(lines: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of scripts.

    An assignment depends on the last assignment of every other variable it
    names; a line calls the first function of its file that it names before a
    bracket. Names count as whole words.
    """
    c = classify_script(lines)
    f = F.col("file")
    defs = c.filter("kind = 'assignment'").select("file", "line", "name", F.lit(True).alias("_d"))
    uses = c.filter("kind = 'assignment'").select("file", "line", F.explode(C.words(F.col("text"))).alias("name"), F.lit(True).alias("_u"))
    seen = defs.join(uses, ["file", "line", "name"], "full")
    held = ordered.running(seen, ["file", "name"], "line", {"def_line": ("last", F.when(F.col("_d"), F.col("line")))}, **kw)
    data = held.filter("_u AND _d IS NULL AND def_line IS NOT NULL").select(
        "file", node_id(f, F.col("def_line")).alias("src"), node_id(f, F.col("line")).alias("dst"), F.lit("DATA_DEPENDENCY").alias("edge_type"))

    functions = c.filter("any_function IS NOT NULL").groupBy("file", F.col("any_function").alias("name")).agg(F.max("line").alias("def_line"))
    named = c.filter("kind = 'other'").select(
        "file", "line", F.posexplode(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), 1)).alias("pos", "name"))
    w = Window.partitionBy("file", "line").orderBy("pos")
    first = named.join(functions, ["file", "name"]).withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    calls = first.select("file", node_id(f, F.col("line")).alias("src"), node_id(f, F.col("def_line")).alias("dst"),
                         F.lit("CALL_RELATION").alias("edge_type"))

    control = None
    for pattern, label in JS_CONTROL:
        hit = F.col("text").rlike(pattern)
        control = F.when(hit, label) if control is None else control.when(hit, label)
    called = first.select("file", "line", F.concat(F.lit("calls "), "name").alias("_called"))
    label = (
        F.when(F.col("kind") == "import", "import").when(F.col("kind") == "function", F.concat(F.lit("function "), "name"))
        .when(F.col("kind") == "assignment", "assignment").otherwise(F.coalesce(control, F.col("_called"), F.lit("")))
    )
    nodes = c.join(called, ["file", "line"], "left").select(
        "file", "line", node_id(f, F.col("line")).alias("node_id"), F.trim("text").alias("code_content"), label.alias("semantic_label"))
    return nodes, data.unionByName(calls).distinct()


def page_links(pages: DataFrame, key: str = "url", html: str = "html") -> DataFrame:
    """Links of pages as edges."""
    return pages.select(F.col(key).alias("src"), F.explode(F.regexp_extract_all(html, F.lit('href="([^"]+)"'), 1)).alias("dst")).distinct()


# ---- configuration

# Ways code reads a configuration key.
CONFIG_READERS = [
    r"""os\.environ\.get\(\s*['"](\w+)['"]""", r"""os\.environ\[['"](\w+)['"]\]""", r"""os\.getenv\(\s*['"](\w+)['"]""",
    r"""(?:config|cfg)\[['"]([\w.]+)['"]\]""", r"""(?:config|cfg)\.get\(\s*['"]([\w.]+)['"]""", r"""cfg\.(\w+)""",
    r"""['"](\w+)['"]\s*:\s*""",
]
CONFIG_NESTED = r"""(?:config|cfg)\[['"](\w+)['"]\]\[['"](\w+)['"]\]"""


def config_reads(lines: DataFrame) -> DataFrame:
    """Keys a line of code reads, one row per line and key."""
    t = F.col("text")
    found = [F.regexp_extract_all(t, F.lit(p), 1) for p in CONFIG_READERS]
    nested = F.zip_with(F.regexp_extract_all(t, F.lit(CONFIG_NESTED), 1), F.regexp_extract_all(t, F.lit(CONFIG_NESTED), 2),
                        lambda a, b: F.concat_ws(".", a, b))
    return lines.select("file", "line", F.explode(F.array_distinct(F.concat(*found, nested))).alias("key"))


def config_influence(lines: DataFrame, config: DataFrame) -> DataFrame:
    """Edges from configuration items to the lines that read them.

    A key matches exactly, else without case with ``.`` read as ``_``, else
    without case; among equals the first item by name. Both sides are joined
    on a normal form of the key, so it does not matter how large they are.
    """
    reads = config_reads(lines)
    items = config.select("path").distinct()
    exact = reads.join(items.withColumn("key", F.col("path")), "key").select("file", "line", "key", "path", F.lit(0).alias("rank"))
    loose = items.select("path", F.explode(F.array_distinct(F.array(
        F.lower(F.replace("path", F.lit("."), F.lit("_"))), F.lower("path")))).alias("norm"))
    folded = reads.withColumn("norm", F.lower("key")).join(loose, "norm").select("file", "line", "key", "path", F.lit(1).alias("rank"))
    best = exact.unionByName(folded).groupBy("file", "line", "key").agg(F.min(F.struct("rank", "path")).alias("b"))
    return best.select(
        F.concat(F.lit("config:"), "b.path").alias("src"), node_id(F.col("file"), F.col("line")).alias("dst"),
        F.lit("CONFIG_INFLUENCE").alias("edge_type")).distinct()


# ---- tracebacks

_FRAME = r'^\s*File "(.*)", line (\d+)(?:, in (.*))?$'


def exception_frames(texts: DataFrame, key: str = "trace_id", text: str = "text") -> DataFrame:
    """Frames of traceback texts in order, with the code line under each."""
    lines = texts.select(key, F.posexplode(F.split(F.trim(text), "\r?\n")).alias("pos", "line"))
    w = Window.partitionBy(key).orderBy("pos")
    frame = F.col("line").rlike(_FRAME)
    nxt = F.lead("line").over(w)
    rows = lines.withColumn("code_line", F.when(~nxt.rlike(_FRAME) & nxt.rlike(r"^\s"), F.trim(nxt))).filter(frame)
    return rows.select(
        key, F.row_number().over(w).alias("frame"), F.regexp_extract("line", _FRAME, 1).alias("file"),
        F.regexp_extract("line", _FRAME, 2).cast("int").alias("line_no"),
        F.coalesce(F.nullif(F.trim(F.regexp_extract("line", _FRAME, 3)), F.lit("")), F.lit("<module>")).alias("func"),
        F.coalesce("code_line", F.lit("")).alias("code_line"))


def exception_types(texts: DataFrame, key: str = "trace_id", text: str = "text") -> DataFrame:
    """Type and message: the last unindented line with a colon after the frames."""
    found = F.filter(F.split(F.trim(text), "\r?\n"), lambda x: x.rlike(r"^[^\s].*:") & ~x.startswith("Traceback") & ~x.startswith('File "'))
    last = F.element_at(found, -1)
    return texts.select(key, F.when(F.size(found) > 0, last).alias("_l")).select(
        key, F.coalesce(F.trim(F.substring_index("_l", ":", 1)), F.lit("UnknownError")).alias("exception_type"),
        F.coalesce(F.trim(F.regexp_extract("_l", r"^[^:]*:([\s\S]*)$", 1)), F.lit("")).alias("message"))


def exception_graph(texts: DataFrame, key: str = "trace_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes and THROWS edges of traceback texts; the last frame is the error."""
    frames = exception_frames(texts, key, text)
    w = Window.partitionBy(key).orderBy("frame")
    here = node_id(F.col("file"), F.col("line_no"))
    seen = frames.withColumn("node_id", here).withColumn("next", F.lead("node_id").over(w))
    edges = seen.filter("next IS NOT NULL").select(key, F.col("node_id").alias("src"), F.col("next").alias("dst"), F.lit("THROWS").alias("edge_type"))
    named = seen.join(exception_types(texts, key, text), key)
    failed = F.col("next").isNull()
    nodes = named.select(
        key, "node_id", F.when(failed, "ERROR").otherwise("CODE").alias("node_type"),
        F.when(failed, F.concat_ws(": ", "exception_type", "message")).otherwise(F.concat(F.lit("in "), "func")).alias("semantic_label"))
    return nodes, edges
