import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from causeway.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(8)


@pytest.fixture(scope="session")
def loop(spark):
    """``total = 0; for i in range(n): total = total + i; return total`` with n = 2."""
    code = ["total = 0", "for i in range(n):", "total = total + i", "for i in range(n):", "total = total + i", "for i in range(n):", "return total"]
    reads = [[], ["n"], ["total", "i"], ["n"], ["total", "i"], ["n"], ["total"]]
    writes = [["total"], ["i"], ["total"], ["i"], ["total"], ["i"], []]
    lines = [2, 3, 4, 3, 4, 3, 5]
    indents = [0, 0, 4, 0, 4, 0, 0]
    blocks = [0, 0, 1, 0, 1, 0, 0]
    held = [{"n": "2"}, {"n": "2", "total": "0"}, {"n": "2", "total": "0", "i": "0"}, {"n": "2", "total": "0", "i": "0"},
            {"n": "2", "total": "0", "i": "1"}, {"n": "2", "total": "1", "i": "1"}, {"n": "2", "total": "1", "i": "1"}]
    steps = spark.createDataFrame(
        [("r", i, "f.py", lines[i], code[i], "f", 0, 0, indents[i], blocks[i], reads[i], writes[i]) for i in range(7)],
        "run_id string, step long, file string, line int, code string, func string, depth int, call_id long, indent int, block_id long, "
        "reads array<string>, writes array<string>")
    snapshots = spark.createDataFrame(
        [("r", i, v, x, "int", hash(x) % 97, None) for i, h in enumerate(held) for v, x in h.items()],
        "run_id string, step long, var string, value string, type string, memory_id long, container_keys array<string>")
    table = spark.createDataFrame([("r", 1, 0, 4, 1)], "run_id string, block_id long, parent_block_id long, indent int, condition_step long")
    return steps, snapshots, table
