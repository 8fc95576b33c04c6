"""DuckDB text of the fixture tables, as common table expressions."""

from __future__ import annotations

import re

_V = "['view','click','signup','error','purchase']"

CTES = {
    "ev": f"""
      SELECT *, k // 10 AS t, {_V}[k % 5 + 1] AS r, {_V}[(k % 7) % 5 + 1] AS r2, {_V}[k % 3 + 1] AS r3
      FROM (SELECT CAST(user_id AS VARCHAR) AS run_id, user_id, ts, event_type AS w, value,
                   CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
                   row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step
            FROM events)""",
    "st": """
      SELECT run_id, step, ts, 'trace.py' AS file, k AS line, k, t, value, w, r,
        CASE t WHEN 0 THEN 'for ' || w || ' in range(' || r || '):' WHEN 1 THEN 'if ' || r || ' > 3:'
               WHEN 2 THEN 'return ' || r WHEN 3 THEN w || ' += ' || r
               WHEN 4 THEN w || '[' || r || '] = ' || r2 WHEN 5 THEN w || '.append(' || r || ')'
               WHEN 6 THEN w || ' = ' || r || '.pop()' WHEN 7 THEN 'while ' || r || ' < ' || r2 || ':'
               WHEN 8 THEN w || ' = max(' || r || ', ' || r2 || ', ' || r3 || ')'
               ELSE w || ', ' || r || ' = ' || r || ', ' || w END AS code,
        'fn' || (k % 4) AS func,
        CASE WHEN user_id % 10 = 0 THEN step WHEN user_id % 10 = 1 THEN step % 10 ELSE k % 7 END AS depth,
        CASE WHEN (step // 10) % 2 = 0 THEN 0 ELSE step // 10 END AS call_id,
        (k % 3) * 4 AS indent, t IN (0, 1, 7) AS ctl,
        coalesce(sum(CASE WHEN t IN (0, 1, 7) THEN 1 ELSE 0 END)
          OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block_id
      FROM ev""",
    "rd": """
      SELECT run_id, step, r AS var FROM ev
      UNION SELECT run_id, step, w FROM ev WHERE t IN (3, 4, 5, 9)
      UNION SELECT run_id, step, r2 FROM ev WHERE t IN (4, 7, 8)
      UNION SELECT run_id, step, r3 FROM ev WHERE t = 8""",
    "wr": """
      SELECT run_id, step, w AS var FROM ev WHERE t NOT IN (1, 2, 7)
      UNION SELECT run_id, step, r FROM ev WHERE t = 9""",
    "sn": """
      SELECT run_id, step, var, s.value AS value, s.type AS type, s.memory_id AS memory_id, s.keys AS container_keys
      FROM (SELECT e.run_id, e.step, v.var,
              last_value(CASE WHEN x.var IS NOT NULL THEN struct_pack(
                  value := CASE WHEN k % 11 = 0 THEN 'None' WHEN k % 13 = 0 THEN '[' || k || ', 1]'
                                WHEN t = 4 THEN '{1: ' || k || '}' WHEN k % 5 = 2 THEN CAST(k AS VARCHAR)
                                ELSE CAST(e.value AS VARCHAR) END,
                  type := CASE WHEN k % 11 = 0 THEN 'NoneType' WHEN k % 13 = 0 THEN 'list'
                               WHEN t = 4 THEN 'dict' WHEN k % 5 = 2 THEN 'int' ELSE 'float' END,
                  memory_id := k % 8,
                  keys := CASE WHEN k % 11 <> 0 AND (k % 13 = 0 OR t = 4)
                               THEN [CAST(k % 3 AS VARCHAR), CAST(k % 5 AS VARCHAR), CAST(k % 4 AS VARCHAR)] END)
                END IGNORE NULLS) OVER (PARTITION BY e.run_id, v.var ORDER BY e.step) AS s
            FROM ev e CROSS JOIN (SELECT unnest(['view','click','signup','error','purchase']) AS var) v
            LEFT JOIN wr x ON x.run_id = e.run_id AND x.step = e.step AND x.var = v.var)
      WHERE s IS NOT NULL""",
    "de": """
      SELECT r.run_id, max(w.step) AS src, r.step AS dst, r.var, count(*) AS version
      FROM (SELECT rd.*, call_id FROM rd JOIN st USING (run_id, step)) r
      JOIN (SELECT wr.*, call_id FROM wr JOIN st USING (run_id, step)) w
        ON r.run_id = w.run_id AND r.call_id = w.call_id AND r.var = w.var AND w.step < r.step
      GROUP BY r.run_id, r.step, r.var""",
    "ce": """
      SELECT s.run_id, max(c.step) AS src, s.step AS dst FROM st s
      JOIN st c ON c.run_id = s.run_id AND c.ctl AND c.step < s.step GROUP BY s.run_id, s.step""",
    "cl": """
      SELECT run_id, call_id, min(step) AS first_step, max(step) AS return_step, min(step) - 1 AS caller_step,
        min_by(func, step) AS func, min_by(k % 8, step) AS arg_mem, max_by(k % 8, step) AS ret_mem,
        min_by(depth, step) AS depth
      FROM st WHERE call_id > 0 GROUP BY run_id, call_id""",
    "pb": """
      SELECT c.run_id, c.call_id, c.caller_step, min(s.var) AS var
      FROM cl c JOIN sn s ON s.run_id = c.run_id AND s.step = c.caller_step AND s.memory_id = c.arg_mem
      GROUP BY c.run_id, c.call_id, c.caller_step""",
    "ed": """
      SELECT run_id, src, dst, 'data' AS kind, var FROM de
      UNION ALL SELECT run_id, src, dst, 'control', '' FROM ce
      UNION ALL SELECT run_id, caller_step, first_step, 'call', '' FROM cl
      UNION ALL SELECT run_id, caller_step, caller_step, 'parameter', var FROM pb""",
    "oh": """
      WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS step
                 FROM orders)
      SELECT CAST(o_custkey AS VARCHAR) AS run_id, step, 'o_totalprice' AS var,
             CAST(o_totalprice AS VARCHAR) AS value, 'float' AS type FROM o
      UNION ALL SELECT CAST(o_custkey AS VARCHAR), step, 'o_orderstatus', o_orderstatus, 'str' FROM o
      UNION ALL SELECT CAST(o_custkey AS VARCHAR), step, 'o_orderpriority', o_orderpriority, 'str' FROM o""",
    "kn": """
      SELECT 'region:' || r_regionkey AS node_id, 'region' AS file_path, r_name AS code_content, 'CONFIG' AS node_type
      FROM region
      UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'CONFIG' FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'CODE' FROM customer
      UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'CODE' FROM supplier
      UNION ALL SELECT 'order:' || o_orderkey, 'order', o_orderstatus, 'RUNTIME' FROM orders""",
    "ke": """
      SELECT 'region:' || n_regionkey AS src, 'nation:' || n_nationkey AS dst, 'CONFIG_INFLUENCE' AS edge_type
      FROM nation
      UNION ALL SELECT 'nation:' || c_nationkey, 'customer:' || c_custkey, 'DATA_DEPENDENCY' FROM customer
      UNION ALL SELECT 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'DATA_DEPENDENCY' FROM supplier
      UNION ALL SELECT 'customer:' || o_custkey, 'order:' || o_orderkey,
                       CASE WHEN o_orderstatus = 'F' THEN 'THROWS' ELSE 'CALL_RELATION' END FROM orders
      UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'item:' || l_orderkey || ':' || l_linenumber,
                       'RUNTIME_TRACE' FROM lineitem""",
}


def cte(body: str, recursive: bool = False, **extra: str) -> str:
    """``body`` preceded by the common table expressions it names."""
    known = {**CTES, **extra}
    needed: list[str] = []
    entered: set[str] = set()

    def visit(text: str) -> None:
        for name in known:
            if name not in entered and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                entered.add(name)
                visit(known[name])
                needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ", ".join(f"{n} AS ({known[n]})" for n in needed)
    return f"WITH {'RECURSIVE ' if recursive else ''}{head} {body}"
