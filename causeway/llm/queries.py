"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


from causeway.llm import bpe_reuse, license_scan, mix_budget, neural_lm, pivot_search, prefix_trie, private_data, quality, sketch_dedup, spelling, token_coder, tool_calls, vector_dedup


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_sketch_dedup")
def op3(spark, sf_dir):
    return sketch_dedup.near_duplicates(read(spark, sf_dir, "documents")).drop("node")


@query("op5_bpe_reuse")
def op5(spark, sf_dir):
    return bpe_reuse.digests(bpe_reuse.encode(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json")))


@query("op8_mix_budget")
def op8(spark, sf_dir):
    return mix_budget.mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "repeats", "taken")


@query("op9_quality")
def op9(spark, sf_dir):
    return quality.quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op6_license_scan")
def op6(spark, sf_dir):
    return license_scan.license_labels(read(spark, sf_dir, "documents"))


@query("op10_token_coder")
def op10(spark, sf_dir):
    blocks = token_coder.write_blocks(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return token_coder.with_checksums(token_coder.read_blocks(blocks))


@query("op4_neural_lm")
def op4(spark, sf_dir):
    return neural_lm.scores(read(spark, sf_dir, "documents"))


@query("op2_projection_dedup", """
    WITH RECURSIVE v AS (
        SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
          AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0 AND len([e FOR e IN embedding IF e <> 0]) > 0),
    pairs AS (
        SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
        WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a),
    tops AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
    links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
    SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
    FROM embeddings e JOIN tops ON tops.a = e.vec_id LEFT JOIN links ON links.a = e.vec_id""")
def op2(spark, sf_dir):
    return vector_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op7_pivot_search", """
    WITH v AS (
        SELECT vec_id, [floor(256 * e::DOUBLE)::BIGINT FOR e IN embedding] AS x FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([e FOR e IN embedding IF e IS NULL OR NOT isfinite(e)]) = 0),
    s AS (
        SELECT q.vec_id AS query_id, v.vec_id, list_sum([z[1] * z[2] FOR z IN list_zip(q.x, v.x)])::BIGINT AS score
        FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op7(spark, sf_dir):
    return pivot_search.top_k(read(spark, sf_dir, "embeddings"))


@query("op1_tool_calls", """
    WITH t AS (SELECT conv_id::VARCHAR AS conv_id, turn, role, text FROM conversations),
    system AS (SELECT conv_id, min(turn) AS first FROM t WHERE role = 'system' GROUP BY conv_id),
    calls AS (
        SELECT t.conv_id, t.conv_id || '-' || turn AS call_id, turn, role,
               CASE WHEN role = 'user' AND first < turn THEN t.conv_id || '-' || first END AS setup, text
        FROM t LEFT JOIN system ON system.conv_id = t.conv_id WHERE role IN ('system', 'user')),
    results AS (SELECT conv_id, conv_id || '-' || (turn - 1) AS call_id, turn, text FROM t WHERE role IS NULL OR role NOT IN ('system', 'user'))
    SELECT conv_id, call_id, 'call' AS kind, turn, CASE WHEN setup IS NULL THEN 0 ELSE 1 END AS level,
           CASE WHEN EXISTS (SELECT 1 FROM results r WHERE r.conv_id = c.conv_id AND r.call_id = c.call_id) THEN 'linked' ELSE 'unanswered' END AS status,
           CASE WHEN role = 'user' AND length(text) > 400 THEN '$.prompt: too long' WHEN length(text) = 0 THEN '$.' || CASE role WHEN 'user' THEN 'prompt' ELSE 'instructions' END || ': too short' ELSE '' END AS errors,
           CASE role WHEN 'system' THEN '{"arguments":{"instructions":' || to_json(text)::VARCHAR || '},"id":"' || call_id || '","name":"configure","type":"call"}'
           ELSE '{"arguments":{"prompt":' || to_json(text)::VARCHAR || CASE WHEN setup IS NULL THEN '' ELSE ',"setup":{"$ref":"' || setup || '"}' END || ',"turn":' || turn
                || '},"id":"' || call_id || '","name":"respond","type":"call"}' END AS message
    FROM calls c
    UNION ALL
    SELECT r.conv_id, r.call_id, 'result', r.turn, CASE WHEN c.call_id IS NOT NULL THEN CASE WHEN setup IS NULL THEN 0 ELSE 1 END END,
           CASE WHEN c.call_id IS NULL THEN 'orphan' ELSE 'linked' END, '', '{"content":' || to_json(r.text)::VARCHAR || ',"id":"' || r.call_id || '","type":"result"}'
    FROM results r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.call_id = r.call_id""")
def op1(spark, sf_dir):
    calls, results = tool_calls.turns_as_calls(read(spark, sf_dir, "conversations"))
    return tool_calls.link_tool_calls(calls, results, tool_calls.TURN_SCHEMAS).withColumn("errors", F.array_join("errors", "; "))


@query("op13_private_data")
def op13(spark, sf_dir):
    return private_data.digests(private_data.find_private(read(spark, sf_dir, "documents")))


@query("op11_prefix_trie", """
    WITH RECURSIVE crc_table AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    own AS (
        SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    shares AS (
        SELECT conv_id, turns, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
               lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 9 AS h FROM own, crc_table),
    rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns
        FROM shares c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
    members AS (
        SELECT conv_id, len(turns) AS n, d AS depth, sha256(turns[1:d]::VARCHAR) AS node, CASE WHEN d > 0 THEN sha256(turns[1:d - 1]::VARCHAR) END AS parent,
               CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS size
        FROM rebuilt, unnest(range(len(turns) + 1)) u(d)),
    nodes AS (
        SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(size) AS saved,
               sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
        FROM members GROUP BY depth, node),
    kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    own_nodes AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (depth, node)),
    below AS (
        SELECT depth, node, depth AS d, parent, saved, n_children = 0 AS leaf, node AS top FROM own_nodes
        UNION ALL
        SELECT p.depth, p.node, b.d, p.parent, b.saved, b.leaf, b.top FROM below b JOIN own_nodes p ON p.depth = b.depth - 1 AND p.node = b.parent),
    sums AS (SELECT depth, node, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM below GROUP BY ALL)
    SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
    FROM own_nodes n JOIN sums USING (depth, node) LEFT JOIN own_nodes p ON p.depth = n.depth - 1 AND p.node = n.parent""")
def op11(spark, sf_dir):
    return prefix_trie.prefix_trie(*prefix_trie.rebuilt(read(spark, sf_dir, "conversations")))


@query("op12_spelling", """
    WITH crc_table AS (
        SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
    runs AS (
        SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    named AS (SELECT DISTINCT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS name FROM runs WHERE length(run) >= 7),
    hashes AS (
        SELECT name, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(name)), lambda i: ('0x' || substr(hex(encode(name)), 2 * i + 1, 2))::BIGINT)),
               lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM named, crc_table),
    marked AS (SELECT run, h FROM runs JOIN hashes ON name = coalesce(doc_id::VARCHAR, '') || ':' || run),
    cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM marked),
    words AS (SELECT word, count(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
    less AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM words, unnest(range(length(word))) u(i)),
    pairs AS (
        SELECT a.word, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM pairs GROUP BY word),
    formed AS (
        SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * n THEN near END AS form, CASE WHEN near_n >= 10 * n THEN near_n END AS form_n
        FROM words w LEFT JOIN best USING (word)),
    steps AS (
        SELECT a.*, coalesce(f.form, e.form, d.form, c.form, b.form, a.form, a.word) AS root
        FROM formed a LEFT JOIN formed b ON b.word = a.form LEFT JOIN formed c ON c.word = b.form LEFT JOIN formed d ON d.word = c.form
        LEFT JOIN formed e ON e.word = d.form LEFT JOIN formed f ON f.word = e.form)
    SELECT word, form, root, n, n_near, form_n FROM steps""")
def op12(spark, sf_dir):
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))
