"""Registered queries of the operators, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

import corpus_pipeline
from tallyhold.llm import bit_planes, byte_bpe, imatch, learned_partitions, manifest, mixing, near_text, near_vectors, personal, secrets, substrings, token_files, toxicity

QUERIES = {f.__name__: f for f in (
    secrets.op1_secrets,
    substrings.op2_substrings,
    imatch.op3_imatch,
    byte_bpe.op4_byte_bpe,
    toxicity.op5_toxicity,
    token_files.op6_token_files,
    personal.op7_personal,
    mixing.op8_mixing,
    near_vectors.op9_near_vectors,
    near_text.op10_near_text,
    manifest.op11_merkle_manifest,
    bit_planes.op12_bit_planes,
    learned_partitions.op13_learned_partitions,
)} | {"pipeline": corpus_pipeline.run}


def _components(node: str, links: str) -> str:
    """CTEs ``links`` in both directions and ``component`` (node, component_id) over ``nodes`` (node)."""
    return f"""
links AS ({links}),
reach AS (
  SELECT {node} AS node, {node} AS reached FROM nodes
  UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.reached = l.a),
component AS (SELECT node, min(reached) AS component_id FROM reach GROUP BY node)"""


SQL: dict[str, str] = {
    "op2_substrings": r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM words WHERE len(ws) >= 35),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY md5(array_to_string(ws[i:i + 34], ' '))) AS n FROM starts),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM windows WHERE n > 1)),
each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM words),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS text, count(*) AS n
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p WHERE g.p IS NULL GROUP BY e.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id""",
    "op8_mixing": mixing.SQL,
    "op9_near_vectors": r"""
WITH RECURSIVE nodes AS (SELECT vec_id FROM embeddings),
usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),""" + _components(
        "vec_id", "SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95") + """
SELECT c.node AS vec_id, (SELECT count(*) FROM links l WHERE l.a = c.node) AS n_links, c.component_id, c.node = c.component_id AS kept FROM component c""",
    "op10_near_text": r"""
WITH RECURSIVE nodes AS (SELECT doc_id FROM documents),
words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
starts AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM words WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),""" + _components(
        "doc_id", "SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)") + """
SELECT c.node AS doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c.component_id, c.node = c.component_id AS kept
FROM component c LEFT JOIN sizes s ON s.doc_id = c.node""",
    "op11_merkle_manifest": manifest.sql(),
    "op12_bit_planes": bit_planes.sql(),
    "op13_learned_partitions": learned_partitions.SQL,
}
