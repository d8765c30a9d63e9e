"""One query per corpus operator, with production parameters, over its whole table; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, decontaminate, exact_dedup, fingerprints, hard_negatives, line_dedup, merkle, near_dup, quality, token_counts, token_shards, toxicity, url_filter
from .common import new_dir, table

WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.token_counts(docs, public_tokenizers.path(WORD_BPE)).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


OP3_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.codec_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE))


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_dir(spark, "shards")
    written = token_shards.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), out, end_id=0)
    return token_shards.read_shards(spark, out, written.collect())  # one row a shard


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), RULES)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT doc_id, unnest(range(len(lines))) AS i, unnest(lines) AS line FROM split),
keyed AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM line),
often AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT k.*, o.last IS NOT NULL AND k.doc_id <> o.last AS gone FROM keyed k LEFT JOIN often o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP8_SQL = r"""
WITH doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
sized AS (SELECT item_id, w, least(len(w), 10) AS n FROM item WHERE len(w) > 0),
start AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM start),
own AS (SELECT d.doc_id, d.w, l.n, unnest(range(1, len(d.w) - l.n + 2)) AS i FROM doc d JOIN (SELECT DISTINCT n FROM win) l ON len(d.w) >= l.n),
hit AS (SELECT o.doc_id, o.i, o.n, win.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM own) o JOIN win USING (n, g)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS k FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(p.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.k, '')) AS items_sha256, p.n_hit IS NOT NULL AS contaminated
FROM doc d LEFT JOIN pos p USING (doc_id) LEFT JOIN ids i USING (doc_id)
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("passages")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.jaccard_classes(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE doc AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sized AS (SELECT doc_id, w, least(len(w), 4) AS n FROM doc WHERE len(w) > 0),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)),
total AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingle a JOIN shingle b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(doc_id, node) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON r.node = e.a)
SELECT r.doc_id, coalesce(any_value(t.n), 0) AS n_shingles, min(r.node) AS component_id
FROM reach r LEFT JOIN total t ON t.doc_id = r.doc_id GROUP BY r.doc_id
"""


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.proofs(docs, ["doc_id", "source", "lang", "n_chars", "text"], altered={"text": tampered})


OP11_SQL = r"""
WITH RECURSIVE crc AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: list_transform(range(8), lambda k: CAST((ascii(x) >> k) & 1 AS BIGINT))))),
    lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295) % 2 = 0 AS even FROM documents),
field AS (SELECT d.doc_id, source, strlen(CAST(d.doc_id AS VARCHAR)) || ':' || d.doc_id || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
    text, CASE WHEN even THEN replace(text, chr(10), '') ELSE text END AS other FROM documents d JOIN crc USING (doc_id)),
leaf AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(other) || ':' || other, '-')) AS other, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM field),
lv(source, k, nodes) AS (SELECT source, 0, list(leaf ORDER BY i) FROM leaf GROUP BY source
    UNION ALL SELECT source, k + 1, list_transform(range((len(nodes) + 2) // 3), lambda j: sha256(array_to_string(nodes[3 * j + 1 : 3 * j + 3], ''))) FROM lv WHERE len(nodes) > 1),
sub AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM lv WHERE len(nodes) = 1),
up(k, nodes) AS (SELECT 0, list(subroot ORDER BY i) FROM sub
    UNION ALL SELECT k + 1, list_transform(range((len(nodes) + 2) // 3), lambda j: sha256(array_to_string(nodes[3 * j + 1 : 3 * j + 3], ''))) FROM up WHERE len(nodes) > 1),
steps AS (SELECT l.doc_id, 0 AS tree, k, (l.i // CAST(pow(3, k) AS BIGINT)) AS p, nodes FROM leaf l JOIN lv ON lv.source IS NOT DISTINCT FROM l.source WHERE len(nodes) > 1
    UNION ALL SELECT l.doc_id, 1, k, s.i // CAST(pow(3, k) AS BIGINT), nodes FROM leaf l JOIN sub s ON s.source IS NOT DISTINCT FROM l.source, up WHERE len(nodes) > 1),
way AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY tree, k) AS step, array_to_string(nodes[p - p % 3 + 1 : p], '') AS l, array_to_string(nodes[p + 2 : p - p % 3 + 3], '') AS r FROM steps),
proof AS (SELECT doc_id, sha256(string_agg(l || r, '' ORDER BY step)) AS proof_sha256 FROM way GROUP BY doc_id),
fold(doc_id, step, h) AS (SELECT doc_id, 0, other FROM leaf UNION ALL SELECT f.doc_id, f.step + 1, sha256(l || h || r) FROM fold f JOIN way w ON w.doc_id = f.doc_id AND w.step = f.step + 1),
last AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM fold GROUP BY doc_id),
root AS (SELECT nodes[1] AS root FROM up WHERE len(nodes) = 1)
SELECT l.doc_id, l.leaf, s.subroot, root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaf l JOIN sub s ON s.source IS NOT DISTINCT FROM l.source JOIN last USING (doc_id) LEFT JOIN proof p USING (doc_id) CROSS JOIN root
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


OP12_SQL = """
WITH vec AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS anchor_id, r.vec_id AS other_id, a.label = r.label AS alike, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM vec a, vec r WHERE a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id),
positive AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.alike AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER w <= 3
"""


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.next_edits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_url_filter, op3_exact_dedup, op4_line_dedup, op5_quality, op6_bpe_codec, op7_token_shards, op8_decontaminate, op9_toxicity, op10_jaccard_join, op11_merkle_manifest, op12_hard_negatives, op13_fingerprints)
}
SQL: dict[str, str] = {"op3_exact_dedup": OP3_SQL, "op4_line_dedup": OP4_SQL, "op8_decontaminate": OP8_SQL, "op10_jaccard_join": OP10_SQL, "op11_merkle_manifest": OP11_SQL, "op12_hard_negatives": OP12_SQL}
