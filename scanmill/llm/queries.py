"""The corpus queries the driver runs, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    align, decontaminate, exact_dedup, html_text, langid, merkle, mixing, ngram_join, packing, suffix_dedup, token_frames,
    toxicity, unit_dedup,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op1_token_frames")
def op1(spark, sf_dir):
    return token_frames.token_digests(table(spark, sf_dir, "documents"), end_id=2)


@query("op5_packing")
def op5(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), window=2048, end_id=1)


@query("op9_exact_dedup", """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)
""")
def op9(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


@query("op2_ngram_join")
def op2(spark, sf_dir):
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents"))


@query("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_decontamination")
def op4(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op6_suffix_dedup")
def op6(spark, sf_dir):
    return suffix_dedup.report(table(spark, sf_dir, "documents"), length=400)


@query("op7_language")
def op7(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


@query("op8_html_text")
def op8(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op10_unit_dedup")
def op10(spark, sf_dir):
    return unit_dedup.unit_report(table(spark, sf_dir, "documents"))


@query("op11_merkle", """
WITH RECURSIVE f AS (
  SELECT doc_id, source,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS body,
         coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
         xor(4294967295, list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)),
           lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
  FROM documents),
h AS (SELECT doc_id, source, sha256(head || body) AS leaf, sha256(head || CASE WHEN crc % 5 = 0 THEN low ELSE body END) AS altered FROM f),
d AS (
  SELECT doc_id, leaf, altered, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx,
         count(*) OVER (PARTITION BY source) AS n, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree
  FROM h),
lv AS (
  SELECT tree, 0 AS level, idx, leaf AS digest, n FROM d
  UNION ALL
  SELECT tree, max(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 15) // 16
  FROM lv WHERE n > 1 GROUP BY tree, idx // 16),
sub AS (SELECT tree, digest FROM lv WHERE n = 1),
tv AS (
  SELECT 0 AS level, tree AS idx, digest, (SELECT count(*) FROM sub) AS n FROM sub
  UNION ALL
  SELECT max(level) + 1, idx // 16, sha256(string_agg(digest, '' ORDER BY idx)), (max(n) + 15) // 16
  FROM tv WHERE n > 1 GROUP BY idx // 16),
up AS (
  SELECT tree, idx AS leaf_idx, 0 AS level, idx, n, altered AS folded, '' AS proof FROM d
  UNION ALL
  SELECT up.tree, leaf_idx, max(up.level) + 1, up.idx // 16, (max(up.n) + 15) // 16,
         sha256(string_agg(CASE WHEN lv.idx = up.idx THEN folded ELSE digest END, '' ORDER BY lv.idx)),
         any_value(proof) || coalesce(string_agg(digest, '' ORDER BY lv.idx) FILTER (lv.idx <> up.idx), '')
  FROM up JOIN lv ON lv.tree = up.tree AND lv.level = up.level AND lv.idx // 16 = up.idx // 16
  WHERE up.n > 1 GROUP BY up.tree, leaf_idx, up.idx),
crown AS (
  SELECT tree, leaf_idx, 0 AS level, tree AS idx, (SELECT count(*) FROM sub) AS n, folded, proof FROM up WHERE n = 1
  UNION ALL
  SELECT crown.tree, leaf_idx, max(crown.level) + 1, crown.idx // 16, (max(crown.n) + 15) // 16,
         sha256(string_agg(CASE WHEN tv.idx = crown.idx THEN folded ELSE digest END, '' ORDER BY tv.idx)),
         any_value(proof) || coalesce(string_agg(digest, '' ORDER BY tv.idx) FILTER (tv.idx <> crown.idx), '')
  FROM crown JOIN tv ON tv.level = crown.level AND tv.idx // 16 = crown.idx // 16
  WHERE crown.n > 1 GROUP BY crown.tree, leaf_idx, crown.idx)
SELECT d.doc_id, d.leaf, sub.digest AS subroot, tv.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root,
       folded = tv.digest AS verified
FROM d JOIN sub USING (tree) JOIN crown ON crown.tree = d.tree AND leaf_idx = d.idx AND crown.n = 1 JOIN tv ON tv.n = 1
""")
def op11(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op12_mixing", r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS draw
  FROM documents),
s AS (
  SELECT source, rank, source_size, CASE rank % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS weight
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank
        FROM d GROUP BY source)),
l AS (
  SELECT source_size, weight, 3 * source_size / weight::DOUBLE AS ratio, rank,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER
           (ORDER BY 3 * source_size / weight::DOUBLE, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY 3 * source_size / weight::DOUBLE, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s),
v AS (SELECT rest, share FROM l WHERE 3 * source_size * share >= weight * rest ORDER BY ratio, rank LIMIT 1),
u AS (
  SELECT s.*, rest, share, 3 * source_size * share < weight * rest AS is_full,
         sum(CASE WHEN 3 * source_size * share < weight * rest THEN 0 ELSE weight END) OVER (ORDER BY rank) AS upto
  FROM s, v),
t AS (
  SELECT source, rank, source_size,
         CASE WHEN is_full THEN (3 * source_size)::DOUBLE ELSE weight::DOUBLE * rest::DOUBLE / share::DOUBLE END AS target,
         CASE WHEN is_full THEN 3 * source_size ELSE upto * rest // share - (upto - weight) * rest // share END AS quota
  FROM u),
p AS (
  SELECT doc_id, size, source_size, target, quota, rank, draw,
         sum(size) OVER (PARTITION BY rank ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, quota - pass * source_size - served + size)) AS words,
         (pass * source_size + served)::DOUBLE / target AS finish
  FROM p, (VALUES (0), (1), (2)) AS r(pass) WHERE size > 0),
o AS (
  SELECT *, sum(words) OVER (ORDER BY finish, rank, pass, draw, served ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - words AS start
  FROM q)
SELECT doc_id, size, source_size, target, sum(words)::BIGINT AS taken, min(CASE WHEN words > 0 THEN start END)::BIGINT AS first_start
FROM o GROUP BY rank, served, doc_id, size, source_size, target
UNION ALL
SELECT doc_id, size, source_size, target, 0, NULL FROM p WHERE size = 0
""")
def op12(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"), weights=(1, 2, 3), limit=3)


@query("op13_alignment")
def op13(spark, sf_dir):
    return align.report(table(spark, sf_dir, "documents"))
