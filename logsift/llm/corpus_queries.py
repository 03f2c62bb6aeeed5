"""Registered queries of the manifest, the prefix trie and the language model, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import lm, merkle, prefixtrie
from logsift.llm.common import crc_mod, fold, table
from logsift.staging import stage

# CRC-32 of a decimal number as text, byte by byte through a table of the reflected polynomial.
CRC = r"""
poly AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
 lambda t, k: CASE WHEN t % 2 = 1 THEN xor(t // 2, 3988292384) ELSE t // 2 END)) AS t)"""


def crc_sql(text: str) -> str:
    """SQL of the unsigned CRC-32 of an ASCII text; the query must also read ``poly``."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda c, b: xor(c // 256, poly.t[xor(c, b) % 256 + 1])), 4294967295)"


def op11_merkle(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    row = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    tampered = F.when(crc_mod("doc_id", 3) == 0, row(fold(F.col("text"))))
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("order"), row(F.col("text")).alias("hash"), F.struct("doc_id", tampered.alias("tampered")).alias("row"))
    manifest = merkle.build(leaves)
    folded = merkle.folded(F.coalesce("row.tampered", "leaf"), F.col("path"))
    found = manifest.proofs().select("row.doc_id", "leaf", "subroot", "root", merkle.joined(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


OP11 = rf"""
WITH RECURSIVE {CRC},
cells AS (
 SELECT doc_id, lang, text AS was, CASE WHEN hit THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now,
  list_reduce(list_transform([CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)],
   lambda x: coalesce(strlen(x) || ':' || x, '-')), lambda a, b: a || b) AS start
 FROM (SELECT *, coalesce({crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0, false) AS hit FROM documents, poly)),
leaves AS (
 SELECT *, sha256(start || coalesce(strlen(was) || ':' || was, '-')) AS leaf, sha256(start || coalesce(strlen(now) || ':' || now, '-')) AS tampered FROM cells),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
nodes AS (
 SELECT lang, 0 AS level, i, leaf AS h, n FROM placed
 UNION ALL
 SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM nodes WHERE n > 1 GROUP BY lang, level, i // 8),
tops AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
upper AS (
 SELECT 0 AS level, i, subroot AS h, n FROM tops
 UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM upper WHERE n > 1 GROUP BY level, i // 8),
heights AS (SELECT lang, max(level) AS height FROM nodes GROUP BY lang),
walk AS (
 SELECT p.lang, p.i AS leaf_at, 0 AS level, p.i, '' AS proof, p.tampered AS acc, false AS up FROM placed p
 UNION ALL
 SELECT w.lang, w.leaf_at, w.level + 1, w.i // 8,
  w.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> w.i), ''),
  sha256(coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < w.i), '') || w.acc || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > w.i), '')), false
 FROM walk w JOIN nodes s ON w.lang IS NOT DISTINCT FROM s.lang AND w.level = s.level AND w.i // 8 = s.i // 8 AND s.n > 1
 GROUP BY w.lang, w.leaf_at, w.level, w.i, w.proof, w.acc),
ends AS (SELECT w.*, t.i AS top_at, t.subroot FROM walk w JOIN heights h ON w.lang IS NOT DISTINCT FROM h.lang AND w.level = h.height JOIN tops t ON w.lang IS NOT DISTINCT FROM t.lang),
climb AS (
 SELECT lang, leaf_at, subroot, 0 AS level, top_at AS i, proof, acc FROM ends
 UNION ALL
 SELECT w.lang, w.leaf_at, w.subroot, w.level + 1, w.i // 8,
  w.proof || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i <> w.i), ''),
  sha256(coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i < w.i), '') || w.acc || coalesce(string_agg(s.h, '' ORDER BY s.i) FILTER (s.i > w.i), ''))
 FROM climb w JOIN upper s ON w.level = s.level AND w.i // 8 = s.i // 8 AND s.n > 1 GROUP BY w.lang, w.leaf_at, w.subroot, w.level, w.i, w.proof, w.acc)
SELECT p.doc_id, p.leaf, c.subroot, r.h AS root, sha256(c.proof) AS proof_sha256, c.acc AS folded_root, c.acc = r.h AS verified
FROM climb c JOIN placed p ON p.lang IS NOT DISTINCT FROM c.lang AND p.i = c.leaf_at
JOIN upper r ON r.n = 1 AND c.level = r.level"""


EMPTY_SHA256 = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation begins with turns of the one whose id is the next lower multiple of 5."""
    own = stage(prefixtrie.turns_of(conversations), "turns")
    base = own.filter("conv_id % 5 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 8).alias("first"))
    length = F.crc32(F.col("conv_id").cast("string")) % 9
    both = own.withColumn("base", F.col("conv_id") - F.col("conv_id") % 5).withColumn("h", length.cast("int")).join(base, "base", "left")
    first = F.coalesce(F.slice("first", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return stage(both.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns")), "rebuilt")


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    conversations = rebuilt(table(spark, sf, "conversations"))
    nodes = prefixtrie.nodes(conversations)
    ended = nodes.filter("class IS NOT NULL").join(prefixtrie.id_digests(conversations), "class")
    every = ended.unionByName(nodes.filter("class IS NULL").withColumn("ends_sha256", F.lit(EMPTY_SHA256)))
    return every.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP12 = rf"""
WITH {CRC},
own AS (
 SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS pos, role, text
 FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT DISTINCT conv_id AS c, conv_id - conv_id % 5 AS base, {crc_sql("CAST(conv_id AS VARCHAR)")} % 9 AS h FROM own, poly),
parts AS (
 SELECT c, pos, 0 AS half, role, text FROM convs JOIN own ON own.conv_id = base AND pos <= h
 UNION ALL SELECT c, pos, 1, role, text FROM convs JOIN own ON own.conv_id = c AND pos > h),
turns AS (
 SELECT c, row_number() OVER w AS d, strlen(text) AS bytes,
  string_agg(md5(strlen(role) || ':' || role || text), '') OVER (w ROWS UNBOUNDED PRECEDING) AS prefix FROM parts WINDOW w AS (PARTITION BY c ORDER BY half, pos)),
members AS (SELECT c, d, prefix, bytes FROM turns UNION ALL SELECT c, 0, '', 0 FROM convs),
lens AS (SELECT c, max(d) AS len FROM members GROUP BY c),
nodes AS (
 SELECT prefix, any_value(m.d) AS depth, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(bytes) AS saved,
  sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = m.d), '')) AS ends_sha256
 FROM members m JOIN lens USING (c) GROUP BY prefix),
children AS (SELECT left(prefix, length(prefix) - 32) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
spread AS (
 SELECT left(n.prefix, 32 * k) AS prefix, sum(n.saved) AS saved, count(*) FILTER (ch.n IS NULL) AS leaves
 FROM nodes n LEFT JOIN children ch USING (prefix), unnest(range(n.depth + 1)) AS t(k) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(ch.n, 0) AS BIGINT) AS n_children,
 s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN spread s USING (prefix) LEFT JOIN children ch USING (prefix)
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = left(n.prefix, length(n.prefix) - 32)"""


def op13_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", F.coalesce(crc_mod("doc_id", 5) != 1, F.lit(False)).alias("learnt"))
    held_out = F.coalesce(crc_mod("doc_id", 5) == 1, F.lit(False)).alias("held_out")
    return lm.score(docs, "learnt").select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


CASES = {
    "op11_merkle": (op11_merkle, OP11),
    "op12_prefix_trie": (op12_prefix_trie, OP12),
    "op13_lm_score": (op13_lm_score, None),
}
