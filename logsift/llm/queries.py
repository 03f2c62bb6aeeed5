"""Registered queries of the operators, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logsift.llm import corpus_queries, decontaminate, extract, langid, linededup, mixing, neardup, outliers, secrets, toolcalls, toxicity
from logsift.llm.common import crc_mod, table

# Tools of the derived calls; "forget" is unknown on purpose.
TOOLS = {
    "search": {
        "type": "object",
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 5}},
        "required": ["query", "limit"],
        "additionalProperties": False,
    },
    "translate": {"type": "object", "properties": {"text": {"type": "string"}, "lang": {"enum": ["de", "en"]}}, "required": ["lang", "text"]},
    "summarise": {"type": "object", "properties": {"text": {"type": "string"}, "words": {"type": "integer"}}, "required": ["text", "words"]},
}


def derived_calls(turns: DataFrame) -> DataFrame:
    """Every assistant turn as a call, most of them built on the one before; some are broken."""
    name = F.get(F.array(*map(F.lit, [*TOOLS, "forget"])), (F.col("conv_id") + F.col("turn")).cast("int") % 4)
    arguments = (
        F.when(F.col("conv_id") % 17 == 0, F.lit('{"query": '))
        .when(F.col("name") == "search", F.to_json(F.struct(F.col("text").alias("query"), F.col("turn").alias("limit"))))
        .when(F.col("name") == "translate", F.to_json(F.struct("text", F.get(F.array(F.lit("en"), F.lit("de"), F.lit("xx")), F.col("conv_id").cast("int") % 3).alias("lang"))))
        .otherwise(F.to_json(F.struct("text")))
    )
    label = lambda n: F.concat(F.lit("call-"), (F.col("turn") + n).cast("string"))
    after = F.when((F.col("turn") >= 2) & (F.col("conv_id") % 5 != 0), label(-2)).when((F.col("turn") == 1) & (F.col("conv_id") % 23 == 0), label(2))
    calls = turns.filter("role = 'assistant'").withColumn("name", name)
    return calls.select("conv_id", label(0).alias("call_id"), "turn", "name", arguments.alias("arguments"), after.alias("after"))


def derived_results(turns: DataFrame) -> DataFrame:
    """Every user turn as the result of the call before it; a first turn answers nothing."""
    number = F.concat(F.lit("call-"), (F.col("turn") - 1).cast("string"))
    return turns.filter("role = 'user'").select("conv_id", number.alias("call_id"), "turn", F.col("text").alias("content"))


def op1_tool_calls(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    linked = toolcalls.link(derived_calls(turns), derived_results(turns), TOOLS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


OP1 = r"""
WITH RECURSIVE named AS (
 SELECT *, ['search', 'translate', 'summarise', 'forget'][(conv_id + turn) % 4 + 1] AS name FROM conversations WHERE role = 'assistant'),
calls AS (
 SELECT conv_id, 'call-' || turn AS call_id, turn, name, conv_id % 17 = 0 AS broken, text,
  CASE WHEN turn >= 2 AND conv_id % 5 <> 0 THEN 'call-' || (turn - 2) WHEN turn = 1 AND conv_id % 23 = 0 THEN 'call-3' END AS wanted FROM named),
known AS (SELECT c.*, p.call_id AS after FROM calls c LEFT JOIN calls p ON p.conv_id = c.conv_id AND p.call_id = c.wanted),
depth AS (
 SELECT conv_id, call_id, CAST(0 AS BIGINT) AS level FROM known WHERE after IS NULL
 UNION ALL SELECT k.conv_id, k.call_id, d.level + 1 FROM known k JOIN depth d ON k.conv_id = d.conv_id AND k.after = d.call_id),
results AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, turn AS result_turn, text AS content FROM conversations WHERE role = 'user')
SELECT coalesce(k.conv_id, r.conv_id) AS conv_id, coalesce(k.call_id, r.call_id) AS call_id, coalesce(k.turn, r.result_turn) AS turn, k.name, d.level, k.after,
 CASE WHEN k.call_id IS NULL THEN 'result without call' WHEN r.call_id IS NULL THEN 'call without result'
  WHEN d.level IS NULL THEN 'cycle' ELSE 'linked' END AS status,
 CAST(k.call_id IS NOT NULL AS BIGINT) AS n_calls, CAST(r.call_id IS NOT NULL AS BIGINT) AS n_results,
 CASE WHEN k.call_id IS NULL THEN '' ELSE array_to_string(list_filter([
  CASE WHEN broken THEN 'arguments: not valid JSON' END, CASE WHEN k.name = 'forget' THEN 'name: unknown tool' END,
  CASE WHEN broken THEN NULL WHEN k.name = 'search' AND k.turn > 5 THEN '$.limit: above 5' WHEN k.name = 'search' AND k.turn < 1 THEN '$.limit: below 1' END,
  CASE WHEN NOT broken AND k.name = 'search' AND k.text = '' THEN '$.query: too short' END,
  CASE WHEN NOT broken AND k.name = 'translate' AND k.conv_id % 3 = 2 THEN '$.lang: not one of the allowed values' END,
  CASE WHEN NOT broken AND k.name = 'summarise' THEN '$.words: missing' END], lambda x: x IS NOT NULL), '; ') END AS errors,
 '{"arguments":' || CASE WHEN k.call_id IS NULL OR broken THEN 'null'
   WHEN k.name = 'search' THEN '{"limit":' || k.turn || ',"query":' || CAST(to_json(k.text) AS VARCHAR) || '}'
   WHEN k.name = 'translate' THEN '{"lang":"' || ['en', 'de', 'xx'][k.conv_id % 3 + 1] || '","text":' || CAST(to_json(k.text) AS VARCHAR) || '}'
   ELSE '{"text":' || CAST(to_json(k.text) AS VARCHAR) || '}' END
  || ',"call_id":"' || coalesce(k.call_id, r.call_id) || '","name":' || coalesce('"' || k.name || '"', 'null')
  || ',"result":' || coalesce(CAST(to_json(r.content) AS VARCHAR), 'null') || '}' AS json
FROM known k FULL JOIN results r ON r.conv_id = k.conv_id AND r.call_id = k.call_id
LEFT JOIN depth d ON d.conv_id = k.conv_id AND d.call_id = k.call_id"""


def op2_outliers(spark: SparkSession, sf: str) -> DataFrame:
    judged = outliers.judge(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


OP3 = r"""
WITH tokens AS (
 SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
 UNION ALL
 SELECT 1, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
grams AS (
 SELECT DISTINCT kind, id, gram FROM (
  SELECT kind, id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM tokens)),
sizes AS (SELECT id, count(*) AS n_item FROM grams WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, s.n_item, count(*) AS n_shared, count(*) / s.n_item AS containment
FROM grams d JOIN grams i ON d.gram = i.gram AND d.kind = 0 AND i.kind = 1 JOIN sizes s ON s.id = i.id
GROUP BY d.id, i.id, s.n_item HAVING 100 * count(*) >= 75 * s.n_item"""


def op4_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.link(table(spark, sf, "documents")).drop("class_id")


OP4 = r"""
WITH RECURSIVE tokens AS (
 SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (
 SELECT DISTINCT doc_id, hash(gram) AS gram FROM (
  SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
   WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM tokens)),
sizes AS (SELECT d.doc_id, count(g.gram) AS n FROM documents d LEFT JOIN grams g USING (doc_id) GROUP BY ALL),
links AS (
 SELECT a.doc_id AS u, b.doc_id AS v FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id
 JOIN sizes m ON m.doc_id = a.doc_id JOIN sizes n ON n.doc_id = b.doc_id
 GROUP BY a.doc_id, b.doc_id, m.n, n.n HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))),
reached AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, l.v FROM reached r JOIN links l ON l.u = r.v)
SELECT s.doc_id, s.n AS n_shingles, min(r.v) AS component_id, min(r.v) = s.doc_id AS kept
FROM sizes s JOIN reached r ON r.u = s.doc_id GROUP BY s.doc_id, s.n"""


def op5_extract(spark: SparkSession, sf: str) -> DataFrame:
    return extract.extract(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


def op6_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"))


OP6 = r"""
WITH sized AS (
 SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
filled AS (
 SELECT *, row_number() OVER o AS place,
  CAST(sum(s) OVER () - coalesce(sum(3 * s) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
  / CAST(sum(w) OVER (ORDER BY 3 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS level
 FROM per WINDOW o AS (ORDER BY 3 * s / w, source NULLS LAST)),
fixed AS (SELECT arg_min(level, place) AS level FROM filled WHERE level * w <= 3 * s),
targets AS (SELECT source, s, least(CAST(3 * s AS DOUBLE), fixed.level * w) AS target FROM per, fixed),
placed AS (
 SELECT d.*, t.s AS source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
 CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
  + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM placed"""


def op7_secrets(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf, "documents"))


def op8_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    edited = linededup.delete_copies(table(spark, sf, "documents"))
    return edited.select("doc_id", "n_lines", "n_deleted", "n_deleted_words", "text")


OP8 = r"""
WITH cut AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS t FROM cut),
spoken AS (
 SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS pos, sum(w) OVER (PARTITION BY doc_id ORDER BY line) AS total
 FROM (SELECT *, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS w FROM lines) WHERE w > 0),
shortest AS (
 SELECT a.doc_id, a.pos AS first, b.pos AS last FROM spoken a JOIN spoken b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 49
 WHERE b.total - a.total + a.w >= 50 AND (b.total - b.w - a.total + a.w < 50 OR b.total - a.total < 50)),
runs AS (
 SELECT r.doc_id, first, last, string_agg(t, chr(10) ORDER BY pos) AS run
 FROM shortest r JOIN spoken s ON s.doc_id = r.doc_id AND s.pos BETWEEN first AND last GROUP BY ALL),
later AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, first) AS copy FROM runs) WHERE copy > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS pos FROM later),
marked AS (
 SELECT l.doc_id, l.line, l.t, s.w, g.pos IS NOT NULL AS gone
 FROM lines l LEFT JOIN spoken s USING (doc_id, line) LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.pos = s.pos)
SELECT d.doc_id, count(m.w) AS n_lines, count_if(coalesce(m.gone, false)) AS n_deleted,
 CAST(coalesce(sum(m.w) FILTER (m.gone), 0) AS BIGINT) AS n_deleted_words,
 CASE WHEN d.text IS NOT NULL THEN coalesce(string_agg(m.t, chr(10) ORDER BY m.line) FILTER (NOT m.gone), '') END AS text
FROM documents d LEFT JOIN marked m ON m.doc_id = d.doc_id GROUP BY d.doc_id, d.text"""


def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    learnt = F.coalesce(crc_mod("doc_id", 5) != 0, F.lit(False))
    index, vocabulary = toxicity.fit(docs, docs.filter(learnt), labels.filter(learnt), toxicity.Settings())
    held_out = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, index, vocabulary).select("doc_id", held_out, "score", "predicted", "evidence", "terms")


def op10_langid(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    net = langid.fit(docs.filter(F.coalesce(crc_mod("doc_id", 4) != 2, F.lit(False))))
    held_out = F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, net).select("doc_id", held_out, "lang_pred", "score", "agreement")


CASES = {
    "op1_tool_calls": (op1_tool_calls, OP1),
    "op2_outliers": (op2_outliers, None),
    "op3_decontaminate": (op3_decontaminate, OP3),
    "op4_near_dedup": (op4_near_dedup, OP4),
    "op5_extract": (op5_extract, None),
    "op6_mix": (op6_mix, OP6),
    "op7_secrets": (op7_secrets, None),
    "op8_line_dedup": (op8_line_dedup, OP8),
    "op9_toxicity": (op9_toxicity, None),
    "op10_langid": (op10_langid, None),
    **corpus_queries.CASES,
}
