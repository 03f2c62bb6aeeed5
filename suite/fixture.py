"""Inputs derived from the driver tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# One log line per event: every level, category and mask occurs.
LINES = """
SELECT event_id AS line_no, concat('app-', cast(user_id % 3 AS string), '.log') AS source_file,
 concat(cast(ts AS string), ' ',
  CASE WHEN event_type <> 'error' THEN CASE event_id % 3 WHEN 0 THEN 'INFO ' WHEN 1 THEN 'DEBUG ' ELSE 'WARNING ' END
       ELSE CASE event_id % 4 WHEN 0 THEN 'ERROR ' WHEN 1 THEN 'FATAL ' WHEN 2 THEN 'CRITICAL ' ELSE '' END END,
  CASE WHEN event_type <> 'error' THEN concat(event_type, ' handled for uid ', cast(user_id AS string), ' in ', cast(event_id % 977 AS string), ' ms')
       ELSE CASE event_id % 8
        WHEN 0 THEN concat('connection timeout to 10.0.', cast(user_id % 256 AS string), '.7 after ', cast(event_id % 977 AS string))
        WHEN 1 THEN concat('postgres query failed rows=', cast(event_id % 53 AS string))
        WHEN 2 THEN concat('sshd[', cast(event_id AS string), ']: Failed password for root from 173.234.31.', cast(user_id % 256 AS string), ' port 38926 ssh2')
        WHEN 3 THEN concat('kafka broker ', cast(user_id % 5 AS string), ' refused connection')
        WHEN 4 THEN concat('exception: heap exhausted at ', cast(event_id AS string))
        WHEN 5 THEN concat('"GET /x HTTP/1.1" 503 ', cast(event_id % 977 AS string))
        WHEN 6 THEN concat('upstream said 500 for 550e8400-e29b-41d4-a716-446655440000 uid ', cast(user_id AS string))
        ELSE concat('task crashed exception code ', cast(user_id AS string)) END END) AS raw_text
FROM events"""

# Replies of a text generator, one per line, in every shape the parser knows.
REPLIES = """
SELECT event_id AS reply_id, CASE event_id % 13
 WHEN 0 THEN concat('{"is_error": true, "error_description": "from ', event_type, '", "recommended_action": null}')
 WHEN 1 THEN concat('Sure: {"is_error": false, "error_description": null, "recommended_action": "wait ', cast(event_id AS string), ' s"} Hope it helps')
 WHEN 2 THEN 'I cannot tell'
 WHEN 3 THEN '{"is_error": "false"}'
 WHEN 4 THEN '{"is_error": 0.0}'
 WHEN 5 THEN concat('{"is_error": ', cast(event_id % 2 AS string), '}')
 WHEN 6 THEN '{"is_error": []}'
 WHEN 7 THEN concat('{"is_error": {"n": ', cast(event_id AS string), '}}')
 WHEN 8 THEN '{"is_error": ""}'
 WHEN 9 THEN '{"is_error": null, "error_description": "none"}'
 WHEN 10 THEN '{"is_error": tru}'
 WHEN 11 THEN '{"is_error": true} or {"is_error": true}'
 ELSE '{"is_error": [0], "recommended_action": "restart"}' END AS reply
FROM events"""

# Label values of several types; `as_json` holds any JSON scalar or container.
LABEL_VALUES = """
SELECT event_id, event_type = 'error' AS as_flag, event_id % 3 AS as_int,
 cast(event_id % 4 AS double) / 2 AS as_real,
 CASE event_id % 11 WHEN 0 THEN 'true' WHEN 1 THEN ' Yes ' WHEN 2 THEN '1.0' WHEN 3 THEN '2' WHEN 4 THEN 'foo'
  WHEN 5 THEN NULL WHEN 6 THEN 'ERROR' WHEN 7 THEN 'ok' WHEN 8 THEN 'Positive' WHEN 9 THEN 'no' ELSE event_type END AS as_text,
 CASE event_id % 9 WHEN 0 THEN '1' WHEN 1 THEN '1.0' WHEN 2 THEN 'true' WHEN 3 THEN '" Y "' WHEN 4 THEN 'null'
  WHEN 5 THEN '[1]' WHEN 6 THEN '{"a": 1}' WHEN 7 THEN '0.5' ELSE 'false' END AS as_json
FROM events"""

# Lines of a label file: JSON, Python literals, blanks and lines to be skipped.
LABEL_LINES = """
SELECT event_id AS line_no, CASE event_id % 8
 WHEN 0 THEN '' WHEN 1 THEN '   ' WHEN 2 THEN '[1, 2]' WHEN 3 THEN 'not a record'
 WHEN 4 THEN concat('{"batch_id": ', cast(event_id AS string), '}')
 WHEN 5 THEN concat('{''batch_id'': ', cast(event_id AS string), ', ''error_found'': ', CASE WHEN event_type = 'error' THEN 'True' ELSE 'False' END, '}')
 WHEN 6 THEN concat('{"error_found": null, "batch_id": ', cast(event_id AS string), '}')
 ELSE concat('{"batch_id": ', cast(event_id AS string), ', "error_found": ', CASE WHEN event_type = 'error' THEN 'true' ELSE 'false' END, '}') END AS text
FROM events"""

# Label documents of every shape, one per event.
LABEL_DOCUMENTS = """
SELECT event_id AS doc_no, CASE event_id % 6
 WHEN 0 THEN concat('{"error_found": [true, false, ', cast(event_id AS string), ']}')
 WHEN 1 THEN concat('{"results": [{"error_found": true, "n": ', cast(event_id AS string), '}, 0, {"x": 1}]}')
 WHEN 2 THEN '[{"error_found": "yes"}, {"y": 2}]'
 WHEN 3 THEN concat('[1, "no", null, {"error_found": ', cast(event_id AS string), '}]')
 WHEN 4 THEN '{"other": 1}'
 ELSE '[]' END AS doc
FROM events"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def derived(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run one of the statements above; views are bound when it is analysed."""
    table(spark, sf, "events").createOrReplaceTempView("events")
    return spark.sql(sql)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return derived(spark, sf, LINES)


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Each document cut at line feeds."""
    docs = table(spark, sf, "documents").select("doc_id", F.split("text", "\n").alias("parts"))
    return docs.select("doc_id", F.posexplode("parts").alias("part", "raw_text"))


# The same with DuckDB.
DOCUMENT_LINES = """
SELECT doc_id, unnest(range(len(parts))) AS part, unnest(parts) AS raw_text
FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)"""
