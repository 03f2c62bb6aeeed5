"""Checked queries: labelling, masking, indexing, batching, verdicts and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.functions import rules, text
from logsift.functions.pyjson import whole_json
from logsift.functions.verdict import json_object_text, parse_verdicts, prompt, truthy, without_echo
from logsift.operators.batching import (
    assign_batches,
    batch_counts,
    batch_text,
    collect_entries,
    rule_verdicts,
    summary,
)
from logsift.operators.classify import generative_classifier, python_classifier
from logsift.operators.indexing import index_ordered, index_scanned
from logsift.plans.triage import triage_batches
from logsift.sinks.results import (
    append_summaries,
    array_lines,
    json_text,
    read_summaries,
    running_totals,
    summary_items,
    write_json_array,
    write_labelled,
)
from logsift.sources.logfiles import scan_log_dir, scan_text_file
from logsift.staging import scratch_path
from suite.fixture import DOCUMENT_LINES, LINES, REPLIES, derived, document_lines, lines, table

# ---- oracle building blocks -------------------------------------------------

# The mask patterns that every labelling must use.
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
UUID = r"\b[a-fA-F0-9]{8}(-[a-fA-F0-9]{4}){3}-[a-fA-F0-9]{12}\b"
NUM = r"\b\d+\b"
SPACES = "concat(" + ", ".join(
    f"chr({c})" for c in [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
) + ")"


def masked(column: str) -> str:
    ip = f"regexp_replace({column}, '{IP}', '<IP>', 'g')"
    return f"regexp_replace(regexp_replace({ip}, '{UUID}', '<UUID>', 'g'), '{NUM}', '<NUM>', 'g')"


def any_of(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(u, '{w}')" for w in words) + ")"


# The words and statuses that make a line an error.
IS_ERROR = (
    any_of(["ERROR", "FATAL", "CRITICAL", "EXCEPTION", "FAILED", "TIMEOUT", "REFUSED"])[:-1]
    + " OR regexp_matches(raw_text, 'HTTP/[^\\n]{3}\" 5\\d\\d') OR contains(raw_text, ' 500 '))"
)


def labelled(source: str) -> str:
    """SQL over ``source`` with columns raw_text and anything else."""
    return f"""
SELECT *, CASE WHEN NOT is_error THEN 'NORMAL'
  WHEN {any_of(['TIMEOUT', 'TIME OUT'])} THEN 'TIMEOUT_ERROR'
  WHEN {any_of(['POSTGRES', 'MYSQL', 'DB', 'SQL'])} THEN 'DATABASE_ERROR'
  WHEN {any_of(['SSH', 'PASSWORD', 'AUTH'])} THEN 'AUTHENTICATION_ERROR'
  WHEN {any_of(['KAFKA', 'BROKER', 'CONSUMER'])} THEN 'MESSAGING_KAFKA_ERROR'
  WHEN {any_of(['MEMORY', 'OOM', 'HEAP'])} THEN 'RESOURCE_EXHAUSTION'
  WHEN {any_of(['HTTP', '500', 'REST'])} THEN 'HTTP_SERVICE_FAILURE'
  ELSE 'GENERIC_SYSTEM_ERROR' END AS error_category,
 CASE WHEN is_error THEN 'HIGH' ELSE 'NONE' END AS severity,
 CASE WHEN contains(u, 'INFO') THEN 'INFO' WHEN contains(u, 'DEBUG') THEN 'DEBUG' WHEN contains(u, 'WARN') THEN 'WARN'
  WHEN contains(u, 'ERROR') THEN 'ERROR' WHEN contains(u, 'FATAL') THEN 'FATAL'
  WHEN contains(u, 'CRITICAL') THEN 'CRITICAL' ELSE 'INFO' END AS level,
 trim(raw_text, {SPACES}) AS raw_message, {masked(f"trim(raw_text, {SPACES})")} AS template
FROM (SELECT *, {IS_ERROR} AS is_error
      FROM (SELECT *, upper(raw_text) AS u FROM ({source}) WHERE length(trim(raw_text, {SPACES})) > 0))"""


INDEXED = f"""
SELECT row_number() OVER (ORDER BY source_file, line_no) - 1 AS index, * FROM ({LINES})"""


def batched(size: int) -> str:
    return f"SELECT index // {size} AS batch_id, * FROM ({INDEXED})"


def texts(size: int) -> str:
    return f"""
SELECT batch_id, string_agg(concat('[', index, '] ', raw_text), chr(10) ORDER BY index) AS text
FROM ({batched(size)}) GROUP BY batch_id"""


def verdicts(size: int) -> str:
    return f"""
SELECT batch_id, bool_or(is_error) AS error_found, count(*) AS n_lines
FROM ({labelled(batched(size))}) GROUP BY batch_id"""


# Fixed value: the wording of the prompt.
PROMPT = """'Determine if there is an error in this group of logs.Respond ONLY with valid JSON in this exact format, do not include any extra text or explanations:
{
  "is_error": true or false,
  "error_description": "brief description of the error or null",
  "recommended_action": "what action to take or null"
}

Log entry: '"""

# ---- queries ----------------------------------------------------------------


def label_lines(spark, sf):
    return rules.label_lines(lines(spark, sf)).drop("raw_text")


def label_counts(spark, sf):
    labelled_lines = rules.label_lines(lines(spark, sf))
    return labelled_lines.groupBy("error_category", "level", "severity").agg(F.count(F.lit(1)).alias("n"))


def template_counts(spark, sf):
    return rules.label_lines(lines(spark, sf)).groupBy("template").agg(F.count(F.lit(1)).alias("n"))


def label_documents(spark, sf):
    return rules.label_lines(document_lines(spark, sf)).drop("raw_text")


def mask_steps(spark, sf):
    raw = F.col("raw_text")
    return lines(spark, sf).select(
        "line_no",
        text.mask_ips(raw).alias("ips"),
        text.mask_uuids(raw).alias("uuids"),
        text.mask_numbers(raw).alias("numbers"),
    )


def mask_documents(spark, sf):
    return document_lines(spark, sf).select("doc_id", "part", text.log_template(F.col("raw_text")).alias("template"))


def strip_text(spark, sf):
    padded = F.concat(F.lit(" \t"), F.col("text"), F.lit(" \x1f\x85\r\n"))
    return table(spark, sf, "documents").select(
        "doc_id", text.strip(padded).alias("stripped"), text.chomp(padded).alias("chomped")
    )


def base_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.base_name(F.col("url")).alias("name"))


def labelled_records(spark, sf):
    record = F.to_json(rules.labelled_record())
    return rules.label_lines(lines(spark, sf)).select("line_no", record.alias("record"))


def export_labelled(spark, sf):
    path = scratch_path(spark, "labelled")
    write_labelled(rules.label_lines(lines(spark, sf)), path)
    schema = (
        "service struct<name:string, environment:string>,"
        "log_data struct<level:string, template:string, raw_message:string>,"
        "ground_truth_label struct<is_error:boolean, error_category:string, severity:string>"
    )
    return spark.read.schema(schema).json(path).select("service.*", "log_data.*", "ground_truth_label.*")


def _written_lines(spark, sf, blank: bool = False):
    path = scratch_path(spark, "logs")
    ordered = lines(spark, sf).orderBy("source_file", "line_no")
    if blank:  # a blank and an empty line after each one
        ordered = ordered.withColumn("raw_text", F.concat("raw_text", F.lit("\n \n")))
    ordered.select("raw_text").write.text(path)
    return path


def scan_log_files(spark, sf):
    """Lines of white space stay and get numbers, empty ones do not."""
    scanned = scan_log_dir(spark, _written_lines(spark, sf, blank=True), glob="*.txt")
    return index_scanned(scanned).select("index", "raw_text")


def scan_label_file(spark, sf):
    scanned = scan_text_file(spark, _written_lines(spark, sf, blank=True))
    return rules.label_lines(index_scanned(scanned)).select("index", "template", "error_category")


def _indexed(spark, sf, **options):
    return index_ordered(lines(spark, sf), **options)


def index_lines(spark, sf):
    return _indexed(spark, sf).select("index", "source_file", "line_no")


def index_null_sources(spark, sf):
    """Lines without a source come first and keep the index dense."""
    source = F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("app-"), (F.col("user_id") % 3).cast("string")))
    rows = table(spark, sf, "events").select(source.alias("source_file"), F.col("event_id").alias("line_no"))
    return index_ordered(rows).select("index", "source_file", "line_no")


def index_lines_small_chunks(spark, sf):
    return _indexed(spark, sf, chunk=64).select("index", "source_file", "line_no")


def index_conversations(spark, sf):
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("source_file"), F.col("turn").alias("line_no"), F.col("text").alias("raw_text")
    )
    numbered = index_ordered(turns.where(F.length("raw_text") > 0))
    return assign_batches(numbered, 10).select("batch_id", "index", "source_file", "line_no")


def batch_lines(spark, sf):
    batches = collect_entries(assign_batches(_indexed(spark, sf)))
    return batches.select("batch_id", F.size("entries").alias("n_lines"), F.to_json("entries").alias("entries"))


def batch_size_floor(spark, sf):
    return assign_batches(_indexed(spark, sf), 0).select("index", "batch_id")


def batch_texts(spark, sf):
    batches = collect_entries(assign_batches(_indexed(spark, sf)))
    return batches.select("batch_id", batch_text(F.col("entries")).alias("text"))


def lines_per_batch(spark, sf):
    return batch_counts(assign_batches(_indexed(spark, sf)))


def batch_verdicts(spark, sf):
    return rule_verdicts(assign_batches(_indexed(spark, sf), 5))


def batch_summaries(spark, sf):
    return summary(rule_verdicts(assign_batches(_indexed(spark, sf), 5)))


def job_totals(spark, sf):
    return running_totals(rule_verdicts(assign_batches(_indexed(spark, sf), 5)))


def prompts(spark, sf):
    batches = collect_entries(assign_batches(_indexed(spark, sf)))
    return batches.select("batch_id", prompt(batch_text(F.col("entries"))).alias("prompt"))


def echo_removal(spark, sf):
    asked = prompt(F.col("raw_text"))
    answer = F.concat(asked, F.lit(" \n reply to "), F.col("source_file"), F.lit("\t\n"))
    return lines(spark, sf).select("line_no", without_echo(answer, asked).alias("reply"))


def parsed_verdicts(spark, sf):
    replies = derived(spark, sf, REPLIES)
    return parse_verdicts(replies.withColumn("object", json_object_text(F.col("reply"))), "reply").drop("reply")


def truth_values(spark, sf):
    values = derived(spark, sf, REPLIES).withColumn("v", whole_json(json_object_text(F.col("reply"))))
    member = F.try_variant_get("v", "$.is_error", "variant")
    return values.select("reply_id", truthy(member).alias("truthy"))


def triage_rules(spark, sf):
    return summary(triage_batches(_indexed(spark, sf), 5))


ERROR_WORDS = rules.ERROR_KEYWORDS


def keyword_generator():
    """A stand-in for a text generator: answers by keyword, fails on some prompts."""
    words = [w.lower() for w in ERROR_WORDS]

    def generate(prompt_text: str) -> str:
        log = prompt_text.split("Log entry: ", 1)[1].lower()
        if "heap exhausted" in log:
            raise RuntimeError("generator out of memory")
        return f'Answer: {{"is_error": {str(any(w in log for w in words)).lower()}, "error_description": null}}'

    return generate


def triage_generated(spark, sf):
    """Failing batches become error rows and the others go on."""
    classifier = generative_classifier(keyword_generator, "keyword-generator")
    result = triage_batches(_indexed(spark, sf), 5, classifier)
    timed = F.col("elapsed_ms") >= 0
    return result.select("batch_id", "error_found", "model_name", "error", timed.alias("timed"))


def grouped_generator():
    one = keyword_generator()
    return lambda prompts: [one(p) for p in prompts]


def triage_grouped(spark, sf):
    """The generator takes lists; a failing prompt does not take its group with it."""
    classifier = generative_classifier(grouped_generator, "grouped-generator", group_chars=20000)
    result = triage_batches(_indexed(spark, sf), 5, classifier)
    timed = F.col("elapsed_ms") >= 0
    return result.select("batch_id", "error_found", "model_name", "error", timed.alias("timed"))


def line_analyzer():
    def analyze(batch_id: int, entries: list[dict]) -> dict:
        flagged = [
            {"log_index": e["index"], "is_error": True, "error_description": e["source_file"]}
            for e in entries
            if "refused" in e["raw_text"]
        ]
        return {"error_found": bool(flagged), "results": flagged}

    return analyze


def triage_python(spark, sf):
    result = triage_batches(_indexed(spark, sf), 20, python_classifier(line_analyzer, "line-analyzer"))
    lines_found = F.array_join(F.transform("results", lambda r: r["log_index"].cast("string")), ",")
    return result.select("batch_id", "error_found", "model_name", lines_found.alias("lines_found"))


def jsonl_roundtrip(spark, sf):
    path = scratch_path(spark, "summaries")
    append_summaries(rule_verdicts(assign_batches(_indexed(spark, sf), 5)), path)
    return read_summaries(spark, path)


def jsonl_lines(spark, sf):
    path = scratch_path(spark, "summaries")
    append_summaries(rule_verdicts(assign_batches(_indexed(spark, sf), 5)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def json_array(spark, sf):
    items = summary_items(rule_verdicts(assign_batches(_indexed(spark, sf), 5)))
    return array_lines(items, ["run", "at"]).select(F.col("at").alias("batch_id"), "line")


def json_array_file(spark, sf):
    """Written, read back in file order and numbered."""
    path = scratch_path(spark, "array")
    items = summary_items(rule_verdicts(assign_batches(_indexed(spark, sf), 5)))
    write_json_array(items, ["run", "at"], path)
    written = scan_log_dir(spark, path, glob="*.txt")
    return index_scanned(written).select(F.col("index").alias("batch_id"), F.col("raw_text").alias("line"))


def labelled_json_lines(spark, sf):
    labelled_lines = rules.label_lines(lines(spark, sf))
    return labelled_lines.select(json_text("line_no", "level", "is_error", "severity").alias("line"))


_SUMMARY_JSON = """concat('{"batch_id":', batch_id, ',"error_found":', error_found, ',"model_name":null,"embedder_model_name":null}')"""
_ARRAY = f"""
SELECT batch_id, concat(CASE WHEN batch_id = min(batch_id) OVER () THEN '[' ELSE ',' END, {_SUMMARY_JSON},
 CASE WHEN batch_id = max(batch_id) OVER () THEN ']' ELSE '' END) AS line FROM ({verdicts(5)})"""
_SUMMARIES = f"""
SELECT batch_id, error_found, CAST(NULL AS VARCHAR) AS model_name, CAST(NULL AS VARCHAR) AS embedder_model_name
FROM ({verdicts(5)})"""
_LABEL_COLUMNS = "level, template, raw_message, is_error, error_category, severity"
_TRUTH = """CASE json_type(obj, '$.is_error') WHEN 'BOOLEAN' THEN json_extract_string(obj, '$.is_error') = 'true'
  WHEN 'VARCHAR' THEN json_extract_string(obj, '$.is_error') <> ''
  WHEN 'ARRAY' THEN json_array_length(obj, '$.is_error') > 0
  WHEN 'OBJECT' THEN len(json_keys(obj, '$.is_error')) > 0
  WHEN 'NULL' THEN false
  ELSE coalesce(CAST(json_extract_string(obj, '$.is_error') AS DOUBLE) <> 0, false) END"""
_REPLY_OBJECTS = f"""
SELECT reply_id, object, CASE WHEN json_valid(object) THEN object END AS obj
FROM (SELECT reply_id, regexp_extract(reply, '\\{{.*\\}}', 0, 's') AS object FROM ({REPLIES}))"""
_WITH_BLANKS = f"""
SELECT row_number() OVER (ORDER BY source_file, line_no, part) - 1 AS index, raw_text
FROM (SELECT source_file, line_no, 0 AS part, raw_text FROM ({LINES})
      UNION ALL SELECT source_file, line_no, 1, ' ' FROM ({LINES}))"""

_GENERATED = f"""SELECT batch_id, heap OR error_word AS error_found, 'grouped-generator' AS model_name,
        CASE WHEN heap THEN 'RuntimeError: generator out of memory' END AS error, true AS timed
        FROM (SELECT batch_id, bool_or(contains(u, 'HEAP EXHAUSTED')) AS heap,
         bool_or({any_of(["ERROR", "FATAL", "CRITICAL", "EXCEPTION", "FAILED", "TIMEOUT", "REFUSED"])}) AS error_word
        FROM (SELECT *, upper(raw_text) AS u FROM ({batched(5)})) GROUP BY batch_id)"""

CASES = {
    "label_lines": (label_lines, f"SELECT line_no, source_file, {_LABEL_COLUMNS} FROM ({labelled(LINES)})"),
    "label_counts": (
        label_counts,
        f"SELECT error_category, level, severity, count(*) AS n FROM ({labelled(LINES)}) GROUP BY ALL",
    ),
    "template_counts": (
        template_counts, f"SELECT template, count(*) AS n FROM ({labelled(LINES)}) GROUP BY template",
    ),
    "label_documents": (
        label_documents, f"SELECT doc_id, part, {_LABEL_COLUMNS} FROM ({labelled(DOCUMENT_LINES)})",
    ),
    "mask_steps": (
        mask_steps,
        f"""SELECT line_no, regexp_replace(raw_text, '{IP}', '<IP>', 'g') AS ips,
        regexp_replace(raw_text, '{UUID}', '<UUID>', 'g') AS uuids,
        regexp_replace(raw_text, '{NUM}', '<NUM>', 'g') AS numbers FROM ({LINES})""",
    ),
    "mask_documents": (
        mask_documents, f"SELECT doc_id, part, {masked('raw_text')} AS template FROM ({DOCUMENT_LINES})",
    ),
    "strip_text": (
        strip_text,
        f"""SELECT doc_id, trim(padded, {SPACES}) AS stripped,
        rtrim(rtrim(padded, chr(10)), chr(13)) AS chomped
        FROM (SELECT doc_id, concat(chr(8195), chr(9), text, ' ', chr(31), chr(133), chr(13), chr(10)) AS padded FROM documents)""",
    ),
    "base_names": (base_names, "SELECT page_id, string_split(url, '/')[-1] AS name FROM pages"),
    "labelled_records": (
        labelled_records,
        f"""SELECT line_no, CAST(to_json(struct_pack(
         service := struct_pack(name := 'university-service', environment := 'production'),
         log_data := struct_pack(level := level, template := template, raw_message := raw_message),
         ground_truth_label := struct_pack(is_error := is_error, error_category := error_category, severity := severity)
        )) AS VARCHAR) AS record FROM ({labelled(LINES)})""",
    ),
    "export_labelled": (
        export_labelled,
        f"SELECT 'university-service' AS name, 'production' AS environment, {_LABEL_COLUMNS} FROM ({labelled(LINES)})",
    ),
    "scan_log_files": (scan_log_files, _WITH_BLANKS),
    "scan_label_file": (
        scan_label_file,
        f"SELECT index, template, error_category FROM ({labelled(INDEXED)})",
    ),
    "index_lines": (index_lines, f"SELECT index, source_file, line_no FROM ({INDEXED})"),
    "index_null_sources": (
        index_null_sources,
        """SELECT row_number() OVER (ORDER BY source_file NULLS FIRST, line_no) - 1 AS index, source_file, line_no
        FROM (SELECT CASE WHEN event_id % 3 <> 0 THEN concat('app-', user_id % 3) END AS source_file, event_id AS line_no FROM events)""",
    ),
    "index_lines_small_chunks": (
        index_lines_small_chunks, f"SELECT index, source_file, line_no FROM ({INDEXED})",
    ),
    "index_conversations": (
        index_conversations,
        """SELECT index // 10 AS batch_id, index, source_file, line_no FROM (
        SELECT row_number() OVER (ORDER BY CAST(conv_id AS VARCHAR), turn) - 1 AS index,
         CAST(conv_id AS VARCHAR) AS source_file, turn AS line_no FROM conversations WHERE length(text) > 0)""",
    ),
    "batch_lines": (
        batch_lines,
        f"""SELECT batch_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(to_json(list(struct_pack(index := index, source_file := source_file,
         raw_text := raw_text) ORDER BY index)) AS VARCHAR) AS entries FROM ({batched(100)}) GROUP BY batch_id""",
    ),
    "batch_size_floor": (batch_size_floor, f"SELECT index, index AS batch_id FROM ({INDEXED})"),
    "batch_texts": (batch_texts, texts(100)),
    "lines_per_batch": (
        lines_per_batch, f"SELECT batch_id, count(*) AS n_lines FROM ({batched(100)}) GROUP BY batch_id",
    ),
    "batch_verdicts": (batch_verdicts, verdicts(5)),
    "batch_summaries": (batch_summaries, _SUMMARIES),
    "job_totals": (
        job_totals,
        f"""SELECT count(*) AS n_batches, CAST(sum(n_lines) AS BIGINT) AS n_lines,
        count(*) FILTER (error_found) AS n_error_batches FROM ({verdicts(5)})""",
    ),
    "prompts": (prompts, f"SELECT batch_id, concat({PROMPT}, text) AS prompt FROM ({texts(100)})"),
    "echo_removal": (echo_removal, f"SELECT line_no, concat('reply to ', source_file) AS reply FROM ({LINES})"),
    "parsed_verdicts": (
        parsed_verdicts,
        f"""SELECT reply_id, object, {_TRUTH} AS error_found,
        json_extract_string(obj, '$.error_description') AS error_description,
        json_extract_string(obj, '$.recommended_action') AS recommended_action FROM ({_REPLY_OBJECTS})""",
    ),
    "truth_values": (truth_values, f"SELECT reply_id, {_TRUTH} AS truthy FROM ({_REPLY_OBJECTS})"),
    "triage_rules": (
        triage_rules, _SUMMARIES.replace("CAST(NULL AS VARCHAR) AS model_name", "'keyword-rules' AS model_name"),
    ),
    "triage_generated": (
        triage_generated,
        f"""SELECT batch_id, heap OR error_word AS error_found, 'keyword-generator' AS model_name,
        CASE WHEN heap THEN 'RuntimeError: generator out of memory' END AS error, true AS timed
        FROM (SELECT batch_id, bool_or(contains(u, 'HEAP EXHAUSTED')) AS heap,
         bool_or({any_of(["ERROR", "FATAL", "CRITICAL", "EXCEPTION", "FAILED", "TIMEOUT", "REFUSED"])}) AS error_word
        FROM (SELECT *, upper(raw_text) AS u FROM ({batched(5)})) GROUP BY batch_id)""",
    ),
    "triage_grouped": (triage_grouped, _GENERATED),
    "triage_python": (
        triage_python,
        f"""SELECT batch_id, count(*) FILTER (contains(raw_text, 'refused')) > 0 AS error_found, 'line-analyzer' AS model_name,
        coalesce(string_agg(CAST(index AS VARCHAR), ',' ORDER BY index) FILTER (contains(raw_text, 'refused')), '') AS lines_found
        FROM ({batched(20)}) GROUP BY batch_id""",
    ),
    "jsonl_roundtrip": (jsonl_roundtrip, _SUMMARIES),
    "jsonl_lines": (jsonl_lines, f"SELECT {_SUMMARY_JSON} AS line FROM ({verdicts(5)})"),
    "json_array": (json_array, _ARRAY),
    "json_array_file": (json_array_file, _ARRAY),
    "labelled_json_lines": (
        labelled_json_lines,
        f"""SELECT concat('{{"line_no":', line_no, ',"level":"', level, '","is_error":', is_error, ',"severity":"', severity, '"}}') AS line
        FROM ({labelled(LINES)})""",
    ),
}
