"""Checked queries: label coercion, label files, pairing and classification metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.functions import rules
from logsift.functions.labels import NEGATIVE_WORDS, POSITIVE_WORDS, coerce_labels
from logsift.operators import metrics
from logsift.operators.pairing import pair_by_key, pair_by_position
from logsift.operators.batching import assign_batches
from logsift.operators.indexing import index_ordered
from logsift.plans.evaluation import compare_files, compare_tables
from logsift.sinks.results import append_summaries, metrics_json
from logsift.sources.labelfiles import document_labels, loose_labels, parse_records, read_labels
from logsift.staging import scratch_path, stage
from suite.fixture import LABEL_DOCUMENTS, LABEL_LINES, LABEL_VALUES, LINES, derived, lines, table
from suite.lines import batched, labelled, verdicts

# ---- inputs -----------------------------------------------------------------


def line_pairs(spark, sf):
    """Truth by keyword rule, prediction by level."""
    by_level = ~F.col("level").isin("INFO", "DEBUG", "WARN")
    labelled_lines = rules.label_lines(lines(spark, sf))
    return labelled_lines.select("line_no", F.col("is_error").alias("y_true"), by_level.alias("y_pred"))


def quality_pairs(spark, sf):
    return table(spark, sf, "labels").select(F.col("quality").alias("y_true"), F.col("toxic").alias("y_pred"))


LINE_PAIRS = f"""
SELECT line_no, CAST(is_error AS INTEGER) AS t, CAST(level NOT IN ('INFO', 'DEBUG', 'WARN') AS INTEGER) AS p
FROM ({labelled(LINES)})"""
QUALITY_PAIRS = "SELECT quality AS t, toxic AS p FROM labels"


def counts(pairs: str) -> str:
    return f"""
SELECT CAST(count(*) FILTER (t = 0 AND p = 0) AS DOUBLE) AS tn, CAST(count(*) FILTER (t = 0 AND p = 1) AS DOUBLE) AS fp,
 CAST(count(*) FILTER (t = 1 AND p = 0) AS DOUBLE) AS fn, CAST(count(*) FILTER (t = 1 AND p = 1) AS DOUBLE) AS tp,
 CAST(count(*) AS DOUBLE) AS n FROM ({pairs})"""


# ---- queries ----------------------------------------------------------------


def label_coercion(spark, sf):
    values = derived(spark, sf, LABEL_VALUES).withColumn("as_json", F.try_parse_json("as_json"))
    return coerce_labels(values, "as_flag", "as_int", "as_real", "as_text", "as_json")


def label_coercion_positive_word(spark, sf):
    values = derived(spark, sf, LABEL_VALUES).select("event_id", "as_text")
    return coerce_labels(values, "as_text", positive_label="foo")


def _label_file(spark, sf, suffix):
    path = scratch_path(spark, "labels") + suffix
    derived(spark, sf, LABEL_LINES).orderBy("line_no").select("text").write.text(path)
    return path


def jsonl_label_file(spark, sf):
    labels = read_labels(spark, _label_file(spark, sf, ".jsonl"))
    return labels.select("pos", F.to_json("label").alias("label"))


def text_label_file(spark, sf):
    labels = read_labels(spark, _label_file(spark, sf, ".labels"), key="batch_id")
    return labels.select("pos", F.to_json("label").alias("label"))


def label_fallback_key(spark, sf):
    """``verdict`` where present, else the default key; a present null stays null."""
    text = F.concat(
        F.when(F.col("line_no") % 3 == 0, '{"verdict": null, "error_found": true, "n": ')
        .when(F.col("line_no") % 3 == 1, '{"verdict": "yes", "n": ')
        .otherwise('{"error_found": false, "n": '),
        F.col("line_no").cast("string"),
        F.lit("}"),
    )
    labels = loose_labels(lines(spark, sf).select("line_no", text.alias("text")), "text", key="verdict")
    return labels.select("line_no", F.to_json("label").alias("label"))


def literal_records(spark, sf):
    """Python literals and JSON with repeated keys or NaN, which Spark's parser refuses."""
    flag = F.initcap((F.col("event_type") == "error").cast("string"))
    number = F.col("event_id").cast("string")
    literal = F.concat(F.lit("{'n': "), number, F.lit(", 'flag': "), flag, F.lit(", 'pair': (1, None)}"))
    repeated = F.concat(F.lit('{"n": 0, "pair": NaN, "n": '), number, F.lit(', "flag": null}'))
    text = F.when(F.col("event_id") % 2 == 0, literal).otherwise(repeated)
    events = table(spark, sf, "events").select("event_id", text.alias("text"))
    return parse_records(events, "text").select(
        "event_id",
        F.try_variant_get("record", "$.n", "long").alias("n"),
        F.try_variant_get("record", "$.flag", "boolean").alias("flag"),
        F.schema_of_variant(F.try_variant_get("record", "$.pair", "variant")).startswith("ARRAY").alias("has_pair"),
    )


def label_documents_by_shape(spark, sf):
    labels = document_labels(derived(spark, sf, LABEL_DOCUMENTS), "doc")
    return labels.select("doc_no", F.col("at").alias("pos"), F.to_json("label").alias("label"))


def confusion(spark, sf):
    long = metrics.confusion_long(line_pairs(spark, sf))
    return long.select(F.col("y_true").cast("int"), F.col("y_pred").cast("int"), "n")


def confusion_matrices(spark, sf):
    pairs = quality_pairs(spark, sf)
    in_order = metrics.confusion_matrix(pairs).select(F.lit("0,1").alias("labels"), "confusion_matrix")
    swapped = metrics.confusion_matrix(pairs, [1, 0]).select(F.lit("1,0").alias("labels"), "confusion_matrix")
    wider = metrics.confusion_matrix(pairs, [0, 1, 2]).select(F.lit("0,1,2").alias("labels"), "confusion_matrix")
    union = in_order.unionByName(swapped).unionByName(wider)
    return union.select("labels", F.to_json("confusion_matrix").alias("matrix"))


_SCALARS = [
    "accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "matthews_corrcoef", "zero_one_loss",
    "hamming_loss",
]
_COUNTS = ["true_negative", "false_positive", "false_negative", "true_positive", "total_samples"]


def _flat(record):
    return record.select(
        *[F.round(c, 9).alias(c) for c in _SCALARS],
        *_COUNTS,
        F.col("support.negative").alias("support_negative"),
        F.col("support.positive").alias("support_positive"),
        F.to_json("confusion_matrix").alias("matrix"),
        F.size("classification_report").alias("report_rows"),
    )


def metrics_lines(spark, sf):
    return _flat(metrics.evaluate(line_pairs(spark, sf)))


def metrics_labels(spark, sf):
    return _flat(metrics.evaluate(quality_pairs(spark, sf)))


def metrics_macro(spark, sf):
    return _flat(metrics.evaluate(quality_pairs(spark, sf), average="macro"))


def _rounded(df):
    return df.withColumns({m: F.round(m, 9) for m in metrics.MEASURES})


def metrics_by_class(spark, sf):
    return _rounded(metrics.metrics_by_class(quality_pairs(spark, sf)))


def metrics_averaged(spark, sf):
    return _rounded(metrics.metrics_averaged(quality_pairs(spark, sf)))


def metrics_one_sided(spark, sf):
    """No true positive occurs: class 1 counts in the averages all the same."""
    pairs = lines(spark, sf).select(F.lit(False).alias("y_true"), F.col("raw_text").contains("timeout").alias("y_pred"))
    return _rounded(metrics.metrics_averaged(pairs, zero_division=0.0))


def metrics_absent_class(spark, sf):
    """No line is positive on either side: the averages over classes that occur, and over both."""
    pairs = lines(spark, sf).select(F.lit(False).alias("y_true"), F.col("raw_text").isNull().alias("y_pred"))
    occurring = metrics.metrics_averaged(pairs).withColumn("classes", F.lit("occurring"))
    return _rounded(occurring.unionByName(metrics.fscore_averaged(pairs).withColumn("classes", F.lit("both"))))


def metrics_wider_labels(spark, sf):
    """A label that cannot occur has no support and the value for empty ratios."""
    return _rounded(metrics.metrics_by_class(quality_pairs(spark, sf), labels=[0, 1, 2], zero_division=0.0))


def report_rows(spark, sf):
    return _rounded(metrics.classification_report(line_pairs(spark, sf)))


def report_one_label(spark, sf):
    return _rounded(metrics.classification_report(quality_pairs(spark, sf), labels=[1]))


def metrics_report(spark, sf):
    """The record as one JSON object, read back."""
    report = metrics_json(metrics.evaluate(quality_pairs(spark, sf)))
    read = lambda path: F.get_json_object("report", path)
    return report.select(
        F.round(read("$.accuracy").cast("double"), 9).alias("accuracy"),
        read("$.confusion_matrix").alias("matrix"),
        read("$.support.positive").cast("long").alias("support_positive"),
        read("$.classification_report[2].label").alias("third_row"),
    )


def pairs_by_position(spark, sf):
    """Truth of each line against the level of the line itself, both by dense index."""
    indexed = rules.label_lines(index_ordered(lines(spark, sf)))
    truth = indexed.select(F.col("index").alias("pos"), F.col("is_error").alias("label"))
    guess = indexed.select(F.col("index").alias("pos"), (F.col("severity") == "HIGH").alias("label"))
    return pair_by_position(truth, guess).select("pos", "y_true", "y_pred")


def _batch_labels(spark, sf):
    """Keyword rule against HTTP sign, per batch of five lines."""
    lined = assign_batches(index_ordered(lines(spark, sf)), 5)
    flagged = lined.withColumn("error", rules.error_flag(F.col("raw_text"), F.upper("raw_text")))
    both = flagged.groupBy("batch_id").agg(
        F.bool_or("error").alias("rule"), F.bool_or(F.col("raw_text").contains("HTTP")).alias("http")
    )
    both = stage(both, "labels")
    return tuple(both.select("batch_id", F.col(c).alias("label")) for c in ("rule", "http"))


def pairs_by_key(spark, sf):
    return pair_by_key(*_batch_labels(spark, sf))


def compare_label_tables(spark, sf):
    return _flat(compare_tables(*_batch_labels(spark, sf)))


def compare_label_files(spark, sf):
    """Written as JSON lines in batch order, read back and paired by position."""
    paths = []
    for labels in _batch_labels(spark, sf):
        path = scratch_path(spark, "verdicts") + ".jsonl"
        append_summaries(labels.withColumnRenamed("label", "error_found").orderBy("batch_id"), path)
        paths.append(path)
    return _flat(compare_files(spark, *paths))


def compare_file_with_itself(spark, sf):
    return _flat(compare_files(spark, _label_file(spark, sf, ".jsonl")))


# ---- oracles ----------------------------------------------------------------


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _word_label(column: str, other: str) -> str:
    return f"""CASE WHEN lower(trim({column})) IN ({_quoted(POSITIVE_WORDS)}) THEN 1
 WHEN lower(trim({column})) IN ({_quoted(NEGATIVE_WORDS)}) THEN 0 ELSE {other} END"""


def metrics_row(pairs: str, average: str = "binary") -> str:
    per_class = {
        "precision": ("coalesce(tp / nullif(tp + fp, 0), 0)", "coalesce(tn / nullif(tn + fn, 0), 0)"),
        "recall": ("coalesce(tp / nullif(tp + fn, 0), 0)", "coalesce(tn / nullif(tn + fp, 0), 0)"),
        "f1_score": (
            "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)", "coalesce(2 * tn / nullif(2 * tn + fp + fn, 0), 0)",
        ),
    }
    chosen = {m: one if average == "binary" else f"(({one}) + ({zero})) / 2" for m, (one, zero) in per_class.items()}
    return f"""
SELECT round((tp + tn) / n, 9) AS accuracy,
 round(list_avg(list_filter([tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0)], lambda x: x IS NOT NULL)), 9) AS balanced_accuracy,
 {', '.join(f'round({sql}, 9) AS {m}' for m, sql in chosen.items())},
 round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 9) AS matthews_corrcoef,
 round((fp + fn) / n, 9) AS zero_one_loss, round((fp + fn) / n, 9) AS hamming_loss,
 CAST(tn AS BIGINT) AS true_negative, CAST(fp AS BIGINT) AS false_positive, CAST(fn AS BIGINT) AS false_negative,
 CAST(tp AS BIGINT) AS true_positive, CAST(n AS BIGINT) AS total_samples,
 CAST(tn + fp AS BIGINT) AS support_negative, CAST(fn + tp AS BIGINT) AS support_positive,
 concat('[[', CAST(tn AS BIGINT), ',', CAST(fp AS BIGINT), '],[', CAST(fn AS BIGINT), ',', CAST(tp AS BIGINT), ']]') AS matrix,
 5 AS report_rows FROM ({counts(pairs)})"""


def class_rows(pairs: str) -> str:
    return f"""
SELECT c.label, coalesce(hit / nullif(pred, 0), 0) AS precision, coalesce(hit / nullif(tru, 0), 0) AS recall,
 coalesce(2 * hit / nullif(pred + tru, 0), 0) AS f1_score, CAST(tru AS BIGINT) AS support, hit, pred, tru
FROM (SELECT k AS label, CAST(count(*) FILTER (t = k AND p = k) AS DOUBLE) AS hit,
  CAST(count(*) FILTER (p = k) AS DOUBLE) AS pred, CAST(count(*) FILTER (t = k) AS DOUBLE) AS tru
  FROM ({pairs}), (SELECT unnest([0, 1]) AS k) GROUP BY k) c"""


_M = ["precision", "recall", "f1_score"]
_ROUND = ", ".join(f"round({m}, 9) AS {m}" for m in _M)


def report(pairs: str) -> str:
    macro = ", ".join(f"round(avg({m}), 9) AS {m}" for m in _M)
    weighted = ", ".join(f"round(sum({m} * tru) / sum(tru), 9) AS {m}" for m in _M)
    return f"""
WITH c AS ({class_rows(pairs)})
SELECT CAST(label AS VARCHAR) AS label, {_ROUND}, support FROM c
UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hit) / sum(tru), 9), CAST(sum(support) AS BIGINT) FROM c
UNION ALL SELECT 'macro avg', {macro}, CAST(sum(support) AS BIGINT) FROM c
UNION ALL SELECT 'weighted avg', {weighted}, CAST(sum(support) AS BIGINT) FROM c"""


_AVERAGES = f"""
WITH c AS ({class_rows(QUALITY_PAIRS)})
SELECT 'binary' AS average, {_ROUND} FROM c WHERE label = 1
UNION ALL SELECT 'micro', {', '.join(f'round(sum(hit) / sum(tru), 9) AS {m}' for m in _M)} FROM c
UNION ALL SELECT 'macro', {', '.join(f'round(avg({m}), 9) AS {m}' for m in _M)} FROM c
UNION ALL SELECT 'weighted', {', '.join(f'round(sum({m} * tru) / sum(tru), 9) AS {m}' for m in _M)} FROM c"""

_ONE_LABEL = f"""
WITH c AS (SELECT * FROM ({class_rows(QUALITY_PAIRS)}) WHERE label = 1)
SELECT CAST(label AS VARCHAR) AS label, {_ROUND}, support FROM c
UNION ALL SELECT 'micro avg', {_ROUND}, support FROM c
UNION ALL SELECT 'macro avg', {_ROUND}, support FROM c
UNION ALL SELECT 'weighted avg', {_ROUND}, support FROM c"""

_BATCH_PAIRS = f"""
SELECT batch_id, CAST(error_found AS INTEGER) AS t, CAST(http AS INTEGER) AS p FROM ({verdicts(5)})
JOIN (SELECT batch_id, bool_or(contains(raw_text, 'HTTP')) AS http FROM ({batched(5)}) GROUP BY batch_id) USING (batch_id)"""

_FILE_LABELS = """SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos, event_id,
 CASE event_id % 8 WHEN 4 THEN NULL WHEN 6 THEN 'null' ELSE CAST(event_type = 'error' AS VARCHAR) END AS label
FROM events WHERE event_id % 8 >= 4"""

_DOCUMENT_LABELS = f"""
SELECT doc_no, CAST(unnest(range(len(items))) AS INTEGER) AS pos, CAST(unnest(items) AS VARCHAR) AS label FROM (
 SELECT doc_no, CASE
  WHEN json_exists(doc, '$.error_found') THEN json_extract(doc, '$.error_found[*]')
  WHEN json_type(doc, '$.results') = 'ARRAY' THEN
   list_transform(json_extract(doc, '$.results[*]'), lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN json_extract(x, '$.error_found') ELSE x END)
  WHEN json_type(doc) = 'ARRAY' AND len(list_filter(json_extract(doc, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0 THEN
   list_transform(json_extract(doc, '$[*]'), lambda x: json_extract(x, '$.error_found'))
  WHEN json_type(doc) = 'ARRAY' THEN json_extract(doc, '$[*]') END AS items
 FROM ({LABEL_DOCUMENTS}))"""

CASES = {
    "label_coercion": (
        label_coercion,
        f"""SELECT event_id, CAST(as_flag AS INTEGER) AS as_flag, CAST(as_int = 1 AS INTEGER) AS as_int,
        CAST(as_real = 1.0 AS INTEGER) AS as_real, {_word_label('as_text', '0')} AS as_text,
        CASE json_type(as_json) WHEN 'BOOLEAN' THEN CAST(as_json = 'true' AS INTEGER)
         WHEN 'VARCHAR' THEN {_word_label("json_extract_string(as_json, '$')", '0')}
         WHEN 'UBIGINT' THEN CAST(as_json = '1' AS INTEGER) WHEN 'DOUBLE' THEN CAST(as_json = '1.0' AS INTEGER)
         ELSE 0 END AS as_json FROM ({LABEL_VALUES})""",
    ),
    "label_coercion_positive_word": (
        label_coercion_positive_word,
        f"""SELECT event_id, coalesce({_word_label('as_text', "CAST(as_text = 'foo' AS INTEGER)")}, 0) AS as_text
        FROM ({LABEL_VALUES})""",
    ),
    "jsonl_label_file": (jsonl_label_file, f"SELECT pos, label FROM ({_FILE_LABELS})"),
    "text_label_file": (
        text_label_file,
        """SELECT row_number() OVER (ORDER BY event_id) - 1 AS pos,
        CASE WHEN event_id % 8 = 2 THEN '[1,2]' ELSE CAST(event_id AS VARCHAR) END AS label
        FROM events WHERE event_id % 8 IN (2, 4, 5, 6, 7)""",
    ),
    "label_fallback_key": (
        label_fallback_key,
        """SELECT event_id AS line_no, CASE event_id % 3 WHEN 0 THEN 'null' WHEN 1 THEN '"yes"' ELSE 'false' END AS label
        FROM events""",
    ),
    "literal_records": (
        literal_records,
        """SELECT event_id, event_id AS n, CASE WHEN event_id % 2 = 0 THEN event_type = 'error' END AS flag,
        event_id % 2 = 0 AS has_pair FROM events""",
    ),
    "label_documents_by_shape": (label_documents_by_shape, _DOCUMENT_LABELS),
    "confusion": (
        confusion, f"SELECT t AS y_true, p AS y_pred, count(*) AS n FROM ({LINE_PAIRS}) GROUP BY t, p",
    ),
    "confusion_matrices": (
        confusion_matrices,
        f"""WITH c AS (SELECT CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tp AS BIGINT) AS tp
         FROM ({counts(QUALITY_PAIRS)}))
        SELECT '0,1' AS labels, concat('[[', tn, ',', fp, '],[', fn, ',', tp, ']]') AS matrix FROM c
        UNION ALL SELECT '1,0', concat('[[', tp, ',', fn, '],[', fp, ',', tn, ']]') FROM c
        UNION ALL SELECT '0,1,2', concat('[[', tn, ',', fp, ',0],[', fn, ',', tp, ',0],[0,0,0]]') FROM c""",
    ),
    "metrics_lines": (metrics_lines, metrics_row(LINE_PAIRS)),
    "metrics_labels": (metrics_labels, metrics_row(QUALITY_PAIRS)),
    "metrics_macro": (metrics_macro, metrics_row(QUALITY_PAIRS, "macro")),
    "metrics_by_class": (
        metrics_by_class, f"SELECT label, {_ROUND}, support FROM ({class_rows(QUALITY_PAIRS)})",
    ),
    "metrics_averaged": (metrics_averaged, _AVERAGES),
    "metrics_one_sided": (
        metrics_one_sided,
        f"""WITH c AS (SELECT count(*) AS n, count_if(raw_text NOT LIKE '%timeout%') AS tn FROM ({LINES}))
        SELECT 'binary' AS average, CAST(0 AS DOUBLE) AS precision, CAST(0 AS DOUBLE) AS recall, CAST(0 AS DOUBLE) AS f1_score
        UNION ALL SELECT 'micro', round(tn / n, 9), round(tn / n, 9), round(tn / n, 9) FROM c
        UNION ALL SELECT 'macro', 0.5, round(tn / n / 2, 9), round(2 * tn / (n + tn) / 2, 9) FROM c
        UNION ALL SELECT 'weighted', 1.0, round(tn / n, 9), round(2 * tn / (n + tn), 9) FROM c""",
    ),
    "metrics_absent_class": (
        metrics_absent_class,
        f"""WITH c AS (SELECT count(*) / count(raw_text) AS share FROM ({LINES})),
        classes AS (SELECT unnest([{{'classes': 'occurring', 'present': 1}}, {{'classes': 'both', 'present': 2}}], recursive := true))
        SELECT average, classes, CASE average WHEN 'binary' THEN 0.0 WHEN 'macro' THEN share / present ELSE share END AS precision,
         precision AS recall, precision AS f1_score FROM c, classes, unnest(['binary', 'micro', 'macro', 'weighted']) AS t(average)""",
    ),
    "metrics_wider_labels": (
        metrics_wider_labels,
        f"""SELECT label, precision, recall, f1_score, support FROM (SELECT label, {_ROUND}, support FROM ({class_rows(QUALITY_PAIRS)}))
        UNION ALL SELECT 2, 0.0, 0.0, 0.0, 0""",
    ),
    "report_rows": (report_rows, report(LINE_PAIRS)),
    "report_one_label": (report_one_label, _ONE_LABEL),
    "metrics_report": (
        metrics_report,
        f"""SELECT accuracy, matrix, support_positive, 'accuracy' AS third_row FROM ({metrics_row(QUALITY_PAIRS)})""",
    ),
    "pairs_by_position": (
        pairs_by_position,
        f"""SELECT row_number() OVER (ORDER BY source_file, line_no) - 1 AS pos, is_error AS y_true, severity = 'HIGH' AS y_pred
        FROM ({labelled(LINES)})""",
    ),
    "pairs_by_key": (
        pairs_by_key, f"SELECT batch_id, CAST(t AS BOOLEAN) AS y_true, CAST(p AS BOOLEAN) AS y_pred FROM ({_BATCH_PAIRS})",
    ),
    "compare_label_tables": (compare_label_tables, metrics_row(_BATCH_PAIRS)),
    "compare_label_files": (compare_label_files, metrics_row(_BATCH_PAIRS)),
    "compare_file_with_itself": (
        compare_file_with_itself,
        metrics_row(f"SELECT CAST(label = 'true' AND label IS NOT NULL AS INTEGER) AS t, t AS p FROM ({_FILE_LABELS})"),
    ),
}
