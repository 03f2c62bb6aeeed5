"""Checked queries: similarity, nearest neighbours, leaders, the vector store and reuse of verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from logsift.functions.vectors import cosine, norm, unit
from logsift.operators.batching import batch_text
from logsift.operators.classify import python_classifier
from logsift.operators.embed import encoder_embedding, hashed_embedding
from logsift.operators.indexing import index_ordered
from logsift.operators.leaders import follow, select_leaders
from logsift.operators.similarity import search, search_batch, top_matches
from logsift.plans.triage import (
    ReuseOptions,
    batches_of,
    embed_batches,
    lookup,
    triage_and_store,
    triage_with_reuse,
)
from logsift.plans.timing import StageTimings
from logsift.schemas import STORE
from logsift.sources.store import VectorStore
from logsift.staging import scratch_path, stage
from suite.fixture import LINES, lines, table
from suite.lines import texts

# The supplied vectors have no pair at the default threshold.
THRESHOLD = 0.3
KEYWORDS = ["handled", "timeout", "postgres", "sshd", "kafka", "heap", "HTTP", "crashed", "upstream"]
LINE_THRESHOLD = 0.93
LINE_BATCH = 10

# ---- inputs -----------------------------------------------------------------


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def rotated(vector):
    return F.concat(F.slice(vector, 2, F.size(vector) - 1), F.slice(vector, 1, 1))


def ordered(spark, sf):
    return vectors(spark, sf).select(F.col("vec_id").alias("ord"), F.col("embedding").alias("vec"))


def store_rows(spark, sf):
    """A store of all vectors, turned by one place, with a verdict from the label."""
    return vectors(spark, sf).select(
        (F.col("vec_id") + 1).alias("id"),
        rotated(F.col("embedding")).alias("vector"),
        F.concat(F.lit("stored "), F.col("vec_id")).alias("raw_text"),
        (F.col("label") % 2 == 1).alias("is_error"),
        F.concat(F.lit("model-"), F.col("label")).alias("model_name"),
        F.lit("table").alias("embedder_model_name"),
    )


def vector_batches(spark, sf):
    """Every vector as a batch of one line."""
    word = F.when(F.col("label") % 3 == 0, F.lit("ERROR ")).otherwise(F.lit("INFO "))
    entry = F.struct(
        F.col("vec_id").alias("index"), F.lit("vectors").alias("source_file"),
        F.concat(word, F.col("vec_id").cast("string")).alias("raw_text"),
    )
    batches = vectors(spark, sf).select(
        F.col("vec_id").alias("batch_id"), F.array(entry).alias("entries"), F.col("embedding").alias("vec")
    )
    return batches.withColumn("text", batch_text(F.col("entries")))


def keyword_vector(df, text):
    """An encoder of plain columns: how often each keyword occurs."""
    gone = lambda w: F.length(text) - F.length(F.replace(F.col(text), F.lit(w), F.lit("")))
    return df.withColumn("vec", F.array(*[(gone(w) / len(w)).cast("double") for w in KEYWORDS]))


def line_batches(spark, sf):
    return embed_batches(batches_of(index_ordered(lines(spark, sf)), LINE_BATCH), keyword_vector)


# ---- queries ----------------------------------------------------------------


def unit_vectors(spark, sf):
    scaled = unit(F.transform("embedding", lambda x: x * 3))
    values = vectors(spark, sf).select("vec_id", F.posexplode(scaled).alias("place", "x"))
    return values.select("vec_id", "place", (F.round("x", 5) + 0.0).alias("x"))  # no negative zero


def cosine_of_columns(spark, sf):
    e = F.col("embedding")
    return vectors(spark, sf).select(
        "vec_id", F.round(cosine(e, rotated(e)), 5).alias("sim"), F.round(norm(e), 5).alias("norm")
    )


def knn(spark, sf):
    v = vectors(spark, sf)
    queries = v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    found = top_matches(queries, v.select(F.col("vec_id").alias("sid"), F.col("embedding").alias("svec")), k=3)
    return found.select("qid", "rank", "sid", F.round("sim", 6).alias("sim"))


def knn_with_broken_vectors(spark, sf):
    """Every tenth stored vector holds a NaN: it is not found, and hides no other."""
    v = vectors(spark, sf)
    broken = F.concat(F.array(F.lit(float("nan")).cast("float")), F.slice("embedding", 2, F.size("embedding") - 1))
    stored = v.select(F.col("vec_id").alias("sid"), F.when(F.col("vec_id") % 10 == 0, broken).otherwise(F.col("embedding")).alias("svec"))
    found = top_matches(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), stored, k=3)
    return found.select("qid", "rank", "sid", F.round("sim", 6).alias("sim"))


def knn_threshold(spark, sf):
    """All pairs of cells that can reach the threshold, several blocks and pivots."""
    v = vectors(spark, sf)
    queries = v.select(F.col("vec_id").alias("qid"), rotated(F.col("embedding")).alias("qvec"))
    stored = v.select(F.col("vec_id").alias("sid"), F.col("embedding").alias("svec"))
    found = top_matches(queries, stored, k=2, threshold=THRESHOLD, block_rows=128, pivots=8)
    return found.select("qid", "rank", "sid", F.round("sim", 6).alias("sim"))


def search_hits(spark, sf):
    queries = vectors(spark, sf).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    found = search_batch(queries, store_rows(spark, sf), k=2)
    hits = found.select("qid", F.posexplode("hits").alias("place", "hit"))
    return hits.select(
        "qid", "place", "hit.id", F.round("hit.distance", 6).alias("distance"), "hit.entity.*"
    )


def search_empty_store(spark, sf):
    queries = vectors(spark, sf).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    found = search_batch(queries, spark.createDataFrame([], STORE))
    return found.select("qid", F.size("hits").alias("n_hits"))


def search_one(spark, sf):
    probe = [float((i * 7) % 5 - 2) for i in range(64)]
    hits = search(probe, store_rows(spark, sf), k=5)
    return hits.select("rank", "id", F.round("distance", 6).alias("distance"), "entity.is_error", "entity.model_name")


def stored_lookup(spark, sf):
    batches = vector_batches(spark, sf).select("batch_id", "vec")
    found = lookup(batches, store_rows(spark, sf), THRESHOLD)
    return found.withColumn("sim", F.round("sim", 6))


def leaders(spark, sf):
    return select_leaders(ordered(spark, sf), THRESHOLD).select("ord")


def leaders_in_rounds(spark, sf):
    """Small heads and blocks, so that the distributed rounds decide most rows."""
    chosen = select_leaders(ordered(spark, sf), THRESHOLD, head_rows=150, block_rows=250, pivots=4)
    return chosen.select("ord")


def followers(spark, sf):
    rows = ordered(spark, sf)
    chosen = stage(select_leaders(rows, THRESHOLD), "leaders")
    found = follow(rows.join(chosen.select("ord"), "ord", "left_anti"), chosen, THRESHOLD)
    return found.select("ord", "leader", F.round("sim", 6).alias("sim"))


_VERDICT = ["batch_id", "error_found", "model_name", "embedder_model_name", "origin", "matched_id"]


def reuse_with_store(spark, sf):
    result = triage_with_reuse(
        vector_batches(spark, sf), store_rows(spark, sf), options=ReuseOptions(THRESHOLD, "table-encoder")
    )
    return result.verdicts.select(*_VERDICT, F.round("similarity", 6).alias("similarity"))


def reuse_new_rows(spark, sf):
    """What the store gains, with ids that follow on."""
    store = VectorStore(spark, scratch_path(spark, "store"))
    store.create_if_missing()
    store.insert(store_rows(spark, sf), order="id")
    triage_and_store(vector_batches(spark, sf), store, options=ReuseOptions(THRESHOLD, "table-encoder"))
    return store.read().select("id", "raw_text", "is_error", "model_name", "embedder_model_name")


def reuse_long_batches(spark, sf):
    """Batches of more than 65,535 bytes are classified and stored like any other."""
    text = F.repeat("text", (F.lit(70000) / F.length("text")).cast("int") + 1)
    docs = table(spark, sf, "documents").where("length(text) > 0")
    entry = F.struct(F.col("doc_id").alias("index"), F.col("source").alias("source_file"), text.alias("raw_text"))
    batches = docs.select(F.col("doc_id").alias("batch_id"), F.array(entry).alias("entries"), F.array(F.lit(1.0), F.col("doc_id").cast("double")).alias("vec"))
    store = VectorStore(spark, scratch_path(spark, "store"))
    # No similarity reaches this threshold.
    verdicts = triage_and_store(batches, store, options=ReuseOptions(1.5, "none"), clear_store=True)
    number = F.regexp_extract("raw_text", r"^\[(\d+)\]", 1).cast("long")
    kept = store.read().select(number.alias("batch_id"), F.octet_length("raw_text").alias("stored_bytes"))
    return verdicts.select("batch_id", "origin", "error_found").join(kept, "batch_id", "left")


def reuse_lines(spark, sf):
    """Log lines end to end: batches, vectors, leaders, verdicts."""
    store = VectorStore(spark, scratch_path(spark, "store"))
    options = ReuseOptions(LINE_THRESHOLD, "keyword-counts")
    result = triage_and_store(line_batches(spark, sf), store, options=options, clear_store=True)
    return result.select(*_VERDICT, F.round("similarity", 6).alias("similarity"))


def failing_analyzer():
    def analyze(batch_id: int, entries: list[dict]) -> bool:
        if any("heap" in e["raw_text"] for e in entries):
            raise ValueError("cannot judge")
        return any("ERROR" in e["raw_text"] for e in entries)

    return analyze


def reuse_lines_failures(spark, sf):
    """A batch whose classification fails is reported and never stored."""
    batches = line_batches(spark, sf)
    classifier = python_classifier(failing_analyzer, "picky")
    options = ReuseOptions(LINE_THRESHOLD, "keyword-counts")
    empty = spark.createDataFrame([], STORE)
    result = triage_with_reuse(batches, empty, classifier, options)
    return result.verdicts.select(*_VERDICT, "error")


def store_insert(spark, sf):
    """Two inserts into a new store; empty names become null."""
    store = VectorStore(spark, scratch_path(spark, "store")).create_if_missing()
    rows = vectors(spark, sf).select(
        F.col("vec_id").alias("batch_id"), F.col("embedding").alias("vector"),
        F.concat(F.lit("text "), F.col("vec_id")).alias("raw_text"), (F.col("label") % 2 == 0).alias("is_error"),
        F.when(F.col("label") % 3 == 0, "").otherwise(F.col("label").cast("string")).alias("model_name"),
        F.lit("").alias("embedder_model_name"),
    )
    store.insert(rows)
    store.insert(rows.withColumn("model_name", F.lit("second")))
    return store.read().select(
        "id", F.size("vector").alias("dim"), F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"),
        "raw_text", "is_error", "model_name", "embedder_model_name",
    )


def store_insert_committed(spark, sf):
    """An insert that fails in one of its tasks leaves nothing behind, and the next one takes its ids."""
    store = VectorStore(spark, scratch_path(spark, "store")).create_if_missing()
    rows = store_rows(spark, sf).withColumn("batch_id", F.col("id"))
    store.insert(rows.withColumn("model_name", F.lit("first")))
    late = F.when(F.col("id") % 7 == 3, F.raise_error(F.lit("broken row")).cast("string")).otherwise("lost")
    try:
        store.insert(rows.withColumn("model_name", late))
    except Exception as error:  # noqa: BLE001 - the failure is part of the query
        if "broken row" not in str(error):
            raise
    store.insert(rows.withColumn("model_name", F.lit("second")))
    return store.read().select("id", F.round(F.element_at("vector", 1).cast("double"), 5).alias("first"), "model_name")


def stage_timings(spark, sf):
    """Rows and time of an embedding and a classification, counted while they are written."""
    timings = StageTimings()
    batches = batches_of(index_ordered(lines(spark, sf).withColumn("source_file", F.lit("events")), "source_file", "line_no"), 50)
    embedded = embed_batches(batches, lambda df, text: encoder_embedding(df, text, length_encoder, elapsed="embed_ms"))
    embedded = stage(timings.watch(embedded, "embed", "embed_ms"), "embedded")
    found = python_classifier(lambda: lambda batch_id, entries: len(entries) > 1)(embedded)
    stage(timings.watch(found, "classify", "elapsed_ms"), "classified")
    sound = (F.col("slowest_ms") > 0) & (F.col("slowest_ms") <= F.col("total_ms") * 1.000001)
    per_row = embedded.agg(F.sum("embed_ms").alias("ms")).first()["ms"]
    total = F.when(F.col("stage") == "embed", F.abs(F.col("total_ms") - per_row) < 0.001).otherwise(True)
    return timings.table(spark).select("stage", "n_rows", (sound & total).alias("timed"))


def store_clear(spark, sf):
    """Rows before and after clearing."""
    store = VectorStore(spark, scratch_path(spark, "store")).create_if_missing()
    store.insert(store_rows(spark, sf), order="id")
    before = store.read().count()
    store.clear()
    return store.read().agg(F.lit(before).cast("long").alias("before"), F.count(F.lit(1)).alias("after"))


def hashed_embeddings(spark, sf):
    """Unit length and full dimension for every line; the values are Spark's own hashing."""
    embedded = hashed_embedding(lines(spark, sf), "raw_text")
    return embedded.select("line_no", F.size("vec").alias("dim"), F.round(norm(F.col("vec")), 5).alias("norm"))


def length_encoder():
    import numpy as np

    return lambda batch: np.array([[len(t), t.count(" ") + 1.0, t.count("e") + 1.0] for t in batch])


def encoded_lines(spark, sf):
    embedded = encoder_embedding(lines(spark, sf), "raw_text", length_encoder)
    return embedded.select("line_no", F.posexplode("vec").alias("place", "x")).select(
        "line_no", "place", F.round(F.col("x").cast("double"), 4).alias("x")
    )


# ---- oracles ----------------------------------------------------------------

_ROT = "list_concat(embedding[2:], embedding[1:1])"
_V = "SELECT vec_id AS ord, CAST(embedding AS DOUBLE[]) AS e FROM embeddings"
_STORED = f"SELECT vec_id + 1 AS id, CAST({_ROT} AS DOUBLE[]) AS e FROM embeddings"
_SIM = "round(list_cosine_similarity(a.e, b.e), 12)"


def top_sql(queries: str, store: str, k: int, threshold: float = -2.0) -> str:
    """``queries`` has ord and e, ``store`` has id and e."""
    return f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY sim DESC, id) AS rank
 FROM (SELECT a.ord, b.id, {_SIM} AS sim FROM ({queries}) a, ({store}) b) WHERE sim >= {threshold}) WHERE rank <= {k}"""


def leaders_sql(rows: str, threshold: float) -> str:
    """CTEs ending in ``leader(ord, e)`` over ``rows`` with ord and e; opens with WITH RECURSIVE."""
    return f"""
WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY ord) - 1 AS i, ord, e FROM ({rows})),
g AS MATERIALIZED (SELECT a.i, list(b.i) AS nb FROM v a JOIN v b ON b.i < a.i AND {_SIM} >= {threshold} GROUP BY a.i),
n AS MATERIALIZED (SELECT v.i, coalesce(g.nb, CAST([] AS BIGINT[])) AS nb FROM v LEFT JOIN g USING (i)),
r(i, ls) AS (
  SELECT CAST(0 AS BIGINT), CAST([0] AS BIGINT[])
  UNION ALL
  SELECT n.i, CASE WHEN list_has_any(r.ls, n.nb) THEN r.ls ELSE list_append(r.ls, n.i) END
  FROM r JOIN n ON n.i = r.i + 1),
leader AS MATERIALIZED (
  SELECT v.ord, v.e FROM (SELECT unnest(ls) AS i FROM (SELECT ls FROM r ORDER BY i DESC LIMIT 1)) JOIN v USING (i))"""


def reuse_sql(rows: str, stored: str, threshold: float, embedder: str) -> str:
    """``rows``: ord, e, own (verdict); ``stored``: id, e, is_error, model_name, embedder_model_name."""
    missed = f"""SELECT ord, e FROM ({rows}) WHERE ord NOT IN
 (SELECT a.ord FROM ({rows}) a, ({stored}) b WHERE {_SIM} >= {threshold})"""
    return f"""{leaders_sql(missed, threshold)},
rows AS MATERIALIZED ({rows}), stored AS MATERIALIZED ({stored}),
hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY sim DESC, kind, id) AS rank FROM (
   SELECT a.ord, 0 AS kind, b.id, {_SIM} AS sim FROM rows a, stored b
   UNION ALL
   SELECT a.ord, 1 AS kind, b.ord AS id, {_SIM} AS sim FROM rows a JOIN leader b ON b.ord < a.ord)
  WHERE sim >= {threshold} AND ord NOT IN (SELECT ord FROM leader)) WHERE rank = 1)
SELECT rows.ord AS batch_id,
 CASE WHEN hit.kind = 0 THEN stored.is_error WHEN hit.kind = 1 THEN other.own ELSE rows.own END AS error_found,
 CASE WHEN hit.kind = 0 THEN stored.model_name ELSE 'keyword-rules' END AS model_name,
 CASE WHEN hit.kind = 0 THEN stored.embedder_model_name ELSE '{embedder}' END AS embedder_model_name,
 CASE hit.kind WHEN 0 THEN 'stored' WHEN 1 THEN 'run' ELSE 'classified' END AS origin,
 hit.id AS matched_id, round(hit.sim, 6) AS similarity
FROM rows LEFT JOIN hit ON hit.ord = rows.ord LEFT JOIN stored ON hit.kind = 0 AND stored.id = hit.id
LEFT JOIN rows AS other ON hit.kind = 1 AND other.ord = hit.id"""


_STORE_SQL = f"""
SELECT vec_id + 1 AS id, CAST({_ROT} AS DOUBLE[]) AS e, concat('stored ', vec_id) AS raw_text, label % 2 = 1 AS is_error,
 concat('model-', label) AS model_name, 'table' AS embedder_model_name FROM embeddings"""
_BATCH_ROWS = "SELECT vec_id AS ord, CAST(embedding AS DOUBLE[]) AS e, label % 3 = 0 AS own FROM embeddings"
_NO_STORE = """SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE[]) AS e, CAST(NULL AS BOOLEAN) AS is_error,
 CAST(NULL AS VARCHAR) AS model_name, CAST(NULL AS VARCHAR) AS embedder_model_name WHERE false"""
_KEYWORD_VECTOR = "CAST([" + ", ".join(
    f"(length(text) - length(replace(text, '{w}', ''))) / {len(w)}" for w in KEYWORDS
) + "] AS DOUBLE[])"
_LINE_ROWS = f"""SELECT batch_id AS ord, {_KEYWORD_VECTOR} AS e,
 regexp_matches(upper(text), 'ERROR|FATAL|CRITICAL|EXCEPTION|FAILED|TIMEOUT|REFUSED')
  OR contains(text, ' 500 ') OR regexp_matches(text, 'HTTP/[^\\n]{{3}}" 5\\d\\d') AS own FROM ({texts(LINE_BATCH)})"""
_PICKY_ROWS = f"""SELECT batch_id AS ord, {_KEYWORD_VECTOR} AS e, contains(text, 'ERROR') AS own,
 contains(text, 'heap') AS fails FROM ({texts(LINE_BATCH)})"""

CASES = {
    "unit_vectors": (
        unit_vectors,
        """SELECT vec_id, CAST(unnest(range(len(e))) AS INTEGER) AS place,
        round(unnest(list_transform(e, lambda x: x / n)), 5) + 0.0::DOUBLE AS x FROM (
        SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings))""",
    ),
    "cosine_of_columns": (
        cosine_of_columns,
        f"""SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_ROT} AS DOUBLE[])), 5) AS sim,
        round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 5) AS norm FROM embeddings""",
    ),
    "knn": (
        knn,
        f"""SELECT ord AS qid, CAST(rank AS INTEGER) AS rank, id AS sid, round(sim, 6) AS sim
        FROM ({top_sql(_V, _V.replace('AS ord', 'AS id'), 3)})""",
    ),
    "knn_with_broken_vectors": (
        knn_with_broken_vectors,
        f"""SELECT ord AS qid, CAST(rank AS INTEGER) AS rank, id AS sid, round(sim, 6) AS sim
        FROM ({top_sql(_V, _V.replace('AS ord', 'AS id') + ' WHERE vec_id % 10 <> 0', 3)})""",
    ),
    "knn_threshold": (
        knn_threshold,
        f"""SELECT ord AS qid, CAST(rank AS INTEGER) AS rank, id AS sid, round(sim, 6) AS sim
        FROM ({top_sql(_STORED.replace('vec_id + 1 AS id', 'vec_id AS ord'), _V.replace('AS ord', 'AS id'), 2, THRESHOLD)})""",
    ),
    "search_hits": (
        search_hits,
        f"""SELECT ord AS qid, CAST(rank - 1 AS INTEGER) AS place, id, round(sim, 6) AS distance, raw_text, is_error, model_name,
        embedder_model_name FROM ({top_sql(_V, _STORED, 2)}) JOIN ({_STORE_SQL}) USING (id)""",
    ),
    "search_empty_store": (search_empty_store, "SELECT vec_id AS qid, 0 AS n_hits FROM embeddings"),
    "search_one": (
        search_one,
        f"""SELECT CAST(rank AS INTEGER) AS rank, id, round(sim, 6) AS distance, is_error, model_name
        FROM ({top_sql("SELECT 0 AS ord, list_transform(range(64), lambda i: CAST((i * 7) % 5 - 2 AS DOUBLE)) AS e", _STORED, 5)})
        JOIN ({_STORE_SQL}) USING (id)""",
    ),
    "stored_lookup": (
        stored_lookup,
        f"""SELECT vec_id AS batch_id, id, round(sim, 6) AS sim, is_error, model_name, embedder_model_name
        FROM embeddings LEFT JOIN (SELECT * FROM ({top_sql(_V, _STORED, 1, THRESHOLD)}) JOIN ({_STORE_SQL}) USING (id)) ON ord = vec_id""",
    ),
    "leaders": (leaders, f"{leaders_sql(_V, THRESHOLD)} SELECT ord FROM leader"),
    "leaders_in_rounds": (leaders_in_rounds, f"{leaders_sql(_V, THRESHOLD)} SELECT ord FROM leader"),
    "followers": (
        followers,
        f"""{leaders_sql(_V, THRESHOLD)} SELECT ord, id AS leader, round(sim, 6) AS sim FROM (
        SELECT *, row_number() OVER (PARTITION BY ord ORDER BY sim DESC, id) AS rank FROM (
         SELECT a.ord, b.ord AS id, {_SIM} AS sim FROM v a JOIN leader b ON b.ord < a.ord)
        WHERE sim >= {THRESHOLD} AND ord NOT IN (SELECT ord FROM leader)) WHERE rank = 1""",
    ),
    "reuse_with_store": (reuse_with_store, reuse_sql(_BATCH_ROWS, _STORE_SQL, THRESHOLD, "table-encoder")),
    "reuse_new_rows": (
        reuse_new_rows,
        f"""SELECT id, raw_text, is_error, model_name, embedder_model_name FROM ({_STORE_SQL})
        UNION ALL SELECT (SELECT max(vec_id) + 1 FROM embeddings) + row_number() OVER (ORDER BY batch_id),
         concat('[', batch_id, '] ', CASE WHEN error_found THEN 'ERROR ' ELSE 'INFO ' END, batch_id),
         error_found, model_name, embedder_model_name
        FROM ({reuse_sql(_BATCH_ROWS, _STORE_SQL, THRESHOLD, 'table-encoder')}) WHERE origin = 'classified'""",
    ),
    "reuse_long_batches": (
        reuse_long_batches,
        """WITH b AS (SELECT doc_id, concat('[', doc_id, '] ', repeat(text, CAST(floor(70000 / length(text)) AS INTEGER) + 1)) AS t
         FROM documents WHERE length(text) > 0)
        SELECT doc_id AS batch_id, 'classified' AS origin, regexp_matches(upper(t), 'ERROR|FATAL|CRITICAL|EXCEPTION|FAILED|TIMEOUT|REFUSED')
         OR contains(t, ' 500 ') OR regexp_matches(t, 'HTTP/[^\\n]{3}" 5\\d\\d') AS error_found, CAST(strlen(t) AS INTEGER) AS stored_bytes FROM b""",
    ),
    "reuse_lines": (reuse_lines, reuse_sql(_LINE_ROWS, _NO_STORE, LINE_THRESHOLD, "keyword-counts")),
    "reuse_lines_failures": (
        reuse_lines_failures,
        f"""{leaders_sql(f"SELECT ord, e FROM ({_PICKY_ROWS}) WHERE NOT fails", LINE_THRESHOLD)},
        rows AS MATERIALIZED ({_PICKY_ROWS}),
        hit AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ord ORDER BY sim DESC, id) AS rank FROM (
          SELECT a.ord, b.ord AS id, {_SIM} AS sim FROM rows a JOIN leader b ON b.ord < a.ord)
         WHERE sim >= {LINE_THRESHOLD} AND ord NOT IN (SELECT ord FROM leader)) WHERE rank = 1)
        SELECT rows.ord AS batch_id, CASE WHEN hit.id IS NOT NULL THEN other.own WHEN rows.fails THEN true ELSE rows.own END AS error_found,
         'picky' AS model_name, 'keyword-counts' AS embedder_model_name,
         CASE WHEN hit.id IS NOT NULL THEN 'run' WHEN rows.fails THEN 'failed' ELSE 'classified' END AS origin,
         hit.id AS matched_id, CASE WHEN hit.id IS NULL AND rows.fails THEN 'ValueError: cannot judge' END AS error
        FROM rows LEFT JOIN hit ON hit.ord = rows.ord LEFT JOIN rows AS other ON other.ord = hit.id""",
    ),
    "store_insert": (
        store_insert,
        """SELECT row_number() OVER (ORDER BY run, vec_id) AS id, CAST(len(embedding) AS INTEGER) AS dim,
        round(CAST(embedding[1] AS DOUBLE), 5) AS first, concat('text ', vec_id) AS raw_text, label % 2 = 0 AS is_error,
        CASE WHEN run = 1 THEN 'second' WHEN label % 3 <> 0 THEN CAST(label AS VARCHAR) END AS model_name,
        CAST(NULL AS VARCHAR) AS embedder_model_name FROM embeddings, (SELECT unnest([0, 1]) AS run)""",
    ),
    "store_insert_committed": (
        store_insert_committed,
        """SELECT row_number() OVER (ORDER BY run, vec_id) AS id, round(CAST(embedding[2] AS DOUBLE), 5) AS first,
        CASE WHEN run = 0 THEN 'first' ELSE 'second' END AS model_name FROM embeddings, (SELECT unnest([0, 1]) AS run)""",
    ),
    "stage_timings": (
        stage_timings,
        """SELECT unnest(['embed', 'classify']) AS stage, CAST(ceil(count(*) / 50) AS BIGINT) AS n_rows, true AS timed FROM events""",
    ),
    "store_clear": (store_clear, "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after FROM embeddings"),
    "hashed_embeddings": (
        hashed_embeddings, "SELECT event_id AS line_no, 384 AS dim, CAST(1 AS DOUBLE) AS norm FROM events",
    ),
    "encoded_lines": (
        encoded_lines,
        f"""SELECT line_no, CAST(unnest([0, 1, 2]) AS INTEGER) AS place,
        round(CAST(CAST(unnest([a / n, b / n, c / n]) AS FLOAT) AS DOUBLE), 4) AS x FROM (
        SELECT *, sqrt(a * a + b * b + c * c) AS n FROM (
         SELECT line_no, CAST(length(raw_text) AS DOUBLE) AS a, 1.0::DOUBLE + length(raw_text) - length(replace(raw_text, ' ', '')) AS b,
          1.0::DOUBLE + length(raw_text) - length(replace(raw_text, 'e', '')) AS c FROM ({LINES})))""",
    ),
}
