"""From log lines to batch verdicts: by rule or generator, or with reuse by similarity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsift.functions.vectors import is_finite
from logsift.operators.batching import assign_batches, batch_text, collect_entries
from logsift.operators.classify import Classifier, classify_batches, rule_results
from logsift.operators.embed import HASHED_ENCODER, hashed_embedding
from logsift.operators.leaders import HEAD_ROWS, follow, select_leaders
from logsift.operators.similarity import top_matches_once
from logsift.operators.skew import SALTS, join_unique
from logsift.schemas import DEFAULT_BATCH_SIZE, DEFAULT_REUSE_THRESHOLD
from logsift.sources.store import VectorStore
from logsift.staging import stage


@dataclass(frozen=True)
class ReuseOptions:
    threshold: float = DEFAULT_REUSE_THRESHOLD
    embedder_name: str | None = HASHED_ENCODER
    head_rows: int = HEAD_ROWS


def batches_of(indexed: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE) -> DataFrame:
    return collect_entries(assign_batches(indexed, batch_size))


def triage_batches(
    indexed: DataFrame, batch_size: int = DEFAULT_BATCH_SIZE, classifier: Classifier | None = None
) -> DataFrame:
    """Every batch is classified: one shuffle by batch, then a narrow stage.

    The keyword rule needs no collected batch: its flags are combined before
    the shuffle, and no line text moves.
    """
    if classifier is None:
        return rule_results(assign_batches(indexed, batch_size))
    return classify_batches(batches_of(indexed, batch_size), classifier)


def embed_batches(batches: DataFrame, encoder=None) -> DataFrame:
    """Add ``text`` and ``vec``; ``encoder(df, text_column)`` replaces the hashed default."""
    texts = batches.withColumn("text", batch_text(F.col("entries")))
    return (encoder or hashed_embedding)(texts, "text")


def stored_verdicts(batches: DataFrame, store: DataFrame, threshold: float) -> DataFrame:
    """``(batch_id, id, sim)`` of the batches whose best stored vector reaches the threshold."""
    queries = batches.select(F.col("batch_id").alias("qid"), F.col("vec").alias("qvec"))
    keyed = store.select(F.col("id").alias("sid"), F.col("vector").alias("svec"))
    hits = top_matches_once(queries, keyed, threshold)
    return hits.select(F.col("qid").alias("batch_id"), F.col("sid").alias("id"), "sim")


def lookup(batches: DataFrame, store: DataFrame, threshold: float = DEFAULT_REUSE_THRESHOLD) -> DataFrame:
    """Verdict columns of the matched stored row; null where a batch has none."""
    batches = stage(batches.select("batch_id", "vec"), "vectors")  # an encoder runs once
    hits = stored_verdicts(batches, store, threshold)
    fields = store.select("id", "is_error", "model_name", "embedder_model_name")
    matched = join_unique(hits, fields, "id")
    return batches.select("batch_id").join(matched, "batch_id", "left")


@dataclass(frozen=True)
class ReuseResult:
    """Verdicts of all batches and the rows to add to the store, both written tables."""

    verdicts: DataFrame
    new_rows: DataFrame


def triage_with_reuse(
    batches: DataFrame,
    store: DataFrame,
    classifier: Classifier | None = None,
    options: ReuseOptions = ReuseOptions(),
) -> ReuseResult:
    """What a loop over the batches would do that stores each newly classified one.

    ``batches`` has ``batch_id``, ``entries`` and ``vec``. Only leaders are
    classified, however long their text. A leader whose classification fails is never stored; then the leaders are chosen again without it
    and only the new ones are classified, until no leader fails.
    """
    batches = stage(batches.select("batch_id", "entries", "vec"), "batches")
    threshold = options.threshold
    hits = stage(stored_verdicts(batches, store, threshold), "hits")
    missed = batches.join(hits.select("batch_id"), "batch_id", "left_anti")
    candidates = missed.select(F.col("batch_id").alias("ord"), "vec")

    verdicts, width = None, 1
    while True:
        leaders = select_leaders(candidates, threshold, options.head_rows)
        verdicts = _classify_new(batches, leaders.select("ord"), verdicts, classifier)
        failed = leaders.join(_failures(verdicts), "ord", "left_semi")
        if failed.isEmpty():
            break
        queue = _next_in_line(candidates, leaders, failed, width, threshold)
        verdicts = _classify_new(batches, queue, verdicts, classifier)
        candidates = stage(candidates.join(_failures(verdicts), "ord", "left_anti"), "candidates")
        width *= 4

    result = _resolve(batches, store, hits, leaders, verdicts, options)
    # A broken vector is never stored.
    text = batches.where(is_finite(F.col("vec"))).select(
        "batch_id", batch_text(F.col("entries")).alias("raw_text"), F.col("vec").alias("vector")
    )
    names = verdicts.select(
        "batch_id",
        F.col("error_found").alias("is_error"),
        "model_name",
        F.lit(options.embedder_name).cast("string").alias("embedder_model_name"),
    )
    chosen = leaders.select(F.col("ord").alias("batch_id"))
    new_rows = stage(text.join(names.join(chosen, "batch_id", "left_semi"), "batch_id"), "new_rows")
    return ReuseResult(result, new_rows)


def _classify_new(batches, wanted, verdicts, classifier) -> DataFrame:
    """Classify the wanted batches that have no verdict yet, once."""
    wanted = wanted.withColumnRenamed("ord", "batch_id")
    if verdicts is not None:
        wanted = wanted.join(verdicts.select("batch_id"), "batch_id", "left_anti")
    fresh = batches.select("batch_id", "entries").join(wanted, "batch_id", "left_semi")
    fresh = stage(classify_batches(fresh, classifier), "verdicts")
    return fresh if verdicts is None else verdicts.unionByName(fresh)


def _failures(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(F.col("error").isNotNull()).select(F.col("batch_id").alias("ord"))


def _next_in_line(candidates, leaders, failed, width, threshold) -> DataFrame:
    """The first ``width`` followers of each failed leader.

    Without their leader they may become leaders and fail in turn. Asking ahead
    for ever more of them keeps the number of rounds logarithmic; a verdict that
    turns out not to be needed is never used.
    """
    others = stage(candidates.join(leaders.select("ord"), "ord", "left_anti"), "others")
    behind = follow(others, leaders, threshold).join(
        failed.select(F.col("ord").alias("leader")), "leader", "left_semi"
    )
    # First within salted parts of a leader's followers, then among what these leave.
    for keys in (["leader", "_salt"], ["leader"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
        behind = behind.withColumn("_salt", F.pmod(F.xxhash64("ord"), F.lit(SALTS)))
        behind = behind.withColumn("_place", place).where(F.col("_place") <= width)
    return behind.select("ord")


def _resolve(batches, store, hits, leaders, verdicts, options) -> DataFrame:
    """One verdict per batch: the leaders' own, then the closest of stored row and leader."""
    embedder = F.lit(options.embedder_name).cast("string")
    leader_ids = leaders.select(F.col("ord").alias("batch_id"))
    others = stage(
        batches.select("batch_id", "vec").join(leader_ids, "batch_id", "left_anti"), "others"
    )
    near = follow(
        others.select(F.col("batch_id").alias("ord"), "vec"), leaders, options.threshold
    ).select(F.col("ord").alias("batch_id"), "leader", F.col("sim").alias("leader_sim"))
    # A stored row wins a tie: its id is smaller than any that this run adds.
    closest = (
        others.select("batch_id")
        .join(hits.withColumnRenamed("sim", "stored_sim"), "batch_id", "left")
        .join(near, "batch_id", "left")
        .withColumn(
            "_stored",
            F.col("id").isNotNull()
            & (F.col("leader").isNull() | (F.col("stored_sim") >= F.col("leader_sim"))),
        )
    )
    closest = stage(closest, "closest")
    columns = [
        "batch_id", "error_found", "model_name", "embedder_model_name", "origin",
        "matched_id", "similarity", "error",
    ]
    none = F.lit(None)

    fields = store.select("id", "is_error", "model_name", "embedder_model_name")
    from_store = (
        join_unique(closest.where("_stored"), fields, "id")
        .select(
            "batch_id", F.col("is_error").alias("error_found"), "model_name", "embedder_model_name",
            F.lit("stored").alias("origin"), F.col("id").alias("matched_id"),
            F.col("stored_sim").alias("similarity"), none.cast("string").alias("error"),
        )
    )
    own = verdicts.select("batch_id", "error_found", "model_name", "error")
    by_leader = own.select(F.col("batch_id").alias("leader"), "error_found", "model_name")
    from_run = (
        join_unique(closest.where(~F.col("_stored") & F.col("leader").isNotNull()), by_leader, "leader")
        .select(
            "batch_id", "error_found", "model_name", embedder.alias("embedder_model_name"),
            F.lit("run").alias("origin"), F.col("leader").alias("matched_id"),
            F.col("leader_sim").alias("similarity"), none.cast("string").alias("error"),
        )
    )
    classified = own.join(leader_ids, "batch_id", "left_semi").select(
        "batch_id", "error_found", "model_name", embedder.alias("embedder_model_name"),
        F.lit("classified").alias("origin"), none.cast("long").alias("matched_id"),
        none.cast("double").alias("similarity"), "error",
    )
    # Left over: classification failed.
    unresolved = closest.where(~F.col("_stored") & F.col("leader").isNull()).select("batch_id")
    names = own.select("batch_id", "model_name", "error")
    failed = unresolved.join(names, "batch_id", "left").select(
        "batch_id", F.lit(True).alias("error_found"), "model_name", embedder.alias("embedder_model_name"),
        F.lit("failed").alias("origin"), none.cast("long").alias("matched_id"),
        none.cast("double").alias("similarity"), "error",
    )
    union = from_store
    for part in (from_run, classified, failed):
        union = union.unionByName(part)
    return stage(union.select(*columns), "resolved")


def triage_and_store(
    batches: DataFrame,
    store: VectorStore,
    classifier: Classifier | None = None,
    options: ReuseOptions = ReuseOptions(),
    clear_store: bool = False,
) -> DataFrame:
    """Batches against the store on disk, which grows by the newly classified ones."""
    if clear_store:
        store.clear()
    store.create_if_missing()
    result = triage_with_reuse(batches, store.read(), classifier, options)
    store.insert(result.new_rows)
    return result.verdicts

