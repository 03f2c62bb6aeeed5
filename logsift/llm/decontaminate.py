"""Documents that contain benchmark items, found by size-partitioned MinHash containment search.

Items are partitioned by the number of their distinct five-word shingles, in
powers of two. Each partition has its own sketch length: the k smallest shingle hashes
of an item (its bottom-k MinHash sketch). A document that contains three quarters of
an item's shingles misses at most a quarter of them, so with k above a quarter of the
partition's largest size it must hold one of the k minima, and nothing is lost; from
96 shingles on k stays 24, and a document is missed with probability 0.25^24. An item of
any length is looked up this way inside a document of any length, where a symmetric signature
of the whole document would drown it. Documents too small for a partition are
not looked up. Candidates are confirmed by the exact share of the item's shingles that
the document holds.

Cases: null and blank texts of either side match nothing. Texts under five words are
one shingle and match only the same words. Repeated rows give one pair; several rows of one ``doc_id``
give their best. A null ``doc_id`` is reported as null. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import attach, row_key, with_shingles
from logsift.staging import scratch_path, stage, stage_at, temporary_stages

PERCENT = 75
LONGEST_SKETCH = 24
_KEY = "_doc"


def sketches(items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per item its shingles, their number, its size partition and its sketch."""
    sized = with_shingles(items.select("item_id", "text"), "text", "hashes").withColumn("hashes", F.array_sort("hashes"))
    sized = sized.select("item_id", "hashes", F.size("hashes").alias("n_item")).filter("n_item > 0")
    largest = F.pow(F.lit(2), F.col("partition") + 1) - 1
    enough = F.floor(largest * (100 - percent) / 100).cast("int") + 1
    return sized.withColumn("partition", F.floor(F.log2(F.col("n_item") + F.lit(0.5))).cast("int")).withColumn(
        "sketch", F.slice("hashes", 1, F.least(enough, F.lit(LONGEST_SKETCH)))
    )


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``(_doc, doc_id, item_id, n_item, n_shared)`` for the items that a row's text contains; a written table.

    ``_doc`` is ``row_key("doc_id", "text")``.
    """
    spark = docs.sparkSession
    out = scratch_path(spark, "contained")
    with temporary_stages(spark):
        known = stage(sketches(items, percent), "items")
        probes = known.select("item_id", "n_item", F.explode("sketch").alias("hash"))
        keyed = docs.select(row_key("doc_id", "text").alias(_KEY), "doc_id", "text")
        hashed = with_shingles(keyed, "text", "hashes").drop("text")
        # An outer explode and a count that is never null: else Spark infers filters on the hashes and evaluates
        # them below the words, which are then split anew for every window.
        single = hashed.select(_KEY, F.coalesce(F.size("hashes"), F.lit(0)).alias("n_doc"), F.explode_outer("hashes").alias("hash"))
        hits = attach(single, "hash", probes, 32, "inner").filter(F.col("n_doc") * 100 >= F.col("n_item") * percent)
        hits = stage(hits.select(_KEY, "item_id").distinct(), "candidates")
        again = with_shingles(attach(keyed, _KEY, hits.select(_KEY).distinct(), 64, "left_semi"), "text", "hashes")
        again = again.select(_KEY, "doc_id", F.explode_outer("hashes").alias("hash"))
        full = known.select("item_id", "n_item", F.explode("hashes").alias("hash"))
        shared = attach(again, "hash", full, 32, "inner").join(hits, [_KEY, "item_id"], "left_semi")
        counted = shared.groupBy(_KEY, "doc_id", "item_id", "n_item").agg(F.count_distinct("hash").alias("n_shared"))
        return stage_at(counted.filter(F.col("n_shared") * 100 >= F.col("n_item") * percent), out)


def contamination(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row per document and item it contains."""
    found = contained_items(docs, items, percent)
    best = found.groupBy("doc_id", "item_id", F.col("n_item").cast("long").alias("n_item")).agg(F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the rows whose text contains an item."""
    gone = contained_items(docs, items, percent).select(_KEY).distinct()
    return attach(docs.withColumn(_KEY, row_key("doc_id", "text")), _KEY, gone, 64, "left_anti").drop(_KEY)
