"""Joins to a unique key that a third of the other side may share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logsift.staging import stage

SALTS = 32
MOST_HOT = 4096


def _bytes(rows: DataFrame) -> int:
    """What the rows take: strings as long as they are, lists by their items, other columns by a bound."""

    def width(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(column), F.lit(0)) + 16
        if isinstance(kind, T.ArrayType):
            return F.greatest(F.size(column), F.lit(0)) * 24 + 24 if not isinstance(kind.elementType, T.StringType | T.BinaryType | T.StructType | T.ArrayType | T.MapType) else F.octet_length(F.to_json(column))
        if isinstance(kind, T.StructType):
            return sum((width(column[f.name], f.dataType) for f in kind), F.lit(8))
        return F.octet_length(F.to_json(F.struct(column))) if isinstance(kind, T.MapType | T.VariantType) else F.lit(16)

    row = sum((width(F.col(f.name), f.dataType) for f in rows.schema), F.lit(8))
    return rows.agg(F.sum(F.coalesce(row.cast("long"), F.lit(64)))).first()[0] or 0


def join_unique(facts: DataFrame, unique: DataFrame, key: str, broadcast_bytes: int = 32 << 20, facts_per_copy: int = 1 << 17) -> DataFrame:
    """Inner join of ``facts`` to the rows of ``unique`` it needs, one per ``key``.

    A table of few bytes is broadcast, and no fact moves. Of a larger one only
    the needed rows are taken: distinct keys first, combined before the shuffle.
    If these are too many as well, both sides are shuffled. Only a key with more than ``facts_per_copy``
    facts is salted: its row is copied, once for each so many facts, so that they are spread over many tasks.
    """
    if _bytes(unique) <= broadcast_bytes:
        return facts.join(F.broadcast(unique), key)
    counts = stage(facts.groupBy(key).agg(F.count(F.lit(1)).alias("_facts")), "keys")
    keys = counts.select(key)
    # Spark's own guess goes by the size of a compressed file, and could broadcast what the driver cannot hold.
    keys = F.broadcast(keys) if _bytes(keys) <= broadcast_bytes else keys.hint("merge")
    needed = stage(unique.join(keys, key, "left_semi"), "needed")
    if _bytes(needed) <= broadcast_bytes:
        return facts.join(F.broadcast(needed), key)
    total = counts.agg(F.sum("_facts")).first()[0]
    share = max(facts_per_copy, total // MOST_HOT + 1)  # so there are fewer hot keys than that
    hot = counts.where(F.col("_facts") > share).select(key, F.ceil(F.col("_facts") / share).cast("int").alias("_copies"))
    if hot.isEmpty():
        return facts.join(needed.hint("merge"), key)
    hot, copies = F.broadcast(hot), F.coalesce("_copies", F.lit(1))
    salted = facts.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), copies).cast("int"))
    copied = needed.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1)))
    return salted.drop("_copies").join(copied.drop("_copies").hint("merge"), [key, "_salt"]).drop("_salt")
