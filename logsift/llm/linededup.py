"""Deletes later copies of line runs that repeat in the corpus.

The corpus is the sequence of its lines with a word, document after document in
the order of ``doc_id`` (nulls last, different texts of one id by a hash). Its suffixes are kept in groups of equal
beginnings, as in a suffix array, and the groups are refined by distributed
prefix doubling: the group of the first 2^(k+1) lines is named by the groups
of the two halves. Suffixes alone in their group are retired after each
round, so only repeated text is shuffled; at the start these are the lines
that occur once. The order between groups is never needed.

A run counts as repeated if it holds ``min_words`` words, inside one document.
Two suffixes share such a run if their common prefix reaches it: two doubled
groups that overlap prove any length. The group at that depth is an interval of
common prefixes, its earliest suffix is the original, and the lines of all others are
deleted. Every repeated run is covered by its shortest sufficient runs,
read from each start and back from each end, so their union gives the maximal
runs whole, and no run longer than ``min_words`` lines has to be compared.

Cases: null and blank texts stay as they are. Blank lines are no part of a
run and stay. Rows equal in ``doc_id`` and ``text`` are one document and get the same
edit. A copied document ends with no line; ``text`` is then blank, not null.
Only built-in functions are used; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import row_key, words
from logsift.staging import scratch_path, stage, stage_at, temporary_stages

MIN_WORDS = 50
_NAME = ["n1", "n2"]
_KEY = "_doc"


def _name(*cells: Column) -> list[Column]:
    """A 128-bit name of the given cells."""
    return [F.xxhash64(*cells).alias("n1"), F.xxhash64(F.lit(1), *cells).alias("n2")]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def positions(docs: DataFrame) -> DataFrame:
    """One row per line with a word: document, place among such lines, line number, name and words."""
    cells = F.transform(_lines(F.col("text")), lambda x, i: F.struct(i.alias("line"), x.alias("text"), F.size(words(x)).alias("words")))
    spoken = F.filter(cells, lambda c: c["words"] > 0)
    rows = docs.select("doc_id", row_key("doc_id", "text").alias(_KEY), F.posexplode_outer(spoken).alias("pos", "cell"))
    rows = rows.filter("pos IS NOT NULL")  # unlike the filter of an inner explode, not evaluated on the text
    return rows.select(_KEY, "doc_id", "pos", F.col("cell.line"), F.col("cell.words"), *_name(F.col("cell.text")))


def _repeated(named: DataFrame) -> DataFrame:
    """The rows whose name occurs at two places; ``named`` is a written table.

    The names are counted before the shuffle and written, so that Spark can
    split a name that a third of the rows share.
    """
    counts = named.groupBy(*_NAME).agg(F.count("*").alias("places")).filter("places > 1").drop("places")
    return stage(named.join(stage(counts, "names"), _NAME, "left_semi").dropDuplicates([_KEY, "pos"]), "repeated")


def runs(repeated: DataFrame, min_words: int) -> DataFrame:
    """Shortest runs of repeated lines with enough words, from every start and to every end.

    A document's lines come together as they were together in its text.
    """
    cell = F.struct("pos", "words")
    docs = repeated.groupBy(_KEY).agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(cell)).alias("cells"))

    def shortest(i: Column, step: int) -> Column:
        """Lines needed from the i-th on, or 0 if a gap or the end comes first."""
        here = F.get(F.col("cells"), i)
        begin = i + 1 if step > 0 else F.greatest(i - (min_words - 2), F.lit(1))
        near = F.slice(F.col("cells"), begin, F.lit(min_words) if step > 0 else i + 2 - begin)
        near = near if step > 0 else F.reverse(near)
        start = F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines"))
        grown = F.aggregate(
            near,
            start,
            lambda a, c: F.when(
                (a["words"] < min_words) & (c["pos"] == here["pos"] + step * a["lines"]),
                F.struct((a["words"] + c["words"]).alias("words"), (a["lines"] + 1).alias("lines")),
            ).otherwise(a),
            lambda a: F.when(a["words"] >= min_words, a["lines"]).otherwise(0),
        )
        return F.when(here["words"] >= min_words, 1).otherwise(grown)

    def found(step: int) -> Column:
        every = F.transform(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: F.struct(F.get(F.col("cells"), i)["pos"].alias("pos"), shortest(i, step).alias("lines")))
        kept = F.filter(every, lambda r: r["lines"] > 0)
        return kept if step > 0 else F.transform(kept, lambda r: F.struct((r["pos"] - r["lines"] + 1).alias("pos"), r["lines"].alias("lines")))

    both = docs.select(_KEY, "doc_id", F.explode(F.array_distinct(F.concat(found(1), found(-1)))).alias("run"))
    level = F.floor(F.log2(F.col("run.lines") + F.lit(0.5))).cast("int")
    return both.select(_KEY, "doc_id", F.col("run.pos").alias("pos"), F.col("run.lines").alias("lines"), level.alias("level"))


def _later(level_runs: DataFrame, named: DataFrame, length: int) -> DataFrame:
    """Of the runs of ``length`` to 2 ``length`` - 1 lines, those with an earlier copy."""
    ends = named.select(_KEY, F.col("pos").alias("_end"), F.col("n1").alias("e1"), F.col("n2").alias("e2"))
    run = level_runs.join(named.select(_KEY, "pos", *_NAME), [_KEY, "pos"])
    if length > 1:
        run = run.withColumn("_end", F.col("pos") + F.col("lines") - length).join(ends, [_KEY, "_end"])
        cells = [F.col(c) for c in ("lines", "n1", "n2", "e1", "e2")]
        run = run.select(_KEY, "doc_id", "pos", "lines", *_name(*cells))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", _KEY, "pos")
    run = stage(run.select(_KEY, "pos", "lines", *_NAME, place.alias("place")), "runs")
    first = run.groupBy(*_NAME).agg(F.min("place").alias("first"), F.count("*").alias("copies"))
    first = stage(first.filter("copies > 1").drop("copies"), "first")
    return run.join(first, _NAME).filter(F.col("place") > F.col("first")).select(_KEY, "pos", "lines")


def later_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: one row per document that loses any, with their line numbers; a written table."""
    spark = docs.sparkSession
    out = scratch_path(spark, "deleted")
    with temporary_stages(spark):
        named = _repeated(stage(positions(docs), "lines"))
        lines = named.select(_KEY, "pos", "line", "words")
        found = stage(runs(named, min_words), "candidates")
        deepest = found.agg(F.max("level")).first()[0]
        later = []
        for level in range((-1 if deepest is None else deepest) + 1):
            length = 1 << level
            later.append(stage(_later(found.filter(F.col("level") == level), named, length), "later"))
            if level < deepest:
                half = named.select(_KEY, (F.col("pos") - length).alias("pos"), F.col("n1").alias("e1"), F.col("n2").alias("e2"))
                pair = named.select(_KEY, "pos", *_NAME).join(half, [_KEY, "pos"])
                named = _repeated(stage(pair.select(_KEY, "pos", *_name(*[F.col(c) for c in (*_NAME, "e1", "e2")])), "doubled"))
        covered = lines.limit(0).select(_KEY, "pos")
        for part in later:
            covered = covered.unionByName(part.select(_KEY, F.explode(F.sequence(F.col("pos"), F.col("pos") + F.col("lines") - 1)).alias("pos")))
        gone = covered.distinct().join(lines, [_KEY, "pos"])
        gone = gone.groupBy(_KEY).agg(F.sort_array(F.collect_list("line")).alias("_gone"), F.sum("words").alias("_gone_words"))
        return stage_at(gone, out)


def delete_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with edited ``text``, and ``n_lines``, ``n_deleted``, ``n_deleted_words``."""
    gone = later_copies(docs, min_words)
    # One plan at every size: which documents lose lines is not bounded.
    joined = docs.withColumn(_KEY, row_key("doc_id", "text")).join(gone.hint("merge"), _KEY, "left")
    spoken = F.filter(_lines(F.col("text")), lambda x: F.size(words(x)) > 0)
    kept = F.filter(_lines(F.col("text")), lambda x, i: ~F.array_contains("_gone", i))
    count = F.coalesce(F.size("_gone"), F.lit(0))
    edited = joined.withColumns(
        {
            "n_lines": F.when(F.col("text").isNull(), 0).otherwise(F.size(spoken)).cast("long"),
            "n_deleted": F.when(F.col("_gone").isNull(), 0).otherwise(count).cast("long"),
            "n_deleted_words": F.coalesce("_gone_words", F.lit(0)).cast("long"),
            "text": F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")),
        }
    )
    return edited.drop(_KEY, "_gone", "_gone_words")
