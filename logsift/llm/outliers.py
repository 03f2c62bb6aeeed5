"""Quality rules with robust multivariate outliers per language and source.

Base rules look at one document: too few words, or too many words inside repeated
five-word windows. The others are judged by a vector of five transformed statistics (word length,
symbols, repeated lines, repeated words, length) and its Mahalanobis distance from a
minimum-covariance-determinant estimate of its group. The estimate starts from
two fixed points, medians with absolute deviations and plain moments, takes concentration steps
(keep the three quarters of rows that are nearest, estimate again) until nothing changes in the group, keeps
the start of the smaller determinant, and ends with one reweighted estimate.

Statistics are integers in thousandths, so sums are exact in any order, and the ranks of distances
are taken over integer steps of their logarithm; exact percentiles then need memory for the values
that occur, not for the rows. All aggregates are combined before the shuffle; a
group may hold any share of the rows. A small ridge is added to each variance, so that a statistic
which is zero in most documents does not reject all others: in such a group 6 symbols in 100 words, a quarter of the
lines or 15 % of the words repeated are accepted, and more is rejected by that statistic alone.

Groups under ``min_rows`` are judged together with the other small ones of their
language, and if these are still few with those of all languages; below that no row is rejected. Null
languages and sources are groups of their own. Null, empty and blank texts fail the base rule. Repeated rows
count as often as they occur and get equal verdicts. Only built-in functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.llm.common import BROADCAST_BYTES, WORD, attach, words
from logsift.staging import scratch_path, stage, stage_at, temporary_stages

FEATURES = ["word_length", "symbols", "lines", "repeats", "length"]
# The 0.9999 quantile of the chi-square distribution with five degrees of freedom.
CUTOFF = 25.74
# Ridge of each variance. Where no text of a group has symbols, repeated lines or repeated words, nothing can be estimated:
# there a text is rejected by that statistic alone from the share on whose distance under the ridge is the cutoff.
FLOORS = [0.03, (0.06 / CUTOFF) ** 0.5, (0.25 / CUTOFF) ** 0.5, (0.15 / CUTOFF) ** 0.5, 0.25]
P = len(FEATURES)
# Quantiles of the chi-square distribution with five degrees of freedom: median, 0.975.
CHI2_MEDIAN, CHI2_975 = 4.351, 12.83
_PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
_SUMS = ["n", *(f"s{i}" for i in range(P)), *(f"q{i}{j}" for i, j in _PAIRS)]
_MODEL = [*(f"m{i}" for i in range(P)), *(f"w{i}{j}" for i, j in _PAIRS), "logdet"]


@dataclass(frozen=True)
class Settings:
    fraction: float = 0.75
    min_rows: int = 60
    cutoff: float = CUTOFF
    # Far above what any group needs; reaching it is an error.
    most_steps: int = 200


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with the counts of the base rules and ``base_failed``."""
    text = F.col("text")
    rows = docs.withColumns(
        {
            "_words": words(text),
            "_spoken": F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD)),
            "word_chars": F.coalesce(F.length(F.translate("text", " \t\n\x0b\f\r", "")), F.lit(0)).cast("long"),
            "n_symbols": F.coalesce(F.length("text") - F.length(F.translate("text", "#*$%&|<>", "")), F.lit(0)).cast("long"),
        }
    ).drop("text")
    n = F.size("_words")
    window = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*[F.get(F.col("_words"), i + j) for j in range(5)]))
    rows = rows.withColumns(
        {
            "n_words": n.cast("long"),
            "n_lines": F.size("_spoken").cast("long"),
            "n_dup_lines": (F.size("_spoken") - F.size(F.array_distinct("_spoken"))).cast("long"),
            "_windows": F.when(n >= 5, window),
        }
    ).drop("_words", "_spoken")
    # Only texts with a repeated window are sorted: equal windows become neighbours.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("_sorted", F.when(F.size(F.array_distinct("_windows")) < F.size("_windows"), placed)).drop("_windows")
    near = lambda k: F.get(F.col("_sorted"), k)["h"]
    twice = F.filter("_sorted", lambda x, k: F.coalesce(x["h"] == near(k - 1), F.lit(False)) | F.coalesce(x["h"] == near(k + 1), F.lit(False)))
    rows = rows.withColumn("_starts", F.array_sort(F.transform(twice, lambda x: x["i"]))).drop("_sorted")
    gain = F.transform("_starts", lambda s, k: F.least(F.lit(5), F.coalesce(F.get(F.col("_starts"), k + 1) - s, F.lit(5))))
    covered = F.aggregate(gain, F.lit(0), lambda a, x: a + x)
    rows = rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts")
    return rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))


def _vector() -> list[Column]:
    """The transformed statistics in thousandths."""
    per = lambda a, b: F.col(a) / F.col(b)
    values = [
        F.ln(per("word_chars", "n_words")),
        F.sqrt(per("n_symbols", "n_words")),
        F.sqrt(per("n_dup_lines", "n_lines")),
        F.sqrt(per("n_repeat_words", "n_words")),
        F.ln("n_words"),
    ]
    return [F.round(v * 1000).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _groups(rows: DataFrame, min_rows: int) -> DataFrame:
    """``_own`` (language and source) with the ``_group`` that judges it: itself, its language's small ones, or all small ones."""
    own = rows.groupBy("_own", "_lang").agg(F.count("*").alias("n"))
    small = own.filter(F.col("n") < min_rows).groupBy("_lang").agg(F.sum("n").alias("of_lang"))
    named = own.join(small, "_lang", "left")
    group = F.when(F.col("n") >= min_rows, F.col("_own")).when(F.col("of_lang") >= min_rows, F.col("_lang")).otherwise("{}")
    return named.select("_own", group.alias("_group"))


def _sums(weighted: list[Column] | None = None) -> list[Column]:
    x = [F.col(f"x{i}") for i in range(P)]
    return [F.count("*").alias("n"), *(F.sum(x[i]).alias(f"s{i}") for i in range(P)), *(F.sum(x[i] * x[j]).alias(f"q{i}{j}") for i, j in _PAIRS)]


def _model(moments: DataFrame, keys: list[str]) -> DataFrame:
    """Means ``m``, inverse Cholesky factor ``w`` and log-determinant from means ``m`` and covariances ``c``."""
    table = moments
    for j in range(P):  # factor, column by column
        square = F.col(f"c{j}{j}") - sum((F.col(f"l{j}{k}") ** 2 for k in range(j)), F.lit(0.0))
        table = table.withColumn(f"l{j}{j}", F.sqrt(F.greatest(square, F.lit(1e-12))))
        below = {f"l{i}{j}": (F.col(f"c{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"l{j}{j}") for i in range(j + 1, P)}
        table = table.withColumns(below) if below else table
    for i in range(P):  # inverse, row by row
        row = {f"w{i}{j}": -sum((F.col(f"l{i}{k}") * F.col(f"w{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}") for j in range(i)}
        table = table.withColumns(row | {f"w{i}{i}": 1 / F.col(f"l{i}{i}")})
    return table.withColumn("logdet", sum((F.ln(f"l{i}{i}") for i in range(P)), F.lit(0.0))).select(*keys, *_MODEL)


def _moments(sums: DataFrame, keys: list[str]) -> DataFrame:
    mean = {f"m{i}": F.col(f"s{i}") / F.col("n") / 1000 for i in range(P)}
    cov = {f"c{i}{j}": F.col(f"q{i}{j}") / F.col("n") / 1e6 - F.col(f"m{i}") * F.col(f"m{j}") + (FLOORS[i] ** 2 if i == j else 0) for i, j in _PAIRS}
    return sums.withColumns(mean).withColumns(cov).select(*keys, *mean, *cov)


def _distance() -> Column:
    """Squared Mahalanobis distance of the statistics ``x`` under the model of the row."""
    gap = [F.col(f"x{i}") / 1000 - F.col(f"m{i}") for i in range(P)]
    return sum((sum((F.col(f"w{i}{j}") * gap[j] for j in range(i + 1)), F.lit(0.0)) ** 2 for i in range(P)), F.lit(0.0))


def _rank() -> Column:
    return F.floor(F.ln(1 + _distance()) * 1000)


def _starts(rows: DataFrame) -> DataFrame:
    """Models of the two starting points of each group."""
    plain = _moments(rows.groupBy("_group").agg(*_sums()), ["_group"])
    middle = stage(rows.groupBy("_group").agg(*[F.percentile(f"x{i}", F.lit(0.5)).alias(f"h{i}") for i in range(P)]), "medians")
    apart = attach(rows, "_group", middle, 256, "inner")
    spread = apart.groupBy("_group").agg(*[F.percentile(F.abs(F.col(f"x{i}") - F.col(f"h{i}")), F.lit(0.5)).alias(f"a{i}") for i in range(P)])
    middle = middle.join(spread, "_group").select(
        "_group",
        *[(F.col(f"h{i}") / 1000).alias(f"m{i}") for i in range(P)],
        *[((1.4826 * F.col(f"a{i}") / 1000) ** 2 + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS],
    )
    both = plain.withColumn("start", F.lit(0)).unionByName(middle.withColumn("start", F.lit(1)))
    return _model(both, ["_group", "start"])


def estimates(rows: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Per ``_group`` the reweighted model and the ``scale`` of its squared distances.

    ``rows`` is a written table of ``_group`` and the statistics ``x``.
    """
    keys, model = ["_group", "start"], stage(_starts(rows), "model")
    # Two models of at most 512 bytes a group, counted once.
    fits = model.count() * 512 <= BROADCAST_BYTES

    def under(models: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(models) if fits else models, "_group")

    # Every step writes the models that came to rest; only groups that still move are computed again.
    moving, rested = model.withColumns({"mark": F.lit(None).cast("long")}), []
    for _ in range(settings.most_steps):
        ranked = under(moving).withColumn("rank", _rank())
        cut = ranked.groupBy(*keys).agg(F.percentile("rank", F.lit(settings.fraction)).alias("cut"))
        both = stage(moving.join(cut, keys), "steps")
        near = under(both).filter(_rank() <= F.col("cut"))
        sums = near.groupBy(*keys).agg(*_sums()).withColumn("mark", F.xxhash64(*_SUMS))
        before = both.select(*keys, F.col("mark").alias("_mark"), F.col("logdet").alias("_logdet"))
        after = _model(_moments(sums, [*keys, "mark"]), [*keys, "mark"]).join(before, keys)
        # A step never raises the determinant but for ties of ranks; those must not make two subsets alternate.
        rest = F.col("_mark").isNotNull() & ((F.col("mark") == F.col("_mark")) | (F.col("logdet") >= F.col("_logdet")))
        after = stage(after.withColumn("rest", rest).drop("_mark", "_logdet"), "model")
        rested.append(after.filter("rest").select(*keys, *_MODEL))
        moving = after.filter("NOT rest").drop("rest")
        if moving.isEmpty():
            break
    else:
        raise RuntimeError(f"concentration steps did not come to rest in {settings.most_steps} steps")
    model = reduce(DataFrame.unionByName, rested)
    best = model.groupBy("_group").agg(F.min_by(F.struct(*_MODEL), F.struct("logdet", "start")).alias("best")).select("_group", "best.*")
    best = stage(best, "best")

    def scaled(fitted: DataFrame) -> DataFrame:
        """With the factor that brings a larger median distance to its chi-square value; the floors may make it smaller."""
        ranked = under(fitted).groupBy("_group").agg(F.percentile(_rank(), F.lit(0.5)).alias("middle"))
        factor = F.greatest((F.exp(F.col("middle") / 1000) - 1) / CHI2_MEDIAN, F.lit(1.0))
        return stage(fitted.join(ranked, "_group").withColumn("scale", factor).drop("middle"), "scaled")

    near = under(scaled(best)).filter(_distance() <= CHI2_975 * F.col("scale"))
    return scaled(stage(_model(_moments(near.groupBy("_group").agg(*_sums()), ["_group"]), ["_group"]), "reweighted"))


def judge(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without text, with the base counts, ``base_failed``, ``distance`` and ``kept``."""
    spark = docs.sparkSession
    out = scratch_path(spark, "judged")
    with temporary_stages(spark):
        own = {"_own": F.to_json(F.struct("lang", "source")), "_lang": F.to_json(F.struct("lang", F.lit("*").alias("any")))}
        rows = stage(statistics(docs).withColumns(own), "statistics")
        regular = rows.filter(~F.col("base_failed"))
        groups = stage(_groups(regular, settings.min_rows), "groups")
        vectors = stage(attach(regular.select("_own", *_vector()), "_own", groups, 128, "inner").drop("_own"), "vectors")
        counted = vectors.groupBy("_group").agg(F.count("*").alias("_rows"))
        models = estimates(vectors, settings).join(counted, "_group").filter(F.col("_rows") >= settings.min_rows)
        models = groups.join(models, "_group").drop("_group", "_rows")
        placed = attach(rows.withColumns({f"x{i}": v for i, v in enumerate(_vector_if_regular())}), "_own", models, 384)
        distance = F.round(_distance() / F.col("scale"), 4)
        kept = ~F.col("base_failed") & F.coalesce(distance <= settings.cutoff, F.lit(True))
        judged = placed.withColumns({"distance": distance, "kept": kept})
        return stage_at(judged.drop("_own", "_lang", "scale", *_MODEL, *(f"x{i}" for i in range(P))), out)


def _vector_if_regular() -> list[Column]:
    return [F.when(~F.col("base_failed"), v) for v in _vector()]
