"""Binary classification metrics from one counting pass.

Four conditional counts are combined on the map side; every metric is
arithmetic on that single row. Ratios follow the usual library conventions: an
undefined ratio takes ``zero_division`` (``nan`` leaves it out of averages and
gives null), averages weigh the classes that occur in the labels.
"""

from __future__ import annotations

import math
from typing import Any, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logsift.functions.labels import coerce_labels

CLASSES = (0, 1)
AVERAGES = ("binary", "micro", "macro", "weighted")
MEASURES = ("precision", "recall", "f1_score")


def confusion_counts(pairs: DataFrame, positive_label: Any = True) -> DataFrame:
    """One row ``tn, fp, fn, tp`` over the columns ``y_true`` and ``y_pred``."""
    coded = coerce_labels(pairs, "y_true", "y_pred", positive_label=positive_label)
    true, pred = F.col("y_true") == 1, F.col("y_pred") == 1
    extra = [F.min("_unpaired").alias("_unpaired")] if "_unpaired" in pairs.columns else []
    return coded.agg(
        F.count_if(~true & ~pred).alias("tn"),
        F.count_if(~true & pred).alias("fp"),
        F.count_if(true & ~pred).alias("fn"),
        F.count_if(true & pred).alias("tp"),
        *extra,
    )


def confusion_long(pairs: DataFrame, positive_label: Any = True) -> DataFrame:
    """``(y_true, y_pred, n)`` for the combinations that occur."""
    coded = coerce_labels(pairs, "y_true", "y_pred", positive_label=positive_label)
    return coded.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(
    pairs: DataFrame, labels: Sequence[int] = CLASSES, positive_label: Any = True
) -> DataFrame:
    """Counts as an array of rows, true labels down and predictions across, in the order given."""
    counts = confusion_counts(pairs, positive_label)
    cell = {(0, 0): "tn", (0, 1): "fp", (1, 0): "fn", (1, 1): "tp"}
    count = lambda t, p: F.col(cell[t, p]) if (t, p) in cell else F.lit(0).cast("long")
    rows = F.array(*[F.array(*[count(t, p) for p in labels]) for t in labels])
    seen = " + ".join(["0"] + [_class(c)["true"] for c in labels if c in CLASSES])
    checked = F.when(
        F.expr(f"{_TOTAL} > 0 AND {seen} = 0"),
        F.raise_error(F.lit("At least one label specified must be in y_true")),
    ).otherwise(rows)
    return counts.select(checked.alias("confusion_matrix"))


# The arithmetic is put together as SQL text over the four counts and becomes a
# column at the end, one call per metric instead of one per operator.
_TOTAL = "(tn + fp + fn + tp)"


def _class(label: int) -> dict[str, str]:
    if label not in CLASSES:  # labels are coerced to the two classes, so no other occurs
        return {"hit": "0L", "true": "0L", "pred": "0L"}
    hit, missed, false = ("tp", "fn", "fp") if label == 1 else ("tn", "fp", "fn")
    return {"hit": hit, "true": f"({hit} + {missed})", "pred": f"({hit} + {false})"}


def _ratio(value: str, total: str) -> str:
    return f"cast(try_divide({value}, {total}) AS DOUBLE)"


def _measure(name: str, hit: str, true: str, pred: str, zero_division: float) -> str:
    ratio = {
        "precision": _ratio(hit, pred),
        "recall": _ratio(hit, true),
        "f1_score": _ratio(f"2 * {hit}", f"({true} + {pred})"),
    }[name]
    other = "cast(NULL AS DOUBLE)" if math.isnan(zero_division) else f"{float(zero_division)}D"
    return f"coalesce({ratio}, {other})"


def _mean(values: list[str], weights: list[str]) -> str:
    """Weighted mean that leaves out null values."""
    total = " + ".join(f"coalesce({v} * {w}, 0D)" for v, w in zip(values, weights))
    weight = " + ".join(f"if({v} IS NULL, 0D, {w})" for v, w in zip(values, weights))
    return f"try_divide({total}, {weight})"


def _averaged(name: str, average: str, pos_label: int, zero_division: float, labels) -> str:
    if average == "binary":
        if pos_label not in CLASSES:
            raise ValueError(f"pos_label={pos_label} is not a valid label: {list(CLASSES)}")
        return _measure(name, **_class(pos_label), zero_division=zero_division)
    chosen = [_class(c) for c in (labels or CLASSES)]
    if average == "micro":
        summed = {k: "(" + " + ".join(c[k] for c in chosen) + ")" for k in chosen[0]}
        return _measure(name, **summed, zero_division=zero_division)
    values = [_measure(name, **c, zero_division=zero_division) for c in chosen]
    if average == "weighted":
        return _mean(values, [f"cast({c['true']} AS DOUBLE)" for c in chosen])
    if average == "macro":
        occurs = [f"cast({c['true']} + {c['pred']} > 0 AS DOUBLE)" for c in chosen]
        return _mean(values, ["1D"] * len(chosen) if labels else occurs)
    raise ValueError(f"average must be one of {AVERAGES} or None, got {average!r}")


def averaged(
    name: str,
    average: str,
    pos_label: int = 1,
    zero_division: float = 0.0,
    labels: Sequence[int] | None = None,
) -> Column:
    """One of the measures over the four counts.

    Without ``labels`` a class counts in an average only if it occurs.
    """
    return F.expr(_averaged(name, average, pos_label, zero_division, labels))


def accuracy() -> Column:
    return F.expr(_ratio("(tp + tn)", _TOTAL))


def balanced_accuracy() -> Column:
    """Mean recall of the classes that occur in ``y_true``."""
    return F.expr(_mean([_ratio(_class(c)["hit"], _class(c)["true"]) for c in CLASSES], ["1D", "1D"]))


def matthews_corrcoef() -> Column:
    """Counts become doubles before they are multiplied; 0 if undefined.

    Square roots are taken one by one, so that the product stays in range.
    """
    spread = "sqrt(tp + fp) * sqrt(tp + fn) * sqrt(tn + fp) * sqrt(tn + fn)"
    agreement = "cast(tp AS DOUBLE) * tn - cast(fp AS DOUBLE) * fn"
    return F.expr(f"coalesce(try_divide({agreement}, {spread}), 0D)")


def zero_one_loss() -> Column:
    return F.expr(_ratio("(fp + fn)", _TOTAL))


def hamming_loss() -> Column:
    """The same as the zero-one loss when every row has a single label."""
    return zero_one_loss()


def evaluate(
    pairs: DataFrame,
    zero_division: float = 0.0,
    average: str = "binary",
    positive_label: Any = True,
) -> DataFrame:
    """The full metrics record: one aggregate, one projection, one row."""
    counts = confusion_counts(pairs, positive_label)
    if "_unpaired" in counts.columns:
        message = F.concat(
            F.lit("the two label lists differ in length, first unpaired position: "), F.col("_unpaired")
        )
        # As a filter, so that it stays whichever metrics are selected.
        counts = counts.where(F.assert_true(F.col("_unpaired").isNull(), message).isNull())
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    return counts.select(
        accuracy().alias("accuracy"),
        balanced_accuracy().alias("balanced_accuracy"),
        *[averaged(m, average, 1, zero_division).alias(m) for m in MEASURES],
        F.array(F.array(tn, fp), F.array(fn, tp)).alias("confusion_matrix"),
        F.expr(_report(CLASSES, zero_division)).alias("classification_report"),
        matthews_corrcoef().alias("matthews_corrcoef"),
        zero_one_loss().alias("zero_one_loss"),
        hamming_loss().alias("hamming_loss"),
        tn.alias("true_negative"),
        fp.alias("false_positive"),
        fn.alias("false_negative"),
        tp.alias("true_positive"),
        F.struct((tn + fp).alias("negative"), (fn + tp).alias("positive")).alias("support"),
        F.expr(_TOTAL).alias("total_samples"),
    )


def metrics_by_class(
    pairs: DataFrame,
    labels: Sequence[int] | None = None,
    zero_division: float = 0.0,
    positive_label: Any = True,
) -> DataFrame:
    """One row per class: precision, recall, F1 and support."""
    rows = [_class_row(c, f"{c}", zero_division) for c in (labels or CLASSES)]
    return confusion_counts(pairs, positive_label).select(F.expr(f"inline(array({', '.join(rows)}))"))


def _row(first: str, values: list[str], support: str | None = None) -> str:
    members = first + "".join(f", '{m}', {v}" for m, v in zip(MEASURES, values))
    return f"named_struct({members}" + (f", 'support', {support})" if support else ")")


def _class_row(label: int, shown: str, zero_division: float) -> str:
    one = _class(label)
    return _row(f"'label', {shown}", [_measure(m, **one, zero_division=zero_division) for m in MEASURES], one["true"])


def metrics_averaged(
    pairs: DataFrame,
    averages: Sequence[str] = AVERAGES,
    labels: Sequence[int] | None = None,
    pos_label: int = 1,
    zero_division: float = 0.0,
    positive_label: Any = True,
) -> DataFrame:
    """One row per kind of average: precision, recall and F1, over the classes that occur unless ``labels`` says otherwise."""
    rows = [
        _row(f"'average', '{kind}'", [_averaged(m, kind, pos_label, zero_division, labels) for m in MEASURES])
        for kind in averages
    ]
    return confusion_counts(pairs, positive_label).select(F.expr(f"inline(array({', '.join(rows)}))"))


def fscore_averaged(pairs: DataFrame, *args, labels: Sequence[int] | None = None, **options) -> DataFrame:
    """As ``metrics_averaged``, but over both classes unless ``labels`` says otherwise, whether they occur or not."""
    return metrics_averaged(pairs, *args, labels=labels or CLASSES, **options)


def _report(labels: Sequence[int], zero_division: float) -> str:
    support = "(" + " + ".join(_class(c)["true"] for c in labels) + ")"

    def mean_row(name: str, kind: str) -> str:
        return _row(f"'label', '{name}'", [_averaged(m, kind, 1, zero_division, labels) for m in MEASURES], support)

    none = "cast(NULL AS DOUBLE)"
    whole = set(CLASSES) <= set(labels)
    rows = [
        *[_class_row(c, f"'{c}'", zero_division) for c in labels],
        _row("'label', 'accuracy'", [none, none, _ratio("(tp + tn)", _TOTAL)], support)
        if whole
        else mean_row("micro avg", "micro"),
        mean_row("macro avg", "macro"),
        mean_row("weighted avg", "weighted"),
    ]
    return f"array({', '.join(rows)})"


def classification_report(
    pairs: DataFrame,
    labels: Sequence[int] | None = None,
    zero_division: float = 0.0,
    positive_label: Any = True,
) -> DataFrame:
    """The report as rows: classes, accuracy, macro average and weighted average."""
    counts = confusion_counts(pairs, positive_label)
    return counts.select(F.expr(f"inline({_report(tuple(labels or CLASSES), zero_division)})"))
