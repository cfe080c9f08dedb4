"""Spans of text: overlap, one-to-one matching, F1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_iou(a: Column, b: Column) -> Column:
    """Intersection over hull of two structs with start and end."""
    shared = F.greatest(F.lit(0), F.least(a["end"], b["end"]) - F.greatest(a["start"], b["start"]))
    hull = F.greatest(a["end"], b["end"]) - F.least(a["start"], b["start"])
    return F.when(hull == 0, 0.0).otherwise(shared / F.nullif(hull, F.lit(0)))


def span_violation(span: Column) -> Column:
    """Why a struct with start and end is no span, else null: it must begin at 0 or later and hold something."""
    return F.when(span["start"].isNull() | span["end"].isNull(), "no bounds").when(span["start"] < 0, "negative start").when(span["end"] <= span["start"], "empty")


def checked_spans(spans: Column) -> Column:
    """The array of spans; one that is none raises an error."""
    bad = F.exists(spans, lambda s: span_violation(s).isNotNull())
    return F.when(bad, F.raise_error(F.lit("a span must begin at 0 or later and hold something"))).otherwise(spans)


def match_spans(expected: Column, predicted: Column, minimum_iou: float = 0.5) -> Column:
    """Matched pairs: best overlap first, of equal ones the later gold and then the later guess; a null label fits any.

    expected and predicted are arrays of structs (start, end, label).
    """
    if not 0 <= minimum_iou <= 1:
        raise ValueError("the least overlap lies between 0 and 1")
    index = lambda spans: F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"), i.alias("i")))
    fits = lambda g, p: g["label"].isNull() | p["label"].isNull() | (g["label"] == p["label"])
    pairs = F.flatten(F.transform(index(expected), lambda g: F.transform(F.filter(index(predicted), lambda p: fits(g, p) & (span_iou(g, p) >= minimum_iou)), lambda p: F.struct(span_iou(g, p).alias("iou"), g["i"].alias("g"), p["i"].alias("p")))))
    none = F.expr("CAST(array() AS array<int>)")
    start = F.struct(none.alias("g"), none.alias("p"))
    taken = lambda acc, x: F.array_contains(acc["g"], x["g"]) | F.array_contains(acc["p"], x["p"])
    step = lambda acc, x: F.when(taken(acc, x), acc).otherwise(F.struct(F.array_append(acc["g"], x["g"]).alias("g"), F.array_append(acc["p"], x["p"]).alias("p")))
    return F.aggregate(F.sort_array(pairs, False), start, step, lambda acc: F.size(acc["g"]))


def precision_recall_f1(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    """An empty denominator gives 1; a negative count raises an error."""
    bad = F.least(tp, fp, fn) < 0
    tp = F.when(bad, F.raise_error(F.lit("counts can't be negative")).cast("int")).otherwise(tp)
    p = F.when(tp + fp > 0, tp / F.nullif(tp + fp, F.lit(0))).otherwise(1.0)
    r = F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0))).otherwise(1.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)}
