"""Relations of an observed set to an expected one, and their precision and recall."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relation_of_counts(observed: Column, expected: Column, both: Column) -> Column:
    """The relation from sizes: of the observed set, the expected set and what they share."""
    return (
        F.when((observed == both) & (expected == both), "exact")
        .when(observed == 0, "empty_wrong")
        .when(observed == both, "subset")
        .when(expected == both, "superset")
        .when(both > 0, "overlap")
        .otherwise("disjoint")
    )


def scores_of_counts(observed: Column, expected: Column, both: Column) -> dict[str, Column]:
    """Precision, recall and F1; an empty observed set has precision 1 only where nothing is expected."""
    p = F.when(observed > 0, both / F.nullif(observed, F.lit(0))).otherwise((expected == 0).cast("double"))
    r = F.when(expected > 0, both / F.nullif(expected, F.lit(0))).otherwise(1.0)
    return {"precision": p, "recall": r, "f1": F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)}


def _sizes(observed: Column, expected: Column) -> tuple[Column, Column, Column]:
    return F.size(F.array_distinct(observed)), F.size(F.array_distinct(expected)), F.size(F.array_intersect(observed, expected))


def set_relation(observed: Column, expected: Column) -> Column:
    return relation_of_counts(*_sizes(observed, expected))


def set_scores(observed: Column, expected: Column) -> dict[str, Column]:
    return scores_of_counts(*_sizes(observed, expected))
