"""Scores of single metrics: a struct of score, label and what they rest on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.jsonwalk import forbidden_value, schema_errors
from evalspark.functions.sets import set_relation, set_scores
from evalspark.functions.spans import match_spans, precision_recall_f1
from evalspark.functions.text import contains_write_verb, exact_match, matches_regex


def _score(passed: Column, label: Column, **evidence: Column) -> Column:
    return F.struct(F.coalesce(passed, F.lit(False)).cast("double").alias("score"), label.alias("label"), *(c.alias(n) for n, c in evidence.items()))


def id_set_score(observed: Column, expected: Column) -> Column:
    """1 for equal sets of ids, which are taken as they are; the label is the relation."""
    relation = set_relation(observed, expected)
    return _score(relation == "exact", relation, **set_scores(observed, expected))


def match_score(observed: Column, expected: Column, case_sensitive: bool = True) -> Column:
    hit = F.coalesce(exact_match(observed, expected, case_sensitive), F.lit(False))
    return _score(hit, F.when(hit, "match").otherwise("mismatch"))


def regex_score(observed: Column, pattern: str, full_match: bool = False, flags: int = 0) -> Column:
    hit = F.coalesce(matches_regex(observed, pattern, full_match, flags), F.lit(False))
    return _score(hit, F.when(hit, "match").otherwise("mismatch"))


def span_f1_score(expected: Column, predicted: Column, minimum_iou: float = 0.5) -> Column:
    """The F1 of matched spans; the label is exact only where all match."""

    def scored(tp: Column) -> Column:
        fp, fn = F.size(predicted) - tp, F.size(expected) - tp
        parts = precision_recall_f1(tp, fp, fn)
        named = {"true_positive": tp, "false_positive": fp, "false_negative": fn, "minimum_iou": F.lit(float(minimum_iou)), **parts}
        return F.struct(parts["f1"].alias("score"), F.when(parts["f1"] == 1, "exact").otherwise("mismatch").alias("label"), *(c.alias(n) for n, c in named.items()))

    # Within an array's function the matching is worked out once, however often its result is used.
    return F.transform(F.array(match_spans(expected, predicted, minimum_iou)), scored)[0]


def schema_score(payload: Column, schema: dict) -> Column:
    errors = schema_errors(payload, schema)
    return _score(F.size(errors) == 0, F.when(F.size(errors) == 0, "valid").otherwise("invalid"), errors=errors)


def safety_score(query: Column, payload: Column, forbidden: list[str]) -> Column:
    """A query with a write verb and a JSON payload with a forbidden scalar are unsafe; a null one raises no flag."""
    tests = {"write_attempt": contains_write_verb(query), "forbidden_value": forbidden_value(payload, forbidden)}
    flags = F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda x: x.isNotNull())
    safe = F.size(flags) == 0
    return _score(safe, F.when(safe, "safe").otherwise("unsafe"), flags=flags)


def safety_scores(cases: DataFrame, key: str, query: str, payload: str, forbidden: list[str]) -> DataFrame:
    """key, score, label and flags of each case, in one scan."""
    return cases.select(key, safety_score(F.col(query), F.col(payload), forbidden).alias("_s")).select(key, "_s.*")
