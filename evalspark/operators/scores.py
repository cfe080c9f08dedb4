"""Scores: normal form, run diffs under one ruler, stability bars."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalspark.functions.hashing import content_hash
from evalspark.functions.stats import reporting_probability, required_successes, threshold_strictness
from evalspark.functions.text import blank_to_null


class RulerError(ValueError):
    """Two runs weren't graded by the same standard."""


# What makes a score, and which way is better.
KINDS, DIRECTIONS = ("code", "llm", "human"), ("maximize", "minimize")
SCORES = """name string, evaluator_id string, evaluator_version string, kind string, direction string, score double, label string,
    explanation string, evidence string, world struct<name:string,revision:string,content_hash:string>, dataset string, case_id string, run_id string"""


def normalize_scores(scores: DataFrame) -> DataFrame:
    """Blank texts become null; a score that isn't finite raises an error."""
    bad = F.isnan("score") | (F.abs("score") == float("inf"))
    fixed = {c: blank_to_null(c) for c in ("dataset", "case_id", "run_id", "label", "explanation") if c in scores.columns}
    return scores.withColumns(fixed | {"score": F.when(bad, F.raise_error(F.lit("a score must be finite")).cast("double")).otherwise(F.col("score"))})


def score_rows(df: DataFrame, scored: Column, *, name: str, evaluator_id: str, evaluator_version: str = "1", kind: str = "code", direction: str = "maximize", **own: Column) -> DataFrame:
    """Rows of the normal form SCORES from a metric's struct of score, label and what they rest on, which becomes the evidence as JSON.

    own gives the other columns: explanation, world, dataset, case_id, run_id; those not given are null.
    """
    if kind not in KINDS or direction not in DIRECTIONS or not (name.strip() and evaluator_id.strip() and evaluator_version.strip()):
        raise ValueError("a score needs names, a known kind and a direction")
    parts = [f.name for f in df.select(scored.alias("s")).schema["s"].dataType.fields if f.name not in ("score", "label")]
    s = F.col("_scored")
    evidence = F.to_json(F.struct(*(s[n].alias(n) for n in parts))) if parts else F.lit("{}")
    fixed = {"name": F.lit(name), "evaluator_id": F.lit(evaluator_id), "evaluator_version": F.lit(evaluator_version), "kind": F.lit(kind), "direction": F.lit(direction), "score": s["score"], "label": s["label"], "evidence": evidence}
    fields = T.StructType.fromDDL(SCORES).fields
    rows = df.withColumn("_scored", scored)
    return normalize_scores(rows.select(*((fixed | own).get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)))


def verdict_scores(verdicts: DataFrame) -> DataFrame:
    return verdicts.select("case_id", (F.col("verdict") == "correct").cast("double").alias("score"), F.coalesce("subtype", "verdict").alias("label"))


def ruler_paths(ruler: dict[str, Any], at: str = "") -> dict[str, Any]:
    """Leaves by dotted path; sequences are leaves."""
    out: dict[str, Any] = {}
    for k, v in ruler.items():
        path = f"{at}.{k}" if at else k
        if isinstance(v, dict) and v:
            out |= ruler_paths(v, path)
        else:
            out[path] = v
    return out


_SHA = re.compile(r"sha256:[0-9a-f]{64}")


def ruler_violations(ruler: Mapping[str, Any]) -> list[str]:
    """What is wrong with a ruler: criteria that are blank or repeated, identities that are no content hashes."""
    criteria, found = list(ruler.get("criteria") or ()), []
    if not criteria or any(not str(c).strip() for c in criteria):
        found.append("criteria need names")
    if len(set(criteria)) != len(criteria):
        found.append("criteria repeat")
    if not str(ruler.get("taxonomyVersion") or ""):
        found.append("taxonomyVersion is missing")
    for part in ("judgeRubricHashes", "calibrationIds"):
        if any(not k.strip() or not _SHA.fullmatch(str(v)) for k, v in dict(ruler.get(part) or {}).items()):
            found.append(f"{part} must map names to content hashes")
    if ruler.get("freezeId") is not None and not _SHA.fullmatch(str(ruler["freezeId"])):
        found.append("freezeId must be a content hash")
    return found


def ruler_of(artifact: Mapping[str, Any]) -> dict[str, Any]:
    """The ruler that a run's artifact records under ruler, in whole; none, or one that isn't valid, is refused."""
    ruler = artifact.get("ruler")
    if not isinstance(ruler, Mapping):
        raise RulerError("the artifact has no ruler")
    if found := ruler_violations(ruler):
        raise RulerError("the artifact's ruler is not valid: " + "; ".join(found))
    return {"judgeRubricHashes": {}, "calibrationIds": {}, "freezeId": None, **ruler, "criteria": list(ruler["criteria"])}


def compare_rulers(before: Mapping[str, Any] | None, after: Mapping[str, Any] | None) -> dict[str, tuple[Any, Any]]:
    """Changed paths with both values; a missing ruler is refused."""
    if not before or not after:
        raise RulerError("both runs need a recorded ruler")
    a, b = ruler_paths(dict(before)), ruler_paths(dict(after))
    return {p: (a.get(p), b.get(p)) for p in sorted({*a, *b}) if (p in a) != (p in b) or a.get(p) != b.get(p)}


def ruler_fingerprint(ruler: dict[str, Any]) -> str:
    return content_hash(ruler)


def assert_same_ruler(before: dict[str, Any] | None, after: dict[str, Any] | None) -> None:
    if changes := compare_rulers(before, after):
        raise RulerError("; ".join(f"{p}: {x!r} -> {y!r}" for p, (x, y) in changes.items()))


def ruler_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same over frames of (path, value): path, before and after wherever they differ."""
    both = before.select("path", F.col("value").alias("before"), F.lit(True).alias("b")).join(after.select("path", F.col("value").alias("after"), F.lit(True).alias("a")), "path", "full_outer")
    return both.where(F.col("b").isNull() | F.col("a").isNull() | ~F.col("before").eqNullSafe(F.col("after"))).select("path", "before", "after")


def movement(before: Column, after: Column, direction: Column) -> Column:
    better = F.when(direction == "minimize", after < before).otherwise(after > before)
    return F.when(before.isNull() | after.isNull(), "incomparable").when(before == after, "unchanged").when(better, "improved").otherwise("regressed")


def score_violations(before: DataFrame, after: DataFrame, criteria: list[str]) -> DataFrame:
    """(rule, case_id, name) of what a diff refuses: unnamed cases, duplicates, unknown criteria, drift of a judge."""
    sides = before.select("case_id", "name", F.lit("before").alias("side")).union(after.select("case_id", "name", F.lit("after")))
    one = sides.groupBy("side", "case_id", "name").count()
    both = before.alias("b").join(after.alias("a"), ["case_id", "name"])
    drift = lambda c: ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    out = lambda df, rule: df.select(F.lit(rule).alias("rule"), "case_id", "name")
    return (
        out(one.where("case_id IS NULL"), "missing_case_id")
        .union(out(one.where("count > 1"), "duplicate"))
        .union(out(one.where(~F.col("name").isin(criteria)), "unknown_criterion"))
        .union(out(both.where(drift("direction")), "direction"))
        .union(out(both.where(drift("evaluator_id") | drift("evaluator_version")), "evaluator"))
        .distinct()
    )


def diff_criteria(before: DataFrame, after: DataFrame) -> DataFrame:
    """A row for each case and criterion of either run, with its movement; one full outer join."""
    side = lambda df, p: df.select("case_id", "name", F.col("score").alias(f"{p}_score"), F.col("label").alias(f"{p}_label"), F.col("direction").alias(f"{p}_direction"), F.lit(True).alias(p))
    both = side(before, "before").join(side(after, "after"), ["case_id", "name"], "full_outer")
    direction = F.coalesce("before_direction", "after_direction", F.lit("maximize"))
    return both.select("case_id", F.col("name").alias("criterion"), movement(F.col("before_score"), F.col("after_score"), direction).alias("movement"), "before_score", "after_score", "before_label", "after_label", (F.col("before") & F.col("after")).alias("on_both"))


def diff_cases(deltas: DataFrame) -> DataFrame:
    """One bucket a case; criteria that can't be compared count only where all are such."""
    has = lambda m: F.bool_or(F.col("movement") == m)
    sums = deltas.groupBy("case_id").agg(has("improved").alias("i"), has("regressed").alias("r"), has("unchanged").alias("u"))
    bucket = F.when(F.col("i") & F.col("r"), "mixed").when(F.col("r"), "regressed").when(F.col("i"), "improved").when(F.col("u"), "unchanged").otherwise("incomparable")
    return sums.select("case_id", bucket.alias("bucket"))


def transitions(deltas: DataFrame) -> DataFrame:
    name = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("<none>"))
    return deltas.where("on_both").groupBy("criterion", F.concat(name("before_label"), F.lit(" -> "), name("after_label")).alias("transition")).agg(F.count("*").alias("n"))


def diff_scores(before: DataFrame, after: DataFrame, before_ruler: dict[str, Any], after_ruler: dict[str, Any], strict: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Criterion movements, case buckets and label transitions; strict raises what the rulers or scores forbid."""
    assert_same_ruler(before_ruler, after_ruler)
    if strict and (bad := score_violations(before, after, list(before_ruler["criteria"])).take(5)):
        raise ValueError(f"scores can't be compared: {bad}")
    deltas = diff_criteria(before, after)
    return deltas, diff_cases(deltas), transitions(deltas)


def stability_bar(outcomes: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """attempts, successes, required, strictness and passed of each key; null never succeeds."""
    sums = outcomes.groupBy(*keys).agg(F.count("*").alias("attempts"), F.count_if(F.coalesce(success, F.lit(False))).alias("successes"))
    n = F.col("attempts")
    return sums.select(*keys, "attempts", "successes", required_successes(n).alias("required"), threshold_strictness(n).alias("strictness"), (F.col("successes") >= required_successes(n)).alias("passed"))


def score_bar(scores: DataFrame, keys: list[str], score: str, threshold: float, direction: str = "maximize") -> DataFrame:
    return stability_bar(scores, keys, F.col(score) <= threshold if direction == "minimize" else F.col(score) >= threshold)


def n_sensitivity(rates: DataFrame, rate: str, sizes: list[int]) -> DataFrame:
    """A row for each rate and size with the chance of passing the bar."""
    spread = rates.withColumn("attempts", F.explode(F.array(*map(F.lit, sizes))))
    n = F.col("attempts")
    return spread.select(*rates.columns, "attempts", required_successes(n).alias("required"), threshold_strictness(n).alias("strictness"), reporting_probability(F.col(rate), n).alias("reporting_probability"))
