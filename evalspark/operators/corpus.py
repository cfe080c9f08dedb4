"""Corpora under review: manifests, reviews, freezes, rubrics."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.hashing import canonical_json, content_hash

# Names that no reviewer has, and words of which a reviewing model's name holds one.
PLACEHOLDERS = ("pending", "pending audit", "pending human review", "pending llm audit", "pending review", "tbd", "unknown")
MODEL_WORDS = r"model|llm|gpt|claude|gemini|llama|mistral|qwen|judge|evaluator|sonnet|opus|grok|deepseek|command|nova|phi|o[1-9]"

#: Short rubrics of our own: labels with their scores, and the placeholders of the prompt.
RUBRICS: dict[str, dict[str, Any]] = {
    "hallucination": {"direction": "minimize", "choices": {"hallucinated": 1.0, "grounded": 0.0}, "prompt": "Question: {{input}}\nContext: {{reference}}\nAnswer: {{output}}\nIs every claim of the answer supported by the context?"},
    "tool_selection": {"direction": "maximize", "choices": {"correct": 1.0, "incorrect": 0.0}, "prompt": "Request: {{input}}\nTools: {{tools}}\nChosen: {{output}}\nIs the chosen tool the right one?"},
    "tool_invocation": {"direction": "maximize", "choices": {"correct": 1.0, "incorrect": 0.0}, "prompt": "Request: {{input}}\nTools: {{tools}}\nCall: {{output}}\nAre the call's arguments right and complete?"},
    "tool_response_handling": {"direction": "maximize", "choices": {"correct": 1.0, "incorrect": 0.0}, "prompt": "Call and result: {{input}}\nReply: {{output}}\nDoes the reply use the result rightly?"},
    "user_friction": {"direction": "minimize", "choices": {"friction": 1.0, "no_friction": 0.0}, "prompt": "Conversation: {{input}}\nDid the user meet an obstacle?"},
}


def available_rubrics() -> tuple[str, ...]:
    return tuple(sorted(RUBRICS))


def rubric_violations(rubric: Mapping[str, Any]) -> list[str]:
    """What is wrong with a rubric: its direction, an empty prompt, choices without labels, scores that aren't finite."""
    found = [] if rubric.get("direction") in ("maximize", "minimize") else ["direction"]
    found += [] if str(rubric.get("prompt") or "").strip() else ["prompt"]
    choices = rubric.get("choices") or {}
    found += [] if choices and all(str(k).strip() for k in choices) else ["choices"]
    bad = [k for k, v in choices.items() if v is not None and not (isinstance(v, (int, float)) and math.isfinite(v))]
    return found + [f"score of {k!r}" for k in bad]


def load_rubric(name: str) -> dict[str, Any]:
    """One of the seeds by its name; ValueError for what is no name, KeyError for an unknown one."""
    if not re.fullmatch(r"[a-z][a-z0-9_]*", name):
        raise ValueError(f"not a rubric's name: {name!r}")
    rubric = RUBRICS[name]
    if found := rubric_violations(rubric):
        raise ValueError(f"{name}: {', '.join(found)}")
    return rubric


def substitute(rubric: Mapping[str, Any], names: Mapping[str, str]) -> dict[str, Any]:
    """The rubric with its prompt's placeholders renamed to a dataset's fields."""
    prompt = re.sub(r"\{\{\s*([\w.-]+)\s*\}\}", lambda m: "{{" + names.get(m[1], m[1]) + "}}", rubric["prompt"])
    return {**rubric, "prompt": prompt}


def clean_reviewer(name: Column) -> Column:
    """White space collapsed; null for a placeholder, a name of under 3 or over 200 characters, or one that names no model."""
    text = F.trim(F.regexp_replace(name, r"(?U)\s+", " "))
    fits = F.length(name).between(3, 200) & ~F.lower(text).isin(*PLACEHOLDERS) & text.rlike(rf"(?iU)\b({MODEL_WORDS})\b")
    return F.when(fits, text)


def review_complete() -> Column:
    """A checklist is blessed with every check true; an annotation is approved."""
    checklist = F.coalesce("blessed", F.lit(False)) & F.coalesce(F.forall(F.map_values("checks"), lambda x: F.coalesce(x, F.lit(False))), F.lit(False))
    return F.when(F.col("profile") == "checklist", checklist).otherwise(F.coalesce(F.col("review_status") == "approved", F.lit(False)))


def manifest_violations(cases: DataFrame, reviews: DataFrame) -> DataFrame:
    """(case_id, rule) for each case without exactly one complete review by a named reviewer, and each review without a case."""
    sums = reviews.withColumn("ok", review_complete()).withColumn("named", clean_reviewer(F.col("reviewer")).isNotNull()).groupBy("case_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"), F.bool_and("named").alias("named"))
    both = cases.select("case_id", F.lit(True).alias("known")).join(sums, "case_id", "full_outer")
    rules = {"no_review": F.col("n").isNull(), "no_case": F.col("known").isNull(), "many_reviews": F.col("n") > 1, "incomplete": ~F.col("ok"), "unnamed_reviewer": ~F.col("named")}
    found = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in rules.items()]), lambda x: x.isNotNull())
    return both.select("case_id", F.explode(found).alias("rule"))


def count_violations(counts: Mapping[str, int], total: int) -> list[str]:
    """What is wrong with a manifest's counts: none, names, signs, sum."""
    found = [] if counts else ["no counts"]
    found += [f"count {k!r}" for k, v in counts.items() if not k.strip() or v < 0]
    return found + ([f"sum {sum(counts.values())} is not {total}"] if sum(counts.values()) != total else [])


def corpus_violations(manifest: Mapping[str, Any], reviews: DataFrame) -> DataFrame:
    """(case_id, rule) of all that is wrong with a manifest and its reviews; the manifest's own rules have a null case.

    The manifest holds profile, required_checks, expected_total, counts and
    category_counts.  Reviews of a case are summed up, so none is gathered.
    """
    spark, required, total = reviews.sparkSession, list(manifest.get("required_checks", ())), manifest["expected_total"]
    checklist = manifest["profile"] == "checklist"
    own = {
        "counts": bool(count_violations(manifest["counts"], total)),
        "category_counts": bool(count_violations(manifest["category_counts"], total)),
        "required_checks_missing": checklist and not required,
        "required_checks_unexpected": not checklist and bool(required),
        "required_checks_names": len(set(required)) != len(required) or any(not r.strip() for r in required),
        "expected_total": total < 1,
    }
    named = F.array(*map(F.lit, required)).cast("array<string>")
    given = F.map_keys(F.coalesce("checks", F.create_map().cast("map<string,boolean>")))
    other = (F.size(F.array_except(named, given)) > 0) | (F.size(F.array_except(given, named)) > 0)
    sums = reviews.groupBy("case_id").agg(
        F.count("*").alias("n"),
        F.bool_and(F.col("profile") == manifest["profile"]).alias("profile"),
        F.bool_or((F.col("profile") == "checklist") & other).alias("checks"),
        F.bool_and(review_complete()).alias("ok"),
        F.bool_and(clean_reviewer(F.col("reviewer")).isNotNull()).alias("named"),
    )
    rules = {"many_reviews": F.col("n") > 1, "other_profile": ~F.coalesce("profile", F.lit(False)), "checks": F.col("checks"), "incomplete": ~F.col("ok"), "unnamed_reviewer": ~F.col("named")}
    found = F.filter(F.array(*[F.when(t, F.lit(r)) for r, t in rules.items()]), lambda x: x.isNotNull())
    count = reviews.agg(F.count("*").alias("n")).where(F.col("n") != total).select(F.lit(None).cast(reviews.schema["case_id"].dataType).alias("case_id"), F.lit("reviews_total").alias("rule"))
    mine = spark.createDataFrame([(r,) for r, bad in own.items() if bad], "rule string").select(F.lit(None).cast(reviews.schema["case_id"].dataType).alias("case_id"), "rule")
    return sums.select("case_id", F.explode(found).alias("rule")).union(count).union(mine)


_SHA = re.compile(r"sha256:[0-9a-f]{64}")


def build_freeze(config: Mapping[str, Any], sources: Mapping[str, str | bytes], corpus_hash: str, world: Mapping[str, str], created_at: datetime, hypotheses: Sequence[Mapping[str, Any]] = ()) -> dict[str, Any]:
    """The hashes of everything that a run depends on, with an id over all of them.

    world has name, revision and contentHash; a time without a zone, a blank
    source name, no source, or an identity that is no content hash is refused.
    """
    if created_at.tzinfo is None or created_at.utcoffset() is None:
        raise ValueError("created_at needs a time zone")
    if not sources or any(not n.strip() for n in sources):
        raise ValueError("sources need names")
    if not _SHA.fullmatch(corpus_hash) or not _SHA.fullmatch(str(world.get("contentHash"))):
        raise ValueError("the corpus and the world are named by content hashes")
    if not str(world.get("name") or "").strip() or not str(world.get("revision") or "").strip():
        raise ValueError("the world needs a name and a revision")
    text = lambda x: x.decode("utf-8") if isinstance(x, bytes) else x
    body = {
        "schemaVersion": "evalspark-freeze/v1",
        "createdAt": created_at.isoformat(),
        "configHash": content_hash(config),
        "corpusHash": corpus_hash,
        "sourceHashes": {n: content_hash({"source": text(sources[n])}) for n in sorted(sources)},
        "world": {"revisions": {}, **world},
        "hypotheses": [dict(h) for h in hypotheses],
        "config": dict(config),
    }
    return {"manifestId": content_hash(body), **body}


def render_preregistration(freeze: Mapping[str, Any]) -> str:
    """The freeze for people: its hashes, sources and hypotheses in Markdown."""
    lines = [f"# Preregistration {freeze['manifestId']}", "", f"- created {freeze['createdAt']}", f"- world {freeze['world']['name']} at {freeze['world']['revision']}", f"- configuration {freeze['configHash']}", f"- corpus {freeze['corpusHash']}", "", "## Sources", ""]
    lines += [f"- {n}: {h}" for n, h in freeze["sourceHashes"].items()]
    stated = [f"- {h.get('id') or 'no id'}: {h.get('statement') or canonical_json(h)}" for h in freeze["hypotheses"]]
    return "\n".join([*lines, "", "## Hypotheses", "", *(stated or ["- none"]), ""])


def preregistration_files(freeze: Mapping[str, Any]) -> dict[str, str]:
    """The contents of the two files by name; whoever calls writes them."""
    return {"preregistration.json": canonical_json(freeze) + "\n", "preregistration.md": render_preregistration(freeze)}
