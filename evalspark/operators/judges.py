"""Judges that ask an injected model: closed answers, one repair, a licence before any call."""

from __future__ import annotations

import asyncio
import functools
import inspect
from collections.abc import Awaitable, Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.functions.hashing import canonical_json, content_hash
from evalspark.functions.text import render
from evalspark.operators.calibration import UncalibratedJudgeError, assert_licensed
from evalspark.operators.corpus import substitute

#: A message has a role and a content.
Message = Mapping[str, str]
#: Asks a model: (messages, operation) to the object it answers with, or to a coroutine that gives it.
Ask = Callable[[list[Message], str], Any]
#: Cases that are asked before their answers leave a task.
ROWS = 256

# The parts of a finding, and the severities where none are named.
FINDING = ("criterion", "severity", "locality", "evidence", "complaint")
SEVERITIES = ("fatal", "weak", "nit")


def _closed(names: Sequence[str], what: str) -> tuple[str, ...]:
    if not names or len(set(names)) != len(names) or any(not n.strip() for n in names):
        raise ValueError(f"{what} must be unique names that aren't blank")
    return tuple(names)


@dataclass(frozen=True)
class ChoiceRubric:
    """One label out of choices, each with its score or none."""

    choices: Mapping[str, float | None]
    prompt: str = ""
    direction: str = "maximize"
    explanation: bool = True

    mode = "choice"
    columns = "label string, score double, explanation string"

    def __post_init__(self) -> None:
        _closed(list(self.choices), "labels")

    @property
    def rubric_hash(self) -> str:
        return content_hash({"mode": self.mode, "choices": self.choices, "direction": self.direction, "explanation": self.explanation, "prompt": self.prompt})

    def errors(self, answer: Any) -> list[str]:
        keys = {"label", "explanation"} if self.explanation else {"label"}
        if not isinstance(answer, Mapping) or set(answer) != keys:
            return [f"the answer must be an object of exactly {', '.join(sorted(keys))}"]
        label, why = answer["label"], answer.get("explanation")
        found = [] if isinstance(label, str) and label in self.choices else [f"label must be one of {', '.join(self.choices)}"]
        return found + ([] if isinstance(why, (str, type(None))) else ["explanation must be text or null"])

    def row(self, answer: Mapping[str, Any] | None) -> tuple:
        if answer is None:
            return None, None, None
        return answer["label"], self.choices[answer["label"]], answer.get("explanation")


@dataclass(frozen=True)
class FindingsRubric:
    """Findings in closed vocabularies, and the criteria that are met."""

    criteria: Sequence[str]
    localities: Sequence[str]
    severities: Sequence[str] = SEVERITIES
    prompt: str = ""

    mode = "findings"
    columns = f"findings array<struct<{', '.join(f'{n}: string' for n in FINDING)}>>, met array<string>"

    def __post_init__(self) -> None:
        for what in ("criteria", "localities", "severities"):
            _closed(getattr(self, what), what)

    @property
    def rubric_hash(self) -> str:
        return content_hash({"mode": self.mode, "criteria": self.criteria, "localities": self.localities, "severities": self.severities, "prompt": self.prompt})

    def errors(self, answer: Any) -> list[str]:
        if not isinstance(answer, Mapping) or set(answer) != {"findings", "met"}:
            return ["the answer must be an object of exactly findings and met"]
        if not isinstance(answer["findings"], list) or not isinstance(answer["met"], list):
            return ["findings and met must be arrays"]
        found = []
        closed = {"criterion": self.criteria, "severity": self.severities, "locality": self.localities}
        for i, one in enumerate(answer["findings"]):
            if not isinstance(one, Mapping) or set(one) != set(FINDING) or not all(isinstance(v, str) and v for v in one.values()):
                found.append(f"finding {i} must hold the texts {', '.join(FINDING)} and nothing else")
            else:
                found += [f"finding {i}: unknown {k} {one[k]!r}" for k, names in closed.items() if one[k] not in names]
        if any(not isinstance(m, str) or m not in self.criteria for m in answer["met"]):
            found.append("met holds an unknown criterion")
        return found

    def row(self, answer: Mapping[str, Any] | None) -> tuple:
        """A criterion with a finding isn't met, whatever the answer says."""
        if answer is None:
            return None, None
        faulted = {f["criterion"] for f in answer["findings"]}
        return [dict(f) for f in answer["findings"]], [m for m in dict.fromkeys(answer["met"]) if m not in faulted]


Rubric = ChoiceRubric | FindingsRubric


def _caller(ask: Ask) -> Callable[..., Awaitable[Any]]:
    """A coroutine function for a port of either kind; calls of a plain one go to threads."""
    if inspect.iscoroutinefunction(ask) or inspect.iscoroutinefunction(getattr(ask, "__call__", None)):
        return ask
    return functools.partial(asyncio.to_thread, ask)


async def ask_with_repair(ask: Callable[..., Awaitable[Any]], rubric: Rubric, messages: Sequence[Message], operation: str) -> tuple[Mapping[str, Any] | None, int]:
    """The answer and the number of calls; an answer off the rubric is sent back once, a second one gives None."""
    answer = await ask(list(messages), operation)
    if not (errors := rubric.errors(answer)):
        return answer, 1
    complaint = f"This is not within the rubric: {'; '.join(errors)}. Give a corrected object and nothing else."
    again = [*messages, {"role": "assistant", "content": canonical_json(answer)}, {"role": "user", "content": complaint}]
    answer = await ask(again, f"{operation}.repair")
    return (None if rubric.errors(answer) else answer), 2


def prompt_messages(prompts: DataFrame, rubric: Rubric) -> Column:
    """The messages of a row: the rubric's prompt filled from the column inputs, then those of the columns messages and prompt, as they are.

    Columns that aren't there add nothing, and without inputs the rubric's prompt
    isn't sent.  A name that inputs lacks raises an error; a null prompt is empty.
    """
    kind = "array<struct<role:string,content:string>>"
    user = lambda c: F.array(F.struct(F.lit("user").alias("role"), c.alias("content"))).cast(kind)
    parts = []
    if "inputs" in prompts.columns and rubric.prompt:
        parts.append(user(render(F.lit(rubric.prompt), F.col("inputs"))))
    if "messages" in prompts.columns:
        parts.append(F.coalesce(F.col("messages").cast(kind), F.array().cast(kind)))
    if "prompt" in prompts.columns:
        parts.append(user(F.coalesce("prompt", F.lit(""))))
    if not parts:
        raise ValueError("prompts need a column inputs, messages or prompt")
    return F.concat(*parts)


def judge(
    prompts: DataFrame, port: Callable[[], Ask], rubric: Rubric, *, evaluator_id: str, evaluator_version: str, operation: str = "judge",
    reports: DataFrame | None = None, allow_uncalibrated: bool = False, calibrating: bool = False, concurrency: int = 8,
) -> DataFrame:
    """Asks the model about each case_id, one row each with the rubric's columns, status, attempts and error.

    What is asked are the messages of prompt_messages().  Before any call, a
    passing report of this very evaluator and rubric must be among reports,
    unless allow_uncalibrated says otherwise, which the status records.  status
    is calibrated or uncalibrated, refused after two answers off the rubric, or
    failed where a port raised an error while calibrating; at other times such
    errors stop the job.

    port() is called once a task, and what it gives is asked with (messages,
    operation), up to concurrency cases at a time; it may be a plain or a
    coroutine function.  A task may run again, so ports must be idempotent.
    """
    if not (evaluator_id.strip() and evaluator_version.strip() and operation.strip()):
        raise ValueError("a judge needs an id, a version and an operation")
    if concurrency < 1:
        raise ValueError("at least one case is asked at a time")
    if not calibrating and not allow_uncalibrated:
        if reports is None:
            raise UncalibratedJudgeError(f"{evaluator_id}@{evaluator_version} has no calibration")
        assert_licensed({"evaluator_id": evaluator_id, "evaluator_version": evaluator_version, "rubric_hash": rubric.rubric_hash}, reports)
    licence = "uncalibrated" if calibrating or allow_uncalibrated else "calibrated"
    names = [c.split(" ", 1)[0] for c in _columns(rubric.columns)]

    async def one(ask: Callable[..., Awaitable[Any]], gate: asyncio.Semaphore, case: str, messages: list[Message]) -> tuple:
        async with gate:
            try:
                answer, calls = await ask_with_repair(ask, rubric, messages, operation)
                status, error = ("refused", "off the rubric after repair") if answer is None else (licence, None)
            except Exception as problem:  # a calibration records it as an answer that isn't available
                if not calibrating:
                    raise
                answer, calls, status, error = None, None, "failed", f"{type(problem).__name__}: {problem}"
        return case, *rubric.row(answer), status, calls, error

    async def some(ask: Callable[..., Awaitable[Any]], cases: Iterable[str], asked: Iterable[list]) -> list[tuple]:
        gate = asyncio.Semaphore(concurrency)
        return await asyncio.gather(*(one(ask, gate, case, [dict(m) for m in messages]) for case, messages in zip(cases, asked, strict=True)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = _caller(port())
        for frame in frames:
            for at in range(0, len(frame), ROWS):
                part = frame.iloc[at : at + ROWS]
                yield pd.DataFrame(asyncio.run(some(ask, part["case_id"], part["messages"])), columns=["case_id", *names, "status", "attempts", "error"])

    rows = prompts.select(F.col("case_id").cast("string").alias("case_id"), prompt_messages(prompts, rubric).alias("messages"))
    return rows.mapInPandas(run, f"case_id string, {rubric.columns}, status string, attempts int, error string")


def _columns(ddl: str) -> list[str]:
    return ddl.split(", ") if "<" not in ddl else ["findings", "met"]


def calibration_outcomes(records: DataFrame, answers: DataFrame, mode: str) -> DataFrame:
    """records (record_id, expected_label or expected_findings) beside a judge's answers, as calibrate() takes them."""
    got = "label" if mode == "choice" else "findings"
    found = answers.select(answers["case_id"].alias("record_id"), answers[got].alias(f"actual_{got}"), answers["error"], (~answers["status"].isin("refused", "failed")).alias("available"))
    return records.join(found, "record_id", "left").na.fill(False, ["available"])


def judge_rubric(seed: Mapping[str, Any], names: Mapping[str, str] | None = None) -> ChoiceRubric:
    """The rubric of one of the seeds, its placeholders renamed to a dataset's fields."""
    own = substitute(seed, names or {})
    return ChoiceRubric(own["choices"], own["prompt"], own["direction"])
