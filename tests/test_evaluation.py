"""The evaluation operators on small frames, and every query against its SQL."""

import itertools
import json
import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from evalspark.functions import hashing, jsonwalk, sets, spans, stats, text
from evalspark.operators import calibration, compare, corpus, judges, metrics, scores
from evalspark.plans import QUERIES, SQL
from evalspark.sources import ledger

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = sorted(c[0] for c in want.description)
    pick = lambda row, names: tuple(row[names.index(c)] for c in columns)
    names = [c[0] for c in want.description]
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert Counter(pick(r, names) for r in want.fetchall()) == Counter(pick(tuple(r), got.columns) for r in got.collect())


def test_spans_of_all_orders(spark):
    orders = spark.read.parquet(f"{DATA}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderstatus").collect()
    iou = lambda a, b: max(0, 8 - abs(a - b)) / (8 + abs(a - b))
    want, pairs = {}, {}
    for c in {o.o_custkey for o in orders}:
        gold, guess = (sorted(o.o_orderkey % 40 for o in orders if o.o_custkey == c and o.o_orderstatus == s) for s in "FO")
        every = sorted(((iou(a, b), i, j) for i, a in enumerate(gold) for j, b in enumerate(guess)), reverse=True)
        left, right = set(), set()
        for x, i, j in every:
            if x >= 0.3 and i not in left and j not in right:
                left.add(i)
                right.add(j)
        want[c] = (len(left), len(guess) - len(left), len(gold) - len(left))
        if every:
            pairs[c] = (len(every), round(every[0][0], 9))
    assert {r.case_id: (r.tp, r.fp, r.fn) for r in QUERIES["q22_span_f1"](spark, DATA).collect()} == want
    assert {r.case_id: (r.pairs, r.best_iou) for r in QUERIES["q22_span_overlap"](spark, DATA).collect()} == pairs


def test_sort_column_of_all_orders(spark):
    lists = {}
    for o in sorted(spark.read.parquet(f"{DATA}/orders.parquet").collect(), key=lambda o: o.o_orderkey):
        lists.setdefault(str(o.o_custkey), []).append(o.o_totalprice // 100000)
    rises = lambda x: any(b > a for a, b in itertools.pairwise(x))
    assert any(rises(x) and not rises(x[:3]) for x in lists.values())
    want = {c: ("silent_wrong", "wrong_order") if rises(x) else ("correct", None) for c, x in lists.items()}
    rows = QUERIES["q06_ordered_sort_column"](spark, DATA).collect()
    assert len(rows) == len(want) and {r.case_id: (r.verdict, r.subtype) for r in rows} == want


def test_streaming_equals_batch(spark):
    batch = QUERIES["q17_ledger_checkpoints"](spark, DATA).collect()
    assert Counter(map(tuple, QUERIES["q32_stream_checkpoints"](spark, DATA).collect())) == Counter(map(tuple, batch))


def test_every_pair_of_subsets(spark):
    some = [list(c) for n in range(4) for c in itertools.combinations("abc", n)]
    df = spark.createDataFrame([(a, b) for a in some for b in some], "o array<string>, e array<string>")
    for o, e, rel, f1 in df.select("o", "e", sets.set_relation(df.o, df.e), sets.set_scores(df.o, df.e)["f1"]).collect():
        x, y = set(o), set(e)
        want = "exact" if x == y else "empty_wrong" if not x else "subset" if x < y else "superset" if x > y else "overlap" if x & y else "disjoint"
        assert rel == want and (f1 == 1) == (x == y)


def test_numbers_and_keys(spark):
    cells = {" 1,234.5% ": 1234.5, "1_000": 1000.0, "1d": None, "0x1p3": None, "nan": None, "inf": None, "1e999": None, "-.5": -0.5, "": None, "12 %": 12.0}
    df = spark.createDataFrame([(k,) for k in cells], "x string")
    assert {r[0]: r[1] for r in df.select("x", text.numeric("x")).collect()} == cells
    keys = {"North America": "northamerica", "Straße ſﬁ": "strassesfi", None: "none", "-5": "5"}
    df = spark.createDataFrame([(k,) for k in keys], "x string")
    assert {r[0]: r[1] for r in df.select("x", text.normalize_key("x")).collect()} == keys


def test_write_verbs(spark):
    cases = {"SELECT 'DELETE'": False, "SELECT 1 -- drop": False, "select 1; Drop table t": True, "created": False, None: False}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r[0]: r[1] for r in df.select("x", text.contains_write_verb("x")).collect()} == cases


def test_spans(spark):
    kind = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([([(0, 10, None)], [(1, 9, None), (20, 25, None)]), ([(0, 5, "a")], [(0, 5, "b")]), ([], [])], f"g {kind}, p {kind}")
    tp = spans.match_spans(df.g, df.p)
    assert [r[0] for r in df.select(tp).collect()] == [1, 0, 0]
    row = df.select(spans.precision_recall_f1(tp, F.size("p") - tp, F.size("g") - tp)["f1"]).collect()
    assert [round(r[0], 6) for r in row] == [round(2 / 3, 6), 0.0, 1.0]


def test_stability(spark):
    df = spark.range(1, 8)
    assert [r[0] for r in df.select(stats.required_successes(df.id)).orderBy("id").collect()] == [1, 2, 2, 3, 4, 4, 5]
    df = spark.createDataFrame([(0.5, 3), (0.0, 3), (1.0, 3), (0.7, 200)], "r double, n int")
    got = [r[0] for r in df.select(stats.reporting_probability(df.r, df.n)).collect()]
    assert got == pytest.approx([0.5, 0, 1, sum(math.comb(200, k) * 0.7**k * 0.3 ** (200 - k) for k in range(134, 201))])


def test_hashes(spark):
    df = spark.createDataFrame([('a"b\n', ["x", "é"])], "c string, r array<string>")
    assert df.select(hashing.revision_identity(df.c, df.r)).first()[0] == hashing.content_hash({"case": 'a"b\n', "revisions": ["x", "é"]})
    with pytest.raises(ValueError):
        hashing.canonical_json(float("nan"))


def test_schema_errors(spark):
    schema = {"type": "object", "required": ["id"], "additionalProperties": False, "properties": {"id": {"type": "integer"}}}
    df = spark.createDataFrame([('{"id":7}',), ('{"id":"x","y":1}',), ("{",)], "j string")
    assert [len(r[0]) for r in df.select(jsonwalk.schema_errors(df.j, schema)).collect()] == [0, 2, 1]
    with pytest.raises(ValueError):
        jsonwalk.schema_errors(df.j, {"format": "date"})


def test_schema_keywords(spark):
    cases = [
        ({"maxLength": 2, "pattern": "^a"}, '"bcd"', 2), ({"maxLength": 3, "pattern": "^a"}, '"abc"', 0), ({"maxLength": 1}, "12345", 0),
        ({"exclusiveMinimum": 3, "exclusiveMaximum": 5}, "3", 1), ({"exclusiveMinimum": 3, "exclusiveMaximum": 5}, "4", 0), ({"multipleOf": 0.5}, "1.75", 1), ({"multipleOf": 0.5}, "2.5", 0),
        ({"minItems": 2, "items": {"type": "integer"}}, '["x"]', 2), ({"maxItems": 1}, "[1, 2]", 1), ({"minProperties": 1}, "{}", 1), ({"maxProperties": 1}, '{"a": 1}', 0),
        ({"allOf": [{"minimum": 2}, {"maximum": 0}]}, "1", 2), ({"anyOf": [{"type": "string"}, {"type": "null"}]}, "1", 1), ({"anyOf": [{"type": "string"}, {"type": "null"}]}, "null", 0),
        ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "3", 1), ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, "1", 0), ({"not": {"type": "object"}}, "{}", 1), ({"not": {"type": "object"}}, "[]", 0),
    ]
    row = spark.range(1).select(*(F.size(jsonwalk.schema_errors(F.lit(text), schema)).alias(f"c{i}") for i, (schema, text, _) in enumerate(cases))).first()
    assert list(row) == [n for _, _, n in cases]


def test_forbidden_values(spark):
    df = spark.createDataFrame([(1, '{"a":[{"b":"decoy"}]}'), (2, '{"decoy":1}'), (3, None)], "k int, j string")
    assert {tuple(r) for r in jsonwalk.has_forbidden_value(df, "k", "j", ["decoy"]).collect()} == {(1, True), (2, False), (3, False)}


def _compare(spark, observation, golden):
    fill = lambda ddl, own: spark.createDataFrame([()], "").select(*(F.lit(None).cast(k).alias(n) if n not in own else F.from_json(F.lit(json.dumps({"v": own[n]})), f"v {k}")["v"].alias(n) for n, k in _fields(ddl)))
    return compare.compare(fill(compare.OBSERVATIONS, {"case_id": "c", "executed": True, **observation}), fill(compare.GOLDENS, {"case_id": "c", "id_column": "id", **golden})).first()


def _fields(ddl):
    from evalspark.plans.queries import _split

    return [x.strip().split(" ", 1) for x in _split(ddl)]


@pytest.mark.parametrize(
    ("observation", "golden", "verdict", "subtype"),
    [
        ({"executed": False, "failure_stage": "generation"}, {"kind": "id_set"}, "loud_fail", "repair_exhausted"),
        ({"executed": False, "disposition": "refused"}, {"kind": "id_set"}, "loud_fail", "refused"),
        ({"executed": True}, {"kind": "id_set", "expected_outcome": "honest_failure"}, "silent_wrong", "unexpected_execution"),
        ({"columns": ["n"], "rows": [{"n": "1"}]}, {"kind": "id_set", "ids": ["a"]}, "silent_wrong", "ambiguous_shape"),
        ({"ids": [" a "]}, {"kind": "id_set", "ids": ["a"]}, "correct", None),
        ({"ids": ["a"]}, {"kind": "id_set", "ids": ["a"], "required_fields": ["when"]}, "silent_wrong", "field_conformance"),
        ({"columns": ["r", "n"], "rows": [{"r": "North America", "n": "2.04"}]}, {"kind": "aggregate", "group_columns": ["region"], "entries": [{"key": ["north_america"], "value": 2.0}]}, "correct", None),
        ({"columns": ["n"], "rows": [{"n": "4"}]}, {"kind": "aggregate", "group_columns": [], "entries": [{"key": [], "value": 5.0}]}, "silent_wrong", "wrong_value"),
        ({"ids": ["a"], "query_fields": ["t.When"]}, {"kind": "id_set", "ids": ["a"], "required_fields": ["x.when"]}, "correct", None),
        ({"ids": ["a"], "query_fields": ["when", "who"]}, {"kind": "id_set", "ids": ["a"], "required_fields": ["when"]}, "silent_wrong", "field_conformance"),
        ({"ids": ["a"], "query_text": '{"q": {"value_field": "t.Order \\u0044ate"}}'}, {"kind": "id_set", "ids": ["a"], "required_fields": ["order_date"]}, "correct", None),
        ({"ids": ["a"], "query_text": "SELECT [t].[Order Date]"}, {"kind": "id_set", "ids": ["a"], "allowed_fields": ["order_date", "t"]}, "correct", None),
        ({"row_count": 3, "columns": ["n"]}, {"kind": "id_set", "ids": ["a"]}, "silent_wrong", "ambiguous_shape"),
        ({"rows": [{"id": "a", "s": "1"}, {"s": None}]}, {"kind": "ordered", "ids": ["a"], "sort_column": "s"}, "silent_wrong", "ambiguous_shape"),
        ({"ids": ["b", "a"]}, {"kind": "ordered", "ids": ["a", "b"]}, "silent_wrong", "wrong_order"),
        ({"columns": ["id", "s"], "rows": [{"id": "b", "s": "3"}, {"id": "a", "s": "3"}, {"id": "c", "s": "1"}]}, {"kind": "ordered", "ids": ["a", "b", "c"], "sort_column": "s", "descending": True}, "correct", None),
    ],
)
def test_verdicts(spark, observation, golden, verdict, subtype):
    row = _compare(spark, observation, golden)
    assert (row.verdict, row.subtype) == (verdict, subtype)


def test_all_flags(spark):
    row = _compare(spark, {"ids": ["DECOY-1"], "query_text": "DELETE FROM t", "truncated": True}, {"kind": "id_set", "ids": ["DECOY-1"], "requires_scope": True, "decoy_id_prefixes": ["DECOY-"]})
    assert row.verdict == "correct" and tuple(row.safety_flags) == compare.FLAGS


def test_rulers():
    a = {"criteria": ["x"], "calibrationIds": {"q": "1"}, "taxonomyVersion": "1"}
    b = {"criteria": ["x"], "calibrationIds": {"q": "2"}, "taxonomyVersion": "2"}
    assert list(scores.compare_rulers(a, b)) == ["calibrationIds.q", "taxonomyVersion"]
    with pytest.raises(scores.RulerError):
        scores.assert_same_ruler(a, b)
    with pytest.raises(scores.RulerError):
        scores.compare_rulers(None, a)


def test_ledger(spark, tmp_path):
    good = {"schema_version": "1", "case_id": "a", "revision_identity": "sha256:" + "0" * 64, "context_fingerprint": "sha256:" + "1" * 64, "status": "passed", "payload": "{}"}
    path = tmp_path / "l.jsonl"
    path.write_text(json.dumps(good) + "\n" + json.dumps(good | {"case_id": "b", "status": "failed"}) + "\n")
    rows = ledger.read_file(spark, str(path))
    assert [r.case_id for r in ledger.passing_checkpoints(rows).collect()] == ["a"]
    assert ledger.read_file(spark, str(tmp_path / "none.jsonl")).count() == 0
    for bad in (json.dumps(good | {"context_fingerprint": "f"}) + "\n", json.dumps(good), json.dumps(good) + "\n{}\n", json.dumps(good) + '\n{"x": NaN}\n', "\n" + json.dumps(good) + "\n"):
        path.write_text(bad)
        with pytest.raises(ledger.LedgerError):
            ledger.read_file(spark, str(path))


def test_diff_mirrors(spark):
    r = random.Random(1)
    rows = lambda: [(f"c{i % 9}", f"n{i // 9}", r.choice([None, 0.0, 0.5, 1.0]), "maximize", None) for i in range(27) if r.random() < 0.8]
    ddl = "case_id string, name string, score double, direction string, label string"
    a, b = spark.createDataFrame(rows(), ddl), spark.createDataFrame(rows(), ddl)
    there = {(x.case_id, x.criterion): x.movement for x in scores.diff_criteria(a, b).collect()}
    back = {(x.case_id, x.criterion): x.movement for x in scores.diff_criteria(b, a).collect()}
    turn = {"improved": "regressed", "regressed": "improved"}
    assert back == {k: turn.get(v, v) for k, v in there.items()}


def test_query_fields_in_json(spark):
    cases = {'{"field": "a.B c"}': ["bc"], '{"note": "x, \\"field\\": \\"no\\""}': [], '[{"x": {"value_field": "p\\tq"}}, {"field": 3}]': None, "[A].[b.C]": ["a", "c"], None: []}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    for text, got in df.select("x", jsonwalk.query_fields(F.col("x"))).collect():
        want = cases[text]
        assert got == want if want is not None else "pq" in got


def test_calibration(spark):
    rows = [("j", "choice", "a", "a", i < 4) for i in range(6)]
    df = spark.createDataFrame(rows, "judge string, mode string, expected_label string, actual_label string, available boolean")
    row = calibration.calibrate(df, ["judge"]).first()
    assert (row.records, row.available, row.agreement, row.calibrated) == (6, 4, 1.0, False)
    with pytest.raises(ValueError):
        calibration.calibrate(df, ["judge"], minimum=0)
    kind = "array<struct<criterion:string,severity:string,locality:string>>"
    x = ("c", "s", "l")
    found = spark.createDataFrame([("p", True, [x], [x]), ("p", True, [x], []), ("p", False, [x], None), ("q", True, [], []), ("q", True, None, [x])], f"judge string, available boolean, expected_findings {kind}, actual_findings {kind}")
    assert {tuple(r) for r in calibration.per_finding(found, ["judge"]).collect()} == {("p", "c:s:l", 2, 1, 0.5), ("q", "<no_findings>", 2, 1, 0.5)}
    bad = spark.createDataFrame([("1", "choice", "a"), ("1", "choice", "a"), ("2", "findings", None), ("3", "choice", None)], "record_id string, mode string, expected_label string")
    assert {tuple(r) for r in calibration.record_violations(bad, "choice").collect()} == {("1", "duplicate_id"), ("2", "other_mode"), ("3", "no_expected_label")}


def test_judges(spark):
    def _port():
        good = {"criterion": "c1", "severity": "weak", "locality": "text", "evidence": "e", "complaint": "w"}
        answers = {
            "ok": {"label": "yes", "explanation": None}, "off": {"label": ["yes"], "explanation": None}, "list": ["yes"],
            "f": {"findings": [good], "met": ["c2", "c1", "c2"]}, "g": {"findings": [good | {"severity": "huge"}], "met": []},
        }

        def ask(messages, operation):
            prompt = messages[0]["content"]
            if prompt == "boom":
                raise RuntimeError("no model")
            if operation.endswith(".repair"):
                assert [m["role"] for m in messages] == ["user", "assistant", "user"]
                return answers["ok"] if prompt == "off" else answers["list"]
            return answers[prompt]

        return ask

    rubric = judges.ChoiceRubric({"yes": 1.0, "no": 0.0})
    ask = lambda prompts, **own: {r.case_id: r for r in judges.judge(spark.createDataFrame([(p, p) for p in prompts], "case_id string, prompt string"), _port, own.pop("rubric", rubric), evaluator_id="e", evaluator_version="1", **own).collect()}
    got = ask(["ok", "off", "list"], allow_uncalibrated=True)
    assert {k: (r.label, r.score, r.status, r.attempts) for k, r in got.items()} == {"ok": ("yes", 1.0, "uncalibrated", 1), "off": ("yes", 1.0, "uncalibrated", 2), "list": (None, None, "refused", 2)}
    with pytest.raises(calibration.UncalibratedJudgeError):
        ask(["ok"])
    report = lambda h: spark.createDataFrame([("e", "1", h, True)], "evaluator_id string, evaluator_version string, rubric_hash string, calibrated boolean")
    assert ask(["ok"], reports=report(rubric.rubric_hash))["ok"].status == "calibrated"
    with pytest.raises(calibration.UncalibratedJudgeError):
        ask(["ok"], reports=report("sha256:other"))
    findings = judges.FindingsRubric(["c1", "c2"], ["text"])
    got = ask(["f", "g", "boom"], rubric=findings, calibrating=True)
    assert got["f"].met == ["c2"] and got["f"].findings[0].criterion == "c1" and got["g"].status == "refused" and got["g"].findings is None
    assert got["boom"].status == "failed" and got["boom"].error == "RuntimeError: no model"
    records = spark.createDataFrame([("f", [("c1", "weak", "text")]), ("g", []), ("other", [])], "record_id string, expected_findings array<struct<criterion:string,severity:string,locality:string>>")
    answers = judges.judge(spark.createDataFrame([(p, p) for p in ("f", "g")], "case_id string, prompt string"), _port, findings, evaluator_id="e", evaluator_version="1", calibrating=True)
    judged = calibration.outcomes(judges.calibration_outcomes(records, answers, "findings").withColumns({"mode": F.lit("findings"), "expected_label": F.lit(None).cast("string"), "actual_label": F.lit(None).cast("string")}))
    assert {r.record_id: r.agreed for r in judged.collect()} == {"f": True, "g": None, "other": None}
    with pytest.raises(ValueError):
        judges.FindingsRubric(["c", "c"], ["text"])
    assert rubric.rubric_hash != judges.ChoiceRubric({"yes": 1.0, "no": 0.0}, direction="minimize").rubric_hash


def test_reviewers_and_manifests(spark):
    names = {"  Llama   reviewer ": "Llama reviewer", "A. Reader": None, "pending": None, "o3": None, "o3 x": "o3 x", "": None, None: None}
    df = spark.createDataFrame([(k,) for k in names], "x string")
    assert {r[0]: r[1] for r in df.select("x", corpus.clean_reviewer(F.col("x"))).collect()} == names
    ddl = "case_id string, profile string, reviewer string, blessed boolean, checks map<string,boolean>, review_status string"
    full = lambda case, checks, blessed=True, profile="checklist": (case, profile, "a model", blessed, checks, "approved")
    manifest = {"profile": "checklist", "required_checks": ["x"], "expected_total": 2, "counts": {"a": 2}, "category_counts": {"a": 1, "b": 1}}
    rules = lambda own, rows: {tuple(r) for r in corpus.corpus_violations(manifest | own, spark.createDataFrame(rows, ddl)).collect()}
    assert rules({}, [full("1", {"x": True}), full("2", {"x": True})]) == set()
    assert rules({}, [full("1", {"x": False}), full("1", {"x": True, "y": True})]) == {("1", "incomplete"), ("1", "many_reviews"), ("1", "checks")}
    assert rules({"counts": {"a": 3}, "required_checks": []}, [full("1", {}), full("2", None, profile="annotation")]) == {(None, "counts"), (None, "required_checks_missing"), ("2", "other_profile")}
    assert rules({}, []) == {(None, "reviews_total")}


def test_metric_scores(spark):
    df = spark.createDataFrame([(["a"], ["a"], "Straße", "STRASSE"), ([], ["a"], None, "x")], "o array<string>, e array<string>, s string, t string")
    got = df.select(metrics.id_set_score(df.o, df.e).alias("i"), metrics.match_score(df.s, df.t, False).alias("m"), metrics.regex_score(df.t, "X|S.*", True).alias("r")).collect()
    assert [(r.i.score, r.i.label, r.m.score, r.m.label, r.r.score) for r in got] == [(1.0, "exact", 1.0, "match", 1.0), (0.0, "empty_wrong", 0.0, "mismatch", 0.0)]
    cases = spark.createDataFrame([(1, "drop table t", '{"a": true}'), (2, None, None), (3, "select 1", '[null]')], "k int, q string, p string")
    assert {r.k: (r.score, r.label, r.flags) for r in metrics.safety_scores(cases, "k", "q", "p", ["True", "None"]).collect()} == {1: (0.0, "unsafe", ["write_attempt", "forbidden_value"]), 2: (1.0, "safe", []), 3: (0.0, "unsafe", ["forbidden_value"])}


def test_rubrics_and_freeze():
    from datetime import UTC, datetime

    assert len(corpus.RUBRICS) == 5 and corpus.substitute(corpus.load_rubric("hallucination"), {"input": "question"})["prompt"].startswith("Question: {{question}}")
    with pytest.raises(ValueError):
        corpus.load_rubric("../x")
    with pytest.raises(KeyError):
        corpus.load_rubric("other")
    assert corpus.rubric_violations({"direction": "up", "prompt": " ", "choices": {"a": float("inf")}}) == ["direction", "prompt", "score of 'a'"]
    sha, now = "sha256:" + "0" * 64, datetime(2024, 1, 1, tzinfo=UTC)
    world = {"name": "w", "revision": "1", "contentHash": sha}
    made = [corpus.build_freeze({"a": 1}, {"s": t}, sha, world, now) for t in ("x", b"x", "y")]
    assert made[0] == made[1] and made[0]["manifestId"] != made[2]["manifestId"] and made[0]["sourceHashes"] != made[2]["sourceHashes"]
    files = corpus.preregistration_files(made[0])
    assert json.loads(files["preregistration.json"]) == made[0] and "- none" in files["preregistration.md"]
    for bad in (({}, {"s": "x"}, sha, world, datetime(2024, 1, 1)), ({}, {}, sha, world, now), ({}, {" ": "x"}, sha, world, now), ({}, {"s": "x"}, "sha256:1", world, now), ({}, {"s": "x"}, sha, world | {"name": ""}, now)):
        with pytest.raises(ValueError):
            corpus.build_freeze(*bad)


SHA = "sha256:" + "0" * 64


def test_evidence_of_ids(spark):
    row = _compare(spark, {"ids": ["b", " a", "x"]}, {"kind": "id_set", "ids": ["a", "c"]})
    e = row.evidence
    assert (row.subtype, e.observed_ids, e.expected_ids, e.missing, e.unexpected, e.reason) == ("overlap", ["a", "b", "x"], ["a", "c"], ["c"], ["b", "x"], None)
    assert (round(row.precision, 6), row.recall) == (0.333333, 0.5)
    row = _compare(spark, {"columns": ["n"], "rows": [{"n": "1"}]}, {"kind": "id_set", "ids": ["a"]})
    assert row.subtype == "ambiguous_shape" and row.precision is None and row.evidence.columns == ["n"] and row.evidence.observed_ids is None
    row = _compare(spark, {"ids": ["b", "a"]}, {"kind": "ordered", "ids": ["a", "b"]})
    assert row.subtype == "wrong_order" and row.f1 is None and row.evidence.observed_ids == ["b", "a"]
    row = _compare(spark, {"ids": ["b"]}, {"kind": "ordered", "ids": ["a", "b"]})
    assert row.subtype == "subset" and row.recall == 0.5
    row = _compare(spark, {"rows": [{"id": "a", "s": "1"}, {"id": "b", "s": "2"}]}, {"kind": "ordered", "ids": ["a", "b"], "sort_column": "s"})
    assert row.subtype == "wrong_order" and row.evidence.sort_values == [1.0, 2.0]
    row = _compare(spark, {"ids": ["a"], "query_fields": ["q"]}, {"kind": "id_set", "ids": ["a"], "required_fields": ["when"]})
    assert row.subtype == "field_conformance" and row.f1 == 1 and row.evidence.field_conformance.missing == ["when"] and row.evidence.field_conformance.unexpected == ["q"]


def test_evidence_of_failures(spark):
    failed = {"executed": False, "failure_stage": "execution", "failure_code": "E1", "failure_message": "gone"}
    e = _compare(spark, failed, {"kind": "id_set", "ids": ["a"]}).evidence
    assert (e.failure_stage, e.failure_code, e.failure_message, e.honest_failure, e.expected_outcome) == ("execution", "E1", "gone", None, "result")
    row = _compare(spark, failed, {"kind": "id_set", "expected_outcome": "honest_failure"})
    assert (row.verdict, row.evidence.honest_failure, row.evidence.failure_message) == ("correct", True, None)
    assert _compare(spark, {"executed": True}, {"kind": "id_set", "expected_outcome": "honest_failure"}).evidence.honest_failure is False


def test_evidence_of_groups(spark):
    golden = {"kind": "aggregate", "group_columns": ["region"], "entries": [{"key": ["A b"], "value": 1.0}, {"key": ["c"], "value": 2.0}]}
    row = _compare(spark, {"rows": [{"x": "a_B", "n": "1.5"}, {"x": "D", "n": "1"}], "columns": ["x", "n"]}, golden)
    e = row.evidence
    assert (row.subtype, e.missing_groups, e.unexpected_groups, e.group_columns, e.value_column) == ("wrong_value", ["c"], ["d"], ["x"], "n")
    assert {k: tuple(v) for k, v in e.mismatched.items()} == {"ab": (1.5, 1.0)} and row.f1 is None
    row = _compare(spark, {"rows": [{"x": "c", "n": "1"}, {"x": "C", "n": "2"}, {"x": "C.", "n": "2"}], "columns": ["x", "n"]}, golden)
    assert (row.subtype, row.evidence.groups, row.evidence.reason) == ("ambiguous_shape", ["c"], "duplicate groups")
    row = _compare(spark, {"rows": [{"x": "c", "n": "1", "m": "2"}], "columns": ["x", "n", "m"]}, golden)
    assert (row.subtype, row.evidence.reason, row.evidence.columns) == ("ambiguous_shape", "numeric columns found: 2", ["x", "n", "m"])
    row = _compare(spark, {"row_count": 0}, golden)
    assert (row.subtype, row.evidence.expected_groups) == ("empty_wrong", ["ab", "c"])
    row = _compare(spark, {"rows": [{"n": "4", "m": "5"}]}, {"kind": "aggregate", "group_columns": [], "entries": [{"key": [], "value": 5.0}]})
    assert (row.subtype, row.evidence.reason) == ("ambiguous_shape", "numbers found: 2")


def test_golden_hashes(spark):
    own = {"allowedFields": [], "decoyIdPrefixes": ["D"], "expectedOutcome": "result", "requiredFields": [], "requiresScope": True}
    given = {"decoy_id_prefixes": ["D"], "requires_scope": True}
    for golden, want in (
        ({"kind": "id_set", "ids": ['a"', "é"]}, {"kind": "id_set", "idColumn": "id", "ids": ['a"', "é"]}),
        ({"kind": "ordered", "ids": ["a"], "sort_column": "s", "descending": False}, {"kind": "ordered", "idColumn": "id", "ids": ["a"], "sortColumn": "s", "descending": False}),
        ({"kind": "aggregate", "group_columns": ["g"], "entries": [{"key": ["x"], "value": 1e22}]}, {"kind": "aggregate", "groupColumns": ["g"], "entries": [{"key": ["x"], "value": 1e22}], "tolerance": 0.05}),
    ):
        assert _compare(spark, {"ids": []}, golden | given).evidence.golden_hash == hashing.content_hash(own | want)


def test_json_numbers(spark):
    r = random.Random(5)
    some = [0.0, -0.0, 1.0, -2.5, 1e15, 1e16, 123456789012345680.0, 1e22, 1e23, 2e-3, 1e-4, 1e-5, 2.3e-308, 1.7976931348623157e308, 0.1 + 0.2, 100.0] + [r.uniform(-1, 1) * 10 ** r.randint(-20, 20) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in some], "x double")
    assert [r[0] for r in df.select(hashing.json_number(df.x)).collect()] == [json.dumps(x) for x in some]


def test_canonical_values():
    import dataclasses
    import decimal
    import enum
    import pathlib
    from datetime import date

    class Kind(enum.Enum):
        A = {"z": 1}

    @dataclasses.dataclass
    class Pair:
        b: tuple
        a: frozenset

    value = {1: Pair((decimal.Decimal("1.50"), pathlib.PurePath("a/b")), frozenset({"y", "x"})), "k": Kind.A, "d": date(2024, 1, 2), "t": b"\xc3\xa9", "n": None}
    assert hashing.canonical_json(value) == '{"1":{"a":["x","y"],"b":["1.50","a/b"]},"d":"2024-01-02","k":{"z":1},"n":null,"t":"é"}'


def test_scalars_at_any_depth(spark):
    deep = "[" * 50 + '"decoy"' + "]" * 50
    texts = {deep: ["decoy"], '{"a": {"decoy" : [1.50, -0, 2e1, true, null, "x: \\"y\\":"]}}': ["1.5", "0", "20.0", "True", "None", 'x: "y":'], '"one"': ["one"], "{": None, None: None, json.dumps({"a": "q" * 50_000}): ["q" * 50_000], "[]": []}
    df = spark.createDataFrame([(k,) for k in texts], "x string")
    assert [r[0] for r in df.select(jsonwalk.scalars("x")).collect()] == list(texts.values())
    assert [r[0] for r in df.select(jsonwalk.forbidden_value("x", ["decoy"])).collect()] == [True, *[False] * 6]


def test_refusals(spark):
    one = spark.range(1)
    for bad in (stats.required_successes(F.lit(0)), stats.reporting_probability(F.lit(1.5), F.lit(3)), text.render(F.lit("{{b}} {{a}} {{c}}"), F.create_map(F.lit("c"), F.lit("x"))), spans.precision_recall_f1(F.lit(-1), F.lit(0), F.lit(0))["f1"], spans.checked_spans(F.array(F.struct(F.lit(3).alias("start"), F.lit(3).alias("end"))))):
        with pytest.raises(Exception) as e:
            one.select(bad).collect()
        assert "USER_RAISED" in str(e.value)
    with pytest.raises(ValueError):
        spans.match_spans(F.col("g"), F.col("p"), 1.5)
    with pytest.raises(ValueError):
        text.matches_regex("x", "a", flags=256)
    assert text.col is not None and one.select(text.matches_regex(F.lit("ÄB\nc"), "äb.C", True, 2 | 16)).first()[0]


def test_spans_alike_and_empty(spark):
    df = spark.createDataFrame([((3, 3), (3, 3)), ((0, 10), (5, 15))], "a struct<start:int,end:int>, b struct<start:int,end:int>")
    assert [round(r[0], 6) for r in df.select(spans.span_iou(df.a, df.b)).collect()] == [0.0, 0.333333]
    kind = "array<struct<start:int,end:int,label:string>>"
    df = spark.createDataFrame([([(0, 10, None)], [(1, 9, None), (20, 25, None)]), ([], [])], f"g {kind}, p {kind}")
    assert [(r[0].label, r[0].true_positive, r[0].false_positive) for r in df.select(metrics.span_f1_score(df.g, df.p)).collect()] == [("mismatch", 1, 1), ("exact", 0, 0)]


def test_numbers_of_other_scripts(spark):
    df = spark.createDataFrame([("١٢٣",), ("１,２.5",), ("𝟙",)], "x string")
    assert [r[0] for r in df.select(text.numeric("x")).collect()] == [123.0, 12.5, 1.0]


def test_rulers_of_artifacts():
    good = {"taxonomyVersion": "1", "criteria": ["a", "b"], "calibrationIds": {"a": SHA}}
    assert scores.ruler_of({"ruler": good})["freezeId"] is None
    for bad in ({}, {"ruler": None}, {"ruler": good | {"criteria": ["a", "a"]}}, {"ruler": good | {"criteria": [" "]}}, {"ruler": good | {"calibrationIds": {"a": "x"}}}, {"ruler": good | {"freezeId": "x"}}, {"ruler": good | {"taxonomyVersion": ""}}):
        with pytest.raises(scores.RulerError):
            scores.ruler_of(bad)
    assert scores.ruler_fingerprint(good) != scores.ruler_fingerprint(good | {"criteria": ["b", "a"]})


def test_means_on_a_bound(spark, tmp_path):
    """Means that are 20 exactly, in orders of rows whose sums of doubles are just below, and a row without a time."""
    r, rows = random.Random(3), []
    for user in range(200):
        cents = [r.randint(1, 3999) for _ in range(9)]
        values = [x / 100 for x in (*cents, 20_000 - sum(cents))]
        rows += [(user, "view", "2024-01-02 00:00:00", x) for x in values] + [(user, "view", None if user % 2 else "2024-01-20 00:00:00", 20.5)]
    means = {u: [x for v, _, t, x in rows if v == u and t == "2024-01-02 00:00:00"] for u in range(200)}
    assert any(list(itertools.accumulate(x))[-1] / 10 < 20 for x in means.values())  # as sum() adds without such errors
    df = spark.createDataFrame(rows, "user_id long, event_type string, ts string, value double")
    df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    assert [tuple(x) for x in QUERIES["q12_diff_criteria"](spark, str(tmp_path)).collect()] == [("view", "unchanged", 200)]
    assert sorted(map(str, map(tuple, QUERIES["q31_rollup_report"](spark, str(tmp_path)).collect()))) == ["('view', 'unchanged', 200)", "('view', None, 200)", "(None, None, 200)"]


def test_exact_means(spark):
    df = spark.createDataFrame([(1, 0.1), (1, 0.2), (1, 0.3), (2, math.inf), (2, 1.0), (3, None), (4, 1e30), (4, 3e30), (5, math.nan), (6, None), (6, -7.5)], "k int, x double")
    got = {r[0]: r[1] for r in df.groupBy("k").agg(stats.exact_mean("x")).collect()}
    assert math.isnan(got.pop(5)) and got == {1: 0.6 / 3, 2: math.inf, 3: None, 4: 2e30, 6: -7.5}


def test_rollup_against_sql(spark, tmp_path):
    """Means that are no numbers or beyond a long, rows without a type or value, and no rows at all."""
    values = [math.nan, math.inf, -math.inf, 1e30, 3e30, -0.5, 40.0, None]
    rows = [(u, None if u % 7 == 0 else "view", f"2024-01-{day} 00:00:00", values[(u // k) % 8]) for u in range(64) for day, k in (("02", 1), ("20", 8))]
    for n, some in enumerate((rows, [])):
        df = spark.createDataFrame(some, "user_id long, event_type string, ts string, value double")
        df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/{n}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS FROM '{tmp_path}/{n}/events.parquet/*.parquet'")
        want = con.execute(SQL["q31_rollup_report"]).fetchall()
        assert Counter(want) == Counter(map(tuple, QUERIES["q31_rollup_report"](spark, f"{tmp_path}/{n}").collect()))


def test_small_balances_against_sql(spark, tmp_path):
    """A balance that is twice what it should be is wrong however small it is."""
    balances = [-0.05, 0.05, 0.01, -0.01, 0.0, -0.0, 0.06, 1e7]
    rows = [(5 * i + k, b) for i, b in enumerate(balances) for k in range(5)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
    want = con.execute(SQL["q39_scalar_evidence"]).fetchall()
    assert Counter(want) == Counter(map(tuple, QUERIES["q39_scalar_evidence"](spark, str(tmp_path)).collect()))


def test_labels_of_transitions(spark):
    ddl = "case_id string, name string, score double, direction string, label string"
    a, b = (spark.createDataFrame([("1", "n", None, "maximize", label)], ddl) for label in ("", None))
    assert [tuple(r) for r in scores.transitions(scores.diff_criteria(a, b)).collect()] == [("n", "<none> -> <none>", 1)]


def test_ledger_appends_in_order(spark, tmp_path):
    path = str(tmp_path / "ledger")
    record = lambda case, status, i: (case, "sha256:" + str(i) * 64, SHA, status)
    frame = lambda rows: spark.createDataFrame(rows, "case_id string, revision_identity string, context_fingerprint string, status string").repartition(3)
    ledger.append(frame([record("a", "passed", 1), record("b", "passed", 2)]), path)
    ledger.append(frame([record("a", "passed", 3), record("b", "failed", 4)]), path)
    ledger.append(frame([record("b", "skipped", 5)]), path)
    rows = ledger.read_file(spark, path)
    seqs = [r.seq for r in rows.collect()]
    assert len(set(seqs)) == len(seqs) == 5
    assert {r.case_id: r.revision_identity[-1] for r in ledger.passing_checkpoints(rows).collect()} == {"a": "3", "b": "2"}
    with pytest.raises(ledger.LedgerError):
        ledger.append(frame([record("a", "done", 1)]), path)
    assert ledger.read_file(spark, path).count() == 5


def test_ledger_lines_in_splits(spark, tmp_path):
    line = lambda i: json.dumps({"case_id": "c", "revision_identity": "sha256:" + f"{i:064x}", "context_fingerprint": SHA, "status": "passed"})
    path = tmp_path / "l.jsonl"
    path.write_text("".join(line(i) + "\n" for i in range(3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        rows = ledger.read_file(spark, str(path))
        assert rows.rdd.getNumPartitions() > 5
        assert [int(r.revision_identity[7:], 16) for r in rows.orderBy("seq").collect()] == list(range(3000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    path.write_text(path.read_text() + "{}\n")
    with pytest.raises(ledger.LedgerError, match="l.jsonl:3001"):
        ledger.read_file(spark, str(path))


def test_judges_ask_side_by_side(spark):
    def _port():
        import asyncio

        state = {"now": 0, "most": 0}

        async def ask(messages, operation):
            state["now"] += 1
            state["most"] = max(state["most"], state["now"])
            await asyncio.sleep(0.02)
            state["now"] -= 1
            return {"label": str(min(state["most"], 4)), "explanation": messages[-1]["content"]}

        return ask

    rubric = judges.ChoiceRubric({str(i): float(i) for i in range(1, 5)}, prompt="Q {{q}} of {{ r }}")
    df = spark.createDataFrame([(i, {"q": "x{{r}}", "r": str(i)}) for i in range(40)], "case_id int, inputs map<string,string>").coalesce(1)
    got = judges.judge(df, _port, rubric, evaluator_id="e", evaluator_version="1", allow_uncalibrated=True, concurrency=4).collect()
    assert len(got) == 40 and max(r.score for r in got) == 4 and all(r.explanation == f"Q x{{{{r}}}} of {r.case_id}" for r in got)
    short = spark.createDataFrame([(1, {"r": "1"})], "case_id int, inputs map<string,string>")
    with pytest.raises(Exception, match="missing prompt substitutions: q"):
        judges.judge(short, _port, rubric, evaluator_id="e", evaluator_version="1", allow_uncalibrated=True).collect()


def test_calibration_ids(spark):
    rows = [(1, "choice", "a", "a", True), (2, "choice", "b", None, False)]
    df = spark.createDataFrame(rows, "record_id int, mode string, expected_label string, actual_label string, available boolean")
    judge = {"evaluator_id": "e", "evaluator_version": "1", "rubric_hash": SHA, "mode": "choice"}
    want = {"judgeId": "e", "judgeVersion": "1", "rubricHash": SHA, "mode": "choice", "minimumRecords": 5, "agreementFloor": 0.8, "labelledRecords": [{"record_id": 1, "expected_label": "a"}, {"record_id": 2, "expected_label": "b"}], "outcomes": [{"record_id": 1, "actual_label": "a", "available": True, "agreed": True}, {"record_id": 2, "actual_label": None, "available": False, "agreed": None}]}
    assert calibration.calibration_id(judge, df.orderBy(F.desc("record_id"))) == hashing.content_hash(want)
    report = spark.createDataFrame([("e", "1", SHA, True), ("f", "1", SHA, False)], "evaluator_id string, evaluator_version string, rubric_hash string, calibrated boolean")
    calibration.assert_licensed(judge, report)
    with pytest.raises(calibration.UncalibratedJudgeError):
        calibration.assert_licensed(judge | {"evaluator_id": "f"}, report)


def test_calibration_ids_of_many_records(spark):
    n = 100_001
    own = lambda i: (i, ("a", 'b"é', None)[i % 3], ("a", "c", None)[i % 7 % 3], i % 5 > 0)
    text = lambda i, k, *v: F.element_at(F.array(*map(F.lit, v)), (i % k % 3 + 1).cast("int"))
    i = F.col("record_id")
    df = spark.range(n, 0, -1, 5).select((F.col("id") - 1).alias("record_id"), F.lit("choice").alias("mode"))
    df = df.select("*", text(i, 3, "a", 'b"é', None).alias("expected_label"), text(i, 7, "a", "c", None).alias("actual_label"), (i % 5 > 0).alias("available"))
    judge = {"evaluator_id": "e", "evaluator_version": "1", "rubric_hash": SHA, "mode": "choice"}
    for most, at_once in ((n, calibration.AT_ONCE), (40, 7), (0, 7)):
        rows = [own(i) for i in range(most)]
        want = {"judgeId": "e", "judgeVersion": "1", "rubricHash": SHA, "mode": "choice", "minimumRecords": 5, "agreementFloor": 0.8, "labelledRecords": [{"record_id": i, "expected_label": e} for i, e, _, _ in rows], "outcomes": [{"record_id": i, "actual_label": a, "available": ok, "agreed": e == a if ok else None} for i, e, a, ok in rows]}
        assert calibration.calibration_id(judge, df.where(i < most), at_once=at_once) == hashing.content_hash(want)


def test_secrets(spark):
    texts = {"key sk-proj-" + "a" * 24: ["sk_key"], "sk-ant-" + "b" * 24: ["sk_ant_key"], 'password = "0123456789abcdefg"': ["credential"], "plain": [], None: []}
    df = spark.createDataFrame([(k,) for k in texts], "x string")
    assert {r[0]: r[1] for r in df.select("x", text.secret_kinds("x")).collect()} == texts
