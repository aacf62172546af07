from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gripelens.functions import entities as E
from gripelens.functions import labels as L
from gripelens.operators import extraction, hooks, labeling

J = '{"component":"z"}'


def parse(spark, contents):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "feedback_id long, content string")
    return E.parse_answers(df, "content")


@pytest.mark.parametrize(
    "content, status, component",
    [
        (J, "success", "z"),
        (f"  {J}\n", "success", "z"),
        (f"```json\n{J}\n```", "malformed", "z"),
        (f"Result: {J}", "malformed", "z"),
        (f"{J} x", "malformed", "z"),
        (f"[{J}]", "failed", None),
        (f"{J} {J}", "malformed", None),
        ("{'component':'z'}", "malformed", None),
        ("12", "failed", None),
        ("null", "failed", None),
        ("true", "failed", None),
        ("none", "malformed", None),
        ('{"component":', "malformed", None),
        ("", "malformed", None),
        (None, "failed", None),
    ],
)
def test_parse(spark, content, status, component):
    row = parse(spark, [content]).first()
    assert row["parse_status"] == status
    assert (row["entity"]["component"] if row["entity"] else None) == component


def test_statistics_and_rows(spark):
    parsed = parse(spark, [J, f"x {J}", "none", None])
    assert extraction.extraction_statistics(parsed).first().asDict() == {
        "successful": 1,
        "malformed": 2,
        "failed": 1,
    }
    got = extraction.entity_rows(parsed).orderBy("feedback_id").collect()
    assert [r["feedback_id"] for r in got] == [0, 1]
    assert got[0]["confidence"] == 0.95 and got[0]["symptom"] == ""


@pytest.mark.parametrize(
    "severity, expected",
    [('"HIGH"', "HIGH"), ('"urgent"', "medium"), (None, "medium"), ("null", "medium"), ("3", "medium")],
)
def test_severity(spark, severity, expected):
    body = "{}" if severity is None else f'{{"severity":{severity}}}'
    row = extraction.entity_rows(parse(spark, [body])).first()
    assert row["severity"] == expected and row["sentiment"] == "negative"


def test_long_field_is_kept(spark):
    row = extraction.entity_rows(parse(spark, ['{"symptom":"' + "x" * 250 + '"}'])).first()
    assert len(row["symptom"]) == 250


def test_formatted_text_with_missing_column_and_null(spark):
    df = spark.createDataFrame([("a", None, "low")], "component string, symptom string, severity string")
    got = extraction.format_entities(df).first()["formatted_text"]
    assert got == "Component: a | Failure:  | Symptom:  | Severity: low | Condition: "


def test_default_lexicon(spark):
    fb = spark.createDataFrame(
        [
            (1, "de", "Das ENGINE overheating bei Autobahnfahrt, dann clutch slipping"),
            (2, "en", "autobahnfahrt with a coolant leak"),
            (3, "en", "nothing here"),
        ],
        "feedback_id long, language string, customer_feedback string",
    )
    lexicon = extraction.default_lexicon(
        spark,
        ["engine overheating", "clutch slipping", "coolant leak"],
        {"de": {"Autobahnfahrt": "highway driving"}},
    )
    got = {r["feedback_id"]: r.asDict() for r in extraction.extract_entities(fb, lexicon).collect()}
    assert set(got) == {1, 2, 3} and got[3]["component"] == ""
    assert (got[1]["component"], got[1]["failure_mode"]) == ("engine", "overheating")
    assert got[1]["driving_condition"] == "highway driving"
    assert got[2]["symptom"] == "coolant leak" and got[2]["driving_condition"] == ""
    assert got[2]["severity"] == "medium" and got[2]["confidence"] == 0.95


def test_three_word_terms(spark):
    fb = spark.createDataFrame(
        [(1, "en", "bad fuel sensor issue today"), (2, "en", "fuel sensor"), (3, "en", "")],
        "feedback_id long, language string, customer_feedback string",
    )
    lexicon = extraction.default_lexicon(spark, ["fuel sensor issue"])
    matches = extraction.lexicon_matches(fb, lexicon)
    assert {(r["feedback_id"], r["value"], r["position"]) for r in matches.collect()} == {
        (1, "fuel sensor", 1),
        (1, "issue", 1),
        (1, "fuel sensor issue", 1),
    }


def test_terms_are_cut_into_words_like_texts(spark):
    fb = spark.createDataFrame(
        [(1, "en", "The START-UP was unsafe"), (2, "en", "front left brake pad, worn"), (3, "en", None)],
        "feedback_id long, language string, customer_feedback string",
    )
    rows = [("Start-up", None, "symptom", "start", 1), ("front left brake pad", None, "component", "pad", 1)]
    lexicon = spark.createDataFrame(rows, extraction.LEXICON_DDL)
    both = lexicon.union(extraction.default_lexicon(spark))
    got = {r["feedback_id"]: r.asDict() for r in extraction.extract_entities(fb, both).collect()}
    assert (got[1]["symptom"], got[1]["severity"]) == ("start", "critical")
    assert got[2]["component"] == "pad" and got[3]["severity"] == "medium"


def test_completion_hook_retries_and_gives_up(spark):
    def call(prompt: str) -> str:
        import threading

        state = threading.current_thread().__dict__.setdefault("seen", {})
        state[prompt] = state.get(prompt, 0) + 1
        if "bad" in prompt or state[prompt] < 3:
            raise RuntimeError("down")
        return '{"component":"c"}'

    fb = spark.createDataFrame(
        [(1, "en", "good"), (2, "en", "bad")],
        "feedback_id long, language string, customer_feedback string",
    )
    got = extraction.extract_entities(fb, call=call).collect()
    assert [(r["feedback_id"], r["component"]) for r in got] == [(1, "c")]
    none = hooks.complete(fb, "customer_feedback", call, tries=2)
    assert none.filter("content IS NOT NULL").count() == 0


def test_no_row_is_lost_by_failed_answers(spark, tmp_path, monkeypatch):
    from gripelens.plans import run
    from gripelens.sources.tables import coerce_records

    def call(prompt: str) -> str:
        if "bad" in prompt:
            raise RuntimeError("down")
        return "no idea" if "odd" in prompt else '{"component":"c"}'

    texts = ["a good complaint here", "a bad complaint here", "an odd complaint here"]
    rows = [(str(i), "en", t, "x", "x", "x", "x") for i, t in enumerate(texts)]
    names = ["feedback_id", "language", "customer_feedback", "timestamp", "vehicle_model", "domain", "country"]
    raw = coerce_records(spark.createDataFrame(rows, names))
    want = {"0": ("c", "medium", 0.95, "success"), "1": ("", "medium", 0.0, "failed"), "2": ("", "medium", 0.0, "malformed")}
    shown = lambda df: {r[0]: (r.component, r.severity, r.confidence, r.parse_status) for r in df.collect()}
    assert shown(extraction.extract_entities(raw, call=call, every_row=True)) == want

    class Reached(Exception):
        pass

    def embedded(formatted, **_):
        raise Reached(shown(formatted))

    monkeypatch.setattr(run, "embed_texts", embedded)
    with pytest.raises(Reached) as reached:
        run.analyse(raw, str(tmp_path / "run"), hooks=run.Hooks(entity=call))
    assert reached.value.args[0] == want


def test_embedding_hook(spark):
    from gripelens.operators.embedding import embed_texts

    def make():
        import numpy as np

        return lambda texts: np.array([[len(t), 1.0] for t in texts], dtype=np.float32)

    df = spark.createDataFrame([(1, "abc"), (2, "a")], "feedback_id long, formatted_text string")
    got = embed_texts(df, make_encoder=make).orderBy("feedback_id").collect()
    assert [list(r["embedding"]) for r in got] == [[3.0, 1.0], [1.0, 1.0]]


def test_label_answers(spark):
    df = spark.createDataFrame(
        [(1, ["a", "b", "c"], '{"label":"L"}'), (2, ["a"], "no"), (3, [], "no"), (4, ["a"], None)],
        "cluster_id int, keywords array<string>, content string",
    )
    got = {r["cluster_id"]: r["label"] for r in labeling.label_from_answer(df).collect()}
    assert got == {1: "L", 2: "a", 3: "Unknown Failure"}


@pytest.mark.parametrize(
    "n, bucket",
    [(10, "Low"), (11, "Medium"), (20, "Medium"), (21, "High"), (50, "High"), (51, "Critical")],
)
def test_severity_bucket(spark, n, bucket):
    assert spark.range(1).select(L.severity_bucket(F.lit(n))).first()[0] == bucket


def test_prompts(spark):
    row = spark.range(1).select(
        L.extraction_prompt(F.lit("oil leak"), F.lit("en")).alias("e"),
        L.label_prompt(F.array(F.lit("k")), F.array(F.lit("x" * 120), F.lit("y"))).alias("l"),
    ).first()
    assert "oil leak" in row["e"] and row["l"].endswith("- " + "x" * 100 + "\n- y")
