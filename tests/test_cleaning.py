from __future__ import annotations

from gripelens.operators import cleaning

SCHEMA = "feedback_id string, customer_feedback string, language string, vehicle_model string"


def rows(df, *columns):
    return [tuple(r) for r in df.orderBy("feedback_id").select(*columns).collect()]


def test_dedupe_comes_before_null_removal(spark):
    df = spark.createDataFrame([("1", "t", "en", None), ("2", "t", "en", "m")], SCHEMA)
    assert cleaning.clean_feedback(df).count() == 0


def test_dedupe_comes_before_cleaning(spark):
    df = spark.createDataFrame([("1", "t a@b.co", "en", "m"), ("2", "t c@d.co", "en", "m")], SCHEMA)
    got = rows(cleaning.clean_feedback(df), "feedback_id", "customer_feedback")
    assert got == [("1", "t"), ("2", "t")]


def test_dedupe_keeps_first_and_one_null(spark):
    df = spark.createDataFrame(
        [("3", "a", "en", "m"), ("1", "a", "en", "m"), ("2", None, "en", "m"), ("4", None, "en", "m")],
        SCHEMA,
    )
    assert rows(cleaning.drop_duplicate_texts(df), "feedback_id") == [("1",), ("2",)]


def test_hot_group_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(str(i), "same", "en", "m") for i in range(50)], SCHEMA)
    plan = cleaning.drop_duplicate_texts(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_statistics_agree_with_clean(spark):
    data = [("1", "a", "en", "m"), ("2", "a", "en", "m"), ("3", "b", "en", None), ("4", None, "en", "m")]
    df = spark.createDataFrame(data, SCHEMA)
    got = cleaning.cleaning_statistics(df).first().asDict()
    assert got == {
        "initial_rows": 4,
        "duplicates": 1,
        "null_rows": 2,
        "final_rows": 1,
        "removed_rows": 3,
    }
    empty = cleaning.cleaning_statistics(df.limit(0)).first()
    assert empty["initial_rows"] == 0 and empty["removed_rows"] == 0
