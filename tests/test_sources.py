from __future__ import annotations

import os

from pyspark.sql import functions as F

from gripelens.schemas import RAW_FEEDBACK
from gripelens.sources import csv, files, tables
from gripelens.streaming import ingest

NAMES = [f.name for f in RAW_FEEDBACK.fields]


def record(i, text="t", **over):
    row = dict(
        feedback_id=i, timestamp="2024-01-01T00:00:00", language="en", vehicle_model="m",
        domain="d", customer_feedback=text, country="c", mileage=5,
    )
    row.update(over)
    return tuple(row[n] for n in NAMES)


def batch(spark, *rows):
    return spark.createDataFrame(list(rows), RAW_FEEDBACK).coalesce(1)


def test_insert_or_ignore(spark, tmp_path):
    path = str(tmp_path / "raw")
    rows = [record("a", "first"), record("a", "second"), record("b", None), record("c")]
    assert tables.insert_or_ignore(batch(spark, *rows), path) == 2
    assert tables.insert_or_ignore(batch(spark, *rows), path) == 0
    assert tables.insert_or_ignore(batch(spark, record("a"), record("d")), path) == 1
    got = {r["feedback_id"]: r["customer_feedback"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": "first", "c": "t", "d": "t"}


def test_coerce_records(spark):
    df = spark.createDataFrame(
        [(7, "x", "12.0"), (8, None, None), (9, "y", "?")],
        "complaint_id long, complaint_text string, mileage_km string",
    )
    got = tables.coerce_records(df).orderBy("feedback_id").collect()
    assert [r["mileage"] for r in got] == [12, 0, 0]
    assert got[0]["feedback_id"] == "7" and got[1]["customer_feedback"] is None
    assert got[0]["country"] is None
    without = tables.coerce_records(df.drop("mileage_km"))
    assert without.agg(F.max("mileage")).first()[0] == 0
    mapped = tables.coerce_records(
        spark.createDataFrame([("only text",)], "feedback string"), {"feedback": "customer_feedback"}
    )
    assert mapped.first()["customer_feedback"] == "only text"


def test_report_is_written_in_sorted_parts(spark, tmp_path):
    path, name = str(tmp_path / "report"), "spark.sql.adaptive.coalescePartitions.enabled"
    ids = [(i * 37) % 500 for i in range(500)]
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        csv.export_report(spark.createDataFrame([(i, f"l{i}") for i in ids], "cluster_id int, label string"), path)
    finally:
        spark.conf.set(name, before)
    parts = sorted(p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-"))
    rows = [[int(line.split(",")[0]) for line in p.read_text().splitlines()[1:]] for p in parts]
    assert len([r for r in rows if r]) > 1 and sum(rows, []) == list(range(500))


def test_csv_keeps_text_and_reads_null_tokens(spark, tmp_path):
    values = ['say "hi", ok', "two\nlines", "  padded  ", "NA", "None", None, "back\\slash", "é, ü"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    path = str(tmp_path / "c")
    csv.write_csv(df, path)
    got = csv.read_csv(spark, path, df.schema).orderBy("i").collect()
    assert [r["t"] for r in got] == [None if v in ("NA", "None") else v for v in values]
    raw = csv.read_csv(spark, path, null_tokens=False).orderBy("i").collect()
    assert raw[3]["t"] == "NA"


def test_csv_schema_matches_by_name(spark, tmp_path):
    path = str(tmp_path / "c")
    csv.write_csv(spark.createDataFrame([("x", "1", "z")], "b string, a string, more string"), path)
    schema = spark.createDataFrame([], "a long, b string, missing double").schema
    assert csv.read_csv(spark, path, schema).collect() == [(1, "x", None)]


def test_latest_file(spark, tmp_path):
    for name, when in (("b.csv", 200), ("a.csv", 300), ("c.csv", 300), ("d.txt", 900)):
        (tmp_path / name).write_text("feedback_id\n1\n")
        os.utime(tmp_path / name, (when, when))
    assert files.latest_path(spark, str(tmp_path), "*.csv").endswith("/c.csv")
    assert files.latest_path(spark, str(tmp_path), "*.none") is None
    assert tables.load_latest(spark, str(tmp_path), str(tmp_path / "raw"), "*.none") is None


def test_latest_file_takes_a_folder_of_part_files(spark, tmp_path):
    folder = tmp_path / "a b" / "a b"  # the name of the folder twice in its path
    spark.range(40).repartition(4).write.parquet(str(folder / "documents.parquet"))
    spark.range(3).coalesce(1).write.parquet(str(folder / "documents_old.parquet"))
    spark.range(5).coalesce(1).write.parquet(str(folder / "labels.parquet"))
    for path in (folder / "documents_old.parquet").iterdir():
        os.utime(path, (100, 100))
    path = files.latest_path(spark, str(folder), "documents*.parquet")
    assert path.endswith("/a b/a b/documents.parquet")
    assert spark.read.parquet(path).count() == 40
    assert files.latest_path(spark, str(folder), "part-*") is None
    parts = [p.stat().st_size for p in (folder / "documents.parquet").glob("part-*")]
    assert files.latest_file(spark, str(folder), "{documents,x}.p?rquet").first()["length"] == sum(parts)


def test_upload_fills_missing_mileage(spark, tmp_path):
    path = tmp_path / "up.csv"
    head = ",".join(n for n in NAMES if n != "mileage")
    path.write_text(f'{head}\na,2024-01-01,en,m,d,"one, two",c\nb,2024-01-01,en,,d,text,c\n')
    assert tables.load_latest(spark, str(tmp_path), str(tmp_path / "raw")) == 1
    row = spark.read.parquet(str(tmp_path / "raw")).first()
    assert row["mileage"] == 0 and row["customer_feedback"] == "one, two"


def test_stage_skips_finished_and_rebuilds_broken(spark, tmp_path):
    path = str(tmp_path / "s")
    assert tables.stage(spark, path, lambda: spark.range(3)).count() == 3
    assert tables.stage(spark, path, lambda: spark.range(9)).count() == 3
    assert tables.stage(spark, path, lambda: spark.range(9), resume=False).count() == 9
    os.remove(f"{path}/_SUCCESS")
    assert tables.stage(spark, path, lambda: spark.range(4)).count() == 4


def test_query_parameters(spark):
    df = spark.createDataFrame([(1, "x' OR 1=1"), (2, "y")], "i long, t string")
    got = tables.run_query(spark, "SELECT i FROM {t} WHERE t = :v", {"v": "x' OR 1=1"}, t=df)
    assert [r["i"] for r in got.collect()] == [1]
    assert tables.table_count(df).first()["count"] == 2


def test_stages_are_keyed_by_their_input(spark, tmp_path):
    path, one, two = str(tmp_path / "s"), spark.range(3), spark.range(4)
    for df in (one, two, one.repartition(2)):
        assert tables.stage(spark, path, lambda: df, key=tables.fingerprint(df)).count() == df.count()
    assert tables.fingerprint(one) == tables.fingerprint(one.repartition(2)) != tables.fingerprint(one, 1)
    assert len(os.listdir(path)) == 2


def test_newest_drop_is_read_whole_and_by_each_header(spark, tmp_path):
    old, new = tmp_path / "old.csv", tmp_path / "two words"
    old.write_text("feedback_id,language\n9,en\n")
    os.utime(old, (100, 100))
    new.mkdir()
    (new / "a.csv").write_text("feedback_id,language\n1,de\n")
    (new / "b.csv").write_text("language,feedback_id,more\nfr,2,x\n")
    paths = files.latest_drop(spark, str(tmp_path), "*.csv")
    assert len(paths) == 2
    got = csv.read_csv(spark, str(new), csv.text_schema("feedback_id", "language")).collect()
    assert sorted(got) == [("1", "de"), ("2", "fr")]
    parts = str(tmp_path / "landing" / "x")
    csv.write_csv(spark.range(40).repartition(4), parts)
    assert len(files.latest_drop(spark, parts, "*.csv")) == 4
    assert files.latest_drop(spark, str(tmp_path), "*.none") == []


def test_stream_inserts_each_file_once(spark, tmp_path):
    drops, path, check = (str(tmp_path / n) for n in ("drops", "raw", "check"))

    def run():
        rows = ingest.read_drops(spark, drops, csv.text_schema(*NAMES))
        ingest.ingest(rows, path, check).awaitTermination()

    csv.write_csv(batch(spark, record("a"), record("b")), drops, mode="append")
    run()
    csv.write_csv(batch(spark, record("b", "again"), record("c")), drops, mode="append")
    run()
    run()
    got = {r["feedback_id"]: r["customer_feedback"] for r in spark.read.parquet(path).collect()}
    assert got == {"a": "t", "b": "t", "c": "t"}
