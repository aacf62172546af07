"""Feedback-shaped views over the test tables, for Spark and as oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``fb``: documents with an event time and type and a country."""
    d, e, n = (table(spark, sf_dir, t) for t in ("documents", "events", "nation"))
    return (
        d.join(e, e.event_id == d.doc_id, "left")
        .join(n, n.n_nationkey == d.doc_id % 25, "left")
        .select(
            d.doc_id.alias("feedback_id"),
            e.ts.alias("timestamp"),
            d.lang.alias("language"),
            F.when(d.doc_id % 11 == 5, None).otherwise(d.source).alias("vehicle_model"),
            e.event_type.alias("domain"),
            d.text.alias("customer_feedback"),
            n.n_name.alias("country"),
            F.when(d.doc_id % 7 == 3, None).otherwise(d.n_chars).alias("mileage"),
        )
    )


def documents_as_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``fb`` that come from documents alone, without joins."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("feedback_id"),
        F.col("lang").alias("language"),
        F.when(F.col("doc_id") % 11 == 5, None).otherwise(F.col("source")).alias("vehicle_model"),
        F.col("text").alias("customer_feedback"),
    )


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cl``: embeddings with their label as cluster, every tenth one noise."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("feedback_id"),
        F.when(F.col("vec_id") % 10 == 0, -1).otherwise(F.col("label")).alias("cluster_id"),
        (F.lit(1.0) - (F.col("vec_id") % 10).cast("double") / F.lit(20.0)).alias(
            "cluster_confidence"
        ),
        "embedding",
    )


def _with_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = table(spark, sf_dir, "documents"), table(spark, sf_dir, "part")
    return d.join(p, p.p_partkey == d.doc_id % 200)


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ent_raw``: entity answers, some fenced, some prefixed, some without JSON."""
    which = F.col("doc_id") % 4
    severity = (
        F.when(which == 0, "critical").when(which == 1, "High").when(which == 2, "low")
        .otherwise("unknown")
    )
    body = F.concat(
        F.lit('{"component":"'), "p_type", F.lit('","failure_mode":"'), "p_name",
        F.lit('","severity":"'), severity, F.lit('","symptom":"'), "source", F.lit('"}'),
    )
    kind = F.col("doc_id") % 5
    content = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.lit("no structured answer"))
        .when(kind == 2, F.concat(F.lit("Result: "), body))
        .otherwise(body)
    )
    return _with_part(spark, sf_dir).select(
        F.col("doc_id").alias("feedback_id"), content.alias("content")
    )


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ent``: structured entities by expression."""
    which = F.col("doc_id") % 4
    return _with_part(spark, sf_dir).select(
        F.col("doc_id").alias("feedback_id"),
        F.col("p_type").alias("component"),
        F.col("p_name").alias("failure_mode"),
        F.col("source").alias("symptom"),
        F.when(which == 0, "critical").when(which == 1, "high").when(which == 2, "low")
        .otherwise("medium").alias("severity"),
        F.col("lang").alias("driving_condition"),
        F.lit("negative").alias("sentiment"),
        F.lit(0.95).alias("confidence"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lab``: one labelled row per cluster of ``cl``."""
    cl = clustered(spark, sf_dir).filter("cluster_id <> -1").select("feedback_id", "cluster_id")
    fb = documents_as_feedback(spark, sf_dir).select("feedback_id", "customer_feedback")
    ent = entities(spark, sf_dir).select("feedback_id", "component", "symptom")
    return (
        cl.join(fb, "feedback_id")
        .join(ent, "feedback_id")
        .groupBy("cluster_id")
        .agg(
            F.min("component").alias("root_component"),
            F.min("symptom").alias("recurring_symptom"),
            F.count("*").alias("failure_frequency"),
            F.min_by("customer_feedback", "feedback_id").alias("representative_complaint"),
        )
        .select(
            "cluster_id",
            F.concat(F.lit("pattern "), F.col("cluster_id").cast("string")).alias("label"),
            "root_component",
            "recurring_symptom",
            "failure_frequency",
            "representative_complaint",
            F.lit(0.85).alias("confidence"),
        )
    )


VIEW_SQL = {
    "fb": """
SELECT d.doc_id AS feedback_id, e.ts AS timestamp, d.lang AS language,
       CASE WHEN d.doc_id % 11 = 5 THEN NULL ELSE d.source END AS vehicle_model,
       e.event_type AS domain, d.text AS customer_feedback, n.n_name AS country,
       CASE WHEN d.doc_id % 7 = 3 THEN NULL ELSE d.n_chars END AS mileage
FROM documents d
LEFT JOIN events e ON e.event_id = d.doc_id
LEFT JOIN nation n ON n.n_nationkey = d.doc_id % 25""",
    "cl": """
SELECT vec_id AS feedback_id,
       CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS cluster_id,
       CAST(1 AS DOUBLE) - CAST(vec_id % 10 AS DOUBLE) / CAST(20 AS DOUBLE) AS cluster_confidence,
       embedding
FROM embeddings""",
    "ent_raw": """
SELECT d.doc_id AS feedback_id,
       CASE d.doc_id % 5
         WHEN 0 THEN concat('```json
', j, '
```')
         WHEN 1 THEN 'no structured answer'
         WHEN 2 THEN concat('Result: ', j)
         ELSE j END AS content
FROM (SELECT doc_id, concat('{"component":"', p.p_type, '","failure_mode":"', p.p_name, '","severity":"',
             CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'High' WHEN 2 THEN 'low' ELSE 'unknown' END,
             '","symptom":"', source, '"}') AS j
      FROM documents JOIN part p ON p.p_partkey = doc_id % 200) d""",
    "ent": """
SELECT doc_id AS feedback_id, p.p_type AS component, p.p_name AS failure_mode, source AS symptom,
       CASE doc_id % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'low' ELSE 'medium' END AS severity,
       lang AS driving_condition, 'negative' AS sentiment, CAST(0.95 AS DOUBLE) AS confidence
FROM documents JOIN part p ON p.p_partkey = doc_id % 200""",
    "lab": """
SELECT cl.cluster_id, concat('pattern ', CAST(cl.cluster_id AS VARCHAR)) AS label,
       min(ent.component) AS root_component, min(ent.symptom) AS recurring_symptom,
       count(*) AS failure_frequency, min_by(fb.customer_feedback, fb.feedback_id) AS representative_complaint,
       CAST(0.85 AS DOUBLE) AS confidence
FROM cl JOIN fb ON fb.feedback_id = cl.feedback_id JOIN ent ON ent.feedback_id = cl.feedback_id
WHERE cl.cluster_id <> -1 GROUP BY cl.cluster_id""",
}
_NEEDS = {"lab": ("fb", "cl", "ent")}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named views, and those they need, as CTEs."""
    wanted: list[str] = []
    for name in names:
        for one in (*_NEEDS.get(name, ()), name):
            if one not in wanted:
                wanted.append(one)
    ctes = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in wanted)
    head, _, rest = sql.strip().partition(" ")
    if head.upper() == "WITH" and not rest.upper().startswith("RECURSIVE"):
        return f"WITH {ctes},\n{rest}"
    if head.upper() == "WITH":
        return f"WITH RECURSIVE {ctes},\n{rest[len('RECURSIVE'):]}"
    return f"WITH {ctes}\n{sql.strip()}"
