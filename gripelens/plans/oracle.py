"""The same queries as SQL for DuckDB over the same tables."""

from __future__ import annotations

from gripelens.plans.catalog import MERGE_THRESHOLD, SEARCH_TEXT, STOP_WORDS
from gripelens.plans.views import with_views

VIN = r"\b[A-HJ-NPR-Z0-9]{17}\b"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"\b[\+]?[(]?[0-9]{3}[)]?[-\s\.]?[0-9]{3}[-\s\.]?[0-9]{4,6}\b"
LONG_NUMBER = r"[\+]?[0-9]{1,3}[-\s\.]?[0-9]{6,14}"


def clean(c: str) -> str:
    c = f"regexp_replace({c}, '{VIN}', '', 'gi')"
    for pattern in (EMAIL, PHONE, LONG_NUMBER):
        c = f"regexp_replace({c}, '{pattern}', '', 'g')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
DEDUPED = """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY customer_feedback ORDER BY feedback_id) AS rn FROM fb)
WHERE rn = 1"""
CLEANED = f"""
SELECT feedback_id, timestamp, language, vehicle_model, domain, {clean("customer_feedback")} AS customer_feedback,
       country, mileage
FROM ({DEDUPED}) WHERE customer_feedback IS NOT NULL AND language IS NOT NULL AND vehicle_model IS NOT NULL"""
ISO = "strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f')"
COERCED = f"""
SELECT CAST(feedback_id AS VARCHAR) AS feedback_id, {ISO} AS timestamp, language, vehicle_model, domain,
       customer_feedback, country, coalesce(mileage, 0) AS mileage FROM fb"""
STORED = f"""
SELECT * FROM ({COERCED}) WHERE feedback_id IS NOT NULL AND timestamp IS NOT NULL AND language IS NOT NULL
  AND vehicle_model IS NOT NULL AND domain IS NOT NULL AND customer_feedback IS NOT NULL AND country IS NOT NULL"""

JSON_TEXT = r"regexp_extract(content, '\{.*\}', 0, 's')"
PARSED = f"""
SELECT feedback_id, content, CASE WHEN json_valid(content) THEN 'success' ELSE 'malformed' END AS parse_status,
       {JSON_TEXT} AS j, {JSON_TEXT} <> '' AS has_entity
FROM ent_raw"""


def _json(field: str) -> str:
    return f"json_extract_string(j, '$.{field}')"


_SEVERITY = f"""CASE WHEN lower({_json("severity")}) IN ('critical', 'high', 'medium', 'low')
  THEN {_json("severity")} ELSE 'medium' END"""
_SENTIMENT = f"""CASE WHEN lower({_json("sentiment")}) IN ('negative', 'neutral', 'positive')
  THEN {_json("sentiment")} ELSE 'negative' END"""


def _valid(always: bool) -> str:
    fields = {
        "component": f"coalesce({_json('component')}, '')",
        "failure_mode": f"coalesce({_json('failure_mode')}, '')",
        "symptom": f"coalesce({_json('symptom')}, '')",
        "severity": _SEVERITY,
        "driving_condition": f"coalesce({_json('driving_condition')}, '')",
        "sentiment": _SENTIMENT,
    }
    if always:
        return ", ".join(f"{v} AS {k}" for k, v in fields.items())
    return ", ".join(f"CASE WHEN has_entity THEN {v} END AS {k}" for k, v in fields.items())


VALUE_COUNTS = """SELECT {c}, count(*) AS count FROM {t} WHERE {c} IS NOT NULL GROUP BY {c}
ORDER BY count DESC, {c}"""
TEXTS = """
SELECT fb.feedback_id, fb.customer_feedback, cl.cluster_id
FROM fb JOIN cl ON fb.feedback_id = cl.feedback_id WHERE cl.cluster_id <> -1"""
TOKENS = f"""
SELECT cluster_id, feedback_id, term FROM (
  SELECT cluster_id, feedback_id,
         unnest(regexp_extract_all(lower(customer_feedback), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM texts)
WHERE term NOT IN ({STOP})"""
VOCAB = """
SELECT cluster_id, term, total FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY total DESC, term) AS r FROM (
    SELECT cluster_id, term, count(*) AS total FROM tokens GROUP BY ALL))"""
WEIGHTS = """
SELECT cluster_id, feedback_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster_id, feedback_id)) AS weight
FROM (
  SELECT c.cluster_id, c.feedback_id, c.term,
         tf * (ln((CAST(1 AS DOUBLE) + n) / (CAST(1 AS DOUBLE) + df)) + CAST(1 AS DOUBLE)) AS w
  FROM (SELECT cluster_id, feedback_id, term, count(*) AS tf FROM tokens
        JOIN vocab USING (cluster_id, term) GROUP BY ALL) c
  JOIN (SELECT cluster_id, term, count(DISTINCT feedback_id) AS df FROM tokens GROUP BY ALL) d
    ON c.cluster_id = d.cluster_id AND c.term = d.term
  JOIN (SELECT cluster_id, count(*) AS n FROM texts GROUP BY ALL) n ON n.cluster_id = c.cluster_id)"""
SCORES = """
SELECT w.cluster_id, term, sum(weight) / any_value(n) AS score
FROM weights w JOIN (SELECT cluster_id, count(*) AS n FROM texts GROUP BY ALL) n ON n.cluster_id = w.cluster_id
GROUP BY w.cluster_id, term"""
KEYWORDS = """
SELECT cluster_id, string_agg(term, ' ' ORDER BY r) AS keywords,
       string_agg(CASE WHEN r <= 2 THEN term END, ' ' ORDER BY r) AS label FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY round(score, 12) DESC, term DESC) AS r FROM scores)
WHERE r <= 5 GROUP BY cluster_id"""
TFIDF = f"""WITH texts AS ({TEXTS}), tokens AS ({TOKENS}), vocab AS ({VOCAB}), weights AS ({WEIGHTS}),
scores AS ({SCORES}), kw AS ({KEYWORDS})"""

LEXICON = """
SELECT DISTINCT term, length(term) AS priority,
  CASE length(term) WHEN 4 THEN 'severity' WHEN 5 THEN 'driving_condition' WHEN 6 THEN 'symptom'
    WHEN 7 THEN 'failure_mode' ELSE 'component' END AS field
FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM benchmark)
WHERE length(term) BETWEEN 4 AND 9"""
MATCHES = """
SELECT feedback_id, field, term, priority, pos
FROM (SELECT doc_id AS feedback_id, unnest(w) AS term, unnest(range(len(w))) AS pos
      FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents))
JOIN lexicon USING (term)"""


def _best(field: str) -> str:
    return f"max(CASE WHEN r = 1 AND field = '{field}' THEN term END)"


PAIRS = f"""WITH centroid AS (
  SELECT cluster_id, list(value ORDER BY pos) AS c FROM (
    SELECT cluster_id, pos, avg(CAST(x AS DOUBLE)) AS value FROM (
      SELECT cluster_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM cl
      WHERE cluster_id <> -1) GROUP BY cluster_id, pos) GROUP BY cluster_id),
pairs AS (
  SELECT a.cluster_id AS i, b.cluster_id AS j, list_cosine_similarity(a.c, b.c) AS s
  FROM centroid a JOIN centroid b ON a.cluster_id < b.cluster_id
  WHERE list_cosine_similarity(a.c, b.c) >= {MERGE_THRESHOLD})"""
# Cluster by cluster in id order: kept ids so far decide whether the next one is mapped.
MERGES = (
    PAIRS.replace("WITH centroid", "WITH RECURSIVE centroid", 1)
    + """,
ordered AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS n FROM centroid),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS INTEGER[]) AS kept
  UNION ALL
  SELECT o.n, CASE WHEN EXISTS (SELECT 1 FROM pairs p WHERE p.j = o.cluster_id AND list_contains(w.kept, p.i))
                   THEN w.kept ELSE list_append(w.kept, o.cluster_id) END
  FROM walk w JOIN ordered o ON o.n = w.n + 1),
final AS (SELECT kept FROM walk ORDER BY n DESC LIMIT 1),
merges AS (
  SELECT j AS old_id, min(i) AS new_id FROM pairs, final
  WHERE list_contains(kept, i) AND NOT list_contains(kept, j) GROUP BY j)"""
)
EUCLIDEAN_DISTANCE = "list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
COSINE_DISTANCE = "1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))"
KNN = """SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(dist, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS rank FROM (
    SELECT a.vec_id AS src, b.vec_id AS dst, {dist} AS dist
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)) WHERE rank <= {k}"""

RAW_KNN = KNN.replace("round(dist, 6) AS dist", "dist")
# Bisection on a logarithmic scale, 128 times, for the width at which the weights of a
# point add up to log2 of their number.
FUZZY = f"""WITH lists AS (
  SELECT src, list(dst ORDER BY rank) AS dsts, list(greatest(dist - low, 0) ORDER BY rank) AS e
  FROM (SELECT *, min(dist) OVER (PARTITION BY src) AS low FROM ({RAW_KNN.format(k=15, dist=COSINE_DISTANCE)}))
  GROUP BY src),
widths AS (
  SELECT *, list_reduce([[0.0, 0.0]::DOUBLE[] FOR i IN range(128)],
    lambda s, x: CASE WHEN list_sum(list_transform(e, lambda v: exp(-v / sqrt(s[1] * s[2])))) > log2(greatest(len(e), 2))
                 THEN [s[1], sqrt(s[1] * s[2])] ELSE [sqrt(s[1] * s[2]), s[2]] END,
    [1e-12, 1e12]::DOUBLE[]) AS ends FROM lists),
directed AS (
  SELECT src, unnest(dsts) AS dst, unnest(list_transform(e, lambda v: exp(-v / sqrt(ends[1] * ends[2])))) AS w FROM widths),
both_ways AS (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst,
         coalesce(max(w) FILTER (src < dst), 0) AS a, coalesce(max(w) FILTER (src > dst), 0) AS b
  FROM directed GROUP BY ALL)
SELECT src, dst, round(a + b - a * b, 6) AS weight FROM both_ways"""
# The tree grows from one point, each time by the point that is cheapest to reach.
TREE_WEIGHT = f"""WITH RECURSIVE pairs AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, {EUCLIDEAN_DISTANCE} AS d FROM embeddings a, embeddings b),
core AS (
  SELECT a, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d) AS r FROM pairs WHERE a <> b)
  WHERE r = 10),
edges AS MATERIALIZED (
  SELECT p.a, p.b, greatest(x.core, y.core, d) AS w
  FROM pairs p JOIN core x ON x.a = p.a JOIN core y ON y.a = p.b WHERE p.a <> p.b),
grown(id, best, done) USING KEY (id) AS (
  SELECT vec_id, CASE WHEN vec_id = (SELECT min(vec_id) FROM embeddings) THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END, false
  FROM embeddings
  UNION
  SELECT g.id, CASE WHEN g.id = n.id THEN g.best ELSE least(g.best, w) END, g.id = n.id
  FROM (SELECT id FROM recurring.grown WHERE NOT done ORDER BY best, id LIMIT 1) n,
       recurring.grown g LEFT JOIN edges ON edges.a = n.id AND edges.b = g.id
  WHERE NOT g.done)
SELECT count(*) - 1 AS edges, round(sum(best), 6) AS total_weight FROM grown"""

SQL = {
    "clean_text": f"SELECT doc_id AS feedback_id, {clean('text')} AS customer_feedback FROM documents",
    "scrub_counts": f"""SELECT count(*) AS rows_seen,
        count(*) FILTER (regexp_matches(text, '{VIN}', 'i')) AS vin_rows,
        count(*) FILTER (regexp_matches(text, '{EMAIL}')) AS email_rows,
        count(*) FILTER (regexp_matches(text, '{PHONE}')) AS phone_rows,
        count(*) FILTER (regexp_matches(text, '{LONG_NUMBER}')) AS long_number_rows FROM documents""",
    "dedupe_first": with_views(f"SELECT feedback_id, language, vehicle_model FROM ({DEDUPED})", "fb"),
    "clean_feedback": with_views(CLEANED, "fb"),
    "cleaned_per_language": with_views(
        f"""SELECT language, count(*) AS complaints, CAST(sum(length(customer_feedback)) AS BIGINT) AS cleaned_chars
        FROM ({CLEANED}) GROUP BY language""",
        "fb",
    ),
    "cleaning_stats": with_views(
        f"""SELECT n AS initial_rows, n - kept AS duplicates, nulls AS null_rows, kept - nulls AS final_rows,
        n - kept + nulls AS removed_rows
        FROM (SELECT (SELECT count(*) FROM fb) AS n, count(*) AS kept,
              count(*) FILTER (vehicle_model IS NULL OR customer_feedback IS NULL OR language IS NULL) AS nulls
              FROM ({DEDUPED}))""",
        "fb",
    ),
    "coerce_records": with_views(COERCED, "fb"),
    "insert_or_ignore": with_views(f"SELECT feedback_id, language, mileage FROM ({STORED})", "fb"),
    "upload_feedback": with_views(STORED, "fb"),
    "load_latest": with_views(STORED, "fb"),
    "latest_file": "SELECT doc_id, lang, n_chars FROM documents",
    "csv_roundtrip": "SELECT * FROM documents",
    "export_report": with_views(
        "SELECT * FROM lab", "lab"
    ),
    "vector_roundtrip": """SELECT vec_id, CAST(len(embedding) AS INTEGER) AS dimension,
        round(CAST(embedding[1] AS DOUBLE), 6) AS first_value,
        round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings""",
    "sql_param_query": with_views(
        "SELECT feedback_id, language, mileage FROM fb WHERE language = 'en' AND mileage >= 1000", "fb"
    ),
    "table_count": with_views("SELECT count(*) AS count FROM fb", "fb"),
    "skip_existing": with_views(
        """SELECT cluster_id, count(*) AS size, 'same' AS input FROM cl GROUP BY cluster_id
        UNION ALL SELECT cluster_id, count(*), 'new' FROM cl WHERE cluster_id = 0 GROUP BY cluster_id""",
        "cl",
    ),
    "entity_parse": with_views(
        f"""SELECT feedback_id, {", ".join(f"{_json(f)} AS {f}" for f in
        ("component", "failure_mode", "symptom", "severity", "driving_condition", "sentiment"))}
        FROM ({PARSED}) WHERE parse_status = 'success'""",
        "ent_raw",
    ),
    "entity_repair": with_views(
        f"""SELECT feedback_id, has_entity AS repaired,
        CASE WHEN has_entity THEN {_json("component")} END AS component,
        CASE WHEN has_entity THEN {_json("severity")} END AS severity
        FROM ({PARSED}) WHERE parse_status = 'malformed'""",
        "ent_raw",
    ),
    "entity_validate": with_views(f"SELECT feedback_id, {_valid(False)} FROM ({PARSED})", "ent_raw"),
    "entity_rows": with_views(
        f"""SELECT feedback_id, {_valid(True)}, CAST(0.95 AS DOUBLE) AS confidence
        FROM ({PARSED}) WHERE has_entity""",
        "ent_raw",
    ),
    "extraction_stats": with_views(
        f"""SELECT count(*) FILTER (parse_status = 'success') AS successful,
        count(*) FILTER (parse_status = 'malformed') AS malformed, CAST(0 AS BIGINT) AS failed FROM ({PARSED})""",
        "ent_raw",
    ),
    "format_entities": with_views(
        """SELECT feedback_id, concat('Component: ', component, ' | Failure: ', failure_mode, ' | Symptom: ', symptom,
        ' | Severity: ', severity, ' | Condition: ', driving_condition) AS formatted_text FROM ent""",
        "ent",
    ),
    "lexicon_matches": f"""WITH lexicon AS ({LEXICON}), matches AS ({MATCHES})
        SELECT feedback_id, field, count(*) AS hits, min(pos) AS first_position FROM matches GROUP BY ALL""",
    "lexicon_entities": f"""WITH lexicon AS ({LEXICON}), matches AS ({MATCHES})
        SELECT feedback_id, coalesce({_best("component")}, '') AS component,
        coalesce({_best("failure_mode")}, '') AS failure_mode, coalesce({_best("symptom")}, '') AS symptom,
        CASE WHEN {_best("severity")} IN ('critical', 'high', 'medium', 'low') THEN {_best("severity")}
          ELSE 'medium' END AS severity,
        coalesce({_best("driving_condition")}, '') AS driving_condition, 'negative' AS sentiment,
        CAST(0.95 AS DOUBLE) AS confidence
        FROM (SELECT *, row_number() OVER (PARTITION BY feedback_id, field ORDER BY priority DESC, pos, term) AS r
              FROM (SELECT doc_id AS feedback_id, field, term, priority, pos FROM documents
                    LEFT JOIN matches ON matches.feedback_id = doc_id)) GROUP BY feedback_id""",
    "noise_flag_coords": with_views(
        """SELECT feedback_id, cluster_id, round(cluster_confidence, 6) AS cluster_confidence,
        round(CAST(embedding[1] AS DOUBLE), 6) AS umap_x, round(CAST(embedding[2] AS DOUBLE), 6) AS umap_y,
        cluster_id = -1 AS is_noise FROM cl""",
        "cl",
    ),
    "cluster_map": with_views(
        """SELECT round(CAST(embedding[1] AS DOUBLE), 6) AS x, round(CAST(embedding[2] AS DOUBLE), 6) AS y,
        cluster_id, feedback_id FROM cl""",
        "cl",
    ),
    "display_fields": """SELECT doc_id AS feedback_id, substr(text, 1, 300) AS preview, upper(lang) AS language,
        '85.00%' AS confidence FROM documents""",
    "label_table": with_views(
        "SELECT label, failure_frequency, root_component, recurring_symptom, confidence FROM lab", "lab"
    ),
    "summary_table": with_views(
        "SELECT cluster_id, label, failure_frequency, root_component FROM lab ORDER BY cluster_id", "lab"
    ),
    "facet_search": with_views(
        """SELECT feedback_id, vehicle_model, language, domain, country FROM fb
        WHERE language IN ('en', 'fr') AND domain IN ('click', 'view')""",
        "fb",
    ),
    "facet_search_page": with_views(
        """SELECT feedback_id, language, domain, customer_feedback FROM fb
        WHERE language IN ('en', 'fr') AND domain IN ('click', 'view') ORDER BY feedback_id LIMIT 20""",
        "fb",
    ),
    "facet_values": with_views(
        " UNION ".join(
            f"SELECT '{c}' AS facet, {c} AS value FROM fb"
            for c in ("vehicle_model", "language", "domain", "country")
        ),
        "fb",
    ),
    "search_feedback": with_views(
        f"""SELECT feedback_id, language, customer_feedback FROM fb
        WHERE feedback_id IN (SELECT feedback_id FROM cl WHERE cluster_id = 3)
          AND translate(customer_feedback, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
              LIKE '%{SEARCH_TEXT.lower()}%'""",
        "fb",
        "cl",
    ),
    "cluster_lookup": with_views(
        """SELECT cluster_id, failure_frequency, root_component, recurring_symptom, '85.00%' AS confidence,
        substr(representative_complaint, 1, 300) AS representative_complaint
        FROM lab WHERE label = 'pattern 3' ORDER BY cluster_id LIMIT 1""",
        "lab",
    ),
    "cluster_members": with_views(
        """SELECT feedback_id, upper(language) AS language, vehicle_model, domain, customer_feedback, country, mileage
        FROM fb WHERE feedback_id IN (SELECT feedback_id FROM cl WHERE cluster_id = 3)
        ORDER BY feedback_id LIMIT 5""",
        "fb",
        "cl",
    ),
    "cluster_texts": with_views(TEXTS, "fb", "cl"),
    "cluster_stats": with_views(
        """SELECT count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS clusters,
        count(*) FILTER (cluster_id = -1) AS noise_points, count(*) AS total_points,
        count(*) FILTER (cluster_id = -1) * CAST(100 AS DOUBLE) / count(*) AS noise_percentage FROM cl""",
        "cl",
    ),
    "cluster_preview": with_views(
        "SELECT feedback_id, cluster_id, cluster_confidence FROM cl ORDER BY feedback_id LIMIT 10", "cl"
    ),
    "cluster_ids": with_views("SELECT DISTINCT cluster_id FROM cl WHERE cluster_id <> -1", "cl"),
    "cluster_info": with_views(
        """SELECT cluster_id, count(*) AS size,
        round(count(*) * CAST(100 AS DOUBLE) / (SELECT count(*) FROM cl), 6) AS percentage
        FROM cl WHERE cluster_id <> -1 GROUP BY cluster_id""",
        "cl",
    ),
    "failure_frequency": with_views(
        "SELECT cluster_id, count(*) AS failure_frequency FROM cl WHERE cluster_id <> -1 GROUP BY cluster_id", "cl"
    ),
    "failure_totals": with_views(
        """SELECT count(*) AS total_clusters, CAST(sum(failure_frequency) AS BIGINT) AS total_failures,
        max(failure_frequency) AS top_cluster_size FROM lab""",
        "lab",
    ),
    "overview_metrics": with_views(
        """SELECT count(*) AS total_issues,
        count(DISTINCT CASE WHEN cluster_id <> -1 THEN cluster_id END) AS clusters,
        count(*) FILTER (cluster_id = -1) AS noise_points,
        count(*) FILTER (cluster_id = -1) * CAST(100 AS DOUBLE) / count(*) AS noise_percentage,
        (SELECT max(failure_frequency) FROM lab) AS top_cluster_size FROM cl""",
        "lab",
    ),
    "language_counts": with_views(VALUE_COUNTS.format(c="language", t="fb"), "fb"),
    "country_top8": with_views(VALUE_COUNTS.format(c="country", t="fb") + " LIMIT 8", "fb"),
    "model_top6": with_views(VALUE_COUNTS.format(c="vehicle_model", t="fb") + " LIMIT 6", "fb"),
    "component_top5": with_views(VALUE_COUNTS.format(c="root_component", t="lab") + " LIMIT 5", "lab"),
    "component_top8": with_views(VALUE_COUNTS.format(c="root_component", t="lab") + " LIMIT 8", "lab"),
    "top_failures": with_views(
        """SELECT label, failure_frequency, root_component, recurring_symptom FROM lab
        ORDER BY failure_frequency DESC, cluster_id LIMIT 10""",
        "lab",
    ),
    "analytics": with_views(
        f"""SELECT * FROM (SELECT 'top_failure' AS section, label AS name, failure_frequency AS value FROM lab
               ORDER BY failure_frequency DESC, cluster_id LIMIT 10)
        UNION ALL SELECT 'component', * FROM ({VALUE_COUNTS.format(c="root_component", t="lab")} LIMIT 5)
        UNION ALL SELECT 'total', 'total_clusters', count(*) FROM lab
        UNION ALL SELECT 'total', 'total_failures', CAST(sum(failure_frequency) AS BIGINT) FROM lab""",
        "lab",
    ),
    "severity_distribution": with_views(
        """SELECT CASE WHEN failure_frequency > 50 THEN 'Critical' WHEN failure_frequency > 20 THEN 'High'
        WHEN failure_frequency > 10 THEN 'Medium' ELSE 'Low' END AS severity, count(*) AS count
        FROM lab GROUP BY 1""",
        "lab",
    ),
    "representatives": with_views(
        """SELECT cluster_id, feedback_id, i AS position FROM (
          SELECT cluster_id, feedback_id, row_number() OVER (PARTITION BY cluster_id ORDER BY feedback_id) - 1 AS i,
                 count(*) OVER (PARTITION BY cluster_id) AS n FROM cl WHERE cluster_id <> -1)
        WHERE n <= 3 OR (i % (n // 3) = 0 AND i // (n // 3) < 3)""",
        "cl",
    ),
    "representative_complaints": with_views(
        """SELECT cluster_id, coalesce(min_by(customer_feedback, fb.feedback_id), '') AS representative_complaint
        FROM cl LEFT JOIN fb ON fb.feedback_id = cl.feedback_id WHERE cluster_id <> -1 GROUP BY cluster_id""",
        "fb",
        "cl",
    ),
    "prompt_snippets": with_views(
        f"""SELECT cluster_id, string_agg('- ' || substr(customer_feedback, 1, 100), chr(10) ORDER BY feedback_id)
          AS snippets
        FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY feedback_id) AS r FROM ({TEXTS}))
        WHERE r <= 3 GROUP BY cluster_id""",
        "fb",
        "cl",
    ),
    "label_json": with_views(
        f"""SELECT feedback_id,
        CASE WHEN parse_status = 'success' THEN {_json("component")} ELSE 'red bolt' END AS label,
        '' AS root_component,
        CASE WHEN parse_status = 'success' THEN {_json("symptom")} ELSE '' END AS recurring_symptom,
        '' AS failure_pattern FROM ({PARSED})""",
        "ent_raw",
    ),
    "fallback_label": f"""SELECT item_id, CASE WHEN len(w) > 0 THEN array_to_string(w[1:2], ' ')
        ELSE 'Unknown Failure' END AS label
        FROM (SELECT item_id, list_filter(string_split(text, ' '),
              lambda x: regexp_full_match(x, '[a-z]{{4,}}') AND x NOT IN ({STOP})) AS w FROM benchmark)""",
    "tfidf_tokens": with_views(
        TFIDF
        + """ SELECT cluster_id, feedback_id, count(*) AS token_count, count(DISTINCT term) AS term_count,
        min(term) AS first_term, max(term) AS last_term FROM tokens GROUP BY ALL""",
        "fb",
        "cl",
    ),
    "tfidf_vocab": with_views(TFIDF + " SELECT cluster_id, term, total FROM vocab", "fb", "cl"),
    "tfidf_weights": with_views(
        TFIDF + " SELECT cluster_id, feedback_id, term, round(weight, 9) AS weight FROM weights", "fb", "cl"
    ),
    "tfidf_scores": with_views(
        TFIDF + " SELECT cluster_id, term, round(score, 9) AS score FROM scores", "fb", "cl"
    ),
    "tfidf_keywords": with_views(TFIDF + " SELECT cluster_id, keywords FROM kw", "fb", "cl"),
    "label_clusters": with_views(
        TFIDF
        + """, members AS (SELECT cluster_id, component, symptom FROM cl JOIN ent ON ent.feedback_id = cl.feedback_id
               WHERE cluster_id <> -1),
        comp AS (SELECT cluster_id, component FROM (SELECT cluster_id, component, row_number() OVER
               (PARTITION BY cluster_id ORDER BY count(*) DESC, component) AS r
               FROM members GROUP BY cluster_id, component)
               WHERE r = 1),
        symp AS (SELECT cluster_id, symptom FROM (SELECT cluster_id, symptom, row_number() OVER
               (PARTITION BY cluster_id ORDER BY count(*) DESC, symptom) AS r
               FROM members GROUP BY cluster_id, symptom)
               WHERE r = 1)
        SELECT f.cluster_id, coalesce(kw.label, 'Unknown Failure') AS label, component AS root_component,
          symptom AS recurring_symptom, failure_frequency, representative_complaint,
          CAST(0.85 AS DOUBLE) AS confidence
        FROM (SELECT cluster_id, count(*) AS failure_frequency FROM cl WHERE cluster_id <> -1 GROUP BY cluster_id) f
        LEFT JOIN kw ON kw.cluster_id = f.cluster_id
        LEFT JOIN comp ON comp.cluster_id = f.cluster_id LEFT JOIN symp ON symp.cluster_id = f.cluster_id
        LEFT JOIN (SELECT cluster_id, min_by(customer_feedback, feedback_id) AS representative_complaint
                   FROM texts GROUP BY cluster_id) t ON t.cluster_id = f.cluster_id""",
        "fb",
        "cl",
        "ent",
    ),
    "quality_cleaning": with_views(
        """SELECT 'invalid_utf8' AS rule, CAST(0 AS BIGINT) AS violations
        UNION ALL SELECT 'null_critical_field', count(*) FROM fb WHERE vehicle_model IS NULL OR language IS NULL
          OR customer_feedback IS NULL
        UNION ALL SELECT 'duplicate_text', count(*) - count(DISTINCT customer_feedback) FROM fb""",
        "fb",
    ),
    "quality_extraction": with_views(
        f"""SELECT 'missing_field' AS rule, count(*) AS violations FROM ent WHERE component IS NULL
          OR failure_mode IS NULL OR symptom IS NULL OR severity IS NULL OR driving_condition IS NULL
        UNION ALL SELECT 'confidence_not_positive', count(*) FROM ent WHERE NOT confidence > 0
        UNION ALL SELECT 'invalid_json', count(*) FROM ({PARSED}) WHERE parse_status <> 'success'""",
        "ent",
        "ent_raw",
    ),
    "quality_vectors": """SELECT 'extra_dimension' AS rule, count(DISTINCT len(embedding)) - 1 AS violations
        FROM embeddings
        UNION ALL SELECT 'null_vector', count(*) FROM embeddings WHERE embedding IS NULL
        UNION ALL SELECT 'null_or_nan_component', count(*) FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) > 0""",
    "quality_clusters": with_views(
        """SELECT 'missing_cluster_id' AS rule, CAST(max(cluster_id) + 1 - count(DISTINCT cluster_id) AS BIGINT)
          AS violations FROM cl WHERE cluster_id <> -1
        UNION ALL SELECT 'confidence_out_of_range', count(*) FROM cl WHERE NOT cluster_confidence BETWEEN 0 AND 1
        UNION ALL SELECT 'empty_label', count(*) FROM lab WHERE coalesce(label, '') = ''
        UNION ALL SELECT 'frequency_not_positive', count(*) FROM lab WHERE NOT failure_frequency > 0""",
        "lab",
    ),
    "quality_constraints": with_views(
        " UNION ALL ".join(
            f"SELECT 'null_{c}' AS rule, count(*) AS violations FROM fb WHERE {c} IS NULL"
            for c in (
                "feedback_id timestamp language vehicle_model domain customer_feedback country".split()
            )
        )
        + " UNION ALL SELECT 'duplicate_feedback_id', count(*) - count(DISTINCT feedback_id) FROM fb",
        "fb",
    ),
    "orphan_keys": with_views(
        """SELECT doc_id AS feedback_id, 'vectors' AS missing_in FROM documents
          WHERE doc_id NOT IN (SELECT feedback_id FROM cl)
        UNION ALL SELECT feedback_id, 'documents' FROM cl WHERE feedback_id NOT IN (SELECT doc_id FROM documents)""",
        "cl",
    ),
    "embedding_metadata": """SELECT vec_id AS feedback_id, CAST(len(embedding) AS INTEGER) AS dimension,
        row_number() OVER (ORDER BY vec_id) - 1 AS embedding_index FROM embeddings""",
    "centroids": with_views(
        """SELECT cluster_id, CAST(pos AS BIGINT) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS value FROM (
          SELECT cluster_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM cl
          WHERE cluster_id <> -1) GROUP BY cluster_id, pos""",
        "cl",
    ),
    "centroid_pairs": with_views(f"{PAIRS} SELECT i, j, round(s, 6) AS similarity FROM pairs", "cl"),
    "merge_map": with_views(f"{MERGES} SELECT old_id, new_id FROM merges", "cl"),
    "apply_merges": with_views(
        """SELECT feedback_id, coalesce(r_regionkey, cluster_id) AS cluster_id, cluster_confidence
        FROM cl LEFT JOIN region ON r_regionkey + 5 = cluster_id""",
        "cl",
    ),
    "refine_clusters": with_views(
        f"""{MERGES} SELECT feedback_id, coalesce(new_id, cluster_id) AS cluster_id
        FROM cl LEFT JOIN merges ON old_id = cluster_id""",
        "cl",
    ),
    "knn_cosine": KNN.format(k=15, dist=COSINE_DISTANCE),
    "knn_euclidean": KNN.format(k=10, dist=EUCLIDEAN_DISTANCE),
    "core_distance": f"""SELECT src AS id, dist AS core FROM ({KNN.format(k=10, dist=EUCLIDEAN_DISTANCE)})
        WHERE rank = 10""",
    "mutual_reachability": f"""WITH knn AS ({KNN.format(k=10, dist=EUCLIDEAN_DISTANCE)}),
        core AS (SELECT src AS id, dist AS core FROM knn WHERE rank = 10)
        SELECT src, dst, dist, greatest(a.core, b.core, dist) AS weight
        FROM knn JOIN core a ON a.id = src JOIN core b ON b.id = dst""",
    "fuzzy_graph": FUZZY,
    "mst_total_weight": TREE_WEIGHT,
    "silhouette": with_views(
        """, points AS (
          SELECT feedback_id, cluster_id, CAST(embedding AS DOUBLE[]) AS v FROM cl WHERE cluster_id <> -1),
        sums AS (
          SELECT a.feedback_id, a.cluster_id AS own, b.cluster_id AS other, count(*) AS n,
                 sum(list_distance(a.v, b.v) * list_distance(a.v, b.v)) AS total
          FROM points a, points b GROUP BY ALL),
        means AS (
          SELECT feedback_id, max(n) FILTER (own = other) AS n,
                 max(total / (n - 1)) FILTER (own = other AND n > 1) AS a, min(total / n) FILTER (own <> other) AS b
          FROM sums GROUP BY feedback_id)
        SELECT round(avg(CASE WHEN b IS NULL THEN NULL WHEN n = 1 OR a = b THEN 0 ELSE (b - a) / greatest(a, b) END), 6)
               AS silhouette FROM means""",
        "cl",
    ),
    "spectral_axes": """SELECT CAST(range AS INTEGER) AS axis, true AS in_range, true AS settled, true AS orthonormal
        FROM range(16)""",
    "stream_ingest": with_views(STORED, "fb"),
}
