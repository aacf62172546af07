"""The registered queries of the numbered operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gripelens.llm import (
    align,
    bpe,
    darts,
    lattice,
    licenses,
    pii,
    quality,
    quality_rules,
    sharding,
    suffixes,
    toxicity,
    trie,
    winnowing,
)

Query = Callable[[SparkSession, str], DataFrame]

#: The query's pseudonyms are of use only with a key that is kept secret.
PII_KEY = "replace-this-key"


def vocabulary_path(name: str) -> str:
    """A tokenizer file of the installed collection of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op2_lattice_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lattice.score_texts(_table(spark, sf, "documents"), vocabulary_path("piece_bpe_32k.model"))


def op3_bpe_streams(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_digests(_table(spark, sf, "documents"), vocabulary_path("word_bpe_49k.json"))


def op4_toxicity_grades(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op5_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pii.pseudonym_counts(_table(spark, sf, "documents"), PII_KEY)


def op6_quality_grades(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality(_table(spark, sf, "documents"), _table(spark, sf, "labels"))


def op7_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    found = winnowing.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_suffix_arrays(spark: SparkSession, sf: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, sf, "documents")).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        "n_spans",
        F.coalesce(F.sha2("kept", 256), "text_key").alias("kept_sha256"),
    )


def op9_extendible_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf, "documents"))


def op10_dart_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return darts.classes(_table(spark, sf, "documents")).select("doc_id", "class_id")


def op11_conversation_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns, lengths = trie.grafted(trie.ordered_turns(_table(spark, sf, "conversations")))
    nodes, ends = trie.prefix_trie(turns, lengths)
    return nodes.join(trie.member_digests(ends), "key", "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def op12_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return align.alignment_counts(
        _table(spark, sf, "documents"), vocabulary_path("byte_bpe_50k.json"), vocabulary_path("piece_bpe_32k.model")
    )


def op13_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scanned(_table(spark, sf, "documents"))
    base, met = F.col("places.label"), F.col("blocks.label")
    joined = {n: F.array_join(F.array_sort(F.array_distinct(c)), ",") for n, c in (("base", base), ("all", F.concat(base, met)))}
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.at").cast("long").alias("first_word"),
        F.array_max("places.at").cast("long").alias("last_word"),
        joined["base"].alias("base_labels"),
        joined["all"].alias("labels"),
        "score",
    )


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_lattice_scores,
        op3_bpe_streams,
        op4_toxicity_grades,
        op5_pseudonyms,
        op6_quality_grades,
        op7_winnowing,
        op8_suffix_arrays,
        op9_extendible_shards,
        op10_dart_minhash,
        op11_conversation_trie,
        op12_token_alignment,
        op13_license_scan,
    )
}

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_PHRASES = ", ".join(f"('{label}', '{phrase}')" for label, phrase in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"('{label}', '{text}')" for label, text in licenses.TEMPLATES)
_BLOCK, _STRIDE = licenses.BLOCK, licenses.STRIDE

SQL: dict[str, str] = {
    "op7_winnowing": rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS k,
         array_to_string(list_slice(w, spot, spot + least(13, len(w)) - 1), ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS spot FROM i WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, spot, array_to_string(list_slice(w, spot, spot + k - 1), ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS spot
        FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)
), hits AS (
  SELECT doc_id, item_id, k, spot FROM places JOIN windows USING (k, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(spot, spot + k)) AS p FROM (SELECT DISTINCT doc_id, k, spot FROM hits))
  GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL)
  GROUP BY doc_id
)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
""",
    "op9_extendible_shards": f"""
WITH a AS (
  SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         lpad(bin(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT), 60, '0') AS address
  FROM documents
), buckets AS (
  SELECT d, substr(address, 1, d) AS bucket, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS n
  FROM a, (SELECT unnest(range(0, 41)) AS d) GROUP BY ALL
), fits AS (
  SELECT * FROM buckets WHERE shard_bytes <= {sharding.SHARD_BYTES} OR (n = 1 AND d > 0)
), chosen AS (
  SELECT doc_id, n_bytes, arg_min(bucket, d) AS shard, min(d)::BIGINT AS depth, arg_min(shard_bytes, d) AS shard_bytes
  FROM a JOIN fits ON substr(address, 1, d) = bucket GROUP BY doc_id, n_bytes
)
SELECT doc_id, n_bytes, shard, depth, shard_bytes, shard_bytes > {sharding.SHARD_BYTES} AS oversized FROM chosen
""",
    "op11_conversation_trie": """
WITH t AS (
  SELECT conv_id::BIGINT AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS giver,
         xor(list_reduce(
           flatten([[ascii(c), -1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[] FOR c IN string_split(conv_id::VARCHAR, '')]),
           lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END,
           4294967295::BIGINT), 4294967295) % 9 AS h
  FROM t GROUP BY conv_id
), grafts AS (
  SELECT s.conv_id, s.giver, s.h, least(s.h, coalesce(g.n, 0)) AS taken
  FROM sizes s LEFT JOIN sizes g ON g.conv_id = s.giver
), rebuilt AS (
  SELECT f.conv_id, place + 1 AS depth, role, text
  FROM grafts f JOIN t ON t.conv_id = f.giver AND place < taken
  UNION ALL
  SELECT f.conv_id, place - h + taken + 1, role, text FROM grafts f JOIN t USING (conv_id) WHERE place >= h
), members AS (
  SELECT conv_id, depth, strlen(text) AS n_bytes,
         md5(string_agg(md5(strlen(role) || ':' || role || text), '')
             OVER (PARTITION BY conv_id ORDER BY depth)) AS key
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, 'root' FROM sizes
), linked AS (
  SELECT *, lag(key) OVER (PARTITION BY conv_id ORDER BY depth) AS parent,
         depth = max(depth) OVER (PARTITION BY conv_id) AS last
  FROM members
), nodes AS (
  SELECT key, min(conv_id) AS conv_id, any_value(depth) AS depth, any_value(parent) AS parent,
         count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM linked GROUP BY key
), children AS (
  SELECT parent AS key, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), known AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (key)
), below AS (
  SELECT DISTINCT a.key, b.key AS node
  FROM members a JOIN members b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), totals AS (
  SELECT below.key, count(*) FILTER (WHERE n_children = 0) AS n_leaves,
         sum((n_convs - 1) * n_bytes) AS saved_tokens
  FROM below JOIN known ON known.key = node GROUP BY below.key
)
SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs::BIGINT AS n_convs,
       k.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
       k.ends_sha256
FROM known k JOIN totals USING (key) LEFT JOIN nodes p ON p.key = k.parent
""",
    "op13_license_scan": rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all({_LOWER}, '{_PLAIN}'), []) AS w FROM documents
), phrases AS (
  SELECT label, string_split(phrase, ' ') AS p FROM (VALUES {_PHRASES}) v(label, phrase)
), places AS (
  SELECT r, label, spot FROM (SELECT r, w, unnest(range(len(w))) AS spot FROM d), phrases
  WHERE w[spot + 1] = p[1] AND list_slice(w, spot + 1, spot + len(p)) = p
), base AS (
  SELECT r, count(*) AS n_base, min(spot) AS first_word, max(spot) AS last_word, list(DISTINCT label) AS found
  FROM places GROUP BY r
), templates AS (
  SELECT label, list_distinct(regexp_extract_all({_LOWER}, '{_PLAIN}')) AS t FROM (VALUES {_TEMPLATES}) v(label, text)
), blocks AS (
  SELECT r, list_distinct(list_slice(w, spot + 1, spot + {_BLOCK})) AS b
  FROM (SELECT r, w, unnest(range(0, greatest(len(w) - {_BLOCK}, 0) + {_STRIDE}, {_STRIDE})) AS spot FROM d)
), shares AS (
  SELECT r, label, len(list_intersect(b, t)) / len(t) AS share FROM blocks, templates
), met AS (
  SELECT r, max(share) AS best, list(DISTINCT label) AS found FROM shares
  WHERE share >= {licenses.CONTAINED} - 1e-9 GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word,
       coalesce(array_to_string(list_sort(base.found), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(base.found, met.found))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN met USING (r)
""",
}
