"""Registered queries of the corpus operators: name to function of (spark, folder), and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from carefold.llm import (
    bitplanes, bpe, centroids, chat, common, decontaminate, fim, language, neardup, packing, quality, rules, substrings, toxicity,
)
from carefold.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


@query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op7_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(table(spark, sf_dir, "documents"))


@query
def op2_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_toxicity_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.classify(table(spark, sf_dir, "documents"))


@query
def op9_chat_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.plain(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TEXT), (-7, 1, "assistant", HARD_TEXT)], "conv_id long, turn long, role string, text string")
    parts = common.store(chat.format_conversations(turns.unionByName(hard)), "chat-parts")
    return chat.read_digests(parts)


HARD_TEXT = r"\### Assistant: </turn> ok"


def _chat_sql() -> str:
    """The same digests from the turns themselves; only formatted_chars follows the template's marks."""
    escaped = "text"
    for mark in ("\\", *chat.CONTROLS):
        escaped = f"replace({escaped}, '{mark}', '\\{mark}')"
    label = "CASE role WHEN 'assistant' THEN 'Assistant' WHEN 'user' THEN 'User' ELSE '=' || role END"
    for mark in ("\\", *chat.CONTROLS):
        label = f"replace({label}, '{mark}', '\\{mark}')"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{HARD_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{HARD_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum({len("<turn>### ") + len(": ") + len("</turn>") + 1} + length({label}) + length({escaped})) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id
"""


SQL["op9_chat_template"] = _chat_sql()


@query
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, sf_dir, "documents")).drop("row")


@query
def op5_benchmark_wand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id")


SQL["op3_repeated_passages"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS l FROM texts),
placed AS (SELECT doc_id, l, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base,
  string_split(regexp_replace(line, '([.!?])([ \\t\\v\\f\\r])', '\\1' || chr(2) || '\\2', 'g'), chr(2)) AS ps FROM lines),
pieces AS (SELECT doc_id, l, base, unnest(ps) AS piece, generate_subscripts(ps, 1) AS p FROM placed),
spans AS (SELECT doc_id, l, p, piece, base + coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, l ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place,
  regexp_extract_all(translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM pieces),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY l, p) AS unit, len(words) AS n,
  place + length(regexp_extract(piece, '^[^A-Za-z0-9\\x{{80}}-\\x{{10FFFF}}]*')) AS b, place + length(piece) AS e, array_to_string(words, ' ') AS digest
  FROM spans WHERE len(words) > 0),
firsts AS (SELECT *, min((doc_id, unit)) OVER (PARTITION BY digest) AS first FROM units),
chained AS (SELECT *, unit - row_number() OVER (PARTITION BY doc_id ORDER BY unit) AS run FROM firsts WHERE first <> (doc_id, unit))
SELECT doc_id, CAST(min(b) AS INTEGER) AS "begin", CAST(max(e) AS INTEGER) AS "end", CAST(sum(n) AS BIGINT) AS n_words, arg_min(first[1], unit) AS first_doc_id
FROM chained GROUP BY doc_id, run HAVING sum(n) >= {substrings.LEAST_WORDS}"""


SQL["op6_prob_minhash"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {neardup.SHINGLE}
  THEN list_transform(range(1, len(ws) - {neardup.SHINGLE} + 2), lambda k: array_to_string(ws[k:k + {neardup.SHINGLE - 1}], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= {neardup.SIMILARITY} * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, sym.b FROM r JOIN sym ON sym.a = r.reach)
SELECT doc_id, min(reach) AS class_id FROM r GROUP BY doc_id"""


@query
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(table(spark, sf_dir, "documents"))


SQL["op11_fill_in_middle"] = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    sha256('{fim.SALT}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, len(units) AS n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (len(units) + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '{fim.PREFIX}') OR contains(text, '{fim.SUFFIX}') OR contains(text, '{fim.MIDDLE}')
      OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= {fim.RATE} THEN 'plain'
    WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < {fim.SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM texts),
parts AS (SELECT *, array_to_string(units[1:least(a, b)], '') AS prefix, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS middle,
  array_to_string(units[greatest(a, b) + 1:], '') AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{fim.PREFIX}' || prefix || '{fim.SUFFIX}' || suffix || '{fim.MIDDLE}' || middle
    ELSE '{fim.SUFFIX}' || suffix || '{fim.PREFIX}' || prefix || '{fim.MIDDLE}' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts"""


@query
def op12_simplex_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.classify(table(spark, sf_dir, "embeddings"))


def _centroid_sql() -> str:
    """Every distance of every round, with lists of integers."""
    rounds = ""
    for k in range(centroids.ROUNDS + 1):
        rounds += f""",
d{k} AS (SELECT r, vec_id, v, c, list_sum(list_transform(range(1, {centroids.DIMENSIONS + 1}), lambda i: (v[i] - m[i]) * (v[i] - m[i]))) AS distance FROM kept, c{k}),
a{k} AS (SELECT * FROM d{k} QUALIFY row_number() OVER (PARTITION BY r ORDER BY distance, c) = 1)"""
        if k < centroids.ROUNDS:
            rounds += f""",
s{k} AS (SELECT c, i, sum(v[i]) AS s, count(*) AS n FROM a{k}, range(1, {centroids.DIMENSIONS + 1}) t(i) GROUP BY c, i),
m{k} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS m FROM s{k} GROUP BY c),
c{k + 1} AS (SELECT c{k}.c, coalesce(m{k}.m, c{k}.m) AS m FROM c{k} LEFT JOIN m{k} ON m{k}.c = c{k}.c)"""
    last = centroids.ROUNDS
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({centroids.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {centroids.DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS m
  FROM (SELECT v, sha256('{centroids.SALT}' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM kept ORDER BY h, v LIMIT {centroids.CLUSTERS})){rounds}
SELECT vec_id, CAST(a{last}.c AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
  CAST(sum(distance) OVER (PARTITION BY a{last}.c) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{last}.m, ',')) AS centroid_sha256
FROM a{last} JOIN c{last} ON a{last}.c = c{last}.c"""


SQL["op12_simplex_centroids"] = _centroid_sql()


@query
def op13_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(table(spark, sf_dir, "documents"))
