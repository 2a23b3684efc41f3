"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, hardnegatives, jaccard_join, language, licenses, mixing, pii, quality, quality_rules, tokencounts, toxicity, urlrules, whitening
from docloom.llm.common import table

#: The URL rules.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(table(spark, sf_dir, "documents")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlrules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return tokencounts.histogram(tokencounts.lengths(table(spark, sf_dir, "documents"), vocabulary))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, vec_id = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(vec_id % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardnegatives.mine(vectors.select("vec_id", label.alias("label"), "embedding"), vec_id % 100 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    other = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return language.predict(docs, language.learn(docs.filter(~other)), other)


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_personal_data, op3_decontamination, op4_quality_rules, op5_license_scan, op6_jaccard_join, op7_quality_classifier, op8_url_filter, op9_source_mix, op10_token_counts, op11_hard_negatives, op12_whitening, op13_language)}


OP8_SQL = r"""
WITH own AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages
), cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path
  FROM own
), fit AS (
  SELECT *,
         CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
              WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
              WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
              WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM cut
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""


OP11_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)
), scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS other, a.label = c.label AS same, CAST(list_dot_product(a.x, c.x) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same
 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) <= 10
"""

# n-grams are strings here; shorter ones first, then by code point, as the operator's keys are ordered
OP13_SQL = r"""
WITH numbered AS (
  SELECT *, row_number() OVER () AS n FROM documents
), told AS (
  SELECT n, doc_id, lang, text, coalesce(xor(list_reduce(
           list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda b: CAST(ascii(b) AS BIGINT))),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d % 2 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)
         ), 4294967295) % 3 = 1, false) AS held_out
  FROM numbered
), word AS (
  SELECT n, doc_id, lang, held_out, regexp_matches(coalesce(text, ''), '\p{L}') AS has,
         list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{M}]+', ' ', 'g'), ' '), lambda w: w <> '') AS words
  FROM told
), counted AS (
  SELECT n, w, count(*) AS often FROM (SELECT n, unnest(words) AS w FROM word) GROUP BY n, w
), gram AS (
  SELECT n, unnest(list_concat(
           list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)),
           list_transform(range(1, length(w) + 2), lambda i: substr(' ' || w || ' ', i, 2)),
           list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)))) AS g, often
  FROM counted
), own AS (
  SELECT n, g, sum(often) AS often FROM gram GROUP BY n, g
), ranked AS (
  SELECT n, g, row_number() OVER (PARTITION BY n ORDER BY often DESC, length(g), g) - 1 AS r FROM own QUALIFY r < 300
), profile AS (
  SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(often) DESC, length(g), g) - 1 AS r
  FROM own JOIN word USING (n) WHERE lang IS NOT NULL AND NOT held_out GROUP BY lang, g QUALIFY r < 300
), near AS (
  SELECT n, lang, sum(least(300, coalesce(abs(ranked.r - profile.r), 300))) AS distance, count(*) AS m
  FROM ranked CROSS JOIN (SELECT DISTINCT lang FROM profile) LEFT JOIN profile USING (lang, g) GROUP BY n, lang
), best AS (
  SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY n ORDER BY distance, lang) = 1
)
SELECT doc_id, held_out, CASE WHEN has THEN coalesce(best.lang, 'und') ELSE 'und' END AS lang_pred,
       CASE WHEN has AND best.lang IS NOT NULL THEN 1 - CAST(distance AS DOUBLE) / (m * 300) ELSE 0.0 END AS score
FROM word LEFT JOIN best USING (n)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_url_filter": OP8_SQL, "op11_hard_negatives": OP11_SQL, "op13_language": OP13_SQL}
