"""Queries that answer questions from stored rows, and SQL that tries every question on every row."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions.text import STOP_WORDS
from docloom.operators import answers
from docloom.plans.registry import long, query

BARE = "lower(regexp_replace({}, '[ \\n\\r\\t,:;(){{}}\\[\\]\"''`“”‘’%\\-_/]', '', 'g'))"
STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)
PAIRS = f"""
WITH asked AS (
  SELECT CAST(s_suppkey AS BIGINT) AS question_id, 'How did ' || p_name || ' of ' || s_name || ' do in 2021?' AS question FROM supplier JOIN part ON p_partkey = s_suppkey
), q AS (
  SELECT *, {BARE.format("question")} AS nq, list_filter(list_distinct(regexp_extract_all(lower(question), '[a-z]{{2,}}')), lambda t: t NOT IN ({STOPS})) AS terms FROM asked
), r AS (
  SELECT CAST(p_partkey AS BIGINT) AS row_index, p_brand AS table_name, CAST(p_size AS BIGINT) AS document_id, p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_type END AS label, CAST(p_size AS VARCHAR) AS value FROM part
), b AS (SELECT *, {BARE.format("label")} AS nl FROM r)"""


def asked_and_stored(t):
    questions = t("supplier").join(t("part"), F.col("p_partkey") == F.col("s_suppkey")).select(long("s_suppkey").alias("question_id"), F.concat(F.lit("How did "), "p_name", F.lit(" of "), "s_name", F.lit(" do in 2021?")).alias("question"))
    label = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", "p_type"))
    size = F.col("p_size").cast("string")
    rows = t("part").select(long("p_size").alias("document_id"), F.col("p_brand").alias("table_name"), long("p_partkey").alias("row_index"), label.alias("label"), F.create_map(F.lit("name"), "p_name", F.lit("2021"), size, F.lit("2022"), F.lit("")).alias("cells"))
    return questions, rows


@query(PAIRS + """
, s AS (
  SELECT question_id, document_id, table_name, row_index, label, value,
         CASE WHEN contains(nq, nl) THEN length(nl) + 100 WHEN contains(nl, nq) THEN length(nq) + 50 ELSE 0 END
         + coalesce(list_sum(list_transform(list_filter(terms, lambda t: contains(nl, t)), lambda t: greatest(10, 3 * length(t)))), 0) AS score
  FROM q CROSS JOIN b WHERE nl <> ''
)
SELECT question_id, document_id, table_name, row_index, label || 'ในปี 2021 เท่ากับ ' || value AS answer, CAST(score AS BIGINT) AS score FROM s WHERE score >= 40
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, table_name, row_index) = 1""")
def direct_answers(t):
    questions, rows = asked_and_stored(t)
    found = answers.direct_answers(answers.best_rows(questions, rows))
    return found.select("question_id", "document_id", "table_name", "row_index", "answer", long("score").alias("score"))


@query(PAIRS + """
, s AS (
  SELECT question_id, document_id, table_name, row_index, label AS row_label, value, CASE WHEN contains(nq, nl) THEN length(nl) + 100 ELSE length(nq) END AS score
  FROM q CROSS JOIN b WHERE nl <> '' AND (contains(nq, nl) OR contains(nl, nq))
)
SELECT question_id, document_id, table_name, row_index, row_label, value, '2021' AS year FROM s
QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY score DESC, document_id, table_name, row_index) = 1""")
def direct_lookups(t):
    return answers.looked_up(*asked_and_stored(t))
