"""The queries over the driver's tables, each with SQL for the same rows where SQL can say it.

A query is a function of tables; tables("orders") reads a table. Integers are cast to
long on both sides, so that results compare equal.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import numeric, text
from docloom.operators import pages, retrieval, tables
from docloom.plans import answer_queries, candidate_queries, load_queries, page_queries, rule_queries, table_queries, warehouse  # noqa: F401  they register queries of their own
from docloom.plans.registry import QUERIES, long, query
from docloom.streaming import counts


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("\nUNION ALL\n".join(f"SELECT l_orderkey, l_linenumber, '{m}' AS metric, {m} AS value FROM lineitem" for m in MEASURES))
def fact_unpivot(t):
    return tables.melted(t("lineitem").select("l_orderkey", "l_linenumber", *MEASURES), ["l_orderkey", "l_linenumber"], MEASURES)


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) AS metric_year, o_orderpriority AS row_label, round(sum(o_totalprice), 2) AS total, count(*) AS n FROM orders GROUP BY 1, 2")
def fact_year_metrics(t):
    return t("orders").groupBy(F.year("o_orderdate").cast("string").alias("metric_year"), F.col("o_orderpriority").alias("row_label")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"), F.count("*").alias("n"))


@query("""
SELECT p_partkey, col_name, col_value, TRY_CAST(col_value AS DOUBLE) AS col_value_num FROM (
  SELECT p_partkey, 'p_brand' AS col_name, p_brand AS col_value FROM part
  UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
  UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part)
WHERE col_value <> ''""")
def eav_load(t):
    own = t("part").select("p_partkey", "p_brand", "p_type", F.col("p_size").cast("string").alias("p_size"))
    long_rows = tables.melted(own, ["p_partkey"], ["p_brand", "p_type", "p_size"], "col_name", "col_value").filter(~tables.blank(F.col("col_value")))
    return long_rows.withColumn("col_value_num", numeric.parse_numeric(F.col("col_value")))


KINDS = ["click", "error", "purchase", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"arg_min(value, event_id) FILTER (WHERE event_type = '{k}') AS {k}" for k in KINDS) + " FROM events GROUP BY user_id")
def eav_pivot_wide(t):
    return tables.wide(t("events"), ["user_id"], "event_id", "event_type", "value")


@query("SELECT p_type AS col_name, count(*) AS n FROM part WHERE p_type NOT LIKE 'column_%' AND length(p_type) BETWEEN 2 AND 40 GROUP BY 1 ORDER BY n DESC, 1 LIMIT 30")
def pivot_columns_ranked(t):
    own = t("part").filter(~F.col("p_type").like("column_%") & F.length("p_type").between(2, 40))
    return own.groupBy(F.col("p_type").alias("col_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "col_name").limit(30)


SHOWN = "CASE l_linenumber % 4 WHEN 0 THEN concat('(', CAST(l_partkey AS {s}), ')') WHEN 1 THEN concat(CAST(l_partkey AS {s}), '.5%') WHEN 2 THEN '-' ELSE concat(' 1,', right(concat('000', CAST(l_partkey AS {s})), 3), ' ') END"


@query("""
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber,
       CASE l_linenumber % 4 WHEN 0 THEN -CAST(l_partkey AS DOUBLE) WHEN 1 THEN l_partkey + 0.5 WHEN 2 THEN NULL
            ELSE CAST(1000 + l_partkey % 1000 AS DOUBLE) END AS value FROM lineitem""")
def parse_numeric(t):
    return t("lineitem").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), numeric.parse_numeric(F.expr(SHOWN.format(s="string"))).alias("value"))


@query(f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, TRY_CAST(nullif(regexp_replace({SHOWN.format(s='VARCHAR')}, '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS value FROM lineitem")
def parse_numeric_backfill(t):
    return t("lineitem").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), numeric.parse_numeric_backfill(F.expr(SHOWN.format(s="string"))).alias("value"))


LABELS = "CASE p_size % 6 WHEN 0 THEN 'สินทรัพย์ (ล้านบาท)' WHEN 1 THEN 'ROE' WHEN 2 THEN 'กำไรต่อหุ้น' WHEN 3 THEN 'ฐานะการเงิน' WHEN 4 THEN 'พันบาท roa' ELSE p_name END"


@query("SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'ล้านบาท' WHEN 1 THEN '%' WHEN 2 THEN 'บาท' WHEN 3 THEN 'ล้านบาท' WHEN 4 THEN 'พันบาท' ELSE '' END AS unit FROM part")
def unit_guess(t):
    return t("part").select("p_partkey", numeric.guess_unit(F.expr(LABELS), F.lit("")).alias("unit"))


@query("SELECT h AS header, regexp_matches(h, '^(25|20)[0-9]{2}$') AS is_year, count(*) AS n FROM (SELECT CAST(year(o_orderdate) + (o_orderkey % 3) * 10 AS VARCHAR) AS h FROM orders) GROUP BY 1")
def year_headers(t):
    header = (F.year("o_orderdate") + (F.col("o_orderkey") % 3) * 10).cast("string")
    return t("orders").groupBy(header.alias("header")).agg(F.count("*").alias("n")).withColumn("is_year", numeric.is_year(F.col("header")))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity FROM lineitem WHERE l_linenumber < 3")
def first_n_rows(t):
    return t("lineitem").filter("l_linenumber < 3").select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "l_quantity")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2 ORDER BY n DESC, source, lang LIMIT 20")
def top_tables(t):
    return t("documents").groupBy("source", "lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source", "lang").limit(20)


@query("SELECT DISTINCT CAST(year(o_orderdate) AS BIGINT) AS y FROM orders")
def distinct_years(t):
    return t("orders").select(long(F.year("o_orderdate")).alias("y")).distinct().orderBy(F.asc_nulls_last("y"))


@query("\nUNION ALL\n".join(f"SELECT '{n}' AS table_name, count(*) AS n FROM {n}" for n in ("documents", "pages", "part", "orders")))
def warehouse_status(t):
    parts = [t(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("documents", "pages", "part", "orders")]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '%URGENT%')")
def semi_join_attr(t):
    keys = t("orders").filter(F.col("o_orderpriority").contains("URGENT")).select(F.col("o_custkey").alias("c_custkey"))
    return t("customer").join(keys, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def anti_join(t):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT d.doc_id, coalesce(n, 0) AS n_labels FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id)")
def doc_chunk_counts(t):
    counted = t("labels").groupBy("doc_id").agg(F.count("*").alias("n"))
    return t("documents").select("doc_id").join(counted, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_labels"))


@query("""
SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""")
def join_inner_star(t):
    lines = t("lineitem").select("l_orderkey", "l_extendedprice", "l_discount")
    named = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    buyers = t("customer").join(named, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name", "r_name")
    sold = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return sold.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id DESC LIMIT 10 OFFSET 20")
def paginate_docs(t):
    return t("documents").select("doc_id", "lang").orderBy(F.desc("doc_id")).offset(20).limit(10)


@query("SELECT CAST(y AS BIGINT) AS y, total, round(total - lag(total) OVER (ORDER BY y), 2) AS delta FROM (SELECT year(o_orderdate) AS y, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1)")
def yoy_delta(t):
    years = t("orders").groupBy(long(F.year("o_orderdate")).alias("y")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    return years.withColumn("delta", F.round(F.col("total") - F.lag("total").over(W.orderBy("y")), 2))  # one row a year


@query("""
SELECT o_orderpriority, CAST(y AS BIGINT) AS y, n FROM (
  SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n, row_number() OVER (PARTITION BY o_orderpriority ORDER BY count(*) DESC, year(o_orderdate)) AS k
  FROM orders GROUP BY 1, 2) WHERE k = 1""")
def argmax_year(t):
    years = t("orders").groupBy("o_orderpriority", long(F.year("o_orderdate")).alias("y")).agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("y")).alias("y"))).alias("b")
    return years.groupBy("o_orderpriority").agg(best).select("o_orderpriority", (-F.col("b.y")).alias("y"), "b.n")


@query("SELECT l_orderkey, sum(l_quantity) AS total, sum(l_quantity) - coalesce(sum(l_quantity) FILTER (WHERE l_linenumber > 1), 0) AS rest FROM lineitem GROUP BY 1")
def total_derived(t):
    others = F.coalesce(F.sum(F.when(F.col("l_linenumber") > 1, F.col("l_quantity"))), F.lit(0.0))
    return t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), (F.sum("l_quantity") - others).alias("rest"))


DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE)))"
COSINE = lambda a, b, e="": f"({DOT.format(a=a, b=b)} / (sqrt({DOT.format(a=a, b=a)}) * sqrt({DOT.format(a=b, b=b)}){e}))"


def query_vector(t, key: int = 0) -> list[float]:
    row = t("embeddings").filter(F.col("vec_id") == key).select("embedding").first()
    return list(row[0]) if row else []


@query(f"SELECT vec_id, round(s, 4) AS similarity FROM (SELECT e.vec_id, {COSINE('e.embedding', 'q.embedding')} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) ORDER BY s DESC, vec_id LIMIT 15")
def vector_topk(t):
    return retrieval.nearest(t("embeddings"), query_vector(t), 15, key="vec_id").select("vec_id", F.round("similarity", 4).alias("similarity"))


@query(f"""
SELECT vec_id, round({COSINE('a', 'b', ' + 1e-10')}, 4) AS similarity_before FROM (
  SELECT vec_id, embedding AS a, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings)""")
def neighbor_similarity(t):
    return retrieval.neighbours(t("embeddings"), "label", "vec_id").select("vec_id", F.round("similarity_before", 4).alias("similarity_before"))


STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query(f"""
WITH f AS (SELECT item_id, list_filter(regexp_extract_all(text, '[A-Za-z]{{2,}}|[0-9]{{4}}|[ก-๙]{{2,}}'), lambda x: lower(x) NOT IN ({STOPS})) AS l FROM benchmark),
g AS (SELECT item_id, l, list_transform(l, lambda y: lower(y)) AS m FROM f)
SELECT item_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(m, lower(x)) = i), ' '), '') AS terms FROM g""")
def keyword_terms(t):
    return t("benchmark").select("item_id", F.array_join(text.keyword_terms(F.col("text")), " ").alias("terms"))


TERMS = ["the", "license", "2020"]
BARE = r"regexp_replace({c}, '[ \n\r\t,:;(){{}}\[\]\"''`“”‘’%\-_/]', '', 'g')"


@query(f"""
WITH n AS (SELECT doc_id, lower(text) AS p, lower({BARE.format(c='text')}) AS b FROM documents),
s AS (SELECT doc_id, CASE WHEN contains(p, 'the') OR contains(b, 'the') OR contains(p, 'license') OR contains(b, 'license') THEN
  (CASE WHEN contains(p, 'the') THEN 12 ELSE 0 END) + (CASE WHEN contains(b, 'the') THEN 9 ELSE 0 END)
  + (CASE WHEN contains(p, 'license') THEN 28 ELSE 0 END) + (CASE WHEN contains(b, 'license') THEN 21 ELSE 0 END)
  + (CASE WHEN contains(p, '2020') THEN 14 ELSE 0 END) + (CASE WHEN contains(b, '2020') THEN 3 ELSE 0 END)
  + (CASE WHEN contains(b, 'thelicense2020') THEN 40 ELSE 0 END) ELSE 0 END AS score FROM n)
SELECT doc_id, CAST(score AS DOUBLE) AS score FROM s JOIN n USING (doc_id) WHERE score > 0 AND (contains(p, 'the') OR contains(p, 'license') OR contains(p, '2020'))""")
def keyword_score(t):
    found = retrieval.keyword_scored(t("documents").select("doc_id", "text"), "the license 2020", TERMS, "text")
    return found.select("doc_id", "score")


HYBRID = f"""
WITH c AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN 'raw_ocr_page' ELSE 'semantic' END AS kind, embedding FROM documents JOIN embeddings ON vec_id = doc_id),
n AS (SELECT doc_id, kind, lower(text) AS p, lower({BARE.format(c='text')}) AS b FROM (
  SELECT * FROM c WHERE contains(lower(text), 'the') OR contains(lower(text), 'license') OR contains(lower(text), '2020') ORDER BY doc_id LIMIT 200)),
s AS (SELECT doc_id, kind, CASE WHEN contains(p, 'the') OR contains(b, 'the') OR contains(p, 'license') OR contains(b, 'license') THEN
  (CASE WHEN contains(p, 'the') THEN 12 ELSE 0 END) + (CASE WHEN contains(b, 'the') THEN 9 ELSE 0 END)
  + (CASE WHEN contains(p, 'license') THEN 28 ELSE 0 END) + (CASE WHEN contains(b, 'license') THEN 21 ELSE 0 END)
  + (CASE WHEN contains(p, '2020') THEN 14 ELSE 0 END) + (CASE WHEN contains(b, '2020') THEN 3 ELSE 0 END)
  + (CASE WHEN contains(b, 'thelicense2020') THEN 40 ELSE 0 END) - (CASE WHEN kind = 'raw_ocr_page' THEN 20 ELSE 0 END) ELSE 0 END AS score FROM n),
f AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, least(0.999, score / 200) AS similarity, 'keyword' AS method, kind FROM s WHERE score > 0),
v AS (SELECT c.doc_id, c.kind, {{cosine}} AS sim FROM c, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) z ORDER BY sim DESC, c.doc_id LIMIT 75),
w AS (SELECT doc_id, row_number() OVER (ORDER BY sim DESC, doc_id) AS rank,
  sim - (CASE WHEN kind = 'raw_ocr_page' THEN 0.08 ELSE 0 END) AS similarity, 'semantic' AS method, kind FROM v),
u AS (SELECT *, 0 AS l FROM f UNION ALL SELECT *, 1 AS l FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY l, rank) AS k FROM u)
SELECT doc_id, rank, round(similarity, 3) AS similarity, method, kind AS source_kind FROM o WHERE k = 1 ORDER BY l, rank LIMIT 25"""


@query(HYBRID.replace("{cosine}", COSINE("c.embedding", "z.q")))
def hybrid_search(t):
    chunks = t("documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, "raw_ocr_page").alias("kind")).join(t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")
    found = retrieval.hybrid(chunks, "the license 2020", TERMS, query_vector(t), 25, "doc_id", "text", kind="kind")
    return found.select("doc_id", long("rank").alias("rank"), F.round("similarity", 3).alias("similarity"), "method", "source_kind")


def routed_sql() -> str:
    terms = {n: " + ".join(f"(CASE WHEN contains(q, '{w}') THEN {v} ELSE 0 END)" for w, v in words.items()) for n, words in retrieval.ROUTES.items()}
    s = list(terms)
    return f"""
WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS q, regexp_matches(coalesce(text, ''), '(^|[^\\p{{L}}\\p{{N}}_])(25|20)[0-9]{{2}}($|[^\\p{{L}}\\p{{N}}_])') AS y FROM conversations),
s AS (SELECT conv_id, turn, {terms[s[0]]} + (CASE WHEN y THEN 2 ELSE 0 END) AS a, {terms[s[1]]} AS b, {terms[s[2]]} AS c, {terms[s[3]]} AS d FROM q),
m AS (SELECT *, greatest(a, b, c, d) AS best, list_sort([a, b, c, d])[3] AS second FROM s)
SELECT conv_id, turn, CAST(best AS BIGINT) AS best,
  CASE WHEN a >= 4 AND b >= 4 THEN 'multi_hop' WHEN best = 0 THEN NULL WHEN a = best THEN '{s[0]}' WHEN b = best THEN '{s[1]}' WHEN c = best THEN '{s[2]}' ELSE '{s[3]}' END AS suggested_tool,
  CASE WHEN a >= 4 AND b >= 4 THEN 'high' WHEN best >= 5 AND best - second >= 3 THEN 'high' WHEN best >= 3 THEN 'medium' ELSE 'low' END AS confidence
FROM m"""


@query(routed_sql())
def route_questions(t):
    scores = [F.col(f"score_{n}") for n in retrieval.ROUTES]
    return retrieval.routed(t("conversations"), "text").select("conv_id", "turn", long(F.greatest(*scores)).alias("best"), "suggested_tool", "confidence")


BLANK = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
STRIP = r"regexp_replace(regexp_replace({c}, '^[\s\x0B\p{{Z}}]+', ''), '[\s\x0B\p{{Z}}]+$', '')"


@query("SELECT doc_id, md5(" + STRIP.format(c=r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + STRIP.format(c="coalesce(text, '')") + rf", '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '{BLANK}+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^ | $', '', 'g')") + ") AS digest FROM documents")
def clean_text(t):
    return t("documents").select("doc_id", F.md5(text.clean_text(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT event_id, CAST(event_id AS VARCHAR) AS digits FROM events")
def thai_digits(t):
    shown = F.translate(F.col("event_id").cast("string"), "0123456789", numeric.THAI_DIGITS)
    return t("events").select("event_id", text.thai_digits(shown).alias("digits"))


@query(r"SELECT doc_id, md5(lower(regexp_replace(regexp_replace(" + BARE.format(c="coalesce(text, '')") + r", '^[\s\x0B\p{Z}]+', ''), '[\s\x0B\p{Z}]+$', ''))) AS digest FROM documents")
def normalize_lookup(t):
    return t("documents").select("doc_id", F.md5(text.normalize_lookup(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 < 2 THEN p_name ELSE p_name || '-' || p_name END AS name FROM part WHERE length(p_name) > 2 AND NOT contains(p_name, '_') AND substr(p_name, 1, length(p_name) // 2) || substr(p_name, 1, length(p_name) // 2) <> p_name")
def dedup_title(t):
    doubled = F.when(F.col("p_size") % 3 == 0, F.concat("p_name", "p_name")).when(F.col("p_size") % 3 == 1, F.concat_ws("_", "p_name", "p_name")).otherwise(F.concat_ws("-", "p_name", "p_name"))
    half = text.first_half(F.col("p_name"))
    own = t("part").filter((F.length("p_name") > 2) & ~F.col("p_name").contains("_") & (F.concat(half, half) != F.col("p_name")))
    return own.select("p_partkey", text.halved(doubled).alias("name"))


@query(r"""SELECT p_partkey, CASE WHEN length(n) <= 12 THEN n ELSE regexp_replace(substr(n, 1, 1), '_+$', '') || '_' || substr(sha1(n), 1, 10) END AS name
FROM (SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(p_name, '[*_`#]+', '', 'g')), '\s+', '_', 'g'), '[^a-zA-Z0-9_.()\-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS n FROM part)""")
def safe_name(t):
    return t("part").select("p_partkey", text.safe_name(F.col("p_name"), F.lit("part"), 12).alias("name"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
f AS (SELECT doc_id, line, min(pos) AS pos FROM l GROUP BY 1, 2)
SELECT doc_id, count(*) AS n, md5(string_agg(line, chr(10) ORDER BY pos)) AS digest FROM f GROUP BY 1""")
def line_dedup(t):
    lines = F.array_distinct(F.split("text", "\n"))
    return t("documents").filter("text IS NOT NULL").select("doc_id", long(F.size(lines)).alias("n"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("digest"))


MARKED = "string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[\\s\\p{Z}]*\\n[\\s\\p{Z}]*', chr(1), 'g'), '([。.!?])[\\s\\p{Z}]*', '\\1' || chr(1), 'g'), chr(1))"


@query(f"""
WITH p AS (SELECT doc_id, list_filter(list_transform({MARKED}, lambda s: regexp_replace(regexp_replace(s, '^[\\s\\p{{Z}}]+', ''), '[\\s\\p{{Z}}]+$', '')), lambda s: s <> '') AS p FROM documents),
q AS (SELECT doc_id, CASE WHEN len(p) >= 3 THEN p ELSE flatten(list_transform(p, lambda s: regexp_split_to_array(s, '[\\s\\p{{Z}}]{{2,}}'))) END AS p FROM p)
SELECT doc_id, CAST(len(p) AS BIGINT) AS n_sentences, md5(array_to_string(p, '|')) AS digest FROM q""")
def sentence_split(t):
    cut = t("documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return cut.select("doc_id", long(F.size("s")).alias("n_sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query()
def chunk_pack(t):
    pieces = F.transform(text.sentences(F.col("text")), lambda s: F.struct(s.alias("text"), F.lit(False).alias("breaks")))
    return t("documents").select("doc_id", F.posexplode(retrieval.packed(pieces)).alias("chunk_index", "chunk_text"))


@query("""
SELECT l_suppkey, k // 25 AS batch, min(k) AS row_start, max(k) AS row_end, string_agg(CAST(l_orderkey AS VARCHAR) || ',' || CAST(l_partkey AS VARCHAR), chr(10) ORDER BY k) AS body
FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS k FROM lineitem) GROUP BY 1, 2""")
def table_chunks_25(t):
    at = F.row_number().over(W.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")) - 1
    rows = t("lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey").withColumn("k", long(at))
    return tables.batches(rows, ["l_suppkey"], "k", F.concat_ws(",", "l_orderkey", "l_partkey"))


@query("""
WITH g AS (SELECT user_id, event_id, CASE WHEN event_id <= lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) + 20 THEN 0 ELSE 1 END AS fresh FROM events),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM g)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM i GROUP BY user_id, island""")
def islands(t):
    return tables.islands(t("events").select("user_id", "event_id"), ["user_id"], "event_id", 20)


@query("SELECT event_id, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM events")
def sections(t):
    return tables.sections(t("events"), ["user_id"], ["event_id"], F.col("event_type") == "signup").select("event_id", "section")


@query("SELECT conv_id, turn, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_char FROM conversations")
def char_offsets(t):
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    return t("conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(before), F.lit(0).cast("long")).alias("start_char"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"')) AS BIGINT) AS n_links,
CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS n_items FROM pages""")
def html_outline(t):
    n = lambda rx: long(F.size(F.regexp_extract_all("html", F.lit(rx), F.lit(0))))
    return t("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), n(r'<a\s[^>]*href="([^"]*)"').alias("n_links"), n("<li[ >]").alias("n_items"))


@query("""
SELECT document_id, part, text FROM (
  SELECT CAST(n_regionkey AS BIGINT) AS document_id, 'node' AS part, 'key: ' || n_nationkey || ', name: ' || n_name AS text FROM nation
  UNION ALL SELECT CAST(n_regionkey AS BIGINT), 'edge', 'from: ' || n_name || ', to: ' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
WHERE contains(lower(text), 'name: nation_1')""")
def graph_search(t):
    attrs = lambda **c: F.create_map(*[x for k, v in c.items() for x in (F.lit(k.strip("_")), v.cast("string"))])
    nodes = t("nation").select(long("n_regionkey").alias("document_id"), long("n_nationkey").alias("item_id"), attrs(key=F.col("n_nationkey"), name=F.col("n_name")).alias("attrs"))
    edges = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    edges = edges.select(long("n_regionkey").alias("document_id"), long("n_nationkey").alias("item_id"), attrs(from_=F.col("n_name"), to=F.col("r_name")).alias("attrs"))
    return retrieval.graph_hits(nodes, edges, "name: NATION_1").select("document_id", "part", "text")


@query("SELECT l_orderkey, CAST(sum(CASE WHEN l_linenumber % 4 = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_numeric, CAST(sum(1) AS BIGINT) AS n_valid, count(*) AS n_cells FROM lineitem GROUP BY 1")
def validate_cells(t):
    own = t("lineitem").select("l_orderkey", F.expr(SHOWN.format(s="string")).alias("cell"))
    return own.groupBy("l_orderkey").agg(F.count_if(numeric.looks_numeric(F.col("cell"))).alias("n_numeric"), F.count_if(numeric.valid_cell(F.col("cell"))).alias("n_valid"), F.count("*").alias("n_cells"))


@query("SELECT run, score, round(score - lag(score) OVER (ORDER BY run), 4) AS delta FROM (SELECT doc_id % 10 AS run, round(avg(quality), 4) AS score FROM labels GROUP BY 1)")
def eval_history_delta(t):
    runs = t("labels").groupBy((F.col("doc_id") % 10).alias("run")).agg(F.round(F.avg("quality"), 4).alias("score"))
    return runs.withColumn("delta", F.round(F.col("score") - F.lag("score").over(W.orderBy("run")), 4))  # one row a run


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_extract(t):
    return t("events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"))


@query("(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 0")
def union_intersect_except(t):
    both = t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))
    return both.subtract(t("nation").filter("n_regionkey = 0").select("n_nationkey"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def rollup_cube(t):
    return t("lineitem").cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("""
SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS near
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)""")
def window_rank_frames(t):
    by = W.partitionBy("o_custkey")
    rank = by.orderBy("o_orderpriority")
    return t("orders").select("o_orderkey", long(F.rank().over(rank)).alias("r"), long(F.dense_rank().over(rank)).alias("d"), F.count("*").over(by.orderBy("o_orderdate", "o_orderkey").rowsBetween(-2, 0)).alias("near"))


@query("SELECT CAST(date_trunc('day', ts) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(t):
    return counts.daily(t.spark, t.path("events"), t("events").schema)


TITLE = "nullif(trim(regexp_extract(html, '{}', 1)), '')"
TITLES = ['(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"', "(?is)<title[^>]*>(.*?)</title>", "(?is)<h1[^>]*>(.*?)</h1>"]


@query(f"SELECT page_id, coalesce({', '.join(TITLE.format(x) for x in TITLES)}) AS title FROM pages")
def page_title(t):
    return t("pages").select("page_id", pages.page_title(F.col("html")).alias("title"))


@query("""
SELECT page_id, link, min(pos) AS pos FROM (
  SELECT page_id, pos, CASE WHEN h LIKE '/%' AND h NOT LIKE '//%' AND host <> '' THEN host || h ELSE h END AS link FROM (
    SELECT page_id, pos - 1 AS pos, host, regexp_replace(hs[pos], '#.*$', '') AS h FROM (
      SELECT page_id, host, hs, unnest(range(1, len(hs) + 1)) AS pos FROM (
        SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS host, regexp_extract_all(html, 'href="([^"]*)"', 1) AS hs FROM pages))))
WHERE regexp_matches(link, '^https?://') GROUP BY 1, 2""")
def page_links(t):
    return pages.links(t("pages"), "page_id")


@query("SELECT p_partkey, 'parts' AS title, 'name' AS h1, 'size' AS h2, trim(p_name) AS name, CAST(p_size AS VARCHAR) AS size, CAST(2 AS BIGINT) AS at FROM part WHERE p_name NOT LIKE '%|%'")
def pipe_tables(t):
    line = F.format_string("Intro.\n| parts |\n| name | size |\n|:--|--:|\n| %s | %d |\n\nEnd.", "p_name", "p_size")
    found = pages.pipe_tables(t("part").filter(~F.col("p_name").contains("|")).select("p_partkey", line.alias("text")), "p_partkey")
    return found.select("p_partkey", "title", F.col("headers")[0].alias("h1"), F.col("headers")[1].alias("h2"), F.explode("rows").alias("r"), long("at").alias("at")).select("p_partkey", "title", "h1", "h2", F.col("r")[0].alias("name"), F.col("r")[1].alias("size"), "at")


@query("SELECT CAST(c_custkey AS BIGINT) AS c_custkey, 'Customer' AS h1, c_name AS v1, c_mktsegment AS v2 FROM customer")
def html_tables(t):
    made = F.concat(F.lit("<p>x</p><TABLE class='a'><tr><td> </td></tr><tr><th>Customer</th><th>Segment</th></tr>\n<tr><td><b>"), "c_name", F.lit("</b></td><td>\n"), "c_mktsegment", F.lit("</td></tr></TABLE>"))
    found = pages.html_tables(t("customer").select(long("c_custkey").alias("c_custkey"), made.alias("html")), "c_custkey")
    return found.select("c_custkey", F.col("headers")[0].alias("h1"), F.explode("rows").alias("r")).select("c_custkey", "h1", F.col("r")[0].alias("v1"), F.col("r")[1].alias("v2"))


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: measures of lineitem unpivoted to long rows, then summed by measure."""
    return fact_unpivot(Tables(spark, sf_dir)).groupBy("metric").agg(F.round(F.sum("value"), 2).alias("total"), F.count("*").alias("n"))


def ran(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name][0](Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(ran, name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
