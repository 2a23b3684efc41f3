"""Queries on stored tables: normalising, repairs, loading, lookups, and joins beside them."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import pages, repairs, retrieval, tables
from docloom.plans.registry import case, long, query, values
from docloom.sources import files
from docloom.streaming import counts

TABLE = "document_id long, table_name string, title string, headers array<string>, rows array<array<string>>"


def given(t, rows):
    return t.spark.createDataFrame(rows, TABLE)


def flat(df):
    """headers and rows of tables as text, cells parted by | and rows by /."""
    line = lambda r: F.array_join(r, "|")
    return df.select("document_id", line(F.col("headers")).alias("headers"), F.array_join(F.transform("rows", line), "/").alias("rows"))


FLAT = "document_id BIGINT, headers VARCHAR, rows VARCHAR"
RAW = [
    (1, "t", "", ["**รายการ**", "2566", "2566", ""], [["a", "1", "2"], ["", " ", None], ["b", "3"]]),
    (2, "t", "", ["รายการ", "column_2", "column_3", "column_4"], [["x", "2566", "2565", "2564"], ["y", "1", "2", "3"]]),
    (3, "t", "", ["รายการ", "column_2", "(%)", "column_4"], [["x", "2566", "2565", ""], ["y", "1", "2", "3"]]),
    (4, "t", "", ["a", "b", "", ""], [["1", "2", "", ""], ["3", "4", "", ""]]),
    (5, "t", "", [], [["1", "2"]]),
    (6, "t", "", ["รายการ", "column_2", "column_3", "column_4"], [["x", "2566", "2564", ""], ["y", "1", "2", "3"]]),
]


@case(values(FLAT, [
    (1, "รายการ|2566|2566_2", "a|1|2/b|3|"), (2, "รายการ|2566|2565|2564", "y|1|2|3"), (3, "รายการ|2566|2565|2564", "y|1|2|3"),
    (4, "a|b", "1|2/3|4"), (5, "รายการ|column_2", "1|2"), (6, "รายการ|column2|column3|column4", "x|2566|2564|/y|1|2|3"),  # mark-up goes, and with it underscores
]))
def normalize_tables(t):
    return flat(tables.normalized(given(t, RAW)))


@case(values(FLAT, [
    (1, "รายการ|หน่วย|2567|2566", "ก|(%)|1.1|1.2/ข||5|6/ค|||"), (2, "รายการ|2567|2566", "ก|1|2"), (3, "รายการ|x", "(%)|1"),
]))
def unit_column(t):
    return flat(tables.with_unit_column(given(t, [
        (1, "t", "", ["รายการ", "2567", "2566"], [["ก", "(%)", "1.1", "1.2"], ["ข", "5", "6"], ["ค"]]), (2, "t", "", ["รายการ", "2567", "2566"], [["ก", "1", "2"]]), (3, "t", "", ["รายการ", "x"], [["(%)", "1"]]),
    ])))


@case(values(FLAT, [
    (1, "ชื่อ|a|b|column_4", "x|1|2|/|5|6|7"), (2, "ชื่อ|a|b", "x|1|2/||5/||6"), (3, "ลำดับ|ชื่อ|a|b|column_5", "1|n|2|3|/||7|8|9"),
]))
def footer_rows(t):
    return flat(tables.footer_collapsed(given(t, [
        (1, "t", "", ["ชื่อ", "a", "b"], [["x", "1", "2"], ["", "", "5"], ["", "", "6"], ["", "", "7"]]), (2, "t", "", ["ชื่อ", "a", "b"], [["x", "1", "2"], ["", "", "5"], ["", "", "6"]]),
        (3, "t", "", ["ลำดับ", "ชื่อ", "a", "b"], [["1", "n", "2", "3"], ["", "", "", "7"], ["", "", "", "8"], ["", "", "", "9"]]),
    ])))


@query(values("document_id BIGINT, lead BIGINT, kept BIGINT, extra VARCHAR", [(1, 2, 3, None), (2, 1, 2, "z"), (3, 1, 2, None)]))
def header_shapes(t):
    own = given(t, [(1, "t", "", ["ลำดับ", "ชื่อบริษัท", "2566"], [["1", "a", ""]]), (2, "t", "", ["x", "note", "column_3"], [["l", "z", ""]]), (3, "t", "", ["x", "2566", "column_3", "column_4"], [["l", "5", "", " "]])])
    first = F.when(F.col("document_id") == 1, F.array(F.lit("l"), F.lit(""), F.lit("5"))).otherwise(F.get("rows", F.lit(0)))
    return own.select("document_id", long(tables.leading_descriptors(F.col("headers"))).alias("lead"), long(tables.trimmed(F.col("headers"), F.col("rows"))).alias("kept"), tables.first_extra(F.col("headers"), first).alias("extra"))


Y2 = ["รายการ", "2566", "2565"]
SHEET = [
    (1, "t", "", Y2, [["สินทรัพย์", "9", "9"], [repairs.BOTH_SIDES, "", ""], [repairs.OTHER, "1", "2"], [repairs.LIABILITIES, "0", "7"], [repairs.EQUITY, "400", "(5)"], [repairs.GRAND, "1,000", "20"]]),
    (2, "t", "", Y2, [[repairs.BOTH_SIDES, "", ""], [repairs.LIABILITIES, "0", "7"], [repairs.OTHER, "1", "2"], ["x", "", ""], [repairs.EQUITY, "400", "5"], [repairs.GRAND, "1,000", "20"]]),
]


@query(values(FLAT, [
    (1, "รายการ|2566|2565", f"สินทรัพย์|9|9/{repairs.BOTH_SIDES}||/{repairs.OTHER}|1|2/{repairs.LIABILITIES}|600|25/{repairs.EQUITY}|400|(5)/{repairs.GRAND}|1,000|20"),
    (2, "รายการ|2566|2565", f"{repairs.BOTH_SIDES}||/{repairs.LIABILITIES}|0|7/{repairs.OTHER}|1|2/x||/{repairs.EQUITY}|400|5/{repairs.GRAND}|1,000|20"),
]))
def balance_totals(t):
    return flat(repairs.balance_totals(given(t, SHEET)))


@query(values(FLAT, [
    (1, "รายการ|2566|2565", f"a|100,000,000|200,000,000/b|1|1/{repairs.OTHER}|50,000,000|70,000,000/{repairs.LIABILITIES}|150,000,001|270,000,001"),
    (2, "รายการ|2566|2565", f"a|1|2/b|1|1/{repairs.OTHER}|5|7/{repairs.LIABILITIES}|9|9"),
]))
def derived_totals(t):
    return flat(repairs.derived_from_total(given(t, [
        (1, "t", "", Y2, [["a", "100,000,000", "200,000,000"], ["b", "1", "1"], [repairs.OTHER, "50,000", "70,000"], [repairs.LIABILITIES, "150,000,001", "270,000,001"]]),
        (2, "t", "", Y2, [["a", "1", "2"], ["b", "1", "1"], [repairs.OTHER, "5", "7"], [repairs.LIABILITIES, "9", "9"]]),
    ])))


@query(values(FLAT, [
    (1, "รายการ|2566|2565", f"{repairs.DEBT}|10|20/{repairs.PROVISIONS}|1|2/{repairs.DEFERRED_TAX}|3|4/{repairs.OTHER}|86|74/{repairs.LIABILITIES}|100|100/z|1|1"),
    (2, "รายการ|2566|2565", f"{repairs.DEBT}{repairs.PROVISIONS}|10|20/{repairs.DEFERRED_TAX}|1|2/{repairs.OTHER}|3|4/{repairs.LIABILITIES}|10|10"),
]))
def shifted_liabilities(t):
    both = repairs.DEBT + repairs.PROVISIONS
    return flat(repairs.shifted_liabilities(given(t, [
        (1, "t", "", Y2, [[both, "10", "20"], [repairs.DEFERRED_TAX, "1", "2"], [repairs.OTHER, "3", "4"], [repairs.LIABILITIES, "100", "100"], ["z", "1", "1"]]),
        (2, "t", "", Y2, [[both, "10", "20"], [repairs.DEFERRED_TAX, "1", "2"], [repairs.OTHER, "3", "4"], [repairs.LIABILITIES, "10", "10"]]),
    ])))


PARTED = [
    (1, "t", "T", Y2, [["a", "1", "2"], ["Part", "", ""], ["Empty", " ", ""], ["b", "3", "4"], ["c", "5", "6"]]),
    (2, "t", "T", ["รายการ", "2566", "2565", "x"], [["a", "(%)", "2", "3"], ["b", "3", "4", ""], ["Part", "", "", ""], ["c", "5", "6", ""]]),
    (3, "t", "T", ["k", "v"], [["only", ""]]),
    (4, "t", "T", ["k", "v"], [["a", "1"]]),
]


@query(values("document_id BIGINT, section BIGINT, title VARCHAR, headers VARCHAR, rows VARCHAR", [
    (1, 0, "T", "รายการ|2566|2565", "a|1|2"), (1, 1, "Empty", "รายการ|2566|2565", "b|3|4/c|5|6"),
    (2, 0, "T", "รายการ|หน่วย|2566|2565", "a|(%)|2|3/b||3|4"), (2, 1, "Part", "รายการ|2566|2565", "c|5|6"), (4, 0, "T", "k|v", "a|1"),
]))
def table_sections(t):
    out = repairs.sections(given(t, PARTED), ["document_id"])
    return flat(out.withColumn("document_id", F.struct("document_id", "section", "title"))).select("document_id.document_id", long("document_id.section").alias("section"), "document_id.title", "headers", "rows")


@query(values("document_id BIGINT, section BIGINT, title VARCHAR, headers VARCHAR, rows VARCHAR", [
    (1, 0, "T", "รายการ|2566|2565", "a|1|2/Empty||/b|3|4/c|5|6"), (2, 0, "T", "รายการ|หน่วย|2566|2565", "a|(%)|2|3/b||3|4"), (2, 1, "Part", "รายการ|2566|2565", "c|5|6"),
    (3, 0, "T", "k|v", "only|"), (4, 0, "T", "k|v", "a|1"),
]))
def rebuilt_tables(t):
    out = repairs.rebuilt(given(t, PARTED), ["document_id"])
    return flat(out.withColumn("document_id", F.struct("document_id", "section", "title"))).select("document_id.document_id", long("document_id.section").alias("section"), "document_id.title", "headers", "rows")


@query(values("document_id BIGINT, page BIGINT, headers VARCHAR, rows VARCHAR", [
    (2, 1, "รายการ|2566|2565", "a|1|2"), (3, 1, "k|v", "x|y"), (5, 2, "ก|2566|2565", "x|2566|2565"), (6, 2, "ก|column_2|column_3", "b|3|4"),
]))
def header_fragments(t):
    rows = [
        (1, "1", "", ["รายการ", "column_2", "(%)"], [["", "2566", "2565"]]), (2, "1", "", ["", "column_2", "column_3"], [["a", "1", "2"]]), (3, "1", "", ["k", "v"], [["x", "y"]]),
        (4, "2", "", ["ก", "column_2", "column_3"], [["x", "2566", "2565"]]), (5, "2", "", ["ก", "column_2", "column_3"], [["x", "2566", "2565"]]), (6, "2", "", ["ก", "column_2", "column_3"], [["b", "3", "4"]]),
    ]
    out = repairs.merged_fragments(given(t, rows).withColumnRenamed("table_name", "page").withColumn("table_name", F.lit("t")), ["page"], "document_id")
    # the table that stays is the fragment's row with the body's content: its number is the body's
    numbered = out.withColumn("document_id", F.when(F.col("document_id").isin(1, 4), F.col("document_id") + 1).otherwise(F.col("document_id")))
    return flat(numbered.withColumn("document_id", F.struct("document_id", "page"))).select("document_id.document_id", F.col("document_id.page").cast("long").alias("page"), "headers", "rows")


YEARS = ["รายการ", "2567", "2566", "2565"]
LOADED = [
    (1, "ก", "", YEARS, [["กำไร", "(%)", "1.10", "1.20"], ["ROE", "", "(%)", "5"], ["", "1", "2", "3"], ["สินทรัพย์ (ล้านบาท)", "(1,000)", "-", ""]]),
    (2, "ฐานะการเงิน", "", ["รายการ", "หน่วย", "2566"], [["หนี้ (ล้านบาท)", "(พันบาท)", "9"], ["ทุน", "", "7"]]),
    (3, "ผู้ถือหุ้น", "", ["ชื่อ", "หุ้น", "ร้อยละ"], [["A", "1,000", "5%"], ["", "2", ""], ["B", "", "x"]]),
]
FACT = "document_id BIGINT, row_index BIGINT, row_label VARCHAR, metric_year VARCHAR, raw_value VARCHAR, numeric_value DOUBLE, unit VARCHAR"


@query(values(FACT, [
    (1, 0, "กำไร", "2567", "1.10", 1.1, "%"), (1, 0, "กำไร", "2566", "1.20", 1.2, "%"), (1, 0, "กำไร", "2565", "1.20", 1.2, "%"),
    (1, 1, "ROE", "2567", "5", 5.0, "%"), (1, 1, "ROE", "2565", "5", 5.0, "%"),
    (1, 3, "สินทรัพย์ (ล้านบาท)", "2567", "(1,000)", -1000.0, "ล้านบาท"), (1, 3, "สินทรัพย์ (ล้านบาท)", "2566", "-", None, "ล้านบาท"),
    (2, 0, "หนี้ (ล้านบาท)", "2566", "9", 9.0, "พันบาท"), (2, 1, "ทุน", "2566", "7", 7.0, "ล้านบาท"),
]))
def fact_rules(t):
    out, _ = tables.loaded(given(t, LOADED), ["document_id", "table_name"])
    return out.select("document_id", long("row_index").alias("row_index"), "row_label", "metric_year", "raw_value", "numeric_value", "unit")


@query(values("document_id BIGINT, row_index BIGINT, row_label VARCHAR, col_name VARCHAR, col_value VARCHAR, col_value_num DOUBLE", [
    (3, 0, "A", "หุ้น", "1,000", 1000.0), (3, 0, "A", "ร้อยละ", "5%", 5.0), (3, 1, "row_1", "หุ้น", "2", 2.0), (3, 2, "B", "ร้อยละ", "x", None),
]))
def attribute_rules(t):
    _, out = tables.loaded(given(t, LOADED), ["document_id", "table_name"])
    return out.select("document_id", long("row_index").alias("row_index"), "row_label", "col_name", "col_value", "col_value_num")


@query(values("document_id BIGINT, n_issues BIGINT, bad BIGINT, empty VARCHAR, ok BOOLEAN, confidence DOUBLE, valid BOOLEAN, retry BOOLEAN", [
    (1, 0, 0, "", True, 1.0, True, False), (2, 1, 0, "", False, 0.666667, False, True), (3, 1, 0, "1", True, 0.6, False, True), (4, 1, 1, "", True, 0.5, False, True), (5, 0, 0, "", True, 1.0, True, False),
]))
def table_issues(t):
    found = tables.issues(given(t, [
        (1, "t", "", ["รายการ", "2566", "2565"], [["a", "1,234", "(5)"], ["b", "-", "5%"]]), (2, "t", "", ["รายการ", "2566", "2565"], [["a", "1"], ["b", "2", "3"]]), (3, "t", "", ["x", "y"], [["a", "b"], ["", ""]]),
        (4, "t", "", ["x", "จำนวน"], [["a", "abc"], ["b", "5"]]), (5, "t", "", ["x", "y"], [["a", "abc"]]),
    ]), ["document_id"])
    return found.select("document_id", long("n_issues").alias("n_issues"), long("n_bad_cells").alias("bad"), F.array_join(F.transform("empty_rows", lambda x: x.cast("string")), ",").alias("empty"), F.col("column_count_ok").alias("ok"), F.round("confidence", 6).alias("confidence"), "valid", "retry")


@query(values("document_id BIGINT, headers VARCHAR, rows VARCHAR, retried BOOLEAN", [(1, "x|2566", "a|5", True), (2, "x|2566", "a|6", False)]))
def retried_tables(t):
    old = given(t, [(1, "t", "", ["x", "2566"], [["a", "S"]]), (2, "t", "", ["x", "2566"], [["a", "6"]])])
    new = given(t, [(1, "t", "", ["x", "2566"], [["a", "5"]]), (2, "t", "", ["x", "2566"], [["a"]])])
    out = tables.corrected(old, new, ["document_id"])
    return flat(out).join(out.select("document_id", "retried"), "document_id")


@query("""
SELECT CAST(o_custkey AS BIGINT) AS document_id, o_orderpriority AS table_name, count(*) AS n_rows, 'key|status' AS headers,
       md5(string_agg(o_orderkey || '|' || o_orderstatus, '/' ORDER BY o_orderkey)) AS digest FROM orders GROUP BY 1, 2""")
def grouped_tables(t):
    cells = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("key"), F.col("o_orderkey").cast("string"))
    rows = t("orders").select(long("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("table_name"), F.array(F.lit("key"), F.lit("status")).alias("headers"), cells.alias("cells"), F.col("o_orderkey").alias("row_index"))
    out = flat(tables.grouped_tables(rows).withColumn("document_id", F.struct("document_id", "table_name")))
    lines = F.size(F.split("rows", "/"))
    return out.select("document_id.document_id", "document_id.table_name", long(lines).alias("n_rows"), "headers", F.md5(F.col("rows").cast("binary")).alias("digest"))


@query("SELECT regexp_extract(o_clerk, '^(.*?_table_[0-9]+)_.*$', 1) AS part_of, count(*) AS n FROM (SELECT 'doc_table_' || (o_orderkey % 7) || '_part' || o_orderkey AS o_clerk FROM orders) GROUP BY 1")
def derived_groups(t):
    name = F.concat(F.lit("doc_table_"), (F.col("o_orderkey") % 7).cast("string"), F.lit("_part"), F.col("o_orderkey").cast("string"))
    return t("orders").groupBy(text.table_group(name).alias("part_of")).agg(F.count("*").alias("n"))


@query("SELECT CAST(l_suppkey AS BIGINT) AS l_suppkey, string_agg(l_returnflag || '=' || v, ',' ORDER BY l_returnflag) AS cells FROM (SELECT l_suppkey, l_returnflag, arg_max(l_orderkey, (l_orderkey, l_linenumber, l_partkey)) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def last_value_map(t):
    last = t("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.max_by("l_orderkey", F.struct("l_orderkey", "l_linenumber", "l_partkey")).alias("v"))
    pair = F.sort_array(F.collect_list(F.struct(F.col("l_returnflag").alias("k"), F.col("v").cast("string").alias("v"))))
    nested = last.groupBy(long("l_suppkey").alias("l_suppkey")).agg(F.map_from_entries(pair).alias("m"))
    return nested.select("l_suppkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("cells"))


@query("SELECT o_orderpriority AS label, string_agg(y || ':' || n, ' ' ORDER BY y) AS years FROM (SELECT o_orderpriority, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1")
def label_years(t):
    n = t("orders").groupBy("o_orderpriority", F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    return n.groupBy(F.col("o_orderpriority").alias("label")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("y", "n"))), lambda x: F.concat_ws(":", x["y"].cast("string"), x["n"].cast("string"))), " ").alias("years"))


@query("SELECT l_returnflag, median(l_quantity) AS median_quantity FROM lineitem GROUP BY 1")
def medians(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.median("l_quantity").alias("median_quantity"))


@query("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, min(c_acctbal) AS low, max(c_acctbal) AS high, string_agg(DISTINCT CAST(c_nationkey % 3 AS VARCHAR), ',' ORDER BY CAST(c_nationkey % 3 AS VARCHAR)) AS thirds FROM customer GROUP BY 1 HAVING count(*) > 5")
def having_and_lists(t):
    third = F.array_join(F.sort_array(F.collect_set((F.col("c_nationkey") % 3).cast("string"))), ",").alias("thirds")
    out = t("customer").groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("nations"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), third, F.count("*").alias("n"))
    return out.filter("n > 5").drop("n")


@query("SELECT o_orderpriority, year(o_orderdate)::BIGINT AS y, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, year(o_orderdate))")
def rollup_years(t):
    return t("orders").rollup("o_orderpriority", long(F.year("o_orderdate")).alias("y")).agg(F.count("*").alias("n"))


NORM = "sqrt(list_sum(list_transform({v}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
FAR = "1 - list_sum(list_transform(list_zip(a, b), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) / (" + NORM.format(v="a") + " * " + NORM.format(v="b") + " + 1e-10)"
BREAKS = f"""
WITH s AS (SELECT label, vec_id, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
d AS (SELECT label, vec_id, CASE WHEN b IS NULL THEN NULL ELSE {FAR} END AS distance FROM s),
m AS (SELECT label, avg(distance) + 0.5 * stddev_pop(distance) AS most FROM d GROUP BY 1)
SELECT vec_id, round(distance, 6) AS distance, coalesce(distance > most, false) AS breaks FROM d JOIN m USING (label)"""


@query(BREAKS)
def sentence_breaks(t):
    return retrieval.breaks(t("embeddings"), "label", "vec_id").select("vec_id", F.round("distance", 6).alias("distance"), "breaks")


@query("SELECT CAST(label AS BIGINT) AS label, CAST(sum(2 + length(CAST(vec_id AS VARCHAR))) AS BIGINT) AS n_chars, md5(string_agg('s' || vec_id || '.', ' ' ORDER BY vec_id)) AS digest FROM embeddings GROUP BY 1")
def semantic_chunks(t):
    sentences = t("embeddings").withColumn("text", F.concat(F.lit("s"), F.col("vec_id").cast("string"), F.lit(".")))
    chunks = retrieval.semantic_chunks(sentences, "label", "vec_id", least=20, most=200)
    whole = chunks.groupBy(long("label").alias("label")).agg(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))
    body = F.array_join(F.transform("c", lambda x: x["chunk_text"]), " ")
    return whole.select("label", long(F.length(F.replace(body, F.lit(" "), F.lit("")))).alias("n_chars"), F.md5(body.cast("binary")).alias("digest"))


@query("""
SELECT e.event_id, p.event_id AS last_purchase FROM (SELECT * FROM events WHERE event_type = 'view') e
ASOF LEFT JOIN (SELECT user_id, event_id FROM events WHERE event_type = 'purchase') p ON e.user_id = p.user_id AND e.event_id >= p.event_id""")
def as_of_join(t):
    # both sides in one window: no pair is made
    own = t("events").filter(F.col("event_type").isin("view", "purchase")).select("user_id", "event_id", "event_type")
    before = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(before)
    return own.withColumn("last_purchase", last).filter("event_type = 'view'").select("event_id", "last_purchase")


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, b.band FROM lineitem JOIN (VALUES (0, 10, 'few'), (10, 30, 'some'), (30, 100, 'many')) AS b(lo, hi, band) ON l_quantity >= lo AND l_quantity < hi")
def range_join(t):
    bands = t.spark.createDataFrame([(0, 10, "few"), (10, 30, "some"), (30, 100, "many")], "lo int, hi int, band string")
    return t("lineitem").join(F.broadcast(bands), (F.col("l_quantity") >= F.col("lo")) & (F.col("l_quantity") < F.col("hi"))).select("l_orderkey", long("l_linenumber").alias("l_linenumber"), "band")


@query("SELECT c_custkey, CAST(count(o_orderkey) AS BIGINT) AS n_rows, md5(coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey), '')) AS digest FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def document_fetch(t):
    kids = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("kids"))
    own = t("customer").select("c_custkey").join(kids, "c_custkey", "left")
    return own.select("c_custkey", long(F.coalesce(F.size("kids"), F.lit(0))).alias("n_rows"), F.md5(F.coalesce(F.array_join("kids", ","), F.lit("")).cast("binary")).alias("digest"))


@query("SELECT 'orders' AS part, o_orderkey AS id FROM orders WHERE o_custkey % 10 <> 3 UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey % 10 <> 3")
def cascade_delete(t):
    gone = t("customer").filter("c_custkey % 10 = 3").select("c_custkey")
    left = tables.without({"customer": (t("customer"), "c_custkey"), "orders": (t("orders"), "o_custkey")}, gone, "c_custkey")
    return left["orders"].select(F.lit("orders").alias("part"), F.col("o_orderkey").alias("id")).unionByName(left["customer"].select(F.lit("customer").alias("part"), F.col("c_custkey").alias("id")))


@query("""
WITH k AS (SELECT doc_id AS chunk_id, lang, source, CASE WHEN source LIKE '%1' THEN NULL ELSE source END AS kind FROM documents)
SELECT chunk_id FROM k WHERE kind IS NULL OR kind NOT IN (SELECT min(source) FROM documents)""")
def kept_kinds(t):
    least = t("documents").agg(F.min("source")).first()[0]
    kind = F.when(~F.col("source").like("%1"), F.col("source"))
    return t("documents").withColumn("kind", kind).filter(F.col("kind").isNull() | ~F.col("kind").isin(least)).select(F.col("doc_id").alias("chunk_id"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS document_id, 'node' AS part, 'name: ' || n_name AS text FROM nation WHERE n_regionkey IN (1, 2)")
def graph_documents(t):
    nodes = t("nation").select(long("n_regionkey").alias("document_id"), long("n_nationkey").alias("item_id"), F.create_map(F.lit("name"), F.col("n_name")).alias("attrs"))
    return retrieval.graph_hits(nodes, nodes.limit(0), "", [1, 2]).select("document_id", "part", "text")


@query("SELECT CAST(r_regionkey AS BIGINT) AS document_id, CASE WHEN r_regionkey = 1 THEN 0 ELSE coalesce(n, 0) END AS file_count, CASE WHEN r_regionkey = 1 THEN 'empty' WHEN n IS NULL THEN 'not_built' ELSE 'ready' END AS status FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation WHERE n_regionkey <> 2 GROUP BY 1) ON n_regionkey = r_regionkey")
def graph_listing(t):
    held = t("nation").filter("n_regionkey <> 2").select(long("n_regionkey").alias("document_id"), F.when(F.col("n_regionkey") != 1, F.col("n_name")).alias("file"))
    return retrieval.graph_status(t("region").select(long("r_regionkey").alias("document_id")), held)


@query(values("question VARCHAR, table_name VARCHAR, overlap BIGINT, asked BIGINT", [
    ("การลงทุนของธนาคาร 2 อันดับแรก", "การลงทุน_ของธนาคาร", 51, 2), ("xyz", None, None, None), ("งบดุล?", "งบดุล", 15, None),
]))
def table_lookup(t):
    asked = t.spark.createDataFrame([("การลงทุนของธนาคาร 2 อันดับแรก",), ("xyz",), ("งบดุล?",)], "question string")
    names = t.spark.createDataFrame([("การลงทุน_ของธนาคาร",), ("งบดุล",), ("",), (None,)], "table_name string")
    return retrieval.table_for(asked, names).select("question", "table_name", long("overlap").alias("overlap"), long(retrieval.asked_rows(F.col("question"))).alias("asked"))


@query("""
WITH f AS (SELECT o_orderpriority AS table_name, o_orderstatus AS row_label, CAST(year(o_orderdate) AS VARCHAR) AS metric_year FROM orders),
a AS (SELECT p_brand AS table_name, p_name AS row_label, p_type AS col_name FROM part)
(SELECT 'fact tables' AS section, table_name AS item, count(*) AS n FROM f GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
UNION ALL (SELECT 'lookup tables', table_name, count(*) FROM a GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 20)
UNION ALL (SELECT DISTINCT 'labels', row_label, CAST(NULL AS BIGINT) FROM f ORDER BY 2 LIMIT 30)
UNION ALL (SELECT DISTINCT 'years', metric_year, CAST(NULL AS BIGINT) FROM f)
UNION ALL (SELECT DISTINCT 'attributes', col_name, CAST(NULL AS BIGINT) FROM a ORDER BY 2 LIMIT 20)
UNION ALL (SELECT DISTINCT 'lookup labels', row_label, CAST(NULL AS BIGINT) FROM a ORDER BY 2 LIMIT 20)
UNION ALL (SELECT 'wide columns', col_name, count(*) FROM a WHERE col_name NOT LIKE 'column_%' AND length(col_name) BETWEEN 2 AND 40 GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 30)""")
def schema_description(t):
    facts = t("orders").select(F.col("o_orderpriority").alias("table_name"), F.col("o_orderstatus").alias("row_label"), F.year("o_orderdate").cast("string").alias("metric_year"))
    attributes = t("part").select(F.col("p_brand").alias("table_name"), F.col("p_name").alias("row_label"), F.col("p_type").alias("col_name"))
    return retrieval.schema_description(facts, attributes)


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def user_sql(t):
    sql = "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"
    return files.select(t.spark, sql, {"orders": t("orders")})


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC NULLS LAST, p_partkey LIMIT 15")
def ranked_numbers(t):
    return t("part").select("p_partkey", "p_retailprice").orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(15)


@query("SELECT * FROM (SELECT event_id, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 7 END, 0) AS page, event_id % 3 AS place FROM events) ORDER BY page, place, event_id LIMIT 50")
def page_order(t):
    page = F.coalesce(F.when(F.col("event_id") % 5 != 0, F.col("event_id") % 7), F.lit(0))
    return t("events").select("event_id", page.alias("page"), (F.col("event_id") % 3).alias("place")).orderBy("page", "place", "event_id").limit(50)


@query("SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, phase, length(text), text) - 1 AS BIGINT) AS chunk_index, md5(text) AS digest FROM (SELECT conv_id, turn, text, CASE role WHEN 'user' THEN 0 ELSE 1 END AS phase FROM conversations)")
def running_index(t):
    own = t("conversations").withColumn("phase", F.when(F.col("role") == "user", 0).otherwise(1))
    at = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "phase", F.length("text"), "text")) - 1
    return own.select("conv_id", long(at).alias("chunk_index"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT CAST(d.doc_id AS BIGINT) AS doc_id, 'RAW_OCR_PAGE: ' || source || ' page ' || (doc_id % 9) || chr(10) || substr(lang, 1, 2) AS text, 'raw_ocr_page' AS source_kind FROM documents d WHERE doc_id % 9 < 4 AND trim(lang) <> ''")
def raw_page_chunks(t):
    raw = t("documents").select("doc_id", F.col("source").alias("filename"), (F.col("doc_id") % 9).alias("page"), F.substring("lang", 1, 2).alias("markdown"))
    return pages.raw_page_chunks(raw, most_pages=4).select("doc_id", "text", "source_kind")


@query("SELECT CAST(conv_id AS BIGINT) AS conv_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY turn), 1, 5000) AS raw_text FROM conversations GROUP BY 1")
def raw_text_appended(t):
    return pages.appended(t("conversations"), "conv_id", "turn", "text", 5000).select(long("conv_id").alias("conv_id"), "raw_text")


@case(values("id BIGINT, body VARCHAR", [(1, "b2"), (2, "c"), (3, "d"), (4, "")]))
def upserted(t):
    old = t.spark.createDataFrame([(1, "b"), (2, "c"), (4, "")], "id long, body string")
    return tables.upserted(old, t.spark.createDataFrame([(1, "b2"), (3, "d")], "id long, body string"), ["id"])


@query("SELECT name, n FROM (SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders) UNION ALL SELECT 'left in orders', 0")
def emptied(t):
    left, counts = tables.emptied(t.spark, {"customer": t("customer"), "orders": t("orders")})
    return counts.unionByName(left["orders"].agg(F.count("*").alias("n")).select(F.lit("left in orders").alias("name"), "n"))


@query("SELECT CAST(p_partkey AS BIGINT) AS id, '{\"p_brand\":\"' || p_brand || '\",\"p_size\":' || p_size || '}' AS row FROM part")
def rows_as_objects(t):
    return t("part").select(long("p_partkey").alias("id"), F.to_json(F.struct("p_brand", "p_size")).alias("row"))


@query("SELECT l_orderkey, date_trunc('month', l_shipdate) AS month, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS shown FROM lineitem WHERE l_linenumber = 1")
def iso_dates(t):
    return t("lineitem").filter("l_linenumber = 1").select("l_orderkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("shown"))


@query("SELECT page_id, CAST(n AS BIGINT) AS n FROM (SELECT page_id, len(list_distinct(list_filter(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1), lambda h: regexp_matches(h, '^https?://') AND NOT contains(h, 'example.net')))) AS n FROM pages)")
def search_results(t):
    found = pages.result_links(t("pages"), "page_id", "example.net", 1 << 30)
    counted = found.groupBy("page_id").agg(F.count("*").alias("n"))
    return t("pages").select("page_id").join(counted, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


HTML = "<html><head><title>T</title></head><body><nav><a href='x'>menu one two</a></nav><script>var a = 1;</script><article><h1>Head line here</h1><p>{p}</p><p>{p}</p><p>Short.</p></article><footer>tags: more of it</footer></body></html>"


@query("""
SELECT strftime(date_trunc('day', ts) - to_days(CAST(k AS INTEGER)), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 2) AS total
FROM events, (VALUES (0), (1)) AS k(k) GROUP BY 1, 2""")
def stream_sliding_counts(t):
    rows = counts.streamed(t.spark, t.path("events"), t("events").schema, lambda e: counts.windowed(e, "2 days", slide="1 day"))
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query("""
WITH g AS (SELECT user_id, ts, value, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, k""")
def stream_sessions(t):
    rows = counts.streamed(t.spark, t.path("events"), t("events").schema, lambda e: counts.sessions(e, "6 hours"))
    return rows.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("total", 2).alias("total"))
