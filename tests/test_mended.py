"""Cases that once went wrong: order of hybrid hits, the SELECT guard, names of tables and parts, balanced braces."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import repairs, retrieval, tables
from docloom.sources import files


def test_a_raw_page_at_distance_nought_comes_first_and_shows_less(spark):
    rows = [(1, "x", [1.0, 0.0], "raw_ocr_page"), (2, "y", [1.0, 0.1], "semantic"), (3, "z", [0.0, 1.0], None)]
    got = retrieval.hybrid(spark.createDataFrame(rows, "chunk_id long, chunk_text string, embedding array<double>, kind string"), "q", ["none"], [1.0, 0.0], kind="kind").collect()
    assert [(r.chunk_id, r.rank) for r in got] == [(1, 1), (2, 2), (3, 3)] and got[0].similarity == pytest.approx(0.92) and got[1].similarity > 0.99


@pytest.mark.parametrize("sql,fine", [
    ("SELECT copy FROM t", True), ("SELECT a AS set FROM t", True), ("SELECT 1 AS update, 2 AS drop, 3 AS pragma", True), ("-- note; drop\n/* x */ SELECT 1", True), ("WITH a AS (SELECT 1) SELECT * FROM a", True),
    ("select 'drop table x; --'", True), ("SELECT 1;", True), ("SELECT 1; SELECT 2", False), ("DROP TABLE t", False), ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", False), ("INSERT INTO t VALUES (1)", False),
    ("SET x = 1", False), ("EXPLAIN SELECT 1", False), ("", False), ("SELECT ((1", False), ("CREATE TABLE t AS SELECT 1", False), ("TRUNCATE TABLE t", False), ("SHOW TABLES", False),
])
def test_only_one_select(spark, sql, fine):
    assert text.only_select(sql, spark) is fine


def test_views_of_the_session_stand_again(spark):
    spark.range(3).createOrReplaceTempView("kept_view")
    got = files.select(spark, "SELECT count(*) AS n FROM kept_view JOIN fresh_view USING (id)", {"kept_view": spark.range(5), "fresh_view": spark.range(4)})
    assert got.collect()[0].n == 4 and spark.table("kept_view").count() == 3 and not spark.catalog.tableExists("fresh_view")
    with pytest.raises(ValueError):
        files.select(spark, "DROP VIEW kept_view")


def test_titles_names_and_texts_of_tables(spark):
    rows = [(1, "**Assets** **Assets**", None, ["a", ""], [["1", "2,0"], ["", ""]]), (2, None, "Loans_Loans", ["a"], []), (3, "", "", ["x"], [["y"]])]
    df = spark.createDataFrame(rows, "id int, title string, table_name string, headers array<string>, rows array<array<string>>")
    got = {r.id: (r.title, r.table_name, r.csv_text) for r in tables.normalized(df, F.concat(F.lit("doc_table_"), F.col("id").cast("string"))).collect()}
    assert got == {1: ("Assets", "Assets", 'a,column_2\n1,"2,0"'), 2: ("doctable2", "Loans", ""), 3: ("doctable3", "doctable3", "x\ny")}


def test_parts_keep_their_table_and_a_table_without_title_goes_by_its_name(spark):
    rows = [(1, None, "Balance", ["item", "v"], [["Balance", ""], ["a", "1"], ["Debts", ""], ["b", "2"]]), (2, "Other", "tab_2", ["item", "v"], [["Part", ""], ["c", "3"]])]
    df = spark.createDataFrame(rows, "id int, title string, table_name string, headers array<string>, rows array<array<string>>")
    parts = repairs.sections(df, ["id"])
    got = {(r.id, r.section): (r.title, r.table_name, r.csv_text) for r in parts.collect()}
    assert got == {(1, 0): ("Balance", "BalanceBalance", "item,v\na,1"), (1, 1): ("Debts", "BalanceDebts", "item,v\nb,2"), (2, 0): ("Part", "tab2Part", "item,v\nc,3")}
    whole = {r.id: r.rows for r in repairs.recombined(parts, df, ["id"]).collect()}
    assert whole[1] == [["a", "1"], ["Debts", ""], ["b", "2"]] and whole[2] == [["c", "3"]]


def brute_balanced(s, quoted):
    start = s.find("{")
    depth, within, escaped = 0, False, False
    for i in range(start, len(s)) if start >= 0 else ():
        c = s[i]
        if quoted and within:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                within = False
            continue
        if c == '"':
            within = True
        depth += (c == "{") - (c == "}")
        if c == "}" and depth == 0:
            return s[start : i + 1]
    return None


@pytest.mark.parametrize("quoted", [True, False])
def test_braces_of_every_short_text(spark, quoted):
    texts = ["".join(t) for n in range(8) for t in itertools.product('{}"\\', repeat=n)] + ["{" + "".join(t) for t in itertools.product('{}"\\', repeat=7)] + ['a {"b": "}", "c": {}} d }', '{"k": "\\""}', "{ü{ñ}ก} x"]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").repartition(8)
    assert all(r.b == (None if r.t is None else brute_balanced(r.t, quoted)) for r in df.select("t", text.balanced(F.col("t"), quoted).alias("b")).collect())


def test_a_long_text_of_braces_takes_one_pass(spark):
    long = "{" * 200_000 + '"}' * 2 + "}" * 200_000
    assert spark.createDataFrame([(long,)], "t string").select(F.length(text.balanced(F.col("t"))).alias("n")).collect()[0].n == len(long) - (0 if brute_balanced(long, True) == long else len(long) - len(brute_balanced(long, True)))


def test_actions(spark):
    rows = ['x Action: {"tool": "sql", "query": "q {1}"} y', 'Action: {"tool": "sql"}', 'Action: {"tool": 1, "query": null} {', "Action: {bad}", "none", None, '{"tool": "a", "query": "b"}', 'Action:\n\n{"query": {"a": 1}, "tool": "t"}']
    got = [r.a for r in spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").orderBy("i").select(text.action(F.col("t")).alias("a")).collect()]
    assert [None if a is None else (a.tool, a.query) for a in got] == [("sql", "q {1}"), None, ("1", None), None, None, None, None, ("t", json.dumps({"a": 1}).replace(" ", ""))]
