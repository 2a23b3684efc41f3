"""Loads that break and come again, functions in SQL, and workers that can't import the package."""

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from docloom.functions import sql
from docloom.operators import loads, repairs

TABLES = "id int, title string, headers array<string>, rows array<array<string>>"


def frame(spark, rows, columns="document_id long, v string"):
    return spark.createDataFrame(rows, columns)


def rows_of(spark, folder, name):
    return sorted([tuple(r) for r in loads.read(spark, folder, name).collect()], key=str)


def test_a_crash_between_tables_leaves_the_old_state_and_the_load_comes_again(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "w")
    facts, notes = frame(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "n")]), frame(spark, [(1, "x"), (3, "y")])
    assert loads.write({"facts": facts, "notes": notes}, facts.unionByName(notes), folder, 0)
    before = rows_of(spark, folder, "facts"), rows_of(spark, folder, "notes")
    assert before[0] == [(1, "a"), (1, "b"), (2, "c"), (None, "n")]
    fresh = {"facts": frame(spark, [(1, "new")]), "notes": frame(spark, [(9, "bad")]).withColumn("v", F.raise_error(F.lit("worker lost")))}
    with pytest.raises(Exception, match="worker lost"):
        loads.write(fresh, fresh["facts"], folder, 1)
    assert (rows_of(spark, folder, "facts"), rows_of(spark, folder, "notes")) == before
    fresh["notes"] = frame(spark, [], "document_id long, v string")
    for again in (True, False):
        assert loads.write(fresh, fresh["facts"], folder, 1) is again
        assert rows_of(spark, folder, "facts") == [(1, "new"), (2, "c"), (None, "n")] and rows_of(spark, folder, "notes") == [(3, "y")]
    more = frame(spark, [(2, "d", 5)], "document_id long, v string, extra int")
    loads.write({"facts": more}, more, folder, 2, gone=frame(spark, [(1, "")]))
    assert rows_of(spark, folder, "facts") == [(2, "d", 5), (None, "n", None)]
    loads.compacted(spark, folder, ["facts", "notes"], str(tmp_path / "c"))
    assert rows_of(spark, str(tmp_path / "c"), "facts") == [(2, "d", 5), (None, "n", None)] and loads.commits(spark, str(tmp_path / "c")).count() == 3


def test_batches_of_a_stream_are_loads(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "w")

    def run(state):
        stream = spark.readStream.schema("document_id long, v string").parquet(source)
        shape = lambda b: {"facts": b.select("document_id", F.upper("v").alias("v"))}
        stream.writeStream.foreachBatch(loads.batches(folder, shape)).option("checkpointLocation", str(tmp_path / state)).trigger(availableNow=True).start().awaitTermination()

    frame(spark, [(1, "a"), (2, "b")]).write.parquet(source)
    run("state")
    frame(spark, [(2, "c"), (3, "d")]).write.mode("append").parquet(source)
    run("state")
    assert rows_of(spark, folder, "facts") == [(1, "A"), (2, "C"), (3, "D")]
    run("lost")  # a stream whose state is lost begins again with batch 0, which is committed
    assert rows_of(spark, folder, "facts") == [(1, "A"), (2, "C"), (3, "D")]


def test_functions_in_sql(spark):
    sql.register(spark)
    got = [r[0] for r in spark.sql("SELECT parse_numeric(x) FROM VALUES (0, '1,200.5'), (1, '(3)'), (2, ' ๑๒ '), (3, 'x'), (4, ''), (5, NULL), (6, '-4'), (7, '1 2') AS t(i, x) ORDER BY i").collect()]
    assert got == [1200.5, -3.0, 12.0, None, None, None, -4.0, None]
    assert spark.sql("SELECT nfkc('\u2460\ufb01e\u0301')").collect()[0][0] == "1fi\u00e9"
    html = "<table><tr><td rowspan=2>a</td><td>b</td></tr><tr><td>c<table><tr><td>x</td></tr><tr><td>y</td></tr></table></td></tr></table><table><tr><td>alone</td></tr></table>"
    spark.createDataFrame([(1, html), (2, None), (3, "no")], "id int, html string").createOrReplaceTempView("pages_of_sql")
    rows = [tuple(r) for r in spark.sql("SELECT id, table_no, row_no, cells FROM pages_of_sql, LATERAL extract_tables(html) ORDER BY 1, 2, 3").collect()]
    assert rows == [(1, 0, 0, ["a", "b"]), (1, 0, 1, ["a", "c"]), (1, 1, 0, ["x"]), (1, 1, 1, ["y"])]


def test_headers_of_investment_tables(spark):
    blob, second = "ชื่อบริษัท ประเภทธุรกิจ ธนาคารถือหุ้น", ["", "", "**ชนิดหุ้น**", "จำนวนหุ้น", "(%)"]
    rows = [
        (1, "t", [blob], [second, ["a", "b", "c", "d", "e"]]), (2, "การลงทุนของธนาคารในบริษัทอื่น", ["x"], [["จำนวนหุ้น"], ["a", "b"], ["1", "2", "3", "4", "5", "6"]]), (3, None, ["ชื่อบริษัท ประเภทธุรกิจ ถือหุ้น", "k"], [["", "จำนวนหุ้น"], []]),
        (4, "t", [blob], [["a", "b", "c", "d", "e"]]), (5, "t", [blob], []), (6, None, None, None), (7, "t", ["h", "i"], [second]),
    ]
    got = {r.id: (r.title, r.headers, r.rows) for r in repairs.investment_headers(spark.createDataFrame(rows, TABLES)).collect()}
    five = repairs.INVESTMENT_HEADERS
    assert got[1] == ("t", five, [["a", "b", "c", "d", "e"]]) and got[2] == (repairs.INVESTMENT_TITLE, five, [["a", "b", "", "", ""], ["1", "2", "3", "4", "5"]]) and got[3] == (repairs.INVESTMENT_TITLE, five, [[""] * 5])
    assert all(got[i] == rows[i - 1][1:] for i in (4, 5, 6, 7))


ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[2]).config("spark.checkpoint.dir", sys.argv[2] + "/shared").getOrCreate()

def lost(batches):
    import importlib.util
    yield from (b.slice(0, 0) for b in batches if importlib.util.find_spec("docloom") is None)

assert spark.range(2).mapInArrow(lost, "id long").count() == 0
from docloom.plans import catalogue
for name in sys.argv[3:]:
    catalogue.queries()[name](spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
    print(name, "done")
"""


def test_workers_that_lack_the_package(tmp_path):
    (tmp_path / "alone.py").write_text(ALONE)
    names = ["main_text", "page_tables", "sql_functions", "nfkc_text"]
    out = subprocess.run([sys.executable, "alone.py", str(Path(__file__).resolve().parents[1]), str(tmp_path), *names], cwd=tmp_path, capture_output=True, text=True, timeout=400, check=False)
    assert out.stdout.count("done") == len(names), out.stderr[-3000:]
