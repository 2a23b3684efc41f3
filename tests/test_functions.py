"""Scalar functions and table operators on literal rows."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.functions import numeric, text
from docloom.operators import pages, retrieval, tables
from docloom.sources import files

TABLE = "document_id int, table_name string, headers array<string>, rows array<array<string>>"


def values(spark, cells, column):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r["v"] for r in rows.select("i", column(F.col("c")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "mode,want",
    [
        ("warehouse", [-1234.0, 12.5, None, None, 1234.5, None, 5.0, None, None, 1234.0]),
        ("strict", [-1234.0, None, None, None, 1234.5, None, None, None, None, 1234.0]),
        ("loose", [-1234.0, 12.5, None, None, 1234.5, None, 5.0, None, None, 1234.0]),
    ],
)
def test_numbers(spark, mode, want):
    cells = ["(1,234)", "12.5%", "–", "abc", " 1,234.50 ", "", "+5", None, "nan", "๑,๒๓๔"]
    assert values(spark, cells, lambda c: numeric.parse_numeric(c, mode)) == want


def test_backfill_loses_the_sign_of_brackets(spark):
    assert values(spark, ["(1,234)", "-5%", "x"], numeric.parse_numeric_backfill) == [1234.0, -5.0, None]


def test_units(spark):
    assert values(spark, ["(%)", "ล้านบาท", "(หุ้น)", "5", None], numeric.unit_token) == ["%", "ล้านบาท", "หุ้น", None, None]
    assert values(spark, ["ROE", "กำไรต่อหุ้น", None, "x (พันบาท)"], lambda c: numeric.guess_unit(c, F.lit(""))) == ["%", "บาท", "", "พันบาท"]


def test_formats(spark):
    assert values(spark, ["1,234.50", "5", "1.234"], lambda c: numeric.format_like(c, F.lit(9876.5))) == ["9,876.50", "9,876", "9,876.500"]
    assert values(spark, ["2", "2.5"], lambda c: numeric.format_delta(c.cast("double"))) == ["2", "2.50"]


def test_cells(spark):
    assert values(spark, ["๑๒๓,๔๕๖.๗๘", "1,2O4", "l,234", "-", "", "a​b", "บท", None], text.clean_cell) == ["123,456.78", "1,204", "1,234", "-", "", "ab", "บท", ""]
    assert values(spark, ["31 ธ.ค. 2566", "1 ม.ค. 68", "2024-01-01"], lambda c: c.rlike(text.THAI_DATE)) == [True, True, False]


def test_names(spark):
    assert values(spark, ["abab", "ab_ab", "2567", "a", ""], text.halved) == ["ab", "ab", "2567", "a", ""]
    assert values(spark, [" A (b)-c% ", None], text.normalize_lookup) == ["abc", ""]
    long_name = values(spark, ["x" * 300], text.safe_name)[0]
    assert len(long_name) == 240 and long_name.startswith("xxx")
    assert values(spark, ['a,"b"', None, "c"], text.csv_cell) == ['"a,""b"""', "", "c"]


def test_terms_and_years(spark):
    assert values(spark, ["What is ROE roe in ปี 2567 for SCB", None], text.keyword_terms) == [["is", "ROE", "in", "2567", "SCB"], None]
    assert values(spark, ["ปี 2567, 2020 x2021 3000"], text.years_in) == [["2567", "2020"]]
    assert values(spark, ["a. b! c? d"], text.sentences) == [["a.", "b!", "c?", "d"]]


def test_tables_are_normalized(spark):
    rows = [(1, "t", ["", "column_2", "column_3", ""], [["", "2566", "2565"], ["x", "1"], ["", " "], ["y", "๒", "3", "4"]])]
    out = tables.normalized(spark.createDataFrame(rows, TABLE)).first()
    assert out["headers"] == ["รายการ", "2566", "2565", "2564"]
    assert out["rows"] == [["x", "1", "", ""], ["y", "๒", "3", "4"]]
    cleaned = tables.cleaned(spark.createDataFrame(rows, TABLE)).first()
    assert cleaned["rows"][3] == ["y", "2", "3", "4"]
    twice = tables.normalized(spark.createDataFrame([(1, "t", ["a", "a", "", "b"], [])], TABLE)).first()
    assert twice["headers"] == ["a", "a_2", "column_3", "b"] and twice["rows"] == []


def test_units_that_slip_into_a_year_shift_the_row(spark):
    rows = [(1, "t", ["รายการ", "2567", "2566", "2565", "2564", "2563"], [["ผลตอบแทน", "(%)", "1.10", "1.22", "1.20", "1.32"], ["", "1", "2", "3", "4", "5"], ["x", "1", "", "-", "4", "5"]])]
    loaded = tables.facts(spark.createDataFrame(rows, TABLE), ["document_id", "table_name"])
    got = {(r["row_label"], r["metric_year"]): (r["numeric_value"], r["unit"]) for r in loaded.collect()}
    assert got == {
        **{("ผลตอบแทน", y): (v, "%") for y, v in [("2567", 1.10), ("2566", 1.22), ("2565", 1.20), ("2564", 1.32), ("2563", 1.32)]},
        **{("x", y): (v, "") for y, v in [("2567", 1.0), ("2565", None), ("2564", 4.0), ("2563", 5.0)]},
    }


def test_attributes_pivot_back(spark):
    rows = [(1, "t", ["ชื่อ", "จำนวน", "หมายเหตุ"], [["a", "1,000", ""], ["", "5%", "z"]]), (2, "u", ["k", "2566"], [["r", "1"]])]
    eav = tables.attributes(spark.createDataFrame(rows, TABLE), ["document_id", "table_name"])
    assert {(r["row_label"], r["col_name"], r["col_value_num"]) for r in eav.collect()} == {("a", "จำนวน", 1000.0), ("row_1", "จำนวน", 5.0), ("row_1", "หมายเหตุ", None)}
    wide = tables.wide(eav, ["document_id", "row_label"], "row_index").collect()
    assert {(r["row_label"], r["จำนวน"], r["หมายเหตุ"]) for r in wide} == {("a", "1,000", None), ("row_1", "5%", "z")}
    assert tables.wide(eav.limit(0), ["document_id"], "row_index").count() == 0
    clash = spark.createDataFrame([(1, "document_id", "x", 0)], "document_id int, col_name string, col_value string, row_index int")
    assert tables.wide(clash, ["document_id"], "row_index").columns == ["document_id", "document_id_1"]


def test_reload_replaces_a_table(spark):
    old = spark.createDataFrame([(1, "t", 1), (1, "u", 2), (None, "t", 3)], "document_id int, table_name string, v int")
    new = spark.createDataFrame([(1, "t", 9)], old.schema)
    assert {tuple(r) for r in tables.replaced(old, new, ["document_id", "table_name"]).collect()} == {(1, "t", 9), (1, "u", 2), (None, "t", 3)}


def test_issues(spark):
    rows = [(1, "t", ["รายการ", "2566", "2565"], [["a", "1,234", "-"], ["b", "x", "5%"]]), (2, "u", ["a", "b"], [["1"], ["", ""]]), (3, "v", [], [])]
    out = {r["document_id"]: r for r in tables.issues(spark.createDataFrame(rows, TABLE), ["document_id"]).collect()}
    assert (out[1]["n_bad_cells"], out[1]["column_count_ok"], out[1]["valid"]) == (1, True, False)
    assert out[1]["confidence"] == pytest.approx(1 - 2 / 6)
    assert (out[2]["column_count_ok"], out[2]["empty_rows"], out[2]["retry"], out[2]["confidence"]) == (False, [1], True, pytest.approx(0.1))
    assert (out[3]["valid"], out[3]["confidence"]) == (True, 1.0)


def test_stored_rows_are_synced_into_the_warehouse(spark):
    stored = tables.warehouse(spark)
    rows = spark.createDataFrame([(1, "t", ["รายการ", "2566"], {"รายการ": "a", "2566": "5"}, 1), (1, "t", ["รายการ", "2566"], {"รายการ": "b", "2566": "6"}, 0), (2, None, ["k", "v"], {"k": "x", "v": "1"}, 0)], "document_id int, table_name string, headers array<string>, cells map<string,string>, row_index int")
    documents = spark.createDataFrame([(1, "f", "pdf", None, None), (2, "g", "pdf", None, None)], stored["dim_documents"].schema)
    once = tables.synced(rows, stored, documents)
    twice = tables.synced(rows, once, documents)
    assert [(r["row_label"], r["metric_year"], r["numeric_value"], r["row_index"]) for r in twice["fact_financial_metrics"].orderBy("row_index").collect()] == [("b", "2566", 6.0, 0), ("a", "2566", 5.0, 1)]
    assert [(r["table_name"], r["row_label"], r["col_name"], r["col_value"]) for r in twice["dim_table_rows"].collect()] == [("unknown", "x", "v", "1")]
    assert {name: df.count() for name, df in twice.items()} == {"dim_documents": 2, "dim_tables": 2, "fact_financial_metrics": 2, "dim_table_rows": 1}
    assert all(df.columns == stored[name].columns for name, df in twice.items())


def test_only_a_select_is_run(spark):
    for good in ("SELECT 1 AS x", " with a as (select 1 as x) select * from a ; ", "-- note\nSELECT 'drop table t; x' AS x", "/* a */ select 1 AS x"):
        assert files.select(spark, good.rstrip("; ")).count() == 1
    for bad in ("DROP TABLE t", "SELECT 1; DROP TABLE t", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "", "CREATE VIEW v AS SELECT 1", "selection"):
        with pytest.raises(ValueError):
            files.select(spark, bad)
    out = files.shown(spark.range(60).withColumnRenamed("id", "n"), 50)
    assert (out["columns"], len(out["rows"]), out["row_count"], out["rows"][0]) == (["n"], 50, 60, {"n": 0})


def test_uploads_and_downloads(spark, tmp_path):
    for name in ("a.pdf", "b.PNG", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert sorted(r["path"][-5:] for r in files.uploads(spark, str(tmp_path)).select("path").collect()) == ["a.pdf", "b.PNG"]
    rows = [(200, "application/pdf", 6000, "http://h/x.pdf?a=1"), (404, "application/pdf", 6000, "u"), (200, "text/html; x", 9000, "u"), (200, "image/png", 1500, "http://h/i.png"), (200, None, 100, "u")]
    out = files.downloads(spark.createDataFrame(rows, "status int, content_type string, length int, path string"))
    assert [r["filename"] for r in out.orderBy("length").collect()] == ["i.png", "x.pdf"]


def test_chunks_break_where_meaning_turns(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    sentences = [(d, i, "".join(rng.choice(list("abcd "), rng.integers(5, 90))), [float(x) for x in rng.normal(size=6)]) for d in range(4) for i in range(25)]
    df = spark.createDataFrame(sentences, "doc int, pos int, text string, embedding array<double>")
    out = retrieval.semantic_chunks(df, "doc", "pos", least=60, most=300).orderBy("doc", "chunk_index").collect()
    for d in range(4):
        own = [s for s in sentences if s[0] == d]
        v = np.array([s[3] for s in own])
        far = [1 - v[i] @ v[i + 1] / (np.linalg.norm(v[i]) * np.linalg.norm(v[i + 1]) + 1e-10) for i in range(24)]
        limit = np.mean(far) + 0.5 * np.std(far)
        chunks, now, size = [], [own[0][2]], len(own[0][2])
        for i in range(24):
            text_ = own[i + 1][2]
            if (far[i] > limit and size >= 60) or size + len(text_) > 300:
                chunks.append(" ".join(now))
                now, size = [], 0
            now.append(text_)
            size += len(text_)
        chunks.append(" ".join(now))
        assert [r["chunk_text"] for r in out if r["doc"] == d] == chunks
    for r in out:
        assert r["end_char"] - r["start_char"] == len(r["chunk_text"])


def test_table_parts_of_pages(spark):
    raw = spark.createDataFrame([("t", 3, ["a", " b"], [["1", None]]), ("e", 1, [], [])], "title string, page int, headers array<string>, rows array<array<string>>")
    assert [r["text"] for r in pages.raw_table_chunks(raw).collect()] == ["RAW_OCR_TABLE: t\nRAW_PAGE: 3\nRAW_HEADERS: a, b\nRAW_CSV:\na,b\n1,"]
    lines = spark.createDataFrame([("ab cd ef gh longer",), ("only long words here",), ("",)], "t string")
    assert [r[0] for r in lines.select(pages.mostly_short_words(F.col("t"))).collect()] == [True, False, False]
    assert [r[0] for r in lines.select(pages.is_block(F.col("t"), ["LONG"], 5)).collect()] == [True, True, True]
    boxes = spark.createDataFrame([(1000, 100, 12), (1000, 600, 0), (0, 0, 0)], "t int, l int, b int")
    assert [r[0] for r in boxes.select(pages.container_score(F.col("t"), F.col("l"), F.col("b"))).collect()] == pytest.approx([900 * 0.9 * 2, 400 * 0.4 * 0.25, 0.0])


def test_routes(spark):
    questions = ["ROE ปี 2567 เท่าไร", "อธิบายนโยบาย esg", "กำไรสุทธิ และ นโยบาย esg ปี 2566", "hello", None]
    rows = spark.createDataFrame(list(enumerate(questions)), "i int, q string")
    out = [(r["suggested_tool"], r["confidence"]) for r in retrieval.routed(rows, "q").orderBy("i").collect()]
    assert out == [("sql_query", "high"), ("vector_search", "high"), ("multi_hop", "high"), (None, "low"), (None, "low")]


def test_hybrid_puts_keyword_hits_first(spark):
    chunks = spark.createDataFrame([(1, "SCB profit 2567", [0.0, 1.0]), (2, "weather", [1.0, 0.0]), (3, "SCB", [1.0, 0.1]), (4, None, [0.0, 0.0])], "chunk_id int, chunk_text string, embedding array<float>")
    out = retrieval.hybrid(chunks, "SCB 2567", ["SCB", "2567"], [1.0, 0.0], 4).collect()
    assert [(r["chunk_id"], r["method"]) for r in out] == [(1, "keyword"), (3, "keyword"), (2, "semantic")]


def test_chunks_are_packed_in_order(spark):
    pieces = [("a" * 60, False), ("b" * 60, True), ("c" * 30, False), ("d" * 1990, False)]
    row = spark.createDataFrame([(pieces,)], "p array<struct<text:string,breaks:boolean>>")
    out = row.select(retrieval.packed(F.col("p")).alias("v")).first()["v"]
    assert out == ["a" * 60 + " " + "b" * 60, "c" * 30, "d" * 1990]


def test_texts_are_folded_in_parts():
    texts = ["ﬁ" if i % 2 else "a" for i in range(3 * text.FOLDED + 1)] + [None]
    made = list(text.nfkc.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert [len(m) for m in made] == [text.FOLDED] * 3 + [2] and [t for m in made for t in m.to_pylist()] == ["fi" if i % 2 else "a" for i in range(3 * text.FOLDED + 1)] + [None]
