"""Rules on cells, names and texts, each over rows given here with what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import numeric, text
from docloom.operators import retrieval
from docloom.plans.registry import Sql, cases

joined = lambda c: F.array_join(c, "|")
listed = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))

cases("rule_parse_numeric", numeric.parse_numeric, [
    ("(1,234)", -1234.0), ("12.5%", 12.5), ("–", None), ("abc", None), (" 1,100 ", 1100.0), ("( 5 )", -5.0), ("+7", 7.0), ("๑,๒๓๔", 1234.0), ("", None), ("(-5)", 5.0), (None, None), (".5", 0.5),
], "DOUBLE")
cases("rule_parse_strict", lambda c: numeric.parse_numeric(c, "strict"), [
    ("( 1,234 )", -1234.0), ("(-5)", 5.0), ("5%", None), ("+5", None), ("1,234.50", 1234.5), ("—", None), ("1.", None), ("-3", -3.0), (None, None),
], "DOUBLE")
cases("rule_parse_loose", lambda c: numeric.parse_numeric(c, "loose"), [
    ("(1,234)", -1234.0), ("–", None), ("12.5%", 12.5), ("-", None), ("((3))", -3.0), ("5)", 5.0), ("", None), (None, None),
], "DOUBLE")
cases("rule_looks_numeric", lambda c: F.coalesce(numeric.looks_numeric(c), F.lit(False)), [
    ("5%", False), ("(5)", False), ("-1,234.5", True), ("", False), ("1.", False), ("+5", False), (" 12 ", True), (None, False),
], "BOOLEAN")
cases("rule_format_like", lambda c, v: numeric.format_like(c, v), [
    ("9876", 1234.0, "1,234"), ("1,234.56", 9876.5, "9,876.50"), ("12.5%", 3.0, "3.00"), ("", 1000000.4, "1,000,000"), (None, 7.0, "7"), ("-", 2.5, "2"), ("0.125", 0.5, "0.500"), ("1.0", -1234.25, "-1,234.2"),
], inputs="x0 string, x1 double")
cases("rule_format_delta", lambda v: numeric.format_delta(v), [(3.0, "3"), (0.125, "0.13"), (-2.0, "-2"), (1.5, "1.50")], inputs="x0 double")
cases("rule_unit_token", numeric.unit_token, [("(บาท/หุ้น)", "บาท/หุ้น"), ("%", "%"), ("ล้าน", None), ("(%)", "%"), (" หุ้น ", "หุ้น"), ("", None), ("1.2", None)])
cases("rule_misplaced_unit", numeric.misplaced_unit, [("(%)", True), ("บาท", True), ("( บาท )", True), ("ราย", True), ("บาท/หุ้น", False), ("", False), ("(x)", False)], "BOOLEAN")
cases("rule_bracketed_unit", numeric.bracketed_unit, [("(anything)", True), ("%", True), ("พันบาท", False), ("()", False), ("(1234567890123456)", False), ("", False)], "BOOLEAN")
cases("rule_value_unit", numeric.infer_value_unit, [
    ("กำไรต่อหุ้น", "ROE", "", "บาท"), ("ROE", "", None, "%"), ("สินทรัพย์", "", "(ล้านบาท)", "ล้านบาท"), ("x", "y", "z", ""), ("อัตราส่วน", "", "ล้านบาท", "%"),
])
cases("rule_with_unit", numeric.with_unit, [("5", "%", "5%"), ("5%", "%", "5%"), ("12", "บาท", "12 บาท"), (" ", "บาท", ""), ("7", "", "7"), ("3 ล้านบาท", "ล้านบาท", "3 ล้านบาท"), (None, "%", "")])
cases("rule_guess_unit", numeric.guess_unit, [
    ("สินทรัพย์ (ล้านบาท)", "", "(หุ้น)", "ล้านบาท"), ("ROE", "", "(เท่า)", "เท่า"), ("ROE", "", "", "%"), ("กำไรต่อหุ้น", "", None, "บาท"), ("x", "ฐานะการเงิน", None, "ล้านบาท"), ("x", "พันบาท", "", "พันบาท"), ("x", "", "", ""),
])
cases("rule_direction", numeric.direction, [(1.5, "เพิ่มขึ้น"), (-1.0, "ลดลง"), (0.0, "ลดลง"), (None, None)], inputs="x0 double")
cases("rule_confidence", lambda a, b, c: F.round(numeric.confidence(a, b, c), 6), [(1, 8, 0, 0.75), (0, 0, 1, 0.6), (4, 4, 0, 0.0), (0, 4, 3, 0.1), (1, 0, 0, 0.0)], "DOUBLE", "x0 int, x1 int, x2 int")
cases("rule_asks_for_numbers", numeric.asks_for_numbers, [("2566", True), ("Total assets", True), ("รายการ", False), ("จำนวนหุ้น", True), ("2566 ", True), ("ปี 2566", False), ("", False), ("1999", False)], "BOOLEAN")
cases("rule_valid_cell", numeric.valid_cell, [("1,234", True), ("(1,234)", True), ("12.5%", True), ("100 %", True), ("-", True), ("...", True), ("abc", False), ("(%)", False), ("+100", True), ("1,234,567.89", True)], "BOOLEAN")
cases("rule_padded_box", lambda *x: F.concat_ws(",", *[numeric.padded_box(*x[:4], 5, *x[4:])[c].cast("string") for c in ("x0", "y0", "x1", "y1", "width", "height", "area")]), [
    (10, 10, 50, 40, 52, 42, "5,5,52,42,40,30,1200"), (2, 3, 4, 5, 100, 100, "0,0,9,10,2,2,4"),
], inputs="x0 int, x1 int, x2 int, x3 int, x4 int, x5 int")
cases("rule_row_band", lambda *x: F.concat_ws(",", numeric.row_band(*x)["top"].cast("string"), numeric.row_band(*x)["bottom"].cast("string")), [
    (0, 1, 3, 100, "20,80"), (0, 0, 0, 100, ""), (2, 2, 3, 100, "70,100"),
], inputs="x0 int, x1 int, x2 int, x3 int")

cases("rule_dedup_name", text.halved, [
    ("aa", "aa"), ("abab", "ab"), ("a_b_a_b_c", "a_b"), ("2567", "2567"), ("2020", "20"), ("การลงทุนการลงทุน", "การลงทุน"), ("x_x", "x_x"), ("ab_ab", "ab"), ("", ""), ("abc", "abc"), ("ab-ab", "ab-ab"),
])
cases("rule_sanitized", text.sanitized, [(None, ""), ("งบงบ", "งบ"), ("ok", "ok")])
cases("rule_repeated_title", text.repeated_title, [("งบ งบ", "งบ"), ("abab", "ab"), ("a - a", "a"), ("a_a", "a"), ("**x y**", "x y"), ("", ""), (None, ""), ("one-two", "one-two"), ("a b a b", "a b a b")])
cases("rule_safe_name", lambda c, d: text.safe_name(c, d, 20), [
    ("งบ การเงิน (2566)", "f", "งบ_การเงิน_(2566)"), ("", "doc table", "doc_table"), ("a/b:c", "f", "a_b_c"), ("**", "", "table"), ("a__b", "f", "ab"), (None, "x", "x"), ("///", "f", "table"),
    ("x" * 30, "f", Sql("'xxxxxxxxx_' || substr(sha1(repeat('x', 30)), 1, 10)")),
])
cases("rule_file_name", text.file_name, [("a/b:c*?", "abc"), ("  x   y. ", "x y"), ("", "site"), (None, "site"), ("z" * 70, "z" * 60), ("...", "site")])
cases("rule_folder_name", text.folder_name, [("a b  c_", "a_b_c"), (None, "site"), ('"x"|y', "xy"), ("w" * 50, "w" * 40)])
cases("rule_clean_cell", text.clean_cell, [
    ("๑๒๓,๔๕๖.๗๘", "123,456.78"), ("1,2O4", "1,204"), ("l,234", "1,234"), ("-", "-"), ("", ""), (None, ""), ("กะม", "กำ"), ("นํ", "นำ"), ("SO2", "502"), ("(1O)", "(10)"), ("a​b", "ab"), ("น้้า", "น้า"), ("่า", "า"), ("a  b", "a b"), ("OK x", "OK x"),
])
cases("rule_clean_header", lambda c: text.clean_cell(c, header=True), [("ลบ. 2566", "ล้านบาท 2566"), ("กำไร (ลบ)", "กำไร (ล้านบาท)"), ("พ.บ.", "พันบาท"), ("SO2", "SO2"), ("๒๕๖๖", "2566"), ("ล.บ.", "ล้านบาท")])
cases("rule_clean_text", text.clean_text, [("a\r\nb", "a\nb"), ("x  y", "x y"), ("\n\n\n a \n\n\n\n b", "a\n\nb"), (None, ""), ("a\x01b", "ab"), ("  ", ""), ("a \t b", "a b")])
cases("rule_strip_markdown", text.strip_markdown, [("**a** `b` #c_d", "a b cd"), (None, ""), (" x\n y ", "x y")])
cases("rule_sentences", lambda c: joined(text.sentences(c)), [
    ("Hello. World", "Hello.|World"), ("3.14", "3.|14"), ("ก。ข", "ก。|ข"), ("a  b", "a|b"), ("One. Two. Three  four", "One.|Two.|Three  four"), ("One.  x  y", "One.|x|y"), ("", ""), (None, ""), ("a\n\nb!c", "a|b!|c"),
])
cases("rule_token_count", lambda c: text.token_count(c).cast("long"), [("a b\tc", 3), ("", 0), ("  x ", 1)], "BIGINT")
cases("rule_table_group", text.table_group, [("doc_table_3_part", "doc_table_3"), ("doc_table_3", "doc_table_3"), ("", "untitled_table"), (None, "untitled_table"), ("a_table_1_b_table_2_c", "a_table_1")])
cases("rule_longer_text", text.longer_text, [("short", "head\n" + "=" * 60 + "\nlonger body", "longer body"), ("same", "same", "same"), (None, None, ""), ("x", "=" * 60, "x"), ("", " body ", "body")])
cases("rule_label_candidates", lambda k, v: joined(F.map_keys(text.label_candidates(F.map_from_arrays(listed(k), listed(v))))), [("2566|column_3|รายการ|x", "1|2|รายได้| ", "รายการ"), ("name|2019", "n|5", "name")])
cases("rule_layout_cleaned", text.layout_cleaned, [("<figure>x</figure>\n\n\n\n![i](u)y", "x\n\ny"), (None, ""), ("<FIGCAPTION a='b'>c</figcaption>", "c")])
cases("rule_text_blocks", lambda c: joined(text.text_blocks(c)), [("a\n\n b \n \na\n\na  c\n\na c", "a|b|a  c"), ("", ""), (None, ""), ("one\ntwo\n\n\nthree", "one\ntwo|three")])
cases("rule_lines_normalized", text.line_filtered, [("Abc\nab\nABC\nx  y  z", "Abc\nx y z"), (None, ""), ("aa\nbb", "")])
cases("rule_answer_method", lambda c: text.answer_method(listed(c)), [
    ("tavily_search|sql_query", "web_search"), ("graph_search|sql_query", "graph_sql_hybrid"), ("sql_query|vector_search", "hybrid"), ("", "agent"), ("graph_search|vector_search", "graph"), ("multi_hop|sql_query", "multi_hop"), ("vector_search", "vector"), ("sql_query", "sql"),
])
cases("rule_asked_rows", lambda c: retrieval.asked_rows(c).cast("long"), [("2 อันดับแรก", 2), ("บริษัทใด", None), ("10 บริษัท", 10), ("5รายการ", 5)], "BIGINT")
cases("rule_contexts", lambda a, b: joined(retrieval.contexts(listed(a), listed(b))), [(" a |b", "a|c|", "a|b|c"), ("", "", "No context used."), ("", "s", "s")])
cases("rule_first_json", text.first_json, [('x {"a": {"b": 1}} y', '{"a": {"b": 1}}'), ("none", None)])
cases("rule_first_array", text.first_array, [("x [1, [2]] y", "[1, [2]]"), ("none", None)])
cases("rule_final_answer", text.final_answer, [("Thought\nFinal Answer: a\nb ", "a\nb"), ("none", "")])
cases("rule_thai_date", lambda c: c.rlike(text.THAI_DATE), [("31 ธ.ค. 2566", True), ("1 ม.ค. 68", True), ("2024-01-01", False), ("5 มกราคม 2566", True), ("5มกราคม66", True)], "BOOLEAN")
cases("rule_csv_cell", text.csv_cell, [("a", "a"), ("a,b", '"a,b"'), ('q"q', '"q""q"'), (None, ""), ("l\nm", '"l\nm"')])
cases("rule_keyword_terms", lambda c: joined(text.keyword_terms(c)), [("What is NPL ของ SCB ปี 2566 npl", "is|NPL|SCB|2566"), ("", ""), ("the and", ""), ("กำไร กำไร 12345", "กำไร|1234")])
cases("rule_embeddable", retrieval.embeddable, [("x" * 8001, "raw_ocr_page", False), ("x" * 8000, "raw_ocr_page", True), ("x" * 9000, None, True), ("x" * 9000, "raw_ocr_table", False)], "BOOLEAN")
