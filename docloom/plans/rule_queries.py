"""Rules on cells, names and texts over columns of the tables: what goes in is made by expressions that both engines read, what comes out is said in SQL.

S is a part's size as text; k % n gives each of n forms of a cell to a part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from docloom.functions import numeric, text
from docloom.operators import retrieval
from docloom.plans.registry import QUERIES

S = "CAST(p_size AS STRING)"
joined = lambda c: F.array_join(c, "|")
listed = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, r"\|"))


def form(*options: str) -> str:
    """One of the options by k."""
    return f"CASE k % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def told(name: str, f: Callable, inputs: list[str], want: str, table: str = "part", key: str = "p_partkey") -> None:
    """A query n, got: f of the inputs, made of a table's columns and k, its key; want is what comes out."""

    def run(t):
        own = t(table).withColumn("k", F.col(key).cast("long"))
        for i, x in enumerate(inputs):
            own = own.withColumn(f"x{i}", F.expr(x))
        return own.select(F.col("k").alias("n"), f(*[F.col(f"x{i}") for i in range(len(inputs))]).alias("got"))

    QUERIES["rule_" + name] = (run, f"SELECT k AS n, {want} AS got FROM (SELECT *, CAST({key} AS BIGINT) AS k FROM {table})")


told("parse_numeric", numeric.parse_numeric, [form(f"'(' || {S} || ',000)'", f"{S} || '%'", "'–'", "p_name", f"' ' || {S} || ',100 '", f"'+' || {S}")], form("-1000.0 * p_size", "CAST(p_size AS DOUBLE)", "NULL", "NULL", "p_size * 1000.0 + 100", "CAST(p_size AS DOUBLE)"))
told("parse_strict", lambda c: numeric.parse_numeric(c, "strict"), [form(f"'( ' || {S} || ',234 )'", f"{S} || '%'", f"'+' || {S}", f"{S} || ',234.50'", "'—'", f"{S} || '.'")], form("-1000.0 * p_size - 234", "NULL", "NULL", "p_size * 1000.0 + 234.5", "NULL", "NULL"))
told("parse_loose", lambda c: numeric.parse_numeric(c, "loose"), [form(f"'(' || {S} || ',234)'", "'–'", f"{S} || '%'", f"'((' || {S} || '))'", f"{S} || ')'", "p_type")], form("-1000.0 * p_size - 234", "NULL", "CAST(p_size AS DOUBLE)", "-1.0 * p_size", "CAST(p_size AS DOUBLE)", "NULL"))
told("looks_numeric", lambda c: F.coalesce(numeric.looks_numeric(c), F.lit(False)), [form(f"{S} || '%'", f"'(' || {S} || ')'", f"'-' || {S} || ',234.5'", f"{S} || '.'", f"' ' || {S} || ' '", "p_name")], "k % 6 IN (2, 4)")
told("format_like", numeric.format_like, [form("'1.25'", "'98'"), form("p_retailprice", "p_size * 1000.0")], form("format('{:,.2f}', p_retailprice)", "format('{:,}', p_size * 1000)"))
told("format_delta", numeric.format_delta, [form("CAST(p_size AS DOUBLE)", "p_size + CAST(0.25 AS DOUBLE)")], form(S, f"{S} || '.25'"))
told("unit_token", numeric.unit_token, [form("'(บาท/หุ้น)'", "'%'", "p_type", "' หุ้น '", "'(' || p_type || ')'")], form("'บาท/หุ้น'", "'%'", "NULL", "'หุ้น'", "NULL"))
told("misplaced_unit", numeric.misplaced_unit, [form("'(%)'", "'(' || p_type || ')'", "'( บาท )'", "p_name", f"{S} || ' บาท'")], "k % 5 IN (0, 2)")
told("bracketed_unit", numeric.bracketed_unit, [form("'(' || p_type || ')'", "'(' || p_name || p_brand || p_type || ')'", "p_name", "'()'", "'%'")], form("true", "length(p_name || p_brand || p_type) <= 15", "false", "false", "true"))
told("value_unit", numeric.infer_value_unit, ["p_type || " + form("'ต่อหุ้น'", "' ROE'", "''", "''"), "p_name", form("p_brand", "p_brand", "'(ล้านบาท)'", "p_brand")], form("'บาท'", "'%'", "'ล้านบาท'", "''"))
told("with_unit", numeric.with_unit, [form(S, f"{S} || '%'", S, "' '", S), form("'%'", "'%'", "'บาท'", "'บาท'", "''")], form(f"{S} || '%'", f"{S} || '%'", f"{S} || ' บาท'", "''", S))
told("guess_unit", numeric.guess_unit, ["p_type || " + form("' (ล้านบาท)'", "' ROE'", "' ROE'", "'ต่อหุ้น'", "''"), form("p_name", "p_name", "p_name", "p_name", "'ฐานะการเงิน'"), form("'(หุ้น)'", f"'(' || p_brand || ')'", "''", "NULL", "NULL")], form("'ล้านบาท'", "p_brand", "'%'", "'บาท'", "'ล้านบาท'"))
told("direction", numeric.direction, ["p_size - 25.0"], "CASE WHEN p_size > 25 THEN 'เพิ่มขึ้น' WHEN p_size IS NOT NULL THEN 'ลดลง' END")
told("confidence", lambda a, b, c: F.round(numeric.confidence(a, b, c), 6), ["p_size % 5", "p_size", "k % 4"], "round(greatest(0, 1 - 2 * (p_size % 5) / greatest(p_size, 1) - least(0.9, 0.4 * CAST(k % 4 AS DOUBLE))), 6)")
told("asks_for_numbers", numeric.asks_for_numbers, [form("'25' || lpad(CAST(p_size % 100 AS STRING), 2, '0')", "'รายการ'", "'ปี 25' || lpad(CAST(p_size % 100 AS STRING), 2, '0')", "'จำนวนหุ้น'")], "k % 4 IN (0, 3)")
told("valid_cell", numeric.valid_cell, [form(f"{S} || ',234'", f"'(' || {S} || ')'", f"{S} || '.5%'", "p_name", "'(' || p_type || ')'", f"'+' || {S}", "'-'")], "k % 7 IN (0, 1, 2, 5, 6)")
told("padded_box", lambda *x: F.concat_ws(",", *[numeric.padded_box(*x[:4], 5, *x[4:])[c].cast("string") for c in ("x0", "y0", "x1", "y1", "width", "height", "area")]), ["p_size", "CAST(k % 40 AS INT)", "p_size + 10", "CAST(k % 40 AS INT) + 20", "50", "45"],
     "concat_ws(',', greatest(0, p_size - 5), greatest(0, k % 40 - 5), least(50, p_size + 15), least(45, k % 40 + 25), 10, 20, 200)")
told("row_band", lambda *x: F.concat_ws(",", numeric.row_band(*x)["top"].cast("string"), numeric.row_band(*x)["bottom"].cast("string")), ["CAST(k % 3 AS INT)", "CAST(k % 3 AS INT) + 1", "4", "p_size * 10"],
     "CASE WHEN least(p_size * 10, floor((k % 3 + 3) * (p_size * 2.0)) + floor(p_size * 2.0 * 0.2)) > greatest(0, floor((k % 3 + 1) * (p_size * 2.0)) - floor(p_size * 2.0 * 0.2)) THEN CAST(greatest(0, floor((k % 3 + 1) * (p_size * 2.0)) - floor(p_size * 2.0 * 0.2)) AS BIGINT) || ',' || CAST(least(p_size * 10, floor((k % 3 + 3) * (p_size * 2.0)) + floor(p_size * 2.0 * 0.2)) AS BIGINT) ELSE '' END")
told("dedup_name", text.halved, [form("p_name || p_name", "p_brand", "p_brand || '_' || p_type || '_' || p_brand || '_' || p_type")], form("p_name", "p_brand", "p_brand || '_' || p_type"))
told("sanitized", text.sanitized, [form("p_name || p_name", "p_brand", "CAST(NULL AS STRING)")], form("p_name", "p_brand", "''"))
told("repeated_title", text.repeated_title, [form("p_name || ' - ' || p_name", "'**' || p_name || '**'", "p_type || '_' || p_type")], form("p_name", "p_name", "p_type"))
told("safe_name", lambda c, d: text.safe_name(c, d, 24), [form(f"p_name || ' (' || {S} || ')'", "'**'", "p_name || '/' || p_type || ':' || p_brand || ' and more'"), "p_type"],
     form(f"replace(p_name, ' ', '_') || '_(' || {S} || ')'", "p_type", "regexp_replace(substr(replace(p_name || '/' || p_type || ':' || p_brand || ' and more', ' ', '_').replace('/', '_').replace(':', '_').replace('#', ''), 1, 13), '_+$', '') || '_' || substr(sha1(replace(p_name || '/' || p_type || ':' || p_brand || ' and more', ' ', '_').replace('/', '_').replace(':', '_').replace('#', '')), 1, 10)"))
told("file_name", text.file_name, [form("p_name || '/' || p_type || ':*?  x. '", "'  ' || p_name || '   ' || p_type || chr(9) || chr(10) || p_brand || '. '", f"repeat(p_name || ' ' || {S} || '. ', 20)", "CAST(NULL AS STRING)", "''", "'.' || repeat('. ', p_size)", "'\"<' || p_name || '>|\"'")],
     form("p_name || p_type || ' x'", "p_name || ' ' || p_type || ' ' || p_brand", f"regexp_replace(substr(repeat(p_name || ' ' || {S} || '. ', 20), 1, 60), '[ .]+$', '')", "'site'", "'site'", "'site'", "p_name"))
told("folder_name", text.folder_name, [form("' ' || p_name || ' ' || p_type || '|_'", "p_name || '   ' || p_type || chr(9) || p_brand || '__'", f"'_' || repeat(p_name || ' ' || {S} || '/', 20)", "CAST(NULL AS STRING)", "'_ _'", "'\"' || p_type || '\"|' || p_brand")],
     form("replace(p_name, ' ', '_') || '_' || p_type", "replace(p_name, ' ', '_') || '_' || p_type || '_' || p_brand", f"substr(repeat(replace(p_name, ' ', '_') || '_' || {S}, 20), 1, 40)", "'site'", "'site'", "p_type || p_brand"))
told("clean_cell", text.clean_cell, [form(f"translate({S}, '0123456789', '๐๑๒๓๔๕๖๗๘๙') || ',๔๕๖'", f"{S} || ',2O4'", "'OK  ' || p_name", "p_type || 'กะม'")], form(f"{S} || ',456'", f"{S} || ',204'", "'OK ' || p_name", "p_type || 'กำ'"))
told("clean_header", lambda c: text.clean_cell(c, header=True), [form(f"'ลบ. ' || {S}", "p_type || ' (ลบ)'", "'พ.บ.' || p_name", "'SO2'")], form(f"'ล้านบาท ' || {S}", "p_type || ' (ล้านบาท)'", "'พันบาท' || p_name", "'SO2'"))
told("clean_text", text.clean_text, ["chr(10) || p_name || chr(13) || chr(10) || chr(10) || chr(10) || chr(10) || '  ' || p_type || chr(9) || chr(1) || 'b '"], "p_name || chr(10) || chr(10) || p_type || ' b'")
told("strip_markdown", text.strip_markdown, ["' **' || p_name || '** ' || chr(10) || p_brand || ' _' || p_type || '_'"], "p_name || ' ' || replace(p_brand, '#', '') || ' ' || p_type")
told("sentences", lambda c: joined(text.sentences(c)), [form("p_name || '. ' || p_type || '! ' || p_brand", "p_name || '  ' || p_type", "p_name || chr(10) || chr(10) || p_type || '?' || p_brand")], form("p_name || '.|' || p_type || '!|' || p_brand", "p_name || '|' || p_type", "p_name || '|' || p_type || '?|' || p_brand"))
told("token_count", lambda c: text.token_count(c).cast("long"), ["coalesce(text, '')"], r"CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0B]+'), lambda w: w <> '')) AS BIGINT)", "documents", "doc_id")
told("table_group", text.table_group, [form(f"p_type || '_table_' || {S} || '_' || p_name", "p_name", "''")], form(f"p_type || '_table_' || {S}", "p_name", "'untitled_table'"))
told("longer_text", text.longer_text, ["p_name", form("'head' || chr(10) || repeat('=', 60) || chr(10) || p_name || p_type || ' '", "'x'", "'head' || repeat('=', 60)", "p_name")], form("p_name || p_type", "p_name", "p_name", "p_name"))
told("label_candidates", lambda k, v: joined(F.map_values(text.label_candidates(F.map_from_arrays(listed(k), listed(v))))), [f"'2566|column_3|name|blank|type'", f"{S} || '|2|' || p_name || '| |' || p_type"], "p_name || '|' || p_type")
told("layout_cleaned", text.layout_cleaned, ["'<figure>' || p_name || '</FIGURE>' || chr(10) || chr(10) || chr(10) || chr(10) || '![i](u)' || p_type"], "p_name || chr(10) || chr(10) || p_type")
told("text_blocks", lambda c: joined(text.text_blocks(c)), ["p_name || chr(10) || chr(10) || ' ' || p_type || ' ' || chr(10) || ' ' || chr(10) || p_name || chr(10) || chr(10) || p_brand || chr(10) || p_type"], "p_name || '|' || p_type || '|' || p_brand || chr(10) || p_type")
told("lines_normalized", text.line_filtered, ["p_name || chr(10) || 'ab' || chr(10) || upper(p_name) || chr(10) || p_type || '  z'"], "p_name || chr(10) || p_type || ' z'")
TOOLS = ["tavily_search", "multi_hop", "graph_search", "sql_query", "vector_search"]
told("answer_method", lambda c: text.answer_method(listed(c)), ["concat_ws('|', " + ", ".join(f"CASE WHEN p_size % {2 ** (i + 1)} >= {2**i} THEN '{x}' END" for i, x in enumerate(TOOLS)) + ")"],
     "CASE WHEN p_size & 1 > 0 THEN 'web_search' WHEN p_size & 2 > 0 THEN 'multi_hop' WHEN p_size & 4 > 0 AND p_size & 8 > 0 THEN 'graph_sql_hybrid' WHEN p_size & 4 > 0 THEN 'graph' WHEN p_size & 8 > 0 AND p_size & 16 > 0 THEN 'hybrid' WHEN p_size & 8 > 0 THEN 'sql' WHEN p_size & 16 > 0 THEN 'vector' ELSE 'agent' END")
told("asked_rows", lambda c: retrieval.asked_rows(c).cast("long"), [form(f"p_name || ' ' || {S} || ' อันดับแรก'", "p_name", f"{S} || 'รายการ'")], form("CAST(p_size AS BIGINT)", "NULL", "CAST(p_size AS BIGINT)"))
told("contexts", lambda a, b: joined(retrieval.contexts(listed(a), listed(b))), ["' ' || p_name || ' | |' || p_type", "p_name || '||' || p_brand"], "p_name || '|' || p_type || '|' || p_brand")
told("first_json", text.first_json, [form("p_type || ' {\"a\": {\"b\": \"' || p_name || '\"}} y'", "p_name")], form("'{\"a\": {\"b\": \"' || p_name || '\"}}'", "NULL"))
told("first_array", text.first_array, [form(f"p_type || ' [' || {S} || ', [2]] y'", "p_name")], form(f"'[' || {S} || ', [2]]'", "NULL"))
told("final_answer", text.final_answer, [form("'Thought' || chr(10) || 'Final Answer: ' || p_name || chr(10) || p_type || ' '", "p_name")], form("p_name || chr(10) || p_type", "''"))
told("thai_date", lambda c: c.rlike(text.THAI_DATE), [form(f"{S} || ' ธ.ค. 2566'", f"'2024-01-' || {S}", f"{S} || 'มกราคม66'", f"p_name || {S} || ' ธ.ค. 2566'")], "k % 4 IN (0, 2)")
told("csv_cell", text.csv_cell, [form("p_name", "p_name || ',' || p_type", "p_name || '\"' || p_type", "p_name || chr(10) || p_type")], form("p_name", "'\"' || p_name || ',' || p_type || '\"'", "'\"' || p_name || '\"\"' || p_type || '\"'", "'\"' || p_name || chr(10) || p_type || '\"'"))
told("keyword_terms", lambda c: joined(text.keyword_terms(c)), ["'What is ' || p_name || ' ของ SCB 2566 and ' || upper(p_name)"], "'is|' || replace(p_name, ' ', '|') || '|SCB|2566'")
told("embeddable", retrieval.embeddable, ["repeat('x', 7999 + CAST(k % 3 AS INT))", "CASE p_size % 3 WHEN 0 THEN 'raw_ocr_page' WHEN 1 THEN 'raw_ocr_table' END"], "NOT (p_size % 3 < 2 AND k % 3 = 2)")
