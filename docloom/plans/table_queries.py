"""Normalising, repairs and upserts of tables that are made from parts and orders, one table a part."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.operators import tables
from docloom.plans.registry import long, query
from docloom.plans.warehouse import flat

S, K = "CAST(p_size AS STRING)", "CAST(p_partkey AS STRING)"


def made(t, *forms: tuple[str, str]):
    """document_id, title, table_name, headers, rows: of each part a table by one of the forms, headers and rows as SQL arrays."""
    pick = lambda n: F.expr(f"CASE p_partkey % {len(forms)} " + " ".join(f"WHEN {i} THEN {f[n]}" for i, f in enumerate(forms)) + " END")
    return t("part").select(long("p_partkey").alias("document_id"), F.lit("t").alias("table_name"), F.lit("").alias("title"), pick(0).alias("headers"), pick(1).alias("rows"))


def shown(*forms: tuple[str, str]) -> str:
    """SQL of headers and rows as text, by form."""
    pick = lambda n: f"CASE p_partkey % {len(forms)} " + " ".join(f"WHEN {i} THEN {f[n]}" for i, f in enumerate(forms)) + " END"
    return f"SELECT CAST(p_partkey AS BIGINT) AS document_id, {pick(0)} AS headers, {pick(1)} AS rows FROM part"


@query(shown(("'Part|size'", f"p_name || '|' || {S} || '/' || p_type || '|'"), ("'รายการ|2566|2565|2564'", f"p_name || '|' || {S} || '|' || {K} || '|' || {S}"), ("p_name || '|column_2'", f"{S} || '|' || {K}")))
def normalize_tables(t):
    return flat(tables.normalized(made(
        t, ("array('**Part**', 'size', '', '')", f"array(array(p_name, {S}), array('', ' '), array('`' || p_type || '`', ''))"),
        ("array('รายการ', 'column_2', 'column_3', 'column_4')", f"array(array('x', '2566', '2565', '2564'), array(p_name, {S}, {K}, {S}))"), ("array(p_name)", f"array(array({S}, {K}))"),
    )))


@query(shown(("'Part|หน่วย|2567|2566'", f"p_name || '|(%)|' || {S} || '|' || {K} || '/' || p_type || '||' || {S} || '|' || {K}"), ("'Part|2567|2566'", f"p_name || '|' || {S} || '|' || {K}")))
def unit_column(t):
    heads = "array('Part', '2567', '2566')"
    return flat(tables.with_unit_column(made(t, (heads, f"array(array(p_name, '(%)', {S}, {K}), array(p_type, {S}, {K}))"), (heads, f"array(array(p_name, {S}, {K}))"))))


@query(shown(("'ชื่อ|a|b|column_4'", f"p_name || '|' || {S} || '|' || {K} || '|/|' || {S} || '|' || {K} || '|' || {S}"), ("'ชื่อ|a|b'", f"p_name || '|' || {S} || '|' || {K} || '/||' || {S} || '/||' || {K}")))
def footer_rows(t):
    heads, first = "array('ชื่อ', 'a', 'b')", f"array(p_name, {S}, {K}), array('', '', {S}), array('', '', {K})"
    return flat(tables.footer_collapsed(made(t, (heads, f"array({first}, array('', '', {S}))"), (heads, f"array({first})"))))


@query("""
SELECT CAST(o_orderkey AS BIGINT) AS id, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 'changed ' || o_orderstatus ELSE o_orderpriority END AS body FROM orders
UNION ALL SELECT -1 - CAST(o_orderkey AS BIGINT), 'added' FROM orders WHERE o_orderpriority LIKE '%URGENT%'""")
def upserted(t):
    stored = t("orders").select(long("o_orderkey").alias("id"), F.col("o_orderpriority").alias("body"))
    urgent = t("orders").filter(F.col("o_orderpriority").contains("URGENT"))
    fresh = urgent.select(long("o_orderkey").alias("id"), F.concat(F.lit("changed "), "o_orderstatus").alias("body")).unionByName(urgent.select((-1 - long("o_orderkey")).alias("id"), F.lit("added").alias("body")))
    return tables.upserted(stored, fresh, ["id"])
