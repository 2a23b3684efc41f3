"""Extracted tables: normalising, loading as facts or attributes, pivoting back, validating.

A table is a row with headers ARRAY<STRING> and rows ARRAY<ARRAY<STRING>>, and
any columns that name it. Everything runs as columns and joins; no table is
brought together from more than one row, so size is bounded by a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import numeric, text

LABEL_HEADER = "รายการ"


def filled_headers(headers: Column) -> Column:
    """No header blank, none twice: mark-up goes, blanks get a number, repeats a suffix _2, _3, ..."""
    named = F.transform(headers, lambda h, i: F.coalesce(F.nullif(text.strip_markdown(h), F.lit("")), F.when(i == 0, LABEL_HEADER).otherwise(F.concat(F.lit("column_"), (i + 1).cast("string")))))
    times = lambda x, h, i: F.size(F.filter(F.slice(x, 1, i + 1), lambda y: y == h))
    return text.bound(named, lambda x: F.transform(x, lambda h, i: F.when(times(x, h, i) > 1, F.concat(h, F.lit("_"), times(x, h, i).cast("string"))).otherwise(h)))


def fitted(row: Column, width: Column) -> Column:
    """A row padded with blanks or cut to a width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def blank(c: Column) -> Column:
    return numeric.strip(F.coalesce(c, F.lit(""))) == ""


def generated(header: Column) -> Column:
    return F.lower(numeric.strip(header)).rlike(r"^column_?[0-9]+$")


def trimmed(headers: Column, rows: Column) -> Column:
    """How many columns are left when generated headers over nothing but blanks go from the end; two stay at least."""
    used = F.transform(headers, lambda h, i: ~generated(h) | F.exists(rows, lambda r: ~blank(F.get(r, i))))
    last = F.array_max(F.transform(used, lambda u, i: F.when(u, i + 1).otherwise(0)))
    return F.greatest(F.least(F.size(headers), F.lit(2)), F.coalesce(last, F.lit(0)))


def promoted_years(headers: Column, rows: Column) -> Column:
    """The years that a first row holds for generated or unit headers, or null.

    There must be a year for each column but the first; one may be missing at the
    end if the others fall by one, and is then filled in.
    """
    first = F.transform(F.get(rows, F.lit(0)), numeric.strip)
    years = F.array_distinct(F.filter(first, numeric.is_year))
    wanted = F.size(headers) - 1
    generic = F.size(F.filter(F.slice(headers, F.lit(2), F.greatest(wanted, F.lit(0))), lambda h: generated(h) | numeric.bracketed_unit(h)))
    stands = (F.size(headers) >= 4) & (generic >= F.greatest(F.lit(2), wanted - 1)) & (F.size(F.filter(first, numeric.is_year)) >= 2)

    def resolved(y):
        falls = F.forall(F.sequence(F.lit(1), F.size(y) - 1), lambda i: F.get(y, i - 1).cast("int") - F.get(y, i).cast("int") == 1)
        more = F.concat(y, F.array((F.get(y, F.size(y) - 1).cast("int") - 1).cast("string")))
        return F.when(F.size(y) == wanted, y).when((F.size(y) == wanted - 1) & (F.size(y) >= 2) & falls, more)

    return F.when(stands, text.bound(years, resolved))


def identified(tables: DataFrame, default: Column) -> DataFrame:
    """tables with title, table_name and csv_text: titles without mark-up and not twice over, names that are safe, from the title where there is none, else default; the text of tables without rows is empty."""
    title = text.repeated_title(F.coalesce(F.nullif(text.strip_markdown(F.col("title")), F.lit("")), default))
    name = F.coalesce(F.nullif(F.col("table_name"), F.lit("")), F.col("title")) if "table_name" in tables.columns else F.col("title")
    named = tables.withColumn("title", title).withColumn("table_name", text.safe_name(text.repeated_title(name), default))
    return named.withColumn("csv_text", F.when(F.size("rows") > 0, numeric.strip(text.table_csv(F.col("headers"), F.col("rows")))).otherwise(F.lit("")))


def normalized(tables: DataFrame, default: Column | None = None) -> DataFrame:
    """Tables without mark-up, with full headers, rows of one width and no blank rows; empty generated columns go from the end, a first row of years becomes headers.

    With default, the name of a table that has none, titles and names are normalised and csv_text is added.
    """
    if default is not None:
        return identified(normalized(tables), default)
    plain = tables.withColumn("rows", F.transform("rows", lambda r: F.transform(r, text.strip_markdown)))
    width = F.greatest(F.size("headers"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)), F.lit(1))
    out = plain.withColumn("__w", width).withColumn("headers", filled_headers(fitted(F.col("headers"), F.col("__w"))))
    out = out.withColumn("rows", F.filter(F.transform("rows", lambda r: fitted(r, F.col("__w"))), lambda r: F.exists(r, lambda x: ~blank(x))))
    out = out.withColumn("__w", trimmed(F.col("headers"), F.col("rows")))
    out = out.withColumn("headers", F.slice("headers", F.lit(1), F.col("__w"))).withColumn("rows", F.transform("rows", lambda r: F.slice(r, F.lit(1), F.col("__w"))))
    out = out.withColumn("__years", promoted_years(F.col("headers"), F.col("rows")))
    up = F.col("__years").isNotNull()
    return (
        out.withColumn("__h", F.when(up, F.concat(F.slice("headers", 1, 1), "__years")).otherwise(F.col("headers")))
        .withColumn("rows", F.when(up, F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: F.slice(r, F.lit(1), F.size("__h")))).otherwise(F.col("rows")))
        .withColumn("headers", F.col("__h")).drop("__h", "__w", "__years")
    )


def cleaned(tables: DataFrame) -> DataFrame:
    """Tables whose headers and cells are mended as readers of scanned pages spoil them."""
    return tables.withColumn("headers", F.transform("headers", lambda h: text.clean_cell(h, header=True))).withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda x: text.clean_cell(x))))


def with_unit_column(tables: DataFrame) -> DataFrame:
    """Tables in which a unit stands in the first year's column of some row get a column for units before it; other rows have it blank."""
    years = F.transform("headers", lambda h, i: F.when(numeric.is_year(numeric.strip(h)), i))
    out = tables.withColumn("__at", F.array_min(F.filter(years, lambda i: i.isNotNull())))
    shifted = lambda r: F.coalesce(numeric.misplaced_unit(F.get(r, F.col("__at"))), F.lit(False))
    out = out.withColumn("__fix", (F.size("headers") >= 3) & F.col("__at").isNotNull() & F.exists("rows", shifted))
    put = lambda a, x: F.concat(F.slice(a, F.lit(1), F.col("__at")), F.array(F.lit(x)), F.slice(a, F.col("__at") + 1, F.greatest(F.size(a) - F.col("__at"), F.lit(0))))
    width = F.size("headers") + 1
    moved = F.transform("rows", lambda r: fitted(F.when(shifted(r) | (F.size(r) <= F.col("__at")), r).otherwise(put(r, "")), width))
    return out.withColumn("rows", F.when(F.col("__fix"), moved).otherwise(F.col("rows"))).withColumn("headers", F.when(F.col("__fix"), put(F.col("headers"), numeric.UNIT_HEADER)).otherwise(F.col("headers"))).drop("__at", "__fix")


# Words of headers that describe a row.
DESCRIPTORS = ["ลำดับ", "รายชื่อ", "ชื่อ", "บริษัท", "หน่วย", "หมายเหตุ"]


def leading_descriptors(headers: Column) -> Column:
    """How many headers from the start describe a row; the first always does."""
    lower = F.transform(headers, lambda h: F.lower(numeric.strip(F.coalesce(h, F.lit("")))))
    named = lambda h: reduce(lambda a, b: a | b, [h.contains(w) for w in DESCRIPTORS])
    describes = lambda h, i: (i == 0) | ((h != "") & ~numeric.is_year(h) & ~generated(h) & named(h))
    ends = F.filter(F.transform(lower, lambda h, i: F.when(~describes(h, i), i)), lambda i: i.isNotNull())
    return F.coalesce(F.array_min(ends), F.size(headers))


def footer_collapsed(tables: DataFrame) -> DataFrame:
    """A run of three rows or more at the end, each with a number in the last column and nothing else, becomes one row.

    Its numbers go from the first column that doesn't describe a row on; headers are generated for what has no column.
    """
    last = F.size("headers") - 1
    lone = lambda r: (F.size(F.filter(r, lambda x: ~blank(x))) == 1) & F.coalesce(numeric.looks_numeric(F.get(r, last)), F.lit(False))
    kept = F.coalesce(F.array_max(F.transform("rows", lambda r, i: F.when(~lone(r), i + 1).otherwise(0))), F.lit(0))
    out = tables.withColumn("__kept", kept).withColumn("__run", F.size("rows") - F.col("__kept")).withColumn("__lead", leading_descriptors(F.col("headers")))
    values = F.transform(F.slice("rows", F.col("__kept") + 1, F.greatest(F.col("__run"), F.lit(0))), lambda r: numeric.strip(F.get(r, last)))
    out = out.withColumn("__values", values).withColumn("__fix", (F.size("rows") >= 3) & (F.col("__run") >= 3) & (F.size("headers") > 0))
    out = out.withColumn("__w", F.greatest(F.size("headers"), F.col("__lead") + F.size("__values")))
    names = F.concat("headers", F.transform(F.array_repeat(F.lit(""), F.col("__w") - F.size("headers")), lambda _, i: F.concat(F.lit("column_"), (F.size("headers") + i + 1).cast("string"))))
    line = fitted(F.concat(F.array_repeat(F.lit(""), F.col("__lead")), "__values"), F.col("__w"))
    body = F.concat(F.transform(F.slice("rows", F.lit(1), F.col("__kept")), lambda r: fitted(r, F.col("__w"))), F.array(line))
    return out.withColumn("rows", F.when(F.col("__fix"), body).otherwise(F.col("rows"))).withColumn("headers", F.when(F.col("__fix"), names).otherwise(F.col("headers"))).drop("__kept", "__run", "__lead", "__values", "__fix", "__w")


def first_extra(headers: Column, row: Column) -> Column:
    """The first cell of a row with text that is neither its label nor under a year, or null."""
    cells = F.arrays_zip(headers.alias("h"), row.alias("v"))
    return F.get(F.filter(cells, lambda z, i: (i > 0) & ~numeric.is_year(numeric.strip(z["h"])) & ~blank(z["v"])), F.lit(0))["v"]


def grouped_tables(rows: DataFrame, document: str = "document_id", name: str = "table_name", headers: str = "headers", cells: str = "cells", order: str = "row_index") -> DataFrame:
    """document, table_name, headers, rows: stored rows, maps of cells, put together as tables.

    Headers are those of the first row; a cell that a row lacks is blank; rows without a table's name make one called unknown.
    """
    named = rows.withColumn(name, F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit("unknown")))
    parts = named.groupBy(document, name).agg(F.min_by(headers, order).alias("headers"), F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.map_entries(cells).alias("c")))).alias("__rows"))
    return parts.select(document, name, "headers", F.transform("__rows", lambda r: F.transform("headers", lambda h: F.coalesce(F.get(F.filter(r["c"], lambda e: e["key"] == h), F.lit(0))["value"], F.lit("")))).alias("rows"))


def loaded(tables: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """facts and attributes of tables: those with a year among their headers go to facts, the others to attributes."""
    return facts(tables, keys), attributes(tables, keys)


def is_fact_table(headers: Column) -> Column:
    return F.exists(headers, numeric.is_year)


def facts(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_index, row_label, metric_year, raw_value, numeric_value, unit: a row for each year of each labelled row.

    The unit is the row's unit cell, else what label and table name hint at. One
    that slipped into a year's column comes before both; the values after it then
    move left, and the last year keeps its own cell if none moved to it.
    """
    years = F.filter(F.transform("headers", lambda h, i: F.named_struct(F.lit("year"), numeric.strip(h), F.lit("at"), i)), lambda x: numeric.is_year(x["year"]))
    rows = tables.filter(is_fact_table(F.col("headers"))).select(*keys, "headers", years.alias("__years"), F.posexplode("rows").alias("row_index", "__row"))
    rows = rows.withColumn("row_label", numeric.strip(F.coalesce(F.get("__row", F.lit(0)), F.lit("")))).filter("row_label <> ''")
    rows = rows.withColumn("__cells", F.transform("__years", lambda y: numeric.strip(F.coalesce(F.get("__row", y["at"]), F.lit("")))))
    rows = rows.withColumn("__slipped", F.get(F.filter(F.transform("__cells", numeric.unit_token), lambda x: x.isNotNull()), F.lit(0)))
    rows = rows.withColumn("__values", F.filter("__cells", lambda x: (x != "") & numeric.unit_token(x).isNull()))
    own = lambda x: F.when(numeric.unit_token(x).isNull(), x).otherwise("")
    moved = F.transform("__years", lambda y, i: F.coalesce(F.get("__values", i), F.when(i == F.size("__years") - 1, own(F.get("__cells", i))).otherwise("")))
    rows = rows.withColumn("__shown", F.when(F.col("__slipped").isNotNull(), moved).otherwise(F.transform("__cells", own)))
    unit_cell = F.get("__row", F.array_position("headers", numeric.UNIT_HEADER).cast("int") - 1)
    unit_cell = F.when(F.array_contains("headers", numeric.UNIT_HEADER), unit_cell)
    explicit = F.nullif(F.regexp_replace(numeric.strip(F.coalesce(unit_cell, F.lit(""))), r"^[()]+|[()]+$", ""), F.lit(""))
    name = F.col("table_name") if "table_name" in keys else F.lit("")
    unit = F.coalesce(F.col("__slipped"), explicit, numeric.guess_unit(F.col("row_label"), name, unit_cell))
    long = rows.select(*keys, "row_index", "row_label", unit.alias("unit"), F.explode(F.zip_with("__years", "__shown", lambda y, v: F.named_struct(F.lit("y"), y["year"], F.lit("v"), v))).alias("__c"))
    long = long.select(*keys, "row_index", text.sanitized(F.col("row_label")).alias("row_label"), text.sanitized(F.col("__c.y")).alias("metric_year"), F.col("__c.v").alias("__v"), text.sanitized(F.col("unit")).alias("unit"))
    # as stored, a value too is its half if it is that twice over; the number is of the cell itself
    return long.filter("__v <> ''").select(*keys, "row_index", "row_label", "metric_year", text.sanitized(F.col("__v")).alias("raw_value"), "unit", numeric.parse_numeric(F.col("__v")).alias("numeric_value"))


def attributes(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row_index, row_label, col_name, col_value, col_value_num: entity, attribute, value, blanks left out; a blank label is row_i."""
    rows = tables.filter(~is_fact_table(F.col("headers"))).select(*keys, "headers", F.posexplode("rows").alias("row_index", "__row"))
    label = F.when(blank(F.get("__row", F.lit(0))), F.concat(F.lit("row_"), F.col("row_index").cast("string"))).otherwise(numeric.strip(F.get("__row", F.lit(0))))
    cells = rows.select(*keys, "row_index", label.alias("row_label"), F.posexplode(F.arrays_zip(F.col("headers").alias("h"), F.col("__row").alias("v"))).alias("__i", "__c"))
    out = cells.filter("__i > 0").select(*keys, "row_index", "row_label", F.col("__c.h").alias("col_name"), numeric.strip(F.col("__c.v")).alias("col_value"))
    return out.filter(~blank(F.col("col_value"))).withColumn("col_value_num", numeric.parse_numeric(F.col("col_value")))


def pivot_columns(eav: DataFrame, name: str = "col_name", most: int = 10_000) -> list[str]:
    """The attribute names, sorted. They become columns, so there may be `most` at the most; more is an error, not a cut."""
    rows = eav.select(name).filter(F.coalesce(F.col(name), F.lit("")) != "").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} attributes can't be columns")
    return sorted(r[0] for r in rows)


def wide(eav: DataFrame, keys: list[str], order: str, name: str = "col_name", value: str = "col_value", columns: list[str] | None = None) -> DataFrame:
    """Attributes as columns; of several values of one cell the first by order. One named like a key gets a suffix _1."""
    columns = pivot_columns(eav, name) if columns is None else columns
    taken, cells = set(keys), []
    for c in columns:
        shown, n = c, 0
        while shown in taken:  # an attribute may be called like a key
            n += 1
            shown = f"{c}_{n}"
        taken.add(shown)
        cells.append(F.min_by(F.when(F.col(name) == c, F.col(value)), F.when(F.col(name) == c, F.col(order))).alias(shown))
    return eav.groupBy(*keys).agg(*cells) if columns else eav.select(*keys).distinct()


def melted(df: DataFrame, keys: list[str], values: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(keys, values, name, value)


def replaced(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the groups of rows that fresh names by keys replaced by fresh's: reload is idempotent."""
    named = fresh.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(lambda a, b: a & b, [stored[k].eqNullSafe(F.col(f"__{k}")) for k in keys])
    return stored.join(named, same, "left_anti").unionByName(fresh, allowMissingColumns=True)


def batches(rows: DataFrame, keys: list[str], order: str, cell: Column, size: int = 25) -> DataFrame:
    """keys, batch, row_start, row_end, body: rows in order, so many together. order counts from 0 within keys."""
    own = rows.withColumn("batch", F.floor(F.col(order) / size)).withColumn("__line", F.struct(F.col(order).alias("o"), cell.alias("t")))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("__line")), lambda x: x["t"]), "\n")
    return own.groupBy(*keys, "batch").agg(F.min(order).alias("row_start"), F.max(order).alias("row_end"), body.alias("body"))


def issues(tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_issues, n_bad_cells, empty_rows (from 0), column_count_ok, confidence, valid, retry.

    A row of another width than the headers is an issue, a blank row one of another
    kind, and so is a cell that isn't a number under a header that asks for one.
    """
    width = F.size("headers")
    empty = lambda r: ~F.exists(r, lambda x: ~blank(x))
    none = lambda x: blank(x) | numeric.strip(F.coalesce(x, F.lit(""))).rlike(numeric.PLACEHOLDER)
    asked = tables.withColumn("__asks", F.transform("headers", lambda h: numeric.asks_for_numbers(F.coalesce(h, F.lit("")))))
    bad = F.aggregate("rows", F.lit(0), lambda n, r: n + F.size(F.filter(F.arrays_zip(F.col("__asks").alias("a"), r.alias("v")), lambda z: ~empty(r) & F.coalesce(z["a"], F.lit(False)) & ~none(z["v"]) & ~numeric.valid_cell(z["v"]))))
    wide_ = F.size(F.filter("rows", lambda r: F.size(r) != width))
    blanks = F.filter(F.transform("rows", lambda r, i: F.when(empty(r), i)), lambda i: i.isNotNull())
    out = asked.select(*keys, (width * F.size("rows")).alias("__cells"), bad.alias("n_bad_cells"), wide_.alias("__wide"), blanks.alias("empty_rows"))
    out = out.withColumn("column_count_ok", F.col("__wide") == 0).withColumn("__n", F.col("n_bad_cells") + F.col("__wide")).withColumn("n_issues", F.col("__n") + F.size("empty_rows"))
    out = out.withColumn("confidence", numeric.confidence(F.col("__n"), F.col("__cells"), F.size("empty_rows")))
    out = out.withColumn("valid", F.col("n_issues") == 0).withColumn("retry", (F.col("confidence") < 0.7) | ~F.col("column_count_ok"))
    return out.drop("__cells", "__wide", "__n")


def corrected(stored: DataFrame, retried: DataFrame, keys: list[str]) -> DataFrame:
    """keys, headers, rows, confidence, retried: a retried table takes the stored one's place only where its confidence is higher."""
    judged = lambda df: df.join(issues(df, keys).select(*keys, "confidence"), keys).select(*keys, "headers", "rows", "confidence")
    new = judged(retried).select(*keys, *[F.col(c).alias(f"__{c}") for c in ("headers", "rows", "confidence")])
    both = judged(stored).join(new, keys, "left").withColumn("retried", F.coalesce(F.col("__confidence") > F.col("confidence"), F.lit(False)))
    return both.select(*keys, *[F.when(F.col("retried"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("headers", "rows", "confidence")], "retried")


def islands(rows: DataFrame, keys: list[str], at: str, gap: int = 2) -> DataFrame:
    """keys, first, last, n: places that lie no more than gap apart, merged."""
    by = W.partitionBy(*keys).orderBy(at)
    fresh = F.when(F.col(at) <= F.lag(at).over(by) + gap, 0).otherwise(1)
    numbered = rows.withColumn("__new", fresh).withColumn("__island", F.sum("__new").over(by))
    return numbered.groupBy(*keys, "__island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("__island")


def sections(rows: DataFrame, keys: list[str], order: list[str], title: Column) -> DataFrame:
    """rows with section: a title row begins the next one."""
    return rows.withColumn("section", F.sum(F.when(title, 1).otherwise(0)).over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))


def without(family: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table of a family, given with its key column, without the rows of the keys in gone: a parent goes with its children."""
    return {name: df.join(gone.select(F.col(key).alias("__gone")).distinct(), F.col(column) == F.col("__gone"), "left_anti") for name, (df, column) in family.items()}


def upserted(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """stored with fresh's rows in place of those with the same keys, and added where there are none. Of fresh's rows with equal keys all stay."""
    return replaced(stored, fresh, keys)


def emptied(spark: SparkSession, stored: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Empty tables of the same schemas, and name, n of what each had."""
    counts = reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in stored.items()])
    return {name: spark.createDataFrame([], df.schema) for name, df in stored.items()}, counts


#: The warehouse's tables.
SCHEMAS = {
    "dim_documents": "document_id int, filename string, doc_type string, source_url string, created_at timestamp",
    "dim_tables": "table_id int, document_id int, table_name string, title string, headers array<string>, row_count int",
    "fact_financial_metrics": "document_id int, table_name string, row_label string, metric_year string, raw_value string, numeric_value double, unit string, row_index int",
    "dim_chunks": "chunk_id int, document_id int, chunk_index int, chunk_text string, summary string, source_kind string",
    "dim_table_rows": "document_id int, table_name string, row_label string, col_name string, col_value string, col_value_num double, row_index int",
}


def warehouse(spark: SparkSession, folder: str | None = None) -> dict[str, DataFrame]:
    """The warehouse's tables as temporary views too: from Parquet folders where they are, else empty."""
    out = {}
    for name, schema in SCHEMAS.items():
        try:
            out[name] = spark.read.schema(schema).parquet(f"{folder}/{name}") if folder else spark.createDataFrame([], schema)
        except AnalysisException:
            out[name] = spark.createDataFrame([], schema)
        out[name].createOrReplaceTempView(name)
    return out


def synced(rows: DataFrame, stored: dict[str, DataFrame], documents: DataFrame) -> dict[str, DataFrame]:
    """dim_documents, dim_tables, fact_financial_metrics and dim_table_rows after the stored rows (as in grouped_tables) are loaded again: tables that rows name are replaced whole, others stay."""
    keys = ["document_id", "table_name"]
    found = grouped_tables(rows).withColumn("table_name", text.sanitized(F.col("table_name")))
    fact, eav = loaded(found, keys)
    named = found.select(*keys).distinct()
    fresh_tables = found.select(*keys, F.col("table_name").alias("title"), "headers", F.size("rows").alias("row_count"))
    left = lambda df: df.join(named, keys, "left_anti").select(df.columns)
    return {
        "dim_documents": upserted(stored["dim_documents"], documents, ["document_id"]),
        "dim_tables": left(stored["dim_tables"]).unionByName(fresh_tables, allowMissingColumns=True),
        "fact_financial_metrics": left(stored["fact_financial_metrics"]).unionByName(fact),
        "dim_table_rows": left(stored["dim_table_rows"]).unionByName(eav),
    }
