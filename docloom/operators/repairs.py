"""Repairs of extracted tables: sections, header fragments, and totals that show where cells were misread.

A table is a row with headers and rows, as in tables.py. Labels stand in the first
column; years are headers. Tables to which a rule doesn't apply stay as they are.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import numeric, text
from docloom.operators import tables
from docloom.streaming.counts import shared_folder

# Labels of a balance sheet's rows.
BOTH_SIDES, OTHER, LIABILITIES, EQUITY, GRAND = "หนี้สินและส่วนของเจ้าของ", "หนี้สินอื่น", "รวมหนี้สิน", "รวมส่วนของเจ้าของ", "รวมหนี้สินและส่วนของเจ้าของ"
DEBT, PROVISIONS, DEFERRED_TAX = "ตราสารหนี้ที่ออกและเงินกู้ยืม", "ประมาณการหนี้สิน", "หนี้สินภาษีเงินได้รอตัดบัญชี"


def cell(row: Column, i: Column) -> Column:
    return F.coalesce(F.get(row, i), F.lit(""))


def number(row: Column, i: Column) -> Column:
    return numeric.parse_numeric(cell(row, i), "strict")


def labels(rows: Column) -> Column:
    return F.transform(rows, lambda r: numeric.strip(cell(r, F.lit(0))))


def place(names: str, label: str) -> Column:
    """Where a label first stands, from 0, or null."""
    return F.nullif(F.array_position(names, label), F.lit(0)) - 1


def year_places(headers: str) -> Column:
    return F.filter(F.transform(headers, lambda h, i: F.when((i > 0) & numeric.is_year(numeric.strip(h)), i)), lambda i: i.isNotNull())


def with_places(df: DataFrame, **found: Column) -> DataFrame:
    return df.withColumn("__labels", labels(F.col("rows"))).withColumn("__years", year_places("headers")).withColumns({f"__{k}": c for k, c in found.items()})


def apart(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tables dealt out by key: what follows is planned by itself, for one plan of all repairs would name each column many times over."""
    return df.repartition(*keys)


def fixed(df: DataFrame, when: Column, rows: Column, columns: list[str]) -> DataFrame:
    return df.withColumn("rows", F.when(F.coalesce(when, F.lit(False)), rows).otherwise(F.col("rows"))).select(*columns)


def balance_totals(df: DataFrame) -> DataFrame:
    """Total liabilities become the grand total less equity in the years in which both are shown and the rest is above nought."""
    own = with_places(df).withColumns({f"__{k}": place("__labels", v) for k, v in {"both": BOTH_SIDES, "other": OTHER, "sum": LIABILITIES, "equity": EQUITY, "grand": GRAND}.items()})
    ordered = reduce(lambda a, b: a & b, [F.col(f"__{a}") < F.col(f"__{b}") for a, b in (("both", "other"), ("other", "sum"), ("sum", "equity"), ("equity", "grand"))])
    of = lambda k: F.get("rows", F.col(f"__{k}"))
    rest = lambda i: number(of("grand"), i) - number(of("equity"), i)
    line = F.transform(of("sum"), lambda v, i: F.when(F.array_contains("__years", i) & (rest(i) > 0), numeric.format_like(cell(of("grand"), i), rest(i))).otherwise(v))
    rows = F.transform("rows", lambda r, i: F.when(i == F.col("__sum"), line).otherwise(r))
    return fixed(own, (F.size("rows") >= 6) & (F.size("__years") >= 2) & ordered, rows, df.columns)


def sum_and_count(rows: Column, i: Column) -> Column:
    """The sum of a column's numbers, and how many there are."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    return F.aggregate(F.transform(rows, lambda r: number(r, i)), start, lambda a, v: F.struct((a["sum"] + F.coalesce(v, F.lit(0.0))).alias("sum"), (a["n"] + F.when(v.isNotNull(), 1).otherwise(0)).alias("n")))


def derived_from_total(df: DataFrame, label: str = OTHER, total: str = LIABILITIES, ratio: float = 5.0, least: float = 1e7) -> DataFrame:
    """The labelled row's cells become what the total leaves, where that is many times what they show and far off, and in most years."""
    own = with_places(df).withColumn("__total", place("__labels", total))
    own = own.withColumn("__at", F.nullif(F.array_position(F.slice("__labels", F.lit(1), F.greatest(F.coalesce(F.col("__total"), F.lit(0)).cast("int"), F.lit(0))), label), F.lit(0)) - 1)
    others = F.filter(F.slice("rows", F.lit(1), F.greatest(F.coalesce(F.col("__total"), F.lit(0)).cast("int"), F.lit(0))), lambda r, i: i != F.col("__at"))
    target, whole = F.get("rows", F.col("__at")), F.get("rows", F.col("__total"))

    def judged(i):
        def of(s):
            now, rest = number(target, i), number(whole, i) - s["sum"]
            good = (s["n"] >= 2) & (rest > 0) & (F.abs(rest) / F.greatest(F.abs(now), F.lit(1.0)) >= ratio) & (F.abs(rest - now) >= least)
            return F.struct(i.alias("i"), F.when(good, numeric.format_like(cell(target, i), rest)).alias("v"))

        return text.bound(sum_and_count(others, i), of)

    own = own.withColumn("__new", F.filter(F.transform("__years", judged), lambda x: x["v"].isNotNull()))
    line = F.transform(target, lambda v, i: F.coalesce(F.get(F.filter("__new", lambda x: x["i"] == i), F.lit(0))["v"], v))
    rows = F.transform("rows", lambda r, i: F.when(i == F.col("__at"), line).otherwise(r))
    enough = F.size("__new") >= F.greatest(F.lit(2), F.size("__years") - 1)
    return fixed(own, (F.size("rows") >= 3) & (F.size("__years") > 0) & (F.col("__total") >= 1) & F.col("__at").isNotNull() & enough, rows, df.columns)


def shifted_liabilities(df: DataFrame) -> DataFrame:
    """Where two labels were read as one and those below moved up, each gets its own row again, and the last of them what the total leaves."""
    own = with_places(df).withColumn("__total", place("__labels", LIABILITIES).cast("int"))
    merged = F.array_min(F.filter(F.transform("__labels", lambda x, i: F.when(x.contains(DEBT) & x.contains(PROVISIONS), i)), lambda i: i.isNotNull()))
    own = own.withColumn("__at", merged)
    at, total = F.col("__at"), F.col("__total")
    stands = (F.size("rows") >= 4) & (F.size("__years") > 0) & (total > at + 2) & (F.get("__labels", at + 1) == DEFERRED_TAX) & (F.get("__labels", at + 2) == OTHER)
    names = F.array(F.lit(DEBT), F.lit(PROVISIONS), F.lit(DEFERRED_TAX))
    before = F.transform(F.slice("rows", F.lit(1), total), lambda r, i: F.when(i.between(at, at + 2), F.concat(F.array(F.get(names, i - at)), F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))))).otherwise(r))
    own = own.withColumn("__stands", F.coalesce(stands, F.lit(False))).withColumn("__before", F.when(F.col("__stands"), before))
    whole = F.get("rows", total)

    def judged(i):
        known = lambda s: number(whole, i).isNotNull() & (s["n"] >= 3)
        return text.bound(sum_and_count(F.col("__before"), i), lambda s: F.struct(i.alias("i"), F.when(known(s), number(whole, i) - s["sum"]).alias("v")))

    own = own.withColumn("__new", F.filter(F.transform("__years", judged), lambda x: x["v"].isNotNull()))
    taxes = F.get("__before", at + 2)
    value = lambda i: F.get(F.filter("__new", lambda x: x["i"] == i), F.lit(0))["v"]
    line = F.transform("headers", lambda h, i: F.when(i == 0, OTHER).otherwise(F.coalesce(numeric.format_like(cell(taxes, i), value(i)), F.lit(""))))
    rows = F.concat("__before", F.array(line), F.slice("rows", total + 1, F.size("rows") - total))
    enough = (F.size("__new") >= F.greatest(F.lit(2), F.size("__years") - 1)) & ~F.exists("__new", lambda x: x["v"] <= 0)
    return fixed(own, F.col("__stands") & enough, rows, df.columns)


def sections(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section (from 0), title, headers, rows: tables cut at rows that have a label and nothing else, which is the next part's title.

    Titles and what they head with no row between are left out. Each part's footer
    and totals are repaired. With years, a part keeps its label and years; if a unit
    stands in the first year of one of its rows, units get a column and those rows
    move left, the last year taking the first cell beyond the years, else its own.
    Where tables have a table_name, parts have one too, with their title, and csv_text.
    """
    named = "table_name" in df.columns
    names_of = ["table_name"] if named else []
    own = apart(balance_totals(df), keys).filter(F.size("headers") > 0)
    lines = own.select(*keys, F.col("title").alias("__first"), *names_of, "headers", F.posexplode("rows").alias("__pos", "__row"))
    heads = (numeric.strip(cell(F.col("__row"), F.lit(0))) != "") & ~F.exists(F.slice("__row", F.lit(2), F.greatest(F.size("__row") - 1, F.lit(0))), lambda x: ~tables.blank(x))
    by = W.partitionBy(*keys).orderBy("__pos").rowsBetween(W.unboundedPreceding, 0)
    cut = lines.withColumn("__head", heads).withColumn("__part", F.sum(F.col("__head").cast("int")).over(by))
    line = F.when(~F.col("__head"), F.struct("__pos", "__row"))
    parts = cut.groupBy(*keys, "__part").agg(
        F.first("headers").alias("headers"), F.first("__first").alias("__first"), *[F.first(n).alias(n) for n in names_of], F.max(F.when(F.col("__head"), numeric.strip(cell(F.col("__row"), F.lit(0))))).alias("__title"),
        F.transform(F.sort_array(F.collect_list(line)), lambda x: x["__row"]).alias("rows"),
    ).filter(F.size("rows") > 0)
    parts = parts.withColumn("title", F.coalesce("__title", "__first")).withColumn("section", F.row_number().over(W.partitionBy(*keys).orderBy("__part")) - 1)
    parts = parts.select(*keys, "section", "title", *names_of, "headers", "rows")
    for repair in (tables.footer_collapsed, shifted_liabilities, derived_from_total):
        parts = apart(repair(parts), keys)
    parts = parts.withColumn("__years", year_places("headers"))
    years = F.size("__years") > 0
    first = F.get("__years", F.lit(0))
    unit = lambda r: F.coalesce(numeric.bracketed_unit(cell(r, first)), F.lit(False))
    parts = parts.withColumn("__units", years & F.exists("rows", unit))
    of = lambda r: F.transform("__years", lambda i: cell(r, i))
    extra = lambda r: F.coalesce(tables.first_extra(F.col("headers"), r), cell(r, F.get("__years", F.size("__years") - 1)))
    moved = lambda r: F.concat(F.array(cell(r, F.lit(0)), numeric.strip(cell(r, first))), F.slice(of(r), F.lit(2), F.size("__years") - 1), F.array(extra(r)))
    with_units = F.transform("rows", lambda r: F.when(unit(r), moved(r)).otherwise(F.concat(F.array(cell(r, F.lit(0)), F.lit("")), of(r))))
    plain = F.transform("rows", lambda r: F.concat(F.array(cell(r, F.lit(0))), of(r)))
    names = F.transform("__years", lambda i: F.get("headers", i))
    shown = parts.withColumn("__rows", F.when(F.col("__units"), with_units).when(years, plain).otherwise(F.col("rows")))
    label = F.slice("headers", 1, 1)
    shown = shown.withColumn("__h", F.when(F.col("__units"), F.concat(label, F.array(F.lit(numeric.UNIT_HEADER)), names)).when(years, F.concat(label, names)).otherwise(F.col("headers")))
    out = shown.select(*keys, "section", "title", *names_of, F.col("__h").alias("headers"), F.col("__rows").alias("rows"))
    if not named:
        return out
    blank_title = F.coalesce(F.col("title"), F.lit("")) == ""
    part_name = F.when(blank_title, F.col("table_name")).otherwise(F.concat_ws("_", F.coalesce("table_name", F.lit("")), text.strip_markdown(F.col("title"))))
    fallback = F.coalesce(F.nullif("table_name", F.lit("")), F.nullif("title", F.lit("")), F.lit("table"))
    return out.withColumn("table_name", text.safe_name(part_name, fallback)).withColumn("csv_text", numeric.strip(text.table_csv(F.col("headers"), F.col("rows"))))


def recombined(parts: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, title, headers, rows: parts whose headers agree are one table again, each but those titled like the table under a row with its title; a table without parts stays whole.

    A table without title goes by its table_name, if it has one.
    """
    base = numeric.strip(F.coalesce(F.nullif("title", F.lit("")), *(["table_name"] if "table_name" in whole.columns else []), F.lit("")))
    same = parts.groupBy(*keys).agg(F.count("*").alias("__n"), F.countDistinct("headers").alias("__h"))
    named = parts.join(same, keys).join(whole.select(*keys, base.alias("__base"), F.col("title").alias("__own")), keys)
    one = (F.col("__n") > 1) & (F.col("__h") == 1)
    alone = named.filter(~one).select(*keys, "section", "title", "headers", "rows")
    titled = (numeric.strip(F.coalesce("title", F.lit(""))) != "") & (numeric.strip(F.col("title")) != F.col("__base"))
    head = F.array(F.concat(F.array(F.col("title")), F.array_repeat(F.lit(""), F.size("headers") - 1)))
    body = F.when(titled, F.concat(head, "rows")).otherwise(F.col("rows"))
    joined = named.filter(one).groupBy(*keys).agg(F.first("headers").alias("headers"), F.first("__own").alias("title"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("section", body.alias("b")))), lambda x: x["b"])).alias("rows"))
    rest = whole.join(same, keys, "left_anti").select(*keys, F.lit(0).alias("section"), "title", "headers", "rows")
    return alone.unionByName(joined.select(*keys, F.lit(0).alias("section"), "title", "headers", "rows")).unionByName(rest)


def merged_fragments(df: DataFrame, page: list[str], order: str) -> DataFrame:
    """A table of one row of years before one with generated headers and as many columns gives it these years, and goes; of a run of such tables every other one does."""
    by = W.partitionBy(*page).orderBy(order)
    ahead = {c: F.lead(c).over(by) for c in ("headers", "rows", "title", "table_name")}
    own = df.withColumns({f"__{c}": v for c, v in ahead.items()})
    rest = lambda a: F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0)))
    line = F.get("rows", F.lit(0))
    generated = lambda h: F.exists(rest(F.col(h)), tables.generated)
    odd = F.exists(rest(F.col("headers")), lambda h: tables.generated(h) | numeric.bracketed_unit(h))
    fits = (F.size("rows") == 1) & (F.size("__rows") > 0) & (F.size("headers") == F.size("__headers"))
    fits = fits & (F.size(F.filter(rest(line), lambda x: F.coalesce(numeric.is_year(numeric.strip(x)), F.lit(False)))) >= 2) & odd & generated("__headers")
    own = own.withColumn("__fits", F.coalesce(fits, F.lit(False)))
    runs = own.withColumn("__run", F.sum(F.when(F.col("__fits"), 0).otherwise(1)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    nth = F.row_number().over(W.partitionBy(*page, "__run", "__fits").orderBy(order))
    runs = runs.withColumn("__merges", F.col("__fits") & (nth % 2 == 1))
    kept = runs.withColumn("__eaten", F.coalesce(F.lag("__merges").over(by), F.lit(False))).filter(~F.col("__eaten"))
    put = F.transform("__headers", lambda h, i: F.when(i == 0, F.coalesce(F.nullif(h, F.lit("")), F.nullif(F.get("headers", F.lit(0)), F.lit("")), F.lit(tables.LABEL_HEADER))).when(
        F.coalesce(numeric.is_year(numeric.strip(F.get(line, i))) | numeric.bracketed_unit(F.get(line, i)), F.lit(False)), numeric.strip(F.get(line, i))).otherwise(h))
    pick = lambda c: F.when(F.col("__merges"), F.coalesce(F.nullif(f"__{c}", F.lit("")), c)).otherwise(F.col(c)).alias(c)
    headers, rows = (F.when(F.col("__merges"), x).otherwise(F.col(c)).alias(c) for c, x in (("headers", put), ("rows", F.col("__rows"))))
    return kept.select(*[{"headers": headers, "rows": rows}.get(c, pick(c) if c in ("title", "table_name") else F.col(c)) for c in df.columns])


def stored(df: DataFrame) -> DataFrame:
    """df as Parquet in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/tables-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rebuilt(df: DataFrame, keys: list[str]) -> DataFrame:
    """Tables normalised, cut into sections, repaired, and put together where headers agree. What several steps read is written between them."""
    own = stored(tables.normalized(df))
    return recombined(stored(sections(own, keys)), own, keys)


# Headers of tables of a bank's investments, words that their broken heads and second head lines hold, and their title.
INVESTMENT_HEADERS = ["ชื่อบริษัท", "ประเภทธุรกิจ", "ชนิดหุ้น", "จำนวนหุ้น", "ธนาคารถือหุ้น (%)"]
RUN_TOGETHER = ["ชื่อบริษัท", "ประเภทธุรกิจ", "ธนาคาร", "ถือหุ้น"]
STORED_WORDS = ["ชื่อบริษัท", "ประเภทธุรกิจ", "ถือหุ้น"]
KIND_OF_SHARE, NUMBER_OF_SHARES = "ชนิดหุ้น", "จำนวนหุ้น"
INVESTMENT_TITLE = "การลงทุนของธนาคารในบริษัทอื่น"


def investment_headers(df: DataFrame) -> DataFrame:
    """tables (title, headers, rows) whose head of several lines was read as one cell and a first row: five known headers, and the rows below.

    Tables as read have one header, rows of five cells, and in their first row both
    words of the second line. Stored ones are known by their title or first header and
    by one of the words; their rows become five cells wide. Others stay.
    """
    plain = lambda c: text.strip_markdown(F.coalesce(c, F.lit("")))
    blob, first = plain(F.get("headers", F.lit(0))), F.coalesce(F.get("rows", F.lit(0)), F.array().cast("array<string>"))
    says = lambda word: F.exists(first, lambda c: plain(c).contains(word))
    holds = lambda words: F.forall(F.array(*map(F.lit, words)), lambda w: blob.contains(w))
    width = F.greatest(F.size("headers"), F.coalesce(F.array_max(F.transform("rows", F.size)), F.lit(0)))
    read = (width == 5) & (F.size("headers") == 1) & holds(RUN_TOGETHER) & says(KIND_OF_SHARE) & says(NUMBER_OF_SHARES)
    title = text.repeated_title(F.coalesce("title", F.lit("")))
    stored = (title.contains(INVESTMENT_TITLE) | holds(STORED_WORDS)) & says(NUMBER_OF_SHARES)
    five = F.transform(F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))), lambda r: tables.fitted(r, F.lit(5)))
    known = F.coalesce((read | stored) & (F.size("rows") > 0), F.lit(False))
    out = df.withColumn("__known", known).withColumn("__rows", F.when(known, five).otherwise(F.col("rows")))
    heads = F.when(F.col("__known"), F.array(*map(F.lit, INVESTMENT_HEADERS))).otherwise(F.col("headers"))
    named = F.when(F.col("__known"), F.coalesce(F.nullif(title, F.lit("")), F.lit(INVESTMENT_TITLE))).otherwise(F.col("title"))
    return out.withColumn("title", named).withColumn("headers", heads).withColumn("rows", F.col("__rows")).drop("__known", "__rows")
