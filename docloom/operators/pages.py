"""Tables, titles and links in texts of pages, as native columns and windows over lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import numeric, text

# Short lines that begin what follows an article, and ones that belong to a page's frame.
STOP_LINES = [
    "เรื่องที่เกี่ยวข้อง", "บทความที่เกี่ยวข้อง", "อ่านเพิ่มเติม", "ข่าวล่าสุด", "เรื่องเด่น", "แท็กที่เกี่ยวข้อง", "แสดงความคิดเห็น", "tags:", "credit:", "ที่มา:", "คุณอาจสนใจ", "ข่าวที่คุณอาจสนใจ", "บทความยอดนิยม",
    "ข่าวน่าสนใจ", "ข่าวแนะนำ", "sponsored", "บทความต่อไป", "แชร์ข่าว", "ติดตามเรา", "คลิกอ่านเพิ่มเติม", "ข่าวต่างประเทศ", "ข่าวสังคม", "ข่าวการเมือง", "ประเด็นฮิต",
]
SKIPPED_LINES = ["หน้าแรก", "สมัครสมาชิก", "เข้าสู่ระบบ", "แชร์เรื่องนี้", "แชร์บทความ", "อ่านข่าวต่อ"]


def first_group(c: Column, pattern: str) -> Column:
    """The pattern's first group, trimmed; null if nothing matches or it is blank."""
    return F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))


def page_title(html: Column) -> Column:
    """og:title, else the title element, else the first h1; null if there is none."""
    og = first_group(html, r'(?is)<meta[^>]*property="og:title"[^>]*content="([^"]*)"')
    return F.coalesce(og, first_group(html, r"(?is)<title[^>]*>(.*?)</title>"), first_group(html, r"(?is)<h1[^>]*>(.*?)</h1>"))


def links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """key, link, pos: http links of each page, fragments cut, each once at its first place from 0.

    Links that begin with one slash belong to the page's host; other relative ones,
    and all on pages whose url isn't http, are left out. Null pages have none.
    """
    host = F.regexp_extract(F.col(url), r"^(https?://[^/?#]+)", 1)
    found = pages.select(key, host.alias("__host"), F.posexplode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)).alias("pos", "__href"))
    href = F.regexp_replace("__href", r"#.*$", "")
    link = F.when(href.startswith("/") & ~href.startswith("//") & (F.col("__host") != ""), F.concat("__host", href)).otherwise(href)
    return found.select(key, "pos", link.alias("link")).filter(F.col("link").rlike("^https?://")).groupBy(key, "link").agg(F.min("pos").cast("long").alias("pos"))


def pipe_tables(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, at (line of the table's head, from 0), title, headers, rows: the pipe tables of each text.

    A table is a run of lines that begin with a pipe. Separator lines (dashes and
    colons alone) aren't rows. The title is a first line of one cell, else null; the
    next line is the head. Tables without rows below the head are left out, and so
    are null and empty texts.
    """
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "__raw")).filter(F.col("__raw").rlike(r"^\s*\|"))
    run = F.col("line") - F.row_number().over(W.partitionBy(key).orderBy("line"))
    inner = F.regexp_replace(F.trim("__raw"), r"^\||\|$", "")
    cells = F.transform(F.split(inner, r"\|", -1), lambda c: F.trim(c))
    rows = lines.withColumn("__run", run).filter(~F.col("__raw").rlike(r"^[\s|:\-]*-[\s|:\-]*$")).withColumn("__row", F.struct("line", cells.alias("cells")))
    tables = rows.groupBy(key, "__run").agg(F.array_sort(F.collect_list("__row")).alias("__rows"))
    titled = (F.size("__rows") > 1) & (F.size(F.col("__rows")[0]["cells"]) == 1) & (F.size(F.col("__rows")[1]["cells"]) > 1)
    tables = tables.withColumn("__title", F.when(titled, F.col("__rows")[0]["cells"][0])).withColumn("__rows", F.when(titled, F.slice("__rows", 2, F.size("__rows"))).otherwise(F.col("__rows")))
    body = F.transform(F.slice("__rows", 2, F.size("__rows")), lambda r: r["cells"])
    return tables.filter(F.size("__rows") > 1).select(key, F.col("__rows")[0]["line"].alias("at"), F.col("__title").alias("title"), F.col("__rows")[0]["cells"].alias("headers"), body.alias("rows"))


def html_tables(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """key, at (the table's place from 0), title, headers, rows: tables in mark-up whose head, the first row with text, has rows below it.

    The title is the caption. Tags within cells are cut and blanks run together; a nested table ends the outer one.
    """
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)).alias("at", "__table"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    cells = lambda tr: F.transform(F.regexp_extract_all(tr, F.lit(r"(?is)<t[hd](?:\s[^>]*)?>(.*?)</t[hd]>"), 1), plain)
    rows = F.filter(F.transform(F.regexp_extract_all("__table", F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1), cells), lambda r: F.exists(r, lambda c: c != ""))
    out = found.withColumn("__rows", rows).filter(F.size("__rows") > 1)
    return out.select(key, "at", first_group(F.col("__table"), r"(?is)<caption[^>]*>(.*?)</caption>").alias("title"), F.col("__rows")[0].alias("headers"), F.slice("__rows", 2, F.size("__rows")).alias("rows"))


def filtered_lines(c: Column, most: int = 300) -> Column:
    """Lines of an article: lines of the frame, single short words and repeats go; a stop line, whatever else it is, ends it once more than `most` characters stand before."""
    lines = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "\n"), numeric.strip), lambda x: x != "")
    holds = lambda x, words: reduce(lambda a, b: a | b, [F.lower(x).contains(w) for w in words])
    stop = lambda x: (F.length(x) < 60) & holds(x, STOP_LINES)
    framed = lambda x: (F.length(x) < 40) & holds(x, SKIPPED_LINES)
    word = lambda x: (F.length(x) < 10) & ~x.contains(" ") & ~x.rlike("[0-9]")

    def cut(placed):
        kept = text.first_of_each(F.filter(placed, lambda p: ~framed(p["x"]) & ~word(p["x"])), lambda p: F.lower(F.regexp_replace(p["x"], r"(?U)\s+", " ")))
        start = F.struct(F.lit(0).alias("size"), F.lit(None).cast("int").alias("full"))
        # the place of the line with which there are more than `most` characters
        step = lambda a, p: F.struct((a["size"] + F.length(p["x"])).alias("size"), F.when(a["full"].isNull() & (a["size"] + F.length(p["x"]) > most), p["i"]).otherwise(a["full"]).alias("full"))

        def before(k):
            full = F.aggregate(k, start, step)["full"]
            ends = F.array_min(F.transform(F.filter(placed, lambda p: stop(p["x"]) & (p["i"] > full)), lambda p: p["i"]))
            return text.bound(F.coalesce(ends, F.size(placed)), lambda e: F.array_join(F.transform(F.filter(k, lambda p: p["i"] < e), lambda p: p["x"]), "\n"))

        return text.bound(kept, before)

    return text.bound(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), cut)


def result_links(pages: DataFrame, key: str, own_host: str, most: int, html: str = "html") -> DataFrame:
    """key, link, pos: the first `most` http links of each result page that don't lead to the search host, each once, fragments cut."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), 1)).alias("pos", "__href"))
    own = found.filter(F.col("__href").rlike("^https?://") & ~F.col("__href").contains(own_host)).withColumn("link", F.regexp_replace("__href", "#.*$", ""))
    once = own.groupBy(key, "link").agg(F.min("pos").alias("pos"))
    return once.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("pos"))).filter(F.col("__n") <= most).drop("__n")


def raw_page_chunks(pages: DataFrame, most_pages: int | None = None, name: str = "filename", page: str = "page", body: str = "markdown") -> DataFrame:
    """pages, a row each, with the text and kind of their raw chunks; blank pages and those from number most_pages on, from 0, have none."""
    own = pages.filter(numeric.strip(F.coalesce(body, F.lit(""))) != "")
    own = own.filter(F.col(page) < most_pages) if most_pages is not None else own
    head = F.concat(F.lit("RAW_OCR_PAGE: "), F.col(name), F.lit(" page "), F.col(page).cast("string"), F.lit("\n"))
    return own.withColumn("text", F.concat(head, numeric.strip(F.col(body)))).withColumn("source_kind", F.lit("raw_ocr_page"))


def raw_table_chunks(tables: DataFrame) -> DataFrame:
    """tables (title, page, headers, rows) with the text and kind of their raw chunks; those without headers and rows have none."""
    cells = lambda r: F.transform(r, lambda x: numeric.strip(F.coalesce(x, F.lit(""))))
    own = tables.withColumn("headers", cells(F.col("headers"))).withColumn("rows", F.transform("rows", cells))
    own = own.withColumn("csv_text", numeric.strip(text.table_csv(F.col("headers"), F.col("rows")))).filter("csv_text <> ''")
    head = F.concat(F.lit("RAW_OCR_TABLE: "), "title", F.lit("\nRAW_PAGE: "), F.col("page").cast("string"), F.lit("\nRAW_HEADERS: "), F.array_join("headers", ", "), F.lit("\nRAW_CSV:\n"), "csv_text")
    return own.withColumn("text", head).withColumn("source_kind", F.lit("raw_ocr_table"))


def appended(parts: DataFrame, key: str, order: str, body: str, most: int = 250_000) -> DataFrame:
    """key, raw_text: a document's parts in order with a blank line between, at most so many characters of it, which is what the store takes."""
    own = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("t")))).alias("p"))
    return own.select(key, F.substring(F.array_join(F.transform("p", lambda x: x["t"]), "\n\n"), 1, most).alias("raw_text"))


def is_block(c: Column, keywords: list[str], most: int = 250) -> Column:
    """Whether a line is a block of its own: short, or with one of the keywords."""
    return (F.length(c) < most) | reduce(lambda a, b: a | b, [F.lower(c).contains(k.lower()) for k in keywords], F.lit(False))


def container_score(text_length: Column, link_length: Column, blocks: Column) -> Column:
    """How much a container looks like the main one: text without links, less where links are dense, more for blocks up to sixty."""
    share = F.least(link_length / F.greatest(text_length, F.lit(1)), F.lit(0.95))
    score = (text_length - link_length) * (1 - share) * (1 + F.least(blocks, F.lit(60)) / 12)
    return F.when(link_length / F.greatest(text_length, F.lit(1)) > 0.55, score * 0.25).otherwise(score)


def mostly_short_words(c: Column, most: float = 0.65) -> Column:
    """Whether so large a share of a line's words has three characters at most, as in menus."""
    words = F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    return F.coalesce(F.size(F.filter(words, lambda w: F.length(w) <= 3)) / F.nullif(F.size(words), F.lit(0)) >= most, F.lit(False))
