"""Pages put together: tables in mark-up and in pipes are cut out, what remains becomes blocks, all in reading order."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import numeric, text
from docloom.operators import dom
from docloom.operators.dom import in_parts

#: A line that may be a title has so many characters.
TITLE = 4


def filled(rows: list[list[tuple[str, int, int]]]) -> list[list[str]]:
    """A grid from rows of (text, rows down, columns across): a cell's text stands in every place that it spans, gaps are empty."""
    taken: dict[tuple[int, int], str] = {}
    width = 0
    for y, row in enumerate(rows):
        x = 0
        for value, down, across in row:
            while (y, x) in taken:
                x += 1
            for v in range(y, len(rows) if down == 0 else min(len(rows), y + down)):
                for u in range(x, x + across):
                    taken.setdefault((v, u), value)
            x += across
            width = max(width, x)
    return [[taken.get((y, x), "") for x in range(width)] for y in range(len(rows))]


def html_grids(nodes: DataFrame, key: str) -> DataFrame:
    """key, at, start, stop, within (place of the table around it, else -1), caption, headers, rows of each table among nodes.

    Cells that span rows and columns are written in each place. A table within a table
    is one of its own, and its text isn't its cell's. The head is the first row with
    text; tables without rows below it have no headers and no rows.
    """
    words = lambda of: F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda t: t["text"]), " "), r"(?U)\s+", " ").alias(of)
    texts = nodes.filter("name IS NULL AND table >= 0")
    in_cells = texts.filter("cell >= 0").groupBy(key, F.col("cell").alias("at")).agg(words("text"))
    cells = nodes.filter("name IN ('td', 'th') AND tr >= 0").select(key, "table", "tr", "at", "down", "across").join(in_cells, [key, "at"], "left")
    held = cells.groupBy(key, F.col("table").alias("at")).agg(F.array_sort(F.collect_list(F.struct("tr", "at", F.coalesce("text", F.lit("")).alias("text"), "down", "across"))).alias("cells"))
    captions = nodes.filter("name = 'caption'").select(key, "table", F.col("at").alias("__from"), F.col("end").alias("__to")).join(texts.select(key, "table", "at", "text"), [key, "table"])
    captions = captions.filter("at > __from AND at < __to").groupBy(key, "table").agg(words("caption")).withColumnRenamed("table", "at")
    tables = nodes.filter("name = 'table'").select(F.col(key).alias("key"), "at", "start", "stop", F.col("table").alias("within"))
    of = tables.join(held.withColumnRenamed(key, "key"), ["key", "at"], "left").join(captions.withColumnRenamed(key, "key"), ["key", "at"], "left")
    schema = of.drop("cells").select("*", F.lit(None).cast("array<array<string>>").alias("grid")).schema

    def grid(cells: list[dict] | None) -> list[list[str]]:
        rows: dict[int, list] = {}
        for c in cells or []:
            rows.setdefault(c["tr"], []).append((c["text"], c["down"], c["across"]))
        return [r for r in filled(list(rows.values())) if any(r)]

    def fill(batches):
        for batch in batches:
            kept = batch.select(schema.names[:-1])
            for start, grids in in_parts(batch.column("cells"), grid, lambda g: sum(map(len, g))):
                yield pa.RecordBatch.from_arrays([*kept.slice(start, len(grids)).columns, pa.array(grids, pa.list_(pa.list_(pa.string())))], schema.names)

    body = F.size("grid") > 1
    grids = of.mapInArrow(fill, schema)
    return grids.select(F.col("key").alias(key), "at", "start", "stop", "within", "caption", F.when(body, F.col("grid")[0]).alias("headers"), F.when(body, F.slice("grid", 2, F.size("grid"))).alias("rows"))


def marked(c: Column) -> Column:
    """Without tags and images."""
    return F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"!\[[^\]]*\]\([^)]+\)", "")


def last_line(c: Column) -> Column:
    """The last line that may be a title, else null."""
    lines = F.filter(F.transform(F.split(marked(c), "\n"), numeric.strip), lambda x: F.length(x) >= TITLE)
    return F.get(lines, F.size(lines) - 1)


def pieces(pages: DataFrame, key: str, tables: DataFrame, body: str) -> DataFrame:
    """key, piece, start, text: what is left of each page when the outermost tables are taken out, by place; tables: key, start, stop."""
    spans = tables.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    own = pages.select(key, F.coalesce(body, F.lit("")).alias("__body")).join(spans, key, "left")
    own = own.withColumn("__spans", F.coalesce("__spans", F.array().cast("array<struct<start: int, stop: int>>")))
    begins = F.concat(F.array(F.lit(0)), F.transform("__spans", lambda s: s["stop"]))
    ends = F.concat(F.transform("__spans", lambda s: s["start"]), F.array(F.length("__body")))
    cut = own.select(key, "__body", F.posexplode(F.arrays_zip(begins.alias("b"), ends.alias("e"))).alias("piece", "p"))
    return cut.select(key, "piece", F.col("p.b").alias("start"), F.substring("__body", F.col("p.b") + 1, F.col("p.e") - F.col("p.b")).alias("text"))


def lines_of(cut: DataFrame, key: str) -> DataFrame:
    """Lines of pieces, stripped, with their place in the page, and table: the number of the pipe table that a line belongs to in its piece, else null.

    A pipe table is a head (a line with two pipes or more), a separator (pipes, dashes
    and colons) and the lines with two pipes or more that follow; of a run of such
    lines the first head counts.
    """
    lines = cut.select(key, "piece", F.col("start").alias("__from"), F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    by = W.partitionBy(key, "piece").orderBy("line")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.col("__from") + F.coalesce(F.sum(F.length("raw") + 1).over(before), F.lit(0))).withColumn("raw", numeric.strip(F.col("raw")))
    lines = lines.withColumn("__row", F.regexp_count("raw", F.lit(r"\|")) >= 2)
    lines = lines.withColumn("__run", F.sum((~F.col("__row")).cast("int")).over(by))
    separator = F.col("__row") & (numeric.strip(F.translate("raw", "|:-", "")) == "") & F.col("raw").contains("-")
    lines = lines.withColumn("__sep", separator).withColumn("__head", F.col("__row") & F.coalesce(F.lead("__sep").over(by), F.lit(False)))
    run = W.partitionBy(key, "piece", "__run")
    head = F.min(F.when(F.col("__head"), F.col("line"))).over(run)
    return lines.withColumn("table", F.when(F.col("__row") & (F.col("line") >= head), head)).drop("__from", "__run", "__head")


def pipe_grids(lines: DataFrame, key: str) -> DataFrame:
    """key, start, title, headers, rows of the pipe tables; a row of one cell before the first row is the title. Tables without rows are left out."""
    inner = F.when(F.col("raw").startswith("|") & F.col("raw").endswith("|"), F.substring("raw", 2, F.length("raw") - 2)).otherwise(F.col("raw"))
    cells = F.transform(F.split(inner, r"\|", -1), numeric.strip)
    own = lines.filter("table IS NOT NULL").groupBy(key, "piece", "table").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("line", cells.alias("cells")))).alias("r"))
    all_rows = F.transform(F.slice("r", 3, F.size("r")), lambda x: x["cells"])
    single = lambda c: F.size(F.filter(c, lambda x: x != "")) == 1
    # titles are the rows of one cell at the top, of which the last counts
    own = own.select(key, "start", F.col("r")[0]["cells"].alias("headers"), all_rows.alias("all"))
    first = F.coalesce(F.array_min(F.transform(F.filter(F.transform("all", lambda c, i: F.struct(i.alias("i"), single(c).alias("s"))), lambda x: ~x["s"]), lambda x: x["i"])), F.size("all"))
    own = own.withColumn("n", first).filter(F.size("all") > F.col("n"))
    title = F.when(F.col("n") > 0, F.get(F.filter(F.get("all", F.col("n") - 1), lambda x: x != ""), F.lit(0)))
    return own.select(key, "start", title.alias("title"), "headers", F.slice("all", F.col("n") + 1, F.size("all")).alias("rows"))


def assembled(pages: DataFrame, document: str, page: str, body: str = "markdown", paragraphs: bool = False) -> DataFrame:
    """document, page, place, kind, title, headers, rows, text: the parts of each document's pages in reading order, place from 0.

    kind is html_table, pipe_table or text. A table in mark-up without caption takes
    its title from the last line before it, back to the table before. Text between
    tables, without mark-up, is one block but where a line holds nothing else than
    mark-up; with paragraphs, blank lines part blocks too. A block that a page already
    has, white space aside, is left out. Pages that share document and number are one
    page each; null and blank pages have no parts.
    """
    key = "__page"
    own = pages.select(F.struct(F.col(document).alias("d"), F.col(page).alias("p"), F.xxhash64(body).alias("h")).alias(key), F.col(body).alias("__body"))
    found = html_grids(dom.nodes(own, key, "__body"), key)
    outer = found.filter("within = -1")
    cut = pieces(own, key, outer.select(key, "start", "stop"), "__body")
    before = cut.select(key, F.row_number().over(W.partitionBy(key).orderBy("piece")).alias("n"), last_line(F.col("text")).alias("__line"))
    numbered = outer.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("start"))).select(key, "at", "n").join(before, [key, "n"]).drop("n")
    titled = found.filter("rows IS NOT NULL").join(numbered, [key, "at"], "left").select(key, "start", F.coalesce("caption", "__line").alias("title"), "headers", "rows")
    lines = lines_of(cut, key)
    blank = F.col("raw") == ""
    cleared = numeric.strip(marked(F.col("raw")))
    loose = lines.filter("table IS NULL").withColumn("line_text", cleared).withColumn("seg", F.col("line") - F.row_number().over(W.partitionBy(key, "piece").orderBy("line")))
    cuts = (F.col("line_text") == "") & (F.lit(paragraphs) | ~blank)
    loose = loose.withColumn("block", F.sum(cuts.cast("int")).over(W.partitionBy(key, "piece", "seg").orderBy("line"))).filter("line_text <> ''")
    blocks = loose.groupBy(key, "piece", "seg", "block").agg(F.min("start").alias("start"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "line_text"))), lambda x: x["line_text"]), "\n").alias("text"))
    same = W.partitionBy(key, F.regexp_replace("text", r"(?U)\s+", " ")).orderBy("start")
    blocks = blocks.withColumn("__n", F.row_number().over(same)).filter("__n = 1")
    nothing, no_rows = F.lit(None).cast("string"), F.lit(None).cast("array<array<string>>")
    parts = (
        titled.select(key, "start", F.lit("html_table").alias("kind"), "title", "headers", "rows", nothing.alias("text"))
        .unionByName(pipe_grids(lines, key).select(key, "start", F.lit("pipe_table").alias("kind"), "title", "headers", "rows", nothing.alias("text")))
        .unionByName(blocks.select(key, "start", F.lit("text").alias("kind"), nothing.alias("title"), F.lit(None).cast("array<string>").alias("headers"), no_rows.alias("rows"), "text"))
    )
    place = F.row_number().over(W.partitionBy(f"{key}.d").orderBy(f"{key}.p", f"{key}.h", "start", "kind")) - 1
    return parts.select(F.col(f"{key}.d").alias(document), F.col(f"{key}.p").alias(page), place.alias("place"), "kind", "title", "headers", "rows", "text")


def page_counts(pages: DataFrame, parts: DataFrame, document: str, page: str) -> DataFrame:
    """document, page, text_blocks, tables: how many parts of each kind each page has, pages without any too."""
    of = parts.groupBy(document, page).agg(F.count_if(F.col("kind") == "text").alias("text_blocks"), F.count_if(F.col("kind") != "text").alias("tables"))
    whole = pages.select(document, page).distinct().join(of.select(F.col(document).alias("__d"), F.col(page).alias("__p"), "text_blocks", "tables"), F.col(document).eqNullSafe(F.col("__d")) & F.col(page).eqNullSafe(F.col("__p")), "left")
    return whole.select(document, page, F.coalesce("text_blocks", F.lit(0)).alias("text_blocks"), F.coalesce("tables", F.lit(0)).alias("tables"))
