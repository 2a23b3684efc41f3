"""Text cleaning, names, terms and routing scores as native columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.numeric import THAI_DIGITS, strip

# Characters that OCR takes for digits, in order.
CONFUSED, MEANT = "OolISBZG", "00115826"
# Unit abbreviations of headers, in the order in which they are replaced.
ABBREVIATIONS = [("ลบ.", "ล้านบาท"), ("ล.บ.", "ล้านบาท"), ("ลบ", "ล้านบาท"), ("พบ.", "พันบาท"), ("พ.บ.", "พันบาท")]
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
#: White space of any script but line ends.
BLANKS = r"[\t\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Words of a question that aren't searched for.
STOP_WORDS = ["อะไร", "เท่าไร", "เท่าไหร่", "เท่า", "ใด", "บ้าง", "ของ", "ใน", "ปี", "และ", "กับ", "ที่", "เป็น", "ได้", "หรือ", "how", "what", "which", "does", "did", "the", "for", "from", "and"]
YEAR_IN_TEXT = r"(?<![\p{L}\p{N}_])(?:25|20)\p{Nd}{2}(?![\p{L}\p{N}_])"
MONTHS = "ม.ค.|ก.พ.|มี.ค.|เม.ย.|พ.ค.|มิ.ย.|ก.ค.|ส.ค.|ก.ย.|ต.ค.|พ.ย.|ธ.ค.|มกราคม|กุมภาพันธ์|มีนาคม|เมษายน|พฤษภาคม|มิถุนายน|กรกฎาคม|สิงหาคม|กันยายน|ตุลาคม|พฤศจิกายน|ธันวาคม"
#: Texts that are folded at a time.
FOLDED = 256
THAI_DATE = rf"^\d{{1,2}}\s*(?:{MONTHS.replace('.', '[.]')})\s*(?:\d{{4}}|\d{{2}})$"


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often a function within body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_of_each(items: Column, key) -> Column:
    """Of items with equal keys the first, in order; by sorting, so that long texts stay cheap."""
    keyed = F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    once = bound(keyed, lambda s: F.filter(s, lambda e, j: (j == 0) | (F.get(s, j - 1)["k"] != e["k"])))
    return F.transform(F.sort_array(F.transform(once, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x")))), lambda e: e["x"])


def clean_text(c: Column) -> Column:
    """Control characters go, runs of blanks become one, of line ends two at most; lines are stripped. Null is empty."""
    text = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    text = F.regexp_replace(text, BLANKS + "+", " ")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    text = F.regexp_replace(text, r"(?<=\n) | (?=\n)", "")
    return strip(text)


def folded(texts: pa.Array) -> pa.Array:
    import unicodedata

    foldable = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    if not pc.any(foldable).as_py():
        return texts
    return pc.replace_with_mask(texts, foldable, pa.array([unicodedata.normalize("NFKC", t) for t in texts.filter(foldable).to_pylist()], texts.type))


@F.arrow_udf(StringType())
def nfkc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Compatibility forms folded (NFKC); texts in ASCII have none and pass as they are. Null stays null.

    By Python's tables, a call for each whole text: Arrow's own function leaves marks apart that NFKC joins.
    A batch is folded in parts of `FOLDED` texts, which are all that stands in Python at once.
    """
    for texts in batches:
        for start in range(0, len(texts), FOLDED):
            yield folded(texts.slice(start, FOLDED))


def thai_digits(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, "0123456789")


def fix_digits(c: Column) -> Column:
    """Letters that OCR takes for digits, in cells that are a number but for them, brackets aside."""
    inner = strip(F.regexp_replace(F.regexp_replace(strip(c), r"^\(+", ""), r"\)+$", ""))
    almost = inner.rlike(r"^[+-]?[0-9OolISBZG][0-9OolISBZG,]*\.?[0-9OolISBZG]*$")
    return F.when(almost, F.translate(c, CONFUSED, MEANT)).otherwise(c)


def mended_marks(c: Column) -> Column:
    """Thai vowels and tone marks that OCR parts, doubles or leaves at the start of a cell."""
    text = F.regexp_replace(c, "ะม|ํ", "ำ")
    text = F.regexp_replace(text, "[่-๋]+([่-๋])", "$1")
    return F.regexp_replace(text, "^[ัิ-ฺ็-๎]+", "")


def clean_cell(c: Column, header: bool = False) -> Column:
    """A cell as shown: marks mended, Thai digits and, but in headers, misread digits; in headers units written out. Null is empty."""
    text = thai_digits(mended_marks(strip(F.coalesce(c, F.lit("")))))
    text = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), ABBREVIATIONS, text) if header else fix_digits(text)
    return strip(F.regexp_replace(F.translate(text, ZERO_WIDTH, ""), r"[ \t]+", " "))


def strip_markdown(c: Column) -> Column:
    """Without asterisks, underscores, backticks and hashes; white space in one. Null is empty."""
    return strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[*_`#]+", ""), r"(?U)\s+", " "))


def safe_name(c: Column, fallback: Column | None = None, most: int = 240) -> Column:
    """A name of letters, digits, Thai and _ - . ( ) only, the fallback's where it is blank; long ones are cut and get ten digits of a SHA-1."""
    text = F.coalesce(*[F.nullif(strip_markdown(x), F.lit("")) for x in (c, *([fallback] if fallback is not None else []))], F.lit("table"))
    name = F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", "_"), r"(?U)[^\w\x{0E00}-\x{0E7F}\-.()]", "_")
    name = F.regexp_replace(F.regexp_replace(name, "_+", "_"), "^_+|_+$", "")
    digest = F.substring(F.sha1(name.cast("binary")), 1, 10)
    cut = F.concat(F.regexp_replace(F.substring(name, 1, most - 11), "_+$", ""), F.lit("_"), digest)
    return F.when(name == "", "table").when(F.length(name) <= most, name).otherwise(cut)


def first_half(c: Column) -> Column:
    return c.substr(F.lit(1), F.floor(F.length(c) / 2).cast("int"))


def halved(c: Column) -> Column:
    """A name of four characters or more that is its half twice over becomes the half; so does one whose parts between _ are, an odd last part aside."""
    half = first_half(c)
    plain = (F.length(c) % 2 == 0) & (F.concat(half, half) == c)
    parts = F.split(c, "_", -1)
    mid = F.floor(F.size(parts) / 2).cast("int")
    head = F.slice(parts, F.lit(1), mid)
    doubled = (mid > 0) & (head == F.slice(parts, mid + 1, mid))
    return F.when(F.length(c) < 4, c).when(plain, half).when(doubled, F.array_join(head, "_")).otherwise(c)


def sanitized(c: Column) -> Column:
    """For loading: valid UTF-8, doubled names halved; null is empty."""
    return halved(F.call_function("make_valid_utf8", F.coalesce(c, F.lit(""))))


def repeated_title(c: Column) -> Column:
    """A title without mark-up that is its half twice over, or twice the same around the first _, - or blank, becomes the half."""
    text = strip_markdown(c)
    half = first_half(text)
    out = F.when((text != "") & (F.length(text) % 2 == 0) & (F.concat(half, half) == text), half)
    for sep in ("_", "-", " "):
        at = F.locate(sep, text)
        one, two = strip(text.substr(F.lit(1), at - 1)), strip(text.substr(at + 1, F.length(text)))
        out = out.when((at > 0) & (one != "") & (one == two), one)
    return out.otherwise(text)


def file_name(c: Column, most: int = 60) -> Column:
    """A file name without characters that file systems refuse; site if nothing is left."""
    text = strip(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/*?"<>|:]', ""), r"(?U)\s+", " "))
    text = strip(F.regexp_replace(F.substring(text, 1, most), "[ .]+$", ""))
    return F.when(text == "", "site").otherwise(text)


def folder_name(c: Column, most: int = 40) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/*?"<>|:]', ""), r"(?U)\s+", "_")
    text = F.substring(F.regexp_replace(text, "^_+|_+$", ""), 1, most)
    return F.when(text == "", "site").otherwise(text)


def normalize_lookup(c: Column) -> Column:
    """For comparing names: no spaces, no punctuation, lower case; null counts as empty."""
    return F.lower(strip(F.regexp_replace(F.coalesce(c, F.lit("")), r"[ \n\r\t,:;(){}\[\]\"'`“”‘’%\-_/]", "")))


def years_in(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(YEAR_IN_TEXT), F.lit(0))


def keyword_terms(c: Column) -> Column:
    """The terms of a question, in order, each once whatever its case, without stop words."""
    found = F.regexp_extract_all(c, F.lit(r"[A-Za-z]{2,}|[0-9]{4}|[ก-๙]{2,}"), F.lit(0))
    return first_of_each(F.filter(found, lambda t: ~F.lower(t).isin(STOP_WORDS)), lambda t: F.lower(t))


def sentences(c: Column) -> Column:
    """Pieces after . ! ? or 。 and at line ends; where those give fewer than three, each is cut at runs of blanks too."""
    kept = lambda x: F.filter(F.transform(x, strip), lambda s: s != "")
    first = kept(F.split(F.coalesce(c, F.lit("")), r"(?U)(?<=[。.!?\n])\s*"))
    return F.when(F.size(first) >= 3, first).otherwise(F.flatten(F.transform(first, lambda s: kept(F.split(s, r"(?U)\s{2,}")))))


def line_filtered(c: Column, least: int = 3) -> Column:
    """Lines of a page, stripped, of so many characters and more, each once whatever its case and blanks."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(c, F.lit("")), BLANKS + "+", " "), "\n"), strip), lambda x: F.length(x) >= least)
    return F.array_join(first_of_each(lines, lambda x: F.lower(F.regexp_replace(x, r"(?U)\s+", " "))), "\n")


def layout_cleaned(c: Column) -> Column:
    """A page's text without tags and images, of line ends two at most."""
    text = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]+>", ""), r"!\[[^\]]*\]\([^)]+\)", "")
    return strip(F.regexp_replace(text, r"\n{3,}", "\n\n"))


def text_blocks(c: Column) -> Column:
    """Paragraphs between blank lines, stripped, each once whatever its white space."""
    blocks = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"(?U)\n\s*\n"), strip), lambda b: b != "")
    return first_of_each(blocks, lambda b: F.regexp_replace(b, r"(?U)\s+", " "))


def table_group(c: Column) -> Column:
    """What a table's parts have in common: their name up to _table_ and its number."""
    name = F.coalesce(F.nullif(c, F.lit("")), F.lit("untitled_table"))
    return F.coalesce(F.nullif(F.regexp_extract(name, r"^(.*?_table_[0-9]+)_.*$", 1), F.lit("")), name)


def longer_text(page_text: Column, content: Column, rule: str = "=" * 60) -> Column:
    """Of a page's text and its file's body, what follows a line of = where there is one, the longer; of equal ones the page's."""
    own, body = strip(F.coalesce(page_text, F.lit(""))), strip(F.coalesce(content, F.lit("")))
    body = F.when(body.contains(rule), strip(body.substr(F.locate(rule, body) + len(rule), F.length(body)))).otherwise(body)
    return F.when(F.length(body) > F.length(own), body).otherwise(own)


def label_candidates(cells: Column) -> Column:
    """The cells of a row, a map, that may label it: not blank, and not under a year or a generated header."""
    return F.map_filter(cells, lambda k, v: ~F.coalesce(k, F.lit("")).rlike(r"^(25[0-9]{2}|20[0-9]{2}|column_[0-9]+)$") & (strip(F.coalesce(v, F.lit(""))) != ""))


def answer_method(tools: Column) -> Column:
    """How an answer was found, from the tools that gave it data."""
    has = lambda t: F.array_contains(tools, t)
    return (
        F.when(has("tavily_search"), "web_search").when(has("multi_hop"), "multi_hop").when(has("graph_search") & has("sql_query"), "graph_sql_hybrid")
        .when(has("graph_search"), "graph").when(has("sql_query") & has("vector_search"), "hybrid").when(has("sql_query"), "sql").when(has("vector_search"), "vector").otherwise("agent")
    )


def first_array(c: Column) -> Column:
    """The text from the first square bracket to the last."""
    return F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit(""))


def only_select(sql: str, spark: SparkSession | None = None) -> bool:
    """Whether a statement, comments before it aside, reads and nothing else: one SELECT or WITH ... SELECT, as Spark's parser sees it."""
    import re

    spark = spark or SparkSession.active()
    body = re.sub(r"(?s)^(?:\s|/\*.*?\*/|--[^\n]*)+", "", sql)
    if not re.match(r"(?i)(select|with)\b", body):
        return False
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        if "ParseException" in type(e).__name__ or "ParseException" in str(e):
            return False
        raise
    kinds = "org.apache.spark.sql.catalyst.plans.logical."
    of = lambda name: spark._jvm.java.lang.Class.forName(kinds + name, True, plan.getClass().getClassLoader())
    acts = [of("Command"), of("ParsedStatement")]

    def reads(node) -> bool:
        below = node.children()
        return not any(a.isInstance(node) for a in acts) and all(reads(below.apply(i)) for i in range(below.size()))

    return reads(plan)


def token_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def csv_cell(c: Column) -> Column:
    """Quoted where it holds a comma, quote or line end; quotes are doubled."""
    text = F.coalesce(c, F.lit(""))
    return F.when(text.rlike(r"[,\"\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def table_csv(headers: Column, rows: Column) -> Column:
    """A table's CSV text: arrays of cells, a line each."""
    line = lambda cells: F.array_join(F.transform(cells, csv_cell), ",")
    return F.array_join(F.concat(F.array(line(headers)), F.transform(rows, line)), "\n")


def row_text(cells: Column) -> Column:
    """A map of cells as k=v, k=v."""
    return F.array_join(F.transform(F.map_entries(cells), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ", ")


def final_answer(c: Column) -> Column:
    return strip(F.regexp_extract(c, r"(?s)Final Answer:\s*(.*)", 1))


def first_json(c: Column) -> Column:
    """The text from the first brace to the last."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def balanced(c: Column, quoted: bool = True) -> Column:
    """The text from the first brace to the one that closes it; null if there is none.

    quoted: braces within strings don't count, nor do escaped quotes end these. One
    fold over pieces cut at braces, quotes and backslashes, linear in the text.
    """
    own = F.substring(c, F.locate("{", c), F.length(c))
    pieces = F.regexp_extract_all(F.when(F.locate("{", c) > 0, own), F.lit(r'[{}"\\]|[^{}"\\]+'), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("within"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def step(a, p):
        at = a["at"] + F.length(p)
        string = a["within"] if quoted else F.lit(False)
        depth = a["depth"] + F.when(string, 0).when(p == "{", 1).when(p == "}", -1).otherwise(0)
        quote = (p == '"') & ~a["escaped"]
        return F.struct(
            depth.alias("depth"), F.when(quote, ~a["within"]).otherwise(a["within"]).alias("within"), (string & ~a["escaped"] & (p == "\\")).alias("escaped"),
            at.alias("at"), F.coalesce(a["end"], F.when(~string & (p == "}") & (depth == 0), at)).alias("end"),
        )

    return F.substring(own, F.lit(1), F.aggregate(pieces, start, step)["end"])


def action(c: Column) -> Column:
    """tool and query of the first action in an answer: the object after `Action:`, if it is valid and has both; else null.

    As the agent reads it, braces within strings count.
    """
    after = F.regexp_extract(c, r"(?s)Action:\s*(.*)", 1)
    body = balanced(after, quoted=False)
    parsed = F.try_parse_json(body)
    keys = F.json_object_keys(body)
    value = lambda k: F.try_variant_get(parsed, f"$.{k}", "string").alias(k)
    return F.when(parsed.isNotNull() & F.array_contains(keys, "tool") & F.array_contains(keys, "query"), F.struct(value("tool"), value("query")))
