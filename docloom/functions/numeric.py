"""Numbers, units and vectors as native columns. Nulls give nulls unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
PLAIN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
STRICT = r"^-?[0-9]+(\.[0-9]+)?$"
YEAR = r"^(?:25|20)[0-9]{2}$"
# Unit words as they stand in cells, and the ones that labels hint at.
UNIT_WORDS = ["%", "บาท", "ล้านบาท", "พันบาท", "หุ้น", "ล้านหุ้น", "เท่า", "สัญญา", "บาท/หุ้น", "ต่อหุ้น"]
UNIT_HEADER = "หน่วย"
RATIO_HINTS = ["roe", "roa", "อัตราส่วน", "ต่อรายได้", "npl"]


def strip(c: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"^[\s\p{Z}]+", ""), r"[\s\p{Z}]+$", "")


def parse_numeric(c: Column, mode: str = "warehouse") -> Column:
    """The number that a cell shows, or null; (x) is negative, commas go, white space at the ends too.

    warehouse: placeholders are empty and the dashes - – —; percent signs go.
    strict: the same placeholders, then plain digits only, no sign +, no percent.
    loose: only - is a placeholder; percent signs and all brackets go.
    """
    text = F.translate(strip(c), THAI_DIGITS, "0123456789")
    negative = text.startswith("(") & text.endswith(")")
    inner = F.when(negative, strip(F.regexp_replace(text, r"(?s)^\((.*)\)$", "$1"))).otherwise(text)
    if mode == "strict":
        bare, form, none = F.translate(inner, ",", ""), STRICT, ["", "-", "–", "—"]
    elif mode == "loose":
        bare, form, none = strip(F.translate(text, ",%()", "")), PLAIN, ["", "-"]
    else:
        bare, form, none = strip(F.translate(inner, ",%", "")), PLAIN, ["", "-", "–", "—"]
    value = F.when(bare.rlike(form), bare.try_cast("double"))
    return F.when(text.isin(none), F.lit(None)).when(negative, -value).otherwise(value)


def parse_numeric_backfill(c: Column) -> Column:
    """The older rule, which loses brackets' signs: all but digits, dots and minus signs are dropped."""
    kept = F.regexp_replace(c, r"[^0-9.\-]", "")
    return F.when(kept != "", kept.try_cast("double"))


def looks_numeric(c: Column) -> Column:
    """Digits with commas, a minus sign, a fraction; no brackets, no percent sign."""
    return F.translate(F.translate(strip(c), ",", ""), THAI_DIGITS, "0123456789").rlike(STRICT)


#: Cells under headers that ask for numbers.
VALID_CELLS = [r"^[+-]?[0-9][0-9,]*\.?[0-9]*$", r"^\([0-9][0-9,]*\.?[0-9]*\)$", r"^[+-]?[0-9][0-9,]*\.?[0-9]*\s*%$"]
PLACEHOLDER = r"^[-–—.]{1,3}$"
# Words of headers that ask for numbers.
NUMERIC_HEADERS = ["จำนวน", "ยอด", "รวม", "บาท", "ล้าน", "พัน", "ร้อย", "อัตรา", "ดอกเบี้ย", "กำไร", "ขาดทุน", "สินทรัพย์", "หนี้สิน", "%", "amount", "total", "sum", "value"]


def valid_cell(c: Column) -> Column:
    """A number, one in brackets, a percentage or a placeholder."""
    text = F.translate(strip(c), THAI_DIGITS, "0123456789")
    return text.rlike("|".join([*VALID_CELLS, PLACEHOLDER]))


def asks_for_numbers(header: Column) -> Column:
    """Whether a header is a year or names an amount."""
    own, lower = strip(header), F.lower(strip(header))
    named = F.lit(False)
    for word in NUMERIC_HEADERS:
        named = named | lower.contains(word)
    return is_year(own) | named


def is_year(c: Column) -> Column:
    return c.rlike(YEAR)


def unit_token(c: Column) -> Column:
    """The unit that a cell consists of, brackets aside, or null."""
    bare = F.regexp_replace(strip(c), r"^\(?(.*?)\)?$", "$1")
    return F.when(bare.isin(UNIT_WORDS), bare)


def bracketed_unit(c: Column) -> Column:
    """Whether a cell is anything short in brackets, or one of the plainest units."""
    return strip(c).rlike(r"^\([^)]{1,15}\)$") | strip(c).isin("%", "บาท", "ล้านบาท")


# Units that readers of scanned pages put into the columns of years.
MISPLACED_UNITS = ["%", "บาท", "ล้านบาท", "พันบาท", "ล้าน", "พัน", "ร้อย", "หุ้น", "ราย", "เท่า", "ครั้ง"]


def misplaced_unit(c: Column) -> Column:
    """Whether a cell is one of the known units, with brackets or without."""
    inner = F.regexp_replace(strip(c), r"^\(?(.*?)\)?$", "$1")
    return inner.isin(MISPLACED_UNITS) | (strip(c).rlike(r"^\([^)]{1,15}\)$") & strip(inner).isin(MISPLACED_UNITS))


# Labels of ratios in questions and rows.
RATIO_LABELS = ["roe", "roa", "อัตราส่วน", "ค่าใช้จ่ายต่อรายได้", "เงินให้สินเชื่อด้อยคุณภาพต่อเงินให้สินเชื่อรวม", "เงินให้สินเชื่อต่อเงินรับฝาก"]


def infer_value_unit(label: Column, question: Column, table_name: Column) -> Column:
    """The unit of an answer's value, from label, question and table name."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(x, F.lit("")) for x in (label, question, table_name)]))
    ratio = F.lit(False)
    for word in RATIO_LABELS:
        ratio = ratio | text.contains(word)
    return F.when(text.contains("ต่อหุ้น"), "บาท").when(ratio, "%").when(text.contains("ล้านบาท"), "ล้านบาท").otherwise("")


def with_unit(value: Column, unit: Column) -> Column:
    """A shown value with its unit, unless it has it; a percent sign goes without a blank."""
    own = strip(F.coalesce(value, F.lit("")))
    worded = unit.isin("บาท", "ล้านบาท")
    return F.when((own == "") | F.endswith(own, unit), own).when(unit == "%", F.concat(own, F.lit("%"))).when(worded, F.concat_ws(" ", own, unit)).otherwise(own)


def padded_box(x0: Column, y0: Column, x1: Column, y1: Column, by: int, width: Column, height: Column) -> Column:
    """A box widened by so many pixels within an image, with its own width, height and area before."""
    low = lambda v: F.greatest(F.lit(0), v - by)
    return F.struct(
        low(x0).alias("x0"), low(y0).alias("y0"), F.least(width, x1 + by).alias("x1"), F.least(height, y1 + by).alias("y1"),
        (x1 - x0).alias("width"), (y1 - y0).alias("height"), ((x1 - x0) * (y1 - y0)).alias("area"),
    )


def row_band(first: Column, last: Column, n_rows: Column, height: Column) -> Column:
    """top and bottom of table rows first to last in an image whose rows, and a header, are evenly spaced; a fifth of a row more on both sides. Null if there is none."""
    each = height / F.greatest(n_rows + 1, F.lit(1))
    margin = F.floor(each * 0.2)
    top = F.greatest(F.lit(0), F.floor((first + 1) * each) - margin)
    bottom = F.least(height, F.floor((last + 2) * each) + margin)
    return F.when((n_rows > 0) & (bottom > top), F.struct(top.cast("long").alias("top"), bottom.cast("long").alias("bottom")))


def guess_unit(label: Column, table_name: Column, unit_cell: Column | None = None) -> Column:
    """The unit that label and table name hint at; a unit cell of the row comes before ratios and per-share labels."""
    both = F.lower(F.concat_ws(" ", F.coalesce(label, F.lit("")), F.coalesce(table_name, F.lit(""))))
    out = F.when(both.contains("ล้านบาท"), "ล้านบาท").when(both.contains("พันบาท"), "พันบาท")
    if unit_cell is not None:
        own = F.regexp_replace(strip(F.coalesce(unit_cell, F.lit(""))), r"^[()]+|[()]+$", "")
        out = out.when(own != "", own)
    ratio = F.lit(False)
    for hint in RATIO_HINTS:
        ratio = ratio | both.contains(hint)
    return out.when(ratio, "%").when(both.contains("ต่อหุ้น"), "บาท").when(both.contains("ฐานะการเงิน"), "ล้านบาท").otherwise("")


def format_like(template: Column, value: Column) -> Column:
    """value with thousands separators and as many decimals as characters follow the template's last dot."""
    shown = strip(F.coalesce(template, F.lit("")))
    decimals = F.when(shown.contains("."), F.length(F.substring_index(shown, ".", -1))).otherwise(0)
    form = F.concat(F.lit("#,##0"), F.when(decimals > 0, F.concat(F.lit("."), F.repeat(F.lit("0"), decimals))).otherwise(""))
    return F.call_function("format_number", value, form)


def format_delta(value: Column) -> Column:
    """Whole numbers without decimals (to 1e-9), others with two."""
    return F.when(F.abs(value - F.round(value)) < 1e-9, F.format_string("%d", F.round(value).cast("long"))).otherwise(F.format_string("%.2f", value))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_similarity(a: Column, b: Column, epsilon: float = 0.0) -> Column:
    """In double; without epsilon a zero vector gives null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + F.lit(epsilon)
    return F.when(norms > 0, dot(a, b) / norms)


def direction(delta: Column) -> Column:
    """The word for a change: risen if it is above nought, else fallen."""
    return F.when(delta > 0, "เพิ่มขึ้น").when(delta.isNotNull(), "ลดลง")


def confidence(issues: Column, cells: Column, empty_rows: Column) -> Column:
    """Of a table: less by two for each share of cells with issues, and by 0.4 for each empty row, 0.9 at most."""
    return F.greatest(F.lit(0.0), 1.0 - 2.0 * issues / F.greatest(cells, F.lit(1)) - F.least(F.lit(0.9), 0.4 * empty_rows))
