"""Messages of jobs over pages: short reasons, one warning for several errors, and what a stored message says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAGE = r"(?i)page\s+(\d+)"


def summarised(error: Column) -> Column:
    """An error's short reason; null is as empty."""
    compact = F.trim(F.regexp_replace(F.coalesce(error, F.lit("")), r"\s+", " "))
    return (
        F.when(compact.contains("StringDataRightTruncationError") & compact.contains("character varying(500)"), "DB insert failed: table_name too long for structured_data.table_name")
        .when(compact.contains("Request timed out") | compact.contains("Error code: 408"), "Typhoon OCR timeout (408)")
        .when(compact.contains("500 Internal Server Error"), "Upstream service returned 500")
        .otherwise(F.substring(compact, 1, 220))
    )


def warning(errors: Column) -> Column:
    """One warning for an array of errors; those that name no page are left out. Null is as an empty array."""
    named = F.filter(F.coalesce(errors, F.array().cast("array<string>")), lambda e: F.coalesce(e, F.lit("")).rlike(PAGE))
    number = lambda e: F.regexp_extract(e, PAGE, 1)
    pages = F.concat(F.lit("Failed pages: "), F.array_join(F.transform(named, number), ", "))
    reasons = F.concat(F.lit("Failed page reasons: "), F.array_join(F.transform(named, lambda e: F.concat(number(e), F.lit("="), summarised(e))), "; "))
    return F.concat(F.lit("Partial OCR warnings: "), F.when(F.size(named) > 0, F.concat(pages, F.lit(" | "), reasons)).otherwise(""))


def told(message: Column) -> Column:
    """progress_text, failed_pages, failed_page_reasons (of a page named twice the last), status_detail of a stored message."""
    detail = F.regexp_replace(F.coalesce(message, F.lit("")), r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    at = r"(?i)Processing page\s+(\d+)/(\d+)"
    progress = F.when(detail.rlike(at), F.concat(F.lit("หน้า "), F.regexp_extract(detail, at, 1), F.lit("/"), F.regexp_extract(detail, at, 2))).otherwise("")
    digits = F.transform(F.split(F.regexp_extract(detail, r"(?i)Failed pages:\s*([0-9,\s]+)", 1), ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    pages = F.transform(F.filter(digits, lambda x: x.rlike(r"^\d+$")), lambda x: x.cast("long"))
    part = r"^\s*(\d+)\s*=\s*(.+?)\s*$"
    parts = F.filter(F.split(F.regexp_extract(detail, r"(?i)Failed page reasons:\s*(.+)$", 1), ";"), lambda x: x.rlike(part))
    pairs = F.transform(parts, lambda x: F.struct(F.regexp_extract(x, part, 1).cast("long").alias("page"), F.regexp_extract(x, part, 2).alias("reason")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["page"] == x["page"]))
    return F.struct(progress.alias("progress_text"), pages.alias("failed_pages"), F.map_from_entries(last).alias("failed_page_reasons"), detail.alias("status_detail"))
