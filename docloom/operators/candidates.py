"""What a page offers for download: links put onto the page's address, files among them, and images, as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Parts of the addresses of files, and of images that belong to a page's frame.
FILE_PARTS = [".pdf", "getmedia", "download"]
FRAME_PARTS = ["logo", "icon", "sprite", "button", "spacer", "blank", "pixel", "avatar", "badge"]
ANCHOR = r"""(?is)<a\b(?=[^>]*\bhref\s*=)[^>]*>.*?(?:</a\s*>|$)"""
SCHEME = r"^[a-zA-Z][a-zA-Z0-9+.\-]*:"


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, quoted either way, without entities; empty if it has none."""
    found = [F.regexp_extract(tag, rf"(?is)^<[^>]*?\s{name}\s*=\s*{q}([^{q}]*){q}", 1) for q in "\"'"]
    return unescaped(F.when(found[0] != "", found[0]).otherwise(found[1]))


def unescaped(c: Column) -> Column:
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def joined(base: Column, ref: Column) -> Column:
    """The address that ref means on the page at base: relative paths, dots, queries and fragments as in RFC 3986. Null if either is null."""
    whole, origin = F.regexp_replace(base, r"(?s)#.*$", ""), F.regexp_extract(base, SCHEME + r"//[^/?#]*", 0)
    path = F.regexp_extract(base, SCHEME + r"//[^/?#]*([^?#]*)", 1)
    tail, own = F.regexp_extract(ref, r"(?s)[?#].*$", 0), F.regexp_replace(ref, r"(?s)[?#].*$", "")
    folder, steps = F.split(path, "/"), F.split(own, "/")
    near = F.concat(F.filter(F.concat(F.slice(folder, 1, F.size(folder) - 1), F.slice(steps, 1, F.size(steps) - 1)), lambda x: x != ""), F.slice(steps, -1, 1))
    parts = F.when(own.startswith("/"), F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0)))).otherwise(near)
    back = lambda a: F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))
    walked = F.aggregate(parts, F.array().cast("array<string>"), lambda a, x: F.when(x == "..", back(a)).when(x == ".", a).otherwise(F.concat(a, F.array(x))))
    walked = F.concat(walked, F.when(F.element_at(parts, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    return (
        F.when(ref == "", base)
        .when(ref.rlike(SCHEME), ref)
        .when(ref.startswith("//"), F.concat(F.regexp_extract(base, SCHEME, 0), ref))
        .when(ref.startswith("#"), F.concat(whole, ref))
        .when(ref.startswith("?"), F.concat(origin, F.when(path == "", "").otherwise(path), ref))
        .otherwise(F.concat(origin, F.lit("/"), F.array_join(walked, "/"), tail))
    )


def anchors(pages: DataFrame, key: str, url: str = "url", html: str = "html", longest: int = 120) -> DataFrame:
    """key, place (from 0), url, text: every link of a page in order, its text cut at so many characters.

    Anchors with an empty address are left out but keep their place. Null pages have
    none; where url is null, or isn't an address, addresses stay as they are written.
    """
    found = pages.select(key, F.col(url).alias("__base"), F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR), 0)).alias("place", "__tag"))
    text = unescaped(F.regexp_replace("__tag", r"(?s)<[^>]*>", ""))
    return _addressed(found.select(key, "__base", "place", attribute(F.col("__tag"), "href").alias("__ref"), F.substring(F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), 1, longest).alias("text"))).select(key, "place", "url", "text")


def _addressed(found: DataFrame) -> DataFrame:
    based = F.col("__base").rlike(SCHEME + "//")
    return found.withColumn("__ref", F.trim("__ref")).filter("__ref <> ''").withColumn("url", F.when(based, joined(F.col("__base"), F.col("__ref"))).otherwise(F.col("__ref")))


def files(links: DataFrame, key: str, most: int = 20) -> DataFrame:
    """The first links of each page whose address looks like a file's, at most so many; rank from 1."""
    return _first(links.filter(F.lower("url").rlike("|".join(map(re.escape, FILE_PARTS)))), key, most)


def _first(rows: DataFrame, key: str, most: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("place"))).filter(F.col("rank") <= most)


def images(pages: DataFrame, key: str, url: str = "url", html: str = "html", least: int = 50, most: int = 20) -> DataFrame:
    """key, place, url, alt, rank: the first images of each page, each address once, at most so many.

    Left out: data addresses, images of which both sides are known and one is under
    `least`, and those whose address names a part of a page's frame. A source may
    stand in data-src. Null pages have none.
    """
    found = pages.select(key, F.col(url).alias("__base"), F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<img\b[^>]*>"), 0)).alias("place", "__tag"))
    tag = F.col("__tag")
    side = lambda name: F.coalesce(F.regexp_extract(attribute(tag, name), r"^\s*(\d{1,9})", 1).try_cast("int"), F.lit(0))
    src = F.trim(attribute(tag, "src"))
    rows = found.select(key, "__base", "place", F.when(src != "", src).otherwise(attribute(tag, "data-src")).alias("__ref"), F.trim(attribute(tag, "alt")).alias("alt"), side("width").alias("w"), side("height").alias("h"))
    rows = rows.filter(~F.col("__ref").startswith("data:") & ~((F.col("w") > 0) & (F.col("h") > 0) & (F.least("w", "h") < least)))
    rows = _addressed(rows).filter(~F.lower("url").rlike("|".join(FRAME_PARTS)))
    once = rows.groupBy(key, "url").agg(F.min(F.struct("place", "alt")).alias("__first")).select(key, "__first.place", "url", "__first.alt")
    return _first(once, key, most)
