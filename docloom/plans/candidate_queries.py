"""Queries over what pages offer for download, and over messages of jobs, made from the rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import messages
from docloom.operators import candidates
from docloom.plans.registry import long, query

#: Added to each page before its own mark-up: links and images of every kind, from its number. In Spark's and DuckDB's SQL alike.
NUMBER = "CAST(page_id AS STRING)"
MADE_LINKS = f"""concat('<a class="x" href="../files/', {NUMBER}, '.PDF?v=1&amp;w=2"> Report <b>', {NUMBER}, '</b> &amp; notes</a><A HREF=''/getmedia/./', {NUMBER}, ''' >m</A><a href="">none</a><a name="top">no</a>',
  '<a href="https://cdn.example.org/download/a/../', {NUMBER}, '#p">d</a><a href="//cdn.example.org/x.pdf">s</a><a href="?q=download">q</a><a href="#end">e</a>', coalesce(html, ''))"""
MADE_IMAGES = f"""concat('<img src="/img/', {NUMBER}, '.png" alt=" first "><img src="a/logo.png"><img src="data:image/png;base64,AA"><img width="40" height="400" src="thin.png">',
  '<IMG data-src="pics/', {NUMBER}, '.jpg" width="640" height="480"><img src="/img/', {NUMBER}, '.png" alt="again"><img src="free.gif" width="10">', coalesce(html, ''))"""
ROOT = "regexp_extract(url, '^[a-z]+://[^/?#]*', 0)"
FOLDER = "regexp_extract(url, '^[a-z]+://[^/?#]*((/[^/?#]*)*/)', 1)"
UP = f"regexp_replace({FOLDER}, '[^/]+/$', '')"
BARE = "regexp_replace(url, '#.*$', '')"
PATH = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/?#]*', '')"
DUCK_NUMBER = NUMBER.replace("STRING", "VARCHAR")


@query(f"""
WITH made AS (SELECT page_id, url AS base, {MADE_LINKS.replace("STRING", "VARCHAR")} AS html, url FROM pages),
own AS (
  SELECT page_id, url, unnest(range(0, len(ts))) AS place, unnest(ts) AS tag
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<a\\s[^>]*href\\s*=[^>]*>.*?</a>') AS ts FROM made)
), put AS (
  SELECT page_id, place, CASE place
      WHEN 0 THEN {ROOT} || {UP} || 'files/' || {DUCK_NUMBER} || '.PDF?v=1&w=2'
      WHEN 1 THEN {ROOT} || '/getmedia/' || {DUCK_NUMBER}
      WHEN 3 THEN 'https://cdn.example.org/download/a/../' || {DUCK_NUMBER} || '#p'
      WHEN 4 THEN regexp_extract(url, '^[a-z]+:', 0) || '//cdn.example.org/x.pdf'
      WHEN 5 THEN {ROOT} || {PATH} || '?q=download'
      WHEN 6 THEN {BARE} || '#end'
      ELSE {ROOT} || regexp_extract(tag, 'href="([^"]*)"', 1) END AS url,
    CASE place WHEN 0 THEN 'Report ' || {DUCK_NUMBER} || ' & notes' WHEN 1 THEN 'm'
      ELSE left(trim(replace(regexp_extract(tag, '(?is)^<a[^>]*>(.*)</a>', 1), '&amp;', '&')), 120) END AS text
  FROM own WHERE place <> 2
), file AS (
  SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) AS k FROM put WHERE lower(url) LIKE '%.pdf%' OR lower(url) LIKE '%getmedia%' OR lower(url) LIKE '%download%'
)
SELECT page_id, CAST(put.place AS BIGINT) AS place, put.url, put.text, CAST(coalesce(file.k, 0) AS BIGINT) AS file_rank
FROM put LEFT JOIN file USING (page_id, place)""")
def link_candidates(t):
    made = t("pages").select("page_id", "url", F.expr(MADE_LINKS).alias("html"))
    links = candidates.anchors(made, "page_id")
    files = candidates.files(links, "page_id").select("page_id", "place", long("rank").alias("file_rank"))
    return links.join(files, ["page_id", "place"], "left").select("page_id", long("place").alias("place"), "url", "text", F.coalesce("file_rank", F.lit(0).cast("long")).alias("file_rank"))


@query(f"""
SELECT page_id, CAST(place AS BIGINT) AS place, {ROOT} || CASE place
    WHEN 0 THEN '/img/' || {DUCK_NUMBER} || '.png' WHEN 4 THEN {FOLDER} || 'pics/' || {DUCK_NUMBER} || '.jpg' ELSE {FOLDER} || 'free.gif' END AS url,
  CASE place WHEN 0 THEN 'first' ELSE '' END AS alt, CAST(CASE place WHEN 0 THEN 1 WHEN 4 THEN 2 ELSE 3 END AS BIGINT) AS rank
FROM pages CROSS JOIN (VALUES (0), (4), (6)) AS v(place)""")
def image_candidates(t):
    made = t("pages").select("page_id", "url", F.expr(MADE_IMAGES).alias("html"))
    return candidates.images(made, "page_id").select("page_id", long("place").alias("place"), "url", "alt", long("rank").alias("rank"))


DOC = "CAST(doc_id AS STRING)"
ERRORS = [f"concat('OCR stopped at Page ', {DOC}, ':  Request timed out')", "'no number, 500 Internal Server Error'", "concat('page 7 of ', coalesce(source, ''), ' ', coalesce(lang, ''), ' answered 500 Internal Server Error')", f"concat('on PAGE  nine of ', {DOC}, ' page 12: ', repeat('odd \t words ', 40))"]
REASON = "left(concat('on PAGE nine of ', " + DOC.replace("STRING", "VARCHAR") + ", ' page 12: ', repeat('odd words ', 40)), 220)"


@query(f"""
SELECT doc_id, 'Partial OCR warnings: Failed pages: ' || d || ', 7, 12 | Failed page reasons: ' || d || '=Typhoon OCR timeout (408); 7=Upstream service returned 500; 12=' || {REASON} AS warning,
  concat_ws(',', d, '7', '12') AS failed_pages, CASE doc_id WHEN 12 THEN trim({REASON}) WHEN 7 THEN 'Upstream service returned 500' ELSE 'Typhoon OCR timeout (408)' END AS first_reason, trim({REASON}) AS last_reason, 'หน้า ' || d || '/99' AS progress_text
FROM (SELECT doc_id, CAST(doc_id AS VARCHAR) AS d FROM documents)""")
def warning_messages(t):
    rows = t("documents").select("doc_id", messages.warning(F.array(*[F.expr(e) for e in ERRORS])).alias("warning"))
    told = messages.told(F.concat(F.lit("Processing page "), F.col("doc_id").cast("string"), F.lit("/99 "), F.col("warning")))
    rows = rows.withColumn("told", told)
    first = F.col("told.failed_page_reasons")[F.col("doc_id")]
    return rows.select("doc_id", "warning", F.array_join("told.failed_pages", ",").alias("failed_pages"), first.alias("first_reason"), F.col("told.failed_page_reasons")[F.lit(12).cast("long")].alias("last_reason"), "told.progress_text")
