"""Queries over pages as trees, and SQL that walks the same trees token by token."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.functions import text
from docloom.operators import assembly, dom, pages
from docloom.plans.registry import long, query

RE_TOKEN = dom.TOKEN.replace("++", "+").replace("*+", "*")
HAS = "regexp_extract(tok, '(?i)\\s{}\\s*=\\s*\"([^\"]*)\"', 1)"
STRIPPED = r"regexp_replace(regexp_replace({}, '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '')"


def listed(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tree_sql(junk: str) -> str:
    """Tables: node (page_id, place, end_at, parent, grand, name, classes, prop, role, text) without what lies in junk, and el (elements with measures)."""
    plain = "tok"
    for entity, char in (("&nbsp;", "chr(160)"), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&amp;", "'&'")):
        plain = f"replace({plain}, '{entity}', {char})"
    return f"""
WITH RECURSIVE token AS (
  SELECT page_id, len(ts) AS n, unnest(range(1, len(ts) + 1)) AS i, unnest(ts) AS tok
  FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '{RE_TOKEN.replace("'", "''")}') AS ts FROM pages)
), read AS (
  SELECT page_id, n, i, tok, lower(regexp_extract(tok, '^</?([a-zA-Z][^\\s/>]*)', 1)) AS name, starts_with(tok, '</') AS closes FROM token
), told AS (
  SELECT *, name <> '' AND NOT closes AND name NOT IN ({listed(dom.VOID + ["script", "style"])}) AND NOT suffix(tok, '/>') AS opens FROM read
), walk AS (
  SELECT page_id, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(place BIGINT, name VARCHAR)[]) AS stack, CAST([] AS STRUCT(place BIGINT, name VARCHAR)[]) AS closed, CAST(0 AS BIGINT) AS parent, CAST(-1 AS BIGINT) AS grand FROM pages
  UNION ALL
  SELECT page_id, i,
         CASE WHEN opens THEN list_append(stack, {{'place': i, 'name': name}}) WHEN k > 0 THEN stack[1:k - 1] ELSE stack END,
         CASE WHEN k > 0 THEN stack[k:] ELSE CAST([] AS STRUCT(place BIGINT, name VARCHAR)[]) END,
         coalesce(stack[-1].place, 0), CASE WHEN len(stack) = 0 THEN -1 ELSE coalesce(stack[-2].place, 0) END
  FROM (
    SELECT w.page_id, t.i, t.opens, t.name, w.stack,
           CASE WHEN t.closes THEN coalesce(len(w.stack) + 1 - list_position(list_reverse(list_transform(w.stack, lambda s: s.name)), t.name), 0) ELSE 0 END AS k
    FROM walk w JOIN told t ON w.page_id = t.page_id AND t.i = w.i + 1)
), ended AS (
  SELECT page_id, unnest(closed).place AS place, i AS end_at FROM walk
), every AS (
  SELECT page_id, CAST(0 AS BIGINT) AS place, coalesce(max(n), 0) + 1 AS end_at, CAST(-1 AS BIGINT) AS parent, CAST(-1 AS BIGINT) AS grand, '' AS name, '' AS label, '' AS classes, '' AS style, '' AS prop, '' AS role, CAST(NULL AS VARCHAR) AS text
  FROM pages LEFT JOIN token USING (page_id) GROUP BY page_id
  UNION ALL
  SELECT t.page_id, t.i, CASE WHEN opens THEN coalesce(e.end_at, n + 1) ELSE t.i + 1 END, w.parent, w.grand, name,
         trim(lower({HAS.format("id")} || ' ' || {HAS.format("class")})), {HAS.format("class")}, lower({HAS.format("style")}), {HAS.format("itemprop")}, {HAS.format("role")}, NULL
  FROM told t JOIN walk w ON w.page_id = t.page_id AND w.i = t.i LEFT JOIN ended e ON e.page_id = t.page_id AND e.place = t.i
  WHERE name <> '' AND NOT closes
  UNION ALL
  SELECT page_id, i, i + 1, 0, -1, NULL, NULL, NULL, NULL, NULL, NULL, {STRIPPED.format(plain)} FROM told WHERE NOT starts_with(tok, '<')
), node AS (
  SELECT * FROM (SELECT *, coalesce(max(CASE WHEN {junk} THEN end_at END) OVER (PARTITION BY page_id ORDER BY place), 0) AS ends FROM every) WHERE place >= ends AND coalesce(text, 'x') <> ''
), own AS (
  SELECT e.page_id, e.place, any_value(e.end_at) AS end_at, any_value(e.parent) AS parent, any_value(e.grand) AS grand, any_value(e.name) AS name, any_value(e.classes) AS classes, any_value(e.prop) AS prop, any_value(e.role) AS role,
         coalesce(sum(length(x.text)), 0) AS bare, coalesce(sum(length(x.text)), 0) + greatest(count(x.text) - 1, 0) AS chars, count(*) FILTER (WHERE x.name IN ({listed(dom.BLOCKS)})) AS blocks
  FROM node e LEFT JOIN node x ON x.page_id = e.page_id AND x.place > e.place AND x.place < e.end_at WHERE e.name IS NOT NULL GROUP BY 1, 2
), el AS (
  SELECT o.*, coalesce(link_chars, 0) AS link_chars, coalesce(link_text, 0) AS link_text FROM own o LEFT JOIN (
    SELECT e.page_id, e.place, sum(a.bare) AS link_chars, sum(a.chars) AS link_text FROM own e JOIN own a ON a.page_id = e.page_id AND a.place > e.place AND a.place < e.end_at AND a.name = 'a' GROUP BY 1, 2) USING (page_id, place)
)"""


def article_sql() -> str:
    kinds = ["name = 'article'", "prop = 'articleBody'", *[f"list_contains(string_split(classes, ' '), '{c}')" for c in dom.ARTICLE_CLASSES]]
    firsts = " UNION ALL ".join(f"SELECT page_id, {k} AS k, arg_min(place, place) AS place, arg_min(end_at, place) AS end_at, arg_min(chars, place) AS chars FROM el WHERE {w} GROUP BY page_id" for k, w in enumerate(kinds))
    return f""", article AS (
  SELECT page_id, arg_min(place, k) AS place, arg_min(end_at, k) AS end_at FROM ({firsts}) WHERE chars > 300 GROUP BY page_id
), gives AS (
  SELECT * FROM el WHERE name IN ({listed(dom.SCORED)}) AND chars >= 30 AND link_chars / chars <= 0.4
), scored AS (
  SELECT page_id, place, sum(s) AS s, min(o) AS o FROM (SELECT page_id, parent AS place, chars AS s, place * 2 AS o FROM gives UNION ALL SELECT page_id, grand, chars * 0.5, place * 2 + 1 FROM gives) WHERE place >= 0 GROUP BY 1, 2
), best AS (
  SELECT s.page_id, s.place, e.end_at FROM scored s JOIN el e ON e.page_id = s.page_id AND e.place = s.place QUALIFY row_number() OVER (PARTITION BY s.page_id ORDER BY s.s DESC, s.o) = 1
), body AS (
  SELECT page_id, min(place) AS place, arg_min(end_at, place) AS end_at FROM el WHERE name = 'body' GROUP BY 1
), chosen AS (
  SELECT p.page_id, coalesce(a.place, b.place, c.place, p.place) AS place, coalesce(a.end_at, b.end_at, c.end_at, p.end_at) AS end_at
  FROM el p LEFT JOIN article a ON a.page_id = p.page_id LEFT JOIN best b ON b.page_id = p.page_id LEFT JOIN body c ON c.page_id = p.page_id WHERE p.place = 0
)"""


def dense_sql() -> str:
    first = "(name IN ('article', 'main') OR role = 'main')"
    return f""", dense AS (
  SELECT *, {first} AS f, least(least(link_text, chars) / greatest(chars, 1), 0.95) AS share, least(link_text, chars) / greatest(chars, 1) > 0.55 AS linked FROM el WHERE ({first} OR name IN ('section', 'div')) AND chars >= 400
), best AS (
  SELECT page_id, place, end_at FROM dense QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY (chars - least(link_text, chars)) * (1 - share) * (1 + least(blocks, 60) / 12) * CASE WHEN linked THEN 0.25 ELSE 1 END DESC, f DESC, place) = 1
), rest AS (
  SELECT page_id, place, end_at FROM el WHERE name IN ('article', 'main', 'body', '') QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY list_position(['article', 'main', 'body', ''], name), place) = 1
), chosen AS (
  SELECT r.page_id, coalesce(b.place, r.place) AS place, coalesce(b.end_at, r.end_at) AS end_at FROM rest r LEFT JOIN best b USING (page_id)
)"""


def lines_sql() -> str:
    holds = lambda words: "(" + " OR ".join(f"contains(lower(x), '{w}')" for w in words) + ")"
    return f""", line AS (
  SELECT page_id, i, {STRIPPED.format("x")} AS x FROM (
    SELECT page_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS x FROM (
      SELECT c.page_id, string_split(regexp_replace(nfc_normalize(string_agg(n.text, chr(10) ORDER BY n.place)), '[^\\S\\n]+', ' ', 'g'), chr(10)) AS ls
      FROM chosen c JOIN node n ON n.page_id = c.page_id AND n.text IS NOT NULL AND n.place > c.place AND n.place < c.end_at GROUP BY c.page_id))
), once AS (
  SELECT page_id, i, x FROM line WHERE length(x) >= 3 QUALIFY row_number() OVER (PARTITION BY page_id, lower(regexp_replace(x, '[\\s\\p{{Z}}]+', ' ', 'g')) ORDER BY i) = 1
), kept AS (
  SELECT *, sum(length(x)) OVER (PARTITION BY page_id ORDER BY i) AS so_far FROM once
  WHERE NOT (length(x) < 40 AND {holds(pages.SKIPPED_LINES)}) AND NOT (length(x) < 10 AND NOT contains(x, ' ') AND NOT regexp_matches(x, '[0-9]'))
), stops AS (
  SELECT o.page_id, min(o.i) AS i FROM once o JOIN (SELECT page_id, min(i) AS i FROM kept WHERE so_far > 300 GROUP BY 1) f ON f.page_id = o.page_id AND o.i > f.i
  WHERE length(x) < 60 AND {holds(pages.STOP_LINES)} GROUP BY 1
)
SELECT c.page_id, any_value(c.place) AS at, coalesce(string_agg(k.x, chr(10) ORDER BY k.i), '') AS text
FROM chosen c LEFT JOIN kept k ON k.page_id = c.page_id AND k.i < coalesce((SELECT s.i FROM stops s WHERE s.page_id = c.page_id), 1000000000)
GROUP BY c.page_id"""


ARTICLE_JUNK = f"name IN ({listed(dom.JUNK_TAGS)}) OR regexp_matches(label, '{'|'.join(dom.JUNK_NAMES)}') OR " + " OR ".join(f"contains(style, '{h}')" for h in dom.HIDDEN)
DENSE_JUNK = f"name IN ({listed(dom.DENSE_JUNK_TAGS)}) OR regexp_matches(label, '{'|'.join(dom.DENSE_JUNK_NAMES)}')"


@query(tree_sql(ARTICLE_JUNK) + article_sql() + lines_sql())
def main_text(t):
    return dom.main_texts(t("pages"), "page_id").withColumn("at", long("at"))


@query(tree_sql(DENSE_JUNK) + dense_sql() + lines_sql())
def main_text_dense(t):
    return dom.main_texts(t("pages"), "page_id", dense=True).withColumn("at", long("at"))


@query(tree_sql("false") + "\nSELECT page_id, name, count(*) AS n, CAST(sum(end_at - place) AS BIGINT) AS width, CAST(sum(chars) AS BIGINT) AS chars, CAST(sum(link_chars) AS BIGINT) AS link_chars, CAST(sum(blocks) AS BIGINT) AS blocks FROM el GROUP BY 1, 2")
def page_elements(t):
    found = dom.measured(dom.nodes(t("pages"), "page_id"), "page_id")
    return found.groupBy("page_id", "name").agg(F.count("*").alias("n"), long(F.sum(F.col("end") - F.col("at"))).alias("width"), *[long(F.sum(c)).alias(c) for c in ("chars", "link_chars", "blocks")])


@query("SELECT doc_id, md5(nfc_normalize(coalesce(text, ''))) AS digest FROM documents")
def nfkc_text(t):
    return t("documents").select("doc_id", F.md5(text.nfkc(F.coalesce("text", F.lit(""))).cast("binary")).alias("digest"))


# A page for each document: its text, a table in mark-up of part of its columns, and one in pipes of the others.
MADE = "coalesce(text, '') || chr(10) || 'Origin of the text' || chr(10) || '<table><tr><th rowspan=2>doc</th><th>lang</th></tr><tr><td>' || coalesce(lang, '') || '</td></tr></table>' || chr(10) || '| size | source |' || chr(10) || '|---|---|' || chr(10) || '| ' || coalesce(n_chars, 0) || ' | ' || coalesce(source, '') || ' |'"
LOOSE = r"regexp_replace(regexp_replace(l, '<[^>]+>', '', 'g'), '!\[[^\]]*\]\([^)]+\)', '', 'g')"


@query(f"""
WITH line AS (
  SELECT doc_id, i, {STRIPPED.format("l")} AS l FROM (
    SELECT doc_id, unnest(range(1, len(ls) + 1)) AS i, unnest(ls) AS l FROM (SELECT doc_id, string_split(coalesce(text, '') || chr(10) || 'Origin of the text' || chr(10), chr(10)) AS ls FROM documents))
), cleared AS (
  SELECT doc_id, i, l <> '' AS held, {STRIPPED.format(LOOSE)} AS x FROM line
), numbered AS (
  SELECT *, sum(CASE WHEN held AND x = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS block FROM cleared
), blocks AS (
  SELECT doc_id, block, string_agg(x, chr(10) ORDER BY i) AS text FROM numbered WHERE x <> '' GROUP BY 1, 2
), once AS (
  SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY block) AS n FROM (
    SELECT * FROM blocks QUALIFY row_number() OVER (PARTITION BY doc_id, regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g') ORDER BY block) = 1)
), parts AS (
  SELECT doc_id, n - 1 AS place, 'text' AS kind, NULL AS title, NULL AS headers, NULL AS cells, md5(text) AS digest FROM once
  UNION ALL SELECT doc_id, n, 'html_table', 'Origin of the text', 'doc|lang', 'doc|' || trim(coalesce(lang, '')), NULL FROM documents JOIN (SELECT doc_id, count(*) AS n FROM once GROUP BY 1) USING (doc_id)
  UNION ALL SELECT doc_id, n + 1, 'pipe_table', NULL, 'size|source', coalesce(n_chars, 0) || '|' || trim(coalesce(source, '')), NULL FROM documents JOIN (SELECT doc_id, count(*) AS n FROM once GROUP BY 1) USING (doc_id)
)
SELECT doc_id, CAST(place AS BIGINT) AS place, kind, title, headers, cells, digest FROM parts""")
def page_parts(t):
    made = t("documents").select("doc_id", F.lit(1).alias("page"), F.expr(MADE.replace("chr(10)", "'\n'")).alias("markdown"))
    parts = assembly.assembled(made, "doc_id", "page")
    flat = lambda c: F.array_join(c, "|")
    return parts.select("doc_id", long("place").alias("place"), "kind", "title", flat(F.col("headers")).alias("headers"), flat(F.flatten("rows")).alias("cells"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT page_id, CAST(len(regexp_extract_all(coalesce(html, ''), '(?i)<table[^>]*>')) AS BIGINT) AS n_tables FROM pages")
def page_tables(t):
    found = assembly.html_grids(dom.nodes(t("pages"), "page_id"), "page_id").groupBy("page_id").agg(F.count("*").alias("n"))
    return t("pages").select("page_id").join(found, "page_id", "left").select("page_id", F.coalesce("n", F.lit(0).cast("long")).alias("n_tables"))
