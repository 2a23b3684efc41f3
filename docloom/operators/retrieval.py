"""Search and routing: exact vectors, keywords, both merged, question routing, graphs, chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import numeric, text

# Words that tell which tool answers a question, with their weights.
ROUTES = {
    "sql_query": {
        "เท่าไร": 3, "เท่าไหร่": 3, "กี่": 3, "จำนวน": 2, "อัตรา": 2, "ร้อยละ": 2, "สูงสุด": 3, "ต่ำสุด": 3, "มากที่สุด": 3, "น้อยที่สุด": 3, "อันดับ": 3,
        "เพิ่มขึ้น": 2, "ลดลง": 2, "เปรียบเทียบ": 2, "รวมกัน": 2, "roa": 4, "roe": 4, "npl": 4, "eps": 4, "สินทรัพย์": 3, "หนี้สิน": 3, "กำไร": 3, "ขาดทุน": 3,
        "รายได้": 3, "เงินกองทุน": 3, "งบการเงิน": 3, "ทุนจดทะเบียน": 3, "ทุนชำระ": 3, "จำนวนหุ้น": 4, "ถือหุ้น": 3, "สัดส่วน": 3, "ลงทุน": 3, "ประเภทธุรกิจ": 3,
        "บริษัทใด": 3, "บริษัทอะไร": 3, "บริษัทใดบ้าง": 3, "กี่บริษัท": 4,
    },
    "vector_search": {
        "นโยบาย": 3, "กลยุทธ์": 3, "มาตรการ": 3, "โครงการ": 3, "แนวทาง": 2, "esg": 4, "ความยั่งยืน": 3, "วิสัยทัศน์": 3, "พันธกิจ": 3, "บทบาท": 2, "หน้าที่": 2,
        "อธิบาย": 2, "สาเหตุ": 2, "ทำไม": 2, "เพราะเหตุใด": 3, "อย่างไร": 2, "ปัจจัยความเสี่ยง": 3, "ความเสี่ยง": 2, "รางวัล": 2, "หลักการ": 2, "แผนงาน": 2, "การกำกับดูแล": 2,
    },
    "graph_search": {
        "ความสัมพันธ์ระหว่าง": 5, "ความสัมพันธ์": 3, "เชื่อมโยง": 3, "ใครเป็นเจ้าของ": 5, "เป็นเจ้าของ": 3, "โครงสร้างผู้ถือหุ้น": 4, "โครงสร้างการถือหุ้น": 4,
        "บริษัทในเครือ": 3, "กลุ่มบริษัท": 2, "ดำรงตำแหน่ง": 3, "เป็นกรรมการใน": 4, "นั่งเป็นกรรมการ": 4,
    },
    "tavily_search": {"ข่าว": 3, "ล่าสุด": 2, "ปัจจุบัน": 1, "ค้นอินเทอร์เน็ต": 5, "ค้นเว็บ": 5, "ค้นหาในเว็บ": 5, "ราคาหุ้นวันนี้": 5},
}
# What kinds of chunks lose in similarity and in keyword score.
SIMILARITY_LOSS = {"raw_ocr_page": 0.08, "raw_ocr_table": 0.03}
KEYWORD_LOSS = {"raw_ocr_page": 20.0, "raw_ocr_table": 8.0}


def weighted(c: Column, words: dict[str, int]) -> Column:
    """The summed weights of the words that c holds."""
    return reduce(lambda a, b: a + b, [F.when(c.contains(w), F.lit(n)).otherwise(F.lit(0)) for w, n in words.items()])


def routed(questions: DataFrame, question: str, routes: dict[str, dict[str, int]] = ROUTES) -> DataFrame:
    """questions with a score for each tool, suggested_tool and confidence; of equal scores the first tool wins."""
    lower, names = F.lower(F.coalesce(F.col(question), F.lit(""))), list(routes)
    year = F.when(F.coalesce(F.col(question), F.lit("")).rlike(text.YEAR_IN_TEXT), 2).otherwise(0)
    out = questions.withColumns({f"score_{n}": weighted(lower, w) + (year if n == names[0] else F.lit(0)) for n, w in routes.items()})
    scores = [F.col(f"score_{n}") for n in names]
    best, both = F.greatest(*scores), (scores[0] >= 4) & (scores[1] >= 4)
    tool = reduce(lambda c, i: c.when(scores[i] == best, names[i]), range(1, len(names)), F.when(scores[0] == best, names[0]))
    margin = best - F.element_at(F.sort_array(F.array(*scores), asc=False), 2)
    sure = F.when((best >= 5) & (margin >= 3), "high").when(best >= 3, "medium").otherwise("low")
    return out.withColumn("suggested_tool", F.when(both, "multi_hop").when(best > 0, tool)).withColumn("confidence", F.when(both, "high").when(best > 0, sure).otherwise("low"))


def loss(kind: Column, losses: dict[str, float]) -> Column:
    return reduce(lambda c, k: c.when(kind == k, F.lit(losses[k])), losses, F.when(F.lit(False), 0.0)).otherwise(0.0)


def nearest(chunks: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "chunk_id", kind: Column | None = None) -> DataFrame:
    """The k chunks of least cosine distance, with similarity; exact, ties by key. Each task keeps k rows."""
    found = chunks.withColumn("similarity", numeric.cosine_similarity(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))).filter(F.col("similarity").isNotNull())
    best = found.orderBy(F.desc("similarity"), key).limit(k)
    return best.withColumn("similarity", F.col("similarity") - loss(kind, SIMILARITY_LOSS)) if kind is not None else best


PUNCTUATION = " \n\r\t,:;(){}[]\"'`“”‘’%-_/"


def keyword_scored(chunks: DataFrame, question: str, terms: list[str], body: str, kind: Column | None = None) -> DataFrame:
    """chunks that hold a term, with score above nought.

    A term counts as it stands and once more with punctuation taken out; a chunk
    must hold one of the acronyms, if there are any, and one of the terms that
    aren't years. Cheap tests come first, and texts are folded once.
    """
    is_year = lambda t: len(t) == 4 and t.isdigit() and t[:2] in ("25", "20")
    acronym = lambda t: t.isascii() and t.isalpha() and t.isupper() and 2 <= len(t) <= 6
    squeeze = lambda t: "".join(c for c in t.lower() if c not in PUNCTUATION)
    found = chunks.filter(reduce(lambda a, b: a | b, [F.lower(F.col(body)).contains(t.lower()) for t in terms], F.lit(False)))
    found = found.withColumn("__plain", F.lower(body)).withColumn("__bare", text.normalize_lookup(F.col(body)))
    has = lambda t: (F.col("__plain").contains(t.lower()), F.col("__bare").contains(squeeze(t)) if squeeze(t) else F.lit(False))
    total = F.lit(0.0)
    for t in terms:
        for there, few, each in zip(has(t), (4.0, 3.0), (4, 3), strict=True):
            total = total + F.when(there, few if is_year(t) else float(max(8, each * len(t)))).otherwise(0.0)
    if start := squeeze(question)[:60]:
        total = total + F.when(F.col("__bare").contains(start), 40.0).otherwise(0.0)
    if "ssf" in [t.lower() for t in terms]:
        total = total + F.when(F.col("__plain").contains("ssf"), 120.0).otherwise(0.0)
    for year in years_of(question):
        total = total + F.when(F.col(body).contains(year), 10.0).otherwise(0.0)
    gate = F.lit(True)
    for group in ([t for t in terms if acronym(t)], [t for t in terms if not is_year(t)]):
        if group:
            gate = gate & reduce(lambda a, b: a | b, [x for t in group for x in has(t)])
    score = total - loss(kind, KEYWORD_LOSS) if kind is not None else total
    return found.withColumn("score", F.when(gate, score).otherwise(0.0)).filter("score > 0").drop("__plain", "__bare")


def years_of(question: str) -> list[str]:
    """Years that stand in a question, as often as they do."""
    import re

    return re.findall(r"(?<!\w)(?:25|20)\d{2}(?!\w)", question)


def merged(lists: list[DataFrame], key: str, k: int) -> DataFrame:
    """The first k rows of ranked lists put one after another, each key once; lists have key, rank and the same columns."""
    every = reduce(DataFrame.unionByName, [x.withColumn("__list", F.lit(i)) for i, x in enumerate(lists)])
    once = every.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy("__list", "rank"))).filter("__n = 1").drop("__n")
    return once.orderBy("__list", "rank").limit(k).drop("__list")


def hybrid(chunks: DataFrame, question: str, terms: list[str], query: list[float], k: int = 5, key: str = "chunk_id", body: str = "chunk_text", vector: str = "embedding", kind: str | None = None, most: int = 200, keep: tuple = ()) -> DataFrame:
    """Keyword hits first, then the nearest by meaning, each chunk once: key, rank, similarity, method, source_kind, body and the columns in keep.

    Kinds of chunks that lose are ranked lower among keyword hits; by meaning their
    rank is that of their distance, and only the similarity shown is less. A missing
    kind is semantic. Of chunks that hold a term the `most` first by key are scored.
    """
    named = chunks.withColumn("source_kind", F.coalesce(F.col(kind), F.lit("semantic")) if kind else F.lit("semantic"))
    any_term = reduce(lambda a, b: a | b, [F.lower(F.col(body)).contains(t.lower()) for t in terms], F.lit(False))
    hits = keyword_scored(named.filter(any_term).orderBy(key).limit(most), question, terms, body, F.col("source_kind"))
    ranked = lambda df, *by: df.withColumn("rank", F.row_number().over(W.orderBy(*by)))  # noqa: E731  few rows
    shown = [key, "rank", "similarity", "method", "source_kind", body, *keep]
    first = ranked(hits, F.desc("score"), key).withColumn("similarity", F.least(F.lit(0.999), F.col("score") / 200)).withColumn("method", F.lit("keyword")).select(*shown)
    near = nearest(named.filter(F.col(vector).isNotNull()), query, max(3 * k, 15), vector, key)
    second = ranked(near, F.desc("similarity"), key).withColumn("method", F.lit("semantic")).withColumn("similarity", F.col("similarity") - loss(F.col("source_kind"), SIMILARITY_LOSS)).select(*shown)
    return merged([first, second], key, k)


def neighbours(chunks: DataFrame, group: str, order: str, vector: str = "embedding") -> DataFrame:
    """chunks with similarity to the chunk before and after in its group; null at the ends."""
    by = W.partitionBy(group).orderBy(order)
    near = lambda other: numeric.cosine_similarity(F.col(vector), other, 1e-10)
    sides = chunks.withColumn("__before", F.lag(vector).over(by)).withColumn("__after", F.lead(vector).over(by))
    return sides.withColumn("similarity_before", near(F.col("__before"))).withColumn("similarity_after", near(F.col("__after"))).drop("__before", "__after")


def breaks(sentences: DataFrame, group: str, order: str, vector: str = "embedding", strength: float = 0.5) -> DataFrame:
    """sentences with distance to the next one of their group (null at the end) and breaks: whether it exceeds the group's mean and so many deviations."""
    by, every = W.partitionBy(group).orderBy(order), W.partitionBy(group)
    far = 1 - numeric.cosine_similarity(F.col(vector), F.lead(vector).over(by), 1e-10)
    out = sentences.withColumn("distance", F.when(F.lead(vector).over(by).isNotNull(), far))
    limit = F.avg("distance").over(every) + F.stddev_pop("distance").over(every) * strength
    return out.withColumn("breaks", F.coalesce(F.col("distance") > limit, F.lit(False)))


def packed(pieces: Column, least: int = 100, most: int = 2000) -> Column:
    """Sentences packed into chunks in order, joined by blanks.

    pieces: array of struct(text, breaks); breaks says that the next sentence is far
    in meaning. A chunk ends there if it has `least` characters, and wherever the
    next sentence would take it over `most`.
    """
    ends = lambda a, p: (a["n"] > 0) & ((a["breaks"] & (a["size"] >= least)) | (a["size"] + F.length(p["text"]) > most))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("size"), F.lit(False).alias("breaks"), F.array().cast("array<int>").alias("cuts"))
    step = lambda a, p: F.struct(
        (a["n"] + 1).alias("n"), (F.when(ends(a, p), 0).otherwise(a["size"]) + F.length(p["text"])).alias("size"), p["breaks"].alias("breaks"),
        F.when(ends(a, p) | (a["n"] == 0), F.array_append(a["cuts"], a["n"])).otherwise(a["cuts"]).alias("cuts"),
    )

    def chunks(all_):
        cuts = F.aggregate(all_, start, step, lambda a: F.array_append(a["cuts"], a["n"]))
        part = lambda c, i: F.array_join(F.transform(F.slice(all_, F.get(c, i) + 1, F.get(c, i + 1) - F.get(c, i)), lambda p: p["text"]), " ")
        return text.bound(cuts, lambda c: F.transform(F.slice(c, F.lit(1), F.size(c) - 1), lambda _, i: part(c, i)))

    return F.when(F.size(pieces) > 0, text.bound(pieces, chunks)).otherwise(F.array().cast("array<string>"))


def semantic_chunks(sentences: DataFrame, group: str, order: str, body: str = "text", vector: str = "embedding", strength: float = 0.5, least: int = 100, most: int = 2000) -> DataFrame:
    """group, chunk_index, chunk_text, token_count, start_char, end_char: sentences with vectors cut where meaning turns.

    Places are of the chunks laid out with one character between them. A group's
    sentences meet in one row: it is a document.
    """
    cut = breaks(sentences, group, order, vector, strength)
    pieces = cut.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("text"), "breaks"))).alias("__p"))
    chunks = pieces.select(group, F.posexplode(packed(F.transform("__p", lambda p: F.struct(p["text"].alias("text"), p["breaks"].alias("breaks"))), least, most)).alias("chunk_index", "chunk_text"))
    before = W.partitionBy(group).orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(F.length("chunk_text") + 1).over(before), F.lit(0))
    return chunks.select(group, "chunk_index", "chunk_text", text.token_count(F.col("chunk_text")).alias("token_count"), begin.alias("start_char"), (begin + F.length("chunk_text")).alias("end_char"))


def embeddable(body: Column, kind: Column, most: int = 8000) -> Column:
    """Whether a chunk gets a vector: raw pages and tables of more characters don't."""
    return ~(F.coalesce(kind, F.lit("semantic")).isin("raw_ocr_page", "raw_ocr_table") & (F.length(body) > most))


def table_for(questions: DataFrame, names: DataFrame, question: str = "question", name: str = "table_name", limit: int = 10_000) -> DataFrame:
    """questions with table_name and overlap: the table whose name shares most characters with the question, 60 % at least; of equal ones the first by name.

    Each character of a name counts once as often as it stands there, and twice its
    length more if one holds the other. Names are few: they are sent to every task
    once their number is known to be at most `limit`; more are an error.
    """
    squeezed = lambda c, rx: F.regexp_replace(F.coalesce(c, F.lit("")), rx, "")
    known = [r[0] for r in names.select(name).filter(F.coalesce(F.col(name), F.lit("")) != "").distinct().limit(limit + 1).collect()]
    if len(known) > limit:
        raise ValueError(f"more than {limit} table names can't be tried on each question")
    own = questions.withColumn("__q", squeezed(F.col(question), r"(?U)[?？\s]+"))
    bare = lambda n: "".join(c for c in n if c != "_" and not c.isspace())
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(bare(n)).alias("bare")) for n in sorted(known)]) if known else F.array().cast("array<struct<name:string,bare:string>>")
    shared = lambda t: F.size(F.filter(F.split(t["bare"], ""), lambda ch: (ch != "") & F.col("__q").contains(ch)))
    held = lambda t: F.col("__q").contains(t["bare"]) | F.contains(t["bare"], F.col("__q"))
    scored = F.transform(rows, lambda t: F.struct((shared(t) + F.when(held(t), 2 * F.length(t["bare"])).otherwise(0)).alias("score"), t["name"].alias("name"), F.length(t["bare"]).alias("n")))
    fit = F.filter(scored, lambda s: s["score"] >= s["n"] * 0.6)
    best = F.get(F.array_sort(fit, lambda a, b: F.when(a["score"] != b["score"], b["score"] - a["score"]).when(a["name"] < b["name"], -1).otherwise(1)), F.lit(0))
    return own.withColumn("__best", best).withColumn(name, F.col("__best.name")).withColumn("overlap", F.col("__best.score")).drop("__q", "__best")


def asked_rows(question: Column) -> Column:
    """How many rows a question asks for, as a number before a word for places or rows, or null."""
    return F.nullif(F.regexp_extract(question, r"([0-9]+)\s*(?:อันดับ|ลำดับ|รายการ|แรก|ตัว|บริษัท)", 1), F.lit("")).cast("int")


def schema_description(facts: DataFrame, attributes: DataFrame) -> DataFrame:
    """section, item, n: what a warehouse holds, for whoever writes queries: its twenty largest tables of both kinds, labels, years, attributes."""
    top = lambda df, section, c, most: df.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias("item")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "item").limit(most).select(F.lit(section).alias("section"), "item", "n")
    some = lambda df, section, c, most: df.select(F.col(c).alias("item")).filter("item IS NOT NULL").distinct().orderBy("item").limit(most).select(F.lit(section).alias("section"), "item", F.lit(None).cast("long").alias("n"))
    columns = attributes.filter(~F.col("col_name").like("column_%") & F.length("col_name").between(2, 40))
    parts = [
        top(facts, "fact tables", "table_name", 20), top(attributes, "lookup tables", "table_name", 20), some(facts, "labels", "row_label", 30), some(facts, "years", "metric_year", 1 << 30),
        some(attributes, "attributes", "col_name", 20), some(attributes, "lookup labels", "row_label", 20), top(columns, "wide columns", "col_name", 30),
    ]
    return reduce(DataFrame.unionByName, parts)


def contexts(observations: Column, sources: Column) -> Column:
    """What an answer drew on: observations, then sources' texts, each once and none blank."""
    own = F.filter(F.transform(observations, numeric.strip), lambda x: x != "")
    all_ = F.array_distinct(F.concat(own, F.filter(sources, lambda x: F.coalesce(x, F.lit("")) != "")))
    return F.when(F.size(all_) > 0, all_).otherwise(F.array(F.lit("No context used.")))


def graph_status(documents: DataFrame, files: DataFrame, document: str = "document_id") -> DataFrame:
    """document, file_count, status: ready, empty, or not_built where a document has no folder. files: document, and file, null for an empty folder."""
    n = files.groupBy(document).agg(F.count("file").alias("file_count"))
    status = F.when(F.col("file_count").isNull(), "not_built").when(F.col("file_count") > 0, "ready").otherwise("empty")
    return documents.select(document).join(n, document, "left").select(document, F.coalesce("file_count", F.lit(0)).alias("file_count"), status.alias("status"))


def graph_hits(nodes: DataFrame, edges: DataFrame, query: str, documents: list | None = None) -> DataFrame:
    """document_id, part, text of the nodes and edges whose text, `k: v, k: v`, holds the whole query; nodes first in each document. An empty query takes all."""
    shown = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("None")))), ", ")
    line = lambda df, part, n: df.select("document_id", F.lit(part).alias("part"), F.lit(n).alias("__n"), "item_id", shown.alias("text"))
    found = line(nodes, "node", 0).unionByName(line(edges, "edge", 1)).filter(F.lower("text").contains(query.lower()))
    if documents is not None:
        found = found.filter(F.col("document_id").isin(documents))
    return found.orderBy("document_id", "__n", "item_id").drop("__n")
