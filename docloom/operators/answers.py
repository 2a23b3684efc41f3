"""Answers from stored rows: which row's label a question means, and what the row says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions import numeric, text

#: Characters of the n-grams by which strings are looked up; shorter strings are looked up as they are.
GRAM = 4
YEAR = r"^(25|20)[0-9]{2}$"
# Words that ask for a change between two years, and for extremes.
CHANGE_WORDS = ["เปลี่ยนจาก", "ต่างจาก", "เปรียบเทียบ", "เพิ่มขึ้น", "ลดลง"]
HIGHEST, LOWEST = "สูงสุด", "ต่ำสุด"


def contained(needles: DataFrame, hays: DataFrame, needle: str = "needle", hay: str = "hay", gram: int = GRAM) -> DataFrame:
    """needle, hay: each pair of different strings of two columns where the one holds the other.

    Of a needle the n-gram that the fewest hays have is its key, and hays are met by
    that; a common n-gram brings candidates only to needles that have no rarer one.
    Only n-grams of needles are looked up. Null and empty strings take no part.
    """
    some = lambda df, c, to: df.select(F.col(c).alias(to)).filter(F.coalesce(F.col(c), F.lit("")) != "").distinct()
    mine, theirs = some(needles, needle, "__needle"), some(hays, hay, "__hay")
    pieces = lambda c, n: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n)))
    keys = mine.withColumn("__n", F.least(F.lit(gram), F.length("__needle")))
    keys = keys.select("__needle", F.explode(pieces(F.col("__needle"), F.col("__n"))).alias("__gram"))
    each = [F.when(F.length("__hay") >= n, pieces(F.col("__hay"), F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(1, gram + 1)]
    met = theirs.select("__hay", F.explode(F.flatten(F.array(*each))).alias("__gram")).join(keys.select("__gram").distinct(), "__gram", "left_semi")
    often = met.groupBy("__gram").agg(F.count("*").alias("__often"))
    rare = keys.join(often, "__gram", "left").withColumn("__often", F.coalesce("__often", F.lit(0)))
    rare = rare.groupBy("__needle").agg(F.min(F.struct("__often", "__gram")).alias("k")).filter("k.__often > 0").select("__needle", F.col("k.__gram").alias("__gram"))
    return rare.join(met, "__gram").filter(F.contains("__hay", "__needle")).select(F.col("__needle").alias("needle"), F.col("__hay").alias("hay"))


def scored_labels(questions: DataFrame, labels: DataFrame, terms: bool = True, held: int = 50) -> DataFrame:
    """question, label, score of normalised strings that have to do with each other.

    questions: question (normalised) and terms (normalised terms with weights); labels:
    label (normalised). A label within the question scores its length and 100, else
    a question within the label its length and `held`; each term of the question
    that the label holds its weight.
    """
    own = questions.select("question", *(["terms"] if terms else [])).distinct()
    inside = contained(labels, own, "label", "question").select(F.col("hay").alias("question"), F.col("needle").alias("label"), F.length("needle") + 100)
    around = contained(own, labels, "question", "label").select(F.col("needle").alias("question"), F.col("hay").alias("label"), F.length("needle") + held)
    pairs = [df.toDF("question", "label", "p").withColumn("t", F.lit(0)) for df in (inside, around)]
    if terms:
        each = own.select("question", F.inline("terms"))
        found = contained(each, labels, "term", "label").join(each, F.col("needle") == F.col("term")).groupBy("question", F.col("hay").alias("label")).agg(F.sum("weight").alias("t"))
        pairs.append(found.select("question", "label", F.lit(0).alias("p"), "t"))
    every = pairs[0]
    for p in pairs[1:]:
        every = every.unionByName(p)
    return every.groupBy("question", "label").agg((F.max("p") + F.max("t")).alias("score"))


def asked(questions: DataFrame, question: str) -> DataFrame:
    """questions with __q (normalised), __terms (terms but years, with weights) and __years."""
    words = F.filter(text.keyword_terms(F.col(question)), lambda t: ~t.rlike(YEAR))
    weighted = F.transform(words, lambda t: F.struct(text.normalize_lookup(t).alias("term"), F.greatest(F.lit(10), F.length(t) * 3).alias("weight")))
    return questions.withColumn("__q", text.normalize_lookup(F.col(question))).withColumn("__terms", F.filter(weighted, lambda t: t["term"] != "")).withColumn("__years", text.years_in(F.col(question)))


def first_best(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of each question the row with the highest score, of equal ones the first by document, table and row."""
    place = W.partitionBy(*by).orderBy(F.desc("score"), "document_id", "table_name", "row_index")
    return pairs.withColumn("__n", F.row_number().over(place)).filter("__n = 1").drop("__n")


ROW = ["document_id", "table_name", "row_index", "label", "cells"]


def best_rows(questions: DataFrame, rows: DataFrame, key: str = "question_id", question: str = "question", least: int = 40) -> DataFrame:
    """key, question, document_id, table_name, row_index, label, cells, score: of each question the stored row that it means most.

    rows: document_id, table_name, row_index, label, cells (a map by header). Rows of
    tables without a header that is a year don't count, nor do scores below `least`.
    Questions that mean no row are left out; keys must name questions.
    """
    own = asked(questions.select(key, question), question)
    dated = rows.select(*ROW, text.normalize_lookup(F.col("label")).alias("__label")).filter(F.exists(F.map_keys("cells"), lambda h: F.coalesce(h, F.lit("")).rlike(YEAR)))
    scores = scored_labels(own.select(F.col("__q").alias("question"), F.col("__terms").alias("terms")), dated.select(F.col("__label").alias("label"))).filter(F.col("score") >= least)
    met = scores.join(own.select(key, question, "__q"), F.col("__q") == scores["question"]).drop(scores["question"]).withColumnRenamed("label", "__label")
    # of equal labels only the first row can win, and of a question's labels only those with the highest score
    top = met.withColumn("__top", F.max("score").over(W.partitionBy(key))).filter("score = __top").drop("__top")
    of_label = dated.groupBy("__label").agg(F.min_by(F.struct(*ROW), F.struct("document_id", "table_name", "row_index")).alias("r")).select("__label", "r.*")
    return first_best(top.join(of_label, "__label"), [key]).select(key, question, *ROW, "score")


def direct_answers(best: DataFrame, question: str = "question") -> DataFrame:
    """best with answer, null where the row doesn't say: a change between the two years asked for, the highest or lowest year, the year's value, or, if no year is asked for, all years'."""
    own = best.withColumn("__years", text.years_in(F.col(question))).withColumn("__unit", numeric.infer_value_unit(F.col("label"), F.col(question), F.col("table_name")))
    q, unit, years = F.col(question), F.col("__unit"), F.col("__years")
    raw = lambda y: numeric.strip(F.coalesce(F.element_at("cells", y), F.lit("")))
    shown = lambda y: numeric.with_unit(raw(y), unit)
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: q.contains(w))
    one, two = F.get(years, F.lit(0)), F.get(years, F.lit(1))
    delta = numeric.parse_numeric(raw(one)) - numeric.parse_numeric(raw(two))
    percent = unit == "%"
    say = lambda y: F.when(percent, shown(y)).otherwise(raw(y))
    change = F.concat(F.col("label"), F.lit("ปี "), one, F.lit(" "), numeric.direction(delta), F.lit(" "), numeric.format_delta(F.abs(delta)), F.lit(" "), F.when(percent, "จุดเปอร์เซ็นต์").otherwise("บาท"), F.lit(" จาก "), say(two), F.lit(" เหลือ "), say(one))
    headers = F.array_sort(F.filter(F.map_keys("cells"), lambda h: h.rlike(YEAR)))
    dated = F.filter(F.transform(headers, lambda h: F.struct(numeric.parse_numeric(raw(h)).alias("v"), h.alias("h"))), lambda x: x["v"].isNotNull())
    # of equal values the first year: the table's order is the map's, and years rise in it
    pick = lambda up: F.get(F.array_sort(dated, lambda a, b: F.when(a["v"] == b["v"], F.when(a["h"] < b["h"], -1).otherwise(1)).when((a["v"] > b["v"]) == F.lit(up), -1).otherwise(1)), F.lit(0))["h"]
    extreme = lambda up: text.bound(pick(up), lambda h: F.concat(F.lit("ปี "), h, F.lit(" ที่ "), shown(h)))
    lines = F.transform(F.filter(headers, lambda h: raw(h) != ""), lambda h: F.concat(F.lit("ปี "), h, F.lit(": "), shown(h)))
    answer = (
        F.when((F.size(years) >= 2) & has(CHANGE_WORDS) & delta.isNotNull(), change)
        .when(has([HIGHEST, LOWEST]) & (F.size(dated) > 0), F.when(q.contains(HIGHEST), extreme(True)).otherwise(extreme(False)))
        .when((F.size(years) == 1) & (raw(one) != ""), F.concat("label", F.lit("ในปี "), one, F.lit(" เท่ากับ "), shown(one)))
        .when((F.size(years) == 0) & (F.size(lines) > 0), F.concat("label", F.lit("\n"), F.array_join(lines, "\n")))
    )
    return own.withColumn("answer", answer).drop("__years", "__unit")


def value_of(year: Column) -> Column:
    return numeric.strip(F.coalesce(F.element_at("cells", year), F.lit("")))


def first_of_years(known: DataFrame, asked_for: DataFrame) -> DataFrame:
    """__label, __year and ROW of the first row with each label that has a value for a year asked for; of rows with equal labels no other can be looked up."""
    years = asked_for.select(F.explode("__years").alias("__year")).distinct()
    each = known.select("*", F.explode(F.filter(F.map_keys("cells"), lambda y: value_of(y) != "")).alias("__year")).join(years, "__year", "left_semi")
    return each.groupBy("__label", "__year").agg(F.min_by(F.struct(*ROW), F.struct("document_id", "table_name", "row_index")).alias("r")).select("__label", "__year", "r.*")


def looked_up(questions: DataFrame, rows: DataFrame, key: str = "question_id", question: str = "question") -> DataFrame:
    """key, document_id, table_name, row_index, row_label, value, year: of each question that names years the row whose label it holds, or that holds it, with a value for one of them.

    A label within the question scores its length and 100, else a question within
    the label its length; the year is the question's first that the row has.
    """
    own = asked(questions.select(key, question), question).filter(F.size("__years") > 0)
    known = rows.select(*ROW, text.normalize_lookup(F.col("label")).alias("__label"))
    scores = scored_labels(own.select(F.col("__q").alias("question")), known.select(F.col("__label").alias("label")), terms=False, held=0)
    met = scores.select(F.col("question").alias("__q"), F.col("label").alias("__label"), "score").join(own, "__q")
    pairs = met.withColumn("__year", F.explode(F.array_distinct("__years"))).join(first_of_years(known, own), ["__label", "__year"])
    dated = pairs.withColumn("year", F.get(F.filter("__years", lambda y: value_of(y) != ""), F.lit(0)))
    return first_best(dated, [key]).select(key, "document_id", "table_name", "row_index", F.col("label").alias("row_label"), F.element_at("cells", F.col("year")).alias("value"), "year")
