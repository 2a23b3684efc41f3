"""The corpus pipeline: quality, near copies, benchmark passages, personal data, mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
and read again before the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import decontaminate, jaccard_join, mixing, pii, quality
from docloom.llm.common import checkpointed, few, shared_dir, table


def row_key():
    """Of equal rows only the same: rows that share an id, or have none, are documents of their own."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.xxhash64("text", "lang", "source", "n_chars").alias("row"))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Null and empty texts are scored like any other."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: that with the least id, rows with no id last; of equal rows one.

    Rows with equal ids and unlike texts are documents of their own. Texts with
    no words have no copies and stay.
    """
    keyed = docs.withColumn("__key", row_key())
    found = checkpointed(jaccard_join.join(keyed, "__key").select("__key", "component_id"))  # read thrice
    goes = found.filter("__key <> component_id").select(F.col("__key").alias("__gone")).distinct()
    gone = F.broadcast(goes) if few(goes, 200_000) else goes
    left = keyed.join(gone, F.col("__key").eqNullSafe(F.col("__gone")), "left_anti")
    again = found.filter("__key = component_id").groupBy("__key").count().filter("count > 1").select(F.col("__key").alias("__again"))
    if again.isEmpty():
        return left.drop("__key")
    once = left.join(again, F.col("__key").eqNullSafe(F.col("__again")), "left_anti")
    repeated = left.join(again, F.col("__key").eqNullSafe(F.col("__again")), "left_semi").dropDuplicates(["__key"])
    return once.unionByName(repeated).drop("__key")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with edits or without; rows with equal ids, or none, and unlike texts are judged each."""
    keyed = docs.withColumn("__key", row_key())
    found = decontaminate.find(keyed, table(spark, sf_dir, "benchmark"), id_col="__key").select(F.col("__key").alias("__gone")).distinct()
    gone = F.broadcast(found) if few(found, 1_000_000) else found
    return keyed.join(gone, F.col("__key").eqNullSafe(F.col("__gone")), "left_anti").drop("__key")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind; n_chars follows the text. Null and empty texts stay as they are; rows with equal ids, or none, are masked each."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents with text, how many of their words it takes, repeats counted, and as parts which words in which slots.

    Documents that it takes nothing of go, those without words among them. Rows with
    equal ids and unlike texts are documents of their own; a null source is one of
    the sources. mixing.mixed_texts lays the parts out as texts.
    """
    keyed = docs.withColumn("__key", row_key())
    taken = mixing.mix_parts(keyed, "__key").filter("taken > 0").withColumnRenamed("__key", "__taken_key")
    return keyed.join(taken, F.col("__key").eqNullSafe(F.col("__taken_key"))).drop("__key", "__taken_key")


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("personal data", personal_data),
    ("mixing sources", source_mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
