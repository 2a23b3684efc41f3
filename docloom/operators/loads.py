"""Loads that write: tables of documents in one folder, seen together or not at all.

Each load has a number and writes its rows of every table as a partition of its own.
A last small write, the commit, says which documents the load has; readers take of
each document the rows of the last committed load that has it. What a broken load has
written is never read, and the same load again writes the same partitions over, so
nothing is needed to clean up; a load that is committed does nothing. So a stream's
batch numbers make repeated batches harmless.

Columns that later loads add are null in rows of earlier ones. compacted() writes
what is current to another folder as one load, since rows that were replaced stay
where they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "commits"


def commits(spark: SparkSession, folder: str, key: str = "document_id") -> DataFrame | None:
    """key, load, gone of every commit; None before the first."""
    try:
        return spark.read.parquet(f"{folder}/{COMMITS}")
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def committed(spark: SparkSession, folder: str, load: int) -> bool:
    known = commits(spark, folder)
    return known is not None and not known.filter(F.col("load") == load).isEmpty()


def write(family: dict[str, DataFrame], documents: DataFrame, folder: str, load: int, key: str = "document_id", gone: DataFrame | None = None) -> bool:
    """Writes a load, whose documents' rows in all tables it replaces, and commits it; False if that was done before.

    family: tables by name, each with key; documents: the keys of the load, those with
    no rows in any table too; gone: keys of documents that the load takes away. Loads
    count from 0 and must rise; a load of no documents leaves all as it was.
    """
    spark = documents.sparkSession
    if committed(spark, folder, load):
        return False
    for name, df in family.items():
        df.withColumn("load", F.lit(load).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{folder}/{name}")
    rows = documents.select(key).distinct().withColumn("gone", F.lit(False))
    if gone is not None:
        rows = rows.join(gone.select(key), key, "left_anti").unionByName(gone.select(key).distinct().withColumn("gone", F.lit(True)))
    rows.withColumn("load", F.lit(load).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{folder}/{COMMITS}")
    return True


def read(spark: SparkSession, folder: str, name: str, key: str = "document_id") -> DataFrame:
    """A table's current rows: of each document those of its last committed load."""
    last = commits(spark, folder, key).groupBy(F.col(key).alias("__key")).agg(F.max_by("gone", "load").alias("__gone"), F.max("load").alias("__load")).filter("NOT __gone")
    rows = spark.read.option("mergeSchema", True).parquet(f"{folder}/{name}")
    return rows.join(last, F.col(key).eqNullSafe(F.col("__key")) & (F.col("load") == F.col("__load"))).drop("__key", "__gone", "__load", "load")


def compacted(spark: SparkSession, folder: str, names: list[str], to: str, key: str = "document_id") -> None:
    """Writes the current rows of all tables to another folder, as load 0."""
    known = commits(spark, folder, key)
    standing = known.groupBy(key).agg(F.max_by("gone", "load").alias("gone")).filter("NOT gone")
    write({n: read(spark, folder, n, key) for n in names}, standing, to, 0, key)


def batches(folder: str, shape: Callable[[DataFrame], dict[str, DataFrame]], key: str = "document_id") -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch of stored rows is a load by the batch's number; shape makes its tables."""

    def load(batch: DataFrame, number: int) -> None:
        batch.persist()
        write(shape(batch), batch, folder, number, key)
        batch.unpersist()

    return load
