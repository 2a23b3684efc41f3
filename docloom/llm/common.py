"""Reading tables, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What the word classes of the operators call white space.
SPACES = b" \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset a temporary one, but on a cluster an error: its machines share no temporary folder."""
    known = spark.sparkContext.getCheckpointDir()
    if known is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            known = tempfile.mkdtemp(prefix="spark-docloom-")
        spark.sparkContext.setCheckpointDir(known)
    return known


def checkpointed(df: DataFrame) -> DataFrame:
    """For narrow tables: reliable checkpoint, removed by Spark's cleaner."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """For wide tables: Parquet in the shared folder, read again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/docloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 1000) -> None:
    """Lets no more than so many rows at once go to Python workers: whole texts are long, and workers have little memory."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > most:
        spark.conf.set(name, most)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id):
    """True for the fifth of the documents that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def few(df: DataFrame, limit: int) -> bool:
    """Whether df has at most limit rows, found without counting beyond them."""
    return df.limit(limit + 1).count() <= limit


def semi_join(big: DataFrame, keys: DataFrame, on: str, limit: int = 1_000_000) -> DataFrame:
    """Rows of big whose key is among keys; keys are broadcast only if they are few, by count."""
    side = F.broadcast(keys) if few(keys, limit) else keys
    renamed = side.select(F.col(on).alias("__semi"))
    return big.join(renamed, big[on].eqNullSafe(F.col("__semi")), "left_semi")
