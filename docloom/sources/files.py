"""Questions, logs and graph files as Spark sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import text

QUESTIONS = "question string, ground_truth string, note string"
LOGGED = "question string, answer string, contexts array<string>, ground_truth string"


def questions(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of questions with their true answers; missing fields are null."""
    return spark.read.schema(QUESTIONS).json(path, multiLine=True)


def append_log(answers: DataFrame, path: str) -> None:
    """Adds answered questions to a folder of JSON lines; earlier ones aren't read or rewritten."""
    answers.select("question", "answer", "contexts", "ground_truth").write.mode("append").json(path)


def log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOGGED).json(path)


def append_history(means: DataFrame, path: str) -> None:
    """Adds evaluation means to a folder of CSV files with headers."""
    means.write.mode("append").csv(path, header=True)


def history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def graphs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """document (the name of the folder that holds data.json), and the file's columns."""
    document = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/data\.json$", 1)
    return spark.read.schema(schema).json(f"{path}/*/data.json", multiLine=True).select(document.alias("document"), "*")


def select(spark: SparkSession, sql: str, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """The rows of one SELECT, which may name the given tables or the session's views; any other statement is an error before it runs.

    The given tables are views only while the statement is read: views of the session
    by the same names stand again afterwards.
    """
    if not text.only_select(sql, spark):
        raise ValueError("only a single SELECT is allowed")
    before = {name: spark.table(name) for name in tables or {} if spark.catalog.tableExists(name)}
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(sql)
    finally:
        for name in tables or {}:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)


def shown(df: DataFrame, most: int = 50) -> dict:
    """columns, rows as objects and row_count, for a screen; rows stop at `most`, the count doesn't."""
    rows = [r.asDict(recursive=True) for r in df.limit(most).collect()]
    return {"columns": df.columns, "rows": rows, "row_count": df.count() if len(rows) == most else len(rows)}


def uploads(spark: SparkSession, path: str, kinds: tuple = ("pdf", "png", "jpg", "jpeg")) -> DataFrame:
    """Files with their bytes, of these kinds by name."""
    return spark.read.format("binaryFile").load(path).filter(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*kinds))


def scraped(pages: DataFrame, contents: DataFrame, key: str) -> DataFrame:
    """key, text: of a page's text and its saved file's body the longer. pages: key, page_text; contents: key, content."""
    return pages.join(contents, key, "left").select(key, text.longer_text(F.col("page_text"), F.col("content")).alias("text"))


def downloads(files: DataFrame, status: str = "status", kind: str = "content_type", size: str = "length", name: str = "path") -> DataFrame:
    """Fetched files that are worth keeping: found, not pages, and 5000 bytes or more, of images 1000."""
    least = F.when(F.lower(F.coalesce(kind, F.lit(""))).startswith("image/"), 1000).otherwise(5000)
    return files.filter((F.col(status) == 200) & ~F.lower(F.coalesce(kind, F.lit(""))).contains("text/html") & (F.col(size) >= least)).withColumn("filename", text.file_name(F.element_at(F.split(F.regexp_replace(name, r"[?#].*$", ""), "/"), -1)))
