"""Exact length histogram: what a corpus costs under every context limit.

Documents are aggregated by encoded length; suffix sums over the histogram
answer totals, quantiles and truncated totals for all limits at once.

Nulls and empty texts have length 0; equal rows, and rows with equal or null ids,
count each; an empty table gives an empty histogram. Whole texts are encoded, once;
long runs of white space are encoded apart, as the pattern would cut them.
"""

from __future__ import annotations

import base64
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed
from docloom.llm.wordarrays import slices

# Fixed value: how byte-level BPE of this vocabulary cuts a text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: what the pattern's \s matches, Unicode's White_Space.
WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LONG_RUN = 10_000  # white space on which the pattern would run back too far
BLOCK = 1 << 12  # lengths whose sums are carried together


def read_ranks(path: str) -> dict[bytes, int]:
    """A vocabulary file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def pieces(text: str):
    """(part, whether it is one run of white space) of a text; the pattern cuts the parts as it would cut the text.

    Of a run before other text the pattern leaves the last character to what follows.
    """
    at = 0
    for run in re.finditer(rf"[{WHITE}]{{{LONG_RUN},}}", text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield text[at : run.start()], False
        yield text[run.start() : end], True
        at = end
    yield text[at:], False


def lengths(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens. The vocabulary is read here, once, and broadcast: its size is the file's, not the data's."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    schema = docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("n_tokens")).schema

    def encoded(batches):
        import tiktoken

        coder, whole = (tiktoken.Encoding(name, pat_str=cut, mergeable_ranks=ranks.value, special_tokens={}) for name, cut in (("ranks", PATTERN), ("runs", "(?s:.+)")))
        size = lambda t: sum(len((whole if run else coder).encode_ordinary(p)) for p, run in pieces(t) if p) if t else 0
        for batch in batches:
            for part in slices(batch):
                n = list(map(size, part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64())], ["id", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encoded, schema).withColumnRenamed("id", id_col)


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens of documents -> a row for each length, as a context limit.

    n_docs: documents of that length; docs_upto, tokens_upto: of that length or
    less; docs_over: longer ones; total_truncated: tokens left if each document
    is cut at it; quantile: share of documents that fit. Sums are carried by
    blocks of lengths, so no task sees the whole histogram. The counts are
    checkpointed: two branches read them, and texts are encoded once.
    """
    counts = checkpointed(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")))
    counts = counts.withColumn("__b", F.floor(F.col("n_tokens") / BLOCK)).withColumn("__t", F.col("n_docs") * F.col("n_tokens"))
    blocks = counts.groupBy("__b").agg(F.sum("n_docs").alias("__d"), F.sum("__t").alias("__bt"))
    after = W.orderBy(F.col("__b").desc()).rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy(F.lit(0))
    carry = blocks.select(
        "__b",
        F.coalesce(F.sum("__d").over(after), F.lit(0)).alias("__d_after"),
        F.coalesce(F.sum("__bt").over(after), F.lit(0)).alias("__t_after"),
        F.sum("__d").over(every).alias("__docs"),
        F.sum("__bt").over(every).alias("__tokens"),
    )
    longer = W.partitionBy("__b").orderBy(F.col("n_tokens").desc()).rowsBetween(W.unboundedPreceding, -1)
    over = F.col("__d_after") + F.coalesce(F.sum("n_docs").over(longer), F.lit(0))
    tokens_over = F.col("__t_after") + F.coalesce(F.sum("__t").over(longer), F.lit(0))
    sums = counts.join(carry, "__b").withColumn("docs_over", over).withColumn("__t_over", tokens_over)
    return sums.select(
        F.col("n_tokens").alias("limit"),
        "n_docs",
        (F.col("__docs") - F.col("docs_over")).alias("docs_upto"),
        "docs_over",
        (F.col("__tokens") - F.col("__t_over")).alias("tokens_upto"),
        (F.col("__tokens") - F.col("__t_over") + F.col("docs_over") * F.col("n_tokens")).alias("total_truncated"),
        ((F.col("__docs") - F.col("docs_over")) / F.col("__docs")).alias("quantile"),
    )


def at_limits(hist: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_upto, docs_over, total_truncated for context limits of one's own, whether a document has that length or not; hist: from histogram."""
    n, d = F.col("limit"), F.col("n_docs")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    rows = [
        F.struct(F.lit(int(x)).cast("long").alias("limit"), total(F.when(n <= x, d)).alias("docs_upto"), total(F.when(n > x, d)).alias("docs_over"), total(F.least(n, F.lit(int(x))) * d).alias("total_truncated"))
        for x in limits
    ]
    return hist.agg(F.array(*rows).alias("__r")).select(F.inline("__r"))
