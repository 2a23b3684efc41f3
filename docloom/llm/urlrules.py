"""URL allow and block rules by a sort-merge range join.

A host with its labels reversed makes every rule host a prefix, and every
prefix an interval of keys: com.example. to com.example/ holds a host and its
subdomains, because / follows . in byte order. Intervals nest or are apart, so
a sweep over pages and interval ends in key order keeps a stack of the rules
that hold. The sweep is distributed: keys are dealt out by range, a window
sweeps each range, and the stack at each range's start is carried in.

Nulls, and urls without ://, have empty host and path, which no rule fits. Equal
urls are judged alike, rows with equal ids, or none, each. Rules with equal host and path:
block is kept. An empty table gives an empty result; without rules all is allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import checkpointed, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STACK = "array<struct<size:int,path:string,rule:string,verdict:string>>"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def events(rules: DataFrame) -> DataFrame:
    """Rules (host, path, verdict) -> key, stack: which rules hold from each interval end on.

    A host's rules enter with all that hold around it: its suffixes are few, so
    each host meets them by an equi-join. At its interval's end they leave.
    """
    rows = rules.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("__block"))
    entry = F.struct(
        (F.length("host") + F.length("path")).alias("size"), "path", F.concat("host", "path").alias("rule"),
        F.when(F.col("__block"), "block").otherwise("allow").alias("verdict"),
    )
    hosts = rows.groupBy("host").agg(F.collect_list(entry).alias("__own")).withColumn("__key", key_of(F.col("host")))
    labels = F.split("host", r"\.", -1)
    around = hosts.select("host", "__key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("__outer"))
    inner = hosts.select(F.col("host").alias("__outer"), "__own")
    met = around.join(inner, "__outer")
    stacks = met.groupBy("__key").agg(
        F.flatten(F.collect_list("__own")).cast(STACK).alias("__stack"),
        F.flatten(F.collect_list(F.when(F.col("__outer") != F.col("host"), F.col("__own")))).cast(STACK).alias("__rest"),
    )
    begin = stacks.select("__key", F.col("__stack").alias("stack"), F.lit(1).alias("__kind"))
    # the end of com.example. is com.example/; of intervals that end together, the outer one closes last
    end = stacks.select(F.concat(F.expr("left(__key, length(__key) - 1)"), F.lit("/")).alias("__key"), F.col("__rest").alias("stack"), F.lit(0).alias("__kind"))
    return begin.unionByName(end)


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """id_col, host, path, rule, verdict for every page; the longest of the rules that fit wins."""
    spark = pages.sparkSession
    own = pages.select(F.col(id_col).alias("__id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = own.withColumn("__key", key_of(F.col("host"))).withColumn("stack", F.lit(None).cast(STACK)).withColumn("__kind", F.lit(2))
    marks = events(rules).select(F.lit(None).cast(own.schema["__id"].dataType).alias("__id"), F.lit("").alias("host"), F.lit("").alias("path"), "__key", "stack", "__kind")
    # the salt lets a hot host fill several ranges; marks come before the pages of their key
    both = keyed.unionByName(marks).withColumn("__salt", F.when(F.col("__kind") == 2, F.pmod(F.xxhash64("__id", "path"), F.lit(1 << 30))).otherwise(F.lit(-1).cast("long")))
    ranged = both.repartitionByRange(partitions(spark), "__key", "__kind", "__salt").withColumn("__range", F.spark_partition_id())
    dealt = checkpointed(ranged)
    place = F.struct("__key", "__kind")
    lasts = dealt.groupBy("__range").agg(F.max(F.when(F.col("__kind") < 2, F.struct(place.alias("at"), F.col("stack").alias("stack")))).alias("__last"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.select("__range", F.last("__last", ignorenulls=True).over(before)["stack"].alias("__carried"))
    sweep = W.partitionBy("__range").orderBy("__key", "__kind", "__salt").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = dealt.withColumn("__here", F.last("stack", ignorenulls=True).over(sweep)).filter("__kind = 2").join(carried, "__range")
    fits = F.filter(F.coalesce("__here", "__carried"), lambda r: F.col("path").startswith(r["path"]))
    best = F.array_max(fits)
    return (
        swept.withColumn("__best", best)
        .select(F.col("__id").alias(id_col), "host", "path", F.col("__best")["rule"].alias("rule"), F.coalesce(F.col("__best")["verdict"], F.lit(otherwise)).alias("verdict"))
    )
