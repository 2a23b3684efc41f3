"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the schedule is the i-th golden-ratio point; laid on the sources'
cumulative shares it names a source. The r-th slot of a source takes the r-th
of its blocks, round and round, three times at most; a source's documents are
shuffled by a hash of their id, laid end to end and cut into blocks of equal
tokens (to within one). Tokens are words.

Nulls and ties: a null text has no words; null sources form one source, ordered
last; rows with equal ids are documents of their own, and which of two equal
rows comes first changes nothing. An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import WORD, checkpointed

GOLDEN = 0.6180339887498949
CELLS = 4096  # of the unit interval, by which slots meet their sources
CHUNK = 1 << 12  # slots whose ranks are counted together
BUCKETS = 1024  # of each source's shuffled documents


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=(1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size -> the same with source_no, weight and target.

    The sources in order of code points, null last, weigh weights in turn and
    share the whole. A target stops at most times its source's size; what is
    over goes to the others by weight. That is water-filling: taken by size over
    weight, sources are full up to the first whose level fits. One row a source.
    """
    number = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    ranked = sources.withColumn("source_no", number).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("source_no") % len(weights) + 1).cast("double"))
    every, by_room = W.partitionBy(F.lit(0)), W.orderBy(F.col("source_size") / F.col("weight"), "source_no")
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    levels = (
        ranked.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__k", F.row_number().over(by_room))
        .withColumn("__level", left / open_weight)
    )
    fits = F.when(F.col("__level") * F.col("weight") <= F.col("__cap"), F.struct("__k", "__level"))
    return (
        levels.withColumn("__first", F.min(fits).over(every))
        .withColumn("target", F.least("__cap", F.col("__first.__level") * F.col("weight")))
        .select("source", "source_no", "source_size", "weight", "target")
    )


def schedule(sources: DataFrame) -> DataFrame:
    """source_no, source_size, target, blocks -> slot, source_no, block: which block of which source each slot takes."""
    spark = sources.sparkSession
    wanted = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    shares = sources.withColumn("__wanted", wanted).filter("__wanted > 0")
    slots = int(shares.agg(F.ceil(F.coalesce(F.sum("__wanted"), F.lit(0.0)))).first()[0])
    order = W.orderBy("source_no")
    upto = F.sum("__wanted").over(order) / F.sum("__wanted").over(W.partitionBy(F.lit(0)))
    spans = shares.select("source_no", "blocks", upto.alias("__to"), F.lead("source_no").over(order).isNull().alias("__end"))
    spans = spans.withColumn("__hi", F.when(F.col("__end"), 1.0).otherwise(F.col("__to"))).withColumn("__lo", F.coalesce(F.lag("__to").over(order), F.lit(0.0)))
    cells = spans.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__lo") * CELLS), F.least(F.floor(F.col("__hi") * CELLS), F.lit(CELLS - 1).cast("long")))))
    high = F.floor(F.col("slot") / (1 << 20))
    step = (1 << 20) * GOLDEN % 1.0
    # the whole part is taken off in two steps, so that large slot numbers keep their digits
    x = high * step - F.floor(high * step) + (F.col("slot") - high * (1 << 20)) * GOLDEN
    points = spark.range(1, slots + 1).select(F.col("id").alias("slot")).withColumn("__x", x - F.floor(x)).withColumn("__cell", F.floor(F.col("__x") * CELLS))
    named = points.join(cells, "__cell").filter("__x >= __lo and __x < __hi").select("slot", "source_no", "blocks", F.floor(F.col("slot") / CHUNK).alias("__chunk"))
    earlier = named.groupBy("source_no", "__chunk").agg(F.count("*").alias("__n"))
    earlier = earlier.select("source_no", "__chunk", F.coalesce(F.sum("__n").over(W.partitionBy("source_no").orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.row_number().over(W.partitionBy("source_no", "__chunk").orderBy("slot")) - 1
    return named.join(earlier, ["source_no", "__chunk"]).withColumn("__rank", rank).filter("__rank < 3 * blocks").select("slot", "source_no", (F.col("__rank") % F.col("blocks")).alias("block"))


def laid_out(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """docs with source_no and size -> with start: where each begins in its source's shuffled row of tokens.

    Sums by bucket of the hash come first, so no task sees a whole source.
    """
    h = F.xxhash64(F.col(id_col), F.lit("mix"))
    dealt = docs.withColumn("__h", h).withColumn("__bucket", F.pmod(F.col("__h"), F.lit(BUCKETS)))
    sums = dealt.groupBy("source_no", "__bucket").agg(F.sum("size").alias("__size"))
    sums = sums.select("source_no", "__bucket", F.coalesce(F.sum("__size").over(W.partitionBy("source_no").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    within = F.sum("size").over(W.partitionBy("source_no", "__bucket").orderBy("__h", id_col, "size").rowsBetween(W.unboundedPreceding, -1))
    return dealt.join(sums, ["source_no", "__bucket"]).withColumn("start", F.col("__before") + F.coalesce(within, F.lit(0))).drop("__h", "__bucket", "__before")


def pieces(laid: DataFrame) -> DataFrame:
    """source_no, start, size, source_size, blocks -> source_no, block, start, piece_from, piece_to: the part of each block in each document."""
    q, r = F.expr("source_size div blocks"), F.col("source_size") % F.col("blocks")
    wide = r * (q + 1)
    holds = lambda p: F.when(p < wide, F.floor(p / (q + 1))).otherwise(r + F.floor((p - wide) / q))
    edge = lambda j: j * q + F.least(j, r)
    last = F.col("start") + F.col("size")
    return (
        laid.filter("size > 0").withColumn("block", F.explode(F.sequence(holds(F.col("start")), holds(last - 1))))
        .withColumn("piece_from", F.greatest("start", edge(F.col("block"))))
        .withColumn("piece_to", F.least(last, edge(F.col("block") + 1)))
        .select("source_no", "block", "start", "piece_from", "piece_to")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 1024, least_blocks: int = 1024) -> tuple[DataFrame, DataFrame]:
    """The documents laid out (id, source_no, start, size, source_size, target), and the mix: slot, source_no, block, start, piece_from, piece_to.

    block: tokens of a block, about; a source of fewer than block * least_blocks
    tokens has least_blocks blocks, or one a token, so that small sources, too,
    come near their targets. The sizes are checkpointed: texts are read once.
    """
    sized = checkpointed(docs.select(F.col(id_col), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size")))
    sources = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("blocks", F.greatest(F.lit(1).cast("long"), F.least(F.col("source_size"), F.greatest(F.ceil(F.col("source_size") / block), F.lit(least_blocks).cast("long")))))
    sources = checkpointed(sources)
    named = sized.join(sources.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "weight")
    laid = laid_out(named, id_col)
    return laid, schedule(sources).join(pieces(laid), ["source_no", "block"])


def mix_parts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, size, source_size, target, taken, parts: what the mix takes of each document.

    taken: its words, repeats counted; parts: (slot, from_word, to_word) in the
    order of slots, to_word exclusive. A document has no more parts than its blocks have slots.
    """
    laid, mixed = mix(docs, id_col)
    part = F.struct("slot", (F.col("piece_from") - F.col("start")).alias("from_word"), (F.col("piece_to") - F.col("start")).alias("to_word"))
    taken = mixed.groupBy("source_no", "start").agg(F.sum(F.col("piece_to") - F.col("piece_from")).alias("__taken"), F.sort_array(F.collect_list(part)).alias("parts"))
    taken = taken.select(F.col("source_no").alias("__no"), F.col("start").alias("__start"), "__taken", "parts")
    out = laid.join(taken, (F.col("source_no") == F.col("__no")) & (F.col("start") == F.col("__start")) & (F.col("size") > 0), "left")
    return out.select(id_col, "size", "source_size", "target", F.coalesce("__taken", F.lit(0)).cast("long").alias("taken"), "parts")


def mix_counts(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, size, source_size, target, taken: the words of each document that the mix takes, repeats counted."""
    return mix_parts(docs, id_col).drop("parts")


def mixed_texts(mixed: DataFrame, text_col: str = "text", parts: str = "parts") -> DataFrame:
    """Documents with parts -> a row for each part, in the mix's order when sorted by slot and from_word: slot, from_word, to_word and the document's columns, text_col cut to the part's words as they stand."""
    rows = mixed.select("*", F.explode(parts).alias("__part"))
    words_ = F.regexp_extract_all(F.col(text_col), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    first, last = F.col("__part.from_word").cast("int"), F.col("__part.to_word").cast("int")
    cut = F.regexp_replace(F.array_join(F.slice(words_, first + 1, last - first), ""), r"^[\x20\x09-\x0D]+", "")
    whole = (first == 0) & (last == F.size(words_))
    return rows.withColumn(text_col, F.when(whole, F.col(text_col)).otherwise(cut)).select("__part.*", *[c for c in mixed.columns if c != parts])
