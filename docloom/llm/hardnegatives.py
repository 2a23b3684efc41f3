"""Hard negatives by norm-bucketed search for the largest inner products.

Candidates are dealt into stripes by hash, each bounded in bytes; within a stripe
they are sorted by norm and cut into buckets. Anchors go in blocks. A block meets a
stripe in one task, bucket after bucket from the largest norm down: an anchor skips
a bucket when its norm times the bucket's largest (Cauchy-Schwarz) is below the
least of its windows' bounds, each the larger of the window's lower limit and the
score of its running kth. Two rounds: the first finds each anchor's positives, the
second its negatives in the windows that the positives' scores make. What blocks and
stripes find is merged by rank. Nothing is approximate.

Rows with a null label or vector, or a component that is null or not finite, take no
part. Null ids come after all others and are no anchors unless the caller says so.
Shorter vectors count as ending in zeros, an empty one as zeros. Rows that are equal
throughout are searched once and counted as often as they stand there; each is an
anchor. Scores that longs don't hold become the nearest long. An empty table, or one
without anchors, gives an empty result. Further columns of any name do no harm.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import few, written
from docloom.llm.vectors import matrix, packed, unpacked, usable, whole

#: Candidates of a bucket, anchors of a block.
BUCKET, BLOCK = 1024, 1024
#: Bytes of a stripe's vectors as longs, and the least number of stripes, so that small tables too are searched by several tasks.
STRIPE_BYTES, STRIPES = 32 << 20, 8
LONGS = np.iinfo(np.int64)
HIT = pa.struct([("score", pa.int64()), ("id", pa.int64()), ("own", pa.bool_())])


def norms(x: np.ndarray) -> np.ndarray:
    """Norms of rows, never below the exact ones."""
    return np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)


def products(a: np.ndarray, c: np.ndarray, reach: float) -> np.ndarray:
    """Exact inner products of rows; reach: a bound for their size. Doubles are exact up to 2**53; beyond, Python's numbers are."""
    if reach < 2**53:
        return (a.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ c.astype(object).T
    return np.clip(exact, LONGS.min, LONGS.max).astype(np.int64)


def buckets(width: int, size: int, by_norm: bool):
    """Rows of a group as buckets of so many: the largest norm of each, and within each by id, null ids last. Without by_norm the group is one bucket."""

    def cut(table: pa.Table) -> pa.Table:
        x = matrix(table["x"], width)
        norm = norms(x)
        order = np.argsort(-norm, kind="stable") if by_norm else np.arange(len(x))
        null = np.asarray(table["id"].is_null())
        ids = np.asarray(table["id"].fill_null(LONGS.max), np.int64)
        out = []
        for i in range(0, len(order), size if by_norm else max(1, len(order))):
            part = order[i : i + size] if by_norm else order
            part = part[np.lexsort((ids[part], null[part]))]
            rows = table.take(pa.array(part))
            out.append({"group": table["group"][0].as_py(), "bucket": len(out), "top": float(norm[part].max()), "ids": rows["id"].to_pylist(), "labels": rows["label"].to_pylist(), "copies": rows["copies"].to_pylist(), "x": packed(x[part])})
        return pa.Table.from_pylist(out, pa.schema([("group", pa.int32()), ("bucket", pa.int32()), ("top", pa.float64()), ("ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("copies", pa.list_(pa.int64())), ("x", pa.binary())]))

    return cut


BUCKETS = "group int, bucket int, top double, ids array<long>, labels array<long>, copies array<long>, x binary"


class Best:
    """The best k hits of one window: scores, ids, whether the id is null, whether it is the anchor's own row."""

    def __init__(self, low: int, high: int, k: int):
        self.low, self.high, self.k = low, high, k
        self.hits = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, bool, bool))

    @property
    def bound(self) -> int:
        """No lower score enters any more."""
        return max(self.low, int(self.hits[0][-1])) if len(self.hits[0]) == self.k else self.low

    def add(self, scores, ids, null, own, copies) -> None:
        """Takes up rows by falling score, those of a score by id."""
        i = np.searchsorted(-scores, -self.high, "left") if self.high < LONGS.max else 0
        j = min(np.searchsorted(-scores, -self.bound, "right"), i + self.k) if self.bound > LONGS.min else min(len(scores), i + self.k)
        if i >= j:
            return
        times = np.minimum(copies[i:j], self.k)
        both = [np.concatenate([old, np.repeat(new[i:j], times)]) for old, new in zip(self.hits, (scores, ids, null, own), strict=True)]
        order = np.lexsort((both[1], both[2], -both[0]))[: self.k]
        self.hits = tuple(v[order] for v in both)


def search(width: int, k: int, same: bool, skips: list | None = None):
    """Meets a stripe's buckets with a block of anchors. same: whether hits share the anchor's label. Row of a result: block, place of the anchor, window, hits."""

    def meet(candidates: pa.Table, anchors: pa.Table) -> pa.Table:
        rows, places, windows, sizes, hits = candidates.sort_by([("top", "descending"), ("bucket", "ascending")]), [], [], [], []
        if anchors.num_rows and rows.num_rows:
            a = unpacked(anchors["x"][0].as_py(), width)
            label, ids, reach = np.array(anchors["labels"][0].as_py()), anchors["ids"][0].as_py(), norms(a)
            best = [[] for _ in ids]
            for w in anchors["windows"][0].as_py():
                best[w["place"]].append(Best(w["low"], w["high"], k))
            need = lambda i: min((w.bound for w in best[i] if w.low <= w.high), default=math.inf)
            least = np.array([float(need(i)) for i in range(len(ids))])
            tops = [max((w.high for w in own), default=LONGS.min) for own in best]
            for row in rows.to_pylist():
                # a bound in doubles may be rounded up by a part in 2**52
                active = np.flatnonzero(reach * row["top"] >= np.where(least > 0, least * (1 - 1e-12), least))
                if skips is not None:
                    skips.append(len(ids) - len(active))
                if not len(active):
                    continue
                c = unpacked(row["x"], width)
                theirs, copies = np.array(row["labels"]), np.array(row["copies"])
                null = np.array([v is None for v in row["ids"]])
                keys = np.array([LONGS.max if v is None else v for v in row["ids"]], np.int64)
                for at in range(0, len(active), 256):
                    part = active[at : at + 256]
                    for i, s in zip(part, products(a[part], c, float(reach[part].max()) * row["top"]), strict=True):
                        on = np.flatnonzero(((theirs == label[i]) == same) & (s >= need(i)) & (s <= tops[i]))
                        on = on[np.argsort(-s[on], kind="stable")]
                        # equal throughout: the anchor itself or a copy
                        own = (null[on] if ids[i] is None else (keys[on] == ids[i]) & ~null[on]) & (c[on] == a[i]).all(1) & same
                        for w in best[i]:
                            if w.low <= w.high:
                                w.add(s[on], keys[on], null[on], own, copies[on])
                        least[i] = float(need(i))
            for i, found in enumerate(best):
                for n, w in enumerate(found):
                    if len(w.hits[0]):
                        places.append(i)
                        windows.append(n)
                        sizes.append(len(w.hits[0]))
                        hits.append(w.hits)
        block = anchors["group"][0].as_py() if anchors.num_rows else 0
        flat = [np.concatenate([h[c] for h in hits]) if hits else np.zeros(0, kind) for c, kind in enumerate((np.int64, np.int64, bool, bool))]
        values = pa.StructArray.from_arrays([pa.array(flat[0]), pa.array(flat[1], mask=flat[2]), pa.array(flat[3])], fields=list(HIT))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), values)
        return pa.table([pa.array([block] * len(places), pa.int32()), pa.array(places, pa.int32()), pa.array(windows, pa.int32()), lists], ["group", "place", "window", "hits"])

    return meet


HITS = "group int, place int, window int, hits array<struct<score: long, id: long, own: boolean>>"


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
    id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    rows: id, whole-numbered label, vector; anchor: which rows are anchors. Of each
    anchor the best `positives` other rows of its label, and for each of those the
    best `negatives` rows of other labels whose score is low to high hundredths of
    the positive's. Scores are inner products of floor(256 * component).
    """
    own = rows.filter(F.col(label_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole(F.col(vector_col)).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    of = own.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.count_if("anchor").alias("anchors")).first()
    width, stripes, blocks = max(1, of.width or 0), max(STRIPES, math.ceil(of.n * max(1, of.width or 0) * 8 / STRIPE_BYTES)), math.ceil(of.anchors / BLOCK)
    once = own.groupBy("id", "label", "x", "anchor").agg(F.count("*").alias("copies"))
    key = F.xxhash64("id", "label", "x")
    group = lambda n: F.pmod(key, F.lit(max(1, n))).cast("int")
    stripe = written(once.withColumn("group", group(stripes)).groupBy("group").applyInArrow(buckets(width, BUCKET, True), BUCKETS))
    block = written(once.filter("anchor").withColumn("group", group(blocks)).groupBy("group").applyInArrow(buckets(width, 0, False), BUCKETS))

    def round_of(windows: DataFrame, k: int, same: bool, order: list) -> DataFrame:
        """The best k hits for each window, ranked; windows: group, windows, reach."""
        wide = F.broadcast(windows.select("group", "reach")) if few(windows, 100_000) else windows.select("group", "reach")
        theirs = stripe.withColumnRenamed("group", "stripe").withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(max(0, blocks - 1))))).join(wide, "group").filter("top >= reach").drop("reach")
        ours = block.join(windows.drop("reach"), "group").withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
        met = theirs.groupBy("group", "stripe").cogroup(ours.groupBy("group", "stripe")).applyInArrow(search(width, k, same), HITS)
        each = met.select("group", "place", "window", F.inline("hits"))
        ranked = F.row_number().over(W.partitionBy("group", "place", "window").orderBy(F.desc("score"), F.asc_nulls_last("id"), *order))
        return each.withColumn("rank", ranked).filter(F.col("rank") <= k)

    place = F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.struct(i.cast("int").alias("place"), F.lit(LONGS.min).alias("low"), F.lit(LONGS.max).alias("high")))
    first = round_of(block.select("group", place.alias("windows"), F.lit(-math.inf).alias("reach")), positives + 1, True, [F.desc("own")])
    # one of the rows that equal the anchor is the anchor itself
    anchors = W.partitionBy("group", "place")
    itself = F.coalesce(F.min(F.when(F.col("own"), F.col("rank"))).over(anchors), F.lit(positives + 2))
    first = first.withColumn("itself", itself).filter(F.col("rank") != F.col("itself")).withColumn("rank", F.col("rank") - (F.col("itself") < F.col("rank")).cast("int")).filter(F.col("rank") <= positives)
    share = lambda p, up: F.expr(f"(score div 100 - if(score % 100 < 0, 1, 0)) * {p} + (pmod(score, 100) * {p} + {99 if up else 0}) div 100")
    first = written(first.select("group", "place", (F.col("rank") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), share(low, True).cast("long").alias("low"), share(high, False).cast("long").alias("high")))
    norm = F.greatest(F.lit(1.0), F.col("top"))
    windows = first.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("place", "window", "low", "high"))).alias("windows"), F.min("low").alias("least"))
    # a bucket below this norm can't meet the least lower limit of any anchor of the block
    windows = windows.join(block.select("group", norm.alias("norm")), "group").select("group", "windows", (F.col("least") * (1 - 1e-12) / F.col("norm")).alias("reach"))
    second = round_of(windows, negatives, False, [])
    who = block.select("group", F.posexplode(F.arrays_zip("ids", "copies")).alias("place", "a")).select("group", "place", F.col("a.ids").alias("anchor_id"), F.col("a.copies").alias("copies"))
    found = second.join(first.drop("low", "high"), ["group", "place", "window"]).join(who, ["group", "place"])
    found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
