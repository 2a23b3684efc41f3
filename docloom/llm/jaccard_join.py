"""N-gram Jaccard join by prefix filters under several global token orders.

A document's set is its distinct five-word shingles. If two sets have a Jaccard
similarity of t or more, then under any order of all tokens the first
|x| - ceil(t |x|) + 1 tokens of both have one in common. The first order puts
frequent tokens last and the rest by hash: tokens met in its prefixes make the
buckets from which candidates come, if what follows the token is long enough in
both sets. Other orders, by other hashes, then must
agree, on short fingerprints of their prefixes; what passes all is verified on
the whole sets. Each class is first verified with one of those it may link to; of the
other pairs only those are whose ends haven't been linked to one class by that.

Only components are wanted, so large groups aren't expanded into pairs. Equal sets
are one class from the start. A bucket of few members gives its pairs. A larger
one has a pivot, the member with the largest share of frequent tokens; its members
meet the pivot only, and buckets with one pivot make one star. Links found so far
make components. A star that still lies in several has all its members outside the
pivot's component compared with each other and with the rest, in blocks of bounded
size, and a block returns no more links than it joins components. Every pair that
may link is thus compared, or lies in one component already: the result is exact
(with 64-bit hashes of shingles and classes, and 48 bits of shingles in comparisons).

Null and empty texts, and those without words, have empty sets and stay alone.
A text of fewer words than a shingle is one token. Rows with a null id take part
and their component is the least id that isn't null. Rows with equal ids are
documents of their own, one row each. An empty table gives an empty result.
Columns other than the id and the text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, checkpointed, few, partitions, semi_join, small_batches, written
from docloom.llm.components import components
from docloom.llm.wordarrays import RADIX, WordHasher, mixed, slices

WORDS = 5
PERCENT = 80
LOCAL, FREQUENT, MOST_FREQUENT = 3, 64, 1_000_000  # documents with a token, in a part of a task and in all; tokens put last
BUCKET = 64  # members of a bucket whose pairs are taken as they are
BLOCK_ROWS, BLOCK_TOKENS = 400, 1_000_000  # of a star: the most in a block
PART_ROWS = 2_000_000  # prefix tokens that a task gathers
WAITING = 2_000_000  # tokens that a task holds before it counts or sends them
CUT = np.uint64(16)
KNOWN = 100_000  # classes that a task remembers to have sent
ORDERS = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
#: A prefix token as sent: 48 bits of it, for a chance meeting only makes a candidate more; its class, the set's size and share of frequent tokens, its place.
SENT = np.dtype([("high", "<u4"), ("low", "<u2"), ("pos", "<u2"), ("sig", "<i8"), ("n", "<i4"), ("central", "<i2")])
MET = "token long, a long, b long, na long, nb long, pos long, central long"


def prefix(n):
    """Length of the prefix of a set of n tokens."""
    return n - (PERCENT * n + 99) // 100 + 1


def sets(hasher: WordHasher, texts: pa.Array):
    """Each text's tokens, distinct and ascending."""
    w = hasher(texts)
    at, h = w.windows(WORDS)
    edge = np.searchsorted(w.doc[at] if len(at) else np.zeros(0, np.int64), np.arange(w.n_docs + 1))
    for i, n in enumerate(w.counts):
        if n >= WORDS:
            s = np.sort(h[edge[i] : edge[i + 1]])
            yield s[np.append(True, s[1:] != s[:-1])]
        elif n:
            token = 0
            for x in w.hash[w.first[i] : w.first[i + 1]].tolist():
                token = (token * RADIX + x) % (1 << 64)
            yield mixed(np.array([(token + 7919 * int(n)) % (1 << 64)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> int:
    """A hash of a set, from its distinct tokens in order."""
    total = np.sum(mixed(s ^ np.uint64(RADIX)) * (mixed(s) | np.uint64(1)), dtype=np.uint64)
    return int(mixed(np.array([total + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def classes(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for each document, id, n, sig, and rows token, count of tokens that many documents of a task have."""
    schema = docs.select(F.col(id_col).alias("id"), *[F.lit(None).cast("long").alias(c) for c in ("n", "sig", "token", "count")]).schema
    schema["id"].nullable = True  # rows of tokens have none
    names = schema.names

    def counted(batches):
        hasher, waiting, size = WordHasher(SPACES), [], 0
        id_type = None

        def frequent():
            s = np.sort(np.concatenate(waiting))
            begin = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
            n = np.diff(np.append(begin, len(s)))
            keep = n >= LOCAL
            none = pa.nulls(int(keep.sum()), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(int(keep.sum()), id_type), none, none, pa.array(s[begin[keep]].view(np.int64)), pa.array(n[keep].astype(np.int64))], names)

        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch):
                n, sigs = [], []
                for s in sets(hasher, part.column(1)):
                    n.append(len(s))
                    sigs.append(signature(s))
                    waiting.append(s)
                none = pa.nulls(part.num_rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sigs, pa.int64()), none, none], names)
                size += sum(n)
                if size >= WAITING:
                    yield frequent()
                    waiting, size = [], 0
        if size:
            yield frequent()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(counted, schema)


def buckets(docs: DataFrame, text_col: str, frequent: np.ndarray, parts: int) -> DataFrame:
    """Rows of MET: pairs (a, b) that fit in a bucket of the first order's prefixes, without a token; members a of larger buckets with it.

    Tasks send packed arrays, a row for each part of the token space; frequent
    tokens are dealt out by class too, so that no part holds all of one.
    """
    last = docs.sparkSession.sparkContext.broadcast(frequent)
    deal = 4 * parts

    def sent(batches):
        hasher, seen, waiting, size = WordHasher(SPACES), set(), [], 0
        short = np.unique(last.value >> CUT)

        def flush():
            rows = np.concatenate(waiting)
            token, sig = token_of(rows), rows["sig"].astype(np.int64).view(np.uint64)
            to = (mixed(np.where(member(token, short), token ^ mixed(sig), token)) % np.uint64(deal)).astype(np.int32)
            order = np.argsort(to, kind="stable")
            rows, to = rows[order], to[order]
            begin = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
            end = np.append(begin[1:], len(to))
            return pa.RecordBatch.from_arrays([pa.array(to[begin]), pa.array([rows[a:b].tobytes() for a, b in zip(begin, end, strict=True)], pa.binary())], ["part", "rows"])

        for batch in batches:
            for part in slices(batch):
                for s in sets(hasher, part.column(0)):
                    if not len(s):
                        continue
                    sig = signature(s)
                    if sig in seen:  # a copy of a set that this task has sent
                        continue
                    if len(seen) >= KNOWN:
                        seen.clear()
                    seen.add(sig)
                    late = member(s, last.value)
                    first = np.concatenate([s[~late], s[late]])[: prefix(len(s))]
                    rows = np.empty(len(first), SENT)
                    rows["high"], rows["low"] = first >> np.uint64(32), (first >> CUT) & np.uint64(0xFFFF)
                    rows["sig"], rows["n"], rows["pos"] = sig, len(s), np.minimum(np.arange(len(first)), (1 << 16) - 1)  # a lower bound does
                    rows["central"] = 10_000 * late.sum() // len(s)
                    waiting.append(rows)
                    size += len(rows)
                if size >= WAITING // 4:
                    yield flush()
                    waiting, size = [], 0
        if size:
            yield flush()

    def batch_of(**columns):
        n = len(columns["a"])
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[c]).astype(np.int64)) if c in columns else pa.nulls(n, pa.int64()) for c in names], names)

    names = [c.split()[0] for c in MET.split(", ")]

    def met(batches):
        rows = [np.frombuffer(x.as_buffer(), SENT) for batch in batches for x in batch.column(1)]
        if not rows:
            return
        rows = np.concatenate(rows)
        token = token_of(rows)
        order = np.lexsort((rows["sig"], token))
        rows, token = rows[order], token[order]
        once = np.append(True, (token[1:] != token[:-1]) | (rows["sig"][1:] != rows["sig"][:-1]))
        rows, token = rows[once], token[once]
        edge = np.append(np.flatnonzero(np.append(True, token[1:] != token[:-1])), len(rows))
        size = np.repeat(np.diff(edge), np.diff(edge))
        large = np.flatnonzero((size > BUCKET) | member(token, np.unique(last.value >> CUT)))
        for i in range(0, len(large), 100_000):
            part = rows[large[i : i + 100_000]]
            yield batch_of(token=token[large[i : i + 100_000]].view(np.int64), a=part["sig"], na=part["n"], pos=part["pos"], central=part["central"])
        keep = size > 1
        keep[large] = False
        rows, token, size = rows[keep], token[keep], size[keep]
        found, n = [], 0
        for ahead in range(1, BUCKET):
            rows, token, size = (x[size > ahead] for x in (rows, token, size))
            if not len(rows):
                break
            both = token[:-ahead] == token[ahead:]
            x, y = rows[:-ahead][both], rows[ahead:][both]
            c = overlap(x["n"].astype(np.int64), y["n"])
            fits = (x["pos"] <= x["n"] - c) & (y["pos"] <= y["n"] - c)
            found.append(np.column_stack([z[f][fits] for f in ("sig", "n") for z in (x, y)]))
            n += len(found[-1])
            if n >= 500_000:
                yield distinct_pairs(found)
                found, n = [], 0
        if n:
            yield distinct_pairs(found)

    def distinct_pairs(found):
        rows = np.concatenate(found)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(1))]
        turned = rows[:, 2] > rows[:, 3]  # the smaller set is a, of equal ones that of the lesser class: its values travel
        rows[turned] = rows[turned][:, [1, 0, 3, 2]]
        return batch_of(a=rows[:, 0], b=rows[:, 1], na=rows[:, 2], nb=rows[:, 3])

    packed = docs.select(F.col(text_col).alias("text")).mapInArrow(sent, "part int, rows binary")
    return packed.repartition(parts, "part").mapInArrow(met, MET)


def token_of(rows: np.ndarray) -> np.ndarray:
    return (rows["high"].astype(np.uint64) << CUT) | rows["low"].astype(np.uint64)


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def packed_sets(docs: DataFrame, text_col: str, of) -> DataFrame:
    """sig, value: the class of each text's set, and what `of` makes of the set, as bytes."""

    def packed(batches):
        hasher = WordHasher(SPACES)
        for batch in batches:
            for part in slices(batch):
                own = [s for s in sets(hasher, part.column(0)) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in own], pa.int64()), pa.array(map(of, own), pa.binary())], ["sig", "value"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(packed, "sig long, value binary")


def six_bytes(s: np.ndarray) -> bytes:
    """The set with 48 bits of each token, ascending: enough to count what two documents share."""
    return np.sort(s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(data: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = data.reshape(-1, 6)
    return wide.view(np.uint64).ravel()


def order_marks(s: np.ndarray) -> bytes:
    """16-bit fingerprints of the set's prefix under each other order, that of mixed(token ^ salt)."""
    k = prefix(len(s))
    out = []
    for salt in ORDERS:
        h = mixed(s ^ salt)
        out.append((np.partition(h, k - 1)[:k] & np.uint64(0xFFFF)).astype("<u2").tobytes())
    return b"".join(out)


def overlap(na, nb):
    """Tokens that sets of na and nb must share to have the similarity."""
    return -(-PERCENT * (na + nb) // (100 + PERCENT))


def alike_prefixes(x: np.ndarray, y: np.ndarray, nx: int, ny: int) -> bool:
    """Whether prefixes share, under every other order, as many fingerprints as the similarity asks for.

    Sets that share c tokens share l of them in their first n - c + l ones, whatever the order.
    """
    c = overlap(nx, ny)
    i, j = len(x) // len(ORDERS), len(y) // len(ORDERS)
    least = min(i - nx, j - ny) + c
    return all(int(np.isin(x[k * i : (k + 1) * i], y[k * j : (k + 1) * j]).sum()) >= least for k in range(len(ORDERS)))


def compared(pairs: DataFrame, values: DataFrame, alike) -> DataFrame:
    """Pairs (a, b, na, nb) for which alike(value of a, value of b, na, nb) holds; values: sig and value."""
    columns = ["a", "b", "na", "nb"]

    def kept(batches):
        for batch in batches:
            yes = [alike(np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8), i.as_py(), j.as_py()) for i, j, x, y in zip(*[batch.column(k) for k in range(2, 6)], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in range(4)], columns).filter(pa.array(yes, pa.bool_()))

    both = pairs.join(values.toDF("a", "__x"), "a").join(values.toDF("b", "__y"), "b")
    return both.select(*columns, "__x", "__y").mapInArrow(kept, "a long, b long, na long, nb long")


def packer(docs: DataFrame, id_col: str, text_col: str, firsts: DataFrame, repeated_ids: bool):
    """A function (sigs, of): packed_sets of the classes in sigs, from the text of the first document that has each."""

    def packed(sigs: DataFrame, of) -> DataFrame:
        ids = checkpointed(sigs.join(firsts, "sig").select(F.col("first_id").alias(id_col)))
        made = packed_sets(semi_join(docs, ids, id_col), text_col, of)
        return made.dropDuplicates(["sig"]) if repeated_ids else made

    return packed


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()


def nearest(pairs: DataFrame) -> DataFrame:
    """Of pairs a part that has each class: that with the least of those it is paired with."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("nb").alias("na"), F.col("na").alias("nb")))
    least = both.groupBy("a").agg(F.min(F.struct("b", "na", "nb")).alias("l")).select("a", "l.*")
    turned = F.struct("na", "a") > F.struct("nb", "b")  # as they were
    pick = lambda x, y, to: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(to)
    return least.select(pick("a", "b", "a"), pick("b", "a", "b"), pick("na", "nb", "na"), pick("nb", "na", "nb")).distinct()


def linked(likely: DataFrame, packed) -> DataFrame:
    """Labels (node, component) of what pairs whose sets are alike make: one pair of each class, then those whose ends aren't linked to one class by that."""
    of = lambda pairs: compared(pairs, written(packed(ends_of(pairs), six_bytes)), by_sets)
    some = checkpointed(nearest(likely))
    links = checkpointed(of(some).select("a", "b"))
    hubs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy("a").agg(F.least("a", F.min("b")).alias("hub"))
    apart = labelled(labelled(likely, hubs, "a", "ha"), hubs, "b", "hb").filter("ha <> hb").select("a", "b", "na", "nb")
    rest = checkpointed(apart.join(some.select("a", "b"), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        links = links.unionByName(of(rest).select("a", "b"))
    return components(links, "a", "b")


def by_marks(x, y, nx, ny):
    return alike_prefixes(x.view("<u2"), y.view("<u2"), nx, ny)


def by_sets(x, y, nx, ny):
    both = int(member(from_six(x), from_six(y)).sum())
    return 100 * both >= PERCENT * (nx + ny - both)


def fit(na: str, nb: str, pa_: str, pb: str):
    """Whether sets of na and nb tokens can have the similarity if the token at these positions is their first common one.

    All that they share then stands from there on. The pair's first common token
    passes, so no pair is lost; frequent tokens stand late and seldom pass.
    """
    c = F.floor((PERCENT * (F.col(na) + F.col(nb)) + 99 + PERCENT) / (100 + PERCENT))
    return (F.col(pa_) <= F.col(na) - c) & (F.col(pb) <= F.col(nb) - c)


def stars(members: DataFrame) -> DataFrame:
    """p, a, np, na, near: the members a of large buckets by the pivot p of their star; near: whether the two fit in a bucket of p's.

    A bucket's pivot is its most central member. One that is a member of buckets
    with more central pivots hands its own over to the first of these, so that a
    group of near copies, which shares many tokens, makes few stars.
    """
    rank = [-F.col("central"), F.xxhash64("a"), F.col("a").alias("p"), F.col("na").alias("np"), F.col("pos").alias("pp")]
    pivots = members.groupBy("token").agg(F.min(F.struct(*rank)).alias("first"), F.count("*").alias("size")).filter("size > 1").select("token", "first")
    met = members.join(F.broadcast(pivots) if few(pivots, 200_000) else pivots, "token")
    own = pivots.select(F.col("first.p").alias("a")).distinct()
    heads = met.join(F.broadcast(own) if few(own, 1_000_000) else own, "a", "left_semi").groupBy("a").agg(F.min("first").alias("head"))
    heads = checkpointed(heads.select(F.col("a").alias("__p"), F.col("head.p").alias("p"), F.col("head.np").alias("np")))
    near = fit("na", "first.np", "pos", "first.pp")
    rows = met.select("a", "na", F.col("first.p").alias("__p"), near.alias("near")).groupBy("__p", "a").agg(F.first("na").alias("na"), F.max("near").alias("near"))
    rows = rows.join(F.broadcast(heads) if few(heads, 1_000_000) else heads, "__p")
    return rows.groupBy("p", "a").agg(F.first("np").alias("np"), F.first("na").alias("na"), F.max(F.col("near") & (F.col("p") == F.col("__p"))).alias("near"))


def blocks(rows: str, tokens: str):
    """Into how many blocks so many members with so many tokens go."""
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.coalesce(tokens, F.lit(0)) / BLOCK_TOKENS)).cast("int")


def cells(rows: DataFrame) -> DataFrame:
    """rows (p, a, na, ca, inner, value) dealt to cells: p, kind, i, j, side, a, na, ca, value.

    Members outside the pivot's component meet each other (kind 0) and those in it
    (kind 1), block by block. A pair of blocks is a cell, which one task reads. A
    star that fits in a block is one cell, with those in the component as side 2.
    """
    counts = [f(F.when(F.col("inner") == side, x)).alias(f"{name}_{side}".lower()) for side in (True, False) for name, f, x in (("rows", F.count, F.lit(1)), ("tokens", F.sum, F.col("na")))]
    open_ = rows.groupBy("p").agg(*counts).filter("rows_false > 0 and rows_true + rows_false > 1")
    small = (F.col("rows_true") + F.col("rows_false") <= BLOCK_ROWS) & (F.coalesce("tokens_true", F.lit(0)) + F.col("tokens_false") <= BLOCK_TOKENS)
    open_ = open_.select("p", small.alias("small"), blocks("rows_true", "tokens_true").alias("inside"), blocks("rows_false", "tokens_false").alias("outside"))
    own, upto = F.col("own"), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.col(n), F.lit(1))), lambda i: i - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    across = F.transform(upto("outside"), lambda i: cell(1, i, own, F.lit(1)))
    around = F.concat(
        F.transform(upto("outside"), lambda j: cell(0, F.least(own, j), F.greatest(own, j), F.when(own <= j, 0).otherwise(1))),
        F.transform(upto("inside"), lambda j: cell(1, own, j, F.lit(0))),
    )
    dealt = rows.join(F.broadcast(open_) if few(open_, 200_000) else open_, "p")
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("a", F.lit(1)), F.greatest(F.when(F.col("inner"), F.col("inside")).otherwise(F.col("outside")), F.lit(1))).cast("int"))
    one = F.array(cell(0, F.lit(0), F.lit(0), F.when(F.col("inner"), 2).otherwise(0)))
    return dealt.select("p", "a", "na", "ca", "value", F.explode(F.when(F.col("small"), one).when(F.col("inner"), across).otherwise(around)).alias("cell")).select("p", "cell.*", "a", "na", "ca", "value")


def labelled(rows: DataFrame, labels: DataFrame, c: str, name: str) -> DataFrame:
    """rows with the component of c as name; c itself where it has no label."""
    return rows.join(labels.toDF("__node", name), F.col(c) == F.col("__node"), "left").withColumn(name, F.coalesce(name, c)).drop("__node")


def star_links(star: DataFrame, labels: DataFrame, marks: DataFrame, packed) -> DataFrame | None:
    """Links (a, b) between different components within stars, enough of them to join all that are linked; None if no star has any.

    A first pass over fingerprints finds the members that may link; sets of only these are compared.
    """
    named = labelled(labelled(star, labels, "a", "ca"), labels, "p", "cp").select("p", "a", "na", "ca", (F.col("ca") == F.col("cp")).alias("inner"))
    named = checkpointed(named.join(named.filter("not inner").select("p").distinct(), "p", "left_semi"))
    if named.isEmpty():
        return None
    own = semi_join(marks, named.select(F.col("a").alias("sig")).distinct(), "sig")
    rows = named.join(own.toDF("a", "value"), "a")
    maybe = checkpointed(cells(rows).groupBy("p", "kind", "i", "j").applyInArrow(cell_members, "p long, a long, na long, ca long, inner boolean").distinct())
    rows = maybe.join(packed(maybe.select(F.col("a").alias("sig")).distinct(), six_bytes).toDF("a", "value"), "a")
    return cells(rows).groupBy("p", "kind", "i", "j").applyInArrow(cell_links, "a long, b long")


class Postings:
    """Who of several lists has a number: counts of what a list shares with each of them."""

    def __init__(self, lists: list[np.ndarray]):
        number, who = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(number, kind="stable")
        self.number, self.who, self.size = number[order], who[order], len(lists)

    def shared(self, own: np.ndarray) -> np.ndarray:
        lo = np.searchsorted(self.number, own)
        n = np.searchsorted(self.number, own, side="right") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.bincount(self.who[at], minlength=self.size)


def cell_of(key, rows: pa.Table, dtype: str):
    """a, n, c, values, and the places of a cell's two sides; a cell of one block has it on both."""
    kind, i, j = (k.as_py() for k in key[1:])
    a, n, c, side = (rows.column(x).to_numpy() for x in ("a", "na", "ca", "side"))
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side != 1 if kind == 0 and i == j else side == 1)
    values = [np.frombuffer(x.as_buffer(), dtype) for x in rows.column("value").combine_chunks()] if len(left) and len(right) else []
    return a, n, c, values, left, right


def cell_members(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """The members of a cell that may link to one on its other side, by fingerprints: p, a, na, ca, inner."""
    a, n, c, values, left, right = cell_of(key, rows, "<u2")
    hit = np.zeros(len(a), bool)
    if values:
        cut = lambda x, k: x[k * len(x) // len(ORDERS) : (k + 1) * len(x) // len(ORDERS)]
        posted = [Postings([np.unique(cut(values[y], k)) for y in right]) for k in range(len(ORDERS))]
        length = np.array([len(x) // len(ORDERS) for x in values])
        for x in left.tolist():
            both = overlap(n[x], n[right])
            least = np.minimum(length[x] - n[x], length[right] - n[right]) + both
            maybe = (c[right] != c[x]) & (both <= np.minimum(n[x], n[right]))
            for k, lists in enumerate(posted):
                if maybe.any():
                    maybe &= lists.shared(cut(values[x], k)) >= least
            hit[right[maybe]] = True
            hit[x] |= maybe.any()
    side = rows.column("side").to_numpy()
    inner = (side == 2) | ((side == 1) & (key[1].as_py() == 1))
    return pa.table({"p": pa.array([key[0].as_py()] * int(hit.sum()), pa.int64()), "a": pa.array(a[hit]), "na": pa.array(n[hit]), "ca": pa.array(c[hit]), "inner": pa.array(inner[hit])})


def cell_links(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Links that join the components of a cell's two sides, no more than join them."""
    a, n, c, values, left, right = cell_of(key, rows, "u1")
    found, root = [], {x: x for x in c.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    if values:
        tokens = list(map(from_six, values))
        posted = Postings([tokens[y] for y in right])
        for x in left.tolist():
            both = posted.shared(tokens[x])
            linked = right[(100 * both >= PERCENT * (n[x] + n[right] - both)) & (c[right] != c[x])]
            for y in linked[np.unique(c[linked], return_index=True)[1]].tolist():
                if (u := find(c[x])) != (v := find(c[y])):
                    root[u] = v
                    found.append((a[x], a[y]))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(id_col, text_col)
    rows = written(classes(docs, id_col, text_col))
    own = rows.filter("n is not null").select("id", "n", "sig")
    counts = rows.filter("token is not null").groupBy("token").agg(F.sum("count").alias("count")).filter(F.col("count") >= FREQUENT)
    top = counts.orderBy(F.desc("count"), "token").limit(MOST_FREQUENT).select("token").toPandas()["token"].to_numpy(dtype=np.int64)
    prefixes = own.agg(F.sum(F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1)).first()[0] or 0
    met = written(buckets(docs, text_col, np.sort(top.view(np.uint64)), max(partitions(spark), -(-int(prefixes) // PART_ROWS))))
    firsts = checkpointed(own.filter("n > 0").groupBy("sig").agg(F.min("id").alias("first_id")))
    repeated_ids = not own.groupBy("id").count().filter("count > 1").isEmpty()

    members = met.filter("token is not null").select("token", "a", "na", "pos", "central")
    pairs = met.filter("token is null").select("a", "b", "na", "nb")
    star = None if members.isEmpty() else checkpointed(stars(members))
    if star is not None:
        ends = F.sort_array(F.array(F.struct(F.col("na").alias("n"), F.col("a").alias("sig")), F.struct(F.col("np").alias("n"), F.col("p").alias("sig"))))
        rays = star.filter("near and a <> p").select(ends.alias("e")).select(F.col("e")[0]["sig"].alias("a"), F.col("e")[1]["sig"].alias("b"), F.col("e")[0]["n"].alias("na"), F.col("e")[1]["n"].alias("nb"))
        pairs = pairs.unionByName(rays)
    pairs = checkpointed(pairs.distinct())
    packed = packer(docs, id_col, text_col, firsts, repeated_ids)
    sigs = ends_of(pairs) if star is None else ends_of(pairs).unionByName(star.select(F.col("a").alias("sig"))).distinct()
    marks = written(packed(sigs, order_marks))
    likely = checkpointed(compared(pairs, marks, by_marks))
    labels = linked(likely, packed)
    more = None if star is None else star_links(star, labels, marks, packed)
    if more is not None and not (more := checkpointed(more)).isEmpty():
        labels = checkpointed(contracted(labels, more))

    named = firsts.join(labels, firsts["sig"] == labels["node"], "left").select("sig", "first_id", F.coalesce("component", "sig").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    by_class = named.join(least, "component").select("sig", "component_id")
    alone = own.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = own.filter("n > 0").join(by_class, "sig").select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def contracted(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links: components of components."""
    of = lambda c: links.select("a", "b").join(labels, F.col(c) == F.col("node"), "left")
    named = of("a").select("b", F.coalesce("component", "a").alias("ca")).join(labels, F.col("b") == F.col("node"), "left").select("ca", F.coalesce("component", "b").alias("cb"), "b")
    fresh = components(named, "ca", "cb").toDF("__node", "__component")
    grown = labels.join(fresh, F.col("component") == F.col("__node"), "left").select("node", F.coalesce("__component", "component").alias("component"))
    more = fresh.join(labels, F.col("__node") == F.col("node"), "left_anti").select(F.col("__node").alias("node"), F.col("__component").alias("component"))
    return grown.unionByName(more)
