"""Benchmark passages in documents, with edits, by CGK embedding and bit sampling.

The CGK random walk copies a sequence of words to a longer one, repeating a word
or going on as a random bit of (step, word) says; sequences at a small edit
distance get walks that meet again, so they differ in few places. Items and
item-sized windows of documents are embedded by several walks; hashes of sampled
places are the keys of many tables, and a window that shares a key with an item
is a candidate. Exact word edit distance between the item and the best part of
the text around the window decides.

Long items are cut into pieces of PIECE words and more, any of which makes a
candidate: the piece with the fewest edits has no more than its share. Each size
of piece gets as many walks as made passages with the most edits allowed need to
be met at the target recall.

Windows begin where one of an item's first 3e + 1 word trigrams stands, as many
words before it as in the item, whatever stands before: an edit spoils three
trigrams at most, so one of them is left in any passage with e edits. Such a
passage of n words keeps n - 2 - 3e of its trigrams in all, so windows with fewer
can't hold an item within the edits allowed and aren't embedded.

Items of one or two words allow no edits and are looked up as they stand; items
without words match nothing. Null and empty texts have no matches.
Rows with equal ids, or none, and equal items are matched each; an empty table, of
texts or of items, gives an empty result. Columns other than the id and text are
not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.toxicity import APART
from docloom.llm.wordarrays import RADIX, WordHasher, Words, mixed, slices

BLOCK_WORDS = 2_000_000  # of items that are indexed and broadcast at once
TARGET, TRIALS = 0.99, 400  # recall of passages with the most edits allowed; made passages that it is tried on
STEP, TABLES, SAMPLES = 4, 8, 6  # walks that are added at once
PIECE = 16  # words of an item's pieces, at least
RATIO = 1.1  # between sizes of windows
MIN_WORDS = 3
MOST_WAITING = 2_000_000  # words of texts that are embedded together
WALKS: dict = {}  # what walks_for has found; a plain dict, since functions in a cache are shipped by name to workers that may lack this package


def allowed(n, rate: float):
    """Edits allowed in an item of n words."""
    return np.floor(rate * np.asarray(n)).astype(np.int64)


def size_class(n: int) -> int:
    """The largest of the window sizes 3, ... growing by RATIO that is at most n."""
    size = MIN_WORDS
    while (after := max(size + 1, math.floor(size * RATIO))) <= n:
        size = after
    return size


def keys(h: np.ndarray, start: np.ndarray, length: np.ndarray, size: int, walks: int) -> np.ndarray:
    """Table keys of sequences h[start:start + length], a row for each, a column for each table.

    The walk is 2 * size steps long, in which it passes size words on average;
    beyond, places would be padding, equal in any two sequences.
    """
    steps = 2 * size
    draws = np.random.default_rng(size)
    out = np.zeros((len(start), walks * TABLES), np.uint64)
    if not len(h):
        return out
    for walk in range(walks):
        salt = draws.integers(0, 1 << 63, steps, dtype=np.uint64)
        wanted = np.array([draws.choice(steps, min(SAMPLES, steps), replace=False) for _ in range(TABLES)])
        tables = [np.flatnonzero((wanted == j).any(1)) + walk * TABLES for j in range(steps)]
        at = np.zeros(len(start), np.int64)
        for j in range(steps):
            word = np.where(at < length, h[np.minimum(start + at, len(h) - 1)], np.uint64(0))
            for t in tables[j]:
                out[:, t] = (out[:, t] + word + np.uint64(1)) * np.uint64(RADIX)
            at += (mixed(word ^ salt[j]) & np.uint64(1)).astype(np.int64)
    return mixed(out + (np.arange(walks * TABLES, dtype=np.uint64) + np.uint64(1000 * size)) * np.uint64(0x9E3779B97F4A7C15))


def walks_for(size: int, rate: float) -> int:
    """Walks in which TARGET of made passages, with the most edits allowed in a size class, share a key with their item; tried once for each size and rate."""
    if (size, rate) not in WALKS:
        WALKS[size, rate] = tried(size, rate)
    return WALKS[size, rate]


def tried(size: int, rate: float) -> int:
    """Walks as walks_for gives them, from made passages."""
    rng = np.random.default_rng(1000 + size)
    edits, n = most_edits(size, rate), max(size, top_words(size) - 1)
    words = lambda k: rng.integers(0, 1 << 63, k, dtype=np.uint64)
    items, texts, starts, trial, first = words(TRIALS * n), [], [], [], 0
    for i in range(TRIALS):
        own = passage = items[i * n : (i + 1) * n]
        for _ in range(edits):
            at, kind = rng.integers(len(passage)), rng.integers(3)  # a word goes, changes or comes
            passage = np.concatenate([passage[:at], words(min(kind, 1)), passage[at + (kind < 2) :]])
        texts.append(np.concatenate([words(n), passage, words(n)]))
        where = {x: j for j, x in enumerate(texts[-1].tolist())}
        begins = set()
        for k in range(min(3 * edits + 1, n - 2)):
            j = where.get(int(own[k]))
            if j is not None and (texts[-1][j : j + 3] == own[k : k + 3]).all():
                begins.add(first + j - k)
        starts += begins
        trial += [i] * len(begins)
        first += len(texts[-1])
    h, start, trial = np.concatenate(texts), np.array(starts), np.array(trial)
    met, walks = np.zeros(TRIALS, bool), 0
    while met.mean() < TARGET:
        walks += STEP
        same = keys(items, np.arange(TRIALS) * n, np.full(TRIALS, size), size, walks)[trial] == keys(h, start, np.full(len(start), size), size, walks)
        met[trial[same.any(1)]] = True
    return walks


def top_words(size: int) -> int:
    """The longest item of a size class, about."""
    return math.ceil(size * RATIO)


def most_edits(size: int, rate: float) -> int:
    return int(allowed(top_words(size), rate))


def leads(h: np.ndarray, first: np.ndarray, counts: np.ndarray, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first 3 * edits + 1 trigrams of sequences h[first:first + counts], ascending, and their places in them."""
    gram, offset = [], []
    for k in range(3 * edits + 1):
        a = first[counts >= k + 3] + k
        gram.append(mixed((h[a] * np.uint64(RADIX) + h[a + 1]) * np.uint64(RADIX) + h[a + 2]))
        offset.append(np.full(len(a), k))
    gram, offset = np.concatenate(gram), np.concatenate(offset)
    order = np.lexsort((offset, gram))
    gram, offset = gram[order], offset[order]
    new = np.append(True, (gram[1:] != gram[:-1]) | (offset[1:] != offset[:-1]))
    return gram[new], offset[new]


class Items:
    """One block of items: words, trigrams and keys."""

    def __init__(self, ids: list, texts: list, rate: float):
        self.rate = rate
        w = WordHasher(APART)(pa.array(texts, pa.string()))
        self.hash, self.first, self.counts = w.hash, w.first, w.counts
        self.ids = ids
        at, grams = w.windows(3)
        self.grams = np.unique(grams)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.grams >> np.uint64(42)).astype(np.int64)] = True
        self.short = {}
        for n in range(1, MIN_WORDS):
            own = np.flatnonzero(self.counts == n)
            at, h = w.windows(n)
            h = h[np.searchsorted(at, self.first[own])]
            order = np.argsort(h, kind="stable")
            self.short[n] = (h[order], own[order])
        own = np.flatnonzero(self.counts >= MIN_WORDS)
        n_pieces = np.maximum(self.counts[own] // PIECE, 1)
        # pieces of an item are as long as each other, to a word
        item = np.repeat(own, n_pieces)
        k = np.arange(len(item)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        parts = np.repeat(n_pieces, n_pieces)
        self.item, self.before = item, self.counts[item] * k // parts
        begin, length = self.first[item] + self.before, self.counts[item] * (k + 1) // parts - self.before
        classes = np.array([size_class(int(n)) for n in length], np.int64)
        found, who, self.leads, self.walks = [], [], {}, {}
        self.sizes = np.unique(classes).tolist()
        for size in self.sizes:
            own = np.flatnonzero(classes == size)
            self.walks[size] = walks_for(size, rate)
            self.leads[size] = leads(self.hash, begin[own], length[own], most_edits(size, rate))
            k = keys(self.hash, begin[own], np.minimum(length[own], size), size, self.walks[size])
            found.append(k.ravel())
            who.append(np.repeat(own, k.shape[1]))
        all_keys, all_who = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (found, who))
        order = np.argsort(all_keys, kind="stable")
        self.keys, self.who = all_keys[order], all_who[order].astype(np.int64)

    @classmethod
    def of(cls, fields: dict) -> Items:
        out = cls.__new__(cls)
        out.__dict__.update(fields)
        return out

    def windows(self, w) -> list[tuple[int, np.ndarray]]:
        """size, first words of the windows to embed."""
        at, grams = w.windows(3)
        maybe = np.flatnonzero(self.sieve[(grams >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.grams, grams[maybe]), max(len(self.grams) - 1, 0))
        met = maybe[self.grams[place] == grams[maybe]] if len(self.grams) else maybe[:0]
        hits, h = at[met], grams[met]
        if not len(hits):
            return []
        out = []
        for size in self.sizes:
            edits = most_edits(size, self.rate)
            gram, offset = self.leads[size]
            lo, hi = np.searchsorted(gram, h, "left"), np.searchsorted(gram, h, "right")
            n = hi - lo
            lead = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
            at_hit = np.repeat(hits, n)
            doc = w.doc[at_hit]
            key = np.unique(np.column_stack([doc, np.maximum(at_hit - offset[lead], w.first[doc])]), axis=0)
            doc, starts = key[:, 0], key[:, 1]
            # edits before the trigram move the window by as many words
            within = np.searchsorted(hits, np.minimum(starts + top_words(size) + 2 * edits - 2, w.first[doc + 1])) - np.searchsorted(hits, np.maximum(starts - edits, w.first[doc]))
            starts = starts[within >= max(1, size - 2 - 3 * edits)]
            if len(starts):
                out.append((size, starts))
        return out

    def short_places(self, w) -> tuple[np.ndarray, np.ndarray]:
        """(first word, item) of places of items of fewer than MIN_WORDS words."""
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for n, (known, item) in self.short.items():
            if len(known):
                at, h = w.windows(n)
                lo = np.searchsorted(known, h)
                times = np.searchsorted(known, h, "right") - lo
                found.append((np.repeat(at, times), item[np.repeat(lo - np.cumsum(times) + times, times) + np.arange(times.sum())]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def candidates(self, w) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first word, item) of places where a window shares a key with a piece of the item; the first word may lie before the row."""
        found = []
        for size, starts in self.windows(w):
            length = np.minimum(size, w.first[w.doc[starts] + 1] - starts)
            k = keys(w.hash, starts, length, size, self.walks[size])
            lo, hi = np.searchsorted(self.keys, k.ravel(), "left"), np.searchsorted(self.keys, k.ravel(), "right")
            met = np.flatnonzero(hi > lo)
            n = hi[met] - lo[met]
            piece = self.who[np.repeat(lo[met] - np.cumsum(n) + n, n) + np.arange(n.sum())]
            at = np.repeat(starts[met // k.shape[1]], n)
            found.append(np.unique(np.column_stack([w.doc[at], at - self.before[piece], self.item[piece]]), axis=0))
        return tuple(np.unique(np.concatenate(found), axis=0).T) if found else (np.zeros(0, np.int64),) * 3

    def matches(self, w) -> list[tuple[int, int, int, int, int]]:
        """(row, item, first word, last word + 1, edits) of verified places, words counted within the row."""
        rows, starts, items = self.candidates(w)
        out = [(int(w.doc[at]), int(item), int(at - w.first[w.doc[at]]), int(at - w.first[w.doc[at]] + self.counts[item]), 0) for at, item in zip(*self.short_places(w), strict=True)]
        order = np.lexsort((starts, items, rows)) if len(starts) else []
        done = (-1, -1, -1)
        for i in order:
            row, start, item = int(rows[i]), int(starts[i]), int(items[i])
            if (row, item) == done[:2] and start < done[2]:
                continue
            n = int(self.counts[item])
            most = int(allowed(n, self.rate))
            lo, hi = max(int(w.first[row]), start - n // 2 - most), min(int(w.first[row + 1]), start + n + n // 2 + most)
            # each word of the item that the text lacks costs an edit
            if n - np.isin(self.hash[self.first[item] : self.first[item] + n], w.hash[lo:hi]).sum() > most:
                continue
            edits, a, b = closest(self.hash[self.first[item] : self.first[item] + n], w.hash[lo:hi])
            if edits <= most:
                out.append((row, item, lo + a - int(w.first[row]), lo + b - int(w.first[row]), edits))
                done = (row, item, lo + b - n // 4)
        return out


def closest(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least word edits between item and any part of text, and that part; exact, by dynamic programming."""
    m = len(text)
    cost, origin = np.zeros(m + 1, np.int64), np.arange(m + 1)
    ramp = np.arange(m + 1)
    for i, word in enumerate(item, 1):
        step = np.empty(m + 1, np.int64)
        step[0] = i
        step[1:] = np.minimum(cost[:-1] + (text != word), cost[1:] + 1)
        start = np.zeros(m + 1, np.int64)
        start[1:] = np.where(step[1:] == cost[:-1] + (text != word), origin[:-1], origin[1:])
        # words of text left over: a running minimum of step - place
        key = (step - ramp) * (2 * m + 4) + (m + 1 - ramp)
        best = np.minimum.accumulate(key)
        back = m + 1 - best % (2 * m + 4)
        cost, origin = step[back] + ramp - back, start[back]
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), end


def gathered(hashes: list[np.ndarray]) -> Words:
    """Texts given by their words' hashes, a row each."""
    sizes = np.array([len(h) for h in hashes])
    return Words(None, np.zeros(len(hashes) + 1, np.int64), None, None, np.repeat(np.arange(len(hashes)), sizes), np.concatenate(hashes))


def find(docs: DataFrame, benchmark: DataFrame, rate: float = 0.15, id_col: str = "doc_id") -> DataFrame:
    """id_col, item_id, first_word, end_word, edits, item_words: each place of each item in each whole text.

    rate: edits allowed for each word of an item. Items are indexed in blocks of
    about BLOCK_WORDS words, so what is broadcast at once is bounded.
    """
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0] // 5
    blocks = size // BLOCK_WORDS + 1
    parts = []
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        parts.append(matched(docs, Items([r["item_id"] for r in own], [r["text"] for r in own], rate), benchmark.schema["item_id"].dataType, id_col))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def matched(docs: DataFrame, index: Items, item_type, id_col: str) -> DataFrame:
    kept = docs.sparkSession.sparkContext.broadcast(index.__dict__)  # plain arrays: workers may lack this package
    names = ["first_word", "end_word", "edits", "item_words"]
    schema = docs.select(F.col(id_col).alias("id"), F.lit(None).cast(item_type).alias("item_id"), *[F.lit(0).cast("long").alias(c) for c in names]).schema

    def search(batches):
        ix, hasher = Items.of(kept.value), WordHasher(APART)
        ids, hashes = [], []

        def flush():
            rows = ix.matches(gathered(hashes))
            if rows:
                row, item, a, b, e = map(list, zip(*rows, strict=True))
                found = pa.concat_arrays(ids).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([found, pa.array([ix.ids[i] for i in item]), *[pa.array(v, pa.int64()) for v in (a, b, e)], pa.array([int(ix.counts[i]) for i in item], pa.int64())], ["id", "item_id", *names])
            ids.clear()
            hashes.clear()

        for batch in batches:
            for part in slices(batch):
                w = hasher(part.column(1))
                rows = np.unique(np.concatenate([w.doc[ix.short_places(w)[0]], *[w.doc[starts] for _, starts in ix.windows(w)]]))
                if len(rows):
                    # embedding is cheap for many windows at once: texts that have any wait for each other
                    ids.append(part.column(0).take(pa.array(rows)))
                    hashes += [w.hash[w.first[r] : w.first[r + 1]].copy() for r in rows]
                    if sum(map(len, hashes)) > MOST_WAITING:
                        yield from flush()
        if ids:
            yield from flush()

    return docs.select(F.col(id_col).alias("id"), "text").mapInArrow(search, schema).withColumnRenamed("id", id_col)
