"""Language by rank-order profiles of n-grams.

Words are runs of letters and marks, in lower case, with a blank before and after.
Their n-grams are runs of one to three characters, blanks at their ends only and a
blank alone not among them. A language's profile is the TOP most frequent n-grams of
all its learning texts, by count, of equal counts shorter ones first, then by code
points. A text's own
TOP n-grams are ranked likewise; a profile's out-of-place distance is the sum of the
differences of rank, TOP for an n-gram that the profile lacks. The least distance
wins, of equal ones the language first by code point. The score is 1 less the
distance over the largest possible, TOP for each of the text's n-grams.

A text that is null or has no letter is `und` with score 0, and so is every text if
nothing was learnt. Rows are judged each, whatever their ids; learning takes rows as
often as they stand there, whose lang isn't null. Whole texts are read, in learning
too; counts of n-grams are added up where they are found before they are shuffled.
Profiles go to the tasks for `LANGUAGES` languages at a time, one pass of texts
through the workers for each such block, so their size is bounded.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, written
from docloom.llm.wordarrays import WordHasher, slices

TOP = 300
#: Languages whose profiles are in memory at once: TOP * 12 bytes each, and a table of the n-grams in them.
LANGUAGES = 500
#: Counts of n-grams that a worker holds before it passes them on.
HELD = 1_000_000
#: ASCII characters that are no letters.
APART = bytes(b for b in range(128) if not chr(b).isalpha())
BITS = np.uint64(21)
#: No letter has a code point of this or more.
PLANES = 0x40000


class Grams:
    """The n-grams of the texts of a column."""

    def __init__(self):
        self.words = WordHasher(APART)
        lowered, letter = np.arange(sys.maxunicode + 1, dtype=np.uint32), np.zeros(sys.maxunicode + 1, bool)
        kind = np.full(sys.maxunicode + 1, ord("C"), np.uint8)
        kind[:PLANES] = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(PLANES)).encode("ascii"), np.uint8)
        letter[:] = kind == ord("L")
        for c in np.flatnonzero(letter):
            low = chr(c).lower()
            if len(low) == 1:
                lowered[c] = ord(low)
        lowered[~(letter | (kind == ord("M")))] = 32
        self.lowered, self.letter = lowered, letter

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n-grams of the column, ascending; entries: row, rising, number of the n-gram, how often; which rows have a letter.

        Chunks between ASCII characters are taken apart once for each different one, and
        count once with their number in each text, so that what is held grows with a
        text's different words.
        """
        w = self.words(texts)
        _, first, chunk = np.unique(w.hash, return_index=True, return_inverse=True)
        if not len(first):
            return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3, np.zeros(w.n_docs, bool)
        order = np.sort(first)
        rank = np.empty(len(first), np.int64)
        rank[np.argsort(first)] = np.arange(len(first))
        pair, often = np.unique(w.doc * len(order) + rank[chunk], return_counts=True)
        doc, chunk = pair // len(order), pair % len(order)
        sizes = w.end[order] - w.start[order]
        at = np.repeat(w.start[order] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        raw = np.insert(w.data[at], np.cumsum(sizes), 32)  # a blank after each chunk
        points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        # the chunks' own blanks are those of the text, so ends are found by counting them
        of = np.concatenate([[0], np.cumsum(points[:-1] == 32)])
        has_letter = np.zeros(len(order), bool)
        has_letter[of[self.letter[points]]] = True
        c = np.concatenate([[32], self.lowered[points]]).astype(np.uint64)
        of = np.concatenate([[0], of])
        blank = c == 32
        grams, owner = [], []
        one = ~blank
        grams.append(c[one])
        owner.append(of[one])
        two = ~(blank[:-1] & blank[1:])
        pair = (c[:-1] << BITS) | c[1:]
        # an n-gram that begins with the blank before a chunk is that chunk's
        grams.append(pair[two])
        owner.append(np.where(blank[:-1], of[1:], of[:-1])[two])
        three = ~blank[1:-1]
        grams.append(((pair[:-1] << BITS) | c[2:])[three])
        owner.append(of[1:-1][three])
        keys, number = np.unique(np.concatenate(grams), return_inverse=True)
        owner = np.concatenate(owner)
        by = np.argsort(owner, kind="stable")
        number, counts = number[by], np.bincount(owner, minlength=len(order))
        begin = np.cumsum(counts) - counts
        times = counts[chunk]
        place = np.repeat(begin[chunk] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        rows = np.zeros(w.n_docs, bool)
        rows[doc[has_letter[chunk]]] = True
        return keys, np.repeat(doc, times), number[place], np.repeat(often, times), rows

    def counts(self, texts: pa.Array, group: np.ndarray, groups: int):
        """n-grams, and a matrix of counts: a row for each group of texts."""
        keys, row, number, often, _ = self(texts)
        return keys, tabulated(group[row], number, often, groups, len(keys))


def tabulated(row: np.ndarray, number: np.ndarray, often: np.ndarray, rows: int, columns: int) -> np.ndarray:
    """Entries added up in a matrix; sums are exact in doubles."""
    return np.bincount(row * columns + number, often, rows * columns).reshape(rows, columns).astype(np.int64)


def ranked(counts: np.ndarray, top: int) -> np.ndarray:
    """The numbers of the top entries above zero of each row, by falling count, of equal counts the smaller number first; -1 where there are fewer."""
    n = counts.shape[1]
    if not n:
        return np.full((len(counts), top), -1)
    code = counts * n + (n - 1 - np.arange(n))
    if n > top:
        code = -np.partition(-code, top - 1, axis=1)[:, :top]
    code = -np.sort(-code, axis=1)
    out = np.where(code >= n, n - 1 - code % n, -1)
    return out if n >= top else np.pad(out, ((0, 0), (0, top - n)), constant_values=-1)


def gram_counts(texts: DataFrame) -> DataFrame:
    """lang, gram, n over all rows of texts (lang, text)."""

    def counted(batches):
        of, held, size = Grams(), {}, 0

        def flush():
            for lang, (grams, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for part in slices(batch):
                langs, group = np.unique(part.column(0).to_pylist(), return_inverse=True)
                keys, counts = of.counts(part.column(1), group, len(langs))
                for i, lang in enumerate(langs.tolist()):
                    own = np.flatnonzero(counts[i])
                    old = held.get(lang, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
                    grams, inverse = np.unique(np.concatenate([old[0], keys[own]]), return_inverse=True)
                    held[lang] = grams, np.bincount(inverse, np.concatenate([old[1], counts[i][own]]), len(grams)).astype(np.int64)
                    size += len(grams) - len(old[0])
                if size > HELD:
                    yield from flush()
                    held, size = {}, 0
        yield from flush()

    return texts.select("lang", "text").mapInArrow(counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> DataFrame:
    """lang, grams: the profile of each language that has a letter in its texts, most frequent n-gram first."""
    small_batches(docs.sparkSession)
    counts = gram_counts(docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    best = counts.withColumn("rank", rank).filter(F.col("rank") <= top)
    own = best.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("g"))
    return own.select("lang", F.transform("g", lambda g: g["gram"]).alias("grams"))


class Nearest:
    """Distances of texts from the profiles of a block of languages."""

    def __init__(self, langs: list[str], profiles: list[list[int]], top: int):
        self.langs, self.top = langs, top
        self.grams = np.unique(np.array([g for p in profiles for g in p], np.uint64))
        self.ranks = np.full((len(langs), len(self.grams) + 1), -1, np.int32)  # the last column is of n-grams that no profile has
        for i, p in enumerate(profiles):
            self.ranks[i, np.searchsorted(self.grams, np.array(p, np.uint64))] = np.arange(len(p))

    def __call__(self, keys: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each text the number of the nearest language and its distance; own: the text's n-grams by rank as places in keys, -1 beyond."""
        at = np.minimum(np.searchsorted(self.grams, keys), max(0, len(self.grams) - 1))
        known = np.append(np.where(self.grams[at] == keys, at, len(self.grams)), len(self.grams))
        place, there = known[own], own >= 0
        best, lang = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.int64)
        mine = np.arange(own.shape[1])
        for i in range(len(self.langs)):
            theirs = self.ranks[i][place]
            distance = np.where(theirs < 0, self.top, np.abs(theirs - mine)) * there
            total = distance.sum(1)
            lang[total < best] = i
            best = np.minimum(best, total)
        return lang, best


def predict(docs: DataFrame, profiles: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", top: int = TOP) -> DataFrame:
    """id_col, held_out, lang_pred, score for every row of docs."""
    small_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("id"), held_out.alias("held_out"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("lang_pred"), F.lit(0.0).alias("score"))
    schema, name = out.schema, None
    known = written(profiles)
    while True:
        rest = known if name is None else known.filter(F.col("lang") > name)
        block = rest.orderBy("lang").limit(LANGUAGES).collect()
        if block:
            out = out.mapInArrow(judge(Nearest([r["lang"] for r in block], [r["grams"] for r in block], top)), schema)
        if len(block) < LANGUAGES:
            break
        name = block[-1]["lang"]
    return out.select(F.col("id").alias(id_col), "held_out", F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), "score")


def judge(nearest: Nearest):
    """Gives texts their nearest language of a block, unless one before is as near."""

    def judged(batches):
        of, names = Grams(), pa.array(nearest.langs, pa.string())
        for batch in batches:
            for part in slices(batch):
                n = part.num_rows
                keys, row, number, often, has = of(part.column(2))
                own = np.full((n, nearest.top), -1)
                # a matrix of some rows at a time
                step, first = max(1, (8 << 20) // max(1, len(keys))), np.searchsorted(row, np.arange(n + 1))
                for i in range(0, n, step):
                    j = min(n, i + step)
                    span = slice(first[i], first[j])
                    own[i:j] = ranked(tabulated(row[span] - i, number[span], often[span], j - i, len(keys)), nearest.top)
                lang, distance = nearest(keys, own)
                score = np.where(has, 1 - distance / np.maximum(1, (own >= 0).sum(1) * nearest.top), 0.0)
                before, old = np.asarray(part.column(4)), part.column(3)
                better = has & ((score > before) | np.asarray(old.is_null()))
                pred = pa.compute.if_else(pa.array(better), names.take(pa.array(lang)), old)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pred, pa.array(np.where(better, score, before))], part.schema.names)

    return judged
