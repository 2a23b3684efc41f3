"""Quality rules: counts of a text, and how far its histograms are from language references.

A language's reference is the mean histogram of character classes and of its most
common words over its documents that pass the base rules. A document's distance is
the Jensen-Shannon distance (base 2, 0 to 1) to its own language's reference; texts
under a minimum length are not judged by it, since short histograms are noise.

Counts are sums over all documents, the same however the table is cut. A null or
empty text has no words and fails the base rule. Where lang is null, or a language
has fewer than LEAST_DOCS documents to make a reference of, distances are null and
the verdict is the base rules'. Rows with equal ids, or none, are judged each. An
empty table gives an empty result. Columns other than doc_id, lang and text are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, checkpointed, written
from docloom.llm.wordarrays import WordHasher, mixed, per_doc, repeated, slices

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Byte classes of the character histogram, each with what it holds; the last is of code points beyond ASCII.
CLASSES = [bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(48, 58)), SPACES, b".,;:", b"!?", b"'\"()-", SYMBOLS, b"+/=@[]\\^_`{}~", bytes(range(0xC0, 256))]
LEAST_WORDS = 50  # of a text that is judged by its histograms
LEAST_DOCS = 20  # of a language that has a reference
COMMON = 40  # words of a language
MOST_LANGUAGES = 10_000  # with a reference; more is an error, since references are broadcast
WAITING = 500_000  # words with their counts that a task holds
UNIT = 1_000_000_000  # shares are summed as whole numbers of this part, so that their order doesn't matter


def common_words(docs: DataFrame) -> dict[str, list[int]]:
    """The most used words (hashes) of each language with LEAST_DOCS documents, of equal counts the least hash; all words are counted."""

    def counted(batches):
        hasher, waiting, size = WordHasher(SPACES), {}, 0

        def summed(name):
            terms, n = (np.concatenate(x) for x in zip(*waiting[name], strict=True))
            terms, place = np.unique(terms, return_inverse=True)
            return terms, np.bincount(place, n, len(terms)).astype(np.int64)

        def sent():
            for name in waiting:
                terms, n = summed(name)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(terms), pa.string()), pa.array(terms.view(np.int64)), pa.array(n)], ["lang", "term", "n"])

        for batch in batches:
            for part in slices(batch):
                w = hasher(part.column(1))
                lang = part.column(0).dictionary_encode()
                code = np.asarray(lang.indices.fill_null(-1), dtype=np.int64)
                of_word = code[w.doc]
                for k, name in enumerate(lang.dictionary.to_pylist()):
                    waiting.setdefault(name, []).append(np.unique(w.hash[of_word == k], return_counts=True))
                    size += len(waiting[name][-1][0])
                rows = [(name, int((code == k).sum())) for k, name in enumerate(lang.dictionary.to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.string()), pa.nulls(len(rows), pa.int64()), pa.array([n for _, n in rows], pa.int64())], ["lang", "term", "n"])
                if size > WAITING:
                    waiting = {name: [summed(name)] for name in waiting}
                    size = sum(len(x[0][0]) for x in waiting.values())
                    if size > WAITING // 2:
                        yield from sent()
                        waiting, size = {}, 0
        yield from sent()

    counts = docs.select(F.col("lang").cast("string").alias("lang"), "text").mapInArrow(counted, "lang string, term long, n long")
    counts = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    # the row without a term has the number of documents; each task keeps so many rows of a language before they meet
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.col("term").isNotNull(), F.desc("n"), "term"))
    rows = checkpointed(counts.withColumn("k", place).filter(F.col("k") <= COMMON + 1).select("lang", "term", "n"))
    large = rows.filter(F.col("term").isNull() & (F.col("n") >= LEAST_DOCS)).select("lang").limit(MOST_LANGUAGES + 1)
    found = rows.join(large, "lang", "left_semi").filter("term is not null").collect()
    out = {}
    for r in sorted(found, key=lambda r: (r["lang"], -r["n"], r["term"])):
        out.setdefault(r["lang"], []).append(r["term"])
    if len(out) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang have {LEAST_DOCS} documents each: not a column of languages")
    return out


def measured(docs: DataFrame, terms: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang, the base counts, and the histograms: code points by class, words by their place in the language's list with the rest at the end."""
    number_of = {name: k for k, name in enumerate(sorted(terms))}
    salt = mixed(np.arange(len(terms) + 1, dtype=np.uint64))  # the last is of documents without a language known here
    pairs = [(term, k, place) for name, k in number_of.items() for place, term in enumerate(terms[name])]
    key = mixed(np.array([t for t, _, _ in pairs], np.int64).view(np.uint64) ^ salt[[k for _, k, _ in pairs]]) if pairs else np.zeros(0, np.uint64)
    order = np.argsort(key)
    key, slot = key[order], np.array([p for _, _, p in pairs], np.int64)[order]
    base = docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), *[F.lit(0).cast("long").alias(c) for c in BASE], F.array(F.lit(0)).alias("classes"), F.array(F.lit(0)).alias("common"))
    schema = base.schema

    def count(batches):
        hasher, lines_of = WordHasher(SPACES, fold=False), WordHasher(b"\n", fold=False)
        folded = WordHasher(SPACES)
        tables = np.array([np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in CLASSES])
        symbol = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
        space = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))
        for batch in batches:
            for part in slices(batch):
                w = hasher(part.column(2))
                points = (w.data & 0xC0) != 0x80
                at, h = w.windows(WINDOW)
                edge = np.zeros(len(w.hash) + 1, np.int64)
                twice = at[repeated(w.doc[at], h)[0]]
                np.add.at(edge, twice, 1)
                np.add.at(edge, twice + WINDOW, -1)
                lines = lines_of.of(w.data, w.at)
                worded = per_doc(~space[w.data], np.column_stack([lines.start, lines.end]).ravel())[::2] > 0 if len(lines.start) else np.zeros(0, bool)
                again = np.zeros(len(lines.start), bool)
                again[worded] = repeated(lines.doc[worded], lines.hash[worded])[1]
                values = [w.counts, per_doc(points & ~space[w.data], w.at), per_doc(symbol[w.data], w.at), per_doc(again, lines.first), per_doc(np.cumsum(edge[:-1]) > 0, w.first)]
                classes = np.column_stack([per_doc(t[w.data], w.at) for t in tables]).astype(np.int32)
                term = folded.spans(w.data, w.start, w.end)
                own = np.array([number_of.get(x, len(number_of)) for x in part.column(1).to_pylist()], np.int64)
                wanted = mixed(term ^ salt[own[w.doc]])
                at = np.minimum(np.searchsorted(key, wanted), max(len(key) - 1, 0))
                number = np.where(key[at] == wanted, slot[at], COMMON) if len(key) else np.full(len(term), COMMON)
                common = np.bincount(w.doc * (COMMON + 1) + number, minlength=w.n_docs * (COMMON + 1)).astype(np.int32)
                lists = lambda a, width: pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * width, a.ravel())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(v.astype(np.int64)) for v in values], lists(classes, len(CLASSES)), lists(common, COMMON + 1)], schema.names)

    return docs.select(F.col("doc_id").alias("id"), F.col("lang").cast("string").alias("lang"), "text").mapInArrow(count, schema)


def references(counts: DataFrame, languages: list[str]) -> dict[str, tuple]:
    """A language's mean histograms, of those in languages; at most MOST_LANGUAGES rows come to the driver."""
    own = counts.filter(~F.col("base_failed") & (F.col("n_words") >= LEAST_WORDS) & F.col("lang").isNotNull())

    def summed(batches):
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            code = np.asarray(lang.indices, dtype=np.int64)
            shares = [np.rint(s * UNIT / np.maximum(s.sum(1, keepdims=True), 1)).astype(np.int64) for s in (matrix(batch.column(1)), matrix(batch.column(2)))]
            for k, name in enumerate(lang.dictionary.to_pylist()):
                if name in wanted:
                    rows = code == k
                    cells = np.concatenate([[rows.sum()], *[s[rows].sum(0) for s in shares]])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells)), pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells.astype(np.int64))], ["lang", "k", "v"])

    wanted = set(languages)
    cells = own.select("lang", "classes", "common").mapInArrow(summed, "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    lists = cells.groupBy("lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]).alias("v")).collect()
    size = len(CLASSES) + 1
    return {r["lang"]: (np.array(r["v"][1:size]) / (UNIT * r["v"][0]), np.array(r["v"][size:]) / (UNIT * r["v"][0])) for r in lists if r["v"][0] >= LEAST_DOCS}


def matrix(lists: pa.Array) -> np.ndarray:
    return np.asarray(lists.flatten(), dtype=float).reshape(len(lists), -1) if len(lists) else np.zeros((0, 1))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of p to q."""
    m = (p + q) / 2
    part = lambda a: np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(1)
    return np.sqrt(np.clip((part(p) + part(np.broadcast_to(q, p.shape))) / 2, 0, 1))


def judge(docs: DataFrame, most_classes: float = 0.3, most_words: float = 0.45) -> DataFrame:
    """doc_id, the base counts, base_failed, class_distance, word_distance, kept. Counts are checkpointed as Parquet."""
    terms = common_words(docs)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    counts = written(measured(docs, terms).withColumn("base_failed", failed))
    known = references(counts, list(terms))

    def compared(batches):
        for batch in batches:
            names = batch.schema.names
            lang = batch.column(names.index("lang")).dictionary_encode()
            code = np.asarray(lang.indices.fill_null(-1), dtype=np.int64)
            out = []
            for k, column in enumerate(("classes", "common")):
                found = matrix(batch.column(names.index(column)))
                shares, far = found / np.maximum(found.sum(1, keepdims=True), 1), np.full(batch.num_rows, np.nan)
                for i, name in enumerate(lang.dictionary.to_pylist()):
                    if name in known:
                        far[code == i] = distance(shares[code == i], known[name][k])
                out.append(pa.array(far, mask=np.isnan(far)))
            kept = [n for n in names if n not in ("classes", "common", "lang")]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(n)) for n in kept], *out], [*kept, "class_distance", "word_distance"])

    unknown = F.lit(None).cast("double")
    schema = counts.drop("classes", "common", "lang").withColumns({"class_distance": unknown, "word_distance": unknown}).schema
    near = counts.mapInArrow(compared, schema)
    like = (F.col("n_words") < LEAST_WORDS) | F.col("class_distance").isNull() | ((F.col("class_distance") <= most_classes) & (F.col("word_distance") <= most_words))
    return near.withColumnRenamed("id", "doc_id").withColumn("kept", ~F.col("base_failed") & like)
