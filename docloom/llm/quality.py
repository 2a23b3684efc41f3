"""Quality classifier: a sparse ensemble of rules over statistics of a text.

Boosted trees over bounded, labelled training rows give paths; each path is a
rule, a conjunction of comparisons. Lasso logistic regression weighs the rules
and drops most. What is left is compiled into one Spark column expression over
the statistics. Statistics are of whole texts; a null text counts as empty and
is scored like one. Rows with equal ids are scored each; an empty table gives an
empty result; with no labelled rows of both kinds the score is the labels' mean.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import SPACES, held_out
from docloom.llm.wordarrays import WordHasher, per_doc, repeated, slices

STATISTICS = [
    "log_words", "word_length", "upper", "digit", "symbol", "bang", "mark", "wide", "space",
    "distinct", "repeat_8", "repeat_3", "line_words", "dup_lines", "short_words", "symbol_ends", "longest_word", "upper_words",
]


class Statistics:
    """The statistics of each text of a column, a row each."""

    def __init__(self):
        self.words, self.lines = WordHasher(SPACES), WordHasher(b"\n", fold=False)
        kind = lambda chars: np.isin(np.arange(256), np.frombuffer(chars, np.uint8))
        self.kinds = [
            (np.arange(256) >= 65) & (np.arange(256) <= 90), (np.arange(256) >= 48) & (np.arange(256) <= 57),
            kind(b"#*$%&|<>@^~_=\\{}[]"), kind(b"!?"), kind(b".,;:'\"()-"), np.arange(256) >= 0xC0, kind(SPACES),
        ]

    def __call__(self, texts: pa.Array) -> np.ndarray:
        w = self.words(texts)
        chars = np.maximum(per_doc((w.data & 0xC0) != 0x80, w.at), 1)
        shares = [per_doc(k[w.data], w.at) / chars for k in self.kinds]
        n = w.counts
        some = np.maximum(n, 1)
        by = lambda values: per_doc(values, w.first) / some
        size = w.end - w.start
        longest = np.zeros(w.n_docs, np.int64)
        np.maximum.at(longest, w.doc, size)
        distinct = by(~repeated(w.doc, w.hash)[1])
        windows = []
        for k in (8, 3):
            at, h = w.windows(k)
            windows.append(np.bincount(w.doc[at], repeated(w.doc[at], h)[1], w.n_docs) / some)
        lines = self.lines.of(w.data, w.at)
        dup = per_doc(repeated(lines.doc, lines.hash)[1], lines.first)
        n_lines = np.maximum(lines.counts, 1)
        last = w.data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
        first = w.data[w.start] if len(w.start) else np.zeros(0, np.uint8)
        second = w.data[np.minimum(w.start + 1, np.maximum(w.end - 1, w.start))] if len(w.start) else first
        caps = self.kinds[0]
        return np.column_stack([
            np.log1p(n), by(size), *shares, distinct, *windows, n / n_lines, dup / n_lines,
            by(size <= 3), by(self.kinds[2][last] | self.kinds[3][last]), np.log1p(longest), by(caps[first] & caps[second]),
        ]).astype(np.float64)


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and the statistics of each row."""
    schema = docs.select(F.col(id_col).alias("id"), *[F.lit(0.0).alias(s) for s in STATISTICS]).schema

    def measured(batches):
        of = Statistics()
        for batch in batches:
            for part in slices(batch):
                values = of(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(values[:, k]) for k in range(len(STATISTICS))]], ["id", *STATISTICS])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(measured, schema).withColumnRenamed("id", id_col)


def training_labels(labels: DataFrame, label: str, most: int, id_col: str = "doc_id") -> DataFrame:
    """id_col, label of at most so many rows outside the held-out fifth, those of the smallest hashes; of a repeated id the largest label."""
    own = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    own = own.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__label"))
    # groups repeated ids after the cut, so that nothing larger than the sample is shuffled
    return own.orderBy(F.xxhash64("__id"), "__id").limit(most).groupBy("__id").agg(F.max("__label").alias("__label"))


def tree(bins: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, least: int) -> list[tuple]:
    """One regression tree on binned features: its paths as (conditions, rows, step); a condition is (feature, bin, above)."""
    paths = []

    def grow(rows, conditions):
        g, h = grad[rows].sum(), hess[rows].sum()
        if conditions:
            paths.append((tuple(conditions), rows, -g / (h + 1.0)))
        if len(conditions) == depth or len(rows) < 2 * least:
            return
        best = (1e-3, None, None)
        for f in range(bins.shape[1]):
            b = bins[rows, f]
            gs, hs, ns = np.cumsum(np.bincount(b, grad[rows], 32)), np.cumsum(np.bincount(b, hess[rows], 32)), np.cumsum(np.bincount(b, minlength=32))
            gain = gs**2 / (hs + 1.0) + (g - gs) ** 2 / (h - hs + 1.0) - g**2 / (h + 1.0)
            gain[(ns < least) | (len(rows) - ns < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] is not None:
            _, f, k = best
            above = bins[rows, f] > k
            grow(rows[~above], [*conditions, (f, k, False)])
            grow(rows[above], [*conditions, (f, k, True)])

    grow(np.arange(len(grad)), [])
    return paths


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic weights with an L1 penalty by accelerated proximal gradient; the intercept is free. x stays as small as it comes, in single precision."""
    n = len(y)
    times = lambda z: (x @ z.astype(x.dtype)).astype(float)
    back = lambda z: (z.astype(x.dtype) @ x).astype(float)
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    u = np.ones(x.shape[1] + 1)
    for _ in range(20):  # the largest eigenvalue of x'x, for the step
        along = times(u[:-1]) + u[-1]
        u = np.append(back(along), along.sum())
        scale = np.linalg.norm(u)
        u /= scale
    rate = 4 * n / scale
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(times(v) + c))) - y
        new = v - rate * back(r) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b = c - rate * r.mean()
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, b


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, penalty: float = 4e-4) -> tuple[list, float]:
    """Rules as ([(statistic, bound, above)], weight), and the intercept."""
    if len(y) == 0 or y.min() == y.max():
        return [], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))) if len(y) else 0.0
    bounds = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])) for f in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(b, x[:, f], side="left") for f, b in enumerate(bounds)])
    draws = np.random.default_rng(11)
    score, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for _ in range(trees):
        rows = np.flatnonzero(draws.random(len(y)) < 0.5)
        if not len(rows):
            continue
        p = 1 / (1 + np.exp(-score))
        paths = tree(bins[rows], (p - y)[rows], (p * (1 - p))[rows], depth, max(5, len(y) // 1000))
        longest = {c for c, _, _ in paths}
        leaves = [q for q in paths if not any(len(c) > len(q[0]) and c[: len(q[0])] == q[0] for c in longest)]
        for conditions, _, step in leaves:
            score[holds(bins, conditions)] += 0.2 * step
        for conditions, _, _ in paths:
            found.setdefault(frozenset(conditions), conditions)
    rules = [c for c in found.values() if all(k < len(bounds[f]) for f, k, _ in c)]
    if not rules:
        return [], float(np.log(y.mean() / (1 - y.mean())))
    sample = np.empty((len(y), len(rules)), np.float32)
    for i, c in enumerate(rules):
        sample[:, i] = holds(bins, c)
    w, b = lasso(sample, y.astype(np.float64), penalty)
    return [([(STATISTICS[f], float(bounds[f][k]), above) for f, k, above in c], float(v)) for c, v in zip(rules, w, strict=True) if abs(v) > 1e-4], b


def one_of_each(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with equal keys that with the least hash of its text."""
    columns = [c for c in rows.columns if c != key]
    first = F.min(F.struct(F.xxhash64("text").alias("__h"), *columns)).alias("__r")
    return rows.groupBy(key).agg(first).select(*[F.col(f"__r.{c}") if c != key else F.col(key) for c in rows.columns])


def holds(bins: np.ndarray, conditions) -> np.ndarray:
    return np.logical_and.reduce([(bins[:, f] > k) == above for f, k, above in conditions])


def compiled(rules: list, intercept: float) -> Column:
    """The rules as one column expression, a probability."""
    terms = [F.lit(float(intercept))]
    for conditions, weight in rules:
        test = reduce(lambda a, b: a & b, [F.col(s) > bound if above else F.col(s) <= bound for s, bound, above in conditions])
        terms.append(F.when(test, F.lit(weight)).otherwise(F.lit(0.0)))
    while len(terms) > 1:  # a balanced sum keeps the expression shallow
        terms = [reduce(lambda a, b: a + b, terms[i : i + 2]) for i in range(0, len(terms), 2)]
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-terms[0]))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> tuple[list, float]:
    """Rules from at most `most` labelled rows; only their statistics come to the driver."""
    chosen = F.broadcast(training_labels(labels, label, most))
    own = one_of_each(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")), "doc_id").select(F.struct("doc_id", "__label").alias("doc_id"), "text")
    rows = statistics(own).select("doc_id.__label", *STATISTICS).toPandas()
    rows = rows.sort_values(list(rows.columns))  # so that reruns agree
    return fit(rows[STATISTICS].to_numpy(), rows["__label"].to_numpy())


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rules, intercept = train(docs, labels, "quality", most)
    score = compiled(rules, intercept)
    return statistics(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, examples: DataFrame | None = None, threshold: float = 0.3, most: int = 20_000) -> DataFrame:
    """The rows of docs that are not rejected, whole; the rules are learnt from examples (docs if not given)."""
    rules, intercept = train(docs if examples is None else examples, labels, "quality", most)
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return statistics(packed, "__row").filter(compiled(rules, intercept) >= threshold).select("__row.*")
