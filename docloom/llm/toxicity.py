"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Examples are a bounded sample of labelled rows. Each example and each document is
a TF-IDF vector over all its words, of unit length; words whose use differs
between toxic and other examples (by the G2 statistic) weigh more. Examples are
held in an inverted index cut into blocks that keep each term's largest weight;
blocks are taken by falling bound until no block can reach the nearest k, where
words that a sixteenth of the examples has count in the bound as they stand. Votes
are weighted by distance; isotonic regression on the examples' own left-out votes
calibrates them. A text that shares no word with an example, an empty or null one
too, has the score of such examples. Rows with equal ids, or none, are scored each;
of examples with equal ids one is kept. With no labelled row the score is 0, and an
empty table gives an empty result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import held_out
from docloom.llm.quality import one_of_each, training_labels
from docloom.llm.wordarrays import WordHasher, mixed, slices

#: ASCII bytes that aren't letters or digits.
APART = bytes(c for c in range(128) if not chr(c).isalnum())
BLOCK = 256  # examples
TELLING = 4.0  # times the weight of other words
MOST_COMMON, SHARE, TOGETHER = 512, 16, 64  # words, of a SHARE-th of the examples, that are added up as matrices, and texts at once; all only for speed


def term_counts(w, picked=None):
    """(row, term, count) of a column's words; with picked (sorted hashes), term is a number and only those count."""
    doc, term = w.doc, w.hash
    if picked is not None:
        at = np.minimum(np.searchsorted(picked, term), max(len(picked) - 1, 0))
        keep = picked[at] == term if len(picked) else np.zeros(len(term), bool)
        doc, term = doc[keep], at[keep].astype(np.uint64)
        key, n = np.unique(doc.astype(np.uint64) * np.uint64(max(len(picked), 1)) + term, return_counts=True)
        return (key // np.uint64(max(len(picked), 1))).astype(np.int64), (key % np.uint64(max(len(picked), 1))).astype(np.int64), n
    order = np.argsort(mixed(term + doc.astype(np.uint64)), kind="stable")
    d, t = doc[order], term[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1])
    begin = np.flatnonzero(new)
    return d[begin], t[begin], np.diff(np.append(begin, len(d)))


def ranges(begin, end):
    """The numbers of all ranges one after another, and for each the place of its range."""
    n = end - begin
    of = np.repeat(np.arange(len(n), dtype=np.int32), n)
    return np.arange(len(of), dtype=np.int32) + (begin - (np.cumsum(n, dtype=np.int32) - n))[of], of


def vocabulary(examples: DataFrame, least_docs: int, least_g2: float) -> DataFrame:
    """term, n, docs of all words, and whether they tell; examples: label, text."""

    def counted(batches):
        hasher = WordHasher(APART)
        for batch in batches:
            for part in slices(batch):
                doc, term, _ = term_counts(hasher(part.column(1)))
                label = np.asarray(part.column(0), dtype=np.int64)
                terms, place = np.unique(term, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(np.bincount(place, minlength=len(terms))), pa.array(np.bincount(place, label[doc], len(terms)).astype(np.int64))], ["term", "n", "toxic"])

    size = examples.agg(F.count("*").alias("docs"), F.sum("label").alias("bad"))
    terms = examples.mapInArrow(counted, "term long, n long, toxic long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    part = lambda seen, all_, total, share: F.when(seen > 0, seen * F.log(seen * total / (all_ * share))).otherwise(0.0)
    n, bad, docs, toxic = F.col("n"), F.col("bad"), F.col("docs"), F.col("toxic")
    g2 = 2 * (part(toxic, n, docs, bad) + part(n - toxic, n, docs, docs - bad) + part(bad - toxic, docs - n, docs, bad) + part(docs - n - bad + toxic, docs - n, docs, docs - bad))
    tells = (n >= least_docs) & (bad > 0) & (bad < docs) & (g2 >= least_g2)
    return terms.join(F.broadcast(size)).select("term", "n", "docs", F.coalesce(tells, F.lit(False)).alias("tells"))


class Examples:
    """Labelled TF-IDF vectors in a block-max inverted index."""

    def __init__(self, terms, idf, ids, labels, doc, term, count, k):
        self.terms, self.idf, self.k = terms, idf, k
        weight = (1 + np.log(count)) * idf[term]
        norm = np.sqrt(np.bincount(doc, weight**2, len(ids)))
        # examples alike lie in the same blocks: those of one language share a frequent term, those of one subject a rarer one
        docs_of = np.bincount(term, minlength=len(terms))[term]
        strongest = np.full((3, len(ids)), -1)
        for k, held in enumerate((docs_of > 0, (docs_of >= 8) & (docs_of * 16 < len(ids)), docs_of * 16 >= len(ids))):
            order = np.flatnonzero(held)
            order = order[np.argsort(weight[order], kind="stable")]
            strongest[k, doc[order]] = term[order]
        rank = np.lexsort((ids, norm, *strongest))
        place = np.empty(len(ids), np.int64)
        place[rank] = np.arange(len(ids))
        self.ids, self.labels, self.empty = ids[rank], labels[rank].astype(np.float64), norm[rank] == 0
        self.n_blocks = len(ids) // BLOCK + 1
        # a cell is a term in a block that has it: term_edge leads from terms to cells, cell_edge from cells to postings
        doc, weight = place[doc], weight / np.maximum(norm[doc], 1e-12)
        order = np.lexsort((doc, term))
        self.doc, self.weight, term = doc[order].astype(np.int32), weight[order], term[order]
        cell = term.astype(np.int64) * self.n_blocks + self.doc // BLOCK
        begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
        self.cell_edge = np.append(begin, len(cell)).astype(np.int32)
        self.cell_block = (cell[begin] % self.n_blocks).astype(np.int32)
        self.cell_top = np.maximum.reduceat(self.weight, begin) if len(cell) else np.zeros(0)
        self.term_edge = np.searchsorted(cell[begin] // self.n_blocks, np.arange(len(terms) + 1)).astype(np.int32)
        self.prior = float(self.labels[self.empty].mean()) if self.empty.any() else float(self.labels.mean()) if len(ids) else 0.0
        self.steps = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        self.unseen = np.log(1 + len(ids)) + 1
        self.met = self.known = 0  # blocks that searches added up, of those that there were

    @classmethod
    def of(cls, fields: dict) -> Examples:
        out = cls.__new__(cls)
        out.__dict__.update(fields)
        return out

    def plain(self) -> dict:
        """What of() takes, as plain arrays: workers may lack this package."""
        return {k: v for k, v in self.__dict__.items() if k not in ("common", "rows")}

    def spread(self):
        """Weights of the words that many examples have, a row each over all examples: these are added up as matrices."""
        if not hasattr(self, "common"):
            held = np.diff(self.cell_edge[self.term_edge])
            picked = np.flatnonzero(held * SHARE >= max(len(self.ids), 1))[:MOST_COMMON]
            self.common = np.full(len(self.terms), -1)
            self.common[picked] = np.arange(len(picked))
            self.rows = np.zeros((len(picked), self.n_blocks * BLOCK))
            for i, t in enumerate(picked):
                own = slice(self.cell_edge[self.term_edge[t]], self.cell_edge[self.term_edge[t + 1]])
                self.rows[i, self.doc[own]] = self.weight[own]
        return self.common, self.rows

    def weighted(self, term, count, others: float = 0.0):
        """A text's weights, of unit length. others: what words that no example has add to its squared length."""
        weight = (1 + np.log(count)) * self.idf[term]
        return weight / np.sqrt((weight**2).sum() + others)

    def votes(self, texts: list):
        """vote for each (term, weight, without): common words of some texts at once, then each text's other words. Texts with one strongest common word, mostly of one language, go together."""
        common, rows = self.spread()
        own = [common[term] for term, _, _ in texts]
        first = [int(at[np.argmax(np.where(at >= 0, weight, 0))]) if len(at) else -1 for at, (_, weight, _) in zip(own, texts, strict=True)]
        order, out = sorted(range(len(texts)), key=first.__getitem__), [None] * len(texts)
        for i in range(0, len(order), TOGETHER):
            part = order[i : i + TOGETHER]
            shared = np.zeros((len(part), len(rows)))
            for k, j in enumerate(part):
                at = own[j]
                shared[k, at[at >= 0]] = texts[j][1][at >= 0]
            used = np.flatnonzero(shared.any(0))
            base = shared[:, used] @ rows[used]
            for k, j in enumerate(part):
                term, weight, without = texts[j]
                rare = own[j] < 0
                out[j] = self.vote(term[rare], weight[rare], without, base[k])
        return out

    def nearest(self, term, weight, without: int = -1, base=None):
        """The k nearest examples by cosine, exact: blocks are left only when their bound is below the k-th. base: what common words add to each example's."""
        base = (np.zeros(self.n_blocks * BLOCK) if base is None else base).reshape(self.n_blocks, BLOCK)
        cells, of = ranges(self.term_edge[term], self.term_edge[term + 1])
        part, block = weight[of], self.cell_block[cells]
        bound = np.bincount(block, part * self.cell_top[cells], self.n_blocks) + base.max(1)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_s, best_d = np.zeros(0), np.zeros(0, np.int64)
        done, step = 0, 4
        while done < len(order):
            take = order[done : done + step]  # twice as many each time: the first blocks make the k-th high
            least = best_s[-1] - 1e-11 if len(best_s) == self.k else 0.0
            take = take[bound[take] >= least]
            if not len(take):
                break
            slot = np.full(self.n_blocks, -1)
            slot[take] = np.arange(len(take))
            own = np.flatnonzero(slot[block] >= 0)
            at, cell = ranges(self.cell_edge[cells[own]], self.cell_edge[cells[own] + 1])
            number = slot[block[own]]
            score = np.bincount(self.doc[at] + ((number - take[number]) * BLOCK)[cell], self.weight[at] * part[own][cell], len(take) * BLOCK) + base[take].ravel()
            if without >= 0 and slot[without // BLOCK] >= 0:
                score[slot[without // BLOCK] * BLOCK + without % BLOCK] = 0
            hit = np.flatnonzero((score > 0) & (score >= least))
            if len(hit) > 4 * self.k:
                hit = hit[score[hit] >= np.partition(score[hit], -self.k)[-self.k] - 1e-11]
            s, d = np.append(best_s, score[hit]), np.append(best_d, take[hit // BLOCK] * BLOCK + hit % BLOCK)
            keep = np.lexsort((d, -np.round(s, 12)))[: self.k]
            best_s, best_d = s[keep], d[keep]
            done, step = done + step, 2 * step
            self.met += len(take)
        self.known += self.n_blocks
        return best_s, best_d

    def vote(self, term, weight, without: int, base):
        s, d = self.nearest(term, weight, without, base)
        near = 1 / (1.02 - np.minimum(s, 1.0))
        return float((near @ self.labels[d] + self.prior) / (near.sum() + 1)), s, d

    def calibrate(self, place: np.ndarray, votes: np.ndarray):
        """Isotonic regression of the labels on the examples' votes, each without itself."""
        if not len(votes):
            return
        order = np.argsort(votes, kind="stable")
        blocks = []
        for v, y in zip(votes[order], self.labels[place][order], strict=True):
            blocks.append([v, v, y, 1])
            while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
                lo, hi = blocks.pop(-2), blocks.pop()
                blocks.append([lo[0], hi[1], lo[2] + hi[2], lo[3] + hi[3]])
        self.steps = (np.array([x for b in blocks for x in b[:2]]), np.array([(b[2] + self.prior) / (b[3] + 1) for b in blocks for _ in (0, 1)]))

    def score(self, vote: float) -> float:
        return float(np.clip(np.interp(vote, *self.steps), 0, 1))


def learn(docs: DataFrame, labels: DataFrame, most: int = 10_000, k: int = 25, least_docs: int = 5, least_g2: float = 20.0) -> Examples:
    """The index over at most `most` labelled rows; of their texts only counts of words come to the driver. least_docs, least_g2: of a word that tells."""
    chosen = F.broadcast(training_labels(labels, "toxic", most))
    examples = one_of_each(docs.select("doc_id", "text").join(chosen, F.col("doc_id") == F.col("__id")).select("__label", "text", "doc_id"), "doc_id")
    # Arrow, not rows: the words of the sample are many for a small driver
    terms = vocabulary(examples.select(F.col("__label").alias("label"), "text"), least_docs, least_g2).toArrow()
    column = lambda c: terms[c].to_numpy()
    order = np.argsort(column("term").view(np.uint64))
    picked = column("term").view(np.uint64)[order]
    idf = (np.log((1 + column("docs")) / (1 + column("n"))) + 1) * np.where(column("tells"), TELLING, 1.0)
    idf = idf[order]
    del terms

    def vectors(batches):
        hasher = WordHasher(APART)
        for batch in batches:
            for part in slices(batch):
                doc, term, n = term_counts(hasher(part.column(1)), picked)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.ListArray.from_arrays(cut, term.astype(np.int32)), pa.ListArray.from_arrays(cut, n.astype(np.int32))], ["label", "id", "terms", "counts"])

    schema = examples.select(F.col("__label").alias("label"), F.col("doc_id").alias("id"), F.array(F.lit(0)).alias("terms"), F.array(F.lit(0)).alias("counts")).schema
    rows = examples.mapInArrow(vectors, schema).toArrow()
    rows = rows.take(pa.compute.sort_indices(rows, [("id", "ascending")])).combine_chunks()
    flat = lambda c: rows[c].combine_chunks().flatten().to_numpy()
    ids, labelled = rows["id"].to_numpy(), rows["label"].to_numpy()
    term, count = flat("terms"), flat("counts")
    doc = np.repeat(np.arange(len(ids), dtype=np.int32), pa.compute.list_value_length(rows["terms"]).to_numpy())
    del rows
    out = Examples(picked, idf, ids, labelled, doc, term, count, k)
    del doc, term, count
    out.calibrate(*left_out_votes(examples, out))
    return out


def left_out_votes(rows: DataFrame, examples: Examples) -> tuple[np.ndarray, np.ndarray]:
    """Places of the examples that have words, and each one's vote without itself; rows: doc_id and text of each."""
    kept = rows.sparkSession.sparkContext.broadcast(examples.plain())

    def voted(batches):
        ex, hasher = Examples.of(kept.value), WordHasher(APART)
        place = {i: p for p, i in enumerate(ex.ids.tolist())}
        for batch in batches:
            for part in slices(batch):
                at = [place[i] for i in part.column(0).to_pylist()]
                doc, term, n = term_counts(hasher(part.column(1)), ex.terms)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                own = [(term[a:b], ex.weighted(term[a:b], n[a:b]), p) for a, b, p in zip(cut[:-1], cut[1:], at, strict=True) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([p for _, _, p in own], pa.int64()), pa.array([v for v, _, _ in ex.votes(own)], pa.float64())], ["place", "vote"])

    found = rows.select("doc_id", "text").mapInArrow(voted, "place long, vote double").toArrow()
    kept.unpersist()
    order = np.argsort(found["place"].to_numpy())
    return found["place"].to_numpy()[order], found["vote"].to_numpy()[order]


def score(docs: DataFrame, examples: Examples, evidence: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, and as evidence the ids and cosines of the nearest examples."""
    kept = docs.sparkSession.sparkContext.broadcast(examples.plain())
    id_type = docs.schema["doc_id"].dataType
    schema = docs.select(F.col("doc_id").alias("id"), F.lit(0.0).alias("score"), F.array(F.lit(None).cast(id_type)).alias("near_ids"), F.array(F.lit(0.0)).alias("near_cosines")).schema

    def scored(batches):
        ex, hasher, seen = Examples.of(kept.value), WordHasher(APART), {}
        for batch in batches:
            for part in slices(batch):
                w = hasher(part.column(1))
                row, word, times = term_counts(w)
                at = np.minimum(np.searchsorted(ex.terms, word), max(len(ex.terms) - 1, 0))
                heard = ex.terms[at] == word if len(ex.terms) else np.zeros(len(word), bool)
                others = np.bincount(row[~heard], (1 + np.log(times[~heard])) ** 2, part.num_rows) * ex.unseen**2
                order = np.lexsort((at[heard], row[heard]))
                doc, term, n = (x[heard][order] for x in (row, at, times))
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                keys = [(term[a:b].tobytes(), n[a:b].tobytes(), round(o, 9)) if a < b else None for a, b, o in zip(cut[:-1], cut[1:], others, strict=True)]
                if len(seen) > 5_000:  # a memo of one task; what it has is found again as before
                    seen.clear()
                new = {key: i for i, key in enumerate(keys) if key is not None and key not in seen}
                texts = [(term[cut[i] : cut[i + 1]], ex.weighted(term[cut[i] : cut[i + 1]], n[cut[i] : cut[i + 1]], others[i]), -1) for i in new.values()]
                for key, (vote, s, d) in zip(new, ex.votes(texts), strict=True):
                    seen[key] = (ex.score(vote), ex.ids[d[:evidence]].tolist(), s[:evidence].tolist())
                found = [(ex.prior, [], []) if key is None else seen[key] for key in keys]
                scores, ids, cosines = map(list, zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores, pa.float64()), pa.array(ids, pa.list_(part.column(0).type)), pa.array(cosines, pa.list_(pa.float64()))], ["id", "score", "near_ids", "near_cosines"])

    rows = docs.select(F.col("doc_id").alias("id"), "text").mapInArrow(scored, schema)
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "near_ids", "near_cosines")
