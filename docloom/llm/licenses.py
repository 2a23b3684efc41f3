"""License notices, with a few edits: exact seeds locate, bounded-error matching verifies.

A text becomes its words, joined by single spaces. Each notice that may have k
edits is split into k + 1 pieces, one of which must stand unchanged; pieces are
found by one automaton pass, and around each the regex library matches the whole
notice with at most k errors, on word bounds. The base phrases are found exactly.

Null and empty texts have no words and no places, score 0. Equal rows are
scanned each; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.wordarrays import slices

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices that are searched with errors: label, words, edits allowed.
NOTICES = [
    ("gpl", "gnu general public license", 3),
    ("lgpl", "gnu lesser general public license", 3),
    ("agpl", "gnu affero general public license", 3),
    ("apache", "apache license version", 2),
    ("mit", "the mit license", 1),
    ("mit", "permission is hereby granted free of charge to any person", 6),
    ("bsd", "redistribution and use in source and binary forms", 5),
    ("mpl", "mozilla public license", 2),
    ("cc-by-nc", "cc by nc", 0),
    ("cc-by-sa", "cc by sa", 0),
    ("cc-by", "creative commons attribution", 3),
    ("public-domain", "dedicated to the public domain", 3),
    ("reserved", "all rights reserved", 2),
]
KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Each byte as it counts in a word: a-z for A-Z, a space for ASCII that isn't a letter or digit.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or c in KEPT else 32 for c in range(256))


def split_up(words: str, edits: int) -> list[tuple[int, str]]:
    """edits + 1 pieces of a notice, about equal, with their places."""
    cut = [round(i * len(words) / (edits + 1)) for i in range(edits + 2)]
    return [(a, words[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


class Notices:
    """The fuzzy search over one text of folded words joined by spaces."""

    def __init__(self, notices=NOTICES):
        import ahocorasick
        import regex

        self.notices = notices
        self.match = [regex.compile(rf"(?b)(?<!\S)(?:{regex.escape(words)}){{e<={edits}}}(?!\S)") for _, words, edits in notices]
        seeds: dict[str, list] = {}
        for k, (_, words, edits) in enumerate(notices):
            for place, piece in split_up(words, edits):
                seeds.setdefault(piece, []).append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.automaton.add_word(piece, (len(piece), uses))
        self.automaton.make_automaton()

    def __call__(self, text: str) -> list[tuple[str, int, int, int]]:
        """(label, start, end, edits) of verified notices; places are code points of the joined words."""
        found, tried = {}, {}
        for last, (size, uses) in self.automaton.iter(text):
            for k, place in uses:
                label, words, edits = self.notices[k]
                begin = last + 1 - size - place - edits
                if begin < tried.get(k, -(1 << 60)):  # within a span that this notice has just been matched in
                    continue
                lo, hi = max(0, begin), min(len(text), begin + len(words) + 3 * edits + 1)
                while lo > 0 and text[lo - 1] != " " and lo > begin - 40:
                    lo -= 1
                m = self.match[k].search(text, lo, hi)
                if m:
                    tried[k] = m.end() - edits
                    found.setdefault((label, m.start(), m.end()), sum(m.fuzzy_counts))
        return [(label, a, b, e) for (label, a, b), e in found.items()]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score, and spans (label, start, end, edits in the folded words)."""
    spans = "array<struct<label:string,start:int,end:int,edits:int>>"
    columns = [("n_words", "long"), ("n_base", "long"), ("first_word", "long"), ("last_word", "long"), ("base_labels", "string"), ("labels", "string"), ("score", "double"), ("spans", spans)]
    schema = docs.select(F.col(id_col).alias("id"), *[F.lit(None).cast(t).alias(c) for c, t in columns]).schema
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))]

    def scanned(batches):
        search = Notices()
        base = [(f" {p} ".encode(), label) for p, label in BASE.items()]
        longest = {label: max(len(w) for x, w, _ in NOTICES if x == label) for label, _, _ in NOTICES}
        for batch in batches:
            for part in slices(batch):
                rows = []
                for text in part.column(1).to_pylist():
                    words = (text or "").encode().translate(FOLD).split()
                    joined = b" ".join(words)
                    padded = b" " + joined + b" "
                    places, labels = [], set()
                    for phrase, label in base:
                        at, number, upto = padded.find(phrase), 0, 0
                        while at >= 0:
                            number, upto = number + padded.count(b" ", upto, at), at  # blanks since the last place only
                            places.append(number)
                            labels.add(label)
                            at = padded.find(phrase, at + 1)
                    fuzzy = search(joined.decode("utf-8", "replace"))
                    score = 1.0 if labels else max((1 - e / longest[x] for x, _, _, e in fuzzy), default=0.0)
                    rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {x for x, *_ in fuzzy})), score, [dict(label=x, start=a, end=b, edits=e) for x, a, b, e in sorted(fuzzy, key=lambda f: f[1:])]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)]], schema.names)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scanned, schema).withColumnRenamed("id", id_col)
