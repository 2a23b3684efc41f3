"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides.

Candidates of a kind are the matches of its base pattern and of a looser or
tighter pattern that finds what the base one runs over. Five labelers vote on
each: the base pattern with its filters, the form of the value, a gazetteer
(top-level domains, calling codes, issuers, address blocks), words of context
and the span's edges. Votes are counted by pattern of votes, which are few at
any size; EM over those counts estimates each labeler's reliability, and its
posteriors train a logistic classifier of spans, compiled into a column
expression. Spans that pass the base rules are always kept; the classifier adds
others, where they overlap no base span.

All of it is DataFrame functions: positions come from the pieces of a text
between its matches, added up in blocks, so work grows with the text and not with
its square. Places are code points, ends exclusive.

A null text counts as empty and has no spans. Rows with equal ids are scanned
each; a null id stays null. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "A-Za-z0-9._%+-"
#: Kind, whether the base one, pattern. A base pattern is written so that it can't run back: it starts where a run of
#: its characters does, and takes runs whole. Of digit chains only those of 14 to 19 digits are taken.
PATTERNS = [
    ("email", True, rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    ("ip", True, r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    ("card", True, r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]"),
    ("email", False, rf"(?<![{LOCAL}])[{LOCAL}]{{1,64}}+\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[(]dot[\])])\x20?[A-Za-z0-9-]++)++"),
    ("card", False, r"(?<![0-9])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])"),
    ("phone", False, r"(?<![0-9(])(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{3}\)[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
]
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.(?!$)|$)){4}$"
#: Gazetteers.
DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "it", "uk", "us", "ca", "au", "nl", "ch", "at", "be", "pt", "mx", "ar", "br", "jp", "cn", "in", "ru"]
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|65)"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
WORDS_FOR = {
    "email": r"mail|contact|kontakt|correo|courriel|write to|reach",
    "ip": r"\bip\b|host|addr|server|client|login",
    "card": r"card|visa|master|amex|pay|karte|carte|tarjeta",
    "phone": r"tel|phone|call|mobil|fax|fon|tél|móvil|whatsapp|sms",
}
WORDS_AGAINST = r"version|build|isbn|issn|order|invoice|serial|\bref\b|\bid\b|section|release"
LABELERS = ["regex", "form", "gazetteer", "context", "edges"]
#: What the classifier sees of a span besides the votes: its length and digits, in eights, at most so many.
MOST_EIGHTS = 4
SPAN = "array<struct<start:int,end:int,kind:int,base:boolean,regex:int,form:int,gazetteer:int,context:int,edges:int,size:int,digits:int>>"


BLOCK = 256  # elements of an array that are folded into one list
CHUNK = 1024  # code points


def bound(value: Column, body) -> Column:
    """body(value) with value computed once, however often body or a function within it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before_each(values: Column, zero: Column, fold) -> Column:
    """For each whole number of an array the fold of those before it; fold is associative, as a sum or a maximum.

    A list that grows by one is copied each time, so lists grow within blocks, and the blocks' own folds in one list more.
    """
    listed = lambda x, first: F.aggregate(
        x, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, v: F.struct(fold(a["at"], v).alias("at"), F.array_append(a["out"], a["at"]).alias("out"))
    )["out"]

    def of(x):
        starts = F.sequence(F.lit(0), F.greatest(F.size(x) - 1, F.lit(0)), F.lit(BLOCK))
        block = lambda b: F.slice(x, b + 1, BLOCK)
        carried = listed(F.transform(starts, lambda b: F.aggregate(block(b), zero, fold)), zero)
        return F.flatten(F.zip_with(starts, carried, lambda b, first: listed(block(b), first)))

    return bound(values, of)


def sorted_once(spans: Column) -> Column:
    """Sorted, each once; array_distinct would compare every two structs."""
    return bound(F.sort_array(spans), lambda x: F.filter(x, lambda s, i: (i == 0) | (s != F.get(x, i - 1))))


def by_kind(kind: str, email: Column, ip: Column, card: Column, phone: Column) -> Column:
    return dict(zip(KINDS, (email, ip, card, phone), strict=True))[kind]


def vote(yes: Column) -> Column:
    return F.when(yes, 1).otherwise(0)


def judged(kind: str, base: bool, value: Column, before: Column, after: Column, start: Column) -> Column:
    """A candidate with its votes: 1 for, 0 against, -1 none."""
    bare = F.regexp_replace(value, "[^0-9]", "")
    digits = F.length(bare)
    luhn = F.call_function("luhn_check", bare)
    passes = by_kind(kind, F.lit(True), value.rlike(OCTETS), luhn & digits.between(14, 19), digits.between(10, 15)) if base else F.lit(False)
    form = by_kind(
        kind,
        value.rlike(r"^[A-Za-z0-9](?:[^@\[(]*[A-Za-z0-9])?\x20?(?:@|[\[(]).*[A-Za-z]{2,24}$"),
        value.rlike(OCTETS) & ~value.rlike(r"(?:^|\.)0[0-9]"),
        luhn & digits.between(13, 19) & ~bare.rlike(r"^(.)\1+$"),
        digits.between(10, 15) & ~value.rlike(r"[0-9]{13}|\([^)]*\(|[().\x20-]{3}"),
    )
    known = by_kind(
        kind,
        vote(F.lower(F.regexp_extract(value, r"[A-Za-z0-9-]+$", 0)).isin(DOMAINS)),
        vote(~value.rlike(r"^(?:0|10|127|22[4-9]|2[3-5][0-9])\.")),
        vote(bare.rlike(ISSUERS)),
        F.when(value.startswith("+"), vote(value.rlike(CALLING_CODES))).otherwise(-1),
    )
    near = F.lower(before)
    context = F.when(near.rlike(WORDS_FOR[kind]), 1).when(near.rlike(WORDS_AGAINST), 0).otherwise(-1)
    edges = vote(before.rlike(r"(?:^|[\s,;:(\"'<>=\[|])$") & after.rlike(r"^(?:$|[\s,.;:)\"'<>!?\]|])"))
    return F.struct(
        start.cast("int").alias("start"), (start + F.length(value)).cast("int").alias("end"), F.lit(KINDS.index(kind)).alias("kind"), passes.alias("base"),
        vote(passes).alias("regex"), vote(form).alias("form"), known.alias("gazetteer"), context.alias("context"), edges.alias("edges"),
        F.least(F.length(value) / 8, F.lit(MOST_EIGHTS)).cast("int").alias("size"), F.least(digits / 8, F.lit(MOST_EIGHTS)).cast("int").alias("digits"),
    )


def candidates(docs: DataFrame, text_col: str = "text", name: str = "candidates") -> DataFrame:
    """docs with an array of candidate spans in each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.withColumns({f"__m{i}": F.regexp_extract_all(text, F.lit(rx), F.lit(0)) for i, (_, _, rx) in enumerate(PATTERNS)})
    cut = found.withColumns({f"__p{i}": F.when(F.size(f"__m{i}") > 0, F.split(text, rx, -1)) for i, (_, _, rx) in enumerate(PATTERNS)})
    lists = []
    for i, (kind, base, _) in enumerate(PATTERNS):
        m, p = F.col(f"__m{i}"), F.col(f"__p{i}")
        before = F.slice(p, 1, F.size(m))
        through = F.zip_with(before, m, lambda a, b: F.length(a) + F.length(b))
        starts = F.zip_with(before_each(through, F.lit(0), lambda a, b: a + b), before, lambda a, b: a + F.length(b))
        each = F.transform(
            F.arrays_zip(m.alias("m"), F.slice(p, 1, F.size(m)).alias("p"), F.slice(p, 2, F.size(m)).alias("q"), starts.alias("s")),
            lambda x: judged(kind, base, x["m"], F.substring(x["p"], -32, 32), F.substring(x["q"], 1, 1), x["s"]),
        )
        lists.append(F.when(F.size(m) > 0, each.cast(SPAN)).otherwise(F.array().cast(SPAN)))
    return cut.withColumn(name, F.concat(*lists)).select(*docs.columns, name)


def votes_counted(found: DataFrame) -> list:
    """How often each pattern of kind, votes and features occurs: at most 4 * 3 ** 5 * 25 rows, however many documents."""
    spans = found.select(F.explode("candidates").alias("c")).select("c.*")
    return spans.groupBy("kind", *LABELERS, "size", "digits").agg(F.count("*").alias("n")).orderBy("kind", *LABELERS, "size", "digits").collect()


def reliabilities(rows: list, rounds: int = 60) -> dict:
    """Per kind: the share of true spans, and of each labeler the chances of a vote for true and for false ones; by EM."""
    out = {}
    for kind in range(len(KINDS)):
        own = [r for r in rows if r["kind"] == kind]
        v = np.array([[r[x] for x in LABELERS] for r in own], float).reshape(-1, len(LABELERS))
        n = np.array([r["n"] for r in own], float)
        share, yes = 0.5, np.array([[0.9] * len(LABELERS), [0.2] * len(LABELERS)])
        for _ in range(rounds if len(own) else 0):
            p = posterior(v, share, yes)
            share = float((n @ p + 1) / (n.sum() + 2))
            for side, w in enumerate((n * p, n * (1 - p))):
                # a prior of ten votes keeps a labeler from turning round where it is hardly heard
                start = np.array([0.9, 0.2])[side]
                yes[side] = (w @ (v == 1) + 10 * start) / (w @ (v >= 0) + 10)
        out[kind] = (share, yes)
    return out


def posterior(v: np.ndarray, share: float, yes: np.ndarray) -> np.ndarray:
    """The chance that a span is true, by its votes."""
    log = [np.where(v == 1, np.log(np.clip(y, 1e-6, 1)), np.where(v == 0, np.log(np.clip(1 - y, 1e-6, 1)), 0.0)).sum(1) for y in yes]
    return 1 / (1 + np.exp(np.clip(log[1] - log[0] + math.log((1 - share) / share), -500, 500)))


def feature_names() -> list[tuple]:
    """(column, value) pairs; each is a feature that a span has or hasn't."""
    return [("kind", k) for k in range(len(KINDS))] + [(x, k) for x in LABELERS for k in (0, 1)] + [(x, k) for x in ("size", "digits") for k in range(MOST_EIGHTS + 1)]


def train(rows: list, steps: int = 25, ridge: float = 1.0) -> list[float]:
    """Weights of the span classifier, a logistic regression on the posteriors, by Newton's method."""
    names = feature_names()
    if not rows:
        return [0.0] * len(names)
    weights = reliabilities(rows)
    x = np.array([[r[c] == k for c, k in names] for r in rows], float)
    n = np.array([r["n"] for r in rows], float)
    y = np.array([posterior(np.array([[r[c] for c in LABELERS]], float), *weights[r["kind"]])[0] for r in rows])
    n = n * (1000 / max(n.sum(), 1000))  # so that the ridge weighs alike at every size
    w = np.zeros(len(names))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x.T * (n * p * (1 - p))) @ x + ridge * np.eye(len(names)) * 0.1
        w = w + np.linalg.solve(hess, x.T @ (n * (y - p)) - ridge * 0.1 * w)
    return [float(v) for v in w]


def probability(span: Column, weights: list[float]) -> Column:
    total = F.lit(0.0)
    for (c, k), w in zip(feature_names(), weights, strict=True):
        if abs(w) > 1e-9:
            total = total + F.when(span[c] == k, F.lit(w)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def decided(found: DataFrame, weights: list[float], threshold: float = 0.5) -> DataFrame:
    """found with base and spans, arrays of (start, kind, end) in order: what passes the base rules, and with what the classifier adds."""
    span = lambda s: [s[c].alias(c) for c in ("start", "kind", "end")]
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    base = sorted_once(F.transform(F.filter("candidates", lambda s: s["base"]), lambda s: F.struct(*span(s))))
    likely = sorted_once(F.transform(F.filter("candidates", lambda s: ~s["base"] & (probability(s, weights) >= threshold)), lambda s: F.struct(*span(s))))
    any_ = F.size("candidates") > 0
    out = found.withColumn("base", F.when(any_, base).otherwise(none)).withColumn("__likely", F.when(any_, likely).otherwise(none))
    # a likely span is free if the base spans that begin before it end by its start, and those after it begin by its end
    marked = lambda c, flag: F.transform(c, lambda s: F.struct(*span(s), F.lit(flag).alias("base")))
    out = out.withColumn("__all", F.when((F.size("base") > 0) & (F.size("__likely") > 0), F.sort_array(F.concat(marked("base", True), marked("__likely", False)))))
    far = F.lit((1 << 31) - 1)
    reached = before_each(F.transform("__all", lambda s: F.when(s["base"], s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    ahead = F.reverse(before_each(F.reverse(F.transform("__all", lambda s: F.when(s["base"], s["start"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
    places = F.arrays_zip(F.col("__all").alias("s"), reached.alias("reached"), ahead.alias("ahead"))
    free = F.transform(F.filter(places, lambda x: ~x["s"]["base"] & (x["reached"] <= x["s"]["start"]) & (x["ahead"] >= x["s"]["end"])), lambda x: F.struct(*span(x["s"])))
    free = F.when(F.col("__all").isNotNull(), free).otherwise(F.col("__likely"))
    return out.withColumn("spans", F.sort_array(F.concat("base", free))).drop("__likely", "__all")


def joined(spans: str) -> Column:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, base and spans of every row. Candidates are written as Parquet, so texts are read once."""
    own = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = written(candidates(own, "__text").drop("__text"))
    return decided(found, train(votes_counted(found))).withColumnRenamed("__id", id_col)


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind and a digest of base spans, and all spans as text."""
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return scanned.select(
        id_col, *counts, F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def part(chunks: str, a: Column, b: Column) -> Column:
    """Code points a to b, b exclusive, of a text in chunks; empty if there are none."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor((b - 1) / CHUNK).cast("int")
    first = F.substring(F.get(chunks, i), F.pmod(a, F.lit(CHUNK)) + 1, F.least(b - a, F.lit(CHUNK)))
    rest = F.concat(F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(F.get(chunks, j), F.lit(1), F.pmod(b - 1, F.lit(CHUNK)) + 1))
    return F.when(b <= a, "").when(i == j, first).otherwise(F.concat(first, rest))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with each span of personal data replaced by its kind in angle brackets; overlapping spans go as one.

    Rows are written with their candidates, so texts are scanned once. Null texts stay null.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*columns).alias("__row"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    scanned = written(candidates(packed, "__text").drop("__text"))
    found = decided(scanned, train(votes_counted(scanned)))
    text = F.col("__row")[text_col]
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    any_ = F.size("spans") > 0
    cut = found.withColumn("__chunks", F.when(any_, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))))
    cut = cut.withColumn("__ends", F.when(any_, before_each(F.transform("spans", lambda s: s["end"]), F.lit(0), lambda a, b: F.greatest(a, b))))
    pieces = F.zip_with("spans", "__ends", lambda s, at: F.concat(part("__chunks", at, s["start"]), F.when(s["start"] >= at, F.concat(F.lit("<"), name(s), F.lit(">"))).otherwise("")))
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    whole = F.concat(F.array_join(pieces, ""), part("__chunks", last, F.length(text)))
    out = F.when(any_, whole).otherwise(text)
    return cut.select(*[out.alias(c) if c == text_col else F.col("__row")[c].alias(c) for c in columns])
