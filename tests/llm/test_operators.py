"""Each operator against a brute-force version in plain Python, and on odd rows."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import components, decontaminate, jaccard_join, licenses, mixing, pii, quality, quality_rules, tokencounts, toxicity, urlrules
from docloom.llm.common import few, semi_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "one", "é ñ ü", "a\u00a0b", "x" * 300_000, "w " * 60_000, "# # | $ %\n" * 50, "Tab\tand\x0bvertical"]


def documents(spark, texts, start=0):
    return spark.createDataFrame([(i + start, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], DOCS)


def collected(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# personal data

BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"\D", "", m)) <= 19 and luhn(re.sub(r"\D", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"\D", "", m)) <= 15),
}


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, (rx, ok)) in enumerate(BASE.items()) for m in re.finditer(rx, text or "") if ok(m[0])]
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


PERSONAL = [
    *ODD,
    "mail a.b@c.com and a@b.c_d@e.f, x@y@z.org; é@é.fr é.a@b-c.d.e.",
    "ip 1.2.3.4 and 1.2.3.4.5.6.7.8, 300.1.1.1 or 001.002.003.255. 1..2.3.4",
    "4111 1111 1111 1111, 4111111111111112; 5 4111-1111-1111-1111; 1  4111111111111111 20 chars 41111111111111111111",
    "call +1 (269) 555-3296 4524132264652876 or +1 (269) 555-3296; +33 1 23 45 67 89. +1 2 +12345678901234567",
    "+1+1+1-234-567-8901) é +1 555 (12) 345-6789-",
    "token user [at] host [dot] com, user(at)host.org",
]


def test_base_spans_match_plain_regexes(spark):
    rng = random.Random(3)
    texts = PERSONAL + ["".join(rng.choice(["1", "4", " ", "-", ".", "@", "+", "a", "é", "(", ")", "25", "555"]) for _ in range(60)) for _ in range(300)]
    out = collected(pii.digest(pii.scan(documents(spark, texts))))
    for i, t in enumerate(texts):
        want = base_spans(t)
        assert out[i]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), t
        assert (out[i]["n_email"], out[i]["n_ip"], out[i]["n_card"], out[i]["n_phone"]) == tuple(len(re.findall(k + ":", want)) for k in BASE)
        assert set(filter(None, want.split(","))) <= set(out[i]["spans"].split(","))


def test_masking_takes_spans_out_and_keeps_the_rest(spark):
    texts = ["hello world", "mail a.b@c.com now", None, "", "+1 (269) 555-3296"]
    out = collected(pii.masked(documents(spark, texts)))
    assert [out[i]["text"] for i in range(5)] == ["hello world", "mail <email> now", None, "", "<phone>"]
    assert pii.masked(documents(spark, texts)).columns == documents(spark, texts).columns


def test_folds_before_each_element(spark, monkeypatch):
    monkeypatch.setattr(pii, "BLOCK", 3)
    rng = random.Random(8)
    lists = [[rng.randint(0, 50) for _ in range(n)] for n in (0, 1, 2, 3, 4, 9, 10, 31)]
    df = spark.createDataFrame([(x,) for x in lists], "x array<int>")
    sums = pii.before_each(F.col("x"), F.lit(0), lambda a, b: a + b)
    tops = pii.before_each(F.col("x"), F.lit(0), lambda a, b: F.greatest(a, b))
    for r in df.select("x", sums.alias("sums"), tops.alias("tops")).collect():
        assert r["sums"] == [sum(r["x"][:i]) for i in range(len(r["x"]))]
        assert r["tops"] == [max([0, *r["x"][:i]]) for i in range(len(r["x"]))]


def mixed_texts(seed, n):
    rng = random.Random(seed)
    bits = ["1.2.3.4", "1.2.3.4.5", "a@b.co", "4111 1111 1111 1111", "4111-1111-1111-1112", "(269) 555-3296", "+1 (269) 555-3296", "user [at] host [dot] com", "tel", "card", "version", "\u00e9t\u00e9", "\n", "x"]
    return [rng.choice(["", " ", ", "]).join(rng.choices(bits, k=rng.randint(1, 40))) for _ in range(n)]


def test_added_spans_are_the_likely_ones_that_touch_no_base_span(spark):
    texts = PERSONAL + mixed_texts(12, 200)
    found = pii.candidates(documents(spark, texts))
    weights = pii.train(pii.votes_counted(found))
    added = 0
    for r in pii.decided(found, weights).collect():
        base = sorted({(c["start"], c["kind"], c["end"]) for c in r["candidates"] if c["base"]})
        assert [tuple(x) for x in r["base"]] == base
        chance = lambda c: 1 / (1 + math.exp(-sum(w for (name, k), w in zip(pii.feature_names(), weights, strict=True) if c[name] == k)))
        likely = {(c["start"], c["kind"], c["end"]) for c in r["candidates"] if not c["base"] and chance(c) >= 0.5}
        free = {s for s in likely if not any(s[0] < b[2] and b[0] < s[2] for b in base)}
        assert [tuple(x) for x in r["spans"]] == sorted([*base, *free])
        added += len(free)
    assert added


def test_masks_are_spans_cut_out_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(pii, "CHUNK", 7)
    texts = PERSONAL + mixed_texts(13, 150)
    docs = documents(spark, texts).withColumn("__text", F.lit("clashes")).withColumn("spans", F.lit(1))
    found = collected(pii.scan(documents(spark, texts)))
    out = collected(pii.masked(docs))
    for i, t in enumerate(texts):
        at, pieces = 0, []
        for start, kind, end in found[i]["spans"]:
            if end > at:
                pieces += [t[at : max(start, at)], f"<{pii.KINDS[kind]}>" if start >= at else ""]
                at = end
        assert out[i]["text"] == (None if t is None else "".join(pieces) + t[at:])
        assert out[i]["__text"] == "clashes" and out[i]["spans"] == 1


def test_many_spans_in_one_text(spark):
    texts = ["1.2.3.4 " * 12_000, "1." * 12_000, "(269) 555-3296 a@b.co " * 3_000]
    began = time.monotonic()
    out = collected(pii.digest(pii.scan(documents(spark, texts))))
    masks = collected(pii.masked(documents(spark, texts)))
    assert out[0]["n_ip"] == 12_000 and out[1]["n_ip"] == 3_000 and out[2]["n_email"] == 3_000
    assert masks[0]["text"] == "<ip> " * 12_000
    assert time.monotonic() - began < 90


def test_reliabilities_are_those_of_plain_expectation_maximisation():
    rng = random.Random(6)
    rows = [{"kind": 0, **{x: rng.choice([-1, 0, 1]) for x in pii.LABELERS}, "size": 1, "digits": 1, "n": rng.randint(1, 30)} for _ in range(40)]
    share, yes = 0.5, {side: [start] * 5 for side, start in ((True, 0.9), (False, 0.2))}
    for _ in range(60):
        chances = []
        for r in rows:
            both = []
            for side, prior in ((True, share), (False, 1 - share)):
                for x, y in zip(pii.LABELERS, yes[side], strict=True):
                    prior *= y if r[x] == 1 else 1 - y if r[x] == 0 else 1
                both.append(prior)
            chances.append(both[0] / sum(both))
        total = sum(r["n"] for r in rows)
        share = (sum(r["n"] * p for r, p in zip(rows, chances, strict=True)) + 1) / (total + 2)
        for side, start in ((True, 0.9), (False, 0.2)):
            weight = [r["n"] * (p if side else 1 - p) for r, p in zip(rows, chances, strict=True)]
            yes[side] = [(sum(w for w, r in zip(weight, rows, strict=True) if r[x] == 1) + 10 * start) / (sum(w for w, r in zip(weight, rows, strict=True) if r[x] >= 0) + 10) for x in pii.LABELERS]
    got_share, got_yes = pii.reliabilities(rows)[0]
    assert got_share == pytest.approx(share, abs=1e-9)
    assert got_yes[0].tolist() == pytest.approx(yes[True], abs=1e-9) and got_yes[1].tolist() == pytest.approx(yes[False], abs=1e-9)


def test_span_weights_are_where_the_penalised_likelihood_is_flat():
    rng = random.Random(7)
    rows = [{"kind": rng.randrange(4), **{x: rng.choice([-1, 0, 1]) for x in pii.LABELERS}, "size": rng.randrange(5), "digits": rng.randrange(5), "n": rng.randint(1, 9)} for _ in range(80)]
    weights, names = pii.train(rows), pii.feature_names()
    known = pii.reliabilities(rows)
    total = sum(r["n"] for r in rows)
    slope = [-0.1 * w for w in weights]
    for r in rows:
        on = [i for i, (c, k) in enumerate(names) if r[c] == k]
        target = float(pii.posterior(np.array([[r[x] for x in pii.LABELERS]], float), *known[r["kind"]])[0])
        p = 1 / (1 + math.exp(-sum(weights[i] for i in on)))
        for i in on:
            slope[i] += r["n"] * min(1, 1000 / total) * (target - p)
    assert max(map(abs, slope)) < 1e-6


# Jaccard join


def shingles(text):
    w = words_of(lower(text))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def groups(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [(len(sets[i]), find(i)) for i in range(len(texts))]


def near_copies(seed, n):
    rng = random.Random(seed)
    base = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.randint(1, 60))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            if w:
                w[rng.randrange(len(w))] = rng.choice("xyz")
        out.append(" ".join(w).upper() if rng.random() < 0.2 else "\t".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_all_pairs(spark, seed):
    texts = near_copies(seed, 150) + ODD[:7] + ODD[-2:] + ["one", "A b c", "a b\nc"]
    out = collected(jaccard_join.join(documents(spark, texts)))
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == groups(texts)


@pytest.mark.parametrize(("frequent", "bucket", "rows"), [(2, 64, 400), (64, 2, 11), (2, 2, 5)])
def test_components_by_stars_and_cells(spark, monkeypatch, frequent, bucket, rows):
    monkeypatch.setattr(jaccard_join, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard_join, "BUCKET", bucket)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", rows)
    texts = near_copies(5 + frequent % 7, 150)
    out = collected(jaccard_join.join(documents(spark, texts)))
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == groups(texts)


def test_a_large_group_whose_members_link_by_others(spark, monkeypatch):
    # copies of one text with one to four words changed: those with many changes link to no pivot, if to any member
    monkeypatch.setattr(jaccard_join, "BUCKET", 8)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 20)
    monkeypatch.setattr(jaccard_join, "BLOCK_ROWS", 60)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(90)]
    texts = []
    for _ in range(260):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(90)] = f"x{rng.randrange(40)}"
        texts.append(" ".join(words))
    out = collected(jaccard_join.join(documents(spark, texts)))
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == groups(texts)


def test_sets_are_compared_once_for_a_class_and_then_only_between_components(spark, monkeypatch):
    # 40 copies of one text, each with a word of its own: all 780 pairs are likely, 39 join them; the last pairs show that links left out first are made up for
    compared, seen = jaccard_join.compared, []

    def counting(pairs, values, alike):
        if alike is jaccard_join.by_sets:
            seen.append(pairs.count())
        return compared(pairs, values, alike)

    monkeypatch.setattr(jaccard_join, "compared", counting)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join([*words[:i], f"x{i}", *words[i + 1 :]]) for i in range(5, 205, 5)]
    out = collected(jaccard_join.join(documents(spark, texts)))
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == groups(texts)
    assert sum(seen) < 80


def test_links_beside_the_nearest_are_made_up_for(spark):
    schema = "a long, b long, na long, nb long"
    # the nearest are 1-2, 2-3, 1-4 and 5-6, of which only 1-2 is alike; 3-4, left out at first, is too
    pairs = spark.createDataFrame([(1, 2, 10, 10), (2, 3, 10, 10), (3, 4, 10, 10), (1, 4, 10, 10), (5, 6, 10, 10)], schema)
    values = {1: range(10), 2: range(10), 3: range(20, 30), 4: [*range(20, 29), 40], 5: range(50, 60), 6: range(70, 80)}
    packed = lambda sigs, of: spark.createDataFrame([(k, of(np.array(v, np.uint64) << np.uint64(16))) for k, v in values.items()], "sig long, value binary").join(sigs, "sig", "left_semi")
    out = {r["node"]: r["component"] for r in jaccard_join.linked(pairs, packed).collect()}
    assert (out[1], out[2], out[3], out[4]) == (1, 1, 3, 3)
    assert out.get(5, 5) != out.get(6, 6)


def test_groups_without_large_buckets_make_no_stars(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "stars", None)  # neither called nor planned
    texts = near_copies(4, 40)
    out = collected(jaccard_join.join(documents(spark, texts)))
    assert [(out[i]["n_shingles"], out[i]["component_id"]) for i in range(len(texts))] == groups(texts)


def test_join_of_an_empty_table_and_of_null_ids(spark):
    assert jaccard_join.join(documents(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (3, "A b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted(r["component_id"] for r in jaccard_join.join(rows).collect()) == [3, 3, 3]


def test_links_are_found_though_the_first_pivots_fit_no_member(spark):
    # the short text is the pivot of both first buckets of the long ones, which meet in the third too late
    own = [f"18.{i}" for i in range(14)]
    texts = [" ".join(x) for x in (own, [*own[:-1], "18.other"], own[:9])]
    out = collected(jaccard_join.join(documents(spark, texts)))
    assert [out[i]["component_id"] for i in range(3)] == [c for _, c in groups(texts)] == [0, 0, 2]


def test_chains_of_links_are_followed(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (102, 101)], "a long, b long")
    out = {r["node"]: r["component"] for r in components.components(links, "a", "b").collect()}
    assert out == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


# decontamination


def test_benchmark_items_are_found_with_edits_and_clean_texts_left(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [[word() for _ in range(rng.randint(12, 45))] for _ in range(40)]
    texts, want = [], set()
    for i in range(300):
        own = [word() for _ in range(rng.randint(0, 200))]
        if i % 2:
            k = rng.randrange(40)
            passage = list(items[k])
            for _ in range(rng.randint(0, len(passage) // 12)):
                at = rng.randrange(len(passage))
                passage[at : at + 1] = rng.choice([[], [word()], [passage[at], word()]])
            at = rng.randint(0, len(own))
            own[at:at] = passage
            want.add((i, k))
        texts.append(" ".join(own))
    texts += ODD
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(98, None), (99, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(documents(spark, texts), benchmark).collect()}
    assert got <= want
    assert len(got) >= 0.97 * len(want)
    assert decontaminate.find(documents(spark, []), benchmark).count() == 0
    assert decontaminate.find(documents(spark, texts), benchmark.filter("false")).count() == 0


def test_items_that_follow_words_of_other_items_are_found(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 7)))
    own = lambda n: [word() for _ in range(n)]
    items, texts, want = [], [], set()
    for early in (1, 2, 3, 5, 8, 13, 20):
        outer = own(60)
        nested, phrase, after = outer[30:50], outer[-early:], own(20)
        k, i = len(items), len(texts)
        items += [outer, nested, after, after[8:] + own(12)]
        # a part of the outer item that begins before the nested one; a phrase of one item before another; two that overlap
        texts += [own(50) + outer[30 - early : 50] + own(50), own(50) + phrase + after + own(50), own(50) + after + items[-1][12:] + own(50)]
        want |= {(i, k + 1), (i + 1, k + 2), (i + 2, k + 2), (i + 2, k + 3)}
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(documents(spark, [" ".join(t) for t in texts]), benchmark).collect() if r["edits"] == 0}
    assert got == want


def test_recall_at_the_edits_allowed(spark):
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 8)))
    sizes = [7, 15, 27, 31, 34, 47, 59, 200, 600]
    items, texts = [], []
    for n in sizes * 60:
        items.append([word() for _ in range(n)])
        passage = list(items[-1])
        for _ in range(int(0.15 * n)):
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], [word()], [passage[at], word()]])
        texts.append(" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]))
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    rows = decontaminate.find(documents(spark, texts), benchmark).collect()
    assert all(r["doc_id"] == r["item_id"] and r["edits"] <= 0.15 * r["item_words"] for r in rows)
    found = Counter(len(items[i]) for i in {r["doc_id"] for r in rows})
    assert sum(found.values()) >= 0.985 * len(texts), found
    assert all(found[n] >= 57 for n in sizes), found


def test_items_of_one_and_two_words_are_found_as_they_stand(spark):
    benchmark = spark.createDataFrame([(0, "Zebra"), (1, "red zebra"), (2, ""), (3, None), (4, "one two three four")], "item_id long, text string")
    texts = ["A red, ZEBRA red", None, "", "zebras red", "zebra", "so one two three four"]
    rows = decontaminate.find(documents(spark, texts), benchmark).collect()
    assert {(r["doc_id"], r["item_id"], r["first_word"], r["end_word"]) for r in rows} == {(0, 0, 2, 3), (0, 1, 1, 3), (4, 0, 0, 1), (5, 4, 1, 5)}


def test_models_reach_workers_as_plain_arrays(spark):
    # what a worker reads of a broadcast needs no module of this package
    import pickle

    docs = documents(spark, ["bad words here", "good words here"] * 30)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    for fields in (toxicity.learn(docs, labels).__dict__, decontaminate.Items([1], ["one two three four"], 0.15).__dict__):
        assert b"docloom" not in pickle.dumps(fields)


def test_examples_with_equal_ids_are_one(spark):
    docs = spark.createDataFrame([(i % 20, f"{'bad' if i % 2 else 'good'} word{i}", i) for i in range(80)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i % 20, i % 2, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    examples = toxicity.learn(docs, labels)
    assert len(set(examples.ids.tolist())) == len(examples.ids) <= 20
    assert toxicity.score(docs, examples).count() == 80
    assert quality.classify(docs, labels).count() == 80


def test_pipeline_drops_only_the_contaminated_row_of_an_id(spark, tmp_path):
    words = " ".join(f"w{i}" for i in range(20))
    spark.createDataFrame([(0, words)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = [(None, f"so {words} on"), (None, "clean"), (None, None), (5, words), (5, "clean too"), (6, "clean"), (7, f"{words} again")]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts], DOCS)
    out = corpus_pipeline.decontamination(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == Counter([(None, "clean"), (None, None), (5, "clean too"), (6, "clean")])


# quality rules


def base_counts(text):
    w = words_of(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    inside = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_counts_match(spark):
    rng = random.Random(4)
    texts = ODD + [" ".join(rng.choice("ab") for _ in range(n)) for n in range(0, 60, 7)] + ["a b\nc\na b\n \nc\n\na b", "1 2 3 4 5 6 7 8 " * 6]
    out = collected(quality_rules.judge(documents(spark, texts)))
    for i, t in enumerate(texts):
        n, *rest = base_counts(t)
        r = out[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, *rest), t and t[:50]
        assert r["base_failed"] == (n < 20 or 100 * rest[-1] > 30 * n)
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(documents(spark, [])).count() == 0


def jensen_shannon(p, q):
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return sum(sum(x * math.log2(x / z) for x, z in zip(side, m, strict=True) if x) / 2 for side in (p, q)) ** 0.5


def histograms(text, common):
    classes = [sum(b in c for b in (text or "").encode()) for c in quality_rules.CLASSES]
    w = Counter(map(lower, words_of(text)))
    words = [w[x] for x in common]
    words += [0] * (quality_rules.COMMON - len(words)) + [w.total() - sum(words)]
    return [[x / max(1, sum(h)) for x in h] for h in (classes, words)]


def test_distances_match_brute_force_however_the_table_is_cut(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "COMMON", 6)
    monkeypatch.setattr(quality_rules, "WAITING", 500)
    rng = random.Random(31)
    vocabulary = {lang: ["".join(rng.choice("abcdefghijké") for _ in range(rng.randint(2, 7))) for _ in range(60)] for lang in ("aa", "bb", "cc")}
    rows = []
    for i in range(300):
        lang = rng.choice(["aa", "bb", "bb", None]) if i > 6 else "cc"
        words = rng.choices(vocabulary[lang or "aa"], [1 / (k + 1) for k in range(60)], k=rng.choice([5, 30, 60, 120]))
        if i % 9 == 0:
            words = [x.upper() + "!?9" for x in words]
        rows.append((i if i % 7 else 3, " ".join(words), lang, i))
    rows += [(400, None, "aa", 400), (401, "", "bb", 401), (None, "x", None, 402)]
    texts = {n: t for _, t, _, n in rows}
    counts = {lang: Counter(lower(w) for _, t, x, _ in rows if x == lang for w in words_of(t)) for lang in ("aa", "bb")}
    common = {lang: [w for w, _ in c.most_common(6)] for lang, c in counts.items()}
    assert all(c.most_common(7)[5][1] > c.most_common(7)[6][1] for c in counts.values())
    passed = lambda t: len(words_of(t)) >= 50 and 100 * base_counts(t)[-1] <= 30 * len(words_of(t))
    reference = {}
    for lang in common:
        own = [histograms(t, common[lang]) for _, t, x, _ in rows if x == lang and passed(t)]
        assert len(own) >= 20
        reference[lang] = [[sum(h[k][j] for h in own) / len(own) for j in range(len(own[0][k]))] for k in (0, 1)]
    results = []
    for parts in (1, 16):
        # the place in the list goes as a clashing extra column, and as the id
        docs = spark.createDataFrame([(n, t, x, "s") for _, t, x, n in rows], "doc_id long, text string, lang string, n_words string").repartition(parts)
        out = collected(quality_rules.judge(docs))
        results.append(out)
        assert len(out) == len(rows)
        for _, t, lang, n in rows:
            r = out[n]
            if lang not in common:
                assert r["class_distance"] is None and r["word_distance"] is None and r["kept"] == (not r["base_failed"])
                continue
            far = [jensen_shannon(h, q) for h, q in zip(histograms(texts[n], common[lang]), reference[lang], strict=True)]
            assert [r["class_distance"], r["word_distance"]] == pytest.approx(far, abs=1e-6)
            assert r["kept"] == (not r["base_failed"] and (len(words_of(t)) < 50 or (far[0] <= 0.3 and far[1] <= 0.45)))
    assert results[0] == results[1]


# licenses


def base_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    places = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_places_match(spark):
    texts = ODD + [
        "The MIT License. mit-license MIT\nLICENSE", "cc by cc-by CC BY-SA", "Apache License, Version 2.0", "GNU General Public License mit license",
        "Permission is hereby grantd, free of charge, to any persn", "all right reserved", "émit license", "mit licenses",
    ]
    out = collected(licenses.scan(documents(spark, texts)))
    for i, t in enumerate(texts):
        r = out[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_licenses(t), t and t[:40]
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1
    assert "mit" in out[len(ODD) + 4]["labels"].split(",")
    assert "reserved" in out[len(ODD) + 5]["labels"].split(",")


def test_license_places_take_time_linear_in_places_and_spans_are_told(spark):
    many = "mit license " * 60_000
    start = time.time()
    r = licenses.scan(documents(spark, [many])).first()
    assert time.time() - start < 20
    assert (r["n_base"], r["first_word"], r["last_word"]) == (60_000, 0, 119_998)
    text = "see the mozzila public license here"
    r = licenses.scan(documents(spark, [text])).first()
    assert [(s["label"], text[s["start"] : s["end"]], s["edits"]) for s in r["spans"]] == [("mpl", "mozzila public license", 2)]


def edit_distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_license_labels_match_edit_distance(spark):
    rng = random.Random(4)
    texts = []
    for label, words, edits in licenses.NOTICES:
        for k in range(edits + 3):
            x = list(words)
            for _ in range(k):
                at = rng.randrange(len(x))
                x[at : at + 1] = rng.choice([[], [x[at], rng.choice("abcxyz")], [rng.choice("abcxyz")]])
            texts.append(" ".join(f"foo {''.join(x)} bar".split()))
    out = collected(licenses.scan(documents(spark, texts)))
    for i, t in enumerate(texts):
        words = t.split()
        spans = [" ".join(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)]
        wanted = {label for label, notice, edits in licenses.NOTICES if any(abs(len(s) - len(notice)) <= edits and edit_distance(s, notice) <= edits for s in spans)}
        assert set(filter(None, out[i]["labels"].split(","))) == wanted | set(filter(None, base_licenses(t)[4].split(","))), t
        assert all(s["edits"] == min(edit_distance(t[s["start"] : s["end"]], n) for x, n, _ in licenses.NOTICES if x == s["label"]) for s in out[i]["spans"])


# URL rules

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def judged(url, rules=RULES):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = lower(host)
    fits = [(len(h) + len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    size, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_url_rules_match(spark):
    rng = random.Random(6)
    labels = ["a", "b", "org", "net", "example", "com", "-x", ""]
    urls = [None, "", "no host", "http://", "http://NET/x", "x://example.net/en/a?b#c", "http://u@net/", "http://net.", "http://.net/"]
    urls += [f"https://{'.'.join(rng.choice(labels) for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/en/x', '/fr/', '/de/y?q', '#f'])}" for _ in range(400)]
    more = RULES + [("a.net", "/", "allow"), ("b.a.net", "/e", "block"), ("com", "/", "allow"), ("example.com", "/", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for rules in (RULES, more):
        out = collected(urlrules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string")), "page_id")
        for i, u in enumerate(urls):
            assert (out[i]["host"], out[i]["path"], out[i]["rule"], out[i]["verdict"]) == judged(u, rules), u
    assert urlrules.judge(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0


# mixing


def wanted(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(names)}
    left, free, out = float(sum(sizes.values())), set(names), {}
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] > 3 * sizes[s]]
        if not full:
            return out | share
        for s in full:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_the_mix_comes_near_its_targets(spark):
    rng = random.Random(8)
    sources = [None, "b", "a", "", "z", "é"]
    rows = [(i, " ".join("w" * rng.randint(0, 400)), rng.choices(sources, [1, 30, 5, 2, 20, 1])[0]) for i in range(600)] + [(900, None, "a"), (901, "", "only empty"), (902, "w " * 30_000, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, again = (collected(mixing.mix_counts(docs.repartition(k))) for k in (2, 5))
    assert first == again
    size = {i: len(words_of(t)) for i, t, _ in rows}
    sizes = Counter()
    for i, _, s in rows:
        sizes[s] += size[i]
    target = wanted(dict(sizes))
    taken = Counter()
    for i, _, s in rows:
        r = first[i]
        assert r["size"] == size[i] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        assert 0 <= r["taken"] <= 3 * size[i]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 20)
    assert mixing.mix_counts(docs.limit(0)).count() == 0


# token counts


def test_token_totals_match_for_every_limit(spark):
    n = [0, 0, 1, 5, 5, 9, 5000, 5000, 12345]
    rows = collected(tokencounts.histogram(spark.createDataFrame([(i, x) for i, x in enumerate(n)], "doc_id long, n_tokens long")), "limit")
    assert set(rows) == set(n)
    for k, r in rows.items():
        assert (r["n_docs"], r["docs_upto"], r["docs_over"]) == (n.count(k), sum(x <= k for x in n), sum(x > k for x in n))
        assert r["tokens_upto"] == sum(x for x in n if x <= k)
        assert r["total_truncated"] == sum(min(x, k) for x in n)
        assert r["quantile"] == pytest.approx(sum(x <= k for x in n) / len(n))
    assert tokencounts.histogram(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_tokens_at_limits_that_no_document_has(spark):
    n = [0, 3, 3, 8, 20, 1000]
    hist = tokencounts.histogram(spark.createDataFrame([(i, x) for i, x in enumerate(n)], "doc_id long, n_tokens long"))
    out = collected(tokencounts.at_limits(hist, [0, 5, 8, 10**6]), "limit")
    for k, r in out.items():
        assert (r["docs_upto"], r["docs_over"], r["total_truncated"]) == (sum(x <= k for x in n), sum(x > k for x in n), sum(min(x, k) for x in n))
    assert len(out) == 4


def test_long_white_space_is_cut_as_the_pattern_cuts_it(spark, monkeypatch):
    import tiktoken

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    coder = tiktoken.Encoding("ranks", pat_str=tokencounts.PATTERN, mergeable_ranks=tokencounts.read_ranks(path), special_tokens={})
    monkeypatch.setattr(tokencounts, "LONG_RUN", 4)
    texts = ["a" + run + b for run in (" " * 4, "\n" * 5, " \n \t  ", "\u3000" * 6, "\u00a0\u2003 \n\n ", "\x1c" * 9) for b in ("", "b", ".", "\u00e9 d")] + [" " * 7, "a    b     c\n\n\n\n\n\nd 's    's"]
    out = collected(tokencounts.lengths(documents(spark, texts), path))
    assert [out[i]["n_tokens"] for i in range(len(texts))] == [len(coder.encode_ordinary(t)) for t in texts]
    monkeypatch.undo()
    out = collected(tokencounts.lengths(documents(spark, ["x " + " " * 2_000_000 + "y", "\n" * 1_500_000, "x" * 1_500_000]), path))
    assert out[0]["n_tokens"] > 1_000_000 and out[1]["n_tokens"] > 100_000 and out[2]["n_tokens"] > 0


def test_tokens_give_texts_back(spark):
    import tiktoken

    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    coder = tiktoken.Encoding("ranks", pat_str=tokencounts.PATTERN, mergeable_ranks=tokencounts.read_ranks(path), special_tokens={})
    texts = [t for t in ODD if t is None or len(t) < 1000] + ["naïve café — 1234 it's\n\n  x"]
    out = collected(tokencounts.lengths(documents(spark, texts), path))
    for i, t in enumerate(texts):
        tokens = coder.encode_ordinary(t) if t else []
        assert coder.decode(tokens) == (t or "")
        assert out[i]["n_tokens"] == len(tokens)


# learnt scores


def labelled(spark, n, seed=5):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        bad, toxic = rng.random() < 0.3, rng.random() < 0.2
        w = [rng.choice(["the", "of", "tree", "house", "river", "walk"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(20, 80))]
        if bad:
            w = [rng.choice(["$$$", "CLICK", "!!!", "a"]) if rng.random() < 0.5 else x for x in w]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["stupid", "idiot", "worthless"])
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, int(not bad), int(toxic)))
    extra = [(n + k, t, None, None, None) for k, t in enumerate(ODD)]
    return spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels + [(10**6, 1, None), (None, None, None), (0, labels[0][1], labels[0][2])], "doc_id long, quality int, toxic int"), labels


def accuracy(out, labels, k):
    held = [(out[i]["predicted"], x[k]) for i, *x in labels if out[i]["held_out"]]
    return sum(a == b for a, b in held) / len(held)


def test_learnt_scores_on_the_held_out_fifth(spark):
    docs, labels, truth = labelled(spark, 1500)
    quality_out = collected(quality.classify(docs, labels))
    toxic_out = collected(toxicity.score(docs, toxicity.learn(docs, labels)))
    for out in (quality_out, toxic_out):
        assert len(out) == 1500 + len(ODD)
        assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert accuracy(quality_out, truth, 0) >= 0.95
    assert accuracy(toxic_out, truth, 1) >= 0.95
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in quality_out.items() if r["score"] >= 0.3}


def test_scores_with_nothing_to_learn_from(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, none).count() == 2
    assert toxicity.score(docs, toxicity.learn(docs, none)).count() == 2


def test_nearest_examples_are_the_exact_nearest(spark):
    docs, labels, truth = labelled(spark, 400, 7)
    ex = toxicity.learn(docs, labels, least_docs=2, least_g2=0.0)
    w = toxicity.WordHasher(toxicity.APART)(toxicity.pa.array([r["text"] for r in docs.orderBy("doc_id").collect()][:400]))
    doc, term, n = toxicity.term_counts(w, ex.terms)
    import numpy as np

    full = np.zeros((len(ex.ids), len(ex.terms)))
    for t in range(len(ex.terms)):
        i, j = ex.cell_edge[ex.term_edge[t]], ex.cell_edge[ex.term_edge[t + 1]]
        full[ex.doc[i:j], t] = ex.weight[i:j]
    for d in range(0, 400, 29):
        own = doc == d
        q = (1 + np.log(n[own])) * ex.idf[term[own]]
        q = q / np.sqrt((q**2).sum())
        s, _ = ex.nearest(term[own], q)
        assert np.allclose(s, np.sort(full[:, term[own]] @ q)[::-1][: len(s)])


def test_blocks_are_left_by_their_bounds(spark, monkeypatch):
    # two languages: blocks of the one can't reach what is near to the other
    rng = random.Random(9)
    tongues = [[f"{x}{i}" for i in range(60)] for x in "pq"]
    texts = [" ".join(rng.choice(tongues[i % 2]) for _ in range(40)) for i in range(300)] + [None, ""]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 0, int(i % 7 == 0)) for i in range(302)], "doc_id long, quality int, toxic int")
    outs = {}
    for size in (8, 4096):
        monkeypatch.setattr(toxicity, "BLOCK", size)
        ex = toxicity.learn(docs, labels, k=5)
        outs[size] = collected(toxicity.score(docs, ex))
        w = toxicity.WordHasher(toxicity.APART)(toxicity.pa.array(texts))
        doc, term, n = toxicity.term_counts(w, ex.terms)
        for d in range(0, 300, 10):
            list(ex.votes([(term[doc == d], ex.weighted(term[doc == d], n[doc == d]), -1)]))
        assert ex.met < ex.known / 2 if size == 8 else ex.met == ex.known == 30
    for i, r in outs[8].items():
        assert r["score"] == pytest.approx(outs[4096][i]["score"], abs=1e-9)
        assert r["near_cosines"] == pytest.approx(outs[4096][i]["near_cosines"], abs=1e-9)


def test_votes_and_calibration_match(spark):
    docs, labels, truth = labelled(spark, 100, 11)
    ex = toxicity.learn(docs, labels, k=7)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    w = toxicity.WordHasher(toxicity.APART)(toxicity.pa.array([text[i] for i in ex.ids.tolist()]))
    doc, term, n = toxicity.term_counts(w, ex.terms)
    full = np.zeros((len(ex.ids), len(ex.terms)))
    full[doc, term] = (1 + np.log(n)) * ex.idf[term]
    full /= np.maximum(np.linalg.norm(full, axis=1, keepdims=True), 1e-12)
    votes = []
    for i in range(len(ex.ids)):
        cosine = full @ full[i]
        cosine[i] = 0
        near = sorted((-round(c, 12), j) for j, c in enumerate(cosine) if c > 0)[:7]
        weight = [1 / (1.02 - min(-c, 1)) for c, _ in near]
        votes.append((sum(x * ex.labels[j] for x, (_, j) in zip(weight, near, strict=True)) + ex.prior) / (sum(weight) + 1))
    # least squares that rise with the vote: the largest mean that begins before, of the least that ends after
    order = sorted(range(len(votes)), key=lambda i: votes[i])
    y = [ex.labels[i] for i in order]
    lo, hi = ex.steps[0][::2], ex.steps[0][1::2]
    for k, i in enumerate(order):
        fitted, size = max((min((sum(y[a : b + 1]) / (b + 1 - a), -(b + 1 - a)) for b in range(k, len(y))) for a in range(k + 1)), key=lambda x: x[0])
        at = np.flatnonzero((lo <= votes[i] + 1e-9) & (votes[i] - 1e-9 <= hi))
        assert len(at)
        level = [(ex.steps[1][2 * b] * (m + 1) - ex.prior) / m for b in at for m in [sum(lo[b] - 1e-9 <= v <= hi[b] + 1e-9 for v in votes)]]
        assert min(abs(x - fitted) for x in level) < 0.02, (k, fitted, level)
        assert -size > 0


def test_neighbours_are_found_by_words_that_do_not_tell(spark):
    docs, labels, truth = labelled(spark, 400, 7)
    copy = "nothing here is rude but these plain words stand in one example only"
    toxic = next(i for i in range(10**7, 10**7 + 99) if zlib.crc32(str(i).encode()) % 5)
    more = spark.createDataFrame([(toxic, copy, "en", "s", 0), (10**8, copy, "en", "s", 0), (10**8 + 1, f"{copy} unheard", "en", "s", 0)], DOCS)
    known = labels.unionByName(spark.createDataFrame([(toxic, 1, 1)], labels.schema))
    out = collected(toxicity.score(more, toxicity.learn(docs.unionByName(more), known)))
    assert out[10**8]["near_ids"][0] == toxic
    assert out[10**8]["near_cosines"][0] == pytest.approx(1)
    assert out[10**8 + 1]["near_ids"][0] == toxic
    assert 0.5 < out[10**8 + 1]["near_cosines"][0] < 0.99


def test_few_and_semi_join(spark):
    big = spark.range(10).withColumnRenamed("id", "k")
    keys = big.filter("k > 6")
    assert few(keys, 3) and not few(keys, 2)
    for limit in (1, 10):
        assert {r["k"] for r in semi_join(big, keys, "k", limit).collect()} == {7, 8, 9}
    assert big.agg(F.count("*")).first()[0] == 10


# the pipeline as a whole


def test_mixed_texts_are_the_words_taken(spark):
    texts = [" ".join(f"d{i}w{k}" for k in range(n)) for i, n in enumerate([1, 5, 40, 300, 900, 0, 7])] + [None, " a\tb \n c "]
    docs = documents(spark, texts)
    mixed = docs.join(mixing.mix_parts(docs), "doc_id")
    rows = mixing.mixed_texts(mixed).collect()
    taken = collected(mixed)
    for r in rows:
        assert words_of(r["text"]) == words_of(texts[r["doc_id"]])[r["from_word"] : r["to_word"]]
    for i, t in taken.items():
        assert t["taken"] == sum(len(words_of(r["text"])) for r in rows if r["doc_id"] == i)


def test_the_pipeline_on_odd_rows(spark, tmp_path):
    rng = random.Random(17)
    good = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) + ("." if k % 11 == 10 else "") for k in range(120))
    item = good()
    copied = good()
    texts = [(i, good()) for i in range(60)] + [(100 + i, copied + f" tail{i}") for i in range(5)]
    texts += [(200, f"so {item} on"), (201, "mail jo.doe@site.org now " + good()), (None, good()), (None, copied), (5, good()), (5, None), (300, ""), (301, None), (302, "x" * 100_000), (59, copied + " tail1")]
    rows = [(i, t, "en" if k % 5 else None, None, None) for k, (i, t) in enumerate(texts)]  # one source: the mix takes all
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert all(r["taken"] > 0 and r["text"] for r in out)
    # one of the copies stays, the least id; the contaminated row goes; the mail is masked; clean rows of repeated and null ids are judged by themselves
    stay = {(i, t) for i, t in texts[:60]} | {(None, texts[67][1]), (5, texts[69][1]), (59, copied + " tail1"), (302, "x" * 100_000)}
    left = {(r["doc_id"], r["text"]) for r in out if r["doc_id"] != 201}
    assert left == stay
    assert {r["doc_id"] for r in out} >= {59, 201} and not {100, 101, 102, 103, 104, 200} & {r["doc_id"] for r in out}
    assert [r["text"].startswith("mail <email> now") for r in out if r["doc_id"] == 201] == [True]
    assert out[0].asDict().keys() >= {"doc_id", "text", "lang", "source", "n_chars", "taken", "parts"}


def test_the_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
