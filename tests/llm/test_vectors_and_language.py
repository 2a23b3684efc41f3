"""Hard negatives, whitening and languages against brute-force versions, and on odd rows."""

from __future__ import annotations

import math
import random
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import hardnegatives, language, queries, vectors, whitening

VECTORS = "vec_id long, embedding array<double>, label int"
SMALL = "/root/testdata/sf0.001"


def floored(v):
    return [max(-(2**63), min(2**63 - 1, math.floor(256 * c))) for c in v]


def brute_negatives(rows, positives=5, negatives=10, low=30, high=90):
    own = [(i, label, floored(v)) for i, v, label in rows if label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dot = lambda a, b: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(a, b, strict=False))))
    rank = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for k, (i, label, v) in enumerate(own):
        if i is None or i % 100:
            continue
        scored = [(dot(v, w), j, theirs) for at, (j, theirs, w) in enumerate(own) if at != k]
        for p, j, _ in sorted([s for s in scored if s[2] == label], key=rank)[:positives]:
            fits = sorted([s for s in scored if s[2] != label and low * p <= 100 * s[0] <= high * p], key=rank)[:negatives]
            out += [(i, j, r + 1, n, p, s) for r, (s, n, _) in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, VECTORS).repartition(3)
    out = hardnegatives.mine(df, F.col("vec_id") % 100 == 0, **more)
    return sorted([(r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out.collect()], key=str)


def vectors_of(seed, n, dims=6, labels=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dims)) * rng.choice([0.05, 0.3, 1, 4], n)[:, None] + 0.3
    return [(i * 10, [float(c) for c in v], int(rng.integers(labels))) for i, v in enumerate(x)]


@pytest.mark.parametrize("bucket,block", [(1024, 1024), (4, 3)])
def test_negatives_are_those_of_all_pairs(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(hardnegatives, "BUCKET", bucket)
    monkeypatch.setattr(hardnegatives, "BLOCK", block)
    monkeypatch.setattr(hardnegatives, "STRIPES", 3)
    rows = vectors_of(bucket, 160)
    rows += [rows[3], rows[3], rows[40], rows[10], rows[10]]  # copies of candidates and of anchors
    rows += [(rows[10][0], [0.5] * 6, 1), (7, rows[20][1], rows[20][2]), (8, rows[20][1], rows[20][2])]  # an anchor's id again, ties
    assert mined(spark, rows) == brute_negatives(rows)


def test_negatives_on_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (1, [1.0], 1), (2, [], 2), (3, None, 2), (4, [1.0, None], 2), (5, [nan, 1.0], 2), (6, [inf, 1.0], 2), (8, [0.5, 0.5], None), (9, [0.5, 0.6], 2), (None, [0.5, 0.6], 2), (None, [1.0, 1.5], 1)]
    rows += [(100, [-1.0, -1.0], 1), (200, [0.0, 0.0], 2), (300, [1e9, 1e9], 1), (301, [3e9, 1e9], 1), (302, [1e9, 1.0], 2), (400, [1e300, 1.0], 2), (401, [1e300, 1.0], 2)]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == [] == mined(spark, [(1, [1.0], 1), (2, [1.0], 2)])
    extra = spark.createDataFrame(rows, VECTORS).select("*", *[F.lit("x").alias(c) for c in ("id", "x", "group", "copies", "anchor", "window", "hits", "rank", "score")])
    assert hardnegatives.mine(extra, F.col("vec_id") % 100 == 0).count() == len(brute_negatives(rows))


def test_low_buckets_are_skipped():
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((400, 8)) * np.geomspace(1, 4000, 400)[:, None]).astype(np.int64)
    table = pa.table({"group": pa.array([0] * 400, pa.int32()), "id": np.arange(400), "label": np.arange(400) % 2, "copies": np.ones(400, np.int64), "x": pa.array(x.tolist(), pa.list_(pa.int64()))})
    cut = hardnegatives.buckets(8, 20, True)(table)
    block = hardnegatives.buckets(8, 0, False)(table.slice(390))
    all_of = [{"place": i, "low": -(2**63), "high": 2**63 - 1} for i in range(10)]
    skips = []
    met = hardnegatives.search(8, 5, False, skips)(cut, block.append_column("windows", pa.array([all_of])))
    assert len(skips) == 20 and skips[0] == 0 and skips[-1] == 10 and sum(skips) > 100
    for r in met.to_pylist():
        own = block["ids"][0].as_py()[r["place"]]
        s = x @ x[own]
        best = sorted([(-s[j], j) for j in range(400) if j % 2 != own % 2])[:5]
        assert [(-h["score"], h["id"]) for h in r["hits"]] == best


def test_packed_matrices_come_back():
    for top in (1, 2**15 - 1, 2**15, 2**31, 2**62):
        x = np.array([[top, -top, 0], [1, 2, 3]], np.int64)
        assert (vectors.unpacked(vectors.packed(x), 3) == x).all()


# whitening


def brute_white(rows, components=4):
    own = [(i, floored(v)) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max([len(v) for _, v in own], default=0)
    x = np.array([v + [0] * (width - len(v)) for _, v in own], np.int64).reshape(len(own), width)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    c = (fit * n - sums) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [i for i, _ in own], (x * n - sums) / n @ (u / np.sqrt(e)), ((n * x - sums) ** 2).sum(1), e / np.trace(c.T @ c / n), n


def whitened(spark, rows, **more):
    return whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), **more).collect()


def test_whitened_vectors_are_those_of_the_eigenvectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((150, 24)) * np.geomspace(3, 0.2, 24) + 1
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1]) for i in range(60)] + [(2000, None), (2001, [float("nan")] * 24), (2002, [None] * 24), (2003, [1.0])]
    ids, want, deviation, explained, n = brute_white(rows)
    got = sorted(whitened(spark, rows), key=lambda r: (r.vec_id, r.component))
    by = np.argsort(ids)
    w = np.array([r.whitened for r in got]).reshape(-1, 4)
    signs = np.sign((w * want[by]).sum(0))
    assert [r.vec_id for r in got[::4]] == sorted(ids) and {r.n for r in got} == {n}
    assert np.abs(w * signs - want[by]).max() < 1e-10
    assert [r.deviation for r in got[::4]] == deviation[by].tolist()
    assert np.allclose([r.explained for r in got[:4]], explained, rtol=1e-10)
    assert max(r.identity_error for r in got) < 1e-10 and max(r.residual for r in got) < 1e-12


@pytest.mark.parametrize("width", [1, 2, 5, 40, 120])
def test_eigenvectors_of_any_width(width):
    rng = np.random.default_rng(width)
    a = rng.standard_normal((width, width)) * np.geomspace(1, 50, width)
    v = a @ a.T
    values, x, residuals = whitening.lobpcg(lambda b: v @ b, width, min(4, width))
    want = np.linalg.eigvalsh(v)[::-1][:4]
    assert np.allclose(values, want, rtol=1e-11) and (residuals < 1e-12 * want[0]).all() and np.allclose(x.T @ x, np.eye(len(values)), atol=1e-9)


def test_whitening_of_few_and_odd_rows(spark):
    assert whitened(spark, []) == [] == whitened(spark, [(1, [1.0, 2.0])]) == whitened(spark, [(1, []), (2, None)])
    line = whitened(spark, [(None, [1.0, 2.0]), (3, [2.0, 4.0]), (3, [3.0, 6.0])])
    assert sorted([(r.vec_id, r.component, r.n) for r in line], key=str) == [(3, 1, 3), (3, 1, 3), (None, 1, 3)]
    assert sorted(abs(round(r.whitened, 9)) for r in line) == [0, round(math.sqrt(1.5), 9), round(math.sqrt(1.5), 9)] and line[0].explained == pytest.approx(1)
    wide = whitened(spark, [(1, [1e16]), (2, [-1e16]), (3, [0.0])])
    assert [r.deviation for r in sorted(wide, key=lambda r: r.vec_id)] == [None, None, 0]
    named = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 1.0], 2)], "vec_id long, embedding array<float>, x int").select("*", F.lit(1).alias("n"), F.lit("").alias("component"))
    assert whitening.whiten(named).count() == 2


# languages


def grams_of(text):
    letters = [(c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text or ""]
    found = Counter()
    for w in "".join(letters).split(" "):
        if w:
            p = f" {w} "
            found.update(p[i : i + k] for k in (1, 2, 3) for i in range(len(p) - k + 1) if p[i : i + k].strip())
    return found


def ranks(counts, top):
    order = sorted(counts, key=lambda g: (-counts[g], len(g), g))[:top]
    return {g: r for r, g in enumerate(order)}


def brute_languages(rows, top):
    """id, language, score; rows: id, text, lang."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    learnt = {}
    for i, text, lang in rows:
        if lang is not None and not held(i):
            learnt.setdefault(lang, Counter()).update(grams_of(text))
    profiles = {k: ranks(v, top) for k, v in sorted(learnt.items()) if v}
    out = []
    for i, text, _ in rows:
        own = ranks(grams_of(text), top)
        if not profiles or not any(unicodedata.category(c)[0] == "L" for c in text or ""):
            out.append((i, held(i), "und", 0.0))
            continue
        far = {k: sum(abs(r - p[g]) if g in p else top for g, r in own.items()) for k, p in profiles.items()}
        best = min(far, key=lambda k: (far[k], k))
        out.append((i, held(i), best, 1 - far[best] / (len(own) * top)))
    return sorted(out, key=str)


def predicted(spark, rows, top):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    other = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    out = language.predict(docs, language.learn(docs.filter(~other), top=top), other, top=top)
    return sorted([(r.doc_id, r.held_out, r.lang_pred, r.score) for r in out.collect()], key=str)


WORDS = {"en": "the and of was house wind Water quiet", "de": "der und die Straße Übung nicht können", "th": "ภาษา ไทย น้ำ ที่ นี้ ความ", "el": "και ΤΟΥ λόγος της", "zz": "ξ þ İstanbul ét"}
ODD = [None, "", " ", "123 456", "́", "a", "A", "ß", "中文字符" * 3, "x" * 200_000, "the—und, die;και", "\x00a\x00", "\U0001f600", "w " * 50_000, "İSTANBUL", "don't"]


@pytest.mark.parametrize("top,languages,held", [(300, 500, 1_000_000), (12, 2, 40)])
def test_languages_are_those_of_plain_profiles(spark, monkeypatch, top, languages, held):
    monkeypatch.setattr(language, "LANGUAGES", languages)
    monkeypatch.setattr(language, "HELD", held)
    draw = random.Random(top)
    rows = []
    for i in range(120):
        lang = draw.choice(list(WORDS))
        rows.append((i, " ".join(draw.choice(WORDS[lang].split()) for _ in range(draw.randrange(1, 30))) + draw.choice(["", "\n7!", " the"]), draw.choice([lang, lang, None])))
    rows += [(500 + i, t, draw.choice(["en", "el", None])) for i, t in enumerate(ODD)] + [(None, "the wind", "en"), (3, "der und", "de"), (3, "der und", "de")]
    got, want = predicted(spark, rows, top), brute_languages(rows, top)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)


def test_languages_with_nothing_to_learn_from(spark):
    assert predicted(spark, [], 300) == []
    assert predicted(spark, [(1, "some text", None), (2, None, "en")], 300) == [(1, zlib.crc32(b"1") % 3 == 1, "und", 0.0), (2, zlib.crc32(b"2") % 3 == 1, "und", 0.0)]


# the queries themselves


def test_queries_match_sql_and_brute_force(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS FROM '{SMALL}/embeddings.parquet'")
    want = sorted(map(str, duck.execute(queries.OP11_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.op11_hard_negatives(spark, SMALL).collect()) == want and want
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = sorted([(r.doc_id, r.held_out, r.lang_pred, r.score) for r in queries.op13_language(spark, SMALL).collect()], key=str)
    want = brute_languages(rows, language.TOP)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-12)
    true = {i: lang for i, _, lang in rows}
    judged = [(p, true[i]) for i, held, p, _ in got if held and true[i]]
    assert sum(p == t for p, t in judged) > 0.95 * len(judged)
    vectors = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    ids, want, deviation, _, n = brute_white(vectors)
    by = {(r.vec_id, r.component): r for r in queries.op12_whitening(spark, SMALL).collect()}
    w = np.array([[by[i, c].whitened for c in (1, 2, 3, 4)] for i in ids])
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9 and [by[i, 1].deviation for i in ids] == deviation.tolist() and by[ids[0], 1].n == n


ALONE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.local.dir", sys.argv[2]).config("spark.checkpoint.dir", sys.argv[2] + "/shared").getOrCreate()

def lost(batches):
    import importlib.util
    yield from (b.slice(0, 0) for b in batches if importlib.util.find_spec("docloom") is None)

assert spark.range(2).mapInArrow(lost, "id long").count() == 0
from docloom.llm import queries
for name in sys.argv[4:]:
    getattr(queries, name)(spark, sys.argv[3]).write.format("noop").mode("overwrite").save()
    print(name, "done")
"""


@pytest.mark.parametrize("names", [["op3_decontamination", "op11_hard_negatives"], ["op12_whitening", "op13_language"]])
def test_workers_that_lack_the_package(tmp_path, names):
    (tmp_path / "alone.py").write_text(ALONE)
    repo = str(Path(__file__).resolve().parents[2])
    out = subprocess.run([sys.executable, "alone.py", repo, str(tmp_path), SMALL, *names], cwd=tmp_path, capture_output=True, text=True, timeout=400, check=False)
    assert out.stdout.count("done") == len(names), out.stderr[-3000:]
