"""The vector operators and the source audit against plain versions on small tables."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.llm import hard_negatives as hn
from quire.llm.common import Scratch
from quire.llm.divergence import batch_counts, source_divergence, term_counts
from quire.llm.hard_negatives import hard_negatives, strassen
from quire.llm.multi_index import LEAST, MultiIndex, nearest

VECTORS = "vec_id long, vector array<float>, label int, query_id string, score string"


def usable(vector, zero=False):
    ok = vector is not None and all(x is not None and math.isfinite(x) for x in vector)
    return ok and (zero or any(x != 0 for x in vector))


def dot(a, b):
    return math.fsum(float(np.float32(x)) * float(np.float32(y)) for x, y in zip(a, b))


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=9)], int(i % 4)) for i in range(120)]
    # ties, repeated rows, an own id that repeats, odd vectors
    rows += [(i, rows[20][1], 1) for i in (200, 205, 210)] + [rows[40], rows[40], rows[33], rows[33], (60, [1.0] * 9, 2)]
    rows += [(300, None, 1), (320, [0.0] * 9, 1), (340, [], 2), (350, [1.0, None], 2), (360, [float("nan")] * 9, 0), (380, [float("inf")] * 9, 0)]
    rows += [(None, [1.0] * 9, 1), (None, None, None), (400, [0.5, 0.25], 3), (420, [2.0] * 9, None)]
    return [(i, v, label, "clash", "clash") for i, v, label in rows]


def plain_nearest(rows, k, every):
    rows = [(i, v) for i, v, *_ in rows if i is not None and usable(v)]
    asking = {}
    for i, v in rows:
        if i % every == 0:
            asking[i] = min(v, asking.get(i, v))
    out = []
    for q, v in asking.items():
        best = sorted((-dot(v, w), i) for i, w in rows if i != q)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_nearest_small_is_exact(spark):
    rows = odd_vectors()
    found = nearest(spark.createDataFrame(rows, VECTORS), Scratch(spark, "t"), F.col("vec_id") % 20 == 0, k=5)
    got, want = sorted(map(tuple, found.collect())), plain_nearest(rows, 5, 20)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-12)


def test_nearest_few_and_none(spark):
    rows = odd_vectors()[:3]
    few = nearest(spark.createDataFrame(rows, VECTORS), Scratch(spark, "t"), F.col("vec_id") % 20 == 0)
    assert sorted((r["query_id"], r["vec_id"]) for r in few.collect()) == [(0, 1), (0, 2)]
    none = nearest(spark.createDataFrame([], VECTORS), Scratch(spark, "t"), F.col("vec_id") % 20 == 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]


def test_nearest_recall(spark):
    """More rows than a walk has to meet, one vector that a third of them share, few centroids."""
    rng = np.random.default_rng(5)
    points = rng.normal(size=(9000, 16)).astype(np.float32)
    points[::3] = points[0]
    frame = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(9000), "vector": list(points)}), "vec_id long, vector array<float>")
    got = nearest(frame, Scratch(spark, "t"), F.col("vec_id") % 60 == 7, k=10, sample=3000).toPandas()
    wide, hits = points.astype(float), 0
    for q in range(7, 9000, 60):
        scores = wide @ wide[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(9000), -scores))[:10]
        own = got[got["query_id"] == q].sort_values("rank")
        assert len(own) == 10 and np.allclose(own["score"], scores[own["vec_id"]], atol=1e-12)
        assert list(zip(-own["score"], own["vec_id"])) == sorted(zip(-own["score"], own["vec_id"]))
        hits += len(set(want) & set(own["vec_id"]))
    assert hits >= 0.9 * 10 * 150


def test_walk_is_in_order():
    rng = np.random.default_rng(9)
    index = MultiIndex(rng.normal(size=(500, 7)), 500, 5)
    query = rng.normal(size=7)
    walked = list(index.walk(query))
    near = [c @ part for c, part in zip(index.halves, (query[:3], query[3:]))]
    far = [near[0].max() + near[1].max() - near[0][c // len(near[1])] - near[1][c % len(near[1])] for c in walked]
    assert sorted(walked) == list(range(len(near[0]) * len(near[1]))) and np.all(np.diff(far) > -1e-12)
    assert LEAST >= 20


@pytest.mark.parametrize("shape", [(1, 1, 1), (17, 33, 50), (64, 64, 64), (100, 63, 19), (40, 9, 300)])
def test_strassen(shape):
    rng = np.random.default_rng(1)
    m, d, n = shape
    a, b = rng.integers(-(2**20), 2**20, (m, d)), rng.integers(-(2**20), 2**20, (n, d))
    assert np.array_equal(strassen(a, b), a @ b.T)
    big, other = a.astype(object) * 10**20, b.astype(object) * 10**20
    assert np.array_equal(strassen(big, other), big.dot(other.T))


def plain_negatives(rows, every, positives, negatives):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label, *_ in rows if i is not None and label is not None and usable(v, zero=True)]
    asking, out = {}, []
    for i, v, label in rows:
        if i % every == 0:
            asking[i] = min((label, v), asking.get(i, (label, v)))
    for anchor, (label, v) in asking.items():
        scores = [(-sum(x * y for x, y in zip(v, w)), i, other) for i, w, other in rows if i != anchor]
        for own, positive in {(s, i) for s, i, _ in sorted(x for x in scores if x[2] == label)[:positives]}:
            within = sorted((s, i) for s, i, other in scores if other != label and 50 * -own <= 100 * -s <= 95 * -own)
            out += [(anchor, positive, rank, i, -own, -s) for rank, (s, i) in enumerate(within[:negatives], 1)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    for name, size in (("ANCHORS", 5), ("CANDIDATES", 40), ("AT_ONCE", 2)):
        monkeypatch.setattr(hn, name, size)
    rows = odd_vectors()
    found = hard_negatives(spark.createDataFrame(rows, VECTORS), Scratch(spark, "t"), F.col("vec_id") % 10 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got, want = sorted(map(tuple, found.collect())), plain_negatives(rows, 10, 5, 3)
    assert got == want and len({r[0] for r in want}) > 8


def test_hard_negatives_none_and_huge(spark):
    none = hard_negatives(spark.createDataFrame([], VECTORS), Scratch(spark, "t"), F.col("vec_id") % 10 == 0)
    assert none.count() == 0
    alone = hard_negatives(spark.createDataFrame(odd_vectors()[:1], VECTORS), Scratch(spark, "t"), F.col("vec_id") % 10 == 0)
    assert alone.count() == 0
    rows = [(i, [1e15 + i * 1e10, 1.0], i % 2, "", "") for i in range(8)] + [(10, [1e15, 1.0], 0, "", ""), (13, [7e14, 0.0], 1, "", "")]
    huge = hard_negatives(spark.createDataFrame(rows, VECTORS.replace("float", "double")), Scratch(spark, "t"), F.col("vec_id") == 10).collect()
    vast = hard_negatives(spark.createDataFrame([(10, [1e38], 0, "", ""), (11, [2e38], 0, "", ""), (12, [1e37], 1, "", "")], VECTORS), Scratch(spark, "t"), F.col("vec_id") == 10)
    assert vast.count() == 0
    assert {(r["positive_id"], r["negative_id"]) for r in huge} == {(i, 13) for i in (0, 2, 4, 6)} and {r["negative_score"] for r in huge} == {None}


AUDIT = "lang string, source string, text string, n long, value string, rank int"


def plain_audit(rows, least, scale, top):
    terms = defaultdict(Counter)
    docs, groups = Counter(), set()
    for lang, source, text, *_ in rows:
        key = (lang or "", source or "")
        groups.add(key)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
        terms[key].update(found)
        docs.update((key[0], t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted((t for at, t in docs if at == lang and docs[at, t] >= least), key=lambda t: t.encode())
        sources = sorted((s for at, s in groups if at == lang), key=lambda s: s.encode())
        total = Counter()
        for s in sources:
            total.update({t: n for t, n in terms[lang, s].items() if t in set(kept)})

        def share(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + scale * (counts[t] + 1) // (n + len(kept)) for t in kept}

        q, shares = share(total), {s: share(terms[lang, s]) for s in sources}
        for s in sources:
            p = shares[s]
            pairs = sorted(((-sum((p[t] - o[t]) ** 2 // o[t] for t in kept), name.encode()) for name, o in shares.items() if name != s))
            out += [(lang, s, "pair", name.decode(), -v, rank) for rank, (v, name) in enumerate(pairs, 1)]
            over = sorted((-((p[t] - q[t]) ** 2 // q[t]), t.encode()) for t in kept if terms[lang, s][t] and p[t] > q[t])
            out += [(lang, s, "term", t.decode(), -v, rank) for rank, (v, t) in enumerate(over[:top], 1)]
    return sorted(out)


def audit_rows():
    words = ["a", "B", "to", "the", "Four", "fives", "eightlet", "ninechars", "sixteencharacter", "seventeencharacte", "x" * 40, "y" * 40, "Ünïcode", "日本語のとても長い言葉です", "𝔘", "z" * 300]
    rng = np.random.default_rng(7)
    rows = []
    for i in range(60):
        text = " ".join(rng.choice(words, size=int(rng.integers(0, 40)))) + ["", "-end1a", "\x00odd_", "\n\t"][i % 4]
        rows.append((["en", "de", None, "en"][i % 4], ["s1", "s2", None, "日"][i // 4 % 4], text))
    rows += [("en", "empty", None), ("en", "empty", ""), ("fr", "only", "rare words"), ("fr", "other", None), (None, None, None), rows[0], rows[0]]
    rows += [("en", "long", "the " * 20_000 + "é" * 5_000)]
    return [(*r, 1, "clash", 2) for r in rows]


@pytest.mark.parametrize("slice_bytes", [1 << 24, 64])
def test_source_divergence(spark, monkeypatch, slice_bytes):
    from quire.llm import divergence

    monkeypatch.setattr(divergence, "SLICE", slice_bytes)
    monkeypatch.setattr(divergence, "SOURCES", 2 if slice_bytes == 64 else 256)
    monkeypatch.setattr(divergence, "ROWS", 20)
    rows = audit_rows()
    found = source_divergence(spark.createDataFrame(rows, AUDIT), Scratch(spark, "t"), top=4)
    assert sorted(map(tuple, found.collect())) == plain_audit(rows, 3, 1_000_000_000, 4)


def test_source_divergence_none(spark):
    found = source_divergence(spark.createDataFrame([], AUDIT), Scratch(spark, "t"))
    assert found.count() == 0 and found.columns == ["lang", "source", "part", "item", "value", "rank"]
    bare = source_divergence(spark.createDataFrame([("en", s, None, 1, "", 2) for s in "ab"], AUDIT), Scratch(spark, "t"))
    assert sorted(map(tuple, bare.collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_term_counts_by_group(spark):
    counts = term_counts(spark.createDataFrame([("en", "s", "A a b1a", 1, "", 2), ("en", "s", "a", 1, "", 2)], AUDIT))
    assert sorted(map(tuple, counts.collect())) == [("en", "s", "a", 4, 2), ("en", "s", "b", 1, 1)]
    assert list(batch_counts(iter([]))) == []
