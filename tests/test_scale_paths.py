"""The ways taken beyond a size: blocks of hot keys, scans, document groups, vector blocks."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire import model
from quire.operators import files, fulltext, graph, hierarchy, media, neighbours, retrieval, scans, scoring, similarity, textindex
from quire.operators.common import as_of, neighbour_value, running_max, running_sum
from quire.plans import registered


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.fixture(scope="module")
def hot(spark):
    """One key with most rows, a few small ones."""
    rnd = random.Random(1)
    rows = [("hot" if i % 10 < 7 else f"k{i % 4}", rnd.randrange(1000), i) for i in range(600)]
    return rows, spark.createDataFrame(rows, "key string, v long, id long")


def test_running_sum_in_blocks(hot):
    rows, df = hot
    got = running_sum(df, ["key"], ["id"], {"total": F.col("v")}, block_rows=50)
    want, sums = [], {}
    for key, v, i in sorted(rows, key=lambda r: r[2]):
        want.append((key, i, sums.get(key, 0)))
        sums[key] = sums.get(key, 0) + v
    assert rows_of(got, "key", "id", "total") == sorted(want)


def test_running_max_in_blocks(hot):
    rows, df = hot
    got = running_max(df, ["key"], ["id"], {"most": F.col("v")}, block_rows=50)
    want, most = [], {}
    for key, v, i in sorted(rows, key=lambda r: r[2]):
        want.append((key, i, most.get(key)))
        most[key] = max(v, most.get(key, v))
    assert sorted(rows_of(got, "key", "id", "most"), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("ahead", [False, True])
def test_neighbour_value_in_blocks(hot, ahead):
    rows, df = hot
    got = neighbour_value(df, ["key"], ["id"], "v", "other", ahead=ahead, block_rows=50)
    by_key = {}
    for key, v, i in sorted(rows, key=lambda r: r[2]):
        by_key.setdefault(key, []).append((i, v))
    want = {}
    for key, items in by_key.items():
        for n, (i, _) in enumerate(items):
            at = n + (1 if ahead else -1)
            want[i] = items[at][1] if 0 <= at < len(items) else None
    assert {r["id"]: r["other"] for r in got.collect()} == want


def test_as_of_in_blocks(spark):
    rnd = random.Random(2)
    marks = [("hot", rnd.randrange(5000), f"m{i:04d}") for i in range(200)]
    points = [("hot", rnd.randrange(5000), f"p{i:04d}") for i in range(400)] + [("cold", 5, "p")]
    m = spark.createDataFrame(marks, "key string, at long, tie string").withColumn("found", F.col("tie"))
    p = spark.createDataFrame(points, "key string, at long, tie string")
    got = {r["tie"]: r["found"] for r in as_of(p, m, ["key"], "at", "found", "tie", block_rows=60).collect()}
    want = {}
    for key, at, tie in points:
        before = [(a, t) for k, a, t in marks if k == key and a <= at]
        want[tie] = max(before)[1] if before else None
    assert got == want


def plain_openings(rule, values):
    """The rules as loops over all rows of a key."""
    opens, since, held, last = [], 0, 0, None
    for value in values:
        if isinstance(rule, scans.MinimumRun):
            opens.append(since >= rule.least and value == 1)
            since = 1 if opens[-1] else since + 1
        elif isinstance(rule, scans.Budget):
            opens.append(since > 0 and (since >= rule.most_rows or held + value > rule.most))
            since, held = (1, value) if opens[-1] else (since + 1, held + value)
        else:
            opens.append(last is None or value - last >= rule.gap)
            last = value if opens[-1] else last
    return [int(x) for x in opens]


RULES = {
    "run": (scans.MinimumRun(10), lambda rnd: int(rnd.random() < 0.2)),
    "sparse": (scans.MinimumRun(3), lambda rnd: int(rnd.random() < 0.004)),
    "batch": (scans.Budget(7, 900), lambda rnd: rnd.choice((1, 40, 200, 700, 1200))),
    "small": (scans.Budget(100, 10**9), lambda rnd: 5),
    "gap": (scans.Spacing(10.0), lambda rnd: rnd.choice((0.0, 0.1, 1.7, 3.3, 30.0))),
    "wide": (scans.Spacing(700.0), lambda rnd: 0.1),
}


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("rows", [20, 10_000])
def test_openings_in_blocks(spark, name, rows):
    """One key in some 64 blocks and more, a null key, a few small ones, against a plain loop."""
    rule, draw = RULES[name]
    rnd, data = random.Random(name), []
    for key, n in (("hot", 700), (None, 90), ("a", 1), ("b", 45)):
        total = 0.0
        for i in range(n):
            value = draw(rnd)
            total = total + value if isinstance(rule, scans.Spacing) else value
            data.append((key, i, total, 9007199254740993 + i))
    kind = "double" if isinstance(rule, scans.Spacing) else "long"
    rows_in = [(k, i, float(v) if kind == "double" else int(v), big) for k, i, v, big in data]
    df = spark.createDataFrame(random.Random(2).sample(rows_in, len(rows_in)), f"key string, i int, v {kind}, big long")
    got = sorted(map(tuple, scans.openings(df, ["key"], ["i"], "v", rule, "opens", rows).collect()), key=repr)
    want = []
    for key in ("hot", None, "a", "b"):
        own = [r for r in rows_in if r[0] == key]
        want += [(*r, o) for r, o in zip(own, plain_openings(rule, [r[2] for r in own]))]
    assert got == sorted(want, key=repr)
    assert scans.openings(df.limit(0), ["key"], ["i"], "v", rule, "opens", rows).count() == 0


def test_openings_need_no_more_jobs_for_more_blocks(spark):
    """The jobs are the same whether a key has few blocks or many."""
    df = spark.range(3000).select(F.lit("k").alias("key"), "id", (F.col("id") % 7).alias("v"))
    jobs = []
    for rows in (600, 30):
        spark.sparkContext.setJobGroup(f"scan{rows}", "scan")
        scans.openings(df, ["key"], ["id"], "v", scans.Budget(5, 20), "opens", rows).count()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scan{rows}")))
    spark.sparkContext.setJobGroup("", "")
    assert abs(jobs[0] - jobs[1]) <= 2


def test_chapters_across_blocks(spark):
    rnd = random.Random(3)
    rows, at = [], 0.0
    for i in range(400):
        at += rnd.choice([0.5, 1.0, 9.0])
        rows.append((1, i, at, at + 0.4, "Chapter two" if rnd.random() < 0.05 else "text"))
    df = spark.createDataFrame(rows, "recording long, seq long, start double, end double, text string")
    plain = rows_of(media.detect_chapters(df, 3.0, 10), "chapter", "title", "start", "end")
    assert rows_of(media.detect_chapters(df, 3.0, 10, rows=13), "chapter", "title", "start", "end") == plain
    # the rule by hand
    want, count, last = [], 0, None
    for _, _, start, end, text in rows:
        if not want or (count >= 10 and (text == "Chapter two" or start - last > 3.0)):
            title = text if want and text == "Chapter two" else f"Chapter {len(want) + 1}"
            want.append([len(want) + 1, title, start, end])
            count = 0
        want[-1][3], last, count = end, end, count + 1
    assert plain == sorted(map(tuple, want))


@pytest.mark.parametrize("rows", [9, 10_000])
def test_frames_against_a_loop(spark, rows):
    rnd, data = random.Random(8), []
    looks = [f"{rnd.getrandbits(64):016x}" for _ in range(9)]
    for video in (1, None, 2):
        for i in range(150):
            look = rnd.choice([*looks, None, ""]) if rnd.random() < 0.4 or not i else data[-1][2]
            if look and rnd.random() < 0.2:
                look = f"{int(look, 16) ^ (1 << rnd.randrange(64)):016x}"
            data.append((video, i, look, rnd.random() < 0.8))
    df = spark.createDataFrame(random.Random(1).sample(data, len(data)), "video long, seq long, hash string, has_content boolean")
    got = {(r["video"], r["seq"]): r["duplicate"] for r in media.frame_dedupe(df, decide=lambda a, b: a < b, rows=rows).collect()}
    want, kept = {}, {}
    for video, i, look, content in data:
        last = kept.setdefault(video, [])
        alike = [(1 - (int(look, 16) ^ int(k, 16)).bit_count() / 64 if k else 0.0, k) for k in last[-5:]] if look else []
        want[(video, i)] = any(s >= 0.9 or s >= 0.7 and look < k for s, k in alike)
        if content and not want[(video, i)]:
            last.append(look or "")
    assert got == want


def mentions(spark, seed, docs=60, entities=25):
    rnd = random.Random(seed)
    rows = {("kb", d, e) for d in range(docs) for e in rnd.sample(range(entities), 3)}
    rows |= {("kb", d, 100) for d in range(docs) if d % 3}  # an entity of two thirds of all documents
    return rows, spark.createDataFrame(sorted(rows), "kb_id string, document_id long, entity_id long")


@pytest.mark.parametrize("heavy", [3, 10, 1000])
def test_shared_entities_of_frequent_ones(spark, heavy):
    rows, df = mentions(spark, heavy)
    got = rows_of(graph.shared_entity_documents(df, k=5, heavy_documents=heavy), "d1", "rank", "d2", "shared")
    ents = {}
    for _, d, e in rows:
        ents.setdefault(d, set()).add(e)
    want = []
    for a in ents:
        scored = sorted((-len(ents[a] & ents[b]), b) for b in ents if b != a and ents[a] & ents[b])
        want += [(a, n, b, -s) for n, (s, b) in enumerate(scored[:5], 1)]
    assert got == sorted(want)


def test_two_hops_against_paths(spark):
    rows, df = mentions(spark, 7, docs=30, entities=40)
    got = rows_of(graph.two_hop_documents(df, k=1000), "d1", "d2", "score")
    ents, docs = {}, {}
    for _, d, e in rows:
        ents.setdefault(d, set()).add(e)
        docs.setdefault(e, set()).add(d)
    ends = {}
    for a in ents:
        for e1 in ents[a]:
            for m in docs[e1] - {a}:
                for e2 in ents[m] - {e1}:
                    for b in docs[e2] - {a, m}:
                        ends.setdefault((a, b), set()).add(e2)
    assert got == sorted((a, b, 0.5 * len(e)) for (a, b), e in ends.items())


def vector_hits(*args, **named):
    return rows_of(retrieval.vector_search(*args, **named), "query_id", "rank", "chunk_id", "distance")


def test_vector_blocks(spark):
    """Blocks of any size find the same neighbours."""
    rnd = random.Random(5)
    rows = [(i, i % 3, [round(rnd.random(), 2) for _ in range(4)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, kb_id int, vector array<float>")
    queries = df.select(F.col("id").alias("query_id"), "kb_id", "vector")
    chunks = df.select(F.col("id").cast("string").alias("chunk_id"), "kb_id", "vector")
    whole = vector_hits(queries, chunks, 4, ["kb_id"])
    assert vector_hits(queries, chunks, 4, ["kb_id"], block_bytes=200) == whole
    assert len(vector_hits(queries, chunks, 4)) == 360
    for q in (0, 17):
        near = sorted((round(sum((a - b) ** 2 for a, b in zip(rows[q][2], v)), 6), str(i)) for i, kb, v in rows if kb == q % 3)[:4]
        got = [(round(d, 4), c) for qid, _, c, d in whole if qid == q]
        assert got == [(round(d, 4), c) for d, c in near]


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("pivots", [1, 4, 30])
def test_pruned_search_is_exact(spark, metric, pivots):
    """Clustered and scattered vectors, copies, a KB with fewer chunks than asked for."""
    rng = np.random.default_rng(pivots)
    centres = rng.normal(size=(6, 5)) * 8
    points = np.round(np.concatenate([c + rng.normal(size=(30, 5)) for c in centres] + [rng.normal(size=(20, 5)) * 9, np.repeat(centres[:1], 12, axis=0)]), 3)
    rows = [(i, 7 if i % 40 == 0 else i % 2, [float(x) for x in p]) for i, p in enumerate(points)]
    df = spark.createDataFrame(rows, "id long, kb_id int, vector array<double>")
    queries, chunks = df.select(F.col("id").alias("query_id"), "kb_id", "vector"), df.select(F.col("id").cast("string").alias("chunk_id"), "kb_id", "vector")
    got = vector_hits(queries, chunks, 9, ["kb_id"], metric=metric, pivots=pivots, block_bytes=800)
    want = []
    for q, kb, _ in rows:
        own = [(i, str(i)) for i, other, _ in rows if other == kb]
        near = neighbours.distances(points[[q]], points[[i for i, _ in own]], metric)[0]
        best = sorted(zip(near, [name for _, name in own]))[:9]
        want += [(q, rank, name, d) for rank, (d, name) in enumerate(best, 1)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)]
    assert np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-6)


def test_search_skips_far_clusters(spark, monkeypatch):
    """Of all pairs of a query and a cluster, only some are looked at where vectors form clusters."""
    rng = np.random.default_rng(2)
    points = np.concatenate([c + rng.normal(size=(60, 8)) for c in rng.normal(size=(10, 8)) * 10])
    around = neighbours.Pivots(points[::20], "l2")
    away = around.away(points)
    home = away.argmin(axis=1)
    cells = [{"cell": int(c), "n": int((home == c).sum()), "radius": float(away[home == c, c].max()), "blocks": 1} for c in np.unique(home)]
    visited = 0
    for i, p in enumerate(points):
        near = around.near(away[i], cells, 5)
        inside = np.isin(home, [c["cell"] for c in near])
        bound = np.sort(((points[inside] - p) ** 2).sum(axis=1))[4]
        more = around.closer(away[i], cells, 5, bound)
        visited += len(near) + len(more)
        best = np.argsort(((points - p) ** 2).sum(axis=1))[:5]
        assert set(home[best]) <= {c["cell"] for c in [*near, *more]}
    assert visited < 0.4 * len(points) * len(cells)


@pytest.mark.parametrize("pivots", [1, 3, 25])
def test_similar_documents_are_all_found(spark, pivots):
    """A document with thirty near chunks of its own, one with many partners, copies, another KB."""
    rng = np.random.default_rng(pivots)
    rows = []
    for doc in range(40):
        for i in range(30 if doc == 3 else 4):
            base = np.eye(6)[doc % 6] * 2 if doc else np.eye(6)[3] * 2
            rows.append((f"c{doc}:{i}", doc % 2, doc, i, [float(x) for x in np.round(base + rng.normal(size=6) * 0.35, 3)]))
    rows += [("z1", 1, 90, 0, rows[0][4]), ("z2", 1, 91, 0, None), ("z3", 1, 92, 0, [])]
    df = spark.createDataFrame(rows, "chunk_id string, kb_id int, document_id long, position int, vector array<double>")
    got = rows_of(similarity.similar_documents(df, None, 0.5, block_bytes=500, pivots=pivots), "kb_id", "document_id", "target_kb", "target_id", "similarity_score", "matching_chunks")
    scores = {}
    for _, kb, doc, _, v in rows:
        for _, other_kb, target, _, w in rows:
            if v and w and kb == other_kb and doc != target:
                s = 1 / (1 + round(sum((a - b) ** 2 for a, b in zip(v, w)), 6))
                if s >= 0.5:
                    scores.setdefault((kb, doc, kb, target), []).append(s)
    want = {key: (sum(sorted(s)[-3:]) / min(3, len(s)), len(s)) for key, s in scores.items()}
    assert {g[:4]: g[5] for g in got} == {key: n for key, (_, n) in want.items()} and max(n for _, n in want.values()) > 20
    assert all(abs(g[4] - want[g[:4]][0]) < 2e-6 for g in got)
    both = spark.createDataFrame([(0, 1)], "kb_id int, target_kb int")
    across = similarity.similar_documents(df, 5, 0.5, both, pivots=pivots)
    assert {(r["kb_id"], r["target_kb"]) for r in across.collect()} <= {(0, 1)} and similarity.similar_documents(df.limit(0)).count() == 0


@pytest.mark.parametrize("pivots", [1, 5])
def test_first_similar_documents_are_cut_in_the_task(spark, pivots):
    """The first k are those of all, ties by id, also of documents too large to be dealt whole; a task
    that sees documents whole lets out no more than k of each."""
    rng = np.random.default_rng(pivots)
    points = [[float(x) for x in np.round(np.eye(4)[doc % 2] + rng.normal(size=4) * 0.1, 1)] for doc in range(60)]
    rows = [(f"c{doc}:{i}", 0, doc, point) for doc, point in enumerate(points) for i in range(1 + (doc % 9 == 0))]
    rows += [(f"big:{i}", 0, 99, points[0]) for i in range(similarity.WHOLE_CHUNKS + 1)]
    df = spark.createDataFrame(rows, "chunk_id string, kb_id int, document_id long, vector array<double>")
    every = similarity.similar_documents(df, None, 0.5, pivots=pivots).collect()
    first = similarity.similar_documents(df, 3, 0.5, pivots=pivots, block_rows=40).collect()
    assert sorted(first) == sorted(r for r in every if r["rank"] <= 3) and len(every) > 1000
    asked = pd.DataFrame({"_asked": points, "kb_id": 0, "document_id": range(60), "_n": 1})
    held = pd.DataFrame({"_held": points, "_f0": 0, "target_id": range(60), "_n": 1})
    assert similarity._similar_pairs(asked, held, 0.5, 3).groupby("document_id").size().max() == 3


def test_vector_filters(spark):
    """A query without chunks has no hits; null equals nothing; integers stay integers beside nulls."""
    queries = spark.createDataFrame([("a", 3, [1.0]), ("b", None, [1.0]), ("c", 9, [1.0]), ("d", 3, [])], "query_id string, kb_id int, vector array<double>")
    chunks = spark.createDataFrame([("x", 3, [2.0]), ("y", None, [1.0]), ("z", 3, None)], "chunk_id string, kb_id int, vector array<double>")
    assert vector_hits(queries, chunks, 2, ["kb_id"]) == [("a", 1, "x", 1.0)]
    assert vector_hits(queries.where("query_id = 'c'"), chunks, 2, ["kb_id"]) == []
    assert vector_hits(queries, chunks.limit(0), 2) == []
    ties = spark.createDataFrame([(f"t{i}", 3, [0.0]) for i in range(9)], "chunk_id string, kb_id int, vector array<double>")
    assert [h[2] for h in vector_hits(queries.where("query_id = 'a'"), ties, 3, ["kb_id"])] == ["t0", "t1", "t2"]


def test_wide_vectors(spark):
    wide = spark.range(40).select(F.col("id").cast("string").alias("chunk_id"), F.transform(F.sequence(F.lit(0), F.lit(3071)), lambda i: (F.col("id") * 7 % 40 + i % 2).cast("double")).alias("vector"))
    got = vector_hits(wide.select(F.col("chunk_id").alias("query_id"), "vector"), wide, 1, block_bytes=8 * 3072 * 10)
    assert [h[2] for h in got] == [h[0] for h in got] and len(got) == 40


@pytest.fixture(scope="module")
def worded(spark):
    """Chunks of a Zipf vocabulary with copies and blanks, and queries of frequent, rare and unknown words."""
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]

    def text(n):
        return " ".join(vocabulary[min(399, int(rnd.paretovariate(0.7)) - 1)] for _ in range(n))

    rows = [(f"c{i:03d}", i % 3, i // 4, text(rnd.randint(1, 60))) for i in range(300)]
    rows += [(f"d{i}", 1, 80, rows[7][3]) for i in range(12)] + [("e1", 0, 81, None), ("e2", 0, 81, " .,; "), ("e3", 2, 82, "Ünïcode w0 w0 w0")]
    chunks = spark.createDataFrame(rows, "chunk_id string, kb_id int, document_id int, text string")
    asked = [(i, text(rnd.randint(1, 25)), i % 3) for i in range(25)] + [(90, "unknown words", 0), (91, "", 0), (92, None, 1), (93, "w0", 1), (94, "ünïcode", 2), (95, "w399 w398 w0 w1", 0)]
    return chunks, spark.createDataFrame(asked, "query_id long, query string, kb_id int")


@pytest.mark.parametrize(("ranges", "k", "scopes"), [(20, 10, (None, "kb_id")), (100_000, 1, (None,)), (20, 1000, ("kb_id",))])
def test_index_equals_plain_relevance(spark, tmp_path, worded, ranges, k, scopes):
    chunks, queries = worded
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index", ["chunk_id", "kb_id", "document_id"])
    # grown by a second segment; one that was never finished does not count
    index.add(chunks.where("document_id < 50"), range_rows=ranges)
    index.add(chunks.where("document_id >= 50"), range_rows=ranges)
    chunks.limit(5).write.parquet(f"file://{tmp_path}/index/forward/segment=torn")
    for scope in scopes:
        got = index.top(queries, k, scope=scope)
        want = retrieval.keyword_search(chunks, queries, k, scope=scope)
        columns = ("query_id", "rank", "chunk_id", "score", "document_id")
        assert rows_of(got, *columns) == rows_of(want, *columns)
    assert index.top(queries.limit(0), k).count() == 0


def test_index_reads_few_candidates(spark, tmp_path, worded, monkeypatch):
    """Frequent words alone make no candidate."""
    chunks, queries = worded
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index", ["chunk_id", "kb_id", "document_id"])
    index.add(chunks)
    held = {}
    plain = textindex.stored

    def watched(df, name):
        held[name] = plain(df, name)
        return held[name]

    monkeypatch.setattr(textindex, "stored", watched)
    rare = queries.where("query_id in (95, 90)").unionByName(spark.createDataFrame([(96, "w350 w0 w1 w2 w3", 1)], queries.schema))
    index.top(rare, 2).count()
    assert held["candidates"].count() < 0.2 * retrieval.keyword_search(chunks, rare, 10_000).count()


def test_closure_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    starts = spark.createDataFrame([("r1", "a"), ("r2", "d"), ("r3", "z")], "request string, node string")
    want = [("r1", n) for n in "abc"] + [("r2", n) for n in "abcd"] + [("r3", "z")]
    assert rows_of(graph.closure(starts, edges), "request", "node") == sorted(want)


def test_closure_of_a_long_chain(spark, monkeypatch):
    """A thousand nodes in a row take about ten rounds, not a thousand."""
    rounds, plain = [], graph.cut_lineage

    def watched(df):
        rounds.append(1)
        return plain(df)

    monkeypatch.setattr(graph, "cut_lineage", watched)
    edges = spark.createDataFrame([(i, i + 1) for i in range(999)] + [(5000, 3), (999, 998)], "src long, dst long")
    starts = spark.createDataFrame([("a", 0), ("b", 990), ("c", 5000), ("d", 77777)], "request string, node long")
    want = [("a", i) for i in range(1000)] + [("b", i) for i in range(990, 1000)] + [("c", i) for i in range(3, 1000)] + [("c", 5000), ("d", 77777)]
    assert rows_of(graph.closure(starts, edges), "request", "node") == sorted(want)
    assert len(rounds) <= 3 * 15


def test_closure_against_a_walk(spark):
    rnd = random.Random(6)
    links = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(75)}
    starts = [(r, rnd.randrange(60)) for r in range(12)]
    want = set()
    for r, node in starts:
        todo = [node]
        while todo:
            node = todo.pop()
            if (r, node) not in want:
                want.add((r, node))
                todo += [d for s, d in links if s == node]
    got = graph.closure(spark.createDataFrame(starts, "request int, node int"), spark.createDataFrame(sorted(links), "src int, dst int"), plain_steps=1)
    assert rows_of(got, "request", "node") == sorted(want)


def test_paths_meet_in_the_middle(spark):
    """Against a breadth-first search that keeps every shortest path."""
    rnd = random.Random(9)
    links = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)}
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    asked = [(r, rnd.randrange(42), rnd.randrange(42)) for r in range(40) for _ in range(1 + r % 2)]
    for limit in (10, 3):
        want = []
        for r in {a[0] for a in asked}:
            starts, ends = ({a[i] for a in asked if a[0] == r} for i in (1, 2))
            paths, seen = [[s] for s in starts], set(starts)
            for _ in range(limit + 1):
                hits = [p for p in paths if p[-1] in ends]
                if hits:
                    want += [(r, i, n) for i, n in enumerate(min(hits))]
                    break
                paths = [[*p, n] for p in paths for n in near.get(p[-1], ()) if n not in seen]
                seen |= {p[-1] for p in paths}
        got = graph.shortest_paths(spark.createDataFrame(asked, "request int, start int, end int"), spark.createDataFrame(sorted(links), "src int, dst int"), limit)
        assert rows_of(got, "request", "hop", "node") == sorted(want)


def test_shortest_path_ties_and_limit(spark):
    edges = spark.createDataFrame([("a", "x"), ("a", "b"), ("b", "z"), ("x", "z"), ("z", "t")], "src string, dst string")
    asked = spark.createDataFrame([(1, "a", "z"), (2, "a", "a"), (3, "a", "q")], "request int, start string, end string")
    got = rows_of(graph.shortest_paths(asked, edges), "request", "hop", "node")
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "z"), (2, 0, "a")]
    assert graph.shortest_paths(asked.where("request = 1"), edges, max_hops=1).count() == 0


def test_containment_by_long_pieces_and_never_through_the_driver(spark):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("ab1.") for _ in range(rnd.randrange(0, 40))) for _ in range(150)]
    inner = texts[:50] + [t[2:11] for t in texts[50:100]] + [t[:3] for t in texts[100:]] + ["", "b"]
    left = spark.createDataFrame([(i % 3, t) for i, t in enumerate(inner)], "key int, small string")
    right = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts)], "key int, id int, large string")
    got = files.containment_matches(left, right, ["key"], "small", "large")
    # an empty text is in no other here
    want = [(i % 3, s, j, t) for i, s in enumerate(inner) for j, t in enumerate(texts) if i % 3 == j % 3 and s and s in t]
    assert rows_of(got, "key", "small", "id", "large") == sorted(want)
    # exploded pieces look small to the planner: none may be sent to the driver as a broadcast
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(("k", "scope", "blocks"), [(3, None, (40, 7)), (1000, "kb_id", (8192, 4096)), (10, "kb_id", (25, 5))])
def test_relevance_in_blocks_equals_all_pairs(spark, worded, monkeypatch, k, scope, blocks):
    chunks, queries = worded
    key = ["chunk_id", "document_id", "kb_id"]
    pairs = fulltext.bm25(chunks, key, "text", queries)
    pairs = pairs.join(queries.select("query_id", "kb_id"), ["query_id", "kb_id"]) if scope else pairs
    want = fulltext.best_hits(pairs, ["query_id"], ["chunk_id"], k)
    monkeypatch.setattr(scoring, "TILE", 3)
    got = scoring.best_relevant(chunks, key, "text", queries, k, scope=scope, chunk_rows=blocks[0], query_rows=blocks[1])
    columns = ("query_id", "rank", "chunk_id", "score", "document_id")
    assert rows_of(got, *columns) == rows_of(want, *columns)
    assert scoring.best_relevant(chunks.limit(0), key, "text", queries, k).count() == 0


def test_relevance_cuts_texts_once_and_stores_asked_terms(spark, worded, monkeypatch):
    """one pass over the corpus gives sizes and postings, and words no query asks for are not kept."""
    chunks, queries = worded
    key, some = ["chunk_id", "document_id", "kb_id"], queries.where("query_id < 3")
    cut, tables, terms, stored = [], {}, fulltext.terms, fulltext.stored
    monkeypatch.setattr(fulltext, "terms", lambda text: cut.append(text) or terms(text))
    monkeypatch.setattr(fulltext, "stored", lambda df, name: tables.setdefault(name, stored(df, name)), raising=False)
    few = rows_of(fulltext.bm25(chunks, key, "text", some), "query_id", "chunk_id", "score")
    assert len(cut) == 2  # queries and corpus
    asked = {w for r in some.collect() for w in r["query"].lower().split()}
    assert {r["term"] for r in tables["postings"].select("term").distinct().collect()} <= asked | {""}
    monkeypatch.setattr(fulltext, "FEW_TERMS", 0)
    assert few and rows_of(fulltext.bm25(chunks, key, "text", some), "query_id", "chunk_id", "score") == few


def test_index_moves_no_posting_for_each_of_many_queries(spark, tmp_path, worded, monkeypatch):
    """Queries that share their terms meet the chunks in blocks, without a table of candidates."""
    chunks, queries = worded
    many = queries.where("query_id < 25").withColumn("query_id", F.explode(F.sequence(F.col("query_id") * 8, F.col("query_id") * 8 + 7)))
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index", ["chunk_id", "kb_id", "document_id"])
    index.add(chunks.where("document_id < 50"))
    index.add(chunks.where("document_id >= 50"))
    written, plain = [], textindex.stored
    monkeypatch.setattr(textindex, "stored", lambda df, name: written.append(name) or plain(df, name))
    got = index.top(many, 4, scope="kb_id")
    assert "candidates" not in written
    pairs = fulltext.bm25(chunks, ["chunk_id", "kb_id"], "text", many).join(many.select("query_id", "kb_id"), ["query_id", "kb_id"])
    columns = ("query_id", "rank", "chunk_id", "score")
    assert rows_of(got, *columns) == rows_of(fulltext.best_hits(pairs, ["query_id"], ["chunk_id"], 4), *columns)


def test_citations_of_copies_are_not_shuffled_as_pairs(spark):
    """many texts that cite one author, many documents of it and many copies of a title; the pairs
    are made last, and documents held twice have their points summed."""
    from quire.operators.citations import match_citations

    names = ["Ann Roy", "Bo Roy", "ann ROY", "Kim Lee", "  ", None]
    docs = [("kb", i, f"The Long Road to {'Rome' if i % 3 else i}", names[i % 6]) for i in range(700)]
    cites = ["See Roy (2001).", "Smith and Roy (1999) [3].", "Ann and Roy (2001), [4]: the long road to Rome, The Long Road to Rome.", "Nothing.", "[7] the\tlong road to rome"]
    texts = [("kb", i, cites[i % 5]) for i in range(600)]

    def expected(docs, texts, threshold):
        found = {0: ["roy"], 1: ["smith and roy", None], 2: ["ann and roy", None], 3: [], 4: [None]}
        out = {}
        for _, d, text in texts:
            cited = found[d % 5]
            for _, t, title, author in docs:
                points, name = 0, (author or "").lower().strip()
                for c in cited:
                    if c and name:
                        a, w = c.split(), name.split()
                        points += 2 if c == name else int(a[-1] in w if len(a) == 1 else a[-1] == w[-1] or (a[0] in w and a[-1] in w))
                if title.lower() in text.lower():
                    points += 2 * sum(1 for c in cited if not (c and author and not name))
                if d != t and points:
                    out[d, t] = out.get((d, t), 0) + points
        return {pair: min(n / 3, 1.0) for pair, n in out.items() if min(n / 3, 1.0) >= threshold}

    def got(df):
        rows = df.select("document_id", "target_id", "confidence").toPandas()
        pairs = dict(zip(zip(rows.document_id, rows.target_id), rows.confidence))
        assert len(pairs) == len(rows)
        return {pair: round(c, 6) for pair, c in pairs.items()}

    def frames(docs, texts):
        return spark.createDataFrame(texts, "kb_id string, document_id long, text string"), spark.createDataFrame(docs, "kb_id string, document_id long, title string, author string")

    for threshold in (0.0, 0.5):
        df = match_citations(*frames(docs, texts), threshold)
        assert got(df) == {p: round(c, 6) for p, c in expected(docs, texts, threshold).items()}
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Generate" in plan and "Exchange" not in plan[: plan.index("Generate")]
    doubled = docs[:40] + docs[:10]
    df = match_citations(*frames(doubled, texts[:40]), 0.5)
    assert got(df) == {p: round(c, 6) for p, c in expected(doubled, texts[:40], 0.5).items()}


@pytest.mark.parametrize("tile_groups", [20, 1000])
def test_groups_of_frequent_entities_meet_in_tiles(spark, tile_groups):
    """overlaps are counted in tiles of groups, whatever their number; names serve as ids."""
    rnd = random.Random(5)
    rows = {(kb, f"d{d}", f"e{e}") for kb in ("a", "b") for d in range(50) for e in [*rnd.sample(range(12), 4), 100 + d // 2, 200 + rnd.randrange(40)]}
    df = spark.createDataFrame(sorted(rows), "kb_id string, document_id string, entity_id string")
    got = rows_of(graph.shared_entity_documents(df, k=6, heavy_documents=5, tile_groups=tile_groups), "kb_id", "d1", "rank", "d2", "shared")
    ents = {}
    for kb, d, e in rows:
        ents.setdefault((kb, d), set()).add(e)
    want = []
    for kb, a in ents:
        scored = sorted((-len(ents[kb, a] & s), b) for (o, b), s in ents.items() if o == kb and b != a and ents[kb, a] & s)
        want += [(kb, a, n, b, -s) for n, (s, b) in enumerate(scored[:6], 1)]
    assert got == sorted(want)


def test_partners_are_counted_in_their_task(spark):
    """Lists go to the task of their document, in whatever batches; a partner is counted once
    for each entity, never for the document in between alone."""
    import pyarrow as pa
    from quire.operators.partners import _counts

    rnd = random.Random(2)
    rows = sorted({(rnd.randrange(4), rnd.randrange(9), rnd.randrange(12)) for _ in range(150)})
    rows = [("kb", d, e, m if m else None, sorted(rnd.sample(range(12), 4))) for d, e, m in rows]
    for size in (1, 7, 1000):
        batches = [pa.RecordBatch.from_pylist([dict(zip(("kb_id", "d1", "e", "m", "docs"), r)) for r in rows[i : i + size]],
                   schema=pa.schema([("kb_id", pa.string()), ("d1", pa.int64()), ("e", pa.int64()), ("m", pa.int64()), ("docs", pa.list_(pa.int64()))])) for i in range(0, len(rows), size)]
        got = sorted((int(r.d1), int(r.d2), int(r.n)) for part in _counts(iter(batches), 3) for r in part.itertuples())
        met = {}
        for _, d1, e, m, docs in rows:
            for d2 in docs:
                if d2 not in (d1, m):
                    met.setdefault(d1, {}).setdefault(d2, set()).add(e)
        assert got == sorted((d1, d2, len(es)) for d1, of in met.items() for d2, es in sorted(of.items(), key=lambda x: (-len(x[1]), x[0]))[:3])


@pytest.mark.parametrize("name", ["document_entities", "mention_edges", "upsert_entities", "chunk_related_concepts", "entity_cross_references"])
def test_order_lines_are_dealt_to_bounded_tasks(spark, monkeypatch, name):
    """Larger tables of lines are joined and grouped in as many tasks as their rows ask for; same results."""
    whole = [tuple(r) for r in registered()[name](spark, "/root/testdata/sf0.001").collect()]
    monkeypatch.setattr(model, "TASK_LINES", 100)
    dealt = registered()[name](spark, "/root/testdata/sf0.001")
    got = [tuple(r) for r in dealt.collect()]
    assert sorted(got, key=str) == sorted(whole, key=str) and got
    assert "REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()


def test_deleted_keys_meet_counts_not_rows(spark):
    """The counts of a delete move one row a key and task, not the rows of the key."""
    rows = spark.range(5000).select((F.col("id") % 2).alias("kb"), F.col("id").alias("line"))
    gone = rows.where("id < 1").select("kb")
    left, counts = hierarchy.delete_rows({"lines": rows}, "kb", gone)
    assert [tuple(r) for r in counts.collect()] == [(0, "lines", 2500)] and left["lines"].columns == ["kb", "line"]
    assert {r["kb"] for r in left["lines"].collect()} == {1} and left["lines"].count() == 2500
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("count(1)")


def test_batches_are_numbered_without_texts(spark, monkeypatch):
    """no text goes through the blocks of the scan and of the running sum."""
    from quire.operators import chunking, common

    rows = [(f"kb{i % 2}", i, f"word{i} " * (i % 7 + 1)) for i in range(60)]
    seen, blocks = [], common.ordered_blocks
    spy = lambda df, *rest: seen.append(df.columns) or blocks(df, *rest)
    monkeypatch.setattr(common, "ordered_blocks", spy)
    monkeypatch.setattr(scans, "ordered_blocks", spy)
    got = chunking.embedding_batches(spark.createDataFrame(rows, "kb string, id int, text string"), ["kb"], ["id"], max_texts=4, max_tokens=30)
    want, state = [], {}
    for kb, i, text in rows:
        number, held, used = state.get(kb, (0, 0, 0))
        size = max(1, len(text) // 3)
        number, held, used = (number + 1, 1, size) if held and (held >= 4 or used + size > 30) else (number, held + 1, used + size)
        state[kb] = number, held, used
        want.append((kb, i, text, number))
    assert rows_of(got, "kb", "id", "text", "batch_no") == sorted(want)
    assert seen and not any("text" in columns for columns in seen)


def test_chapters_are_stored_and_listed_under_few_buckets(spark, monkeypatch):
    """a chapter of hundreds of hours is not listed under each of its hours."""
    chapters = spark.createDataFrame([(1, 1, "a", 0.0, 1e6), (1, 2, "b", 1e6 + 1, 2e6)], "recording long, chapter int, title string, start double, end double")
    segments = spark.createDataFrame([(r, i, i * 1e5, i * 1e5 + 9, f"s{i}") for r in (1, 2) for i in range(20)], "recording long, seq int, start double, end double, text string")
    visuals = segments.select("recording", (F.col("start") + 2).alias("t"), F.col("text").alias("description"), F.lit("slide").alias("kind"), F.lit(True).alias("has_content"))
    widths, names, join, stored = [], [], media.span_join, media.stored
    monkeypatch.setattr(media, "span_join", lambda *a: widths.append(a[-1]) or join(*a))
    monkeypatch.setattr(media, "stored", lambda df, name: names.append(name) or stored(df, name))
    texts, seen = media.merge_visuals(chapters, segments, visuals)
    assert rows_of(texts, "recording", "chapter", "text") == [
        (1, 1, " ".join(f"s{i}" for i in range(10))), (1, 2, " ".join(f"s{i}" for i in range(11, 20))), (2, 1, " ".join(f"s{i}" for i in range(20)))
    ]
    assert rows_of(seen, "recording", "chapter", "t") == sorted((r, 2 if r == 1 and i > 10 - 1 else 1, i * 1e5 + 2) for r in (1, 2) for i in range(20))
    assert min(widths) >= 1e6 - 2 and "own-chapters" in names


@pytest.mark.parametrize(("k", "scope"), [(10, None), (3, "kb_id")])
def test_postings_are_written_when_asked_and_find_the_same(spark, tmp_path, worded, monkeypatch, k, scope):
    """an index that is searched in blocks holds no postings."""
    chunks, queries = worded
    index = textindex.TextIndex(spark, f"file://{tmp_path}/index", ["chunk_id", "kb_id", "document_id"])
    index.add(chunks.where("document_id < 50"), range_rows=20)
    index.add(chunks.where("document_id >= 50"), range_rows=20)
    columns = ("query_id", "rank", "chunk_id", "score", "document_id")
    blocks = rows_of(index.top(queries, k, scope=scope), *columns)
    assert not (tmp_path / "index" / "postings").exists()
    monkeypatch.setattr(textindex, "SHARED", 10**9)
    assert rows_of(index.top(queries, k, scope=scope), *columns) == blocks
    index.add(spark.createDataFrame([("z9", 1, 99, "w0 w0 fresh")], "chunk_id string, kb_id int, document_id int, text string"))
    asked = spark.createDataFrame([(1, "fresh", 1)], "query_id long, query string, kb_id int")
    assert [r["chunk_id"] for r in index.top(asked, 2).collect()] == ["z9"]


def test_blocks_of_queries_move_hits_only(spark, worded, monkeypatch):
    """Chunks are read where they lie, once for each block of queries, and a task lets
    out k chunks of a query however many it has read."""
    chunks, queries = worded
    seen, plain = [], scoring.best_hits
    monkeypatch.setattr(scoring, "best_hits", lambda found, *a: seen.append(found) or plain(found, *a))
    rows = chunks.repartition(1)
    got = scoring.best_relevant(rows, ["chunk_id"], "text", queries, 2, chunk_rows=10, query_rows=9)
    assert len(seen) > 2
    assert all("Exchange" not in f._jdf.queryExecution().executedPlan().toString() for f in seen)
    # one task has all chunks: the hits that it lets out are the result
    monkeypatch.undo()
    first = []
    monkeypatch.setattr(scoring, "best_hits", lambda found, *a: first.append(found.count()) or plain(found, *a))
    scoring.best_relevant(rows, ["chunk_id"], "text", queries, 2, chunk_rows=10)
    assert sum(first) == got.count()


@pytest.mark.parametrize("seeded", [False, True])
def test_two_hops_move_mentions_and_not_paths(spark, monkeypatch, seeded):
    """tasks that hold a KB find what lists find, with hubs, strings and few paths at a time."""
    from quire.operators import hops

    _, df = mentions(spark, 7, docs=60, entities=40)
    hub = spark.createDataFrame([("k", d, 900 + e) for d in range(0, 50) for e in range(3)], df.schema)
    df = df.unionByName(hub).unionByName(hub.withColumn("kb_id", F.lit("other")))
    df = df.withColumn("document_id", F.concat(F.lit("d"), "document_id"))
    seeds = df.where("document_id in ('d3', 'd17', 'none')").select("kb_id", "document_id") if seeded else None
    columns = ("kb_id", "d1", "rank", "d2", "score")
    want = rows_of(graph.two_hop_documents(df, 6, seeds, task_edges=0), *columns)
    sent, plain = [], graph.two_hops_in_tasks
    monkeypatch.setattr(graph, "two_hops_in_tasks", lambda *a: sent.append(plain(*a)) or sent[-1])
    assert want == rows_of(graph.two_hop_documents(df, 6, seeds), *columns)
    # one shuffle of packed mentions, and none of what comes out
    assert sent[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert want == rows_of(graph.two_hop_documents(df, 6, seeds, task_edges=200), *columns)  # one KB this way, one that
    monkeypatch.setattr(hops, "PACK_EDGES", 10)
    monkeypatch.setattr(hops, "HUB_DOCUMENTS", 5)
    monkeypatch.setattr(hops, "CANDIDATES", 50)
    assert want == rows_of(graph.two_hop_documents(df, 6, seeds), *columns)


def test_related_rows_meet_once(spark):
    """choosing the kind of a pair and ranking a document's pairs share one shuffle."""
    one = spark.createDataFrame([("k", 1, 2, 3), ("k", 1, 2, 3), ("k", 1, 4, 1)], "kb_id string, d1 long, d2 long, shared long")
    two = spark.createDataFrame([("k", 1, 2, 4.0), ("k", 1, 5, 1.0)], "kb_id string, d1 long, d2 long, score double")
    near = spark.createDataFrame([("k", 1, 5, "cites", 1.0), ("k", 1, 6, "similar_to", 0.5)], "kb_id string, d1 long, d2 long, relationship_type string, score double")
    got = graph.related_documents(one, two, near, 3)
    want = [(1, 1, 2, "shared_entity", 4.0, 2), (1, 2, 4, "shared_entity", 1.0, 1), (1, 3, 5, "shared_entity", 1.0, 2)]
    assert got._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert rows_of(got, "d1", "rank", "d2", "relationship_type", "score", "hops") == want


def test_runs_without_a_title_stay_in_their_task(spark, monkeypatch):
    """only runs that some title has are shuffled; with too many titles all are, and the hits are the same."""
    from quire.operators import citations as ci

    said = [f"alpha w{i} beta gamma delta w{i + 1} end" for i in range(40)]
    texts = spark.createDataFrame([("k", i, t) for i, t in enumerate([*said, "two words", "", None])], "kb_id string, document_id long, text string")
    held = ["w3 beta gamma delta w4", "w5 beta gamma", "a beta gamma delta w8 end", "gamma beta delta w9 end", "no such title here", "beta gamma", "a w7 b"]
    titles = spark.createDataFrame([("k", t, i) for i, t in enumerate(held)], "kb_id string, title string, title_id long")
    sent, plain = [], ci._title_runs

    def watched(shared, lengths):
        run = plain(shared, lengths)
        sent.append(spark.sparkContext.accumulator(0))
        total = sent[-1]

        def counting(batches):
            for batch in run(batches):
                total.add(batch.num_rows)
                yield batch

        return counting

    monkeypatch.setattr(ci, "_title_runs", watched)
    want = sorted((i, j) for i, t in enumerate(said) for j, h in enumerate(held) if len(set(h.split())) > 2 and h in t)
    assert rows_of(ci._title_hits(texts, titles), "document_id", "title_id") == want
    monkeypatch.setattr(ci, "FEW_TITLES", 0)
    assert rows_of(ci._title_hits(texts, titles), "document_id", "title_id") == want
    assert 0 < sent[0].value < sent[1].value / 2
