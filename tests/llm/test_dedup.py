"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from quire.llm.ball_hashing import _meet, fingerprint, links, near_dedup, simhash_groups
from quire.llm.block_naming import exact_dedup
from quire.llm.common import Scratch, components
from quire.llm.line_join import line_report, without_duplicate_lines


def by_key(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("block", [1, 3, 64, 4096])
def test_exact_dedup(docs, docs_rows, block):
    rows = docs_rows if block > 3 else [r for r in docs_rows if len(r[1] or "") < 1000]
    source = docs if block > 3 else docs.where("text is null or length(text) < 1000")
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in rows)
    got = exact_dedup(source, block_bytes=block)
    assert got.columns == ["doc_id", "n_words", "keep_id", "group_size", "kept", "text_sha256"]
    assert by_key(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want


def test_exact_dedup_hot_and_empty(spark, no_docs):
    assert exact_dedup(no_docs).count() == 0
    rows = [(i, "same text of many") for i in range(300)] + [(1000 + i, f"own {i} " * 5) for i in range(100)] + [(None, "same text of many")]
    got = exact_dedup(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=7).collect()
    assert Counter((r["keep_id"], r["group_size"]) for r in got)[299, 301] == 301
    assert sum(r["kept"] for r in got) == 101


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reachable(prints, radius=2):
    """Smallest key reachable of every (key, fingerprint)."""
    root = {k: k for k, _ in prints}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, (a, p) in enumerate(prints):
        for b, q in prints[i + 1 :]:
            if (p ^ q).bit_count() <= 2 * radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k, _ in prints}


def test_simhash(docs, docs_rows, no_docs):
    assert all(fingerprint(t) == plain_fingerprint(t) for _, t, *_ in docs_rows)
    prints = [(i, plain_fingerprint(t)) for i, t, *_ in docs_rows]
    root = reachable(list(dict(prints).items()))
    want = sorted((i, f"{p:016x}", root[i]) for i, p in prints)
    assert by_key(simhash_groups(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash_groups(no_docs).count() == 0
    assert sorted({r["doc_id"] for r in near_dedup(docs).collect()}) == sorted(set(root.values()))


def test_near_dedup_decides_each_row(spark, no_docs):
    """Null and shared keys neither save a copy nor take an own text with them; names may clash."""
    a, b, c = ("the quick river ran over the old stones again " + x for x in ("", "while nobody looked at boats", "and eleven cats sang of distant harbours"))
    rows = [(1, a), (None, a), (None, b), (2, c), (2, a), (3, None), (4, ""), (None, None), (5, c)]
    docs = spark.createDataFrame([(k, t, i, "x") for i, (k, t) in enumerate(rows)], "doc_id long, text string, _print int, _key string")
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and sorted(r["_print"] for r in kept.collect()) == [0, 2, 3, 5]
    assert sorted(r["_print"] for r in near_dedup(docs.where("doc_id is null")).collect()) == [1, 2, 7]
    assert near_dedup(no_docs).count() == 0


def test_prefixes_over_many_batches():
    """A prefix may be spread over batches of any size."""
    import numpy as np
    import pandas as pd

    from quire.llm import ball_hashing

    random.seed(4)
    prints = sorted({(random.getrandbits(8) << 56) ^ (1 << random.randrange(56)) for _ in range(60)})
    frame = pd.DataFrame({"print": np.array(prints, dtype=np.uint64).view(np.int64), "prefix": [p >> 60 for p in prints], "bits": 4, "left": 2})
    results = []
    for size in (1, 3, 1000):
        batches = [frame.iloc[i : i + size] for i in range(0, len(frame), size)] + [frame.iloc[:0]]
        made = pd.concat(ball_hashing.meetings(batches, 2))
        results.append(sorted(set(zip(made["a"], made["b"]))))
    assert results[0] == results[1] == results[2] and results[0]


@pytest.mark.parametrize("radius", [1, 2])
def test_ball_links(spark, radius):
    random.seed(radius)
    centres = [random.getrandbits(64) for _ in range(6)]
    prints = set(centres)
    for c in centres:
        for _ in range(25):
            p = c
            for b in random.sample(range(64), random.randint(1, 6)):
                p ^= 1 << b
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "p long")
    found = components(links(frame, "p", radius), Scratch(spark, "test")).collect()
    got = {p: p for p in signed} | {r["node"]: r["root"] for r in found}
    assert got == reachable([(p, p & (1 << 64) - 1) for p in signed], radius)


def test_ball_links_in_turn(monkeypatch):
    """A prefix with too many values is taken in parts, with the same links."""
    import numpy as np

    import quire.llm.ball_hashing as ball

    random.seed(5)
    base = random.getrandbits(64)
    prints = np.array(sorted({base ^ sum(1 << b for b in random.sample(range(60), 3)) for _ in range(60)}), dtype=np.uint64)

    def roots():
        edges = _meet(prints, np.full(len(prints), 2), 4, base >> 60, 2)
        root = {int(p): int(p) for p in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            for x, y in zip(a.tolist(), b.tolist()):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        return {p: find(p) for p in root}

    whole = roots()
    monkeypatch.setattr(ball, "VALUES_AT_ONCE", 1000)
    assert roots() == whole


def test_components(spark):
    random.seed(3)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(160)] + [(500, i) for i in range(501, 540)] + [(i, i + 1) for i in range(600, 640)]
    root = {k: k for e in edges for k in e}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    assert {r["node"]: r["root"] for r in got} == {k: find(k) for e in edges if e[0] != e[1] for k in e}
    assert len(got) == len({r["node"] for r in got})


def words_of(line):
    return set(re.findall(r"[^\x20\x09-\x0D]+", line))


def plain_removed(rows):
    """{key: removed line numbers} by comparing every line with every earlier one."""
    lines = sorted({(i, n, line) for i, t, *_ in rows for n, line in enumerate((t or "").split("\n")) if t is not None and words_of(line)})
    removed = defaultdict(set)
    for at, (i, n, line) in enumerate(lines):
        own = words_of(line)
        for _, _, other in lines[:at]:
            theirs = words_of(other)
            if line == other or 5 * len(own & theirs) >= 4 * len(own | theirs):
                removed[i].add(n)
                break
    return {i: sorted(removed[i]) for i, *_ in rows}


def line_rows():
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
    base = [[random.choice(vocabulary) for _ in range(random.randint(1, 60))] for _ in range(40)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(random.randint(1, 5)):
            words = list(random.choice(base))
            for _ in range(random.randint(0, 6)):
                words[random.randrange(len(words))] = random.choice(vocabulary)
            lines.append(random.choice([" ", "  "]).join(words))
        rows.append((i, "\n".join(lines)))
    return rows


def test_lines_random(spark):
    rows = line_rows()
    # copies of one line with small changes: a cluster
    cluster = [f"w{j}" for j in range(40)]
    rows += [(1000 + i, " ".join(cluster[:i] + [f"new{i}"] + cluster[i + 1 :])) for i in range(40)]
    got = {r["doc_id"]: r["removed"] for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removed(rows)


def test_lines_with_full_sketches(spark, monkeypatch):
    """Bitmaps without a free bit let no copy and no removed line into the pairs."""
    import quire.llm.sketches as sketches

    rows = line_rows()
    cluster = [f"w{j}" for j in range(40)]
    rows += [(1000 + i, " ".join(cluster[:i] + [f"new{i}"] + cluster[i + 1 :])) for i in range(40)]
    rows += [(2000 + i, " ".join(cluster)) for i in range(100)]
    stored, put = {}, Scratch.put

    def spy(self, df, name):
        stored[name] = put(self, df, name)
        if name == "join-pairs":
            gone = {tuple(r) for r in stored["lead-gone"].collect()}
            asking = {(r["doc"], r["line"]) for r in stored[name].collect()}
            places = [(r["doc"], r["line"]) for part in ("passed", "firsts") for r in stored[part].collect() if part == "firsts" or not r["unsure"]]
            stored["seen"] = gone, asking, places
        return stored[name]

    monkeypatch.setattr(sketches, "BITS", 64)
    monkeypatch.setattr(Scratch, "put", spy)
    got = {r["doc_id"]: r["removed"] for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_removed(rows)
    gone, asking, places = stored["seen"]
    assert gone and not gone & asking
    assert len(places) == len({line for _, t in rows for line in t.split("\n")})


def test_lines_meet_in_one_shuffle(spark, monkeypatch):
    """Both sides of the join are one exchange, and words are hashed into one table that goes after use."""
    rows, plans, dropped, put, drop = line_rows(), [], [], Scratch.put, Scratch.drop

    def spy(self, df, name):
        if name == "join-pairs":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df, name)

    monkeypatch.setattr(Scratch, "put", spy)
    monkeypatch.setattr(Scratch, "drop", lambda self, name: (dropped.append(name), drop(self, name)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r["doc_id"]: r["removed"] for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == plain_removed(rows)
    assert "ReusedExchange" in plans[0] and "hashed" in dropped


def test_lines(docs, docs_rows, no_docs, spark):
    report = {r["doc_id"]: r for r in line_report(docs).collect()}
    assert {i: r["removed"] for i, r in report.items()} == plain_removed(docs_rows)
    assert report[13]["n_lines"] == 5 and report[3]["n_lines"] == report[4]["n_lines"] == report[5]["n_lines"] == 0
    assert line_report(no_docs).count() == 0
    kept = {r["doc_id"]: r["text"] for r in without_duplicate_lines(docs).collect()}
    assert kept[13] == "a\nb\n" and kept[3] is None and kept[4] == "" and 1 not in kept and 2 not in kept
    null_key = spark.createDataFrame([(None, "same line"), (1, "same line"), (None, "same line")], "doc_id long, text string")
    assert without_duplicate_lines(null_key).count() == 3
