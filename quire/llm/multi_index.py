"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut into two halves and each half is quantised by its own centroids, so k centroids a
half make k * k cells. A query ranks the centroids of either half and walks over pairs of them with a
heap, nearest sum first; it stops when the cells it has been to hold a given share of all entries.
Entries of these cells are then ranked by their true inner products.

Only the centroids and the cells' sizes are fitted: the former on a bounded sample. Every row is in
the index, cells that hold many rows are split over blocks and small ones share a block.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.llm.tiles import copied, finite, stacked, tiled, tiles_of

# rows that the centroids are fitted on, and of them those that set where a walk stops
SAMPLE, ASKED = 20_000, 300
# centroids of a half at most, so that all cells have a size known to every task
CENTROIDS = 256
# share of true neighbours that a walk is to meet on the sample
TARGET = 0.95
# entries that a walk meets at least, in cells; rows of a block; queries of a tile
LEAST, BLOCK, QUERIES = 2048, 8192, 4096


def _assigned(half: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2 * (half @ centroids.T), axis=1)


def _means(half: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's iterations from rows spread over the sample; a centroid without rows stays."""
    centroids = half[np.linspace(0, len(half) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = _assigned(half, centroids)
        order = np.argsort(home, kind="stable")
        ids, first = np.unique(home[order], return_index=True)
        centroids[ids] = np.add.reduceat(half[order], first, axis=0) / np.diff(np.append(first, len(half)))[:, None]
    return centroids


class MultiIndex:
    """Centroids of both halves and where a walk stops: all that is fitted, of bounded size."""

    def __init__(self, sample: np.ndarray, rows: int, k: int, target: float = TARGET):
        self.width, self.cut = sample.shape[1], sample.shape[1] // 2
        n = int(np.clip(round(rows ** (1 / 3)), 1, min(CENTROIDS, len(sample))))
        self.halves = [_means(sample[:, : self.cut], n), _means(sample[:, self.cut :], n)]
        self.share = self._share(sample, rows, k, target)

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        first, second = (_assigned(h, c) for h, c in zip((vectors[:, : self.cut], vectors[:, self.cut :]), self.halves))
        return first * len(self.halves[1]) + second

    def walk(self, query: np.ndarray) -> Iterator[int]:
        """Cells in order of their summed distance, where the distance of a centroid is how far its
        inner product with the query's half lies below the best one's."""
        sides = []
        for part, centroids in zip((query[: self.cut], query[self.cut :]), self.halves):
            near = centroids @ part
            order = np.argsort(-near, kind="stable")
            sides.append((order.tolist(), (near[order[0]] - near[order]).tolist()))
        (first, far1), (second, far2) = sides
        n = len(second)
        # pair (i, j) enters once (i - 1, j) and (i, j - 1) are out: row i holds its next j, and a
        # row may not run ahead of the one before it
        heap, upto, waiting = [(0.0, 0, 0)], [0] * len(first), [False] * len(first)
        waiting[0] = True
        while heap:
            _, i, j = heapq.heappop(heap)
            yield first[i] * n + second[j]
            upto[i], waiting[i] = j + 1, False
            if j + 1 < n and (i == 0 or upto[i - 1] > j + 1):
                heapq.heappush(heap, (far1[i] + far2[j + 1], i, j + 1))
                waiting[i] = True
            if i + 1 < len(first) and not waiting[i + 1] and upto[i + 1] == j:
                heapq.heappush(heap, (far1[i + 1] + far2[j], i + 1, j))
                waiting[i + 1] = True

    def _share(self, sample: np.ndarray, rows: int, k: int, target: float) -> float:
        """Share of the entries at which a walk has met `target` of the neighbours, on the sample:
        with n of N rows in it, the k nearest of all are its k * n / N nearest."""
        if len(sample) < 2:
            return 1.0
        asked = np.linspace(0, len(sample) - 1, min(ASKED, len(sample))).astype(int)
        k = min(len(sample) - 1, max(1, round(k * len(sample) / rows)))
        cells = self.cells(sample)
        sizes = np.bincount(cells, minlength=len(self.halves[0]) * len(self.halves[1]))
        needs = []
        for i in asked:
            scores = sample @ sample[i]
            scores[i] = -np.inf
            near = cells[np.argpartition(-scores, k - 1)[:k]]
            walked = np.fromiter(self.walk(sample[i]), dtype=np.int64, count=len(sizes))
            met = np.empty(len(sizes))
            met[walked] = np.cumsum(sizes[walked]) / len(sample)
            needs.append(met[near])
        return float(np.quantile(np.concatenate(needs), target))


class Route:
    """Which blocks a query has to be compared in, and with which of their cells."""

    def __init__(self, index: MultiIndex, sizes: np.ndarray, block: np.ndarray, splits: np.ndarray, least: int):
        self.index, self.sizes, self.block, self.splits, self.least = index, sizes, block, splits, least

    schema = "query_id long, vector array<double>, copies long, block int, cells array<int>"

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes, block, splits = self.sizes.tolist(), self.block.tolist(), self.splits.tolist()
        for batch in batches:
            rows = []
            for query_id, vector, copies in zip(batch["query_id"], stacked(batch["vector"], self.index.width), batch["copies"]):
                enough, met, blocks = self.least + copies, 0, {}
                for cell in self.index.walk(vector):
                    if not sizes[cell]:
                        continue
                    for b in range(block[cell], block[cell] + splits[cell]):
                        blocks.setdefault(b, []).append(cell)
                    met += sizes[cell]
                    if met >= enough:
                        break
                rows += [(query_id, vector, copies, b, cells) for b, cells in blocks.items()]
            yield pd.DataFrame(rows, columns=["query_id", "vector", "copies", "block", "cells"])


class Rerank:
    """The k best entries of a block for each query that came to it, by inner products in double
    precision. A matrix product finds them, up to its rounding, and each is computed on its own."""

    schema = "query_id long, vec_id long, score double"

    def __init__(self, k: int, width: int):
        self.k, self.width = k, width

    def __call__(self, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        ids, rows = entries["vec_id"].to_numpy(dtype=np.int64), stacked(entries["vector"], self.width)
        cells, code = np.unique(entries["cell"].to_numpy(), return_inverse=True)
        norms = np.abs(rows).sum(axis=1)
        for at in range(0, len(queries) if len(rows) else 0, 256):
            part = queries.iloc[at : at + 256]
            asked, names = stacked(part["vector"], self.width), part["query_id"].to_numpy(dtype=np.int64)
            allowed = np.zeros((len(part), len(cells)), dtype=bool)
            for i, own in enumerate(part["cells"]):
                allowed[i, np.searchsorted(cells, np.intersect1d(cells, own))] = True
            scores = np.where(allowed[:, code] & (ids != names[:, None]), asked @ rows.T, -np.inf)
            # no sum of products is off by more than this
            slack = 4 * self.width * np.finfo(float).eps * np.abs(asked).max(axis=1, initial=0) * norms.max()
            if len(rows) > self.k:
                limit = np.partition(scores, len(rows) - self.k, axis=1)[:, len(rows) - self.k]
                near = (scores >= (limit - slack)[:, None]) & (scores > -np.inf)
            else:
                near = scores > -np.inf
            i, j = np.nonzero(near)
            exact = (asked[i] * rows[j]).sum(axis=1)
            order = np.lexsort((ids[j], -exact, i))
            i, j, exact = i[order], j[order], exact[order]
            first = np.searchsorted(i, i)
            keep = np.arange(len(i)) - first < self.k
            out.append(pd.DataFrame({"query_id": names[i[keep]], "vec_id": ids[j[keep]], "score": exact[keep]}))
        return pd.concat(out[1:] or out, ignore_index=True)


def _sample(entries: DataFrame, rows: int, size: int) -> np.ndarray:
    """About `size` rows, at most twice as many: those with the smallest hashes of their id."""
    below = min(1.0, 1.2 * size / max(1, rows))
    hashed = entries.select("vector", F.xxhash64("vec_id").alias("h")).where(F.col("h") <= F.lit(min(2**63 - 1, int(below * 2**64) - 2**63)))
    return [r["vector"] for r in hashed.orderBy("h").limit(size).select("vector").collect()]


def nearest(rows: DataFrame, scratch: Scratch, asks, k: int = 20, target: float = TARGET, least: int = LEAST, sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `asks` holds for, its `k` nearest other rows
    of those found, by largest inner product in double precision, ties by smaller vec_id.

    `rows` has vec_id and vector; other columns are ignored. Rows with a null vec_id, and vectors that
    are null, empty, zero or hold null or non-finite components take no part. Shorter vectors count
    as filled up with zeros. Rows with the query's vec_id are its own, not its neighbours; of several
    queries with one id the one with the smallest vector asks; other repeated rows are all found. Every
    query has `k` rows, or all others where there are fewer; no rows give no rows.

    A walk ends when it has met `share` of all entries (fitted so that `target` of the neighbours are
    met on the sample of at most `sample` rows), and at least `least` besides the query's own rows; up to
    that many rows the search is exact.
    """
    least = max(least, k)
    usable = rows.select("vec_id", "vector").where(F.col("vec_id").isNotNull() & finite(F.col("vector"))).where(F.exists("vector", lambda x: x != 0))
    given = scratch.put(usable.withColumn("vector", F.col("vector").cast("array<double>")), "entries")
    count, width = given.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = MultiIndex(stacked(_sample(given, count, sample), width), count, k, target)

    @F.pandas_udf("int")
    def cell(vectors: pd.Series) -> pd.Series:
        return pd.Series(index.cells(stacked(vectors, width)).astype(np.int32))

    indexed = scratch.put(given.withColumn("cell", cell("vector")), "indexed")
    # at most CENTROIDS ** 2 rows
    held = {r["cell"]: r["n"] for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = np.zeros(len(index.halves[0]) * len(index.halves[1]), dtype=np.int64)
    sizes[list(held)] = list(held.values())
    splits = np.maximum(1, -(-sizes // BLOCK))
    block, at, room = np.zeros(len(sizes), dtype=np.int64), 0, 0
    for i, size in enumerate(sizes):
        # cells in a row share a block while it has room
        if splits[i] > 1 or size > room:
            at, room = at + 1, BLOCK
        block[i] = at
        at, room = (at + splits[i] - 1, 0) if splits[i] > 1 else (at, room - size)
    places = rows.sparkSession.createDataFrame(
        [(int(c), int(block[c]), int(splits[c])) for c in np.flatnonzero(sizes)], "cell int, first int, splits int"
    )
    asking = given.where(asks).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("vector"), F.count("*").alias("copies"))
    asking = scratch.put(asking, "asking")
    q = tiles_of(asking.count(), QUERIES)
    # the broadcast side is one row a cell, at most CENTROIDS ** 2
    salt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.col("splits")).cast("int")
    entries = indexed.join(F.broadcast(places), "cell").select("vec_id", "vector", "cell", (F.col("first") + salt).alias("block"))
    route = Route(index, sizes, block, splits, max(least, int(np.ceil(index.share * count))))
    # few queries are cheap to read and dear to walk for: their tasks are split by hash
    sent = tiled(asking, q, "tile", "query_id").repartition("query_id").select("query_id", "vector", "copies").mapInPandas(lambda b: route(b), route.schema)
    left = tiled(sent, q, "tile", "query_id").groupBy("tile", "block")
    right = copied(entries, q, "tile").groupBy("tile", "block")
    rerank = Rerank(k, width)
    found = left.cogroup(right).applyInPandas(lambda x, y: rerank(x, y), rerank.schema)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
