"""Hard negatives: rows of another label that score within a window below an anchor's positives.

Anchors and candidates meet tile by tile. Inner products of a tile are an integer matrix product by
Strassen's recursion: operands are padded with zeros to even sizes, seven half-size products replace
eight, and small blocks are multiplied directly. Integers wrap around in additions and come back, so
a result that fits is exact.

Two passes over the tiles, together one product for each anchor and candidate: the first multiplies
rows of one label and keeps each anchor's best, the second the rows of other labels and keeps, for
each positive, the best within its window. What tiles keep merges by taking the best again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.llm.tiles import copied, finite, stacked, tiled, tiles_of

# rows of a tile; anchors multiplied at a time; a block with a side this small is multiplied directly
ANCHORS, CANDIDATES, AT_ONCE, LEAF = 8192, 8192, 512, 16


def _even(x: np.ndarray) -> np.ndarray:
    """A zero row and column more where the sizes are odd."""
    out = np.full((x.shape[0] + x.shape[0] % 2, x.shape[1] + x.shape[1] % 2), 0, dtype=x.dtype)
    out[: x.shape[0], : x.shape[1]] = x
    return out


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a (m x d) times the transpose of b (n x d), for int64 or Python integers."""
    (m, d), n = a.shape, b.shape[0]
    if min(m, d, n) <= LEAF:
        return np.einsum("ik,jk->ij", a, b) if a.dtype != object else a.dot(b.T)
    if m % 2 or d % 2 or n % 2:
        return strassen(_even(a), _even(b))[:m, :n]
    h, k, w = m // 2, d // 2, n // 2
    a11, a12, a21, a22 = a[:h, :k], a[:h, k:], a[h:, :k], a[h:, k:]
    # blocks of the transpose of b
    b11, b12, b21, b22 = b[:w, :k], b[w:, :k], b[:w, k:], b[w:, k:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((m, n), dtype=p1.dtype)
    out[:h, :w], out[:h, w:] = p1 + p4 - p5 + p7, p3 + p5
    out[h:, :w], out[h:, w:] = p2 + p4, p1 - p2 + p3 + p6
    return out


def scaled(vectors, scale: int, width: int) -> np.ndarray:
    """floor(scale * x) of all components, as doubles that hold integers."""
    return np.floor(scale * stacked(vectors, width))


def integers(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both operands as int64, or as Python integers where an inner product, or its place in a sorted
    tile, could leave 64 bits."""
    bound = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) * max(1, len(b))
    if bound < 2.0**61:
        return a.astype(np.int64), b.astype(np.int64)
    big = np.frompyfunc(int, 1, 1)
    return big(a).astype(object).reshape(a.shape), big(b).astype(object).reshape(b.shape)


def keyed(scores: np.ndarray) -> np.ndarray:
    """Score and place of a candidate in one number: sorted, the best is last and of equal scores the
    first candidate, so that candidates in order of their id need no other tie-break."""
    n = scores.shape[1]
    return scores * n + np.arange(n - 1, -1, -1)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, best first."""
    n, keys = scores.shape[1], keyed(scores)
    if k < n:
        keys = np.partition(keys, n - k, axis=1)[:, n - k :]
    return (n - 1 - np.sort(keys, axis=1)[:, ::-1] % n).astype(np.int64)


def held(score) -> int:
    """A score as it travels: of 38 digits at most."""
    return max(1 - 10**38, min(10**38 - 1, int(score)))


class Positives:
    """First pass: each anchor's best rows of its own label."""

    def __init__(self, k: int, scale: int, width: int):
        self.k, self.scale, self.width = k, scale, width

    schema = "anchor_id long, positive_id long, positive_score decimal(38,0)"

    def __call__(self, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple] = []
        rows = rows.sort_values("vec_id", kind="stable")
        by_label = {label: part for label, part in rows.groupby("label")}
        for label, asking in anchors.groupby("label"):
            if label not in by_label:
                continue
            part = by_label[label]
            ids, v = part["vec_id"].to_numpy(), scaled(part["vector"], self.scale, self.width)
            for at in range(0, len(asking), AT_ONCE):
                own = asking.iloc[at : at + AT_ONCE]
                scores = strassen(*integers(scaled(own["vector"], self.scale, self.width), v))
                # an anchor's own rows come on top and go
                for anchor, line in zip(own["vec_id"].tolist(), scores):
                    others = np.flatnonzero(ids != anchor)
                    if len(others):
                        top = others[best(line[None, others], self.k)[0]]
                        found += [(anchor, int(ids[j]), held(line[j])) for j in top]
        return pd.DataFrame({"anchor_id": [f[0] for f in found], "positive_id": [f[1] for f in found], "positive_score": [f[2] for f in found]}, dtype=object)


class Windows:
    """Second pass: for each positive of an anchor the best rows of other labels in its window."""

    def __init__(self, k: int, low: int, high: int, scale: int, width: int):
        self.k, self.low, self.high, self.scale, self.width = k, low, high, scale, width

    schema = "anchor_id long, positive_id long, positive_score decimal(38,0), negative_id long, negative_score decimal(38,0)"

    def __call__(self, anchors: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id", kind="stable")
        ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
        vectors = scaled(rows["vector"], self.scale, self.width)
        found: list[tuple] = []
        for label, asking in anchors.groupby("label"):
            other = np.flatnonzero(labels != label)
            if not len(other):
                continue
            v, names = vectors[other], ids[other]
            for at in range(0, len(asking), AT_ONCE):
                own = asking.iloc[at : at + AT_ONCE]
                keys = np.sort(keyed(strassen(*integers(scaled(own["vector"], self.scale, self.width), v))), axis=1)
                for anchor, positives, line in zip(own["vec_id"].tolist(), own["positives"], keys):
                    found += self._within(anchor, positives, line, names)
        columns = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pd.DataFrame({c: [f[i] for f in found] for i, c in enumerate(columns)}, dtype=object)

    def _within(self, anchor: int, positives, line: np.ndarray, names: np.ndarray) -> Iterator[tuple]:
        n = len(names)
        for positive in positives:
            score = int(positive["positive_score"])
            # low * score <= 100 * negative <= high * score, in whole numbers
            least, most = -(-self.low * score // 100), self.high * score // 100
            end = int(np.searchsorted(line, (most + 1) * n)) if line.dtype == object or abs(most) < 2**62 // n else (n if most > 0 else 0)
            for key in line[max(0, end - self.k) : end][::-1]:
                if key // n < least:
                    break
                yield anchor, positive["positive_id"], score, int(names[n - 1 - int(key % n)]), held(key // n)


def hard_negatives(
    rows: DataFrame, scratch: Scratch, asks, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `rows` has vec_id, label and vector; `asks` is the condition that makes a row an anchor. Scores
    are inner products of floor(scale * x), higher first, ties by smaller vec_id. Of the first
    `positives` other rows of an anchor's label each gets the first `negatives` rows of other labels
    with low * positive <= 100 * negative <= high * positive.

    Rows with a null vec_id, label, vector or component or a non-finite component take no part.
    Vectors of different lengths count as filled up with zeros, empty ones score 0. Rows with an
    anchor's own vec_id are never its positives; of several anchors with one id the one with the
    smallest label, then vector, asks. Negatives are kept as often as they occur; positives that agree
    in vec_id and score ask once. An anchor without a
    positive, and a positive without a row in its window, has no row. Other columns are ignored. A
    score outside 64 bits is exact in ranking, up to 38 digits, and null in the result.

    Tiles are dealt by a hash of the row, never by label, so no label is hot; a tile holds about
    `ANCHORS` or `CANDIDATES` rows, and each anchor takes a bounded number of rows out of it.
    """
    given = scratch.put(rows.select("vec_id", "label", "vector").where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector"))), "rows")
    asking = given.where(asks).groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("a")).select("vec_id", "a.*")
    anchors = scratch.put(asking, "anchors")
    count, width = given.agg(F.count("*"), F.max(F.size("vector"))).first()
    a, c = tiles_of(anchors.count(), ANCHORS), tiles_of(count, CANDIDATES)
    # copies of a row differ in nothing, so they are dealt by a number of their own
    dealt = tiled(given.withColumn("_n", F.monotonically_increasing_id()), c, "c", "vec_id", "_n").drop("_n")
    right = copied(dealt, a, "a").groupBy("a", "c")

    def passes(left: DataFrame, kernel) -> DataFrame:
        left = copied(tiled(left, a, "a", "vec_id"), c, "c")
        return left.groupBy("a", "c").cogroup(right).applyInPandas(lambda x, y: kernel(x, y), kernel.schema)

    ranked = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = passes(anchors, Positives(positives, scale, width or 0)).withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= positives)
    held = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_set(F.struct("positive_id", "positive_score")).alias("positives"))
    second = passes(scratch.put(anchors.join(held, "vec_id"), "asking"), Windows(negatives, low, high, scale, width or 0))
    merged = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    score = {c: F.expr(f"try_cast({c} as long)") for c in ("positive_score", "negative_score")}
    return (
        second.withColumn("rank", F.row_number().over(merged)).where(F.col("rank") <= negatives)
        .withColumns(score).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    )
