"""Documents over one document in between, found in tasks that hold the mentions of their KB.

Paths from a document to the far ones are many more than mentions: as rows they would be shuffled some hundred for
each mention. A KB's mentions are few bytes, so they are packed and sent whole to a few tasks, each of which answers
for its share of the documents and keeps nothing but counts of some of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import stored

# mentions that travel in a row
PACK_EDGES = 16_384
# paths and far documents in memory at once, about
PATHS, CANDIDATES = 1 << 20, 1 << 22
# an entity of more documents has its links worked out once, and so many links are kept
HUB_DOCUMENTS, HUB_LINKS = 256, 1 << 24


def two_hops_in_tasks(edges: DataFrame, asked: Column, k: int) -> DataFrame:
    """(kb_id, d1, d2, n, rank) from distinct `edges` (kb_id, document_id, entity_id); only documents with
    `asked` rows are answered for."""
    tasks = 2 * edges.sparkSession.sparkContext.defaultParallelism
    counts = edges.groupBy("kb_id").agg(F.count("*").alias("n"))
    total = F.lit(max(1, edges.count()))
    shares = stored(counts.select("kb_id", F.ceil(F.col("n") / PACK_EDGES).alias("packs"), F.ceil(F.col("n") * tasks / total).cast("int").alias("shares")), "shares")
    placed = edges.withColumn("asked", asked).join(shares, "kb_id").withColumn("pack", F.pmod(F.xxhash64("document_id"), F.col("packs")))
    packs = placed.groupBy("kb_id", "shares", "pack").agg(F.collect_list(F.struct("document_id", "entity_id", "asked")).alias("e"))
    packs = stored(packs.select("kb_id", "shares", "pack", F.col("e.document_id").alias("docs"), F.col("e.entity_id").alias("ents"), F.col("e.asked").alias("asked")), "packs")
    sent = packs.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    dealt = sent.repartitionByRange(2 * tasks, "kb_id", "share").sortWithinPartitions("kb_id", "share")
    kb, document = (edges.schema[c].dataType.simpleString() for c in ("kb_id", "document_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches):
            yield from _Kb(rows).answers(*key, k)

    return dealt.select("kb_id", "shares", "share", "docs", "ents", "asked").mapInArrow(run, f"kb_id {kb}, d1 {document}, d2 {document}, n bigint, rank int")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """The packs of one KB and share after another."""
    key, held = None, []
    for batch in batches:
        keys = list(zip(batch["kb_id"], batch["share"].to_pylist(), batch["shares"].to_pylist()))
        first = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[first]:
                continue
            if held and keys[first] != key:
                yield key, held
                held = []
            key = keys[first]
            held.append(batch.slice(first, i - first).select(["docs", "ents", "asked"]))
            first = i
    if held:
        yield key, held


def _codes(lists: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
    """Places of values among the distinct ones in order, and these."""
    coded = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    place = np.empty(len(order), "int32")
    place[order.to_numpy()] = np.arange(len(order), dtype="int32")
    return place[coded.indices.to_numpy()], coded.dictionary.take(order)


def _spread(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of a table of lists that begin at `starts`: which of `rows` each value belongs to, and its place."""
    first = starts[rows]
    lengths = starts[rows + 1] - first
    owner = np.repeat(np.arange(len(rows)), lengths)
    return owner, np.arange(len(owner)) + np.repeat(first - (np.cumsum(lengths) - lengths), lengths)


class _Kb:
    """The mentions of a KB by document and by entity."""

    def __init__(self, packs: list[pa.RecordBatch]):
        doc, self.names = _codes([p["docs"] for p in packs])
        ent, names = _codes([p["ents"] for p in packs])
        asked = pa.concat_arrays([p["asked"].flatten() for p in packs]).to_numpy(zero_copy_only=False)
        packs.clear()
        self.docs, self.ents = len(self.names), len(names)
        self.asked = np.zeros(self.docs, bool)
        self.asked[doc[asked]] = True
        order = np.lexsort((ent, doc))
        self.ents_of, self.doc_at = ent[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=self.docs))])
        order = np.lexsort((doc, ent))
        self.docs_of, self.ent_at = doc[order], np.concatenate([[0], np.cumsum(np.bincount(ent, minlength=self.ents))])
        self.hubs: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.hub_links = 0
        # links of an entity, and of a document
        degree = np.diff(self.doc_at)
        links = np.concatenate([[0], np.cumsum(degree[self.docs_of])])
        self.hub = np.diff(self.ent_at) > HUB_DOCUMENTS
        ways = links[self.ent_at[1:]] - links[self.ent_at[:-1]]
        ways = np.concatenate([[0], np.cumsum(ways[self.ents_of])])
        self.ways = ways[self.doc_at[1:]] - ways[self.doc_at[:-1]]

    def answers(self, kb: pa.Scalar, share: int, shares: int, k: int) -> Iterator[pa.RecordBatch]:
        own = np.arange(share, self.docs, shares)
        own = own[self.asked[own]]
        for part in _parts(own, self.ways[own], PATHS):
            near, far, only = self._reached(part)
            sizes = self.ent_at[far + 1] - self.ent_at[far]
            starts = np.searchsorted(near, np.arange(len(part) + 1))
            load = np.concatenate([[0], np.cumsum(sizes)])
            for some in _parts(np.arange(len(part)), load[starts[1:]] - load[starts[:-1]], CANDIDATES):
                rows = slice(starts[some[0]], starts[some[-1] + 1])
                d1, d2, n, rank = self._best(part, near[rows], far[rows], only[rows], k)
                if len(d1):
                    columns = [pa.repeat(kb, len(d1)), self.names.take(pa.array(d1)), self.names.take(pa.array(d2)), pa.array(n), pa.array(rank)]
                    yield from pa.table(columns, names=["kb_id", "d1", "d2", "n", "rank"]).to_batches(50_000)

    def _links(self, entities: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `entities`, document in between, other entity)."""
        at, place = _spread(self.ent_at, entities)
        between = self.docs_of[place]
        again, place = _spread(self.doc_at, between)
        at, between, other = at[again], between[again], self.ents_of[place]
        kept = other != entities[at]
        return at[kept], between[kept], other[kept]

    def _hub(self, entity: int) -> tuple[np.ndarray, np.ndarray]:
        """The links of a frequent entity: for each other one the three smallest documents decide for any ends."""
        if entity not in self.hubs:
            _, between, other = self._links(np.array([entity]))
            order = np.lexsort((between, other))
            between, other = between[order], other[order]
            kept = np.arange(len(other)) - np.searchsorted(other, other) < 3
            if self.hub_links + int(kept.sum()) > HUB_LINKS:
                self.hubs.clear()
                self.hub_links = 0
            self.hubs[entity] = between[kept], other[kept]
            self.hub_links += int(kept.sum())
        return self.hubs[entity]

    def _reached(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `part`, entity) of the entities that a document leads to, in order, with the document in
        between if it is the only one, else -1."""
        owner, place = _spread(self.doc_at, part)
        entity = self.ents_of[place]
        plain = ~self.hub[entity]
        at, between, other = self._links(entity[plain])
        at = owner[plain][at]
        found = [(at, between, other)]
        for i in np.flatnonzero(~plain):
            b, o = self._hub(int(entity[i]))
            found.append((np.full(len(b), owner[i]), b, o))
        at, between, other = (np.concatenate(x) for x in zip(*found))
        kept = between != part[at]
        key, between = at[kept] * self.ents + other[kept], between[kept]
        order = np.argsort(key, kind="stable")
        key, between = key[order], between[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "int64")
        if not len(first):
            return first, first, first
        least, most = np.minimum.reduceat(between, first), np.maximum.reduceat(between, first)
        key = key[first]
        return key // self.ents, key % self.ents, np.where(least == most, least, -1)

    def _best(self, part: np.ndarray, near: np.ndarray, far: np.ndarray, only: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        owner, place = _spread(self.ent_at, far)
        end, at = self.docs_of[place], near[owner]
        kept = (end != part[at]) & (end != only[owner])
        key = np.sort(at[kept] * self.docs + end[kept])
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, "int64")
        n = np.diff(np.append(first, len(key)))
        key = key[first]
        # of those met once only the first k can be among the best
        at, once = key // self.docs, n == 1
        before = np.concatenate([[0], np.cumsum(once)])
        starts = np.searchsorted(at, at)
        kept = ~once | (before[:-1] - before[starts] < k)
        key, at, n = key[kept], at[kept], n[kept]
        order = np.lexsort((key, -n, at))
        key, at, n = key[order], at[order], n[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at) + 1
        kept = rank <= k
        return part[at[kept]], (key % self.docs)[kept], n[kept].astype("int64"), rank[kept].astype("int32")


def _parts(rows: np.ndarray, load: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of rows whose loads together are `most`, about."""
    if len(rows):
        at = np.cumsum(load) // most
        yield from np.split(rows, np.flatnonzero(np.diff(at)) + 1)
