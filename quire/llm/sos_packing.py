"""Packing documents into sequences by the sum of squares.

Documents become token pieces of at most a sequence's capacity. A piece goes to the open sequence,
or to a new one, after which the sum over all gaps g of (open sequences with gap g) squared is
smallest; this keeps many different gaps open, so that later pieces find one that they close.

Full pieces are sequences of their own. The others are dealt into shards of bounded size by a
hash, each packed on its own, large pieces first. The pieces of the sequences that stay open are
packed again among themselves while that saves sequences: first within the shard, then with those
of other shards, dealt anew. Shards stay bounded: few are open after a round, and need fewer shards.
"""

from __future__ import annotations

import zlib
from array import array
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.bpe import DEFAULT_TOKENIZER, transducer
from quire.llm.common import Scratch

CAPACITY = 1024
END = 2
SHARD_PIECES = 1 << 16
# how often what stays open is packed again within a shard
ROUNDS = 4
# packing what other shards left open goes on while a round closes this share of the open sequences
WORTHWHILE, MOST_ROUNDS = 1 / 16, 100


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: all full but the first."""
    first = n if n <= capacity else (n % capacity or capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def pieces_column(text: Column, path: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, end: int = END) -> Column:
    """The pieces of each text's tokens and the end token: piece, start, length, ids_crc32."""

    @F.arrow_udf("array<struct<piece:int,start:long,length:long,ids_crc32:long>>")
    def run(texts: pa.Array) -> pa.Array:
        closing, offsets = end.to_bytes(4, "little"), [0]
        rows: list[tuple[int, int, int, int]] = []
        for _, ids, starts in transducer(path).encode_all(texts):
            raw = memoryview(ids.tobytes())
            for begin, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
                parts = cut(stop - begin + 1, capacity)
                # the last piece ends in the end token
                crcs = [zlib.crc32(raw[4 * (begin + at) : min(4 * (begin + at + n), 4 * stop)]) for at, n in parts]
                crcs[-1] = zlib.crc32(closing, crcs[-1])
                rows += [(i, at, n, crc) for i, ((at, n), crc) in enumerate(zip(parts, crcs))]
                offsets.append(len(rows))
        kinds = {"piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
        fields = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, names=list(kinds)))

    return run(text)


class Bins:
    """Open sequences by how full they are."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.open = np.zeros(capacity + 1, np.int64)
        self.at: list[array] = [array("q") for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset) for a piece, by the smallest sum of squares; of equal choices the
        fullest sequence."""
        if size >= self.capacity:
            self.made += 1
            return self.made - 1, 0
        before, after = self.open[: self.capacity - size + 1], self.open[size:]
        # moving one sequence from level h to h + size changes the sum by this
        change = np.where(before > 0, 2 * (after - before) + 2, 1 << 60)
        change[-1] = 1 - 2 * before[-1] if before[-1] else 1 << 60
        change[0] = 2 * after[0] + 1
        level = len(change) - 1 - int(change[::-1].argmin())
        if level:
            chosen = self.at[level].pop()
            self.open[level] -= 1
        else:
            chosen, self.made = self.made, self.made + 1
        if level + size < self.capacity:
            self.at[level + size].append(chosen)
            self.open[level + size] += 1
        return chosen, level


def place_all(sizes: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset, fill of the sequence) of every piece; sequences are numbered from 0."""
    seq, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    todo, base, open_before = np.argsort(-sizes, kind="stable"), 0, len(sizes) + 1
    for _ in range(rounds):
        bins = Bins(capacity)
        placed = np.array([bins.place(size) for size in sizes[todo].tolist()], np.int64).reshape(-1, 2)
        if bins.made >= open_before:
            break
        total = np.zeros(bins.made, np.int64)
        np.add.at(total, placed[:, 0], sizes[todo])
        seq[todo], offset[todo], fill[todo] = placed[:, 0] + base, placed[:, 1], total[placed[:, 0]]
        base, open_before = base + bins.made, int((total < capacity).sum())
        todo = todo[fill[todo] < capacity]
    return seq, offset, fill


def _pack_shards(items: DataFrame, shards: int, capacity: int, number: int) -> DataFrame:
    """`items` (id long, size int) plus seq, offset, fill. `number`, at most 127, keeps the sequences
    of the calls apart and deals pieces anew."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        seq, offset, fill = place_all(group["size"].to_numpy().astype(np.int64), capacity)
        return pd.DataFrame({"id": group["id"], "size": group["size"], "seq": seq + (number << 56 | int(group["shard"].iat[0]) << 28), "offset": offset, "fill": fill})

    dealt = items.withColumn("shard", F.pmod(F.xxhash64("id", F.lit(number)), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, "id long, size int, seq long, offset long, fill long")


def pack(items: DataFrame, scratch: Scratch, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Place `items` (id long, size int; ids distinct): rows (id, seq, offset).

    A shard holds about `shard_pieces` pieces in every round. Rounds go on while more than one shard is
    open and a round closes at least a share of `WORTHWHILE` of the open sequences, so there are few."""

    def tally(frame: DataFrame) -> tuple[int, int]:
        still = frame.where(F.col("fill") < capacity)
        return still.agg(F.count("*"), F.count_distinct("seq")).first()

    shards, done = max(1, -(-items.count() // shard_pieces)), []
    placed = scratch.put(_pack_shards(items, shards, capacity, 0), "packed0")
    count, sequences = tally(placed)
    for number in range(1, MOST_ROUNDS + 1):
        if shards == 1:
            break
        shards = max(1, -(-count // shard_pieces))
        still = placed.where(F.col("fill") < capacity)
        again = scratch.put(_pack_shards(still.select("id", "size"), shards, capacity, number), f"packed{number}")
        count, left = tally(again)
        if again.select("seq").distinct().count() >= sequences:
            break
        done.append(placed.where(F.col("fill") == capacity))
        placed = again
        if left > (1 - WORTHWHILE) * sequences:
            break
        sequences = left
    return reduce(DataFrame.unionByName, done, placed).select("id", "seq", "offset")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = DEFAULT_TOKENIZER, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row a piece: all columns of `docs` but `text`, plus piece, start, length, ids_crc32,
    sequence_id and offset. A null text is empty and gives a piece with the end token alone; all
    rows are packed, repeated ones too; columns of the added names give way."""
    added = ["piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    rest = [c for c in docs.columns if c not in (*added, text)]
    scratch = Scratch(docs.sparkSession, "sos-packing")
    pieces = docs.select(*rest, F.explode(pieces_column(F.col(text), path, capacity)).alias("_p")).select(*rest, "_p.*", F.monotonically_increasing_id().alias("_id"))
    pieces = scratch.put(pieces, "pieces")
    full, part = pieces.where(F.col("length") == capacity), pieces.where(F.col("length") < capacity)
    where = pack(part.select(F.col("_id").alias("id"), F.col("length").cast("int").alias("size")), scratch, capacity, shard_pieces)
    placed = part.join(where, part["_id"] == where["id"]).withColumn("sequence_id", F.col("seq"))
    alone = full.withColumns({"sequence_id": -1 - F.col("_id"), "offset": F.lit(0).cast("long")})
    return reduce(DataFrame.unionByName, [frame.select(*rest, "piece", "start", "length", "ids_crc32", "sequence_id", "offset") for frame in (placed, alone)])
