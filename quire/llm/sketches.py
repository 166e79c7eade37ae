"""Fixed-size summaries of all rows, looked up in a projection without a join.

Both take a column of 64-bit hashes, are one row of bounded size whatever the input, and err on one
side only: a bitmap may say yes for an absent hash, a count may be too high. They save work; what
must be exact is checked by their users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

BITS = 1 << 22
BUCKETS = 1 << 21


class Bitmap:
    """Which hashes occur: 2 ** 22 bits, half a megabyte."""

    def __init__(self, hashes: DataFrame, column: str, scratch: Scratch, name: str):
        spark, word = hashes.sparkSession, F.shiftright(F.pmod(F.col(column), F.lit(BITS)), 6)
        words = hashes.groupBy(word.alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({column}, 64) as int)))").alias("b"))
        empty = spark.range(BITS >> 6).select(F.col("id").alias("w"), F.lit(0).cast("long").alias("b"))
        full = words.unionByName(empty).groupBy("w").agg(F.expr("bit_or(b)").alias("b"))
        row = full.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
        self.table = scratch.put(row, name)

    def has(self, hashed: Column) -> Column:
        at = F.pmod(hashed, F.lit(BITS))
        word = F.get(self.table.scalar(), F.shiftright(at, 6).cast("int"))
        return F.getbit(word, F.pmod(at, F.lit(64)).cast("int")) == 1


class Frequencies:
    """How often hashes occur, on a logarithmic scale of a byte: 2 ** 21 buckets."""

    def __init__(self, hashes: DataFrame, column: str, scratch: Scratch, name: str):
        counts = hashes.groupBy(F.col(column).bitwiseAND(F.lit(BUCKETS - 1)).alias("b")).agg(F.count("*").alias("n"))
        empty = hashes.sparkSession.range(BUCKETS).select(F.col("id").alias("b"), F.lit(0).cast("long").alias("n"))
        scaled = counts.unionByName(empty).groupBy("b").agg(F.sum("n").alias("n")).select(
            F.shiftright("b", 11).alias("chunk"), "b", F.least(F.lit(127), F.floor(4 * F.log2(F.col("n") + 1))).cast("tinyint").alias("v")
        )
        chunks = scaled.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda x: x["v"]).alias("vs"))
        row = chunks.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "vs"))), lambda x: x["vs"])).alias("all"))
        self.table = scratch.put(row, name)

    def column(self) -> Column:
        """The whole summary, to be named by a projection below the one that calls `of`: higher-order
        functions take no subquery themselves. The planner folds both projections into one, so
        that no row carries it."""
        return self.table.scalar()

    @staticmethod
    def of(summary: str, hashed: Column) -> Column:
        return F.coalesce(F.get(F.col(summary), hashed.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.lit(0).cast("tinyint"))


# four times log2 of 1 + 1: the scaled count of a hash that occurs once
ONCE = 4
