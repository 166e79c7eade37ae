"""Helpers that several of the operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import drop_folder, scratch_folder

# how many ways a lookup by a possibly hot key is split
SALTS = 16


class Scratch:
    """Tables that one operator writes to the shared folder and reads again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch_folder(spark, name)

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, name: str) -> None:
        drop_folder(self.spark, f"{self.folder}/{name}")

    def release(self) -> None:
        """Let go of the shuffles behind tables that are stored by now. Executors delete them once the
        driver has collected its garbage, which left alone may be long after the next large shuffle."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def salted_lookup(rows: DataFrame, found: DataFrame, keys: list[str], spread: Column, salts: int = SALTS) -> DataFrame:
    """Left join of `rows` with `found`, which has one row a key. A hot key's rows go to `salts`
    tasks, by `spread`; `found` is copied as many times, so keep only keys that need it there."""
    # copying hides the size from the planner, which must not broadcast it
    copies = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], "left").drop("_salt")


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph: rows (node, root) with root the smallest node
    reachable, for every node that has an edge.

    Alternates large-star and small-star steps, each a shuffle of the edges; the number of edges
    never grows. A node with very many neighbours is split over tasks: its minimum is aggregated
    first and then looked up with a salt, so that no task gathers its neighbours. Every round is
    written to the shared folder, which cuts the lineage.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    current, step = scratch.put(links, "links0"), 0
    while True:
        # large star: every larger neighbour of a node links to the smallest of its neighbourhood
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = (
            salted_lookup(both.where("v > u"), low.select("u", "m"), ["u"], F.col("v"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        step += 1
        star = scratch.put(large, f"links{step}")
        # small star: a node's smaller neighbours and itself link to the smallest of them
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            salted_lookup(star, least, ["u"], F.col("v"))
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        step += 1
        after = scratch.put(small, f"links{step}")
        changed = after.join(current, ["u", "v"], "left_anti").limit(1).count() or current.join(after, ["u", "v"], "left_anti").limit(1).count()
        scratch.drop(f"links{step - 1}")
        scratch.drop(f"links{step - 2}")
        current = after
        if not changed:
            # stable: every edge goes from a node to its root
            roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


