"""Exact deduplication by deterministic block naming.

A text's UTF-8 bytes are cut into blocks of a fixed size. Equal blocks get the same integer name,
then adjacent names are named as pairs, level by level, until each document has one name. Two
documents have the same name at the same level exactly when their bytes are equal: names come
from sorting the blocks and pairs themselves, never from a hash, so there are no collisions.

The name of a block is the smallest occurrence number among its copies. Blocks that make up a
large share of all rows are dealt out over several tasks; what these tasks agree on separately
is merged afterwards. Every level halves the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SALTS, Scratch, salted_lookup

BLOCK_BYTES = 4096
# a block is dealt out over several tasks if it makes up more than 1 in HOT_SHARE of all blocks;
# at most HOT_SHARE blocks can, so the list of their hashes is bounded
HOT_SHARE = 1000


def _blocks(text: Column, size: int) -> Column:
    """The UTF-8 bytes in pieces of `size`; one empty piece for an empty text."""
    raw = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(raw) / F.lit(size)), F.lit(1)) - 1
    return F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.substring(raw, (i * size + 1).cast("int"), F.lit(size)))


def identities(docs: DataFrame, text: str, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of `docs` without `text`, plus their identity `_level`, `_name`: equal for equal texts
    and for no others. A null text counts as empty; repeated rows stay."""
    rest = F.struct(*[c for c in docs.columns if c != text]).alias("_rest")
    full = docs.select(rest, F.coalesce(F.col(text), F.lit("")).alias("_text"), F.monotonically_increasing_id().alias("_row"))
    cut = full.select("_rest", "_row", F.posexplode(_blocks(F.col("_text"), block_bytes)).alias("_pos", "_block"), F.octet_length("_text").alias("_bytes")).select(
        # the other columns ride on the first block only
        F.when(F.col("_pos") == 0, F.col("_rest")).alias("_rest"), "_row", F.col("_pos").cast("long").alias("_pos"), "_block",
        F.greatest(F.ceil(F.col("_bytes") / F.lit(block_bytes)), F.lit(1)).alias("_n"),
        F.xxhash64("_block").alias("_hash"), F.monotonically_increasing_id().alias("_occ"),
    )
    shares = cut.groupBy("_hash").count()
    total = shares.agg(F.sum("count"))
    hot = shares.where(F.col("count") > total.scalar() / HOT_SHARE).select("_hash", F.lit(True).alias("_hot"))
    dealt = cut.join(F.broadcast(hot), "_hash", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.col("_row"), F.lit(SALTS))).otherwise(-1))
    # the first occurrence of the same bytes; the hash only makes the sort cheap
    copies = Window.partitionBy("_hash", "_salt", "_block").orderBy("_occ")
    named = dealt.withColumn("_first", F.first("_occ").over(copies))
    # of a hot block only the first of each salt keeps its bytes, for the merge
    named = scratch.put(
        named.select("_rest", "_row", "_pos", "_n", "_occ", "_first", F.when((F.col("_salt") >= 0) & (F.col("_first") == F.col("_occ")), F.col("_block")).alias("_block")),
        "blocks",
    )
    merged = named.where("_block is not null").groupBy("_block").agg(F.min("_first").alias("_name"), F.collect_list("_first").alias("_firsts"))
    merged = merged.select("_name", F.explode("_firsts").alias("_first"))
    level = (
        # at most HOT_SHARE * SALTS rows are looked up
        named.join(F.broadcast(merged), "_first", "left")
        .select("_rest", "_row", "_pos", "_n", "_occ", F.coalesce("_name", "_first").alias("_name"))
    )
    longest, height, done = named.agg(F.max("_n")).first()[0] or 1, 0, []
    while longest > 1:
        done.append(_finished(level, height))
        height, longest = height + 1, -(-longest // 2)
        level = _name_pairs(level.where("_n > 1"), scratch, height)
    return reduce(DataFrame.unionByName, done, _finished(level, height))


def _finished(level: DataFrame, height: int) -> DataFrame:
    return level.where("_n = 1").select("_rest.*", F.lit(height).alias("_level"), "_name")


def _name_pairs(level: DataFrame, scratch: Scratch, height: int) -> DataFrame:
    """The next level: neighbours become pairs (a last one alone gets -1), equal pairs one name."""
    odd = F.col("_pos") % 2 == 1
    pairs = scratch.put(
        level.groupBy("_row", F.floor(F.col("_pos") / 2).alias("_pos")).agg(
            F.first("_rest", ignorenulls=True).alias("_rest"), F.max("_n").alias("_n"), F.min("_occ").alias("_occ"),
            F.max(F.when(~odd, F.col("_name"))).alias("_left"), F.coalesce(F.max(F.when(odd, F.col("_name"))), F.lit(-1)).alias("_right"),
        ),
        f"pairs{height}",
    )
    # a pair that occurs once names itself
    repeated = pairs.groupBy("_left", "_right").agg(F.min("_occ").alias("_name"), F.count("*").alias("_count")).where("_count > 1").drop("_count")
    return salted_lookup(pairs, repeated, ["_left", "_right"], F.col("_row")).select(
        "_rest", "_row", "_pos", F.ceil(F.col("_n") / 2).alias("_n"), "_occ", F.coalesce("_name", "_occ").alias("_name")
    )


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`, all columns but `text`, plus keep_id, group_size, kept and
    text_sha256. Of equal texts the row with the largest key stays; null counts as empty.

    Rows of one text that share the largest key all stay, as nothing tells them apart; a null key
    stays only where its whole group has none. Input columns named like the added ones give way.
    """
    added = ["keep_id", "group_size", "kept", "text_sha256"]
    scratch = Scratch(docs.sparkSession, "block-naming")
    source = docs.drop(*added).withColumn("text_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    named = scratch.put(identities(source, text, scratch, block_bytes), "identities")
    groups = named.groupBy("_level", "_name").agg(F.max(key).alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1")
    # documents without a copy need no lookup
    found = salted_lookup(named, groups, ["_level", "_name"], F.col(key))
    keep = F.when(F.col("group_size").isNull(), F.col(key)).otherwise(F.col("keep_id"))
    return found.select(
        *[c for c in source.columns if c not in (text, "text_sha256")],
        keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), keep.eqNullSafe(F.col(key)).alias("kept"), "text_sha256",
    )
