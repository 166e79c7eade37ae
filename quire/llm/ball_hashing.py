"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most 2r bits exactly when some 64-bit value is within r bits of
both. So every distinct fingerprint emits all values within r bits (2081 for r = 2), values are
grouped, and fingerprints that meet on a value are linked.

The shuffle does not carry the values one by one. Rows are dealt out by the first `bits` bits of
the emitted values, so a fingerprint travels once for each way to flip up to r of these bits, and
the task that gets it emits the values with that prefix: the same values on the same keys, in a
fraction of the bytes. `bits` grows with the number of fingerprints, which keeps the values a
prefix has at about `VALUES_PER_PREFIX`; prefixes that get far more than their share are dealt out
by eight more bits.

All fingerprints that meet on one value are within 2r bits of each other, hence linking each to
the smallest of them loses no connection and needs no pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, components, salted_lookup

SHINGLE_WORDS = 4
SEED = 42
RADIUS = 2
VALUES_PER_PREFIX = 1 << 20
# a prefix with this many times the mean number of rows is dealt out by more bits
HOT_PREFIX = 64
MORE_BITS = 8
# values a task holds at once, shingles a text is hashed in
VALUES_AT_ONCE = 1 << 21
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash over word shingles: a bit is 1 if set in over half the shingles' hashes.

    ASCII letters are lower-cased, words split at ASCII white space; fewer words than `size` are
    one shingle, no words give 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    first, last = starts[:n].tolist(), ends[min(size, len(words)) - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = slice(at, at + SHINGLES_AT_ONCE)
        hashes = np.array([xxhash.xxh64_intdigest(joined[s:e], SEED) for s, e in zip(first[part], last[part])], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a long with the same bits."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return run(text)


def _masks(bits: int, flips: int) -> list[int]:
    """All values of `bits` bits with at most `flips` ones."""
    return [sum(1 << b for b in ones) for k in range(flips + 1) for ones in combinations(range(bits), k)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _meet(prints: np.ndarray, left: np.ndarray, bits: int, prefix: int, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of the fingerprints that meet on a value whose first `bits` bits are `prefix`; each
    may flip `left` of the other bits. More values than a task should hold are taken in turn."""
    free = 64 - bits
    per_left = [sum(math.comb(free, j) for j in range(k + 1)) for k in range(radius + 1)]
    if bits <= 60 - radius and sum(int((left == k).sum()) * per_left[k] for k in range(radius + 1)) > VALUES_AT_ONCE:
        links = []
        for nibble in range(16):
            used = np.bitwise_count(((prints >> np.uint64(free - 4)) & np.uint64(15)) ^ np.uint64(nibble)).astype(np.int64)
            stay = used <= left
            links += _meet(prints[stay], left[stay] - used[stay], bits + 4, prefix << 4 | nibble, radius)
        return links
    low = np.uint64((1 << free) - 1)
    values, owners = [], []
    for k in range(radius + 1):
        own = np.flatnonzero(left == k)
        masks = np.array(_masks(free, k), dtype=np.uint64)
        values.append(((prints[own] & low)[:, None] ^ masks[None, :]).ravel())
        owners.append(np.repeat(own, len(masks)))
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = np.argsort(value)
    value = value[order]
    same = np.concatenate(([False], value[1:] == value[:-1]))
    if not same.any():
        return []
    owned = prints[owner[order]]
    begins = np.flatnonzero(~same)
    smallest = np.repeat(np.minimum.reduceat(owned, begins), np.diff(np.append(begins, len(owned))))
    linked = owned != smallest
    pairs = np.unique(np.stack([smallest[linked], owned[linked]], axis=1), axis=0)
    # the meeting value proves it; checked all the same
    near = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= 2 * radius
    return [(pairs[near, 0], pairs[near, 1])]


def meetings(batches: Iterable[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links (a, b) of fingerprints dealt out to a task: `print`, `prefix`, `bits` and `left`, in order of
    bits and prefix."""

    def one_by_one(part: pd.DataFrame, key: np.ndarray) -> Iterator[pd.DataFrame]:
        if not len(part):
            return
        prints, left = part["print"].to_numpy().view(np.uint64), part["left"].to_numpy().astype(np.int64)
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        for begin, end in zip(begins, np.append(begins[1:], len(key))):
            if end - begin > 1:
                found = _meet(prints[begin:end], left[begin:end], int(part["bits"].iat[begin]), int(part["prefix"].iat[begin]), radius)
                for a, b in found:
                    yield pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        key = batch["bits"].to_numpy().astype(np.int64) << 40 | batch["prefix"].to_numpy()
        # the last prefix may go on in the next batch, the first may have begun in one before
        whole = key != key[-1]
        if held and (whole.any() or key[-1] != held_key):
            own = key == held_key
            begun = pd.concat([*held, batch[own & whole]])
            yield from one_by_one(begun, np.full(len(begun), held_key))
            batch, key, whole, held = batch[~(own & whole)], key[~(own & whole)], whole[~(own & whole)], []
        yield from one_by_one(batch[whole], key[whole])
        held.append(batch[~whole])
        held_key = key[-1]
    if held:
        rest = pd.concat(held)
        yield from one_by_one(rest, np.full(len(rest), held_key))


def links(prints: DataFrame, column: str, radius: int = RADIUS, count: int | None = None) -> DataFrame:
    """Rows (a, b) of fingerprints within 2 * radius bits, enough to connect all that are linked
    directly or over others. `prints` has distinct fingerprints, `count` of them."""
    per_print = sum(math.comb(64, k) for k in range(radius + 1))
    count = prints.count() if count is None else count
    bits = min(24, max(4, math.ceil(math.log2(max(1, count * per_print) / VALUES_PER_PREFIX + 1))))
    shift = 64 - bits
    masks = F.array(*[F.lit(_signed(m << shift)).cast("long") for m in _masks(bits, radius)])
    rows = prints.select(F.col(column).alias("print"), F.explode(masks).alias("mask")).select(
        "print", F.shiftrightunsigned(F.col("print").bitwiseXOR(F.col("mask")), shift).alias("prefix"), F.bit_count("mask").alias("used")
    )
    crowded = rows.groupBy("prefix").count()
    hot = crowded.where(F.col("count") > HOT_PREFIX * count * len(_masks(bits, radius)) / 2**bits).select("prefix", F.lit(True).alias("hot"))
    more = F.array(*[F.lit(m).cast("long") for m in _masks(MORE_BITS, radius)])
    next_bits = F.shiftrightunsigned("print", shift - MORE_BITS).bitwiseAND(F.lit((1 << MORE_BITS) - 1))
    # at most 2 ** bits / HOT_PREFIX prefixes are hot
    dealt = rows.join(F.broadcast(hot), "prefix", "left").select(
        "print", "prefix", "used", "hot", next_bits.alias("next"), F.explode(F.when(F.col("hot"), more).otherwise(F.array(F.lit(0).cast("long")))).alias("flip")
    )
    dealt = dealt.select(
        "print", F.when(F.col("hot"), F.shiftleft("prefix", MORE_BITS).bitwiseOR(F.col("next").bitwiseXOR(F.col("flip")))).otherwise(F.col("prefix")).alias("prefix"),
        F.when(F.col("hot"), bits + MORE_BITS).otherwise(bits).alias("bits"), (F.lit(radius) - F.col("used") - F.bit_count("flip")).alias("left"),
    ).where("left >= 0")

    together = dealt.repartition("bits", "prefix").sortWithinPartitions("bits", "prefix")
    return together.mapInPandas(lambda batches: meetings(batches, radius), "a long, b long")


def _components(printed: DataFrame, key: str, print_column: str, radius: int, scratch: Scratch) -> DataFrame:
    """(_print, component_id) of the fingerprints that are linked or occur more than once, from a stored
    table of rows with their fingerprints."""
    named = printed.select(F.col(key), F.col(print_column).alias("_print"))
    classes = scratch.put(named.groupBy("_print").agg(F.min(key).alias("_first"), F.count("*").alias("_count")), "classes")
    found = scratch.put(links(classes, "_print", radius, classes.count()), "links")
    roots = components(found, scratch)
    linked = classes.join(roots, classes["_print"] == roots["node"], "left").select("_print", "_first", "_count", F.coalesce("root", "_print").alias("_root"), F.col("root").isNotNull().alias("_linked"))
    linked = scratch.put(linked.where("_linked or _count > 1"), "linked")
    smallest = linked.groupBy("_root").agg(F.min("_first").alias("component_id"))
    # a component of very many fingerprints is one root: looked up with a salt
    return salted_lookup(linked, smallest, ["_root"], F.col("_print")).select("_print", "component_id", F.lit(True).alias("_known"))


def simhash_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """All columns of `docs` but `text`, plus `fingerprint` (16 hex digits) and `component_id`, the
    smallest key that links reach; null and empty texts have fingerprint zero and link to it.

    Repeated rows are kept; rows whose component has null keys only get a null component_id.
    """
    added = ["fingerprint", "component_id"]
    scratch = Scratch(docs.sparkSession, "ball-hashing")
    rest = [c for c in docs.columns if c not in (*added, text)]
    printed = scratch.put(docs.select(*rest, fingerprint_column(F.col(text)).alias("_print")), "prints")
    named = _components(printed, key, "_print", radius, scratch)
    return salted_lookup(printed, named, ["_print"], F.col(key)).select(
        *rest, F.lpad(F.lower(F.hex("_print")), 16, "0").alias("fingerprint"), F.when(F.col("_known"), F.col("component_id")).otherwise(F.col(key)).alias("component_id")
    )


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """`docs` without near-duplicates: of each component the row with the smallest key stays.

    Rows are told apart by key and fingerprint. Rows of the staying key that lie in its component stay
    together. Rows with a null key go if their component has a key, and else stay; a row that is like
    no other stays whatever its key, null, shared or its own. Any column names are allowed, no rows
    give no rows.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    own = "_print"
    while own in docs.columns:
        own += "_"
    printed = scratch.put(docs.withColumn(own, fingerprint_column(F.col(text))), "documents")
    named = _components(printed, key, own, radius, scratch).select("_print", "component_id").where("component_id is not null")
    rows = printed.select(F.col(key).alias("_key"), F.col(own).alias("_print"))
    # one row a key and fingerprint: the few that go are those whose component has a smaller key
    gone = scratch.put(salted_lookup(rows.distinct(), named, ["_print"], F.col("_key")).where("component_id is not null and not component_id <=> _key").select("_key", "_print"), "gone")
    gone = gone.hint("merge")
    return printed.join(gone, printed[key].eqNullSafe(gone["_key"]) & (printed[own] == gone["_print"]), "left_anti").drop(own)
