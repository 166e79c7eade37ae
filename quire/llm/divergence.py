"""How the sources of a language differ in the terms they use: an audit in exact integers.

Counting terms is the heavy part and runs on the bytes of whole Arrow batches. Terms of at most
eight bytes become one 64-bit word and those of at most sixteen two; words are sorted by radix, 16
bits a pass, and equal neighbours counted as runs. Longer terms are sorted as bytes, in a bucket for
each length. What a batch counts is summed by Spark, so no text is shuffled.

A source's share of a term is p = 1 + floor(scale * (count + 1) / (N + V)), with N its kept terms and
V the language's. Two sources differ by floor((p - q) ** 2 / q) summed over all kept terms. Most terms
are absent from most sources, so only counts that are there are looked at: what two sources hold
apart follows from how many terms each has with a count, and terms that both hold correct it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch

# bytes of text counted at a time (a longer text on its own)
SLICE = 1 << 24
# sources that meet in one task, and rows of counts for one of its groups
SOURCES, ROWS = 256, 1 << 17

# ASCII letters and whatever is not ASCII
IN_TERM = np.zeros(256, dtype=bool)
IN_TERM[128:] = IN_TERM[ord("A") : ord("Z") + 1] = IN_TERM[ord("a") : ord("z") + 1] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def term_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and end in the bytes of texts laid end to end."""
    inside = IN_TERM[data]
    before, after = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    after[edges[edges > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def packed(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
    """Terms of at most 16 bytes as one or two words, first bytes highest, padded with zeros, which
    no term holds. `data` must run 16 bytes on behind the last term."""
    at = np.ndarray(len(data) - 7, dtype=">u8", buffer=data, strides=(1,))
    words = []
    for skipped in range(0, 8 if lengths.max(initial=0) <= 8 else 16, 8):
        held = np.clip(lengths - skipped, 0, 8).astype(np.uint64)
        word = at[starts + skipped].astype(np.uint64)
        # a shift by 64 bits is undefined, so words without a byte are set apart
        word &= np.where(held > 0, ~np.uint64(0) << (np.uint64(64) - np.uint64(8) * np.maximum(held, 1)), np.uint64(0))
        words.append(word)
    return words


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """A stable order by all words, the first one leading: lowest 16 bits first, a counting sort each."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in (0, 16, 32, 48):
            digit = (word >> np.uint64(shift)).astype(np.uint16)
            if digit.min() != digit.max():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _changes(values: np.ndarray) -> np.ndarray:
    new = np.ones(len(values), dtype=bool)
    new[1:] = values[1:] != values[:-1]
    return new


def counted_runs(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(group, start, length, occurrences, texts) of every term in every group of a slice of texts,
    which are in order of their group. `data` is lower-cased and padded by 16 bytes."""
    starts, ends = term_bounds(data[: offsets[-1]], offsets)
    lengths = ends - starts
    texts = np.searchsorted(offsets, starts, side="right") - 1
    short = [np.flatnonzero((lengths > low) & (lengths <= high)) for low, high in ((0, 4), (4, 8), (8, 16))]
    long = np.flatnonzero(lengths > 16)
    sized = long[np.argsort(lengths[long], kind="stable")]
    for rows in [*short, *np.split(sized, np.flatnonzero(_changes(lengths[sized]))[1:])]:
        if not len(rows):
            continue
        if (size := int(lengths[rows].max())) <= 16:
            words = packed(data, starts[rows], lengths[rows])
            order = radix_order(words)
            new = np.logical_or.reduce([_changes(w[order]) for w in words])
        else:
            raw = np.ndarray(len(data) - size + 1, dtype=f"S{size}", buffer=data, strides=(1,))[starts[rows]]
            order = np.argsort(raw, kind="stable")
            new = _changes(raw[order])
        # a stable order leaves the texts of a term in theirs, so a group is one run
        rows, seen = rows[order], texts[rows[order]]
        other = new | _changes(seen)
        new |= _changes(groups[seen])
        first = np.flatnonzero(new)
        yield groups[seen[first]], starts[rows[first]], lengths[rows[first]], np.diff(np.append(first, len(rows))), np.add.reduceat(other.astype(np.int64), first)


def batch_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, source, term, n, docs), a row for each term of a slice and group."""
    for batch in batches:
        langs, lang_names = pd.factorize(batch.column(0).to_pandas())
        sources, source_names = pd.factorize(batch.column(1).to_pandas())
        groups = langs * max(1, len(source_names)) + sources
        order = np.argsort(groups, kind="stable")
        texts = batch.column(2).cast(pa.large_string()).take(pa.array(order))
        bounds, groups = np.frombuffer(texts.buffers()[1], dtype=np.int64)[: len(texts) + 1], groups[order]
        raw = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SLICE, side="right")) - 1)
            data = np.zeros(bounds[end] - bounds[at] + 16, dtype=np.uint8)
            data[:-16] = LOWER[raw[bounds[at] : bounds[end]]]
            whole = data.tobytes()
            for group, start, length, n, docs in counted_runs(data, bounds[at : end + 1] - bounds[at], groups[at:end]):
                terms = pa.array([whole[s : s + size] for s, size in zip(start.tolist(), length.tolist())], pa.binary()).cast(pa.string())
                names = [pa.array(lang_names[group // len(source_names)], pa.string()), pa.array(source_names[group % len(source_names)], pa.string())]
                yield pa.record_batch([*names, terms, pa.array(n.astype(np.int64)), pa.array(docs)], names=["lang", "source", "term", "n", "docs"])
            at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): how often and in how many texts a term occurs in a group."""
    given = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")])
    found = given.mapInArrow(batch_counts, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, scale: int) -> Column:
    """1 + floor(scale * (n + 1) / total), in decimals that hold any count."""
    return F.lit(1) + F.call_function("div", F.lit(scale).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)"), total.cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _shared_terms(frame: pd.DataFrame) -> pd.DataFrame:
    """For each ordered pair of sources, what the terms that both hold add to what `source_divergence`
    makes of either alone. Rows meet their neighbours at distance 1, 2, ... in order of the term."""

    def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) * (p - q) // q

    frame = frame.sort_values(["term", "source"], ignore_index=True)
    codes, names = pd.factorize(frame["source"])
    terms = pd.factorize(frame["term"])[0]
    p, p0, home = frame["p"].to_numpy(), frame["p0"].to_numpy(), frame["home"].to_numpy()
    low, high = frame["low"].iloc[0], frame["high"].iloc[0]
    total, seen = np.zeros(len(names) ** 2, dtype=np.int64), np.zeros(len(names) ** 2, dtype=bool)
    for distance in range(1, len(frame)):
        i = np.flatnonzero(terms[distance:] == terms[:-distance])
        if not len(i):
            break
        # two blocks of sources meet here: pairs within one of them are counted where it meets itself
        i = i[(home[i] == low) & (home[i + distance] == high) | (home[i] == high) & (home[i + distance] == low)]
        for a, b in ((i, i + distance), (i + distance, i)):
            pair = codes[a] * len(names) + codes[b]
            np.add.at(total, pair, apart(p[a], p[b]) - apart(p[a], p0[b]) - apart(p0[a], p[b]) + apart(p0[a], p0[b]))
            seen[pair] = True
    at = np.flatnonzero(seen)
    return pd.DataFrame({"lang": frame["lang"].iloc[0], "source": names[at // len(names)], "item": names[at % len(names)], "value": total[at]})


def source_divergence(docs: DataFrame, scratch: Scratch, min_docs: int = 3, scale: int = 1_000_000_000, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank). Part `pair`: every other source of the language by how
    far it is off; part `term`: the `top` terms that a source uses more than its language does.

    A term is a run of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps those
    in at least `min_docs` of its texts. Nulls in lang, source and text count as '', repeated rows as
    rows of their own; groups without terms are there with a value for each other source; no rows
    give no rows; other columns of `docs` are ignored. Ties go by the item's bytes.

    A term has at most one row a source, the sources of a language meet by blocks of at most about
    `SOURCES`, and terms by buckets of about `ROWS` rows: no task holds more, however common a term.
    """
    rows = scratch.put(term_counts(docs), "counts")
    term = Window.partitionBy("lang", "term")
    kept = scratch.put(
        rows.withColumns({"in_docs": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": F.min("source").over(term) == F.col("source")})
        .where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "lang_n", "first"),
        "kept",
    )
    of_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("v"))
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    found = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    groups = found.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0, ["total", "held", "lang_total", "v"])
    blocks = found.groupBy("lang").agg(F.ceil(F.count("*") / SOURCES).alias("blocks"))
    groups = scratch.put(
        groups.join(blocks, "lang")
        .withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("total") + F.col("v"), scale)))
        .withColumn("home", F.pmod(F.xxhash64("source"), F.col("blocks"))),
        "groups",
    )
    shares = scratch.put(
        kept.join(groups, ["lang", "source"]).select(
            "lang", "source", "term", "p0", "home", "blocks",
            _share(F.col("n"), F.col("total") + F.col("v"), scale).alias("p"),
            _share(F.col("lang_n"), F.col("lang_total") + F.col("v"), scale).alias("q"),
        ),
        "shares",
    )
    # terms
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = (
        shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
        .withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    )
    # pairs: both without the term, then the terms of either as if the other lacked them, then those of both
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("held").alias("other_held"))
    # a row for each pair of sources, as asked
    pairs = groups.join(other, "lang").where("source <> item")
    neither = pairs.select("lang", "source", "item", F.when(F.col("v") > 0, (F.col("v") - F.col("held") - F.col("other_held")) * _apart(F.col("p0"), F.col("q0"))).otherwise(0).alias("value"))
    levels = scratch.put(shares.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"), F.first("p0").alias("p0")), "levels")
    here = levels.join(other.drop("other_held"), "lang").where("source <> item")
    own = here.select("lang", "source", "item", (F.col("terms") * _apart(F.col("p"), F.col("q0"))).alias("value"))
    others = here.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), (F.col("terms") * _apart(F.col("q0"), F.col("p"))).alias("value"))
    buckets = max(1, -(-shares.count() // ROWS))
    met = shares.select(
        "lang", "source", "term", "p", "p0", "home", F.pmod(F.xxhash64("term"), F.lit(buckets)).alias("bucket"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("away"),
    ).select("*", F.least("home", "away").alias("low"), F.greatest("home", "away").alias("high"))
    both = met.groupBy("lang", "low", "high", "bucket").applyInPandas(_shared_terms, "lang string, source string, item string, value long")
    parts = neither.unionByName(own).unionByName(others).unionByName(both)
    value = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sources = value.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(ranked))
    return sources.unionByName(terms)
