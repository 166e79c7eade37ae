"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Of lines that are equal, or whose sets have a Jaccard similarity
of at least the threshold, the later ones are removed; later means larger (key, line number). The
join is exact: words are ordered by rarity, two similar lines must share one of their first few
(prefix filter), at fitting places (positional filter), with fitting sizes (length filter) and
few differing bits in a parity sketch; whoever passes is verified on the words themselves.

Text is never shuffled to find candidates. Equal lines are found by their SHA-256, then only first
occurrences go on, as short rows of hashes; words are read again for verified candidates alone.
The order of rarity and the pre-filters come from fixed-size sketches, used so that they can make a
candidate too many, never one too few. Where they fill up on large inputs, joins on (key, line) still
keep copies and removed lines from asking for partners.

Clusters of very many versions of one line would make all pairs among themselves. Lines are first
compared with the earliest and a few previous lines of salted groups that share a rare word; what that removes no longer asks for partners, though it stays a partner for others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import SALTS, Scratch
from quire.llm.sketches import ONCE, Bitmap, Frequencies

THRESHOLD = (4, 5)  # Jaccard similarity of at least 4 / 5
OTHER_SPACES = "\t\x0b\f\r"
# lines before it that a line is first compared with, in each of its groups
NEIGHBOURS = 4
# word keys: seven bits of rarity above 56 bits of hash
HASH_BITS = 56


def _cut(text: Column, spaces: str = OTHER_SPACES) -> Column:
    """Words, and empty strings, between ASCII white space; plain replacing beats a pattern."""
    for space in spaces:
        text = F.replace(text, F.lit(space), F.lit(" "))
    return F.split(text, " ")


def common_words(a: Column, b: Column) -> Column:
    """How many distinct words two lines share."""
    return F.size(F.array_remove(F.array_intersect(_cut(a), _cut(b)), ""))


def hashes_of(line: Column) -> Column:
    """The distinct words of a line as 64-bit hashes: for filters, and to count them."""
    return F.array_remove(F.array_distinct(F.transform(_cut(line), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, line, content) of every line that has a word; rows without a key take no part."""
    cut = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.posexplode_outer(F.split(text, "\n")).alias("line", "content"))
    return cut.where(F.col("content").rlike("[^ \\t\\x0B\\f\\r]"))


def _at(doc="doc", line="line") -> Column:
    return F.xxhash64(doc, line)


class _Similarity:
    """Filters and the final test for one threshold, in whole numbers."""

    def __init__(self, part: int, whole: int):
        self.part, self.whole = part, whole

    def prefix(self, n: Column) -> Column:
        """How many of n words in order a similar line must share one of."""
        return n - F.ceil(n * self.part / F.lit(self.whole)).cast("int") + 1

    def sizes(self, a: Column, b: Column) -> Column:
        return (a * self.whole >= b * self.part) & (b * self.whole >= a * self.part)

    def shared(self, common: Column, a: Column, b: Column) -> Column:
        """Whether `common` shared words are enough: J >= t is common >= t / (1 + t) * (a + b)."""
        return common * (self.part + self.whole) >= (a + b) * self.part

    def parity(self, a: Column, b: Column, n: Column, m: Column) -> Column:
        """Differing bits of the sketches are at most the differing words."""
        return F.bit_count(a.bitwiseXOR(b)) * (self.part + self.whole) <= (n + m) * (self.whole - self.part)


def lasting_lines(docs: DataFrame, key: str, text: str, scratch: Scratch, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """(doc, line) of the lines that stay: first of their equals, and not similar to an earlier
    line, of the same text or another."""
    like = _Similarity(*threshold)
    lines = _lines(docs, key, text)
    same = lines.groupBy(F.unhex(F.sha2("content", 256)).alias("sha")).agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n"), F.max(F.xxhash64("content")).alias("hash"))
    same = scratch.put(same.select("hash", "first.doc", "first.line", "n"), "same")
    # a line goes on if it is not repeated, or is the first; both tests may let more pass, which a join
    # takes out again
    repeated = Bitmap(same.where("n > 1"), "hash", scratch, "repeated")
    first = Bitmap(same.where(repeated.has(F.col("hash"))).select(_at().alias("at")), "at", scratch, "first")
    fresh = lines.where(~repeated.has(F.xxhash64("content")) | first.has(_at())).withColumn("unsure", repeated.has(F.xxhash64("content")))

    # of each line the hashes of its words, cut once: they are counted, then put in order
    hashed = scratch.put(fresh.select("doc", "line", "unsure", hashes_of(F.col("content")).alias("hashes")), "hashed")
    # the order of rarity: how many lines hold a word; without a second one, no line has it for a partner
    usual = Frequencies(hashed.select(F.explode("hashes").alias("h")), "h", scratch, "usual")
    # of each line: size, parity sketch, smallest and largest word hash, and its first words in order
    low = (1 << HASH_BITS) - 1
    parity = F.aggregate("hashes", F.lit(0).cast("long"), lambda x, h: x.bitwiseXOR(_bit(h)))
    ranked = F.sort_array(F.transform("hashes", lambda h: F.shiftleft(Frequencies.of("usual", h).cast("long"), HASH_BITS).bitwiseOR(h.bitwiseAND(F.lit(low)))))
    ordered = hashed.withColumn("usual", usual.column()).select("doc", "line", "unsure", F.size("hashes").alias("n"), parity.alias("parity"), ranked.alias("ranked"))
    # a word met once has no partner, but keeps its place in the order
    first_words = F.slice("ranked", F.lit(1), like.prefix(F.col("n")))
    passed = scratch.put(ordered.select("doc", "line", "n", "parity", first_words.alias("prefix"), "unsure"), "passed")
    scratch.drop("hashed")
    firsts = same.where(repeated.has(F.col("hash"))).select("doc", "line").hint("merge")
    sure = scratch.put(passed.where("unsure").drop("unsure").join(firsts, ["doc", "line"], "left_semi"), "firsts")
    sets = passed.where("not unsure").drop("unsure").unionByName(sure)
    scratch.release()

    # first comparison: among the lines whose first words have the same smallest or largest hash,
    # with the earliest and with some before
    shared = _once(F.transform(F.filter("prefix", lambda w: F.shiftright(w, HASH_BITS) > ONCE), lambda w: w.bitwiseAND(F.lit(low)))).alias("shared")
    signed = sets.select("doc", "line", "n", "parity", shared).where(F.size("shared") > 0)
    signed = signed.select(F.struct("doc", "line", "n", "parity").alias("own"), F.posexplode(F.array(F.array_min("shared"), F.array_max("shared"))).alias("k", "extreme"))
    group = Window.partitionBy("extreme", "k", F.pmod(_at("own.doc", "own.line"), F.lit(SALTS))).orderBy("own.doc", "own.line")
    before = [F.lag("own", i + 1).over(group).alias(f"before{i}") for i in range(NEIGHBOURS)]
    led = signed.select("own", F.first("own").over(group).alias("lead"), *before)
    met = led.select("own", F.explode(F.array("lead", *[f"before{i}" for i in range(NEIGHBOURS)])).alias("other"))
    pairs = met.where(
        (F.col("own") != F.col("other")) & like.sizes(F.col("own.n"), F.col("other.n")) & like.parity(F.col("own.parity"), F.col("other.parity"), F.col("own.n"), F.col("other.n"))
    ).select("own.doc", "own.line", "own.n", F.col("other.doc").alias("doc2"), F.col("other.line").alias("line2"), F.col("other.n").alias("n2"))
    pairs = scratch.put(pairs.distinct(), "lead-pairs")
    gone = _verified(pairs, docs, key, text, like, scratch, "lead")

    # the join proper
    asked = Bitmap(gone.select(_at().alias("at")), "at", scratch, "asked")
    # only lines that may be gone are looked up; a side of its own, as a cluster of removed lines
    # would make all pairs if the join itself had to tell them
    known = asked.has(_at())
    seeming = sets.where(known).join(gone.hint("merge").withColumn("removed", F.lit(True)), ["doc", "line"], "left")
    # both sides are the same rows, so that one shuffle serves them: a line that no longer asks has a
    # negative size, which fits no other as the later one
    marked = sets.where(~known).unionByName(seeming.withColumn("n", F.when(F.col("removed"), -F.col("n")).otherwise(F.col("n"))).drop("removed"))
    words = marked.select("doc", "line", "n", "parity", F.posexplode("prefix").alias("i", "word")).where(F.shiftright("word", HASH_BITS) > ONCE)

    a, b = words.alias("a"), words.alias("b")
    earlier = (F.col("a.doc") < F.col("b.doc")) | ((F.col("a.doc") == F.col("b.doc")) & (F.col("a.line") < F.col("b.line")))
    n = F.abs("a.n")
    reach = F.least(n - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    pairs = a.join(
        b,
        (F.col("a.word") == F.col("b.word")) & earlier & like.sizes(n, F.col("b.n")) & like.shared(reach, n, F.col("b.n"))
        & like.parity(F.col("a.parity"), F.col("b.parity"), n, F.col("b.n")),
    ).select(F.col("b.doc").alias("doc"), F.col("b.line").alias("line"), F.col("b.n").alias("n"), F.col("a.doc").alias("doc2"), F.col("a.line").alias("line2"), n.alias("n2"))
    pairs = scratch.put(pairs.distinct(), "join-pairs")
    scratch.drop("passed")
    scratch.drop("firsts")
    scratch.release()
    more = _verified(pairs, docs, key, text, like, scratch, "join")
    return same.select("doc", "line").join(gone.unionByName(more).distinct().hint("merge"), ["doc", "line"], "left_anti")


def _once(value: Column) -> Column:
    """A value that later projections share: behind a generator, planners do not copy it into each
    place that uses it. Outer, or the planner would test, and so compute, it once more."""
    return F.explode_outer(F.array(value))


def _bit(h: Column) -> Column:
    """A long with one bit set, which the low six bits of the hash choose."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, like: _Similarity, scratch: Scratch, name: str) -> DataFrame:
    """(doc, line) of the later line of each stored pair whose word sets are similar enough."""
    ends = pairs.select("doc", "line").unionByName(pairs.select(F.col("doc2").alias("doc"), F.col("line2").alias("line")))
    wanted = Bitmap(ends.select(_at().alias("at")), "at", scratch, f"{name}-ends")
    read = scratch.put(_lines(docs, key, text).where(wanted.has(_at())), f"{name}-lines").hint("merge")
    other = read.select(F.col("doc").alias("doc2"), F.col("line").alias("line2"), F.col("content").alias("content2"))
    met = pairs.join(read, ["doc", "line"]).join(other, ["doc2", "line2"])
    enough = like.shared(common_words(F.col("content"), F.col("content2")), F.col("n"), F.col("n2"))
    later = F.greatest(F.struct("doc", "line"), F.struct(F.col("doc2").alias("doc"), F.col("line2").alias("line")))
    gone = scratch.put(met.where(enough).select(later.alias("x")).select("x.doc", "x.line").distinct(), f"{name}-gone")
    # the last readers of the pairs and of the lines' texts have run
    scratch.drop(f"{name}-pairs")
    scratch.drop(f"{name}-lines")
    scratch.release()
    return gone


def line_report(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """One row a document: key, n_lines (with a word), n_kept and removed, the numbers of the
    removed lines in order, from 0. Null and empty texts have no lines; rows without a key keep
    all lines and take no part; rows with one key count as one document."""
    scratch = Scratch(docs.sparkSession, "line-join")
    stay = lasting_lines(docs, key, text, scratch, threshold)
    kept = stay.groupBy("doc").agg(F.collect_set("line").alias("kept"))
    worded = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.when(line.rlike("[^ \\t\\x0B\\f\\r]"), i)), lambda i: i.isNotNull())
    counted = docs.select(F.col(key), worded.alias("lines"))
    joined = counted.join(kept.hint("merge"), counted[key] == kept["doc"], "left")
    removed = F.when(F.col(key).isNull(), F.array().cast("array<int>")).otherwise(F.array_except("lines", F.coalesce("kept", F.array().cast("array<int>"))))
    return joined.select(key, F.size("lines").cast("long").alias("n_lines"), removed.alias("removed")).withColumn("n_kept", F.col("n_lines") - F.size("removed"))


def without_duplicate_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """`docs` with the removed lines cut out of `text`; lines without a word stay. A document that
    loses every line it had words in is dropped."""
    report = line_report(docs.select(key, text), key, text, threshold)
    cut = report.where(F.size("removed") > 0).select(F.col(key).alias("_key"), F.col("removed").alias("_removed"), (F.col("n_kept") == 0).alias("_empty")).dropDuplicates(["_key"])
    joined = docs.join(cut.hint("merge"), docs[key] == cut["_key"], "left")
    rest = F.array_join(F.filter(F.split(text, "\n"), lambda line, i: ~F.array_contains("_removed", i)), "\n")
    shorter = F.when(F.col("_removed").isNotNull(), rest).otherwise(F.col(text))
    return joined.where(~F.coalesce("_empty", F.lit(False))).select(*[shorter.alias(c) if c == text else F.col(c) for c in docs.columns])
