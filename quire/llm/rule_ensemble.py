"""Quality classifier as a sparse rule ensemble.

Shallow trees are grown on statistics of the labelled texts; every path from a root to a node
becomes a conjunctive rule. A lasso logistic regression weighs the rules and drops most of them,
and what is left is compiled to one Spark column expression over the statistics.

Labels, language, source and keys are never inputs of a score. All training runs on Spark; rules
and weights, whose number is bounded by the trees, are all that the driver holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from quire.llm.common import Scratch

# labelled rows the classifier is fitted on at most, those with the smallest hash of their key
FIT_ROWS = 50_000
FIT_PARTITIONS = 4
TREES, DEPTH, LASSO, THRESHOLD = 24, 3, 0.0005, 0.3
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STATISTICS = [
    "log_words", "word_length", "longest_word", "distinct_words", "stutters", "repeated_triples", "short_words", "upper", "symbols", "marks",
    "bars", "digits", "stops", "commas", "lines", "repeated_lines", "non_ascii",
]


def statistics(text: str | None) -> tuple[float, ...]:
    """The values of `STATISTICS` over a whole text; a null or empty text has zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return (0.0,) * len(STATISTICS)

    def count(wanted: bytes) -> int:
        return len(raw) - len(raw.translate(None, wanted))

    n, lengths = len(words), list(map(len, words))
    triples = set(zip(words, words[1:], words[2:]))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    return (
        math.log1p(n), sum(lengths) / n, float(max(lengths)), len(set(words)) / math.sqrt(n), sum(map(eq, words, words[1:])) / n,
        1 - len(triples) / (n - 2) if n > 2 else 0.0, sum(x < 4 for x in lengths) / n, count(UPPER) / max(1, count(UPPER + UPPER.lower())),
        count(b"#*$%&<>") / n, count(b"!") / n, count(b"|") / n, count(b"0123456789") / len(raw), count(b".?") / n, count(b",") / n,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), count(bytes(range(128, 256))) / len(raw),
    )


@dataclass(frozen=True)
class Rule:
    """A conjunction of statistic <= bound or statistic > bound."""

    tests: tuple[tuple[int, bool, float], ...]  # statistic, at most, bound

    def column(self) -> Column:
        met = F.lit(True)
        for index, at_most, bound in self.tests:
            value = F.col(STATISTICS[index])
            met = met & (value <= bound if at_most else value > bound)
        return met


@dataclass(frozen=True)
class Ensemble:
    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weighted:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def _paths(node, tests: tuple = ()) -> list[tuple]:
    """The conditions of every node below the root of a fitted tree."""
    found = [tests] if tests else []
    if node.numDescendants() > 0:
        split = node.split()
        index, bound = split.featureIndex(), split.threshold()
        found += _paths(node.leftChild(), (*tests, (index, True, bound)))
        found += _paths(node.rightChild(), (*tests, (index, False, bound)))
    return found


def _shortest(tests: tuple) -> tuple:
    """One bound a statistic and direction: the tightest."""
    tight: dict[tuple[int, bool], float] = {}
    for index, at_most, bound in tests:
        old = tight.get((index, at_most), bound)
        tight[index, at_most] = min(old, bound) if at_most else max(old, bound)
    return tuple(sorted((i, m, b) for (i, m), b in tight.items()))


def fit(labelled: DataFrame, scratch: Scratch, label: str = "label", key: str = "doc_id", rows: int = FIT_ROWS) -> Ensemble:
    """Fit on at most `rows` labelled rows (see `FIT_ROWS`); with one class only, or no rows, the
    score is that class's share, or a half."""
    order = [F.xxhash64(key), key, label, *STATISTICS]
    sample = scratch.put(labelled.orderBy(*order).limit(rows).repartition(FIT_PARTITIONS, key).sortWithinPartitions(*order).select(F.col(label).cast("double").alias("label"), *STATISTICS), "sample")
    classes = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(classes) < 2:
        share = next((c for c in classes), 0.5)
        return Ensemble(math.log((share + 1e-3) / (1 - share + 1e-3)), ())
    vectors = VectorAssembler(inputCols=STATISTICS, outputCol="features").transform(sample).select("label", "features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, featureSubsetStrategy="onethird", seed=7, minInstancesPerNode=5).fit(vectors)
    paths = {_shortest(p) for tree in forest._java_obj.trees() for p in _paths(tree.rootNode())}
    rules = [Rule(p) for p in sorted(paths)]
    met = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="features").transform(
        sample.select("label", *[r.column().cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    )
    ready = scratch.put(met.select("label", "features"), "rules")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, standardization=False).fit(ready)
    weighted = [(rule, float(w)) for rule, w in zip(rules, lasso.coefficients) if w]
    return Ensemble(float(lasso.intercept), tuple(weighted))


def held_out(key: Column) -> Column:
    """The fifth of the documents that no label is learnt from."""
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


@F.pandas_udf(StructType([StructField(n, DoubleType()) for n in STATISTICS]))
def _measure(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([statistics(t) for t in texts], columns=STATISTICS, dtype="float64")


def _measured(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return docs.select(*keep, _measure(F.col(text)).alias("_m")).select(*keep, "_m.*")


def _learn(measured: DataFrame, labels: DataFrame, scratch: Scratch, key: str, label: str, rows: int) -> Ensemble:
    """Learn from the statistics of labelled rows outside the held-out fifth."""
    known = labels.where(F.col(label).isin(0, 1)).select(F.col(key), F.col(label).alias("label")).distinct()
    learnt = measured.where(~held_out(F.col(key))).select(key, *STATISTICS).join(known, key)
    return fit(learnt, scratch, "label", key, rows)


def quality_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """All columns of `docs` but `text`, plus `held_out`, `score` (0 to 1) and `predicted` (1 from
    `threshold` on). Labels other than 0 and 1 are passed over. Columns of the added names give
    way; null texts score like empty ones; a null key counts as held out. All rows stay, repeated
    ones too."""
    added = ["held_out", "score", "predicted", *STATISTICS]
    rest = [c for c in docs.columns if c not in (*added, text)]
    scratch = Scratch(docs.sparkSession, "rule-ensemble")
    measured = scratch.put(_measured(docs, text, rest), "statistics")
    scored = measured.withColumn("score", _learn(measured, labels, scratch, key, label, rows).score())
    out = F.coalesce(held_out(F.col(key)), F.lit(True))
    return scored.select(*rest, out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_filter(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = THRESHOLD, rows: int = FIT_ROWS) -> DataFrame:
    """`docs` without the rows that score below `threshold`. Texts are measured twice, to learn and
    to judge, and never shuffled."""
    scratch = Scratch(docs.sparkSession, "rule-ensemble")
    model = _learn(_measured(docs, text, [key]), labels, scratch, key, label, rows)
    judged = docs.select(F.struct(*docs.columns).alias("_row"), _measure(F.col(text)).alias("_m")).select("_row", "_m.*")
    return judged.where(model.score() >= threshold).select("_row.*")
