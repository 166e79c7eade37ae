"""Quality rules as weak supervision.

Each rule votes that a text is bad, that it is good, or abstains. Nobody says how far a rule can
be trusted: expectation-maximisation over the vote patterns estimates, for good and for bad texts
apart, how often each rule votes which way. A text is kept if the posterior probability that it is
good is at least a half. One rule that errs no longer drops a text, as it would if all had to pass.

Only the histogram of vote patterns, at most 3 ** rules rows, reaches the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

SPACES = " \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
BASE = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long"}
MORE = {"n_lines": "long", "n_upper": "long", "n_letters": "long", "n_stops": "long", "n_marks": "long", "n_distinct": "long", "n_stutters": "long", "n_tails": "long"}
COUNTS = {**BASE, **MORE}
# ends of words that plain prose does not have
TAILS = b"#*$%&|<>@^~=+_\\/{}[]"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_WORDS = 50
ROUNDS = 50


def _count(raw: bytes, wanted: bytes) -> int:
    return len(raw) - len(raw.translate(None, wanted))


def counts(text: str | None) -> tuple[int, ...]:
    """The values of `COUNTS` for a whole text; null has no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    triples = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(triples)) < len(triples):
        seen, covered = {}, bytearray(len(words))
        for at, triple in enumerate(triples):
            earlier = seen.setdefault(triple, at)
            if earlier != at:
                covered[earlier : earlier + 3] = covered[at : at + 3] = b"\1\1\1"
        repeated = sum(covered)
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    return (
        len(words), len(text) - sum(text.count(c) for c in SPACES), _count(raw, SYMBOLS), len(lines) - len(set(lines)), repeated,
        len(lines), _count(raw, UPPER), _count(raw, UPPER + UPPER.lower()), sum(w[-1] in b".?!:;" for w in words), raw.count(b"!"),
        len(set(words)), sum(map(eq, words, words[1:])), sum(w[-1] in TAILS for w in words),
    )


@dataclass(frozen=True)
class Rule:
    """Votes bad or good where the value says so, otherwise abstains."""

    name: str
    value: Column
    bad: tuple[float, float]  # votes bad below the first or above the second
    good: tuple[float, float]  # votes good from the first to the second

    def vote(self) -> Column:
        low, high = self.bad
        return F.when((self.value < low) | (self.value > high), -1).when(self.value.between(*self.good), 1).otherwise(0)


def _per(count: str, of: str) -> Column:
    return F.coalesce(F.try_divide(F.col(count).cast("double"), F.col(of)), F.lit(0.0))



def standard_rules() -> list[Rule]:
    """Thresholds in the range of published web-text filters."""
    never = (math.inf, -math.inf)
    return [
        Rule("length", F.col("n_words").cast("double"), (20, math.inf), never),
        Rule("word_length", _per("word_chars", "n_words"), (2.2, 12), never),
        Rule("symbols", _per("n_symbols", "n_words"), (-1, 0.1), never),
        Rule("tails", _per("n_tails", "n_words"), (-1, 0.2), never),
        Rule("repeats", _per("n_repeat_words", "n_words"), (-1, 0.45), never),
        Rule("lines", _per("n_dup_lines", "n_lines"), (-1, 0.5), never),
        Rule("capitals", _per("n_upper", "n_letters"), (-1, 0.4), never),
        Rule("stops", _per("n_stops", "n_words"), (0.01, 0.6), (0.03, 0.3)),
        Rule("marks", _per("n_marks", "n_words"), (-1, 0.3), never),
        Rule("variety", F.col("n_distinct") / F.sqrt(F.greatest("n_words", F.lit(1)).cast("double")), (1.5, math.inf), (6, math.inf)),
        Rule("stutter", _per("n_stutters", "n_words"), (-1, 0.2), never),
    ]


@dataclass
class Trust:
    """What the rules turned out to be worth: prior of good, and log odds for good of each vote."""

    prior: float
    odds: dict[str, dict[int, float]] = field(default_factory=dict)

    def posterior(self) -> Column:
        """The probability of good, compiled to an expression over the vote columns."""
        total = F.lit(math.log(self.prior / (1 - self.prior)))
        for name, by_vote in self.odds.items():
            vote = F.col(f"vote_{name}")
            total = total + F.when(vote == -1, by_vote[-1]).when(vote == 1, by_vote[1]).otherwise(by_vote[0])
        return 1 / (1 + F.exp(-total))


def learn(patterns: list[tuple[tuple[int, ...], int]], names: list[str], rounds: int = ROUNDS) -> Trust:
    """Expectation-maximisation over vote patterns with their counts: how often each rule votes bad,
    abstains or votes good, on good and on bad texts. It starts from the belief
    that a text with a bad vote is bad; sorted patterns make it the same on every run."""
    patterns = sorted(patterns)
    if not patterns:
        return Trust(0.5, {n: {-1: 0.0, 0: 0.0, 1: 0.0} for n in names})
    votes, weight = np.array([p for p, _ in patterns]), np.array([n for _, n in patterns], float)
    good = np.where((votes == -1).any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        prior = (weight @ good + 1) / (weight.sum() + 2)
        share = {}
        for vote in (-1, 0, 1):
            hit = (votes == vote) * weight[:, None]
            # one imagined text of either kind that votes like the average keeps logarithms finite
            usual = np.maximum(hit.sum(axis=0) / weight.sum(), 1e-300)
            share[vote] = np.log((good @ hit + usual) / (weight @ good + 1)) - np.log(((1 - good) @ hit + usual) / (weight @ (1 - good) + 1))
        # a vote may be worthless, but never counts against its own direction
        share[-1], share[1] = np.minimum(share[-1], 0), np.maximum(share[1], 0)
        good = 1 / (1 + np.exp(-math.log(prior / (1 - prior)) - sum((votes == v) @ share[v] for v in share)))
    return Trust(float(prior), {n: {v: float(share[v][i]) for v in (-1, 0, 1)} for i, n in enumerate(names)})


def quality_rules(docs: DataFrame, text: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """All columns of `docs` but `text`, plus the counts of `COUNTS`, one vote column a rule,
    `base_failed`, `posterior` (probability of good) and `kept`. Columns of these names give way.

    Null and empty texts have no words and fail the base check. All rows stay, repeated ones too;
    an empty table learns nothing and stays empty.
    """
    rules = standard_rules() if rules is None else rules
    names = [r.name for r in rules]

    @F.pandas_udf(", ".join(f"{n} {t}" for n, t in COUNTS.items()))
    def count(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([counts(t) for t in texts], columns=list(COUNTS), dtype="int64")

    added = {*COUNTS, "base_failed", "posterior", "kept", *(f"vote_{n}" for n in names)}
    rest = [c for c in docs.columns if c not in added and c != text]
    scratch = Scratch(docs.sparkSession, "weak-rules")
    counted = scratch.put(docs.select(*rest, count(F.col(text)).alias("_c")).select(*rest, "_c.*"), "counts")
    voted = counted.select("*", *[r.vote().alias(f"vote_{r.name}") for r in rules])
    votes = [f"vote_{n}" for n in names]
    histogram = voted.groupBy(*votes).count().collect()
    trust = learn([(tuple(r[v] for v in votes), r["count"]) for r in histogram], names)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return voted.withColumns({"base_failed": failed, "posterior": trust.posterior()}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5))
