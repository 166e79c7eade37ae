"""Sequential rules over ordered rows as a parallel prefix over functions of a state.

Opening chapters, filling batches and choosing scenes go on from the last opening, so each row depends
on all before it. Given where a block of rows opens first, everything else in it is fixed: an opening
leads to the next one. A state before the block only decides that first opening, and few rows come into
question. So each block is summed up by these rows and the state that each leads to; the blocks of a
key, one small row each, are gone through in order; and with its entry state every block labels its
rows. That is one grouped pass, one over summaries and one that labels, however long a key is.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.common import ordered_blocks
from quire.session import stored

# rows of a key that one task goes through; longer keys are split
SCAN_ROWS = 200_000


class MinimumRun:
    """A row opens if it is a candidate and at least `least` rows passed since the last opening (or the
    key's begin). State: rows since then, as far as they matter. Input: a 0/1 column."""

    start = 0

    def __init__(self, least: int):
        self.least = least

    def following(self, flags: np.ndarray) -> np.ndarray:
        """For each row, where the next opening is if it opens; the number of rows for none."""
        n = len(flags)
        ahead = np.append(np.minimum.accumulate(np.where(flags > 0, np.arange(n), n)[::-1])[::-1], n)
        return ahead[np.minimum(np.arange(n) + max(1, self.least), n)]

    def head(self, flags: np.ndarray) -> dict:
        """What of a block decides its first opening, whatever the state before it."""
        n = len(flags)
        ahead = np.append(np.minimum.accumulate(np.where(flags > 0, np.arange(n), n)[::-1])[::-1], n)
        return {"rows": n, "by_state": [int(ahead[min(n, max(0, self.least - s))]) for s in range(self.least + 1)]}

    def candidates(self, head: dict) -> set[int]:
        return set(head["by_state"]) - {head["rows"]}

    def first(self, head: dict, state: int) -> int | None:
        at = head["by_state"][state]
        return at if at < head["rows"] else None

    def leaving(self, flags: np.ndarray, last: int) -> int:
        """The state behind a block whose last opening is given."""
        return min(self.least, len(flags) - last)

    def passing(self, head: dict, state: int) -> int:
        """The state behind a block without an opening."""
        return min(self.least, state + head["rows"])


class Budget:
    """A row opens a batch if with it the open one would hold more than `most_rows` rows or more than
    `most` in sum. State: rows and sum of the open batch. Input: a column of whole numbers."""

    start = (0, 0)

    def __init__(self, most_rows: int, most: int):
        self.most_rows, self.most = most_rows, most

    @staticmethod
    def _sums(sizes: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(sizes.astype(np.int64)))

    def following(self, sizes: np.ndarray) -> np.ndarray:
        sums, at = self._sums(sizes), np.arange(len(sizes))
        # sums never fall, so the first row beyond the budget is found by halving
        over = np.searchsorted(sums, sums[:-1] + self.most, side="right") - 1
        return np.minimum(np.maximum(np.minimum(over, at + self.most_rows), at + 1), len(sizes))

    def head(self, sizes: np.ndarray) -> dict:
        sums = self._sums(sizes)
        return {"rows": len(sizes), "sum": int(sums[-1]), "sums": sums[: self.most_rows + 2].tolist()}

    def candidates(self, head: dict) -> set[int]:
        return set(range(min(head["rows"], self.most_rows + 1)))

    def first(self, head: dict, state: Sequence[int]) -> int | None:
        count, used = state
        for i, total in enumerate(head["sums"][1:]):
            if count + i > 0 and (count + i >= self.most_rows or used + total > self.most):
                return i
        return None

    def leaving(self, sizes: np.ndarray, last: int) -> tuple[int, int]:
        return len(sizes) - last, int(sizes[last:].sum())

    def passing(self, head: dict, state: Sequence[int]) -> tuple[int, int]:
        return state[0] + head["rows"], state[1] + head["sum"]


class Spacing:
    """A row opens if it is at least `gap` behind the last opening; the first of a key does. State: the
    last opening's value. Input: a column of ascending doubles."""

    start = None

    def __init__(self, gap: float):
        self.gap = gap

    def _far(self, values: np.ndarray, last: np.ndarray) -> np.ndarray:
        """First place whose value minus `last` is at least the gap, by that very difference."""
        at, n = np.searchsorted(values, last + self.gap, side="left"), len(values)
        # the sum may round otherwise than the difference: move to where the difference holds
        while (back := (at > 0) & (values[np.maximum(at, 1) - 1] - last >= self.gap)).any():
            at = at - back
        while (on := (at < n) & (values[np.minimum(at, n - 1)] - last < self.gap)).any():
            at = at + on
        return at

    def following(self, values: np.ndarray) -> np.ndarray:
        return np.maximum(self._far(values, values), np.arange(len(values)) + 1)

    def head(self, values: np.ndarray) -> dict:
        # the state is no later than the first row, so rows further on are never the first to open
        reach = int(self._far(values, values[:1])[0]) + 1
        return {"rows": len(values), "values": values[:reach].tolist()}

    def candidates(self, head: dict) -> set[int]:
        return set(range(len(head["values"])))

    def first(self, head: dict, state: float | None) -> int | None:
        return next((i for i, v in enumerate(head["values"]) if state is None or v - state >= self.gap), None)

    def leaving(self, values: np.ndarray, last: int) -> float:
        return float(values[last])

    def passing(self, head: dict, state: float | None) -> float | None:
        return state


def openings(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, rule, out: str, rows: int = SCAN_ROWS) -> DataFrame:
    """Add the 0/1 column `out`: whether `rule` opens at a row, over each key's rows in order. `order`
    must be a total order within a key; null is a key like any other."""
    base = stored(df, "scan")
    key = [f"_k{i}" for i in range(len(keys))]
    place = [f"_o{i}" for i in range(len(order))]
    narrow = base.select(*[F.col(c).alias(k) for c, k in zip(keys, key)], *[F.col(c).alias(o) for c, o in zip(order, place)], F.col(value).alias("_v"))
    blocked, split = ordered_blocks(narrow, key, place, rows)

    def in_order(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.take(pc.sort_indices(table, sort_keys=[(o, "ascending") for o in place], null_placement="at_start"))
        return table, table["_v"].to_numpy()

    def labelled(table: pa.Table, state) -> pa.Table:
        table, values = in_order(table)
        opens, at = np.zeros(len(values), dtype=np.int32), rule.first(rule.head(values), state)
        if at is not None:
            following = rule.following(values).tolist()
            while at < len(values):
                opens[at] = 1
                at = following[at]
        return table.select([*key, *place]).append_column("_opens", pa.array(opens))

    fields = {f.name: f.dataType.simpleString() for f in narrow.schema}
    of_key = ", ".join(f"{k} {fields[k]}" for k in key)
    label_type = ", ".join(f"{c} {fields[c]}" for c in (*key, *place)) + ", _opens int"
    if not split:
        labels = blocked.groupBy(*key).applyInArrow(lambda table: labelled(table, rule.start), label_type)
    else:

        def summed(table: pa.Table) -> pa.Table:
            _, values = in_order(table)
            head, following, ends = rule.head(values), rule.following(values).tolist(), {}
            # chains of openings soon meet: what one has gone through, the next need not
            for first in rule.candidates(head):
                chain, at = [], first
                while at < len(values) and at not in ends:
                    chain.append(at)
                    at = following[at]
                ends.update(dict.fromkeys(chain, ends[at] if at in ends else chain[-1] if chain else first))
            leads = {str(first): rule.leaving(values, ends[first]) for first in rule.candidates(head)}
            one = table.slice(0, 1).select([*key, "_block"])
            return one.append_column("_summary", pa.array([json.dumps({"head": head, "leads": leads})], pa.string()))

        def entered(table: pa.Table) -> pa.Table:
            """The state before each block of a key: one small row a block."""
            table, state, states = table.sort_by("_block"), rule.start, []
            for text in table["_summary"].to_pylist():
                block = json.loads(text)
                states.append(json.dumps(state))
                at = rule.first(block["head"], state)
                state = rule.passing(block["head"], state) if at is None else block["leads"][str(at)]
            return table.select([*key, "_block"]).append_column("_state", pa.array(states, pa.string()))

        start, block = f"{of_key}, " if key else "", "_block int"
        summaries = blocked.groupBy(*key, "_block").applyInArrow(summed, f"{start}{block}, _summary string")
        states = stored(summaries.groupBy(*key).applyInArrow(entered, f"{start}{block}, _state string"), "scan-states")
        joined = blocked.groupBy(*key, "_block").cogroup(states.groupBy(*key, "_block"))
        labels = joined.applyInArrow(lambda rows, state: labelled(rows, json.loads(state["_state"][0].as_py())), label_type)
    labels = labels.withColumnRenamed("_opens", out)
    same = [base[c].eqNullSafe(labels[k]) for c, k in zip((*keys, *order), (*key, *place))]
    condition = same[0]
    for part in same[1:]:
        condition = condition & part
    return base.join(labels, condition).drop(*key, *place)
