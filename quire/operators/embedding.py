"""Vectors of texts from the caller's embedder, a request at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.operators.chunking import MAX_TEXTS, MAX_TOKENS

# Tries of a request, seconds before the second one; each wait doubles.
TRIES, WAIT = 3, 1.0

Embedder = Callable[[list[str]], Sequence[Sequence[float]]]

# embedders of this worker, by the name of what makes them
_MADE: dict[str, Embedder] = {}


class Refused(Exception):
    """Raised by an embedder whose request was too large: it is cut in half and tried again."""


def estimated(text: str) -> int:
    return max(1, len(text) // 3)


def requests_of(texts: Sequence[str], max_texts: int, max_tokens: int) -> Iterator[list[str]]:
    """Texts in order, as requests of bounded number and tokens; a longer text is one on its own."""
    held: list[str] = []
    used = 0
    for text in texts:
        size = estimated(text)
        if held and (len(held) >= max_texts or used + size > max_tokens):
            yield held
            held, used = [], 0
        held.append(text)
        used += size
    if held:
        yield held


def answered(embedder: Embedder, texts: list[str], tries: int, wait: float) -> list[Sequence[float]]:
    """The vectors of one request. A refused request is halved down to single texts; any other failure
    is tried again after a wait, and the last one is raised."""
    for attempt in range(tries):
        try:
            vectors = list(embedder(texts))
            break
        except Refused:
            if len(texts) == 1:
                raise
            middle = len(texts) // 2
            return answered(embedder, texts[:middle], tries, wait) + answered(embedder, texts[middle:], tries, wait)
        except Exception:
            if attempt == tries - 1:
                raise
            time.sleep(wait * 2**attempt)
    if len(vectors) != len(texts):
        raise ValueError(f"asked for {len(texts)} vectors, got {len(vectors)}")
    return vectors


def embedded(
    rows: DataFrame, make: Callable[[], Embedder], name: str, text: str = "text", out: str = "embedding", max_texts: int = MAX_TEXTS, max_tokens: int = MAX_TOKENS,
    tries: int = TRIES, wait: float = WAIT,
) -> DataFrame:
    """`rows` with the vector of each text in `out`, which gives way if it is there.

    `make` is called in a worker when its first text comes, once for all tasks of that worker; `name`
    tells embedders apart. A blank text is an error, as it cannot be embedded. Rows stream: a task holds
    one Arrow batch, so requests end with a batch at the latest.
    """
    kept = [c for c in rows.columns if c != out]
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in kept) + f", `{out}` array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            if any(not t or t.isspace() for t in texts):
                raise ValueError("cannot embed an empty text")
            vectors: list = []
            if texts:
                embedder = _MADE.get(name) or _MADE.setdefault(name, make())
                for request in requests_of(texts, max_texts, max_tokens):
                    vectors += answered(embedder, request, tries, wait)
            yield pa.record_batch([*batch.columns, pa.array([list(map(float, v)) for v in vectors], pa.list_(pa.float32()))], names=[*kept, out])

    return rows.select(*kept).mapInArrow(run, schema)
