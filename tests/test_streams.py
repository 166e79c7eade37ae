"""Streaming jobs with documents that come again, late and repeated events; embedders that fail."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.operators import actions, embedding
from quire.sources import corpus
from quire.streaming import jobs


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


DOCS = "kb_id string, doc_id long, text string, seq int"


def batch_of(spark, *rows):
    return spark.createDataFrame(list(rows), DOCS)


def words(n, start=0):
    return " ".join(f"w{i}" for i in range(start, start + n))


def state(spark, path):
    table = rows_of(jobs.ingested(spark, path), "kb_id", "doc_id", "position", "text")
    counters = {r["kb_id"]: (r["documents"], r["chunks"], r["tokens"]) for r in jobs.ingest_counters(spark, path).collect()}
    return table, {k: v for k, v in counters.items() if any(v)}


def counted(spark, path):
    rows = jobs.ingested(spark, path).groupBy("kb_id").agg(F.count_distinct("doc_id").alias("d"), F.count("*").alias("c"), F.sum("token_count").alias("t")).collect()
    return {r["kb_id"]: (r["d"], r["c"], r["t"]) for r in rows}


def test_a_document_that_comes_again_replaces_itself(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    order = [F.desc("seq")]

    def ingest(number, *rows):
        jobs.ingest_batch(batch_of(spark, *rows), number, path, 10, 2, order, buckets=3)

    ingest(0, ("a", 1, words(25), 1), ("a", 2, words(5), 1), ("b", 1, words(12), 1), ("a", 3, "  ", 1))
    first = state(spark, path)
    assert first[1] == counted(spark, path) == {"a": (2, 4, first[1]["a"][2]), "b": (1, 2, first[1]["b"][2])}
    # the same batch once more, after its marker or after it broke off before it
    ingest(0, ("a", 1, words(25), 1), ("a", 2, words(5), 1), ("b", 1, words(12), 1), ("a", 3, "  ", 1))
    assert state(spark, path) == first
    spark.range(1).write.mode("overwrite").parquet(f"{path}/gone")
    from quire.session import drop_folder

    drop_folder(spark, f"{path}/done/batch=0")
    ingest(0, ("a", 1, words(25), 1), ("a", 2, words(5), 1), ("b", 1, words(12), 1), ("a", 3, "  ", 1))
    assert state(spark, path) == first
    # a shorter version, two versions in one batch, a blank one that is refused, a new document
    ingest(1, ("a", 1, words(4, 50), 2), ("b", 1, words(8, 1), 2), ("b", 1, words(3, 70), 3), ("a", 2, "", 9), ("c", 7, words(1), 1))
    table, counters = state(spark, path)
    assert table == [("a", 1, 0, words(4, 50)), ("a", 2, 0, words(5)), ("b", 1, 0, words(3, 70)), ("c", 7, 0, "w0")]
    assert counters == counted(spark, path) == {"a": (2, 2, 9), "b": (1, 1, 3), "c": (1, 1, 1)}
    # what came before, again
    ingest(2, ("a", 1, words(25), 3), ("b", 1, words(12), 4))
    ingest(3, ("c", 7, words(1), 2))
    assert state(spark, path)[1] == counted(spark, path)


def test_ingest_as_a_stream(spark, tmp_path):
    for i, rows in enumerate([[("a", 1, words(25), 1), ("a", 2, words(3), 1)], [("a", 1, words(2), 2)]]):
        batch_of(spark, *rows).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    docs = spark.readStream.schema(DOCS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    jobs.ingest_chunks(docs, f"file://{tmp_path}/table", 10, 2)
    assert counted(spark, f"file://{tmp_path}/table") == state(spark, f"file://{tmp_path}/table")[1]
    assert {r[1] for r in state(spark, f"file://{tmp_path}/table")[0]} == {1, 2}


NOON = dt.datetime(2024, 3, 1, 12)


def stream_of(spark, tmp_path, schema, batches):
    """Rows as a stream of one file a micro-batch, in the given order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, jobs.ROCKSDB)
    yield
    spark.conf.unset(name)


def test_requests_in_any_order_give_the_batch_result(spark, tmp_path, rocks):
    rnd = random.Random(5)
    rows = [(rnd.randrange(6), NOON + dt.timedelta(seconds=i), i, rnd.choice(("create", "approve", "reject", "execute")), rnd.random() < 0.5) for i in range(120)]
    shuffled = list(rows)
    for at in range(0, 120, 20):
        part = shuffled[at : at + 30]
        rnd.shuffle(part)
        shuffled[at : at + 30] = part
    schema = "action_id long, ts timestamp, seq long, op string, ok boolean"
    stream = stream_of(spark, tmp_path, schema, [shuffled[at : at + 12] for at in range(0, 120, 12)])
    got = rows_of(jobs.run_to_table(jobs.action_states(stream, "60 seconds"), "states"), "action_id", "seq", "outcome")
    want = rows_of(actions.transitions(spark.createDataFrame(rows, schema)), "action_id", "seq", "outcome")
    # the last minute still waits for requests that may come before it
    assert got == [w for w in want if w[1] <= 119 - 60]


class CountedState:
    """A list and timers that count the round trips to the store."""

    def __init__(self):
        self.rows, self.timers, self.trips = [], [], 0

    def appendValue(self, row):
        self.rows, self.trips = [*self.rows, row], self.trips + 1

    def appendList(self, rows):
        self.rows, self.trips = [*self.rows, *rows], self.trips + 1

    def registerTimer(self, at):
        self.timers, self.trips = [*self.timers, at], self.trips + 1


def test_action_requests_reach_the_state_in_few_round_trips():
    rows = pd.DataFrame({"ts": [NOON + dt.timedelta(seconds=i) for i in range(500)][::-1], "seq": range(500), "op": "create", "ok": True})
    state, processor = CountedState(), jobs.ActionProcessor()
    processor.handle = processor.waiting = state
    list(processor.handleInputRows((1,), iter([rows]), None))
    first = int(pd.Series([NOON]).astype("datetime64[us]").astype("int64")[0] // 1000)
    assert len(state.rows) == 500 and min(state.timers) == first and state.trips <= 2


def test_windows_count_once_and_tell_late_rows(spark, tmp_path):
    schema = "event_id long, ts timestamp, query string, kb_id long, type string, results_count long"

    def hit(i, hours, query="q", kb=1, kind="hybrid"):
        return (i, NOON + dt.timedelta(hours=hours), query, kb, kind, i)

    batches = [
        [hit(1, 0), hit(2, 1, "r", 2, "keyword"), hit(2, 1, "r", 2, "keyword")],
        [hit(1, 0), hit(3, 2, "r", 1, "semantic"), hit(4, 30)],
        [hit(5, 90)],
        [hit(6, 1), hit(7, 91)],  # the first comes days too late
        [hit(8, 200)],
    ]
    late: list[int] = []
    windows = jobs.search_windows(stream_of(spark, tmp_path, schema, batches), "1 day", "1 day", None, ("query", "kb_id", "type"))
    got = rows_of(jobs.run_to_table(windows, "windows", late=late), "start", "dimension", "value", "searches", "avg_results")
    day = dt.datetime(2024, 3, 1)
    want = [
        (day, "kb_id", "1", 2, 2.0), (day, "kb_id", "2", 1, 2.0), (day, "query", "q", 1, 1.0), (day, "query", "r", 2, 2.5),
        (day, "type", "hybrid", 1, 1.0), (day, "type", "keyword", 1, 2.0), (day, "type", "semantic", 1, 3.0),
    ]
    first_day = [g for g in got if g[0] == day]
    assert first_day == sorted(want)
    assert {g[0].day for g in got} == {1, 2, 5} and all(g[3] in (1, 2) for g in got)
    assert late == [1]


def failing_embedder(path):
    """Fails now and then, refuses more than four texts at once, and notes when it is set up."""

    def make():
        with open(f"{path}/made", "a") as out:
            out.write("x")
        calls = [0]

        def embed(texts):
            calls[0] += 1
            if len(texts) > 4:
                raise embedding.Refused
            if calls[0] % 3 == 1:
                raise TimeoutError
            return [[float(len(t)), 0.5] for t in texts]

        return embed

    return make


def test_embedder_fails_and_refuses(spark, tmp_path):
    rows = spark.createDataFrame([(i, "x" * (i + 1), 9007199254740993) for i in range(33)], "id long, text string, big long").repartition(2)
    got = embedding.embedded(rows, failing_embedder(str(tmp_path)), "failing", max_texts=7, wait=0.0)
    assert sorted((r["id"], r["big"], r["embedding"]) for r in got.collect()) == [(i, 9007199254740993, [float(i + 1), 0.5]) for i in range(33)]
    assert 1 <= len((tmp_path / "made").read_text()) <= 4
    assert list(embedding.requests_of(["a" * 30, "b" * 300, "c", "d"], 2, 50)) == [["a" * 30], ["b" * 300], ["c", "d"]]
    with pytest.raises(Exception, match="cannot embed an empty text"):
        embedding.embedded(spark.createDataFrame([(" ",)], "text string"), failing_embedder(str(tmp_path)), "failing").collect()
    with pytest.raises(ValueError, match="asked for 1 vectors"):
        embedding.answered(lambda texts: [], ["a"], 3, 0.0)
    with pytest.raises(embedding.Refused):
        embedding.answered(refusing, ["a", "b"], 3, 0.0)
    assert embedding.embedded(rows.limit(0), failing_embedder(str(tmp_path)), "failing").count() == 0


def refusing(texts):
    raise embedding.Refused


def test_import_into_a_kb_with_new_vectors(spark, tmp_path):
    schemas = {
        "documents": "kb_id string, id string, title string", "chunks": "kb_id string, id string, document_id string, text string, position int, embedding array<float>",
        "entities": "kb_id string, id string, name string, type string", "relationships": "kb_id string, source_id string, relationship_type string, target_id string",
    }
    parts = {
        "documents": [("a", "d1", "One"), ("b", "d2", "Two")], "chunks": [("a", "c1", "d1", "first text", 0, [1.0]), ("a", "c2", "d1", "second", 1, None)],
        "entities": [("a", "e1", "Ann", "PERSON"), ("a", "e2", "Bo", "PERSON")], "relationships": [("a", "d1", "CITES", "d3")],
    }
    corpus.write_export("a", {k: spark.createDataFrame(v, schemas[k]) for k, v in parts.items()}, f"file://{tmp_path}/export", embeddings=True)
    before = {"entities": spark.createDataFrame([("n", "old", "Ann", "PERSON"), ("n", "own", "Cy", "PERSON")], schemas["entities"])}
    plain = corpus.import_kb(spark, f"file://{tmp_path}/export", schemas, "n")
    assert {r["embedding"] and tuple(r["embedding"]) for r in plain["chunks"].collect()} == {(1.0,), None}
    made = corpus.import_kb(spark, f"file://{tmp_path}/export", schemas, "n", before, failing_embedder(str(tmp_path)), "import-test")
    assert sorted(r["embedding"][0] for r in made["chunks"].collect()) == [6.0, 10.0]
    names = {r["name"]: r["id"] for r in made["entities"].collect()}
    assert set(names) == {"Ann", "Bo", "Cy"} and names["Cy"] == "own" and names["Ann"] not in ("old", "e1")
    document = made["documents"].collect()
    assert len(document) == 1 and {r["document_id"] for r in made["chunks"].collect()} == {document[0]["id"]} == {r["source_id"] for r in made["relationships"].collect()}


def test_a_table_that_is_a_folder_is_streamed(spark, tmp_path):
    """A table may be one file or a folder of files; both come through with the same rows."""
    spark.range(6).repartition(3).write.parquet(f"{tmp_path}/many.parquet")
    pd.DataFrame({"id": range(4)}).to_parquet(tmp_path / "one.parquet")
    for name, rows in (("many", 6), ("one", 4)):
        got = jobs.run_to_table(jobs.read_table(spark, str(tmp_path), name), name)
        assert sorted(r["id"] for r in got.collect()) == list(range(rows))
