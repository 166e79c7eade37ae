"""Structured Streaming jobs over the append logs: searches, ingests, actions, segments.

Sources are folders of parquet files; every job runs with an `availableNow` trigger here and with
any trigger in production. Checkpoints and tables live below the shared checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from quire.functions.text import clean_text, is_blank
from quire.operators.actions import next_status
from quire.operators.chunking import chunk_tokens
from quire.operators.common import first_per_key
from quire.session import drop_folder, folder_exists, is_folder, scratch_folder

# folders of the chunk table; a batch writes those anew that hold one of its documents
BUCKETS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 100) -> DataFrame:
    """A table of a folder as a stream with the schema of the batch table. The table is a file, and so are
    those that follow it, or a folder of files."""
    path = f"{folder}/{name}.parquet"
    stream = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    if is_folder(spark, path):
        return stream.option("pathGlobFilter", "*.parquet").parquet(path)
    return stream.option("pathGlobFilter", f"{name}*.parquet").parquet(folder)


def run_to_table(stream: DataFrame, name: str, mode: str = "append", late: list[int] | None = None) -> DataFrame:
    """Run a query over what is there, into parquet, and read the result. `late` gets the number of rows
    that came behind the watermark and were left out."""
    spark = stream.sparkSession
    out = scratch_folder(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if late is not None:
        late.append(late_rows(query))
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def late_rows(query: StreamingQuery) -> int:
    """Rows that the stateful operators of a query dropped because they came behind the watermark; a row
    dropped early does not reach later ones."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for progress in query.recentProgress for op in json.loads(progress.json)["stateOperators"])


def search_windows(searches: DataFrame, delay: str = "1 day", size: str = "1 day", slide: str | None = None, dimensions: Sequence[str] = ("query",)) -> DataFrame:
    """Counts per window and value of each dimension: (start, end, dimension, value, searches,
    avg_results); a window is final, and emitted, once the watermark passes it.

    `searches` has event_id, ts, results_count and the dimensions (query, kb_id, type). A search that is
    delivered again within the delay counts once. Windows are counted by all dimensions together
    first; these few rows, one for each combination, are then summed by each dimension alone.
    """
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    once = searches.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])
    combined = once.groupBy(window, *dimensions).agg(F.count("*").alias("n"), F.count("results_count").alias("counted"), F.sum("results_count").alias("results"))
    # the window column carries the event time on, so that a second aggregation can be chained
    each = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    listed = combined.select("window", "n", "counted", "results", F.explode(each).alias("by")).select("window", "n", "counted", "results", "by.*")
    summed = listed.groupBy("window", "dimension", "value").agg(F.sum("n").alias("searches"), (F.sum("results") / F.sum("counted")).alias("avg_results"))
    return summed.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "dimension", "value", "searches", "avg_results")


def gap_chapters(segments: DataFrame, gap: str, delay: str = "1 day") -> DataFrame:
    """Chapters by pauses alone: session windows of each recording."""
    sessions = segments.withWatermark("ts", delay).groupBy("recording", F.session_window("ts", gap)).agg(F.count("*").alias("segments"))
    return sessions.select("recording", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "segments")


def ingest_chunks(docs: DataFrame, path: str, size: int, overlap: int, order: Sequence[Column] = (), buckets: int = BUCKETS) -> None:
    """Clean and chunk arriving documents (kb_id, doc_id, text) into the table below `path`.

    A document that comes again replaces its chunks, wherever it came before; of several in one batch
    the first in `order` counts. Blank documents are refused and change nothing.
    """
    query = (
        docs.writeStream.foreachBatch(lambda batch, number: ingest_batch(batch, number, path, size, overlap, order, buckets))
        .option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()


def ingest_batch(batch: DataFrame, number: int, path: str, size: int, overlap: int, order: Sequence[Column] = (), buckets: int = BUCKETS) -> None:
    """Take one micro-batch into the chunk table; a batch that is repeated gives the state of one.

    Chunks lie in folders by a hash of their document. The folders that the batch touches are written
    anew, by dynamic partition overwrite, from what they held and what came. The change of the counters is
    written before that, once, and a marker after it: a batch that broke off finds its change
    and does the rest again, one with a marker does nothing.
    """
    spark = batch.sparkSession
    if folder_exists(spark, f"{path}/done/batch={number}/_SUCCESS"):
        return
    came = batch.withColumn("text", clean_text(F.col("text"))).where(~is_blank(F.col("text")))
    came = first_per_key(came, ["kb_id", "doc_id"], [*order, F.desc("text")]).select("kb_id", "doc_id", "text")
    chunks = chunk_tokens(came, size=size, overlap=overlap).withColumn("bucket", F.pmod(F.xxhash64("kb_id", "doc_id"), F.lit(buckets)).cast("int"))
    chunks.write.mode("overwrite").parquet(f"{path}/arrived/batch={number}")
    new = spark.read.schema(chunks.schema).parquet(f"{path}/arrived/batch={number}")
    touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most `buckets`
    there = folder_exists(spark, f"{path}/chunks")
    old = spark.read.schema(chunks.schema).parquet(f"{path}/chunks").where(F.col("bucket").isin(touched)) if there else new.limit(0)
    keys = new.select("kb_id", "doc_id").distinct()
    if not folder_exists(spark, f"{path}/counters/batch={number}/_SUCCESS"):
        gone = old.join(keys, ["kb_id", "doc_id"], "left_semi")

        def counted(rows: DataFrame, sign: int) -> DataFrame:
            per = rows.groupBy("kb_id").agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("chunks"), F.sum("token_count").alias("tokens"))
            return per.select("kb_id", *[(F.col(c) * sign).alias(c) for c in ("documents", "chunks", "tokens")])

        change = counted(new, 1).unionByName(counted(gone, -1)).groupBy("kb_id").agg(*[F.sum(c).alias(c) for c in ("documents", "chunks", "tokens")])
        change.write.mode("overwrite").parquet(f"{path}/counters/batch={number}")
    rest = old.join(keys, ["kb_id", "doc_id"], "left_anti").unionByName(new).repartition("bucket", "doc_id")
    rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/chunks")
    spark.range(1).write.mode("overwrite").parquet(f"{path}/done/batch={number}")
    drop_folder(spark, f"{path}/arrived/batch={number}")


def ingested(spark: SparkSession, path: str) -> DataFrame:
    """The chunk table (kb_id, doc_id, position, text, token_count)."""
    return spark.read.parquet(f"{path}/chunks").drop("bucket")


def ingest_counters(spark: SparkSession, path: str) -> DataFrame:
    """Documents, chunks and tokens of each KB: the sum of the batches' changes."""
    changes = spark.read.parquet(f"{path}/counters")
    return changes.groupBy("kb_id").agg(*[F.sum(c).alias(c) for c in ("documents", "chunks", "tokens")])


class ActionProcessor(StatefulProcessor):
    """Requests of one action wait until the watermark has passed them, then run in order of `seq`; the
    status is state. So requests may come in any order within the delay."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.status = handle.getValueState("status", "status string")
        self.waiting = handle.getListState("waiting", "ts long, seq long, op string, ok boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # each call of the handle is a round trip: the rows of a batch go in at once, with one timer for its first
        for batch in rows:
            times = batch["ts"].astype("datetime64[us]").astype("int64") // 1000
            came = list(zip(times.tolist(), batch["seq"].tolist(), batch["op"].tolist(), batch["ok"].astype(bool).tolist()))
            if came:
                self.waiting.appendList(came)
                self.handle.registerTimer(min(times))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # the first timer to expire takes all requests that the watermark has passed; there is a timer no later
        # than the first request that waits
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get())
        due = sorted((r for r in held if r[0] <= passed), key=lambda r: r[1])
        if not due:
            return
        later = [tuple(r) for r in held if r[0] > passed]
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        else:
            self.waiting.clear()
        known = self.status.get()
        status, outcomes = known[0] if known else None, []
        for _, seq, op, ok in due:
            moved = next_status(status, op, ok)
            outcomes.append((key[0], seq, moved or ("404" if status is None else "409")))
            status = moved or status
        if status is not None:
            self.status.update((status,))
        yield pd.DataFrame(outcomes, columns=["action_id", "seq", "outcome"])

    def close(self) -> None:
        pass


def action_states(requests: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Outcomes of requests(action_id, ts, seq, op, ok), each once the watermark, `delay` behind the
    newest request, has passed it; `seq` follows `ts`. Needs the RocksDB state store."""
    timed = requests.withWatermark("ts", delay)
    return timed.groupBy("action_id").transformWithStateInPandas(
        statefulProcessor=ActionProcessor(), outputStructType="action_id long, seq long, outcome string", outputMode="Append", timeMode="EventTime"
    )
