"""Counts and usage analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.common import top_k, union_all

NODE_KINDS = ["documents", "chapters", "chunks", "entities", "courses", "modules", "topics", "concepts"]


def graph_stats(nodes: dict[str, DataFrame], edges: DataFrame) -> DataFrame:
    """Node counts per kind and outgoing relationships of every KB."""
    counted = [df.groupBy("kb_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind)) for kind, df in nodes.items()]
    counted.append(edges.groupBy("kb_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("relationships")))
    wide = union_all(counted).groupBy("kb_id").pivot("kind", [*NODE_KINDS, "relationships"]).agg(F.sum("n"))
    filled = wide.na.fill(0)
    return filled.withColumn("exists", (F.col("documents") > 0) | (F.col("courses") > 0))


def kb_overview(docs: DataFrame, chapters: DataFrame, tree: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document its chapters, sections and depth, with the chunk and document totals of its KB."""
    per_doc = docs.join(chapters.groupBy("document_id").agg(F.count("*").alias("chapters")), "document_id", "left").join(tree, "document_id", "left")
    chunk_docs = docs.join(chunks.groupBy("document_id").agg(F.count("*").alias("chunks")), "document_id", "left")
    totals = chunk_docs.groupBy("kb_id").agg(F.coalesce(F.sum("chunks"), F.lit(0)).alias("kb_chunks"), F.count("*").alias("kb_documents"))
    return per_doc.join(totals, "kb_id").select("kb_id", "document_id", "chapters", "sections", "depth", "kb_chunks", "kb_documents")


def recent(events: DataFrame, days: int, ts: str = "ts") -> DataFrame:
    """Events after the last event minus `days`."""
    last = events.agg(F.max(ts).alias("t")).select("t").scalar()
    return events.where(F.col(ts) > last - F.make_dt_interval(F.lit(days)))


def _ranked(counts: DataFrame, metric: str, key: str, k: int | None) -> DataFrame:
    rows = counts.select(F.lit(metric).alias("metric"), F.col(key).cast("string").alias("key"), F.col("count").cast("double").alias("value"))
    return rows.orderBy(F.desc("value"), "key").limit(k) if k else rows


def search_analytics(searches: DataFrame, days: int = 7, top: int = 10) -> DataFrame:
    """Totals, top queries, KB usage and search types as (metric, key, value) rows.

    `searches` has ts, query, kb_ids, results_count, search_type.
    """
    near = recent(searches, days).withColumn("query", F.trim(F.lower("query")))
    totals = near.agg(
        F.count("*").cast("double").alias("total_searches"), F.countDistinct("query").cast("double").alias("unique_queries"),
        F.coalesce(F.avg("results_count"), F.lit(0.0)).alias("avg_results"),
    )
    names = ["total_searches", "unique_queries", "avg_results"]
    flat = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).alias("value")) for n in names])).alias("r")).select("r.*")
    queries = _ranked(near.groupBy("query").count(), "query", "query", top)
    kbs = _ranked(near.select(F.explode("kb_ids").alias("kb_id")).groupBy("kb_id").count(), "kb", "kb_id", None)
    kinds = _ranked(near.groupBy(F.coalesce("search_type", F.lit("unknown")).alias("kind")).count(), "type", "kind", None)
    return union_all([flat, queries, kbs, kinds])


def view_analytics(views: DataFrame, days: int = 7, top: int = 10) -> DataFrame:
    """Total views, distinct documents and the most viewed ones. `views` has ts, document_id."""
    near = recent(views, days)
    totals = near.agg(F.count("*").cast("double").alias("total_views"), F.countDistinct("document_id").cast("double").alias("unique_documents"))
    flat = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.lit("").alias("key"), F.col(n).alias("value")) for n in totals.columns])).alias("r")).select("r.*")
    return union_all([flat, _ranked(near.groupBy("document_id").count(), "document", "document_id", top)])


def all_analytics(searches: DataFrame, views: DataFrame, kind: str = "all", days: int = 7) -> DataFrame:
    if kind not in ("search", "documents", "all"):
        raise ValueError(f"unknown analytics type: {kind}")
    parts = []
    if kind in ("search", "all"):
        parts.append(search_analytics(searches, days).withColumn("report", F.lit("search")))
    if kind in ("documents", "all"):
        parts.append(view_analytics(views, days).withColumn("report", F.lit("documents")))
    return union_all(parts)


COUNTERS = ["documents", "chapters", "chunks", "entities"]


def increment_stats(stats: DataFrame, deltas: DataFrame) -> DataFrame:
    """Counters of known KBs plus the sum of their signed deltas."""
    added = deltas.groupBy("kb_id").agg(*[F.sum(c).alias(f"_{c}") for c in COUNTERS])
    rows = stats.join(added, "kb_id", "left")
    return rows.select("kb_id", *[(F.coalesce(c, F.lit(0)) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in COUNTERS])


def kb_list(kbs: DataFrame, stats: DataFrame) -> DataFrame:
    rows = kbs.join(stats, "kb_id", "left")
    return rows.select(*kbs.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS])


def kb_entries(kbs: DataFrame, docs: DataFrame, k: int | None = None) -> DataFrame:
    """KB rows with title and author fallbacks; when there are none, the documents per KB: the first k,
    or all. Which it is, is part of the plan."""
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.lit("(untitled)"))
    author = F.coalesce(F.nullif(F.col("author"), F.lit("")), F.nullif(F.col("created_by"), F.lit("")), F.lit("Unknown"))
    entries = kbs.select("kb_id", title.alias("title"), author.alias("author"), F.coalesce("document_count", "doc_count").alias("document_count"))
    first = docs if k is None else top_k(docs, ["kb_id"], [F.col("document_id")], k)
    some = kbs.limit(1).select(F.lit(1).alias("_some"))
    only = first.withColumn("_some", F.lit(1)).join(F.broadcast(some), "_some", "left_anti")
    return entries.unionByName(only.select(
        "kb_id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.lit("(untitled)")).alias("title"),
        F.coalesce(F.nullif(F.col("author"), F.lit("")), F.lit("Unknown")).alias("author"), F.lit(None).cast("long").alias("document_count"),
    ))


def job_overview(jobs: DataFrame) -> DataFrame:
    """Jobs newest first with defaults for missing fields."""
    status = F.coalesce("status", F.lit("unknown"))
    return jobs.withColumn("status", status).withColumn("progress", F.coalesce("progress", F.lit(0))).orderBy(F.desc("created_at"), F.desc("job_id"))


def scan_check(pages: DataFrame, sample_pages: int = 5) -> DataFrame:
    """Per document: does its text layer look like a scan or a repeated stamp?

    `pages` has document_id, page (from 0), text, full_image. Pages from the middle are sampled;
    documents under ten pages use the five around their middle, which may repeat page 0.
    """
    from quire.functions.text import strip

    total = F.col("total_pages")
    counts = pages.groupBy("document_id").agg(F.count("*").cast("int").alias("total_pages"))
    start = F.floor(total / 10).cast("int")
    checked = F.least(F.lit(sample_pages), total)
    middle = F.greatest(start + 1, total - start) - start
    step = F.greatest(F.lit(1), F.floor(middle / sample_pages)).cast("int")
    mid = F.floor(total / 2).cast("int")
    few = F.transform(F.sequence(F.lit(0), F.least(F.lit(5), total) - 1), lambda i: F.greatest(F.lit(0), mid - 2 + i))
    many = F.transform(F.sequence(F.lit(0), checked - 1), lambda i: F.least(start + i * step, total - 1))
    sampled = counts.select("document_id", checked.alias("checked"), F.posexplode(F.when(total < 10, few).otherwise(many)).alias("i", "page"))
    body = sampled.join(pages, ["document_id", "page"]).withColumn("text", strip(F.col("text")))
    texts = F.array_sort(F.collect_list(F.struct("i", "text")))  # at most sample_pages per document
    merged = body.groupBy("document_id", "checked").agg(
        (F.sum(F.length("text")) / F.col("checked")).alias("avg_chars"), F.sum(F.col("full_image").cast("int")).alias("images"),
        F.array_join(F.transform(texts, lambda t: t["text"]), " ").alias("joined"),
    )
    phrases = F.filter(F.transform(F.split("joined", r"[.!?\n]+"), strip), lambda p: F.length(p) > 10)
    measured = merged.withColumn("_p", phrases)
    scanned = (F.col("avg_chars") < 100) | (F.col("images") >= F.col("checked") * 0.5)
    ratio = F.when(~scanned & (F.size("_p") > 0), F.size(F.array_distinct("_p")) / F.size("_p")).otherwise(1.0)
    return measured.select(
        "document_id", F.round("avg_chars", 6).alias("avg_chars"), "images", scanned.alias("needs_ocr"),
        F.round(ratio, 6).alias("uniqueness_ratio"), (ratio < 0.2).alias("is_repetitive"),
    )
