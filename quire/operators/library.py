"""Library items, the KB registry and the document links between them.

An item keeps its outputs in a map name → struct(path, filename, kb_id, document_id) and its tags in
plain columns. Updates are tables, applied to all items at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import is_blank
from quire.operators.common import first_per_key, union_all, upsert
from quire.operators.fulltext import best_hits, bm25

# Settings of a new KB.
CHUNK_SIZE, CHUNK_OVERLAP = 512, 50

TAGS = ["organization", "course_code", "course_id", "module_id", "topic_ids", "custom_tags"]
OUTPUT_TYPE = "struct<path:string,filename:string,kb_id:string,document_id:string>"


def new_id(*parts: Column) -> Column:
    """Deterministic id of 12 characters, so that a rerun writes the same rows."""
    return F.substring(F.sha2(F.concat_ws("\x01", *[p.cast("string") for p in parts]), 256), 1, 12)


def kb_output(items_outputs: Column) -> Column:
    return F.try_element_at(items_outputs, F.lit("knowledge_base"))


def filter_library(items: DataFrame, has_kb: bool | None = None, topic_id: str | None = None, custom_tag: str | None = None, **equal: str) -> DataFrame:
    """Complete items passing the filters: organization and course_code without regard to case,
    course_id and module_id exactly, topic_id and custom_tag by membership, has_kb by either kb_id.

    Legacy items (a filename but no outputs) need all their legacy fields.
    """
    kept = items.where("id is not null and title is not null and author is not null and created_at is not null")
    for name in ("organization", "course_code"):
        if equal.get(name):
            kept = kept.where(F.lower(F.coalesce(name, F.lit(""))) == equal[name].lower())
    for name in ("course_id", "module_id"):
        if equal.get(name):
            kept = kept.where(F.col(name) == equal[name])
    if topic_id:
        kept = kept.where(F.array_contains("topic_ids", topic_id))
    if custom_tag:
        kept = kept.where(F.array_contains("custom_tags", custom_tag))
    if has_kb is not None:
        linked = ~is_blank(F.col("kb_id")) | ~is_blank(kb_output(F.col("output_files"))["kb_id"])
        kept = kept.where(linked == F.lit(has_kb))
    legacy = F.col("filename").isNotNull() & F.col("output_files").isNull()
    return kept.where(~legacy | F.col("legacy_complete"))


def filter_library_client(items: DataFrame, title: str = "", author: str = "", has_kb: bool | None = None) -> DataFrame:
    """Items by parts of title and author; has_kb needs a document_id in the KB output."""
    kept = items
    for name, part in (("title", title), ("author", author)):
        part = part.strip().lower()
        if part:
            kept = kept.where(F.lower(F.coalesce(name, F.lit(""))).contains(part))
    if has_kb is not None:
        linked = ~is_blank(kb_output(F.col("output_files"))["document_id"])
        kept = kept.where(linked == F.lit(has_kb))
    return kept


def facet_values(items: DataFrame) -> DataFrame:
    """Distinct organizations, course codes and custom tags as (facet, value), sorted."""
    own = F.array(F.struct(F.lit("organization").alias("facet"), F.col("organization").alias("value")), F.struct(F.lit("course_code").alias("facet"), F.col("course_code").alias("value")))
    tags = F.transform(F.coalesce("custom_tags", F.array().cast("array<string>")), lambda c: F.struct(F.lit("custom_tag").alias("facet"), c.alias("value")))
    return items.select(F.inline(F.concat(own, tags))).where("value <> ''").distinct().orderBy("facet", "value")


def upsert_outputs(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Items after output updates (id, title, author, output_type, output, seq): an output replaces
    the one of its name, a new id makes a new item, and `last_touched` puts changed items in front.
    """
    last = first_per_key(updates, ["id", "output_type"], [F.desc("seq")])
    fresh = last.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("output_type", "output"))).alias("_new"),  # one entry per output type
        F.max("seq").alias("_seq"),
    )
    first = updates.groupBy("id").agg(F.min_by(F.struct("title", "author"), "seq").alias("_first"))
    rows = items.join(fresh.join(first, "id"), "id", "full")
    none = F.create_map().cast(f"map<string,{OUTPUT_TYPE}>")
    old = F.map_filter(F.coalesce("output_files", none), lambda k, _: ~F.coalesce(F.map_contains_key(F.coalesce("_new", none), k), F.lit(False)))
    merged = F.map_concat(old, F.coalesce("_new", none))
    keep = [c for c in items.columns if c not in ("id", "title", "author", "output_files")]
    return rows.select(
        "id", F.coalesce("title", "_first.title").alias("title"), F.coalesce("author", "_first.author").alias("author"),
        F.when(F.col("_seq").isNull(), F.col("output_files")).otherwise(merged).alias("output_files"), F.col("_seq").alias("last_touched"), *keep,
    )


def add_by_filename(items: DataFrame, added: DataFrame) -> DataFrame:
    """Items plus new ones; an older item with the same filename goes. Items without one stay."""
    named = upsert(items.where("filename is not null"), added.where("filename is not null"), ["filename"], [F.desc("seq")])
    rest = union_all([df.where("filename is null") for df in (items, added)])
    return named.unionByName(rest, allowMissingColumns=True)


def patch(items: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Items with the given (non-null) fields of one change row per key."""
    given = changes.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    rows = items.join(given, key, "left")
    return rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in items.columns])


def patch_metadata(items: DataFrame, docs: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Title and author changes on items and on the documents linked to them."""
    fields = ["title", "author"]
    linked = items.where("kb_id is not null and document_id is not null").select("id", "kb_id", "document_id")
    carried = changes.join(linked, "id")
    once = first_per_key(carried, ["kb_id", "document_id"], [F.col("id")])
    given = once.select("kb_id", "document_id", *[F.col(f).alias(f"_{f}") for f in fields])
    rows = docs.join(given, ["kb_id", "document_id"], "left")
    patched = rows.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in docs.columns])
    return patch(items, changes, "id", fields), patched


def sync_tags(items: DataFrame, courses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items with their course id and CONTAINS_DOCUMENT edges from course, module and topics.

    A course code without a course id takes the best matching course of the KB, or a new id.
    `courses` has kb_id, course_id, title.
    """
    linked = items.where("kb_id is not null and document_id is not null")
    open_ = linked.where(~is_blank(F.col("course_code")) & is_blank(F.col("course_id")))
    codes = open_.select("kb_id", F.col("course_code").alias("query")).distinct().withColumn("query_id", F.xxhash64("kb_id", "query"))
    scored = bm25(courses, ["course_id", "kb_id"], "title", codes)
    in_kb = scored.join(codes.select("query_id", "kb_id"), ["query_id", "kb_id"], "left_semi")
    best = best_hits(in_kb, ["query_id"], ["course_id"], 1).join(codes.drop("kb_id"), "query_id")
    best = best.select("kb_id", F.col("query").alias("course_code"), F.col("course_id").alias("_best"))
    rows = linked.join(best, ["kb_id", "course_code"], "left")
    made = F.when(~is_blank(F.col("course_code")), new_id(F.lit("course"), F.col("kb_id"), F.col("course_code")))
    synced = rows.withColumn("course_id", F.coalesce(F.nullif(F.col("course_id"), F.lit("")), "_best", made)).drop("_best")
    ends = F.concat(
        F.array(F.struct(F.lit("course").alias("src_kind"), F.col("course_id").alias("src")), F.struct(F.lit("module").alias("src_kind"), F.col("module_id").alias("src"))),
        F.transform(F.coalesce("topic_ids", F.array().cast("array<string>")), lambda x: F.struct(F.lit("topic").alias("src_kind"), x.alias("src"))),
    )
    edges = synced.select("kb_id", "document_id", F.inline(ends)).where("src <> ''").distinct()
    return synced, edges


def delete_outputs(items: DataFrame, docs: DataFrame, doomed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Items without the doomed outputs (id, output_type) and documents without the ones they held.

    A KB output names its document by id, else by title and author. A legacy path counts as m4b.
    An item without any output left goes.
    """
    gone = doomed.groupBy("id").agg(F.collect_set("output_type").alias("_gone"))  # at most one entry per output type
    rows = items.join(gone, "id", "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<string>")))
    held = F.map_contains_key("output_files", "knowledge_base") & F.array_contains("_gone", "knowledge_base")
    kb = kb_output(F.col("output_files"))
    dropped = rows.where(F.coalesce(held, F.lit(False)) & ~is_blank(kb["kb_id"])).select(
        kb["kb_id"].alias("kb_id"), kb["document_id"].alias("document_id"), "title", "author"
    )
    by_id = docs.join(dropped.where("document_id is not null").select("kb_id", "document_id").distinct(), ["kb_id", "document_id"], "left_anti")
    by_name = dropped.where("document_id is null").select("kb_id", "title", "author").distinct()
    docs_left = by_id.join(by_name, ["kb_id", "title", "author"], "left_anti")
    legacy = F.array_contains("_gone", "m4b") & ~F.coalesce(F.map_contains_key("output_files", "m4b"), F.lit(False))
    left = rows.withColumn("path", F.when(~legacy, F.col("path"))).withColumn("filename", F.when(~legacy, F.col("filename"))).withColumn(
        "output_files", F.map_filter("output_files", lambda k, _: ~F.array_contains("_gone", k))
    )
    some = F.coalesce(F.size(F.map_keys("output_files")), F.lit(0)) > 0
    # items nobody asked to change stay as they are
    return left.where(some | F.col("path").isNotNull() | (F.size("_gone") == 0)).drop("_gone"), docs_left


def reingest(items: DataFrame, texts: DataFrame, chapters: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chapters to ingest again and the items with their new KB link.

    `requests` has id, kb_id; `texts` has id, text; `chapters` has id, number, title, text,
    start_page. An item without chapters gives its whole text as one chapter.
    """
    named = items.where(F.map_contains_key("output_files", "searchable_pdf")).join(
        requests.select("id", F.col("kb_id").alias("_kb")), "id"
    ).withColumn("_doc", new_id(F.lit("document"), F.col("_kb"), F.col("id")))
    whole = texts.join(chapters.select("id").distinct(), "id", "left_anti").join(items.select("id", "title"), "id").select(
        "id", F.lit(1).alias("number"), F.coalesce("title", F.lit("Full Document")).alias("title"), F.trim("text").alias("text"), F.lit(0).alias("start_page")
    )
    parts = chapters.select("id", "number", "title", "text", "start_page").unionByName(whole)
    rows = named.select("id", F.col("_kb").alias("kb_id"), F.col("_doc").alias("document_id")).join(parts, "id")
    link = F.struct(
        F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("filename"), F.col("_kb").alias("kb_id"), F.col("_doc").alias("document_id")
    )
    others = F.map_filter("output_files", lambda k, _: k != "knowledge_base")
    linked = named.withColumn("output_files", F.map_concat(others, F.create_map(F.lit("knowledge_base"), link))).drop("_kb", "_doc")
    kept = items.join(named.select("id"), "id", "left_anti")
    return rows, kept.unionByName(linked)


def orphans(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents no item links to, with the item whose id their source file starts with, if any.

    The lengths of item ids are few, so each file name is cut to them and joined by equality.
    """
    linked = union_all([
        items.select(F.col("document_id")), items.select(kb_output(F.col("output_files"))["document_id"].alias("document_id")),
    ]).where("document_id is not null").distinct()
    loose = docs.join(linked, "document_id", "left_anti")
    sizes = items.select(F.length("id").alias("size")).distinct()
    lengths = sizes.agg(F.array_sort(F.collect_set("size")).alias("sizes")).select("sizes").scalar()
    cut = loose.select("document_id", "source_file", F.explode(lengths).alias("size"))
    heads = cut.select("document_id", F.substring("source_file", F.lit(1), F.col("size")).alias("id")).distinct()
    matched = heads.join(items.select("id", "seq"), "id").groupBy("document_id").agg(F.min_by("id", F.struct("seq", "id")).alias("item_id"))
    return loose.join(matched, "document_id", "left").withColumn("orphan", F.col("item_id").isNull())


def media_lookup(asked: DataFrame, jobs: DataFrame, items: DataFrame) -> DataFrame:
    """File of each (id, output_type): of the completed job, else of the item, else the old single
    file for m4b; not found rows have a null path."""
    j = jobs.where("status = 'completed'").select("id", F.col("output_files").alias("_j"), F.col("output_file").alias("_jf"))
    i = items.select("id", F.col("output_files").alias("_i"), F.col("path").alias("_ip"))
    rows = asked.join(j, "id", "left").join(i, "id", "left")
    audio = F.col("output_type") == "m4b"
    path = F.coalesce(
        F.try_element_at("_j", F.col("output_type")), F.when(audio, F.col("_jf")), F.try_element_at("_i", F.col("output_type"))["path"], F.when(audio, F.col("_ip"))
    )
    return rows.select("id", "output_type", path.alias("path"))


def registry_upsert(kbs: DataFrame, changes: DataFrame, model: str) -> DataFrame:
    """KB rows after changes (name, description, settings); new KBs get the default settings.

    `changes` has kb_id, seq and nullable fields; the last given value of each field counts.
    """
    fields = ["name", "description", "chunk_size", "chunk_overlap", "embedding_model"]
    last = changes.groupBy("kb_id").agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f"_{f}") for f in fields])
    rows = kbs.join(last, "kb_id", "full")
    defaults = {"description": F.lit(""), "chunk_size": F.lit(CHUNK_SIZE), "chunk_overlap": F.lit(CHUNK_OVERLAP), "embedding_model": F.lit(model)}
    return rows.select("kb_id", *[F.coalesce(f"_{f}", f, defaults.get(f, F.lit(None))).alias(f) for f in fields])


def find_kb(docs: DataFrame, kb_order: DataFrame) -> DataFrame:
    """The first KB (by kb_order) that has each document."""
    return docs.join(kb_order, "kb_id").groupBy("document_id").agg(F.min_by("kb_id", F.struct("position", "kb_id")).alias("kb_id"))
