"""Corpora as documents with chapters, the chunk table, exports and imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import is_blank
from quire.operators.common import union_all, upsert
from quire.operators.hierarchy import ordered_text
from quire.operators.library import new_id

# Source type by file extension, output names, format of an export.
SOURCE_TYPES = {
    ".pdf": "upload",
    ".mp3": "audio_upload",
    ".m4b": "audio_upload",
    ".m4a": "audio_upload",
    ".aac": "audio_upload",
    ".wav": "audio_upload",
    ".mp4": "video_upload",
    ".mkv": "video_upload",
    ".webm": "video_upload",
    ".avi": "video_upload",
    ".mov": "video_upload",
    ".m4v": "video_upload",
    ".zip": "archive_upload",
}
OUTPUTS = ["m4b", "searchable_pdf", "combined_pdf", "knowledge_base"]
FORMAT_VERSION = "1.0"


def text_documents(rows: DataFrame) -> DataFrame:
    """(document, chapter) rows of raw texts: one chapter from page 1 each; blank texts are refused."""
    kept = rows.where(~is_blank(F.col("text")))
    chapter = F.struct(F.lit(1).alias("number"), F.col("title").alias("title"), F.col("text").alias("text"), F.lit(1).alias("start_page"))
    return kept.withColumn("chapters", F.array(chapter)).drop("text")


def chapter_rows(docs: DataFrame) -> DataFrame:
    """One row per chapter with text, from documents with a `chapters` array."""
    keep = [c for c in docs.columns if c != "chapters"]
    rows = docs.select(*keep, F.inline("chapters")) if "title" not in keep else docs.withColumnRenamed("title", "document_title").select(
        *[("document_title" if c == "title" else c) for c in keep], F.inline("chapters")
    )
    return rows.where(~is_blank(F.col("text")))


def source_type(extension: Column, given: Column) -> Column:
    pairs = [F.lit(x) for pair in SOURCE_TYPES.items() for x in pair]
    return F.coalesce(F.nullif(given, F.lit("")), F.try_element_at(F.create_map(*pairs), F.lower(extension)), F.lit("upload"))


def valid_outputs(asked: Column, default: str = "m4b") -> Column:
    """The known output names in the order asked, or the default when none is left."""
    names = F.filter(F.transform(F.split(asked, ","), lambda o: F.trim(o)), lambda o: o.isin(OUTPUTS))
    return F.when(F.size(names) > 0, names).otherwise(F.array(F.lit(default)))


def chunk_records(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Rows of the chunk table: chunks with their vectors, nulls as '' or 0, ids filled in.

    Every chunk needs exactly one vector of the same width and every vector a chunk.
    """
    joined = chunks.join(vectors.withColumn("_v", F.lit(True)), ["kb_id", "document_id", "position"], "full")
    unmatched = F.col("_v").isNull() | F.col("text").isNull()
    checked = F.when(unmatched, F.raise_error(F.lit("chunks and vectors do not match")).cast("boolean")).otherwise(True)
    rows = joined.where(checked)

    def filled(name, default):
        return F.coalesce(F.col(name), F.lit(default)).alias(name) if name in chunks.columns else F.lit(default).alias(name)

    fallback = F.concat(F.col("document_id").cast("string"), F.lit("_"), F.col("position").cast("string"))
    ident = F.coalesce(F.col("id"), fallback) if "id" in chunks.columns else fallback
    return rows.select(
        ident.alias("id"), "kb_id", "document_id", filled("chapter_id", ""), "text", filled("page_number", 0), "position", filled("token_count", 0),
        filled("document_title", ""), filled("document_author", ""), filled("chapter_title", ""), "embedding",
    )


def write_chunks(records: DataFrame, path: str) -> None:
    """Append to the chunk table, one folder per KB. A hot KB is written by many tasks: the rows
    keep their partitioning, nothing is gathered per KB."""
    records.write.mode("append").partitionBy("kb_id").parquet(path)


def scan_chunks(spark: SparkSession, path: str, kb_id=None, document_id=None, chapter_id=None) -> DataFrame:
    """Chunks under AND-ed equality filters; kb_id prunes folders, the others reach the scan."""
    df = spark.read.parquet(path)
    for name, value in (("kb_id", kb_id), ("document_id", document_id), ("chapter_id", chapter_id)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def document_text(chunks: DataFrame) -> DataFrame:
    """Text of each document: its chunks by chapter and position, joined by blanks."""
    return ordered_text(chunks, ["kb_id", "document_id"], ["chapter_no", "position"], "text", " ")


def write_export(kb_id, parts: dict[str, DataFrame], path: str, embeddings: bool = False) -> None:
    """Export one KB as JSON lines, a folder per kind: documents, chunks, entities, relationships."""
    for kind, df in parts.items():
        kept = df.where(F.col("kb_id") == kb_id)
        if kind == "chunks" and not embeddings:
            kept = kept.drop("embedding")
        kept.withColumn("format_version", F.lit(FORMAT_VERSION)).write.mode("errorifexists").json(f"{path}/{kind}")


def export_summary(spark: SparkSession, path: str, schemas: dict[str, str]) -> DataFrame:
    counted = [spark.read.schema(s).json(f"{path}/{kind}").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind)) for kind, s in schemas.items()]
    return union_all(counted).select("kind", "n")


def read_export(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    """Rows of one kind; another format version is an error."""
    rows = spark.read.schema(f"{schema}, format_version string").json(f"{path}/{kind}")
    wrong = F.concat(F.lit("Unsupported export format: "), F.coalesce("format_version", F.lit("none")))
    known = F.when(F.col("format_version") == FORMAT_VERSION, True).otherwise(F.raise_error(wrong).cast("boolean"))
    return rows.where(known).drop("format_version")


def rename_import(rows: DataFrame, new_kb: str, columns: list[str]) -> DataFrame:
    """Rows moved into a new KB; ids in `columns` become new ids derived from the old ones."""
    moved = rows.withColumn("kb_id", F.lit(new_kb))
    for name in columns:
        moved = moved.withColumn(name, F.when(F.col(name).isNotNull(), new_id(F.lit(new_kb), F.col(name))))
    return moved


def merge_import(existing: DataFrame, imported: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `existing` with those of an import put in their place or added."""
    return upsert(existing, imported, keys)


# what tells the rows of each kind of an export apart inside a KB
IMPORT_KEYS = {"documents": ["kb_id", "id"], "chunks": ["kb_id", "document_id", "position"], "entities": ["kb_id", "name", "type"], "relationships": ["kb_id", "source_id", "relationship_type", "target_id"]}
# columns of each kind that hold ids which an import gives anew
IMPORT_IDS = {"documents": ["id"], "chunks": ["document_id"], "entities": ["id"], "relationships": ["source_id", "target_id"]}


def import_kb(
    spark: SparkSession, path: str, schemas: dict[str, str], new_kb: str, existing: dict[str, DataFrame] | None = None, make_embedder=None, embedder_name: str = "import",
) -> dict[str, DataFrame]:
    """The tables of an export as KB `new_kb`, with new ids.

    `existing` has tables of a KB to import into: rows with the same key give way, others stay. With
    `make_embedder` the chunks' vectors are made anew (`operators/embedding.py`), whether the export has
    any or not; without one they are as exported.
    """
    from quire.operators.embedding import embedded

    tables = {}
    for kind, schema in schemas.items():
        rows = rename_import(read_export(spark, path, kind, schema), new_kb, IMPORT_IDS[kind])
        if kind == "chunks" and make_embedder:
            rows = embedded(rows, make_embedder, embedder_name)
        before = (existing or {}).get(kind)
        tables[kind] = rows if before is None else merge_import(before, rows, IMPORT_KEYS[kind])
    return tables


def keep_newest(events: DataFrame, kinds: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """Retention of an event log: the newest k rows of each kind, or all."""
    if k is None:
        return events
    from quire.operators.common import top_k

    return top_k(events, kinds, order, k, "_r").drop("_r")


def keep_snapshots(snapshots: DataFrame, k: int | None = None) -> DataFrame:
    """Rows of the newest k snapshot times, or all."""
    if k is None:
        return snapshots
    times = snapshots.select("snapshot_at").distinct().orderBy(F.desc("snapshot_at")).limit(k)
    return snapshots.join(times, "snapshot_at", "left_semi")
