"""Queries for sources, scans, sinks and the streaming jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import model
from quire.model import SQL_MENTIONS, sql_chunks
from quire.operators.files import classify_files, extension, list_downloads
from quire.plans.hierarchy import _sql_cleaned
from quire.plans.registry import query
from quire.session import scratch_folder
from quire.sources import corpus as co
from quire.sources import files as fi
from quire.streaming import jobs


@query("src_documents", """
select doc_id as document_id, lang as kb_id, array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') as document_title, 1 as number,
  array_to_string(list_slice(string_split(text, ' '), 1, 3), ' ') as title, text, 1 as start_page from documents where doc_id % 9 <> 0
union all
select doc_id, lang, 'in chapters', i::int, 'Chapter ' || i, line, (i * 2)::int from (
  select doc_id, lang, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents where doc_id % 9 = 0)
where trim(line, E' \\n\\t') <> ''""")
def src_documents(t):
    base = t.documents.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("kb_id"), "text")
    title = F.array_join(F.slice(F.split("text", " "), 1, 3), " ")
    blank = base.withColumn("text", F.lit(" \n "))  # refused
    texts = co.text_documents(base.where("document_id % 9 <> 0").unionByName(blank).withColumn("title", title))

    def chapter(line, i):
        number = i + 1
        return F.struct(number.alias("number"), F.concat(F.lit("Chapter "), number.cast("string")).alias("title"), line.alias("text"), (number * 2).alias("start_page"))

    given = base.where("document_id % 9 = 0").select(
        "document_id", "kb_id", F.lit("in chapters").alias("title"), F.transform(F.split("text", "\n"), chapter).alias("chapters")
    )
    return co.chapter_rows(texts.unionByName(given))


# A file listing: the pages as files of many kinds.
EXTENSIONS = [".mp4", ".MP3", ".pdf", ".jpeg", ".txt", ".tar.gz", "", ".m4v", ".webp"]
SQL_LISTING = f"""listing as (
  select '/files/' || page_id % 7 || '/' || case page_id % 13 when 0 then '.hidden' when 1 then 'console-' when 2 then 'screenshot-' else 'File' end || page_id || {EXTENSIONS}[page_id % 9 + 1] as path,
    strlen(html) as length, page_id * 7919 % 1000003 as modified from pages)"""


def listing(t):
    i = F.col("page_id")
    head = F.when(i % 13 == 0, ".hidden").when(i % 13 == 1, "console-").when(i % 13 == 2, "screenshot-").otherwise("File")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (i % 9 + 1).cast("int"))
    path = F.concat(F.lit("/files/"), (i % 7).cast("string"), F.lit("/"), head, i.cast("string"), ext)
    return t.pages.select(path.alias("path"), F.octet_length("html").cast("long").alias("length"), F.timestamp_seconds(i * 7919 % 1000003).alias("modificationTime"))


@query("src_files_classify", f"""
with {SQL_LISTING},
seen as (select string_split(path, '/')[-1] as name, lower(regexp_extract(string_split(path, '/')[-1], '^.+?(\\.[^.]+)$', 1)) as ext, length from listing)
select case when ext in ('.mp4', '.mkv', '.webm', '.avi', '.mov', '.m4v') then 'video' when ext in ('.mp3', '.m4a', '.aac', '.m4b', '.wav', '.flac') then 'audio'
  when ext = '.pdf' then 'pdf' when ext in ('.jpg', '.jpeg', '.png', '.gif', '.webp') then 'image' else 'other' end as kind, count(*) as files, sum(length)::bigint as bytes
from seen where not starts_with(name, '.') group by 1""")
def src_files_classify(t):
    return classify_files(listing(t))


@query("src_downloads", f"""
with {SQL_LISTING}
select string_split(path, '/')[-1] as name, path, length, modified from listing
where not starts_with(string_split(path, '/')[-1], 'console-') and not starts_with(string_split(path, '/')[-1], 'screenshot-') and contains(lower(string_split(path, '/')[-1]), '.mp')""")
def src_downloads(t):
    return list_downloads(listing(t), "*.MP").select("name", "path", "length", F.unix_seconds("modificationTime").alias("modified"))


# An archive listing per document: a member per line, a folder and a resource fork.
def members(t):
    line = F.struct(
        F.concat(F.lit("lectures/part_"), F.col("i").cast("string"), F.when(F.col("i") % 2 == 1, ".mp4").otherwise(".txt")).alias("name"), F.octet_length("line").cast("long").alias("size")
    )
    archive = F.col("doc_id").cast("string").alias("archive")
    lines = t.documents.select(archive, F.posexplode(F.split("text", "\n")).alias("i", "line")).select("archive", (F.col("i") + 2).alias("position"), line.alias("m"))
    fixed = [F.struct(F.lit("lectures/").alias("name"), F.lit(0).cast("long").alias("size")), F.struct(F.lit("__MACOSX/x.mp4").alias("name"), F.lit(5).cast("long").alias("size"))]
    return lines.unionByName(t.documents.select(archive, F.posexplode(F.array(*fixed)).alias("position", "m"))).select("archive", "position", "m.*")


SQL_ARCHIVES = """lines as (
  select doc_id::varchar as archive, generate_subscripts(string_split(text, chr(10)), 1) - 1 as i, unnest(string_split(text, chr(10))) as line from documents),
members as (
  select archive, i + 2 as position, 'lectures/part_' || i || case when i % 2 = 1 then '.mp4' else '.txt' end as name, strlen(line) as size from lines
  union all select doc_id::varchar, 0, 'lectures/', 0 from documents union all select doc_id::varchar, 1, '__MACOSX/x.mp4', 5 from documents)"""


@query("src_zip_listing", f"""
with {SQL_ARCHIVES},
shown as (
  select *, not ends_with(name, '/') as is_file, row_number() over (partition by archive, ends_with(name, '/') order by position) as place,
    count(*) filter (not ends_with(name, '/')) over (partition by archive) as n from members)
select archive, count(*) filter (is_file) as files, sum(size)::bigint as bytes, count(*) filter (ends_with(name, '.mp4')) as videos,
  count(*) filter (is_file and not starts_with(name, '__MACOSX')) as extracted, count(*) filter (is_file) as previewed,
  max(name) filter (is_file and place = n) as last_previewed from shown group by archive""")
def src_zip_listing(t):
    listed = members(t)
    extracted = fi.extractable(listed).groupBy("archive").agg(F.count("*").alias("extracted"))
    preview = fi.archive_preview(listed).groupBy("archive").agg(F.count("*").alias("previewed"), F.max_by("name", "place").alias("last_previewed"))
    return fi.archive_info(listed).join(extracted, "archive", "left").join(preview, "archive", "left")


@query("src_source_type", """
with asked as (
  select doc_id, ['.pdf', '.MP3', '.mp4', '.zip', '.txt', '.m4v'][doc_id % 6 + 1] as ext, case when doc_id % 10 = 0 then 'library_pdf' else '' end as given,
    ['m4b', 'x, searchable_pdf ,knowledge_base', 'x,y', ''][doc_id % 4 + 1] as outputs from documents)
select doc_id, coalesce(nullif(given, ''), case lower(ext) when '.pdf' then 'upload' when '.mp3' then 'audio_upload' when '.mp4' then 'video_upload' when '.m4v' then 'video_upload' when '.zip' then 'archive_upload' else 'upload' end) as source_type,
  case doc_id % 4 when 1 then 'searchable_pdf|knowledge_base' else 'm4b' end as outputs from asked""")
def src_source_type(t):
    i = F.col("doc_id")
    ext = F.element_at(F.array(*map(F.lit, [".pdf", ".MP3", ".mp4", ".zip", ".txt", ".m4v"])), (i % 6 + 1).cast("int"))
    given = F.when(i % 10 == 0, "library_pdf").otherwise("")
    outputs = F.element_at(F.array(*map(F.lit, ["m4b", "x, searchable_pdf ,knowledge_base", "x,y", ""])), (i % 4 + 1).cast("int"))
    return t.documents.select("doc_id", co.source_type(ext, given).alias("source_type"), F.array_join(co.valid_outputs(outputs), "|").alias("outputs"))


def chunk_table(t):
    """The chunk table of the embedded chunks, written and ready to scan."""
    vectors = model.embedded_chunks(t)
    chunks = vectors.select(
        "kb_id", "document_id", "position", F.when(F.col("position") != 3, F.col("chunk_id")).alias("id"), F.concat(F.lit("text "), "chunk_id").alias("text"),
        F.when(F.col("position") == 1, 7).alias("page_number"), F.lit(2).alias("token_count"), F.when(F.col("position") < 2, "ch1").alias("chapter_id"),
    )
    path = scratch_folder(t.spark, "chunks")
    co.write_chunks(co.chunk_records(chunks, vectors.select("kb_id", "document_id", "position", F.col("vector").alias("embedding"))), path)
    return path


SQL_CHUNK_TABLE = """records as (
  select case when vec_id % 5 = 3 then vec_id // 5 || '_3' else vec_id::varchar end as id, label as kb_id, vec_id // 5 as document_id, case when vec_id % 5 < 2 then 'ch1' else '' end as chapter_id,
    'text ' || vec_id as text, case when vec_id % 5 = 1 then 7 else 0 end as page_number, (vec_id % 5)::int as position, 2 as token_count, len(embedding) as width from embeddings)"""


@query("sink_chunks", f"with {SQL_CHUNK_TABLE} select * from records")
def sink_chunks(t):
    rows = t.spark.read.parquet(chunk_table(t)).withColumn("width", F.size("embedding"))
    return rows.select("id", "kb_id", "document_id", "chapter_id", "text", "page_number", "position", "token_count", "width")


@query("scan_chunks_filtered", f"with {SQL_CHUNK_TABLE} select id, text, position from records where kb_id = 3 and chapter_id = 'ch1'")
def scan_chunks_filtered(t):
    return co.scan_chunks(t.spark, chunk_table(t), kb_id=3, chapter_id="ch1").select("id", "text", "position")


# Chapters are the lines of a document, chunked one by one; the text is put together again.
@query("scan_document_text", r"""
select lang as kb_id, doc_id as document_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: array_to_string(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''), ' ')), lambda x: x <> ''), ' ') as text from documents""")
def scan_document_text(t):
    from quire.operators.chunking import chunk_tokens

    lines = t.documents.select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chapter_no", "text"))
    chunks = chunk_tokens(lines, size=16, overlap=0)
    texts = co.document_text(chunks)
    # single blanks: a chunk that fits keeps the blanks of its line
    return texts.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


EXPORT_SCHEMAS = {
    "documents": "kb_id string, id long, title string, author string",
    "chunks": "kb_id string, id string, document_id long, text string, position int, embedding array<float>",
    "entities": "kb_id string, id string, name string, type string",
    "relationships": "kb_id string, source_id long, relationship_type string, target_id long",
}


def export_parts(t):
    mentions = model.document_mentions(t)
    docs = t.documents.select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("id"), F.col("text").alias("title"), F.col("source").alias("author"))
    cites = docs.select("kb_id", F.col("id").alias("source_id")).join(docs.select("kb_id", (F.col("id") - 4).alias("source_id"), F.col("id").alias("target_id")), ["kb_id", "source_id"])
    # the first chunk of a document has the vector of its number, if there is one
    vectors = t.embeddings.select(F.col("vec_id").alias("document_id"), F.lit(0).alias("position"), "embedding")
    chunks = model.document_chunks(t, 128, 16).join(vectors, ["document_id", "position"], "left").select("kb_id", F.col("chunk_id").alias("id"), "document_id", "text", "position", "embedding")
    return {
        "documents": docs, "chunks": chunks, "entities": mentions.select("kb_id", F.col("entity_id").alias("id"), "name", "type").distinct(),
        "relationships": cites.withColumn("relationship_type", F.lit("CITES")).select("kb_id", "source_id", "relationship_type", "target_id"),
    }


def exported(t, kb_id="en", embeddings=False):
    path = scratch_folder(t.spark, "export")
    co.write_export(kb_id, export_parts(t), path, embeddings)
    return path


def letters_embedder():
    """An embedder without a model: how many of some letters a text has."""
    return lambda texts: [[float(text.count(letter)) for letter in "aeiou"] for text in texts]


SQL_EXPORT = f"""{sql_chunks(128, 16)}, {SQL_MENTIONS},
rels as (select a.lang as kb_id, a.doc_id as source_id, b.doc_id as target_id from documents a join documents b on b.doc_id = a.doc_id + 4 and a.lang = b.lang)"""


@query("sink_export", f"""
with {SQL_EXPORT}
select 'documents' as kind, count(*) as n from documents where lang = 'en' union all select 'chunks', count(*) from chunks where kb_id = 'en'
union all select 'entities', count(distinct entity_id) from mentions where kb_id = 'en' union all select 'relationships', count(*) from rels where kb_id = 'en'
union all select 'vector components', sum(len(embedding)) from chunks join embeddings on vec_id = document_id where kb_id = 'en' and position = 0""")
def sink_export(t):
    path = exported(t, embeddings=True)
    chunks = co.read_export(t.spark, path, "chunks", EXPORT_SCHEMAS["chunks"])
    width = chunks.where("embedding is not null").agg(F.sum(F.size("embedding")).alias("n"))
    return co.export_summary(t.spark, path, EXPORT_SCHEMAS).unionByName(width.select(F.lit("vector components").alias("kind"), "n"))


# English is exported and imported into a KB that already has its entities with even names, under old ids; the vectors
# are made anew.
@query("src_import", f"""
with {SQL_EXPORT},
letters as (select *, list_transform(['a', 'e', 'i', 'o', 'u'], lambda c: length(text) - length(replace(text, c, ''))) as v from chunks where kb_id = 'en')
select 'document' as kind, 'copy' as kb_id, sha256('copy' || chr(1) || doc_id)[:12] as id, text as value from documents where lang = 'en'
union all select 'chunk', 'copy', sha256('copy' || chr(1) || document_id)[:12] || ':' || position, text from chunks where kb_id = 'en'
union all select 'vector', 'copy', sha256('copy' || chr(1) || document_id)[:12] || ':' || position, array_to_string(v, ',') from letters
union all select distinct 'entity', 'copy', sha256('copy' || chr(1) || entity_id)[:12], name from mentions where kb_id = 'en'
union all select 'entity', 'copy', 'old', 'kept' union all
select 'relationship', 'copy', sha256('copy' || chr(1) || source_id)[:12], sha256('copy' || chr(1) || target_id)[:12] from rels where kb_id = 'en'""")
def src_import(t):
    path = exported(t)
    entities = co.read_export(t.spark, path, "entities", EXPORT_SCHEMAS["entities"])
    before = entities.where("length(name) % 2 = 0").select(F.lit("copy").alias("kb_id"), F.lit("old").alias("id"), "name", "type")
    own = t.region.limit(1).select(F.lit("copy").alias("kb_id"), F.lit("old").alias("id"), F.lit("kept").alias("name"), F.lit("TERM").alias("type"))
    tables = co.import_kb(t.spark, path, EXPORT_SCHEMAS, "copy", {"entities": before.unionByName(own)}, letters_embedder, "letters")

    def rows(df, kind, ident, value):
        return df.select(F.lit(kind).alias("kind"), "kb_id", ident.alias("id"), value.alias("value"))

    place = F.concat_ws(":", "document_id", "position")
    vector = F.array_join(F.transform("embedding", lambda x: x.cast("int").cast("string")), ",")
    return (
        rows(tables["documents"], "document", F.col("id"), F.col("title")).unionByName(rows(tables["chunks"], "chunk", place, F.col("text")))
        .unionByName(rows(tables["chunks"], "vector", place, vector)).unionByName(rows(tables["entities"], "entity", F.col("id"), F.col("name")))
        .unionByName(rows(tables["relationships"], "relationship", F.col("source_id"), F.col("target_id")))
    )


# Search and view events appended by event type; all are kept.
@query("sink_event_log", """
select case when event_type in ('click', 'purchase') then 'search' else 'view' end as kind, event_id from events""")
def sink_event_log(t):
    kind = F.when(F.col("event_type").isin("click", "purchase"), "search").otherwise("view")
    stream = jobs.read_table(t.spark, t.folder, "events").select(kind.alias("kind"), "event_id", "ts")
    log = jobs.run_to_table(stream, "event_log")
    return co.keep_newest(log, ["kind"], [F.desc("ts"), F.desc("event_id")]).select("kind", "event_id")


# A snapshot of the event counts per type and hour; all hours stay.
@query("sink_stats_snapshot", """
with snaps as (select date_trunc('hour', ts) as hr, event_type as kb_id, count(*) as documents from events group by all)
select strftime(hr, '%Y-%m-%d %H:%M') as snapshot_at, kb_id, documents from snaps""")
def sink_stats_snapshot(t):
    counts = t.events.groupBy(F.date_trunc("hour", "ts").alias("snapshot_at"), F.col("event_type").alias("kb_id")).agg(F.count("*").alias("documents"))
    path = scratch_folder(t.spark, "snapshots")
    counts.write.mode("append").parquet(path)
    kept = co.keep_snapshots(t.spark.read.schema(counts.schema).parquet(path))
    return kept.select(F.date_format("snapshot_at", "yyyy-MM-dd HH:mm").alias("snapshot_at"), "kb_id", "documents")


def utc_text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


# Final windows only: those the watermark (last event minus a day) has passed. Searches are counted by
# query (event type), KB (the user's number) and search type.
@query("stream_search_analytics", """
with hits as (
  select ts, floor(value) as results, unnest([
    {'dimension': 'query', 'value': event_type}, {'dimension': 'kb_id', 'value': (user_id % 7)::varchar},
    {'dimension': 'type', 'value': case event_id % 3 when 0 then 'semantic' when 1 then 'keyword' else 'hybrid' end}]) as d from events),
daily as (
  select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as fin, d.dimension, d.value, count(*) as searches, avg(results) as avg_results from hits group by all),
weekly as (
  select start, start + interval 7 day as fin, d.dimension, d.value, count(*) as searches, avg(results) as avg_results
  from (select *, unnest(list_transform(range(7), lambda i: date_trunc('day', ts) - to_days(i::int))) as start from hits) group by all),
both_windows as (select 'day' as size, * from daily union all select 'week', * from weekly)
select size, strftime(start, '%Y-%m-%d %H:%M:%S') as start, dimension, value, searches, round(avg_results, 6) as avg_results from both_windows
where fin <= (select max(ts) from events) - interval 1 day""")
def stream_search_analytics(t):
    def windows(size, slide):
        events = jobs.read_table(t.spark, t.folder, "events")
        kind = F.element_at(F.array(F.lit("semantic"), F.lit("keyword"), F.lit("hybrid")), (F.col("event_id") % 3 + 1).cast("int"))
        hits = events.select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("query"), (F.col("user_id") % 7).alias("kb_id"), kind.alias("type"), F.floor("value").alias("results_count")
        )
        table = jobs.run_to_table(jobs.search_windows(hits, "1 day", size, slide, ("query", "kb_id", "type")), "search_windows")
        return table.select(utc_text("start").alias("start"), "dimension", "value", "searches", F.round("avg_results", 6).alias("avg_results"))

    return windows("1 day", None).withColumn("size", F.lit("day")).unionByName(windows("7 days", "1 day").withColumn("size", F.lit("week")))


@query("stream_ingest_chunks", f"""
with raw as (select doc_id, text from documents), {_sql_cleaned('raw', 'doc_id')},
tok as (select doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') as w from raw_c where text <> ''),
cut as (select *, unnest(range(case when len(w) <= 128 then 1 else ceil((len(w) - 128) / 112.0)::bigint + 1 end)) as i from tok)
select doc_id, i::int as position, case when len(w) <= 128 then text else array_to_string(list_slice(w, i * 112 + 1, least(i * 112 + 128, len(w))), ' ') end as text,
  least(128, len(w) - i * 112)::int as token_count from cut""")
def stream_ingest_chunks(t):
    path = scratch_folder(t.spark, "ingest")
    jobs.ingest_chunks(jobs.read_table(t.spark, t.folder, "documents").select(F.col("lang").alias("kb_id"), "doc_id", "text"), path, 128, 16)
    return jobs.ingested(t.spark, path).select("doc_id", "position", "text", "token_count")


@query("stream_action_state", """
with recursive reqs as (
  select user_id as action_id, event_id, case event_type when 'signup' then 'create' when 'view' then 'approve' when 'click' then 'reject' else 'execute' end as op, value < 60 as ok,
    row_number() over (partition by user_id order by event_id) as i from events),
walk as (
  select action_id, event_id, i, case when op = 'create' then 'pending' end as status, case when op = 'create' then 'pending' else '404' end as outcome from reqs where i = 1
  union all
  select action_id, event_id, i, coalesce(moved, status), coalesce(moved, case when status is null then '404' else '409' end) from (
    select r.action_id, r.event_id, r.i, w.status, case when w.status is null and r.op = 'create' then 'pending' when w.status = 'pending' and r.op = 'approve' then 'approved'
      when w.status = 'pending' and r.op = 'reject' then 'rejected' when w.status = 'approved' and r.op = 'execute' then case when r.ok then 'completed' else 'failed' end end as moved
    from walk w join reqs r on r.action_id = w.action_id and r.i = w.i + 1))
select action_id, event_id as seq, outcome from walk""")
def stream_action_state(t):
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "approve").when(F.col("event_type") == "click", "reject").otherwise("execute")
    asked = jobs.read_table(t.spark, t.folder, "events").select(
        F.col("user_id").alias("action_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("value") < 60).alias("ok")
    )
    store = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(store, None)
    t.spark.conf.set(store, jobs.ROCKSDB)
    try:
        return jobs.run_to_table(jobs.action_states(asked), "action_states")
    finally:
        t.spark.conf.set(store, before) if before else t.spark.conf.unset(store)


@query("stream_gap_chapters", """
with marked as (
  select user_id as recording, ts, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 20 hour then 0 else 1 end as opens from events),
numbered as (select *, sum(opens) over (partition by recording order by ts rows unbounded preceding) as n from marked)
select recording, strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, count(*) as segments from numbered group by recording, n
having max(ts) + interval 20 hour <= (select max(ts) from events) - interval 1 day""")
def stream_gap_chapters(t):
    events = jobs.read_table(t.spark, t.folder, "events").select(F.col("user_id").alias("recording"), F.col("ts").cast("timestamp").alias("ts"))
    table = jobs.run_to_table(jobs.gap_chapters(events, "20 hours"), "gap_chapters")
    return table.select("recording", utc_text("start").alias("start"), "segments")
