"""The knowledge-base model derived from the given tables; one function per model table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import words
from quire.operators.chunking import chunk_tokens
from quire.operators.common import dealt
from quire.session import stored


def documents(t) -> DataFrame:
    """Documents with kb = language, author = source and the first five words as title."""
    title = F.array_join(F.slice(words(F.col("text")), 1, 5), " ")
    return t.documents.select(
        F.col("doc_id").alias("document_id"),
        F.col("lang").alias("kb_id"),
        F.col("source").alias("author"),
        title.alias("title"),
        "text",
    )


def document_chunks(t, size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunks of the documents, with ids document:position."""
    base = t.documents.select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("document_id"), "text")
    chunks = chunk_tokens(base, size=size, overlap=overlap)
    return chunks.withColumn("chunk_id", F.concat_ws(":", "document_id", "position"))


def queries(t) -> DataFrame:
    """One query per benchmark item: its whole text."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# The same tables as SQL common table expressions, for the oracles.
SQL_WORDS = r"list_filter(string_split_regex({0}, '\s+'), lambda w: w <> '')"

SQL_DOCUMENTS = rf"""docs as (
  select doc_id as document_id, lang as kb_id, source as author,
         array_to_string(list_slice({SQL_WORDS.format('text')}, 1, 5), ' ') as title, text
  from documents)"""


def sql_chunks(size: int = 512, overlap: int = 50) -> str:
    step = size - overlap
    return rf"""tok as (
  select doc_id as document_id, lang as kb_id, text, {SQL_WORDS.format('text')} as w from documents
  where trim(text, E' \n\t') <> ''),
chunks as (
  select document_id, kb_id, i::int as position,
         case when len(w) <= {size} then text else array_to_string(list_slice(w, i*{step}+1, least(i*{step}+{size}, len(w))), ' ') end as text,
         least({size}, len(w) - i*{step})::int as token_count,
         document_id || ':' || i as chunk_id
  from (select *, unnest(range(case when len(w) <= {size} then 1 else ceil((len(w)-{size})/{step}.0)::bigint + 1 end)) as i from tok))"""


SQL_QUERIES = "queries as (select item_id as query_id, text as query from benchmark)"


def embedded_chunks(t) -> DataFrame:
    """Chunk vectors: kb = label, five chunks per document."""
    return t.embeddings.select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.col("label").alias("kb_id"),
        F.floor(F.col("vec_id") / 5).alias("document_id"),
        (F.col("vec_id") % 5).cast("int").alias("position"),
        F.col("embedding").alias("vector"),
    )


def gazetteer(t) -> DataFrame:
    """Names to look for: the longer words of the benchmark, each with a type and a score."""
    word = F.regexp_replace(F.lower(F.col("w")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    listed = t.benchmark.select(F.explode(words(F.col("text"))).alias("w")).select(word.alias("word"))
    kinds = ["CONCEPT", "TECHNIQUE", "TERM", "PERSON", "ORGANIZATION", "TOOL", "WORK"]
    return listed.where(F.length("word") >= 6).distinct().select(
        "word",
        F.element_at(F.array(*map(F.lit, kinds)), F.length("word") % 7 + 1).alias("type"),
        (F.length("word") % 10 / 10).alias("score"),
    )


SQL_GAZETTEER = rf"""gaz as (
  select distinct word, ['CONCEPT','TECHNIQUE','TERM','PERSON','ORGANIZATION','TOOL','WORK'][length(word) % 7 + 1] as type,
         (length(word) % 10) / 10.0::double as score from (
    select regexp_replace(lower(unnest({SQL_WORDS.format('text')})), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as word from benchmark)
  where length(word) >= 6)"""


def document_mentions(t) -> DataFrame:
    """Mentions (kb_id, document_id, entity_id, name, type) of gazetteer names scored at least 0.5."""
    from quire.operators.entities import gazetteer_hits

    docs = t.documents.select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("document_id"), "text")
    hits = gazetteer_hits(docs, ["kb_id", "document_id"], gazetteer(t)).where("score >= 0.5")
    return hits.select("kb_id", "document_id", F.concat_ws(":", "kb_id", "name").alias("entity_id"), "name", "type", "hits")


SQL_MENTIONS = SQL_GAZETTEER + rf""",
doc_words as (
  select kb_id, document_id, word, count(*) as hits, min(pos) as pos from (
    select lang as kb_id, doc_id as document_id, regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as word, pos from (
      select lang, doc_id, unnest({SQL_WORDS.format('text')}) as w, generate_subscripts({SQL_WORDS.format('text')}, 1) - 1 as pos from documents))
  where length(word) >= 2 group by all),
mentions as (
  select kb_id, document_id, kb_id || ':' || word as entity_id, word as name, type, hits from doc_words join gaz using (word) where score >= 0.5)"""


def sql_bm25(out: str, corpus: str, key: str, text: str, queries: str) -> str:
    """CTE `out`(query_id, key columns, score) of BM25 over a corpus CTE."""
    split = r"list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
    return rf"""{out}_d as (select {key}, {split.format(text)} as w from {corpus}),
{out}_s as (select count(*) filter (len(w) > 0) as n, sum(len(w)) / count(*) filter (len(w) > 0) as avgdl from {out}_d),
{out}_q as (select query_id, term, count(*) as qtf from (select query_id, unnest({split.format('query')}) as term from {queries}) group by all),
{out}_p as (select {key}, term, any_value(dl) as dl, count(*) as tf from (select {key}, len(w) as dl, unnest(w) as term from {out}_d)
  where term in (select term from {out}_q) group by {key}, term),
{out}_f as (select term, count(*) as df from {out}_p group by term),
{out} as (
  select query_id, {key}, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from {out}_p join {out}_f using (term) join {out}_q using (term) cross join {out}_s group by query_id, {key})"""


# The mention graph of orders and parts: document = order, entity = part, KB = order priority.
# Lines of a task at most, on the mean: a task that groups lines holds a row for nearly each of them.
TASK_LINES = 500_000


def line_tasks(t) -> int | None:
    """How many tasks the lines are dealt to; None for a table that needs no dealing. The count comes from
    the files' footers."""
    lines = t.lineitem.count()
    return max(t.spark.sparkContext.defaultParallelism, -(-lines // TASK_LINES)) if lines > 2 * TASK_LINES else None


def order_mentions(t) -> DataFrame:
    tasks = line_tasks(t)
    kb = t.orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("kb_id"))
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("document_id"), F.col("l_partkey").alias("entity_id"),
        "l_linenumber", "l_returnflag", "l_quantity", "l_tax",
    )
    # the join, and what is grouped by document after it, stay in these tasks
    joined = dealt(lines, tasks, "document_id").join(dealt(kb, tasks, "document_id"), "document_id")
    chapter = F.concat_ws(":", "document_id", "l_returnflag").alias("chapter_id")
    return joined.select("document_id", "entity_id", chapter, "l_linenumber", "l_returnflag", "l_quantity", "l_tax", "kb_id")


def with_parts(t, rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Rows with entity_id and the columns of their part (entity_id and others)."""
    tasks = line_tasks(t)
    return dealt(rows, tasks, "entity_id").join(dealt(parts, tasks, "entity_id"), "entity_id")


def part_entities(t) -> DataFrame:
    return t.part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"))


SQL_ORDER_MENTIONS = """lines as (
  select o_orderpriority as kb_id, l_orderkey as document_id, l_partkey as entity_id, l_orderkey || ':' || l_returnflag as chapter_id,
         l_linenumber, l_returnflag, l_quantity, l_tax from lineitem join orders on l_orderkey = o_orderkey),
edges as (select distinct kb_id, document_id, entity_id from lines)"""


# Courses: course = region, module = nation, topic = (nation, segment), concept = customer.
def modules(t) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("kb_id"), F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("course_id"),
        F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("module_id"), F.col("n_name").alias("title"),
        F.floor(F.col("n_nationkey") / 5).cast("int").alias("order"),
    )


def topics(t) -> DataFrame:
    segs = t.customer.select("c_nationkey", "c_mktsegment").distinct()
    order = F.ascii("c_mktsegment")
    return segs.select(
        F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("module_id"),
        F.concat_ws(":", F.lit("t"), "c_nationkey", "c_mktsegment").alias("topic_id"),
        F.col("c_mktsegment").alias("title"), order.alias("order"),
    )


def concepts(t) -> DataFrame:
    return t.customer.select(
        F.concat_ws(":", F.lit("t"), "c_nationkey", "c_mktsegment").alias("topic_id"),
        F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("concept_id"),
        F.col("c_name").alias("title"), F.col("c_custkey").alias("order"),
    )


SQL_COURSES = """modules as (
  select r_name as kb_id, 'c' || r_regionkey as course_id, 'm' || n_nationkey as module_id, n_name as title, n_nationkey // 5 as ord
  from nation join region on n_regionkey = r_regionkey),
topics as (
  select distinct 'm' || c_nationkey as module_id, 't:' || c_nationkey || ':' || c_mktsegment as topic_id, c_mktsegment as title, ascii(c_mktsegment) as ord from customer),
concepts as (
  select 't:' || c_nationkey || ':' || c_mktsegment as topic_id, 'k' || c_custkey as concept_id, c_name as title, c_custkey as ord from customer)"""


# Web pages as a document tree: document = host, level 1 = first path segment, level 2 = page.
def page_rows(t) -> DataFrame:
    """Pages with document, segment, 1-based page number inside the host, title and plain text."""
    from quire.operators.common import running_sum

    rows = t.pages.select(
        "page_id",
        F.regexp_extract("url", "://([^/?#]+)", 1).alias("document_id"),
        F.regexp_extract("url", "://[^/?#]+/([^/?#]+)", 1).alias("segment"),
        F.regexp_extract("html", "<h1>([^<]*)</h1>", 1).alias("title"),
        F.regexp_replace("html", "<[^>]*>", "\n").alias("text"),
        F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1)).alias("blocks"),
    )
    numbered = running_sum(rows, ["document_id"], ["segment", "page_id"], {"page": F.lit(1)})
    return numbered.withColumn("page", (F.col("page") + 1).cast("int"))


def page_sections(t) -> DataFrame:
    """Section tree rows with sibling order and end page."""
    from quire.operators.hierarchy import sections_from_tree

    pages = stored(page_rows(t).select("document_id", "segment", "page_id", "title", "page"), "pages")
    segment = F.concat_ws("/", "document_id", "segment")
    none = F.lit(None).cast("string")
    top = pages.groupBy("document_id").agg(F.min("page").alias("start_page")).select(
        "document_id", F.col("document_id").alias("section_id"), none.alias("parent_id"), F.lit(0).alias("level"), F.col("document_id").alias("title"), "start_page"
    )
    middle = pages.groupBy("document_id", "segment").agg(F.min("page").alias("start_page")).select(
        "document_id", segment.alias("section_id"), F.col("document_id").alias("parent_id"), F.lit(1).alias("level"), F.col("segment").alias("title"), "start_page"
    )
    leaves = pages.select(
        "document_id", F.concat_ws("/", "document_id", "segment", "page_id").alias("section_id"), segment.alias("parent_id"), F.lit(2).alias("level"),
        "title", F.col("page").alias("start_page"),
    )
    return stored(sections_from_tree(top.unionByName(middle).unionByName(leaves), 3), "sections")


def page_chunks(t) -> DataFrame:
    rows = page_rows(t).select("document_id", F.col("page").alias("page_number"), "page_id", F.posexplode("blocks").alias("position", "text"))
    return rows.withColumn("chunk_id", F.concat_ws(":", "page_id", "position"))


SQL_PAGES = r"""page_rows as (
  select page_id, regexp_extract(url, '://([^/?#]+)', 1) as document_id, regexp_extract(url, '://[^/?#]+/([^/?#]+)', 1) as segment,
    regexp_extract(html, '<h1>([^<]*)</h1>', 1) as title, regexp_replace(html, '<[^>]*>', chr(10), 'g') as text,
    regexp_extract_all(html, '<p>([^<]*)</p>', 1) as blocks,
    row_number() over (partition by regexp_extract(url, '://([^/?#]+)', 1) order by regexp_extract(url, '://[^/?#]+/([^/?#]+)', 1), page_id)::int as page from pages)"""

SQL_PAGE_SECTIONS = SQL_PAGES + """,
nodes as (
  select document_id, document_id as section_id, null::varchar as parent_id, 0 as level, document_id as title, min(page) as start_page from page_rows group by document_id
  union all select document_id, document_id || '/' || segment, document_id, 1, segment, min(page) from page_rows group by document_id, segment
  union all select document_id, document_id || '/' || segment || '/' || page_id, document_id || '/' || segment, 2, title, page from page_rows),
sibs as (
  select *, (row_number() over w - 1)::int as ord, lead(start_page) over w as nxt from nodes
  window w as (partition by document_id, coalesce(parent_id, '') order by start_page, section_id)),
sections as (
  select a.document_id, a.section_id, a.parent_id, a.level, a.ord, a.title, a.start_page, coalesce(a.nxt, b.nxt, c.nxt) as end_page
  from sibs a left join sibs b on b.section_id = a.parent_id left join sibs c on c.section_id = b.parent_id),
page_chunks as (
  select document_id, page as page_number, page_id, generate_subscripts(blocks, 1) - 1 as position, unnest(blocks) as text,
    page_id || ':' || (generate_subscripts(blocks, 1) - 1) as chunk_id from page_rows)"""

SQL_LINKS = """links as (
  select chunk_id, section_id from page_chunks k join sections s on s.document_id = k.document_id and s.start_page > 0 and s.start_page <= k.page_number
    and (s.end_page is null or k.page_number <= s.end_page)
  qualify row_number() over (partition by chunk_id order by start_page desc, level desc) = 1)"""


# Recordings: one per user, a segment per event; every signup speaks a chapter marker.
def segments(t) -> DataFrame:
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / 1000000
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_type") == "signup", F.concat(F.lit(" Chapter "), k, F.lit(" begins"))).otherwise(F.concat_ws(" ", "event_type", k))
    return t.events.select(
        F.col("user_id").alias("recording"), F.col("event_id").alias("seq"), start.alias("start"), (start + F.col("value")).alias("end"), text.alias("text")
    )


SQL_SEGMENTS = """segs as (
  select user_id as recording, event_id as seq, (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000000 as start,
    (epoch_us(ts) - epoch_us(timestamp '2024-01-01')) / 1000000 + value as fin,
    case when event_type = 'signup' then ' Chapter ' || json_extract_string(props, '$.k') || ' begins' else event_type || ' ' || json_extract_string(props, '$.k') end as text from events)"""
