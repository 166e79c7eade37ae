"""Queries for vector, keyword, entity and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import model
from quire.model import SQL_DOCUMENTS, SQL_MENTIONS, SQL_QUERIES, sql_bm25, sql_chunks
from quire.operators import retrieval as rt
from quire.operators.fulltext import best_hits, bm25
from quire.operators.textindex import TextIndex
from quire.plans.registry import query
from quire.session import scratch_folder, stored

CHUNKS = sql_chunks(128, 16)
D2 = "round(pow(list_distance({0}::double[], {1}::double[]), 2), 6)"


INDEXES: dict[tuple[str, str], TextIndex] = {}


def chunk_index(t) -> TextIndex:
    """The text index of the chunks: written by the first query that asks for it, then read."""
    name = (t.spark.sparkContext.applicationId, t.folder)
    if name not in INDEXES:
        index = TextIndex(t.spark, scratch_folder(t.spark, "text-index"), ["chunk_id", "kb_id", "document_id", "source"])
        sources = t.documents.select(F.col("doc_id").alias("document_id"), "source")
        index.add(model.document_chunks(t, 128, 16).join(sources, "document_id"))
        INDEXES[name] = index
    return INDEXES[name]


# Every chunk asks for its neighbours inside its own KB.
@query("vector_search", f"""
with pairs as (
  select q.vec_id as query_id, c.vec_id::varchar as chunk_id, {D2.format('q.embedding', 'c.embedding')} as distance
  from embeddings q join embeddings c on q.label = c.label),
ranked as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from pairs)
select query_id, chunk_id, distance, round(1 / (1 + distance), 6) as score, rank from ranked where rank <= 10""")
def vector_search(t):
    chunks = model.embedded_chunks(t)
    asked = chunks.select(F.col("chunk_id").cast("long").alias("query_id"), "kb_id", "vector")
    hits = rt.vector_search(asked, chunks, 10, ["kb_id"])
    return hits.select("query_id", "chunk_id", "distance", F.round("score", 6).alias("score"), "rank")


@query("vector_search_multi_kb", f"""
with pairs as (
  select q.vec_id as query_id, c.vec_id::varchar as chunk_id, {D2.format('q.embedding', 'c.embedding')} as distance
  from embeddings q join embeddings c on c.label in (q.label, (q.label + 1) % 10, (q.label + 2) % 10)),
ranked as (select *, row_number() over (partition by query_id order by distance, chunk_id) as rank from pairs)
select query_id, chunk_id, distance, rank from ranked where rank <= 10""")
def vector_search_multi_kb(t):
    chunks = model.embedded_chunks(t)
    scope = F.array(*[((F.col("kb_id") + i) % 10).cast("int") for i in range(3)])
    asked = chunks.select(F.col("chunk_id").cast("long").alias("query_id"), scope.alias("kb_ids"), "vector")
    return rt.vector_search_scoped(asked, chunks, 10).select("query_id", "chunk_id", "distance", "rank")


@query("distance_to_score", """
select event_id, value - 5 as distance, case when value - 5 >= 0 then round(1 / (1 + value - 5), 6) else 0 end as score from events""")
def distance_to_score(t):
    distance = F.col("value") - 5
    return t.events.select("event_id", distance.alias("distance"), F.round(rt.distance_to_score(distance), 6).alias("score"))


@query("keyword_search", f"""
with {CHUNKS}, {SQL_QUERIES}, {SQL_DOCUMENTS}, {sql_bm25('hits', 'chunks', 'chunk_id, kb_id, document_id', 'text', 'queries')},
per_kb as (select *, row_number() over (partition by query_id, kb_id order by score desc, chunk_id) as r from hits),
ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from per_kb where r <= 10)
select query_id, chunk_id, h.kb_id, document_id, score, rank, title, author from ranked h left join docs using (document_id) where rank <= 10""")
def keyword_search(t):
    # one search over chunks as they come: an index pays from the second on
    hits = rt.keyword_search(model.document_chunks(t, 128, 16), model.queries(t), 10, model.documents(t))
    return hits.select("query_id", "chunk_id", "kb_id", "document_id", "score", "rank", "title", "author")


@query("fulltext_api", f"""
with {CHUNKS}, {SQL_QUERIES}, {sql_bm25('hits', 'chunks', 'chunk_id, document_id', 'text', 'queries')},
ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from hits)
select query_id, chunk_id, document_id, score, rank from ranked where rank <= 20""")
def fulltext_api(t):
    hits = rt.indexed_search(chunk_index(t), model.queries(t), 20)
    return hits.select("query_id", "chunk_id", "document_id", "score", "rank")


PARTS = "parts as (select p_partkey as entity_id, p_name as name, p_type as type, p_brand as kb_id, p_name || ' ' || p_brand || ' ' || p_type as label from part)"
BRAND_QUERIES = "queries as (select row_number() over (order by p_name) as query_id, p_name as query from (select distinct p_name from part))"


def parts(t):
    label = F.concat_ws(" ", "p_name", "p_brand", "p_type")
    return t.part.select(
        F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_brand").alias("kb_id"), label.alias("label")
    )


def name_queries(t):
    """One query per distinct part name."""
    return t.part.select(F.xxhash64("p_name").alias("query_id"), F.col("p_name").alias("query")).distinct()


@query("entity_search", f"""
with {PARTS}, {BRAND_QUERIES}, {sql_bm25('hits', 'parts', 'entity_id, kb_id, type', 'name', 'queries')},
ranked as (select *, row_number() over (partition by query_id, kb_id order by score desc, entity_id) as rank from hits where type = 'ECONOMY')
select query, kb_id, entity_id, score, rank from ranked join queries using (query_id) where rank <= 5
union all
select '*', kb_id, entity_id, 1.0, 0 from parts where type = 'ECONOMY'""")
def entity_search(t):
    asked = name_queries(t)
    scored = bm25(parts(t), ["entity_id", "kb_id", "type"], "name", asked).where("type = 'ECONOMY'")
    hits = best_hits(scored, ["query_id", "kb_id"], ["entity_id"], 5)
    listed = parts(t).where("type = 'ECONOMY'").select(
        F.lit("*").alias("query"), "kb_id", "entity_id", F.lit(1.0).alias("score"), F.lit(0).alias("rank")
    )
    return hits.join(asked, "query_id").select("query", "kb_id", "entity_id", "score", "rank").unionByName(listed)


@query("course_search", f"""
with {PARTS}, {BRAND_QUERIES}, {sql_bm25('hits', 'parts', 'entity_id', 'label', 'queries')},
ranked as (select *, row_number() over (partition by query_id order by score desc, entity_id) as rank from hits)
select query, entity_id as course_id, score, rank from ranked join queries using (query_id) where rank <= 10""")
def course_search(t):
    asked = name_queries(t)
    hits = best_hits(bm25(parts(t), ["entity_id"], "label", asked), ["query_id"], ["entity_id"], 10)
    return hits.join(asked, "query_id").select("query", F.col("entity_id").alias("course_id"), "score", "rank")


CONCEPTS = """concepts as (select c_custkey as concept_id, c_name as name, c_mktsegment || ' buyer of nation ' || c_nationkey as definition,
  c_nationkey as module_id, c_mktsegment as topic, c_name || ' ' || c_mktsegment || ' buyer of nation ' || c_nationkey as body from customer)"""


@query("concept_search", f"""
with {CONCEPTS}, queries as (select n_nationkey as query_id, 'building nation ' || n_nationkey as query from nation),
{sql_bm25('hits', 'concepts', 'concept_id', 'body', 'queries')},
ranked as (select *, row_number() over (partition by query_id order by score desc, concept_id) as rank from hits)
select query_id, concept_id, score, rank, topic as topic_title, n_name as module_title, r_name as course_title
from ranked join concepts using (concept_id) left join nation on module_id = n_nationkey left join region on n_regionkey = r_regionkey where rank <= 20""")
def concept_search(t):
    asked = t.nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.concat(F.lit("building nation "), F.col("n_nationkey").cast("string")).alias("query"))
    body = F.concat("c_name", F.lit(" "), "c_mktsegment", F.lit(" buyer of nation "), F.col("c_nationkey").cast("string"))
    concepts = t.customer.select(F.col("c_custkey").alias("concept_id"), body.alias("body"), F.col("c_mktsegment").alias("topic_title"), "c_nationkey")
    hits = best_hits(bm25(concepts, ["concept_id"], "body", asked), ["query_id"], ["concept_id"], 20)
    modules = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("module_title"), F.col("n_regionkey").alias("r_regionkey"))
    courses = t.region.select("r_regionkey", F.col("r_name").alias("course_title"))
    named = hits.join(concepts.drop("body"), "concept_id").join(modules, "c_nationkey", "left").join(courses, "r_regionkey", "left")
    return named.select("query_id", "concept_id", "score", "rank", "topic_title", "module_title", "course_title")


SQL_GRAPH = f"""ents as (select distinct kb_id, entity_id, name from mentions),
{sql_bm25('eh', 'ents', 'kb_id, entity_id, name', 'name', 'queries')},
er as (select *, row_number() over (partition by query_id, kb_id order by score desc, entity_id) as er from eh qualify er <= 10),
nq as (select distinct name as query_id, name as query from er),
{sql_bm25('nh', 'chunks', 'chunk_id, kb_id, document_id', 'text', 'nq')},
nr as (
  select e.kb_id, e.entity_id, chunk_id, document_id, score, row_number() over (partition by e.kb_id, e.entity_id order by score desc, chunk_id) as cr
  from (select distinct kb_id, entity_id, name from er) e join nh on nh.kb_id = e.kb_id and nh.query_id = e.name
  where exists (select 1 from mentions m where m.kb_id = e.kb_id and m.entity_id = e.entity_id and m.document_id = nh.document_id) qualify cr <= 5),
linked as (
  select er.query_id, er.kb_id, er.er, nr.chunk_id, nr.document_id, nr.score, nr.cr from er join nr on nr.kb_id = er.kb_id and nr.entity_id = er.entity_id),
once as (select *, row_number() over (partition by query_id, chunk_id order by kb_id, er, cr) as o from linked qualify o = 1),
graph as (select query_id, chunk_id, document_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from once)"""


def chunk_table(t):
    """The chunks as a table, for plans that read them several times."""
    return stored(model.document_chunks(t, 128, 16), "chunks")


def graph_hits(t, chunks, asked, k):
    mentions = stored(model.document_mentions(t), "mentions")
    entities = mentions.select("entity_id", "kb_id", "name").distinct()
    return rt.graph_search(asked, chunks, entities, mentions, k)


@query("graph_entity_search", f"""
with {CHUNKS}, {SQL_QUERIES}, {SQL_MENTIONS}, {SQL_GRAPH}
select query_id, chunk_id, document_id, score, rank from graph where rank <= 10""")
def graph_entity_search(t):
    return graph_hits(t, chunk_table(t), model.queries(t), 10).select("query_id", "chunk_id", "document_id", "score", "rank")


# Hybrid search: every document with a vector asks with its whole text and its vector; the
# vector belongs to the first chunk of the document.
def hybrid_queries(t):
    asked = t.documents.select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    return asked.join(t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), "query_id")


def semantic_hits(t, table, asked, k):
    vectors = t.embeddings.select(F.concat(F.col("vec_id").cast("string"), F.lit(":0")).alias("chunk_id"), F.col("embedding").alias("vector"))
    chunks = vectors.join(table.where("position = 0").select("chunk_id"), "chunk_id", "left_semi")
    return rt.vector_search(asked, chunks, k).select("query_id", "chunk_id", "score", "rank")


def with_key(chunks, hits):
    keys = chunks.select("chunk_id", rt.fusion_key(F.col("document_id"), F.col("chunk_id"), F.col("text")).alias("key"))
    return hits.join(keys, "chunk_id")


def keyword_hits(chunks, asked, k):
    return rt.keyword_search(chunks, asked.select("query_id", "query"), k)


SQL_HYBRID_QUERIES = f"""queries as (
  select doc_id as query_id, text as query, embedding as vector
  from documents join embeddings on vec_id = doc_id)"""
SQL_KEYS = "keys as (select chunk_id, document_id || ':' || chunk_id || ':' || md5(text)[:16] as key from chunks)"


def sql_semantic(queries: str, k: int, out: str = "semantic") -> str:
    return f"""{out}_p as (
  select query_id, vec_id || ':0' as chunk_id, {D2.format('vector', 'embedding')} as d from {queries} cross join embeddings
  where vec_id || ':0' in (select chunk_id from chunks)),
{out} as (select query_id, chunk_id, 1 / (1 + d) as score, row_number() over (partition by query_id order by d, chunk_id) as rank from {out}_p qualify rank <= {k})"""


def sql_keyword(queries: str, k: int, out: str = "keyword") -> str:
    return f"""{sql_bm25(out + '_h', 'chunks', 'chunk_id', 'text', queries)},
{out} as (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank from {out}_h qualify rank <= {k})"""


def sql_rrf(signals: dict[str, float], k: int, out: str = "fused") -> str:
    lists = " union all ".join(f"select '{s}' as signal, {w} as w, query_id, chunk_id, score, rank from {s}" for s, w in signals.items())
    return f"""{out}_l as (select * from ({lists}) join keys using (chunk_id)),
{out}_n as (select query_id, count(distinct signal) as n, min(signal) as one from {out}_l group by query_id),
{out}_f as (select query_id, key, round(case when any_value(n) = 1 and any_value(one) <> 'graph' then max(score) else sum(w / (60 + rank)) end, 9) as score
  from {out}_l join {out}_n using (query_id) group by query_id, key),
{out} as (select *, row_number() over (partition by query_id order by score desc, key) as rank from {out}_f qualify rank <= {k})"""


@query("rrf_fusion", f"""
with {CHUNKS}, {SQL_HYBRID_QUERIES}, {SQL_KEYS}, {SQL_MENTIONS}, {sql_semantic('queries', 30)}, {sql_keyword('queries', 30)},
{SQL_GRAPH.replace('graph as (select', 'graph_all as (select')}, graph as (select * from graph_all where rank <= 30),
{sql_rrf({'semantic': 0.5, 'keyword': 0.3, 'graph': 0.2}, 10)}, {SQL_DOCUMENTS}
select query_id, f.key, score, rank, c.document_id, c.position, d.title, d.author, c.text
from fused f join keys using (key) join chunks c on c.chunk_id = keys.chunk_id left join docs d on d.document_id = c.document_id""")
def rrf_fusion(t):
    asked, chunks = hybrid_queries(t), chunk_table(t)
    signals = {
        "semantic": with_key(chunks, semantic_hits(t, chunks, asked, 30)),
        "keyword": with_key(chunks, keyword_hits(chunks, asked, 30)),
        "graph": with_key(chunks, graph_hits(t, chunks, asked.select("query_id", "query"), 30)),
    }
    hits = rt.described(rt.rrf_fusion(signals, 10, rt.WEIGHTS_GRAPH, ["chunk_id"]), chunks, model.documents(t))
    return hits.select("query_id", "key", "score", "rank", "document_id", "position", "title", "author", "text")


SEARCH_TYPE = "case query_id % 5 when 0 then 'semantic' when 1 then 'keyword' when 2 then 'hybrid' when 3 then 'other' else 'hybrid' end"


def search_answers(t, k):
    chunks = chunk_table(t)
    asked = hybrid_queries(t).withColumn("search_type", F.expr(SEARCH_TYPE))
    blank = asked.withColumn("query", F.when(F.col("query_id") % 7 == 0, "  ").otherwise(F.col("query")))
    hits = rt.search(
        blank, lambda q, n: with_key(chunks, semantic_hits(t, chunks, q, n)), lambda q, n: with_key(chunks, keyword_hits(chunks, q, n)), k
    )
    return rt.described(hits, chunks, model.documents(t))


@query("search_dispatch", f"""
with {CHUNKS}, {SQL_HYBRID_QUERIES.replace('queries as', 'everyone as')}, {SQL_KEYS}, {SQL_DOCUMENTS},
queries as (select *, {SEARCH_TYPE} as search_type from everyone where query_id % 7 <> 0),
hybrids as (select * from queries where search_type in ('hybrid', 'other')),
sem as (select * from queries where search_type = 'semantic'), kw as (select * from queries where search_type = 'keyword'),
{sql_semantic('sem', 5, 's')}, {sql_keyword('kw', 5, 'w')}, {sql_semantic('hybrids', 15)}, {sql_keyword('hybrids', 15)},
{sql_rrf({'semantic': 0.6, 'keyword': 0.4}, 5)},
answers as (
  select query_id, key, chunk_id, round(score, 6) as score, rank from fused join keys using (key)
  union all select query_id, key, chunk_id, round(score, 6), rank from s join keys using (chunk_id)
  union all select query_id, key, chunk_id, round(score, 6), rank from w join keys using (chunk_id))
select query_id, key, score, rank, c.document_id, d.title, c.text from answers a join chunks c on c.chunk_id = a.chunk_id left join docs d on d.document_id = c.document_id""")
def search_dispatch(t):
    return search_answers(t, 5).select("query_id", "key", F.round("score", 6).alias("score"), "rank", "document_id", "title", "text")


@query("context_window", f"""
with {CHUNKS}
select h.chunk_id, case when c.position < h.position then 'before' else 'after' end as side, c.position, c.text as context
from chunks h join chunks c on c.document_id = h.document_id and c.position between h.position - 2 and h.position + 2 and c.position <> h.position""")
def context_window(t):
    chunks = chunk_table(t)
    return rt.context_window(chunks, chunks, 2, ["document_id"])


# A question is asked about the documents of one source; the source follows from the question's number.
SCOPED = 20


def rag_hits(t, k=5):
    """Keyword answers with their texts, among the documents of the asked source."""
    asked = model.queries(t).withColumn("source", F.concat(F.lit("src"), (F.col("query_id") % SCOPED).cast("string")))
    hits = rt.indexed_search(chunk_index(t), asked, k, scope="source")
    return hits.join(chunk_table(t).select("chunk_id", "text"), "chunk_id")


SQL_RAG = f"""{CHUNKS}, {SQL_QUERIES}, {sql_bm25('hits', 'chunks', 'chunk_id, document_id', 'text', 'queries')},
ranked as (
  select h.*, row_number() over (partition by query_id order by score desc, chunk_id) as ref
  from hits h join documents d on d.doc_id = h.document_id and d.source = 'src' || (query_id % {SCOPED}) qualify ref <= 5),
kept as (select query_id, chunk_id, r.document_id, score, text, ref from ranked r join chunks using (chunk_id))"""


@query("rag_context", f"""
with {SQL_RAG}
select query_id, string_agg('[' || ref || '] ' || text, chr(10) || chr(10) order by ref) as context, count(*) as chunks_retrieved from kept group by query_id""")
def rag_context(t):
    return rt.rag_context(rag_hits(t))


@query("rag_sources", f"""
with {SQL_RAG}
select query_id, '[' || ref || ']' as ref, document_id, case when length(text) > 200 then text[:200] || '...' else text end as text_preview, score from kept""")
def rag_sources(t):
    return rt.rag_sources(rag_hits(t)).select("query_id", "ref", "document_id", "text_preview", "score")


@query("chat_messages", f"""
with {CHUNKS}, lasts as (select conv_id, max(turn) as last from conversations where role = 'user' group by conv_id),
queries as (select c.conv_id as query_id, c.text as query from conversations c join lasts l on c.conv_id = l.conv_id and c.turn = l.last),
{sql_bm25('hits', 'chunks', 'chunk_id', 'text', 'queries')},
ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from hits qualify rank <= 3),
ctx as (select query_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) order by rank) as context from ranked join chunks using (chunk_id) group by query_id)
select conv_id as session_id, 0 as part, -1 as turn, 'system' as role,
  'You answer questions about "all" and cite sources like [1].' || chr(10) || chr(10) || 'Context:' || chr(10) || coalesce(context, 'No relevant context found.') as content
from lasts left join ctx on query_id = conv_id
union all
select c.conv_id, case when c.turn = last then 2 else 1 end, c.turn, c.role, c.text from conversations c join lasts l on c.conv_id = l.conv_id where c.turn <= last""")
def chat_messages(t):
    turns = t.conversations.withColumnRenamed("conv_id", "session_id")
    last = turns.where("role = 'user'").groupBy("session_id").agg(F.max_by("text", "turn").alias("text"))
    asked = last.select(F.col("session_id").alias("query_id"), F.col("text").alias("query"))
    chunks = chunk_table(t)
    hits = rt.indexed_search(chunk_index(t), asked, 3).join(chunks.select("chunk_id", "text"), "chunk_id")
    contexts = rt.rag_context(hits).select(F.col("query_id").alias("session_id"), F.lit("all").alias("kb_name"), "context")
    return rt.chat_messages(turns, contexts)
