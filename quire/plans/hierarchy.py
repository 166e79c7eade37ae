"""Queries for section trees, chapters, courses and cascading deletes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import model
from quire.model import SQL_COURSES, SQL_LINKS, SQL_MENTIONS, SQL_ORDER_MENTIONS, SQL_PAGES, SQL_PAGE_SECTIONS, sql_bm25
from quire.operators import hierarchy as hi
from quire.operators.common import upsert
from quire.operators.entities import chunk_related_concepts, gazetteer_hits
from quire.operators.scoring import best_relevant
from quire.plans.registry import query
from quire.session import stored
from quire.plans.text import TRIM, sql_replace_all


@query("upsert_nodes", """
with new as (
  select c_custkey as id, c_name || ' (new)' as name, c_nationkey as nation, 2 as batch from customer where c_acctbal < 0
  union all select 10000000 + s_suppkey, s_name, s_nationkey, 2 from supplier
  union all select 10000000 + s_suppkey, s_name || ' again', s_nationkey, 3 from supplier where s_acctbal < 5000)
select id, name, nation from (
  select *, row_number() over (partition by id order by batch desc) as r from (select c_custkey as id, c_name as name, c_nationkey as nation, 1 as batch from customer union all select * from new)) where r = 1""")
def upsert_nodes(t):
    old = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.lit(1).alias("batch"))
    changed = t.customer.where("c_acctbal < 0").select(
        F.col("c_custkey").alias("id"), F.concat("c_name", F.lit(" (new)")).alias("name"), F.col("c_nationkey").alias("nation"), F.lit(2).alias("batch")
    )
    supplier = t.supplier.select(
        (F.lit(10000000) + F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(2).alias("batch"), "s_acctbal"
    )
    again = supplier.where("s_acctbal < 5000").withColumn("name", F.concat("name", F.lit(" again"))).withColumn("batch", F.lit(3))
    new = changed.unionByName(supplier.drop("s_acctbal")).unionByName(again.drop("s_acctbal"))
    return upsert(old, new, ["id"], [F.desc("batch")]).drop("batch")


@query("sections_from_tree", f'with {SQL_PAGE_SECTIONS} select document_id, section_id, parent_id, level, ord as "order", title, start_page, end_page from sections')
def sections_from_tree(t):
    return model.page_sections(t)


@query("link_chunks_to_sections", f"with {SQL_PAGE_SECTIONS}, {SQL_LINKS} select chunk_id, section_id from links")
def link_chunks_to_sections(t):
    return hi.link_chunks_to_sections(model.page_chunks(t), model.page_sections(t))


SQL_CHAPTERS = """chapters as (
  select document_id, segment as chapter_id, min(page) - 1 as start_page from page_rows group by all),
counts as (select document_id, count(*) as pages from page_rows group by all),
ranges as (select *, coalesce(lead(start_page) over (partition by document_id order by start_page), pages) - 1 as end_page from chapters join counts using (document_id))"""


def page_chapters(t):
    pages = model.page_rows(t)
    chapters = pages.groupBy("document_id", F.col("segment").alias("chapter_id")).agg((F.min("page") - 1).alias("start_page"))
    return chapters, pages.groupBy("document_id").agg(F.count("*").alias("pages"))


def _sql_clean(text: str) -> str:
    text = sql_replace_all(text, [
        (r"personal\s+use\s+only[,.]?\s*do\s+not\s+reproduce\.?", "", "gi"), (r"confidential[:\s]+[^.]*\.?", "", "gi"),
        (r"proprietary[:\s]+[^.]*\.?", "", "gi"), (r"\bdraft\b", "", "gi")])
    return text


# The pages hold none of the stamped phrases besides those deleted here; lines repeat, so copies are counted.
def _sql_cleaned(source: str, keys: str) -> str:
    lines = rf"""{source}_m as (select {keys}, {_sql_clean('text')} as text from {source}),
{source}_n as (select {keys}, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from {source}_m),
{source}_k as (select *, row_number() over (partition by {keys}, {TRIM.format('line')} order by pos) as copy from {source}_n),
{source}_d as (select {keys}, string_agg(line, chr(10) order by pos) as text from {source}_k where not (length({TRIM.format('line')}) between 11 and 79 and copy > 3) group by {keys}),
{source}_j as (select {keys}, {sql_replace_all('text', [
    (r'(?m)^\d+\s*$', '', 'g'), (r'\n{3,}', r'@@', 'g'), (r'([\w\p{L}])-\n([\w\p{L}])', r'\1\2', 'g')]).replace("'@@'", "chr(10) || chr(10)")} as text from {source}_d),
{source}_c as (select {keys}, {TRIM.format("regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_full_match(trim(x, E' \\t'), '[0-9]{1,3}')), chr(10)), '[ \\t]+', ' ', 'g'), ' +\\n', chr(10), 'g')")} as text from {source}_j)"""
    return lines


@query("chapter_ranges_text", f"""
with {SQL_PAGES}, {SQL_CHAPTERS},
texts as (
  select r.document_id, chapter_id, string_agg(text, chr(10) order by page) as text from ranges r join page_rows p on p.document_id = r.document_id and page - 1 between start_page and end_page group by all),
{_sql_cleaned('texts', 'document_id, chapter_id')}
select document_id, chapter_id, start_page, end_page, text from ranges join texts_c using (document_id, chapter_id)""")
def chapter_ranges_text(t):
    chapters, counts = page_chapters(t)
    pages = model.page_rows(t).select("document_id", (F.col("page") - 1).alias("page"), "text")
    return hi.chapter_texts(hi.chapter_ranges(chapters, counts), pages).select("document_id", "chapter_id", "start_page", "end_page", "text")


@query("sample_text", f"""
with {SQL_PAGES}
select document_id, string_agg('=== PAGE ' || page || ' ===' || chr(10) || text, chr(10) || chr(10) order by page) filter (page <= 25) as sample, count(*) as total_pages from page_rows group by document_id""")
def sample_text(t):
    return hi.sample_text(model.page_rows(t).select("document_id", "page", "text"))


@query("full_text", f"""
with {SQL_PAGES}, texts as (select document_id, string_agg(text, chr(10) order by page) as text from page_rows group by all),
{_sql_cleaned('texts', 'document_id')}
select document_id, text from texts_c""")
def full_text(t):
    from quire.functions.text import clean_text

    joined = hi.ordered_text(model.page_rows(t), ["document_id"], ["page"], "text", "\n")
    return joined.select("document_id", clean_text(F.col("text")).alias("text"))


# Scanned hosts are the blogs; recognised text exists for two pages of three.
@query("page_text_choice", f"""
with {SQL_PAGES}
select document_id, page, case when document_id like 'blog%' then case when page_id % 3 <> 0 then 'scan: ' || title else '' end
  when page_id % 2 = 0 then text || chr(10) || trim(title) || chr(10) || segment else text end as text from page_rows""")
def page_text_choice(t):
    rows = model.page_rows(t)
    notes = F.when(F.col("page_id") % 2 == 0, F.array("title", F.lit("  "), "segment")).otherwise(F.array().cast("array<string>"))
    pages = rows.select("document_id", "page", "text", notes.alias("annotations"), F.col("document_id").startswith("blog").alias("needs_ocr"))
    cache = rows.where("page_id % 3 <> 0").select("document_id", "page", F.concat(F.lit("scan: "), "title").alias("ocr_text"))
    return hi.page_text(pages, cache)


SQL_COUNTS = "counts as (select section_id, count(*) as chunk_count from links group by all)"


@query("section_tree", f"""
with {SQL_PAGE_SECTIONS}, {SQL_LINKS}, {SQL_COUNTS}
select document_id, section_id, case when level <= 1 then parent_id end as tree_parent, level, ord as "order", title, start_page, end_page, coalesce(chunk_count, 0) as chunk_count
from sections left join counts using (section_id)""")
def section_tree(t):
    sections = model.page_sections(t)
    return hi.section_tree(sections, hi.link_chunks_to_sections(model.page_chunks(t), sections), max_depth=1)


@query("section_content", f"""
with {SQL_PAGE_SECTIONS}, {SQL_LINKS}, {SQL_COUNTS}
select section_id, 'section' as kind, section_id as item_id, title, 0 as place, coalesce(chunk_count, 0) as chunk_count from sections left join counts using (section_id)
union all select parent_id, 'child', section_id, title, ord, null from sections where parent_id is not null
union all select section_id, 'chunk', chunk_id, text, position, null from links join page_chunks using (chunk_id)""")
def section_content(t):
    chunks = model.page_chunks(t)
    sections = model.page_sections(t)
    return hi.section_content(sections, hi.link_chunks_to_sections(chunks, sections), chunks.select("chunk_id", "text", "position"))


# Asked titles: the second word of every page title of the host.
@query("section_by_title", f"""
with {SQL_PAGE_SECTIONS},
asked as (select distinct document_id, replace(string_split(title, ' ')[2], 'e', 'E') as wanted from page_rows where string_split(title, ' ')[2] <> '')
select document_id, wanted, section_id, title from asked join sections using (document_id) where contains(lower(title), lower(wanted))
qualify row_number() over (partition by document_id, wanted order by level, ord, section_id) = 1""")
def section_by_title(t):
    word = F.replace(F.get(F.split("title", " "), F.lit(1)), F.lit("e"), F.lit("E"))
    asked = model.page_rows(t).select("document_id", word.alias("wanted")).where("wanted <> ''").distinct()
    return hi.section_by_title(model.page_sections(t), asked)


@query("breadcrumb_path", f"""
with {SQL_PAGE_SECTIONS}, {SQL_LINKS}
select chunk_id, concat_ws(' > ', c.title, b.title, a.title) as path from links join sections a using (section_id)
left join sections b on b.section_id = a.parent_id left join sections c on c.section_id = b.parent_id""")
def breadcrumb_path(t):
    sections = model.page_sections(t)
    paths = hi.breadcrumbs(sections, 3)
    links = hi.link_chunks_to_sections(model.page_chunks(t), sections)
    return links.join(paths, "section_id").select("chunk_id", F.array_join("path", " > ").alias("path"))


# Hits of the benchmark terms on page chunks; a section's names are all gazetteer words of its chunks.
@query("enrich_results", rf"""
with {SQL_PAGE_SECTIONS}, {SQL_LINKS}, {SQL_MENTIONS.split(',' + chr(10) + 'doc_words')[0]},
queries as (select item_id as query_id, text as query from benchmark), {sql_bm25('hits', 'page_chunks', 'chunk_id', 'text', 'queries')},
ranked as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from hits qualify rank <= 5),
names as (select distinct section_id, word as name from (
  select section_id, regexp_replace(lower(unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as word
  from links join page_chunks using (chunk_id)) join gaz using (word)),
related as (select section_id, string_agg(name, '|' order by name) as related from names group by all)
select query_id, rank, chunk_id, concat_ws(' > ', c.title, b.title, a.title) as path, related from ranked left join links using (chunk_id) left join sections a using (section_id)
left join sections b on b.section_id = a.parent_id left join sections c on c.section_id = b.parent_id left join related using (section_id)""")
def enrich_results(t):
    chunks, sections = stored(model.page_chunks(t), "chunks"), model.page_sections(t)
    links = stored(hi.link_chunks_to_sections(chunks, sections), "links")
    asked = t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = stored(best_relevant(chunks, ["chunk_id"], "text", asked, 5), "hits")
    named = gazetteer_hits(chunks.join(links, "chunk_id"), ["section_id"], model.gazetteer(t)).select("section_id", "name")
    # names are listed for the chunks that were hit, not for each chunk of a section
    concepts = chunk_related_concepts(named, links.join(hits.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    rows = hi.enrich_results(hits, links, hi.breadcrumbs(sections, 3), concepts)
    return rows.select("query_id", "rank", "chunk_id", F.array_join("path", " > ").alias("path"), F.array_join("related", "|").alias("related"))


@query("unique_id_check", """
with ids as (
  select 'topic' as label, 't:' || c_nationkey || ':' || c_mktsegment as id from customer union all select 'concept', 'k' || c_custkey from customer
  union all select 'chunk', l_orderkey || ':' || l_linenumber from lineitem)
select label, id, count(*) as copies from ids group by all having count(*) > 1""")
def unique_id_check(t):
    return hi.duplicate_ids({
        "topic": t.customer.select(F.concat_ws(":", F.lit("t"), "c_nationkey", "c_mktsegment").alias("id")),
        "concept": model.concepts(t).select("concept_id"),
        "chunk": t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id")),
    })


@query("tree_size_depth", f"with {SQL_PAGE_SECTIONS} select document_id, count(*) as sections, max(level) + 1 as depth from sections group by all")
def tree_size_depth(t):
    return hi.tree_size(model.page_sections(t))


# Only hosts with several languages have a stored tree; the others fall back to their chapters.
@query("browse_structure", f"""
with {SQL_PAGE_SECTIONS}, {SQL_LINKS}, {SQL_CHAPTERS}, treed as materialized (select document_id from chapters group by all having count(*) > 1),
shown as materialized (select s.* from sections s semi join treed using (document_id)),
linked as materialized (select section_id, count(*) as chunk_count from links group by all)
select document_id, section_id, parent_id as tree_parent, level, title, start_page, coalesce(chunk_count, 0) as chunk_count, 'graph' as source from shown left join linked using (section_id)
union all select document_id, chapter_id, null, 0, chapter_id, start_page, 0, 'registry' from chapters anti join treed using (document_id)""")
def browse_structure(t):
    chapters, _ = page_chapters(t)
    treed = chapters.groupBy("document_id").count().where("count > 1").select("document_id")
    sections = model.page_sections(t).join(treed, "document_id", "left_semi")
    tree = hi.section_tree(sections, hi.link_chunks_to_sections(model.page_chunks(t), sections))
    return hi.browse_structure(tree, chapters.withColumn("title", F.col("chapter_id")))


@query("get_document", rf"""
with {SQL_MENTIONS},
docs as (select doc_id as document_id, case when doc_id % 2 = 0 then 'registry' else 'graph' end as source, source as author from documents),
chapters as (select doc_id as document_id, string_agg(line, '|' order by n) as chapters from (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as n from documents) group by all),
names as (select document_id, string_agg(distinct name, '|' order by name) as entities from mentions group by all)
select document_id, source, author, chapters, entities from docs left join chapters using (document_id) left join names using (document_id)""")
def get_document(t):
    docs = t.documents.select(F.col("doc_id").alias("document_id"), F.col("source").alias("author"))
    chapters = t.documents.select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("number", "title"))
    return hi.get_document(docs.where("document_id % 2 = 0"), docs, chapters, model.document_mentions(t))


@query("course_structure", f"""
with {SQL_COURSES}, courses as (select 'c' || r_regionkey as course_id, r_name as course_title from region)
select course_id, course_title, m.module_id, m.title as module_title, m.ord as module_order, t.topic_id, t.title as topic_title, t.ord as topic_order,
  k.concept_id, k.title as concept_title, k.ord as concept_order
from courses left join modules m using (course_id) left join topics t using (module_id) left join concepts k using (topic_id)""")
def course_structure(t):
    courses = t.region.select(F.concat(F.lit("c"), F.col("r_regionkey").cast("string")).alias("course_id"), F.col("r_name").alias("course_title"))
    return hi.course_structure(courses, model.modules(t), model.topics(t), model.concepts(t))


@query("sequential_path", f"""
with {SQL_COURSES},
rows as (
  select course_id, 'module' as kind, module_id as id, title, ord as a, module_id as a2, null::int as b, null as b2, null::bigint as c, null as c2 from modules
  union all select course_id, 'topic', topic_id, t.title, m.ord, module_id, t.ord, topic_id, null, null from topics t join modules m using (module_id)
  union all select course_id, 'concept', concept_id, k.title, m.ord, module_id, t.ord, topic_id, k.ord, concept_id from concepts k join topics t using (topic_id) join modules m using (module_id))
select course_id, kind, id, title, row_number() over (partition by course_id order by a, a2, b nulls first, b2 nulls first, c nulls first, c2 nulls first) - 1 as position from rows""")
def sequential_path(t):
    return hi.sequential_path(model.modules(t), model.topics(t), model.concepts(t))


@query("module_follows", f"""
with {SQL_COURSES}
select course_id, lag(module_id) over (partition by course_id order by ord, module_id) as src, module_id as dst from modules qualify src is not null""")
def module_follows(t):
    return hi.module_follows(model.modules(t))


@query("concept_covers", """
select distinct concept_id, chunk_id from (
  select p_partkey as concept_id, unnest([p_partkey || ':1', p_size || ':2', p_size || ':99']) as chunk_id from part)
where chunk_id in (select l_orderkey || ':' || l_linenumber from lineitem)""")
def concept_covers(t):
    ids = F.array(F.concat(F.col("p_partkey").cast("string"), F.lit(":1")), F.concat(F.col("p_size").cast("string"), F.lit(":2")), F.concat(F.col("p_size").cast("string"), F.lit(":99")))
    chunks = t.lineitem.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("chunk_id"))
    return hi.concept_covers(t.part.select(F.col("p_partkey").alias("concept_id"), ids.alias("chunk_ids")), chunks).select("concept_id", "chunk_id")


# A course per customer nation and one without modules per supplier; modules are the segments.
@query("list_courses", """
select 'n' || c_nationkey as course_id, count(distinct c_mktsegment) as module_count, max(c_custkey) as created_at from customer group by all
union all select 's' || s_suppkey, 0, s_suppkey from supplier""")
def list_courses(t):
    nation = F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("course_id")
    courses = t.customer.groupBy(nation).agg(F.max("c_custkey").alias("created_at")).unionByName(
        t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("course_id"), F.col("s_suppkey").alias("created_at"))
    )
    return hi.list_courses(courses, t.customer.select(nation, F.col("c_mktsegment").alias("module_id")))


@query("kb_overview", f"""
with {SQL_PAGE_SECTIONS}, {SQL_CHAPTERS}, ch as (select document_id, count(*) as chapters from chapters group by all),
size as (select document_id, count(*) as sections, max(level) + 1 as depth from sections group by all),
kc as (select document_id, count(*) as chunks from page_chunks group by all),
per_doc as (select string_split(document_id, '.')[-1] as kb_id, document_id, chapters, sections, depth, coalesce(chunks, 0) as chunks from ch join size using (document_id) left join kc using (document_id))
select kb_id, document_id, chapters, sections, depth, (sum(chunks) over (partition by kb_id))::bigint as kb_chunks, count(*) over (partition by kb_id) as kb_documents from per_doc""")
def kb_overview(t):
    from quire.operators.analytics import kb_overview as overview

    chapters, _ = page_chapters(t)
    docs = chapters.select("document_id").distinct().withColumn("kb_id", F.substring_index("document_id", ".", -1))
    return overview(docs, chapters, hi.tree_size(model.page_sections(t)), model.page_chunks(t))


@query("delete_document_cascade", f"""
with {SQL_ORDER_MENTIONS}, gone as (select o_orderkey from orders where o_orderstatus in ('F', 'P')),
orphans as (select kb_id, entity_id from edges group by all having count(*) filter (document_id not in (select * from gone)) = 0)
select o_orderpriority as kb_id, 'documents' as kind, count(*) as deleted from orders where o_orderkey in (select * from gone) group by all
union all select kb_id, 'chapters', count(distinct chapter_id) from lines where document_id in (select * from gone) group by all
union all select kb_id, 'chunks', count(*) from lines where document_id in (select * from gone) group by all
union all select kb_id, 'entities', count(*) from orphans group by all
union all select kb_id, 'mentions left', count(*) from edges where document_id not in (select * from gone) group by all""")
def delete_document_cascade(t):
    mentions = model.order_mentions(t)
    docs = t.orders.select(F.col("o_orderpriority").alias("kb_id"), F.col("o_orderkey").alias("document_id"), "o_orderstatus")
    tables = {"documents": docs, "chapters": mentions.select("kb_id", "document_id", "chapter_id").distinct(), "chunks": mentions}
    left, counts = hi.delete_documents(tables, mentions, docs.where("o_orderstatus in ('F', 'P')"))
    remaining = left["mentions"].groupBy("kb_id").agg(F.count("*").alias("deleted")).withColumn("kind", F.lit("mentions left"))
    return counts.unionByName(remaining)


@query("delete_kb", """
with gone as (select lang from documents group by all having count(*) % 2 = 0 or min(doc_id) < 3)
select lang as kb_id, 'documents' as kind, count(*) as deleted from documents where lang in (select * from gone) group by all
union all select lang, 'paragraphs', sum(len(string_split(text, chr(10))))::bigint from documents where lang in (select * from gone) group by all
union all select lang, 'documents left', count(*) from documents where lang not in (select * from gone) group by all""")
def delete_kb(t):
    docs = t.documents.select(F.col("lang").alias("kb_id"), "doc_id", "text")
    doomed = docs.groupBy("kb_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first")).where("n % 2 = 0 or first < 3")
    tables = {"documents": docs.drop("text"), "paragraphs": docs.select("kb_id", F.explode(F.split("text", "\n")).alias("line"))}
    left, counts = hi.delete_rows(tables, "kb_id", doomed)
    remaining = left["documents"].groupBy("kb_id").agg(F.count("*").alias("deleted")).withColumn("kind", F.lit("documents left"))
    return counts.unionByName(remaining)


@query("delete_course_cascade", f"""
with {SQL_COURSES}
select course_id, 'modules' as kind, count(*) as deleted from modules where kb_id < 'AT' group by all
union all select course_id, 'topics', count(*) from topics join modules using (module_id) where kb_id < 'AT' group by all
union all select course_id, 'concepts', count(*) from concepts join topics using (topic_id) join modules using (module_id) where kb_id < 'AT' group by all""")
def delete_course_cascade(t):
    mods = model.modules(t)
    doomed = mods.where("kb_id < 'AT'").select("course_id").distinct()
    _, counts = hi.delete_rows(hi.with_course(mods, model.topics(t), model.concepts(t)), "course_id", doomed)
    return counts
