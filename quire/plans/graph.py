"""Queries for entities, mentions and the document graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import model
from quire.model import SQL_COURSES, SQL_GAZETTEER, SQL_MENTIONS, SQL_ORDER_MENTIONS, sql_bm25, sql_chunks
from quire.operators import entities as en
from quire.operators import graph as gr
from quire.operators.common import upsert
from quire.operators.files import containment_matches
from quire.operators.fulltext import best_hits, bm25
from quire.plans.registry import query
from quire.session import stored

SQL_INDICATORS = r"""(len(regexp_extract_all(x, '\b(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.)\s+[A-Z]'))
  + len(regexp_extract_all(x, '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b'))
  + len(regexp_extract_all(x, '(?i)\b(?:University|Institute|Corporation|Inc\.|Ltd\.)\b'))
  + len(regexp_extract_all(x, '(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b')))"""

# Every third document gets an opening full of names, so that the second extractor has work.
OPENING = "Dr. Roy of the University met Ms. Anna Lee, Prof. Max Born and Niels Bohr in March. "


def opened(t):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(OPENING), "text")).otherwise(F.col("text"))
    return t.documents.select(F.col("lang").alias("kb_id"), F.col("doc_id").alias("document_id"), text.alias("text"))


@query("extract_entities", rf"""
with {SQL_GAZETTEER},
texts as (select doc_id as document_id, case when doc_id % 3 = 0 then '{OPENING}' || text else text end as text from documents),
tokens as (select document_id, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as w from texts),
first as (
  select distinct document_id, word as name, type from (
    select document_id, regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as word from tokens) join gaz using (word) where score >= 0.6),
ascii as (select document_id, regexp_replace(text, '[^\x00-\x7f]', '0', 'g') as x, text from texts),
unsure as (
  select * from ascii where document_id not in (select document_id from first) and {SQL_INDICATORS} > 3),
second as (
  select distinct document_id, unnest(regexp_extract_all(x, '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b')) as name from unsure)
select document_id, name, type, 1 as list_no from first
union all select document_id, any_value(name), 'PERSON', 2 from second group by document_id, lower(name)""")
def extract_entities(t):
    texts = opened(t)
    key = ["document_id"]
    first = stored(en.gazetteer_hits(texts, key, model.gazetteer(t)), "entities")
    second = en.proper_names(texts, key)
    return en.extract_entities(texts.select("document_id", "text"), key, first, second, threshold=0.6).select("document_id", "name", "type", "list_no")


SQL_CHUNK_ENTITIES = rf"""{SQL_GAZETTEER}, {sql_chunks(128, 16)},
chunk_words as (select distinct kb_id, document_id, position, regexp_replace(lower(w), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g') as word from (
  select kb_id, document_id, position, unnest(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) as w from chunks)),
chunk_entities as (select kb_id, document_id, position, word as name, type from chunk_words join gaz using (word) where score >= 0.5)"""


def chunk_entities(t):
    hits = en.gazetteer_hits(model.document_chunks(t, 128, 16), ["kb_id", "document_id", "position"], model.gazetteer(t))
    return stored(hits, "entities").where("score >= 0.5").select("kb_id", "document_id", "position", "name", "type")


@query("extract_entities_batch", f"""
with {SQL_CHUNK_ENTITIES}
select * from chunk_entities qualify position = min(position) over (partition by kb_id, document_id, name)""")
def extract_entities_batch(t):
    return en.first_text_only(chunk_entities(t), ["kb_id", "document_id"], "position")


# List one: names of the first chunk; list two: the names of the other chunks in another case.
@query("merge_entity_lists", f"""
with {SQL_CHUNK_ENTITIES}
select document_id, name, type, 1 as list_no from chunk_entities where position = 0
union all
select document_id, replace(name, 'e', 'E'), any_value(type), 2 from chunk_entities c where position > 0
  and not exists (select 1 from chunk_entities o where o.position = 0 and o.document_id = c.document_id and o.name = c.name)
group by document_id, name""")
def merge_entity_lists(t):
    found = chunk_entities(t)
    two = found.where("position > 0").select("document_id", F.replace("name", F.lit("e"), F.lit("E")).alias("name"), "type", F.col("position").alias("pos"))
    return en.merge_entity_lists(found.where("position = 0"), two, ["document_id"])


@query("dedupe_entities", f"""
with {SQL_CHUNK_ENTITIES}
select kb_id, document_id, position, '  ' || replace(name, 'e', 'E') as name, type from chunk_entities c where position > 0
  and not exists (select 1 from chunk_entities o where o.position = 0 and o.kb_id = c.kb_id and o.name = c.name)""")
def dedupe_entities(t):
    found = chunk_entities(t)
    new = found.where("position > 0").withColumn("name", F.concat(F.lit("  "), F.replace("name", F.lit("e"), F.lit("E"))))
    return en.dedupe_entities(new, found.where("position = 0"), ["kb_id"])


@query("upsert_entities", f"""
with {SQL_ORDER_MENTIONS},
rows as (
  select kb_id, p_name as name, p_type as type, entity_id as id, 'brand ' || p_brand as description, document_id as first_seen_in,
    list_slice(string_split(p_name || ' ' || p_brand, ' '), 1, l_linenumber % 4) as aliases, document_id * 100 + l_linenumber * 10 + 0 as s0,
    row_number() over (partition by kb_id, p_name, p_type order by document_id, l_linenumber, entity_id) as seq
  from lines join part on p_partkey = entity_id),
ranked as (select *, row_number() over (partition by kb_id, name, type order by len(aliases) desc, seq) as longest from rows)
select kb_id, name, type, max(id) filter (seq = 1) as id, max(description) filter (seq = 1) as description, max(first_seen_in) filter (seq = 1) as first_seen_in,
  max(array_to_string(aliases, '|')) filter (longest = 1) as aliases from ranked group by kb_id, name, type""")
def upsert_entities(t):
    named = model.with_parts(t, model.order_mentions(t), t.part.withColumnRenamed("p_partkey", "entity_id"))
    aliases = F.slice(F.split(F.concat_ws(" ", "p_name", "p_brand"), " "), F.lit(1), F.col("l_linenumber") % 4)
    # a total order: document, line, entity
    seq = F.col("document_id").cast("decimal(38,0)") * 10**12 + F.col("l_linenumber") * 10**10 + F.col("entity_id")
    rows = named.select(
        "kb_id", F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("entity_id").alias("id"),
        F.concat(F.lit("brand "), "p_brand").alias("description"), F.col("document_id").alias("first_seen_in"), aliases.alias("aliases"), seq.alias("seq"),
    )
    return en.upsert_entities(rows).withColumn("aliases", F.array_join("aliases", "|"))


@query("mention_edges", f"""
with {SQL_ORDER_MENTIONS}
select kb_id, entity_id, 'document' as src_kind, document_id::varchar as src from edges
union all select distinct kb_id, entity_id, 'chapter', chapter_id from lines""")
def mention_edges(t):
    return en.mention_edges(model.order_mentions(t), model.line_tasks(t))


@query("document_entities", f"""
with {SQL_ORDER_MENTIONS}, counts as (select kb_id, entity_id, count(*) as mention_count from edges group by all)
select kb_id, document_id, entity_id, p_name as name, p_type as type, mention_count
from edges join counts using (kb_id, entity_id) join part on p_partkey = entity_id where p_type = 'ECONOMY'""")
def document_entities(t):
    edges = model.order_mentions(t).select("kb_id", "document_id", "entity_id").distinct()
    ents = edges.select("kb_id", "entity_id").distinct().join(model.part_entities(t), "entity_id")
    return en.document_entities(edges, ents, "ECONOMY").select("kb_id", "document_id", "entity_id", "name", "type", "mention_count")


@query("get_entities", f"""
with {SQL_ORDER_MENTIONS}
select distinct kb_id, p_name as name, p_type as type from edges join part on p_partkey = entity_id""")
def get_entities(t):
    edges = model.order_mentions(t).select("kb_id", "entity_id").distinct()
    return en.get_entities(edges.join(model.part_entities(t), "entity_id"))


SQL_ONE_HOP = """one as (
  select a.kb_id, a.document_id as d1, b.document_id as d2, count(*) as shared from edges a join edges b
  on a.kb_id = b.kb_id and a.entity_id = b.entity_id and a.document_id <> b.document_id group by all)"""


@query("related_shared_entity_1hop", f"""
with {SQL_ORDER_MENTIONS}, {SQL_ONE_HOP}
select kb_id, d1, d2, shared, row_number() over (partition by kb_id, d1 order by shared desc, d2) as rank from one qualify rank <= 20""")
def related_shared_entity_1hop(t):
    return gr.shared_entity_documents(model.order_mentions(t))


SQL_TWO_HOP = """two_all as (
  select kb_id, d1, d2, count(*) * 0.5::double as score from (
    select distinct a.kb_id, a.document_id as d1, d.document_id as d2, d.entity_id as e2
    from edges a join edges b on b.kb_id = a.kb_id and b.entity_id = a.entity_id and b.document_id <> a.document_id
    join edges c on c.kb_id = a.kb_id and c.document_id = b.document_id and c.entity_id <> a.entity_id
    join edges d on d.kb_id = a.kb_id and d.entity_id = c.entity_id and d.document_id <> a.document_id and d.document_id <> b.document_id) group by all),
two as (select *, row_number() over (partition by kb_id, d1 order by score desc, d2) as rank from two_all qualify rank <= 20)"""


@query("related_shared_entity_2hop", f"with {SQL_ORDER_MENTIONS}, {SQL_TWO_HOP} select kb_id, d1, d2, score, rank from two")
def related_shared_entity_2hop(t):
    return gr.two_hop_documents(model.order_mentions(t))


# Stored document edges: a returned part number names a cited order, an accepted one a similar order.
SQL_DOC_EDGES = """doc_edges as (
  select kb_id, src, dst, type, score from (
    select a.o_orderpriority as kb_id, b.o_orderpriority as kb2, l_orderkey as src, l_partkey as dst,
      case l_returnflag when 'R' then 'CITES' else 'SIMILAR_TO' end as type, case when l_tax > 0.04 then l_discount * 10 end as score
    from lineitem join orders a on a.o_orderkey = l_orderkey join orders b on b.o_orderkey = l_partkey where l_returnflag in ('R', 'A'))
  where kb_id = kb2),
neighbours as (
  select kb_id, d1, d2, lower(type) as relationship_type, max(case type when 'CITES' then 1.0 else coalesce(score, 0.5) end) as score from (
    select kb_id, src as d1, dst as d2, type, score from doc_edges union all select kb_id, dst, src, type, score from doc_edges)
  where d1 <> d2 group by all)"""


def doc_edges(t):
    kb = t.orders.select("o_orderkey", "o_orderpriority")
    lines = t.lineitem.where("l_returnflag in ('R', 'A')").select(
        F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"),
        F.when(F.col("l_returnflag") == "R", "CITES").otherwise("SIMILAR_TO").alias("type"),
        F.when(F.col("l_tax") > 0.04, F.col("l_discount") * 10).alias("score"),
    )
    near = lines.join(kb.select(F.col("o_orderkey").alias("src"), F.col("o_orderpriority").alias("kb_id")), "src")
    far = kb.select(F.col("o_orderkey").alias("dst"), F.col("o_orderpriority").alias("kb_id"))
    return near.join(far, ["dst", "kb_id"])


@query("related_edges", f"with {SQL_DOC_EDGES} select kb_id, d1, d2, relationship_type, score from neighbours")
def related_edges(t):
    return gr.edge_neighbours(doc_edges(t))


@query("related_documents", f"""
with {SQL_ORDER_MENTIONS}, {SQL_ONE_HOP}, {SQL_TWO_HOP}, {SQL_DOC_EDGES},
every as (
  select kb_id, d1, d2, 'shared_entity' as relationship_type, shared::double as score, 1 as hops, 0 as p from one
  union all select kb_id, d1, d2, 'shared_entity', score, 2, 0 from two
  union all select kb_id, d1, d2, relationship_type, score, 1, case relationship_type when 'cites' then 1 else 2 end from neighbours),
first as (select * from every qualify row_number() over (partition by kb_id, d1, d2 order by p, score desc, hops) = 1)
select kb_id, d1, d2, relationship_type, score, hops, row_number() over (partition by kb_id, d1 order by score desc, d2) as rank from first qualify rank <= 20""")
def related_documents(t):
    mentions = stored(model.order_mentions(t).select("kb_id", "document_id", "entity_id").distinct(), "mentions")
    neighbours = stored(gr.edge_neighbours(doc_edges(t)), "neighbours")
    one = gr.shared_entity_documents(mentions).select("kb_id", "d1", "d2", "shared")
    # a linked document that also shares entities counts as shared, wherever it ranks
    one = one.unionByName(gr.shared_counts(neighbours, mentions))
    return gr.related_documents(one, gr.two_hop_documents(mentions), neighbours)


@query("filter_relation_type", f"""
with {SQL_DOC_EDGES}
select kb_id, d1, d2, relationship_type, score, greatest(1, least(3, d1 % 6)) as hops from neighbours where relationship_type in ('cites')""")
def filter_relation_type(t):
    kept = gr.edge_neighbours(doc_edges(t)).where(F.col("relationship_type").isin("cites"))
    return kept.withColumn("hops", gr.clamp_hops(F.col("d1") % 6))


SQL_SECTIONS = """sections as (
  select document_id, kb_id, chapter_id as section_id, l_returnflag as title, ascii(l_returnflag) as start_page, count(*) as chunk_count from lines group by all)"""


def order_sections(t):
    rows = model.order_mentions(t).withColumn("start_page", F.ascii("l_returnflag"))
    return rows.groupBy("kb_id", "document_id", F.col("chapter_id").alias("section_id"), F.col("l_returnflag").alias("title"), "start_page").agg(
        F.count("*").alias("chunk_count")
    )


@query("entity_cross_references", f"""
with {SQL_ORDER_MENTIONS}, {SQL_SECTIONS}, names as (select distinct upper(p_name) as name from part),
hits as (select distinct kb_id, document_id, p_name as entity_name from edges join part on p_partkey = entity_id where lower(p_name) in (select lower(name) from names))
select kb_id, document_id, entity_name, o_orderstatus as document_title, title, chunk_count, start_page
from hits join orders on o_orderkey = document_id left join sections using (kb_id, document_id)""")
def entity_cross_references(t):
    mentions = model.order_mentions(t)
    edges = mentions.select("kb_id", "document_id", "entity_id").distinct()
    ents = edges.select("kb_id", "entity_id").distinct().join(model.part_entities(t), "entity_id")
    docs = t.orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("kb_id"), F.col("o_orderstatus").alias("document_title"))
    names = t.part.select(F.upper("p_name").alias("name"))
    refs = en.cross_references(edges, ents, docs, order_sections(t), names, model.line_tasks(t))
    return refs.select("kb_id", "document_id", "entity_name", "document_title", "title", "chunk_count", "start_page")


@query("chunk_related_concepts", f"""
with {SQL_ORDER_MENTIONS},
names as (select distinct chapter_id, p_name as name from lines join part on p_partkey = entity_id),
best as (select *, row_number() over (partition by chapter_id order by name) as place from names)
select document_id || ':' || l_linenumber || ':' || entity_id as chunk_id, name, place from lines join best using (chapter_id)""")
def chunk_related_concepts(t):
    rows = model.order_mentions(t).withColumnRenamed("chapter_id", "section_id")
    named = model.with_parts(t, rows.select("entity_id", "section_id"), model.part_entities(t)).select("section_id", "name")
    chunks = rows.select(F.concat_ws(":", "document_id", "l_linenumber", "entity_id").alias("chunk_id"), "section_id")
    return en.chunk_related_concepts(named, chunks, tasks=model.line_tasks(t))


@query("infer_related_concepts", f"""
with {SQL_ORDER_MENTIONS}, covers as (select distinct kb_id, chapter_id, entity_id from lines where l_returnflag <> 'R'),
known as (select distinct a.kb_id, a.entity_id as c1, b.entity_id as c2 from lines a join lines b on a.chapter_id = b.chapter_id and a.entity_id < b.entity_id where a.l_returnflag = 'R')
select distinct a.kb_id, a.entity_id as c1, b.entity_id as c2 from covers a join covers b on a.kb_id = b.kb_id and a.chapter_id = b.chapter_id and a.entity_id < b.entity_id
where not exists (select 1 from known k where k.kb_id = a.kb_id and k.c1 = a.entity_id and k.c2 = b.entity_id)""")
def infer_related_concepts(t):
    rows = model.order_mentions(t)
    covers = rows.select("kb_id", F.col("chapter_id").alias("chunk_id"), F.col("entity_id").alias("concept_id"), "l_returnflag").distinct()
    none = covers.select("kb_id", F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst")).where("false")
    returned = gr.co_covered(covers.where("l_returnflag = 'R'"), none)
    known = returned.select("kb_id", F.col("c2").alias("src"), F.col("c1").alias("dst"))
    return gr.co_covered(covers.where("l_returnflag <> 'R'"), known)


# Known prerequisites: a topic of a nation leads to the same topic of the next nation of its region.
def known_prerequisites(t):
    mods = model.modules(t)
    tops = model.topics(t).join(mods.select("module_id", "course_id", F.col("order").alias("m_order")), "module_id")
    nxt = tops.select("course_id", (F.col("m_order") - 1).alias("m_order"), "title", F.col("topic_id").alias("dst"))
    return tops.select("course_id", "m_order", "title", F.col("topic_id").alias("src")).join(nxt, ["course_id", "m_order", "title"]).select("src", "dst")


SQL_KNOWN_PREREQS = """known as (
  select a.topic_id as src, b.topic_id as dst from topics a join modules ma using (module_id) join modules mb on mb.course_id = ma.course_id and mb.ord = ma.ord + 1
  join topics b on b.module_id = mb.module_id and b.title = a.title)"""


@query("infer_prerequisites", f"""
with {SQL_COURSES}, {SQL_KNOWN_PREREQS}
select m1.kb_id, t1.topic_id as t1, t2.topic_id as t2, row_number() over (partition by m1.kb_id order by t1.topic_id, t2.topic_id) as rank
from modules m1 join modules m2 on m1.course_id = m2.course_id and m1.ord < m2.ord join topics t1 on t1.module_id = m1.module_id join topics t2 on t2.module_id = m2.module_id
where not exists (select 1 from known where src = t1.topic_id and dst = t2.topic_id)""")
def infer_prerequisites(t):
    return gr.inferred_prerequisites(model.modules(t), model.topics(t), known_prerequisites(t))


@query("prerequisites", f"""
with {SQL_COURSES}, {SQL_KNOWN_PREREQS}
select dst as topic_id, src as prereq_id, t.title as prereq_title, t.ord as topic_order, m.title as module_title, m.ord as module_number
from known join topics t on t.topic_id = src left join modules m using (module_id)""")
def prerequisites(t):
    rows = gr.prerequisites(known_prerequisites(t), model.topics(t), model.modules(t))
    return rows.select("topic_id", "prereq_id", "prereq_title", "topic_order", "module_title", "module_number").orderBy("module_number", "topic_order")


@query("add_edges", f"""
with {SQL_COURSES}, {SQL_KNOWN_PREREQS}
select src, 'PREREQUISITE_OF' as type, dst from known
union
select 't:' || c_nationkey || ':' || c_mktsegment, 'RELATED_TO', 'm' || c_nationkey from customer
union
select src, case when contains(src, 'MACH') then 'PREREQUISITE_OF' else 'EXTENDS' end, dst from known""")
def add_edges(t):
    known = known_prerequisites(t)
    old = known.withColumn("type", F.lit("PREREQUISITE_OF"))
    new = known.withColumn("type", F.when(F.col("src").contains("MACH"), "PREREQUISITE_OF").otherwise("EXTENDS")).unionByName(
        t.customer.select(
            F.concat_ws(":", F.lit("t"), "c_nationkey", "c_mktsegment").alias("src"),
            F.concat(F.lit("m"), F.col("c_nationkey").cast("string")).alias("dst"), F.lit("RELATED_TO").alias("type"),
        )
    )
    return gr.add_edges(old, new)


@query("graph_stats", f"""
with {SQL_ORDER_MENTIONS}, {SQL_COURSES},
kinds as (
  select o_orderpriority as kb_id, 'documents' as kind, count(*) as n from orders group by all
  union all select kb_id, 'chapters', count(distinct chapter_id) from lines group by all
  union all select kb_id, 'chunks', count(*) from lines group by all
  union all select kb_id, 'entities', count(distinct entity_id) from lines group by all
  union all select kb_id, 'relationships', count(*) from edges group by all
  union all select kb_id, 'courses', count(distinct course_id) from modules group by all
  union all select kb_id, 'modules', count(*) from modules group by all
  union all select kb_id, 'topics', count(*) from topics join modules using (module_id) group by all
  union all select kb_id, 'concepts', count(*) from concepts join topics using (topic_id) join modules using (module_id) group by all)
select kb_id, coalesce(sum(n) filter (kind = 'documents'), 0) as documents, coalesce(sum(n) filter (kind = 'chapters'), 0) as chapters,
  coalesce(sum(n) filter (kind = 'chunks'), 0) as chunks, coalesce(sum(n) filter (kind = 'entities'), 0) as entities,
  coalesce(sum(n) filter (kind = 'relationships'), 0) as relationships, coalesce(sum(n) filter (kind = 'courses'), 0) as courses,
  coalesce(sum(n) filter (kind = 'modules'), 0) as modules, coalesce(sum(n) filter (kind = 'topics'), 0) as topics,
  coalesce(sum(n) filter (kind = 'concepts'), 0) as concepts, coalesce(sum(n) filter (kind in ('documents', 'courses')), 0) > 0 as exists from kinds group by kb_id""")
def graph_stats(t):
    from quire.operators.analytics import graph_stats as stats

    mentions, mods = model.order_mentions(t), model.modules(t)
    tops = model.topics(t).join(mods.select("module_id", "kb_id"), "module_id")
    nodes = {
        "documents": t.orders.select(F.col("o_orderpriority").alias("kb_id")),
        "chapters": mentions.select("kb_id", "chapter_id").distinct(),
        "chunks": mentions,
        "entities": mentions.select("kb_id", "entity_id").distinct(),
        "courses": mods.select("kb_id", "course_id").distinct(),
        "modules": mods,
        "topics": tops,
        "concepts": model.concepts(t).join(tops.select("topic_id", "kb_id"), "topic_id"),
    }
    return stats(nodes, mentions.select("kb_id", "document_id", "entity_id").distinct())


def course_edges(t):
    mods, tops, cons = model.modules(t), model.topics(t), model.concepts(t)
    follows = mods.select("course_id", F.col("order").alias("o"), F.col("module_id").alias("src")).join(
        mods.select("course_id", (F.col("order") - 1).alias("o"), F.col("module_id").alias("dst")), ["course_id", "o"]
    )
    parts = [
        mods.select(F.col("course_id").alias("src"), F.col("module_id").alias("dst")), follows.select("src", "dst"),
        tops.select(F.col("module_id").alias("src"), F.col("topic_id").alias("dst")),
        cons.select(F.col("topic_id").alias("src"), F.col("concept_id").alias("dst")),
    ]
    from quire.operators.common import union_all

    return union_all(parts)


# Requests: from the first customer of a nation to the last one of the nation after next in its region.
@query("learning_path", f"""
with recursive {SQL_COURSES},
requests as (
  select a.c_nationkey as request, min(a.c_name) as from_name, (select max(b.c_name) from customer b where b.c_nationkey = (a.c_nationkey + 10) % 25) as to_name
  from customer a group by all),
one_way as (
  select course_id as src, module_id as dst from modules union all select module_id, topic_id from topics union all select topic_id, concept_id from concepts
  union all select a.module_id, b.module_id from modules a join modules b on a.course_id = b.course_id and b.ord = a.ord + 1),
links as (select src, dst from one_way union select dst, src from one_way),
walk as (
  select request, concept_id as node, [concept_id] as path, to_name from requests join concepts on contains(lower(title), lower(from_name))
  union all
  select request, dst, list_append(path, dst), to_name from walk join links on src = node where len(path) <= 6 and not list_contains(path, dst)
    and (dst[1] <> 'k' or dst in (select concept_id from concepts where contains(lower(title), lower(to_name))))),
best as (
  select request, path from walk join concepts c on c.concept_id = node and contains(lower(c.title), lower(to_name))
  qualify row_number() over (partition by request order by len(path), path) = 1)
select request, unnest(path) as node, (generate_subscripts(path, 1) - 1)::int as hop from best""")
def learning_path(t):
    names = t.customer.select("c_nationkey", "c_name")
    ends = names.groupBy("c_nationkey").agg(F.min("c_name").alias("first"), F.max("c_name").alias("last"))
    asked = ends.select(F.col("c_nationkey").alias("request"), F.lower("first").alias("from_name"), ((F.col("c_nationkey") + 10) % 25).alias("far")).join(
        ends.select(F.col("c_nationkey").alias("far"), F.lower("last").alias("to_name")), "far"
    )
    titled = model.concepts(t).select("concept_id", F.lower("title").alias("title"))
    starts = containment_matches(asked.select("request", "from_name"), titled, [], "from_name", "title").select("request", F.col("concept_id").alias("start"))
    finish = containment_matches(asked.select("request", "to_name"), titled, [], "to_name", "title").select("request", F.col("concept_id").alias("end"))
    return gr.shortest_paths(starts.join(finish, "request"), course_edges(t))


@query("kb_dependency_closure", """
with recursive deps as (
  select 's' || s_suppkey as src, 'n' || s_nationkey as dst from supplier union all select 'n' || n_nationkey, 'n' || n_regionkey from nation
  union all select 'n' || r_regionkey, 'n' || (r_regionkey + 1) % 5 from region where r_regionkey < 3),
walk as (select 's' || s_suppkey as request, 's' || s_suppkey as node from supplier union select request, dst from walk join deps on src = node)
select request, node from walk""")
def kb_dependency_closure(t):
    def name(prefix, column):
        return F.concat(F.lit(prefix), column.cast("string"))

    deps = (
        t.supplier.select(name("s", F.col("s_suppkey")).alias("src"), name("n", F.col("s_nationkey")).alias("dst"))
        .unionByName(t.nation.select(name("n", F.col("n_nationkey")).alias("src"), name("n", F.col("n_regionkey")).alias("dst")))
        .unionByName(t.region.where("r_regionkey < 3").select(name("n", F.col("r_regionkey")).alias("src"), name("n", (F.col("r_regionkey") + 1) % 5).alias("dst")))
    )
    kb = name("s", F.col("s_suppkey"))
    return gr.closure(t.supplier.select(kb.alias("request"), kb.alias("node")), deps)


@query("explore_concepts", f"""
with {SQL_ORDER_MENTIONS}, {SQL_SECTIONS}, queries as (select row_number() over (order by w) as query_id, w as query from (select distinct string_split(p_name, ' ')[1] as w from part)),
ents as (select distinct kb_id, entity_id, p_name as name from edges join part on p_partkey = entity_id),
{sql_bm25('hits', 'ents', 'kb_id, entity_id, name', 'name', 'queries')},
per_kb as (select *, row_number() over (partition by query_id, kb_id order by score desc, entity_id) as r from hits qualify r <= 20),
named as (select * from per_kb qualify row_number() over (partition by query_id, name order by kb_id, r) = 1),
best as (select *, row_number() over (partition by query_id order by score desc, kb_id, entity_id) as rank from named qualify rank <= 5),
docs as (select distinct m.kb_id, document_id, p_name as name from edges m join part on p_partkey = entity_id)
select query, b.name, b.kb_id, b.score, b.rank, d.document_id, s.title, s.chunk_count
from best b join queries using (query_id) left join docs d on d.kb_id = b.kb_id and lower(d.name) = lower(b.name) left join sections s on s.kb_id = d.kb_id and s.document_id = d.document_id""")
def explore_concepts(t):
    from quire.operators.common import first_per_key

    mentions = model.order_mentions(t)
    edges = mentions.select("kb_id", "document_id", "entity_id").distinct()
    ents = edges.select("kb_id", "entity_id").distinct().join(model.part_entities(t), "entity_id")
    asked = t.part.select(F.split("p_name", " ")[0].alias("query")).distinct().select(F.xxhash64("query").alias("query_id"), "query")
    hits = best_hits(bm25(ents, ["entity_id", "kb_id", "name"], "name", asked), ["query_id", "kb_id"], ["entity_id"], 20)
    once = first_per_key(hits, ["query_id", "name"], [F.col("kb_id"), F.col("rank")]).drop("rank")
    best = best_hits(once, ["query_id"], ["kb_id", "entity_id"], 5).join(asked, "query_id").drop("entity_id")
    docs = t.orders.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("kb_id"))
    refs = en.cross_references(edges, ents, docs, order_sections(t), best.select("name"), model.line_tasks(t))
    refs = refs.select("kb_id", F.col("entity_name").alias("name"), "document_id", "title", "chunk_count")
    return best.join(refs, ["kb_id", "name"], "left").select("query", "name", "kb_id", "score", "rank", "document_id", "title", "chunk_count")
