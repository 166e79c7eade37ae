"""Queries for usage analytics, counters, overviews and the filters over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import model
from quire.model import SQL_DOCUMENTS, SQL_MENTIONS, SQL_PAGES, sql_chunks
from quire.operators import analytics as an
from quire.operators.common import first_per_key
from quire.plans.registry import query


# The event log as searches and views.
def searches(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select(
        "ts", F.concat(F.lit(" "), F.upper("event_type"), F.lit(" ")).alias("query"), F.array((k % 10).cast("string"), (k % 7).cast("string")).alias("kb_ids"),
        F.floor("value").alias("results_count"), F.when(k % 3 == 0, "semantic").when(k % 3 == 1, "hybrid").alias("search_type"),
    )


def views(t):
    return t.events.select("ts", F.get_json_object("props", "$.k").alias("document_id"))


SQL_SEARCHES = """searches as (
  select ts, lower(event_type) as query, k % 10 as k1, k % 7 as k2, floor(value) as results_count, case k % 3 when 0 then 'semantic' when 1 then 'hybrid' else 'unknown' end as search_type, k
  from (select *, json_extract_string(props, '$.k')::bigint as k from events) where ts > (select max(ts) from events) - interval 7 day)"""
SQL_SEARCH_REPORT = """
select 'total_searches' as metric, '' as key, count(*)::double as value from searches
union all select 'unique_queries', '', count(distinct query) from searches
union all select 'avg_results', '', round(coalesce(avg(results_count), 0), 6) from searches
union all select * from (select 'query', query, count(*) from searches group by query order by count(*) desc, query limit 10)
union all select 'kb', kb::varchar, count(*) from (select k1 as kb from searches union all select k2 from searches) group by kb
union all select 'type', search_type, count(*) from searches group by search_type"""
SQL_VIEW_REPORT = """
select 'total_views' as metric, '' as key, count(*)::double as value from searches
union all select 'unique_documents', '', count(distinct k) from searches
union all select * from (select 'document', k::varchar, count(*) from searches group by k order by count(*) desc, k::varchar limit 10)"""


@query("search_analytics", f"with {SQL_SEARCHES} {SQL_SEARCH_REPORT}")
def search_analytics(t):
    return an.search_analytics(searches(t), 7).withColumn("value", F.round("value", 6))


@query("document_view_analytics", f"with {SQL_SEARCHES} {SQL_VIEW_REPORT}")
def document_view_analytics(t):
    return an.view_analytics(views(t), 7)


@query("analytics_all", f"with {SQL_SEARCHES} select *, 'search' as report from ({SQL_SEARCH_REPORT}) union all select *, 'documents' from ({SQL_VIEW_REPORT})")
def analytics_all(t):
    return an.all_analytics(searches(t), views(t), "all", 7).withColumn("value", F.round("value", 6))


# Counters per KB (language) and signed changes from the event log.
SQL_STATS = rf"""{sql_chunks(128, 16)},
stats as (
  select d.kb_id, d.documents, d.chapters, c.chunks, d.entities from (
    select lang as kb_id, count(*) as documents, sum(len(string_split(text, chr(10))))::bigint as chapters, count(distinct source) as entities from documents group by all) d
  join (select kb_id, count(*) as chunks from chunks group by all) c using (kb_id))"""


def kb_counters(t):
    docs = t.documents.groupBy(F.col("lang").alias("kb_id")).agg(
        F.count("*").alias("documents"), F.sum(F.size(F.split("text", "\n"))).alias("chapters"), F.countDistinct("source").alias("entities")
    )
    chunks = model.document_chunks(t, 128, 16).groupBy("kb_id").agg(F.count("*").alias("chunks"))
    return docs.join(chunks, "kb_id").select("kb_id", *an.COUNTERS)


@query("increment_stats", f"""
with {SQL_STATS},
deltas as (
  select case event_type when 'view' then 'en' when 'click' then 'fr' when 'error' then 'de' else 'xx' end as kb_id,
    sum(case when event_type = 'error' then -1 else 1 end) as d, sum(event_id % 3)::bigint as c from events group by all)
select kb_id, (documents + coalesce(d, 0))::bigint as documents, (chapters + coalesce(c, 0))::bigint as chapters, (chunks - coalesce(c, 0))::bigint as chunks, entities from stats left join deltas using (kb_id)""")
def increment_stats(t):
    kb = F.when(F.col("event_type") == "view", "en").when(F.col("event_type") == "click", "fr").when(F.col("event_type") == "error", "de").otherwise("xx")
    step = F.when(F.col("event_type") == "error", -1).otherwise(1)
    third = F.col("event_id") % 3
    deltas = t.events.select(kb.alias("kb_id"), step.alias("documents"), third.alias("chapters"), (-third).alias("chunks"), F.lit(0).alias("entities"))
    return an.increment_stats(kb_counters(t), deltas)


SQL_KBS = "kbs as (select distinct lang as kb_id, 'Documents in ' || lang as description from documents union all select source, 'Documents from ' || source from documents group by source)"


@query("kb_list", f"""
with {SQL_STATS}, {SQL_KBS}
select kb_id, description, coalesce(documents, 0) as documents, coalesce(chapters, 0) as chapters, coalesce(chunks, 0) as chunks, coalesce(entities, 0) as entities from kbs left join stats using (kb_id)""")
def kb_list(t):
    kbs = t.documents.select(F.col("lang").alias("kb_id"), F.concat(F.lit("Documents in "), "lang").alias("description")).distinct().unionByName(
        t.documents.select(F.col("source").alias("kb_id"), F.concat(F.lit("Documents from "), "source").alias("description")).distinct()
    )
    return an.kb_list(kbs, kb_counters(t))


@query("kb_stats", f"""
with {SQL_STATS}, {SQL_MENTIONS}
select kb_id, documents, chapters, chunks, entities, (select count(*) from chunks c where c.kb_id = s.kb_id) as stored_chunks,
  (select count(distinct entity_id) from mentions m where m.kb_id = s.kb_id) as graph_entities, (select count(*) from mentions m where m.kb_id = s.kb_id) as graph_relationships
from stats s""")
def kb_stats(t):
    mentions = model.document_mentions(t)
    stored = model.document_chunks(t, 128, 16).groupBy("kb_id").agg(F.count("*").alias("stored_chunks"))
    graph = mentions.groupBy("kb_id").agg(F.countDistinct("entity_id").alias("graph_entities"), F.count("*").alias("graph_relationships"))
    return kb_counters(t).join(stored, "kb_id", "left").join(graph, "kb_id", "left").na.fill(0)


@query("kb_entries", """
select lang as kb_id, case when lang = 'en' then 'English' else lang || ' texts' end as title, 'Unknown' as author, count(*) as document_count from documents group by lang
union all
select * from (select source, coalesce(nullif(text, ''), '(untitled)'), coalesce(nullif(case when doc_id % 2 = 0 then lang else '' end, ''), 'Unknown'), null from documents)""")
def kb_entries(t):
    kbs = t.documents.groupBy(F.col("lang").alias("kb_id")).agg(F.count("*").alias("doc_count")).select(
        "kb_id", F.when(F.col("kb_id") == "en", "English").otherwise("").alias("title"), F.concat("kb_id", F.lit(" texts")).alias("name"),
        F.lit("").alias("author"), F.lit(None).cast("string").alias("created_by"), F.lit(None).cast("long").alias("document_count"), "doc_count",
    )
    docs = t.documents.select(
        F.col("source").alias("kb_id"), F.col("doc_id").alias("document_id"), F.col("text").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("author"),
    )
    return an.kb_entries(kbs, docs).unionByName(an.kb_entries(kbs.where("false"), docs))


@query("job_overview", """
select event_id as job_id, case when event_type = 'view' then 'unknown' else event_type end as status, case when event_id % 4 = 0 then 0 else floor(value)::bigint end as progress,
  case when event_type = 'error' then props end as error from events""")
def job_overview(t):
    jobs = t.events.select(
        F.col("event_id").alias("job_id"), F.nullif(F.col("event_type"), F.lit("view")).alias("status"),
        F.when(F.col("event_id") % 4 != 0, F.floor("value")).alias("progress"), F.when(F.col("event_type") == "error", F.col("props")).alias("error"),
        F.col("ts").alias("created_at"),
    )
    return an.job_overview(jobs).select("job_id", "status", "progress", "error")


# Pages of a document are its lines here; hosts with many pages come from the page table.
@query("repetitive_text_check", rf"""
with {SQL_PAGES},
pages_all as (
  select 'd' || doc_id as document_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as page, unnest(string_split(text, chr(10))) as text, doc_id % 5 = 0 as full_image from documents
  union all select 's' || source, (row_number() over (partition by source order by doc_id) - 1)::int, case when source like '%1' then 'the same stamp here. ' else text end, false from documents
  union all select document_id, page - 1, text, page_id % 4 = 0 from page_rows),
counts as (select document_id, count(*)::int as total, least(5, count(*))::int as checked, (count(*) // 10)::int as s from pages_all group by all),
steps as (select *, greatest(1, (greatest(s + 1, total - s) - s) // 5)::int as step, total // 2 as mid from counts),
picks as (select document_id, checked, i, case when total < 10 then greatest(0, mid - 2 + i) else least(s + i * step, total - 1) end as page
  from (select *, unnest(range(least(5, total))) as i from steps)),
body as (select document_id, checked, i, trim(text, E' \n\t\r') as text, full_image from picks join pages_all using (document_id, page)),
merged as (select document_id, any_value(checked) as checked, sum(length(text)) / any_value(checked)::double as avg_chars, sum(full_image::int)::bigint as images, string_agg(text, ' ' order by i) as joined from body group by document_id),
measured as (select *, list_filter(list_transform(string_split_regex(joined, '[.!?\n]+'), lambda x: trim(x, E' \n\t\r')), lambda x: length(x) > 10) as p, avg_chars < 100 or images >= checked * 0.5 as scanned from merged)
select document_id, round(avg_chars, 6) as avg_chars, images, scanned as needs_ocr,
  round(case when not scanned and len(p) > 0 then len(list_distinct(p)) / len(p)::double else 1.0 end, 6) as uniqueness_ratio,
  case when not scanned and len(p) > 0 then len(list_distinct(p)) / len(p)::double else 1.0 end < 0.2 as is_repetitive from measured""")
def repetitive_text_check(t):
    from quire.operators.common import running_sum

    lines = t.documents.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document_id"), (F.col("doc_id") % 5 == 0).alias("full_image"), F.posexplode(F.split("text", "\n")).alias("page", "text")
    )
    stamped = F.when(F.col("source").endswith("1"), "the same stamp here. ").otherwise(F.col("text"))
    sources = running_sum(t.documents.select("source", "doc_id", stamped.alias("text")), ["source"], ["doc_id"], {"page": F.lit(1)}).select(
        F.concat(F.lit("s"), "source").alias("document_id"), F.lit(False).alias("full_image"), F.col("page").cast("int").alias("page"), "text"
    )
    hosts = model.page_rows(t).select("document_id", (F.col("page_id") % 4 == 0).alias("full_image"), (F.col("page") - 1).alias("page"), "text")
    return an.scan_check(lines.unionByName(sources).unionByName(hosts))


# Action requests out of the orders.
def order_actions(t):
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("approved")
    return t.orders.select(F.col("o_orderkey").alias("id"), status.alias("status"), F.col("o_orderdate").alias("created_at"))


SQL_ACTIONS = "actions as (select o_orderkey as id, case o_orderstatus when 'O' then 'pending' when 'F' then 'completed' else 'approved' end as status, o_orderdate as created_at from orders)"


@query("filter_actions", f"""
with {SQL_ACTIONS} select id, status, strftime(created_at, '%Y-%m-%d') as created from actions where status = 'pending' order by created_at desc, id desc limit 50 offset 100""")
def filter_actions(t):
    from quire.operators.actions import list_actions

    return list_actions(order_actions(t), "pending", limit=50, offset=100).select("id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("filter_audit", f"""
with {SQL_ACTIONS}, kept as (select * from actions where status = 'completed' and created_at >= timestamp '1996-03-01' and created_at <= timestamp '1997-06-30')
select id, status, strftime(created_at, '%Y-%m-%d') as created, (select count(*) from kept) as total from kept""")
def filter_audit(t):
    from quire.operators.actions import audit

    rows = audit(order_actions(t), status="completed", since="1996-03-01", until="1997-06-30")
    return rows.select("id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "total")


@query("filter_session", """
select user_id as session_id, event_id as id, strftime(ts, '%Y-%m-%d %H:%M:%S') as updated from events where user_id in (select user_id from events where event_type = 'signup')""")
def filter_session(t):
    from quire.operators.actions import session_actions

    actions = t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("id"), F.col("ts").alias("updated_at"), "event_type")
    rows = session_actions(actions, actions.where("event_type = 'signup'").select("session_id"))
    return rows.select("session_id", "id", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("normalize_kb_scope", """
select event_id, case event_type when 'view' then 'none' when 'click' then 'all' else 'selected' end as mode,
  case event_type when 'view' then '' when 'click' then (select string_agg(distinct lang, '|' order by lang) from documents) else case when k % 2 = 0 then k || '|b' else k::varchar end end as kb_ids
from (select *, json_extract_string(props, '$.k')::bigint as k from events)""")
def normalize_kb_scope(t):
    from quire.operators.actions import every_kb, kb_scope

    k = F.get_json_object("props", "$.k").cast("long")
    mode = F.when(F.col("event_type") == "view", "none").when(F.col("event_type") == "click", "all").when(F.col("event_type") == "error", "odd")
    ids = F.array(k.cast("string"), F.lit("  "), F.when(k % 2 == 0, "b"), F.lit(""))
    kbs = every_kb(t.documents.select(F.col("lang").alias("kb_id")))
    rows = t.events.select("event_id", kb_scope(mode, ids, kbs).alias("s"))
    return rows.select("event_id", "s.mode", F.array_join("s.kb_ids", "|").alias("kb_ids"))
