"""Queries for the library, the registry and action requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import actions as ac
from quire.operators import library as li
from quire.operators.common import union_all, upsert
from quire.plans.registry import query


def named(prefix, column):
    return F.concat(F.lit(prefix), column.cast("string"))


# Library items out of the parts.
def items(t):
    k = F.col("p_partkey")

    def entry(name, when, **fields):
        body = F.struct(*[fields.get(f, F.lit(None)).cast("string").alias(f) for f in ("path", "filename", "kb_id", "document_id")])
        return F.when(when, F.struct(F.lit(name).alias("key"), body.alias("value")))

    kb = named("kb", F.col("p_size") % 7)
    outputs = F.map_from_entries(F.array_compact(F.array(
        entry("m4b", k % 2 == 0, path=named("m/", k), filename=F.concat(k.cast("string"), F.lit(".m4b"))),
        entry("searchable_pdf", k % 3 == 0, path=named("s/", k), filename=F.concat(k.cast("string"), F.lit(".pdf"))),
        entry("knowledge_base", k % 5 == 0, kb_id=kb, document_id=F.when(k % 10 == 0, named("d", k))),
    )))
    return t.part.select(
        named("i", k).alias("id"), k.alias("seq"), F.when(k % 50 != 7, F.col("p_name")).alias("title"), F.col("p_brand").alias("author"), k.alias("created_at"),
        F.when(k % 11 != 4, outputs).alias("output_files"), F.col("p_brand").alias("organization"), F.col("p_type").alias("course_code"),
        F.when(k % 6 == 0, named("c", F.col("p_size"))).alias("course_id"), F.when(k % 4 == 0, named("m", F.col("p_size") % 5)).alias("module_id"),
        F.array(named("t", F.col("p_size") % 3), named("t", F.col("p_size") % 4)).alias("topic_ids"), F.split("p_name", " ").alias("custom_tags"),
        F.when(k % 13 == 0, kb).alias("kb_id"), F.when(k % 13 == 0, named("d", k)).alias("document_id"),
        F.when(k % 11 == 4, named("f", k % 97)).alias("filename"), F.when(k % 11 == 4, named("p/", k)).alias("path"), (k % 2 == 0).alias("legacy_complete"),
    )


SQL_ITEMS = """items as (
  select 'i' || p_partkey as id, p_partkey as k, case when p_partkey % 50 <> 7 then p_name end as title, p_brand as author,
    p_partkey % 11 <> 4 as has_map, p_partkey % 11 <> 4 and p_partkey % 2 = 0 as m4b, p_partkey % 11 <> 4 and p_partkey % 3 = 0 as pdf, p_partkey % 11 <> 4 and p_partkey % 5 = 0 as kb,
    'kb' || p_size % 7 as kbn, p_brand as organization, p_type as course_code, case when p_partkey % 6 = 0 then 'c' || p_size end as course_id,
    case when p_partkey % 4 = 0 then 'm' || p_size % 5 end as module_id, ['t' || p_size % 3, 't' || p_size % 4] as topic_ids, string_split(p_name, ' ') as custom_tags,
    case when p_partkey % 13 = 0 then 'kb' || p_size % 7 end as kb_id, case when p_partkey % 13 = 0 then 'd' || p_partkey end as document_id,
    case when p_partkey % 11 = 4 then 'f' || p_partkey % 97 end as filename, case when p_partkey % 11 = 4 then 'p/' || p_partkey end as path from part)"""


@query("filter_library", f"""
with {SQL_ITEMS}, complete as (select * from items where title is not null and (has_map or k % 2 = 0))
select 'organization' as filter, id from complete where lower(organization) = 'brand#5'
union all select 'course', id from complete where lower(course_code) = 'economy' and (kb_id is not null or kb)
union all select 'tags', id from complete where list_contains(topic_ids, 't1') and list_contains(custom_tags, 'ring')
union all select 'module', id from complete where module_id = 'm2' and not (kb_id is not null or kb)
union all select 'all', id from complete""")
def filter_library(t):
    rows = items(t)
    asked = {
        "organization": dict(organization="BRAND#5"), "course": dict(course_code="economy", has_kb=True), "tags": dict(topic_id="t1", custom_tag="ring"),
        "module": dict(module_id="m2", has_kb=False), "all": {},
    }
    return union_all([li.filter_library(rows, **f).select(F.lit(name).alias("filter"), "id") for name, f in asked.items()])


@query("filter_library_client", f"""
with {SQL_ITEMS}
select id, title from items where contains(lower(title), 'red') and contains(lower(author), '#1') and not (kb and k % 10 = 0)""")
def filter_library_client(t):
    return li.filter_library_client(items(t), title=" Red ", author="#1", has_kb=False).select("id", "title")


@query("facet_values", f"""
with {SQL_ITEMS}
select distinct 'organization' as facet, organization as value from items union all select distinct 'course_code', course_code from items
union all select distinct 'custom_tag', unnest(custom_tags) from items""")
def facet_values(t):
    return li.facet_values(items(t))


# Updates: every line item with quantity above 40 delivers an output of its part.
SQL_UPDATES = """updates as (
  select 'i' || case when l_linenumber = 7 then 1000000 + l_partkey else l_partkey end as id, 'T' || l_orderkey as title, 'A' || l_suppkey as author,
    case l_returnflag when 'A' then 'm4b' when 'R' then 'combined_pdf' else 'searchable_pdf' end as output_type, 'u/' || l_orderkey || '/' || l_linenumber as path,
    l_orderkey * 10 + l_linenumber as seq, l_suppkey from lineitem)"""


def updates(t):
    target = F.when(F.col("l_linenumber") == 7, F.col("l_partkey") + 1000000).otherwise(F.col("l_partkey"))
    path = F.concat(F.lit("u/"), F.concat_ws("/", "l_orderkey", "l_linenumber"))
    none = F.lit(None).cast("string")
    return t.lineitem.select(
        named("i", target).alias("id"), named("T", F.col("l_orderkey")).alias("title"), named("A", F.col("l_suppkey")).alias("author"),
        F.when(F.col("l_returnflag") == "A", "m4b").when(F.col("l_returnflag") == "R", "combined_pdf").otherwise("searchable_pdf").alias("output_type"),
        F.struct(path.alias("path"), path.alias("filename"), none.alias("kb_id"), none.alias("document_id")).alias("output"),
        # the supplier makes the order total where an order repeats a line number
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("n"), "l_suppkey", "l_partkey").alias("seq"),
    )


@query("library_upsert", f"""
with {SQL_ITEMS}, {SQL_UPDATES},
last as (select * from updates qualify row_number() over (partition by id, output_type order by seq desc, l_suppkey desc) = 1),
heads as (select id, min_by(title, seq * 100000 + l_suppkey) as title, min_by(author, seq * 100000 + l_suppkey) as author, max(seq) as touched from updates group by id),
olds as (
  select id, 'm4b' as o, 'm/' || k as path from items where m4b union all select id, 'searchable_pdf', 's/' || k from items where pdf
  union all select id, 'knowledge_base', null from items where kb)
select coalesce(i.id, h.id) as id, case when i.id is null then h.title else coalesce(i.title, h.title) end as title, coalesce(i.author, h.author) as author, touched as last_touched,
  (select string_agg(o || '=' || coalesce(path, ''), '|' order by o) from (
    select o, path from olds where olds.id = coalesce(i.id, h.id) and not exists (select 1 from last where last.id = olds.id and last.output_type = o)
    union all select output_type, path from last where last.id = coalesce(i.id, h.id))) as outputs
from items i full join heads h on h.id = i.id""")
def library_upsert(t):
    rows = li.upsert_outputs(items(t), updates(t))
    entries = F.array_sort(F.transform(F.map_entries("output_files"), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"]["path"], F.lit("")))))
    return rows.select("id", "title", "author", F.col("last_touched.n").alias("last_touched"), F.nullif(F.array_join(entries, "|"), F.lit("")).alias("outputs"))


@query("library_add", f"""
with {SQL_ITEMS}, added as (select 'n' || s_suppkey as id, case when s_suppkey % 3 = 0 then null else 'f' || s_suppkey % 60 end as filename, s_suppkey as seq from supplier),
every as (select id, filename, 0 as new, k as seq from items where filename is not null union all select id, filename, 1, seq from added where filename is not null)
select id, filename from every qualify row_number() over (partition by filename order by new desc, seq desc) = 1
union all select id, filename from items where filename is null union all select id, filename from added where filename is null""")
def library_add(t):
    added = t.supplier.select(
        named("n", F.col("s_suppkey")).alias("id"), F.when(F.col("s_suppkey") % 3 != 0, named("f", F.col("s_suppkey") % 60)).alias("filename"), F.col("s_suppkey").alias("seq")
    )
    return li.add_by_filename(items(t), added).select("id", "filename")


@query("library_patch_tags", f"""
with {SQL_ITEMS}
select id, case when k % 7 = 0 then 'Org ' || k else organization end as organization, case when k % 14 = 0 then '' else course_code end as course_code,
  case when k % 7 = 0 then 'x' else array_to_string(custom_tags, '|') end as custom_tags, array_to_string(topic_ids, '|') as topic_ids from items""")
def library_patch_tags(t):
    k = F.col("p_partkey")
    changes = t.part.where(k % 7 == 0).select(
        named("i", k).alias("id"), named("Org ", k).alias("organization"), F.when(k % 14 == 0, "").alias("course_code"), F.array(F.lit("x")).alias("custom_tags"),
        F.lit(None).cast("array<string>").alias("topic_ids"),
    )
    rows = li.patch(items(t), changes, "id", ["organization", "course_code", "custom_tags", "topic_ids"])
    return rows.select("id", "organization", "course_code", F.array_join("custom_tags", "|").alias("custom_tags"), F.array_join("topic_ids", "|").alias("topic_ids"))


def kb_documents(t):
    k = F.col("p_partkey")
    return t.part.select(
        named("d", k).alias("document_id"), named("kb", F.col("p_size") % 7).alias("kb_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("author"),
        F.concat(F.when(k % 2 == 0, named("i", k)).otherwise(named("z", k)), F.lit("_0_file.pdf")).alias("source_file"),
    )


SQL_DOCS = """docs as (
  select 'd' || p_partkey as document_id, 'kb' || p_size % 7 as kb_id, p_name as title, p_brand as author,
    case when p_partkey % 2 = 0 then 'i' else 'z' end || p_partkey || '_0_file.pdf' as source_file, p_partkey as k from part)"""


@query("library_patch_metadata", f"""
with {SQL_ITEMS}, {SQL_DOCS}
select id as item_or_document, case when k % 2 = 0 then 'New ' || k else title end as title, case when k % 4 = 0 then 'Someone' else author end as author from items
union all
select document_id, case when k % 26 = 0 then 'New ' || k else title end, case when k % 52 = 0 then 'Someone' else author end from docs""")
def library_patch_metadata(t):
    k = F.col("p_partkey")
    changes = t.part.where(k % 2 == 0).select(named("i", k).alias("id"), named("New ", k).alias("title"), F.when(k % 4 == 0, "Someone").alias("author"))
    rows, docs = li.patch_metadata(items(t), kb_documents(t), changes)
    return rows.select(F.col("id").alias("item_or_document"), "title", "author").unionByName(docs.select("document_id", "title", "author").toDF("item_or_document", "title", "author"))


# Courses of the KBs: kb0 to kb2 know some of the codes. One code is one term, so the best match is
# the shortest title, then the smallest id.
@query("library_tag_sync", f"""
with {SQL_ITEMS},
synced as (
  select id, document_id, kb_id, module_id, topic_ids, coalesce(course_id, case when kb_id in ('kb0', 'kb1', 'kb2') and course_code in ('ECONOMY', 'PROMO') then 'n-' || kb_id || '-' || course_code end,
    sha256('course' || chr(1) || kb_id || chr(1) || course_code)[:12]) as course_id from items where kb_id is not null)
select kb_id, document_id, 'course' as src_kind, course_id as src from synced
union all select kb_id, document_id, 'module', module_id from synced where module_id is not null
union all select distinct kb_id, document_id, 'topic', unnest(topic_ids) from synced""")
def library_tag_sync(t):
    codes = t.part.where("p_type in ('ECONOMY', 'PROMO')").select("p_type", named("kb", F.col("p_size") % 3).alias("kb_id")).distinct()
    courses = codes.select("kb_id", F.concat_ws("-", F.lit("n"), "kb_id", "p_type").alias("course_id"), F.initcap("p_type").alias("title"))
    _, edges = li.sync_tags(items(t), courses)
    return edges.select("kb_id", "document_id", "src_kind", "src")


@query("library_delete_output", f"""
with {SQL_ITEMS}, {SQL_DOCS},
left_items as (
  select id, k, k % 15 = 0 as asked_kb, k % 4 = 0 as asked_m4b, has_map, m4b and k % 4 <> 0 as m4b, pdf, kb and k % 15 <> 0 as kb,
    case when k % 4 = 0 and not m4b then null else path end as path from items),
gone as (select i.kbn as kb_id, case when i.k % 10 = 0 then 'd' || i.k end as document_id, title, author from items i where kb and k % 15 = 0)
select id as item_or_document, concat_ws('|', case when kb then 'knowledge_base' end, case when m4b then 'm4b' end, case when pdf then 'searchable_pdf' end, path) as rest
from left_items where m4b or pdf or kb or path is not null or not (asked_kb or asked_m4b)
union all
select document_id, kb_id from docs d where not exists (select 1 from gone g where g.kb_id = d.kb_id and (g.document_id = d.document_id or (g.document_id is null and g.title = d.title and g.author = d.author)))""")
def library_delete_output(t):
    k = F.col("p_partkey")
    doomed = t.part.where(k % 15 == 0).select(named("i", k).alias("id"), F.lit("knowledge_base").alias("output_type")).unionByName(
        t.part.where(k % 4 == 0).select(named("i", k).alias("id"), F.lit("m4b").alias("output_type"))
    )
    rows, docs = li.delete_outputs(items(t), kb_documents(t), doomed)
    kinds = F.array_join(F.array_sort(F.map_keys("output_files")), "|")
    return rows.select(F.col("id").alias("item_or_document"), F.concat_ws("|", F.nullif(kinds, F.lit("")), "path").alias("rest")).unionByName(
        docs.select(F.col("document_id").alias("item_or_document"), F.col("kb_id").alias("rest"))
    )


# Texts of the items are the documents with the same number; every third has chapters by line.
@query("library_reingest", f"""
with {SQL_ITEMS}, chaps as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) as number, unnest(string_split(text, chr(10))) as line from documents where doc_id % 3 = 0)
select i.id, 'kb9' as kb_id, sha256('document' || chr(1) || 'kb9' || chr(1) || i.id)[:12] as document_id, number, 'Line ' || number as title, line as text, number * 2 as start_page
from items i join chaps on doc_id = k where pdf
union all
select i.id, 'kb9', sha256('document' || chr(1) || 'kb9' || chr(1) || i.id)[:12], 1, coalesce(title, 'Full Document'), trim(text), 0 from items i join documents on doc_id = k where pdf and doc_id % 3 <> 0""")
def library_reingest(t):
    texts = t.documents.select(named("i", F.col("doc_id")).alias("id"), "text", "doc_id")
    lines = texts.where("doc_id % 3 = 0").select("id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    chapters = lines.select("id", (F.col("n") + 1).alias("number"), named("Line ", F.col("n") + 1).alias("title"), "text", ((F.col("n") + 1) * 2).alias("start_page"))
    requests = t.part.select(named("i", F.col("p_partkey")).alias("id"), F.lit("kb9").alias("kb_id"))
    rows, _ = li.reingest(items(t), texts.select("id", "text"), chapters, requests)
    return rows.select("id", "kb_id", "document_id", "number", "title", "text", "start_page")


@query("library_orphans", f"""
with {SQL_ITEMS}, {SQL_DOCS},
loose as (select * from docs where document_id not in (select document_id from items where document_id is not null) and document_id not in (select 'd' || k from items where kb and k % 10 = 0)),
heads as (select l.document_id, i.id, i.k from loose l join items i on starts_with(l.source_file, i.id))
select l.document_id, l.kb_id, h.id as item_id, h.id is null as orphan from loose l left join (select * from heads qualify row_number() over (partition by document_id order by k) = 1) h using (document_id)""")
def library_orphans(t):
    return li.orphans(items(t), kb_documents(t)).select("document_id", "kb_id", "item_id", "orphan")


# Bulk requests: one per order, a target per line.
def bulk_targets(t):
    op = F.when(F.col("l_returnflag") == "A", "retag").when(F.col("l_returnflag") == "N", "delete").when(F.col("l_linenumber") == 3, "rename").otherwise("reindex")
    place = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return t.lineitem.select(
        F.col("l_orderkey").alias("request"), place.alias("place"), named("i", F.col("l_partkey") * 2).alias("item_id"), op.alias("operation"),
        F.when(F.col("l_suppkey") % 4 != 0, named("kb", F.col("l_suppkey") % 9)).alias("kb_id"),
    )


SQL_BULK = SQL_ITEMS + """,
targets as (
  select l_orderkey as request, l_linenumber, l_partkey, l_suppkey, 'i' || l_partkey * 2 as item_id,
    case when l_returnflag = 'A' then 'retag' when l_returnflag = 'N' then 'delete' when l_linenumber = 3 then 'rename' else 'reindex' end as operation,
    case when l_suppkey % 4 <> 0 then 'kb' || l_suppkey % 9 end as kb_id from lineitem),
placed as (select *, min((l_linenumber, l_partkey, l_suppkey)) filter (operation = 'delete') over (partition by request, item_id) as gone_at from targets),
outcomes as (
  select t.request, t.l_linenumber, t.l_partkey, t.l_suppkey, t.item_id, t.operation, t.kb_id, case when operation = 'rename' then 'unknown operation: rename'
    when operation = 'reindex' and t.kb_id is null then 'kb_id required'
    when i.id is null or coalesce((t.l_linenumber, t.l_partkey, t.l_suppkey) > gone_at, false) then 'not found'
    when operation = 'reindex' and not i.pdf then 'no PDF available'
    when operation = 'reindex' and t.kb_id not in (select kbn from items) then 'KB not found: ' || t.kb_id end as error
  from placed t left join items i on i.id = t.item_id)"""


def bulk_outcomes(t):
    has_pdf = F.coalesce(F.map_contains_key("output_files", "searchable_pdf"), F.lit(False))
    kbs = t.part.select(named("kb", F.col("p_size") % 7).alias("kb_id")).distinct()
    return ac.bulk_outcomes(bulk_targets(t), items(t).select("id", has_pdf.alias("has_pdf")), kbs)


@query("library_bulk", f"with {SQL_BULK} select request, l_linenumber as line, item_id, operation, error is null as ok, error from outcomes")
def library_bulk(t):
    return bulk_outcomes(t).select("request", F.col("place.l_linenumber").alias("line"), "item_id", "operation", "ok", "error")


@query("bulk_result_summary", f"""
with {SQL_BULK}
select request, count(*) as total, count(*) filter (error is null) as succeeded, count(*) filter (error is not null) as failed,
  string_agg(item_id || ' ' || operation || ' ' || coalesce(error, 'ok'), '|' order by l_linenumber, l_partkey, l_suppkey) as details from outcomes group by request""")
def bulk_result_summary(t):
    rows = ac.bulk_summary(bulk_outcomes(t))
    told = F.transform("details", lambda d: F.concat_ws(" ", d["item_id"], d["operation"], F.coalesce(d["error"], F.lit("ok"))))
    return rows.select("request", "total", "succeeded", "failed", F.array_join(told, "|").alias("details"))


# The library after all bulk requests: tags are the line's ship mode, the KB of an item is its type's number at first.
@query("library_bulk_effects", f"""
with {SQL_BULK},
done as (
  select o.request, o.l_linenumber, o.l_partkey, o.l_suppkey, o.item_id, o.operation, o.kb_id, (o.l_partkey % 5)::varchar as tags
  from outcomes o where error is null),
last as (
  select item_id as id, bool_or(operation = 'delete') as gone, bool_or(operation = 'retag') as retagged,
    arg_max(tags, (request, l_linenumber, l_partkey, l_suppkey)) filter (operation = 'retag') as tags,
    arg_max(kb_id, (request, l_linenumber, l_partkey, l_suppkey)) filter (operation = 'reindex') as kb_id from done group by item_id)
select i.id, case when coalesce(retagged, false) then l.tags else 'none' end as tags, coalesce(l.kb_id, 'kb0') as kb_id from items i left join last l on l.id = i.id where not coalesce(gone, false)""")
def library_bulk_effects(t):
    targets = bulk_targets(t).withColumn("tags", (F.col("place.l_partkey") % 5).cast("string"))
    shelf = items(t).select("id", F.lit("none").alias("tags"), F.lit("kb0").alias("kb_id"))
    return ac.bulk_effects(shelf, targets, bulk_outcomes(t))


# Requests on one action per user; the event type says what is asked.
@query("action_transitions", """
with recursive reqs as (
  select user_id as action_id, event_id, case event_type when 'signup' then 'create' when 'view' then 'approve' when 'click' then 'reject' else 'execute' end as op, value < 60 as ok,
    row_number() over (partition by user_id order by event_id) as i from events),
walk as (
  select action_id, event_id, i, case when op = 'create' then 'pending' end as status, case when op = 'create' then 'pending' else '404' end as outcome from reqs where i = 1
  union all
  select r.action_id, r.event_id, r.i,
    case when w.status is null then case when r.op = 'create' then 'pending' end
      when w.status = 'pending' and r.op = 'approve' then 'approved' when w.status = 'pending' and r.op = 'reject' then 'rejected'
      when w.status = 'approved' and r.op = 'execute' then case when r.ok then 'completed' else 'failed' end else w.status end,
    case when w.status is null then case when r.op = 'create' then 'pending' else '404' end
      when w.status = 'pending' and r.op = 'approve' then 'approved' when w.status = 'pending' and r.op = 'reject' then 'rejected'
      when w.status = 'approved' and r.op = 'execute' then case when r.ok then 'completed' else 'failed' end else '409' end
  from walk w join reqs r on r.action_id = w.action_id and r.i = w.i + 1)
select action_id, event_id as seq, outcome from walk""")
def action_transitions(t):
    op = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "view", "approve").when(F.col("event_type") == "click", "reject").otherwise("execute")
    asked = t.events.select(F.col("user_id").alias("action_id"), F.col("event_id").alias("seq"), op.alias("op"), (F.col("value") < 60).alias("ok"))
    return ac.transitions(asked).select("action_id", "seq", "outcome")


def action_records(t):
    """An action per order with its lines as targets."""
    op = F.when(F.col("l_returnflag") == "A", "retag").when(F.col("l_returnflag") == "N", "delete").otherwise("reindex")
    target = F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", named("i", F.col("l_partkey")).alias("item_id"), op.alias("operation"),
        named("kb", F.col("l_suppkey")).alias("kb_id"), named("tag", F.col("l_linenumber")).alias("tags"),
    )
    targets = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(target)).alias("targets"))
    status = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "completed").otherwise("approved")
    title = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority"))
    orders = t.orders.select(F.col("o_orderkey").alias("id"), title.alias("title"), status.alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "library.bulk").alias("type"))
    return orders.join(targets, "id")


SQL_RECORDS = """targets as (
  select l_orderkey as id, 'i' || l_partkey as item_id, case l_returnflag when 'A' then 'retag' when 'N' then 'delete' else 'reindex' end as operation, 'kb' || l_suppkey as kb_id, 'tag' || l_linenumber as tags,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as r from lineitem),
firsts as (select * from targets where r = 1), ids as (select id, string_agg(item_id, '|' order by r) as item_ids from targets group by id)"""


@query("action_normalize", f"""
with {SQL_RECORDS}
select id, 'library.bulk' as type, case when id % 5 = 0 then 'Action Request' else o_orderpriority end as title, operation, item_ids,
  case when operation = 'reindex' then kb_id end as kb_id, case when operation = 'retag' then tags end as tags,
  case o_orderstatus when 'O' then 'proposed' when 'F' then 'completed' else 'approved' end as status
from orders join firsts on id = o_orderkey join ids using (id)""")
def action_normalize(t):
    return ac.normalize_record(action_records(t)).withColumn("item_ids", F.array_join("item_ids", "|"))


@query("action_targets", f"""
with {SQL_RECORDS}
select a.id, (b.r - 1)::int as place, b.item_id, a.operation, case when a.operation = 'reindex' then a.kb_id end as kb_id, case when a.operation = 'retag' then a.tags end as tags
from firsts a join targets b using (id)""")
def action_targets(t):
    return ac.fan_out_targets(ac.normalize_record(action_records(t)))


@query("action_validate", f"""
with {SQL_RECORDS},
reqs as (
  select o_orderkey as id, case o_orderkey % 11 when 0 then '' when 1 then 'mail.send' else 'library.bulk' end as type, case when o_orderkey % 7 = 0 then '  ' else 's' || o_custkey end as session_id,
    case when o_orderkey % 6 = 0 then 'rename' else operation end as operation, case when o_orderkey % 13 = 0 then '' else (select string_agg(distinct t.item_id, '|' order by t.item_id) from targets t where t.id = o_orderkey) end as item_ids,
    case when o_orderkey % 3 = 0 then kb_id end as kb_id from orders join firsts on id = o_orderkey)
select id, operation, item_ids, case when type = '' then 'type is required' when type <> 'library.bulk' then 'Unsupported action type: ' || type
  when trim(session_id) = '' then 'chat_session_id is required' when operation = 'rename' then 'Unsupported operation: rename'
  when item_ids = '' then 'payload.item_ids[] is required' when operation = 'reindex' and kb_id is null then 'payload.kb_id is required for reindex' end as error from reqs""")
def action_validate(t):
    local = ac.normalize_record(action_records(t)).drop("kb_id", "type", "title", "status", "tags")
    heads = action_records(t).select("id", F.get("targets", F.lit(0))["kb_id"].alias("first_kb"))
    orders = t.orders.select(F.col("o_orderkey").alias("id"), "o_custkey")
    i = F.col("id")
    ids = F.when(i % 13 == 0, F.array(F.lit(" "))).otherwise(F.concat("item_ids", "item_ids", F.array(F.lit(""))))
    asked = local.join(heads, "id").join(orders, "id").select(
        "id", F.when(i % 11 == 0, "").when(i % 11 == 1, "mail.send").otherwise("library.bulk").alias("type"),
        F.when(i % 7 == 0, "  ").otherwise(named("s", F.col("o_custkey"))).alias("session_id"),
        F.when(i % 6 == 0, " Rename").otherwise(F.concat(F.lit(" "), F.upper("operation"))).alias("operation"), ids.alias("item_ids"),
        F.when(i % 3 == 0, F.col("first_kb")).alias("kb_id"),
    )
    return ac.validate(asked).select("id", "operation", F.array_join(F.array_sort("item_ids"), "|").alias("item_ids"), "error")


@query("action_defaults", """
select event_id as id, case when event_id % 3 = 0 then 'library.bulk' else event_type end as type, case when event_id % 4 = 0 then 'Action Request' else 'Title ' || event_id end as title,
  case when event_id % 5 = 0 then 'proposed' else 'approved' end as status,
  case when event_id % 6 = 0 then '2030-01-01 00:00:00' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as created_at,
  case when event_id % 6 = 0 then '2030-01-01 00:00:00' else strftime(ts, '%Y-%m-%d %H:%M:%S') end as updated_at,
  case when event_id % 7 = 0 then 'local-policy' else 'user ' || user_id end as created_by, event_id % 8 <> 0 as approval_required,
  case when event_id % 9 = 0 then 'library.bulk:generic|' else '' end || case when event_id % 3 = 0 then 'library.bulk:' || event_type else event_type end as allowed_operations,
  case when event_id % 10 = 0 then 'high' else 'moderate' end as risk_level from events""")
def action_defaults(t):
    i = F.col("event_id")
    policy = F.struct(
        F.when(i % 7 != 0, named("user ", F.col("user_id"))).alias("created_by"), F.when(i % 8 == 0, F.lit(False)).alias("approval_required"),
        F.when(i % 9 == 0, F.array(F.lit("library.bulk:generic"), F.lit(" "), F.lit("library.bulk:generic"))).alias("allowed_operations"),
        F.when(i % 10 == 0, " high ").alias("risk_level"),
    )
    when = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    stored = t.events.select(
        i.alias("id"), F.when(i % 3 == 0, "library.bulk").otherwise(F.col("event_type")).alias("type"), F.when(i % 4 == 0, "  ").otherwise(named("Title ", i)).alias("title"),
        F.when(i % 5 != 0, "approved").alias("status"), F.col("event_type").alias("operation"), F.when(i % 6 == 0, "yesterday").otherwise(when).alias("created_at"),
        F.lit("soon").alias("updated_at"), policy.alias("policy"),
    )
    rows = ac.fill_defaults(stored, F.to_timestamp(F.lit("2030-01-01 00:00:00")))
    text = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("created_at", "updated_at")]
    return rows.select("id", "type", "title", "status", *text, "created_by", "approval_required", F.array_join("allowed_operations", "|").alias("allowed_operations"), "risk_level")


@query("staging_order", """
with recursive calls as (
  select user_id as area, event_id, 'f' || event_id as name, case when event_type = 'click' then floor(value / 10)::bigint end as ord, value as size, row_number() over (partition by user_id order by event_id) as i from events),
walk as (
  select area, event_id, name, size, i, coalesce(ord, 1) as place, greatest(1, coalesce(ord, 1) + 1) as nxt from calls where i = 1
  union all
  select c.area, c.event_id, c.name, c.size, c.i, coalesce(c.ord, w.nxt), greatest(w.nxt, coalesce(c.ord, w.nxt) + 1) from walk w join calls c on c.area = w.area and c.i = w.i + 1)
select area, place, name, size from walk qualify row_number() over (partition by area, place order by event_id desc) = 1""")
def staging_order(t):
    calls = t.events.select(
        F.col("user_id").alias("area"), F.col("event_id").alias("seq"), named("f", F.col("event_id")).alias("name"),
        F.when(F.col("event_type") == "click", F.floor(F.col("value") / 10)).cast("double").alias("order"), F.col("value").alias("size"),
    )
    return ac.staged_files(calls).orderBy("area", "place")


@query("media_outputs_lookup", f"""
with {SQL_ITEMS}, asked as (select distinct 'i' || l_partkey as id, case l_returnflag when 'A' then 'm4b' when 'R' then 'searchable_pdf' else 'combined_pdf' end as output_type, l_partkey as k from lineitem)
select a.id, a.output_type, coalesce(
  case when a.k % 3 = 1 and a.k % 4 <> 0 and a.output_type = 'combined_pdf' then 'j/' || a.k end, case when a.k % 3 = 1 and a.k % 4 <> 0 and a.output_type = 'm4b' and a.k % 5 = 0 then 'old/' || a.k end,
  case a.output_type when 'm4b' then case when i.m4b then 'm/' || a.k end when 'searchable_pdf' then case when i.pdf then 's/' || a.k end end, case when a.output_type = 'm4b' then i.path end) as path
from asked a left join items i using (id)""")
def media_outputs_lookup(t):
    kind = F.when(F.col("l_returnflag") == "A", "m4b").when(F.col("l_returnflag") == "R", "searchable_pdf").otherwise("combined_pdf")
    asked = t.lineitem.select(named("i", F.col("l_partkey")).alias("id"), kind.alias("output_type")).distinct()
    k = F.col("p_partkey")
    jobs = t.part.where(k % 3 == 1).select(
        named("i", k).alias("id"), F.when(k % 4 == 0, "failed").otherwise("completed").alias("status"),
        F.create_map(F.lit("combined_pdf"), named("j/", k)).alias("output_files"), F.when(k % 5 == 0, named("old/", k)).alias("output_file"),
    )
    return li.media_lookup(asked, jobs, items(t))


# The registry: KBs by language, changes by source.
@query("registry_upsert", """
with kbs as (select distinct lang as kb_id, lang as name from documents),
changes as (
  select case when doc_id % 4 = 0 then 'new-' || source else lang end as kb_id, doc_id as seq, case when doc_id % 3 = 0 then 'Name ' || doc_id end as name,
    case when doc_id % 5 = 0 then 'About ' || doc_id end as description, case when doc_id % 50 = 0 then doc_id::int end as chunk_size from documents),
last as (
  select kb_id, max_by(name, seq) filter (name is not null) as name, max_by(description, seq) filter (description is not null) as description, max_by(chunk_size, seq) filter (chunk_size is not null) as chunk_size
  from changes group by kb_id)
select coalesce(k.kb_id, l.kb_id) as kb_id, coalesce(l.name, k.name) as name, coalesce(l.description, '') as description, coalesce(l.chunk_size, 512) as chunk_size, 50 as chunk_overlap, 'hash-64' as embedding_model
from kbs k full join last l on l.kb_id = k.kb_id""")
def registry_upsert(t):
    none = F.lit(None)
    kbs = t.documents.select(F.col("lang").alias("kb_id"), F.col("lang").alias("name")).distinct().select(
        "*", none.cast("string").alias("description"), none.cast("int").alias("chunk_size"), none.cast("int").alias("chunk_overlap"), none.cast("string").alias("embedding_model")
    )
    i = F.col("doc_id")
    changes = t.documents.select(
        F.when(i % 4 == 0, F.concat(F.lit("new-"), "source")).otherwise(F.col("lang")).alias("kb_id"), i.alias("seq"), F.when(i % 3 == 0, named("Name ", i)).alias("name"),
        F.when(i % 5 == 0, named("About ", i)).alias("description"), F.when(i % 50 == 0, i.cast("int")).alias("chunk_size"),
        none.cast("int").alias("chunk_overlap"), none.cast("string").alias("embedding_model"),
    )
    return li.registry_upsert(kbs, changes, "hash-64")


@query("registry_documents", """
with saved as (select doc_id, lang as kb_id, case when doc_id % 4 = 0 then 'changed' else source end as author from documents where doc_id % 10 <> 3)
select * from saved""")
def registry_documents(t):
    old = t.documents.select("doc_id", F.col("lang").alias("kb_id"), F.col("source").alias("author"))
    changed = old.where("doc_id % 4 = 0").withColumn("author", F.lit("changed"))
    return upsert(old, changed, ["kb_id", "doc_id"]).join(old.where("doc_id % 10 = 3").select("kb_id", "doc_id"), ["kb_id", "doc_id"], "left_anti")


@query("registry_delete_kb", """
with gone as (select distinct lang from documents where doc_id < 2)
select 'kb' as kind, lang as id from documents where lang not in (select * from gone) group by lang
union all select 'document', doc_id::varchar from documents where lang not in (select * from gone)""")
def registry_delete_kb(t):
    from quire.operators.hierarchy import delete_rows

    docs = t.documents.select(F.col("lang").alias("kb_id"), "doc_id")
    left, _ = delete_rows({"kbs": docs.select("kb_id").distinct(), "documents": docs}, "kb_id", docs.where("doc_id < 2").select("kb_id"))
    kbs = left["kbs"].select(F.lit("kb").alias("kind"), F.col("kb_id").alias("id"))
    return kbs.unionByName(left["documents"].select(F.lit("document").alias("kind"), F.col("doc_id").cast("string").alias("id")))


# A document is in its language's KB and, when its number is even, in its source's KB.
@query("find_kb_for_document", """
with held as (select doc_id as document_id, lang as kb_id from documents union all select doc_id, source from documents where doc_id % 2 = 0)
select document_id, kb_id from held qualify row_number() over (partition by document_id order by length(kb_id) desc, kb_id) = 1""")
def find_kb_for_document(t):
    held = t.documents.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("kb_id")).unionByName(
        t.documents.where("doc_id % 2 = 0").select(F.col("doc_id").alias("document_id"), F.col("source").alias("kb_id"))
    )
    order = held.select("kb_id").distinct().withColumn("position", -F.length("kb_id"))
    return li.find_kb(held, order)
