"""The registered queries of the operators, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.anchors import BASE_KINDS, listed, personal_data
from quire.llm.ball_hashing import simhash_groups
from quire.llm.block_naming import exact_dedup
from quire.llm.bpe import round_trip
from quire.llm.common import Scratch
from quire.llm.divergence import source_divergence
from quire.llm.hard_negatives import hard_negatives
from quire.llm.line_blocks import extract_text
from quire.llm.line_join import line_report
from quire.llm.multi_index import nearest
from quire.llm.rule_ensemble import quality_scores
from quire.llm.sos_packing import pack_documents
from quire.llm.warc import archive, read_bundles
from quire.llm.weak_rules import quality_rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op4_exact_dedup",
    """
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
           doc_id = max(doc_id) over g as kept, sha256(coalesce(text, '')) as text_sha256
    from documents window g as (partition by coalesce(text, ''))
    """,
)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents").select("doc_id", "text"), table(spark, folder, "labels").select("doc_id", "quality")
    return quality_scores(docs, labels).select("doc_id", "held_out", "score", "predicted")


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    scored = quality_rules(table(spark, folder, "documents").select("doc_id", "text"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


@query("op6_html_extraction")
def op6_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = personal_data(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("spans", lambda s: s["kind"])
    per_kind = [(F.size("spans") - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *per_kind, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return simhash_groups(docs).select("doc_id", "fingerprint", "component_id")


@query("op8_bpe")
def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return round_trip(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query("op3_packing")
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return pack_documents(docs).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query(
    "op5_warc",
    """
    with p as (select page_id, coalesce(html, '') as html, max(page_id) over (partition by coalesce(html, '')) as response from pages),
         h as (select *, sha1(html) as hex from p),
         d as (
           select *, list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
             ((instr('0123456789abcdef', substr(hex, (5 * i) // 4 + 1, 1)) - 1) * 16
              + greatest(instr('0123456789abcdef', substr(hex || '0', (5 * i) // 4 + 2, 1)) - 1, 0)
             ) // (1 << (3 - (5 * i) % 4)::int)) % 32)::int, 1)) as letters
           from h)
    select page_id, strlen(html) as payload_bytes, array_to_string(letters, '') as payload_digest,
           case when page_id = response then 'response' else 'revisit' end as record_type,
           case when page_id <> response then response end as refers_to
    from d
    """,
)
def op5_warc(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    bundles = f"{scratch.folder}/bundles"
    archive(table(spark, folder, "pages").select("page_id", "url", "html"), bundles, scratch=scratch)
    read = read_bundles(spark, bundles)
    return read.select(read["record_id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op10_line_dedup",
    """
    with l as (
           select doc_id, u.i - 1 as line, u.t as content
           from (select doc_id, unnest(list_transform(string_split(text, chr(10)), lambda t, i: {'i': i, 't': t})) as u from documents where text is not null)
           where regexp_matches(u.t, '[^\\x20\\x09-\\x0D]')),
         f as (select content, min((doc_id, line)) as pos from l group by content),
         s as (select pos, list_distinct(regexp_extract_all(content, '[^\\x20\\x09-\\x0D]+')) as words from f),
         w as (select pos, len(words) as n, unnest(words) as word from s),
         p as (
           select b.pos, a.pos as earlier
           from w a join w b on a.word = b.word and a.pos < b.pos and a.n * 5 >= b.n * 4 and b.n * 5 >= a.n * 4
           group by b.pos, a.pos, a.n, b.n
           having count(*) * 9 >= (a.n + b.n) * 4),
         k as (select pos from f where pos not in (select pos from p)),
         m as (select doc_id, line, (doc_id, line) in (select pos from k) as stays from l)
    select d.doc_id, count(m.line) as n_lines, count(*) filter (stays) as n_kept,
           coalesce(string_agg(m.line::varchar, ',' order by m.line) filter (not stays), '') as removed
    from documents d left join m on d.doc_id = m.doc_id
    group by d.doc_id
    """,
)
def op10_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    report = line_report(table(spark, folder, "documents").select("doc_id", "text"))
    return report.select("doc_id", "n_lines", "n_kept", F.array_join("removed", ",").alias("removed"))


@query("op11_multi_index")
def op11_multi_index(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest(rows, Scratch(spark, "multi-index"), F.col("vec_id") % 20 == 0).select("query_id", "rank", "vec_id", "score")


@query(
    "op12_source_divergence",
    """
    with d as (
           select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as terms
           from documents),
         o as (select row, lang, source, unnest(terms) as term from d),
         k as (select lang, term, count(*) as n from o group by lang, term having count(distinct row) >= 3),
         lk as (select lang, sum(n)::hugeint as total, count(*)::hugeint as v from k group by lang),
         c as (select lang, source, term, count(*) as n from o join k using (lang, term) group by lang, source, term),
         g as (select lang, source, coalesce(sum(n), 0)::hugeint as total from (select distinct lang, source from d) left join c using (lang, source) group by lang, source),
         p as (
           select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                  1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.total + lk.v) as p,
                  1 + (1000000000::hugeint * (k.n + 1)) // (lk.total + lk.v) as q
           from g join k on g.lang = k.lang join lk on g.lang = lk.lang
           left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
         t as (
           select lang, source, 'term' as part, term as item, (p - q) * (p - q) // q as value,
                  row_number() over (partition by lang, source order by (p - q) * (p - q) // q desc, term) as rank
           from p where n > 0 and p > q),
         s as (
           select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value
           from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
         r as (
           select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0) as value
           from g a join g b on a.lang = b.lang and a.source <> b.source
           left join s on s.lang = a.lang and s.source = a.source and s.item = b.source)
    select lang, source, part, item, value::bigint as value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from r
    union all
    select lang, source, part, item, value::bigint, rank::int from t where rank <= 200
    """,
)
def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents").select("lang", "source", "text"), Scratch(spark, "divergence"))


@query(
    "op13_hard_negatives",
    """
    with e as (
           select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) as v
           from embeddings
           where vec_id is not null and label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
         s as (
           select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, coalesce(list_dot_product(a.v, b.v), 0)::bigint as score
           from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
         p as (
           select anchor_id, vec_id as positive_id, score as positive_score from s where same
           qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
         n as (
           select p.anchor_id, positive_id, positive_score, s.vec_id as negative_id, s.score as negative_score,
                  (row_number() over (partition by p.anchor_id, positive_id order by s.score desc, s.vec_id))::int as rank
           from p join s on p.anchor_id = s.anchor_id and not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
    select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from n where rank <= 3
    """,
)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"))
    return hard_negatives(rows, Scratch(spark, "negatives"), F.col("vec_id") % 50 == 0)
