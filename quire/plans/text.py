"""Queries for text cleaning, splitting, chunking and string scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import model
from quire.functions import text as fx
from quire.model import SQL_WORDS, sql_chunks
from quire.operators import chunking
from quire.operators.files import course_metadata, flatten_tree, reorder_files
from quire.operators.entities import entity_type, indicator_count
from quire.plans.registry import query

TRIM = r"trim({0}, E' \n\t\r')"


# Pages as they come out of a scanner: stamps, page numbers, broken words and repeated footers.
def scanned(t):
    c = F.col("text")
    return t.documents.select(
        "doc_id",
        F.concat(
            F.lit("Personal use only, do NOT reproduce.\n"), F.col("doc_id").cast("string"), F.lit("\n\n\n\n"),
            F.replace(c, F.lit("the"), F.lit("t-\nhe")),
            F.lit("\nCONFIDENTIAL: internal copy. 2024-01-02 reader@example.com\n  12  \nA  draft\t text  \n"),
            F.repeat(F.concat(F.lit("Footer of source "), F.col("source"), F.lit("\n")), 5),
        ).alias("text"),
    )


SQL_SCANNED = r"""scanned as (
  select doc_id, 'Personal use only, do NOT reproduce.' || chr(10) || doc_id || repeat(chr(10), 4)
    || replace(text, 'the', 't-' || chr(10) || 'he')
    || E'\nCONFIDENTIAL: internal copy. 2024-01-02 reader@example.com\n  12  \nA  draft\t text  \n'
    || repeat('Footer of source ' || source || chr(10), 5) as text
  from documents)"""


def sql_replace_all(column: str, patterns) -> str:
    for pattern, put, flags in patterns:
        quoted = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{quoted}', '{put}', '{flags}')"
    return column


SQL_DEMARKED = SQL_SCANNED + rf""",
stripped as (
  select doc_id, {sql_replace_all('text', [
      (r'personal\s+use\s+only[,.]?\s*do\s+not\s+reproduce\.?', '', 'gi'),
      (r'do\s+not\s+reproduce\.?\s*personal\s+use\s+only', '', 'gi'),
      (r'\d{4}[-/]\d{2}[-/]\d{2}\s+\S+@\S+\.\S+', '', 'gi'),
      (r'\S+@\S+\.\S+\s+\d{4}[-/]\d{2}[-/]\d{2}', '', 'gi'),
      (r'©\s*\d{4}[^.]*\.?\s*all\s+rights\s+reserved\.?', '', 'gi'),
      (r'confidential[:\s]+[^.]*\.?', '', 'gi'),
      (r'proprietary[:\s]+[^.]*\.?', '', 'gi'),
      (r'\bdraft\b', '', 'gi'),
      (r'\bsample\s+copy\b', '', 'gi'),
  ])} as text from scanned),
numbered as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos
  from stripped),
counted as (
  select *, row_number() over (partition by doc_id, {TRIM.format('line')} order by pos) as copy from numbered),
demarked as (
  select doc_id, string_agg(line, chr(10) order by pos) as text from counted
  where not (length({TRIM.format('line')}) between 11 and 79 and copy > 3) group by doc_id)"""

SQL_CLEANED = SQL_DEMARKED + rf""",
joined as (
  select doc_id, {sql_replace_all('text', [
      (r'(?m)^\d+\s*$', '', 'g'), (r'\n{3,}', r'\n\n', 'g'), (r'([\w\p{L}])-\n([\w\p{L}])', r'\1\2', 'g'),
  ]).replace(r"'\n\n'", "chr(10) || chr(10)")} as text from demarked),
cleaned as (
  select doc_id, {TRIM.format("regexp_replace(regexp_replace(array_to_string(list_filter(string_split(text, chr(10)), lambda x: not regexp_full_match(trim(x, E' \\t'), '[0-9]{1,3}')), chr(10)), '[ \\t]+', ' ', 'g'), ' +\\n', chr(10), 'g')")} as text
  from joined)"""


@query("remove_watermarks", "with " + SQL_DEMARKED + " select * from demarked")
def remove_watermarks(t):
    return scanned(t).select("doc_id", fx.remove_watermarks(F.col("text")).alias("text"))


@query("clean_text", "with " + SQL_CLEANED + " select * from cleaned")
def clean_text(t):
    return scanned(t).select("doc_id", fx.clean_text(F.col("text")).alias("text"))


# Text with everything speech normalisation must spell out or drop.
def spoken(t):
    return t.documents.select(
        "doc_id",
        F.concat(
            F.lit("“Dr. Roy” — see https://example.com/x and a@b.org, e.g. Fig. 3 … "), F.col("text"),
            F.lit(" 3×4 ≤ 12 (Smith & Jones, 2005) [Figure 1.2] (Table 3) [12] vol. 2 • a word2 Then ----- end.... pp. 4 % x"),
        ).alias("text"),
    )


def _sql_spoken() -> str:
    text = "text"
    for char, put in fx.CHARACTER_REPLACEMENTS.items():
        quoted = put.replace("'", "''")
        text = f"replace({text}, chr({ord(char)}), '{quoted}')"
    text = sql_replace_all(text, [
        (r"[^\x00-\x7f\x{c0}-\x{ff}]", " ", "g"), (r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", "g"), (r"\s+", " ", "g")])
    for short, spelled in fx.ABBREVIATIONS.items():
        text = f"replace({text}, '{short}', '{spelled}')"
    # RE2 has no look-around: the neighbours are matched and put back instead
    text = sql_replace_all(text, [
        (r"https?://\S+", "", "g"), (r"\S+@\S+\.\S+", "", "g"),
        (r"\([A-Za-z&\s]+,?\s*\d{4}[a-z]?\)", "", "g"),
        (r"\((?:[A-Za-z]+,?\s*\d{4}[a-z]?[;,]\s*)+[A-Za-z]+,?\s*\d{4}[a-z]?\)", "", "g"),
        (r"[\[(](?:Figure|Table|Fig|Tab)\.?\s+[\d.]+[\])]", "", "gi"),
        (r"(?m)^(?:Figure|Table|Fig|Tab)\.?\s+[\d.]+[.:]\s*", "", "gi"),
        (r"\(p{1,2}\.\s*\d+(?:\s*-\s*\d+)?\)", "", "g"), (r"[\x{a9}\x{ae}\x{2122}]", "", "g"), (r"\[\d+\]", "", "g"),
        # a mark before each capital letter keeps the letter free to be the left neighbour of the next match
        ("([A-Z])", "\x02\\1", "g"), ("([\\w\\p{L}])\\s*\\d\\s*\x02", "\\1 ", "g"), ("\x02", "", "g"),
        (r"[.]{2,}", ".", "g"), (r"[,]{2,}", ",", "g"), (r"[-]{3,}", ", ", "g"),
        (r"(^|[^\w\p{L}])\s+[^aAI\s]\s+([^\w\p{L}]|$)", r"\1 \2", "g"),
        (r" {2,}", " ", "g")])
    return rf"""with spoken as (
  select doc_id, chr(8220) || 'Dr. Roy' || chr(8221) || ' ' || chr(8212) || ' see https://example.com/x and a@b.org, e.g. Fig. 3 '
    || chr(8230) || ' ' || text || ' 3' || chr(215) || '4 ' || chr(8804) || ' 12 (Smith & Jones, 2005) [Figure 1.2] (Table 3) [12] vol. 2 '
    || chr(8226) || ' a word2 Then ----- end.... pp. 4 % x' as text from documents)
select doc_id, {TRIM.format(text)} as text from spoken"""


@query("normalize_text", _sql_spoken())
def normalize_text(t):
    return spoken(t).select("doc_id", fx.normalize_text(F.col("text")).alias("text"))


@query("split_sentences", rf"""
with parts as (
  select doc_id, false as before_capital, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) as p from documents
  union all
  select doc_id, true, string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)) from documents),
kept as (select doc_id, before_capital, list_filter(list_transform(p, lambda x: {TRIM.format('x')}), lambda x: x <> '') as p from parts)
select doc_id, before_capital, unnest(p) as sentence, generate_subscripts(p, 1) - 1 as pos from kept""")
def split_sentences(t):
    text = F.col("text")
    forms = F.array(
        F.struct(F.lit(False).alias("before_capital"), fx.sentences(text).alias("s")),
        F.struct(F.lit(True).alias("before_capital"), fx.sentences(text, True).alias("s")),
    )
    both = t.documents.select("doc_id", F.inline(forms))
    return both.select("doc_id", "before_capital", F.posexplode("s").alias("pos", "sentence"))


def with_paragraphs(t):
    """The prose has single line breaks; every other line starts a paragraph here."""
    lines = F.split("text", "\n")
    spaced = F.transform(lines, lambda line, i: F.concat(line, F.when(i % 2 == 1, "\n\n").otherwise("\n")))
    return t.documents.select("doc_id", F.array_join(spaced, "").alias("text"))


SQL_PARAGRAPHED = r"""spaced as (
  select doc_id, array_to_string(list_transform(string_split(text, chr(10)),
    lambda line, i: line || case when i % 2 = 0 then chr(10) || chr(10) else chr(10) end), '') as text from documents)"""

# Greedy packing in SQL: a recursive walk over the pieces of every text at once.
SQL_SPLIT_PARAGRAPHS = rf"""with recursive {SQL_PARAGRAPHED},
paras as (
  select doc_id, generate_subscripts(p, 1) as para, unnest(p) as body from (
    select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda x: {TRIM.format('x')}), lambda x: x <> '') as p from spaced)),
pieces as (
  select doc_id, para, generate_subscripts(s, 1) as i, unnest(s) as piece, len(s) as n from (
    select doc_id, para, case when length(body) <= 1000 then [body] else
      list_filter(list_transform(string_split(regexp_replace(body, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1)),
        lambda x: {TRIM.format('x')}), lambda x: x <> '') end as s from paras)),
walk as (
  select doc_id, para, i, n, piece as cur, null::varchar as done from pieces where i = 1
  union all
  select p.doc_id, p.para, p.i, p.n,
    case when length(w.cur) + length(p.piece) > 1000 then p.piece else w.cur || ' ' || p.piece end,
    case when length(w.cur) + length(p.piece) > 1000 then w.cur end
  from walk w join pieces p on p.doc_id = w.doc_id and p.para = w.para and p.i = w.i + 1),
outs as (
  select doc_id, para, i * 2 as o, done as paragraph from walk where done is not null
  union all select doc_id, para, i * 2 + 1, cur from walk where i = n)
select doc_id, row_number() over (partition by doc_id order by para, o) - 1 as pos, paragraph from outs"""


@query("split_paragraphs", SQL_SPLIT_PARAGRAPHS)
def split_paragraphs(t):
    return with_paragraphs(t).select("doc_id", F.posexplode(chunking.paragraphs(F.col("text"))).alias("pos", "paragraph"))


# Two recursive walks: over the sentences of a text, and over the clauses of a long sentence.
SQL_CHUNK_SENTENCES = rf"""with recursive sents as (
  select doc_id, generate_subscripts(p, 1) as i, unnest(p) as s, len(p) as n from (
    select doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)),
      lambda x: {TRIM.format('x')}), lambda x: x <> '') as p from documents)),
walk as (
  select doc_id, i, n, case when length(s) <= 500 then s end as cur, length(s) + 1 as used, null::varchar as done from sents where i = 1
  union all
  select s.doc_id, s.i, s.n,
    case when length(s.s) > 500 then null when w.cur is null or w.used + length(s.s) > 500 then s.s else w.cur || ' ' || s.s end,
    case when w.cur is null then length(s.s) + 1 when w.used + length(s.s) > 500 then length(s.s) else w.used + length(s.s) + 1 end,
    case when length(s.s) > 500 or w.used + length(s.s) > 500 then w.cur end
  from walk w join sents s on s.doc_id = w.doc_id and s.i = w.i + 1),
clauses as (
  select doc_id, i, generate_subscripts(c, 1) as j, unnest(c) as s, len(c) as n from (
    select doc_id, i, string_split(regexp_replace(s, '([,;:])\s+', chr(2) || '\1' || chr(2), 'g'), chr(2)) as c from sents where length(s) > 500)),
inner_walk as (
  select doc_id, i, j, n, s as cur, length(s) + 1 as used, null::varchar as done from clauses where j = 1
  union all
  select c.doc_id, c.i, c.j, c.n,
    case when w.used + length(c.s) > 500 then c.s else w.cur || ' ' || c.s end,
    case when w.used + length(c.s) > 500 then length(c.s) else w.used + length(c.s) + 1 end,
    case when w.used + length(c.s) > 500 then w.cur end
  from inner_walk w join clauses c on c.doc_id = w.doc_id and c.i = w.i and c.j = w.j + 1),
outs as (
  select doc_id, i, 0 as o, done as piece from walk where done is not null
  union all select doc_id, i, 2 * j, done from inner_walk where done is not null
  union all select doc_id, i, 2 * j + 1, cur from inner_walk where j = n
  union all select doc_id, i, 1000000, cur from walk where i = n and cur is not null)
select doc_id, row_number() over (partition by doc_id order by i, o) - 1 as pos, piece from outs"""


@query("chunk_sentences_chars", SQL_CHUNK_SENTENCES)
def chunk_sentences_chars(t):
    return t.documents.select("doc_id", F.posexplode(chunking.sentence_chunks(F.col("text"), 500)).alias("pos", "piece"))


SQL_CHUNK_PARAGRAPHS = rf"""with recursive {SQL_PARAGRAPHED},
paras as (
  select doc_id, generate_subscripts(p, 1) as i, unnest(p) as body, len(p) as n from (
    select doc_id, list_filter(list_transform(string_split_regex(text, '\n\s*\n'), lambda x: {TRIM.format('x')}), lambda x: x <> '') as p from spaced)),
sized as (select *, {SQL_WORDS.format('body')} as w from paras),
walk as (
  select doc_id, i, n, case when len(w) > 120 then null else body end as cur, case when len(w) > 120 then 0 else len(w) end as used,
    null::varchar as done, case when len(w) > 120 then w end as long from sized where i = 1
  union all
  select s.doc_id, s.i, s.n,
    case when len(s.w) > 120 then null when k.cur is null or k.used + len(s.w) > 120 then s.body else k.cur || chr(10) || chr(10) || s.body end,
    case when len(s.w) > 120 then 0 when k.cur is null or k.used + len(s.w) > 120 then len(s.w) else k.used + len(s.w) end,
    case when len(s.w) > 120 or k.used + len(s.w) > 120 then k.cur end,
    case when len(s.w) > 120 then s.w end
  from walk k join sized s on s.doc_id = k.doc_id and s.i = k.i + 1),
outs as (
  select doc_id, i, 0 as o, done as text from walk where done is not null
  union all
  select doc_id, i, 1 + j, array_to_string(list_slice(long, j*100 + 1, j*100 + 120), ' ')
  from (select doc_id, i, long, unnest(range(ceil((len(long) - 120) / 100.0)::bigint + 1)) as j from walk where long is not null)
  union all
  select doc_id, i, 1000000, cur from walk where i = n and cur is not null)
select doc_id, row_number() over (partition by doc_id order by i, o) - 1 as position, text, len({SQL_WORDS.format('text')})::int as token_count from outs"""


@query("chunk_paragraphs", SQL_CHUNK_PARAGRAPHS)
def chunk_paragraphs(t):
    return with_paragraphs(t).select("doc_id", F.inline(chunking.paragraph_chunks(F.col("text"), 120, 20)))


@query("count_tokens", rf"select doc_id, len({SQL_WORDS.format('text')}) as tokens from documents")
def count_tokens(t):
    return t.documents.select("doc_id", fx.count_tokens(F.col("text")).alias("tokens"))


@query("estimate_tokens", "select doc_id, greatest(1, length(text) // 3) as est_tokens from documents")
def estimate_tokens(t):
    return t.documents.select("doc_id", fx.estimate_tokens(F.col("text")).alias("est_tokens"))


@query("chunk_tokens", f"with {sql_chunks(128, 16)} select kb_id, document_id, chunk_id, position, text, token_count from chunks")
def chunk_tokens(t):
    return model.document_chunks(t, 128, 16)


@query("filter_empty_chunks", rf"""
select doc_id, pos - 1 as pos, line as text from (
  select doc_id, unnest(string_split(text || E'\n \n\t\n', chr(10))) as line,
         generate_subscripts(string_split(text || E'\n \n\t\n', chr(10)), 1) as pos from documents)
where {TRIM.format('line')} <> ''""")
def filter_empty_chunks(t):
    padded = F.concat("text", F.lit("\n \n\t\n"))
    return chunking.filter_empty(t.documents.select("doc_id", F.posexplode(F.split(padded, "\n")).alias("pos", "text")))


@query("make_embedding_batches", f"""
with recursive {sql_chunks(128, 16)},
sized as (
  select kb_id, chunk_id, greatest(1, length(text) // 3) as est, row_number() over (partition by kb_id order by document_id, position) as i from chunks),
walk as (
  select kb_id, chunk_id, i, est, 0 as batch_no, 1 as n, est as used from sized where i = 1
  union all
  select s.kb_id, s.chunk_id, s.i, s.est,
    case when w.n >= 40 or w.used + s.est > 8000 then w.batch_no + 1 else w.batch_no end,
    case when w.n >= 40 or w.used + s.est > 8000 then 1 else w.n + 1 end,
    case when w.n >= 40 or w.used + s.est > 8000 then s.est else w.used + s.est end
  from walk w join sized s on s.kb_id = w.kb_id and s.i = w.i + 1)
select kb_id, chunk_id, est as est_tokens, batch_no from walk""")
def make_embedding_batches(t):
    chunks = model.document_chunks(t, 128, 16)
    batched = chunking.embedding_batches(chunks, ["kb_id"], ["document_id", "position"], max_texts=40, max_tokens=8000)
    return batched.select("kb_id", "chunk_id", "est_tokens", "batch_no")


# Model replies around the event properties: fenced, plain, wrapped in prose, and broken ones.
@query("parse_model_json", r"""
with replies as (
  select event_id, case event_id % 4
    when 0 then E'```json\n' || props || E'\n```' when 1 then E'Sure:\n```\n' || props || E'\n``` done'
    when 2 then 'The answer is ' || props || '.' else 'no object, ' || event_type end as reply from events),
bodies as (
  select event_id, case when contains(reply, '```json') then string_split(string_split(reply, '```json')[2], '```')[1]
    when contains(reply, '```') then string_split(reply, '```')[2] else reply end as body from replies)
select event_id, try_cast(json_extract_string(try_cast(nullif(regexp_extract(body, '(?s)\{.*\}'), '') as json), '$.k') as bigint) as k from bodies""")
def parse_model_json(t):
    i = F.col("event_id") % 4
    reply = (
        F.when(i == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```")))
        .when(i == 1, F.concat(F.lit("Sure:\n```\n"), "props", F.lit("\n``` done")))
        .when(i == 2, F.concat(F.lit("The answer is "), "props", F.lit(".")))
        .otherwise(F.concat(F.lit("no object, "), "event_type"))
    )
    return t.events.select("event_id", fx.parse_model_json(reply, "k bigint")["k"].alias("k"))


SQL_TYPE_MAP = """case {0} when 'concept' then 'CONCEPT' when 'technique' then 'TECHNIQUE' when 'term' then 'TERM'
  when 'person' then 'PERSON' when 'organization' then 'ORGANIZATION' when 'tool' then 'TOOL' when 'work' then 'WORK'
  when 'location' then 'ORGANIZATION' when 'product' then 'TOOL' when 'event' then 'CONCEPT' when 'date' then 'TERM'
  when 'work of art' then 'WORK' else 'CONCEPT' end"""
SQL_LABELS = "['Person', 'tool', 'EVENT', 'date', 'work of art', 'location', 'product', 'technique', 'unknown']"


def part_label():
    labels = ["Person", "tool", "EVENT", "date", "work of art", "location", "product", "technique", "unknown"]
    return F.element_at(F.array(*map(F.lit, labels)), (F.col("p_partkey") % 9 + 1).cast("int"))


@query("map_entity_type", f"""
select p_partkey, {SQL_LABELS}[p_partkey % 9 + 1] as label, {SQL_TYPE_MAP.format(f'lower({SQL_LABELS}[p_partkey % 9 + 1])')} as type from part""")
def map_entity_type(t):
    return t.part.select("p_partkey", part_label().alias("label"), entity_type(part_label()).alias("type"))


@query("parse_name_type_lines", rf"""
with replies as (
  select p_partkey, p_name || ' | ' || {SQL_LABELS}[p_partkey % 9 + 1] || chr(10) || p_brand || E'|tool|new\nx|term\nno bar ' || p_type || E'\n|person' as reply
  from part),
lines as (select p_partkey, {TRIM.format('unnest(string_split(reply, chr(10)))')} as line, generate_subscripts(string_split(reply, chr(10)), 1) - 1 as line_no from replies),
cut as (select p_partkey, line_no, {TRIM.format("line[:strpos(line, '|') - 1]")} as name, lower({TRIM.format("line[strpos(line, '|') + 1:]")}) as label from lines where contains(line, '|'))
select p_partkey, line_no, name, {SQL_TYPE_MAP.format('label')} as type from cut where length(name) >= 2""")
def parse_name_type_lines(t):
    from quire.operators.entities import name_type_lines

    reply = F.concat(
        F.lit(" \n"), "p_name", F.lit(" | "), part_label(), F.lit("\n"), "p_brand", F.lit("|tool|new\nx|term\nno bar "), "p_type", F.lit("\n|person")
    )
    return name_type_lines(t.part.select("p_partkey", reply.alias("reply")), "reply")


@query("has_entity_indicators", r"""
with ascii as (
  select doc_id, regexp_replace('Dr. Roy of the University met Ms. Anna Lee in March. ' || text, '[^\x00-\x7f]', '0', 'g') as x from documents)
select doc_id, (len(regexp_extract_all(x, '\b(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.)\s+[A-Z]'))
  + len(regexp_extract_all(x, '\b[A-Z][a-z]+\s+[A-Z][a-z]+\b'))
  + len(regexp_extract_all(x, '(?i)\b(?:University|Institute|Corporation|Inc\.|Ltd\.)\b'))
  + len(regexp_extract_all(x, '(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b'))) as indicators,
  indicators > 3 and 2 < greatest(1, len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) // 200) as missed
from ascii""")
def has_entity_indicators(t):
    from quire.operators.entities import has_entity_indicators as missed

    text = F.concat(F.lit("Dr. Roy of the University met Ms. Anna Lee in March. "), "text")
    return t.documents.select("doc_id", indicator_count(text).alias("indicators"), missed(text, F.lit(2)).alias("missed"))


# A contents list per document: its lines, numbered, each with a page; every third line has none.
@query("parse_toc_lines", rf"""
with toc as (
  select doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda line, i:
    '  ' || i || ' ' || line || case when i % 3 = 0 then '' else ' ' || (i * 7) end), chr(10)) as toc from documents),
lines as (select doc_id, {TRIM.format('unnest(string_split(toc, chr(10)))')} as line from toc)
select doc_id, regexp_extract(line, '^(\d+)\s+(.+?)\s+(\d+)$', 1)::bigint as number, {TRIM.format(r"regexp_extract(line, '^(\d+)\s+(.+?)\s+(\d+)$', 2)")} as title,
       regexp_extract(line, '^(\d+)\s+(.+?)\s+(\d+)$', 3)::bigint + 13 as start_page
from lines where regexp_matches(line, '^(\d+)\s+(.+?)\s+(\d+)$')""")
def parse_toc_lines(t):
    def entry(line, i):
        page = F.when((i + 1) % 3 == 0, "").otherwise(F.concat(F.lit(" "), ((i + 1) * 7).cast("string")))
        return F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(" "), line, page)

    toc = F.array_join(F.transform(F.split("text", "\n"), entry), "\n")
    return t.documents.select("doc_id", F.inline(fx.toc_entries(toc)))


@query("detect_headings", r"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
entries as (
  select doc_id, i, i * 3 as page, case i % 6 when 0 then 'Chapter ' || i || ': ' || line when 1 then 'PART IV ' || line
    when 2 then i || ' Introduction to words' when 3 then 'Page_' || i || '.pdf' when 4 then '12-' || i || '.pdf' else line end as title from lines),
found as (
  select *, case when regexp_matches(title, '^Page_\d+\.pdf$') or regexp_matches(title, '^[\d\-]+\.pdf$') then null
    when regexp_matches(title, '(?i)^chapter\s+(\d+)[:\s]*(.*)$') then regexp_extract(title, '(?i)^chapter\s+(\d+)', 1)
    when regexp_matches(title, '(?i)^(\d+)\s+([A-Z][a-z\s]+)$') then regexp_extract(title, '^(\d+)', 1)
    when regexp_matches(title, '(?i)^part\s+([IVX]+)[:\s]*(.*)$') then regexp_extract(title, '(?i)^part\s+([IVX]+)', 1) end as number from entries)
select doc_id, title, page - 1 as page, number from found where number is not null""")
def detect_headings(t):
    from quire.operators.hierarchy import headings

    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("p", "line"))
    i, line = F.col("p") + 1, F.col("line")
    text_i = i.cast("string")
    title = (
        F.when(i % 6 == 0, F.concat(F.lit("Chapter "), text_i, F.lit(": "), line))
        .when(i % 6 == 1, F.concat(F.lit("PART IV "), line))
        .when(i % 6 == 2, F.concat(text_i, F.lit(" Introduction to words")))
        .when(i % 6 == 3, F.concat(F.lit("Page_"), text_i, F.lit(".pdf")))
        .when(i % 6 == 4, F.concat(F.lit("12-"), text_i, F.lit(".pdf")))
        .otherwise(line)
    )
    return headings(lines.select("doc_id", title.alias("title"), (i * 3).alias("page"))).select("doc_id", "title", "page", "number")


# Structure trees: a chapter per line of a document with the sentences of the line as children.
@query("flatten_structure", rf"""
with lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
nodes as (
  select doc_id, i, 0 as j, line as title, case when i % 2 = 0 then i end as number, i * 2 as page from lines
  union all
  select doc_id, i, generate_subscripts(string_split(line, ' '), 1), unnest(string_split(line, ' ')), null, null from lines)
select doc_id, coalesce(number, pos + 1)::int as number, case when title = '' then 'Untitled' else title end as title, coalesce(page, 1)::int as start_page, pos from (
  select *, row_number() over (partition by doc_id order by i, j) - 1 as pos from nodes)""")
def flatten_structure(t):
    def chapter(line, i):
        head = line
        none = F.lit(None).cast("int")
        return F.struct(
            F.when((i + 1) % 2 == 0, i + 1).alias("number"), head.alias("title"), ((i + 1) * 2).alias("start_page"),
            F.transform(
                F.split(head, " "), lambda w: F.struct(none.alias("number"), w.alias("title"), none.alias("start_page"))
            ).alias("children"),
        )

    trees = t.documents.select("doc_id", F.transform(F.split("text", "\n"), chapter).alias("structure"))
    return flatten_tree(trees, "structure", depth=2)


# Upload sets: the parts of a brand as files; the wanted order names some exactly, some in short.
@query("reorder_files", r"""
with files as (select p_brand as set_id, p_partkey as pos, p_name || '-' || p_partkey || '.pdf' as name from part),
wanted as (
  select p_brand as set_id, 1000000000 - p_partkey as rank,
    case when p_partkey % 3 = 0 then p_name || '-' || p_partkey || '.pdf' else p_partkey || '.pdf' end as wanted from part),
hits as (
  select w.set_id, w.rank, f.name, row_number() over (partition by w.set_id, w.rank order by case when f.name = w.wanted then 0 else 1 end, f.pos) as r
  from wanted w join files f on f.set_id = w.set_id and (f.name = w.wanted or contains(f.name, w.wanted) or contains(w.wanted, f.name)))
select set_id, 0 as part, rank as place, name from hits where r = 1
union all
select set_id, 1, pos, name from files f where not exists (select 1 from hits h where h.r = 1 and h.set_id = f.set_id and h.name = f.name)""")
def reorder_files_query(t):
    name = F.concat("p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(".pdf"))
    files = t.part.select(F.col("p_brand").alias("set_id"), F.col("p_partkey").alias("pos"), name.alias("name"))
    short = F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf"))
    wanted = t.part.select(
        F.col("p_brand").alias("set_id"), (F.lit(1000000000) - F.col("p_partkey")).alias("rank"),
        F.when(F.col("p_partkey") % 3 == 0, name).otherwise(short).alias("wanted"),
    )
    return reorder_files(files, wanted)


SQL_MINE_START = r"""(?i)^["']?([^"']+?)["']?\s+by\s+([^,.]+)"""
SQL_MINE_INTRO = r"""(?i)(?:this is|presenting|welcome to)\s+["']?([^"']+?)["']?\s+by\s+([^,.]+)"""


def _sql_group(text: str, pattern: str, group: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"nullif({TRIM.format(f"regexp_extract({text}, '{quoted}', {group})")}, '')"


@query("mine_metadata", rf"""
with openings as (
  select doc_id, case doc_id % 3 when 0 then 'Hello. This is "' || array_to_string(list_slice({SQL_WORDS.format('text')}, 1, 3), ' ') || '" by Ann ' || source || ', read by Bo Li. '
    when 1 then 'Long title by ' || source || '; narrated  by Cy Day.' else '' end || text as x from documents
  union all
  select 1000000000 + conv_id, string_agg(text, ' ' order by turn) from (
    select conv_id, turn, text, row_number() over (partition by conv_id order by turn) as r from conversations) where r <= 20 group by conv_id),
intro as (select doc_id, case when doc_id >= 1000000000 then x else x[:2000] end as x from openings),
raw as (
  select doc_id, {_sql_group('x', SQL_MINE_INTRO, 1)} as t1, {_sql_group('x', SQL_MINE_INTRO, 2)} as a1,
    {_sql_group("trim(x, E' \\n\\t')", SQL_MINE_START, 1)} as t2, {_sql_group("trim(x, E' \\n\\t')", SQL_MINE_START, 2)} as a2,
    {_sql_group('x', r"(?i)written by\s+([^,.]+)", 1)} as a3, {_sql_group('x', r"(?i)(?:read|narrated)\s+by\s+([^,.]+)", 1)} as n from intro)
select doc_id, regexp_replace(coalesce(t1, t2), '[.,;:!?]+$', '') as title,
  regexp_replace(coalesce(case when t1 is not null then a1 else a2 end, a3), '[.,;:!?]+$', '') as author, regexp_replace(n, '[.,;:!?]+$', '') as narrator from raw""")
def mine_metadata(t):
    from quire.operators.media import intro_text

    first = F.array_join(F.slice(fx.words(F.col("text")), 1, 3), " ")
    opening = (
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('Hello. This is "'), first, F.lit('" by Ann '), "source", F.lit(", read by Bo Li. ")))
        .when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Long title by "), "source", F.lit("; narrated  by Cy Day.")))
        .otherwise("")
    )
    texts = t.documents.select("doc_id", F.substring(F.concat(opening, "text"), 1, 2000).alias("intro"))
    talks = intro_text(t.conversations, "conv_id", "turn").select((F.col("conv_id") + 1000000000).alias("doc_id"), "intro")
    return texts.unionByName(talks).select("doc_id", fx.mine_metadata(F.col("intro")).alias("m")).select("doc_id", "m.*")


@query("infer_course_metadata", rf"""
with videos as (
  select source || '_Course_Lectures' as archive, doc_id, doc_id % 3 <> 1 as success,
    case when doc_id % 2 = 0 then 'Welcome, I''m Professor Ann Lee of ' else 'this is  Dr. Boole ' end || text as x from documents),
first as (select *, row_number() over (partition by archive order by doc_id) as r from videos)
select archive, replace(replace(replace(archive, '_Lectures', ''), '_Course', ''), '_', ' ') as title,
  case when success then coalesce(nullif(regexp_extract(x[:1000], '(?:I''m|I am|this is)\s+(?:Professor|Dr\.?)\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)', 1), ''), 'Unknown') else 'Unknown' end as author
from first where r = 1""")
def infer_course_metadata(t):
    talk = F.when(F.col("doc_id") % 2 == 0, "Welcome, I'm Professor Ann Lee of ").otherwise("this is  Dr. Boole ")
    videos = t.documents.select(
        F.concat("source", F.lit("_Course_Lectures")).alias("archive"), F.col("doc_id").alias("idx"),
        (F.col("doc_id") % 3 != 1).alias("success"), F.concat(talk, "text").alias("text"),
    )
    return course_metadata(videos)


@query("coalesce_media_tags", """
select event_id, coalesce(case when event_id % 3 = 0 then 'T' || event_id end, event_type) as title,
  case when event_id % 2 = 0 then 'A' || user_id else 'C' || user_id end as author from events""")
def coalesce_media_tags(t):
    i, u = F.col("event_id"), F.col("user_id")
    tags = F.create_map(
        F.lit("Title"), F.when(i % 3 == 0, F.concat(F.lit("T"), i.cast("string"))).otherwise(""),
        F.lit("ALBUM"), F.col("event_type"),
        F.lit("Artist"), F.when(i % 2 == 0, F.concat(F.lit("A"), u.cast("string"))),
        F.lit("composer"), F.concat(F.lit("C"), u.cast("string")),
    )
    return t.events.select(
        "event_id", fx.first_tag(tags, "title", "album", "name").alias("title"),
        fx.first_tag(tags, "artist", "author", "album_artist", "composer").alias("author"),
    )


@query("natural_sort_key", r"""
with names as (select c_custkey, lower('Lecture_' || c_custkey || '_of_' || c_name || case when c_custkey % 2 = 0 then 'b' else '' end) as name from customer)
select c_custkey, array_to_string(list_transform(regexp_extract_all(name, '\d+|\D+'), lambda p: case when regexp_full_match(p, '\d+')
  then lpad(length(ltrim(p, '0'))::varchar, 4, '0') || ltrim(p, '0') else p end), '|') as sort_key from names""")
def natural_sort_key(t):
    tail = F.when(F.col("c_custkey") % 2 == 0, "b").otherwise("")
    name = F.concat(F.lit("Lecture_"), F.col("c_custkey").cast("string"), F.lit("_of_"), "c_name", tail)
    keyed = t.customer.select("c_custkey", fx.natural_key(name).alias("key")).orderBy("key")
    return keyed.select("c_custkey", F.array_join(F.filter("key", lambda p: p != ""), "|").alias("sort_key"))


@query("text_preview", "select doc_id, case when length(text) > 200 then text[:200] || '...' else text end as preview from documents")
def text_preview(t):
    return t.documents.select("doc_id", fx.text_preview(F.col("text")).alias("preview"))


@query("safe_file_name", r"""
select doc_id, replace(regexp_replace(string_split(text, chr(10))[1], '[^\w\p{L}\s-]', '', 'g')[:50], ' ', '_') as file_name from documents""")
def safe_file_name(t):
    return t.documents.select("doc_id", fx.safe_file_name(F.split("text", "\n")[0]).alias("file_name"))


@query("escape_query", r"""
select item_id, replace(regexp_replace(replace('a+b/(' || text || ')\"x"*', '\', '\\'), '([+\-&|!(){}\[\]^"~*?:])', '\\\\\1', 'g'), '/', '\/') as escaped from benchmark""")
def escape_query(t):
    dressed = F.concat(F.lit("a+b/("), "text", F.lit(')\\"x"*'))
    return t.benchmark.select("item_id", fx.escape_query(dressed).alias("escaped"))


@query("escape_markup", "select page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as html from pages")
def escape_markup(t):
    return t.pages.select("page_id", fx.escape_markup(F.col("html")).alias("html"))
