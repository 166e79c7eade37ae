"""Queries for segments, chapters, frames and detections."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire import model
from quire.model import SQL_SEGMENTS
from quire.operators import media as me
from quire.plans.registry import query

# Pauses between events last hours, so a chapter break is a pause above twenty hours.
GAP = 72000.0

SQL_CHAPTERS = SQL_SEGMENTS + r""",
nsegs as (
  select *, row_number() over (partition by recording order by start, seq) as i, lag(fin) over (partition by recording order by start, seq) as before,
    regexp_matches(ltrim(text), '(?i)^(chapter|part|section|book|prologue|epilogue)\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten|[ivxlc]+)') as marker from segs),
walk as (
  select recording, i, 1 as n, 1 as chapter from nsegs where i = 1
  union all
  select s.recording, s.i, case when w.n >= 10 and (s.marker or s.start - s.before > 72000) then 1 else w.n + 1 end,
    case when w.n >= 10 and (s.marker or s.start - s.before > 72000) then w.chapter + 1 else w.chapter end
  from walk w join nsegs s on s.recording = w.recording and s.i = w.i + 1),
chapters as (
  select recording, chapter, case when chapter > 1 and min_by(marker, i) then trim(min_by(text, i))[:80] else 'Chapter ' || chapter end as title,
    min(start) as start, max_by(fin, i) as fin from nsegs join walk using (recording, i) group by recording, chapter)"""


def chapters(t):
    return me.detect_chapters(model.segments(t), GAP)


@query("detect_chapters", f"""
with recursive {SQL_CHAPTERS} select recording, chapter, title, round(start, 6) as start, round(fin, 6) as "end" from chapters""")
def detect_chapters(t):
    return chapters(t).withColumn("start", F.round("start", 6)).withColumn("end", F.round("end", 6))


SQL_CHAPTER_TEXTS = """texts as (
  select c.recording, c.chapter, string_agg(s.text, ' ' order by s.start, s.seq) as text from chapters c join segs s on s.recording = c.recording and s.start >= c.start and s.fin <= c.fin group by all)"""


@query("chapter_segments_text", f"""
with recursive {SQL_CHAPTERS}, {SQL_CHAPTER_TEXTS}
select recording, chapter, title, coalesce(text, '') as text from chapters left join texts using (recording, chapter)""")
def chapter_segments_text(t):
    return me.chapter_segments(chapters(t), model.segments(t)).select("recording", "chapter", "title", "text")


# A frame ten seconds before the end of every segment.
def frames(t):
    return model.segments(t).select("recording", F.col("seq").alias("frame"), (F.col("end") - 10).alias("t"))


@query("nearby_transcript", f"""
with {SQL_SEGMENTS}, frames as (select recording, seq as frame, fin - 10 as t from segs)
select f.recording, frame, coalesce(string_agg(text, ' ' order by start, seq) filter (text is not null), '') as nearby
from frames f left join segs s on s.recording = f.recording and (abs(start - t) <= 15 or abs(fin - t) <= 15 or (start <= t and t <= fin)) group by f.recording, frame""")
def nearby_transcript(t):
    return me.nearby_transcript(frames(t), model.segments(t)).select("recording", "frame", "nearby")


# Scene changes: the events of a user, with an hour played as a second.
@query("frame_schedule", f"""
with recursive {SQL_SEGMENTS},
scenes as (select recording as video, start / 3600 as t, row_number() over (partition by recording order by start, seq) as i from segs),
walk as (
  select video, i, t as last, true as keep, t from scenes where i = 1
  union all
  select s.video, s.i, case when s.t - w.last >= 10 then s.t else w.last end, s.t - w.last >= 10, s.t from walk w join scenes s on s.video = w.video and s.i = w.i + 1),
chosen as (select video, t from walk where keep),
videos as (select video, max(t) + 30 as duration from scenes group by video),
grid as (select video, unnest(range(ceil(duration / 60)::bigint)) * 60.0::double as t from videos)
select video, round(t, 6) as t from chosen
union select video, round(t, 6) from grid g where not exists (select 1 from chosen c where c.video = g.video and abs(c.t - g.t) < 10)""")
def frame_schedule(t):
    scenes = model.segments(t).select(F.col("recording").alias("video"), "seq", (F.col("start") / 3600).alias("t"))
    videos = scenes.groupBy("video").agg((F.max("t") + 30).alias("duration"))
    return me.frame_schedule(scenes, videos).withColumn("t", F.round("t", 6))


SQL_HASH = """array_to_string(list_transform(range(16), lambda n: substr('0123456789abcdef', 1 + list_sum(list_transform(range(4), lambda b:
  case when {0}[n * 4 + b + 1]::double > list_avg({0}::double[]) then (8 >> b::int) else 0 end))::int, 1)), '')"""


@query("image_hash", f"select vec_id, {SQL_HASH.format('embedding')} as hash from embeddings")
def image_hash(t):
    return t.embeddings.select("vec_id", me.image_hash(F.col("embedding")).alias("hash"))


@query("hash_similarity", f"""
with hashes as (select vec_id, {SQL_HASH.format('embedding')} as h from embeddings)
select a.vec_id, 1 - (bit_count(xor(('0x' || a.h[:8])::bigint, ('0x' || b.h[:8])::bigint)) + bit_count(xor(('0x' || a.h[9:])::bigint, ('0x' || b.h[9:])::bigint))) / 64.0::double as similarity
from hashes a join hashes b on b.vec_id = a.vec_id + 1""")
def hash_similarity(t):
    hashes = t.embeddings.select("vec_id", me.image_hash(F.col("embedding")).alias("a"))
    after = hashes.select((F.col("vec_id") - 1).alias("vec_id"), F.col("a").alias("b"))
    return hashes.join(after, "vec_id").select("vec_id", me.hash_similarity(F.col("a"), F.col("b")).alias("similarity"))


# Frames per label; five values are repeated over the picture so that copies occur.
@query("frame_dedupe", f"""
with recursive pics as (
  select label as video, vec_id as seq, vec_id % 7 <> 0 as content, list_transform(range(64), lambda i: embedding[i % 5 + 1]) as px from embeddings),
hashed as (
  select video, seq, content, ('0x' || h[:8])::bigint as a, ('0x' || h[9:])::bigint as b, row_number() over (partition by video order by seq) as i
  from (select *, {SQL_HASH.format('px')} as h from pics)),
walk as (
  select video, i, seq, false as dup, case when content then [{{'a': a, 'b': b}}] else [] end as kept from hashed where i = 1
  union all
  select video, i, seq, dup, case when content and not dup then list_slice(list_append(kept, {{'a': a, 'b': b}}), -5, -1) else kept end from (
    select h.video, h.i, h.seq, h.content, h.a, h.b, w.kept,
      coalesce(list_max(list_transform(w.kept, lambda k: 1 - (bit_count(xor(k.a, h.a)) + bit_count(xor(k.b, h.b))) / 64.0)), 0) >= 0.9 as dup
    from walk w join hashed h on h.video = w.video and h.i = w.i + 1))
select video, seq, dup as duplicate from walk""")
def frame_dedupe(t):
    pixels = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(F.col("embedding"), i % 5))
    shots = t.embeddings.select(
        F.col("label").alias("video"), F.col("vec_id").alias("seq"), me.image_hash(pixels).alias("hash"), (F.col("vec_id") % 7 != 0).alias("has_content")
    )
    return me.frame_dedupe(shots).select("video", "seq", "duplicate")


# Visuals two seconds into every segment; users divisible by five have no chapters.
def visuals(t):
    kind = F.when(F.col("seq") % 3 == 0, "talking_head").otherwise("slide")
    return model.segments(t).select(
        "recording", (F.col("start") + 2).alias("t"), F.when(F.col("seq") % 11 != 0, F.concat(F.lit("shows "), "text")).otherwise("").alias("description"),
        kind.alias("kind"), (F.col("seq") % 4 != 0).alias("has_content"),
    )


def merged(t):
    some = chapters(t).where("recording % 5 <> 0")
    return me.merge_visuals(some, model.segments(t), visuals(t))


SQL_MERGED = SQL_CHAPTERS + """,
every as (
  select * from chapters where recording % 5 <> 0
  union all select recording, 1, 'Full Video', 0, max(fin) from segs where recording % 5 = 0 group by recording),
shown as (
  select recording, start + 2 as t, 'shows ' || text as description, case when seq % 3 = 0 then 'talking_head' else 'slide' end as kind from segs
  where seq % 11 <> 0 and seq % 4 <> 0),
seen as (select e.recording, e.chapter, t, description, kind from every e join shown s on s.recording = e.recording and t >= e.start and t <= e.fin),
texts as (
  select c.recording, c.chapter, string_agg(s.text, ' ' order by s.start, s.seq) as text from every c join segs s on s.recording = c.recording and s.start >= c.start and s.fin <= c.fin group by all),
body as (select e.recording, e.chapter, title, coalesce(text, '') as text from every e left join texts using (recording, chapter))"""


@query("merge_transcript_visuals", f"""
with recursive {SQL_MERGED}
select recording, chapter, 'text' as kind, title, null::double as t, text from body
union all select recording, chapter, kind, null, round(t, 6), description from seen""")
def merge_transcript_visuals(t):
    texts, seen = merged(t)
    return texts.select("recording", "chapter", F.lit("text").alias("kind"), "title", F.lit(None).cast("double").alias("t"), "text").unionByName(
        seen.select("recording", "chapter", "kind", F.lit(None).cast("string").alias("title"), F.round("t", 6).alias("t"), F.col("description").alias("text"))
    )


@query("merged_text", f"""
with recursive {SQL_MERGED},
notes as (
  select recording, chapter, string_agg('[' || floor(t / 60)::bigint || ':' || lpad(floor(t - floor(t / 60) * 60)::bigint::varchar, 2, '0') || '] ' || description || E'\\n\\n', '' order by t, description) as stamps,
    string_agg(case when kind <> 'talking_head' then E'\\n\\n[On screen: ' || description || E']\\n\\n' else '' end, '' order by t, description) as spoken,
    string_agg('- ' || description || chr(10), '' order by t, description) as bullets from seen group by all)
select recording, chapter, E'\\n\\n## ' || title || E'\\n\\n' || text || coalesce(E'\\n\\n### Visual Content\\n\\n' || stamps, '') as reading,
  case when coalesce(spoken, '') <> '' then text || chr(10) || spoken else text end as narration, trim(text || coalesce(E'\\n\\n[Visual Content]\\n' || bullets, ''), E' \\n\\t') as indexed
from body left join notes using (recording, chapter)""")
def merged_text(t):
    return me.merged_text(*merged(t))


def videos(t):
    return model.segments(t).groupBy("recording").agg(F.max("end").alias("duration")).select(
        (F.col("recording") % 5).alias("batch"), F.col("recording").alias("idx"), "recording", "duration", (F.col("recording") % 4 != 0).alias("success")
    )


SQL_VIDEOS = "videos as (select recording % 5 as batch, recording as idx, recording, max(fin) as duration, recording % 4 <> 0 as success from segs group by recording)"


@query("combine_chapters", f"""
with recursive {SQL_CHAPTERS}, {SQL_VIDEOS},
moved as (select *, coalesce(sum(duration::decimal(20,6)) over (partition by batch order by idx rows between unbounded preceding and 1 preceding), 0) as off from videos)
select batch, row_number() over (partition by batch order by idx, chapter) as number, idx, title, round((start::decimal(20,6) + off)::double, 6) as start, round((fin::decimal(20,6) + off)::double, 6) as "end",
  round(start, 6) as local_start, round(fin, 6) as local_end from moved join chapters using (recording) where success""")
def combine_chapters(t):
    rows = me.combine_chapters(videos(t), chapters(t))
    exact = [F.round(c, n).alias(c) for c, n in (("start", 6), ("end", 6), ("local_start", 6), ("local_end", 6))]
    return rows.select("batch", "number", "idx", "title", *exact)


@query("batch_totals", f"""
with {SQL_SEGMENTS}, {SQL_VIDEOS}
select batch, count(*) filter (success) as succeeded, count(*) filter (not success) as failed, round(coalesce(sum(duration) filter (success), 0), 4) as duration from videos group by batch""")
def batch_totals(t):
    return me.batch_totals(videos(t)).withColumn("duration", F.round("duration", 4))


@query("chapter_markers", r"""
with files as (
  select source as archive, doc_id as seq, case when doc_id % 3 = 0 then 'intro_' || doc_id else 'chapter_0' || doc_id || '_' || replace(text, ' ', '_') end as stem, n_chars * 10 as ms from documents)
select archive, seq, case when regexp_matches(stem, '^chapter_(\d+)_(.+)') then 'Chapter ' || regexp_extract(stem, '^chapter_(\d+)_(.+)', 1)::bigint || ': ' || replace(regexp_extract(stem, '^chapter_(\d+)_(.+)', 2), '_', ' ') else stem end as title,
  (sum(ms) over w - ms)::bigint as start_ms, (sum(ms) over w)::bigint as end_ms from files window w as (partition by archive order by seq)""")
def chapter_markers(t):
    i = F.col("doc_id")
    chapter = F.concat(F.lit("chapter_0"), i.cast("string"), F.lit("_"), F.replace(F.col("text"), F.lit(" "), F.lit("_")))
    stem = F.when(i % 3 == 0, F.concat(F.lit("intro_"), i.cast("string"))).otherwise(chapter)
    files = t.documents.select(F.col("source").alias("archive"), i.alias("seq"), stem.alias("stem"), (F.col("n_chars") * 10).alias("duration_ms"))
    return me.chapter_markers(files)


# Each vector is a page of 32 detections: pairs of values are x and y, the next value the height.
@query("reconstruct_lines", """
with raw as (select vec_id as page, unnest(range(32)) as i, embedding from embeddings),
dets as (
  select page, i as seq, embedding[2*i + 1]::double * 1000 as x, embedding[2*i + 2]::double * 1000 as y, embedding[(2*i + 3) % 64 + 1]::double * 300 as height, 'w' || i as text,
    (i * 7 + page) % 10 / 10.0::double as confidence from raw),
kept as (select * from dets where confidence >= 0.25),
med as (select page, list_sort(list(height) filter (height > 0))[count(*) filter (height > 0) // 2 + 1] as m from kept group by page),
flagged as (
  select k.*, coalesce(m, 20) as median, coalesce((abs(y - lag(y) over (partition by k.page order by y, x, seq)) >= coalesce(m, 20) * 0.5)::int, 0) as nl from kept k join med using (page)),
lined as (select *, sum(nl) over (partition by page order by y, x, seq) as line from flagged),
lines as (select page, line, median, string_agg(text, ' ' order by x, seq) as text, avg(y) as my from lined group by all),
spaced as (select *, case when my - lag(my) over (partition by page order by line) > median * 1.5 then chr(10) else '' end || text as body from lines)
select page, string_agg(body, chr(10) order by line) as text from spaced group by page""")
def reconstruct_lines(t):
    e, i = F.col("embedding"), F.col("i")
    dets = t.embeddings.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(31))).alias("i")).select(
        F.col("vec_id").alias("page"), i.alias("seq"), (F.get(e, i * 2).cast("double") * 1000).alias("x"), (F.get(e, i * 2 + 1).cast("double") * 1000).alias("y"),
        (F.get(e, (i * 2 + 3) % 64).cast("double") * 300).alias("height"), F.concat(F.lit("w"), i.cast("string")).alias("text"),
        ((i * 7 + F.col("vec_id")) % 10 / 10).alias("confidence"),
    )
    return me.reconstruct_lines(dets)
