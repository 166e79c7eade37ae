"""Time-ordered media tables: segments, chapters, frames and detections.

Joins of times with spans use time buckets as an equality, so a long recording is never paired
with itself; sequential rules are scans over blocks (`scans.py`).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.common import neighbour_value, running_sum, top_k
from quire.operators.scans import SCAN_ROWS, MinimumRun, Spacing, openings
from quire.session import stored

# Chapter markers at the start of a segment.
CHAPTER_MARKER = (
    r"(?iU)^(chapter|part|section|book|prologue|epilogue)\s+"
    r"(\d+|one|two|three|four|five|six|seven|eight|nine|ten|[ivxlc]+)"
)


def intro_text(segments: DataFrame, recording: str, order: str, k: int = 20) -> DataFrame:
    """The first k segments of each recording as one text."""
    first = top_k(segments.select(recording, order, "text"), [recording], [F.col(order)], k)
    parts = F.array_sort(F.collect_list(F.struct("rank", "text")))
    return first.groupBy(recording).agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("intro"))


def detect_chapters(segments: DataFrame, min_gap: float = 3.0, min_segments: int = 10, rows: int = SCAN_ROWS) -> DataFrame:
    """Chapters (recording, chapter, title, start, end) of segments(recording, seq, start, end, text).

    Once a chapter has enough segments, a marker phrase or a long pause opens the next one.
    """
    marker = F.ltrim("text").rlike(CHAPTER_MARKER)
    # of the texts only the titles of markers go through the scan
    marked = segments.select("recording", "seq", "start", "end", marker.alias("_marker"), F.when(marker, F.substring(F.trim("text"), 1, 80)).alias("_given"))
    paused = neighbour_value(marked, ["recording"], ["start", "seq"], "end", "_last_end", block_rows=rows)
    may = F.coalesce(F.col("_marker") | (F.col("start") - F.col("_last_end") > min_gap), F.col("_marker"), F.lit(False))
    numbered = openings(paused.withColumn("_may", may.cast("int")), ["recording"], ["start", "seq"], "_may", MinimumRun(min_segments), "_opens", rows)
    # the scan only says where chapters open; a running sum numbers them
    numbered = running_sum(numbered, ["recording"], ["start", "seq"], {"_before": F.col("_opens")}, counted=segments)
    numbered = numbered.withColumn("chapter", (F.col("_before") + F.col("_opens") + 1).cast("int"))
    order = F.struct("start", "seq")
    grouped = numbered.groupBy("recording", "chapter").agg(
        F.min("start").alias("start"), F.max_by("end", order).alias("end"), F.min_by(F.struct("_given"), order).alias("_first")
    )
    title = F.when((F.col("chapter") > 1) & F.col("_first._given").isNotNull(), F.col("_first._given")).otherwise(F.concat(F.lit("Chapter "), F.col("chapter").cast("string")))
    return grouped.select("recording", "chapter", title.alias("title"), "start", "end")


def span_join(points: DataFrame, spans: DataFrame, key: str, at: str, start: Column, end: Column, width: float) -> DataFrame:
    """Points joined to the spans of the same key whose [start, end] holds `at`.

    Each span is listed under every bucket of `width` it touches, each point under its own.
    """
    buckets = F.explode(F.sequence(F.floor(start / width), F.floor(end / width))).alias("_bucket")
    listed = spans.where(end >= start).withColumn("_s", start).withColumn("_e", end).select("*", buckets)
    placed = points.withColumn("_bucket", F.floor(F.col(at) / width))
    return placed.join(listed, [key, "_bucket"]).where((F.col(at) >= F.col("_s")) & (F.col(at) <= F.col("_e"))).drop("_bucket", "_s", "_e")


def ordered_list(rows: DataFrame, keys: list[str], order: list[str], text: str, separator: str, out: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), separator).alias(out))


def chapter_segments(chapters: DataFrame, segments: DataFrame, width: float = 3600.0) -> DataFrame:
    """Text of each chapter: its segments that start and end inside it."""
    spans = chapters.select("recording", "chapter", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    inside = span_join(segments, spans, "recording", "start", F.col("c_start"), F.col("c_end"), width).where(F.col("end") <= F.col("c_end"))
    texts = ordered_list(inside, ["recording", "chapter"], ["start", "seq"], "text", " ", "text")
    return chapters.join(texts, ["recording", "chapter"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def nearby_transcript(frames: DataFrame, segments: DataFrame, window: float = 15.0, width: float = 60.0) -> DataFrame:
    """Text around each frame (recording, frame, t): segments near or over its time."""
    reach = window + 1e-6  # the exact test follows; rounding must not lose a border case
    spans = segments.select("recording", "seq", "start", "end", "text")
    pairs = span_join(frames, spans, "recording", "t", F.col("start") - reach, F.col("end") + reach, width)
    near = (F.abs(F.col("start") - F.col("t")) <= window) | (F.abs(F.col("end") - F.col("t")) <= window)
    kept = pairs.where(near | ((F.col("start") <= F.col("t")) & (F.col("t") <= F.col("end"))))
    texts = ordered_list(kept, ["recording", "frame"], ["start", "seq"], "text", " ", "nearby")
    return frames.join(texts, ["recording", "frame"], "left").withColumn("nearby", F.coalesce("nearby", F.lit("")))


def frame_schedule(scenes: DataFrame, videos: DataFrame, gap: float = 10.0, interval: float = 60.0, rows: int = SCAN_ROWS) -> DataFrame:
    """Times (video, t) to capture: scene changes at least `gap` apart, and every `interval` where
    no captured scene is near. `scenes` has video, seq, t; `videos` has video, duration."""
    timed = scenes.select("video", "seq", F.col("t").cast("double").alias("t"))
    chosen = openings(timed, ["video"], ["t", "seq"], "t", Spacing(gap), "keep", rows).where("keep = 1").select("video", "t")
    last_slot = F.ceil(F.col("duration") / interval) - 1
    grid = videos.where("duration > 0").select("video", F.explode(F.sequence(F.lit(0).cast("long"), last_slot)).alias("slot"))
    near = chosen.select(
        "video", "t", F.explode(F.sequence(F.floor((F.col("t") - gap) / interval), F.ceil((F.col("t") + gap) / interval))).alias("slot")
    ).where(F.abs(F.col("t") - F.col("slot") * interval) < gap)
    free = grid.join(near.select("video", "slot").distinct(), ["video", "slot"], "left_anti")
    return chosen.unionByName(free.select("video", (F.col("slot") * interval).alias("t"))).distinct()


def image_hash(pixels: Column) -> Column:
    """Mean hash of 64 grey values as 16 hex digits."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(pixels)
    bits = F.array_join(F.transform(pixels, lambda p: F.when(p.cast("double") > mean, "1").otherwise("0")), "")
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def hash_similarity(a: Column, b: Column) -> Column:
    """Share of equal bits of two 16-digit hashes; 0 when one is missing."""

    def half(h, at):
        return F.conv(F.substring(h, at, 8), 16, 10).cast("long")

    differing = sum((F.bit_count(half(a, at).bitwiseXOR(half(b, at))) for at in (1, 9)), F.lit(0))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).otherwise(1.0 - differing / 64.0)


def frame_dedupe(frames: DataFrame, high: float = 0.9, low: float = 0.7, decide=None, recent: int = 5, rows: int = SCAN_ROWS) -> DataFrame:
    """Add `duplicate`: a frame much like one of the last kept content frames of its video.

    `frames` has video, seq, hash, has_content. Between `low` and `high` the caller's `decide`
    (two hashes → bool) is asked; without one the frame is kept.

    What a stretch of frames does to the last kept ones has no small table, so the frames of a video
    are walked in order; they stream by, and only `recent` hashes are held. A frame that repeats the
    content frame before it is a duplicate whatever was kept, and changes nothing: such frames, nearly
    all of a still picture, are told in parallel and never walked.
    """
    base = neighbour_value(frames, ["video"], ["seq"], F.struct("hash", "has_content"), "_before", block_rows=rows)
    repeats = F.coalesce((F.col("hash") != "") & (F.col("hash") == F.col("_before.hash")) & F.col("_before.has_content"), F.lit(False)) & F.lit(high <= 1)
    base = stored(base.withColumn("_repeats", repeats).drop("_before"), "frames")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, kept, begun = None, (), False
        for batch in batches:
            columns = [batch.column(name).to_pylist() for name in ("video", "hash", "has_content")]
            labels = []
            for own, hashed, content in zip(*columns):
                if not begun or own != video:
                    video, kept, begun = own, (), True
                number = int(hashed, 16) if hashed else None
                duplicate = False
                for other, text in kept if hashed else ():
                    similarity = 1.0 - (number ^ other).bit_count() / 64.0 if text else 0.0
                    if similarity >= high or (similarity >= low and decide is not None and decide(hashed, text)):
                        duplicate = True
                        break
                if content and not duplicate:
                    kept = (*kept, (number, hashed or ""))[-recent:]
                labels.append(duplicate)
            yield pa.record_batch([batch.column("video"), batch.column("seq"), pa.array(labels, pa.bool_())], names=["video", "seq", "duplicate"])

    walked = base.where("not _repeats").select("video", "seq", "hash", "has_content").repartition("video").sortWithinPartitions("video", "seq")
    types = {f.name: f.dataType.simpleString() for f in base.schema}
    labels = walked.mapInArrow(walk, f"video {types['video']}, seq {types['seq']}, duplicate boolean")
    told = labels.select(F.col("video").alias("_video"), F.col("seq").alias("_seq"), "duplicate")
    joined = base.join(told, base["video"].eqNullSafe(told["_video"]) & base["seq"].eqNullSafe(told["_seq"]), "left")
    return joined.select(*frames.columns, F.when(F.col("_repeats"), True).otherwise(F.col("duplicate")).alias("duplicate"))


def merge_visuals(chapters: DataFrame, segments: DataFrame, visuals: DataFrame, width: float = 3600.0) -> tuple[DataFrame, DataFrame]:
    """Chapters with their text, and their visuals (recording, chapter, t, description, kind).

    A recording without chapters is one chapter from 0 to its end. Visuals need a description.
    """
    chapters = stored(chapters, "own-chapters")
    ends = segments.groupBy("recording").agg(F.max("end").alias("end"))
    whole = ends.join(chapters.select("recording").distinct(), "recording", "left_anti").select(
        "recording", F.lit(1).alias("chapter"), F.lit("Full Video").alias("title"), F.lit(0.0).alias("start"), "end"
    )
    # several joins read the chapters, and finding them is the dear part
    every = stored(chapters.select("recording", "chapter", "title", "start", "end").unionByName(whole), "chapters")
    # a span is listed under every bucket it touches: some two, where buckets are as long as the mean span
    mean = every.where(F.col("end") >= F.col("start")).agg(F.avg(F.col("end") - F.col("start")).alias("mean")).first()["mean"]
    width = max(width, mean or 0.0)
    shown = visuals.where("has_content and description <> ''").select("recording", "t", "description", "kind")
    spans = every.select("recording", "chapter", "start", "end")
    inside = span_join(shown, spans, "recording", "t", F.col("start"), F.col("end"), width)
    return chapter_segments(every, segments, width), inside.select("recording", "chapter", "t", "description", "kind")


def merged_text(chapters: DataFrame, visuals: DataFrame) -> DataFrame:
    """Each chapter as text: `reading` with a list of its visuals, `narration` with what is on
    screen (no talking heads), `indexed` for ingestion."""
    minutes = F.floor(F.col("t") / 60).cast("long")
    seconds = F.lpad(F.floor(F.col("t") - F.floor(F.col("t") / 60) * 60).cast("string"), 2, "0")
    notes = visuals.select(
        "recording", "chapter", "t", "description",
        F.concat(F.lit("["), minutes.cast("string"), F.lit(":"), seconds, F.lit("] "), "description", F.lit("\n\n")).alias("stamp"),
        F.when(F.col("kind") != "talking_head", F.concat(F.lit("\n\n[On screen: "), "description", F.lit("]\n\n"))).otherwise("").alias("spoken"),
        F.concat(F.lit("- "), "description", F.lit("\n")).alias("bullet"),
    )
    parts = F.array_sort(F.collect_list(F.struct("t", "description", "stamp", "spoken", "bullet")))
    grouped = notes.groupBy("recording", "chapter").agg(parts.alias("_v"))

    def joined(field):
        return F.array_join(F.transform("_v", lambda v: v[field]), "")

    some = F.col("_v").isNotNull()
    rows = chapters.join(grouped, ["recording", "chapter"], "left")
    reading = F.concat(F.lit("\n\n## "), "title", F.lit("\n\n"), "text", F.when(some, F.concat(F.lit("\n\n### Visual Content\n\n"), joined("stamp"))).otherwise(""))
    narration = F.when(some & (joined("spoken") != ""), F.concat("text", F.lit("\n"), joined("spoken"))).otherwise(F.col("text"))
    indexed = F.when(some, F.concat("text", F.lit("\n\n[Visual Content]\n"), joined("bullet"))).otherwise(F.col("text"))
    return rows.select("recording", "chapter", reading.alias("reading"), narration.alias("narration"), F.btrim(indexed, F.lit(" \n\t")).alias("indexed"))


def combine_chapters(videos: DataFrame, chapters: DataFrame) -> DataFrame:
    """Chapters of a batch with running numbers and times moved by the videos before.

    `videos` has batch, idx, recording, duration, success; failed videos give time but no chapters.
    """
    offsets = running_sum(videos, ["batch"], ["idx"], {"offset": F.col("duration").cast("decimal(20,6)")}).where("success")
    rows = offsets.select("batch", "idx", "recording", "offset").join(chapters, "recording")
    numbered = running_sum(rows, ["batch"], ["idx", "chapter"], {"number": F.lit(1)})

    def moved(time):
        # decimals: sums of many durations in any order are the same
        return (F.col(time).cast("decimal(20,6)") + F.col("offset")).cast("double").alias(time)

    return numbered.select(
        "batch", (F.col("number") + 1).alias("number"), "idx", "title", moved("start"), moved("end"), F.col("start").alias("local_start"), F.col("end").alias("local_end"),
    )


def batch_totals(videos: DataFrame) -> DataFrame:
    return videos.groupBy("batch").agg(
        F.count_if("success").alias("succeeded"), F.count_if(~F.col("success")).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("success"), F.col("duration"))), F.lit(0.0)).alias("duration"),
    )


def marker_title(stem: Column) -> Column:
    """Title from a file stem "chapter_01_Some_Name"; any other stem is its own title."""
    pattern = r"(?U)^chapter_(\d+)_(.+)"
    number = F.regexp_extract(stem, pattern, 1).cast("long").cast("string")
    named = F.concat(F.lit("Chapter "), number, F.lit(": "), F.replace(F.regexp_extract(stem, pattern, 2), F.lit("_"), F.lit(" ")))
    return F.when(stem.rlike(pattern), named).otherwise(stem)


def chapter_markers(files: DataFrame) -> DataFrame:
    """Start and end of each file when all files of an archive play in order."""
    rows = running_sum(files, ["archive"], ["seq"], {"start_ms": F.col("duration_ms")})
    return rows.select("archive", "seq", marker_title(F.col("stem")).alias("title"), "start_ms", (F.col("start_ms") + F.col("duration_ms")).alias("end_ms"))


def reconstruct_lines(detections: DataFrame, threshold: float = 0.25) -> DataFrame:
    """Text of each page from detections(page, seq, x, y, height, text, confidence).

    Detections within half the median height below the one before share a line; a gap between
    lines above one and a half medians starts a paragraph.
    """
    kept = detections.where(F.col("confidence") >= threshold)
    sized = running_sum(kept.where("height > 0").select("page", "seq", "height"), ["page"], ["height", "seq"], {"i": F.lit(1)})
    counts = sized.groupBy("page").agg(F.floor(F.count("*") / 2).alias("mid"))
    middle = sized.join(counts, "page").where("i = mid").select("page", F.col("height").alias("median"))
    rows = kept.join(middle, "page", "left").withColumn("median", F.coalesce("median", F.lit(20.0)))
    order = ["y", "x", "seq"]
    before = neighbour_value(rows, ["page"], order, "y", "_before")
    starts = (F.abs(F.col("y") - F.col("_before")) >= F.col("median") * 0.5).cast("int")
    flagged = before.withColumn("_new", F.coalesce(starts, F.lit(0)))
    lined = running_sum(flagged, ["page"], order, {"_done": F.col("_new")}).withColumn("line", F.col("_done") + F.col("_new"))
    words = F.array_sort(F.collect_list(F.struct("x", "seq", "text")))
    lines = lined.groupBy("page", "line", "median").agg(
        F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), F.avg("y").alias("mean_y")
    )
    spaced = neighbour_value(lines, ["page"], ["line"], "mean_y", "_above")
    lead = F.when(F.col("mean_y") - F.col("_above") > F.col("median") * 1.5, "\n").otherwise("")
    return ordered_list(spaced.withColumn("_text", F.concat(lead, "text")), ["page"], ["line"], "_text", "\n", "text")
