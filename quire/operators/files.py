"""File listings and the small file-shaped tables: kinds, ordering, structure trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import course_title, lecturer
from quire.operators.common import first_per_key, union_all

# File kinds by extension.
KIND_EXTENSIONS = {
    "video": [".mp4", ".mkv", ".webm", ".avi", ".mov", ".m4v"],
    "audio": [".mp3", ".m4a", ".aac", ".m4b", ".wav", ".flac"],
    "pdf": [".pdf"],
    "image": [".jpg", ".jpeg", ".png", ".gif", ".webp"],
}


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case last suffix with its dot; a leading dot starts a name, not a suffix."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1))


def file_kind(path: Column) -> Column:
    ext = extension(path)
    kind = F.lit("other")
    for name, extensions in KIND_EXTENSIONS.items():
        kind = F.when(ext.isin(extensions), name).otherwise(kind)
    return kind


def classify_files(files: DataFrame) -> DataFrame:
    """Files and bytes per kind; dot files are not counted."""
    seen = files.where(~file_name(F.col("path")).startswith("."))
    return seen.groupBy(file_kind(F.col("path")).alias("kind")).agg(
        F.count("*").alias("files"), F.sum("length").alias("bytes")
    )


def list_downloads(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """Downloads newest first, without captures; `pattern` is a substring, a leading * is ignored."""
    name = file_name(F.col("path"))
    kept = files.where(~name.startswith("console-") & ~name.startswith("screenshot-"))
    if pattern:
        kept = kept.where(F.lower(name).contains(pattern.lstrip("*").lower()))
    return kept.select(name.alias("name"), "path", "length", "modificationTime").orderBy(
        F.desc("modificationTime"), "path"
    )


def flatten_tree(docs: DataFrame, tree: str, depth: int) -> DataFrame:
    """Preorder list of a nested tree of at most `depth` levels; missing numbers are positions."""

    def visit(nodes: Column, level: int) -> Column:
        def one(node):
            own = F.array(F.struct(node["number"].alias("number"), node["title"].alias("title"), node["start_page"].alias("start_page")))
            return F.concat(own, visit(node["children"], level + 1)) if level < depth else own

        return F.flatten(F.transform(nodes, one))

    keep = [c for c in docs.columns if c != tree]
    flat = docs.select(*keep, F.posexplode(visit(F.col(tree), 1)).alias("pos", "node"))
    return flat.select(
        *keep, "pos",
        F.coalesce("node.number", F.col("pos") + 1).alias("number"),
        F.coalesce(F.nullif(F.col("node.title"), F.lit("")), F.lit("Untitled")).alias("title"),
        F.coalesce("node.start_page", F.lit(1)).alias("start_page"),
    )


# sizes of the pieces that texts are joined on
PIECES = (1, 2, 4, 8, 16, 32)


def _pieces(text: Column, size: Column) -> Column:
    """The different pieces of a text, each of `size` characters; the text is no shorter."""
    places = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, size)))


def containment_matches(left: DataFrame, right: DataFrame, keys: list[str], inner: str, outer: str) -> DataFrame:
    """Pairs of the same keys where `outer` (right) contains `inner` (left).

    Every piece of the inner text occurs in the outer one, so the join has an equality on one of them: of
    the longest pieces of a fixed size that fit, the one the fewest outer texts have. A piece is more than
    half of its text, up to 63 characters, so few texts meet in vain. Groups are never paired whole.
    """
    size = F.lit(0)
    for n in PIECES:
        size = F.when(F.length(inner) >= n, n).otherwise(size)
    asked = left.select(*keys, inner).distinct().withColumn("_size", size).where("_size > 0")
    used = sorted(r["_size"] for r in asked.select("_size").distinct().collect())  # at most all PIECES
    # the planner takes exploded rows for no more than their source, and would send them all to the driver
    own = asked.select(*keys, inner, F.explode(_pieces(F.col(inner), F.col("_size"))).alias("_g")).hint("merge")
    fitting = F.explode(F.filter(F.array(*map(F.lit, used)).cast("array<int>"), lambda n: n <= F.length(outer)))
    sized = right.select(*keys, outer).distinct().select(*keys, outer, fitting.alias("_size"))
    held = sized.select(*keys, outer, F.explode(_pieces(F.col(outer), F.col("_size"))).alias("_g"))
    held = held.join(own.select(*keys, "_g").distinct().hint("merge"), [*keys, "_g"], "left_semi")
    counts = held.groupBy(*keys, "_g").agg(F.count("*").alias("_n")).hint("merge")
    rarest = own.join(counts, [*keys, "_g"]).groupBy(*keys, inner).agg(F.min_by("_g", F.struct("_n", "_g")).alias("_g"))
    pairs = rarest.hint("merge").join(held, [*keys, "_g"]).where(F.col(outer).contains(F.col(inner))).select(*keys, inner, outer).hint("merge")
    return left.join(pairs, [*keys, inner]).join(right.hint("merge"), [*keys, outer])


def reorder_files(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Order files(set_id, pos, name) by wanted(set_id, rank, wanted).

    An exact name wins, else the first file whose name contains or is contained in the wanted
    text; files not named follow in their own order (part 1).
    """
    exact = wanted.join(files, (wanted.set_id == files.set_id) & (wanted.wanted == files.name)).select(
        wanted.set_id, "rank", "pos", "name"
    )
    loose = wanted.join(exact.select("set_id", "rank").distinct(), ["set_id", "rank"], "left_anti")
    inside = containment_matches(loose, files, ["set_id"], "wanted", "name")
    around = containment_matches(files, loose, ["set_id"], "name", "wanted")
    columns = ["set_id", "rank", "pos", "name"]
    first = first_per_key(
        union_all([exact.select(columns), inside.select(columns), around.select(columns)]), ["set_id", "rank"], [F.col("pos")]
    )
    rest = files.join(first.select("set_id", "name").distinct(), ["set_id", "name"], "left_anti")
    return first.select("set_id", F.lit(0).alias("part"), F.col("rank").alias("place"), "name").unionByName(
        rest.select("set_id", F.lit(1).alias("part"), F.col("pos").alias("place"), "name")
    )


def course_metadata(videos: DataFrame) -> DataFrame:
    """Course title from the archive name; lecturer from the first video when it succeeded."""
    heads = videos.groupBy("archive").agg(
        F.min_by(F.struct("success", F.substring("text", 1, 1000).alias("text")), "idx").alias("v")
    )
    author = F.when(F.col("v.success"), lecturer(F.col("v.text"))).otherwise("Unknown")
    return heads.select("archive", course_title(F.col("archive")).alias("title"), author.alias("author"))
