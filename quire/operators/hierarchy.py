"""Section trees, chapter ranges, course hierarchies and cascading deletes.

Trees are rows with parent, level and order columns. A parent may have any number of children, so
children stay rows in place of nested lists.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators.common import as_of, first_per_key, neighbour_value, running_sum, union_all
from quire.operators.files import containment_matches

# tasks among which the rows of a deleted key are dealt
SALTS = 64


def headings(entries: DataFrame) -> DataFrame:
    """Chapter-like entries of a contents list with their number; pages become zero-based."""
    numbered = entries.withColumn("number", fx.heading_number(F.col("title"))).where("number is not null")
    return numbered.withColumn("page", F.col("page") - 1)


def sections_from_tree(nodes: DataFrame, levels: int) -> DataFrame:
    """Sibling order and end page of tree rows (document_id, section_id, parent_id, level, title, start_page).

    Siblings go by (start_page, section_id). A section ends where its next sibling starts, the last
    one where its parent ends.
    """
    family = ["document_id", "_parent"]
    order = ["start_page", "section_id"]
    rows = nodes.withColumn("_parent", F.coalesce("parent_id", F.lit("")))
    ordered = running_sum(rows, family, order, {"order": F.lit(1)})
    nexts = neighbour_value(ordered, family, order, "start_page", "_next", ahead=True).drop("_parent")
    done = None
    for level in range(levels):
        here = nexts.where(F.col("level") == level)
        if done is None:
            resolved = here.withColumn("end_page", F.col("_next"))
        else:
            parents = resolved.select("document_id", F.col("section_id").alias("parent_id"), F.col("end_page").alias("_up"))
            resolved = here.join(parents, ["document_id", "parent_id"], "left").withColumn("end_page", F.coalesce("_next", "_up"))
        tidy = resolved.select(
            "document_id", "section_id", "parent_id", "level", F.col("order").cast("int").alias("order"), "title", "start_page", "end_page"
        )
        done = tidy if done is None else done.unionByName(tidy)
    return done


def link_chunks_to_sections(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(chunk_id, section_id): the section with the greatest start at or before the chunk's page
    that has not ended; the deeper one on ties. Sections starting at page 0 never match.

    Sections of one level do not overlap, so per level only the last start can hold the page.
    """
    marks = sections.where("start_page > 0").select(
        "document_id", "level", F.col("start_page").alias("page"), F.col("section_id").alias("tie"),
        F.struct("section_id", "start_page", "end_page").alias("section"),
    )
    levels = sections.select("document_id", "level").distinct()
    pages = chunks.select("document_id", F.col("page_number").alias("page")).distinct()
    points = pages.join(levels, "document_id").withColumn("tie", F.lit(""))
    held = as_of(points, marks, ["document_id", "level"], "page", "section", "tie")
    valid = held.where("section is not null and (section.end_page is null or page <= section.end_page)")
    best = first_per_key(valid, ["document_id", "page"], [F.desc("section.start_page"), F.desc("level")])
    found = best.select("document_id", F.col("page").alias("page_number"), F.col("section.section_id").alias("section_id"))
    return chunks.join(found, ["document_id", "page_number"]).select("chunk_id", "section_id")


def chapter_ranges(chapters: DataFrame, page_counts: DataFrame) -> DataFrame:
    """End page of each chapter: the page before the next one, the last page for the last one."""
    nexts = neighbour_value(chapters, ["document_id"], ["start_page", "chapter_id"], "start_page", "_next", ahead=True)
    return nexts.join(page_counts, "document_id").withColumn("end_page", F.coalesce(F.col("_next"), F.col("pages")) - 1).drop("_next", "pages")


def ordered_text(rows: DataFrame, keys: list[str], order: list[str], text: str, separator: str, out: str = "text") -> DataFrame:
    """The texts of each key in order as one value."""
    parts = F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["_t"]), separator).alias(out))


def chapter_texts(chapters: DataFrame, pages: DataFrame) -> DataFrame:
    """Cleaned text of each chapter (document_id, chapter_id, start_page, end_page) from its pages."""
    marks = chapters.select(
        "document_id", F.col("start_page").alias("page"), F.col("chapter_id").alias("tie"), F.struct("chapter_id", "end_page").alias("chapter")
    )
    points = pages.select("document_id", "page", "text", F.lit("").alias("tie"))
    held = as_of(points, marks, ["document_id"], "page", "chapter", "tie").where("page <= chapter.end_page")
    texts = ordered_text(held.select("document_id", "chapter.chapter_id", "page", "text"), ["document_id", "chapter_id"], ["page"], "text", "\n")
    joined = chapters.join(texts, ["document_id", "chapter_id"], "left")
    return joined.withColumn("text", fx.clean_text(F.coalesce("text", F.lit(""))))


def sample_text(pages: DataFrame, max_pages: int = 25) -> DataFrame:
    """First pages as "=== PAGE n ===" blocks, with the page count. Pages count from 1."""
    block = F.concat(F.lit("=== PAGE "), F.col("page").cast("string"), F.lit(" ===\n"), F.col("text"))
    sample = ordered_text(pages.where(F.col("page") <= max_pages).withColumn("_b", block), ["document_id"], ["page"], "_b", "\n\n", "sample")
    counts = pages.groupBy("document_id").agg(F.count("*").alias("total_pages"))
    return sample.join(counts, "document_id")


def page_text(pages: DataFrame, cache: DataFrame) -> DataFrame:
    """Recognised text where the document needs it, else extracted text plus its annotations.

    `pages` has document_id, page, text, annotations, needs_ocr; `cache` has document_id, page, ocr_text.
    """
    notes = F.filter(F.transform("annotations", fx.strip), lambda a: a != "")
    plain = F.when(F.size(notes) > 0, F.concat("text", F.lit("\n"), F.array_join(notes, "\n"))).otherwise(F.col("text"))
    text = F.when(F.col("needs_ocr"), F.coalesce("ocr_text", F.lit(""))).otherwise(plain)
    return pages.join(cache, ["document_id", "page"], "left").select("document_id", "page", text.alias("text"))


def section_tree(sections: DataFrame, chunk_links: DataFrame, max_depth: int = 5) -> DataFrame:
    """Sections with chunk counts and the parent they hang under; a node deeper than `max_depth`,
    or without its parent, is a root. Siblings go by (level, order)."""
    counts = chunk_links.groupBy("section_id").agg(F.count("*").alias("chunk_count"))
    known = sections.select(F.col("section_id").alias("parent_id"), F.lit(True).alias("_known"))
    placed = sections.join(counts, "section_id", "left").join(known, "parent_id", "left")
    parent = F.when(F.col("_known") & (F.col("level") <= max_depth), F.col("parent_id"))
    return placed.select(
        "document_id", "section_id", parent.alias("tree_parent"), "level", "order", "title", "start_page", "end_page",
        F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    )


def section_content(sections: DataFrame, chunk_links: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Rows of each section: itself, its children by order and, if given, its chunks by position."""
    counts = chunk_links.groupBy("section_id").agg(F.count("*").alias("chunk_count"))
    own = sections.join(counts, "section_id", "left").select(
        "section_id", F.lit("section").alias("kind"), F.col("section_id").alias("item_id"), "title",
        F.lit(0).alias("place"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"),
    )
    children = sections.where("parent_id is not null").select(
        F.col("parent_id").alias("section_id"), F.lit("child").alias("kind"), F.col("section_id").alias("item_id"), "title", F.col("order").alias("place")
    )
    parts = [own, children]
    if chunks is not None:
        body = chunk_links.join(chunks, "chunk_id")
        parts.append(body.select("section_id", F.lit("chunk").alias("kind"), F.col("chunk_id").alias("item_id"), F.col("text").alias("title"), F.col("position").alias("place")))
    return union_all(parts)


def section_by_title(sections: DataFrame, asked: DataFrame) -> DataFrame:
    """First section (by level, order, id) of the document whose title contains the asked text."""
    titled = sections.withColumn("_title", F.lower("title"))
    wanted = asked.select("document_id", F.lower("wanted").alias("_wanted"), "wanted")
    hits = containment_matches(wanted, titled, ["document_id"], "_wanted", "_title")
    first = first_per_key(hits, ["document_id", "wanted"], [F.col("level"), F.col("order"), F.col("section_id")])
    return first.select("document_id", "wanted", "section_id", "title")


def breadcrumbs(sections: DataFrame, levels: int) -> DataFrame:
    """Titles from the root down to each section, by one parent join per level."""
    nodes = sections.select("document_id", "section_id", "parent_id", "title")
    path = nodes.select("document_id", "section_id", F.col("parent_id").alias("_up"), F.array("title").alias("path"))
    for _ in range(levels - 1):
        parents = nodes.select("document_id", F.col("section_id").alias("_up"), F.col("parent_id").alias("_next"), F.col("title").alias("_t"))
        joined = path.join(parents, ["document_id", "_up"], "left")
        grown = F.when(F.col("_t").isNotNull(), F.concat(F.array("_t"), F.col("path"))).otherwise(F.col("path"))
        path = joined.select("document_id", "section_id", F.col("_next").alias("_up"), grown.alias("path"))
    return path.select("document_id", "section_id", "path")


def enrich_results(hits: DataFrame, chunk_links: DataFrame, paths: DataFrame, concepts: DataFrame) -> DataFrame:
    """Hits with the breadcrumb of their section and the related entity names of their chunk."""
    trail = chunk_links.join(paths, "section_id").select("chunk_id", "path")
    names = concepts.groupBy("chunk_id").agg(F.array_sort(F.collect_set("name")).alias("related"))
    return hits.join(trail, "chunk_id", "left").join(names, "chunk_id", "left")


def duplicate_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """Ids that occur more than once in their node table."""
    tagged = union_all([df.select(F.lit(label).alias("label"), F.col(df.columns[0]).cast("string").alias("id")) for label, df in tables.items()])
    return tagged.groupBy("label", "id").agg(F.count("*").alias("copies")).where("copies > 1")


def tree_size(sections: DataFrame) -> DataFrame:
    return sections.groupBy("document_id").agg(F.count("*").alias("sections"), (F.max("level") + 1).alias("depth"))


def browse_structure(tree: DataFrame, chapters: DataFrame) -> DataFrame:
    """The section tree of a document, else its chapters as a flat list, with a source flag."""
    flat = chapters.join(tree.select("document_id").distinct(), "document_id", "left_anti")
    return tree.select(
        "document_id", "section_id", "tree_parent", "level", "title", "start_page", "chunk_count", F.lit("graph").alias("source")
    ).unionByName(
        flat.select(
            "document_id", F.col("chapter_id").alias("section_id"), F.lit(None).cast("string").alias("tree_parent"), F.lit(0).alias("level"),
            "title", "start_page", F.lit(0).cast("long").alias("chunk_count"), F.lit("registry").alias("source"),
        )
    )


def get_document(registry: DataFrame, graph: DataFrame, chapters: DataFrame, entities: DataFrame) -> DataFrame:
    """Each document from the registry, else from the graph, with chapters and entities in order."""
    both = registry.withColumn("source", F.lit("registry")).unionByName(graph.withColumn("source", F.lit("graph")))
    docs = first_per_key(both, ["document_id"], [F.desc("source")])
    titles = ordered_text(chapters, ["document_id"], ["number"], "title", "|", "chapters")
    names = entities.groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("entities"))
    return docs.join(titles, "document_id", "left").join(names, "document_id", "left")


def course_structure(courses: DataFrame, modules: DataFrame, topics: DataFrame, concepts: DataFrame) -> DataFrame:
    """Course → module → topic → concept rows with their order columns; empty levels stay null."""

    def level(df: DataFrame, parent: str, key: str) -> DataFrame:
        return df.select(parent, key, F.col("title").alias(f"{key[:-3]}_title"), F.col("order").alias(f"{key[:-3]}_order"))

    rows = courses.join(level(modules, "course_id", "module_id"), "course_id", "left")
    rows = rows.join(level(topics, "module_id", "topic_id"), "module_id", "left")
    return rows.join(level(concepts, "topic_id", "concept_id"), "topic_id", "left")


def sequential_path(modules: DataFrame, topics: DataFrame, concepts: DataFrame) -> DataFrame:
    """Depth-first list of a course with positions, by (module, topic, concept) order."""
    m = modules.select("course_id", "module_id", F.struct("order", "module_id").alias("mk"), "title")
    t = topics.join(m.select("course_id", "module_id", "mk"), "module_id").select(
        "course_id", "topic_id", "mk", F.struct("order", "topic_id").alias("tk"), "title"
    )
    c = concepts.join(t.select("course_id", "topic_id", "mk", "tk"), "topic_id")
    rows = union_all([
        m.select("course_id", F.lit("module").alias("kind"), F.col("module_id").alias("id"), "title", "mk"),
        t.select("course_id", F.lit("topic").alias("kind"), F.col("topic_id").alias("id"), "title", "mk", "tk"),
        c.select("course_id", F.lit("concept").alias("kind"), F.col("concept_id").alias("id"), "title", "mk", "tk", F.struct("order", "concept_id").alias("ck")),
    ])
    numbered = running_sum(rows, ["course_id"], ["mk", "tk", "ck"], {"position": F.lit(1)})  # nulls first: parents lead
    return numbered.select("course_id", "position", "kind", "id", "title")


def module_follows(modules: DataFrame) -> DataFrame:
    """FOLLOWS edges between neighbouring modules of a course."""
    rows = neighbour_value(modules, ["course_id"], ["order", "module_id"], "module_id", "previous")
    return rows.where("previous is not null").select("course_id", F.col("previous").alias("src"), F.col("module_id").alias("dst"))


def concept_covers(concepts: DataFrame, chunks: DataFrame) -> DataFrame:
    """Concept → chunk edges of the chunk_ids arrays, for chunks that exist."""
    listed = concepts.select("concept_id", F.explode("chunk_ids").alias("chunk_id")).distinct()
    return listed.join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def list_courses(courses: DataFrame, modules: DataFrame) -> DataFrame:
    counts = modules.groupBy("course_id").agg(F.countDistinct("module_id").alias("module_count"))
    rows = courses.join(counts, "course_id", "left").withColumn("module_count", F.coalesce("module_count", F.lit(0)))
    return rows.orderBy(F.desc("created_at"), "course_id")


def delete_documents(tables: dict[str, DataFrame], mentions: DataFrame, doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the doomed documents and the deleted counts per KB.

    `tables` and `mentions` have kb_id and document_id; an entity goes when no document is left
    that mentions it.
    """
    keys = ["kb_id", "document_id"]
    gone = doomed.select(*keys).distinct()
    left = {name: df.join(gone, keys, "left_anti") for name, df in tables.items()}
    edges = mentions.select(*keys, "entity_id").distinct()
    still = edges.join(gone, keys, "left_anti").select("kb_id", "entity_id").distinct()
    orphans = edges.select("kb_id", "entity_id").distinct().join(still, ["kb_id", "entity_id"], "left_anti")
    left["mentions"] = edges.join(gone, keys, "left_anti")
    counted = [df.join(gone, keys, "left_semi").groupBy("kb_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(name)) for name, df in tables.items()]
    counted.append(orphans.groupBy("kb_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit("entities")))
    return left, union_all(counted).select("kb_id", "kind", F.col("n").alias("deleted"))


def delete_rows(tables: dict[str, DataFrame], key: str, doomed: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of the doomed keys and the deleted counts per key and table.

    Rows are counted by key before they meet the doomed keys, so they do not move for that. For what is
    left, the rows of a key are dealt to `SALTS` tasks and each doomed key goes to all of them.
    """
    gone = doomed.select(key).distinct()
    spread = gone.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def kept(df: DataFrame) -> DataFrame:
        # any salt gives the same rows
        return df.withColumn("_salt", F.floor(F.rand() * SALTS).cast("int")).join(spread, [key, "_salt"], "left_anti").select(*df.columns)

    left = {name: kept(df) for name, df in tables.items()}
    # `gone` has each key once, so an inner join; a semi join would be pushed below the counting
    counted = [df.groupBy(key).agg(F.count("*").alias("deleted")).join(gone, key).withColumn("kind", F.lit(name)) for name, df in tables.items()]
    return left, union_all(counted).select(key, "kind", "deleted")


def with_course(modules: DataFrame, topics: DataFrame, concepts: DataFrame) -> dict[str, DataFrame]:
    """The descendants of courses with their course_id."""
    m = modules.select("course_id", "module_id")
    t = topics.join(m, "module_id").select("course_id", "topic_id")
    c = concepts.join(t, "topic_id").select("course_id", "concept_id")
    return {"modules": m, "topics": t, "concepts": c}


