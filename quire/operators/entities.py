"""Entity extraction, entity lists, mention edges and entity lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import count_tokens, strip, words
from quire.operators.common import dealt, first_per_key, let, ranked

# Extractor labels and the entity types they map to.
ENTITY_TYPES = {
    "concept": "CONCEPT",
    "technique": "TECHNIQUE",
    "term": "TERM",
    "person": "PERSON",
    "organization": "ORGANIZATION",
    "tool": "TOOL",
    "work": "WORK",
    "location": "ORGANIZATION",
    "product": "TOOL",
    "event": "CONCEPT",
    "date": "TERM",
    "work of art": "WORK",
}

# Signs of names in a text.
INDICATOR_PATTERNS = [
    r"(?U)\b(?:Dr\.|Prof\.|Mr\.|Mrs\.|Ms\.)\s+[A-Z]",
    r"(?U)\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    r"(?iU)\b(?:University|Institute|Corporation|Inc\.|Ltd\.)\b",
    r"(?iU)\b(?:January|February|March|April|May|June|July|August|September|October|November|December)\b",
]
PROPER_NAME = INDICATOR_PATTERNS[1]


def entity_type(label: Column) -> Column:
    pairs = [F.lit(x) for pair in ENTITY_TYPES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(label)), F.lit("CONCEPT"))


def name_key(name: Column) -> Column:
    return strip(F.lower(name))


def name_type_lines(replies: DataFrame, reply: str) -> DataFrame:
    """Rows of "name|type" lines; names of one character are dropped."""
    keep = [c for c in replies.columns if c != reply]
    lines = replies.select(*keep, F.posexplode(F.split(strip(F.col(reply)), "\n")).alias("line_no", "line"))
    bar = F.instr("line", "|")
    parsed = lines.where(bar > 0).select(
        *keep, "line_no",
        strip(F.substring("line", F.lit(1), bar - 1)).alias("name"),
        entity_type(strip(F.substring("line", bar + 1, F.length("line")))).alias("type"),
    )
    return parsed.where(F.length("name") >= 2)


def indicator_count(text: Column) -> Column:
    def total(t):
        found = [F.size(F.regexp_extract_all(t, F.lit(p), F.lit(0))) for p in INDICATOR_PATTERNS]
        return sum(found[1:], found[0])

    return let(text, total)


def has_entity_indicators(text: Column, found: Column) -> Column:
    """More than three signs of names but fewer entities than one per 200 words."""

    def missed(t):
        expected = F.greatest(F.lit(1), F.floor(count_tokens(t) / 200))
        return (indicator_count(t) > 3) & (found < expected)

    return let(text, missed)


def gazetteer_hits(texts: DataFrame, key: list[str], gazetteer: DataFrame, text: str = "text") -> DataFrame:
    """Default extractor: words of each text that a gazetteer(word, type, score) lists.

    Marks around the words are cut from the whole text at once. Only listed words go on, and they
    are counted per text before they meet the gazetteer's columns.
    """
    bare = F.regexp_replace(F.lower(F.col(text)), r"(?U)(?<=^|\s)[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?=\s|$)", "")
    seen = texts.select(*key, F.posexplode_outer(words(bare)).alias("pos", "word")).where(F.length("word") >= 2)
    listed = seen.join(gazetteer.select("word").distinct(), "word", "left_semi")
    counted = listed.groupBy(*key, "word").agg(F.count("*").alias("hits"), F.min("pos").alias("pos"))
    return counted.join(gazetteer, "word").select(*key, F.col("word").alias("name"), "type", "score", "hits", "pos")


def proper_names(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Default second extractor: pairs of capitalised words, as persons."""
    names = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(PROPER_NAME), F.lit(0)))
    return texts.select(*key, F.posexplode(names).alias("pos", "name")).withColumn("type", F.lit("PERSON"))


def extract_entities(
    texts: DataFrame, key: list[str], first: DataFrame, second: DataFrame, threshold: float = 0.5, gate: float = 0.4
) -> DataFrame:
    """Entities of the first extractor; the second one adds names where the first found none or was
    unsure on average and the text shows signs of names.

    `first` has key, name, type, score, hits and `second` key, name, type.
    """
    sure = first.where((F.col("score") >= threshold) & (F.length("name") >= 2))
    per_text = sure.groupBy(*key).agg(
        F.sum("hits").alias("found"), (F.sum(F.col("score") * F.col("hits")) / F.sum("hits")).alias("confidence")
    )
    found = F.coalesce("found", F.lit(0))
    weak = (found == 0) | (F.col("confidence") < gate)
    unsure = texts.join(per_text, key, "left").where(weak & has_entity_indicators(F.col("text"), found)).select(*key)
    added = second.join(unsure, key, "left_semi").where(F.length("name") >= 2)
    merged = merge_entity_lists(sure.select(*key, "name", "type"), added.select(*key, "name", "type", "pos"), key)
    return merged


def merge_entity_lists(one: DataFrame, two: DataFrame, key: list[str]) -> DataFrame:
    """All of list one plus the first entry of each unseen name of list two (ordered by `pos`)."""
    named = [*key, "_name"]
    left = one.withColumn("_name", name_key(F.col("name")))
    right = two.withColumn("_name", name_key(F.col("name")))
    unseen = right.join(left.select(*named).distinct(), named, "left_anti")
    added = first_per_key(unseen, named, [F.col("pos"), F.col("name"), F.col("type")])
    columns = [*key, "name", "type"]
    return left.select(*columns, F.lit(1).alias("list_no")).unionByName(added.select(*columns, F.lit(2).alias("list_no")))


def first_text_only(entities: DataFrame, scope: list[str], text_no: str) -> DataFrame:
    """Drop an entity whose name an earlier text of the same scope already gave."""
    w = Window.partitionBy(*scope, name_key(F.col("name"))).orderBy(text_no)
    return entities.withColumn("_first", F.rank().over(w)).where("_first = 1").drop("_first")


def dedupe_entities(new: DataFrame, existing: DataFrame, scope: list[str]) -> DataFrame:
    """Entities whose normalised name is not among the existing ones."""
    known = existing.select(*scope, name_key(F.col("name")).alias("_name")).distinct()
    keyed = new.withColumn("_name", name_key(F.col("name")))
    return keyed.join(known, [*scope, "_name"], "left_anti").drop("_name")


def upsert_entities(rows: DataFrame) -> DataFrame:
    """One entity per (kb, name, type) out of old and new rows ordered by `seq`.

    Identity comes from the first row, aliases from the longest list (the earlier one on ties).
    """
    return (
        rows.groupBy("kb_id", "name", "type")
        .agg(
            F.min_by(F.struct("id", "description", "first_seen_in"), "seq").alias("f"),
            F.max_by("aliases", F.struct(F.size("aliases"), -F.col("seq"))).alias("aliases"),
        )
        .select("kb_id", "name", "type", "f.*", "aliases")
    )


def mention_edges(mentions: DataFrame, tasks: int | None = None) -> DataFrame:
    """Distinct document → entity and chapter → entity edges, in so many tasks."""
    ends = F.array(
        F.struct(F.lit("document").alias("src_kind"), F.col("document_id").cast("string").alias("src")),
        F.struct(F.lit("chapter").alias("src_kind"), F.col("chapter_id").cast("string").alias("src")),
    )
    edges = mentions.select("kb_id", "entity_id", F.inline(ends)).where("src is not null")
    return dealt(edges, tasks, "kb_id", "entity_id", "src").distinct()


def document_entities(edges: DataFrame, entities: DataFrame, type_: str | None = None) -> DataFrame:
    """Entities of every document with the number of documents mentioning them."""
    counts = edges.groupBy("kb_id", "entity_id").agg(F.count("*").alias("mention_count"))
    described = entities.where(F.col("type") == type_) if type_ else entities
    # counts and entities have one row per entity: only the edges can be skewed, and AQE splits them
    return edges.join(described.join(counts, ["kb_id", "entity_id"]), ["kb_id", "entity_id"])


def get_entities(entities: DataFrame, k: int | None = None) -> DataFrame:
    """Distinct (kb, name, type): all, or the first k in that order."""
    order = ["kb_id", "name", "type"]
    rows = entities.select(*order).distinct()
    return rows if k is None else rows.orderBy(*order).limit(k)


def cross_references(edges: DataFrame, entities: DataFrame, docs: DataFrame, sections: DataFrame, names: DataFrame, tasks: int | None = None) -> DataFrame:
    """Sections of the documents that mention each asked name, case-insensitively.

    `sections` holds one row per (document, section) with start_page and chunk_count; documents
    without sections keep one row. Edges and what they lead to are dealt to `tasks` tasks.
    """
    asked = entities.withColumn("_n", F.lower("name")).join(names.select(F.lower("name").alias("_n")).distinct(), "_n")
    hits = dealt(edges, tasks, "kb_id", "entity_id").join(asked.select("kb_id", "entity_id", F.col("name").alias("entity_name")), ["kb_id", "entity_id"])
    named = dealt(hits.select("kb_id", "document_id", "entity_name"), tasks, "kb_id", "document_id").distinct().join(docs, ["kb_id", "document_id"])
    return named.join(sections, ["kb_id", "document_id"], "left")


def chunk_related_concepts(section_entities: DataFrame, chunk_sections: DataFrame, tasks: int | None = None) -> DataFrame:
    """All distinct entity names of each chunk's section in name order. Sections are dealt to `tasks` tasks."""
    distinct = dealt(section_entities.select("section_id", "name"), tasks, "section_id").distinct()
    best = ranked(distinct, ["section_id"], [F.col("name")], rank="place")
    return dealt(chunk_sections, tasks, "section_id").join(best, "section_id").select("chunk_id", "name", "place")
