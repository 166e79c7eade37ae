"""Rules pinned on small tables, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from quire.functions import text as fx
from quire.operators import actions, chunking, citations, entities, hierarchy, library, media, retrieval
from quire.sources import corpus, files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_repeated_lines_go_from_the_fourth_on(spark):
    text = "\n".join(["A repeated footer"] * 5 + ["short", "short", "short", "short", "end"])
    assert one(spark, fx.drop_repeated_lines(F.col("t")), t=text) == "\n".join(["A repeated footer"] * 3 + ["short"] * 4 + ["end"])


def test_clean_text(spark):
    text = "12\nSome  co-\npy  \n\n\n\n 7 \nDRAFT body\tend \n345\n"
    assert one(spark, fx.clean_text(F.col("t")), t=text) == "Some copy\n\n body end"


def test_abbreviations_keep_their_order(spark):
    # "p." is spelled out inside "pp." before "pp." itself is looked for
    assert one(spark, fx.normalize_text(F.col("t")), t="Dr. Wu, e.g. pp. 3") == "Doctor Wu, for example ppage 3"


def test_escape_query(spark):
    assert one(spark, fx.escape_query(F.col("t")), t='a+b\\c/d"') == 'a\\\\+b\\\\c\\/d\\\\"'


def test_natural_key_orders_numbers(spark):
    names = ["lecture_10", "lecture_2", "lecture_1b", "lecture_1", "intro", "lecture_002"]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(fx.natural_key(F.col("n")), "n")
    assert [r.n for r in df.collect()] == ["intro", "lecture_1", "lecture_1b", "lecture_002", "lecture_2", "lecture_10"]


def test_token_windows_rebuild_the_text(spark):
    words = [f"w{i}" for i in range(57)]
    df = spark.createDataFrame([(" ".join(words),)], "text string")
    chunks = chunking.chunk_tokens(df, size=10, overlap=3).orderBy("position").collect()
    assert [c.position for c in chunks] == list(range(8))
    rebuilt = chunks[0].text.split() + [w for c in chunks[1:] for w in c.text.split()[3:]]
    assert rebuilt == words and all(c.token_count <= 10 for c in chunks)


def test_token_windows_borders(spark):
    df = spark.createDataFrame([(" ",), ("a  b",), ("a b c",), ("a b c d",)], "text string")
    got = [(r.text, r.position, r.token_count) for r in chunking.chunk_tokens(df, size=3, overlap=1).collect()]
    assert sorted(got) == [("a  b", 0, 2), ("a b c", 0, 3), ("a b c", 0, 3), ("c d", 1, 2)]


def test_sentence_chunks(spark):
    long = "alpha beta, gamma delta; epsilon zeta eta theta"
    df = spark.createDataFrame([(f"One two. Three four! {long}. Five.",)], "t string")
    got = df.select(chunking.sentence_chunks(F.col("t"), 20).alias("p")).first().p
    assert got == ["One two. Three four!", "alpha beta ,", "gamma delta ;", "epsilon zeta eta theta.", "Five."]


def test_sentence_chunks_against_brute_force(spark):
    """Packing by the plain rule on whole documents."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.p for r in docs.select("doc_id", chunking.sentence_chunks(F.col("text"), 500).alias("p")).collect()}
    for row in docs.collect():
        pieces = got[row.doc_id]
        assert "".join("".join(pieces).split()) == "".join(row.text.split())  # nothing lost, order kept
        sentences = fx_sentences(row.text)
        if all(len(s) <= 500 for s in sentences):
            # each piece is full: the next sentence would not have fit
            at = 0
            for piece in pieces:
                start = at
                while at < len(sentences) and " ".join(sentences[start : at + 1]) == piece[: len(" ".join(sentences[start : at + 1]))]:
                    at += 1
                assert " ".join(sentences[start:at]) == piece
                if at < len(sentences):
                    assert len(piece) + 1 + len(sentences[at]) > 500


def fx_sentences(text):
    out, start = [], 0
    for i, char in enumerate(text):
        if char in ".!?" and i + 1 < len(text) and text[i + 1].isspace():
            out.append(text[start : i + 1].strip())
            start = i + 1
    out.append(text[start:].strip())
    return [s for s in out if s]


def test_blank_text_cannot_be_embedded(spark):
    df = spark.createDataFrame([("kb", 1, "a"), ("kb", 2, "  ")], "kb_id string, pos int, text string")
    with pytest.raises(Exception, match="cannot embed an empty text"):
        chunking.embedding_batches(df, ["kb_id"], ["pos"]).collect()


def test_fallback_extractor_needs_signs(spark):
    texts = spark.createDataFrame([(1, "Dr. Ann Lee met Prof. Max Born in May."), (2, "nothing here")], "document_id int, text string")
    none = spark.createDataFrame([], "document_id int, name string, type string, score double, hits long, pos int")
    got = entities.extract_entities(texts, ["document_id"], none, entities.proper_names(texts, ["document_id"]))
    assert {(r.document_id, r.name) for r in got.collect()} == {(1, "Ann Lee"), (1, "Max Born")}


def test_single_signal_keeps_raw_scores(spark):
    lists = "query_id long, key string, score double, rank int"
    sem = spark.createDataFrame([(1, "a", 0.9, 1), (2, "a", 0.8, 1), (3, "b", 0.7, 1)], lists)
    key = spark.createDataFrame([(2, "a", 5.0, 1), (2, "c", 4.0, 2)], lists)
    graph = spark.createDataFrame([(4, "g", 3.0, 1)], lists)
    got = {(r.query_id, r.key): r.score for r in retrieval.rrf_fusion({"semantic": sem, "keyword": key, "graph": graph}, 5, retrieval.WEIGHTS_GRAPH).collect()}
    assert got[(1, "a")] == 0.9 and got[(3, "b")] == 0.7
    assert got[(2, "a")] == round(0.5 / 61 + 0.3 / 61, 9) and got[(2, "c")] == round(0.3 / 62, 9)
    assert got[(4, "g")] == round(0.2 / 61, 9)


def test_hits_carry_their_content_and_filters_come_first(spark):
    chunks = spark.createDataFrame([("c1", 1, 0, "x", "one"), ("c2", 1, 1, "y", "two"), ("c3", 2, 0, "x", "three"), ("c4", 3, 0, "x", "four")], "chunk_id string, document_id long, position int, chapter_id string, text string")
    docs = spark.createDataFrame([(1, "First", "Ann"), (2, "Second", None)], "document_id long, title string, author string")
    some = retrieval.in_scope(chunks, spark.createDataFrame([(1,), (2,)], "document_id long"), spark.createDataFrame([("x",)], "chapter_id string"))
    assert sorted(r.chunk_id for r in some.collect()) == ["c1", "c3"]
    # the best hit is out of scope, and the scope still gives its own two
    queries = spark.createDataFrame([(1, "two three one")], "query_id long, query string")
    found = retrieval.keyword_search(some.withColumn("kb_id", F.lit(0)), queries, 2)
    assert {r.chunk_id for r in found.collect()} == {"c1", "c3"}
    lists = "query_id long, key string, score double, rank int, chunk_id string"
    sem, key = spark.createDataFrame([(1, "a", 0.9, 1, "c1")], lists), spark.createDataFrame([(1, "b", 5.0, 1, "c4"), (1, "a", 4.0, 2, "c9")], lists)
    fused = retrieval.rrf_fusion({"semantic": sem, "keyword": key}, 5, carried=["chunk_id"])
    rows = {r.key: (r.chunk_id, r.document_id, r.title, r.author, r.text) for r in retrieval.described(fused, chunks, docs).collect()}
    assert rows == {"a": ("c1", 1, "First", "Ann", "one"), "b": ("c4", 3, None, None, "four")}


def test_bulk_effects_and_details(spark):
    items = spark.createDataFrame([("a", "old", "k"), ("b", "old", "k"), ("c", "old", "k")], "id string, tags string, kb_id string")
    targets = spark.createDataFrame([
        (1, 0, "a", "retag", None, "t1"), (1, 1, "b", "delete", None, None), (1, 2, "b", "retag", None, "t2"), (2, 0, "a", "retag", None, "t3"), (2, 1, "a", "reindex", "k9", None), (2, 2, "c", "reindex", "none", None),
    ], "request int, place int, item_id string, operation string, kb_id string, tags string")
    outcomes = actions.bulk_outcomes(targets, spark.createDataFrame([("a", True), ("b", True), ("c", True)], "id string, has_pdf boolean"), spark.createDataFrame([("k9",)], "kb_id string"))
    assert sorted(map(tuple, actions.bulk_effects(items, targets, outcomes).collect())) == [("a", "t3", "k9"), ("c", "old", "k")]
    summary = {r.request: [(d.item_id, d.operation, d.error) for d in r.details] for r in actions.bulk_summary(outcomes).collect()}
    assert summary == {1: [("a", "retag", None), ("b", "delete", None), ("b", "retag", "not found")], 2: [("a", "retag", None), ("a", "reindex", None), ("c", "reindex", "KB not found: none")]}


def test_scope_of_all_is_the_kb_table(spark):
    kbs = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "kb_id string")
    rows = spark.createDataFrame([("all",), ("none",), ("some",)], "mode string")
    got = rows.select("mode", actions.kb_scope(F.col("mode"), F.array(F.lit("x"), F.lit(" ")), actions.every_kb(kbs)).alias("s")).collect()
    assert {r.mode: (r.s.mode, r.s.kb_ids) for r in got} == {"all": ("all", ["a", "b"]), "none": ("none", []), "some": ("selected", ["x"])}


def test_citation_points(spark):
    texts = spark.createDataFrame([("kb", 1, "As Smith (1999) and Ann Lee and Bo Roy (2001) say, The Long Road is open [3].")], "kb_id string, document_id long, text string")
    docs = spark.createDataFrame(
        [("kb", 1, "own", "Smith"), ("kb", 2, "x", "John Smith"), ("kb", 3, "The Long Road", "Kim"), ("kb", 4, "y z", "smith"), ("other", 5, "x", "Smith")],
        "kb_id string, document_id long, title string, author string",
    )
    got = {r.target_id: round(r.confidence, 6) for r in citations.match_citations(texts, docs).collect()}
    # author word 1 point, title 2 points for each of 3 citations, exact author 2 points
    assert got == {2: 0.333333, 3: 1.0, 4: 0.666667}


def test_sections_end_at_the_next_sibling_or_the_parent(spark):
    rows = [("d", "a", None, 0, "A", 1), ("d", "b", None, 0, "B", 9), ("d", "a1", "a", 1, "A1", 1), ("d", "a2", "a", 1, "A2", 4)]
    tree = hierarchy.sections_from_tree(spark.createDataFrame(rows, "document_id string, section_id string, parent_id string, level int, title string, start_page int"), 2)
    assert {r.section_id: (r.order, r.end_page) for r in tree.collect()} == {"a": (0, 9), "b": (1, None), "a1": (0, 4), "a2": (1, 9)}
    chunks = spark.createDataFrame([("c1", "d", 1), ("c2", "d", 5), ("c3", "d", 9), ("c4", "d", 40), ("c5", "d", 0)], "chunk_id string, document_id string, page_number int")
    links = {r.chunk_id: r.section_id for r in hierarchy.link_chunks_to_sections(chunks, tree).collect()}
    assert links == {"c1": "a1", "c2": "a2", "c3": "b", "c4": "b"}


def test_deeper_nodes_become_roots(spark):
    rows = [("d", "a", None, 0, "A", 1), ("d", "a1", "a", 1, "A1", 1), ("d", "a11", "a1", 2, "A11", 1)]
    tree = hierarchy.sections_from_tree(spark.createDataFrame(rows, "document_id string, section_id string, parent_id string, level int, title string, start_page int"), 3)
    none = spark.createDataFrame([], "chunk_id string, section_id string")
    assert {r.section_id: r.tree_parent for r in hierarchy.section_tree(tree, none, max_depth=1).collect()} == {"a": None, "a1": "a", "a11": None}


def test_frame_rules(spark):
    scenes = spark.createDataFrame([(1, i, t) for i, t in enumerate([3.0, 8.0, 14.0, 23.9, 24.0, 65.0])], "video int, seq int, t double")
    videos = spark.createDataFrame([(1, 130.0), (2, 60.0)], "video int, duration double")
    got = sorted((r.video, r.t) for r in media.frame_schedule(scenes, videos).collect())
    assert got == [(1, 3.0), (1, 14.0), (1, 24.0), (1, 65.0), (1, 120.0), (2, 0.0)]
    shots = spark.createDataFrame([(1, i, h, c) for i, (h, c) in enumerate([("f" * 16, True), ("f" * 15 + "0", True), ("0" * 16, False), ("0" * 16, True)])], "video int, seq int, hash string, has_content boolean")
    assert [r.duplicate for r in media.frame_dedupe(shots).orderBy("seq").collect()] == [False, True, False, False]
    asked = media.frame_dedupe(spark.createDataFrame([(1, 0, "f" * 16, True), (1, 1, "f" * 12 + "0000", True)], shots.schema), decide=lambda a, b: True)
    assert [r.duplicate for r in asked.orderBy("seq").collect()] == [False, True]


def test_upsert_twice_is_once(spark):
    old = spark.createDataFrame([("kb1", "One", None, None, None, None)], "kb_id string, name string, description string, chunk_size int, chunk_overlap int, embedding_model string")
    change = spark.createDataFrame([("kb1", 1, None, "new", None, None, None), ("kb2", 2, "Two", None, 64, None, None)], "kb_id string, seq int, name string, description string, chunk_size int, chunk_overlap int, embedding_model string")
    once = library.registry_upsert(old, change, "m")
    twice = library.registry_upsert(once, change, "m")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert {r.kb_id: (r.name, r.description, r.chunk_size) for r in once.collect()} == {"kb1": ("One", "new", 512), "kb2": ("Two", "", 64)}


def test_delete_inside_a_bulk_request(spark):
    targets = spark.createDataFrame([(1, 0, "a", "retag", None), (1, 1, "a", "delete", None), (1, 2, "a", "retag", None), (1, 3, "b", "reindex", "kb")], "request int, place int, item_id string, operation string, kb_id string")
    items = spark.createDataFrame([("a", True), ("b", False)], "id string, has_pdf boolean")
    kbs = spark.createDataFrame([("kb",)], "kb_id string")
    got = [(r.ok, r.error) for r in actions.bulk_outcomes(targets, items, kbs).orderBy("place").collect()]
    assert got == [(True, None), (True, None), (False, "not found"), (False, "no PDF available")]


def test_chunk_and_vector_mismatch(spark):
    chunks = spark.createDataFrame([("kb", 1, 0, "t"), ("kb", 1, 1, "u")], "kb_id string, document_id int, position int, text string")
    vectors = spark.createDataFrame([("kb", 1, 0, [0.5])], "kb_id string, document_id int, position int, embedding array<float>")
    with pytest.raises(Exception, match="do not match"):
        corpus.chunk_records(chunks, vectors).collect()


def test_export_version_is_checked(spark, tmp_path):
    (tmp_path / "documents").mkdir()
    (tmp_path / "documents" / "x.json").write_text('{"id": "a", "format_version": "2.0"}\n')
    with pytest.raises(Exception, match="Unsupported export format: 2.0"):
        corpus.read_export(spark, str(tmp_path), "documents", "id string").collect()


def test_list_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name, body in (("a.MP4", "12345"), ("sub/b.pdf", "1"), ("sub/.c.pdf", "12"), ("noext", "123")):
        (tmp_path / name).write_text(body)
    from quire.operators.files import classify_files

    got = {r.kind: (r.files, r.bytes) for r in classify_files(files.list_files(spark, str(tmp_path))).collect()}
    assert got == {"video": (1, 5), "pdf": (1, 1), "other": (1, 3)}


def test_scan_reads_only_what_it_needs(spark):
    from quire.plans.registry import Tables

    plan = Tables(spark, "/root/testdata/sf0.001").lineitem.where("l_quantity > 40").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,40.0)]" in plan


def test_hits_show_all_names_of_their_section(spark):
    """a section of more than twenty names keeps each of them."""
    from quire.operators.entities import chunk_related_concepts
    from quire.operators.hierarchy import enrich_results
    from quire.plans import oracles
    from quire.plans.hierarchy import enrich_results as plan

    names = [f"name{i:02d}" for i in range(30)]
    named = spark.createDataFrame([("s", n) for n in names * 2], "section_id string, name string")
    links = spark.createDataFrame([("c1", "s"), ("c2", "s")], "chunk_id string, section_id string")
    hits = spark.createDataFrame([(1, 1, "c2")], "query_id long, rank int, chunk_id string")
    paths = spark.createDataFrame([("d", "s", ["Top"])], "document_id string, section_id string, path array<string>")
    (row,) = enrich_results(hits, links, paths, chunk_related_concepts(named, links)).collect()
    assert row["related"] == names
    assert "<= 20" not in oracles()["enrich_results"] and "SHOWN_CONCEPTS" not in plan.__code__.co_names
