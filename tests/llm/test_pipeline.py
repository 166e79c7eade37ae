"""The pipeline as a whole: each stage on what the one before kept, against plain versions."""

import os
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm.anchors import find_spans, mask
from quire.llm.ball_hashing import fingerprint
from quire.llm.bpe import DEFAULT_TOKENIZER
from quire.llm.line_join import line_report
from quire.llm.rule_ensemble import quality_scores
from quire.llm.sos_packing import cut

FOLDER = "/root/testdata/sf0.001"


def roots_of(prints):
    """Smallest id that links of at most four bits reach, by trying all pairs of a small table."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {i: find(i) for i in prints}


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    columns, kept = docs.columns, [docs]
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "simhash_near_dedup", "personal_data", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept[-1], FOLDER).write.parquet(f"{tmp_path}/{name}")
        kept.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(k.columns == columns for k in kept[:-1])
    raw, good, lined, single, clean = ({r["doc_id"]: r["text"] for r in k.select("doc_id", "text").collect()} for k in kept[:-1])
    assert all(r["n_chars"] == len(r["text"]) for k in kept[2:5] for r in k.select("text", "n_chars").collect())
    # quality: what the scores of all documents predict
    assert good == {r["doc_id"]: raw[r["doc_id"]] for r in quality_scores(docs.select("doc_id", "text"), labels).where("predicted = 1").collect()}
    # lines: those that the report removes are cut out, and documents left without any go
    report = {r["doc_id"]: r for r in line_report(kept[1].select("doc_id", "text")).collect()}
    want = {i: "\n".join(x for n, x in enumerate(good[i].split("\n")) if n not in set(r["removed"])) if r["removed"] else good[i] for i, r in report.items() if r["n_kept"] or not r["removed"]}
    assert lined == want
    # near copies: one document of each group
    roots = roots_of({i: fingerprint(t) for i, t in lined.items()})
    assert single == {i: t for i, t in lined.items() if roots[i] == i}
    assert clean == {i: mask(t, find_spans(t)) for i, t in single.items()} and clean != single
    # packing: all tokens of all documents, in sequences without gaps
    packed = kept[-1].toPandas()
    tokenizer = Tokenizer.from_file(DEFAULT_TOKENIZER)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    pieces = []
    for i, text in clean.items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        pieces += [(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut(len(ids)))]
    digest = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, packed[digest].itertuples(index=False))) == sorted(pieces)
    for _, own in packed.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]] and own["length"].sum() <= 1024
    # the whole run gives the same pieces
    whole = corpus_pipeline.run(spark, FOLDER).toPandas()
    assert sorted(map(tuple, whole[digest].itertuples(index=False))) == sorted(pieces)


def test_pipeline_of_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, f"file://{os.path.abspath(tmp_path)}").count() == 0
