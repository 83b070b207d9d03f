"""The pipeline's stages: columns, decisions, and the whole run."""

import collections

import __spark_entry__ as entry
import corpus_pipeline
from furlong.llm import pieces
from llm_support import INNER, SMALL, awkward, components_by_force, no_documents  # noqa: F401


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "SentencePiece encoding",
    ]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_stages_on_the_small_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], SMALL).write.parquet(f"{tmp_path}/{i}")
        kept.append(spark.read.parquet(f"{tmp_path}/{i}"))
    assert all(k.columns == columns for k in kept[:-1])
    rows = [[tuple(r) for r in k.select("doc_id", "text").collect()] for k in kept[:-1]]
    assert set(rows[1]) <= set(rows[0])
    first = {}
    for i, t in sorted(rows[1]):
        first.setdefault(" ".join((t or "").split()) if (t or "").strip() else t, i)
    assert len(rows[2]) == len(first)
    want = {i for i, _, c in components_by_force(rows[2]) if i == c}
    assert {i for i, _ in rows[3]} == want and len(rows[3]) == len(want)
    copies = collections.Counter(i for i, _ in rows[4])
    assert set(copies) <= want and max(copies.values()) <= 3
    with open(pieces.default_model(), "rb") as f:
        library = pieces.Pieces(f.read()).processor
    texts = dict(rows[4])
    last = kept[-1].collect()
    assert collections.Counter(r["doc_id"] for r in last) == copies
    assert all(r["ids"] == library.encode(texts[r["doc_id"]]) and r["round_trip"] for r in last)
    whole = corpus_pipeline.run(spark, SMALL).select("doc_id").collect()
    assert collections.Counter(r["doc_id"] for r in whole) == copies


def test_awkward_documents_pass_all_stages(spark, awkward, no_documents, tmp_path, monkeypatch):
    for name, docs in (("awkward", awkward), ("none", no_documents)):
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}{i}")
            columns = docs.columns
            docs = spark.read.parquet(f"{tmp_path}/{name}{i}")
            if i < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
                assert all(r[c] == c for r in docs.select(*INNER).collect() for c in INNER)
        assert docs.count() > 0 or name == "none"
