"""The pipeline against its stages: brute force where that is small, what each stage keeps elsewhere."""

import collections
import os

import pytest
from pyspark.sql import functions as F
from test_documents import SPACE, linked_components, order

import corpus_pipeline
from quarrylint.llm import mixing, robust_outliers


@pytest.fixture(scope="module")
def folder(docs, tmp_path_factory):
    """A table folder with the documents, each of the awkward rows twice."""
    target = tmp_path_factory.mktemp("tables")
    again = docs.unionByName(docs.where("doc_id > 10000 OR doc_id IS NULL"))
    again.write.parquet(str(target / "documents.parquet"))
    return str(target)


def test_stages_by_hand(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    good = robust_outliers.quality(docs).where("kept").select("doc_id")
    kept_ids = {r.doc_id for r in good.collect()}
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id in kept_ids]

    groups = {}
    for doc_id, text in rows:
        key = SPACE.sub(" ", text or "")
        if key not in groups or order(doc_id) < groups[key][0]:
            groups[key] = order(doc_id), text
    rows = [(doc_id, text) for doc_id, text in groups.values()]
    left = sorted(doc_id for doc_id, _, _, kept in linked_components(rows) if kept)

    found = corpus_pipeline.run(spark, folder)
    pieces = collections.Counter(r.doc_id for r in found.where("piece = 0").collect())
    assert sorted(pieces) == left
    mixed = mixing.mix(docs.where(F.col("doc_id").isin(left)).dropDuplicates(["doc_id"]))
    assert pieces == collections.Counter(r.doc_id for r in mixed.select("doc.doc_id").collect())


def test_sequences_are_full_and_gapless(spark, folder):
    found = corpus_pipeline.run(spark, folder).collect()
    sequences = collections.defaultdict(list)
    for r in found:
        assert r.length <= 4096
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [at for at, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 4096


def test_stages_keep_the_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality rules", "exact dedup", "near dedup", "mixing to target weights", "best-fit packing"
    ]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_no_documents(spark, docs, tmp_path):
    docs.where("doc_id = -1").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    assert os.path.isdir(tmp_path)
