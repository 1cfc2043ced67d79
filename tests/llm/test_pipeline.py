from collections import Counter

import corpus_pipeline
import pytest
from helpers import awkward, empty, links

from logweave import shared
from logweave.llm import quality
from logweave.llm.session import stored


def test_stages_on_the_fixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, results = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf), name)
        results[name] = docs
        if name != "token_output":
            assert docs.columns == columns
        if name in ("quality_rules", "near_duplicates", "decontamination"):
            assert Counter(map(tuple, docs.collect())) <= Counter(map(tuple, before.collect()))
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    kept = quality.rules(spark.read.parquet(f"{sf}/documents.parquet"), model).where("kept")
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in results["quality_rules"].collect()}
    rows = results["quality_rules"].orderBy("doc_id").collect()
    near = links([r["text"] for r in rows])
    left = {r["doc_id"] for r in results["near_duplicates"].collect()}
    for i, r in enumerate(rows):
        if not near[i]:
            assert r["doc_id"] in left
    texts = [r["text"] for r in results["near_duplicates"].collect()]
    assert not any(links(texts).values())
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert not any(t in r["text"] for r in results["decontamination"].collect() for t in items)
    assert {r["doc_id"] for r in results["token_output"].collect()} == {r["doc_id"] for r in results["source_mix"].collect()}


@pytest.mark.parametrize("make", [awkward, empty])
def test_stages_take_awkward_rows(spark, sf, make):
    docs = make(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert name == "token_output" or out.columns == docs.columns
        out.count()


def test_run_leaves_only_its_result(spark, sf, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "shared_folder", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100
    names = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert not names & {name for name, _ in corpus_pipeline.STAGES[:-1]} and "tokens" in names
