"""The pipeline's stages keep whole what they should, and queries are there by their names."""

import __spark_entry__ as entry
import corpus_pipeline
from panelscope.llm import decontaminate, near_dup

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.stored(stage(spark, seen[-1], SMALL), f"test-{name}"))
    rows = [[tuple(r) for r in d.select("doc_id", "text").collect()] for d in seen[:-1]]
    assert set(rows[1]) <= set(rows[0]) and len(rows[1]) >= 0.98 * len(rows[0])
    order = sorted(rows[1])
    classes = near_dup.brute_force([t for _, t in order])
    assert sorted(rows[2]) == [r for i, r in enumerate(order) if classes[i] == i]
    items = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    assert sorted(rows[3]) == sorted(r for r, hit in zip(rows[2], decontaminate.brute_force(rows[2], items)) if not hit[2])
    assert {i for i, _ in rows[4]} <= {i for i, _ in rows[3]}
    assert all(d.columns == docs.columns for d in seen[:5]) and seen[5].count() == len(rows[4])


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, SMALL), f"empty-{name}")
    assert docs.count() == 0


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)) and "pipeline" in names
