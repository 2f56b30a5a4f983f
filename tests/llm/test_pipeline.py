"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline

from tests.llm.test_operators import brute_fingerprint, brute_groups, brute_kept, split
from weftgraph.llm import superkmer


def test_stages_work_on_what_the_one_before_kept(spark, folder, docs, tmp_path):
    held, columns = docs, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, held, folder)
        assert out.columns == (columns if k < 4 else [*columns, "copy"])
        out.write.parquet(f"{tmp_path}/{k}")
        before, after = held.collect(), spark.read.parquet(f"{tmp_path}/{k}").collect()
        if "quality" in name or "benchmark" in name:
            assert set(after) <= set(before)
        elif "SimHash" in name:
            group, first = brute_groups({brute_fingerprint(r["text"]) for r in before}), {}
            for r in before:  # by doc_id, rows without one last; among equals any, so they are compared by group
                g, rank = group[brute_fingerprint(r["text"])], (r["doc_id"] is None, r["doc_id"] or 0)
                first[g] = min(first.get(g, rank), rank)
            assert set(after) <= set(before)
            assert sorted(group[brute_fingerprint(r["text"])] for r in after) == sorted(first)
            assert all(first[group[brute_fingerprint(r["text"])]] == (r["doc_id"] is None, r["doc_id"] or 0) for r in after)
        elif "substring" in name:
            assert sorted((str(r["doc_id"]), len(split(r["text"]))) for r in after) == sorted((i, n - g) for i, n, g, _ in brute_kept([(r["doc_id"], r["text"]) for r in before]))
        else:
            most = max((r["copy"] for r in after), default=0)
            assert {r["doc_id"] for r in after} <= {r["doc_id"] for r in before} and most <= 3
        held = spark.read.parquet(f"{tmp_path}/{k}")
    assert superkmer.op10_superkmer(spark, folder).count() == docs.count()


def test_run_returns_the_last_stage(spark, folder):
    assert "copy" in corpus_pipeline.run(spark, folder).columns


def test_run_on_nothing(spark, nothing, folder, tmp_path):
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    nothing.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
