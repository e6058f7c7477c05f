import inspect

import corpus_pipeline
from corpus import documents, labels, prose
from pyspark.sql import functions as F
from test_near import brute_force

from barloom.llm.secrets import find_spans
from barloom.session import cut_lineage


def test_stages():
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "exact dedup", "near dedup", "secret scan", "packing",
    ]
    for _, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]


def test_each_stage_on_the_rows_before(spark, tmp_path):
    good = [prose(i, 120) for i in range(60)]
    good += [good[3], good[4], good[5] + " tail", good[6] + " password=abc123def456", None, ""]
    docs = documents(spark, good + ["At At At At " * 40] * 30)
    labels(spark, 96, lambda i: int(i < 66)).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = cut_lineage(stage(spark, docs, str(tmp_path)), "stage")
        assert after.columns == docs.columns and after.dtypes == docs.dtypes
        rows, left = docs.collect(), after.collect()
        if name == "quality classifier":
            assert not [r for r in left if (r.text or "").startswith("At At")]
            assert {r.doc_id for r in left if r.doc_id is not None} >= set(range(64))
        elif name == "exact dedup":
            assert sorted({r.text or "" for r in rows}) == sorted(r.text or "" for r in left)
            assert 60 in {r.doc_id for r in left} and 3 not in {r.doc_id for r in left}
        elif name == "near dedup":
            kept = {i for i, _, _, keep in brute_force([(r.doc_id, r.text) for r in rows]) if keep}
            assert {r.doc_id for r in left if r.doc_id is not None} == {i for i in kept if i is not None}
        else:
            assert len(rows) == len(left) and not any(find_spans(r.text or "") for r in left)
            clean = {r.doc_id for r in rows if not find_spans(r.text or "")}
            before = {r.doc_id: r for r in rows}
            assert all(r == before[r.doc_id] for r in left if r.doc_id in clean)
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.collect()}


def test_run_on_the_tables(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "sequence_id", "offset", "length").collect()
    assert rows and {r.doc_id for r in rows} <= {
        r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()
    }
