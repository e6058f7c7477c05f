from collections import defaultdict
from hashlib import sha256

import pytest
from corpus import documents
from pyspark.sql import functions as F

from barloom.llm.content_sort import content_sort_dedup


def expected(rows, keep):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    found = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        for n, i in enumerate(sorted(ids, key=lambda i: (i != best, i is None))):
            found.append((i, best, len(ids), n == 0, sha256(text.encode()).hexdigest()))
    return sorted(found, key=str)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_equals_brute_force(spark, keep):
    docs = documents(spark)
    got = content_sort_dedup(docs, keep=keep).drop("row").collect()
    assert sorted(map(tuple, got), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()], keep)


def test_hot_content_is_cut_and_joined_again(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 > 0, F.lit("same text")).otherwise(F.concat(F.lit("same text "), "id")).alias("text"),
    )
    got = content_sort_dedup(docs).drop("row").collect()
    assert sorted(map(tuple, got), key=str) == expected([(r.doc_id, r.text) for r in docs.collect()], "largest")


def test_carried_columns_come_back_whole(spark):
    docs = documents(spark)
    got = content_sort_dedup(docs, carry=docs.columns).select("row.*")
    assert got.columns == docs.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, docs.collect()))


def test_normalised_and_empty(spark):
    docs = spark.createDataFrame([(1, "A"), (2, "a"), (3, "b")], "doc_id long, text string")
    got = content_sort_dedup(docs, normalise=F.lower, carry=["text"])
    assert {(r.id, r.keep_id, r.row.text) for r in got.collect()} == {(1, 2, "A"), (2, 2, "a"), (3, 3, "b")}
    assert content_sort_dedup(docs.limit(0)).collect() == []
