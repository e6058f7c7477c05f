"""Ranked search against scoring every document by hand."""

import math
import random
import re
from collections import Counter

import pytest
from corpus import documents, odd_texts

from barloom.llm import lexical_search as search

LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def by_hand(docs, items, top=10):
    told = [(i, words(t)) for i, t in docs]
    told = [(i, w) for i, w in told if w]
    n, total = len(told), sum(len(w) for _, w in told)
    df = Counter(t for _, w in told for t in set(w))
    out = []
    for item, text in items:
        scored = []
        for i, w in told:
            tf, m = Counter(w), 100 - 90 + 90 * len(w) * n // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * tf[t] // (1000 * tf[t] + 8 * m))
                for t in set(words(text))
                if tf[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def made(seed, n, least=0):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)] + ["É", "漢字", "x_y", "It's", "😀"]
    weights = [1 / (i + 1) for i in range(len(names))]
    return [(i, rng.choice(" ,\n_").join(rng.choices(names, weights, k=rng.randint(least, 30)))) for i in range(n)]


def found(spark, docs, items, **given):
    df = spark.createDataFrame([(i, t, "z", 1) for i, t in docs], "doc_id long, text string, id string, score int")
    asked = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, id int")
    out = search.rank_documents(df.repartition(5), asked, **given)
    assert out.columns == ["item_id", "rank", "id", "score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_against_scoring_all(spark):
    docs, items = made(1, 500), made(2, 30, 3)
    docs += [(1000 + i, docs[i][1]) for i in range(100)]  # equal scores
    docs += [(5, "W1 w2"), (None, "w3 w40"), (None, None), (2000, ""), (2001, " .,"), (2002, "w50 " * 40_000)]
    items += [(3, "w1 w1 É"), (None, "w2"), (90, ""), (91, None), (92, "nowhere"), (93, "😀x_y")]
    expected = by_hand(docs, items)
    assert len(expected) > 250
    assert found(spark, docs, items) == expected


def test_small_blocks_bundles_and_waves(spark, monkeypatch):
    docs, items = made(3, 300), made(4, 40, 1)
    for name, value in (("BLOCK_DOCS", 7), ("BUNDLE_ITEMS", 3), ("WAVE_TERMS", 150)):
        monkeypatch.setattr(search, name, value)
    assert found(spark, docs, items, owners=3, top=4) == by_hand(docs, items, 4)


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a b")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "")])])
def test_nothing_to_find(spark, docs, items):
    assert found(spark, docs, items) == []


def test_odd_documents(spark):
    df = documents(spark)
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    items = list(enumerate(t[:300] if t else t for t in odd_texts()))
    asked = spark.createDataFrame(items, "item_id int, text string")
    out = sorted((tuple(r) for r in search.rank_documents(df, asked).collect()), key=str)
    assert out == by_hand(docs, items)


def test_string_ids(spark):
    df = spark.createDataFrame([("b", "x y"), ("a", "x y"), (None, "x y"), ("c", "z")], "doc_id string, text string")
    out = search.rank_documents(df, spark.createDataFrame([("q", "y")], "item_id string, text string")).collect()
    assert [(r["item_id"], r["rank"], r["id"]) for r in sorted(out, key=lambda r: r["rank"])] == [
        ("q", 1, "a"), ("q", 2, "b"), ("q", 3, None)
    ]
