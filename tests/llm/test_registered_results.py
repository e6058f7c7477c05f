"""Registered queries without SQL, as they are registered, against brute force over the same tables."""

import hashlib
import re

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

from barloom.llm import queries


@pytest.fixture(scope="module")
def texts(sf_dir):
    rows = pd.read_parquet(f"{sf_dir}/documents.parquet")
    return {int(i): t or "" for i, t in zip(rows["doc_id"], rows["text"])}


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def test_op5_equals_the_library(spark, sf_dir, texts):
    library = Tokenizer.from_file(queries.tokenizer_path(queries.VOCABULARY))
    library.no_truncation()
    library.no_padding()
    expected = {}
    for i, text in texts.items():
        ids = library.encode(text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[i] = (len(ids), digest(" ".join(map(str, ids))), digest(decoded))
    rows = queries.op5_trie_bpe(spark, sf_dir).collect()
    assert rows[0].asDict().keys() >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows} == expected
    assert len(rows) == len(texts)


def shingles(text: str) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text)
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def test_op8_equals_comparing_all_pairs(spark, sf_dir, texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    ids, links = sorted(sets), 0
    least = {i: i for i in ids}
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                links += 1
                low, high = sorted((least[a], least[b]))
                least = {i: low if c == high else c for i, c in least.items()}
    rows = queries.op8_hyperminhash(spark, sf_dir).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert got == {i: (len(sets[i]), least[i], least[i] == i) for i in ids} and len(rows) == len(ids)
    assert links > 0


def test_op9_finds_most_neighbours_with_exact_scores(spark, sf_dir):
    table = pd.read_parquet(f"{sf_dir}/embeddings.parquet")
    name = next(c for c in table.columns if isinstance(table[c].iloc[0], (list, np.ndarray)))
    rows = {int(i): np.asarray(v, dtype=np.float64) for i, v in zip(table["vec_id"], table[name])}
    ids = np.array(sorted(rows))
    unit = np.array([rows[i] / np.linalg.norm(rows[i]) for i in ids])
    found, met, asked = {}, 0, 0
    for row in queries.op9_hilbert_ann(spark, sf_dir).collect():
        found.setdefault(row["query_id"], []).append((row["rank"], row["vec_id"], row["score"]))
    assert set(found) == {i for i in rows if i % 50 == 0}
    for query, hits in found.items():
        hits.sort()
        assert [rank for rank, _, _ in hits] == [1, 2, 3, 4, 5]
        assert [(-s, v) for _, v, s in hits] == sorted((-s, v) for _, v, s in hits)
        score = unit @ unit[ids == query][0]
        for _, vec, given in hits:
            assert vec != query and abs(given - score[ids == vec][0]) < 1e-12
        others = ids != query
        best = ids[others][np.lexsort((ids[others], -score[others]))[:5]]
        met, asked = met + len({v for _, v, _ in hits} & set(best.tolist())), asked + 5
    assert met >= 0.9 * asked
