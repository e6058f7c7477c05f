import numpy as np
import pytest
from corpus import changed, documents, prose

from barloom.llm import hyperminhash as H


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_force(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        r = find(i)
        known = [x for x in (least.get(r), doc_id) if x is not None]
        least[r] = min(known) if known else None
    return sorted(
        [(doc_id, len(sets[i]), least[find(i)], doc_id == least[find(i)]) for i, (doc_id, _) in enumerate(rows)],
        key=str,
    )


def check(docs):
    got = [(r.id, r.n_shingles, r.component_id, r.kept) for r in H.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == brute_force([(r.doc_id, r.text) for r in docs.collect()])


def test_awkward_rows(spark):
    check(documents(spark))


def test_groups_chains_and_near_misses(spark):
    texts = []
    for g in range(12):
        base = prose(g, 30 + 40 * (g % 4))
        texts += [base, base, changed(base, 97), changed(base, 40), changed(base, 23), changed(base, 15)]
        words = base.split(" ")
        texts += [" ".join(words[i : i + 25]) for i in range(6)]
    check(documents(spark, texts))


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """Buckets larger than a block."""
    monkeypatch.setattr(H, "BLOCK_SHINGLES", 1500)
    base = prose(5, 120).split(" ")
    rng = np.random.default_rng(1)
    texts = []
    for i in range(150):
        words = list(base)
        for k in rng.choice(120, 1 + i % 6, replace=False):
            words[k] = f"v{i}"
        texts.append(" ".join(words))
    check(documents(spark, texts))


def test_small_sets_collide_as_their_similarity_says():
    rng = np.random.default_rng(3)
    for size in (4, 20, 90, 400, 5000):
        missed, equal = 0, []
        for _ in range(120):
            whole = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            a, b = H.registers(whole), H.registers(whole[np.sort(rng.choice(size, size * 3 // 4, replace=False))])
            equal.append((a == b).mean())
            missed += not (a == b).reshape(-1, H.BAND_REGISTERS).all(axis=1).any()
        assert missed == 0
        assert abs(np.mean(equal) - 0.75) < 0.03


def test_estimate_corrects_accidents():
    rng = np.random.default_rng(4)
    equal = []
    for _ in range(200):
        a, b = (H.registers(np.unique(rng.integers(0, 1 << 64, 2000, dtype=np.uint64))) for _ in range(2))
        equal.append((a == b).mean())
    assert abs(np.mean(equal) - H.accidental(11, 11)) < 0.001
    assert H.estimated_jaccard(H.accidental(11, 11), 2000, 2000) == pytest.approx(0)


def test_empty(spark):
    assert H.near_duplicates(documents(spark, [])).collect() == []
    assert [r.component_id for r in H.near_duplicates(documents(spark, ["", "a b"])).collect()].count(0) == 1
