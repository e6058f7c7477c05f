from array import array
from collections import defaultdict

import pytest
from corpus import documents, prose
from pyspark.sql import functions as F

from barloom.llm import bestfit_pack, concat_pack
from barloom.llm.queries import VOCABULARY, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path(VOCABULARY)


def encoded(docs):
    library = tokenizers.Tokenizer.from_file(PATH)
    return [
        (r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 2])) for r in docs.collect()
    ]


def rebuilt(pieces, counts):
    """Documents put together again from their pieces; rows that share an id are told apart by their tokens."""
    by_doc = defaultdict(list)
    for p in pieces:
        ids = array("I", bytes(p.ids)).tolist()
        assert len(ids) == p.length
        by_doc[p.id].append((p.start, p.doc_tokens, tuple(ids)))
    whole = []
    for doc_id, parts in by_doc.items():
        singles = [ids for start, n, ids in parts if start == 0 and len(ids) == n]
        rest = sorted((n, start, ids) for start, n, ids in parts if not (start == 0 and len(ids) == n))
        whole += [(doc_id, ids) for ids in singles]
        while rest:
            n, text, at = rest[0][0], (), 0
            while at < n:
                piece = next(p for p in rest if p[0] == n and p[1] == at)
                rest.remove(piece)
                text, at = text + piece[2], at + len(piece[2])
            whole.append((doc_id, text))
    return sorted(whole, key=str)


def gapless(pieces, size):
    rows = defaultdict(list)
    for p in pieces:
        rows[p.sequence_id].append((p.offset, p.length))
    assert sorted(rows) == list(range(len(rows)))
    ends = []
    for spans in rows.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= size
        ends.append(at)
    return ends


@pytest.mark.parametrize("window", [16, 4096])
def test_concat_and_cut(spark, window):
    docs = documents(spark).repartition(3, "doc_id")
    pieces = concat_pack.concat_and_cut(docs, PATH, window=window)
    rows = pieces.collect()
    assert rebuilt(rows, None) == sorted(encoded(docs), key=str)
    ends = gapless(rows, window)
    assert sorted(ends)[1:] == [window] * (len(ends) - 1)
    assert all(p.opens == (p.start == 0) and p.closes == (p.start + p.length == p.doc_tokens) for p in rows)
    joined = concat_pack.sequences(pieces).collect()
    assert sorted(len(s.ids) // 4 for s in joined) == sorted(ends)


@pytest.mark.parametrize("row", [16, 4096])
def test_best_fit(spark, row):
    docs = documents(spark).repartition(3, "doc_id")
    packed = bestfit_pack.pack_best_fit(docs, PATH, row=row)
    rows = bestfit_pack.segments(packed).collect()
    assert rebuilt(rows, None) == sorted(encoded(docs), key=str)
    gapless(rows, row)
    for r in packed.collect():
        assert len(r.ids) == 4 * row and r.cu_seqlens[-1] == r.n_tokens
        assert list(r.position_resets) == list(r.cu_seqlens)[:-1]
    for r in packed.join(bestfit_pack.position_ids(packed), "sequence_id").collect():
        expected = [i for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:]) for i in range(b - a)]
        assert list(r.positions) == expected


def test_best_fit_decreasing_equals_a_plain_search():
    import random

    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 64) for _ in range(rng.randint(0, 80))]
        free, plain = [], []
        for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
            fitting = [s for s in free if s >= lengths[i]]
            space = min(fitting) if fitting else 64
            if fitting:
                free.remove(space)
            free.append(space - lengths[i])
            plain.append(space)
        rows = bestfit_pack.best_fit_decreasing(lengths, 64)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(free)


def test_little_padding(spark):
    docs = spark.createDataFrame([(i, prose(i, 50 + i % 400)) for i in range(600)], "doc_id long, text string")
    packed = bestfit_pack.pack_best_fit(docs.coalesce(1), PATH, row=1024)
    fill = packed.agg(F.sum("n_tokens") / (F.count(F.lit(1)) * 1024)).first()[0]
    assert fill > 0.99


def test_many_partitions_share_their_rest(spark):
    docs = spark.createDataFrame([(i, prose(i, 50 + i % 400)) for i in range(600)], "doc_id long, text string")
    packed = bestfit_pack.pack_best_fit(docs.repartition(32), PATH, row=1024)
    full = packed.agg(F.sum("n_tokens"), F.count(F.lit(1))).first()
    assert full[0] / (full[1] * 1024) > 0.99
    rows = bestfit_pack.segments(packed).collect()
    assert rebuilt(rows, None) == sorted(encoded(docs), key=str)
    gapless(rows, 1024)


def test_work_grows_with_the_documents(monkeypatch):
    """Documents slightly over half a row never fill one; still a block keeps only the emptiest rows for the next."""
    handled, kept, row, block = 0, [], 64, 128
    for number in range(0, 20_000, block):
        pieces = kept + [33 + i % 9 for i in range(number, number + block)]
        rows = bestfit_pack.best_fit_decreasing(pieces, row)
        handled += len(pieces)
        poor = sorted((sum(pieces[i] for i in r), r) for r in rows)[: bestfit_pack.REST_ROWS]
        kept = [pieces[i] for _, r in poor for i in r]
    assert handled <= 20_000 * (1 + bestfit_pack.REST_ROWS / block) + block


def test_long_runs_of_half_rows(spark):
    """One task, 8,000 documents of about 40 tokens at row 64: ends in time, keeps every document."""
    rows = [(i, prose(i % 50, 13)) for i in range(8_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    packed = bestfit_pack.pack_best_fit(docs, PATH, row=64)
    found = bestfit_pack.segments(packed).groupBy("id", "doc_tokens").agg(F.sum("length").alias("n"))
    assert found.filter("n = doc_tokens").count() == len(rows)


def test_the_registered_queries_hold_their_columns(spark, sf_dir):
    """Digests of ops 3, 5 and 10 against the tokenizers library, over the whole table."""
    import hashlib
    import zlib

    from tokenizers import Tokenizer

    from barloom.llm.queries import QUERIES

    library = Tokenizer.from_file(PATH)
    library.no_truncation()
    library.no_padding()
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in docs.items()}
    for r in QUERIES["op5_trie_bpe"](spark, sf_dir).collect():
        told = library.decode(ids[r["doc_id"]], skip_special_tokens=False)
        assert r["n_tokens"] == len(ids[r["doc_id"]])
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids[r["doc_id"]])).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    for name in ("op3_concat_cut", "op10_best_fit"):
        covered = dict.fromkeys(docs, 0)
        ends = {}
        for r in sorted(QUERIES[name](spark, sf_dir).collect(), key=lambda r: (r["sequence_id"], r["offset"])):
            whole = [*ids[r["doc_id"]], 2]
            piece = whole[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(whole) and r["offset"] == ends.get(r["sequence_id"], 0)
            ends[r["sequence_id"]] = r["offset"] + r["length"]
            assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in piece))
            covered[r["doc_id"]] += r["length"]
        assert covered == {i: len(v) + 1 for i, v in ids.items()}
        assert sorted(ends) == list(range(len(ends))) and max(ends.values()) <= 4096


def test_empty(spark):
    docs = documents(spark, [])
    assert concat_pack.concat_and_cut(docs, PATH).collect() == []
    assert bestfit_pack.pack_best_fit(docs, PATH).collect() == []
