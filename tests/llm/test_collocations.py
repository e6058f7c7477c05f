"""Double-array tries against dictionaries; collocations against counting by hand."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpus import documents, odd_texts

from barloom.llm import collocations as col
from barloom.llm import double_array as trie


@pytest.mark.parametrize("kind", ["words", "digits", "dense", "deep", "one", "none"])
def test_double_array_finds_exactly_its_keys(kind):
    rng = random.Random(kind)
    if kind == "words":
        keys = {"".join(rng.choices("abcdé", k=rng.randint(0, 6))).encode() + b" " for _ in range(4000)}
    elif kind == "digits":
        keys = {rng.randrange(1 << 14).to_bytes(3, "big") + rng.randrange(300).to_bytes(3, "big") for _ in range(9000)}
    elif kind == "dense":
        keys = {bytes([a, b]) for a in range(256) for b in range(0, 256, 1 + a % 9)}
    else:
        keys = {"deep": {b"x" * 5000 + b" ", b"x" * 4000 + b" "}, "one": {b"\xff"}, "none": set()}[kind]
    keys = rng.sample(sorted(keys), len(keys))
    base, check = trie.build(keys)
    assert len(base) == len(check) <= 16 * sum(map(len, keys)) + 4 * trie.SYMBOLS
    states = [trie.walk(base, check, key) for key in keys]
    assert [int(base[s]) for s in states] == list(range(len(keys)))
    known = {key[:i] for key in keys for i in range(len(key) + 1)}
    for key in rng.sample(keys, min(len(keys), 500)):
        for i in range(len(key)):
            other = key[:i] + bytes([rng.randrange(256)]) + key[i + 1 :]
            state = trie.walk(base, check, other)
            assert (state >= 0) == (other in known)
    if keys and kind == "digits":
        wide = np.array([[*key] for key in keys], dtype=np.int32)
        state = np.zeros(len(keys), dtype=np.int32)
        for level in wide.T:
            state, went = trie.advance(base, check, state, level)
            assert went.all()
        assert (base[state] == np.arange(len(keys))).all()


def by_hand(rows, max_words=3, least=10, cover=50, top=2000, scale=1_000_000):
    counts, sizes = defaultdict(Counter), Counter()
    lower = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang = "und" if lang is None else lang
            sizes[lang] += len(words)
            for k in range(1, max_words + 1):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        covered = set()
        for longer, a in found.items():
            for k in range(2, len(longer)):
                for i in range(len(longer) - k + 1):
                    part = longer[i : i + k]
                    if 100 * a >= cover * f[part]:
                        covered.add(part)
        ranked = []
        for p, a in found.items():
            if p not in covered:
                cuts = [(scale * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, sizes[lang], -score))
    return sorted(out)


def made(seed, n, vocabulary=30):
    rng = random.Random(seed)
    words = [f"W{i}" if i % 3 else f"é{i}" for i in range(vocabulary)]
    ends = [" "] * 12 + [". ", ",", "\n", "\t\t", "!?", "\x0c ", " \x1c ", "; "]
    langs = ["en", "en", "en", "de", None, "a b", ""]
    made = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice((4, 10, vocabulary))]) + rng.choice(ends) for _ in range(rng.randint(0, 60)))
        made.append((text, rng.choice(langs)))
    return made


def found(spark, rows, **given):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "text string, lang string, phrase string, id int")
    return sorted(tuple(r) for r in col.collocations(df, **given).collect())


def test_counting_by_hand(spark):
    rows = made(1, 400)
    expected = by_hand(rows)
    assert len(expected) > 100 and {r[0] for r in expected} >= {"en", "de", "und", "a b", ""}
    assert found(spark, rows) == expected


def test_longer_phrases_and_other_bounds(spark):
    rows = made(2, 300, 8)
    given = {"max_words": 5, "least": 4, "top": 37}
    assert found(spark, rows, **given, cover_percent=90) == by_hand(rows, **given, cover=90)


def test_many_tries_and_small_chunks(spark, monkeypatch):
    rows = made(3, 300) + [("long a. b " * 200 + "tail " * 50, "en"), ("nobreak" * 50, "en")]
    for name, value in (("TRIE_KEYS", 40), ("TRIE_BYTES", 60)):
        monkeypatch.setattr(col, name, value)
    assert found(spark, rows) == by_hand(rows)


def test_sequences_are_written_once_however_many_tries(spark, monkeypatch):
    rows = made(4, 300) + [(None, "en"), ("", None), ("W1 é1 " * 3000, "de")]
    for name, value in (("TRIE_KEYS", 40), ("TRIE_BYTES", 60), ("SHARD_WORDS", 500)):
        monkeypatch.setattr(col, name, value, raising=False)
    labels, plain = [], col.cut_lineage

    def noted(df, label):
        labels.append(label)
        return plain(df, label)

    monkeypatch.setattr(col, "cut_lineage", noted)
    assert found(spark, rows, max_words=4) == by_hand(rows, max_words=4)
    assert max(Counter(labels).values()) == 1 and {"ids-1", "answers-1", "ids-2", "answers-2"} <= {*labels}


def test_a_few_tries_are_broadcast_together(spark, monkeypatch):
    """Dealing words and pairs to tries shuffles a multiple of the sequences, so it is left to many tries."""
    rows = made(5, 300) + [(None, "en"), ("", None), ("W1 é1 " * 3000, "de")]
    for name, value in (("TRIE_KEYS", 100), ("TRIE_BYTES", 200), ("SHARD_WORDS", 500), ("TRIES", 100)):
        monkeypatch.setattr(col, name, value, raising=False)
    tries, labels, plain, build = [], [], col.cut_lineage, col._broadcast

    def noted(df, label):
        labels.append(label)
        return plain(df, label)

    def counted(keys, number, label):
        tries.append(number)
        return build(keys, number, label)

    monkeypatch.setattr(col, "cut_lineage", noted)
    monkeypatch.setattr(col, "_broadcast", counted)
    assert found(spark, rows, max_words=4) == by_hand(rows, max_words=4)
    assert tries[0] > 1 and tries[1] > 1 and not [label for label in labels if label.startswith("answers")]


def test_counts_are_sent_packed(monkeypatch):
    """A task sends a row for some neighbouring ids, not one for each, whichever trie they are in."""
    monkeypatch.setattr(col, "ROW_COUNTS", 4, raising=False)
    rng = random.Random(6)
    pairs = rng.sample([(a, b) for a in range(1, 10) for b in range(1, 10)], 31)

    class Told:
        def __init__(self, numbers):
            keys = {"id": list(numbers), "key": [bytes(pairs[n - 1]) for n in numbers]}
            self.value = col._built(pa.table(keys))

    ids = [rng.randrange(10) for _ in range(300)]
    batch = pa.RecordBatch.from_pydict({"block": [7], "ids": [np.array(ids, dtype="<u4").tobytes()]})
    run = col._advancer([Told(range(1, 32, 2)), Told(range(2, 32, 2))], 1, True)
    tasks = [*run([batch]), *run([batch, batch]), *run([])]
    assert [task.num_rows <= 8 for task in tasks] == [True] * 3
    told, sums = pa.Table.from_batches(tasks), Counter()
    for part in range(8):
        rows = told.filter(pa.compute.equal(told.column("part"), part))
        if rows.num_rows:
            found = col._add_up(rows).to_pydict()
            sums.update(dict(zip(found["id"], found["a"])))
    places = Counter(zip(ids, ids[1:]))
    assert sums == Counter({n: 3 * places[pair] for n, pair in enumerate(pairs, 1) if places[pair]}) and len(sums) > 20


@pytest.mark.parametrize("size", [16, 100, 1000])
def test_slices_of_a_long_text_give_the_same_ids(size):
    text = b"one two. three  .four five,\n\nsix se.ven " * 20 + b"x" * 200 + b" two three"
    words = sorted({w.encode() for w in "one two three four five six se ven".split()})
    base, check = trie.build([w + b" " for w in words])
    arrays = (base, check, np.arange(1, len(words) + 1))

    def code(part):
        raw = np.frombuffer(part + b"\n", dtype=np.uint8)
        return col._word_ids((part + b"\n").translate(col._PLAIN), raw, np.array([0]), np.array([0], dtype=np.int32), arrays)[0]

    whole = code(text)
    ranges = list(col.slices(text.translate(col._PLAIN), size))
    assert len(ranges) > 1 and ranges[0][0] == 0 and ranges[-1][1] == len(text)
    assert col._joined(text, ranges, code).tolist() == whole.tolist()


def test_products_over_64_bits_and_ties(spark):
    big = 3_000_000_000_000
    level = spark.createDataFrame(
        [(1, "en", "x y z", big, [4 * 10**12, big + 7], [big + 5, 4 * 10**12]), (2, "en", "a b", 10, [20], [20])],
        "id long, lang string, phrase string, a long, lefts array<long>, rights array<long>",
    )
    rows = {r["phrase"]: tuple(r) for r in col._scored(level, None, 50, 10**6).collect()}
    scores = [(10**6 * big * big // (x * y), k) for k, (x, y) in enumerate([(4 * 10**12, big + 5), (big + 7, 4 * 10**12)])]
    assert rows["x y z"][5] == min(scores)[0] and min(scores)[1] == 0 and rows["x y z"][3] == 4 * 10**12
    assert rows["a b"][2:] == (10, 20, 20, 250_000)


def test_odd_documents(spark):
    df = documents(spark)
    rows = [(r["text"], r["lang"]) for r in df.collect()]
    rows = rows * 6
    many = df.crossJoin(spark.range(6).select())
    assert sorted(tuple(r) for r in col.collocations(many).collect()) == by_hand(rows)
    assert len(odd_texts()) and col.collocations(documents(spark, [])).collect() == []
    assert col.collocations(df.limit(0)).columns == [f.split()[0] for f in col.RESULT.split(", ")]
