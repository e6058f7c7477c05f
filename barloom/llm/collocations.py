"""Collocations of a text corpus: words that stand together more often than their parts would.

Phrases grow by one word per level. The candidates of a level are those sequences of two overlapping frequent phrases of the
level before that occur often enough, so every part of a candidate is frequent (Apriori). Candidates are laid out as a
double-array trie, which is broadcast (a few of them, where one is too small); numpy moves the states of all text positions through it one symbol at a time, counts
the leaves they reach with ``bincount``, and Spark adds up the counts of all tasks.

* **Texts are read twice**: for the words, and to write each document as the ids of its frequent words. Later levels read and
  write only such id sequences.
* **Candidates** need no counts, only the knowledge that a sequence is frequent: tasks send a sequence with its count cut
  off at ``least``, and sums of these reach ``least`` exactly where the true counts do.
* **Nothing unbounded is broadcast.** A trie holds ``TRIE_KEYS`` candidates, or words of ``TRIE_BYTES``, and ``TRIES`` of them are
  broadcast together for one pass. Where more are needed, they are not broadcast but built where they are asked: a task sends the
  distinct words or pairs of each block of its sequences to the shards that hold them, and the answers come back to the block;
  that shuffles a multiple of the sequences. Either way texts and sequences are read and written once.
* **No hot group.** Tasks add up before they send, so a sequence arrives once per task at most; the best of a language are
  found in 64 groups first.

Defined results: a null text is empty, a null language ``und``; documents without words count nothing; repeated rows count each;
an empty table has no collocations.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from itertools import count, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm import double_array as trie
from barloom.llm.common import col, cut_lineage, forget, numbered

UNDETERMINED = "und"
LEAST, COVER_PERCENT, TOP, SCALE, MAX_WORDS = 10, 50, 2_000, 1_000_000, 3

TRIE_KEYS = 1 << 19
TRIE_BYTES = 4 << 20
TRIES = 3
#: So many words of text ask each of the tries that are not broadcast, on average at most.
SHARD_WORDS = 1 << 22
#: So many bytes of text, or entries of counts, are worked on at a time.
CHUNK_BYTES = 2 << 20
CHUNK_ENTRIES = 1 << 20
#: An id is written in digits of so many bits; a node of a trie has at most 2^DIGIT_BITS children then.
DIGIT_BITS = 6
#: Rows of a batch of counts, and about so many ids in a row of sequences.
BATCH_ROWS = 1 << 16
ROW_IDS = 1 << 14
#: Counts of so many neighbouring ids go in one row.
ROW_COUNTS = 1 << 12
GROUPS = 64

_SPACE = 0x20
# fixed values: what ends a piece, and what ends a word
_BREAKS = b".,;:!?\n\x0b\x0c\r"
_ENDS = _BREAKS + b"\x20\t"
_PLAIN = bytes.maketrans(bytes(range(65, 91)) + _ENDS, bytes(range(97, 123)) + b" " * len(_ENDS))
_IS_BREAK = np.isin(np.arange(256), np.frombuffer(_BREAKS, dtype=np.uint8))

SEQUENCES = "block long, ids binary"
RESULT = "lang string, rank long, phrase string, a long, l long, r long, n long, score long"


def slices(text: bytes, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Cuts a text, words lower-cased and ends of words blank, into ranges that no word crosses."""
    start = 0
    while len(text) - start > size:
        end = text.find(b" ", start + size)
        if end < 0:
            break
        yield start, end
        start = end
    yield start, len(text)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    langs = batch.column("lang").to_pylist()
    return zip(langs, batch.column("text").cast(pa.binary()).to_pylist())


def _parts(batches, name: str) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose column ``name`` holds a chunk of bytes, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(name)).fill_null(0).to_numpy(zero_copy_only=False)
        chunk = np.cumsum(sizes) // CHUNK_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(low, high - low) for low, high in zip(cuts, cuts[1:]) if low < high)


def _cut(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (rows.slice(at, BATCH_ROWS) for at in range(0, rows.num_rows, BATCH_ROWS))


def _count_words(batches):
    counts: dict[str, Counter] = {}

    def told():
        for lang, words in counts.items():
            words = pa.RecordBatch.from_pydict(
                {
                    "lang": pa.array([lang] * len(words), pa.string()),
                    "word": pa.array(list(words), pa.binary()).cast(pa.string()),
                    "n": pa.array(list(words.values()), pa.int64()),
                }
            )
            yield from _cut(words)
        counts.clear()

    for batch in _parts(batches, "text"):
        for lang, text in _texts(batch):
            plain = text.translate(_PLAIN)
            for start, end in slices(plain):
                counts.setdefault(lang, Counter()).update(plain[start:end].split())
            if sum(map(len, counts.values())) > CHUNK_ENTRIES // 4:
                yield from told()
    yield from told()


def _built(keys: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base`` and ``check`` of a trie of (``id``, ``key``), and the ids in the order of its leaves."""
    base, check = trie.build(keys.column("key").to_pylist())
    return base, check, np.asarray(keys.column("id"), dtype=np.int64)


def _build(keys):
    return pa.table(
        {
            "trie": keys.column("trie").slice(0, 1),
            **{
                name: pa.array([values.tobytes()], pa.binary())
                for name, values in zip(("base", "check", "ids"), _built(keys))
            },
        }
    )


@contextmanager
def _broadcast(keys: DataFrame, tries: int, label: str):
    """Tries of (``id``, ``key``), each built in a task of its own; they are given up at the end, so what used them must be written by then."""
    kept = "trie long, base binary, check binary, ids binary"
    dealt = keys.select((F.col("id") % tries).alias("trie"), "id", "key")
    built = cut_lineage(dealt.groupBy("trie").applyInArrow(_build, kept), label)
    kinds = (("base", "<i4"), ("check", "<i4"), ("ids", "<i8"))
    broadcasts = []
    for number in range(tries):
        row = built.filter(F.col("trie") == number).first()
        if row is not None:
            arrays = [np.frombuffer(row[name], dtype=kind) for name, kind in kinds]
            broadcasts.append(keys.sparkSession.sparkContext.broadcast(arrays))
            del row, arrays
    try:
        yield broadcasts
    finally:
        for broadcast in broadcasts:
            broadcast.destroy()
        forget(built)


def _pieces(plain: bytes, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a chunk start, and their places in its sequence, which has a zero where a piece ends."""
    text = np.frombuffer(plain, dtype=np.uint8)
    inside = text != _SPACE
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]]))
    breaks = np.cumsum(_IS_BREAK[raw], dtype=np.int32)[starts]
    gap = np.zeros(starts.size, dtype=np.int64)
    gap[1:] = breaks[1:] != breaks[:-1]
    return starts, np.arange(starts.size) + np.cumsum(gap)


def _put(place: np.ndarray, found: np.ndarray) -> np.ndarray:
    out = np.zeros(int(place[-1]) + 1 if place.size else 0, dtype=np.uint32)
    out[place] = found
    return out


def _word_ids(plain: bytes, raw: np.ndarray, doc_starts: np.ndarray, doc_states: np.ndarray, arrays):
    """Ids of the words of a chunk with zeros at the ends of pieces, and where each document's begin."""
    base, check, ids = arrays
    text = np.frombuffer(plain, dtype=np.uint8)
    starts, place = _pieces(plain, raw)
    doc = np.searchsorted(doc_starts, starts, side="right") - 1
    found = np.zeros(starts.size, dtype=np.uint32)
    state = doc_states[doc]
    live = np.flatnonzero(state >= 0)
    state, at = state[live], starts[live]
    while live.size:
        symbol = text[at]
        after, went = trie.advance(base, check, state, symbol)
        ended = went & (symbol == _SPACE)
        found[live[ended]] = ids[base[after[ended]]]
        on = went & ~ended
        live, state, at = live[on], after[on], at[on] + 1
    out = _put(place, found)
    first = np.searchsorted(doc, np.arange(doc_starts.size))  # the first word of each document or a later one
    begins = np.append(place, out.size)[first]
    return out, begins


def _coded(docs: list[tuple[str, bytes]], code: Callable[[list], np.ndarray]) -> Iterator[np.ndarray]:
    """Sequences of the documents of a slice; ``code`` gets about a chunk of text at a time."""
    short = [doc for doc in docs if len(doc[1]) <= CHUNK_BYTES]
    if short:
        yield code(short)
    for lang, text in docs:
        if len(text) > CHUNK_BYTES:
            yield _joined(text, slices(text.translate(_PLAIN)), lambda part, lang=lang: code([(lang, part)]))


def _together(docs: list[tuple[str, bytes]]) -> tuple[bytes, np.ndarray]:
    """The texts, each of a piece of its own, as one: plain and as bytes."""
    text = b"\n".join(t for _, t in docs) + b"\n"
    return text.translate(_PLAIN), np.frombuffer(text, dtype=np.uint8)


def _blocks(batches) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The texts in slices, each with a number no other slice of the table has."""
    first = TaskContext.get().partitionId() << 32
    return enumerate(_parts(batches, "text"), first)


def _rows(ids: np.ndarray) -> list[bytes]:
    """A sequence in rows, which end where pieces end."""
    zeros = np.flatnonzero(ids == 0)
    at = np.searchsorted(zeros, np.arange(ROW_IDS, ids.size, ROW_IDS))
    cuts = np.unique(zeros[at[at < zeros.size]])
    return [part.astype("<u4", copy=False).tobytes() for part in np.split(ids, cuts) if part.any()]


def _told(block: int, ids: np.ndarray) -> dict[str, pa.Array]:
    rows = _rows(ids)
    return {"block": pa.array([block] * len(rows), pa.int64()), "ids": pa.array(rows, pa.binary())}


def _encoder(broadcasts):
    """Writes documents as their frequent words' ids; a word is in one of the tries at most."""

    def run(batches):
        tries = [broadcast.value for broadcast in broadcasts]
        states: dict[str, list[int]] = {}

        def start(lang: str) -> list[int]:
            if lang not in states:
                states[lang] = [trie.walk(base, check, lang.encode() + b" ") for base, check, _ in tries]
            return states[lang]

        def code(docs):
            plain, raw = _together(docs)
            sizes = np.array([len(t) + 1 for _, t in docs])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            doc_states = np.array([start(lang) for lang, _ in docs], dtype=np.int32)
            return reduce(
                np.maximum, (_word_ids(plain, raw, starts, mine, arrays)[0] for mine, arrays in zip(doc_states.T, tries))
            )

        for block, batch in _blocks(batches):
            for ids in _coded(list(_texts(batch)), code):
                yield pa.RecordBatch.from_pydict(_told(block, ids))

    return run


def _word_asker(shards: int):
    """Writes documents as numbers that their words have in the block, and what each shard is asked: those words.

    Rows with ``ids`` are documents; rows with ``shard`` are words of a language and their numbers.
    """

    def run(batches):
        for block, batch in _blocks(batches):
            next_number = count(1).__next__
            known: dict[str, defaultdict] = defaultdict(lambda: defaultdict(next_number))

            def code(docs):
                parts = []
                for lang, mine in groupby(sorted(docs, key=lambda doc: doc[0]), key=lambda doc: doc[0]):
                    plain, raw = _together(list(mine))
                    _, place = _pieces(plain, raw)
                    numbers = np.fromiter(map(known[lang].__getitem__, plain.split()), np.uint32, place.size)
                    parts += [_put(place, numbers), np.zeros(1, dtype=np.uint32)]
                return np.concatenate(parts[:-1])

            for ids in _coded(list(_texts(batch)), code):
                columns = _told(block, ids)
                none = len(columns["ids"])
                columns |= {"shard": pa.nulls(none, pa.int32()), "lang": pa.nulls(none, pa.string())}
                columns |= {name: pa.nulls(none, pa.binary()) for name in ("words", "codes")}
                yield pa.RecordBatch.from_pydict(columns)
            asked: dict[tuple[int, str], tuple[list, list]] = defaultdict(lambda: ([], []))
            for lang, numbers in known.items():
                for word, number in numbers.items():
                    words, codes = asked[zlib.crc32(word) % shards, lang]
                    words.append(word)
                    codes.append(number)
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([block] * len(asked), pa.int64()),
                    "ids": pa.nulls(len(asked), pa.binary()),
                    "shard": pa.array([shard for shard, _ in asked], pa.int32()),
                    "lang": pa.array([lang for _, lang in asked], pa.string()),
                    "words": pa.array([b" ".join([*words, b""]) for words, _ in asked.values()], pa.binary()),
                    "codes": pa.array([np.array(codes, dtype="<u8").tobytes() for _, codes in asked.values()], pa.binary()),
                }
            )

    return run


def _answers(blocks: list, codes: list, found: list) -> dict[str, pa.Array]:
    """What is known of the codes asked: those with an id, and their ids."""
    known = [ids > 0 for ids in found]
    return {
        "block": pa.array(blocks, pa.int64()),
        "codes": pa.array([c[k].tobytes() for c, k in zip(codes, known)], pa.binary()),
        "found": pa.array([f[k].astype("<u4", copy=False).tobytes() for f, k in zip(found, known)], pa.binary()),
    }


def _word_answerer(keys, asked):
    """Ids of the words asked of one shard."""
    arrays = _built(keys)
    states: dict[str, int] = {}
    blocks, codes, found = [], [], []
    for batch in _parts(asked.to_batches(), "words"):
        texts = batch.column("words").to_pylist()
        langs = batch.column("lang").to_pylist()
        for lang in {*langs} - {*states}:
            states[lang] = trie.walk(arrays[0], arrays[1], lang.encode() + b" ")
        joined = b"".join(texts)
        starts = np.concatenate([[0], np.cumsum([len(text) for text in texts])[:-1]]).astype(np.int64)
        doc_states = np.array([states[lang] for lang in langs], dtype=np.int32)
        ids, begins = _word_ids(joined, np.frombuffer(joined, dtype=np.uint8), starts, doc_states, arrays)
        blocks += batch.column("block").to_pylist()
        codes += [np.frombuffer(mine, dtype="<u8") for mine in batch.column("codes").to_pylist()]
        found += np.split(ids, begins[1:])
    return pa.table(_answers(blocks, codes, found))


def _placer(paired: bool):
    """Puts the answers to a block in the places that asked."""

    def run(sequences, answers):
        codes = np.frombuffer(b"".join(answers.column("codes").to_pylist()), dtype="<u8")
        found = np.frombuffer(b"".join(answers.column("found").to_pylist()), dtype="<u4")
        order = np.argsort(codes)
        codes, found = codes[order], found[order]
        rows = []
        for batch in _parts(sequences.to_batches(), "ids") if codes.size else ():
            ids = _sequence(batch)
            mine = _pairs(ids) if paired else ids.astype(np.uint64)
            at = np.minimum(np.searchsorted(codes, mine), codes.size - 1)
            rows += _rows(np.where((codes[at] == mine) & (mine > 0), found[at], np.uint32(0)))
        block = sequences.column("block")[0].as_py() if rows else None
        return pa.table({"block": pa.array([block] * len(rows), pa.int64()), "ids": pa.array(rows, pa.binary())})

    return run


def _placed(sequences: DataFrame, answers: DataFrame, paired: bool, label: str) -> DataFrame:
    both = sequences.groupBy("block").cogroup(answers.groupBy("block"))
    return cut_lineage(both.applyInArrow(_placer(paired), SEQUENCES), label)


def _joined(text: bytes, ranges, code) -> np.ndarray:
    """A long text's ids from those of its slices; a zero between two slices where a piece ends there."""
    parts, before = [], 0
    for start, end in ranges:
        part = text[start:end]
        mine = code(part)
        if mine.size:
            first = start + len(part) - len(part.lstrip(_ENDS))
            if parts and any(mark in _BREAKS for mark in text[before:first]):
                parts.append(np.zeros(1, dtype=np.uint32))
            parts.append(mine)
            before = start + len(part.rstrip(_ENDS))
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint32)


def _sequence(batch: pa.RecordBatch) -> np.ndarray:
    """The id sequences of the documents, a zero after each."""
    return np.frombuffer(b"\0\0\0\0".join([*batch.column("ids").to_pylist(), b""]), dtype="<u4")


def _pairs(ids: np.ndarray) -> np.ndarray:
    """Each place's code: its id and the next one, or 0 where either is none."""
    codes = np.zeros(ids.size, dtype=np.uint64)
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    codes[both] = ids[both].astype(np.uint64) << np.uint64(32) | ids[both + 1]
    return codes


def _follow(least: int):
    """(``code``, ``n``): two frequent phrases at neighbouring places, with their count cut off at ``least``."""

    def run(batches):
        held, size = [], 0

        def told():
            codes, counts = np.unique(np.concatenate(held), return_counts=True)
            counts = np.minimum(counts, least)
            yield from _cut(
                pa.RecordBatch.from_pydict({"code": pa.array(codes.view(np.int64)), "n": pa.array(counts, pa.int64())})
            )

        for ids in map(_sequence, _parts(batches, "ids")):
            codes = _pairs(ids)
            held.append(codes[codes > 0])
            size += held[-1].size
            if size >= CHUNK_ENTRIES:
                yield from told()
                held, size = [], 0
        if size:
            yield from told()

    return run


def _reached(base, check, first: np.ndarray, second: np.ndarray, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs a trie of id pairs knows, and the leaves they reach."""
    live, state = np.arange(first.size), np.zeros(first.size, dtype=np.int32)
    for step in range(2 * digits):
        part, shift = (first, second)[step // digits], DIGIT_BITS * (digits - 1 - step % digits)
        symbol = part[live] >> np.uint32(shift) & np.uint32((1 << DIGIT_BITS) - 1)
        after, went = trie.advance(base, check, state, symbol.astype(np.int32))
        live, state = live[went], after[went]
    return live, base[state]


def _advancer(broadcasts, digits: int, last: bool):
    """Moves all positions through tries of id pairs: what each found, and how often each leaf was reached.

    Rows with ``ids`` are sequences; rows with ``sums`` are this task's counts, dense in the order of ids.
    """

    def run(batches):
        tries = [broadcast.value for broadcast in broadcasts]
        counts = [np.zeros(numbers.size, dtype=np.int64) for _, _, numbers in tries]
        for batch in _parts(batches, "ids"):
            ids = _sequence(batch)
            at = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
            found = np.zeros(ids.size, dtype=np.uint32)
            for (base, check, numbers), sums in zip(tries, counts):
                live, leaves = _reached(base, check, ids[at], ids[at + 1], digits)
                sums += np.bincount(leaves, minlength=sums.size)
                found[at[live]] = numbers[leaves]
            if last:
                continue
            rows = _told(batch.column("block")[0].as_py(), found)
            none = len(rows["ids"])
            yield pa.RecordBatch.from_pydict(rows | {"part": pa.nulls(none, pa.int64()), "sums": pa.nulls(none, pa.binary())})
        dense = np.zeros(1 + sum(sums.size for sums in counts), dtype="<i8")
        for (_, _, numbers), sums in zip(tries, counts):
            dense[numbers] = sums
        parts = np.split(dense, range(ROW_COUNTS, dense.size, ROW_COUNTS))
        told = [(number, part.tobytes()) for number, part in enumerate(parts) if part.any()]
        yield pa.RecordBatch.from_pydict(
            {
                "block": pa.nulls(len(told), pa.int64()),
                "ids": pa.nulls(len(told), pa.binary()),
                "part": pa.array([number for number, _ in told], pa.int64()),
                "sums": pa.array([part for _, part in told], pa.binary()),
            }
        )

    return run


def _add_up(rows):
    """The counts of all tasks for the ids of one part."""
    sums = sum(np.frombuffer(each.as_py(), dtype="<i8") for each in rows.column("sums"))
    reached = np.flatnonzero(sums)
    first = rows.column("part")[0].as_py() * ROW_COUNTS
    return pa.table({"id": pa.array(first + reached, pa.int64()), "a": pa.array(sums[reached], pa.int64())})


def _pair_shard(prefix, suffix, shards: int):
    """The shard of a pair of ids, for columns and arrays alike."""
    return (prefix * 1_000_003 + suffix) % shards


def _pair_asker(shards: int):
    """What each shard is asked: the distinct pairs of a block, and how often they stand there."""

    def run(batches):
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), batch.num_rows]
            runs = (batch.slice(low, high - low) for low, high in zip(cuts, cuts[1:]) if low < high)
            for part in _parts(runs, "ids"):
                codes = _pairs(_sequence(part))
                codes, counts = np.unique(codes[codes > 0], return_counts=True)
                shard = _pair_shard((codes >> np.uint64(32)).astype(np.int64), codes.view(np.uint32)[::2], shards)
                order = np.argsort(shard, kind="stable")
                asked, begins = np.unique(shard[order], return_index=True)
                ranges = list(zip(begins, [*begins[1:], codes.size]))
                codes, counts = codes[order], counts[order].astype("<u4")
                yield pa.RecordBatch.from_pydict(
                    {
                        "shard": pa.array(asked, pa.int32()),
                        "block": pa.array([part.column("block")[0].as_py()] * asked.size, pa.int64()),
                        "codes": pa.array([codes[low:high].tobytes() for low, high in ranges], pa.binary()),
                        "counts": pa.array([counts[low:high].tobytes() for low, high in ranges], pa.binary()),
                    }
                )

    return run


def _pair_answerer(digits: int, last: bool):
    """Moves the pairs asked of one shard through its trie: the ids they found, and how often each leaf was reached.

    Rows with ``block`` are answers; rows with ``id`` are counts.
    """

    def run(keys, asked):
        base, check, numbers = _built(keys)
        counts = np.zeros(numbers.size, dtype=np.int64)
        blocks, codes, found = [], [], []
        for batch in _parts(asked.to_batches(), "codes"):
            mine = [np.frombuffer(each, dtype="<u8") for each in batch.column("codes").to_pylist()]
            all_codes = np.concatenate(mine)
            times = np.frombuffer(b"".join(batch.column("counts").to_pylist()), dtype="<u4")
            first, second = (all_codes >> np.uint64(32)).astype(np.uint32), all_codes.astype(np.uint32)
            live, leaves = _reached(base, check, first, second, digits)
            # sums of a batch are far below 2^53, where floats end to be exact
            counts += np.bincount(leaves, weights=times[live], minlength=counts.size).astype(np.int64)
            if last:
                continue
            ids = np.zeros(all_codes.size, dtype=np.uint32)
            ids[live] = numbers[leaves]
            blocks += batch.column("block").to_pylist()
            codes += mine
            found += np.split(ids, np.cumsum([each.size for each in mine])[:-1])
        reached = np.flatnonzero(counts)
        answers = _answers(blocks, codes, found)
        none = pa.nulls(len(blocks), pa.int64())
        sums = {
            "block": pa.nulls(reached.size, pa.int64()),
            "codes": pa.nulls(reached.size, pa.binary()),
            "found": pa.nulls(reached.size, pa.binary()),
            "id": pa.array(numbers[reached], pa.int64()),
            "n": pa.array(counts[reached]),
        }
        return pa.concat_tables([pa.table(answers | {"id": none, "n": none}), pa.table(sums)])

    return run


def _first_level(texts: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """Counts of all words, and the frequent ones with ids."""
    counted = texts.mapInArrow(_count_words, "lang string, word string, n long")
    counted = cut_lineage(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    frequent, number = numbered(counted.filter(F.col("n") >= least), "phrases-1")
    none = F.array().cast("array<long>")
    level = frequent.select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("n").alias("a"),
        none.alias("lefts"), none.alias("rights"),
    )
    return counted, level, number


def _shards(tries: int, running: int) -> int:
    """Tries to build where they are asked, ``tries`` for their keys and enough of them for the words of a text that ask."""
    return max(tries, 1 + running // SHARD_WORDS)


def _encode(texts: DataFrame, words: DataFrame, running: int) -> DataFrame:
    """Sequences of the ids of frequent words; ``running`` is the number of words of all texts."""
    key = F.encode(F.concat("lang", F.lit(" "), "phrase", F.lit(" ")), "utf-8")
    keys = words.select("id", key.alias("key"), F.encode("phrase", "utf-8").alias("word"))
    tries = 1 + keys.agg(F.sum(F.length("key"))).first()[0] // TRIE_BYTES
    if tries <= TRIES:
        with _broadcast(keys.select("id", "key"), tries, "trie-1") as broadcasts:
            return cut_lineage(texts.mapInArrow(_encoder(broadcasts), SEQUENCES), "ids-1")
    shards = _shards(tries, running)
    local = texts.select("lang", "text").mapInArrow(
        _word_asker(shards), f"{SEQUENCES}, shard int, lang string, words binary, codes binary"
    )
    local = cut_lineage(local, "local")
    asked = local.filter(F.col("shard").isNotNull()).select("shard", "block", "lang", "words", "codes")
    dealt = keys.select((F.crc32("word") % shards).cast("int").alias("shard"), "id", "key")
    answers = dealt.groupBy("shard").cogroup(asked.groupBy("shard"))
    answers = cut_lineage(answers.applyInArrow(_word_answerer, "block long, codes binary, found binary"), "answers-1")
    placed = _placed(local.filter(F.col("ids").isNotNull()).select("block", "ids"), answers, False, "ids-1")
    forget(local, answers)
    return placed


def _next_level(
    sequences: DataFrame, below: DataFrame, number: int, words: int, least: int, last: bool, running: int
) -> tuple[DataFrame | None, DataFrame, int]:
    """Id sequences, phrases and number of phrases of ``words`` words, from those of one word less.

    The sequences given are given up.
    """
    pairs = sequences.mapInArrow(_follow(least), "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    first = F.shiftrightunsigned("code", 32)
    pairs = pairs.filter(F.col("n") >= least).select(
        first.alias("prefix"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("suffix")
    )
    chosen, found = numbered(pairs, f"candidates-{words}")
    digits = -(-number.bit_length() // DIGIT_BITS)

    def written(name: str) -> list[Column]:
        shifts = range(DIGIT_BITS * (digits - 1), -1, -DIGIT_BITS)
        values = (F.shiftright(name, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1)) for shift in shifts)
        return [F.unhex(F.lpad(F.hex(value), 2, "0")) for value in values]

    if not found:
        return None, below.limit(0), 0
    keys = chosen.select("id", F.concat(*written("prefix"), *written("suffix")).alias("key"), "prefix", "suffix")
    tries = 1 + found // TRIE_KEYS
    if tries <= TRIES:
        with _broadcast(keys.select("id", "key"), tries, f"trie-{words}") as broadcasts:
            walked = sequences.mapInArrow(_advancer(broadcasts, digits, last), f"{SEQUENCES}, part long, sums binary")
            walked = cut_lineage(walked, f"ids-{words}")
        rows = walked.filter(F.col("ids").isNotNull()).select("block", "ids")
        summed = walked.filter(F.col("part").isNotNull()).select("part", "sums").groupBy("part")
        summed = summed.applyInArrow(_add_up, "id long, a long")
    else:
        shards = _shards(tries, running)
        asked = sequences.mapInArrow(_pair_asker(shards), "shard int, block long, codes binary, counts binary")
        shard = _pair_shard(F.col("prefix"), F.col("suffix"), shards).cast("int")
        walked = keys.select(shard.alias("shard"), "id", "key").groupBy("shard").cogroup(asked.groupBy("shard"))
        schema = "block long, codes binary, found binary, id long, n long"
        walked = cut_lineage(walked.applyInArrow(_pair_answerer(digits, last), schema), f"answers-{words}")
        answers = walked.filter(F.col("block").isNotNull()).select("block", "codes", "found")
        rows = None if last else _placed(sequences, answers, True, f"ids-{words}")
        summed = walked.filter(F.col("id").isNotNull()).groupBy("id").agg(F.sum("n").alias("a"))
    before = below.select(F.col("id").alias("prefix"), "lang", "phrase", F.col("a").alias("left"), "lefts")
    after = below.select(F.col("id").alias("suffix"), F.col("last"), F.col("a").alias("right"), "rights")
    level = chosen.join(summed, "id").join(before, "prefix").join(after, "suffix")
    level = level.select(
        "id", "prefix", "suffix", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "a",
        F.concat("lefts", F.array("left")).alias("lefts"), F.concat(F.array("right"), "rights").alias("rights"),
    )
    level = cut_lineage(level, f"phrases-{words}")
    forget(chosen, sequences, *([walked] if last or tries > TRIES else []))
    return (None if last else rows), level, found


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    cover_percent: int = COVER_PERCENT,
    top: int = TOP,
    scale: int = SCALE,
) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` words: ``lang, rank, phrase, a, l, r, n, score``.

    ``a`` is a phrase's count, ``l`` and ``r`` those of the two parts of its weakest cut, ``n`` the words of the language and
    ``score`` the floor of ``scale * a * a / (l * r)``. A phrase is left out when a longer one with at least
    ``cover_percent`` of its count contains it. Equal scores go by ``a``, then by the bytes of the phrase.
    """
    texts = docs.select(
        F.coalesce(col(lang_col).cast("string"), F.lit(UNDETERMINED)).alias("lang"),
        F.coalesce(col(text_col), F.lit("")).alias("text"),
    )
    words, level, number = _first_level(texts, least)
    levels: list[DataFrame] = []
    if number and max_words > 1:
        running = words.agg(F.sum("n")).first()[0]
        sequences = _encode(texts, level, running)
        for size in range(2, max_words + 1):
            sequences, level, number = _next_level(sequences, level, number, size, least, size == max_words, running)
            if not number:
                break
            levels.append(level)
    if not levels:
        return docs.sparkSession.createDataFrame([], RESULT)
    ranked = [_scored(level, _covers(longer), cover_percent, scale) for level, longer in zip(levels, [*levels[1:], None])]
    best = _best(reduce(DataFrame.unionByName, ranked), top)
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


def _covers(longer: DataFrame | None) -> DataFrame | None:
    """The count of the most frequent phrase, one word longer, around each phrase."""
    if longer is None:
        return None
    parts = longer.select(F.explode(F.array("prefix", "suffix")).alias("id"), F.col("a").alias("around"))
    return parts.groupBy("id").agg(F.max("around").alias("around"))


def _scored(level: DataFrame, covers: DataFrame | None, cover_percent: int, scale: int) -> DataFrame:
    if covers is not None:
        level = level.join(covers, "id", "left").filter(
            F.col("around").isNull() | (100 * F.col("around") < cover_percent * F.col("a"))
        )

    def exact(value: Column) -> Column:
        return value.cast("decimal(19,0)")

    square = F.lit(scale).cast("decimal(38,0)") * exact(F.col("a")) * exact(F.col("a"))

    def cut(parts: Column, place: Column) -> Column:
        score = F.call_function("div", square, exact(parts["lefts"]) * exact(parts["rights"]))
        return F.struct(
            score.cast("long").alias("score"), place.alias("k"), parts["lefts"].alias("l"), parts["rights"].alias("r")
        )

    weakest = F.array_min(F.transform(F.arrays_zip("lefts", "rights"), cut))
    return level.withColumn("cut", weakest).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each language, found in groups of it first, so no task orders a whole language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    for keys in (["lang", "_group"], ["lang"]):
        scored = scored.withColumn("_group", group)
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        scored = scored.withColumn("rank", rank).filter(F.col("rank") <= top)
    return scored.drop("_group")
