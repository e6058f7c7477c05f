"""Near duplicates by HyperMinHash: banded compressed registers, corrected estimates, exact verification."""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import col, cut_lineage

SHINGLE_WORDS = 5
#: Links need ``100 * intersection >= PERCENT * union``.
PERCENT = 75
#: 32 bands of 4 registers: two sets at the threshold share none of them once in 190,000 times.
REGISTERS = 128
BAND_REGISTERS = 4
MANTISSA_BITS = 10
#: Four standard deviations of the estimate below the threshold.
PLAUSIBLE = PERCENT / 100 - 4 * (PERCENT / 100 * (1 - PERCENT / 100) / REGISTERS) ** 0.5
#: Shingles of the members, and of those they are compared with, that one row of a bucket holds.
BLOCK_SHINGLES = 65_536
#: Smaller sets are similar enough only to their equals.
LEAST_SHINGLES = -(-PERCENT // (100 - PERCENT))
#: Bytes and words hashed at a time, which bounds a task's memory.
CHUNK_BYTES = 2_000_000
SLICE_WORDS = 100_000

_RNG = np.random.default_rng(20_240_501)
_BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE_VALUES[_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: For each register, the order in which an empty one asks the others for their value.
_DONORS = np.array([_RNG.permutation(REGISTERS) for _ in range(REGISTERS)])
_BUCKET_BITS = REGISTERS.bit_length() - 1
_BUCKET_STARTS = np.arange(REGISTERS, dtype=np.uint64) << np.uint64(64 - _BUCKET_BITS)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    powers = np.full(n, base, np.uint64)
    powers[0] = 1
    return np.cumprod(powers, dtype=np.uint64)


def _word_hashes(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit polynomial hash of each word of a buffer, slice by slice."""
    hashes = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), SLICE_WORDS):
        first, last = starts[k : k + SLICE_WORDS], ends[k : k + SLICE_WORDS]
        part = buffer[first[0] : last[-1]]
        begins = first - first[0]
        longest = int((last - first).max())
        spans = np.diff(np.append(begins, len(part)))
        place = np.arange(len(part)) - np.repeat(begins, spans)
        np.minimum(place, longest, out=place)
        hashes[k : k + SLICE_WORDS] = np.add.reduceat(
            _BYTE_VALUES[part] * _powers(_BASE, longest + 1)[place], begins
        )
    return _mixed(hashes)


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The distinct word shingles of each text as sorted 64-bit hashes.

    Words are runs of anything but ASCII white space, A-Z lower-cased. A text of fewer words than a shingle has
    its whole sequence as one; one without words has none.
    """
    coded = [text.encode("utf-8", "surrogatepass").lower() for text in texts]
    buffer = np.frombuffer(b"\n" + b"\n".join(coded) + b"\n", np.uint8)
    space = _SPACE[buffer]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    hashes = _word_hashes(buffer, starts, ends)
    edges = np.cumsum([1, *(len(c) + 1 for c in coded)])
    words = np.searchsorted(starts, edges)
    factors = _powers(_STEP, SHINGLE_WORDS)
    n = max(0, len(hashes) - SHINGLE_WORDS + 1)
    shingles = np.zeros(n, np.uint64)
    for k in range(SHINGLE_WORDS):
        shingles += hashes[k : k + n] * factors[k]
    shingles = _mixed(shingles)
    found = []
    for low, high in zip(words[:-1], words[1:]):
        if high - low >= SHINGLE_WORDS:
            found.append(np.unique(shingles[low : high - SHINGLE_WORDS + 1]))
        elif high > low:
            few = hashes[low:high] * factors[: high - low]
            found.append(_mixed(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(high - low)))
        else:
            found.append(np.zeros(0, np.uint64))
    return found


def registers(shingles: np.ndarray) -> np.ndarray:
    """HyperMinHash of a sorted set: per bucket the least hash as its count of leading zeros and the
    MANTISSA_BITS bits after the first one.

    An empty bucket takes the value of the first bucket in its own random order that has one, so small sets
    collide as often as their Jaccard similarity says.
    """
    at = np.searchsorted(shingles, _BUCKET_STARTS)
    least = shingles[np.minimum(at, len(shingles) - 1)]
    own = (at < len(shingles)) & (least >> np.uint64(64 - _BUCKET_BITS) == np.arange(REGISTERS, dtype=np.uint64))
    fraction, exponent = np.frexp((least << np.uint64(_BUCKET_BITS)).astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 62)
    mantissa = np.clip((fraction * 2 - 1) * (1 << MANTISSA_BITS), 0, (1 << MANTISSA_BITS) - 1).astype(np.int64)
    value = ((zeros << MANTISSA_BITS) | mantissa).astype(np.uint16)
    if not own.all():
        donor = _DONORS[np.arange(REGISTERS), own[_DONORS].argmax(axis=1)]
        value = np.where(own, value, value[donor])
    return value


@functools.lru_cache(maxsize=4096)
def accidental(log_a: int, log_b: int) -> float:
    """How often registers of two unrelated sets with about ``2**log`` shingles agree by chance."""
    edges = np.array([0.0])
    for zeros in range(40, -1, -1):
        low = 2.0 ** -(zeros + 1)
        edges = np.append(edges, low + low * np.arange(1 << MANTISSA_BITS) / (1 << MANTISSA_BITS))
    edges = np.append(edges, 1.0)
    chance = [
        -np.diff((1 - edges) ** max(1.0, 2.0**log / REGISTERS)) for log in (log_a, log_b)
    ]
    return float((chance[0] * chance[1]).sum())


def estimated_jaccard(equal: float, n_a: int, n_b: int) -> float:
    """From the share of equal registers, with accidental agreement taken out."""
    chance = accidental(n_a.bit_length(), n_b.bit_length())
    return (equal - chance) / (1 - chance)


def _signatures(docs: DataFrame) -> DataFrame:
    """``id``, ``n`` (shingles), ``class`` (digest of the set) and ``registers``, the last two null without
    shingles."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, sets in _sets_of(batch.column("text")):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(start, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                    ],
                    ["id", "n", "class", "registers"],
                )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(sign, f"id {kind}, n long, class binary, registers binary")


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _sets_of(texts: pa.Array) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Shingle sets in runs of about CHUNK_BYTES characters, each with the row of its first text."""
    start, size, chunk = 0, 0, []
    for i, text in enumerate(texts):
        chunk.append(text.as_py() or "")
        size += len(chunk[-1])
        if size >= CHUNK_BYTES or i + 1 == len(texts):
            yield start, shingle_sets(chunk)
            start, size, chunk = i + 1, 0, []


def _bands(classes: DataFrame) -> DataFrame:
    """(key, band, node) for each band of each class that can be linked at all."""
    width = 2 * BAND_REGISTERS
    numbers = F.array(*[F.lit(i) for i in range(REGISTERS // BAND_REGISTERS)])
    keys = F.transform(numbers, lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))))
    return classes.filter(F.col("n") >= LEAST_SHINGLES).select("node", F.posexplode(keys).alias("band", "key"))


def _shingles_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles): the full set of each class in ``wanted`` (node, class, first_id), from a document of it."""
    named = wanted.select("node", "class", F.col("first_id").alias("id"))
    texts = docs.join(named, docs["id"].eqNullSafe(named["id"])).select("node", "class", "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for batch in batches:
            for start, sets in _sets_of(batch.column("text")):
                names = batch.column("class").slice(start, len(sets)).to_pylist()
                rows = [i for i, (s, name) in enumerate(zip(sets, names)) if len(s) and _digest(s) == name]
                rows = [i for i in rows if not (names[i] in done or done.add(names[i]))]
                nodes = batch.column("node").slice(start, len(sets)).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([nodes[i] for i in rows], pa.int64()),
                        pa.array([sets[i].tobytes() for i in rows], pa.binary()),
                    ],
                    ["node", "shingles"],
                )

    return texts.mapInArrow(build, "node long, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    met = pairs.select("a", "b").join(left, "a").join(right, "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = len(np.intersect1d(a, b, assume_unique=True)) if _sizes_allow(len(a), len(b), percent) else 0
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            found = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            yield found

    return met.select("a", "b", "set_a", "set_b").mapInArrow(verify, "a long, b long")


def _sizes_allow(a: int, b: int, percent: int) -> bool:
    return 100 * min(a, b) >= percent * max(a, b)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that ``edges`` (a, b) connect; the root is the least node.

    Alternating stars: every node links its larger neighbours to its least one, then its smaller ones too,
    until nothing changes. A node of any degree is aggregated before it is shuffled.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut_lineage(
            small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "component-links"
        )
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _star_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Confirmed links (a, b) of every class to at most two others: of two hubs that each bucket has, those
    that it shares most bands with. Work is linear in the members of a bucket."""
    second = F.xxhash64("node")
    hubs = members.groupBy("key").agg(F.min("node").alias("first"), F.min_by("node", second).alias("second"))
    pairs = None
    for hub in ("first", "second"):
        met = members.join(hubs.select("key", F.col(hub).alias("hub")), "key").filter("node <> hub")
        shared = met.groupBy("node", "hub").agg(F.count(F.lit(1)).alias("bands"))
        best = shared.groupBy("node").agg(F.max_by("hub", F.struct("bands", -F.col("hub"))).alias("hub"))
        found = best.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
    return _verified(pairs.distinct(), sets, PERCENT)


def _star_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root): nodes with one root are connected; connected nodes need not have one root yet."""
    nodes = members.select("node").distinct()
    least = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    once = nodes.join(least, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    upper = once.select(F.col("node").alias("root"), F.col("root").alias("top"))
    return once.join(upper, "root").select("node", F.col("top").alias("root"))


def _bucket_links(members: DataFrame, classes: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Confirmed links (a, b) between members of a bucket that have different roots.

    Whoever is outside a bucket's largest root meets all its members. A bucket of BLOCK_SHINGLES or fewer is one row;
    of a larger one both sides come in blocks of about that size, so a bucket of any size is a number of rows of bounded size, and only links leave them.
    A pair is looked at in the first band it shares alone.
    """
    rooted = cut_lineage(members.join(roots, "node").join(classes.select("node", "n"), "node"), "rooted-members")
    marks = {"low": F.min, "high": F.max, "mark": F.bit_xor, "other_mark": F.bit_xor}
    marked = rooted.withColumns(
        {"low": F.col("node"), "high": F.col("node"), "mark": F.xxhash64("node"), "other_mark": F.xxhash64("node", F.lit(1))}
    )
    sizes = marked.groupBy("key", "band", "root").agg(
        F.count(F.lit(1)).alias("members"),
        F.sum("n").alias("n"),
        *[summary(name).alias(name) for name, summary in marks.items()],
    )
    opened = (
        sizes.groupBy("key", "band")
        .agg(
            F.max_by("root", F.struct("members", "root")).alias("major"),
            F.max_by("n", F.struct("members", "root")).alias("major_n"),
            F.sum("n").alias("all_n"),
            F.sum("members").alias("size"),
            F.count(F.lit(1)).alias("roots"),
            *[summary(name).alias(name) for name, summary in marks.items()],
        )
        .filter("roots > 1")
        # of buckets with the same members the one of the first band is enough: it is where their pairs are looked at
        .groupBy("size", *marks)
        .agg(F.min(F.struct("band", "key", "major", "major_n", "all_n")).alias("bucket"))
        .select("bucket.key", "bucket.major", "bucket.major_n", "bucket.all_n")
    )
    opened = cut_lineage(opened, "open-buckets")
    held = F.struct("node", "root", "n", "registers", "shingles")
    whole = classes.select("node", "registers").join(sets, "node")
    inside = rooted.join(opened, "key").join(whole, "node")
    outside = rooted.join(opened, "key").filter("root <> major").join(whole, "node")

    # a bucket of one block is gathered once, its outsiders marked
    outer = (F.col("root") != F.col("major")).alias("outer")
    single = (
        inside.filter(F.col("all_n") <= BLOCK_SHINGLES)
        .groupBy("key", "band")
        .agg(F.collect_list(F.struct("node", "root", "n", "registers", "shingles", outer)).alias("members"))
    )

    def compare_single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _found(
                (_Side(rows.filter(rows.field("outer"))), _Side(rows), band)
                for band, rows in _rows_of(batch, "members")
            )

    def blocks(rows: DataFrame, n: Column, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.ceil(n / BLOCK_SHINGLES))
        return rows.groupBy("key", "band", block.alias(f"{name}_block")).agg(F.collect_list(held).alias(name))

    large = F.col("all_n") > BLOCK_SHINGLES
    met = blocks(inside.filter(large), F.col("all_n"), "members").join(
        blocks(outside.filter(large), F.col("all_n") - F.col("major_n"), "outsiders").drop("band"), "key"
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _found(
                (_Side(outsiders), _Side(members), band)
                for (band, outsiders), (_, members) in zip(_rows_of(batch, "outsiders"), _rows_of(batch, "members"))
            )

    links = single.select("band", "members").mapInArrow(compare_single, "a long, b long")
    return links.unionByName(met.select("band", "outsiders", "members").mapInArrow(compare, "a long, b long"))


def _rows_of(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, pa.StructArray]]:
    for i in range(batch.num_rows):
        yield batch.column("band")[i].as_py(), batch.column(name)[i].values


def _found(sides: Iterator[tuple[_Side, _Side, int]]) -> pa.RecordBatch:
    links = [link for outside, inside, band in sides for link in _links_between(outside, inside, band)]
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])


class _Side:
    """One block of a bucket."""

    def __init__(self, rows: pa.StructArray):
        self.nodes, self.roots, self.n = (
            rows.field(k).to_numpy(zero_copy_only=False) for k in ("node", "root", "n")
        )
        values = b"".join(rows.field("registers").to_pylist())
        self.registers = np.frombuffer(values, np.uint16).reshape(-1, REGISTERS)
        self.shingles = rows.field("shingles")

    def set_of(self, i: int) -> np.ndarray:
        return np.frombuffer(self.shingles[i].as_buffer(), np.uint64)


def _links_between(outside: _Side, inside: _Side, band: int) -> list[tuple[int, int]]:
    """Links that join different roots. Likelier pairs come first, and a pair whose roots a link of this
    block has joined already adds nothing."""
    joined: dict[int, int] = {}

    def top(root: int) -> int:
        while root in joined:
            root = joined[root]
        return root

    links = []
    for k, node in enumerate(outside.nodes):
        equal = inside.registers == outside.registers[k]
        share = equal.mean(axis=1)
        first = equal.reshape(len(equal), -1, BAND_REGISTERS).all(axis=2).argmax(axis=1)
        likely = np.flatnonzero((first == band) & (share >= PLAUSIBLE) & (inside.nodes != node))
        n, own = int(outside.n[k]), None
        for i in likely[np.argsort(-share[likely], kind="stable")]:
            m = int(inside.n[i])
            mine, other = top(int(outside.roots[k])), top(int(inside.roots[i]))
            if mine == other or not _sizes_allow(n, m, PERCENT) or estimated_jaccard(share[i], n, m) < PLAUSIBLE:
                continue
            own = outside.set_of(k) if own is None else own
            both = len(np.intersect1d(own, inside.set_of(i), assume_unique=True))
            if 100 * both >= PERCENT * (n + m - both):
                joined[mine] = other
                links.append((int(node), int(inside.nodes[i])))
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id``, ``n_shingles``, ``component_id`` and ``kept``.

    Rows with equal shingle sets form a class, which is compared once. A class is signed with HyperMinHash
    registers; classes that share a band of them meet in a bucket. First every class is held against two hubs
    at most, so copies of one text take a comparison or two each however many they are. Then
    members of a bucket that are not known to be connected are compared in blocks. Candidates pass a
    collision-corrected estimate of their Jaccard similarity and are confirmed on their full shingle sets.
    ``component_id`` is the least id of all documents reachable over confirmed links.

    A null, empty or white text has no shingles and is linked with nothing, not even its like. Null ids name no component:
    a row with one is kept only if its whole component has none. Rows that repeat an id are documents of their own; all
    with the least id of their component are kept. Other columns are left out; an empty table gives no rows.
    """
    source = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    signed = cut_lineage(_signatures(source), "signatures")
    grouped = (
        signed.filter(F.col("class").isNotNull())
        .groupBy("class")
        .agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("registers").alias("registers"))
    )
    classes = cut_lineage(grouped.withColumn("node", F.monotonically_increasing_id()), "classes")
    bands = _bands(classes)
    buckets = bands.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = cut_lineage(bands.join(buckets.select("key"), "key"), "bucket-members")
    wanted = members.select("node").distinct().join(classes.select("node", "class", "first_id"), "node")
    sets = cut_lineage(_shingles_of(source, wanted), "shingle-sets")
    stars = cut_lineage(_star_links(members, sets), "star-links")
    rest = cut_lineage(_bucket_links(members, classes, sets, _star_roots(members, stars)), "bucket-links")
    roots = components(stars.unionByName(rest))
    linked = classes.select("class", "node", "first_id").join(roots, "node", "left")
    linked = linked.select("class", "first_id", F.coalesce("root", "node").alias("root"))
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.join(least, "root").select("class", "component_id")
    placed = signed.select("id", "n", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return placed.select("id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn(
        "kept", F.col("id").eqNullSafe(F.col("component_id"))
    )
