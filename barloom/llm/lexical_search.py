"""Ranked lexical search with the terms split over owners, which bundles of items visit one after the other.

Documents are cut into blocks. A term owner holds the postings of its terms, by block. An item bundle travels with sparse
accumulators, one per item and document that has scored: in every round it meets its next owner by a cogroup on (owner,
block), the owner's terms add their integer contributions, and the bundle moves on. Bundle ``b`` starts at owner ``b``, so all
owners work in every round when there are as many bundles. The last round selects the best of each block.

* A group of a cogroup is one owner's postings in one block and the bundles that are there: at most ``BLOCK_DOCS`` documents and
  the items of one wave, whatever the corpus or the frequency of a term. Nothing is cut off or sampled.
* The terms of one wave of items, at most ``WAVE_TERMS`` and those of one item more, are broadcast; a larger set of items takes
  several waves, each with a scan of the texts.
* Spark sums document frequencies and sizes; the driver sees one number per term of the wave.

Defined results: terms are the longest runs of digits, letters and characters from U+0080 on, only A-Z lower-cased; a null or
empty text has none. Every row is a document or an item of its own, also when its id is repeated or null; a null id comes last
among equals. Items without a scoring document have no rows, as have all on an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.collocations import slices
from barloom.llm.common import col, cut_lineage, numbered, scratch_path

OWNERS = 4
BLOCK_DOCS, BLOCK_HITS = 4_096, 1 << 21
BUNDLE_ITEMS = 256
WAVE_TERMS = 1 << 18
TOP = 10
GROUPS = 64

# fixed values: the characters of a term, and the constants of the score
_KEPT = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
_TERMS = bytes(
    c if c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)
UNIT, SATURATION, LENGTH_SHARE, WEIGHT = 1_000_000_000, 8, 90, 1_000


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a slice of it at a time."""
    plain = text.translate(_TERMS)
    for start, end in slices(plain):
        yield plain[start:end].split()


def _item_terms(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.binary()).to_pylist()
        found = [sorted({t for part in terms(text) for t in part}) for text in texts]
        yield pa.RecordBatch.from_pydict(
            {
                "item": batch.column("item"),
                "terms": pa.array(found, pa.list_(pa.binary())),
                "n": pa.array([len(f) for f in found], pa.int64()),
            }
        )


def _poster(vocabulary, owners: int):
    """Cuts a task's documents into blocks: one row per owner and block, with the ids and lengths of its documents."""

    def run(batches):
        known = vocabulary.value
        block = (TaskContext.get().partitionId() << 32) if TaskContext.get() else 0
        ids, lengths, hits, places = [], [], [], []

        def told():
            order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] if ids[i] is not None else 0))
            rank = np.empty(len(ids), dtype=np.int64)
            rank[order] = np.arange(len(ids))
            doc = rank[np.repeat(np.arange(len(ids)), places)]
            codes, counts = np.unique(np.array(hits, dtype=np.int64) << 32 | doc, return_counts=True)
            term, doc = codes >> 32, codes & 0xFFFFFFFF
            for owner in range(owners):
                mine = term % owners == owner
                yield pa.RecordBatch.from_pydict(
                    {
                        "owner": pa.array([owner], pa.int32()),
                        "block": pa.array([block], pa.int64()),
                        "ids": pa.array([[ids[i] for i in order]], pa.list_(kind)),
                        "lengths": pa.array([np.array(lengths, dtype="<i8")[order].tobytes()]),
                        "term": pa.array([term[mine].astype("<u4").tobytes()]),
                        "doc": pa.array([doc[mine].astype("<u4").tobytes()]),
                        "tf": pa.array([counts[mine].astype("<u4").tobytes()]),
                        "docs": pa.array([len(ids)], pa.int64()),
                        "terms": pa.array([sum(lengths)], pa.int64()),
                    }
                )

        kind = pa.int64()
        for batch in batches:
            kind = batch.column("id").type
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                length, before = 0, len(hits)
                for part in terms(text):
                    length += len(part)
                    hits.extend([known[t] for t in part if t in known])
                if not length:
                    continue
                ids.append(key)
                lengths.append(length)
                places.append(len(hits) - before)
                if len(ids) >= BLOCK_DOCS or len(hits) >= BLOCK_HITS:
                    yield from told()
                    block += 1
                    ids, lengths, hits, places = [], [], [], []
        if ids:
            yield from told()

    return run


def _frequencies(size: int):
    """(``term``, ``df``): in how many of a task's documents each term is."""

    def run(batches):
        found = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for term in batch.column("term").to_pylist():
                found += np.bincount(np.frombuffer(term, dtype="<u4"), minlength=size)
        term = np.flatnonzero(found)
        yield pa.RecordBatch.from_pydict({"term": pa.array(term), "df": pa.array(found[term])})

    return run


def _round(plan, number: int, owners: int, documents: int, words: int, last: bool, top: int):
    """One round: the bundles that are at an owner take up what its terms add in one block."""

    def contributions(row):
        """Score that each posting adds, by term."""
        term, doc, tf = (np.frombuffer(row[name][0].as_py(), dtype="<u4") for name in ("term", "doc", "tf"))
        tf = tf.astype(np.int64)
        length = np.frombuffer(row["lengths"][0].as_py(), dtype="<i8")
        m = 100 - LENGTH_SHARE + LENGTH_SHARE * length * documents // words
        return term, doc, (UNIT * tf) // (1000 * tf + SATURATION * m[doc])

    def best(scores: np.ndarray) -> np.ndarray:
        """Places of the ``top`` highest scores above 0, equal ones by place."""
        place = np.flatnonzero(scores > 0)
        if place.size > top:
            least = np.partition(scores[place], place.size - top)[place.size - top]
            place = place[scores[place] >= least]
        return place[np.argsort(-scores[place], kind="stable")][:top]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        owner, block = (part.as_py() for part in key)
        weights, bundles = plan.value
        term, doc, added = contributions({name: right.column(name) for name in right.column_names})
        size = right.column("docs")[0].as_py()
        carried = {row["bundle"]: row for row in left.to_pylist()}
        out = {"bundle": [], "block": [], "cells": [], "scores": []}
        rows = {"item": [], "id": [], "score": []}
        for bundle, (items, by_owner) in bundles.items():
            if (bundle + number) % owners != owner:
                continue
            total = np.zeros((len(items), size), dtype=np.int64)
            if bundle in carried:
                cells = np.frombuffer(carried[bundle]["cells"], dtype="<u4")
                total.reshape(-1)[cells] = np.frombuffer(carried[bundle]["scores"], dtype="<i8")
            for one, asking in by_owner.get(owner, ()):
                low, high = np.searchsorted(term, (one, one + 1))
                if low < high:
                    total[np.ix_(asking, doc[low:high])] += weights[one] * added[low:high]
            if last:
                ids = right.column("ids")[0].as_py()
                for place, item in enumerate(items):
                    for found in best(total[place]):
                        rows["item"].append(item)
                        rows["id"].append(ids[found])
                        rows["score"].append(int(total[place, found]))
                continue
            cells = np.flatnonzero(total)
            if cells.size:
                out["bundle"].append(bundle)
                out["block"].append(block)
                out["cells"].append(cells.astype("<u4").tobytes())
                out["scores"].append(total.reshape(-1)[cells].tobytes())
        if last:
            kind = right.schema.field("ids").type.value_type
            kinds = pa.schema([("item", pa.int64()), ("id", kind), ("score", pa.int64())])
            return pa.table(rows, schema=kinds)
        kinds = [("bundle", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("scores", pa.binary())]
        return pa.table(out, schema=pa.schema(kinds))

    return run


def _waves(items: DataFrame) -> DataFrame:
    """``item, terms, wave``: items in waves of ``WAVE_TERMS`` terms, by a running total over the numbered items."""
    found = items.select(F.col("id").alias("item"), "text").mapInArrow(
        _item_terms, "item long, terms array<binary>, n long"
    )
    found = cut_lineage(found.filter(F.col("n") > 0), "item-terms")
    part = F.floor(F.col("item") / BUNDLE_ITEMS).alias("part")
    sums = found.groupBy(part).agg(F.sum("n").alias("n"))
    so_far = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("start"))
    within = Window.partitionBy("part").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return found.withColumn("part", part).join(starts, "part").select(
        "item", "terms", F.floor(start / WAVE_TERMS).alias("wave")
    )


def _bundles(pairs: list[tuple[int, list[bytes]]], vocabulary: dict[bytes, int], owners: int):
    """For each bundle its items, and for each owner the bundle's terms there with the items that ask for them."""
    bundles = {}
    for first in range(0, len(pairs), BUNDLE_ITEMS):
        chosen = pairs[first : first + BUNDLE_ITEMS]
        asking: dict[int, list[int]] = {}
        for place, (_, found) in enumerate(chosen):
            for term in found:
                asking.setdefault(vocabulary[term], []).append(place)
        by_owner: dict[int, list] = {}
        for term in sorted(asking):
            by_owner.setdefault(term % owners, []).append((term, np.array(asking[term])))
        bundles[len(bundles)] = ([item for item, _ in chosen], by_owner)
    return bundles


def _search(texts: DataFrame, pairs: list[tuple[int, list[bytes]]], owners: int, top: int) -> DataFrame | None:
    """``item, id, score`` of one wave: the best of every block."""
    spark = texts.sparkSession
    vocabulary = {term: number for number, term in enumerate(sorted({t for _, found in pairs for t in found}))}
    key = texts.schema["id"].dataType.simpleString()
    schema = (
        f"owner int, block long, ids array<{key}>, lengths binary, term binary, doc binary, tf binary, docs long, terms long"
    )
    known = spark.sparkContext.broadcast(vocabulary)
    path = scratch_path(spark, "postings")
    texts.mapInArrow(_poster(known, owners), schema).write.partitionBy("owner").parquet(path)
    postings = spark.read.schema(schema).parquet(path)
    documents, words = postings.filter(F.col("owner") == 0).agg(F.sum("docs"), F.sum("terms")).first()
    if not documents:
        return None
    counted = postings.select("term").mapInArrow(_frequencies(len(vocabulary)), "term long, df long")
    weights = np.zeros(len(vocabulary), dtype=np.int64)
    for term, df in counted.groupBy("term").agg(F.sum("df")).collect():
        weights[term] = math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1)))
    bundles = _bundles(pairs, vocabulary, owners)
    plan = spark.sparkContext.broadcast((weights, bundles))
    carried = spark.createDataFrame([], "bundle int, block long, cells binary, scores binary")
    for number in range(owners):
        last = number == owners - 1
        visited = sorted({(bundle + number) % owners for bundle in bundles})
        here = postings.filter(F.col("owner").isin(visited)).select(
            "owner", "block", "lengths", "term", "doc", "tf", "docs", *(["ids"] if last else [])
        )
        at = ((F.col("bundle") + number) % owners).cast("int")
        travelling = carried.withColumn("owner", at).groupBy("owner", "block")
        kept = f"item long, id {key}, score long" if last else "bundle int, block long, cells binary, scores binary"
        step = _round(plan, number, owners, documents, words, last, top)
        carried = travelling.cogroup(here.groupBy("owner", "block")).applyInArrow(step, kept)
    return carried


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    top: int = TOP,
    owners: int = OWNERS,
) -> DataFrame:
    """``item_id, rank, id, score``: each item's ``top`` documents, highest score first, equal scores by id.

    With N documents that have a term, L terms in them with repeats, n terms in a document and df documents with a term, a
    term weighs ``floor(1000 * ln((2N + 2) / (2 df + 1)))``, and one that occurs tf times adds its weight times
    ``10^9 tf div (1000 tf + 8 m)``, where ``m = 10 + (90 n N) div L``.
    """
    spark = docs.sparkSession
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col), F.lit("")).alias("text"))
    asked, _ = numbered(
        items.select(col(item_col).alias("item_id"), F.coalesce(col(item_text_col), F.lit("")).alias("text")), "items"
    )
    waves = cut_lineage(_waves(asked), "waves")
    found = []
    for wave in range((waves.agg(F.max("wave")).first()[0] or 0) + 1):
        chosen = waves.filter(F.col("wave") == wave).orderBy("item").collect()
        if chosen:
            pairs = [(row["item"], [bytes(t) for t in row["terms"]]) for row in chosen]
            part = _search(texts, pairs, owners, top)
            if part is not None:
                found.append(part)
    if not found:
        kind = docs.schema[id_col].dataType.simpleString()
        item = items.schema[item_col].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {item}, rank int, id {kind}, score long")
    best = _best(reduce(DataFrame.unionByName, found), top)
    names = asked.select(F.col("id").alias("item"), "item_id")
    return best.join(names, "item").select("item_id", F.col("rank").cast("int"), "id", "score")


def _best(scored: DataFrame, top: int) -> DataFrame:
    """The first ``top`` of each item, found in groups of it first, so no task orders the best of all blocks."""
    group = F.pmod(F.xxhash64("id"), F.lit(GROUPS))
    for keys in (["item", "_group"], ["item"]):
        scored = scored.withColumn("_group", group)
        order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"))
        scored = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return scored.drop("_group")
