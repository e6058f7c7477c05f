"""Nearest neighbours through shifted space-filling curves: Hilbert orders of projected vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import col, cut_lineage

#: Rows that the projections and grids are fitted on.
FIT_ROWS = 4_096
#: Queries by whose true neighbours the window is measured.
PROBES = 192
CURVES = 4
#: Projected dimensions and bits of each: together a key of at most 63 bits.
AXES = 8
BITS = 7
#: Share of the probes' true neighbours that the windows must reach.
RECALL = 0.97
#: Rows of one block of a curve; a query visits whole blocks.
BLOCK = 4_096
#: Queries that meet a block together.
QUERY_BATCH = 512


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along the Hilbert curve through a grid of ``2**bits`` cells a side, one row per point.

    From the top bit down, each axis whose bit is set flips the first axis below that bit, and otherwise
    swaps those lower bits with it; that undoes the turns of the curve. What remains is a Gray code.
    """
    x = cells.T.astype(np.uint64).copy()
    axes = len(x)
    for level in range(bits - 1, 0, -1):
        top = np.uint64(1 << level)
        below = top - np.uint64(1)
        for axis in range(axes):
            flips = (x[axis] & top) != 0
            swapped = np.where(flips, 0, (x[0] ^ x[axis]) & below).astype(np.uint64)
            x[0] = np.where(flips, x[0] ^ below, x[0] ^ swapped)
            x[axis] ^= swapped if axis else np.uint64(0)
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    turned = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> np.uint64(level)) & np.uint64(1), np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turned
    keys = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, -1, -1):
        for axis in range(axes):
            keys = (keys << np.uint64(1)) | ((x[axis] >> np.uint64(level)) & np.uint64(1))
    return keys.astype(np.int64)


@dataclass(frozen=True)
class Curves:
    """For each curve: directions to project on, and where its shifted grid begins and how wide it is."""

    directions: np.ndarray
    low: np.ndarray
    width: np.ndarray

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(curve, row) keys of unit vectors."""
        found = []
        for turn, low, width in zip(self.directions, self.low, self.width):
            cells = np.floor((unit @ turn - low) / width * (1 << BITS))
            found.append(hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS))
        return np.array(found)


def fit_curves(sample: np.ndarray, size: int) -> Curves:
    """Curves over the sample's strongest directions, each turned at random and shifted by a part of a cell
    of the coarsest grid, so that points parted by one curve's borders lie together on another."""
    rng = np.random.default_rng(11)
    sample = sample if len(sample) else np.zeros((1, size))
    centred = sample - sample.mean(axis=0)
    strength, basis = np.linalg.eigh(centred.T @ centred)
    basis = basis[:, np.argsort(-strength)]
    axes = min(AXES, size)
    directions, low, width = [], [], []
    for curve in range(CURVES):
        if size > axes:
            mixed = np.linalg.qr(rng.normal(size=(size, size)))[0][:, :axes]
            used = basis @ mixed
        else:
            used = basis @ np.linalg.qr(rng.normal(size=(size, size)))[0]
        along = sample @ used
        spread = np.maximum(along.max(axis=0) - along.min(axis=0), 1e-9)
        shift = spread * (curve / CURVES) / 2
        directions.append(used)
        low.append(along.min(axis=0) - spread / 4 - shift / 2)
        width.append(spread * 1.75)
    return Curves(np.array(directions), np.array(low), np.array(width))


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column without nulls, whose lists are of one length, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def nearest(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> list:
    """For each query its ``k`` nearest of ``rows`` but itself: (ids, cosines), nearest first, ties to the
    smaller id. A matrix product finds who can be among them; their cosines are then summed one by one, so
    that equal vectors get equal cosines wherever they are met."""
    q_norm = np.sqrt((queries * queries).sum(axis=1))
    norm = np.sqrt((rows * rows).sum(axis=1))
    rough = (queries / q_norm[:, None]) @ (rows / norm[:, None]).T
    found = []
    for i, own in enumerate(query_ids):
        line = rough[i]
        line[ids == own] = -np.inf
        at = len(line) - min(k, len(line))
        near = np.flatnonzero(line >= np.partition(line, at)[at] - 1e-9)
        near = near[line[near] > -np.inf]
        exact = (rows[near] * queries[i]).sum(axis=1) / (norm[near] * q_norm[i])
        best = np.lexsort((ids[near], -exact))[:k]
        found.append((ids[near][best], exact[best]))
    return found


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``id`` and ``vector`` (array of double) of rows with an id and a finite vector that is not zero."""
    cast = vectors.select(col(id_col).alias("id"), col(vector_col).cast("array<double>").alias("vector"))
    infinite = F.lit(float("inf"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < infinite))
    length = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    return cast.filter(F.col("id").isNotNull() & F.col("vector").isNotNull()).filter(finite).filter(
        (length > 0) & (length < infinite)
    )


@dataclass(frozen=True)
class HilbertIndex:
    """Rows in the order of each curve, written to the shared scratch folder.

    ``places`` has ``curve``, ``rank``, ``id``, ``vector`` and ``query``: the rows that are searched, and once
    more, marked, those that ask.
    """

    places: DataFrame
    filed: DataFrame
    size: int


def build_index(rows: DataFrame, asking: DataFrame, k: int) -> HilbertIndex:
    """File ``rows`` (``id``, ``vector``) and the queries ``asking`` along every curve.

    Of equal vectors only the ``k + 1`` smallest ids are filed: the others lose every tie and can be in no
    answer. Projections and grids are fitted on FIT_ROWS rows, whose commonest vector length is searched.
    """
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id").select("vector").limit(FIT_ROWS).collect()
    sizes = [len(r[0]) for r in sample]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 1
    fit = np.array([r[0] for r in sample if len(r[0]) == size], np.float64).reshape(-1, size)
    shared = spark.sparkContext.broadcast(fit_curves(_unit(fit), size))
    equal = Window.partitionBy("vector").orderBy("id")
    filed = (
        rows.filter(F.size("vector") == size)
        .withColumn("n", F.row_number().over(equal))
        .filter(F.col("n") <= k + 1)
        .drop("n")
    )
    both = filed.withColumn("query", F.lit(False)).unionByName(
        asking.filter(F.size("vector") == size).withColumn("query", F.lit(True))
    )

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = shared.value.keys(_unit(_matrix(batch.column("vector"))))
                for curve, of_curve in enumerate(keys):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([curve] * batch.num_rows, pa.int32()), pa.array(of_curve), *batch.columns],
                        ["curve", "key", *batch.schema.names],
                    )

    kind = both.schema["id"].dataType.simpleString()
    layout = f"curve int, key long, id {kind}, vector array<double>, query boolean"
    order = ["curve", "key", "id", "query"]
    dealt = both.mapInArrow(key, layout).repartitionByRange(*order).sortWithinPartitions(*order)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, reached = TaskContext.get().partitionId(), Counter()
        for batch in batches:
            locals_ = []
            for curve in batch.column("curve").to_pylist():
                locals_.append(reached[curve])
                reached[curve] += 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(locals_, pa.int64())],
                [*batch.schema.names, "part", "local"],
            )

    numbered = cut_lineage(dealt.mapInArrow(number, f"{layout}, part int, local long"), "hilbert-places")
    totals = numbered.groupBy("curve", "part").count().collect()
    bases, reached = [], Counter()
    for curve, part, n in sorted(tuple(r) for r in totals):
        bases.append((curve, part, reached[curve]))
        reached[curve] += n
    base = spark.createDataFrame(bases, "curve int, part int, base long")
    places = numbered.join(F.broadcast(base), ["curve", "part"]).select(
        "curve", (F.col("base") + F.col("local")).alias("rank"), "id", "vector", "query"
    )
    return HilbertIndex(places, filed, size)


def measured_window(index: HilbertIndex, asking: DataFrame, k: int, recall: float) -> int:
    """Ranks to look at on either side so that ``recall`` of true neighbours lie within them on some curve.

    PROBES queries are held against all filed rows in blocks, which is linear in the rows. Only their
    ``k`` neighbours each, and the places of those, reach the driver.
    """
    spark = asking.sparkSession
    probes = asking.filter(F.size("vector") == index.size).orderBy(F.xxhash64("id"), "id").limit(PROBES).collect()
    if not probes:
        return BLOCK
    shared = spark.sparkContext.broadcast(
        (np.array([r["id"] for r in probes]), np.array([r["vector"] for r in probes], np.float64))
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, queries = shared.value
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("id").to_numpy(zero_copy_only=False)
                found = nearest(queries, own, _matrix(batch.column("vector")), ids, k)
                yield _answers(own, found, batch.schema.field("id").type)

    kind = index.filed.schema["id"].dataType.simpleString()
    partial = index.filed.mapInArrow(search, f"query_id {kind}, found array<struct<id:{kind},score:double>>")
    pairs = _merge(partial, k).select("query_id", "id").collect()
    if not pairs:
        return BLOCK
    named = spark.createDataFrame(sorted({(x,) for pair in pairs for x in pair}), f"id {kind}")
    placed = index.places.join(F.broadcast(named), "id").select("id", "query", "curve", "rank").collect()
    rank = {(r["id"], r["query"], r["curve"]): r["rank"] for r in placed}
    apart = [
        min(abs(rank[q, True, curve] - rank[i, False, curve]) for curve in range(CURVES)) for q, i in pairs
    ]
    return int(np.quantile(apart, recall, method="higher")) + 1


def _answers(own: np.ndarray, found: list, kind: pa.DataType) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum([len(ids) for ids, _ in found])]).astype(np.int32)
    flat = pa.StructArray.from_arrays(
        [
            pa.array(np.concatenate([ids for ids, _ in found]), kind),
            pa.array(np.concatenate([scores for _, scores in found]), pa.float64()),
        ],
        ["id", "score"],
    )
    return pa.RecordBatch.from_arrays(
        [pa.array(own, kind), pa.ListArray.from_arrays(pa.array(ends), flat)], ["query_id", "found"]
    )


def _merge(partial: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of all that was found for a query, whichever curves and blocks it came from."""
    pairs = partial.select("query_id", F.inline("found")).distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_index(index: HilbertIndex, n_queries: int, window: int, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``id``, ``score``: every query against the blocks of each curve that its
    window touches, merged and reranked by cosine."""
    block = F.floor(F.col("rank") / BLOCK).cast("long")
    pair = F.struct("id", "vector")
    filed = (
        index.places.filter(~F.col("query"))
        .groupBy("curve", block.alias("block"))
        .agg(F.collect_list(pair).alias("filed"))
    )
    low, high = (F.floor((F.col("rank") + by) / BLOCK).cast("long") for by in (-window, window))
    batch = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n_queries // QUERY_BATCH))))
    visits = (
        index.places.filter("query")
        .withColumn("block", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))
        .groupBy("curve", "block", batch.alias("batch"))
        .agg(F.collect_list(pair).alias("asking"))
    )
    met = visits.join(filed, ["curve", "block"]).select("asking", "filed")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                asking, rows = (batch.column(name)[i].values for name in ("asking", "filed"))
                own, ids = (x.field("id").to_numpy(zero_copy_only=False) for x in (asking, rows))
                queries, against = (_matrix(x.field("vector")) for x in (asking, rows))
                yield _answers(own, nearest(queries, own, against, ids, k), rows.field("id").type)

    kind = index.places.schema["id"].dataType.simpleString()
    return _merge(met.mapInArrow(search, f"query_id {kind}, found array<struct<id:{kind},score:double>>"), k)


def nearest_neighbours(
    vectors: DataFrame,
    asks: Column,
    k: int = 5,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``id`` and ``score``: for each row that ``asks``, its ``k`` nearest
    others by cosine in double precision, nearest first, ties to the smaller id.

    Vectors are projected on several sets of directions, each a grid shifted against the others with a
    Hilbert curve through it. All rows are ordered along every curve; a query meets the rows around its own place on each, and
    what it meets is reranked by the original vectors. How far around is measured, not assumed: the window is the one that reaches
    ``recall`` of the true neighbours of PROBES queries. Clustered vectors need short windows; vectors without any structure need
    windows in proportion to the table, whatever the curve.

    Ids are integers and unique; of repeated ids each row counts. Rows with a null id, a null or zero vector, null, infinite
    or NaN components, or a length other than the commonest take no part; queries among them give no rows. Other columns
    are left out. With fewer than ``k`` candidates all are returned.
    """
    rows = usable(vectors, id_col, vector_col)
    asking = cut_lineage(usable(vectors.filter(asks), id_col, vector_col), "queries")
    index = build_index(rows, asking, k)
    window = measured_window(index, asking, k, recall)
    return search_index(index, asking.count(), window, k)
