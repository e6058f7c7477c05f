"""Best-fit-decreasing packing of token ids into fixed rows, with exact capacity search."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import col, partition_offsets, scratch_path
from barloom.llm.trie_bpe import chunks, loaded, share_vocabulary

ROW = 4096
#: A task packs about so many rows' worth of tokens at a time; its memory follows this, not its input.
BLOCK_ROWS = 1024
#: Of the rows emptier than this the REST_ROWS emptiest give their pieces back: to the next block, or, from a task's last
#: block, to the common rest.
SETTLED, SETTLED_LAST = 0.95, 0.995
REST_ROWS = 64
#: Parts from this number on hold the rows packed from the common rest.
REST_PART = 1 << 30

Piece = tuple[int, int, bytes]  # document number within the task, first token, ids


class CapacityTree:
    """Counts of open rows by free space, with the smallest sufficient space found in log steps."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, space: int, change: int) -> None:
        node = space + self.size
        while node:
            self.count[node] += change
            node >>= 1

    def best(self, need: int) -> int | None:
        """The smallest space of at least ``need`` that some open row has."""
        node = need + self.size
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                while node < self.size:
                    node *= 2
                    if not self.count[node]:
                        node += 1
                return node - self.size
            node >>= 1
        return None


def best_fit_decreasing(lengths: list[int], row: int) -> list[list[int]]:
    """Rows as lists of positions in ``lengths``: each piece, longest first, goes where it fits tightest."""
    tree = CapacityTree(row)
    open_rows: dict[int, list[int]] = {}
    rows: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        space = tree.best(lengths[i])
        if space is None:
            number, space = len(rows), row
            rows.append([])
        else:
            number = open_rows[space].pop()
            tree.add(space, -1)
        rows[number].append(i)
        left = space - lengths[i]
        if left:
            open_rows.setdefault(left, []).append(number)
            tree.add(left, 1)
    return rows


def pack_best_fit(
    docs: DataFrame,
    vocabulary: str,
    eos: int = 2,
    pad: int = 0,
    row: int = ROW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """A written table with one packed row each: ``sequence_id``, ``ids`` (``row`` unsigned 32-bit
    little-endian integers, padded with ``pad``), ``n_tokens``, ``cu_seqlens`` (0 and each segment's end),
    ``position_resets`` (where position ids start again at 0), ``doc_ids``, ``starts`` (each segment's first token in its document) and ``doc_tokens``.

    A document longer than a row is split: whole rows of its own, then a rest that is packed like any other
    document, so no token is lost and each is in one segment. Best-fit-decreasing runs in every task on
    blocks of BLOCK_ROWS rows' worth of tokens. At the end of a block the REST_ROWS emptiest rows, if they are not well
    filled, are dissolved into the next block, so every block takes in almost as many new tokens as it holds. Those of a
    task's last block go to a common rest, which is dealt into blocks of the same size and packed once more.
    Gapless ``sequence_id`` come from prefix sums over the rows each partition has written.

    A null or empty text is a document of the end token alone. Repeated rows and null ids are documents of
    their own; other columns are left out; an empty table gives no rows.
    """
    spark = docs.sparkSession
    shared = share_vocabulary(spark, vocabulary)
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    end, filler = array("I", [eos]).tobytes(), array("I", [pad]).tobytes()

    def emit(rows: list[list[Piece]], known: dict[int, tuple[object, int]], id_type, part: int, first: int, rest: bool):
        cuts, ids, used = [], [], []
        for pieces in rows:
            bounds = [0]
            for piece in pieces:
                bounds.append(bounds[-1] + len(piece[2]) // 4)
            cuts.append(bounds)
            used.append(bounds[-1])
            ids.append(b"".join(p[2] for p in pieces) + filler * (row - bounds[-1]))
        columns = [
            pa.array([part] * len(rows), pa.int32()),
            pa.array(range(first, first + len(rows)), pa.int64()),
            pa.array([rest] * len(rows), pa.bool_()),
            pa.array(ids if rest else [None] * len(rows), pa.binary()),
            pa.array([None] * len(rows) if rest else ids, pa.binary()),
            pa.array(used, pa.int32()),
            pa.array(cuts, pa.list_(pa.int32())),
            pa.array([bounds[:-1] for bounds in cuts], pa.list_(pa.int32())),
            pa.array([[known[p[0]][0] for p in pieces] for pieces in rows], pa.list_(id_type)),
            pa.array([[p[1] for p in pieces] for pieces in rows], pa.list_(pa.int64())),
            pa.array([[known[p[0]][1] for p in pieces] for pieces in rows], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.fieldNames())

    def packed_rows(pieces: list[Piece]) -> list[list[Piece]]:
        """Rows of pieces, the emptiest first."""
        found = best_fit_decreasing([len(p[2]) // 4 for p in pieces], row)
        return sorted(([pieces[i] for i in places] for places in found), key=filled)

    def filled(pieces: list[Piece]) -> int:
        return sum(len(p[2]) for p in pieces) // 4

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = loaded(shared), TaskContext.get().partitionId()
        waiting: list[Piece] = []
        known: dict[int, tuple[object, int]] = {}
        number, tokens, written, id_type = 0, 0, 0, pa.int64()

        def block(last: bool):
            nonlocal waiting, tokens, written, known
            rows = packed_rows(waiting)
            least = (SETTLED_LAST if last else SETTLED) * row
            poor = sum(filled(pieces) < least for pieces in rows[:REST_ROWS])
            rest, done = rows[:poor], rows[poor:]
            for i in range(0, len(done), 128):
                yield emit(done[i : i + 128], known, id_type, part, written + i, False)
            written += len(done)
            if last and rest:
                yield emit(rest, known, id_type, part, 0, True)
            waiting = [p for pieces in rest for p in pieces]
            tokens = sum(map(filled, rest))
            known = {p[0]: known[p[0]] for p in waiting}

        for batch in batches:
            id_type = batch.schema.field(0).type
            names = batch.column(0).to_pylist()
            for first, texts in chunks(batch.column(1).to_pylist()):
                for name, ids in zip(names[first:], bpe.encode_chunk(texts)):
                    ids += end
                    known[number] = (name, len(ids) // 4)
                    for start in range(0, len(ids), 4 * row):
                        waiting.append((number, start // 4, ids[start : start + 4 * row]))
                    number += 1
                    tokens += len(ids) // 4
                    if tokens >= BLOCK_ROWS * row:
                        yield from block(False)
        if waiting:
            yield from block(True)

    def pack_rest(pieces: pa.Table) -> pa.Table:
        group = pieces.column("group")[0].as_py()
        names, lengths = pieces.column("id"), pieces.column("doc_tokens").to_pylist()
        known = dict(enumerate(zip(names.to_pylist(), lengths)))
        each = zip(known, pieces.column("start").to_pylist(), pieces.column("ids").to_pylist())
        rows = packed_rows(list(each))
        return pa.Table.from_batches([emit(rows, known, names.type, REST_PART + group, 0, False)])

    layout = (
        "part int, local long, rest boolean, rest_ids binary, ids binary, n_tokens int, cu_seqlens array<int>, "
        f"position_resets array<int>, doc_ids array<{kind}>, starts array<long>, doc_tokens array<long>"
    )
    schema = spark.createDataFrame([], layout).schema
    path = scratch_path(spark, "packed")

    def write(rows: DataFrame, mode: str) -> DataFrame:
        rows.write.mode(mode).option("compression", "zstd").parquet(path)
        return spark.read.schema(schema).parquet(path)

    packed = write(source.mapInArrow(pack, schema), "errorifexists")
    left = packed.filter("rest")
    tokens = left.agg(F.sum("n_tokens")).first()[0] or 0
    if tokens:
        groups = 1 + tokens // (BLOCK_ROWS * row)
        # ids of the rest have a column of their own, so that reading them leaves all others unread
        pieces = segments(left.withColumn("ids", F.col("rest_ids")).withColumn("sequence_id", F.col("local")))
        group = F.pmod(F.xxhash64("id", "start", "doc_tokens", "sequence_id", "offset"), F.lit(groups)).cast("int")
        pieces = pieces.withColumn("group", group).select("group", "id", "start", "doc_tokens", "ids")
        packed = write(pieces.groupBy("group").applyInArrow(pack_rest, schema), "append")
    packed = packed.filter(~F.col("rest")).drop("rest", "rest_ids")
    totals = packed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    bases = partition_offsets(totals, "part", "rows")
    numbered = packed.join(F.broadcast(bases), "part").withColumn("sequence_id", F.col("base") + F.col("local"))
    return numbered.select("sequence_id", *packed.columns[2:])


def segments(packed: DataFrame) -> DataFrame:
    """One row per segment of the packed rows, its ``ids`` cut out of the matrix."""

    def segment(doc_id: Column, i: Column) -> Column:
        offset = F.element_at("cu_seqlens", (i + 1).cast("int"))
        length = F.element_at("cu_seqlens", (i + 2).cast("int")) - offset
        return F.struct(
            doc_id.alias("id"),
            F.element_at("starts", (i + 1).cast("int")).alias("start"),
            length.cast("long").alias("length"),
            offset.cast("long").alias("offset"),
            F.element_at("doc_tokens", (i + 1).cast("int")).alias("doc_tokens"),
            F.substring("ids", offset * 4 + 1, length * 4).alias("ids"),
        )

    return packed.select("sequence_id", F.explode(F.transform("doc_ids", segment)).alias("s")).select(
        "sequence_id", "s.*"
    )


def position_ids(packed: DataFrame) -> DataFrame:
    """``sequence_id`` and ``positions``: 0, 1, ... anew from each reset."""
    lengths = F.transform(
        "position_resets",
        lambda at, i: F.element_at("cu_seqlens", (i + 2).cast("int")) - at,
    )
    runs = F.transform(lengths, lambda n: F.sequence(F.lit(0), n - 1))
    return packed.select("sequence_id", F.flatten(runs).alias("positions"))
