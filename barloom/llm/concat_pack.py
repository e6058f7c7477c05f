"""Concatenate-and-cut packing: global token offsets by prefix sums, then fixed windows."""

from __future__ import annotations

from array import array
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import col, partition_offsets, scratch_path
from barloom.llm.trie_bpe import chunks, loaded, share_vocabulary

WINDOW = 4096


def tokenise_table(
    docs: DataFrame, vocabulary: str, eos: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A written table of ``id``, ``ids`` (unsigned 32-bit, little-endian, ``eos`` last), ``n``, ``part`` and
    ``start``: the tokens before the row in its partition.

    Each task numbers its own rows, and what later steps read is the committed output, so a task that ran
    twice leaves one numbering.
    """
    spark = docs.sparkSession
    shared = share_vocabulary(spark, vocabulary)
    end = array("I", [eos]).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, total = loaded(shared), TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, texts in chunks(batch.column(1).to_pylist()):
                encoded = [ids + end for ids in bpe.encode_chunk(texts)]
                counts = [len(ids) // 4 for ids in encoded]
                starts = []
                for n in counts:
                    starts.append(total)
                    total += n
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(texts)),
                        pa.array(encoded, pa.binary()),
                        pa.array(counts, pa.int64()),
                        pa.array([part] * len(texts), pa.int32()),
                        pa.array(starts, pa.int64()),
                    ],
                    ["id", "ids", "n", "part", "start"],
                )

    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    rows = source.mapInArrow(encode, f"id {kind}, ids binary, n long, part int, start long")
    path = scratch_path(spark, "tokens")
    rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def concat_and_cut(
    docs: DataFrame,
    vocabulary: str,
    eos: int = 2,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece of a document: ``id``, ``start``, ``length``, ``ids``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``opens`` and ``closes``.

    All documents form one stream in the order of their partitions. The first pass tokenises and adds up
    each partition; prefix sums over those totals give every document its place in the stream. The second
    pass cuts the stream into windows: a document that crosses a border leaves a piece on either side, and
    ``opens`` and ``closes`` tell whether a piece has its document's first and last token. Only the stream's
    last window is not full. Nothing is shuffled but one total per partition.

    A null or empty text is a document of the end token alone. Repeated rows and null ids are documents of
    their own; other columns are left out; an empty table gives no pieces.
    """
    tokens = tokenise_table(docs, vocabulary, eos, id_col, text_col)
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    bases = partition_offsets(totals, "part", "total")
    placed = tokens.join(F.broadcast(bases), "part").withColumn("at", F.col("base") + F.col("start"))
    size = F.lit(window).cast("long")
    numbers = F.sequence(
        F.floor(F.col("at") / size).cast("long"), F.floor((F.col("at") + F.col("n") - 1) / size).cast("long")
    )

    def piece(number):
        low = F.greatest(F.col("at"), number * size)
        high = F.least(F.col("at") + F.col("n"), (number + 1) * size)
        start = low - F.col("at")
        ids = F.substring(F.col("ids"), (start * 4 + 1).cast("int"), ((high - low) * 4).cast("int"))
        return F.struct(
            number.alias("sequence_id"),
            (low - number * size).alias("offset"),
            start.alias("start"),
            (high - low).alias("length"),
            ids.alias("ids"),
        )

    cut = placed.select("id", F.col("n").alias("doc_tokens"), F.explode(F.transform(numbers, piece)).alias("p"))
    return cut.select(
        "id",
        "p.start",
        "p.length",
        "p.ids",
        "doc_tokens",
        "p.sequence_id",
        "p.offset",
        (F.col("p.start") == 0).alias("opens"),
        (F.col("p.start") + F.col("p.length") == F.col("doc_tokens")).alias("closes"),
    )


def sequences(pieces: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """The windows themselves: ``sequence_id``, ``ids`` and the ``n_pieces`` joined.

    A window has at most as many pieces as tokens, so a group is bounded by the window.
    """
    joined = F.sort_array(F.collect_list(F.struct("offset", "ids", *carry)))
    grouped = pieces.groupBy("sequence_id").agg(joined.alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    return grouped.select("sequence_id", ids.alias("ids"), F.size("pieces").alias("n_pieces"))
