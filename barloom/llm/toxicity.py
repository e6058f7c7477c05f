"""Toxicity by averaged subword embeddings and a linear softmax, trained together in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import col, cut_lineage, label_fold
from barloom.llm.labelled import training_rows

#: Labelled documents that a fit uses, of either label.
PER_CLASS = 2_500
#: Bytes of their bags that reach the driver, half of them for either label.
FIT_BYTES = 96 << 20
BUCKETS = 1 << 16
SIZES = (4, 5, 6)
DIMENSIONS = 8
EPOCHS = 80
RATE = 0.3
DECAY = 0.003
#: Distinct n-grams of documents that one step of a fit handles at a time.
STRIPE = 2_000_000


def subword_buckets(text: str) -> np.ndarray:
    """A bucket for each character n-gram of each word, the word's borders included, words lower-cased.

    A misspelt word shares most of its n-grams, and so its vectors, with the word it hides.
    """
    codes = np.frombuffer(" ".join(["", *text.lower().split(), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    border = codes == 32
    found = []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            continue
        mixed = np.full(n, size, np.uint32)
        whole = np.ones(n, bool)
        for i in range(size):
            mixed *= np.uint32(0x01000193)
            mixed ^= codes[i : i + n]
            if 0 < i < size - 1:
                whole &= ~border[i : i + n]
        mixed = mixed[whole]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        found.append(mixed >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


@dataclass(frozen=True)
class SubwordModel:
    """Embeddings (bucket, dimension), softmax weights (dimension, 2) and bias (2)."""

    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def logits_by_bucket(self) -> np.ndarray:
        """What one n-gram adds to the toxic side's lead: the average of embeddings goes through a linear
        layer, so the layer may as well come first."""
        lead = self.embeddings @ self.weights
        return lead[:, 1] - lead[:, 0]


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, prior: float) -> SubwordModel:
    """Fit embeddings and softmax jointly on the cross-entropy of whole documents.

    ``bags`` has each document's buckets and their shares of its n-grams. Steps are Adam's with one scale
    for a whole matrix, so rare n-grams do not move as far as telling ones. Both classes weigh the same while
    fitting; the bias then moves to the odds of ``prior``, the share of label 1 among all that are labelled.
    """
    rng = np.random.default_rng(7)
    embeddings = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    weights = rng.normal(0, 0.1, (DIMENSIONS, 2))
    bias = np.zeros(2)
    both = len(set(labels.tolist())) == 2
    if both:
        target = np.eye(2)[labels]
        each = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
        parameters = [embeddings, weights, bias]
        moments = [(np.zeros_like(p), np.zeros(())) for p in parameters]
        stripes = _stripes(bags)
        for step in range(1, EPOCHS + 1):
            lead, pulled, off_sum = embeddings @ weights, np.zeros((BUCKETS, 2)), np.zeros(2)
            # the average of embeddings is linear: the layer may come before it, on the way down and back
            for docs, rows, buckets, shares in stripes:
                logits = np.stack([np.bincount(rows, shares * lead[buckets, c]) for c in (0, 1)], axis=1)
                off = (_softmax(logits + bias) - target[docs]) * each[docs, None]
                for c in (0, 1):
                    pulled[:, c] += np.bincount(buckets, shares * off[rows, c], BUCKETS)
                off_sum += off.sum(axis=0)
            gradients = [pulled @ weights.T, embeddings.T @ pulled, off_sum]
            for p, g, (m, v) in zip(parameters, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.01 * ((g * g).mean() - v)
                p *= 1 - (RATE * DECAY if p is not bias else 0)
                p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-12)
    odds = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    return SubwordModel(embeddings, weights if both else weights * 0, bias + [0.0, odds])


def _stripes(bags: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents: which, and for each n-gram its document within the run, bucket and share. Every
    document has an entry, so that each run has a logit for each of its documents."""
    stripes, start, size = [], 0, 0
    for i, (buckets, _) in enumerate(bags):
        size += len(buckets)
        if size >= STRIPE or i + 1 == len(bags):
            run = [(b, s) if len(b) else (np.zeros(1, b.dtype), np.zeros(1, s.dtype)) for b, s in bags[start : i + 1]]
            rows = np.repeat(np.arange(len(run), dtype=np.int32), [len(b) for b, _ in run])
            found = (np.concatenate([part[k] for part in run]) for k in (0, 1))
            stripes.append((slice(start, i + 1), rows, *found))
            start, size = i + 1, 0
    return stripes


def _softmax(logits: np.ndarray) -> np.ndarray:
    raised = np.exp(logits - logits.max(axis=1, keepdims=True))
    return raised / raised.sum(axis=1, keepdims=True)


def bag_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct buckets of a text and their shares."""
    counts = np.bincount(subword_buckets(text), minlength=1)
    buckets = np.flatnonzero(counts)
    return buckets.astype(np.uint16), (counts[buckets] / max(1, counts.sum())).astype(np.float32)


def training_bags(rows: DataFrame, budget: int) -> DataFrame:
    """``id``, ``label``, ``buckets`` and ``shares`` of the documents in ``rows`` that a fit uses.

    An id that several documents have counts once, with its smallest text. The whole texts become bags on the
    executors, which are written. Of either label those documents stay whose bags, in the order of a hash of the
    id, fit into half of ``budget`` bytes. Only sizes are sorted, at most PER_CLASS of either label.
    """
    once = rows.groupBy("id", "label").agg(F.min("text").alias("text"))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bag_of(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    batch.column("label"),
                    pa.array([b.tobytes() for b, _ in found], pa.binary()),
                    pa.array([s.tobytes() for _, s in found], pa.binary()),
                    pa.array([b.nbytes + s.nbytes for b, s in found], pa.int64()),
                ],
                ["id", "label", "buckets", "shares", "size"],
            )

    kind = rows.schema["id"].dataType.simpleString()
    layout = f"id {kind}, label int, buckets binary, shares binary, size long"
    written = cut_lineage(once.select("id", "text", "label").mapInArrow(bags, layout), "bags")
    so_far = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0)
    sizes = written.select("id", "label", F.sum("size").over(so_far).alias("reached"))
    chosen = sizes.filter(F.col("reached") <= budget // 2).select("id")
    return written.join(F.broadcast(chosen), "id").select("id", "label", "buckets", "shares")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> SubwordModel:
    """Fit on at most ``2 * PER_CLASS`` labelled documents outside fold 0, as far as their bags fit into FIT_BYTES;
    only these bags reach the driver. However many documents there are and however long, they take no more."""
    rows = training_rows(docs, labels, "toxic", PER_CLASS, id_col, text_col)
    drawn = sorted(training_bags(rows, FIT_BYTES).collect(), key=lambda r: r[0])
    known = labels.filter(col("toxic").isin(0, 1) & (label_fold(col(id_col)) != 0))
    prior = known.agg(F.avg(col("toxic").cast("double"))).first()[0]
    found = [(np.frombuffer(r[2], np.uint16), np.frombuffer(r[3], np.float32)) for r in drawn]
    return train(found, np.array([r[1] for r in drawn], np.int64), 0.5 if prior is None else prior)


def score_toxicity(
    docs: DataFrame, model: SubwordModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id`` and ``score`` (0 to 1, higher: likelier toxic) of each row.

    The score is the softmax of the averaged embeddings of all n-grams of the whole text, from the text alone.
    A null or empty text has no n-grams and gets the bias alone. Repeated rows and null ids give a row each;
    other columns are left out. Nothing is shuffled; the model is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.logits_by_bucket(), model.bias[1] - model.bias[0]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, bias = shared.value
        for batch in batches:
            scores = []
            for text in batch.column(1):
                buckets = subword_buckets(text.as_py() or "")
                logit = bias + (lead[buckets].mean() if len(buckets) else 0.0)
                scores.append(1 / (1 + np.exp(-np.clip(logit, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["id", "score"])

    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(score, f"id {kind}, score double")
