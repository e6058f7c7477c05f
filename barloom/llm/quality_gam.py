"""Document quality by a generalised additive model with pairwise terms, read from lookup tables."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import col, label_fold
from barloom.llm.labelled import training_rows

#: Labelled documents that a fit uses, of either label.
PER_CLASS = 10_000
BINS = 32
PAIR_BINS = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 10
RATE = 0.1

FEATURES = [
    "log_words", "word_length", "letters", "capitals", "digits", "symbols", "distinct_words",
    "top_word", "repeats", "ended_words", "marked_words", "line_words", "distinct_lines", "distinct_pairs",
]


def features(text: str) -> list[float]:
    """Statistics of one whole text, in the order of FEATURES; an empty text has zeros."""
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    joined = "".join(words)
    counts = Counter(words)
    kinds = Counter(joined)
    letters = sum(k for c, k in kinds.items() if c.isalpha())
    upper = sum(k for c, k in kinds.items() if c.isupper())
    digits = sum(k for c, k in kinds.items() if c.isdigit())
    lines = [line for line in text.split("\n") if line]
    clean = sum(k for w, k in counts.items() if w.isalpha())
    ended = sum(k for w, k in counts.items() if w[-1] in ".,;:!?" and w[:-1].isalpha())
    return [
        math.log1p(n),
        len(joined) / n,
        letters / len(joined),
        upper / max(1, letters),
        digits / len(joined),
        (len(joined) - letters - digits) / len(joined),
        len(counts) / n,
        max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n,
        ended / n,
        1 - (clean + ended) / n,
        n / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
        len(set(zip(words, words[1:]))) / n,
    ]


@dataclass(frozen=True)
class AdditiveModel:
    """``edges`` cut each feature into bins; a score is ``base`` plus one entry of each table."""

    base: float
    edges: list[np.ndarray]
    coarse: list[np.ndarray]
    tables: np.ndarray
    pairs: list[tuple[int, int]]
    pair_tables: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Vectorised: bin every feature once, then add table entries."""
        logit = np.full(len(x), self.base)
        fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]
        for j, bins in enumerate(fine):
            logit += self.tables[j][bins]
        rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.coarse)]
        for table, (j, k) in zip(self.pair_tables, self.pairs):
            logit += table[rough[j], rough[k]]
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the split of a histogram that lowers the loss most."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(np.argmax(gain)) if len(gain) else 0
    return (float(gain[at]) if len(gain) else 0.0), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The steps that a tree on one binned feature takes for each bin: Newton steps in up to 2**depth leaves."""
    if depth and len(g) > 1:
        gain, at = _best_cut(g, h)
        if gain > 1e-9:
            return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1), shallow_tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), -g.sum() / (h.sum() + 1))


def pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of a tree on two binned features: a cut of the first, then one of the second in each half."""
    best, table = 0.0, np.zeros_like(g)
    for at in range(1, len(g)):
        total, steps = 0.0, np.zeros_like(g)
        for half in (slice(0, at), slice(at, None)):
            gs, hs = g[half].sum(axis=0), h[half].sum(axis=0)
            gain, cut = _best_cut(gs, hs)
            for side in (slice(0, cut), slice(cut, None)):
                total += gs[side].sum() ** 2 / (hs[side].sum() + 1)
                steps[half, side] = -gs[side].sum() / (hs[side].sum() + 1)
        if total > best:
            best, table = total, steps
    return best, table


def train(x: np.ndarray, y: np.ndarray, prior: float) -> AdditiveModel:
    """Cyclic boosting: each round visits every feature in turn with one shallow tree and a small step; then the
    pairs whose trees still gain most are boosted the same way.

    Both labels weigh the same in the fit; ``base`` is set to the odds of ``prior``.
    """
    width = len(FEATURES)
    odds = float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    tables = np.zeros((width, BINS))
    if len(set(y.tolist())) < 2:
        none = [np.zeros(0)] * width
        return AdditiveModel(odds, none, none, tables, [], np.zeros((0, PAIR_BINS, PAIR_BINS)))
    edges = [_cuts(x[:, j], BINS) for j in range(width)]
    coarse = [_cuts(x[:, j], PAIR_BINS) for j in range(width)]
    fine = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    logit = np.zeros(len(y))

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return weight * (p - y), weight * p * (1 - p)

    for _ in range(ROUNDS):
        for j in range(width):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(fine[j], g, BINS), np.bincount(fine[j], h, BINS))
            tables[j] += step
            logit += step[fine[j]]
    cells = {(j, k): rough[j] * PAIR_BINS + rough[k] for j in range(width) for k in range(j + 1, width)}

    def grid(cell: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.bincount(cell, values, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)

    g, h = slopes()
    gains = {pair: pair_tree(grid(cell, g), grid(cell, h))[0] for pair, cell in cells.items()}
    pairs = sorted(gains, key=lambda pair: (-gains[pair], pair))[:PAIRS]
    pair_tables = np.zeros((len(pairs), PAIR_BINS, PAIR_BINS))
    for _ in range(PAIR_ROUNDS):
        for i, pair in enumerate(pairs):
            g, h = slopes()
            step = RATE * pair_tree(grid(cells[pair], g), grid(cells[pair], h))[1]
            pair_tables[i] += step
            logit += step.ravel()[cells[pair]]
    return AdditiveModel(odds, edges, coarse, tables, pairs, pair_tables)


def _feature_matrix(texts: pa.Array) -> np.ndarray:
    return np.array([features(text.as_py() or "") for text in texts]).reshape(len(texts), len(FEATURES))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> AdditiveModel:
    """Fit on at most ``2 * PER_CLASS`` labelled documents outside fold 0; the features of their whole texts
    are computed on the executors, and only those reach the driver."""
    rows = training_rows(docs, labels, "quality", PER_CLASS, id_col, text_col)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = pa.array([v.tobytes() for v in _feature_matrix(batch.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), values], ["id", "label", "values"]
            )

    kind = rows.schema["id"].dataType.simpleString()
    drawn = rows.mapInArrow(measure, f"id {kind}, label int, values binary").collect()
    drawn.sort(key=lambda r: r[0])
    known = labels.filter(col("quality").isin(0, 1) & (label_fold(col(id_col)) != 0))
    prior = known.agg(F.avg(col("quality").cast("double"))).first()[0]
    x = np.array([np.frombuffer(r[2]) for r in drawn]).reshape(len(drawn), len(FEATURES))
    return train(x, np.array([r[1] for r in drawn], np.int64), 0.5 if prior is None else prior)


def score_quality(
    docs: DataFrame, model: AdditiveModel, id_col: str = "doc_id", text_col: str = "text", carry=()
) -> DataFrame:
    """``id``, ``score`` (0 to 1, higher: likelier good) and ``row``, a struct of the columns in ``carry``.

    The score comes from statistics of the whole text alone. A null or empty text has all features zero.
    Repeated rows and null ids give a row each; other columns are left out. Nothing is shuffled; the model
    is of fixed size.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = shared.value.scores(_feature_matrix(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(scores, pa.float64()), batch.column("row")], ["id", "score", "row"]
            )

    row = F.struct(*[col(name) for name in carry]) if carry else F.struct(F.lit(True).alias("none"))
    source = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), row.alias("row"))
    types = {field.name: field.dataType.simpleString() for field in source.schema}
    return source.mapInArrow(score, f"id {types['id']}, score double, row {types['row']}")
