"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting visits one feature after the other and adds a shallow tree over its
bins, shrunk, to the feature's table; then the pairs of features that reduce the loss
most get two-dimensional tables the same way. A score is the logistic of the tables'
entries at a document's bins.

The model is fitted on at most ``max_rows`` labelled rows, the first by a digest of
their ids; ids whose crc32 modulo 4 is 2 are never learned from. Scores cover all texts.

* NULL or blank text: all rates are 0, scored like any other.
* Labels with a NULL id or quality are left out; of several labels of one id the lowest counts.
* No training row: every score is 0.5. Rows of one kind: a constant score.
* NULL ids: not held out. Repeated rows score alike. Further columns are ignored, or
  kept by ``kept_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlsight.llm.common import remainder
from crawlsight.llm.features import RATES, base_counts, rates


@dataclass(frozen=True)
class GamOptions:
    max_rows: int = 20_000  # labelled rows to fit on
    bins: int = 32
    pair_bins: int = 8
    rounds: int = 60
    pairs: int = 6
    leaves: int = 4
    shrink: float = 0.2
    smooth: float = 1.0  # added to a leaf's curvature
    threshold: float = 0.7
    held_out: int = 2  # remainder of ids, modulo 4, that aren't learned from


@dataclass
class Model:
    cuts: list[np.ndarray]
    pair_cuts: list[np.ndarray]
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance of label 1 for rows of features: bins are looked up and their entries added."""
        total = np.full(len(x), self.base)
        for k, table in enumerate(self.tables):
            total += table[np.searchsorted(self.cuts[k], x[:, k])]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_cuts[i], x[:, i]), np.searchsorted(self.pair_cuts[j], x[:, j])]
        return 1 / (1 + np.exp(-total))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    """Borders between quantiles of the positive values. Most counts are 0, which has a bin
    of its own that reaches halfway to the smallest value seen."""
    positive = values[values > 0]
    if not len(positive):
        return np.zeros(1)
    return np.unique(np.concatenate([[positive.min() / 2], np.quantile(positive, np.arange(1, bins - 1) / (bins - 1))]))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, smooth: float) -> np.ndarray:
    """Values per bin of a tree over ordered bins, grown leaf by leaf where the gain is largest."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    borders = [0, len(g)]

    def worth(a, b):
        return (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + smooth)

    while len(borders) <= leaves:
        best = (1e-9, None)
        for a, b in zip(borders, borders[1:]):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gain = worth(a, at) + worth(at, b) - worth(a, b)
                k = int(np.argmax(gain))
                best = max(best, (float(gain[k]), int(at[k])), key=lambda t: t[0])
        if best[1] is None:
            break
        borders = sorted([*borders, best[1]])
    out = np.empty(len(g))
    for a, b in zip(borders, borders[1:]):
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + smooth)
    return out


def _quarters(g: np.ndarray, h: np.ndarray, smooth: float) -> tuple[float, np.ndarray]:
    """The best tree with one cut on each axis: its gain and its values per cell."""
    best, out = 0.0, np.zeros_like(g)
    gs, hs = (np.pad(a.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for a in (g, h))
    n, m = g.shape
    for a in range(1, n):
        for b in range(1, m):
            cells = [(r, c) for r in ((0, a), (a, n)) for c in ((0, b), (b, m))]
            gain, value = 0.0, np.zeros_like(g)
            for (r0, r1), (c0, c1) in cells:
                sg = gs[r1, c1] - gs[r0, c1] - gs[r1, c0] + gs[r0, c0]
                sh = hs[r1, c1] - hs[r0, c1] - hs[r1, c0] + hs[r0, c0]
                gain += sg**2 / (sh + smooth)
                value[r0:r1, c0:c1] = sg / (sh + smooth)
            if gain > best:
                best, out = gain, value
    return best, out


def fit(x: np.ndarray, y: np.ndarray, options: GamOptions = GamOptions()) -> Model:
    width = x.shape[1]
    model = Model([_cuts(x[:, k], options.bins) for k in range(width)], [_cuts(x[:, k], options.pair_bins) for k in range(width)])
    if not len(y):
        return model
    share = (y.sum() + 0.5) / (len(y) + 1)
    model.base = float(np.log(share / (1 - share)))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if y.min() == y.max():
        return model
    at = [np.searchsorted(c, x[:, k]) for k, c in enumerate(model.cuts)]
    total = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(options.rounds):
        for k in range(width):
            g, h = slopes()
            size = len(model.tables[k])
            step = options.shrink * _tree(np.bincount(at[k], g, size), np.bincount(at[k], h, size), options.leaves, options.smooth)
            model.tables[k] += step
            total += step[at[k]]
    coarse = [np.searchsorted(c, x[:, k]) for k, c in enumerate(model.pair_cuts)]

    def grid(i, j, values):
        n, m = len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1
        return np.bincount(coarse[i] * m + coarse[j], values, n * m).reshape(n, m)

    g, h = slopes()
    gains = {(i, j): _quarters(grid(i, j, g), grid(i, j, h), options.smooth)[0] for i in range(width) for j in range(i)}
    model.pairs = sorted(gains, key=gains.get, reverse=True)[: options.pairs]
    model.pair_tables = [np.zeros((len(model.pair_cuts[i]) + 1, len(model.pair_cuts[j]) + 1)) for i, j in model.pairs]
    for _ in range(options.rounds // 3):
        for k, (i, j) in enumerate(model.pairs):
            g, h = slopes()
            step = options.shrink * _quarters(grid(i, j, g), grid(i, j, h), options.smooth)[1]
            model.pair_tables[k] += step
            total += step[coarse[i], coarse[j]]
    return model


def train(docs: DataFrame, labels: DataFrame, options: GamOptions = GamOptions()) -> Model:
    """The model from a bounded sample of labelled rows; only their texts are read into features."""
    truth = (
        labels.filter(f"doc_id is not null and quality is not null and {remainder('doc_id', 4)} <> {options.held_out}")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(options.max_rows)
    )
    # At most ``max_rows`` pairs of numbers.
    rows = docs.select("doc_id", "text").join(F.broadcast(truth.withColumnRenamed("doc_id", "_id")), F.expr("doc_id = _id"))
    stats = base_counts(rows.select(F.struct("quality").alias("_row"), "text"), more=True, carry="_row").select("_row.quality", *rates())
    # Repeated rows of a labelled id may add some; the bound holds for them too.
    got = stats.limit(2 * options.max_rows).toPandas()
    return fit(got[list(RATES)].to_numpy(np.float64), (got["quality"].to_numpy() == 1).astype(np.float64), options)


def _scored(stats: DataFrame, carry: str, model: Model) -> DataFrame:
    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.column_stack([c.to_numpy(np.float64) for c in columns])))

    # A filter on the score must not move below the projections and repeat their work.
    once = score.asNondeterministic()
    return stats.select(carry, *rates()).select(carry, once(*RATES).alias("score"))


def classify(docs: DataFrame, labels: DataFrame, options: GamOptions = GamOptions()) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = train(docs, labels, options)
    return _scored(base_counts(docs, more=True), "doc_id", model).select(
        "doc_id",
        F.expr(f"{remainder('doc_id', 4)} = {options.held_out}").alias("held_out"),
        "score",
        (F.col("score") >= options.threshold).cast("int").alias("predicted"),
    )


def kept_documents(docs: DataFrame, labels: DataFrame, options: GamOptions = GamOptions()) -> DataFrame:
    """The documents that the classifier accepts, with all their columns; nothing is shuffled."""
    model = train(docs, labels, options)
    rows = docs.select(F.struct("*").alias("_row"))
    scored = _scored(base_counts(rows, more=True, carry="_row", text="_row.text"), "_row", model)
    return scored.filter(F.col("score") >= options.threshold).select("_row.*")
