"""Quality classifier: a generalised additive model with pairwise interactions.

Shape functions are lookup tables over quantile bins.  They are learned by cyclic boosting:
round after round, each feature in turn gets one shallow tree on the current residuals, added
to its table with a small step, so no feature takes what another explains as well.  The pairs
whose quadrants explain most of what remains then get tables of their own, in the same way.
A text is scored by adding its bins' table entries, column by column over an Arrow batch.

Labels are learned from at most ``SAMPLE`` rows, chosen by hash of the id; their features
(``SAMPLE`` short rows) are the only data that reach the driver.  Scoring reads all rows and
whole texts; no feature depends on id, language, source or label.

Defined results: null and empty texts have all features at 0 and are scored as such; with no
labelled rows of one kind the score is the (smoothed) share of label 1; repeated rows score
alike; null ids are kept.  Columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.llm.common import binary_values
from tidewatch.session import share

SAMPLE, THRESHOLD = 20_000, 0.3
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, STEP, RIDGE = 32, 150, 8, 60, 0.1, 5.0

FEATURES = ("log_words", "word_length", "distinct_words", "repeated_next", "upper", "symbols", "marks", "bars",
            "digits", "beyond_ascii", "log_line", "repeated_lines", "top_word", "short_words", "capitalised", "spaces")

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_SPACE = np.isin(_CODES, [9, 10, 11, 12, 13, 32])
_PLAIN = np.isin(_CODES, list(b".,;:'()-"))
_SYMBOL = ~(_LETTER | _DIGIT | _SPACE | _PLAIN)


def features_of(text: bytes | None) -> np.ndarray:
    """The features of one whole text, in the order of ``FEATURES``."""
    if not text:
        return np.zeros(len(FEATURES))
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [line for line in text.split(b"\n") if line.strip()]
    n, letters, size = max(len(words), 1), max(counts[_LETTER].sum(), 1), len(text)
    tally: dict[bytes, int] = {}
    for word in words:
        tally[word] = tally.get(word, 0) + 1
    initials = sum(b"A"[0] <= word[0] <= b"Z"[0] for word in words)
    return np.array([
        np.log1p(len(words)), size / n, len(tally) / n ** 0.8, sum(map(eq, words, words[1:])) / n,
        counts[_UPPER].sum() / letters, counts[_SYMBOL].sum() / n, counts[33] / n, counts[124] / n,
        counts[_DIGIT].sum() / size, counts[128:].sum() / size, np.log1p(size / max(len(lines), 1)),
        1 - len(set(lines)) / max(len(lines), 1), max(tally.values(), default=0) / n,
        sum(len(word) <= 3 for word in words) / n, initials / n, counts[_SPACE].sum() / size])


@dataclass
class Gam:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def bins(self, features: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(edges, features[:, i], "right") for i, edges in enumerate(self.edges)]

    def score(self, features: np.ndarray) -> np.ndarray:
        bins = self.bins(features)
        total = np.full(len(features), self.bias)
        for table, at in zip(self.tables, bins, strict=True):
            total += table[at]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[bins[i], bins[j]]
        return 1 / (1 + np.exp(-total))


def _sums(at: np.ndarray, size: int, gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.bincount(at, gradient, size), np.bincount(at, weight, size)


def _gains(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Gain of a cut before each position but the first, along the last axis."""
    left_g, left_h = np.cumsum(g, -1)[..., :-1], np.cumsum(h, -1)[..., :-1]
    all_g, all_h = g.sum(-1, keepdims=True), h.sum(-1, keepdims=True)
    return (left_g ** 2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE)
            - all_g ** 2 / (all_h + RIDGE))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values of a shallow tree over ordered bins."""
    if depth and len(g) > 1:
        gains = _gains(g, h)
        cut = int(gains.argmax()) + 1
        if gains[cut - 1] > 1e-9:
            return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + RIDGE))


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best cut of one feature with a cut of the other on either side."""
    best, values = 0.0, np.zeros_like(g)
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        across = np.cumsum(a, 0)[:-1], np.cumsum(b, 0)[:-1]
        sides = [across, (a.sum(0) - across[0], b.sum(0) - across[1])]
        gains = [_gains(x, y) for x, y in sides]
        total = gains[0].max(-1) + gains[1].max(-1) + _gains(a.sum(1), b.sum(1))
        cut = int(total.argmax())
        if total[cut] > best:
            best, made = float(total[cut]), np.zeros_like(a)
            for rows, (x, y), gain in ((slice(0, cut + 1), sides[0], gains[0]), (slice(cut + 1, None), sides[1], gains[1])):
                at = int(gain[cut].argmax()) + 1
                for columns in (slice(0, at), slice(at, None)):
                    made[rows, columns] = x[cut, columns].sum() / (y[cut, columns].sum() + RIDGE)
            values = made.T if turned else made
    return best, values


def fit_gam(features: np.ndarray, labels: np.ndarray) -> Gam:
    """Tables learned by cyclic boosting; features are visited in order, so the fit is repeatable."""
    share_of_one = (labels.sum() + 1) / (len(labels) + 2)
    model = Gam(float(np.log(share_of_one / (1 - share_of_one))), [], [], [], [])
    for column in features.T if len(features) else np.zeros((len(FEATURES), 0)):
        levels = np.linspace(0, 1, BINS + 1)[1:-1]
        model.edges.append(np.unique(np.quantile(column, levels)) if len(column) else np.empty(0))
        model.tables.append(np.zeros(len(model.edges[-1]) + 1))
    if len(np.unique(labels)) < 2:
        return model
    bins = model.bins(features)
    total = np.full(len(labels), model.bias)

    def residuals():
        p = 1 / (1 + np.exp(-total))
        return labels - p, p * (1 - p)

    for _ in range(ROUNDS):
        for at, table in zip(bins, model.tables, strict=True):
            step = STEP * _tree(*_sums(at, len(table), *residuals()))
            table += step
            total += step[at]
    found = []
    for i, j in combinations(range(len(bins)), 2):
        shape = len(model.tables[i]), len(model.tables[j])
        if min(shape) > 1:
            sums = _sums(bins[i] * shape[1] + bins[j], shape[0] * shape[1], *residuals())
            found.append((_pair_tree(*(s.reshape(shape) for s in sums))[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(found, key=lambda f: (-f[0], f[1:]))[:PAIRS]]
    cells = [(bins[i] * len(model.tables[j]) + bins[j], (len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    model.pair_tables = [np.zeros(shape) for _, shape in cells]
    for _ in range(PAIR_ROUNDS):
        for (cell, shape), table in zip(cells, model.pair_tables, strict=True):
            sums = _sums(cell, shape[0] * shape[1], *residuals())
            step = STEP * _pair_tree(*(s.reshape(shape) for s in sums))[1]
            table += step
            total += step.ravel()[cell]
    return model


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id",
        text_column: str = "text", label_column: str = "quality") -> Gam:
    """The model of at most ``sample`` labelled rows, chosen by hash of their ids."""
    chosen = (labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull())
              .select(F.col(id_column).cast("long").alias("_doc"), F.col(label_column).cast("int").alias("label"))
              .groupBy("_doc").agg(F.min("label").alias("label")).orderBy(F.xxhash64("_doc"), "_doc").limit(sample))

    def measure(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = [features_of(text).tolist() for text in binary_values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))],
                                             names=["doc", "label", "features"])

    rows = (documents.select(F.col(id_column).cast("long").alias("_doc"), F.col(text_column).cast("string").alias("text"))
            .join(F.broadcast(chosen), "_doc").select("_doc", "label", "text")
            .mapInArrow(measure, "doc long, label int, features array<double>")
            .groupBy("doc").agg(F.min(F.struct("features", "label")).alias("least"))
            .orderBy("doc").select("doc", "least.label", "least.features").toArrow())
    features = np.array(rows["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit_gam(features, rows["label"].to_numpy())


def quality(model: Gam, documents: DataFrame, text_column: str = "text") -> Column:
    """The score of a text, 0 to 1, as a column."""
    shared = share(documents.sparkSession, model)

    @F.arrow_udf(T.DoubleType())
    def score(texts):
        import pyarrow as pa

        rows = [features_of(text) for text in binary_values(texts)]
        return pa.array(shared.value.score(np.array(rows).reshape(-1, len(FEATURES))), pa.float64())

    return score(F.col(text_column).cast("string"))
