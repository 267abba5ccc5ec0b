"""Quality classifier: a generalised additive model with pairwise interactions.

The logit of a document is a constant plus one table entry per feature and one per chosen
pair of features. The tables come from cyclic boosting: round after round each feature in
turn gets a shallow tree on the current gradients, over its own bins alone, whose leaves
are added to its table at a small rate; afterwards the pairs whose cells reduce the loss
most are boosted in the same way. Scoring bins the features and adds table entries.

The model is fitted on at most ``Fit.documents`` labelled rows per label, those with the
smallest hash of their id. Features come from the text alone. Nulls count as empty texts;
repeated rows score alike; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rowmender.llm.common import map_rows
from rowmender.llm.textstats import repeated_words, symbol_count, word_lines

FEATURES = (
    "words", "word_length", "symbols", "pipes", "upper_words", "marks", "digits", "repeated", "distinct",
    "dup_lines", "line_words", "ends", "plain_words", "top_word",
)


@dataclass(frozen=True)
class Fit:
    documents: int = 10_000  # at most so many of either label
    bins: int = 32
    pair_bins: int = 8
    pairs: int = 6
    rounds: int = 200
    pair_rounds: int = 60
    rate: float = 0.1
    ridge: float = 1.0


@dataclass
class Model:
    base: float = 0.0
    edges: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), 0)))
    tables: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), 1)))
    pair_edges: np.ndarray = field(default_factory=lambda: np.zeros((len(FEATURES), 0)))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, values: np.ndarray) -> np.ndarray:
        logit = np.full(len(values), self.base)
        bins, coarse = digitize(values, self.edges), digitize(values, self.pair_edges)
        for j in range(len(FEATURES)):
            logit += self.tables[j, bins[:, j]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            logit += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-logit))


def features(text: str) -> list[float]:
    lines = word_lines(text)
    words = [w for _, own in lines for w in own]
    n, size = len(words), max(1, len(text))
    if not n:
        return [0.0] * len(FEATURES)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    return [
        np.log1p(n), sum(map(len, words)) / n, symbol_count(text) / n, text.count("|") / n, sum(map(str.isupper, words)) / n,
        (text.count("!") + text.count("?")) / n, sum(map(text.count, "0123456789")) / size, repeated_words(words) / n, len(counts) / n,
        1 - len({line for line, _ in lines}) / len(lines), np.log1p(n / len(lines)), sum(own[-1][-1] in ".!?" for _, own in lines) / len(lines),
        sum(map(str.isalpha, words)) / n, max(counts.values()) / n,
    ]


def digitize(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(edges[j], values[:, j], side="right") for j in range(values.shape[1])], 1)


def quantile_edges(values: np.ndarray, bins: int) -> np.ndarray:
    return np.quantile(values, np.arange(1, bins) / bins, axis=0).T


def shallow_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float, depth: int = 2) -> np.ndarray:
    """Leaf value of each bin of the best axis tree of the given depth over ordered bins."""
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + ridge))
    if depth and len(gradient) > 1:
        g, h = np.cumsum(gradient), np.cumsum(weight)
        gain = g[:-1] ** 2 / (h[:-1] + ridge) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + ridge)
        cut = int(np.argmax(gain)) + 1
        if gain[cut - 1] > g[-1] ** 2 / (h[-1] + ridge):
            out[:cut] = shallow_tree(gradient[:cut], weight[:cut], ridge, depth - 1)
            out[cut:] = shallow_tree(gradient[cut:], weight[cut:], ridge, depth - 1)
    return out


def grid_tree(gradient: np.ndarray, weight: np.ndarray, ridge: float) -> np.ndarray:
    """The best cut in each of the two directions: four leaves over a grid of cells."""
    best, found = -np.inf, np.zeros_like(gradient)
    totals = np.stack([gradient, weight])
    sums = np.zeros((2, gradient.shape[0] + 1, gradient.shape[1] + 1))
    sums[:, 1:, 1:] = totals.cumsum(1).cumsum(2)
    for a in range(1, gradient.shape[0]):
        for b in range(1, gradient.shape[1]):
            g, h = (np.array([[s[a, b], s[a, -1] - s[a, b]], [s[-1, b] - s[a, b], s[-1, -1] - s[a, -1] - s[-1, b] + s[a, b]]]) for s in sums)
            value = g / (h + ridge)
            gain = (g * value).sum()
            if gain > best:
                best = gain
                found = np.repeat(np.repeat(value, [a, gradient.shape[0] - a], 0), [b, gradient.shape[1] - b], 1)
    return found


def fit(values: np.ndarray, labels: np.ndarray, settings: Fit = Fit()) -> Model:
    if len(set(labels.tolist())) < 2:
        share = float(labels.mean()) if len(labels) else 0.5
        share = min(max(share, 0.01), 0.99)
        return Model(base=float(np.log(share / (1 - share))))
    model = Model(edges=quantile_edges(values, settings.bins), pair_edges=quantile_edges(values, settings.pair_bins))
    share = labels.mean()
    model.base = float(np.log(share / (1 - share)))
    model.tables = np.zeros((len(FEATURES), settings.bins))
    bins, coarse = digitize(values, model.edges), digitize(values, model.pair_edges)
    logit = np.full(len(labels), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-logit))
        return labels - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(settings.rounds):
        for j in range(len(FEATURES)):
            gradient, weight = slopes()
            step = settings.rate * shallow_tree(np.bincount(bins[:, j], gradient, settings.bins), np.bincount(bins[:, j], weight, settings.bins), settings.ridge)
            model.tables[j] += step
            logit += step[bins[:, j]]
    gradient, weight = slopes()
    k = settings.pair_bins
    cells = {(i, j): coarse[:, i] * k + coarse[:, j] for i in range(len(FEATURES)) for j in range(i + 1, len(FEATURES))}
    gains = {p: float((np.bincount(c, gradient, k * k) ** 2 / (np.bincount(c, weight, k * k) + settings.ridge)).sum()) for p, c in cells.items()}
    model.pairs = sorted(gains, key=lambda p: (-gains[p], p))[: settings.pairs]
    model.pair_tables = [np.zeros((k, k)) for _ in model.pairs]
    for _ in range(settings.pair_rounds):
        for pair, table in zip(model.pairs, model.pair_tables):
            gradient, weight = slopes()
            c = cells[pair]
            step = settings.rate * grid_tree(np.bincount(c, gradient, k * k).reshape(k, k), np.bincount(c, weight, k * k).reshape(k, k), settings.ridge)
            table += step
            logit += step.reshape(-1)[c]
    return model


def fold(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, labels: DataFrame, settings: Fit = Fit()) -> Model:
    """From the texts of the labelled documents (labels: doc_id, quality)."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = None
    for value in (0, 1):
        some = known.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.documents)
        chosen = some if chosen is None else chosen.unionByName(some)

    def make():
        def work(cols):
            return {"doc_id": cols["doc_id"], "quality": cols["quality"], "values": [[float(x) for x in features(t or "")] for t in cols["text"]]}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "quality")
    rows = map_rows(sample, make, f"doc_id {kind}, quality int, values array<double>").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["values"]))[: 4 * settings.documents]
    values = np.array([r["values"] for r in rows]).reshape(-1, len(FEATURES))
    return fit(values, np.array([r["quality"] for r in rows], float), settings)


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """doc_id, score and predicted of every document."""

    def make():
        def work(cols):
            found = model.score(np.array([features(t or "") for t in cols["text"]]).reshape(-1, len(FEATURES)))
            return {"doc_id": cols["doc_id"], "score": found.tolist(), "predicted": (found >= threshold).astype(int).tolist()}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, score double, predicted int")


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that reach the threshold, with all their columns; no shuffle."""

    @F.pandas_udf("double")
    def rated(texts):
        import pandas as pd

        return pd.Series(model.score(np.array([features(t or "") for t in texts]).reshape(-1, len(FEATURES))))

    return docs.filter(rated(F.col("text")) >= threshold)
