"""Quality rules by labelling lines: a linear-chain conditional random field.

Each line with a word is content or boilerplate. A line is described by binned features
(its words, symbols, letter case, repetition, whether an earlier line equals it); a weight
per feature bin and label, and one per pair of neighbouring labels, give the score of a
labelling, and the Viterbi path is the best one. A document stays when enough of its
characters stand in content lines and it passes the plain counts.

The weights are fitted by gradient ascent on the likelihood, with forward and backward
sums, on a bounded sample of labelled documents (``Training.documents``); their lines take
the label of the document. Nulls count as empty texts, which fail; repeated rows are
judged alike; other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from rowmender.llm.common import map_rows
from rowmender.llm.textstats import repeated_words, symbol_count, word_lines

BOILERPLATE, CONTENT = 0, 1
BINS = 8
FEATURES = 9


@dataclass(frozen=True)
class Training:
    documents: int = 3000  # at most so many of either label
    stretch: int = 64  # lines of one training sequence
    rounds: int = 150
    rate: float = 0.1
    ridge: float = 1e-3


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    min_content: float = 0.5


def bin_of(value: float) -> int:
    """Shares in [0, 1] to bins that are finer near zero."""
    return min(BINS - 1, int(value**0.5 * BINS))


def line_bins(line: str, words: list[str], seen: bool) -> list[int]:
    n, size = len(words), len(line)
    upper = sum(map(str.isupper, words))
    plain = sum(map(str.isalpha, words))
    return [
        min(BINS - 1, n.bit_length()),
        bin_of(symbol_count(line) / size),
        bin_of(upper / n),
        bin_of(1 - plain / n),
        bin_of(1 - len(set(words)) / n),
        min(BINS - 1, size // n),
        int(words[-1][-1] in ".!?") + 2 * int(words[0][0].isupper()),
        bin_of((line.count("!") + line.count("?")) / size),
        int(seen),
    ]


def document_bins(lines: list[tuple[str, list[str]]]) -> list[list[int]]:
    seen: set[str] = set()
    out = []
    for line, words in lines:
        out.append(line_bins(line, words, line in seen))
        seen.add(line)
    return out


@dataclass
class Field:
    """``emit[feature, bin, label]``, ``move[label, next label]``."""

    emit: np.ndarray
    move: np.ndarray

    def scores(self, bins: np.ndarray) -> np.ndarray:
        return self.emit[np.arange(FEATURES), bins].sum(axis=-2)

    def viterbi(self, bins: list[list[int]]) -> list[int]:
        emit = self.scores(np.array(bins, np.int64)).tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = emit[0]
        back = []
        for x, y in emit[1:]:
            from_b0, from_b1 = b + m10 > a + m00, b + m11 > a + m01
            back.append((from_b0, from_b1))
            a, b = x + (b + m10 if from_b0 else a + m00), y + (b + m11 if from_b1 else a + m01)
        labels = [int(b >= a)]
        for step in reversed(back):
            labels.append(int(step[labels[-1]]))
        return labels[::-1]


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], training: Training = Training()) -> Field:
    """Maximum-likelihood weights from line bins and line labels."""
    emit, move = np.zeros((FEATURES, BINS, 2)), np.zeros((2, 2))
    emit[:, :, CONTENT] += 1e-3  # without any training lines everything is content
    if not sequences:
        return Field(emit, move)
    cut = [(b[i : i + training.stretch], y[i : i + training.stretch]) for b, y in zip(sequences, labels) for i in range(0, len(y), training.stretch)]
    size, longest = len(cut), max(len(y) for _, y in cut)
    bins, gold, mask = np.zeros((size, longest, FEATURES), np.int64), np.zeros((size, longest), np.int64), np.zeros((size, longest), bool)
    for i, (b, y) in enumerate(cut):
        bins[i, : len(y)], gold[i, : len(y)], mask[i, : len(y)] = b, y, True
    n = mask.sum()
    each = np.arange(FEATURES)
    hot = np.eye(2)[gold] * mask[..., None]
    both = mask[:, 1:] & mask[:, :-1]
    gold_moves = np.einsum("ita,itb->ab", hot[:, :-1] * both[..., None], hot[:, 1:])
    slots = (each * BINS + bins).reshape(-1)
    sums = lambda p: np.stack([np.bincount(slots, np.repeat(p[..., k].reshape(-1), FEATURES), FEATURES * BINS) for k in (0, 1)], -1).reshape(FEATURES, BINS, 2)
    gold_emit = sums(hot)
    moments = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    lse = lambda x, axis: np.logaddexp(*np.moveaxis(x, axis, 0))
    for step in range(1, training.rounds + 1):
        local = emit[each, bins].sum(axis=2)
        ahead, behind = np.zeros((size, longest, 2)), np.zeros((size, longest, 2))
        ahead[:, 0] = local[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(mask[:, t, None], lse(ahead[:, t - 1, :, None] + move, 1) + local[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(mask[:, t + 1, None], lse(move + (local[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        total = lse(ahead[:, -1], 1)[:, None, None]
        share = np.exp(np.where(mask[..., None], ahead + behind - total, -np.inf))
        pair = ahead[:, :-1, :, None] + move + (local + behind)[:, 1:, None, :] - total[..., None]
        moves = np.exp(np.where(both[..., None, None], pair, -np.inf)).sum((0, 1))
        slopes = ((gold_emit - sums(share)) / n - training.ridge * emit, (gold_moves - moves) / n - training.ridge * move)
        for k, (weights, slope) in enumerate(zip((emit, move), slopes)):  # Adam steps
            first, second = moments[2 * k], moments[2 * k + 1]
            first += 0.1 * (slope - first)
            second += 0.001 * (slope**2 - second)
            weights += training.rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return Field(emit, move)


def train(docs: DataFrame, labels: DataFrame, training: Training = Training()) -> Field:
    """``docs`` has doc_id and text, ``labels`` doc_id and quality (1 good, 0 poor)."""
    known = labels.filter("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = None
    for value in (0, 1):
        some = known.filter(F.col("quality") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(training.documents)
        chosen = some if chosen is None else chosen.unionByName(some)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def make():
        def work(cols):
            out = {"doc_id": cols["doc_id"], "quality": cols["quality"], "bins": []}
            for text in cols["text"]:
                out["bins"].append([x for line in document_bins(word_lines(text or "")) for x in line])
            return out

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_rows(sample.select("doc_id", "text", "quality"), make, f"doc_id {kind}, quality int, bins array<int>").collect()
    # in a fixed order, so that the weights do not depend on the order of arrival
    rows = sorted((r for r in rows if r["bins"]), key=lambda r: (r["doc_id"], r["bins"]))[: 4 * training.documents]
    bins = [np.array(r["bins"], np.int64).reshape(-1, FEATURES) for r in rows]
    return fit(bins, [np.full(len(b), r["quality"]) for b, r in zip(bins, rows)], training)


def judge(docs: DataFrame, field: Field, rules: Rules = Rules(), with_lines: bool = False) -> DataFrame:
    """One row per document: counts, ``base_failed``, ``content_share``, ``kept`` and, on demand, the line labels."""

    def make():
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept", "line_labels")

        def one(text: str):
            lines = word_lines(text)
            words = [w for _, own in lines for w in own]
            n, chars = len(words), sum(map(len, words))
            repeats = repeated_words(words)
            failed = n < rules.min_words or 100 * repeats > rules.max_repeat_percent * n
            labels = field.viterbi(document_bins(lines)) if lines else []
            content = sum(sum(map(len, own)) for (_, own), label in zip(lines, labels) if label == CONTENT)
            share = content / chars if chars else 0.0
            dup = len(lines) - len({line for line, _ in lines})
            return n, chars, symbol_count(text), dup, repeats, failed, share, not failed and share >= rules.min_content, labels

        def work(cols):
            found = [one(text or "") for text in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {name: [f[i] for f in found] for i, name in enumerate(names)}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
              "base_failed boolean, content_share double, kept boolean" + ", line_labels array<int>" * with_lines)
    return map_rows(docs.select("doc_id", "text"), make, schema)
