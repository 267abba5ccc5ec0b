"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. Three letters in a row are bound into one vector:
the first is shifted by two places, the second by one, and the three are multiplied. The
bundle (sum) of all three-letter vectors describes a text; the bundle of all texts of a language
is its prototype. A text gets the language whose prototype has the largest cosine to it.

All learning rows count: tasks count three-letter strings by language, bundle them once, and
only these vectors, one per language and task, are summed over the cluster. A null text or
one without letters is ``und`` with score 0; repeated rows are judged alike; other
columns are left out.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowmender.llm.common import map_rows, slices

DIMENSIONS = 1024
SEED = 20
MOST_ROWS = 40_000  # vectors a task keeps at a time

LETTERS = np.array([chr(i).isalpha() for i in range(1 << 16)])


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct three-letter strings, a blank between words, and how often each occurs."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = LETTERS[np.minimum(codes, 0xFFFF)]
    if len(codes) and codes.max() > 0xFFFF:
        letter = np.array([chr(c).isalpha() for c in codes])
    codes = np.where(letter, codes, 32)
    codes = codes[np.concatenate([[True], letter[1:] | letter[:-1]])].astype(np.uint64)
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.unique((codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:], return_counts=True)


class Space:
    """The vectors of three-letter strings, made when needed."""

    def __init__(self, dimensions: int):
        self.dimensions = dimensions
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        found = self.letters.get(code)
        if found is None:
            signs = np.random.Generator(np.random.PCG64([SEED, code])).integers(0, 2, self.dimensions)
            found = self.letters[code] = (2 * signs - 1).astype(np.int8)
        return found

    def row(self, gram: int) -> int:
        at = self.rows.get(gram)
        if at is None:
            at = self.rows[gram] = len(self.rows)
            if at == len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            a, b, c = gram >> 42, gram >> 21 & 0x1FFFFF, gram & 0x1FFFFF
            self.table[at] = np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)
        return at

    def bundle(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(self.dimensions, np.float64)
        for at in range(0, len(found), 4096):
            if len(self.rows) > MOST_ROWS:
                self.rows.clear()
            rows = [self.row(g) for g in found[at : at + 4096].tolist()]
            total += counts[at : at + 4096].astype(np.float32) @ self.table[rows].astype(np.float32)
        return total


def learn(docs: DataFrame, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """The prototype of each non-null ``lang`` of ``docs``."""

    def run(batches):
        counted: dict[str, dict[int, int]] = defaultdict(dict)
        for batch in slices(batches):
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = counted[lang]
                for gram, n in zip(*(x.tolist() for x in grams(text or ""))):
                    own[gram] = own.get(gram, 0) + n
        space = Space(dimensions)
        for lang, own in counted.items():
            if own:
                vector = space.bundle(np.array(list(own), np.uint64), np.array(list(own.values()), np.int64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * dimensions, pa.string()), pa.array(range(dimensions), pa.int32()), pa.array(np.rint(vector).astype(np.int64))],
                    names=["lang", "place", "value"])

    parts = docs.filter("lang is not null").select("text", "lang").mapInArrow(run, "lang string, place int, value bigint")
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect():
        out.setdefault(r["lang"], np.zeros(dimensions))[r["place"]] = r["value"]
    return out


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score (the cosine, 0 at least) of every document."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[n] / max(np.linalg.norm(prototypes[n]), 1e-12) for n in names]) if names else None

    def make():
        space = Space(matrix.shape[1]) if names else None

        def one(text):
            found, counts = grams(text or "")
            if not names or not len(found):
                return "und", 0.0
            vector = space.bundle(found, counts)
            norm = np.linalg.norm(vector)
            if not norm:
                return "und", 0.0
            cosines = matrix @ vector / norm
            best = int(np.argmax(cosines))
            return names[best], min(1.0, max(0.0, float(cosines[best])))

        def work(cols):
            found = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs.select("doc_id", "text"), make, f"doc_id {kind}, lang_pred string, score double")
