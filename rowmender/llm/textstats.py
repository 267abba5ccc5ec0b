"""Counts over words and lines that several operators use."""

from __future__ import annotations

import re

import numpy as np

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SYMBOLS = "#*$%&|<>"


def duplicated(codes: np.ndarray) -> np.ndarray:
    """Which values occur more than once."""
    order = np.sort(codes)
    twice = order[1:][order[1:] == order[:-1]]
    return np.isin(codes, twice) if len(twice) else np.zeros(len(codes), bool)


def window_codes(ids: np.ndarray, distinct: int, width: int) -> np.ndarray:
    """One number per window of ``width`` ids, equal just for equal windows."""
    count = len(ids) - width + 1
    codes, values = ids[:count].copy(), distinct
    for step in range(1, width):
        if values * distinct >= 1 << 62:
            kinds, codes = np.unique(codes, return_inverse=True)
            values = len(kinds)
        codes = codes * distinct + ids[step : step + count]
        values *= distinct
    return codes


def repeated_words(words: list[str], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    if len(words) <= width:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == len(words):
        return 0
    hit = np.flatnonzero(duplicated(window_codes(ids, len(numbers), width)))
    if not len(hit):
        return 0
    covered = np.zeros(len(words) + 1, np.int32)
    np.add.at(covered, hit, 1)
    np.add.at(covered, hit + width, -1)
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def symbol_count(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


def word_lines(text: str) -> list[tuple[str, list[str]]]:
    """The lines that hold a word, each with its words."""
    return [(line, words) for line in text.split("\n") if (words := WORDS(line))]
