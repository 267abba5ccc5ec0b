"""Splitting texts before byte-pair encoding, fast and independent of the neighbours."""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable

#: A blank beside other white space: only there does a split at blanks change the matches.
LOOSE = re.compile(r" \s|\s ")


class Memo(dict):
    """``make(word)`` of each word, computed when first asked for; emptied when it grows too large."""

    def __init__(self, make: Callable[[str], object], most: int = 1_000_000):
        self.make, self.most = make, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        made = self[word] = self.make(word)
        return made


class Split:
    """Applies ``make`` to parts of a text whose results, one after another, are those of the text.

    In the usual pattern of byte-level encoders a blank belongs to the word after it. A
    text in which no blank stands beside other white space can therefore be cut before
    every blank; any other text is one part.
    """

    def __init__(self, make: Callable[[str], object]):
        self.whole = make
        self.after_blank = Memo(lambda word: make(" " + word))

    def parts(self, text: str) -> list:
        if LOOSE.search(text):
            return [self.whole(text)]
        first, *rest = text.split(" ")
        return [self.whole(first), *map(self.after_blank.__getitem__, rest)]


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def json_vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks and special tokens of a byte-level vocabulary file, whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    letters = byte_letters()
    special = {t["content"]: t["id"] for t in found["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): i for word, i in found["model"]["vocab"].items() if word not in special}
    joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in found["model"]["merges"]]
    ids = [found["model"]["vocab"][w] for w in joined]
    if ids != sorted(ids):
        raise ValueError("the ids do not follow the merges")
    return ranks, special


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, file)}
