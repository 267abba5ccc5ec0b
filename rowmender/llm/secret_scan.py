"""Secrets in texts: fixed patterns, and values whose guessing cost is high.

Three patterns find secrets by their form. Beside them, every value that follows a name
such as ``password`` or ``credential`` and a ``:`` or ``=`` is rated by the number of guesses an
attacker needs: a dynamic program cuts it into words, dates, repeats, walks over the
keyboard and brute-force spans so that the sum of the logarithms is smallest. A repeat costs what
its block costs alone, by the same program. A value that is costly to guess is a finding (kind
``guess``), unless a pattern has it already; words, dates or filler in that place are cheap and
are left alone. A quoted value with blanks is as costly as its costliest word, so sentences are
left alone too; a passphrase of plain words is not told from them.

The words are those that passwords are often made of, and the frequent words of the corpus
(:func:`corpus_words`), at most ``WORDS`` of them, counted over all documents.

Nulls count as empty texts; offsets are code points, ends exclusive; repeated rows are
scanned alike; other columns are left out.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from rowmender.llm.common import drop_path, map_rows, written

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
CONTEXT = re.compile(
    r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?)["']?[\x20\t]*[:=][\x20\t]*(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"',;]+))""",
    re.I | re.A)
#: One of these stands in every match of the two patterns above, in lower case.
NAMES = ("passw", "secret", "token", "api", "passphrase", "pwd", "key", "credential")
KINDS = ("assign", "access", "hex", "guess")

# Frequent words of passwords, most frequent first.
COMMON = (
    "password", "qwerty", "dragon", "letmein", "monkey", "football", "iloveyou", "admin", "welcome", "login", "abc", "master", "hello",
    "freedom", "whatever", "trustno", "shadow", "sunshine", "princess", "baseball", "superman", "secret", "token", "changeme", "example",
    "default", "test", "user", "guest", "root", "pass", "none", "null", "true", "false", "required", "your", "here", "value", "string",
    "name", "the", "and", "for", "this", "that", "with", "from", "must", "not", "key", "company", "summer", "winter", "spring", "autumn",
)
KEYBOARD = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
SWAPS = str.maketrans("@4310$57!", "aaeiosstl")
DATE = re.compile(r"(?:\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|(?:19|20)\d{6}|(?:19|20)\d{2})", re.A)

DATE_COST = math.log10(365 * 120)
DATE_LENGTHS = range(4, 11)
WALK_COST = math.log10(94 * 4)
PART_COST = 0.3  # each further part doubles the orders to be tried
PERIODS = range(2, 9)  # lengths of a block that repeats
SHORTEST_WORD, LONGEST_WORD = 3, 24
WORDS = 30_000


def keyboard_neighbours() -> set[tuple[str, str]]:
    """Pairs of keys beside each other, in a row or in the next one."""
    out = set()
    for y, row in enumerate(KEYBOARD):
        for x, c in enumerate(row):
            near = [(x + 1, y), (x, y + 1), (x - 1, y + 1)]
            for nx, ny in near:
                if ny < len(KEYBOARD) and 0 <= nx < len(KEYBOARD[ny]):
                    out |= {(c, KEYBOARD[ny][nx]), (KEYBOARD[ny][nx], c)}
    return out


ADJACENT = keyboard_neighbours()


def symbol_cost(c: str) -> float:
    """Brute force over the class of the character."""
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 1000)


class Guesser:
    """Guess costs with a ranked list of words, most frequent first."""

    def __init__(self, words: Sequence[str] = ()) -> None:
        self.rank: dict[str, int] = {}
        for w in (*COMMON, *words):
            if SHORTEST_WORD <= len(w) <= LONGEST_WORD:
                self.rank.setdefault(w, len(self.rank) + 1)
        self.longest = max(map(len, self.rank))
        self.blocks: dict[str, float] = {}

    def block_cost(self, block: str) -> float:
        """The cost of a short text alone, kept for the next time."""
        found = self.blocks.get(block)
        if found is None:
            if len(self.blocks) > 100_000:
                self.blocks.clear()
            found = self.blocks[block] = self.cost(block)
        return found

    def word_cost(self, part: str) -> float | None:
        low = part.lower()
        rank, swapped = self.rank.get(low), 0.0
        if rank is None:
            rank, swapped = self.rank.get(low.translate(SWAPS)), 0.6
        if rank is None:
            return None
        case = 0.0 if part == low else 0.3 if part[1:] == low[1:] or part.isupper() else 0.3 * sum(map(str.isupper, part))
        return math.log10(rank + 1) + swapped + case

    def cost(self, value: str) -> float:
        """Decimal logarithm of the guesses that the cheapest segmentation needs.

        Runs, walks and repeats may begin at several places. Of two beginnings the earlier one
        gains on the later one as the end moves on, because log(n) flattens, so a beginning
        that is no cheaper when it comes up never is, and few are kept.
        """
        n = len(value)
        best = [0.0] + [math.inf] * n
        brute = math.inf  # the cheapest way that ends in an open brute-force span
        low = value.lower()
        dates: dict[int, list[int]] = {}
        for start in range(n):
            if value[start].isdigit():
                for size in DATE_LENGTHS:
                    if start + size <= n and DATE.fullmatch(value, start, start + size):
                        dates.setdefault(start + size, []).append(start)
        runs: list[tuple[int, float]] = []
        walks: list[tuple[int, float]] = []
        blocks: dict[tuple[int, int], list[tuple[int, float]]] = {}
        run = walk = 0  # where the run and the walk that are under way begin

        def cheapest(begun: list[tuple[int, float]], start: int, base: float, end: int, unit: int) -> float:
            """Take in a beginning, and the cheapest of all for this end."""
            found = min((b + math.log10((end - s) // unit) for s, b in begun), default=math.inf)
            own = base + math.log10((end - start) // unit)
            if own < found:
                begun.append((start, base))
            return min(own, found)

        for end in range(1, n + 1):
            at = end - 1
            brute = min(best[at] + PART_COST, brute) + symbol_cost(value[at])
            cost = brute
            for start in range(max(0, end - self.longest), end - SHORTEST_WORD + 1):
                own = self.word_cost(value[start:end])
                if own is not None:
                    cost = min(cost, best[start] + PART_COST + own)
            for start in dates.get(end, ()):
                cost = min(cost, best[start] + PART_COST + DATE_COST)
            if at and value[at] != value[at - 1]:
                run, runs = at, []
            if end - run >= 3:
                cost = min(cost, cheapest(runs, end - 3, best[end - 3] + PART_COST + symbol_cost(value[at]), end, 1))
            if at and (low[at - 1], low[at]) not in ADJACENT:
                walk, walks = at, []
            if end - walk >= 3:
                cost = min(cost, cheapest(walks, end - 3, best[end - 3] + PART_COST + WALK_COST, end, 1))
            for period in PERIODS:
                if 2 * period > end:
                    break
                chain = (period, end % period)
                if value[end - period : end] == value[end - 2 * period : end - period]:
                    start = end - 2 * period
                    base = best[start] + PART_COST + self.block_cost(value[end - period : end])
                    cost = min(cost, cheapest(blocks.setdefault(chain, []), start, base, end, period))
                else:
                    blocks.pop(chain, None)
            best[end] = cost
        return best[n]

    def value_cost(self, value: str) -> float:
        """The cost of a value, or of its costliest word if it has blanks."""
        return max((self.cost(part) for part in value.split()), default=0.0)


PLAIN = Guesser()


def guess_cost(value: str) -> float:
    return PLAIN.cost(value)


def corpus_words(docs: DataFrame, most: int = WORDS, text: str = "text") -> list[str]:
    """At most ``most`` of the most frequent words of three letters and more, most frequent first.

    Counted over all documents by bounded counters in each task; the driver gets the words
    that a histogram of their counts admits.
    """
    from rowmender.llm.importance import SampleSettings, frequent_words

    counts, path = written(frequent_words(docs.select(F.col(f"`{text}`").alias("text")), SampleSettings(counters=4 * most)), "word-counts")
    letters = counts.filter(F.col("word").rlike(f"^[a-z]{{{SHORTEST_WORD},{LONGEST_WORD}}}$"))
    step = F.floor(F.log2("n") * 8).cast("int")
    room, least = most, None
    for level, number in sorted(letters.groupBy(step.alias("level")).agg(F.count(F.lit(1))).collect(), reverse=True):
        room -= number
        if room < 0:
            break
        least = level
    kept = [] if least is None else letters.filter(step >= least).collect()
    drop_path(docs.sparkSession, path)
    return [r["word"] for r in sorted(kept, key=lambda r: (-r["n"], r["word"]))]


def scan(text: str, min_cost: float = 10.0, min_length: int = 8, guesser: Guesser = PLAIN) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, guess cost or 0) of every finding, by start and kind."""
    found: list[tuple[int, int, str, float]] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        taken = []
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                found.append((*m.span(), "assign", guesser.cost(m[2])))
                taken.append(m.span())
        for m in CONTEXT.finditer(text):
            group = next(i for i in (1, 2, 3) if m[i] is not None)
            lo, hi = m.span(group)
            if hi - lo >= min_length and not any(a < hi and lo < b for a, b in taken):
                cost = guesser.value_cost(m[group])
                if cost >= min_cost:
                    found.append((lo, hi, "guess", cost))
    if "AKIA" in text:
        found += [(*m.span(), "access", 0.0) for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex", 0.0) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple]) -> str:
    return ",".join(f"{kind}:{lo}:{hi}" for lo, hi, kind, *_ in found)


def redact(text: str, found: list[tuple], mark: str = "[secret]") -> str:
    """The text with every finding replaced; findings that overlap become one mark."""
    out, at = [], 0
    spans: list[list[int]] = []
    for lo, hi, *_ in sorted(found):
        if spans and lo < spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        out += [text[at:lo], mark]
        at = hi
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, min_cost: float = 10.0, min_length: int = 8, with_text: bool = False, words: Sequence[str] = ()) -> DataFrame:
    """One row per document: counts, ``base_sha256``, ``spans``, ``highest_cost`` and, on demand, ``redacted``.

    ``words`` are words that are cheap to guess beside the built-in ones, such as :func:`corpus_words`.
    """
    words = list(words)

    def make():
        guesser = Guesser(words)
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "highest_cost", "redacted")

        def one(text):
            found = scan(text or "", min_cost, min_length, guesser)
            base = [f for f in found if f[2] != "guess"]
            counts = [sum(f[2] == kind for f in found) for kind in KINDS]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            return (*counts[:3], digest, joined(found), counts[3], max((f[3] for f in found), default=0.0), redact(text, found) if with_text and text is not None else None)

        def work(cols):
            rows = [one(t) for t in cols["text"]]
            return {"doc_id": cols["doc_id"]} | {name: [r[i] for r in rows] for i, name in enumerate(names)}

        return work

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, n_guess bigint, highest_cost double"
              + ", redacted string" * with_text)
    return map_rows(docs.select("doc_id", "text"), make, schema)


def keep_redacted(docs: DataFrame, text: str = "text", words: Sequence[str] = ()) -> DataFrame:
    """The rows with every secret of ``text`` replaced; all columns stay."""
    words, made = list(words), []

    @F.pandas_udf("string")
    def redacted(texts):
        if not made:  # once per task
            made.append(Guesser(words))
        return texts.map(lambda t: t if t is None else redact(t, scan(t, guesser=made[0])))

    redacted_columns = [redacted(F.col(f"`{text}`")).alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*redacted_columns)
