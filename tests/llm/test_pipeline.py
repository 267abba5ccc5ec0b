import random
import re
from collections import Counter

import corpus_pipeline
from rowmender.llm import packing, secret_scan
from rowmender.llm.common import load

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _t string"


def word_places(text):
    """The words of a text and where they start, and its end."""
    found = list(re.finditer(r"[^\x20\x09-\x0D]+", text))
    return [m[0] for m in found], [m.start() for m in found] + [len(text)]


def without_repeats(text, words, starts, seen):
    """The text without words of runs of 51 that ``seen`` has twice; blanks go with the word before."""
    gone = set()
    for i in range(len(words) - 50):
        if seen[tuple(words[i : i + 51])] > 1:
            gone.update(range(i, i + 51))
    return text[: starts[0]] + "".join(text[starts[i] : starts[i + 1]] for i in range(len(words)) if i not in gone)


def test_passages_of_51_words(spark):
    """Passages of 51 to 65 short words that recur are cut, shorter ones and clean texts stay."""
    rng = random.Random(11)
    make = lambda n: [f"{rng.choice('abcdef')}{rng.randrange(10000)}" for _ in range(n)]
    rows, planted = [], {}
    for n in (40, 50, 51, 52, 58, 65):
        passage = make(n)
        for k in range(3):
            doc = len(rows)
            rows.append((doc, " ".join(make(30 + k)) + "\n" + ("  " if k == 2 else " ").join(passage) + " " + " ".join(make(20)), "en", "s", 1, None))
            planted[doc] = n
    rows += [(100 + i, " ".join(make(80)), "en", "s", 1, None) for i in range(5)] + [(200, None, "en", "s", 1, None), (201, " ", "en", "s", 1, None)]
    same = " ".join(make(60))
    rows += [(300, same, "en", "s", 1, None), (301, same + " ", "en", "s", 1, None)]
    docs = spark.createDataFrame(rows, COLUMNS.replace("_t string", "had_text string"))
    out = {r.doc_id: r.text for r in corpus_pipeline.long_repeats(spark, docs, SF).collect()}
    seen = Counter(tuple(own[i : i + 51]) for own in ((r[1] or "").split() for r in rows) for i in range(len(own) - 50))
    for doc, text, *_ in rows:
        if doc in (300, 301):
            assert doc not in out
        elif not text or not text.split():
            assert out[doc] == text
        else:
            assert out[doc] == without_repeats(text, *word_places(text), seen)
            assert (len(out[doc].split()) < len(text.split())) == (planted.get(doc, 0) > 50)


def test_stages(spark):
    docs = load(spark, SF, "documents")
    quality = {r.doc_id: r.quality for r in load(spark, SF, "labels").collect()}
    rows = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        rows[name] = {r.doc_id: r for r in out.collect()}
        docs = spark.createDataFrame(list(rows[name].values()), out.schema)
    good, alone, cut, safe = rows.values()
    assert set(safe) == set(cut) <= set(alone) <= set(good)
    wrong = [d for d, q in quality.items() if (d in good) != bool(q)]
    assert len(wrong) <= 0.03 * len(quality)
    sets = {d: {tuple(r.text.lower().split()[i : i + 5]) for i in range(max(1, len(r.text.split()) - 4))} for d, r in good.items()}
    ids = sorted(sets)
    dropped = set(good) - set(alone)
    near = {b: a for i, b in enumerate(ids) for a in ids[:i] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert dropped == set(near)
    words = {d: word_places(r.text) for d, r in alone.items()}
    seen = Counter(tuple(own[i : i + 51]) for own, _ in words.values() for i in range(len(own) - 50))
    for doc, r in alone.items():
        left = without_repeats(r.text, *words[doc], seen)
        assert (doc in cut) == (left == r.text or bool(left.split())) and (doc not in cut or cut[doc].text == left)
    guesser = secret_scan.Guesser(secret_scan.corpus_words(spark.createDataFrame([(r.text,) for r in cut.values()], "text string")))
    for r in safe.values():
        assert secret_scan.redact(cut[r.doc_id].text, secret_scan.scan(cut[r.doc_id].text, guesser=guesser)) == r.text and r.n_chars == len(r.text)
    packed = corpus_pipeline.pack(spark, docs, SF).collect()
    assert {r.doc_id for r in packed} == set(safe)
    assert {r.doc_id: r.piece for r in packed if r.piece == 0}.keys() == set(safe)
    total = sum(r.length for r in packed)
    assert len({r.sequence_id for r in packed}) <= total / corpus_pipeline.CAPACITY * 1.05 + 2
    assert packing.piece_lengths(5000, 2048) == [904, 2048, 2048]


def test_odd_rows(spark):
    body = " ".join(f"word{i}" for i in range(90)) + "."
    rows = [(1, body, "en", "s", 1, "x"), (1, body, "en", "s", 1, "x"), (None, body, None, None, None, None), (3, None, None, None, None, None), (4, "", "en", "s", 0, "y")]
    docs = spark.createDataFrame(rows, COLUMNS)
    alone = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted((r.doc_id or 0) for r in alone) == [0, 1, 3, 4]
    cut = corpus_pipeline.long_repeats(spark, docs, SF).collect()
    assert [r.doc_id for r in cut if r.doc_id in (3, 4)] and all(r._t in ("x", "y", None) for r in cut)
    safe = corpus_pipeline.secrets(spark, docs, SF)
    assert safe.columns == docs.columns and safe.count() == 5
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
