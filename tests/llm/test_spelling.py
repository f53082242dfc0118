"""Spelling variants against all pairs of words, and on hard rows."""

import random
import re
import zlib
from collections import Counter

import pytest

from meshwork.llm import spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, misspelt=199):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if misspelt and h % misspelt == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                total[w] += 1
    return {w: n for w, n in total.items() if n >= 5}


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    out, form, sized = [], {}, {}
    for w in words:
        sized.setdefault(len(w), []).append(w)
    for w, n in words.items():
        own = [x for k in (-1, 0, 1) for x in sized.get(len(w) + k, ()) if near(w, x)]
        best = min(own, key=lambda x: (-words[x], x)) if own else None
        if best and words[best] >= 5 * n:
            form[w] = best
        out.append((w, n, len(own)))

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, k, words[form[w]] if w in form else None) for w, n, k in out)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    parts = ["in", "th", "er", "on", "à", "ß", "ÿe"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randrange(3, 8))) for _ in range(150)]
    rows = []
    for k in range(200):
        text = []
        for _ in range(rng.randrange(120)):
            w = base[min(int(rng.expovariate(0.08)), 149)]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("eß") + w[at:], w[:at] + rng.choice("eß") + w[at + 1 :]])
            text.append(rng.choice([w, w, w, w.capitalize()]))
        rows.append((k, rng.choice([" ", ", ", "1", "_"]).join(text)))
    rows += [(1000, None), (1001, ""), (1002, "çabcdef " * 30 + "cabcdef " * 4), (1002, "cabcdef "), (None, "nullish " * 40), (1003, "÷×÷×÷× " * 6), (1004, ("q" * 3000 + " ") * 6 + ("q" * 3001 + " ") * 40), (1005, "aaaaaa " * 5 + "aaaaaaa " * 25 + "aaaaaaaa " * 125)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, word string"), rows


@pytest.mark.parametrize("misspelt", [199, 3])
def test_like_all_pairs(docs, misspelt):
    frame, rows = docs
    want = grouped(counted(rows, misspelt))
    assert sum(r[1] is not None for r in want) > 20
    got = sorted(tuple(r) for r in spelling.spelling_variants(frame, misspelt=misspelt).collect())
    assert got == want
    assert misspelt == 3 or any(r[2] not in (r[0], r[1]) for r in want)  # forms of forms


def test_crowds(docs):
    """Buckets of any size give the same pairs."""
    frame, rows = docs
    words = spelling.vocabulary(frame, misspelt=3)
    pairs = [{tuple(r) for r in spelling.near_pairs(words, crowd=c).collect()} for c in (0, 64)]
    own = sorted(counted(rows, 3))
    assert pairs[0] == pairs[1] == {(a, b) for a in own for b in own if a < b and near(a, b)}


def test_words_without_misspelling(docs):
    frame, rows = docs
    got = {r["word"]: r["n"] for r in spelling.vocabulary(frame).collect()}
    assert got == counted(rows, None)


def test_long_texts_and_flushes(spark, monkeypatch):
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abc") for _ in range(6)) for _ in range(4000))
    want = counted([(1, text)], None)
    monkeypatch.setattr(spelling, "CHUNK", 50)
    assert "".join(spelling._chunks(text)) == text
    assert sum((Counter(re.findall("[a-z]+", c)) for c in spelling._chunks(text)), Counter()) == Counter(text.split())
    assert {r["word"]: r["n"] for r in spelling.vocabulary(spark.createDataFrame([(1, text)], "doc_id int, text string")).collect()} == want


def test_empty(docs):
    assert spelling.spelling_variants(docs[0].limit(0), misspelt=199).count() == 0
