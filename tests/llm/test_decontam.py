"""Decontamination against a plain scan, on hard rows, in several passes, and of long texts in blocks."""

import hashlib
import random
import re

import numpy as np
import pytest

from meshwork.llm import decontam

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items):
    """(id, words, hit words, items) by comparing every window with every run."""
    windows = set()
    for item, text in items:
        w = words_of(text)
        n = min(10, len(w))
        windows |= {("" if item is None else str(item), tuple(w[k : k + n])) for k in range(len(w) - n + 1) if n}
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for item, run in windows:
            for k in range(len(w) - len(run) + 1):
                if tuple(w[k : k + len(run)]) == run:
                    hit |= set(range(k, k + len(run)))
                    found.add(item)
        out.append((doc, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def rows(df):
    out = []
    for r in df.collect():
        h = r["hits"]
        assert all(a < b for a, b in zip(h, h[1:], strict=False))
        out.append((r["doc_id"], r["n_words"], sum(h[1::2]) - sum(h[::2]), r["items"]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "Über", "x1", "日本", "and", "of", "Œuvre", "a", "z9z"])
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate([12, 30, 3, 1, 10, 9, 11, 40])]
    items[3] = (3, "Solitary")
    items += [(8, None), (9, ""), (10, " -- !"), (1, items[0][1]), (None, "one two three four five six seven eight nine ten eleven"), (2, items[2][1])]
    docs = []
    for k in range(60):
        text = " ".join(word() for _ in range(rng.randrange(40)))
        if k % 3 == 0:
            w = words_of(rng.choice(items)[1])
            cut = rng.randrange(len(w) + 1)
            text += " " + ", ".join(x.upper() if x.isascii() else x for x in w[: max(cut, 10)]) + "! " + text
        docs.append((k, text))
    docs += [(60, None), (61, ""), (62, "..."), (0, docs[0][1]), (63, "SOLITARY"), (64, "one-two three four five six seven eight nine ten eleven"), (None, "solitary"), (66, "x" * 9000 + " solitary")]
    return spark.createDataFrame([(*d, 0, 0) for d in docs], "doc_id long, text string, n_words int, items int"), docs, spark.createDataFrame(items, "item_id long, text string"), items


@pytest.mark.parametrize("part", [decontam.PART_BYTES, 1500])
def test_like_a_plain_scan(tables, part):
    """In one pass and in several, between which what was found is carried."""
    frame, docs, bench, items = tables
    want = plain(docs, items)
    assert sum(r[2] > 0 for r in want) > 10
    assert rows(decontam.contamination(frame, bench, part_bytes=part)) == want


def test_parts_hold_their_weight(tables):
    _, _, bench, items = tables
    parts = [*decontam._parts(bench, "item_id", "text", 1500)]
    weight = [sum(len(w) + decontam.WORD_BYTES * len(w.split(b" ")) for _, w in p) for p in parts]
    assert len(parts) > 2 and all(w <= 1500 or len(p) == 1 for w, p in zip(weight, parts, strict=True))


def test_blocks_and_pieces(spark, monkeypatch):
    """Windows that cross blocks of a text and pieces of an item, and words longer than a block."""
    rng = random.Random(7)
    long = [str(rng.randrange(50)) for _ in range(300)]
    item = [*long[40:90], "y" * 70, *long[90:120]]
    items = [(1, " ".join(item)), (2, "y" * 70), (3, " ".join(long[200:204]))]
    docs = [(1, " ".join(long)), (2, " ".join([*long[:100], *item, "y" * 71, *long])), (3, "y" * 70 + "z")]
    want = plain(docs, items)
    monkeypatch.setattr(decontam, "BLOCK", 64)
    monkeypatch.setattr(decontam, "PIECE", 8)
    index = decontam.Windows.of([(str(i), " ".join(words_of(t)).encode()) for i, t in items])
    import pyarrow as pa

    for (_doc, n, hit, found), (_, text) in zip(want, docs, strict=True):
        count, hits = decontam._scan(pa.array([text]), index)
        ranges, groups = hits.get(0, (np.zeros(0), ()))
        assert (int(count[0]), int(ranges[1::2].sum() - ranges[::2].sum()), sorted({i for g in groups for i in index.items[g]})) == (n, hit, found)


def test_same_hash(monkeypatch):
    """Windows that share one hash are told apart by their words."""
    monkeypatch.setattr(decontam, "_run_hashes", lambda h, size: np.full(max(0, len(h) - size + 1), 77, np.uint64))
    import pyarrow as pa

    items = [("a", b"one two three"), ("b", b"three two one"), ("c", b"one two three"), ("d", b"single")]
    index = decontam.Windows.of(items)
    count, hits = decontam._scan(pa.array(["zero One two, three four", "nothing here", None, "single"]), index)
    assert count.tolist() == [5, 2, 0, 1] and sorted(hits) == [0, 3]
    assert hits[0][0].tolist() == [1, 4] and {i for g in hits[0][1] for i in index.items[g]} == {"a", "c"}
    assert {i for g in hits[3][1] for i in index.items[g]} == {"d"}


def test_removal(spark, tables):
    frame, docs, bench, items = tables
    kept = decontam.decontaminate(frame, bench, remove="documents")
    assert kept.columns == frame.columns
    clean = sorted(str((r[0], r[1])) for r in plain(docs, items) if not r[2])
    assert sorted(str((r["doc_id"], len(words_of(r["text"])))) for r in kept.collect()) == clean
    cut = {}
    for part in (decontam.PART_BYTES, 1500):
        out = decontam.decontaminate(frame, bench, part_bytes=part)
        assert out.columns == frame.columns
        cut[part] = sorted(str((r["doc_id"], r["text"])) for r in out.collect())
    assert cut[1500] == cut[decontam.PART_BYTES]
    want = {r[0]: r[1] - r[2] for r in plain(docs, items)}
    for r in out.collect():
        assert len(words_of(r["text"])) == want[r["doc_id"]]
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[63] == "" and texts[64] == "" and texts[60] is None and texts[66] == "x" * 9000 + " "
    with pytest.raises(ValueError):
        decontam.decontaminate(frame, bench, remove="words")


def test_empty_tables(tables):
    frame, docs, bench, _ = tables
    assert decontam.contamination(frame.limit(0), bench).count() == 0
    assert rows(decontam.contamination(frame, bench.limit(0))) == plain(docs, [])


def test_query(spark, tmp_path, tables):
    from meshwork.llm import queries

    frame, docs, bench, items = tables
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in queries.op13_decontamination(spark, str(tmp_path)).collect()), key=str)
    want = [(d, n, hit, len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), hit > 0) for d, n, hit, found in plain(docs, items)]
    assert got == sorted(want, key=str)
