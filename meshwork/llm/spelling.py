"""Spelling variants by anagram hashing: keys that differ by one letter's value, then the order of letters."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, materialize, slices
from meshwork.store import Rounds

#: The letters of a word, after lower-casing A-Z.
LETTERS = "a-zÀ-ÿ"
#: The power that a letter's code point is raised to.
POWER = 5
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: Words that a task counts before it sends its counts on; code points of a text that are searched at once.
HELD, CHUNK = 200_000, 1 << 20
#: Entries of a bucket that meet each other; in larger ones they meet by what is left of the word without the letter.
CROWD = 64

_VALUE = {chr(c): c**POWER for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]}
_OTHER = re.compile(f"[^{LETTERS}]")
_HALF, _FULL = 1 << 63, 1 << 64


def _chunks(text: str) -> Iterator[str]:
    """The text in chunks that end between words."""
    at = 0
    while len(text) - at > CHUNK:
        found = _OTHER.search(text, at + CHUNK)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def vocabulary(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, misspelt: int | None = None) -> DataFrame:
    """word and n of the words of at least ``least_length`` letters that occur ``least_count`` times or more in all texts.

    A word is a longest run of A-Z, a-z and U+00C0 to U+00FF, lower-cased in A-Z.
    With ``misspelt`` a run loses a letter where the crc32 of ``id:run`` is a
    multiple of that number, namely its letter number crc32 modulo its length; what
    is left is the word. A null id counts as the empty text. Null and empty texts
    have no words; rows that repeat count each; texts of any length are read chunk
    by chunk. Each task sums its words, then Spark the tasks' sums.
    """
    runs = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        send = lambda: pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], names=["word", "n"])
        for batch in slices(batches, 256):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                begun = zlib.crc32(f"{doc}:".encode())
                for chunk in _chunks(text.encode().lower().decode()):  # bytes are lower-cased in A-Z alone
                    found = runs.findall(chunk)
                    if misspelt is None:
                        total.update(found)
                    else:
                        for word, n in Counter(found).items():
                            h = zlib.crc32(word.encode(), begun)
                            if h % misspelt == 0:
                                word = word[: h % len(word)] + word[h % len(word) + 1 :]
                                if len(word) < least_length:
                                    continue
                            total[word] += n
                    if len(total) > HELD:
                        yield send()
                        total.clear()
        yield send()

    rows = docs.filter(F.col(text_col).isNotNull()).select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    return arrow_map(rows, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def anagram_key(word: str) -> int:
    """The sum of its letters' powers."""
    return sum(map(_VALUE.__getitem__, word))


def _signed(x: int) -> int:
    x %= _FULL
    return x - _FULL if x >= _HALF else x


def entries(words: DataFrame) -> DataFrame:
    """key, tag, word, letter: under each key, once for either end of the word, the word itself (letter is null) and the word less each letter.

    Two words that differ by an exchange agree in key once either has lost its own
    letter, those that differ by an added one once the longer has lost it. The
    letters before the difference or those behind it are half of the others or
    more; the tag holds that half and its end, so that few anagrams share a bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            for part in slices(iter([batch]), 2048, 1 << 18):
                key, tag, word, letter = [], [], [], []
                for w in part.column(0).to_pylist():
                    whole = anagram_key(w)
                    for end in (0, 1):
                        n = (len(w) + 1) // 2
                        key.append(_signed(whole)), tag.append(zlib.crc32((w[-n:] if end else w[:n]).encode(), end)), word.append(w), letter.append(None)
                        n = len(w) // 2  # half of one letter less, rounded up
                        side = zlib.crc32((w[len(w) - n :] if end else w[:n]).encode(), end)
                        for x in sorted(set(w[: len(w) - n] if end else w[n:])):
                            key.append(_signed(whole - _VALUE[x])), tag.append(side), word.append(w), letter.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(tag, pa.int64()), pa.array(word, pa.string()), pa.array(letter, pa.string())], names=["key", "tag", "word", "letter"])

    return arrow_map(words.select("word"), run, "key long, tag long, word string, letter string")


def _rests(crowded: DataFrame) -> DataFrame:
    """key, tag, word, letter and rest, a hash of the word without the letter, for each place that the letter has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048, 1 << 18):
            row, rest = [], []
            for k, (w, x) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                codes = np.frombuffer(w.encode("utf-32-le"), np.uint32).astype(np.uint64)
                with np.errstate(over="ignore"):
                    up = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(codes), np.uint64(0xD1342543DE82EF95))])
                    before = np.r_[np.uint64(0), np.cumsum(codes * up[:-1])]
                    behind = before[-1] - before
                    less = [before[-1]] if x is None else [before[i] + behind[i + 1] * np.uint64(pow(0xD1342543DE82EF95, -1, _FULL)) for i in np.flatnonzero(codes == ord(x))]
                row += [k] * len(less)
                rest += [int(v) for v in less]
            out = batch.take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.array(rest, np.uint64).view(np.int64))], names=[*out.schema.names, "rest"])

    return arrow_map(crowded, run, "key long, tag long, word string, letter string, rest long")


def near_pairs(words: DataFrame, *, crowd: int = CROWD) -> DataFrame:
    """a, b: each pair of different words, a before b, that one inserted, deleted or replaced letter makes equal.

    ``words`` has one row a word (column word). Entries with one key and tag meet
    and are verified letter by letter. Buckets of more than ``crowd`` entries
    aren't compared whole: there only those meet that are equal without the letter,
    which an alphabet of 90 letters bounds.
    """
    every = materialize(entries(words), "spelling-entries")
    many = materialize(every.groupBy("key", "tag").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > crowd).select("key", "tag"), "spelling-crowds")
    near = F.levenshtein("a", "b", 1) == 1

    def met(left: DataFrame, keys: list[str]) -> DataFrame:
        a = left.select(*keys, F.col("word").alias("a"), F.col("letter").isNull().alias("whole"))
        b = left.select(*keys, F.col("word").alias("b"), F.col("letter").isNull().alias("b_whole"))
        return a.join(b, keys).filter((F.col("a") < F.col("b")) & ~(F.col("whole") & F.col("b_whole")) & near).select("a", "b")

    small = met(every.join(many, ["key", "tag"], "left_anti"), ["key", "tag"])
    large = met(_rests(every.join(many, ["key", "tag"], "left_semi")), ["key", "tag", "rest"])
    return small.unionByName(large).distinct()


def variant_groups(words: DataFrame, *, ratio: int = RATIO, crowd: int = CROWD) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``words`` (word, n; one row a word).

    Two words are near if one inserted, deleted or replaced letter makes them
    equal. A word's form is its near word of the largest n (of equal ones the first
    in code-point order) if that is at least ``ratio`` times the word's own, else
    null; the root is where forms lead to, the word itself without a form. As n
    grows along forms, they don't lead in circles. An empty table gives no rows.
    """
    words = materialize(words.select("word", "n"), "spelling-words")
    pairs = materialize(near_pairs(words, crowd=crowd), "spelling-pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    best = both.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy(F.col("a").alias("word")).agg(F.min(F.struct((-F.col("n")).alias("less"), F.col("b").alias("form"))).alias("best"), F.count(F.lit(1)).alias("n_near"))
    fits = -F.col("best.less") >= F.col("n") * ratio
    found = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    found = materialize(found, "spelling-forms")
    rounds = Rounds()
    lead = rounds.cut(found.filter("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = lead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = rounds.cut(lead.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots-odd")
        if after.filter("moved").isEmpty():
            break
        lead = rounds.cut(after.select("word", "root"), "spelling-roots")
    return found.join(lead, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, misspelt: int | None = None) -> DataFrame:
    """The variant groups of the words of all texts; see ``vocabulary`` and ``variant_groups``."""
    return variant_groups(vocabulary(docs, id_col=id_col, text_col=text_col, least_length=least_length, least_count=least_count, misspelt=misspelt), ratio=ratio)
