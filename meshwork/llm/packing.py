"""Best-fit packing of tokenised documents by the sum-of-squares rule."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, materialize, slices

CAPACITY = 4096
#: Pieces that one task packs together.
GROUP = 2048
#: Open sequences of a first-round group go to the second round if they miss more tokens than this.
SLACK = 8

PIECES = "piece int, start long, length long, ids_crc32 long"


_LATIN = [chr(i) for i in range(0x180)]
_L, _N = ("".join(re.escape(c) for c in _LATIN if unicodedata.category(c)[0] == kind) for kind in "LN")


class CachedEncoder:
    """Token ids, as little-endian 32-bit words, of texts under a lower-casing word BPE.

    Texts of Latin letters up to U+017F part into words and signs as the
    tokenizer's own pattern parts them, and each distinct one meets the BPE model
    once. Other texts, and those with the name of a special token, go through the
    whole tokenizer.
    """

    #: Distinct words that a worker remembers at most: the first it meets, so the frequent ones.
    MOST = 400_000
    WORDS = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^\s{_L}{_N}]+")
    OTHER = re.compile("[^\x00-\x1b\x20-\u017f]|\u0130|<\\|")

    def __init__(self, path: str, end_id: int) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        bare = Tokenizer(whole.model)
        bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        model, most = whole.model, self.MOST

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = [t.id for t in model.tokenize(word)] if word.isascii() else bare.encode(word, add_special_tokens=False).ids
                coded = np.array(ids, dtype="<u4").tobytes()
                if len(self) < most:
                    self[word] = coded
                return coded

        self.whole, self.known, self.end = whole, Words(), np.uint32(end_id).tobytes()

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if self.OTHER.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() + self.end
        return b"".join(map(self.known.__getitem__, self.WORDS.findall(text.lower()))) + self.end


@lru_cache(maxsize=2)
def encoder_of(path: str, end_id: int) -> CachedEncoder:
    """The worker's encoder: it and what it remembers outlive a task."""
    return CachedEncoder(path, end_id)


def tokenize(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document: doc_id, piece, start, length, ids_crc32.

    Null counts as empty: its one piece is the end id. Only documents of more than
    ``capacity`` ids are cut, into full pieces and a rest. Ids of any type pass
    through, null ones too; repeated rows give pieces of their own; an empty table
    gives none; other columns are ignored.
    """
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder_of(path, end_id)
        for batch in slices(batches, 512):
            out: list[tuple] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = encode(text)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    out.append((row, k, at // 4, len(own) // 4, zlib.crc32(own)))
            rows, *columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *(pa.array(x, t) for x, t in zip(columns, kinds, strict=True))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = dict(docs.dtypes)[id_col]
    return arrow_map(docs.select(F.col(id_col).alias("doc_id"), text_col), run, f"doc_id {kind}, {PIECES}")


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, int]:
    """(bin, offset) of each item and the number of bins.

    An item goes to the open bin, or a new one, whose choice leaves the sum of the
    squared numbers of open bins per residual gap smallest; of equal choices to
    that with the least gap.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; full and new ones don't count
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    where, offset = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    bins = 0
    for k, size in enumerate(lengths.tolist()):
        gap = capacity
        if size < capacity:
            change = count[: capacity - size + 1] - count[size:]  # half the growth of the sum, if a bin of gap size, size + 1, ... is taken
            change[-1] += 1  # a new bin leaves no gap behind
            change[0] -= 1 if count[size] else 0  # a bin that is filled is open no longer
            usable = count[size:] > 0
            usable[-1] = True
            change[~usable] = np.iinfo(np.int64).max
            gap = size + int(change.argmin())
        if gap == capacity:
            where[k], offset[k] = bins, 0
            chosen, bins = bins, bins + 1
        else:
            chosen = waiting[gap].pop()
            count[gap] -= 1
            where[k], offset[k] = chosen, capacity - gap
        if left := gap - size:
            waiting[left].append(chosen)
            count[left] += 1
    return where, offset, bins


_PLACED = PIECES + ", tag long, grp long, bin long, offset long, gap long"


def _pack(batches: Iterator[pa.RecordBatch], capacity: int) -> Iterator[pa.RecordBatch]:
    """Packs each run of rows with one ``grp``, longest first as they come; holds one run at a time."""
    kept: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        run = pa.Table.from_batches(kept).combine_chunks()
        size = run["length"].to_numpy()
        where, offset, bins = sum_of_squares(size, capacity)
        gap = capacity - np.bincount(where, weights=size, minlength=bins).astype(np.int64)[where]
        for name, x in (("bin", where), ("offset", offset), ("gap", gap)):
            run = run.append_column(name, pa.array(x, pa.int64()))
        return run.to_batches()[0]

    for batch in batches:
        grp = batch.column("grp").to_numpy()
        edges = [0, *(np.flatnonzero(grp[1:] != grp[:-1]) + 1).tolist(), len(grp)]
        for a, b in zip(edges, edges[1:], strict=False):
            if a == b:
                continue
            if kept and kept[0].column("grp")[0].as_py() != grp[a]:
                yield packed()
                kept = []
            kept.append(batch.slice(a, b - a))
    if kept:
        yield packed()


def _round(pieces: DataFrame, rows: int, capacity: int) -> DataFrame:
    groups = max(1, -(-rows // GROUP))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("tag"), F.lit(groups))).repartition("grp").sortWithinPartitions("grp", F.desc("length"), "tag")
    kind = dict(pieces.dtypes)["doc_id"]
    return dealt.mapInArrow(lambda batches: _pack(batches, capacity), f"doc_id {kind}, {_PLACED}")


def pack(pieces: DataFrame, *, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Pieces (of ``tokenize``) fall by chance into groups of about 2048, and each
    group packs its own, longest first, in one task. Sequences that stay open
    there by more than a few tokens are dissolved and packed again, in groups of
    as many, so what stays open in the end doesn't grow with the number of groups.
    Every piece is placed; equal pieces are separate; an empty table gives no rows.
    """
    pieces = materialize(pieces.withColumn("tag", F.monotonically_increasing_id()), "pack-pieces")
    rows = pieces.count()
    first = _round(pieces, rows, capacity).withColumn("round", F.lit(0))
    if rows > GROUP:
        first = materialize(first, "pack-first")
        again = first.filter(F.col("gap") > SLACK).select(pieces.columns)
        first = first.filter(F.col("gap") <= SLACK).unionByName(_round(again, again.count(), capacity).withColumn("round", F.lit(1)))
    number = F.shiftleft(F.col("grp") * 2 + F.col("round"), 24) + F.col("bin")
    return first.select("doc_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset")
