"""Benchmark decontamination: a broadcast hash set of normalised word windows, scanned over whole texts, verified, and cut out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, materialize, slices
from meshwork.llm.hashgrams import mix64, span_hashes
from meshwork.store import Rounds

WINDOW = 10
#: Bytes of a text that are split into words at once; a word counts with so many bytes in its hash.
BLOCK = 1 << 22
#: What one broadcast may weigh: each word of the benchmark weighs its bytes and WORD_BYTES. More goes in further passes.
PART_BYTES, WORD_BYTES = 32 << 20, 64
#: Words of an item that travel together; pieces of an item overlap, so that each window lies within one.
PIECE = 4096
#: Windows whose bytes are compared at once.
VERIFIED = 1 << 15

_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_VALUE = mix64(np.arange(7001, 7257, dtype=np.uint64))[_FOLD]
_ODD = mix64(np.arange(9001, 9001 + WINDOW, dtype=np.uint64)) | np.uint64(1)
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

Words = tuple[np.ndarray, np.ndarray, np.ndarray]


def _words(data: np.ndarray, firsts: np.ndarray, at: int, end: int) -> Words:
    """Starts, ends and hashes of the words in ``data[at:end]``; no word crosses a place in ``firsts``."""
    inside = _WORD[data[at:end]]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edge = firsts[(firsts > at) & (firsts < end)] - at
    begin[edge] = inside[edge]
    stop[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts + at, ends + at, span_hashes(_VALUE[data[at:end]], starts, ends)


def _blocks(raw: bytes) -> Iterator[Words]:
    """The words of one text, block by block; blocks end between words. A word longer than a block has the hash of its first bytes."""
    data, none, at = np.frombuffer(raw, np.uint8), np.zeros(0, np.int64), 0
    while at < len(raw):
        end = min(len(raw), at + BLOCK)
        if end < len(raw) and _WORD[data[end]]:
            gaps = np.flatnonzero(~_WORD[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                starts, _, hashes = _words(data, none, at, end)
                found = _GAP.search(raw, end)
                at = found.start() if found else len(raw)
                yield starts, np.array([at]), hashes
                continue
        yield _words(data, none, at, end)
        at = end


def _run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    run = np.zeros(max(0, n), np.uint64)
    for k in range(size if n > 0 else 0):
        run += hashes[k : k + n] * _ODD[k]
    return mix64(run + np.uint64(size))


@dataclass(frozen=True)
class Windows:
    """The distinct windows of a part of the benchmark, by hash; each has its words, for comparing, and the items that hold it."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray  # sorted
    first: np.ndarray  # number of a window's first word
    size: np.ndarray
    group: np.ndarray  # number of a window's set of items
    items: list[tuple[str, ...]]
    sieve: np.ndarray

    @staticmethod
    def of(pieces: list[tuple[str, bytes]]) -> Windows:
        """From (item, its words with a blank between): all windows of ten words; of fewer words, the one of all."""
        raw = b" ".join(p for _, p in pieces)
        data = np.frombuffer(raw, np.uint8)
        firsts = np.cumsum([0, *(len(p) + 1 for _, p in pieces)])[:-1]
        read = [*_blocks(raw)]
        starts, ends, hashes = (np.concatenate([x[k] for x in read]) if read else np.zeros(0, np.uint64 if k == 2 else np.int64) for k in range(3))
        owner = np.searchsorted(firsts, starts, "right") - 1
        count = np.bincount(owner, minlength=len(pieces))
        names = sorted({i for i, _ in pieces})
        number = {x: k for k, x in enumerate(names)}
        item = np.array([number[i] for i, _ in pieces], np.int64)
        rows = []
        for size in sorted({int(min(n, WINDOW)) for n in count if n}):
            run = _run_hashes(hashes, size)
            at = np.arange(len(run))
            at = at[(owner[at] == owner[at + size - 1]) & (np.minimum(count[owner[at]], WINDOW) == size)]
            rows.append((run[at], at, np.full(len(at), size), item[owner[at]]))
        h, at, size, of = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.uint64 if k == 0 else np.int64) for k in range(4))
        order = np.argsort(h, kind="stable")
        h, at, size, of = h[order], at[order], size[order], of[order]
        text = lambda k: raw[starts[at[k]] : ends[at[k] + size[k] - 1]]
        new = np.r_[True, h[1:] != h[:-1]][: len(h)]
        for k in np.flatnonzero(~new):
            new[k] = text(k) != text(k - 1)
        kind = np.cumsum(new) - 1
        pairs = np.unique(kind * max(1, len(names)) + of)
        owners = np.split(pairs % max(1, len(names)), np.flatnonzero(np.diff(pairs // max(1, len(names)))) + 1) if len(pairs) else []
        sets: dict[bytes, int] = {}
        group = np.array([sets.setdefault(x.tobytes(), len(sets)) for x in owners], np.int64)
        h, at, size = h[new], at[new], size[new]
        bits = max(12, int(16 * len(h)).bit_length())
        sieve = np.zeros(1 << bits, bool)
        sieve[h >> np.uint64(64 - bits)] = True
        return Windows(data, starts, ends, h, at, size, group, [tuple(names[i] for i in np.frombuffer(x, np.int64)) for x in sets], sieve)

    def _same(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, kind: np.ndarray, size: int) -> np.ndarray:
        """Whether the words behind ``at`` are those of the window, byte for byte."""
        out = np.zeros(len(at), bool)
        step = np.arange(size)
        for lo in range(0, len(at), VERIFIED):
            mine, theirs = (at[lo : lo + VERIFIED, None] + step), (self.first[kind[lo : lo + VERIFIED], None] + step)
            length = ends[mine] - starts[mine]
            ok = (length == self.ends[theirs] - self.starts[theirs]).all(axis=1)
            n, a, b = length[ok].ravel(), starts[mine[ok]].ravel(), self.starts[theirs[ok]].ravel()
            if len(n):
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                equal = _FOLD[data[np.repeat(a, n) + inner]] == self.data[np.repeat(b, n) + inner]
                ok[ok] = np.logical_and.reduceat(equal, (np.cumsum(n) - n)[::size])
            out[lo : lo + VERIFIED] = ok
        return out

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(number of the first word, window) of every occurrence within one owner, in the order of words."""
        found = []
        shift = np.uint64(64 - len(self.sieve).bit_length() + 1)
        for size in np.unique(self.size).tolist():
            run = _run_hashes(hashes, size)
            at = np.flatnonzero(self.sieve[run >> shift])
            if owner is not None:
                at = at[owner[at] == owner[at + size - 1]]
            kind = np.searchsorted(self.hashes, run[at])
            while len(at):
                ok = kind < len(self.hashes)
                ok[ok] = self.hashes[kind[ok]] == run[at[ok]]
                at, kind = at[ok], kind[ok]
                fits = self.size[kind] == size
                fits[fits] = self._same(data, starts, ends, at[fits], kind[fits], size)
                found.append((at[fits], kind[fits]))
                kind = kind + 1  # another window of the same hash
        at, kind = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(2))
        order = np.argsort(at, kind="stable")
        return at[order], kind[order]


def _merged(start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranges sorted by their starts as the fewest ranges, flat: start, end, start, end."""
    reach = np.maximum.accumulate(stop)
    new = np.r_[True, start[1:] > reach[:-1]]
    return np.stack([start[new], reach[np.r_[new[1:], True]]], axis=1).ravel()


def _scan(texts: pa.Array, index: Windows) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The words of each text, and of those with hits the hit ranges of words and the sets of items."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    upto = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    count, hits = np.zeros(len(texts), np.int64), {}
    if len(texts) == 1 and upto[1] - upto[0] > BLOCK:
        raw = texts[0].as_py()
        data, carry = np.frombuffer(raw, np.uint8), (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        ranges, groups = [], [np.zeros(0, np.int64)]
        for block in _blocks(raw):
            words = tuple(np.concatenate(x) for x in zip(carry, block, strict=True))
            at, kind = index.find(data, *words)
            at = at + count[0] - len(carry[0])
            ranges.append(np.stack([at, at + index.size[kind]], axis=1))
            groups.append(np.unique(index.group[kind]))
            count[0] += len(block[0])
            carry = tuple(x[len(x) - min(len(x), WINDOW - 1) :] for x in words)
        every = np.concatenate(ranges)
        if len(every):
            every = every[np.argsort(every[:, 0], kind="stable")]
            hits[0] = _merged(every[:, 0], every[:, 1]), np.unique(np.concatenate(groups))
        return count, hits
    if upto[-1] == upto[0]:
        return count, hits
    data = np.frombuffer(texts.buffers()[2], np.uint8)[upto[0] : upto[-1]]
    firsts = upto[:-1] - upto[0]
    starts, ends, hashes = _words(data, firsts, 0, len(data))
    owner = np.searchsorted(firsts, starts, "right") - 1
    count = np.bincount(owner, minlength=len(texts))
    before = np.cumsum(count) - count
    at, kind = index.find(data, starts, ends, hashes, owner)
    if len(at):
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(owner[at])) + 1):
            row = int(owner[at[part[0]]])
            own = at[part] - before[row]
            hits[row] = _merged(own, own + index.size[kind[part]]), np.unique(index.group[kind[part]])
    return count, hits


def _without(text: str, ranges: list[int]) -> str:
    """The text without the hit words and what stands between those of one range."""
    raw, keep, at = text.encode(), [], 0
    read = [x[:2] for x in _blocks(raw)]
    starts, ends = (np.concatenate([x[k] for x in read]) for k in range(2))
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        keep.append(raw[at : starts[a]])
        at = int(ends[b - 1])
    return b"".join([*keep, raw[at:]]).decode()


def _parts(benchmark: DataFrame, item_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items' words in parts that weigh ``most`` at most (one piece of an item at least)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            items, texts, sizes = [], [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = text.encode()
                low = [raw[s:e].lower() for starts, ends, _ in _blocks(raw) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                for at in range(0, max(1, len(low) - WINDOW + 1), PIECE):
                    own = low[at : at + PIECE + WINDOW - 1]
                    if own:
                        items.append(item), texts.append(b" ".join(own)), sizes.append(len(own) * WORD_BYTES)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], names=["item", "words", "size"])

    rows = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = materialize(arrow_map(rows, cut, "item string, words binary, size long").distinct(), "benchmark-pieces")
    weight = F.sum(F.col("size") + F.length("words"))
    total, rows = pieces.agg(weight, F.count(F.lit(1))).first()
    buckets = 1 if (total or 0) <= most else 2 * -(-total // most)
    while True:
        bucket = F.pmod(F.xxhash64("item", "words"), F.lit(buckets))
        sizes = pieces.groupBy(bucket.alias("bucket")).agg(weight.alias("weight"), F.count(F.lit(1)).alias("rows")).orderBy("bucket").collect() if buckets > 1 else []
        if all(r["weight"] <= most or r["rows"] == 1 for r in sizes):
            break
        buckets *= 2
    groups, room = [[]], most
    for r in sizes:
        if r["weight"] > room and groups[-1]:
            groups.append([])
            room = most
        groups[-1].append(r["bucket"])
        room -= r["weight"]
    for group in groups:
        own = pieces.filter(bucket.isin(group)) if len(groups) > 1 else pieces
        yield [(r["item"], bytes(r["words"])) for r in own.select("item", "words").collect()]


def _passes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, most: int, out: list[str], cut_text: bool) -> DataFrame:
    """``docs`` with __words, __hits (flat ranges of words) and __items, of ``out`` columns; a pass over the texts for each part of the benchmark."""
    rounds, rows = Rounds(), docs.select(*docs.columns, F.lit(0).cast("long").alias("__words"), F.lit(None).cast("array<long>").alias("__hits"), F.lit(None).cast("array<string>").alias("__items"))
    parts = _parts(benchmark, item_col, item_text_col, most)
    part = next(parts)
    while part is not None:
        after = next(parts, None)
        rows = _pass(rows, Windows.of(part), text_col, out if after is None else docs.columns, cut_text and after is None)
        if after is not None:
            rows = rounds.cut(rows, "decontam")
        part = after
    return rows


def _pass(rows: DataFrame, index: Windows, text_col: str, out: list[str], cut_text: bool) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(index)
    names = [*out, "__words", "__hits", "__items"]
    schema = rows.select(names).schema
    at, text_at, hits_at, items_at = [rows.columns.index(c) for c in out], rows.columns.index(text_col), rows.columns.index("__hits"), rows.columns.index("__items")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            count, found = _scan(batch.column(text_at), shared.value)
            hits, items = batch.column(hits_at).to_pylist(), batch.column(items_at).to_pylist()
            for k, (ranges, groups) in found.items():
                if hits[k]:
                    every = np.concatenate([np.array(hits[k]).reshape(-1, 2), ranges.reshape(-1, 2)])
                    every = every[np.argsort(every[:, 0], kind="stable")]
                    ranges = _merged(every[:, 0], every[:, 1])
                hits[k] = ranges.tolist()
                items[k] = sorted({*(items[k] or ()), *(i for g in groups for i in shared.value.items[g])})
            columns = [batch.column(c) for c in at]
            if cut_text and any(hits):
                texts = [_without(t, h) if h else t for t, h in zip(batch.column(text_at).to_pylist(), hits, strict=True)]
                columns[out.index(text_col)] = pa.array(texts, batch.column(text_at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=names)

    return arrow_map(rows, run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row for each row of ``docs``: the id, n_words, hits (array of start, end, start, end: ranges of words), items (sorted as strings).

    Words are runs of ASCII letters and digits and of code points from U+0080 on,
    lower-cased in A-Z. A window is ten consecutive words of an item, or all of an
    item that has fewer; each occurrence in a document hits its words. Windows are
    found by hash and then compared word for word. Null and empty texts have no
    words and no windows. Rows are scanned one by one: repeated ids or rows get a
    row each. Items that share an id count as one, whatever rows repeat; a null
    item id counts as the empty text. Without items nothing is hit; an empty table
    gives no rows; other columns are ignored. Texts of any length are split into
    words block by block.

    The broadcast weighs ``part_bytes`` at most: a larger benchmark goes in as many
    passes, between which the rows and what was found are written.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _passes(narrow, benchmark, "text", item_col, item_text_col, part_bytes, ["id"], False)
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return found.select(F.col("id").alias(id_col), F.col("__words").alias("n_words"), empty("__hits", "array<long>").alias("hits"), empty("__items", "array<string>").alias("items"))


def hit_words(hits: str = "hits") -> F.Column:
    """The number of words in flat ranges."""
    return F.aggregate(F.transform(hits, lambda x, k: F.when(k % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "spans", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """``docs`` with all their columns, without what the benchmark's windows hit (see ``contamination``).

    ``remove="documents"`` drops documents with a hit. ``remove="spans"`` cuts each
    range of hit words, with what stands between its words, out of the text; a
    text that is hit whole becomes what stands around its words. Null texts stay.
    Columns have any name but those that begin with two underscores.
    """
    if remove not in ("spans", "documents"):
        raise ValueError("remove is spans or documents")
    found = _passes(docs, benchmark, text_col, item_col, item_text_col, part_bytes, docs.columns, remove == "spans")
    return (found if remove == "spans" else found.filter("__hits IS NULL")).select(docs.columns)
