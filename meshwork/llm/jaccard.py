"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct five-word shingles. Two documents link when
100 * |A & B| >= 80 * |A | B|; the components of the links are exact.

Sketches. A shingle that both sets hold cancels out when shingles are XOR-ed, so
the number of places in which two parity sketches differ is at most the size of
the symmetric difference; for linked sets of a and b shingles that is at most
(a + b) / 9. Each document has two kinds. The block sketch of its size band, the
sizes from 2**j to 2**(j+1)-1, has p(j) blocks of 64 bits, and each shingle is
XOR-ed into one. The bit sketch has 2 to 4 bits a shingle, a power of two, and
each shingle flips one bit; folding its halves onto each other gives the sketch
of half the bits, so sketches of neighbouring sizes compare.

Pigeonhole. Blocks have one order that looks at their content only: those with
many shingles that are rare in a sample come first. A document takes part with
its first D + 1 blocks, D the largest (a + b) / 9 over all b it may link with. Of
two linked documents at most D blocks differ, so the first block in which they
agree stands among the first D + 1 of both: an equi-join on (band, block,
content) finds every link. A document that may link into the next band takes part
there, too.

Buckets. A bucket, the documents that share a block, gives its pairs if it is
small. In a large one each member pairs with the smallest id; once these pairs
are verified and their components known, buckets whose members lie in several
components come together by their smallest id, the hub, as copies of a text share
many buckets. The members outside the hub's main component are compared with all
of its members, a bounded number of both in a task: bit sketches rule pairs out,
whole sets decide, and a task gives only links that join components which it
hasn't joined yet. Members of one component need no comparing, so no bucket
expands into all pairs, and no link between components is lost.

Local combining. Each task first merges equal sets and large buckets among the
documents it holds, so a hot block reaches the shuffle as one row for each few
thousand documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, materialize, materialize_filtered, picked, slices
from meshwork.llm.components import components
from meshwork.llm.hashgrams import mix64
from meshwork.llm.shingles import shingle_set

#: A bucket of more members gives a star instead of all pairs.
SMALL = 12
#: Documents sampled for the order of blocks (results do not depend on it), and the share of them from which a shingle is common.
SAMPLE_DOCS, COMMON = 4000, 0.002
#: Common shingles that go to the tasks at most, 8 bytes each: the commonest (results do not depend on them).
MOST_COMMON = 1 << 19
#: Documents of a bucket, and shingles of them, that one task holds, about.
HELD, HELD_SHINGLES = 512, 1 << 20

#: Stands for a missing id; such rows are no nodes.
_NO_ID = -(1 << 63)

#: Kinds of rows that the sketch step gives.
_ENTRY, _HUB, _MEMBER, _EQUAL, _SIZE = range(5)


def band(n: int) -> int:
    return n.bit_length() - 1


def blocks_of(j: int) -> int:
    """Blocks of a sketch in band j: about 3 to 1.5 shingles a block."""
    return (6 << j) // 10 + 8


def places(n: int) -> list[tuple[int, int]]:
    """(band, blocks to take part with) of a set of n shingles."""
    top, most = (2 << band(n)) - 1, n * 5 // 4
    out = [(band(n), (n + min(top, most)) // 9 + 1)]
    if most > top:
        out.append((band(n) + 1, (n + most) // 9 + 1))
    return out


def signatures(tokens: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The 64-bit signatures of the blocks that a set takes part with, in all its bands."""
    rare = np.ones(len(tokens), dtype=np.int64)
    if len(common):
        rare[common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens] = 0
    out = []
    for j, take in places(len(tokens)):
        p = blocks_of(j)
        seeded = mix64(tokens ^ np.uint64((j + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        block = ((seeded >> np.uint64(32)) * np.uint64(p)) >> np.uint64(32)
        order = np.argsort(block, kind="stable")
        block = block[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        content = np.zeros(p, dtype=np.uint64)
        weight = np.zeros(p, dtype=np.int64)
        content[block[first]] = np.bitwise_xor.reduceat(mix64(tokens)[order], first)
        weight[block[first]] = np.add.reduceat(rare[order] * 4096 + 1, first)
        weight = np.minimum(weight >> 12, 7) * 8 + np.minimum(weight & 4095, 7)
        sign = mix64(content ^ mix64((np.arange(p, dtype=np.uint64) << np.uint64(8)) + np.uint64(j)))
        out.append(sign[np.lexsort((sign, -weight))[:take]])
    return np.concatenate(out)


def bit_sketch(tokens: np.ndarray) -> bytes:
    """The parity of the shingles at each of 2n to 4n places."""
    bits = max(64, 1 << (2 * len(tokens) - 1).bit_length())
    at, odd = np.unique(mix64(tokens) & np.uint64(bits - 1), return_counts=True)
    out = np.zeros(bits, dtype=np.uint8)
    out[at[odd % 2 == 1].astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """The sketch of ``size`` bytes, as 64-bit words."""
    words = np.frombuffer(sketch, dtype=np.uint64)
    while len(words) * 8 > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def may_link(n: int, sketches: np.ndarray, sizes: np.ndarray, own: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets (a row of words each, all folded alike, and size) may link with one of n shingles, as sketches and sizes say."""
    low, high = np.minimum(sizes, n), np.maximum(sizes, n)
    differ = np.bitwise_count(sketches ^ own[None, :]).sum(axis=1, dtype=np.int64)
    return (100 * low >= percent * high) & (differ * (100 + percent) <= (sizes + n) * (100 - percent))


def _rows(kind: int, key: np.ndarray, doc: np.ndarray, via: np.ndarray | None = None, extra: list[bytes] | None = None) -> pa.RecordBatch:
    n = len(key)
    columns = [pa.array(key.view(np.int64)), pa.array(np.full(n, kind, np.int8)), pa.array(doc), pa.nulls(n, pa.int64()) if via is None else pa.array(via), pa.nulls(n, pa.binary()) if extra is None else pa.array(extra, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "kind", "doc", "via", "extra"])


_SCHEMA = "key long, kind byte, doc long, via long, extra binary"


def _runs(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, np.int64)
    return first, np.diff(np.r_[first, len(sig)])


def _members(sig: np.ndarray, doc: np.ndarray, via: np.ndarray) -> pa.RecordBatch:
    """Memberships; their key is dealt by chance, the bucket's own is the extra."""
    key = mix64(sig.view(np.uint64) ^ mix64(doc.astype(np.uint64)))
    return _rows(_MEMBER, key, doc, via, [x.tobytes() for x in sig.view(np.int64)])


def _sketch(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 4096, 8 << 20):
        docs = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        sizes, bits, equal, alike, sigs, owner = np.zeros(len(docs), np.int64), [], [], {}, [], []
        for k, raw in enumerate(batch.column(1).to_pylist()):
            tokens = shingle_set(raw)
            sizes[k] = len(tokens)
            if docs[k] == _NO_ID:
                bits.append(None)
                continue
            key = tokens.tobytes() if len(tokens) <= 4 else (len(tokens), int(tokens.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix64(tokens))))
            at = alike.setdefault(key, k)
            bits.append(bit_sketch(tokens) if at == k and len(tokens) else None)
            if not len(tokens):
                continue
            if at != k:
                equal.append((docs[k], docs[at]))
                continue
            sigs.append(signatures(tokens, common))
            owner.append(np.full(len(sigs[-1]), docs[k]))
        yield _rows(_SIZE, mix64(docs.view(np.uint64)), docs, sizes, bits)
        if equal:
            a, b = (np.array(x) for x in zip(*equal, strict=True))
            yield _rows(_EQUAL, mix64(a.view(np.uint64)), a, b)
        if not sigs:
            continue
        sig, doc = np.concatenate(sigs), np.concatenate(owner)
        order = np.argsort(sig)
        sig, doc = sig[order], doc[order]
        first, count = _runs(sig)
        hub = np.minimum.reduceat(doc, first)
        large = np.repeat(count > SMALL, count)
        yield _rows(_ENTRY, sig[~large], doc[~large])
        if large.any():
            yield _rows(_HUB, sig[first][count > SMALL], hub[count > SMALL])
            yield _members(sig[large], doc[large], np.repeat(hub, count)[large])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (as _ENTRY: doc, via) and memberships (_MEMBER) of all buckets; other rows pass.

    Rows come sorted by key; a bucket that a batch cuts is carried into the next.
    """
    keep: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))

    def paired(sig: np.ndarray, doc: np.ndarray, hub: np.ndarray) -> Iterator[pa.RecordBatch]:
        first, count = _runs(sig)
        if not len(first):
            return
        large = (count > SMALL) | np.logical_or.reduceat(hub, first)
        wide = np.repeat(large, count)
        if wide.any():
            yield _members(sig[wide], doc[wide], np.repeat(np.minimum.reduceat(doc, first), count)[wide])
        pairs = []
        for gap in range(1, SMALL):
            ok = ~large & (count > gap)
            if not ok.any():
                break
            at = np.concatenate([np.arange(s, s + c - gap) for s, c in zip(first[ok], count[ok], strict=True)])
            pairs.append(np.stack([np.maximum(doc[at], doc[at + gap]), np.minimum(doc[at], doc[at + gap])]))
        if pairs:
            a, b = np.unique(np.concatenate(pairs, axis=1), axis=1)
            yield _rows(_ENTRY, a, a, b)

    for batch in batches:
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        index = kind <= _HUB
        if not index.all():
            yield batch.filter(pa.array(~index))
        sig, doc = (np.r_[k, batch.column(c).to_numpy(zero_copy_only=False)[index]] for k, c in zip(keep, (0, 2), strict=False))
        hub = np.r_[keep[2], kind[index] == _HUB]
        if not len(sig):
            continue
        last = np.searchsorted(sig, sig[-1])
        yield from paired(sig[:last], doc[:last], hub[:last])
        keep = (sig[last:], doc[last:], hub[last:])
    yield from paired(*keep)


def _common(docs: DataFrame) -> np.ndarray:
    """Hashes of the shingles in a share of the sampled documents, the commonest MOST_COMMON of them."""
    rows = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, rows))
    some = docs.filter(picked(share, "doc")) if share < 1 else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            for raw in batch.column(1).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(raw).view(np.int64))], names=["t"])

    least = max(3, int(COMMON * min(rows, SAMPLE_DOCS)))
    found = arrow_map(some, run, "t long").groupBy("t").count().filter(F.col("count") >= least).orderBy(F.desc("count"), "t").limit(MOST_COMMON).select("t").toArrow()
    return np.sort(found["t"].to_numpy().view(np.uint64))


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted distinct sets have 100 * |A & B| >= percent * |A | B|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def _with_texts(dealt: DataFrame, docs: DataFrame) -> DataFrame:
    """The written rows ``dealt`` (doc, ...) with their texts. Spark filters a join's left side first, by a right one under a condition; this one holds for all ids."""
    return docs.join(dealt.filter(F.col("doc") > _NO_ID), "doc")


def verified(pairs: DataFrame, docs: DataFrame, percent: int = 80) -> DataFrame:
    """The pairs (a, b) of ids whose whole sets link, of ids with several texts any two; docs: doc, raw.

    Pairs are dealt by b in parts of about HELD; b's text goes to each part once,
    before the texts of its partners, which stream. One join gives the texts to
    both, so that texts pass through a shuffle once.
    """
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("parts"))
    partner = pairs.join(parts, "b").select(F.col("a").alias("doc"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), "a")
    hub = parts.select(F.col("b").alias("doc"), "b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("a"))
    dealt = _with_texts(materialize(partner.unionByName(hub), "jaccard-dealt"), docs).select("b", "part", "a", "raw")
    dealt = dealt.repartition("b", "part").sortWithinPartitions("b", "part", F.asc_nulls_first("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, own = None, []
        for batch in slices(batches, 1024):
            ok = []
            for b, part, a, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens = shingle_set(raw)
                if (b, part) != group:
                    group, own = (b, part), []
                if a is None and not any(np.array_equal(tokens, x) for x in own):
                    own.append(tokens)
                ok.append(a is not None and any(linked(tokens, x, percent) for x in own))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return arrow_map(dealt, run, "a long, b long")


def _ruled_in(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bit sketches allow a link; sketches: doc, n, bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            na, nb = (batch.column(i).to_numpy() for i in (2, 3))
            a, b = (batch.column(i).to_pylist() for i in (4, 5))
            ok = [bool(may_link(int(n), folded(y, w := min(len(x), len(y)))[None, :], m[None], folded(x, w), percent)[0]) for n, m, x, y in zip(na, nb, a, b, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    side = lambda c: sketches.select(F.col("doc").alias(c), F.col("n").alias(f"n_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b")
    return arrow_map(both, run, "a long, b long")


class _Held:
    """The documents of one hub that a task holds, and the components that links join there."""

    def __init__(self) -> None:
        self.docs: list[tuple[int, int, np.ndarray]] = []
        self.sketches: list[bytes] = []
        self.sizes = np.zeros(0, np.int64)
        self.matrix: dict[int, np.ndarray] = {}
        self.root: dict[int, int] = {}

    def find(self, c: int) -> int:
        while (up := self.root.get(c, c)) != c:
            self.root[c] = c = self.root.get(up, up)
        return c

    def links(self, doc: int, component: int, tokens: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
        """The links of a document that passes with held ones, unless links found here join their components already."""
        if not self.docs:
            return
        if not len(self.sizes):
            self.sketches = [bit_sketch(t) for _, _, t in self.docs]
            self.sizes = np.array([len(t) for _, _, t in self.docs])
        own = bit_sketch(tokens)
        width = min(len(own), *map(len, self.sketches))
        if width not in self.matrix:
            self.matrix[width] = np.stack([folded(x, width) for x in self.sketches])
        for k in np.flatnonzero(may_link(len(tokens), self.matrix[width], self.sizes, folded(own, width), percent)):
            other, theirs, set_ = self.docs[k]
            x, y = self.find(theirs), self.find(component)
            if x != y and linked(tokens, set_, percent):
                self.root[max(x, y)] = min(x, y)
                yield max(doc, other), min(doc, other)


def _across(open_: DataFrame, sketches: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of one hub's documents that join all components which links between them join; open_: hub, doc, component.

    Documents outside the hub's main component are dealt into parts of about HELD
    documents, all of the hub's into cuts of as many; a task holds a part's and
    lets a cut's pass. Sketches rule pairs out, whole sets decide. Of the links a
    task gives those that join components it hasn't joined yet, so their number
    doesn't grow with the pairs.
    """
    sized = open_.join(sketches.select("doc", "n"), "doc")
    per = sized.groupBy("hub", "component").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    main = per.groupBy("hub").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.sum("rows").alias("rows"), (F.sum("rows") - F.max("rows")).alias("outside"), F.sum("n").alias("n"))
    many = lambda rows: F.ceil(F.greatest(F.col(rows) / HELD, F.col(rows) / F.col("rows") * F.col("n") / HELD_SHINGLES)).cast("int")
    main = materialize(main.select("hub", "main", many("outside").alias("parts"), many("rows").alias("cuts")), "jaccard-hubs")  # a table, as open buckets are
    rows = open_.join(main, "hub")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = rows.filter("component <> main").select("hub", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("part"), upto("cuts").alias("cut"), F.lit(0).alias("passing"), "doc", "component")
    passing = rows.select("hub", upto("parts").alias("part"), F.pmod(F.xxhash64("doc", F.lit(1)), F.col("cuts")).cast("int").alias("cut"), F.lit(1).alias("passing"), "doc", "component")
    dealt = _with_texts(materialize(held.unionByName(passing), "jaccard-across"), docs)
    dealt = dealt.select("hub", "part", "cut", "passing", "doc", "component", "raw").repartition("hub", "part", "cut").sortWithinPartitions("hub", "part", "cut", "passing", "doc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, _Held()
        for batch in slices(batches, 1024):
            found: list[tuple[int, int]] = []
            for hub, part, cut, passing, doc, component, raw in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if (hub, part, cut) != group:
                    group, held = (hub, part, cut), _Held()
                if passing:
                    found += held.links(doc, component, shingle_set(raw), percent)
                else:
                    held.docs.append((doc, component, shingle_set(raw)))
            if found:
                a, b = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return arrow_map(dealt, run, "a long, b long")


def near_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sizes, labels): doc and n_shingles of every row; node and component of every linked document.

    A null text is empty; empty sets link with nothing. Rows that repeat an id are
    one node. The component is the smallest id that links reach. Ids are whole
    numbers; others are refused.
    """
    if dict(docs.dtypes)[id_col] not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must hold whole numbers")
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    nodes = docs.filter(F.col("doc").isNotNull())
    common = docs.sparkSession.sparkContext.broadcast(_common(nodes))
    sketched = arrow_map(docs.select(F.coalesce("doc", F.lit(_NO_ID)).alias("doc"), "raw"), lambda b: _sketch(b, common.value), _SCHEMA)
    dealt = sketched.repartition("key").sortWithinPartitions("key")
    met = materialize(dealt.mapInArrow(_meet, _SCHEMA), "jaccard-candidates")
    rows = met.filter(F.col("kind") == _SIZE)
    sizes = rows.select(F.when(F.col("doc") > _NO_ID, F.col("doc")).alias("doc"), F.col("via").alias("n_shingles"))
    found = met.filter((F.col("doc") != F.col("via")) & (F.col("doc") > _NO_ID))
    ends = (F.greatest("doc", "via").alias("a"), F.least("doc", "via").alias("b"))
    sketches = rows.filter(F.col("extra").isNotNull() & (F.col("doc") > _NO_ID)).select("doc", F.col("via").alias("n"), F.col("extra").alias("bits"))
    equal = found.filter(F.col("kind") == _EQUAL).select(*ends).distinct()
    pairs = found.filter(F.col("kind").isin(_ENTRY, _MEMBER)).select(*ends).distinct()
    likely = materialize(_ruled_in(pairs, sketches, percent), "jaccard-likely")
    links = materialize_filtered(verified(likely, nodes, percent).unionByName(equal), "jaccard-links")
    labels = components(links)
    members = met.filter((F.col("kind") == _MEMBER) & (F.col("doc") > _NO_ID)).select(F.col("extra").alias("sig"), "doc").distinct()
    members = members.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    members = materialize(members, "jaccard-buckets")
    spread = members.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("doc").alias("hub")).filter("low <> high").select("sig", "hub")
    spread = materialize(spread, "jaccard-open")  # a table, so that the join's sides are both shuffles, which adaptive execution splits
    if spread.isEmpty():
        return sizes, labels
    open_ = materialize(members.join(spread, "sig").select("hub", "doc", "component").distinct(), "jaccard-members")
    more = materialize_filtered(_across(open_, sketches, nodes, percent), "jaccard-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more))
    return sizes, labels


def near_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row.

    Documents without words have 0 shingles and stand alone. A row without an id
    is no node: its component is null. An empty table gives no rows.
    """
    sizes, labels = near_links(docs, id_col=id_col, text_col=text_col, percent=percent)
    return sizes.join(labels.withColumnRenamed("node", "doc"), "doc", "left").select(F.col("doc").alias("doc_id"), "n_shingles", F.coalesce("component", "doc").alias("component_id"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The documents whose id is their component's smallest, with all their columns, and all rows without an id.

    Rows that repeat an id stay or go together, documents without words stay, and
    an empty table gives no rows.
    """
    _, labels = near_links(docs, id_col=id_col, text_col=text_col, percent=percent)
    gone = labels.filter("node <> component").select(F.col("node").alias(id_col))
    return docs.join(gone, id_col, "left_anti").select(docs.columns)
