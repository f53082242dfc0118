"""SentencePiece encoding and decoding by a streaming Viterbi search.

The model at hand is of the BPE kind, whose segmentation isn't the one of the
highest score but the one that its merges leave. The search is Viterbi's all the
same: a lattice of pieces over the normalised text, walked left to right, that
keeps one backpointer for each position. A piece may follow the piece before it
only if merging the two alone would leave just these two; the segmentation that
the merges leave is the only path through the lattice all of whose neighbours may
stand so. Ids are committed, and the window cut, wherever all backpointer paths
that the longest piece still lets survive pass through one boundary.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import arrow_map, slices

SPACE = "▁"


def wire(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffers message: number, and an integer or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, message[at : at + size]
            at += size


def unlike(model: bytes) -> list[str]:
    """What of a model file this module wouldn't encode as the library does; none if it does.

    The public format holds pieces in field 1 (their kind in 3: 1 normal, 4 user
    defined, 5 unused), the trainer's settings in 2 (kind of model in 3: 1 unigram,
    2 BPE; blanks as suffix in 24), the normaliser's in 3 (table of characters in 2,
    first blank added in 3, blanks removed in 4, blanks escaped in 5), and those for
    decoding in 5.
    """
    kinds: set[int] = set()
    trainer, normal, decoding = {}, {}, {}
    for number, value in wire(model):
        if number == 1:
            kinds.add(dict(wire(value)).get(3, 1))
        elif number in (2, 3, 5):
            (trainer if number == 2 else normal if number == 3 else decoding).update(wire(value))
    tests = {
        "not a BPE model": trainer.get(3, 1) != 2,
        "user-defined pieces": 4 in kinds,
        "unused pieces": 5 in kinds,
        "blanks as suffix": bool(trainer.get(24, 0)),
        "a table of characters": bool(normal.get(2)) or bool(decoding.get(2)),
        "no blank in front": not normal.get(3, 1),
        "blanks removed": bool(normal.get(4, 1)),
        "blanks kept as they are": not normal.get(5, 1),
    }
    return [what for what, found in tests.items() if found]


def alphabets(pieces: Iterable[str]) -> list[set[str]]:
    """Sets of characters, the largest first: neighbours in a piece are of one set, so no piece reaches from one set into another."""
    sets: dict[str, set[str]] = {}
    for piece in pieces:
        merged = sets.setdefault(piece[0], {piece[0]})
        for char in piece[1:]:
            other = sets.setdefault(char, {char})
            if other is not merged:
                small, merged = sorted((merged, other), key=len)
                merged |= small
                sets.update(dict.fromkeys(small, merged))
    return sorted({id(x): x for x in sets.values()}.values(), key=len, reverse=True)


class Remembered(dict[str, bytes]):
    """What ``make`` gives for a word; the first ``most`` words of at most 32 characters are kept."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, word: str) -> bytes:
        made = self.make(word)
        if len(word) <= 32 and len(self) < self.most:
            self[word] = made
        return made


class PieceModel:
    """Pieces, scores and kinds of a SentencePiece model file, and its segmentation.

    Raises ValueError for models that would be encoded otherwise than by the
    library: kinds other than BPE, user-defined or unused pieces, normalisation.
    """

    NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
    #: Segmented words, pairs of pieces, and steps between states, that a worker remembers at most: the first it meets, so the frequent ones.
    MOST = 500_000
    #: Alphabets at whose borders texts are cut; what is left is cut as one.
    ALPHABETS = 8

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        with open(path, "rb") as file:
            if found := unlike(file.read()):
                raise ValueError(f"{path}: {', '.join(found)}")
        sp = SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.bytes = {int(p[3:-1], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        self.rank = {p: (-sp.get_score(i), i) for i, p in enumerate(self.pieces) if not special[i] and i not in self.byte_of}
        self.longest = max(map(len, self.rank), default=1)
        self.codes = {p: i.to_bytes(4, "little") for p, (_, i) in self.rank.items()}
        self.known = Remembered(self._searched, self.MOST)
        halves = {p: two for p in sorted(self.rank, key=len) if len(two := self.merged(p, 2)) == 2}
        #: Rank and halves of pieces whose merges rise in rank.
        self.split: dict[str, tuple[float, str, str]] = {}
        for p, (a, b) in halves.items():
            if all(len(x) == 1 or (x in self.split and self.split[x][0] < self.rank[p][0]) for x in (a, b)):
                self.split[p] = self.rank[p][0], a, b
        #: For each piece that merging gives back, whether it may follow others; every one may come first.
        self.after: dict[str, dict[str, bool]] = {p: {"": True} for p in halves}
        self.pairs = self.steps = 0
        #: States of the walk over a text: the longest start of a piece that ends what was read; state 0 is the empty one.
        self.starts = list(dict.fromkeys(["", *(p[:k] for p in self.after for k in range(1, len(p) + 1))]))
        self.state = {s: k for k, s in enumerate(self.starts)}
        self.next: list[dict[str, int]] = [{} for _ in self.starts]
        for k, s in enumerate(self.starts[1:], 1):
            self.next[self.state[s[:-1]]][s[-1]] = k
        #: The pieces that end at a state, longest first.
        self.ends = [tuple((len(p), p, self.after[p]) for k in range(len(s) - 1) if (p := s[k:]) in self.after) for s in self.starts]
        self.words = re.compile(self._words())

    def _words(self) -> str:
        """Texts are cut where no piece reaches over: before a run of blanks and between alphabets. All paths converge there."""
        if any(SPACE in p.lstrip(SPACE) for p in self.rank):
            return "(?s:.+)"
        found = alphabets(x for p in self.rank if len(p) > 1 and (x := p.lstrip(SPACE)))
        classes = ["".join(map(re.escape, sorted(x))) for x in (*found[: self.ALPHABETS], set().union(*found[self.ALPHABETS :])) if x]
        return "|".join([*(f"{SPACE}*[{x}]+" for x in classes), f"{SPACE}+", "(?s:.)"])

    def merged(self, text: str, least: int = 1) -> list[str]:
        """What the merges leave of a short text, or its last ``least`` parts: the pair of the best rank first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > least:
            ranked = [(self.rank[a + b][0], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.rank]
            if not ranked:
                break
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def stay(self, left: str, right: str) -> bool:
        """Whether merging both together leaves just these two, each a character or a piece that merging gives back.

        Where merges rise in rank, those at the border are undone from the last one on:
        no merge over the border may come before the one undone, or after all of them.
        """
        split, rank = self.split, self.rank
        if not all(len(x) == 1 or x in split for x in (left, right)):
            return self.merged(left + right) == [left, right]
        undone, leftmost = float("inf"), True
        while True:
            over = rank.get(left + right)
            if over and (over[0] < undone or (leftmost and over[0] == undone)):
                return False
            a, b = split.get(left), split.get(right)
            if a and (not b or a[0] > b[0]):
                undone, leftmost, left = a[0], False, a[2]
            elif b:
                undone, leftmost, right = b[0], True, b[1]
            else:
                return True

    def _may_follow(self, left: str, right: str) -> bool:
        ok = self.stay(left, right)
        if self.pairs < self.MOST:
            self.pairs += 1
            self.after[right][left] = ok
        return ok

    def _step(self, state: int, char: str) -> int:
        """The state after one more character."""
        read = self.starts[state] + char
        found = next(s for k in range(len(read) + 1) if (s := self.state.get(read[k:])) is not None)
        if self.steps < self.MOST:
            self.steps += 1
            self.next[state][char] = found
        return found

    def viterbi(self, text: str) -> Iterator[str]:
        """The pieces of ``text``, committed as soon as no later character can change them.

        back[i] is the piece that ends the segmentation of the first i characters
        of the window; back[0] is the last piece that is committed. Positions
        further back than the longest piece only matter through the boundaries that
        paths of the live ones share, so no piece reaches over the window's start.
        """
        at, back = 0, [""]  # window start; piece that ends at each boundary of the window
        ends, following = self.ends, self.next
        i = state = 0
        while at + i < len(text):
            found = char = text[at + i]
            i += 1
            came = following[state].get(char)
            state = self._step(state, char) if came is None else came
            for size, piece, after in ends[state]:
                last = back[i - size]
                ok = after.get(last)
                if ok or (ok is None and self._may_follow(last, piece)):
                    found = piece
                    break
            back.append(found)
            if i > 2 * self.longest and at + i < len(text):
                cut = self._converged(back, i)
                if cut:
                    done, k = [], cut
                    while k:
                        done.append(back[k])
                        k -= len(back[k])
                    yield from reversed(done)
                    at, i, back = at + cut, i - cut, back[cut:]
        done, k = [], i
        while k:
            done.append(back[k])
            k -= len(back[k])
        yield from reversed(done)

    def _converged(self, back: list[str], i: int) -> int:
        """The last boundary that the paths of all positions within reach of the next piece pass through."""
        live = set(range(max(1, i - self.longest + 1), i + 1))
        while len(live) > 1:
            top = max(live)
            live.discard(top)
            live.add(top - len(back[top]))
        return live.pop()

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.rank:
            return [self.rank[piece][1]]
        raw = [self.bytes.get(b) for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in raw or not raw else raw

    def _searched(self, word: str) -> bytes:
        codes = self.codes
        return b"".join([codes.get(p) or b"".join(i.to_bytes(4, "little") for i in self.ids_of(p)) for p in self.viterbi(word)])

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit words. A blank goes before a text that isn't empty; blanks become the space sign."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, map(itemgetter(0), self.words.finditer(SPACE + text.replace(" ", SPACE)))))

    def decode(self, ids: bytes) -> str:
        """The text of ids, read front to back: byte pieces gather until another piece comes; the first blank goes."""
        texts = self.decoded
        text = b"".join(map(texts.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    @property
    def decoded(self) -> list[bytes]:
        if not hasattr(self, "_decoded"):
            self._decoded = [bytes([self.byte_of[i]]) if i in self.byte_of else p.replace(SPACE, " ").encode() if p in self.rank else b"" for i, p in enumerate(self.pieces)]
        return self._decoded


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    """The worker's model: it and what it remembers outlive a task."""
    return PieceModel(path)


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", ids: bool = True, digest: bool = False) -> DataFrame:
    """id, n_ids and, as asked for, ids (array) and digests of the ids and of the text decoded again.

    A null or empty text has no ids. Texts are encoded whole; the window is
    bounded by a few times the longest piece, whatever the text. Repeated rows
    repeat their results; an empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    fields = [("id", kind), ("n_ids", "long"), *([("ids", "array<int>")] if ids else []), *([("ids_crc32", "long"), ("decoded_crc32", "long"), ("round_trip", "boolean")] if digest else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in slices(batches, 512):
            texts = batch.column(1).to_pylist()
            coded = [model.encode(t or "") for t in texts]
            columns = [batch.column(0), pa.array([len(c) // 4 for c in coded], pa.int64())]
            if ids:
                columns.append(pa.array([np.frombuffer(c, "<i4") for c in coded], pa.list_(pa.int32())))
            if digest:
                back = [model.decode(c) for c in coded]
                columns += [pa.array([zlib.crc32(c) for c in coded], pa.int64()), pa.array([zlib.crc32(b.encode("utf-8", "surrogatepass")) for b in back], pa.int64()), pa.array([b == (t or "") for b, t in zip(back, texts, strict=True)], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n, _ in fields])

    return arrow_map(docs.select(F.col(id_col).alias("id"), text_col), run, ", ".join(f"{n} {t}" for n, t in fields)).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of rows of ids; null ids, like none, give the empty text."""
    kind = dict(encoded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(path)
        for batch in slices(batches, 512):
            texts = [model.decode(np.array(x or [], dtype="<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    return arrow_map(encoded.select(F.col(id_col).alias("id"), ids_col), run, f"id {kind}, text string").withColumnRenamed("id", id_col)
