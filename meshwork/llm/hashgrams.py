"""Hashed n-grams and words of whole texts as numpy arrays, in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Code points hashed at once.
BLOCK = 1 << 18
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype=np.uint32)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2**64, and those of its inverse; they grow as texts do."""

    BASE = 0xD1342543DE82EF95

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            base, inverse = self.BASE, pow(self.BASE, -1, 1 << 64)
            self.up, self.down = (np.multiply.accumulate(np.r_[np.uint64(1), np.full(size - 1, b, dtype=np.uint64)]) for b in (base, inverse))
        return self.up, self.down


POWERS = Powers()


def span_sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The polynomial of each span of ``values`` (uint64), from one running sum."""
    up, down = POWERS.upto(len(values) + 1)
    run = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=run[1:])
    return (run[ends] - run[starts]) * down[starts]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values`` (uint64)."""
    return mix64(span_sums(values, starts, ends) + (ends - starts).astype(np.uint64))


def blocks(texts: list[str], reach: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of the texts in blocks: (codes, owner, live).

    Texts stand apart by zeros. A text longer than a block is cut; each piece has
    ``reach`` code points of the next behind it, which aren't live as starts.
    """
    parts: list[tuple[int, str, int]] = []
    size = 0

    def packed() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gap = "\0" * reach
        codes = np.frombuffer((gap.join(p for _, p, _ in parts) + gap).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        lens = np.array([len(p) + reach for _, p, _ in parts])
        owner = np.repeat(np.array([k for k, _, _ in parts]), lens)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lens) - lens, lens)
        return codes, owner, place < np.repeat(np.array([n for _, _, n in parts]), lens)

    for k, text in enumerate(texts):
        for at in range(0, len(text), BLOCK):
            piece = text[at : at + BLOCK + reach]
            parts.append((k, piece, min(BLOCK, len(text) - at)))
            size += len(piece)
            if size >= BLOCK:
                yield packed()
                parts, size = [], 0
    if parts:
        yield packed()


def char_grams(codes: np.ndarray, live: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashed values (``bits`` bits) of the n-grams that start at live places."""
    m = len(codes) - n + 1
    h = np.full(m, n * 0x3C6EF372 & 0xFFFFFFFF, dtype=np.uint32)
    ok = live[:m].copy()
    for i in range(n):
        c = codes[i : i + m]
        ok &= c != 0
        h = (h ^ (c * _ODD[i])) * np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(15)
    at = np.flatnonzero(ok)
    return at, (h[at] * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)


class Words:
    """Hashed words, runs without white space, of the blocks of some texts, taken in order; a word that a block's end cuts is carried on."""

    def __init__(self) -> None:
        self.owner, self.sum, self.length = -1, 0, 0  # of the word that is open
        self.before: tuple[int, int] | None = None  # owner and hash of the last word given

    def take(self, codes: np.ndarray, owner: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and 64-bit hashes of the words that end in the block."""
        gap = (codes <= 32) | (codes == 0xA0) | (codes == 0x3000) | ~live
        edge = np.flatnonzero(np.diff(np.r_[True, gap, True].astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        sums = span_sums(mix64(codes.astype(np.uint64) + np.uint64(1)), starts, ends)
        sizes, owners = (ends - starts).astype(np.uint64), owner[starts]
        if self.length:
            if len(starts) and starts[0] == 0 and owners[0] == self.owner:
                sums[0] = np.uint64((self.sum + int(sums[0]) * pow(Powers.BASE, self.length, 1 << 64)) % (1 << 64))
                sizes[0] += np.uint64(self.length)
            else:
                sums, sizes, owners = np.r_[np.uint64(self.sum), sums], np.r_[np.uint64(self.length), sizes], np.r_[self.owner, owners]
            self.length = 0
        last = int(np.flatnonzero(live)[-1]) if live.any() else -1
        if len(starts) and ends[-1] == last + 1:  # more of it may come
            self.owner, self.sum, self.length = int(owners[-1]), int(sums[-1]), int(sizes[-1])
            sums, sizes, owners = sums[:-1], sizes[:-1], owners[:-1]
        return owners, mix64(sums + sizes)

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        """The word that is still open, if any."""
        size, self.length = self.length, 0
        n = int(size > 0)
        return np.array([self.owner] * n, dtype=np.int64), mix64(np.array([(self.sum + size) % (1 << 64)] * n, dtype=np.uint64))

    def pairs(self, owners: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Owners and exclusive or of each two neighbouring words of a text, those of blocks before among them."""
        if not len(owners):
            return owners, hashes
        if self.before is not None:
            owners, hashes = np.r_[self.before[0], owners], np.r_[np.uint64(self.before[1]), hashes]
        self.before = int(owners[-1]), int(hashes[-1])
        same = owners[1:] == owners[:-1]
        return owners[1:][same], (hashes[1:] ^ hashes[:-1])[same]
