"""Sets of hashed word shingles of whole texts."""

from __future__ import annotations

import numpy as np

from meshwork.llm.hashgrams import mix64, span_hashes

WORDS = 5
#: Bytes hashed at once; a text is cut at white space.
BLOCK = 1 << 22

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]  # lower-cases A-Z
_ODD = mix64(np.arange(1001, 1001 + WORDS, dtype=np.uint64)) | np.uint64(1)
_BLANKS = (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")


def _cut(raw: bytes, at: int) -> int:
    """The end of the block that starts at ``at``: white space, or the end of the text."""
    if len(raw) - at <= BLOCK:
        return len(raw)
    end = max(raw.rfind(b, at + 1, at + BLOCK) for b in _BLANKS)
    return end if end >= 0 else min((x for b in _BLANKS if (x := raw.find(b, at + BLOCK)) >= 0), default=len(raw))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, a run without blanks and \\x09-\\x0D, after lower-casing A-Z, in order."""
    out, at = [], 0
    while at < len(raw):
        end = _cut(raw, at)
        out.append(_hashed(raw[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _hashed(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[data], True].astype(np.int8)))
    return span_hashes(_VALUE[data], edge[::2], edge[1::2])


def shingle_set(raw: bytes) -> np.ndarray:
    """The sorted distinct hashes of all runs of five words; of fewer words, one for the whole; none without words."""
    words = word_hashes(raw)
    n = len(words)
    if not n:
        return words
    if n < WORDS:
        whole = words * _ODD[:n]
        return mix64(whole.sum(dtype=np.uint64, keepdims=True) ^ np.uint64(n))
    run = words[: n - WORDS + 1] * _ODD[0]
    for k in range(1, WORDS):
        run = run + words[k : n - WORDS + 1 + k] * _ODD[k]
    return np.unique(mix64(run))
