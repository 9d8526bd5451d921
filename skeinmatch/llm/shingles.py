"""64-bit hashes of words and of five-word shingles, vectorised over many texts."""

from __future__ import annotations

import hashlib

import numpy as np

from .common import chunked, mix

WORDS = 5
#: Longer words are hashed one by one.
LONG_WORD = 64
_KEY = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = np.array([0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03, 0x2545F4914F6CDD1D, 0xA24BAED4963EE407, 0x9FB21C651E98DF25], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: What the first 0 to 8 bytes of a little-endian word keep.
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte's place of each word, where words are runs of bytes other than ASCII white space.

    A-Z count as a-z. A word's bytes go eight at a time through a keyed mixer, after its length, so words of up to eight
    bytes of one length never collide; words over LONG_WORD bytes take a keyed BLAKE2b digest."""
    low = buffer.lower()
    a = np.frombuffer(low, np.uint8)
    inside = np.empty(len(a) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[a], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = ends - starts
    eights = np.ndarray((len(a),), "<u8", buffer=low + bytes(8), strides=(1,))
    h = mix(size.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + _KEY)
    if len(h):
        h = mix(h ^ (eights[starts] & _KEEP[np.minimum(size, 8)]))
    left = np.flatnonzero((size > 8) & (size <= LONG_WORD))
    done = 8
    while len(left):
        h[left] = mix(h[left] * _KEY ^ (eights[starts[left] + done] & _KEEP[np.minimum(size[left] - done, 8)]))
        done += 8
        left = left[size[left] > done]
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(low[starts[k] : ends[k]], digest_size=8, key=b"word").digest(), "little")
    return h, starts


def shingle_sets(texts: list[bytes | None]):
    """Yields, text by text, the sorted distinct hashes of its five-word shingles.

    Fewer words: the whole sequence is one shingle. No words, empty or null: an empty array."""
    for lo, hi in chunked(texts):
        part = [t or b"" for t in texts[lo:hi]]
        h, starts = word_hashes(b"\n".join(part))
        first = np.cumsum([0, *(len(t) + 1 for t in part)])
        at = np.searchsorted(starts, first)
        n = len(h)
        if n >= WORDS:
            s = h[: n - 4] * _MULTIPLIERS[0]
            for k in range(1, WORDS):
                s += h[k : n - 4 + k] * _MULTIPLIERS[k]
            s = mix(s)
        for i in range(len(part)):
            b, e = at[i], at[i + 1]
            if e - b >= WORDS:
                u = np.sort(s[b : e - 4])
                keep = np.empty(len(u), bool)
                keep[0] = True
                np.not_equal(u[1:], u[:-1], out=keep[1:])
                yield u[keep]
            elif e > b:
                yield mix(np.atleast_1d((h[b:e] * _MULTIPLIERS[: e - b]).sum(dtype=np.uint64) + np.uint64(e - b)))
            else:
                yield np.empty(0, np.uint64)
