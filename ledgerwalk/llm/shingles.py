"""Hashed word shingles of a batch of texts, with numpy.

Words are the runs of bytes other than space and 0x09-0x0D of the UTF-8 text,
A-Z in lower case.  Every different word of a batch is hashed once, as a whole, to
64 bits (polynomials over bytes would meet on words built for it); a shingle's
hash mixes the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

SHINGLE = 5
#: Bytes of text worked on at a time (a longer text is worked on alone).
CHUNK = 1 << 19
_RNG = np.random.default_rng(20240101)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2 ** 64))
_MULTIPLIERS = [np.uint64(int(x) | 1) for x in _RNG.integers(1, 2 ** 63, SHINGLE, dtype=np.uint64)]
_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0..n-1."""
    if len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: A-Z in lower case, every separator as a space.
_PLAIN = bytes(32 if b in (9, 10, 11, 12, 13) else b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def chunks(texts: Iterable[bytes], limit: int = CHUNK) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > limit:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf = np.frombuffer((b" ".join(texts) + b" ").translate(_PLAIN), np.uint8)
    lengths = np.array([len(t) + 1 for t in texts])
    doc_end = np.cumsum(lengths)
    gap = buf == 32
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    offsets = np.concatenate(([0], np.cumsum(~gap)[ends - 1])) if len(ends) else np.zeros(1, np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(buf[~gap])]).dictionary_encode()
    each = np.fromiter(map(xxhash.xxh3_64_intdigest, words.dictionary.to_pylist()), np.uint64, len(words.dictionary))
    word = each[words.indices.to_numpy()]
    starts = ends - 1  # a word belongs to the text in which it ends
    last = np.searchsorted(starts, doc_end)  # words before the end of each text
    n = len(word)
    if n >= SHINGLE:
        five = sum(word[k:n - SHINGLE + 1 + k] * _MULTIPLIERS[k] for k in range(SHINGLE))
        five = mix(five)
    out, begin = [], 0
    for end in last.tolist():
        count = end - begin
        if count >= SHINGLE:
            out.append(np.unique(five[begin:end - SHINGLE + 1]))
        elif count:
            short = np.full(1, count, np.uint64)
            for k in range(begin, end):
                short = mix(short * _MULTIPLIERS[0] + word[k:k + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
        begin = end
    return out
