"""Vectorised hashing of Arrow text columns, as bytes, in bounded slices."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text hashed at once; a longer document is a slice of its own.
SLICE = 1 << 20
#: Bytes that a gear hash of 32 bits still remembers.
GEAR_WINDOW = 32

_RANDOM = np.random.default_rng(20240229)
GEAR = _RANDOM.integers(0, 1 << 32, 256, dtype=np.uint32)
BYTE = _RANDOM.integers(0, 1 << 64, 256, dtype=np.uint64) | np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)

#: Bytes that separate words.
BLANKS = b" \t\n\x0b\x0c\r"
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS)] = True
FOLDED = BYTE.copy()
FOLDED[ord("A") : ord("Z") + 1] = BYTE[ord("a") : ord("z") + 1]
FOLDED[IS_BLANK] = 0


def texts(column: pa.Array) -> list[bytes]:
    """The column's texts in UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(data: list[bytes], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(first, last) of runs of documents of about ``size`` bytes each."""
    first, held = 0, 0
    for at, text in enumerate(data):
        if held and held + len(text) > size:
            yield first, at
            first, held = at, 0
        held += len(text)
    if first < len(data):
        yield first, len(data)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gear(data: np.ndarray) -> np.ndarray:
    """Gear hash at every byte: the sum of GEAR[byte] shifted by its distance.

    h[i] = 2 h[i - 1] + GEAR[data[i]] in 32 bits only remembers 32 bytes, so it
    is built by doubling: windows of 1, 2, 4, 8, 16 and 32 bytes.
    """
    h = GEAR[data]
    for width in (1, 2, 4, 8, 16):
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
    return h


def gear_hits(data: bytes, bits: int) -> np.ndarray:
    """Places behind the bytes where the gear hash has ``bits`` leading zeros."""
    every, out = np.frombuffer(data, np.uint8), []
    for first in range(0, len(every), SLICE):
        before = max(0, first - GEAR_WINDOW + 1)
        hashes = gear(every[before : first + SLICE])[first - before :]
        out.append(np.flatnonzero(hashes >> np.uint32(32 - bits) == 0) + first + 1)
    return np.concatenate(out) if out else np.empty(0, np.int64)


_powers: dict[str, np.ndarray] = {}
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of FACTOR and of its inverse, modulo 2**64.

    Those that a slice needs stay in the worker; more, for a single word longer
    than that, are only lent.
    """

    def built(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        return np.cumprod(steps)

    if n > 2 * SLICE + 2:
        return built(FACTOR, n), built(INVERSE, n)
    if not _powers:
        _powers["up"], _powers["down"] = built(FACTOR, 2 * SLICE + 2), built(INVERSE, 2 * SLICE + 2)
    return _powers["up"][:n], _powers["down"][:n]


def parts(text: bytes, size: int = SLICE) -> Iterator[bytes]:
    """A text in parts of about ``size`` bytes, cut at blanks only."""
    at = 0
    while len(text) - at > size:
        blank = BLANK.search(text, at + size)
        if not blank:
            break
        yield text[at : blank.start()]
        at = blank.end()
    yield text[at:]


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of some texts, and each text's word count.

    A-Z count as a-z.  A word's hash is a polynomial in FACTOR over its bytes.  A
    text longer than a slice is hashed part by part.
    """
    if len(data) == 1 and len(data[0]) > SLICE:
        found = [hashed([part])[0] for part in parts(data[0])]
        return np.concatenate(found), np.array([sum(map(len, found))])
    return hashed(data)


def hashed(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``word_hashes`` of texts that make up a slice."""
    joined = np.frombuffer(b" ".join(data) + b" ", np.uint8)
    blank = IS_BLANK[joined]
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.cumsum([len(x) + 1 for x in data])
    counts = np.diff(np.searchsorted(starts, ends), prepend=0)
    if not len(starts):
        return np.empty(0, np.uint64), counts
    up, down = powers(len(joined))
    sums = np.add.reduceat(FOLDED[joined] * up, starts)
    return mix(sums * down[starts]), counts


def shingle_sets(data: list[bytes], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles of ``width`` words, as sorted hashes.

    A shorter text is one shingle of all its words; a text without words has
    none.
    """
    words, counts = word_hashes(data)
    factors = [np.uint64(pow(FACTOR, 3 * i + 1, 1 << 64)) for i in range(width)]
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for i, factor in enumerate(factors):
        rolled += words[i : i + n] * factor
    rolled = mix(rolled)
    out, at = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(rolled[at : at + count - width + 1]))
        elif count:
            whole = np.array([count * INVERSE % (1 << 64)], np.uint64)
            for i in range(count):
                whole += words[at + i : at + i + 1] * factors[i]
            out.append(mix(whole))
        else:
            out.append(np.empty(0, np.uint64))
        at += count
    return out
