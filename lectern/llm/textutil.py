"""Word splitting and hashing shared by the operators of this subpackage."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WORD = re.compile(r"[^\W_]+")
U64 = np.uint64


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


@lru_cache(2)
def _marks(low: int, high: int) -> re.Pattern:
    """Combining marks and format characters of a range; a class within one plane is a table, beyond it a list."""
    picked = [c for c in map(chr, range(low, high)) if unicodedata.category(c) in ("Mn", "Cf")]
    return re.compile("[" + re.escape("".join(picked)) + "]+")


def fold(text: str) -> str:
    """Case folded, without accents and format characters (soft hyphens, joiners)."""
    if text.isascii():
        return text.lower()
    plain = _marks(0x80, 0x10000).sub("", unicodedata.normalize("NFKD", text.casefold()))
    return _marks(0x10000, 0x110000).sub("", plain) if plain and max(plain) > "\uffff" else plain


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> U64(31))) * U64(0x7FB5D329728EA185)
    x = (x ^ (x >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


@lru_cache(1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter or digit, and a random number for it."""
    inside = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    return inside, mix(np.arange(0x110000, dtype=np.uint64) + U64(0x2545F4914F6CDD1D))


#: An odd number has an inverse, so the hash of a word comes from sums up to its beginning and its end.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    known = _POWERS.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        known[0] = 1
        np.multiply.accumulate(known, out=known)
        if n <= 1 << 22:
            _POWERS[base] = known
    return known[:n]


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, in order, and how many words each text has; the same words as ``words`` gives."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(texts)) + 1
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)[: int(sizes.sum())]
    inside, random = _characters()
    is_in = inside[points]
    edge = np.diff(is_in.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # the last sign is a line end
    sums = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum(random[points] * _powers(_BASE, len(points)), out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(points))[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, np.diff(bounds)


def shingle_rows(texts: list[str | None], size: int, least: int = 1, piece: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of ``size`` words of each text with at least ``least`` words: (row, 48-bit hash), sorted by both.

    Texts shorter than ``size`` words have one hash of all their words. Comes in pieces of whole texts, of about ``piece``
    characters and at most 2**15 texts. Nulls and texts without words have none.
    """
    first = 0
    while first < len(texts):
        past, held = first, 0
        while past < len(texts) and past - first < 1 << 15 and (held == 0 or held + len(texts[past] or "") <= piece):
            held += len(texts[past] or "")
            past += 1
        h, lengths = word_hashes([t or "" for t in texts[first:past]])
        starts = np.cumsum(lengths) - lengths
        lengths = np.where(lengths >= max(1, least), lengths, 0)
        acc = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
        for k in range(size):
            acc = mix(acc * U64(_BASE) + h[k : k + len(acc)])
        windows = np.maximum(0, lengths - size + 1)
        rows = np.repeat(np.arange(len(lengths)), windows)
        hashes = acc[np.arange(len(rows)) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(starts, windows)]
        short = np.flatnonzero((lengths > 0) & (lengths < size))
        if len(short):
            whole = np.zeros(len(short), dtype=np.uint64)
            for k in range(size - 1):
                at = np.flatnonzero(lengths[short] > k)
                whole[at] = mix(whole[at] * U64(_BASE) + h[starts[short[at]] + k])
            rows, hashes = np.concatenate([rows, short]), np.concatenate([hashes, whole])
        both = np.sort((rows.astype(np.uint64) << U64(48)) | (hashes >> U64(16)))
        if len(both):
            both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        yield (both >> U64(48)).astype(np.int64) + first, both & U64((1 << 48) - 1)
        first = past
