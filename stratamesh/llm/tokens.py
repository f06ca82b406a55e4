"""Hashes of words and shingles, for many texts at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from .common import FOLD

#: ASCII white space: tab to carriage return, and space.
BLANK = np.array([b in (9, 10, 11, 12, 13, 32) for b in range(256)])
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def unmix(x: np.ndarray) -> np.ndarray:
    """The number that ``mix`` turns into ``x``."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * np.uint64(pow(0x94D049BB133111EB, -1, 1 << 64))
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * np.uint64(pow(0xBF58476D1CE4E5B9, -1, 1 << 64))
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def byte_values() -> np.ndarray:
    return np.random.default_rng(0x77).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)


def folded(text: str | None) -> bytes:
    """UTF-8 with A-Z in lower case; null counts as empty."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD) if isinstance(text, str) else b""


def parcels(texts: Iterable[str | None], size: int = 2_000_000) -> Iterator[list[bytes]]:
    """Runs of folded texts of about ``size`` bytes together, or one longer text."""
    held, n = [], 0
    for t in texts:
        b = folded(t)
        if held and n + len(b) > size:
            yield held
            held, n = [], 0
        held.append(b)
        n += len(b)
    if held:
        yield held


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and for each text the index of its first word (and the total)."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[::2], edge[1::2]
    text_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, text_start)
    if not len(starts):
        return np.empty(0, dtype=np.uint64), first
    lengths = ends - starts
    power = np.ones(int(lengths.max()), dtype=np.uint64)
    power[1:] = np.cumprod(np.full(len(power) - 1, _BASE, dtype=np.uint64))
    letters = np.flatnonzero(~blank)
    offset = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(letters)) - np.repeat(offset, lengths)
    value = byte_values()[data[letters]] * power[place]
    return mix(np.add.reduceat(value, offset) + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its ``n``-word shingles.

    A text of fewer words has one, of all its words; a text without words none.
    """
    words, first = word_hashes(texts)
    if len(words) >= n:
        h = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for k in range(n):
            h = mix(h + words[k : len(words) - n + 1 + k] + _BASE)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            yield np.unique(h[a : b - n + 1])
        elif b > a:
            one = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for w in words[a:b]:
                    one = mix(np.array([one + w * _BASE], dtype=np.uint64))[0]
            yield np.array([one], dtype=np.uint64)
        else:
            yield np.empty(0, dtype=np.uint64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of equal length, bytes of equal weight side by side, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T).tobytes() for x in arrays))


def unpack(data: bytes, n: int, *kinds) -> list[np.ndarray]:
    import zstandard

    sizes = [np.dtype(k).itemsize for k in kinds]
    raw, out, a = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * sum(sizes))), dtype=np.uint8), [], 0
    for kind, size in zip(kinds, sizes):
        out.append(np.ascontiguousarray(raw[a : a + n * size].reshape(size, n).T).reshape(-1).view(kind))
        a += n * size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers; ``np.cumsum`` undoes it."""
    return np.diff(x, prepend=x.dtype.type(0))
