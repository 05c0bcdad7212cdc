"""Hashes of the words of whole texts, many texts at a time."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np

_U = np.uint64
_RANDOM = np.random.default_rng(20240501)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
#: Odd weights for the places of a sequence of words.
WEIGHT = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * _U(2) + _U(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that words consist of: all but white space; or digits, small letters and what is not ASCII.
SOLID = ~np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])
#: Bytes of text that are hashed at once.
PIECE = 2 << 20
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.multiply.accumulate(np.r_[_U(1), np.full(n - 1, p, np.uint64)]) for p in (_BASE, inverse))


def _hashes(text: bytes, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of a lower-cased piece."""
    b = np.frombuffer(text, np.uint8)
    solid = np.zeros(len(b) + 2, np.int8)
    solid[1:-1] = kind[b]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(1 << max(16, (len(b)).bit_length()))
    sums = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), starts


def _pieces(text: bytes) -> Iterator[bytes]:
    """Cuts a long text at white space."""
    at = 0
    while len(text) - at > PIECE:
        cut = max(text.rfind(c, at, at + PIECE) for c in _SPACES)
        if cut <= at:
            found = [i for i in (text.find(c, at + PIECE) for c in _SPACES) if i >= 0]
            cut = min(found, default=len(text))
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_hashes(texts: list[bytes | None], kind: np.ndarray = SOLID) -> Iterator[np.ndarray]:
    """64-bit hashes of the words of each text, A-Z as a-z; null has none."""
    held: list[bytes] = []
    load = 0

    def flush() -> Iterator[np.ndarray]:
        if held:
            at = np.cumsum([0, *[len(t) + 1 for t in held]])
            words, starts = _hashes(b"\n".join(held), kind)
            cut = np.searchsorted(starts, at)
            for a, b in zip(cut, cut[1:]):
                yield words[a:b]

    for text in texts:
        text = (text or b"").lower()
        if load + len(text) > PIECE:
            yield from flush()
            held, load = [], 0
        if len(text) > PIECE:
            yield np.concatenate([_hashes(p, kind)[0] for p in _pieces(text)])
            continue
        held.append(text)
        load += len(text) + 1
    yield from flush()
