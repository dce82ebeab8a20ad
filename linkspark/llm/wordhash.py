"""Words of many texts at once as 64-bit fingerprints, in numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_P, _Q = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_MIX = np.random.default_rng(11).integers(1, 1 << 64, 256, np.uint64)
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_tables: dict[int, np.ndarray] = {}
_PRIME = (1 << 32) - 5
_R, _S = 0x6C8E9CF5, 0xB5297A4D
_residues: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**i modulo 2**64 for i below n at least."""
    held = _tables.get(base)
    if held is None or len(held) < n:
        held = np.full(max(n, 1 << 16) * 5 // 4, base, np.uint64)
        held[0] = 1
        held = _tables[base] = np.multiply.accumulate(held)
    return held


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def residues(base: int, n: int) -> np.ndarray:
    """base**i modulo _PRIME for i below n at least."""
    held = _residues.get(base)
    if held is None or len(held) < n:
        held, size = np.ones(1, np.uint64), max(n, 1 << 16) * 5 // 4
        while len(held) < size:
            held = np.concatenate([held, held * np.uint64(pow(base, len(held), _PRIME)) % np.uint64(_PRIME)])
        _residues[base] = held
    return held


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the whole word."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 offsets; a null text is empty."""
    texts = texts.cast(pa.large_string())
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    if texts.null_count:  # what lies under a null counts for nothing
        texts = texts.fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return data, offsets


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, one past the last, bytes, offsets from 0) for about ``size`` bytes each; no text is cut."""
    data, offsets = buffers(texts)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = min(len(texts), max(first + 1, last))
        yield first, last, data[offsets[first]:offsets[last]], offsets[first:last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of bytes other than ASCII white space: (starts, ends, fingerprints, words before each text and in all).

    ``lower`` takes A-Z as a-z. Two words share a fingerprint by chance only, with odds of 2**-64.
    """
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    white = _WHITE[data]
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    before = np.concatenate([[True], white[:-1]]) | opens[:-1]
    after = np.concatenate([white[1:], [True]]) | opens[1:]
    starts = np.flatnonzero(~white & before)
    ends = np.flatnonzero(~white & after) + 1
    counts = np.searchsorted(starts, offsets)
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64), counts
    values = np.zeros(n + 1, np.uint64)
    np.multiply(_MIX[_LOWER[data] if lower else data], powers(_P, n)[:n], out=values[:n])
    edges = np.stack([starts, ends], axis=1).ravel()
    sums = np.add.reduceat(values, edges)[::2] * powers(inverse(_P), n)[starts]
    return starts, ends, mixed(sums), counts


def windows(fingerprints: np.ndarray, size: int) -> np.ndarray:
    """Fingerprint of every run of ``size`` words (by order and content); empty if there are fewer words."""
    n = len(fingerprints) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(fingerprints) + 1, np.uint64)
    np.cumsum(fingerprints * powers(_Q, len(fingerprints))[:len(fingerprints)], out=total[1:])
    return mixed((total[size:] - total[:-size]) * powers(inverse(_Q), n)[:n])


def checks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Second fingerprints (32 bits) of the words that begin and end there, worked out from their bytes alone.

    Polynomials over the integers modulo a prime: what makes two fingerprints of ``words`` equal says nothing here.
    """
    n = len(data)
    if not len(starts):
        return np.zeros(0, np.uint64)
    prime, values = np.uint64(_PRIME), np.zeros(n + 1, np.uint64)
    values[:n] = (data.astype(np.uint64) + np.uint64(1)) * residues(_R, n)[:n] % prime
    sums = np.add.reduceat(values, np.stack([starts, ends], axis=1).ravel())[::2] % prime
    return sums * residues(pow(_R, -1, _PRIME), n)[starts] % prime


def window_checks(checks: np.ndarray, size: int) -> np.ndarray:
    """Second fingerprints (32 bits) of the windows of ``windows``, from those of their words."""
    n = len(checks) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    prime, total = np.uint64(_PRIME), np.zeros(len(checks) + 1, np.uint64)
    np.cumsum(checks * residues(_S, len(checks))[:len(checks)] % prime, out=total[1:])
    return (total[size:] - total[:-size]) % prime * residues(pow(_S, -1, _PRIME), n)[:n] % prime
