"""Words and hashes of whole blocks of text as numpy arrays."""

from __future__ import annotations

import numpy as np

#: Bytes handled at once; arrays of eight bytes for each bound a worker's memory.
CHUNK = 1 << 21
#: A fixed odd number, the base of the polynomial hash modulo 2**64.
BASE = 0x9E3779B97F4A7C55
_U = np.uint64
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE to the powers 0 .. n-1 and their inverses, modulo 2**64."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, CHUNK + 4096)
        up = np.full(size, BASE, _U)
        down = np.full(size, pow(BASE, -1, 1 << 64), _U)
        up[0] = down[0] = 1
        _POWERS["up"], _POWERS["down"] = np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)
    return _POWERS["up"], _POWERS["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of a 64-bit hash (the finaliser of splitmix64)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


#: A random number for every byte at every place modulo 64. The hash of a word is their sum; a polynomial
#: modulo 2**64 would give some different long words of two letters the same hash, whatever its base.
LETTERS = mixed(np.arange(64 * 256, dtype=_U) + _U(BASE))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one byte array, a blank after each, and where each starts."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(sizes + 1, out=starts[1:])
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), starts


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums p of (byte + 1) * BASE**i: the hash of [s, e) is (p[e] - p[s]) * BASE**-s."""
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, _U)
    np.cumsum((values.astype(_U) + _U(1)) * up[: len(values)], out=out[1:])
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash (A-Z lowered) of every word of data, which ends with a blank."""
    found: list[tuple] = []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + CHUNK)
        if end < n:  # words stay whole: chunks end behind a blank
            window = BLANK[data[max(at, end - 65536) : end]]
            if window.any():
                end -= int(np.argmax(window[::-1]))
            else:
                rest = np.flatnonzero(BLANK[data[end:]])
                end += int(rest[0]) + 1
        part = LOWER[data[at:end]]
        blank = np.empty(len(part) + 1, bool)
        blank[0], blank[1:] = True, BLANK[part]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        s, e = edges[0::2], edges[1::2]
        size = e - s
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        letters = LETTERS[(place & 63) << 8 | part[~blank[1:]]]
        far = np.flatnonzero(place >= 64)
        letters[far] *= mixed((place[far] >> 6).astype(_U)) | _U(1)
        sums = np.add.reduceat(letters, first) if len(s) else np.zeros(0, _U)
        found.append((s + at, e + at, mixed(sums ^ (size.astype(_U) * _U(BASE)))))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and how often each comes (or the sum of its weights)."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable") if weights is not None else None
    ordered = np.sort(keys) if order is None else keys[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    if weights is None:
        return ordered[first], np.diff(np.append(first, len(ordered)))
    return ordered[first], np.add.reduceat(weights[order], first)


def bounds(ascending: np.ndarray, parts: int) -> np.ndarray:
    """Where the hash ranges of ``parts`` (a power of two) start in ascending 64-bit keys."""
    shift = _U(64 - (parts.bit_length() - 1))
    return np.searchsorted(ascending, np.arange(parts, dtype=_U) << shift) if parts > 1 else np.zeros(1, np.int64)
