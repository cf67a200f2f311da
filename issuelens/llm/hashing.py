"""Vectorised hashes of byte strings inside tasks (numpy)."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64
MASK = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(33))
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


#: A Mersenne prime: hashes are polynomials modulo this prime, so texts built to
#: collide modulo a power of two do not.
PRIME = (1 << 31) - 1
_P, _SHIFT = _U(PRIME), _U(31)
#: Two bases, drawn once at random; a hash is the pair of both residues.
BASES = (1_205_940_587, 789_338_271)


def _fold(x: np.ndarray) -> np.ndarray:
    """Below 2^62: the same residue, below 2^31 + 2 (in place)."""
    high = x >> _SHIFT
    x &= _P
    x += high
    np.right_shift(x, _SHIFT, out=high)
    x &= _P
    x += high
    return x


@lru_cache(maxsize=8)
def _byte_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(seed * 0x632BE59BD9B4E019 & MASK)) % _P


_LOW = 14  # powers come from two small tables: low and high bits of the exponent


@lru_cache(maxsize=16)
def _powers(base: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i for i < 2^14 and base^(2^14 i) for i < high, modulo the prime."""
    out = []
    for b, n in ((base, 1 << _LOW), (pow(base, 1 << _LOW, PRIME), high)):
        p = np.ones(n, np.uint64)
        k = 1
        while k < n:  # the next k powers from the first k
            p[k:2 * k] = p[:min(k, n - k)] * _U(pow(b, k, PRIME)) % _P
            k *= 2
        out.append(p)
    return out[0], out[1]


class Prefix:
    """Prefix sums of a byte buffer modulo the prime, for both bases: the hash
    of any range in a few operations (equal strings, equal hashes)."""

    def __init__(self, buf: np.ndarray, seed: int = 1):
        high = 1 << max(4, int(len(buf) >> _LOW).bit_length())
        step = 1 << _LOW
        self.sums, self.inverses = [], []
        for base in BASES:
            self.inverses.append(_powers(pow(base, -1, PRIME), high))
            low, top = _powers(base, high)
            table = _byte_table(seed)
            sums = np.zeros(len(buf) + 1, np.uint32)
            for i in range(0, len(buf), step):
                part = table[buf[i:i + step]]
                part *= low[:len(part)]
                _fold(part)
                part *= top[i >> _LOW]
                _fold(part)
                np.cumsum(part, out=part)
                part += _U(sums[i])
                sums[i + 1:i + 1 + len(part)] = _fold(part)
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        low, high = start & ((1 << _LOW) - 1), start >> _LOW
        both = np.zeros(len(start), np.uint64)
        for sums, inverse in zip(self.sums, self.inverses):
            x = sums[end].astype(np.uint64)
            x += _U(2 * PRIME)
            x -= sums[start]
            _fold(x)
            x *= inverse[0][low]
            _fold(x)
            x *= inverse[1][high]
            _fold(x)
            x %= _P  # one value per residue
            both <<= _SHIFT
            both |= x
        both += mix((end - start).astype(np.uint64))
        return mix(both)
