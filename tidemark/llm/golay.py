"""Fuzzy keys for 64-bit fingerprints from the perfect binary Golay code (23 bits, 12 of them message).

Every 23-bit word lies within distance 3 of exactly one codeword. Its keys are all codewords within
distance 4: that one alone, or six when the distance is 3. Two words at distance 1 or 2 have a word z
between them at distance 1 from both; the codeword nearest to z is within 4 of both, so they share a key.

A fingerprint is cut in segments of 23, 23 and 18 bits. With at most four differing bits in all, either
every segment differs in two bits or fewer, and then one triple of keys is shared; or one segment differs
in three or four, and the other two differ in one bit at most, so one of them is equal and the other
shares a key. Those two kinds of keys miss no pair.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

GENERATOR = 0b101011100011
WIDTHS = (23, 23, 18)
RADIUS = 4


def _syndrome_bits() -> np.ndarray:
    out = np.zeros(23, np.int32)
    for i in range(23):
        r = 1 << i
        for b in range(22, 10, -1):
            if r >> b & 1:
                r ^= GENERATOR << (b - 11)
        out[i] = r
    return out


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits of a word; per syndrome six error patterns, unused ones -1."""
    bits = _syndrome_bits()
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for table, base in ((low, 0), (high, 12)):
        for i in range(int(len(table)).bit_length() - 1):
            table[1 << i : 2 << i] = table[: 1 << i] ^ bits[base + i]
    found: list[list[int]] = [[] for _ in range(2048)]
    for weight in range(RADIUS + 1):
        for on in combinations(range(23), weight):
            s = 0
            for i in on:
                s ^= int(bits[i])
            if weight < 4 or len(found[s]) < 6 and bin(found[s][0]).count("1") == 3:
                found[s].append(sum(1 << i for i in on))
    patterns = np.full((2048, 6), -1, np.int32)
    for s, p in enumerate(found):
        patterns[s, : len(p)] = p
    return low, high, patterns


def segment_keys(words: np.ndarray, t: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Message indexes (n x 6) of the codewords within distance 4, and which of the six exist."""
    low, high, patterns = t
    p = patterns[low[words & 0xFFF] ^ high[words >> 12]]
    return ((words[:, None] ^ p) >> 11) & 0xFFF, p >= 0


def keys(fps: np.ndarray, t: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All keys of unsigned 64-bit fingerprints, as (index of the fingerprint, key)."""
    segments, at = [], 0
    for width in WIDTHS:
        segments.append(((fps >> np.uint64(at)) & np.uint64((1 << width) - 1)).astype(np.int32))
        at += width
    made = [segment_keys(s, t) for s in segments]
    n = len(fps)
    (a, va), (b, vb), (c, vc) = [(m.astype(np.int64), v) for m, v in made]
    triple = (a[:, :, None, None] << 24) | (b[:, None, :, None] << 12) | c[:, None, None, :]
    valid = va[:, :, None, None] & vb[:, None, :, None] & vc[:, None, None, :]
    rows, out = [np.nonzero(valid.reshape(n, -1))[0]], [triple[valid]]
    kind = 0
    for exact in range(3):
        for fuzzy in range(3):
            if exact == fuzzy:
                continue
            kind += 1
            m, v = made[fuzzy]
            k = (np.int64(kind) << 40) | (segments[exact].astype(np.int64)[:, None] << 12) | m
            rows.append(np.nonzero(v)[0])
            out.append(k[v])
    return np.concatenate(rows), np.concatenate(out)
