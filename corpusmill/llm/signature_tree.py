"""Signature trees: which of many sets may be similar, by dual traversal.

A set's signature is a bitmap of its tokens' hashes. A node holds the OR of its members' bitmaps, the range of
their sizes, the largest number of tokens that a member has beyond its own bits, and the range of their components.
Two sets under nodes x and y share at most popcount(OR_x AND OR_y) + (tokens beyond bits) tokens: each shared token
falls on a common bit, and all but a set's surplus tokens have bits of their own. A node pair is left out if that is
less than similar sets of their least sizes must share, if the sizes are too far apart, or if all members are already
in one component. For single sets a and b the bound is |a| - popcount(a AND NOT b), or the same with b first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Words of 64 bits of a signature.
WORDS = 32
FANOUT = 8
#: Node pairs that are looked at together; bounds memory.
CHUNK = 8192


def signature(hashes: np.ndarray) -> np.ndarray:
    """The bitmap of a set of 64-bit hashes."""
    bits = np.zeros(64 * WORDS, np.uint8)
    bits[(hashes >> np.uint64(64 - 11)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


@dataclass
class Level:
    """The nodes of one level; node k of a level has nodes k * FANOUT ... of the level below."""

    bits: np.ndarray
    least: np.ndarray
    most: np.ndarray
    surplus: np.ndarray
    low: np.ndarray
    high: np.ndarray


def tree(bits: np.ndarray, sizes: np.ndarray, component: np.ndarray) -> list[Level]:
    """Levels from the sets themselves up to one root."""
    levels = [Level(bits, sizes, sizes, sizes - np.bitwise_count(bits).sum(1, dtype=np.int64), component, component)]
    while len(levels[-1].least) > 1:
        x = levels[-1]
        at = np.arange(0, len(x.least), FANOUT)
        levels.append(Level(np.bitwise_or.reduceat(x.bits, at), np.minimum.reduceat(x.least, at), np.maximum.reduceat(x.most, at), np.maximum.reduceat(x.surplus, at), np.minimum.reduceat(x.low, at), np.maximum.reduceat(x.high, at)))
    return levels


def possible(x: Level, a: np.ndarray, y: Level, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which node pairs may hold sets of different components with intersection / union >= num / den."""
    ok = (den * x.most[a] >= num * y.least[b]) & (den * y.most[b] >= num * x.least[a])
    ok &= (np.minimum(x.low[a], y.low[b]) != np.maximum(x.high[a], y.high[b]))
    some = np.flatnonzero(ok)
    a, b = a[some], b[some]
    bound = np.bitwise_count(x.bits[a] & y.bits[b]).sum(1, dtype=np.int64) + np.minimum(x.surplus[a], y.surplus[b])
    ok[some] = (num + den) * bound >= num * (x.least[a] + y.least[b])
    return ok


def candidates(x: list[Level], y: list[Level] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets (their places) of two trees, or of one (y None: each pair once), that the bounds leave."""
    one = y is None
    y = x if one else y
    i, j = len(x) - 1, len(y) - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    # Depth first over chunks of node pairs, so that memory stays bounded.
    stack = [(i, j, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        i, j, a, b = stack.pop()
        if len(a) > CHUNK:
            stack += [(i, j, a[k : k + CHUNK], b[k : k + CHUNK]) for k in range(0, len(a), CHUNK)]
            continue
        ok = possible(x[i], a, y[j], b, num, den)
        a, b = a[ok], b[ok]
        if one and i == j == 0:
            a, b = a[a < b], b[a < b]
        if not len(a):
            continue
        if i == j == 0:
            out.append((a, b))
            continue
        down_x, down_y = i > 0 and i >= j, j > 0 and j >= i
        if down_x:
            a, b = (a[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(b, FANOUT)
            keep = a < len(x[i - 1].least)
            a, b, i = a[keep], b[keep], i - 1
        if down_y:
            b, a = (b[:, None] * FANOUT + np.arange(FANOUT)).ravel(), np.repeat(a, FANOUT)
            keep = b < len(y[j - 1].least)
            a, b, j = a[keep], b[keep], j - 1
        if one:
            a, b = a[a <= b], b[a <= b]
        stack.append((i, j, a, b))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])
