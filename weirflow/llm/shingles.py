"""Sets of word shingles as sorted 64-bit hashes, and SetSketch registers of such sets."""

from __future__ import annotations

import hashlib

import numpy as np

#: Multipliers of splitmix64.
GOLDEN, MIX1, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_state: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: scatters the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """``n`` well mixed 64-bit numbers, the same everywhere."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed) * MIX1)


#: Bytes of words hashed at a time; a longer word is hashed by itself.
BLOCK = 1 << 16


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each byte, and p^k and p^-k modulo 2^64 for k up to BLOCK, p odd; built once in a process."""
    if not _state:
        _state["bytes"] = numbers(256, 7)
        p = int(numbers(1, 11)[0]) | 1
        with np.errstate(over="ignore"):
            for name, factor in (("p", p), ("q", pow(p, -1, 1 << 64))):
                each = np.full(BLOCK + 1, factor, np.uint64)
                each[0] = 1
                _state[name] = np.cumprod(each, dtype=np.uint64)
    return _state["bytes"], _state["p"], _state["q"]


def normal(text: str | None) -> bytes:
    """Words (runs without ASCII white space, A-Z lower-cased) between single spaces."""
    return b" ".join(text.encode("utf-8", "replace").lower().split()) if text else b""


def word_hashes(words: bytes) -> np.ndarray:
    """Hashes of the words of ``normal`` text, in blocks, so that memory beyond the text's own is a few bytes a word."""
    b = np.frombuffer(words, np.uint8)
    each, p, q = tables()
    gaps = np.flatnonzero(b == 32)
    starts, ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(b)]))
    out, k = np.empty(len(starts), np.uint64), 0
    with np.errstate(over="ignore"):
        while k < len(starts):
            low = int(starts[k])
            m = max(k + 1, int(np.searchsorted(ends, low + BLOCK, side="right")))
            high = int(ends[m - 1])
            if high - low > BLOCK:
                out[k] = int.from_bytes(hashlib.blake2b(words[low:high], digest_size=8).digest(), "little")
            else:
                prefix = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each[b[low:high]] * p[: high - low], dtype=np.uint64)))
                out[k:m] = (prefix[ends[k:m] - low] - prefix[starts[k:m] - low]) * q[starts[k:m] - low]
            k = m
    return mix(out)


def shingle_set(words: bytes, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of ``normal`` text; with fewer words one, of all of them."""
    if not words:
        return np.zeros(0, np.uint64)
    w = word_hashes(words)
    k = min(k, len(w))
    n = len(w) - k + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            h = h * GOLDEN + w[j : j + n]
        return np.unique(mix(h))


def set_key(s: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


class SetSketch:
    """Registers K_i = clip(floor(1 - log_b(min over x of E_i(x))), 0, q + 1) with exponential E_i of rate a.

    Registers of a union are the maxima of the registers: sketches merge in any order.
    """

    def __init__(self, m: int, b: float = 1.001, a: float = 20.0, q: int = (1 << 16) - 2):
        self.m, self.b, self.a, self.q = m, b, a, q
        self.factors = numbers(m, 3) | np.uint64(1)

    def registers(self, s: np.ndarray) -> np.ndarray:
        least = np.full(self.m, np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 2048):
                part = s[at : at + 2048]
                for lo in range(0, self.m, 16):
                    product = part[None, :] * self.factors[lo : lo + 16, None]
                    np.minimum(least[lo : lo + 16], product.min(axis=1), out=least[lo : lo + 16])
        u = (least.astype(np.float64) + 1.0) / 2.0**64
        e = -np.log1p(-np.minimum(u, 1 - 1e-16)) / self.a
        return np.clip(np.floor(1 - np.log(e) / np.log(self.b)), 0, self.q + 1).astype(np.uint16)

    def log_likelihood(self, j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, u: np.ndarray) -> np.ndarray:
        """Of Jaccard similarity j, given how many registers are greater, less and the same; u is the first set's share of both sizes."""
        v = 1 - u
        step = (self.b - 1) / self.b
        above = -np.log1p(-np.clip(u - v * j, 0, 1) * step) / np.log(self.b)
        below = -np.log1p(-np.clip(v - u * j, 0, 1) * step) / np.log(self.b)
        tiny = 1e-12
        return more * np.log(np.maximum(above, tiny)) + less * np.log(np.maximum(below, tiny)) + same * np.log(np.maximum(1 - above - below, tiny))

    def may_reach(self, x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, least: float, surprise: float = 12.5) -> np.ndarray:
        """For pairs of sketches: False only if sizes or likelihood rule a similarity of ``least`` out.

        Ruled out: the smaller set is under ``least`` of the larger, or the most likely similarity is lower and
        its log-likelihood is over ``surprise`` greater (five standard deviations).
        """
        nx, ny = nx.astype(np.float64), ny.astype(np.float64)
        fits = np.minimum(nx, ny) >= least * np.maximum(nx, ny) * (1 - 1e-12)
        more, less = (x > y).sum(axis=1), (x < y).sum(axis=1)
        same, u = self.m - more - less, nx / (nx + ny)
        grid = np.linspace(0, 1, 65)
        top = np.minimum(u, 1 - u) / np.maximum(u, 1 - u)
        best = np.full(len(nx), -np.inf)
        for g in grid:
            best = np.maximum(best, self.log_likelihood(np.minimum(g, top), more, less, same, u))
        return fits & ((same >= least * self.m) | (best - self.log_likelihood(np.minimum(least, top), more, less, same, u) <= surprise))
