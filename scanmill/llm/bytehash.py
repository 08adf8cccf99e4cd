"""Words, shingles and byte windows of many texts at once, hashed with numpy prefix sums.

The hash of bytes [s, e) is ``sum(byte[i] * B**(i - s))`` modulo 2**64, read from one running sum; equal bytes have
equal hashes wherever they stand. Two bases give 128 bits where a hash stands for the bytes themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .memory import remembered

BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: word bytes: everything but \x20 and \x09-\x0D
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
#: letters of any script: a-z, and every byte of a character beyond ASCII
LETTER = np.zeros(256, dtype=bool)
LETTER[97:123] = True
LETTER[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    powers = remembered("powers")
    known = powers.get(base)
    if known is None or len(known[0]) < n:
        # full slices in tasks get tables for all that follow; the driver hashes a few words and has no room for those
        size = max(n, 5 << 19) if n > 1 << 18 else 1 << (n - 1).bit_length()
        inverse = np.uint64(pow(int(BASES[base]), -1, 1 << 64))
        up = np.full(size, BASES[base], dtype=np.uint64)
        down = np.full(size, inverse, dtype=np.uint64)
        up[0] = down[0] = 1
        known = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 1 << 23:  # longer ones are made for one text and let go
            powers[base] = known
    return known


class Bytes:
    """The bytes of many texts in a row, a line feed between two of them."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        values = ["" if t is None else t for t in texts.to_pylist()]
        raw = [v if isinstance(v, bytes) else v.encode("utf-8", "surrogatepass") for v in values]
        self.sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.starts = np.cumsum(self.sizes + 1) - (self.sizes + 1)
        self.data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8) if raw else np.zeros(0, np.uint8)
        if lower:
            self.data = _LOWER[self.data]
        self._sums: dict[int, np.ndarray] = {}

    def sums(self, base: int = 0) -> np.ndarray:
        if base not in self._sums:
            up, _ = _power(base, len(self.data) + 1)
            out = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[: len(self.data)], out=out[1:])
            self._sums[base] = out
        return self._sums[base]

    def hash(self, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
        sums = self.sums(base)
        _, down = _power(base, len(self.data) + 1)
        return mix((sums[end] - sums[start]) * down[start] + (np.asarray(end - start).astype(np.uint64) << np.uint64(40)))

    def words(self, kind: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word; a word never crosses texts."""
        inside = np.zeros(len(self.data) + 1, dtype=np.int8)
        inside[1:] = kind[self.data]
        edge = np.diff(inside)
        start = np.flatnonzero(edge == 1)
        end = np.flatnonzero(edge == -1)
        return start, end, np.searchsorted(self.starts, start, side="right") - 1


def shingles(word_hash: np.ndarray, doc: np.ndarray, docs: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every run of ``size`` words and its text; a text with fewer words has its whole sequence as one."""
    counts = np.bincount(doc, minlength=docs).astype(np.int64)
    first = np.cumsum(counts) - counts
    step = np.uint64(0xA24BAED4963EE407)
    n = len(word_hash)
    whole = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        whole = whole * step + word_hash[k : k + len(whole)]
    long = counts >= size
    keep = np.ones(len(whole), dtype=bool)
    keep &= doc[: len(whole)] == doc[size - 1 : size - 1 + len(whole)]
    got, owner = [mix(whole[keep])], [doc[: len(whole)][keep]]
    for d in np.flatnonzero(~long & (counts > 0)):
        value = np.uint64(0)
        with np.errstate(over="ignore"):
            for h in word_hash[first[d] : first[d] + counts[d]]:
                value = value * step + h
            value = value + np.uint64(counts[d]) * np.uint64(0xC2B2AE3D27D4EB4F)
        got.append(mix(np.array([value], dtype=np.uint64)))
        owner.append(np.array([d]))
    value, owner = np.concatenate(got), np.concatenate(owner).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return value[order], owner[order]
