"""Unsigned integers as variable-length bytes, seven bits a byte, low bits first: many at once."""

from __future__ import annotations

import numpy as np


def sizes(values: np.ndarray) -> np.ndarray:
    """Bytes of each value (0 to 2^63 - 1)."""
    v, n = np.asarray(values, np.int64), np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        more = v >= 1 << bits
        if not more.any():
            break
        n += more
    return n


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values one after another, and the size of each."""
    v = np.asarray(values, np.int64)
    n = sizes(v)
    at = np.cumsum(n) - n
    out = np.zeros(int(n.sum()), np.uint8)
    for k in range(int(n.max()) if len(n) else 0):
        here = n > k
        part = v[here] >> 7 * k & 127
        out[at[here] + k] = part | np.where(n[here] > k + 1, 128, 0)
    return out, n


def decode(data: np.ndarray) -> np.ndarray:
    """The values of whole bytes; a last value without its end is left out. A value of over nine bytes raises ValueError."""
    b = np.asarray(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    if not len(ends):
        return np.zeros(0, np.int64)
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = ends - starts + 1
    longest = int(n.max())
    if longest == 1:
        return b[ends].astype(np.int64)
    if longest > 9:
        raise ValueError("a value has more than 63 bits")
    out = np.zeros(len(ends), np.int64)
    for k in range(longest):
        here = n > k if k else slice(None)
        out[here] |= (b[starts[here] + k] & 127).astype(np.int64) << 7 * k
    return out


def zigzag(values: np.ndarray) -> np.ndarray:
    """Signed values as unsigned ones: 0, -1, 1, -2 to 0, 1, 2, 3."""
    v = np.asarray(values, np.int64)
    return v << 1 ^ v >> 63


def unzigzag(values: np.ndarray) -> np.ndarray:
    v = np.asarray(values, np.int64)
    return v >> 1 ^ -(v & 1)
