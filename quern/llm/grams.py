"""Hashed character n-grams of whole texts, as numpy arrays."""

from __future__ import annotations

import re

import numpy as np

_NOT_LETTERS = re.compile(r"[\W\d_]+")
_SPACES = re.compile(r"\s+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def letters_only(text: str) -> str:
    """Lower case, every run of other characters as one space, padded with spaces."""
    return f" {_NOT_LETTERS.sub(' ', text.lower()).strip()} "


def squeezed(text: str) -> str:
    """Lower case, white space runs as one space, padded with spaces."""
    return f" {_SPACES.sub(' ', text.lower()).strip()} "


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def gram_buckets(codes: np.ndarray, orders: tuple[int, ...], bits: int) -> np.ndarray:
    """Bucket numbers (0 .. 2**bits-1) of all n-grams of the given orders, repeats included."""
    out, rolling = [], np.zeros(len(codes), np.uint64)
    shift = np.uint64(64 - bits)
    for n in range(1, max(orders) + 1):
        if len(codes) < n:
            break
        rolling = (rolling[: len(codes) - n + 1] ^ (codes[n - 1 :] + np.uint64(n))) * _MIX[0]
        rolling ^= rolling >> np.uint64(29)
        if n in orders:
            out.append(((rolling * _MIX[1]) >> shift).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)
