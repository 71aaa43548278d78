"""Locally adaptive scalar quantisation: each vector has its own offset and scale, and a code of 4 or 8 bits a dimension."""

from __future__ import annotations

import numpy as np


def encode(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, scale, codes) of the rows; two 4-bit codes share a byte, the lower half first. Halves round away from zero."""
    top = (1 << bits) - 1
    low, high = x.min(1).astype(np.float64), x.max(1).astype(np.float64)
    span = high - low
    with np.errstate(divide="ignore", invalid="ignore"):
        z = np.where(span[:, None] > 0, top * (x.astype(np.float64) - low[:, None]) / span[:, None], 0)
    codes = np.clip(np.floor(z + 0.5), 0, top).astype(np.uint8)
    if bits == 4:
        if codes.shape[1] % 2:
            codes = np.concatenate([codes, np.zeros((len(codes), 1), np.uint8)], 1)
        codes = codes[:, ::2] | codes[:, 1::2] << 4
    return low.astype(np.float32), (span / top).astype(np.float32), codes


def decode(offset: np.ndarray, scale: np.ndarray, codes: np.ndarray, dim: int, bits: int) -> np.ndarray:
    if bits == 4:
        both = np.empty((len(codes), codes.shape[1] * 2), np.uint8)
        both[:, ::2], both[:, 1::2] = codes & 15, codes >> 4
        codes = both[:, :dim]
    return offset[:, None].astype(np.float64) + scale[:, None].astype(np.float64) * codes


def width(dim: int, bits: int) -> int:
    return dim if bits == 8 else (dim + 1) // 2
