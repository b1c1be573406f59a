"""Numpy helpers of this package on top of the core's."""

from __future__ import annotations

import numpy as np

from helixmill.functions.flat import flat_text, mix, ranges, slices

__all__ = ["flat_text", "mix", "mix2", "ranges", "slices"]

GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of an ordered pair of names."""
    return mix(mix(a) * np.uint64(3) + b * GOLD + np.uint64(1))
