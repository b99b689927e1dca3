"""Borders and feathered weights of tiles."""

from __future__ import annotations

import numpy as np


def edge_points(height: int, width: int, n: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Points along the border of an image."""
    t, w, h = np.linspace(0, 1, n), width - 1.0, height - 1.0
    return np.r_[t * w, t * w, 0 * t, 0 * t + w], np.r_[0 * t, 0 * t + h, t * h, t * h]


def feather(mask: np.ndarray, width: int = 64) -> np.ndarray:
    """Weights that rise from the border of the valid area over ``width`` pixels: the distance along rows and
    columns to the nearest invalid pixel, the lesser of the two."""
    out = np.full(mask.shape, float(width))
    for axis in (0, 1):
        for back in (False, True):
            m = np.flip(mask, axis) if back else mask
            run, dist = np.zeros(m.shape[1 - axis]), np.zeros(m.shape)
            for k in range(m.shape[axis]):
                row = np.take(m, k, axis)
                run = np.where(row, run + 1, 0)
                dist[(k, slice(None)) if axis == 0 else (slice(None), k)] = run
            out = np.minimum(out, np.flip(dist, axis) if back else dist)
    return np.where(mask, np.clip(out / width, 0, 1), 0)
