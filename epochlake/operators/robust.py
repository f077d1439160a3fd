"""Weights that outliers lose, shared by motion repair and robust regression."""

from __future__ import annotations

import math

import numpy as np

#: Residuals beyond so many standard deviations have no weight; a median of absolute deviations to a standard deviation.
TUNE, NORMAL = 4.685, 1.4826


def biweight(r: np.ndarray, middle: np.ndarray | float = 0.0) -> np.ndarray:
    """Tukey's weights of residuals, along the last axis, by the median of their distance from ``middle``."""
    scale = TUNE * NORMAL * np.median(np.abs(r - middle), axis=-1, keepdims=True)
    u = np.divide(r, scale, out=np.zeros_like(r), where=scale > 0)
    return np.square(np.clip(1 - u * u, 0, None))


def robust_mean(v: np.ndarray, rounds: int = 50) -> tuple[float, np.ndarray]:
    """(mean, weights): the mean by Tukey's weights of the distances from it, when it settles."""
    weights, mean = np.ones_like(v), math.inf
    for _ in range(rounds):
        last, mean = mean, float(weights @ v / weights.sum()) if weights.any() else 0.0
        weights = biweight(v - mean)
        if abs(mean - last) < math.sqrt(np.finfo(float).eps) * max(abs(mean), abs(last)):
            break
    return mean, weights
