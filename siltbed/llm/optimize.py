"""Limited-memory BFGS for the smooth convex fits of the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def minimize(objective: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int = 100, memory: int = 8, tol: float = 1e-5) -> np.ndarray:
    """A minimum of ``objective`` (value, gradient), by backtracking along quasi-Newton directions."""
    x = start.astype(np.float64)
    value, grad = objective(x)
    pairs: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        if np.abs(grad).max(initial=0) <= tol * max(1.0, abs(value)):
            break
        direction, saved = grad.copy(), []
        for s, d, rho in reversed(pairs):
            a = rho * (s @ direction)
            direction -= a * d
            saved.append(a)
        if pairs:
            s, d, _ = pairs[-1]
            direction *= (s @ d) / (d @ d)
        else:
            direction /= max(1.0, np.linalg.norm(grad))
        for (s, d, rho), a in zip(pairs, reversed(saved), strict=True):
            direction += (a - rho * (d @ direction)) * s
        slope = grad @ direction
        if slope <= 0:
            direction, slope, pairs = grad, grad @ grad, []
        size = 1.0
        while True:
            candidate = x - size * direction
            new_value, new_grad = objective(candidate)
            if new_value <= value - 1e-4 * size * slope or size < 1e-10:
                break
            size /= 2
        s, d = candidate - x, new_grad - grad
        if (curve := s @ d) > 1e-12:
            pairs = [*pairs[1 - memory :], (s, d, 1 / curve)]
        x, value, grad = candidate, new_value, new_grad
    return x
