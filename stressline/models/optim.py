"""Minimisers in numpy; functions take a batch of parameter vectors, one a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

STEPS = np.array([2.0, 1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 0.001])


def gradient(value: Callable[[np.ndarray], np.ndarray], u: np.ndarray, h: float = 1e-5) -> np.ndarray:
    k = len(u)
    steps = h * np.eye(k)
    both = value(np.concatenate([u + steps, u - steps]))
    return (both[:k] - both[k:]) / (2 * h)


def quasi_newton(value: Callable[[np.ndarray], np.ndarray], u: np.ndarray, *, rounds: int = 100, tol: float = 1e-8) -> tuple[np.ndarray, float]:
    """Minimum by inverse-Hessian updates; all step lengths of a line are tried in one batch."""
    f, k = float(value(u[None])[0]), len(u)
    if not k:
        return u, f
    h = np.eye(k)
    slope = gradient(value, u)
    for _ in range(rounds):
        step = -h @ slope
        if step @ slope > -1e-14:
            h = np.eye(k)
            step = -slope
        step *= min(1.0, 2.0 / (np.linalg.norm(step) + 1e-300))
        tried = value(u + STEPS[:, None] * step)
        best = int(np.argmin(tried))
        if tried[best] >= f - tol:
            if (h == np.eye(k)).all():
                break
            h = np.eye(k)
            continue
        moved = STEPS[best] * step
        u, f = u + moved, float(tried[best])
        new = gradient(value, u)
        turn = new - slope
        slope = new
        if (sy := float(moved @ turn)) > 1e-12:
            a = np.eye(k) - np.outer(moved, turn) / sy
            h = a @ h @ a.T + np.outer(moved, moved) / sy
    return u, f
