"""Sparse linear models over hashed features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Feature indices and values of documents one after another; ends[i] closes document i."""

    index: np.ndarray
    value: np.ndarray
    ends: np.ndarray

    def __len__(self) -> int:
        return len(self.ends)

    def take(self, rows: np.ndarray) -> Rows:
        starts = np.concatenate([[0], self.ends[:-1]])[rows]
        n = self.ends[rows] - starts
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return Rows(self.index[at], self.value[at], np.cumsum(n))

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ends, prepend=0))

    def dot(self, weight: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner(), weight[self.index] * self.value, minlength=len(self))

    def pull(self, grad: np.ndarray, size: int) -> np.ndarray:
        """Sum over documents of grad[i] * features of i."""
        return np.bincount(self.index, grad[self.owner()] * self.value, minlength=size)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


class Adam:
    def __init__(self, size: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, weight: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.v += 0.001 * (grad * grad - self.v)
        weight -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def fit_soft(rows: Rows, target: np.ndarray, size: int, *, l2: float = 1e-5, rate: float = 0.2, steps: int = 80) -> np.ndarray:
    """Full-batch logistic regression on targets between 0 and 1; the last weight is the bias."""
    weight, adam = np.zeros(size + 1), Adam(size + 1, rate)
    for _ in range(steps):
        g = (sigmoid(rows.dot(weight[:-1]) + weight[-1]) - target) / max(1, len(rows))
        adam.step(weight, np.append(rows.pull(g, size) + l2 * weight[:-1], g.sum()))
    return weight


def fit_nnpu(pos: Rows, unl: Rows, prior: float, size: int, *, l2: float = 1e-4, rate: float = 0.05, steps: int = 400, beta: float = 0.0) -> np.ndarray:
    """Non-negative positive-unlabelled risk with the logistic loss:
    prior * R_pos(+) + max(-beta, R_unl(-) - prior * R_pos(-)); where the negative part falls below -beta
    its gradient is followed upwards instead."""
    weight, adam = np.zeros(size + 1), Adam(size + 1, rate)
    weight[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    for _ in range(steps):
        zp, zu = pos.dot(weight[:-1]) + weight[-1], unl.dot(weight[:-1]) + weight[-1]
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.mean(np.logaddexp(0, zu)) - prior * np.mean(np.logaddexp(0, zp))
        gp_plus = prior * (sp - 1) / len(pos)
        gp_minus, gu = -prior * sp / len(pos), su / len(unl)
        if negative < -beta:
            gp, g_un = -gp_minus, -gu
        else:
            gp, g_un = gp_plus + gp_minus, gu
        grad = pos.pull(gp, size) + unl.pull(g_un, size) + l2 * weight[:-1]
        adam.step(weight, np.append(grad, gp.sum() + g_un.sum()))
    return weight
