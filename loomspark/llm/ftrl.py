"""Follow-the-regularised-leader (proximal) for sparse linear classifiers with elastic-net penalties."""

from __future__ import annotations

import numpy as np

#: One example: distinct feature indices, their values, and the class (0 or 1 for a single output).
Example = tuple[np.ndarray, np.ndarray, int]


class Ftrl:
    """Per-coordinate FTRL-proximal; one output is logistic regression, more are a softmax.

    The bias is the feature ``size``, always 1.  ``l1`` keeps weights of rare features exactly zero, ``l2`` shrinks the
    rest.
    """

    def __init__(self, size: int, outputs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((size + 1, outputs)), np.zeros((size + 1, outputs))

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, example: Example) -> None:
        index, value, label = example
        rows, x = np.append(index, len(self.z) - 1), np.append(value, 1.0)
        w = self.weights(rows)
        p = probabilities(x @ w)
        p[label if len(p) > 1 else 0] -= 1.0 if len(p) > 1 else label
        g = np.outer(x, p)
        n = self.n[rows]
        self.z[rows] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[rows] = n + g * g

    def fit(self, examples: list[Example], epochs: int, seed: int = 7) -> np.ndarray:
        """Learn in a shuffled order that depends on the seed alone; returns the weights, bias last."""
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            for k in rng.permutation(len(examples)):
                self.learn(examples[k])
        return self.weights()


def logits(weights: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Sparse dot product of one example with each output's weights."""
    return value @ weights[index] + weights[-1]


def probabilities(scores: np.ndarray) -> np.ndarray:
    """Softmax over the outputs, or the logistic function of a single one."""
    if len(scores) == 1:
        return 1 / (1 + np.exp(-np.clip(scores, -500, 500)))
    e = np.exp(scores - scores.max())
    return e / e.sum()


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature that minimises the log loss of held-back examples; 1 if there are none."""
    if not len(labels):
        return 1.0

    def loss(t: float) -> float:
        s = scores / t
        s = s - s.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(s).sum(1)) - s[np.arange(len(labels)), labels]))

    low, high = np.log(0.02), np.log(20.0)
    for _ in range(60):  # golden section: the loss has one minimum in 1 / t
        a, b = high - (high - low) * 0.618034, low + (high - low) * 0.618034
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return float(np.exp((low + high) / 2))
