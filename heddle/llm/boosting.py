"""Gradient-boosted trees for two classes, on histograms of binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    edges: list[np.ndarray]  # of each feature's bins
    feature: np.ndarray  # (trees, inner nodes)
    below: np.ndarray  # the highest bin that goes left
    leaves: np.ndarray  # (trees, 2 ** depth)
    start: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(self.edges)), np.uint8)

    def probability(self, x: np.ndarray) -> np.ndarray:
        # Only the features that trees ask for are binned.
        used = np.unique(self.feature)
        binned, rows = np.zeros(x.shape, np.uint8), np.arange(len(x))
        for j in used:
            binned[:, j] = np.searchsorted(self.edges[j], x[:, j], "left")
        z = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, below, leaves in zip(self.feature, self.below, self.leaves, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < inner:
                at = 2 * at + 1 + (binned[rows, feature[at]] > below[at])
            z += leaves[at - inner]
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 24, least: float = 2.0, ridge: float = 1.0) -> Trees:
    edges = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        edges.append(((values[1:] + values[:-1]) / 2) if len(values) <= bins else np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)))
    prior = float(np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99))
    inner = 2**depth - 1
    model = Trees(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int64), np.zeros((trees, inner + 1)), float(np.log(prior / (1 - prior))))
    binned = model.bins(x).astype(np.int64)
    z = np.full(len(x), model.start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-z))
        slope, curve = y - p, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            gain, where = np.full(width, 1e-6), np.zeros((width, 2), np.int64) + [0, 255]
            local = at - first
            for j in range(x.shape[1]):
                if not len(edges[j]):
                    continue
                key = local * 256 + binned[:, j]
                g = np.cumsum(np.bincount(key, slope, width * 256).reshape(width, 256), axis=1)
                h = np.cumsum(np.bincount(key, curve, width * 256).reshape(width, 256), axis=1)
                g, h = g[:, : len(edges[j]) + 1], h[:, : len(edges[j]) + 1]
                rest_g, rest_h = g[:, -1:] - g, h[:, -1:] - h
                value = g**2 / (h + ridge) + rest_g**2 / (rest_h + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                value[(h < least) | (rest_h < least)] = 0
                best = value.argmax(axis=1)
                up = value[np.arange(width), best] > gain
                gain[up], where[up] = value[np.arange(width), best][up], np.stack([np.full(width, j), best], axis=1)[up]
            model.feature[t, first : first + width], model.below[t, first : first + width] = where[:, 0], where[:, 1]
            at = 2 * at + 1 + (binned[np.arange(len(x)), where[local, 0]] > where[local, 1])
        leaf = at - inner
        model.leaves[t] = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, curve, inner + 1) + ridge)
        z += model.leaves[t][leaf]
    return model
