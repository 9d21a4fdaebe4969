"""Gradient-boosted trees on binned features, and isotonic calibration, for models trained on bounded samples."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of depth-limited trees over quantile bins. Trees are arrays in heap order."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, reg: float = 1.0, least: float = 2.0):
        self.trees, self.depth, self.rate, self.bins, self.reg, self.least = trees, depth, rate, bins, reg, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, width = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(width)]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if width else np.zeros((n, 0), int)
        prior = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
        self.start = float(np.log(prior / (1 - prior)))
        score = np.full(n, self.start)
        self.feature, self.cut, self.value = [], [], []
        inner = (1 << self.depth) - 1
        for _ in range(self.trees if n else 0):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            feature, cut, value = np.full(inner, -1), np.zeros(inner), np.zeros(2 * inner + 1)
            at = np.zeros(n, np.int64)
            for node in range(inner):
                own = at == node
                if not own.any():
                    continue
                best = (1e-9, -1, 0)
                gs, hs = g[own].sum(), h[own].sum()
                for j in range(width):
                    if not len(cuts[j]):
                        continue
                    k = len(cuts[j]) + 1
                    gl = np.cumsum(np.bincount(code[own, j], g[own], k))[:-1]
                    hl = np.cumsum(np.bincount(code[own, j], h[own], k))[:-1]
                    gain = gl**2 / (hl + self.reg) + (gs - gl) ** 2 / (hs - hl + self.reg) - gs**2 / (hs + self.reg)
                    gain[(hl < self.least * 0.05) | (hs - hl < self.least * 0.05)] = 0
                    i = int(np.argmax(gain))
                    if gain[i] > best[0]:
                        best = (float(gain[i]), j, i)
                if best[1] >= 0:
                    feature[node], cut[node] = best[1], cuts[best[1]][best[2]]
                    at[own] = 2 * node + 1 + (code[own, best[1]] > best[2])
            for node in np.unique(at):
                own = at == node
                value[node] = self.rate * g[own].sum() / (h[own].sum() + self.reg)
            score += value[at]
            self.feature.append(feature)
            self.cut.append(cut)
            self.value.append(value)
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inside = at < len(feature)
                f = np.where(inside, feature[np.minimum(at, len(feature) - 1)], -1)
                on = f >= 0
                go = x[every, np.maximum(f, 0)] > cut[np.minimum(at, len(cut) - 1)]
                at = np.where(on, 2 * at + 1 + go, at)
            score += value[at]
        return score


class Isotonic:
    """Pool adjacent violators over (score, label); a step function, made linear between the steps' middles."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        blocks: list[list[float]] = []
        for s, v in zip(score[order], y[order]):
            blocks.append([float(v), 1.0, float(s)])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
                b = blocks.pop()
                blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
        self.x = np.array([b[2] / b[1] for b in blocks])
        self.y = np.array([(b[0] + 0.01) / (b[1] + 0.02) for b in blocks])  # never quite 0 or 1
        self.y = np.maximum.accumulate(self.y)
        return self

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y) if len(self.x) else np.full(len(score), 0.5)
