"""A linear-chain conditional random field in numpy: training and batched Viterbi decoding."""

from __future__ import annotations

import numpy as np

_NEVER = -1e6


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class ChainModel:
    """Weights of hashed features per label and of label pairs; label 0 surrounds each sequence."""

    def __init__(self, weights: np.ndarray, pairs: np.ndarray):
        self.weights, self.pairs = weights, pairs

    @classmethod
    def train(
        cls,
        features: list[list[list[int]]],
        labels: list[list[int]],
        allowed: np.ndarray,
        dimensions: int,
        steps: int = 80,
        rate: float = 0.5,
        penalty: float = 1e-3,
    ) -> ChainModel:
        """Maximum likelihood by full-batch Adagrad on padded sequences; deterministic.

        ``allowed`` tells which label may follow which.  Feature 0 is padding.
        """
        count, k = len(features), len(allowed)
        longest = max(map(len, features))
        width = max(len(f) for s in features for f in s)
        x = np.zeros((count, longest, width), dtype=np.int64)
        y, mask = np.zeros((count, longest), dtype=np.int64), np.zeros((count, longest))
        for i, (sequence, marks) in enumerate(zip(features, labels)):
            for t, (f, mark) in enumerate(zip(sequence, marks)):
                x[i, t, : len(f)], y[i, t], mask[i, t] = f, mark, 1
        gold = np.eye(k)[y] * mask[..., None]
        before = np.concatenate([np.zeros((count, 1), dtype=np.int64), y[:, :-1]], axis=1)
        gold_pairs = np.zeros((k, k))
        np.add.at(gold_pairs, (before.ravel(), y.ravel()), mask.ravel())
        last = mask.sum(axis=1).astype(int) - 1
        np.add.at(gold_pairs, (y[np.arange(count), last], 0), 1)
        barred = np.where(allowed, 0.0, _NEVER)
        w, pairs = np.zeros((dimensions, k)), np.zeros((k, k))
        seen_w, seen_pairs = np.full(w.shape, 1e-8), np.full(pairs.shape, 1e-8)
        for _ in range(steps):
            emit = w[x].sum(axis=2)
            step = pairs + barred
            alpha = np.zeros((count, longest, k))
            alpha[:, 0] = emit[:, 0] + step[0]
            for t in range(1, longest):
                new = _logsum(alpha[:, t - 1, :, None] + step, 1) + emit[:, t]
                alpha[:, t] = np.where(mask[:, t, None] > 0, new, alpha[:, t - 1])
            beta = np.zeros((count, longest, k))
            beta[:, -1] = step[:, 0]
            for t in range(longest - 2, -1, -1):
                new = _logsum((step + (emit[:, t + 1] + beta[:, t + 1])[:, None, :]), 2)
                beta[:, t] = np.where(mask[:, t + 1, None] > 0, new, beta[:, t + 1])
            norm = _logsum(alpha[:, -1] + step[:, 0], 1)
            chance = np.exp(alpha + beta - norm[:, None, None]) * mask[..., None]
            follow = np.exp(
                alpha[:, :-1, :, None] + step + (emit + beta)[:, 1:, None, :]
                - norm[:, None, None, None]
            ) * mask[:, 1:, None, None]
            expected = follow.sum(axis=(0, 1))
            expected[0] += chance[:, 0].sum(axis=0)
            expected[:, 0] += np.take_along_axis(
                chance, last[:, None, None], axis=1
            )[:, 0].sum(axis=0)
            grad = np.zeros_like(w)
            for c in range(width):
                np.add.at(grad, x[:, :, c].ravel(), (gold - chance).reshape(-1, k))
            grad = grad / count - penalty * w
            grad[0] = 0
            grad_pairs = (gold_pairs - expected) / count - penalty * pairs
            seen_w += grad * grad
            seen_pairs += grad_pairs * grad_pairs
            w += rate * grad / np.sqrt(seen_w)
            pairs += rate * grad_pairs / np.sqrt(seen_pairs)
        return cls(w, pairs + barred)

    def best_paths(self, emissions: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        """The best labels of sequences (each of one place at least) whose emissions lie end to end.

        All sequences advance together, the longest first, so that those still running are a prefix.
        """
        k = len(self.pairs)
        order = np.argsort(-np.array(sizes), kind="stable")
        size = np.array(sizes)[order]
        first = (np.cumsum(sizes) - sizes)[order]
        running = np.searchsorted(-size, -np.arange(size[0]), side="left")
        back = np.zeros((len(emissions), k), dtype=np.int8)
        best = emissions[first] + self.pairs[0]
        into = np.ascontiguousarray(self.pairs.T)
        for t in range(1, int(size[0])):
            n = running[t]
            scores = best[:n, None, :] + into
            at = first[:n] + t
            back[at] = scores.argmax(axis=2)
            best[:n] = scores.max(axis=2) + emissions[at]
        label = (best + self.pairs[:, 0]).argmax(axis=1)
        path = np.zeros(len(emissions), dtype=np.int8)
        for t in range(int(size[0]) - 1, -1, -1):
            n = running[t]
            at = first[:n] + t
            path[at] = label[:n]
            label[:n] = back[at, label[:n]]
        out: list[np.ndarray] = [path[:0]] * len(sizes)
        for i, a, n in zip(order, first, size):
            out[i] = path[a : a + n]
        return out
