"""Linear-chain conditional random field with tags O, B, I (numpy, batched over chains)."""

from __future__ import annotations

import math

import numpy as np

O, B, I = 0, 1, 2
FORBIDDEN = -1e9  # O -> I, and I at a chain's start


class ChainCRF:
    """Hashed binary features per token; ``weights`` has a row per feature slot and a column per tag."""

    def __init__(self, slots: int):
        self.weights = np.zeros((slots, 3))
        self.moves = np.zeros((3, 3))
        self.start = np.zeros(3)

    def _scores(self, features: np.ndarray) -> np.ndarray:
        return sum(self.weights[features[..., k]] for k in range(features.shape[-1]))

    def _moves(self) -> tuple[np.ndarray, np.ndarray]:
        moves, start = self.moves.copy(), self.start.copy()
        moves[O, I] = start[I] = FORBIDDEN
        return moves, start

    def viterbi(self, features: np.ndarray) -> np.ndarray:
        """Best tags of chains of one length; features: chains x length x features."""
        scores = self._scores(features)
        moves, start = self._moves()
        best, back = start + scores[:, 0], []
        for t in range(1, scores.shape[1]):
            both = best[:, :, None] + moves
            back.append(both.argmax(axis=1))
            best = both.max(axis=1) + scores[:, t]
        tags = [best.argmax(axis=1)]
        for step in reversed(back):
            tags.append(step[np.arange(len(step)), tags[-1]])
        return np.stack(tags[::-1], axis=1)

    def best(self, features: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Best tags of many chains in one row; features: tokens x features, ``first`` marks where a chain starts.

        The row is cut into pieces of equal length, all walked at the same time from each of the three tags they can be
        entered with; the pieces are then joined in turn.  Weights are whole multiples of 2^-20, so that sums are exact
        and a text has the same tags whatever stands beside it."""
        n = len(features)
        if not n:
            return np.zeros(0, np.int64)
        whole = lambda x: np.rint(x * (1 << 20)).astype(np.int64)
        weights = whole(self.weights)
        length = math.isqrt(n - 1) + 1
        pieces = -(-n // length)
        scores = np.zeros((pieces * length, 3), np.int64)
        for column in features.T:
            scores[:n] += weights[column]
        scores[n:, 1:] = whole(np.float64(FORBIDDEN))
        scores, starts = scores.reshape(pieces, length, 3), np.zeros(pieces * length, bool)
        starts[:n] = first
        starts = starts.reshape(pieces, length)
        moves, start = (whole(x) for x in self._moves())
        either = np.stack([moves, np.tile(start, (3, 1))])
        value = np.where(np.eye(3, dtype=bool), 0, np.int64(-1) << 60) + np.zeros((pieces, 1, 1), np.int64)
        back = np.empty((length, pieces, 3, 3), np.int8)
        for t in range(length):  # value: piece x entered with x now
            step = either[starts[:, t].astype(int)][:, None]
            zero, one, two = (value[:, :, y, None] + step[:, :, y] for y in range(3))
            most = np.maximum(zero, one)
            back[t] = np.where(two > most, 2, one > zero)  # the first of equal ones
            value = np.maximum(most, two) + scores[:, t, None, :]
        total, entered = np.zeros(3, np.int64), np.empty((pieces, 3), np.int8)
        for k in range(pieces):
            both = total[:, None] + value[k]
            entered[k], total = both.argmax(axis=0), both.max(axis=0)
        now, came = np.empty(pieces, np.int64), np.empty(pieces, np.int64)
        last = int(total.argmax())
        for k in range(pieces - 1, -1, -1):
            now[k], came[k] = last, entered[k, last]
            last = int(came[k])
        tags, row = np.empty((pieces, length), np.int64), np.arange(pieces)
        for t in range(length - 1, -1, -1):
            tags[:, t] = now
            now = back[t][row, came, now].astype(np.int64)
        return tags.ravel()[:n]

    def _gradient(self, features, tags, g_weights, g_moves, g_start) -> float:
        """Adds the log-likelihood's gradient of chains of one length; returns the log-likelihood."""
        scores = self._scores(features)
        moves, start = self._moves()
        n, length, _ = scores.shape
        log = lambda x, axis: x.max(axis) + np.log(np.exp(x - x.max(axis, keepdims=True)).sum(axis))
        a = [start + scores[:, 0]]
        for t in range(1, length):
            a.append(log(a[-1][:, :, None] + moves, 1) + scores[:, t])
        z = log(a[-1], 1)
        b = [np.zeros((n, 3))]
        for t in range(length - 1, 0, -1):
            b.append(log(moves + (b[-1] + scores[:, t])[:, None, :], 2))
        b = b[::-1]
        one = np.eye(3)[tags]
        like = -z.sum() + start[tags[:, 0]].sum()
        diffs = one - np.exp(np.stack(a, axis=1) + np.stack(b, axis=1) - z[:, None, None])
        for tag in range(3):
            g_weights[:, tag] += np.bincount(features.ravel(), np.repeat(diffs[..., tag].ravel(), features.shape[2]), len(g_weights))
        for t in range(length):
            like += scores[np.arange(n), t, tags[:, t]].sum()
            if t:
                p = np.exp(a[t - 1][:, :, None] + moves + (scores[:, t] + b[t])[:, None, :] - z[:, None, None])
                np.add.at(g_moves, (tags[:, t - 1], tags[:, t]), 1)
                g_moves -= p.sum(axis=0)
                like += moves[tags[:, t - 1], tags[:, t]].sum()
            else:
                g_start += diffs[:, 0].sum(axis=0)
        return like

    def fit(self, groups: list[tuple[np.ndarray, np.ndarray]], rounds: int = 60, rate: float = 0.2,
            l2: float = 1e-5) -> list[float]:
        """Adam on the mean log-likelihood; groups: (features, tags) of chains of one length each."""
        total = max(1, sum(t.size for _, t in groups))
        values = [self.weights, self.moves, self.start]
        first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
        seen = []
        for k in range(1, rounds + 1):
            grads = [np.zeros_like(v) for v in values]
            seen.append(sum(self._gradient(f, t, *grads) for f, t in groups) / total)
            for v, g, m, s in zip(values, grads, first, second):
                g = g / total - l2 * v
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v += rate * (m / (1 - 0.9 ** k)) / (np.sqrt(s / (1 - 0.999 ** k)) + 1e-8)
        return seen
