"""A two-state linear-chain conditional random field over words, on whole arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

PREFIXES = (3, 4, 5, 6)
SUFFIX = 4


def features(word: str) -> list[str]:
    """The word itself, its beginnings and its ending."""
    low = word.lower()
    return [f"={low}", *(f"^{low[:k]}" for k in PREFIXES if len(low) > k), *([f"${low[-SUFFIX:]}"] if len(low) > SUFFIX else [])]


@dataclass
class Chain:
    """Weights of word features for the offending state, its bias, and the scores of transitions."""

    weights: dict[str, float]
    bias: float
    start: np.ndarray
    moves: np.ndarray

    def emission(self, word: str) -> float:
        get = self.weights.get
        return self.bias + sum(get(feature, 0.0) for feature in features(word))


def forward_backward(
    odds: np.ndarray,
    real: np.ndarray,
    start: np.ndarray,
    moves: np.ndarray,
    pairs: bool = False,
    before: np.ndarray | None = None,
    after: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginal probability of state 1 at each place, for rows of log odds; `real` marks places in use.

    With `pairs` also the expected number of each transition. Padding stands at the ends of rows. Rows that are
    pieces of longer chains take the messages from both sides: `before`, the weights of the states at the first
    place before its emission, and `after`, those that the rest of the chain sends back; two columns each.
    """
    rows, length = odds.shape
    emit = np.exp(np.clip(odds, -30, 30))
    forward = np.empty((length, 2, rows))
    step = np.exp(moves)
    a0, a1 = np.full(rows, np.exp(start[0])), np.full(rows, np.exp(start[1]))
    if before is not None:
        a0, a1 = before[:, 0], before[:, 1]
    a1 = a1 * emit[:, 0]
    for t in range(length):
        if t:
            b0 = a0 * step[0, 0] + a1 * step[1, 0]
            b1 = (a0 * step[0, 1] + a1 * step[1, 1]) * emit[:, t]
            a0, a1 = b0, b1
        scale = a0 + a1
        a0, a1 = a0 / scale, a1 / scale
        forward[t, 0], forward[t, 1] = a0, a1
    marginal = np.empty((rows, length))
    expected = np.zeros((2, 2)) if pairs else None
    b0, b1 = (np.ones(rows), np.ones(rows)) if after is None else (after[:, 0], after[:, 1])
    for t in range(length - 1, -1, -1):
        f0, f1 = forward[t]
        p1 = f1 * b1
        marginal[:, t] = p1 / (f0 * b0 + p1)
        if t:
            e0, e1 = b0, b1 * emit[:, t]
            use = real[:, t]
            if expected is not None:
                g0, g1 = forward[t - 1]
                joint = np.stack([g0 * step[0, 0] * e0, g0 * step[0, 1] * e1, g1 * step[1, 0] * e0, g1 * step[1, 1] * e1])
                joint = joint / joint.sum(axis=0) * use
                expected += joint.sum(axis=1).reshape(2, 2)
            n0 = step[0, 0] * e0 + step[0, 1] * e1
            n1 = step[1, 0] * e0 + step[1, 1] * e1
            total = n0 + n1
            b0, b1 = np.where(use, n0 / total, b0), np.where(use, n1 / total, b1)
    return marginal * real, expected


def messages(odds: np.ndarray, real: np.ndarray, place: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`before` and `after` of the pieces of whole chains; `place` numbers each chain's pieces, which follow each other.

    A piece is summed up by the products of its steps, two by two numbers. Forward messages go from piece to piece
    of all chains at once, backward messages the other way, so a chain costs its length however it is cut.
    """
    rows, length = odds.shape
    emit, step = np.exp(np.clip(odds, -30, 30)), np.exp(moves)
    through = np.zeros((rows, 2, 2))
    through[:, 0, 0], through[:, 1, 1] = 1.0, emit[:, 0]
    for t in range(1, length):
        after = through @ step
        after[:, :, 1] *= emit[:, t, None]
        after /= after.sum(axis=(1, 2), keepdims=True)
        through = np.where(real[:, t, None, None], after, through)
    before, behind = np.tile(np.exp(start), (rows, 1)), np.ones((rows, 2))
    order = np.argsort(place, kind="stable")
    bounds = np.searchsorted(place[order], np.arange(int(place.max()) + 2))
    levels = [order[low:high] for low, high in zip(bounds[:-1], bounds[1:], strict=True)]
    for here in levels[1:]:
        sent = np.einsum("ri,rij->rj", before[here - 1], through[here - 1]) @ step
        before[here] = sent / sent.sum(axis=1, keepdims=True)
    for here in reversed(levels[1:]):
        sent = np.einsum("rij,rj->ri", through[here], behind[here]) @ step.T
        behind[here - 1] = sent / sent.sum(axis=1, keepdims=True)
    return before, behind


def fit(windows: np.ndarray, tags: np.ndarray, word_features: list[np.ndarray], size: int, rounds: int = 60, ridge: float = 1e-3, rate: float = 0.15) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Weights, bias, start and transitions by gradient steps on the mean log likelihood.

    `windows` holds word numbers, -1 where a window is shorter; `tags` the states.
    """
    real = windows >= 0
    words = np.where(real, windows, 0)
    lengths = np.array([len(one) for one in word_features])
    flat = np.concatenate(word_features) if len(word_features) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(word_features)), lengths)
    count = max(1, int(real.sum()))
    observed = np.array([[((tags[:, :-1] == i) & (tags[:, 1:] == j) & real[:, 1:]).sum() for j in (0, 1)] for i in (0, 1)], dtype=float)
    first = np.array([(tags[:, 0] == 0).sum(), (tags[:, 0] == 1).sum()], dtype=float)
    point = np.zeros(size + 7)
    point[size] = -3.0
    mean, square = np.zeros_like(point), np.zeros_like(point)
    for number in range(1, rounds + 1):
        weights, bias, start, moves = point[:size], point[size], point[size + 1 : size + 3], point[size + 3 :].reshape(2, 2)
        scores = np.bincount(owner, weights[flat], len(word_features)) + bias
        odds = np.where(real, scores[words], 0.0)
        marginal, expected = forward_backward(odds, real, start, moves, pairs=True)
        error = (marginal - tags) * real
        by_word = np.bincount(words[real], error[real], len(word_features))
        slope = np.concatenate([
            np.bincount(flat, by_word[owner], size),
            [error.sum()],
            np.array([(1 - marginal[:, 0]).sum(), marginal[:, 0].sum()]) - first,
            (expected - observed).ravel(),
        ]) / count * 50 + ridge * point
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        point = point - rate * (mean / (1 - 0.9**number)) / (np.sqrt(square / (1 - 0.99**number)) + 1e-8)
    return point[:size], float(point[size]), point[size + 1 : size + 3], point[size + 3 :].reshape(2, 2)
