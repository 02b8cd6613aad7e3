"""Forward-backward against all tag sequences, and texts longer than a piece against one chain."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from tradewind.llm import crf, toxicity


def every_sequence(odds, start, moves):
    """Marginals and expected transitions by the weights of all tag sequences."""
    total, marginal, pairs = 0.0, np.zeros(len(odds)), np.zeros((2, 2))
    for tags in product((0, 1), repeat=len(odds)):
        score = start[tags[0]] + sum(o for o, t in zip(odds, tags, strict=True) if t) + sum(moves[a, b] for a, b in zip(tags, tags[1:], strict=False))
        weight = np.exp(score)
        total += weight
        marginal += weight * np.array(tags)
        for a, b in zip(tags, tags[1:], strict=False):
            pairs[a, b] += weight
    return marginal / total, pairs / total


@pytest.mark.parametrize("length", [1, 2, 9])
def test_forward_backward_is_the_sum_over_all_sequences(length):
    rng = np.random.default_rng(length)
    odds, start, moves = rng.normal(0, 2, (3, length)), rng.normal(0, 1, 2), rng.normal(0, 1.5, (2, 2))
    got, pairs = crf.forward_backward(odds, np.ones((3, length), bool), start, moves, pairs=True)
    expected = [every_sequence(row, start, moves) for row in odds]
    assert np.allclose(got, [m for m, _ in expected]) and np.allclose(pairs, sum(p for _, p in expected))


@pytest.mark.parametrize("length", [1, 63, 64, 65, 128, 200, 700])
def test_a_text_of_many_pieces_is_one_chain(length):
    rng = np.random.default_rng(length)
    words = [f"w{'abcdefghij'[k]}" for k in rng.integers(0, 10, length)]
    weights = {f"=w{letter}": float(v) for letter, v in zip("abcdefghij", rng.normal(0, 2, 10), strict=True)}
    chain = crf.Chain(weights, -0.5, rng.normal(0, 1, 2), rng.normal(0, 1.5, (2, 2)))
    tagger = toxicity.Tagger(toxicity.Model(chain, 0.5, np.zeros(3)))
    other = [" ".join(words[: length // 2]), "", "wa", " ".join(words[::-1])]
    _, expected, marginals = tagger.read([other[0], " ".join(words), *other[1:]])
    odds = np.array([[chain.emission(word) for word in words]])
    whole, _ = crf.forward_backward(odds, np.ones_like(odds, bool), chain.start, chain.moves)
    assert np.allclose(marginals[1], whole[0], atol=1e-9)
    assert np.isclose(expected[1], whole.sum())
