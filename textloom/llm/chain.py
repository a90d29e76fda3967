"""Linear-chain conditional random fields over many sequences at once, in numpy.

Sequences lie one after another in flat arrays; ``first[i]:first[i + 1]`` are the positions of sequence ``i``. Each
step of a recursion handles one position of every sequence that is long enough, longest first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def steps(first: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Where the sequences start, longest first, and how many are longer than t, for each t."""
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    counts = np.bincount(length, minlength=1)
    longer = len(length) - np.cumsum(counts)[:-1] if len(counts) > 1 else np.zeros(0, dtype=np.int64)
    return first[:-1][order], longer.tolist()


def posteriors(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Probability of each state at each position by forward-backward."""
    begin, longer = steps(first)
    if not longer:
        return np.zeros_like(scores)
    peak = scores.max(axis=1, keepdims=True)
    local = np.exp(scores - peak)
    move = np.exp(trans - trans.max())
    ahead = np.empty_like(local)
    now = local[begin[: longer[0]]] * np.exp(start - start.max())
    now /= now.sum(axis=1, keepdims=True)
    ahead[begin[: longer[0]]] = now
    for t in range(1, len(longer)):
        at = begin[: longer[t]] + t
        now = (now[: longer[t]] @ move) * local[at]
        now /= now.sum(axis=1, keepdims=True)
        ahead[at] = now
    back = np.ones((longer[-1], scores.shape[1]), dtype=scores.dtype)
    for t in range(len(longer) - 1, 0, -1):
        at = begin[: longer[t]] + t
        carried = (back * local[at]) @ move.T
        carried /= carried.sum(axis=1, keepdims=True)
        back = np.ones((longer[t - 1], scores.shape[1]), dtype=scores.dtype)
        back[: longer[t]] = carried
        ahead[begin[: longer[t - 1]] + t - 1] *= back
    return ahead / ahead.sum(axis=1, keepdims=True)


def viterbi(scores: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The best state sequence."""
    begin, longer = steps(first)
    path = np.zeros(len(scores), dtype=np.int64)
    if not longer:
        return path
    came = np.zeros(scores.shape, dtype=np.int8)
    best = np.empty_like(scores)
    now = scores[begin[: longer[0]]] + start
    best[begin[: longer[0]]] = now
    for t in range(1, len(longer)):
        at = begin[: longer[t]] + t
        options = now[: longer[t], :, None] + trans[None]
        came[at] = options.argmax(axis=1)
        now = options.max(axis=1) + scores[at]
        best[at] = now
    state = np.zeros(len(begin), dtype=np.int64)
    for t in range(len(longer) - 1, -1, -1):
        at = begin[: longer[t]] + t
        ending = longer[t + 1] if t + 1 < len(longer) else 0
        state[ending : longer[t]] = best[at[ending:]].argmax(axis=1)
        path[at] = state[: longer[t]]
        if t:
            state[: longer[t]] = came[at, state[: longer[t]]]
    return path


def pair_counts(scores: np.ndarray, marginal: np.ndarray, first: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Expected number of moves between states, from neighbouring positions' marginals under ``trans``."""
    inner = np.ones(len(scores), dtype=bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    right = np.flatnonzero(inner)
    joint = marginal[right - 1][:, :, None] * np.exp(trans - trans.max())[None] * marginal[right][:, None, :]
    return (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


def adam(size: tuple[int, ...]) -> Iterator[np.ndarray]:
    """Send gradients to be ascended, get steps."""
    m, v, t = np.zeros(size), np.zeros(size), 0
    grad = yield np.zeros(size)
    while True:
        t += 1
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        grad = yield (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
