"""A two-state linear-chain conditional random field over concatenated sequences.

The state of a position is 0 or 1.  ``e`` holds, for every position, the log
weight of state 1 against state 0; ``A`` the 2 x 2 transition weights (not
logs); ``pi`` the start weights.  All sequences of a batch lie one after another
in flat arrays; ``starts`` marks first positions.

Forward and backward passes are exact and need no padding: the flat array is cut
into blocks, the transfer matrix of each block is multiplied up for all blocks
at once, messages go from block to block, and a second sweep fills the blocks.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128


def _sweep(w0, w1, reset, A, pi):
    """Share of state 1 in the forward message, at every position, shape (blocks, BLOCK)."""
    n, b = w0.shape
    m00, m01, m10, m11 = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
    step = []
    for t in range(b):
        r = reset[:, t]
        a00, a10 = np.where(r, pi[0], A[0, 0]) * w0[:, t], np.where(r, pi[0], A[1, 0]) * w0[:, t]
        a01, a11 = np.where(r, pi[1], A[0, 1]) * w1[:, t], np.where(r, pi[1], A[1, 1]) * w1[:, t]
        step.append((a00, a01, a10, a11))
        m00, m01, m10, m11 = m00 * a00 + m01 * a10, m00 * a01 + m01 * a11, m10 * a00 + m11 * a10, m10 * a01 + m11 * a11
        s = m00 + m01 + m10 + m11
        m00, m01, m10, m11 = m00 / s, m01 / s, m10 / s, m11 / s
    p, into = 0.5, np.empty(n)
    for i, (a, c, d, f) in enumerate(zip(m00.tolist(), m01.tolist(), m10.tolist(), m11.tolist())):
        into[i] = p
        one, zero = (1 - p) * c + p * f, (1 - p) * a + p * d
        p = one / (one + zero)
    out = np.empty((n, b))
    for t, (a00, a01, a10, a11) in enumerate(step):
        one, zero = (1 - into) * a01 + into * a11, (1 - into) * a00 + into * a10
        into = one / (one + zero)
        out[:, t] = into
    return out


def forward_backward(e, starts, A, pi):
    """Shares of state 1: forward messages, backward messages, marginals; flat arrays."""
    size = len(e)
    if not size:
        return np.empty(0), np.empty(0), np.empty(0)
    n = -(-size // BLOCK)
    w1 = np.full(n * BLOCK, 0.5)
    w1[:size] = 1 / (1 + np.exp(-np.clip(e, -20, 20)))
    w0 = 1 - w1
    reset = np.ones(n * BLOCK, bool)
    reset[:size] = starts
    fwd = _sweep(w0.reshape(n, BLOCK), w1.reshape(n, BLOCK), reset.reshape(n, BLOCK), A, pi).ravel()[:size]
    # Backward: with x(t) = weights(t) * beta(t), x(t) is a forward message of the
    # reversed chain under the transposed transitions.
    ends = np.ones(n * BLOCK, bool)
    ends[: size - 1] = reset[1:size]
    back = _sweep(*(x[::-1].reshape(n, BLOCK) for x in (w0, w1, ends)), A.T, np.ones(2)).ravel()[::-1][:size]
    beta1, beta0 = back / w1[:size], (1 - back) / w0[:size]
    one, zero = fwd * beta1, (1 - fwd) * beta0
    return fwd, beta1 / (beta1 + beta0), one / (one + zero)


def expected_transitions(e, starts, A, fwd, bwd):
    """Expected counts of the four transitions inside sequences."""
    inner = np.flatnonzero(~starts)
    w1 = 1 / (1 + np.exp(-np.clip(e[inner], -20, 20)))
    f, g = fwd[inner - 1], bwd[inner]
    x = np.stack([(1 - f) * A[0, 0] * (1 - w1) * (1 - g), (1 - f) * A[0, 1] * w1 * g, f * A[1, 0] * (1 - w1) * (1 - g), f * A[1, 1] * w1 * g])
    return (x / x.sum(0)).sum(1).reshape(2, 2) if len(inner) else np.zeros((2, 2))


def fit(emit, grad, size, y, starts, rounds=40, rate=0.25, l2=1e-4):
    """Maximum conditional likelihood by full-batch Adam.

    emit(w) gives e; grad(d) maps per-position residuals to the gradient of w.
    y: states of the labelled positions.  Returns w, A, pi.
    """
    w, T = np.zeros(size), np.zeros((2, 2))
    inner = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inner - 1], y[inner]), 1)
    first = y[starts].mean() if starts.any() else 0.5
    pi = np.array([1 - first, first]) + 1e-3
    moments = [np.zeros(size + 4), np.zeros(size + 4)]
    total = max(1, len(y))
    for k in range(1, rounds + 1):
        A, e = np.exp(T), emit(w)
        fwd, bwd, p = forward_backward(e, starts, A, pi)
        g = np.concatenate([grad(y - p) / total - l2 * w, ((seen - expected_transitions(e, starts, A, fwd, bwd)) / total - l2 * T).ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * g
        moments[1] = 0.99 * moments[1] + 0.01 * g * g
        move = rate * (moments[0] / (1 - 0.9**k)) / (np.sqrt(moments[1] / (1 - 0.99**k)) + 1e-10)
        w, T = w + move[:size], np.clip(T + move[size:].reshape(2, 2), -6, 6)
    return w, np.exp(T), pi


def logistic(x, y, rounds=200, l2=1e-3):
    """Newton fit of a small logistic regression with intercept; returns the weights, intercept last."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 30)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + l2 * np.eye(len(w))
        w = w + np.linalg.solve(h, x.T @ (y - p) - l2 * w)
    return w


def apply_logistic(w, x):
    return 1 / (1 + np.exp(-np.clip(np.column_stack([x, np.ones(len(x))]) @ w, -30, 30)))
