"""A linear-chain conditional random field in numpy.

Sequences are rows of one flat emission matrix plus offsets; forward-backward and Viterbi run time
step by time step over all sequences of a batch at once (longest first, so the active set only
shrinks). A second transition matrix applies where ``breaks`` marks a position (for instance the
first word of a sentence inside a document).
"""

from __future__ import annotations

import numpy as np


class Layout:
    """Time-major order of ragged sequences: ``order[k0[t]:k0[t] + k[t]]`` are the flat rows at step t."""

    def __init__(self, lengths: np.ndarray) -> None:
        lengths = np.asarray(lengths, np.int64)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]) if len(lengths) else np.zeros(0, np.int64)
        by = np.argsort(-lengths, kind="stable")
        sl, ss = lengths[by], starts[by]
        top = int(sl[0]) if len(sl) else 0
        # sequences of length > t, for every t
        self.k = np.searchsorted(-sl, -np.arange(1, top + 1), side="right")
        self.first = ss
        total = int(lengths.sum())
        step = np.repeat(np.arange(top), self.k)
        self.k0 = np.concatenate([[0], np.cumsum(self.k)[:-1]]) if top else np.zeros(0, np.int64)
        rank = np.arange(total) - np.repeat(self.k0, self.k)
        self.order = ss[rank] + step if total else np.zeros(0, np.int64)
        self.steps = top


def forward_backward(
    emissions: np.ndarray, layout: Layout, trans: np.ndarray, start: np.ndarray,
    breaks: np.ndarray | None = None, trans_break: np.ndarray | None = None, want_pairs: bool = False,
) -> tuple[np.ndarray, float, np.ndarray | None, np.ndarray | None]:
    """Posterior marginals (flat order), log-likelihood normaliser and, if wanted, expected transition counts."""
    n, m = emissions.shape
    post = np.zeros((n, m), np.float32)
    if n == 0:
        return post, 0.0, np.zeros((m, m)), np.zeros((m, m))
    o = layout.order
    e = emissions[o]
    top = e.max(axis=1, keepdims=True)
    e = np.exp(e - top)
    a, ab = np.exp(trans), np.exp(trans_break if trans_break is not None else trans)
    flags = breaks[o] if breaks is not None else None
    broken = np.logical_or.reduceat(flags, layout.k0).tolist() if flags is not None else [False] * layout.steps  # has a step any break?
    alpha = np.empty((n, m), e.dtype)
    scale = np.empty(n, e.dtype)
    k, k0 = layout.k.tolist(), layout.k0.tolist()
    x = e[: k[0]] * np.exp(start)
    s = x.sum(axis=1)
    alpha[: k[0]] = x / s[:, None]
    scale[: k[0]] = s
    for t in range(1, layout.steps):
        lo, c = k0[t], k[t]
        prev = alpha[k0[t - 1] : k0[t - 1] + c]
        x = prev @ a
        if broken[t]:
            f = flags[lo : lo + c]
            x[f] = prev[f] @ ab
        x *= e[lo : lo + c]
        s = x.sum(axis=1)
        np.maximum(s, 1e-30, out=s)
        alpha[lo : lo + c] = x / s[:, None]
        scale[lo : lo + c] = s
    log_z = float(np.log(scale).sum() + top.sum())
    beta = np.ones((n, m), e.dtype)
    pairs = np.zeros((m, m)) if want_pairs else None
    pairs_b = np.zeros((m, m)) if want_pairs else None
    for t in range(layout.steps - 1, 0, -1):
        lo, c, lp = k0[t], k[t], k0[t - 1]
        w = beta[lo : lo + c] * e[lo : lo + c] / scale[lo : lo + c, None]
        back = w @ a.T
        f = flags[lo : lo + c] if broken[t] else None
        if f is not None:
            back[f] = w[f] @ ab.T
        beta[lp : lp + c] = back
        if want_pairs:
            prev = alpha[lp : lp + c]
            if f is None:
                pairs += prev.T @ w
            else:
                pairs += prev[~f].T @ w[~f]
                pairs_b += prev[f].T @ w[f]
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    post[o] = p
    if want_pairs:
        pairs *= a
        pairs_b *= ab
    return post, log_z, pairs, pairs_b


def viterbi(emissions: np.ndarray, layout: Layout, trans: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Best label of every row, in flat order."""
    n, m = emissions.shape
    out = np.zeros(n, np.int64)
    if n == 0:
        return out
    o = layout.order
    e = emissions[o]
    k, k0 = layout.k.tolist(), layout.k0.tolist()
    back = np.zeros((n, m), np.int16)
    score = e[: k[0]] + start
    last = {}
    for t in range(1, layout.steps):
        c = k[t]
        if c < len(score):
            last[t - 1] = score[c:]
        cand = score[:c, :, None] + trans[None]
        best = cand.argmax(axis=1)
        back[k0[t] : k0[t] + c] = best
        score = np.take_along_axis(cand, best[:, None, :], axis=1)[:, 0] + e[k0[t] : k0[t] + c]
    last[layout.steps - 1] = score
    path = np.zeros(n, np.int64)
    cur = np.zeros(0, np.int64)
    for t in range(layout.steps - 1, -1, -1):
        if t in last:
            cur = np.concatenate([cur, last[t].argmax(axis=1)])
        lo, c = k0[t], k[t]
        path[lo : lo + c] = cur
        if t:
            cur = np.take_along_axis(back[lo : lo + c], cur[:, None], axis=1)[:, 0].astype(np.int64)
    out[o] = path
    return out


class Adam:
    """Plain Adam over a dict of arrays."""

    def __init__(self, lr: float = 0.1) -> None:
        self.lr, self.t, self.m, self.v = lr, 0, {}, {}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for key, g in grads.items():
            m = self.m.setdefault(key, np.zeros_like(g))
            v = self.v.setdefault(key, np.zeros_like(g))
            m *= 0.9
            m += 0.1 * g
            v *= 0.98
            v += 0.02 * g * g
            params[key] += self.lr * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.98**self.t)) + 1e-6)
