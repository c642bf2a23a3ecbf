"""A bidirectional gated recurrent network with attention pooling, in numpy.

Arrays are time-major: inputs (steps, windows, size). All parameters are float64 in training and float32 in use.
"""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


def _squash(x: np.ndarray) -> None:
    """The sigmoid in place, by exp, which is several times as fast as tanh on float32."""
    np.negative(x, out=x)
    np.minimum(x, 80, out=x)
    np.exp(x, out=x)
    x += 1.0
    np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> None:
    x *= 2.0
    _squash(x)
    x *= 2.0
    x -= 1.0


def initial(size: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["W" + d] = rng.normal(0, 1 / np.sqrt(size), (size, 3 * hidden))
        p["U" + d] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        p["c" + d] = np.zeros(3 * hidden)
    p["A"] = rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, hidden))
    p["a"], p["v"] = np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden)
    p["u"], p["o"] = rng.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden), np.zeros(1)
    return p


def _run(pre: np.ndarray, u: np.ndarray, mask: np.ndarray | None, keep: list | None) -> np.ndarray:
    """States of one direction; ``pre`` holds the projected inputs in the order of the steps."""
    steps, n, h3 = pre.shape
    k = h3 // 3
    h, out = np.zeros((n, k), pre.dtype), np.empty((steps, n, k), pre.dtype)
    for t in range(steps):
        hu = h @ u
        gates = pre[t, :, : 2 * k] + hu[:, : 2 * k]
        _squash(gates)
        z, r = gates[:, :k], gates[:, k:]
        new = r * hu[:, 2 * k :]
        new += pre[t, :, 2 * k :]
        _tanh(new)
        nxt = h - new
        nxt *= z
        nxt += new
        if mask is not None:
            nxt *= mask[t][:, None]
        if keep is not None:
            keep.append((h, hu, z, r, new))
        out[t] = h = nxt
    return out


def forward(p: dict, pre_f: np.ndarray, pre_b: np.ndarray, mask: np.ndarray | None, keep: dict | None = None) -> np.ndarray:
    """Logit of each window. ``pre_f``, ``pre_b``: inputs times W plus c; ``mask``: 1 where a step holds a word."""
    kf, kb = ([], []) if keep is not None else (None, None)
    f = _run(pre_f, p["Uf"], mask, kf)
    b = _run(pre_b[::-1], p["Ub"], None if mask is None else mask[::-1], kb)[::-1]
    h = np.concatenate([f, b], axis=2)
    hidden = h @ p["A"] + p["a"]
    _tanh(hidden)
    e = hidden @ p["v"]
    w = np.exp(e - e.max(axis=0))
    if mask is not None:
        w = w * mask
    w /= np.maximum(w.sum(axis=0), 1e-9)
    pooled = np.einsum("tn,tnk->nk", w, h)
    if keep is not None:
        keep.update(kf=kf, kb=kb, h=h, hidden=hidden, w=w, pooled=pooled)
    return pooled @ p["u"] + p["o"]


def _back(dout: np.ndarray, u: np.ndarray, mask: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs and of U from those of the states of one direction."""
    steps, n, k = dout.shape
    dpre, du, dh = np.empty((steps, n, 3 * k)), np.zeros_like(u), np.zeros((n, k))
    for t in range(steps - 1, -1, -1):
        h, hu, z, r, new = kept[t]
        d = (dout[t] + dh) * mask[t][:, None]
        dnew = d * (1 - z) * (1 - new * new)
        dz = d * (h - new) * z * (1 - z)
        dr = dnew * hu[:, 2 * k :] * r * (1 - r)
        dpre[t] = np.concatenate([dz, dr, dnew], axis=1)
        dhu = np.concatenate([dz, dr, dnew * r], axis=1)
        du += h.T @ dhu
        dh = d * z + dhu @ u.T
    return dpre, du


def gradients(p: dict, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
    """Mean weighted log loss, its gradients, and those of the inputs."""
    keep: dict = {}
    logit = forward(p, x @ p["Wf"] + p["cf"], x @ p["Wb"] + p["cb"], mask, keep)
    q, total = sigmoid(logit), weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / total)
    d = weight * (q - y) / total
    g = {"u": keep["pooled"].T @ d, "o": np.array([d.sum()])}
    h, w, hidden = keep["h"], keep["w"], keep["hidden"]
    dpool = d[:, None] * p["u"]
    dh = w[:, :, None] * dpool
    dw = np.einsum("nk,tnk->tn", dpool, h)
    de = w * (dw - (w * dw).sum(axis=0))
    g["v"] = np.einsum("tn,tnk->k", de, hidden)
    dpre = de[:, :, None] * p["v"] * (1 - hidden * hidden)
    g["A"], g["a"] = np.einsum("tni,tnj->ij", h, dpre), dpre.sum(axis=(0, 1))
    dh = dh + dpre @ p["A"].T
    k = p["Uf"].shape[0]
    df, g["Uf"] = _back(dh[:, :, :k], p["Uf"], mask, keep["kf"])
    db, g["Ub"] = _back(dh[::-1, :, k:], p["Ub"], mask[::-1], keep["kb"])
    db = db[::-1]
    g["Wf"], g["Wb"] = np.einsum("tni,tnj->ij", x, df), np.einsum("tni,tnj->ij", x, db)
    g["cf"], g["cb"] = df.sum(axis=(0, 1)), db.sum(axis=(0, 1))
    return loss, g, df @ p["Wf"].T + db @ p["Wb"].T


class Adam:
    def __init__(self, rate: float = 0.01):
        self.rate, self.t, self.m, self.s = rate, 0, {}, {}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        for name, d in g.items():
            m = self.m[name] = 0.9 * self.m.get(name, 0.0) + 0.1 * d
            s = self.s[name] = 0.999 * self.s.get(name, 0.0) + 0.001 * d * d
            p[name] = p[name] - self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(s / (1 - 0.999**self.t)) + 1e-8)
