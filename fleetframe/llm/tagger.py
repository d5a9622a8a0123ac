"""A character-level bidirectional LSTM with CRF transitions, in numpy.

Trained from texts with labelled spans by the negative log likelihood of the
tag sequence (forward-backward through the CRF, back-propagation through
both LSTMs, Adam).  Windows are decoded in batches by Viterbi.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
OUT, TAGS = 0, 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
# Classes of characters: these each, then digits, a-z, A-Z, white space, other.
SINGLE = "@.-+()%_:/,[]<>'\"*#="
CLASSES = len(SINGLE) + 7


def classes(text: str) -> np.ndarray:
    """The class of each character; 0 pads."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(code), CLASSES - 1, np.int64)
    for k, (a, b) in enumerate((("0", "9"), ("a", "z"), ("A", "Z"))):
        out[(code >= ord(a)) & (code <= ord(b))] = len(SINGLE) + 1 + k
    out[(code == 32) | ((code >= 9) & (code <= 13))] = len(SINGLE) + 4
    for k, c in enumerate(SINGLE):
        out[code == ord(c)] = k + 1
    out[code >= 128] = len(SINGLE) + 5
    return out


def tags_of(length: int, spans: Sequence[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


def spans_of(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Runs of one kind; a new one at each begin tag."""
    out, start, kind = [], None, 0
    for i, t in enumerate([*tags.tolist(), OUT]):
        k = (t + 1) // 2
        if start is not None and (k != kind or t == 2 * kind - 1):
            out.append((KINDS[kind - 1], start, i))
            start = None
        if k and start is None:
            start, kind = i, k
    return out


@dataclass
class Tagger:
    """Weights: for both directions x (classes, 4h), u (h, 4h), b (4h); the
    emissions o (2h, tags) and c (tags); the transitions t (tags, tags) and
    s (first tag)."""

    w: dict[str, np.ndarray]

    def _lstm(self, side: str, x: np.ndarray, live: np.ndarray, keep: bool = False):
        """Hidden states (time, batch, h); padded steps keep the state."""
        wx, u, b = self.w["x" + side], self.w["u" + side], self.w["b" + side]
        steps, n, h = x.shape[0], x.shape[1], u.shape[0]
        state, cell = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, memo = np.zeros((steps, n, h), np.float32), []
        for t in (range(steps) if side == "f" else range(steps - 1, -1, -1)):
            z = wx[x[t]] + state @ u + b
            g = np.empty_like(z)
            g[:, :3 * h] = 1 / (1 + np.exp(-np.clip(z[:, :3 * h], -30, 30)))
            g[:, 3 * h:] = np.tanh(z[:, 3 * h:])
            i, f, o, a = g[:, :h], g[:, h:2 * h], g[:, 2 * h:3 * h], g[:, 3 * h:]
            new = f * cell + i * a
            m = live[t][:, None]
            new = np.where(m, new, cell)
            th = np.tanh(new)
            hidden = np.where(m, o * th, state)
            if keep:
                memo.append((t, g, cell, new, th, state, m))
            state, cell = hidden, new
            out[t] = hidden * m
        return out, memo

    def emissions(self, x: np.ndarray, keep: bool = False):
        """x is (time, batch) classes, 0 where padded."""
        live = x > 0
        f, mf = self._lstm("f", x, live, keep)
        b, mb = self._lstm("b", x, live, keep)
        hid = np.concatenate([f, b], axis=2)
        return hid @ self.w["o"] + self.w["c"], hid, live, mf, mb

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The best tags (time, batch) of padded windows."""
        e, _, live, _, _ = self.emissions(x)
        t = self.w["t"]
        best, back = e[0] + self.w["s"], np.zeros(e.shape, np.int8)
        for k in range(1, len(e)):
            s = best[:, :, None] + t
            back[k] = s.argmax(axis=1)
            best = np.where(live[k][:, None], s.max(axis=1) + e[k], best)
        tag, out = best.argmax(axis=1), np.zeros(x.shape, np.int64)
        for k in range(len(e) - 1, -1, -1):
            out[k] = np.where(live[k], tag, OUT)
            if k:
                tag = np.where(live[k], back[k][np.arange(len(tag)), tag], tag)
        return out

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        e, hid, live, mf, mb = self.emissions(x, keep=True)
        w, steps, n = self.w, len(e), e.shape[1]
        t = w["t"]
        fwd = np.zeros_like(e)
        fwd[0] = e[0] + w["s"]
        log_sum = lambda a, axis: (m := a.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis=axis))
        for k in range(1, steps):
            fwd[k] = np.where(live[k][:, None], log_sum(fwd[k - 1][:, :, None] + t, 1) + e[k], fwd[k - 1])
        bwd = np.zeros_like(e)
        for k in range(steps - 2, -1, -1):
            bwd[k] = np.where(live[k + 1][:, None], log_sum(t + (e[k + 1] + bwd[k + 1])[:, None, :], 2), bwd[k + 1])
        total = log_sum(fwd[-1], 1)
        seen = np.exp(fwd + bwd - total[:, None]) * live[:, :, None]
        gold = np.eye(TAGS, dtype=np.float32)[y] * live[:, :, None]
        de = (seen - gold) / n
        g = {"s": de[0].sum(axis=0), "t": np.zeros_like(t)}
        for k in range(1, steps):
            pair = np.exp(fwd[k - 1][:, :, None] + t + (e[k] + bwd[k])[:, None, :] - total[:, None, None])
            pair *= live[k][:, None, None]
            g["t"] += pair.sum(axis=0) / n
            np.subtract.at(g["t"], (y[k - 1][live[k]], y[k][live[k]]), 1 / n)
        g["o"] = np.einsum("tbh,tbk->hk", hid, de)
        g["c"] = de.sum(axis=(0, 1))
        dh_all = de @ w["o"].T
        h = w["uf"].shape[0]
        for side, memo, part in (("f", mf, dh_all[:, :, :h]), ("b", mb, dh_all[:, :, h:])):
            gx, gu, gb = (np.zeros_like(w[c + side]) for c in "xub")
            dh, dc = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
            for k, gate, cell, _, th, state, m in reversed(memo):
                i, f, o, a = gate[:, :h], gate[:, h:2 * h], gate[:, 2 * h:3 * h], gate[:, 3 * h:]
                d = dh + part[k]
                c = dc + d * o * (1 - th * th)
                dz = np.concatenate([c * a * i * (1 - i), c * cell * f * (1 - f), d * th * o * (1 - o), c * i * (1 - a * a)], axis=1) * m
                np.add.at(gx, x[k], dz)
                gu += state.T @ dz
                gb += dz.sum(axis=0)
                dh = np.where(m, dz @ w["u" + side].T, dh)
                dc = np.where(m, c * f, dc)
            g["x" + side], g["u" + side], g["b" + side] = gx, gu, gb
        return g


def train(examples: Sequence[tuple[str, Sequence[tuple[str, int, int]]]], hidden: int = 24, epochs: int = 10,
          batch: int = 64, rate: float = 0.01, seed: int = 7) -> Tagger:
    """A tagger fitted to (text, spans) examples; reruns agree."""
    rng = np.random.default_rng(seed)
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    w = {"o": small(2 * hidden, TAGS), "c": np.zeros(TAGS, np.float32), "t": small(TAGS, TAGS), "s": small(TAGS)}
    for side in "fb":
        w |= {"x" + side: small(CLASSES, 4 * hidden), "u" + side: small(hidden, 4 * hidden),
              "b" + side: np.repeat(np.float32([0, 1, 0, 0]), hidden)}
    tagger, one, two, step = Tagger(w), {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    data = [(classes(t), tags_of(len(t), s)) for t, s in examples]
    order = sorted(range(len(data)), key=lambda i: len(data[i][0]))
    groups = [order[i:i + batch] for i in range(0, len(order), batch)]
    for epoch in range(epochs):
        for at in rng.permutation(len(groups)):
            group = groups[at]
            steps = max(len(data[i][0]) for i in group)
            x, y = np.zeros((steps, len(group)), np.int64), np.zeros((steps, len(group)), np.int64)
            for b, i in enumerate(group):
                x[:len(data[i][0]), b], y[:len(data[i][0]), b] = data[i]
            g, step = tagger._gradients(x, y), step + 1
            scale = min(1.0, 5.0 / (float(np.sqrt(sum((v * v).sum() for v in g.values()))) + 1e-9))
            now = rate * (1 - 0.9 * epoch / epochs)
            for k, v in g.items():
                v = v * scale
                one[k] = 0.9 * one[k] + 0.1 * v
                two[k] = 0.999 * two[k] + 0.001 * v * v
                w[k] -= (now * (one[k] / (1 - 0.9 ** step)) / (np.sqrt(two[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return tagger
