"""Models that a fold trains, in NumPy: attention or degree-weighted message passing, a transformer, and a baseline.

A fold's data is its task's group: a few hundred features and profiles. Gradients come from a short tape.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


class Value:
    """An array and how its gradient flows to what it was made from."""

    def __init__(self, data, parents=(), back=None):
        self.data, self.parents, self.back, self.grad = np.asarray(data, dtype=float), parents, back, None

    def backward(self) -> None:
        order, seen, stack = [], set(), [(self, False)]
        while stack:
            node, done = stack.pop()
            if done:
                order.append(node)
            elif id(node) not in seen:
                seen.add(id(node))
                stack += [(node, True), *((p, False) for p in node.parents)]
        self.grad = np.ones_like(self.data)
        for node in reversed(order):
            if node.back:
                for p, g in zip(node.parents, node.back(node.grad), strict=True):
                    g = _shrunk(g, p.data.shape)
                    p.grad = g if p.grad is None else p.grad + g

    def __add__(self, o):
        o = _value(o)
        return Value(self.data + o.data, (self, o), lambda g: (g, g))

    def __mul__(self, o):
        o = _value(o)
        return Value(self.data * o.data, (self, o), lambda g: (g * o.data, g * self.data))

    def __sub__(self, o):
        return self + _value(o) * -1.0

    def __matmul__(self, o):
        return Value(self.data @ o.data, (self, o), lambda g: (g @ np.swapaxes(o.data, -1, -2), np.swapaxes(self.data, -1, -2) @ g))

    def pow(self, p: float):
        return Value(self.data**p, (self,), lambda g: (g * p * self.data ** (p - 1),))

    def exp(self):
        out = np.exp(self.data)
        return Value(out, (self,), lambda g: (g * out,))

    def elu(self):
        out = np.where(self.data > 0, self.data, np.expm1(np.minimum(self.data, 0)))
        return Value(out, (self,), lambda g: (g * np.where(self.data > 0, 1.0, out + 1),))

    def leaky(self, slope: float):
        return Value(np.where(self.data > 0, self.data, slope * self.data), (self,), lambda g: (g * np.where(self.data > 0, 1.0, slope),))

    def mean(self, axis: int):
        n = self.data.shape[axis]
        return Value(self.data.mean(axis=axis, keepdims=True), (self,), lambda g: (np.broadcast_to(g / n, self.data.shape),))

    def sum(self, axis: int):
        return Value(self.data.sum(axis=axis, keepdims=True), (self,), lambda g: (np.broadcast_to(g, self.data.shape),))

    def rows(self, at: np.ndarray):
        """Rows ``at``; their gradients add up."""

        return Value(self.data[at], (self,), lambda g: (_added(g, at, len(self.data)),))

    def sum_by(self, at: np.ndarray, n: int):
        """Rows added up by ``at``."""
        return Value(_added(self.data, at, n), (self,), lambda g: (g[at],))

    def passed(self, weight: "Value", src: np.ndarray, dst: np.ndarray):
        """Messages of (feature, head, width), weighted by (edge, head) and added up by ``dst``: a matrix product a head, of as
        many rows and columns as there are features, whatever the number of edges."""
        n, heads, _ = self.data.shape
        cell = dst * n + src
        by = [np.bincount(cell, weight.data[:, k], minlength=n * n).reshape(n, n) for k in range(heads)]

        def back(g):
            own = np.stack([by[k].T @ g[:, k] for k in range(heads)], axis=1)
            return own, np.stack([(g[:, k] @ self.data[:, k].T).ravel()[cell] for k in range(heads)], axis=1)

        return Value(np.stack([by[k] @ self.data[:, k] for k in range(heads)], axis=1), (self, weight), back)

    def reshape(self, *shape: int):
        return Value(self.data.reshape(shape), (self,), lambda g: (g.reshape(self.data.shape),))

    def swap(self, a: int, b: int):
        return Value(np.swapaxes(self.data, a, b), (self,), lambda g: (np.swapaxes(g, a, b),))


def _places(at: np.ndarray, width: int) -> np.ndarray:
    """Places of rows ``at`` in an array of that width, laid out flat."""
    return (at[:, None] * width + np.arange(width)).ravel()


def _added(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    width = int(np.prod(x.shape[1:]))
    return np.bincount(_places(at, width), x.ravel(), minlength=n * width).reshape(n, *x.shape[1:])


def _value(x) -> Value:
    return x if isinstance(x, Value) else Value(x)


def _shrunk(g: np.ndarray, shape: tuple[int, ...]) -> np.ndarray:
    """A gradient summed over what was broadcast."""
    while g.ndim > len(shape):
        g = g.sum(axis=0)
    for i, n in enumerate(shape):
        if n == 1 and g.shape[i] != 1:
            g = g.sum(axis=i, keepdims=True)
    return g


def _standard(x: Value, axis: int, epsilon: float = 1e-5) -> Value:
    d = x - x.mean(axis)
    return d * ((d * d).mean(axis) + epsilon).pow(-0.5)


class Weights:
    """Named parameters, drawn uniformly within 1 / sqrt(inputs)."""

    def __init__(self, rng: np.random.Generator):
        self.rng, self.own = rng, {}

    def linear(self, name: str, inputs: int, outputs: int) -> None:
        bound = 1 / np.sqrt(inputs)
        self.own[f"{name}.w"] = Value(self.rng.uniform(-bound, bound, (inputs, outputs)))
        self.own[f"{name}.b"] = Value(self.rng.uniform(-bound, bound, (1, outputs)))

    def scale(self, name: str, n: int) -> None:
        self.own[f"{name}.g"], self.own[f"{name}.b"] = Value(np.ones((1, n))), Value(np.zeros((1, n)))

    def apply(self, name: str, x: Value) -> Value:
        return x @ self.own[f"{name}.w"] + self.own[f"{name}.b"]

    def scaled(self, name: str, x: Value) -> Value:
        return x * self.own[f"{name}.g"] + self.own[f"{name}.b"]


@dataclass
class Trained:
    """Hyperparameters and the loop that all trained models share: AdamW, a cosine schedule, clipped gradients, one step a
    condition, conditions shuffled in each epoch, a fresh model a fold."""

    hidden: int = 128
    heads: int = 8
    layers: int = 3
    rate: float = 5e-4
    decay: float = 1e-4
    epochs: int = 50
    dropout: float = 0.1
    clip: float = 1.0

    def build(self, w: Weights, n: int) -> None:
        raise NotImplementedError

    def forward(self, w: Weights, control: np.ndarray, dose: np.ndarray, edges: np.ndarray, state: dict, training: bool) -> Value:
        raise NotImplementedError

    def start(self, w: Weights) -> None:
        w.linear("in", 1, self.hidden)
        w.scale("in.norm", self.hidden)
        w.linear("head", self.hidden, 1)

    def embedded(self, w: Weights, control: np.ndarray) -> Value:
        return w.scaled("in.norm", _standard(w.apply("in", Value(control[:, None])), 1)).elu()

    def dropped(self, w: Weights, x: Value, training: bool) -> Value:
        if not training or not self.dropout:
            return x
        return x * ((w.rng.random(x.data.shape) >= self.dropout) / (1 - self.dropout))

    def batch_norm(self, w: Weights, name: str, x: Value, state: dict, training: bool) -> Value:
        """Over features; running moments, moved by a tenth, when predicting."""
        if training:
            m, v = x.data.mean(axis=0), x.data.var(axis=0) * len(x.data) / max(1, len(x.data) - 1)
            old = state.get(name, (np.zeros_like(m), np.ones_like(v)))
            state[name] = 0.9 * old[0] + 0.1 * m, 0.9 * old[1] + 0.1 * v
            return w.scaled(name, _standard(x, 0))
        m, v = state.get(name, (0.0, 1.0))
        return w.scaled(name, (x - m) * (1 / np.sqrt(v + 1e-5)))

    def predict(self, control: np.ndarray, masks: np.ndarray, profiles: np.ndarray, mask: np.ndarray, edges: np.ndarray, seed: int) -> np.ndarray:
        w = Weights(np.random.default_rng(seed))
        self.build(w, len(control))
        first = {k: np.zeros_like(v.data) for k, v in w.own.items()}
        second = {k: np.zeros_like(v.data) for k, v in w.own.items()}
        state: dict = {}
        step, order = 0, np.arange(len(profiles))
        dose = lambda m: np.where(m, 0.0, 1.0)[:, None]
        for epoch in range(self.epochs):
            rate = self.rate * 0.5 * (1 + np.cos(np.pi * epoch / self.epochs))
            w.rng.shuffle(order)
            for i in order:
                for v in w.own.values():
                    v.grad = None
                miss = self.forward(w, control, dose(masks[i]), edges, state, True) - profiles[i][:, None]
                (miss * miss).mean(0).backward()
                grads = {k: v.grad for k, v in w.own.items() if v.grad is not None}
                size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                shrink = min(1.0, self.clip / (size + 1e-6))
                step += 1
                for k, g in grads.items():
                    g = g * shrink
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    own = w.own[k].data * (1 - rate * self.decay)
                    w.own[k].data = own - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        return self.forward(w, control, dose(mask), edges, state, False).data[:, 0]


class Attention(Trained):
    """Message passing with attention, heads averaged, and a residual from the masked input."""

    def build(self, w: Weights, n: int) -> None:
        self.start(w)
        w.linear("residual", self.hidden, self.hidden)
        for i in range(self.layers):
            w.linear(f"conv{i}", self.hidden, self.hidden * self.heads)
            for side in ("src", "dst"):
                w.own[f"conv{i}.{side}"] = Value(w.rng.normal(0, 1 / np.sqrt(self.hidden), (1, self.heads, self.hidden)))
            w.own[f"conv{i}.bias"] = Value(np.zeros((1, self.hidden)))
            w.scale(f"norm{i}", self.hidden)

    def layer(self, w: Weights, i: int, x: Value, edges: np.ndarray, training: bool) -> Value:
        n = len(x.data)
        h = (x @ w.own[f"conv{i}.w"]).reshape(n, self.heads, self.hidden)
        src, dst = edges[:, 0], edges[:, 1]
        score = lambda side: (h * w.own[f"conv{i}.{side}"]).sum(2).reshape(n, self.heads)
        e = (score("src").rows(src) + score("dst").rows(dst)).leaky(0.2)
        top = np.full((n, self.heads), -np.inf)
        np.maximum.at(top.reshape(-1), _places(dst, self.heads), e.data.ravel())
        weight = (e - top[dst]).exp()
        alpha = weight * (weight.sum_by(dst, n) + 1e-16).pow(-1.0).rows(dst)
        return h.passed(self.dropped(w, alpha, training), src, dst).mean(1).reshape(n, self.hidden) + w.own[f"conv{i}.bias"]

    def forward(self, w, control, dose, edges, state, training):
        x = self.embedded(w, control) * dose
        residual = w.apply("residual", x)
        for i in range(self.layers):
            x = self.batch_norm(w, f"norm{i}", self.layer(w, i, x, edges, training), state, training)
            x = (x + residual).elu() if i == self.layers - 1 else self.dropped(w, x.elu(), training)
        return w.apply("head", x)


class Convolution(Trained):
    """Message passing with weights by degree; no residual."""

    def build(self, w: Weights, n: int) -> None:
        self.start(w)
        for i in range(self.layers):
            w.linear(f"conv{i}", self.hidden, self.hidden)
            w.scale(f"norm{i}", self.hidden)

    def forward(self, w, control, dose, edges, state, training):
        n, (src, dst) = len(control), edges.T
        degree = np.maximum(1, np.bincount(dst, minlength=n))
        by = Value((1 / np.sqrt(degree[src] * degree[dst]))[:, None])
        x = self.embedded(w, control) * dose
        for i in range(self.layers):
            x = (x @ w.own[f"conv{i}.w"]).reshape(n, 1, self.hidden).passed(by, src, dst).reshape(n, self.hidden)
            x = self.batch_norm(w, f"norm{i}", x + w.own[f"conv{i}.b"], state, training).elu()
            if i < self.layers - 1:
                x = self.dropped(w, x, training)
        return w.apply("head", x)


@dataclass
class Transformer(Trained):
    """Attention among all features, with learned places; masked after places are added."""

    heads: int = 4
    layers: int = 2
    wide: int = 256

    def build(self, w: Weights, n: int) -> None:
        self.start(w)
        w.own["place"] = Value(w.rng.normal(0, 0.02, (n, self.hidden)))
        for i in range(self.layers):
            for name in ("q", "k", "v", "o"):
                w.linear(f"{i}{name}", self.hidden, self.hidden)
            w.linear(f"{i}up", self.hidden, self.wide)
            w.linear(f"{i}down", self.wide, self.hidden)
            w.scale(f"{i}a", self.hidden)
            w.scale(f"{i}b", self.hidden)

    def forward(self, w, control, dose, edges, state, training):
        n, size = len(control), self.hidden // self.heads
        x = (self.embedded(w, control) + w.own["place"]) * dose
        split = lambda y: y.reshape(n, self.heads, size).swap(0, 1)
        for i in range(self.layers):
            y = w.scaled(f"{i}a", _standard(x, 1))
            q, k, v = (split(w.apply(f"{i}{c}", y)) for c in "qkv")
            e = (q @ k.swap(1, 2)) * (1 / np.sqrt(size))
            p = (e - e.data.max(axis=2, keepdims=True)).exp()
            mixed = ((p * p.sum(2).pow(-1.0)) @ v).swap(0, 1).reshape(n, self.hidden)
            x = x + self.dropped(w, w.apply(f"{i}o", mixed), training)
            y = w.apply(f"{i}up", w.scaled(f"{i}b", _standard(x, 1))).leaky(0.0)
            x = x + self.dropped(w, w.apply(f"{i}down", self.dropped(w, y, training)), training)
        return w.apply("head", x)


class MeanOfOthers:
    """A baseline: the mean of the training profiles."""

    def predict(self, control, masks, profiles, mask, edges, seed):
        return profiles.mean(axis=0) if len(profiles) else control.copy()
