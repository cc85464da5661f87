"""A bidirectional gated recurrent network with attention pooling, forward and backward passes in numpy.

Inputs are vectors of words in windows, ``(windows, steps, inputs)`` with a mask; the output is one logit a window.
"""

from __future__ import annotations

import numpy as np

Params = dict[str, np.ndarray]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def initial(inputs: int, hidden: int, rng: np.random.Generator) -> Params:
    def drawn(*shape):
        return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

    params: Params = {}
    for way in ("f", "b"):
        params[f"{way}_in"] = drawn(inputs, 3 * hidden)
        params[f"{way}_gates"] = drawn(hidden, 2 * hidden)
        params[f"{way}_state"] = drawn(hidden, hidden)
        params[f"{way}_bias"] = np.zeros(3 * hidden, dtype=np.float32)
    params["query_in"] = drawn(2 * hidden, hidden)
    params["query"] = drawn(hidden)
    params["out"] = drawn(2 * hidden)
    params["bias"] = np.full(1, -1.0, dtype=np.float32)
    return params


def _swept(params: Params, way: str, driven: np.ndarray, mask: np.ndarray, keep: bool):
    """States along one direction; ``driven`` is the input's part of update, reset and candidate."""
    windows, steps, three = driven.shape
    hidden = three // 3
    gates_w, state_w = params[f"{way}_gates"], params[f"{way}_state"]
    states = np.zeros((windows, steps, hidden), dtype=np.float32)
    h = np.zeros((windows, hidden), dtype=np.float32)
    tape = []
    for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
        x = driven[:, t]
        gates = sigmoid(x[:, :2 * hidden] + h @ gates_w)
        update, reset = gates[:, :hidden], gates[:, hidden:]
        gated = reset * h
        candidate = np.tanh(x[:, 2 * hidden:] + gated @ state_w)
        m = mask[:, t, None]
        after = h + m * update * (candidate - h)
        if keep:
            tape.append((t, h, update, reset, gated, candidate, m))
        h = after
        states[:, t] = h
    return states, tape


def _swept_back(params: Params, way: str, tape, d_states: np.ndarray, grads: Params) -> np.ndarray:
    gates_w, state_w = params[f"{way}_gates"], params[f"{way}_state"]
    windows, steps, hidden = d_states.shape
    d_driven = np.zeros((windows, steps, 3 * hidden), dtype=np.float32)
    d_gates_w, d_state_w = np.zeros_like(gates_w), np.zeros_like(state_w)
    d_h = np.zeros((windows, hidden), dtype=np.float32)
    for t, h, update, reset, gated, candidate, m in reversed(tape):
        d_h = d_h + d_states[:, t]
        d_update = d_h * m * (candidate - h) * update * (1 - update)
        d_candidate = d_h * m * update * (1 - candidate ** 2)
        d_gated = d_candidate @ state_w.T
        d_reset = d_gated * h * reset * (1 - reset)
        both = np.concatenate([d_update, d_reset], axis=1)
        d_driven[:, t, :2 * hidden] = both
        d_driven[:, t, 2 * hidden:] = d_candidate
        d_gates_w += h.T @ both
        d_state_w += gated.T @ d_candidate
        d_h = d_h * (1 - m * update) + d_gated * reset + both @ gates_w.T
    grads[f"{way}_gates"], grads[f"{way}_state"] = d_gates_w, d_state_w
    grads[f"{way}_bias"] = d_driven.sum(axis=(0, 1))
    return d_driven


def _pooled(params: Params, states: np.ndarray, mask: np.ndarray):
    asked = np.tanh(states @ params["query_in"])
    weight = asked @ params["query"]
    weight = np.where(mask > 0, weight, -1e9)
    weight = np.exp(weight - weight.max(axis=1, keepdims=True)) * (mask > 0)
    weight = weight / np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
    return np.einsum("wt,wth->wh", weight, states), weight, asked


def drive(params: Params, x: np.ndarray) -> np.ndarray:
    """The input's part of all gates, forward and backward side by side; depends on the word alone."""
    return np.concatenate([x @ params[f"{way}_in"] + params[f"{way}_bias"] for way in ("f", "b")], axis=-1)


def logits(params: Params, driven: np.ndarray, mask: np.ndarray) -> np.ndarray:
    half = driven.shape[-1] // 2
    states = np.concatenate([_swept(params, "f", driven[..., :half], mask, False)[0],
                             _swept(params, "b", driven[..., half:], mask, False)[0]], axis=2)
    return _pooled(params, states, mask)[0] @ params["out"] + params["bias"][0]


def loss_gradients(params: Params, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Weighted logistic loss, gradients of the parameters, and of the inputs."""
    half = 3 * params["f_state"].shape[0]
    driven = drive(params, x)
    f_states, f_tape = _swept(params, "f", driven[..., :half], mask, True)
    b_states, b_tape = _swept(params, "b", driven[..., half:], mask, True)
    states = np.concatenate([f_states, b_states], axis=2)
    pooled, attention, asked = _pooled(params, states, mask)
    z = pooled @ params["out"] + params["bias"][0]
    p = sigmoid(z)
    loss = float((weight * np.logaddexp(0, np.where(y > 0, -z, z))).sum())
    d_z = (weight * (p - y)).astype(np.float32)
    grads: Params = {"out": pooled.T @ d_z, "bias": np.array([d_z.sum()], dtype=np.float32)}
    d_pooled = d_z[:, None] * params["out"]
    d_states = attention[:, :, None] * d_pooled[:, None, :]
    d_attention = np.einsum("wth,wh->wt", states, d_pooled)
    d_weight = attention * (d_attention - (attention * d_attention).sum(axis=1, keepdims=True))
    grads["query"] = np.einsum("wth,wt->h", asked, d_weight)
    d_asked = d_weight[:, :, None] * params["query"] * (1 - asked ** 2)
    flat = states.reshape(-1, states.shape[2])
    grads["query_in"] = flat.T @ d_asked.reshape(-1, d_asked.shape[2])
    d_states = (d_states + d_asked @ params["query_in"].T).astype(np.float32)
    hidden = half // 3
    d_x = np.zeros_like(x)
    for way, tape, part in (("f", f_tape, d_states[..., :hidden]), ("b", b_tape, d_states[..., hidden:])):
        d_driven = _swept_back(params, way, tape, part, grads)
        grads[f"{way}_in"] = x.reshape(-1, x.shape[2]).T @ d_driven.reshape(-1, half)
        d_x += d_driven @ params[f"{way}_in"].T
    return loss, grads, d_x
