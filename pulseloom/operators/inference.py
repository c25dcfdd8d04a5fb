"""Forward pass of the sequence classifier over batches of rows, from plain weight arrays.

Weights are a dict of numpy arrays (nested lists are taken too). Rows are independent: Spark deals them out in Arrow
batches, and rows of one shape are computed together. Training isn't done here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

READOUTS = ("last", "mean", "max", "min", "mean_max", "mean_min", "min_max", "attention", "avg_pool", "max_pool", "adaptive_pool")
Weights = Mapping[str, np.ndarray]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def lstm_states(x: np.ndarray, layers: Sequence[Weights]) -> np.ndarray:
    """States of every step, (rows, steps, width), of stacked LSTM layers.

    A layer has w_in (4 width x inputs), w_state (4 width x width) and bias (4 width), with gates in the order input, forget, cell, output.
    """
    for layer in layers:
        w_in, w_state, bias = (np.asarray(layer[k], float) for k in ("w_in", "w_state", "bias"))
        width = w_state.shape[1]
        h = c = np.zeros((len(x), width))
        driven = x @ w_in.T + bias
        steps = []
        for t in range(x.shape[1]):
            gate = driven[:, t] + h @ w_state.T
            i, f, o = (_sigmoid(gate[:, k * width : (k + 1) * width]) for k in (0, 1, 3))
            c = f * c + i * np.tanh(gate[:, 2 * width : 3 * width])
            h = o * np.tanh(c)
            steps.append(h)
        x = np.stack(steps, 1) if steps else np.zeros((len(x), 0, width))
    return x


def layer_norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray, eps: float = 1e-5) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + eps) * scale + shift


def encoder(x: np.ndarray, layers: Sequence[Weights], heads: int) -> np.ndarray:
    """Transformer encoder over (rows, patches, width): self-attention and a rectified two-layer map, each added and then normalised.

    A layer has w_qkv, b_qkv, w_out, b_out, w_up, b_up, w_down, b_down, scale1, shift1, scale2, shift2.
    """
    for layer in layers:
        w = {k: np.asarray(v, float) for k, v in layer.items()}
        rows, patches, width = x.shape
        q, k, v = np.split(x @ w["w_qkv"].T + w["b_qkv"], 3, -1)
        q, k, v = (z.reshape(rows, patches, heads, width // heads).transpose(0, 2, 1, 3) for z in (q, k, v))
        score = q @ k.transpose(0, 1, 3, 2) / np.sqrt(width // heads)
        share = np.exp(score - score.max(-1, keepdims=True))
        mixed = ((share / share.sum(-1, keepdims=True)) @ v).transpose(0, 2, 1, 3).reshape(rows, patches, width)
        x = layer_norm(x + mixed @ w["w_out"].T + w["b_out"], w["scale1"], w["shift1"])
        x = layer_norm(x + np.maximum(x @ w["w_up"].T + w["b_up"], 0) @ w["w_down"].T + w["b_down"], w["scale2"], w["shift2"])
    return x


def read_out(states: np.ndarray, method: str, attention: np.ndarray | None = None) -> np.ndarray:
    """(rows, steps, width) to one vector a row by one of READOUTS; ValueError for another."""
    if method not in READOUTS:
        raise ValueError(f"unknown readout {method}")
    if method == "attention":
        score = states @ np.asarray(attention, float)
        share = np.exp(score - score.max(1, keepdims=True))
        return ((share / share.sum(1, keepdims=True))[..., None] * states).sum(1)
    single = {"last": lambda: states[:, -1], "mean": lambda: states.mean(1), "max": lambda: states.max(1), "min": lambda: states.min(1)}
    single |= {"avg_pool": single["mean"], "max_pool": single["max"]}
    parts = ("mean", "max") if method == "adaptive_pool" else (method,) if method in single else method.split("_")
    return np.concatenate([single[p]() for p in parts], 1)


def forward(x: np.ndarray, weights: Mapping, method: str = "last") -> np.ndarray:
    """Logits of (rows, steps, inputs), or of (rows, patches, steps, inputs) by way of each patch's last state and the encoder.

    weights: lstm (layers), optionally encoder (layers) and heads, attention, norm (scale, shift), fc (vector) and bias.
    """
    if x.ndim == 4:
        rows, patches = x.shape[:2]
        last = lstm_states(x.reshape(rows * patches, *x.shape[2:]), weights["lstm"])[:, -1]
        states = encoder(last.reshape(rows, patches, -1), weights["encoder"], int(weights["heads"]))
    else:
        states = lstm_states(x, weights["lstm"])
    z = read_out(states, method, weights.get("attention"))
    if "norm" in weights:
        z = layer_norm(z, *(np.asarray(v, float) for v in weights["norm"]))
    return z @ np.asarray(weights["fc"], float) + float(weights["bias"])


def classify(features: str, inputs: int, weights: Mapping, method: str = "last", patches: int | None = None) -> Column:
    """Probability of class 1 from a flat array of steps x inputs (or patches x steps x inputs) values; null where the array is null, empty, of
    another size, or holds a value that isn't finite."""
    if method not in READOUTS:
        raise ValueError(f"unknown readout {method}")
    unit = inputs * (patches or 1)

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        out = np.full(len(values), np.nan)
        by_size: dict[int, list[int]] = {}
        flat = [None if v is None else np.asarray(v, float) for v in values]
        for k, v in enumerate(flat):
            if v is not None and len(v) and len(v) % unit == 0 and np.isfinite(v).all():
                by_size.setdefault(len(v), []).append(k)
        for size, at in by_size.items():
            x = np.stack([flat[k] for k in at]).reshape(len(at), *([patches] if patches else []), size // unit, inputs)
            out[at] = _sigmoid(forward(x, weights, method))
        return pd.Series(out).astype(object).where(np.isfinite(out), None)

    return run(F.col(features).cast("array<double>"))
