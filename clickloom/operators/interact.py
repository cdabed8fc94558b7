"""Feature crosses with weights, evaluated batch by batch in numpy.

The weights of a cross are one small matrix per field pair (their size depends
on the declared fields only, never on the data).  They travel as a broadcast
variable; Spark streams the field vectors through Arrow, with no shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import vectors as V
from clickloom.functions.arrow import lists, matrix
from clickloom.session import ship_package

Kernel = Callable[[np.ndarray, Mapping[str, np.ndarray]], np.ndarray]


def _pairs(x: np.ndarray):
    left, right = zip(*combinations(range(x.shape[1]), 2))
    return x[:, list(left)], x[:, list(right)], list(left)


def _relu(a):
    return np.maximum(a, 0.0)


def _softmax(a, axis):
    e = np.exp(a - a.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def fefm(x, w):
    """``v_i (W + W') v_j`` per pair; ``W``: pair x d x d."""
    p, q, _ = _pairs(x)
    return np.einsum("npd,pde,npe->np", p, w["W"] + w["W"].transpose(0, 2, 1), q)


def outer_product(x, w):
    """Pair kernel: ``mat`` d x pair x d, ``vec`` pair x d, ``num`` pair x 1."""
    p, q, _ = _pairs(x)
    k = w["kernel"]
    if k.ndim == 3:
        return np.einsum("npc,apc,npa->np", p, k, q)
    return (p * q * k[None]).sum(-1)


def bilinear(x, w):
    """``(v_i W) * v_j``; W shared (d x d), per left field or per pair (n x d x d)."""
    p, q, left = _pairs(x)
    W = w["W"]
    if W.ndim == 2:
        out = (p @ W) * q
    else:
        per_pair = W if W.shape[0] == len(left) and w.get("per") != "field" else W[left]
        out = np.einsum("npd,pde->npe", p, per_pair) * q
    return out.reshape(len(x), -1)


def senet(x, w):
    """Scale each field by two ReLU layers over the field means."""
    a = _relu(_relu(x.mean(-1) @ w["W1"]) @ w["W2"])
    return (x * a[:, :, None]).reshape(len(x), -1)


def cross_net(x, w):
    """``x0 (x_l . w) + b + x_l`` for vectors, ``x0 * (W x_l + b) + x_l`` for matrices."""
    x0 = x.reshape(len(x), -1)
    xl = x0
    for kernel, bias in zip(w["kernels"], w["bias"]):
        if kernel.ndim == 1:
            xl = x0 * (xl @ kernel)[:, None] + bias + xl
        else:
            xl = x0 * (xl @ kernel.T + bias) + xl
    return xl


def afm(x, w):
    """Attention-weighted sum of pair products, projected to one number."""
    p, q, _ = _pairs(x)
    prod = p * q
    att = _softmax(_relu(prod @ w["W"] + w["b"]) @ w["h"], axis=1)
    return ((att[:, :, None] * prod).sum(1) @ w["p"])[:, None]


def field_bi_interaction(x, w):
    """Products between field groups plus the interaction inside each group."""
    groups = [list(map(int, g)) for g in w["groups"]]
    sums = np.stack([x[:, g].sum(1) for g in groups], axis=1)
    squares = np.stack([(x[:, g] ** 2).sum(1) for g in groups], axis=1)
    left, right, _ = _pairs(sums)
    mf = (left * right * w["mf"][None, :, None]).sum(1) + w.get("bias_mf", 0.0)
    fm = ((sums**2 - squares) * w["fm"][None, :, None]).sum(1) + w.get("bias_fm", 0.0)
    return mf + fm


#: Weights are sent to every executor, up to this size.
WEIGHT_BYTES_LIMIT = 256 * 1024 * 1024

KINDS: dict[str, Kernel] = {
    "fefm": fefm,
    "outer_product": outer_product,
    "bilinear": bilinear,
    "senet": senet,
    "cross_net": cross_net,
    "afm": afm,
    "field_bi_interaction": field_bi_interaction,
}


def interact(
    df: DataFrame,
    fields: Sequence[str],
    kind: str | Kernel,
    weights: Mapping[str, object],
    out: str = "cross",
    scalar: bool = False,
) -> DataFrame:
    """Add ``out`` = the cross of the field vectors as ``array<double>``, or one number.

    Weights above ``WEIGHT_BYTES_LIMIT`` are refused.
    """
    ship_package(df.sparkSession)
    kernel = KINDS[kind] if isinstance(kind, str) else kind
    k = len(fields)
    size = len(pickle.dumps(dict(weights)))
    if size > WEIGHT_BYTES_LIMIT:
        raise ValueError(f"the weights of {k} fields take {size} bytes; at most {WEIGHT_BYTES_LIMIT} are sent to every executor")
    shared = df.sparkSession.sparkContext.broadcast(dict(weights))

    def evaluate(flat: pa.Array) -> pa.Array:
        known = flat.drop_null()
        if not len(known):
            return pa.nulls(len(flat), pa.float64() if scalar else pa.list_(pa.float64()))
        x = matrix(known, len(known.flatten()) // len(known))
        y = kernel(x.reshape(len(x), k, -1), shared.value)
        made = pa.array(y[:, 0]) if scalar else lists(y)
        if not flat.null_count:
            return made
        valid = flat.is_valid().to_numpy(zero_copy_only=False)  # a missing field vector gives a missing cross
        return made.take(pa.array(np.cumsum(valid) - 1, mask=~valid))

    udf = F.arrow_udf(evaluate, "double" if scalar else "array<double>")
    return df.withColumn(out, udf(V.concat(*fields)))
