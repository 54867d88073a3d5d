"""Multilayer perceptrons fitted from packed rows, for tables on which MLlib's own fit takes too long.

The network, its first weights, its loss and the minimiser are of MLlib's kind: sigmoid layers and a softmax at the end, mean cross entropy over
all rows, L-BFGS with ten corrections and its tests for the end. The rows are scaled once, in double precision, and packed as single precision
numbers, half of what MLlib keeps and spills. A pass is one Spark job of matrix products over all blocks, whose sums, in double precision, reach
the driver: one row of gradients a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame

from flowsieve.operators.blocks import LABEL_TYPE, Scaling, packed
from flowsieve.sources.fitted import write_metadata
from flowsieve.sources.workspace import dropped, scratch_path

BLOCK_ROWS = 1 << 12
CORRECTIONS = 10
SUMS = "rows bigint, loss double, gradient binary"


def layers_of(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Views of the weights (outputs by inputs, stored by column) and of the biases of each layer."""
    found, at = [], 0
    for ins, outs in zip(sizes, sizes[1:]):
        found.append((weights[at : at + ins * outs].reshape(ins, outs).T, weights[at + ins * outs : at + (ins + 1) * outs]))
        at += (ins + 1) * outs
    return found


def first_weights(sizes: Sequence[int], seed: int) -> np.ndarray:
    """Even draws from a range that falls with the root of a layer's inputs."""
    random = np.random.default_rng(seed & (2**63 - 1))
    return np.concatenate([random.uniform(-2.4, 2.4, (ins + 1) * outs) / np.sqrt(ins) for ins, outs in zip(sizes, sizes[1:])])


def block_sums(rows: np.ndarray, labels: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], into: list[tuple[np.ndarray, np.ndarray]]) -> float:
    """The loss of a block, whose rows are columns here; its gradients are added to `into`."""
    held = [rows]
    for weights, bias in layers[:-1]:
        z = weights @ held[-1]
        z += bias[:, None]
        np.negative(z, out=z)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1
        held.append(np.reciprocal(z, out=z))
    weights, bias = layers[-1]
    z = (weights @ held[-1]).astype(float) + bias[:, None]
    z -= z.max(axis=0)
    every = np.arange(len(labels))
    right = z[labels, every].copy()
    np.exp(z, out=z)
    total = z.sum(axis=0)
    loss = float((np.log(total) - right).sum())
    z /= total
    z[labels, every] -= 1
    delta = z.astype(rows.dtype)
    for i in range(len(layers) - 1, -1, -1):
        into[i][0][...] += delta @ held[i].T
        into[i][1][...] += delta.sum(axis=1, dtype=float)
        if i:
            delta = layers[i][0].T @ delta
            delta *= held[i]
            delta *= 1 - held[i]
    return loss


def halves(numbers: np.ndarray) -> bytes:
    """Single precision numbers without loss: the lower halves as they are, which hardly compress, then the upper ones compressed."""
    split = numbers.reshape(-1).view(np.uint16).reshape(-1, 2)
    return split[:, 0].tobytes() + pa.Codec("lz4").compress(split[:, 1].tobytes(), asbytes=True)


def from_halves(stored: pa.Buffer, width: int, rows: int) -> np.ndarray:
    size = width * rows * 2
    split = np.empty((width * rows, 2), np.uint16)
    split[:, 0] = np.frombuffer(stored[:size], np.uint16)
    split[:, 1] = np.frombuffer(pa.Codec("lz4").decompress(stored[size:], size), np.uint16)
    return split.reshape(-1).view(np.float32).reshape(width, rows)


def summing(weights: np.ndarray, sizes: Sequence[int]):
    """The rows, loss and gradients of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        layers = [(np.ascontiguousarray(w), b) for w, b in layers_of(weights.astype(np.float32), sizes)]
        gradient, seen, loss = np.zeros(len(weights)), 0, 0.0
        into = layers_of(gradient, sizes)
        for batch in batches:
            for rows, labels, numbers in zip(*(batch.column(c) for c in ("rows", "labels", "numbers"))):
                values = from_halves(numbers.as_buffer(), sizes[0], rows.as_py())
                loss += block_sums(values, np.frombuffer(labels.as_buffer(), LABEL_TYPE).astype(np.intp), layers, into)
                seen += rows.as_py()
        yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([loss]), pa.array([gradient.tobytes()], pa.binary())], names=["rows", "loss", "gradient"])

    return run


def mean_loss(blocks: DataFrame, sizes: Sequence[int], weights: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean loss over all rows, and its gradient: one pass."""
    parts = blocks.mapInArrow(summing(weights, sizes), SUMS).toArrow()
    rows = sum(parts.column("rows").to_pylist())
    if not rows:
        raise ValueError("no rows to fit")
    gradient = sum(np.frombuffer(g.as_buffer()) for g in parts.column("gradient"))
    return float(sum(parts.column("loss").to_pylist())) / rows, gradient / rows


Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def minimise(objective: Objective, start: np.ndarray, iterations: int, tolerance: float) -> np.ndarray:
    """L-BFGS: at most so many steps, until the last ten values or the gradient say that nothing is left to gain."""
    x, (value, gradient) = start, objective(start)
    first, values, steps = value, [value], []
    for i in range(iterations):
        direction = -two_loops(gradient, steps)
        if direction @ gradient >= 0:
            direction, steps = -gradient, []
        found = wolfe_step(objective, x, value, gradient, direction, 1.0 / np.linalg.norm(direction) if not steps else 1.0)
        if found is None:
            return x
        step, new_value, new_gradient = found
        moved, turned = step * direction, new_gradient - gradient
        if moved @ turned > 0:
            steps = [*steps, (moved, turned)][-CORRECTIONS:]
        x, value, gradient = x + moved, new_value, new_gradient
        values = [*values, value][-10:]
        if abs(value - max(values)) <= tolerance * abs(first) or np.linalg.norm(gradient) <= max(tolerance * abs(value), 1e-8):
            return x
    return x


def two_loops(gradient: np.ndarray, steps: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The gradient times the inverse curvature that the last steps tell."""
    q, shares = gradient.copy(), []
    for moved, turned in reversed(steps):
        share = (moved @ q) / (moved @ turned)
        q -= share * turned
        shares.append(share)
    if steps:
        moved, turned = steps[-1]
        q *= (moved @ turned) / (turned @ turned)
    for (moved, turned), share in zip(steps, reversed(shares)):
        q += (share - (turned @ q) / (moved @ turned)) * moved
    return q


def wolfe_step(objective: Objective, x: np.ndarray, value: float, gradient: np.ndarray, direction: np.ndarray, step: float, most: int = 20) -> tuple[float, float, np.ndarray] | None:
    """A step that lowers the value enough and flattens the slope (strong Wolfe conditions), found between bounds that close in; None if there is none."""
    slope, low, high, best = gradient @ direction, (0.0, value, gradient @ direction), None, None
    for _ in range(most):
        new_value, new_gradient = objective(x + step * direction)
        new_slope = new_gradient @ direction
        enough = np.isfinite(new_value) and new_value <= value + 1e-4 * step * slope
        if enough and (best is None or new_value < best[1]):
            best = step, new_value, new_gradient
        if enough and abs(new_slope) <= 0.9 * abs(slope):
            return best if best[0] == step else (step, new_value, new_gradient)
        if not enough or new_value >= low[1] and low[0] > 0:
            high = step, new_value, new_slope
        elif new_slope >= 0:
            low, high = (step, new_value, new_slope), low
        else:
            low = step, new_value, new_slope
        if high is None:
            step *= 2
        elif abs(high[0] - low[0]) <= 1e-10 * max(1.0, abs(low[0])):
            break
        else:
            step = between(low, high)
    return best


def between(low: tuple[float, float, float], high: tuple[float, float, float]) -> float:
    """The least point of the parabola through the lower end's value and slope and the other end's value, kept off both ends."""
    width = high[0] - low[0]
    bend = high[1] - low[1] - low[2] * width
    share = -low[2] * width / (2 * bend) if np.isfinite(bend) and bend > 0 else 0.5
    return low[0] + min(max(share, 0.1), 0.9) * width


def fit_packed(
    network: MultilayerPerceptronClassifier, rows: DataFrame, label_index: str, features: Sequence[str], scaling: Scaling, block_rows: int = BLOCK_ROWS
) -> MultilayerPerceptronClassificationModel:
    """The perceptron fitted on all rows, with the features scaled as the model will get them."""
    sizes, spark = list(network.getLayers()), rows.sparkSession
    start = network.getInitialWeights().toArray() if network.isSet(network.initialWeights) else first_weights(sizes, network.getSeed())
    with packed(rows, label_index, features, lambda columns: halves(scaling.apply(columns).astype(np.float32)), block_rows) as blocks:
        weights = minimise(lambda w: mean_loss(blocks, sizes, w), start, network.getMaxIter(), network.getTol())
    with dropped(spark, scratch_path(spark, "network")) as path:
        write_metadata(spark, path, network, "MultilayerPerceptronClassificationModel", {})
        spark.createDataFrame([(Vectors.dense(weights),)], ["weights"]).coalesce(1).write.parquet(f"{path}/data")
        return MultilayerPerceptronClassificationModel.load(path)
