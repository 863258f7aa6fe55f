"""Training of a two-layer classifier by gradients that are summed over the cluster.

Each step broadcasts the weights, forms the gradient of the focal loss over the
rows of one batch in the tasks and sums it by a tree of tasks; the driver holds
weights and moments only. A batch is a share of the rows by hash and epoch, so
every row is in one batch of each epoch and a rerun deals alike. After each epoch
the state is written as a table of its own folder; a run that stopped goes
on from the last whole one and does what it would have done.
"""

from __future__ import annotations

import json
import operator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Weights = dict[str, np.ndarray]


def initial(inputs: int, hidden: int, classes: int, seed: int = 0) -> Weights:
    rng = np.random.default_rng(seed)
    return {"w1": rng.normal(0, (2 / inputs) ** 0.5, (inputs, hidden)), "b1": np.zeros(hidden), "w2": rng.normal(0, (2 / hidden) ** 0.5, (hidden, classes)), "b2": np.zeros(classes)}


def probabilities(weights: Weights, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the hidden layer and the probability of each class."""
    hidden = np.maximum(x @ weights["w1"] + weights["b1"], 0)
    z = hidden @ weights["w2"] + weights["b2"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return hidden, e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(weights: Weights, x: np.ndarray, y: np.ndarray, class_weights: np.ndarray, gamma: float) -> tuple[float, Weights]:
    """Sums over rows of the focal loss -w (1 - p)**gamma ln p and of its gradient."""
    hidden, p = probabilities(weights, x)
    own = np.maximum(p[np.arange(len(y)), y], 1e-12)
    w = class_weights[y]
    loss = float((-w * (1 - own) ** gamma * np.log(own)).sum())
    slope = w * (gamma * (1 - own) ** (gamma - 1) * np.log(own) * own - (1 - own) ** gamma) if gamma else -w
    dz = -slope[:, None] * p
    dz[np.arange(len(y)), y] += slope
    dh = (dz @ weights["w2"].T) * (hidden > 0)
    return loss, {"w1": x.T @ dh, "b1": dh.sum(axis=0), "w2": hidden.T @ dz, "b2": dz.sum(axis=0)}


def _flat(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def _shaped(flat: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    x = batch.column(0)
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1), batch.column(1).to_numpy()


def _step(rows: DataFrame, weights: Weights, class_weights: np.ndarray, gamma: float) -> np.ndarray:
    """(rows, loss, gradient) summed over a table of (x, y)."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, class_weights))

    def run(batches):
        total = np.zeros(2 + sum(w.size for w in weights.values()))
        for batch in batches:
            if batch.num_rows:
                x, y = _arrays(batch)
                loss, gradient = loss_and_gradient(shared.value[0], x, y, shared.value[1], gamma)
                total += np.r_[len(y), loss, _flat(gradient)]
        yield pa.RecordBatch.from_pydict({"total": [total.tobytes()]})

    summed = rows.select("x", "y").mapInArrow(run, "total binary").rdd.map(lambda r: np.frombuffer(r.total)).treeAggregate(0, operator.add, operator.add)
    shared.unpersist()
    return summed


class Trainer:
    """Adam with a bound on the gradient, a lower rate on a plateau of the validation loss, an early stop, and the best weights kept."""

    def __init__(self, folder: str, classes: int, inputs: int = 256, hidden: int = 128, gamma: float = 1.0, batches: int = 4, rate: float = 1e-3, plateau: int = 2, patience: int = 5, clip: float = 1.0, seed: int = 0):
        self.folder, self.classes, self.gamma, self.batches, self.plateau, self.patience, self.clip = folder.rstrip("/"), classes, gamma, batches, plateau, patience, clip
        self.start = initial(inputs, hidden, classes, seed)
        n = _flat(self.start).size
        self.state = {"epoch": 0, "step": 0, "rate": rate, "since": 0, "best_loss": float("inf"), "stopped": False, "history": []}
        self.now, self.m, self.v, self.best = _flat(self.start), np.zeros(n), np.zeros(n), _flat(self.start)

    def _save(self, rows: DataFrame) -> None:
        arrays = {k: getattr(self, k).tolist() for k in ("now", "m", "v", "best")}
        spark = rows.sparkSession
        spark.createDataFrame([(json.dumps(self.state), *arrays.values())], "state string, now array<double>, m array<double>, v array<double>, best array<double>").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/epoch-{self.state['epoch']:05d}")

    def _load(self, rows: DataFrame) -> None:
        """The last epoch that was written whole."""
        spark = rows.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epoch-*/_SUCCESS")
        found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
        if found:
            row = spark.read.parquet(max(s.getPath().getParent().toString() for s in found)).first()
            self.state = json.loads(row.state)
            self.now, self.m, self.v, self.best = (np.array(row[k]) for k in ("now", "m", "v", "best"))

    def fit(self, train: DataFrame, valid: DataFrame, epochs: int, class_weights: list[float] | None = None) -> Weights:
        """Train on (id, x, y) up to that epoch, going on from what the folder has; returns the weights of the least validation loss."""
        self._load(train)
        weight = np.array(class_weights or [1.0] * self.classes)
        while self.state["epoch"] < epochs and not self.state["stopped"]:
            epoch = self.state["epoch"]
            for b in range(self.batches):
                rows = train.where(F.pmod(F.xxhash64(F.lit(epoch), F.col("id")), F.lit(self.batches)) == b)
                total = _step(rows, _shaped(self.now, self.start), weight, self.gamma)
                if total[0]:
                    self._move(total[2:] / total[0])
            total = _step(valid, _shaped(self.now, self.start), weight, self.gamma)
            self._judge(float(total[1] / max(total[0], 1)))
            self.state["epoch"] += 1
            self._save(train)
        return _shaped(self.best, self.start)

    def _move(self, gradient: np.ndarray) -> None:
        gradient = gradient * min(1.0, self.clip / max(np.linalg.norm(gradient), 1e-12))
        self.state["step"] += 1
        t = self.state["step"]
        self.m, self.v = 0.9 * self.m + 0.1 * gradient, 0.999 * self.v + 0.001 * gradient**2
        self.now = self.now - self.state["rate"] * (self.m / (1 - 0.9**t)) / (np.sqrt(self.v / (1 - 0.999**t)) + 1e-8)

    def _judge(self, loss: float) -> None:
        s = self.state
        s["history"].append(loss)
        if loss < s["best_loss"]:
            s["best_loss"], s["since"], self.best = loss, 0, self.now.copy()
        else:
            s["since"] += 1
            if s["since"] % (self.plateau + 1) == 0:
                s["rate"] *= 0.5
            s["stopped"] = s["since"] >= self.patience


def predict(rows: DataFrame, weights: Weights) -> DataFrame:
    """Adds ``pred``, the class of greatest probability (the lower of two), to a table with x."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    at = rows.columns.index("x")

    def run(batches):
        for batch in batches:
            x = batch.column(at)
            found = probabilities(shared.value, x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1))[1].argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "pred"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + ", pred long")
