"""The encoder, the messages and the training against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import network as N
from loomline.operators import train as T


def plain_encoder(e, x):
    """Place by place and head by head."""
    x = x @ e.first[0] + e.first[1]
    for p in range(len(x)):
        for i in range(e.size):
            x[p, i] += (np.sin if i % 2 == 0 else np.cos)(p / 10000 ** ((i - i % 2) / e.size))
    norm = lambda v: (v - v.mean()) / np.sqrt(v.var() + 1e-5)
    d = e.size // e.heads
    for w in e.layers:
        a = x @ w["in"][0] + w["in"][1]
        seen = np.zeros_like(x)
        for h in range(e.heads):
            q, k, v = (a[:, i * e.size + h * d : i * e.size + (h + 1) * d] for i in range(3))
            for p in range(len(x)):
                s = np.exp([q[p] @ k[o] / np.sqrt(d) for o in range(len(x))])
                seen[p, h * d : (h + 1) * d] = (s[:, None] * v).sum(axis=0) / s.sum()
        x = np.array([norm(r) for r in x + seen @ w["out"][0] + w["out"][1]])
        x = np.array([norm(r + np.maximum(r @ w["up"][0] + w["up"][1], 0) @ w["down"][0] + w["down"][1]) for r in x])
    return x


def test_windows_equal_plain_numpy(spark):
    rng = np.random.default_rng(1)
    encoder = N.LocalEncoder(6, 16, 4, 2, 32, seed=3)
    windows = {"a": [3, 1, 2], "b": [1], "c": [100, 30, 40, 5], "d": [0, 400]}
    rows = [(w, i, n, rng.normal(size=6).tolist()) for w, counts in windows.items() for i, n in enumerate(counts)]
    frame = spark.createDataFrame(rows, "wid string, pos long, count long, vec array<double>").repartition(3)
    got = {(r.wid, r.pos): r.encoded for r in N.encode_windows(frame, encoder).collect()}
    for w in windows:
        own = [r for r in rows if r[0] == w]
        places = [i for i, r in enumerate(own) for _ in range(max(r[2], 1))][: N.MOST_POSITIONS]
        seen = plain_encoder(encoder, np.array([own[i][3] for i in places]))
        for i in range(len(own)):
            mine = seen[[p for p, o in enumerate(places) if o == i]]
            assert np.allclose(got[w, i], mine.mean(axis=0) if len(mine) else 0)
    assert len(got) == len(rows) and N.encode_windows(frame, encoder, by_count=False).count() == len(rows)


def plain_messages(layer, nodes, edges):
    out, d = {}, layer.size // layer.heads
    lin = lambda kind, name, x: (x @ layer.kinds[kind][name][0] + layer.kinds[kind][name][1]).reshape(layer.heads, d)
    for (kind, i), x in nodes.items():
        incoming = [(r, layer.relations[r][0], s) for s, r, t in edges if t == i and layer.relations[r][1] == kind and (layer.relations[r][0], s) in nodes]
        received = np.zeros((layer.heads, d))
        for h in range(layer.heads) if incoming else ():
            q = lin(kind, "query", x)[h]
            e = np.exp([q @ (lin(sk, "key", nodes[sk, s])[h] @ layer.maps[r]["key"][h]) / np.sqrt(d) for r, sk, s in incoming])
            for a, (r, sk, s) in zip(e / e.sum(), incoming):
                received[h] += a * (lin(sk, "value", nodes[sk, s])[h] @ layer.maps[r]["value"][h])
        r = received.ravel()
        smooth = r * 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (r + 0.044715 * r**3)))
        out[kind, i] = 0.5 * (smooth @ layer.kinds[kind]["out"][0] + layer.kinds[kind]["out"][1]) + 0.5 * x
    return out


def test_messages_equal_plain_numpy(spark):
    """Two layers; an entity in every line, one in none, an edge to nowhere."""
    rng = np.random.default_rng(2)
    relations = {"HAS": ("log", "entity"), "OF": ("entity", "log")}
    nodes = {("log", i): rng.normal(size=16) for i in range(12)} | {("entity", i): rng.normal(size=16) for i in range(5)}
    links = [(i, j) for i in range(12) for j in range(4) if j == 0 or (i + j) % 3 == 0]
    edges = [(i, "HAS", j) for i, j in links] + [(j, "OF", i) for i, j in links] + [(99, "HAS", 0)]
    frame = spark.createDataFrame([(k, i, x.tolist()) for (k, i), x in nodes.items()], "kind string, id long, x array<double>")
    table = spark.createDataFrame(edges, "src long, relation string, dst long").repartition(3)
    for seed in (0, 1):
        layer = N.TypedLayer(relations, 16, 4, seed)
        frame, nodes = N.pass_messages(frame, table, layer), plain_messages(layer, nodes, edges)
    got = {(r.kind, r.id): r.x for r in frame.collect()}
    assert set(got) == set(nodes) and all(np.allclose(got[k], nodes[k]) for k in nodes)


@pytest.mark.parametrize("block", [1 << 18, 40, 8])
def test_vectors_go_to_blocks_once(spark, monkeypatch, block):
    """Not along edges: with one block each vector is needed once; with many, and nodes of more edges than a block holds, messages are the same."""
    monkeypatch.setattr(N, "EDGES", block)
    rng = np.random.default_rng(5)
    relations = {"HAS": ("log", "entity"), "OF": ("entity", "log")}
    nodes = {(k, f"{k}{i}"): rng.normal(size=8) for k, n in (("log", 20), ("entity", 12)) for i in range(n)}
    links = [(f"log{i}", f"entity{j}") for i in range(20) for j in range(12) if i == 3 or j == 1 or (i * j) % 3 == 1]
    edges = [(i, "HAS", j) for i, j in links] + [(j, "OF", i) for i, j in links] + [("log1", "OTHER", "log2")]
    frame = spark.createDataFrame([(k, i, x.tolist()) for (k, i), x in nodes.items()], "kind string, id string, x array<double>")
    table = spark.createDataFrame(edges, "src string, relation string, dst string").repartition(3)
    cells, ends = N.dealt(frame, table, relations)
    assert cells.count() == len(edges) - 1 and (block < 1000 or ends.count() == 32)
    layer = N.TypedLayer(relations, 8, 2, 0)
    got = {(r.kind, r.id): r.x for r in N.pass_messages(frame, cells, layer, ends).collect()}
    want = plain_messages(layer, nodes, edges[:-1])
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("gamma", [0.0, 1.0, 2.0])
def test_gradient_agrees_with_differences(gamma):
    rng = np.random.default_rng(4)
    weights, x, y, w = T.initial(5, 7, 3, 1), rng.normal(size=(20, 5)), rng.integers(0, 3, 20), np.array([0.5, 1.0, 2.0])
    _, gradient = T.loss_and_gradient(weights, x, y, w, gamma)
    for name in weights:
        for at in list(np.ndindex(weights[name].shape))[::3]:
            sides = []
            for step in (1e-6, -1e-6):
                moved = {k: v.copy() for k, v in weights.items()}
                moved[name][at] += step
                sides.append(T.loss_and_gradient(moved, x, y, w, gamma)[0])
            assert abs((sides[0] - sides[1]) / 2e-6 - gradient[name][at]) < 1e-4


def points(spark, n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) * 0.5 + np.eye(3, 4)[y] * 3
    return spark.createDataFrame([(i, x[i].tolist(), int(y[i])) for i in range(n)], "id long, x array<double>, y long").repartition(2)


def test_a_resumed_run_equals_an_unbroken_one(spark, tmp_path):
    train, valid = points(spark, 150, 1), points(spark, 60, 2)
    make = lambda name, **more: T.Trainer(str(tmp_path / name), 3, 4, 8, batches=2, rate=0.05, **more)
    whole = make("whole").fit(train, valid, 4)
    make("parts").fit(train, valid, 2)
    (tmp_path / "parts/epoch-00003").mkdir()  # a state that was not written whole
    resumed = make("parts")
    again = resumed.fit(train, valid, 4)
    assert resumed.state["epoch"] == 4 and all(np.allclose(whole[k], again[k]) for k in whole)
    got = T.predict(valid, again).where("pred = y").count()
    assert got > 54
    assert resumed.state["history"][-1] < resumed.state["history"][0]


def test_rate_and_early_stop(tmp_path):
    trainer = T.Trainer(str(tmp_path / "t"), 2, 2, 2, rate=1.0, plateau=1, patience=4)
    for loss in (3.0, 2.0, 2.5, 2.5, 2.5):
        trainer._judge(loss)
    assert (trainer.state["rate"], trainer.state["stopped"], trainer.state["best_loss"]) == (0.5, False, 2.0)
    trainer._judge(2.1)
    assert trainer.state["stopped"] and trainer.state["rate"] == 0.25
