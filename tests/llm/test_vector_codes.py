import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from loomline.llm import vector_codes as V
from loomline.llm.queries import ORACLE_SQL

TYPE = "vec_id long, embedding array<double>, label int, code string, error string, of int"


def rows(spark, values, parts=3):
    return spark.createDataFrame([(*v, "mine", "mine", 3) for v in values], TYPE).repartition(parts)


def plain(values, rounds=6):
    """The contract in plain Python."""
    kept = [v for v in values if v[1] is not None and all(x is not None and math.isfinite(x) for x in v[1])]
    width = -(-max((len(v[1]) for v in kept), default=0) // 8) * 8
    size = width // 8
    ints = [[math.floor(Fraction(x) * 4096) for x in v[1]] + [0] * (width - len(v[1])) for v in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:16]
    books = [[ints[i][p * size : (p + 1) * size] for i in order] for p in range(8)]

    def nearest(v, p):
        return min((sum((a - b) ** 2 for a, b in zip(v[p * size : (p + 1) * size], c)), k) for k, c in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(8):
            codes = [nearest(v, p)[1] for v in ints]
            groups = [[v[p * size : (p + 1) * size] for v, c in zip(ints, codes) if c == k] for k in range(len(books[p]))]
            new.append([[sum(col) // len(g) for col in zip(*g)] if g else old for g, old in zip(groups, books[p])])
        books = new
    digest = hashlib.sha256(",".join(str(c) for part in books for entry in part for c in entry).encode()).hexdigest()
    found = [[nearest(v, p) for p in range(8)] for v in ints]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for v, e in zip(kept, errors):
        labels[v[2]] = labels.get(v[2], 0) + e
    most = (1 << 63) - 1
    return sorted(((-1 if v[0] is None else v[0]), "".join(f"{k:02x}" for _, k in f), min(e, most), min(labels[v[2]], most), digest) for v, f, e in zip(kept, found, errors))


def result(df):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


def sample(seed, n=120, d=16, scale=1.0):
    rng = random.Random(seed)
    hot = [rng.gauss(0, scale) for _ in range(d)]
    return [(i, [float(np.float32(x)) for x in (hot if rng.random() < 0.35 else [rng.gauss(0, scale) for _ in range(d)])], rng.choice([0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("seed, scale", [(1, 1.0), (2, 0.0004), (3, 200.0)])
def test_equals_plain(spark, seed, scale):
    values = sample(seed, scale=scale)
    assert result(V.compressed(rows(spark, values))) == plain(values)


def test_awkward_rows(spark):
    """Nulls, lengths that differ, repeated ids, ties, tiny and huge components."""
    values = sample(4, 40, 13)
    values += [(3, values[3][1], 0), (3, [9.0] * 13, 1), (None, [0.5] * 13, None), (50, None, 1), (51, [1.0, None], 1), (52, [float("nan")] * 13, 1), (53, [float("inf")], 1)]
    values += [(54, [], 1), (55, [1.0], None), (-1, [-0.0001] * 13, 2), (56, [3e38] * 13, 2), (57, [1e300, -1e300], 2), (58, [5e5] * 13, 2), (59, [1023.9999] * 13, 2)]
    assert result(V.compressed(rows(spark, values))) == plain(values)


def test_large_values_only(spark):
    values = [(i, [float((i * 7919 + j * j) % 13) * 2.0**40 for j in range(8)], i % 2) for i in range(30)]
    assert result(V.compressed(rows(spark, values))) == plain(values)


def test_few_and_none(spark):
    assert result(V.compressed(rows(spark, sample(5, 3)))) == plain(sample(5, 3))
    assert V.compressed(rows(spark, sample(5, 1)).limit(0)).collect() == []
    assert result(V.compressed(rows(spark, [(1, [], None), (2, None, 3)]))) == plain([(1, [], None), (2, None, 3)])


def test_intervals_hold():
    """The screening decides as int64 does, entries that differ in the last bit included."""
    rng = np.random.default_rng(3)
    for top in (3, 1000, V.NARROW - 2):
        data = rng.integers(-top, top + 1, (500, 24))
        entries = data[:8].repeat(2, axis=0)
        entries[1::2, 5] += rng.integers(-1, 2, 8)
        code, distance = V.screened(data, entries.tolist())
        exact = ((data[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (code == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_twin(spark):
    import duckdb

    from loomline.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = con.execute(f"select vec_id, code, error, label_error, codebooks_sha256 from ({ORACLE_SQL['op13_vector_codes']}) order by vec_id").fetchall()
    assert [tuple(r) for r in QUERIES["op13_vector_codes"](spark, folder).orderBy("vec_id").collect()] == want
