import random
import zlib

import numpy as np
import pytest

from loomline.llm import toxicity as X

from .helpers import by_id, docs, empty, prose, texts


def best_sum(scores):
    best = now = 0.0
    for s in scores:
        now = max(0.0, now + s)
        best = max(best, now)
    return best


def maximal(scores):
    """Ruzzo and Tompa's segments by their recursive definition: the best contiguous run, then left and right of it."""
    best, at = 1e-12, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, at = total, (i, j + 1)
    if at is None:
        return []
    i, j = at
    return maximal(scores[:i]) + [(i, j)] + [(a + j, z + j) for a, z in maximal(scores[j:])]


@pytest.mark.parametrize("seed", range(8))
def test_segments_equal_the_definition(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(-0.3, 1.0, 40)
    found = X.segments(scores)
    assert [(a, z) for a, z, _ in found] == maximal(scores.tolist())
    assert max(s for *_, s in found) == pytest.approx(best_sum(scores))
    assert all(s == pytest.approx(scores[a:z].sum()) for a, z, s in found)


def corpus(n=700):
    rng = random.Random(9)
    values, toxic = [], []
    for _ in range(n):
        words = prose(rng, rng.randint(20, 80)).split(" ")
        bad = rng.random() < 0.25
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(["vilename", "stinker", "nastyword"], 2)
        values.append(" ".join(words))
        toxic.append(int(bad))
    return values, toxic


def test_held_out_rows(spark):
    values, toxic = corpus()
    frame = docs(spark, values + [None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    model = X.train(frame, labels)
    got = by_id(X.toxicity(frame, model))
    assert len(got) == len(values) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i in range(len(values)) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in range(len(values)))
    assert np.mean([got[i]["predicted"] == toxic[i] for i in held]) > 0.95
    for i in held:
        if toxic[i] and got[i]["passages"]:
            a, z = map(int, got[i]["passages"].split(",")[0].split(":"))
            assert any(w in values[i][a:z] for w in ("vilename", "stinker", "nastyword"))
            break
    # Held-out labels change nothing.
    other = X.train(frame, spark.createDataFrame([(i, 1, 1 - t if i in set(held) else t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int"))
    assert other.curve == model.curve and np.array_equal(other.toxic, model.toxic)


def test_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = X.toxicity(docs(spark), X.train(docs(spark), none)).collect()
    assert len(rows) == len(texts()) and {r.score for r in rows} == {0.0}
    assert X.toxicity(empty(spark), X.train(empty(spark), none)).collect() == []
