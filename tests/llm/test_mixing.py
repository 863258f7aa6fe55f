import random
from collections import defaultdict

import pytest

from loomline.llm import mixing

from .helpers import WORD, by_id, docs, empty, prose, texts


def plain_targets(totals):
    """Round by round: cap what is above, reshare the excess by weight."""
    names = sorted((k for k in totals if k is not None)) + [None] * (None in totals)
    weight = {k: mixing.WEIGHTS[i % 3] for i, k in enumerate(names)}
    left, free, out = 1.5 * sum(totals.values()), set(names), {}
    while free:
        share = {k: left * weight[k] / sum(weight[x] for x in free) for k in free}
        above = {k for k in free if share[k] > 2 * totals[k]}
        if not above:
            return out | share
        for k in above:
            out[k] = 2.0 * totals[k]
            left -= out[k]
            free.discard(k)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_totals(spark, seed):
    rng = random.Random(seed)
    values = texts(seed) + [prose(rng, rng.randint(1, 200)) for _ in range(100)]
    sources = [rng.choice(["b", "a", "é", "Z", None, "a", "a"]) for _ in values]
    frame = spark.createDataFrame([(i, t, s, i) for i, (t, s) in enumerate(zip(values, sources))], "doc_id long, text string, source string, size long")
    got = by_id(mixing.mixed(frame))
    size = [len(WORD.findall(t or "")) for t in values]
    totals, taken = defaultdict(int), defaultdict(int)
    for i, s in enumerate(sources):
        totals[s] += size[i]
        taken[s] += got[i]["taken"]
    want = plain_targets(totals)
    for i, s in enumerate(sources):
        r = got[i]
        assert r["size"] == size[i] and r["source_size"] == totals[s] and r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * size[i] and r["taken"] == r["copies"] * size[i] + r["partial_words"]
    for s in totals:
        assert abs(taken[s] - want[s]) <= max(5, 0.02 * want[s])
    assert got == by_id(mixing.mixed(frame))


def test_the_mixture_holds_what_was_taken(spark):
    frame = docs(spark)
    rows = mixing.mixture(frame).collect()
    taken = {k: r["taken"] for k, r in by_id(mixing.mixed(frame)).items()}
    words = defaultdict(int)
    for r in rows:
        assert len(WORD.findall(r.text)) == r.copy_words > 0
        words[r.doc_id] += r.copy_words
    assert dict(words) == {k: n for k, n in taken.items() if n}
    assert set(frame.columns) < set(mixing.mixture(frame).columns)


def test_columns_of_the_same_name(spark):
    frame = docs(spark).selectExpr("*", "1 as copy", "2 as _key", "3 as _size", "4 as lam")
    out = mixing.mixture(frame)
    assert out.columns == [c for c in frame.columns if c != "copy"] + ["copy", "copy_words"]
    assert {(r._key, r._size, r.lam) for r in out.collect()} == {(2, 3, 4)}


def test_no_words_and_empty_table(spark):
    assert {r.taken for r in mixing.mixed(docs(spark, ["", None, " "])).collect()} == {0}
    assert mixing.mixed(empty(spark)).collect() == [] == mixing.mixture(empty(spark)).collect()


def test_only_whole_texts(spark):
    rng = random.Random(3)
    values = [prose(rng, rng.choice([40, rng.randint(1, 200)])) for _ in range(1200)] + [prose(rng, 4000)]
    frame = docs(spark, values)
    rows = mixing.mixture(frame).collect()
    assert all(r.text == values[r.doc_id] and r.n_chars == len(r.text) for r in rows)
    copies = defaultdict(list)
    for r in rows:
        copies[r.doc_id].append(r.copy)
    got = by_id(mixing.mixed(frame))
    assert {k: sorted(c) for k, c in copies.items()} == {k: list(range(1, r["copies"] + 1)) for k, r in got.items() if r["copies"]}
    assert all(abs(r["copies"] - r["rate"]) < 1.2 for r in got.values())
    for source in range(3):
        mine = [r for k, r in got.items() if k % 3 == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 20


def test_many_documents_of_one_size(spark, monkeypatch):
    frame = spark.range(3000).selectExpr("id as doc_id", "concat('one two three ', id) as text", "if(id < 1000, 'a', 'b') as source")
    taken = mixing.mixed(frame).where("source_size > 4000").groupBy().agg({"taken": "sum", "target": "max"}).first()
    monkeypatch.setattr(mixing, "PICKED", 4)
    again = mixing.mixed(frame).where("source_size > 4000").groupBy().agg({"taken": "sum", "target": "max"}).first()
    assert taken == again and abs(taken["sum(taken)"] - taken["max(target)"]) <= 2
