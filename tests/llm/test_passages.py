import random

from loomline.llm import passages as P

from .helpers import docs, empty


def brute(values):
    words = [(t or "").split() for t in values]
    owners = {}
    for i, w in enumerate(words):
        for k in range(len(w) - P.WORDS + 1):
            owners.setdefault(tuple(w[k : k + P.WORDS]), set()).add(i)
    out = {}
    for i, w in enumerate(words):
        covered = set()
        for k in range(len(w) - P.WORDS + 1):
            if len(owners[tuple(w[k : k + P.WORDS])]) > 1:
                covered.update(range(k, k + P.WORDS))
        if covered:
            out[i] = len(covered)
    return out


def mixed(seed):
    rng = random.Random(seed)
    word = lambda n: [rng.choice("a b c de fg hij k l m n".split()) + str(rng.randint(0, 40)) for _ in range(n)]
    shared = [word(n) for n in (50, 51, 52, 60, 95, 200)]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 4)):
            parts += rng.choice(shared) if rng.random() < 0.5 else word(rng.randint(0, 120))
        if rng.random() < 0.3 and parts:
            parts[rng.randrange(len(parts))] = "changed"
        out.append(" ".join(parts))
    line = " ".join(word(60))
    return out + out[:3] + [f"{line}\n{line}\n{line}", "x " * 300, "", None]


def test_equals_brute_force(spark):
    for seed in (1, 2):
        values = mixed(seed)
        got = {r.doc_id: r.shared_words for r in P.shared_words(docs(spark, values)).collect()}
        assert got == brute(values) and got


def test_rows_of_one_id_are_one_document(spark):
    text = " ".join(f"w{i}" for i in range(80))
    frame = spark.createDataFrame([(1, text), (1, text), (None, text)], "doc_id long, text string")
    assert P.shared_words(frame).collect() == []


def test_empty_table(spark):
    assert P.shared_words(empty(spark)).collect() == []
