import random
import re
from collections import Counter

import numpy as np
import pytest

from loomline.llm import collocations as C
from loomline.llm.queries import ORACLE_SQL, QUERIES

from .helpers import docs, empty, texts


def plain(rows, least, best):
    """The contract in plain Python, for (lang, text) rows."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    out = {}
    for (lang, p), a in cands.items():
        inside = any(q[0] == lang and len(q[1]) > len(p) and 100 * b >= 100 * a and any(q[1][i : i + len(p)] == p for i in range(len(q[1]) - len(p) + 1)) for q, b in cands.items())
        if not inside:
            score, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, s[2].decode(), -s[1], s[3], s[4], n[lang], -s[0]) for lang, xs in out.items() for i, s in enumerate(sorted(xs)[:best]))


def phrases(seed, n=60):
    rng = random.Random(seed)
    words = "the The of état naïve a,b x. new york city and new delhi ö \x1cfs \x1f".split(" ")
    fixed = ["new york city hall", "the the the the the the", "state of the art", "état of the union address"]
    return [" ".join(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 60))).replace(" of ", rng.choice([" of ", "\tof  ", ". of ", "\x0bof\n"])) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, 7, 7, "mine") for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long, k long, phrase string").repartition(3)


@pytest.mark.parametrize("seed, slots, best", [(1, 1 << 20, 2000), (2, 40, 2000), (3, 1 << 20, 7)])
def test_equals_brute_force(spark, monkeypatch, seed, slots, best):
    """Also with candidates in several blocks."""
    monkeypatch.setattr(C, "SLOTS", slots)
    rng = random.Random(seed)
    rows = [(rng.choice(["en", "en", "de", None, "und"]), t) for t in phrases(seed) + texts(seed)]
    assert sorted(tuple(r) for r in C.collocations(table(spark, rows), 5, best).collect()) == plain(rows, 5, best)


def test_perfect_hash():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**64, (n, 2), np.uint64), axis=0)
        keys[: n // 3, 0] = 7  # keys that differ in one half only
        table = C.PerfectHash(keys)
        assert sorted(table.slots(keys[:, 0], keys[:, 1]).tolist()) == list(range(n))
        other = rng.integers(0, 2**64, (1000, 2), np.uint64)
        assert (table.slots(other[:, 0], other[:, 1]) == -1).all()


def test_scores_past_64_bits():
    import pyarrow as pa

    big = 3 * 10**13
    part = pa.RecordBatch.from_pydict({"lang": ["en"], "phrase": ["a b c"], "k": [3], "n": [big], "f0": [10**12], **{f"f{i}": [10**12 + i if i < 5 else 0] for i in range(1, 9)}})
    out = next(C._scored([part])).to_pylist()[0]
    want = [1000 * 10**12 * big // ((10**12 + 2 * i + 1) * (10**12 + 2 * i + 2)) for i in range(2)]
    assert out["score"] == min(want) and out["l"] == 10**12 + 2 * want.index(min(want)) + 1


def test_awkward_tables(spark):
    assert C.collocations(empty(spark)).collect() == []
    assert C.collocations(docs(spark, [None, "", " . ", "one"])).collect() == []
    rows = [("en", "a b " * 70_000)] * 3
    assert sorted(tuple(r) for r in C.collocations(table(spark, rows)).collect()) == plain(rows, 100, 2000)


def test_twin(spark):
    import duckdb

    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(f"select lang, rank, phrase, a, l, r, n, score from ({ORACLE_SQL['op12_collocations']})").fetchall()
    assert len(want) > 20
    assert sorted(tuple(r) for r in QUERIES["op12_collocations"](spark, folder).collect()) == sorted(want)
