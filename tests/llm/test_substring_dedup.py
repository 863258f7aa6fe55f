import hashlib
import random

import pytest

from loomline.llm import substring_dedup as S
from loomline.llm.queries import ORACLE_SQL, QUERIES

from .helpers import WORD, docs, empty, prose, texts


def plain(rows):
    """The contract in plain Python, for (doc_id, text) rows."""
    words = [WORD.findall(t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words):
        for i in range(len(w) - 49):
            if d is not None:
                k = tuple(w[i : i + 50])
                least[k] = min(least.get(k, d), d)
    out = []
    for (d, _), w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 49):
            if d is not None and least[tuple(w[i : i + 50])] < d:
                gone[i : i + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def passages(seed, n=60):
    """Documents that share passages of about 50 words in different contexts, shifted, cut, overlapping and chained."""
    rng = random.Random(seed)
    pool = [prose(rng, k).split() for k in (49, 50, 51, 60, 75, 130, 400)] + [["x"] * 90, ["a", "b"] * 40, ["p", "q", "r"] * 30]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(pool)
            i = rng.choice([0, 0, rng.randrange(len(p))])
            words += p[i : i + rng.choice([30, 49, 50, 51, 70, 400])] + prose(rng, rng.choice([0, 1, 3, 40])).split()
            if rng.random() < 0.3 and words:
                words[rng.randrange(len(words))] = "changed"
        out.append(rng.choice([" ", "  ", "\n", "\t\x0b"]).join(words))
        if rng.random() < 0.4:
            pool.append(words[: rng.randint(1, 300)] or ["y"])
    return out


def test_cover():
    """Every shift between two documents has a position of the cover in both."""
    for shift in range(S.PERIOD):
        assert any((c + shift) % S.PERIOD in S.COVER for c in S.COVER)
    assert S.PERIOD + S.ANCHOR - 1 == S.WINDOW


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    values = passages(seed) + texts(seed)
    random.Random(seed).shuffle(values)
    assert result(S.removals(docs(spark, values))) == plain(list(enumerate(values)))


@pytest.mark.parametrize("bits", [6, 17])
def test_full_bitmaps_lose_nothing(spark, monkeypatch, bits):
    """Bitmaps that say yes to everything, and short blocks."""
    from loomline.llm import common

    monkeypatch.setattr(common, "BITMAP_BITS", bits)
    monkeypatch.setattr(S, "MOST", 7)
    values = passages(9, 40)
    assert result(S.removals(docs(spark, values))) == plain(list(enumerate(values)))


def test_awkward_rows(spark):
    """Null and equal doc_ids, repeated rows, one text in many documents."""
    values = passages(5, 20)
    rows = [(i // 2, t) for i, t in enumerate(values)] + [(None, values[0]), (None, None), (3, values[6]), (3, values[6]), (-5, values[7])] + [(100 + i, values[7]) for i in range(30)]
    frame = spark.createDataFrame([(*r, "mine", 1, "mine") for r in rows], "doc_id long, text string, key string, first int, starts string").repartition(3)
    assert result(S.removals(frame)) == plain(rows)


def test_empty(spark):
    assert S.removals(empty(spark)).collect() == []


def test_very_long_text(spark):
    """20 MB in one document, a third of it a copy."""
    rng = random.Random(11)
    part = " ".join(f"w{rng.randrange(10**6)}" for _ in range(800_000))
    rows = [(1, part), (2, "start " + part + " " + " ".join(f"v{rng.randrange(10**6)}" for _ in range(1_700_000)))]
    assert len(rows[1][1]) > 18_000_000
    got = {r.doc_id: r for r in S.removals(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[2].n_removed, got[2].n_words) == (0, 800_000, 2_500_001)


def test_twin(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet'")
    want = con.execute(f"select doc_id, n_words, n_removed, kept_sha256 from ({ORACLE_SQL['op11_substring_dedup']})").fetchall()
    assert sum(r[2] for r in want) > 0
    assert result(QUERIES["op11_substring_dedup"](spark, folder)) == sorted(want, key=str)
