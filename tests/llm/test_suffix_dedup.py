import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import suffix_dedup as S

from .helpers import by_id, docs, empty, texts


def brute(values, length=S.LENGTH):
    data = [(t or "").encode() for t in values]
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed, n=60):
    rng = random.Random(seed)
    made = ["".join(rng.choice("abcdefgh é ") for _ in range(size)) for size in (100, 380, 399, 400, 401, 900)]
    out = []
    for _ in range(n):
        k = rng.random()
        if k < 0.15:
            out.append("a" * rng.randint(300, 1500))
        elif k < 0.25:
            out.append("ab" * rng.randint(150, 700))
        elif k < 0.35 and out:
            out.append(rng.choice(out))
        else:
            out.append("".join(rng.choice(made) if rng.random() < 0.5 else "".join(rng.choice("abcdefgh é ") for _ in range(rng.randint(0, 700))) for _ in range(rng.randint(1, 4))))
    return out + ["", None, None]


@pytest.mark.parametrize("seed, group", [(5, 2000), (6, 4)])
def test_equals_brute_force(spark, monkeypatch, seed, group):
    monkeypatch.setattr(S, "GROUP_ROWS", group)  # 4: every head recurses
    values = passages(seed)
    got = by_id(S.removals(docs(spark, values)))
    want = brute(values)
    assert [tuple(got[i][k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(values))] == want
    assert sum(w[1] for w in want)


def test_long_texts_come_in_slices(spark, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 1500)
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdef ") for _ in range(3000))
    values = ["".join(rng.choice("abcdef ") for _ in range(n)) + shared + "".join(rng.choice("abcdef ") for _ in range(n)) for n in (100, 2777, 5000)] + ["ab" * 4000]
    got = by_id(S.removals(docs(spark, values)))
    assert [tuple(got[i][k] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for i in range(len(values))] == brute(values)


def test_owner_is_the_leftmost_least_head():
    tuples = S.Tuples(pa.array([t or "" for t in passages(3, 30)]))
    starts = np.arange(len(tuples.data) - S.HEAD + 1)
    h = tuples.spans.hash(starts, starts + S.HEAD)
    covered = 0
    for first, last, at in zip(tuples.first, tuples.last, tuples.at):
        for i in range(first, last + 1):
            assert i + int(np.argmin(h[i : i + S.SPAN + 1])) == at
            covered += 1
    assert covered == sum(max(0, n - S.LENGTH + 1) for n in np.diff(tuples.offsets))


def test_texts_are_cut_and_columns_kept(spark):
    values = texts(2, 8) + ["same " * 120, "same " * 120, "other words only"]
    out = S.without_repeats(docs(spark, values))
    rows = by_id(out)
    assert out.columns == docs(spark, values).columns and len(rows) == len(values)
    assert rows[len(values) - 1]["text"] == "other words only" and rows[len(values) - 2]["text"] == ""


def test_empty_table(spark):
    assert S.removals(empty(spark)).collect() == []
