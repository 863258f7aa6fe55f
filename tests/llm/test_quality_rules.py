from collections import Counter

import numpy as np
import pytest

from loomline.llm import quality_rules as Q

from .helpers import WORD, by_id, docs, empty, texts


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    inside = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside), "base_failed": failed}


ODD = ["a\nb\na\n\n\na \nb", "#*$%&|<> x\r\ny\r\ny", "w1 w2 w3 w4 w5 w6 " * 4, "same line\n" * 9, "é é\x1fz \x0b\x0c", "\n", "1 2 3 4 5 6 7 8 9", "1 2 3 4 5 6 7 8 9 10"]


def test_base_measures(spark):
    values = texts(11) + ODD
    got = by_id(Q.quality_report(docs(spark, values), Q.Ratio(np.zeros(1 << Q.BUCKET_BITS))))
    for i, text in enumerate(values):
        want = plain(text)
        assert {k: got[i][k] for k in want} == want, text
        assert got[i]["kept"] == (not want["base_failed"])


def test_ratio_rejects_what_is_not_like_trusted_text(spark):
    rng = np.random.default_rng(0)
    good = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"], 40) + rng.choice(list("abcdefgh"), 40)) for _ in range(200)]
    junk = [" ".join(w + "***" for w in g.split()) for g in good[:40]]
    frame = docs(spark, good + junk)
    trusted = spark.createDataFrame([(i,) for i in range(0, 200, 2)] + [(None,)], "doc_id long")
    ratio = Q.fitted_ratio(frame, trusted)
    got = by_id(Q.quality_report(frame, ratio))
    passed = [i for i in got if not got[i]["base_failed"]]
    assert all(got[i]["kept"] == (i < 200) for i in passed) and len(passed) > 200
    kept = Q.quality_filter(frame, ratio)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {i for i in got if got[i]["kept"]}


def test_no_trusted_text_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert not Q.fitted_ratio(docs(spark), none).weights.any()
    ratio = Q.fitted_ratio(empty(spark), none)
    assert Q.quality_report(empty(spark), ratio).collect() == [] == Q.quality_filter(empty(spark), ratio).collect()


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_threshold_is_the_quantile_of_all_held_out_documents(spark, n):
    values = np.round(np.random.default_rng(n).normal(0, 0.01, n), 4)
    got = Q._quantile(spark.createDataFrame([(float(v),) for v in values], "llr double"), 0.37)
    assert got == pytest.approx(np.quantile(values, 0.37), abs=1e-12)
    assert Q._quantile(spark.createDataFrame([], "llr double"), 0.37) is None


def test_every_trusted_document_counts(spark):
    docs = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 60, 3)], "doc_id long")
    assert sorted(r.doc_id for r in Q._of(docs, ids).collect()) == list(range(0, 50, 3))
    assert not hasattr(Q, "TRUSTED_BOUND")
