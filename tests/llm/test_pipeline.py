"""The pipeline over a small corpus with planted cases, stage by stage against plain readings."""

import random

import pytest

from loomline.llm import secrets

from .helpers import WORD, prose

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    place = str(tmp_path_factory.mktemp("corpus"))
    good = [prose(rng, rng.randint(40, 200)) for _ in range(160)]
    items = [prose(rng, 30) for _ in range(3)]
    texts = list(good)
    texts += [good[0], good[1], good[1] + " end"]  # 160-162: copies
    texts += [f"{good[5][:200]} {items[0]} {good[6][:200]}", f"{good[7]} {items[1].upper()} {good[8]}"]  # 163, 164: leaks
    texts += ["too short", "again and again it goes " * 40, None, ""]  # 165-168: base rules
    texts += [" ".join(w + "$$$" for w in g.split()) for g in good[20:30]]  # 169-178: junk
    texts[2] += ' token = "0123456789abcdef0123"'
    docs = [(i, t, "en", ["a", "b", None][i % 3], None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{place}/documents.parquet")
    spark.createDataFrame([(i, int(i < 160), 0) for i in range(0, 179, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{place}/benchmark.parquet")
    return place


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = corpus_pipeline.cut(stage(spark, docs, folder))
        assert out.columns[:5] == docs.columns[:5]
        assert n == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        seen[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    quality, copies, leaks, hidden, mixed = (seen[name] for name, _ in corpus_pipeline.STAGES)
    assert set(range(163)) <= set(quality) and not set(range(165, 179)) & set(quality)
    assert set(quality) - set(copies) == {160, 161, 162}
    assert set(copies) - set(leaks) == {163, 164}
    assert set(hidden) == set(leaks) and "[assign]" in hidden[2]
    assert all(not secrets.all_spans(t)[1] for t in hidden.values())
    assert {i: t for i, t in hidden.items() if i != 2} == {i: t for i, t in leaks.items() if i != 2}
    assert set(mixed) <= set(hidden) and all(hidden[i].startswith(t) for i, t in mixed.items())


def test_run_gives_the_last_stage(spark, folder):
    rows = corpus_pipeline.run(spark, folder)
    words = rows.groupBy().sum("copy_words").first()[0]
    kept = sum(len(WORD.findall(r.text)) for r in rows.where("copy = 1").collect())
    assert rows.columns[-2:] == ["copy", "copy_words"] and words >= kept > 0


