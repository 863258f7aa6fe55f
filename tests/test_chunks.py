"""The table of chunks: resume, failures between its steps, replacement, backup, compaction, lookup."""

import pytest
from pyspark.sql import functions as F

from loomline.operators import generate, learn
from loomline.sources.chunks import ChunkTable


def keyed(spark, low, high, value="v"):
    return spark.range(low, high).select(F.lpad(F.col("id").cast("string"), 6, "0").alias("k"), F.lit(value).alias("v"))


def content(table, version=None):
    return sorted(map(tuple, table.read(version).collect()))


def rows(low, high, value="v"):
    return [(f"{i:06d}", value) for i in range(low, high)]


def test_resume_keeps_every_row_once(spark, tmp_path):
    """600 of 1000, a job that dies between write and publish, then all of them: every row is there once."""
    table = ChunkTable(spark, str(tmp_path / "t"), "k", 100)
    everything = keyed(spark, 0, 1000)
    assert table.add(everything.where("k < '000600'")) == 1 and content(table) == rows(0, 600)
    table.stage(everything)
    assert content(table) == rows(0, 600) and table.version() == 1
    assert table.add(everything) == 2 and content(table) == rows(0, 1000)
    assert table.manifest().agg(F.sum("rows"), F.max("rows")).first()[:] == (1000, 100)
    assert table.add(everything) == 3 and content(table) == rows(0, 1000)
    assert table.verify().count() == 0


def test_one_of_two_writers_publishes(spark, tmp_path):
    table, other = (ChunkTable(spark, str(tmp_path / "t"), "k") for _ in range(2))
    staged = table.stage(keyed(spark, 0, 10))
    other.add(keyed(spark, 20, 30))
    with pytest.raises(FileExistsError):
        table.publish(staged, False, 0)
    assert table.publish(staged, False, table.version()) == 2 and content(table) == rows(0, 10) + rows(20, 30)


def test_a_torn_commit_file_counts_for_nothing(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "k")
    table.add(keyed(spark, 0, 5))
    (tmp_path / "t/commits/00000002").write_text('{"attempt": "x", "wh')
    assert content(table) == rows(0, 5)


def test_replace_compact_and_backup(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "k", 50)
    for i in range(4):
        table.add(keyed(spark, 25 * i, 25 * i + 25).repartition(3))
    assert table.replace(keyed(spark, 90, 120, "new")) == 5
    assert content(table) == rows(0, 90) + rows(90, 120, "new") and content(table, 4) == rows(0, 100)
    table.compact()
    after = [(r.least, r.greatest) for r in table.manifest().orderBy("least").collect()]
    assert all(a[1] < b[0] for a, b in zip(after, after[1:])) and content(table) == content(table, 5)
    table.stage(keyed(spark, 0, 3))
    assert table.vacuum() == 6 and content(table) == rows(0, 90) + rows(90, 120, "new")


def test_lookup_reads_few_chunks(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "k", 20)
    table.add(keyed(spark, 0, 2000))
    table.add(keyed(spark, 5000, 5010))
    asked = keyed(spark, 300, 310).unionByName(keyed(spark, 4000, 4010)).unionByName(keyed(spark, 305, 308)).select("k").union(spark.createDataFrame([(None,)], "k string"))
    assert sorted(map(tuple, table.lookup(asked).collect())) == rows(300, 310)
    assert 10 * len(table.holding(asked)) < table.manifest().count()
    assert table.lookup(keyed(spark, 3000, 3001)).count() == 0


def test_damage_is_seen(spark, tmp_path):
    table = ChunkTable(spark, str(tmp_path / "t"), "k", 50)
    table.add(keyed(spark, 0, 100))
    first, second = table._chunks(None)[:2]
    spark.read.parquet(first).withColumn("v", F.lit("other")).coalesce(1).write.parquet(str(tmp_path / "x"))
    (made,) = (tmp_path / "x").glob("part-*")
    name = second.rsplit("/", 1)[1]
    target = next((tmp_path / "t/data").rglob(name))
    target.write_bytes(made.read_bytes())
    target.with_name(f".{name}.crc").unlink()
    assert [r.file for r in table.verify().collect()] == [name]


def test_each_text_is_encoded_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def encode(texts):
        seen.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    table = ChunkTable(spark, str(tmp_path / "t"), "digest")
    texts = spark.createDataFrame([("a",), ("bb",), ("a",), (None,), ("",)], "text string")
    learn.add_vectors(texts, table, learn.encoder(encode))
    assert seen.value == 3
    learn.add_vectors(texts.union(spark.createDataFrame([("ccc",)], "text string")), table, learn.encoder(encode))
    assert seen.value == 4
    learn.add_vectors(texts, table, learn.encoder(encode))
    assert seen.value == 4
    got = learn.with_vectors(texts.union(spark.createDataFrame([("new",)], "text string")), table, 2)
    assert sorted(("-" if r.text is None else r.text, r.vector) for r in got.collect()) == [("", [0.0, 1.0]), ("-", [0.0, 0.0]), ("a", [1.0, 1.0]), ("a", [1.0, 1.0]), ("bb", [2.0, 1.0]), ("new", [0.0, 0.0])]


def test_each_prompt_is_answered_once(spark, tmp_path):
    """A generator that fails at first, a prompt that breaks the job, and a second run."""
    log = tmp_path / "log"
    log.mkdir()

    def ask(prompt):
        import os
        import uuid

        if prompt == "p7" and not os.path.exists(log / "mended"):
            raise TimeoutError("down")
        if not list(log.glob(f"{prompt}.tried-*")):
            (log / f"{prompt}.tried-{uuid.uuid4().hex}").touch()
            raise TimeoutError("busy")
        (log / f"{prompt}.answer-{uuid.uuid4().hex}").touch()
        return prompt.upper()

    table = ChunkTable(spark, str(tmp_path / "t"), "digest")
    prompts = spark.createDataFrame([(f"p{i % 20}",) for i in range(60)] + [(None,)], "prompt string").repartition(1)
    with pytest.raises(Exception, match="down"):
        generate.answer(prompts, table, ask, attempts=2, pause=0.01, in_flight=1)
    assert table.version() == 0
    (log / "mended").touch()
    generate.answer(prompts, table, ask, attempts=3, pause=0.01)
    generate.answer(prompts, table, ask, attempts=1)
    assert sorted(r.answer for r in table.read().collect()) == sorted(f"P{i}" for i in range(20))
    assert all(len(list(log.glob(f"p{i}.answer-*"))) == 1 for i in range(20)) and not (tmp_path / "t/journal").exists()
