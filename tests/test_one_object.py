"""The reader of one giant object against json.loads, with ranges of a few bytes."""

import json
import random
from contextlib import contextmanager

import pytest
from pyspark.errors import PySparkException

from loomline.sources import knowledge, one_object


@contextmanager
def ranges_of(spark, size):
    """Files are read in ranges of so many bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, str(size))
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


ODD = ["}", "{", "[", "]", ",", ":", '"', "\\", "\\\\", '\\"', "é", "漢", "𝄞", "\n", "\t", " ", "a", '"}', '{"b": 1}', "},{", " "]


def random_value(rng, depth=0):
    kind = rng.randrange(5 if depth < 3 else 2)
    if kind == 0:
        return "".join(rng.choice(ODD) for _ in range(rng.randrange(12)))
    if kind == 1:
        return rng.choice([None, True, 1.5, -3, ""])
    if kind == 2:
        return [random_value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {"".join(rng.choice(ODD) for _ in range(3)): random_value(rng, depth + 1) for _ in range(rng.randrange(4))}


@pytest.mark.parametrize("seed, size", [(1, 40), (2, 90), (3, 300), (4, 1 << 20)])
def test_equals_json(spark, tmp_path, seed, size):
    rng = random.Random(seed)
    want = []
    for i in range(3):
        whole = {f"{''.join(rng.choice(ODD) for _ in range(4))}{j}": random_value(rng) for j in range(rng.choice([0, 1, 40]))}
        (tmp_path / f"{i}.json").write_text(" \n" * rng.randrange(9) + json.dumps(whole, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 3])) + rng.choice(["", "\n", " \n\n"]))
        want += [json.dumps({k: v}, sort_keys=True) for k, v in whole.items()]
    with ranges_of(spark, size):
        rows = one_object.entries(spark, [str(tmp_path)])
    got = [json.dumps(json.loads("{" + r.entry + "}"), sort_keys=True) for r in rows.collect()]
    assert sorted(got) == sorted(want)


def test_one_entry_over_many_ranges(spark, tmp_path):
    whole = {"a": {"logs": [{"raw_line": "x}" * 500, "timestamp": '",{'}] * 20}, "b": {"logs": []}}
    (tmp_path / "w.json").write_text(json.dumps(whole))
    with ranges_of(spark, 64):
        text = spark.read.option("lineSep", "}").text(str(tmp_path / "w.json"))
        assert text.rdd.getNumPartitions() > 100
        rows = knowledge.windows_json(spark, [str(tmp_path / "w.json")])
    got = {r.wid: [x.raw_line for x in r.logs] for r in rows.collect()}
    assert got == {"a": ["x}" * 500] * 20, "b": []}


def test_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f'w"{i}', "f", [("a}", "1"), ("b\\", "2")] * i) for i in range(50)], "wid string, label_file string, logs array<struct<raw_line:string,timestamp:string>>").repartition(4)
    one_object.write_object(rows, str(tmp_path / "out"))
    with ranges_of(spark, 200):
        back = one_object.windows_object(spark, [str(tmp_path / "out")], "label_file:string,logs:array<struct<raw_line:string,timestamp:string>>")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))


@pytest.mark.parametrize("text", ['{"a": {"b": 1}', '{"a": "b', '{"a": [1, 2}'])
def test_broken_files_are_errors(spark, tmp_path, text):
    (tmp_path / "w.json").write_text(text)
    with pytest.raises((ValueError, PySparkException)):
        knowledge.windows_json(spark, [str(tmp_path / "w.json")]).collect()


def test_ranges_grow_with_the_object(spark, tmp_path):
    """So that a large object is not read by a task for every 64 KB; small ones keep small ranges."""
    (tmp_path / "a").write_bytes(b"x" * 1_000_000)
    cores = spark.sparkContext.defaultParallelism
    assert one_object.range_bytes(spark, str(tmp_path), 65536, 32) == 65536
    assert one_object.range_bytes(spark, str(tmp_path), 100, 32) == 1_000_000 // (32 * cores)


def test_windows_of_a_value_share_an_object(spark, tmp_path):
    rows = spark.createDataFrame([(f"w{i}", "ab"[i % 2], i) for i in range(9)], "wid string, stream string, n int").repartition(5)
    one_object.write_object(rows, str(tmp_path / "o"), together="stream", files=2)
    got = one_object.windows_object(spark, [str(tmp_path / "o")], "n int").collect()
    assert sorted((r.wid, r.n) for r in got) == [(f"w{i}", i) for i in range(9)]
