"""The template tree against a sequential one, and matching."""

import os
import random

import pytest

from loomline.functions import entities as E
from loomline.operators import templates as T
from loomline.sources import eventlog

SF = os.environ.get("LOOMLINE_TEST_SF", "/root/testdata/sf0.01")


class Tree:
    """A sequential tree of depth 4, one line at a time."""

    def __init__(self):
        self.nodes, self.words = {}, {}

    def node(self, words, grow=False):
        if len(words) == 1:
            return (1,)
        known = self.words.setdefault(len(words), set())
        if grow and not any(c.isdigit() for c in words[0]) and len(known) < 99:
            known.add(words[0])
        return len(words), words[0] if words[0] in known else "<*>"

    def add(self, line):
        words = line.split(" ")
        clusters = self.nodes.setdefault(self.node(words, True), [])
        scored = [(sum(a == b != "<*>" for a, b in zip(t, words)), t.count("<*>"), -i) for i, (t, _) in enumerate(clusters)]
        if scored and (best := max(scored))[0] >= 0.4 * len(words):
            cluster = clusters[-best[2]]
            cluster[0][:] = [a if a == b else "<*>" for a, b in zip(cluster[0], words)]
            cluster[1] += 1
        else:
            clusters.append([words[:], 1])

    def match(self, line):
        words = line.split(" ")
        fits = [(t.count("<*>"), -i, " ".join(t)) for i, (t, _) in enumerate(self.nodes.get(self.node(words), [])) if all(a in ("<*>", b) for a, b in zip(t, words))]
        return max(fits)[2] if fits else "<UNKNOWN>"

    def templates(self):
        return sorted((" ".join(t), n) for clusters in self.nodes.values() for t, n in clusters)


def grown(lines):
    tree = Tree()
    for line in lines:
        tree.add(line)
    return tree


def table(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "i long, line string").repartition(3)


def mined(frame, order=("i",)):
    return sorted((r.template, r["size"]) for r in T.mine_templates(frame, "line", list(order)).collect())


def test_equals_a_sequential_tree_on_the_event_log(spark):
    lines = eventlog.lines(spark, SF).join(spark.read.parquet(f"{SF}/events.parquet").select("event_id", "ts"), "event_id").select("ts", "event_id", E.message("raw_line").alias("line"))
    tree = grown([r.line for r in lines.orderBy("ts", "event_id").collect()])
    assert mined(lines, ("ts", "event_id")) == tree.templates()


def random_lines(seed, n=300):
    rng = random.Random(seed)
    words = ["open", "close", "file", "x1", "x2", "by", "user", "", "é"]
    return list(dict.fromkeys(" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 5, 8]))) for _ in range(n)))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_a_sequential_tree_on_distinct_lines(spark, seed):
    lines = random_lines(seed)
    tree, frame = grown(lines), table(spark, lines)
    assert mined(frame) == tree.templates()
    asked = random_lines(seed + 100) + lines[:50] + ["never seen before at all"]
    got = T.match_templates(table(spark, asked), T.mine_templates(frame, "line", ["i"]), "line", ["i"]).collect()
    assert {r.i: r.template for r in got} == {i: tree.match(x) for i, x in enumerate(asked)} and len(got) == len(asked)
    assert any(r.template == T.UNKNOWN for r in got)


def test_many_first_words(spark):
    """Beyond 99 first words of a length, new ones share a node."""
    lines = [f"{chr(97 + i // 26)}{chr(97 + i % 26)} one two three" for i in range(150)] + ["zz9 one two three", "ab one two four"]
    assert mined(table(spark, lines)) == grown(lines).templates()
    assert ("<*> one two three", 52) in mined(table(spark, lines))


@pytest.mark.parametrize("hot", [3, 25])
def test_hot_nodes_are_split(spark, monkeypatch, hot):
    """Every line is in one template that fits it, whatever is split; shards of one form are merged again."""
    monkeypatch.setattr(T, "HOT", hot)
    monkeypatch.setattr(T, "BLOCK", 4)
    lines = random_lines(7) + [f"n{i} is {i} of all m{i} made so r{i}" for i in range(60)]
    frame = table(spark, lines)
    found = T.mine_templates(frame, "line", ["i"])
    assert sum(r["size"] for r in found.collect()) == len(lines) and ("<*> is <*> of all <*> made so <*>", 60) in mined(frame)
    got = T.match_templates(frame, found, "line", ["i"]).collect()
    assert len(got) == len(lines) and all(all(a in ("<*>", b) for a, b in zip(r.template.split(" "), r.line.split(" "))) for r in got)


def test_empty_and_null(spark):
    frame = table(spark, ["a b c", None])
    assert mined(frame) == [("a b c", 1)] and mined(frame.limit(0)) == []
    got = T.match_templates(frame, T.mine_templates(frame.limit(0), "line", ["i"]), "line", ["i"]).collect()
    assert [r.template for r in got] == [T.UNKNOWN] * 2
