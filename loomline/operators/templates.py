"""Templates of log messages by a prefix tree of fixed depth, and matching against the templates found.

The tree has a node for each number of words, below it one for each first word,
and below that clusters of messages: a message joins the cluster that agrees with it in
most words, if these are ``LIKE`` of all at least, and words that differ become
holes; else it starts a cluster. Words with digits share one node, and so do
those beyond the first ``CHILDREN - 1`` of a parent.

Nodes do not depend on each other, so each is one group of a shuffle, grown in
the order in which its distinct messages first appear. A node of over ``HOT``
distinct messages is split by the next word, again and again; what has no word
left is dealt into shards, grown alone, whose templates are merged as messages
are, eight shards at a time. Below ``HOT`` the result is that of a sequential tree
over the distinct messages.

A message matches a template of its own node only, in every word that is no
hole; of several, the one with most holes, then the first. Templates are compiled to a
trie with a branch for holes at each word, descended with backtracking.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

HOLE = "<*>"
UNKNOWN = "<UNKNOWN>"
LIKE, DEPTH, CHILDREN = 0.4, 4, 100
#: Distinct messages of a node that one task grows.
HOT = 20_000
#: Templates of a trie; those of a node stay together.
BLOCK = 65_536


class Clusters:
    """The clusters of one node: words as numbers, a row a template, holes as -1."""

    def __init__(self, words: int, like: float = LIKE):
        self.known: dict[str, int] = {}
        self.rows, self.holes, self.sizes, self.firsts, self.n, self.like = np.zeros((16, words), np.int64), np.zeros(16, np.int64), [], [], 0, like

    def add(self, words: list[str], size: int, first: tuple) -> None:
        row = np.array([-2 if w == HOLE else self.known.setdefault(w, len(self.known)) for w in words])
        same = (self.rows[: self.n] == row).sum(axis=1)
        if self.n and (most := same.max()) >= self.like * len(words):
            best = np.flatnonzero(same == most)
            i = int(best[self.holes[best].argmax()])
            self.rows[i, self.rows[i] != row] = -1
            self.holes[i] = (self.rows[i] == -1).sum()
            self.sizes[i] += size
            return
        if self.n == len(self.rows):
            self.rows, self.holes = np.concatenate([self.rows, np.zeros_like(self.rows)]), np.concatenate([self.holes, np.zeros_like(self.holes)])
        self.rows[self.n] = np.where(row < 0, -1, row)
        self.holes[self.n] = (row < 0).sum()
        self.sizes.append(size)
        self.firsts.append(first)
        self.n += 1

    def templates(self) -> Iterator[tuple[str, int, tuple]]:
        names = [*self.known, HOLE]
        for row, size, first in zip(self.rows[: self.n], self.sizes, self.firsts):
            yield " ".join(names[w] for w in row), size, first


def _grow(order: list[str], like: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values([*order, "template"])
        clusters = Clusters(int(rows["words"].iloc[0]), like)
        for template, size, *first in rows[["template", "size", *order]].itertuples(index=False):
            clusters.add(template.split(" "), size, first)
        node = [rows["words"].iloc[0], rows["path"].iloc[0], rows["shard"].iloc[0]]
        return pd.DataFrame([(*node, t, n, *first) for t, n, first in clusters.templates()], columns=["words", "path", "shard", "template", "size", *order])

    return run


def _word(i: int | Column) -> Column:
    """The i-th word of a message, or the hole that stands for all words with digits."""
    word = F.get(F.split("template", " "), i if isinstance(i, Column) else F.lit(i))
    return F.when(word.rlike(r"\p{Nd}"), HOLE).otherwise(word)


def _nodes(messages: DataFrame, order: list[str], levels: int) -> DataFrame:
    """Adds ``path``: the words of the nodes down to a message's own. The last word is never a node."""
    rows = messages.withColumn("path", F.array().cast("array<string>"))
    for i in range(levels):
        here = rows.withColumn("_word", F.when(F.col("words") > i + 1, _word(i)))
        first = here.where(f"_word <> '{HOLE}'").groupBy("words", "path", "_word").agg(F.min(F.struct(*order)).alias("_first"))
        rank = F.row_number().over(W.partitionBy("words", "path").orderBy("_first", "_word"))
        own = written(first.withColumn("_rank", rank).where(F.col("_rank") < CHILDREN).select("words", "path", "_word", F.lit(True).alias("_own")))
        node = F.when(F.col("_own"), F.col("_word")).otherwise(F.lit(HOLE))
        rows = here.join(own, ["words", "path", "_word"], "left").withColumn("path", F.when(F.col("_word").isNull(), F.col("path")).otherwise(F.array_append("path", node))).drop("_word", "_own")
    return rows


def mine_templates(lines: DataFrame, text: str, order: list[str], like: float = LIKE, depth: int = DEPTH) -> DataFrame:
    """(words, path, template, size, *order) of each template; ``order`` names the columns that order lines, and keeps the first line's."""
    firsts = F.min(F.struct(*order)).alias("_first")
    counts = lines.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("template")).agg(F.count(F.lit(1)).alias("size"), firsts).select("template", "size", "_first.*")
    rows = written(_nodes(counts.withColumn("words", F.size(F.split("template", " "))), order, depth - 3))
    while True:
        sizes = written(rows.groupBy("words", "path").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HOT))
        split = sizes.where(F.col("words") > F.size("path")).select("words", "path", F.lit(True).alias("_hot"))
        if split.isEmpty():
            break
        finer = F.when(F.col("_hot"), F.array_append("path", _word(F.size("path")))).otherwise(F.col("path"))
        rows = written(rows.join(split, ["words", "path"], "left").withColumn("path", finer).drop("_hot"))
    shards = F.coalesce(F.ceil(F.col("_n") / HOT), F.lit(1)).cast("long")
    rows = rows.join(sizes, ["words", "path"], "left").withColumn("shard", F.pmod(F.xxhash64("template"), shards)).drop("_n")
    kinds = dict(lines.dtypes)
    schema = f"words int, path array<string>, shard long, template string, size long, {', '.join(f'{c} {kinds[c]}' for c in order)}"
    grow = lambda df: df.select("words", "path", "shard", "template", "size", *order).groupBy("words", "path", "shard").applyInPandas(_grow(order, like), schema)
    found, most = grow(rows), sizes.agg(F.max(F.ceil(F.col("_n") / HOT))).first()[0] or 1
    while most > 1:
        found, most = grow(written(found).withColumn("shard", F.floor(F.col("shard") / 8).cast("long"))), -(-most // 8)
    return found.drop("shard")


class Trie:
    """Templates by node; below a node a branch for each word and one for holes."""

    def __init__(self, templates: list[tuple[tuple[str, ...], str]]):
        self.nodes: dict = {}
        for rank, (path, template) in enumerate(templates):  # the first comes first
            at = self.nodes.setdefault(path, {})
            words = template.split(" ")
            for word in words:
                at = at.setdefault(word, {})
            at.setdefault(None, (words.count(HOLE), -rank, template))

    def match(self, path: tuple[str, ...], words: list[str]) -> str | None:
        """The template of the node that fits every word; of several the one with most holes, then the first."""
        best, todo = None, [(self.nodes.get(path, {}), 0)]
        while todo:
            at, i = todo.pop()
            if i == len(words):
                best = max(filter(None, (best, at.get(None))), default=None)
                continue
            for word in {words[i], HOLE}:
                if word in at:
                    todo.append((at[word], i + 1))
        return best and best[2]


def match_templates(lines: DataFrame, templates: DataFrame, text: str, order: list[str]) -> DataFrame:
    """Adds ``template``, ``<UNKNOWN>`` for a line that fits none. Distinct messages are matched once, and nothing is learnt from them."""
    templates = written(templates)
    rows = lines.where(F.col(text).isNotNull()).select(F.col(text).alias("template")).distinct()
    rows = rows.withColumn("words", F.size(F.split("template", " "))).withColumn("path", F.array().cast("array<string>"))
    deepest = templates.agg(F.max(F.size("path"))).first()[0] or 0
    for i in range(deepest):
        # The child for a message's word, or else that for holes, where the node has any children.
        below = written(templates.where(F.size("path") > i).select("words", F.slice("path", 1, i).alias("path"), F.col("path")[i].alias("_word")).distinct())
        any_ = below.select("words", "path", F.lit(True).alias("_inner")).distinct()
        here = rows.withColumn("_word", _word(i)).join(below.withColumn("_own", F.lit(True)), ["words", "path", "_word"], "left").join(any_, ["words", "path"], "left")
        node = F.when(F.col("_own"), F.col("_word")).otherwise(F.lit(HOLE))
        rows = here.withColumn("path", F.when(F.col("_inner"), F.array_append("path", node)).otherwise(F.col("path"))).drop("_word", "_own", "_inner")
    blocks = -(-templates.count() // BLOCK) or 1
    of_block = F.pmod(F.xxhash64("words", "path"), F.lit(blocks))
    rows, parts = written(rows.withColumn("_block", of_block)), []
    for b in range(blocks):
        found = templates.where(of_block == b).orderBy(*order, "template").select("path", "template").collect()  # about BLOCK rows
        shared = lines.sparkSession.sparkContext.broadcast(Trie([(tuple(r.path), r.template) for r in found]))

        def matched(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for frame in frames:
                best = [shared.value.match(tuple(path), message.split(" ")) for message, path in zip(frame["template"], frame["path"])]
                yield pd.DataFrame({"_text": frame["template"], "template": pd.Series(best, dtype=object)})

        parts.append(rows.where(F.col("_block") == b).select("template", "path").mapInPandas(matched, "_text string, template string"))
    found = written(reduce(DataFrame.unionAll, parts))
    return lines.join(found, F.col(text) == F.col("_text"), "left").drop("_text").withColumn("template", F.coalesce("template", F.lit(UNKNOWN)))
