"""Words of each document that passages shared with other documents cover.

A passage is ``WORDS`` words in a row (contract words, as bytes). Sampling is
that of ``suffix_dedup`` over words in place of bytes: a passage owns the suffix
that starts at the least hash of a ``HEAD``-word gram in it, and the passages
that own one suffix make a context, told by hashes of all its words.

1. Heads of one document only are dropped.
2. A context that stands in two documents is shared as a whole.
3. Of the other contexts of a head, and one of each shared, the passages are
   counted one by one.

Documents are told apart by doc_id, so rows without one share nothing and rows
of one id are the same document. Null and empty texts have no words; shorter
texts than a passage share nothing. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bitmap, cut, in_bitmap

WORDS = 51
HEAD = 8
_SPAN = WORDS - HEAD
_BLOCK = 1 << 16  # passages handled at once


class _Contexts:
    """Contexts of the documents of one column; positions count words from a document's start."""

    def __init__(self, column: pa.Array):
        data, offsets = T.utf8(column)
        start, end, doc = T.words(data, offsets)
        words = T.Spans(data).hash(start, end)
        lead = np.searchsorted(doc, np.arange(len(column) + 1))
        at = np.flatnonzero(doc[: max(len(doc) - WORDS + 1, 0)] == doc[WORDS - 1 :])
        if not len(at):
            self.first = self.last = self.doc = self.suffix = self.base = at
            self.key = at.view(np.uint64)
            return
        heads = T.grams(words, HEAD)
        around = np.lib.stride_tricks.sliding_window_view(heads, _SPAN + 1)
        suffix = np.concatenate([some + around[some].argmin(axis=1) for some in np.array_split(at, -(-len(at) // _BLOCK))])
        new = np.r_[True, (suffix[1:] != suffix[:-1]) | (at[1:] != at[:-1] + 1)]
        self.first, self.last = at[new], at[np.r_[new[1:], True]]
        self.suffix, self.doc = suffix[new], doc[at[new]]
        self.base = lead[self.doc]
        self.key = T.mix(heads[self.suffix] + np.uint64(1))
        self.spans = T.Spans(words)


def _mapped(docs: DataFrame, schema: str, columns, keep=None) -> DataFrame:
    """A row for each context, or for each that ``keep`` (contexts, doc_ids) chooses."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
        found = _Contexts(part.column("text"))
        ids = part.column("doc_id").to_numpy()
        at = np.arange(len(found.first)) if keep is None else np.flatnonzero(keep(found, ids))
        if not len(at):
            return None
        arrays = columns(found, ids, at)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)) for a in arrays], names=names)

    return docs.mapInArrow(T.mapper(run), schema)


def _heads(found, ids, at):
    pair = np.unique(np.stack([found.key.view(np.int64), ids[found.doc]]), axis=1)
    return pair[0], pair[1]


def _occurrences(found, ids, at):
    first, last = found.first[at], found.last[at]
    return ids[found.doc[at]], first - found.base[at], last - first + 1, found.key[at], found.suffix[at] - first, found.spans.hash(first, last + WORDS)


def _passages(found, ids, at):
    """The passages of the contexts, one a row."""
    n = found.last[at] - found.first[at] + 1
    of = np.repeat(np.arange(len(at)), n)
    start = found.first[at][of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return ids[found.doc[at][of]], start - found.base[at][of], found.spans.hash(start, start + WORDS)


def _hashed(ids: np.ndarray) -> np.ndarray:
    return T.mix(ids.view(np.uint64))


def _covered(ranges: DataFrame) -> DataFrame:
    """(doc_id, shared_words) of ranges (doc_id, start, stop) of words that may overlap."""
    step = lambda acc, r: F.struct((acc["n"] + F.greatest(r["stop"] - F.greatest(r["start"], acc["to"]), F.lit(0).cast("long"))).alias("n"), F.greatest(acc["to"], r["stop"]).alias("to"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    lists = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("r"))
    return lists.select("doc_id", F.aggregate("r", zero, step)["n"].alias("shared_words"))


def shared_words(docs: DataFrame) -> DataFrame:
    """(doc_id, shared_words) for each document that shares a passage with another one."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    heads = _mapped(docs, "key long, doc_id long", _heads).groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    known = bitmap(cut(heads.where("low < high").select("key")), "key")
    schema = "doc_id long, first long, passages long, key long, back long, context long"
    places = cut(_mapped(docs, schema, _occurrences, lambda found, ids: in_bitmap(known, found.key)))
    same = ["key", "back", "passages", "context"]
    classes = cut(places.groupBy(*same).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")))
    shared = places.join(classes.where("low < high").select(*same), same).select("doc_id", F.col("first").alias("start"), (F.col("first") + F.col("passages") - 1 + WORDS).alias("stop"))
    # Contexts of one document beside others of their head.
    open_keys = classes.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("low") == F.col("high")).alias("open")).where("n > 1 and open").select("key")
    parts = cut(classes.join(open_keys, "key").select("key", F.col("low").alias("doc_id")).distinct())
    if parts.isEmpty():
        return _covered(shared)
    doubtful = bitmap(parts.select("key").distinct(), "key")
    readers = _id_bitmap(parts.select("doc_id").distinct())
    rows = cut(_mapped(docs, "doc_id long, start long, passage long", _passages, lambda found, ids: in_bitmap(doubtful, found.key) & in_bitmap(readers, _hashed(ids))[found.doc]))
    # Written, so that the join by passage is one that Spark can split.
    both = cut(rows.groupBy("passage").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("passage"))
    single = rows.join(both, "passage").select("doc_id", "start", (F.col("start") + WORDS).alias("stop"))
    return _covered(shared.union(single))


def _id_bitmap(ids: DataFrame):
    """A bitmap of hashed ids."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"mark": _hashed(batch.column("doc_id").to_numpy()).view(np.int64)})

    return bitmap(cut(ids.mapInArrow(run, "mark long")), "mark")
