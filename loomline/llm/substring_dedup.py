"""Passages of 50 words that a document with a smaller doc_id holds, too, are removed.

Anchors. Windows of ``ANCHOR`` words are hashed at the positions of a difference
cover modulo ``PERIOD`` only, counted from each document's first word. For any
shift between two documents some position of every period is in the cover of
both, and a period and an anchor fit in a window, so two equal windows share an
anchor. Documents' windows around an anchor of one document alone are done with.

Extension. A shared anchor is extended to the content-defined cuts around it: a
block is all windows that start between two cuts, known by a 128-bit hash of its
words. A block that a smaller document holds settles all its windows. What is
left of shared anchors, blocks that no smaller document holds, is written as
pieces; anchors are looked for again among these, and each window around one
that is still shared is compared by a 128-bit hash of its words. The smallest
document with a window never has it settled by a block, so nothing is lost.

Tasks learn of shared anchors and of each block's first document by bitmaps of a
fixed size. These can only say yes too often: then more windows are compared.

Null and empty texts have no words. A row with a null doc_id is kept whole and
removes nothing. Rows with equal doc_ids don't remove each other's words.
Repeated rows give repeated result rows. An empty table gives an empty table.
Extra columns are ignored. A task holds some 40 bytes for each byte of the
longest text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bitmap, cut, in_bitmap

WINDOW = 50
#: A perfect difference cover: each shift but 0 modulo PERIOD is the difference of one pair.
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
#: Cuts are where the hash of GRAM words is 0 modulo CUT; longer blocks than MOST windows are cut again.
GRAM, CUT, MOST = 4, 32, 256

_IN_COVER = np.zeros(PERIOD, bool)
_IN_COVER[list(COVER)] = True


class Words:
    """The words of several documents in one buffer, joined by single spaces, and their hashes."""

    def __init__(self, texts: pa.Array):
        lists = [(v.as_py() or "").encode().split() for v in texts]
        every = [w for ws in lists for w in ws]
        self.line = b" ".join(every)
        self.counts = np.fromiter(map(len, lists), np.int64, len(lists))
        lengths = np.fromiter(map(len, every), np.int64, len(every))
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        self.doc = np.repeat(np.arange(len(lists)), self.counts)
        self.first = np.cumsum(self.counts) - self.counts
        self.place = np.arange(len(every)) - self.first[self.doc]
        self.left = self.counts[self.doc] - self.place  # words from here to the end of the document

    def spans(self) -> T.Spans:
        return T.Spans(T.word_hashes(np.frombuffer(self.line, np.uint8), self.start, self.end))

    def bytes(self, a: int, b: int) -> bytes:
        return self.line[self.start[a] : self.end[b - 1]]

    def digests(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """128-bit hashes of words a to b, as two longs."""
        at, to = self.start[a].tolist(), self.end[b - 1].tolist()
        return np.frombuffer(b"".join(xxhash.xxh3_128_digest(self.line[i:j]) for i, j in zip(at, to)), np.int64).reshape(-1, 2)


def _anchors(words: Words, spans: T.Spans, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of anchors and their hashes. ``place``: each word's number in its document."""
    at = np.flatnonzero(_IN_COVER[place % PERIOD] & (words.left >= ANCHOR) & (words.counts[words.doc] >= WINDOW))
    return at, spans.hash(at, at + ANCHOR)


def _candidates(words: Words, at: np.ndarray) -> np.ndarray:
    """Whether a window starts at a word and holds one of the anchors ``at``; ``at`` has a document's own anchors."""
    seen = np.zeros(len(words.place) + 1, np.int64)
    seen[at + 1] = 1
    np.cumsum(seen, out=seen)
    windows = np.flatnonzero(words.left >= WINDOW)
    out = np.zeros(len(words.place), bool)
    out[windows] = seen[windows + PERIOD] > seen[windows]
    return out


def _blocks(words: Words, spans: T.Spans) -> tuple[np.ndarray, np.ndarray]:
    """Runs of window starts [a, b) between cuts; every window start is in one."""
    starts = words.left >= WINDOW
    at = np.flatnonzero(starts)
    if not len(at):
        return at, at
    a = at[(words.place[at] == 0) | (spans.hash(at, at + GRAM) % np.uint64(CUT) == 0)]
    last = words.first[words.doc[a]] + words.counts[words.doc[a]] - WINDOW + 1
    b = np.minimum(np.r_[a[1:], len(starts)], last)
    n = -(-(b - a) // MOST)
    a, b = np.repeat(a, n), np.repeat(b, n)
    a = a + MOST * (np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n))
    return a, np.minimum(b, a + MOST)


def _runs(flags: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [a, b) of set flags, none across a place in ``apart``."""
    edge = np.zeros(len(flags) + 1, bool)
    edge[apart[apart < len(flags)]] = True
    before = np.r_[False, flags[:-1]]
    after = np.r_[flags[1:], False]
    return np.flatnonzero(flags & (~before | edge[:-1])), np.flatnonzero(flags & (~after | edge[1:])) + 1


def _block_keys(digests: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One long for a block and a document."""
    pair = digests.view(np.uint64)
    return T.mix(T.mix(pair[:, 0] + doc.view(np.uint64)) ^ pair[:, 1]).view(np.int64)


def _first_rows(part: pa.RecordBatch) -> pa.RecordBatch:
    """(h, g, doc): g is null for an anchor; a block has 128 bits."""
    words, doc = Words(part.column("text")), part.column("doc_id").to_numpy()
    spans = words.spans()
    at, h = _anchors(words, spans, words.place)
    a, b = _blocks(words, spans)
    digests = words.digests(a, b + WINDOW - 1)
    g = pa.concat_arrays([pa.nulls(len(at), pa.int64()), pa.array(digests[:, 1])])
    return pa.RecordBatch.from_arrays([pa.array(np.r_[h.view(np.int64), digests[:, 0]]), g, pa.array(doc[words.doc[np.r_[at, a]]])], ["h", "g", "doc"])


def _settled(words: Words, doc: np.ndarray, shared, firsts) -> tuple[np.ndarray, np.ndarray]:
    """Window starts around shared anchors: of blocks that a smaller document holds, and the others."""
    spans = words.spans()
    at, h = _anchors(words, spans, words.place)
    candidate = _candidates(words, at[in_bitmap(shared, h)])
    a, b = _blocks(words, spans)
    seen = np.r_[0, np.cumsum(candidate)]
    some = seen[b] > seen[a]
    a, b = a[some], b[some]
    later = ~in_bitmap(firsts, _block_keys(words.digests(a, b + WINDOW - 1), doc[words.doc[a]]))
    steps = np.zeros(len(candidate) + 1, np.int64)
    np.add.at(steps, a[later], 1)
    np.add.at(steps, b[later], -1)
    settled = np.cumsum(steps[:-1]) > 0
    return settled, candidate & ~settled


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.xxhash64("text").alias("key"))
    known = rows.where("doc_id is not null")

    every = known.mapInArrow(T.mapper(_first_rows), "h long, g long, doc long").groupBy("h", "g").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    every = cut(every.where("g is not null or first < last").select("h", "g", "first"))
    shared = bitmap(every.where("g is null"), "h")

    def keyed(batches):
        for x in batches:
            yield pa.RecordBatch.from_pydict({"key": _block_keys(np.column_stack([x.column(0).to_numpy(), x.column(1).to_numpy()]), x.column(2).to_numpy())})

    firsts = bitmap(cut(every.where("g is not null").mapInArrow(keyed, "key long")), "key")

    def pieces(part: pa.RecordBatch) -> pa.RecordBatch:
        words, doc = Words(part.column("text")), part.column("doc_id").to_numpy()
        a, b = _runs(_settled(words, doc, shared, firsts)[1], words.first)
        of = words.doc[a]
        text = [words.bytes(i, j + WINDOW - 1) for i, j in zip(a.tolist(), b.tolist())]
        return pa.RecordBatch.from_arrays([pa.array(doc[of]), part.column("key").take(pa.array(of)), pa.array(words.place[a]), pa.array(text, pa.binary()).cast(pa.string())], ["doc_id", "key", "at", "text"])

    left = cut(known.mapInArrow(T.mapper(pieces), "doc_id long, key long, at long, text string"))

    def placed(part: pa.RecordBatch):
        words = Words(part.column("text"))
        place = words.place + part.column("at").to_numpy()[words.doc]
        return words, place, *_anchors(words, words.spans(), place)

    def anchors(part: pa.RecordBatch) -> pa.RecordBatch:
        words, _, at, h = placed(part)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("doc_id").take(pa.array(words.doc[at]))], ["h", "doc"])

    again = left.mapInArrow(T.mapper(anchors), "h long, doc long").groupBy("h").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    still = bitmap(cut(again.where("first < last").select("h")), "h")

    def windows(part: pa.RecordBatch, repeated=None) -> pa.RecordBatch:
        words, place, at, h = placed(part)
        a = np.flatnonzero(_candidates(words, at[in_bitmap(still, h)]))
        digests = words.digests(a, a + WINDOW)
        if repeated is not None:
            held = in_bitmap(repeated, digests[:, 0])
            a, digests = a[held], digests[held]
        of = pa.array(words.doc[a])
        return pa.RecordBatch.from_arrays([pa.array(digests[:, 0]), pa.array(digests[:, 1]), part.column("doc_id").take(of), part.column("key").take(of), pa.array(place[a])], ["h", "g", "doc_id", "key", "at"])

    kinds = "h long, g long, doc_id long, key long, at long"
    compared = left.mapInArrow(T.mapper(windows), kinds)
    # Written first, so that the join by window is one that Spark can split; a window may be in a third of all documents.
    smallest = cut(compared.groupBy("h", "g").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("h", "g", "first"))
    repeated = bitmap(smallest, "h")
    compared = left.mapInArrow(T.mapper(lambda part: windows(part, repeated)), kinds)
    found = compared.join(smallest, ["h", "g"]).where("doc_id > first").groupBy("doc_id", "key").agg(F.collect_set("at").alias("starts"))
    found = cut(found).withColumnsRenamed({"doc_id": "of", "key": "of_key"})

    def removed(part: pa.RecordBatch) -> pa.RecordBatch:
        words, ids = Words(part.column("text")), part.column("doc_id")
        settled, _ = _settled(words, ids.fill_null(0).to_numpy(), shared, firsts)
        starts = part.column("starts")
        sizes = np.diff(np.asarray(starts.offsets))
        flat = starts.values.slice(starts.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
        settled[flat + np.repeat(words.first, sizes)] = True
        settled[ids.is_null().to_numpy(zero_copy_only=False)[words.doc]] = False
        seen = np.r_[np.zeros(WINDOW, np.int64), np.cumsum(settled)]
        gone = seen[WINDOW:] > seen[:-WINDOW]  # no window starts within the last 49 words, so none reaches the next document
        a, b = _runs(~gone, words.first)
        bounds = np.searchsorted(a, np.r_[words.first, len(gone)]).tolist()
        a, b = a.tolist(), b.tolist()
        digest = [hashlib.sha256(b" ".join(words.bytes(a[i], b[i]) for i in range(x, y))).hexdigest() for x, y in zip(bounds, bounds[1:])]
        n_removed = np.bincount(words.doc[gone], minlength=len(ids))
        return pa.RecordBatch.from_arrays([ids, pa.array(words.counts), pa.array(n_removed), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = rows.join(found, (F.col("doc_id") == F.col("of")) & (F.col("key") == F.col("of_key")), "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(T.mapper(removed), "doc_id long, n_words long, n_removed long, kept_sha256 string")
