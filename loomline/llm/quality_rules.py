"""Quality rules and an n-gram log-likelihood ratio between trusted and raw text.

Base rules look at one document. The method hashes word unigrams and bigrams
into ``2**BUCKET_BITS`` buckets, counts them over every document (the raw
multinomial) and over trusted documents (the target multinomial, smoothed
towards the raw one), and thresholds the mean log ratio per n-gram of every
document. One in ``HELD_OUT`` trusted documents is not counted: the threshold
is ``MARGIN`` below the ``QUANTILE`` of these. So it fits a small corpus, in
which all text that was not counted looks unlike the target, as well as a
large one.

Null texts count as empty: no words, so ``base_failed``. Repeated rows are
judged one by one. With no trusted text every ratio is 0 and only the base
rules decide. Extra columns are ignored by :func:`quality_report` and kept by
:func:`quality_filter`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bitmap, cut, in_bitmap

BUCKET_BITS = 16
HELD_OUT, QUANTILE, MARGIN = 5, 0.005, 0.05
#: Bins of a mean log ratio of 1, from which its quantile is found.
BINS = 1 << 12
MIN_WORDS = 10
#: Percent of words in repeated windows above which the base rule fails.
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True

REPORT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, llr double, base_failed boolean, kept boolean"


def _features(data: np.ndarray, offsets: np.ndarray):
    """Bucket and document of each unigram and bigram, and the word spans and hashes."""
    start, end, doc = T.words(data, offsets)
    spans = T.Spans(data)
    h = spans.hash(start, end)
    two = T.grams(h, 2)
    inside = doc[1:] == doc[:-1]
    shift = np.uint64(64 - BUCKET_BITS)
    bucket = np.concatenate([T.mix(h), two[inside]]) >> shift
    return bucket.astype(np.int64), np.concatenate([doc, doc[1:][inside]]), doc, h, spans


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, spans: T.Spans) -> np.ndarray:
    n_docs = len(offsets) - 1
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    start, stop = cuts[:-1], cuts[1:]
    if not len(start):
        return np.zeros(n_docs, np.int64)
    filled = np.add.reduceat((~T.IS_SPACE[data]).astype(np.int64), start) > 0
    stop = stop - (data[stop - 1] == 10)
    start, stop = start[filled], stop[filled]
    doc = np.searchsorted(offsets, start, side="right") - 1
    key = spans.hash(start, stop) * np.uint64(31) + T.mix(doc)
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n_docs) - np.bincount(doc[first], minlength=n_docs)


def _repeated_words(h: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Words inside a window of five words that its document has twice or more."""
    if len(h) < WINDOW:
        return np.zeros(n_docs, np.int64)
    window = T.grams(h, WINDOW)
    at = np.flatnonzero(doc[: len(window)] == doc[WINDOW - 1 :])
    _, which, times = np.unique(window[at] + T.mix(doc[at]), return_inverse=True, return_counts=True)
    twice = at[times[which] > 1]
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, twice, 1)
    np.add.at(change, twice + WINDOW, -1)
    return np.bincount(doc[np.cumsum(change[:-1]) > 0], minlength=n_docs)


@dataclass
class Ratio:
    """The log ratio of each bucket, and the mean below which a document is rejected."""

    weights: np.ndarray
    threshold: float = -MARGIN


def measure(column: pa.Array, ratio: Ratio) -> dict[str, np.ndarray]:
    """All measures of the documents of one text column."""
    data, offsets = T.utf8(column)
    n = len(offsets) - 1
    bucket, of, doc, h, spans = _features(data, offsets)
    n_words = np.bincount(doc, minlength=n)
    llr = np.bincount(of, ratio.weights[bucket], minlength=n) / np.maximum(np.bincount(of, minlength=n), 1)
    repeat = _repeated_words(h, doc, n)
    failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    return {
        "n_words": n_words,
        "word_chars": T.per_doc(~T.IS_SPACE[data] & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": T.per_doc(_SYMBOL[data], offsets),
        "n_dup_lines": _duplicate_lines(data, offsets, spans),
        "n_repeat_words": repeat,
        "llr": llr,
        "base_failed": failed,
        "kept": ~failed & (llr >= ratio.threshold),
    }


def _quantile(values: DataFrame, share: float) -> float | None:
    """The exact quantile of a column llr, interpolated; the driver gets counts of bins and the distinct values of one or two bins."""
    values = cut(values)
    bins = F.floor(F.col("llr") * BINS)
    rows = values.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n")).orderBy("bin").toArrow()
    upto = np.cumsum(rows["n"].to_numpy())
    if not len(upto):
        return None
    place = (upto[-1] - 1) * share
    first, second = int(place), min(int(place) + 1, int(upto[-1]) - 1)
    low, high = np.searchsorted(upto, [first, second], side="right")
    near = values.where(bins.between(rows["bin"][int(low)].as_py(), rows["bin"][int(high)].as_py()))
    near = near.groupBy("llr").agg(F.count(F.lit(1)).alias("n")).orderBy("llr").toArrow()
    before = int(upto[low - 1]) if low else 0
    at = np.searchsorted(np.cumsum(near["n"].to_numpy()) + before, [first, second], side="right")
    a, b = near["llr"].to_numpy()[at]
    return float(a + (b - a) * (place - first))


def _of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """doc_id and text of the documents with such ids, and the columns of these; a bitmap keeps most others from being moved."""
    shared = bitmap(ids.select(F.xxhash64(F.col("doc_id").cast("long")).alias("_key")), "_key")

    def likely(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(shared, batch.column("_key").to_numpy())))

    keyed = docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("long")).alias("_key"))
    return keyed.mapInArrow(likely, keyed.schema).drop("_key").join(ids.hint("merge"), "doc_id")  # a broadcast would grow with the labels


def fitted_ratio(docs: DataFrame, trusted_ids: DataFrame) -> Ratio:
    """Log ratio of every bucket, from all documents and all trusted ones, and the threshold.

    ``trusted_ids`` has doc_id. Counts are summed within a task, so a
    task sends at most one row for each bucket.
    """
    ids = trusted_ids.select("doc_id").where("doc_id is not null").distinct()
    ids = cut(ids.withColumn("counted", F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(HELD_OUT)) > 0))
    trusted = cut(_of(docs, ids))
    size = 1 << BUCKET_BITS

    def count(batches):
        n = np.zeros(size, np.int64)
        for part in T.chunks(batches):
            n += np.bincount(_features(*T.utf8(part.column("text")))[0], minlength=size)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"bucket": at, "n": n[at]})

    def counts(texts: DataFrame) -> np.ndarray:
        rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
        out = np.zeros(size)
        out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        return out

    target = counts(trusted.where("counted"))
    if not target.sum():
        return Ratio(np.zeros(size))
    raw = counts(docs)
    p_raw = (raw + 1) / (raw.sum() + size)
    p_target = (target + size * p_raw) / (target.sum() + size)
    ratio = Ratio(np.log(p_target) - np.log(p_raw))
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def means(part: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(part.column("text"), shared.value)
        return pa.RecordBatch.from_pydict({"llr": found["llr"][~found["base_failed"]]})

    threshold = _quantile(trusted.where("not counted").select("text").mapInArrow(T.mapper(means), "llr double"), QUANTILE)
    if threshold is not None:
        ratio.threshold = threshold - MARGIN
    return ratio


def quality_report(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """One row of measures and the verdict for each document."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), **{k: pa.array(v) for k, v in measure(part.column("text"), shared.value).items()}})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.mapper(judge), REPORT)


def quality_filter(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(measure(part.column("text"), shared.value)["kept"]))

    return docs.mapInArrow(T.mapper(keep), docs.schema)
