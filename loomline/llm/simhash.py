"""SimHash fingerprints and near-duplicate components by covering hashing.

A fingerprint bit is 1 if it is set in over half of the XXH64 values of the
text's word shingles. Bit i of a fingerprint gets a nonzero vector of
``radius + 1`` bits; mask v keeps the bits whose vector has an odd inner
product with v. Any ``radius`` differing bits span too small a space to meet
every v, so some mask avoids them all: each linked pair shares a bucket of at
least one of the ``2**(radius+1) - 1`` tables, without luck.

Buckets hold distinct fingerprints only. One of more than ``BUCKET_ROWS`` is
dealt again: its free bits are cut into ``radius + 1`` blocks, of which a
linked pair shares one, and each block joins the mask. That ends, since a mask
with at most ``FREE_BITS`` free bits has at most ``2**FREE_BITS`` fingerprints.
Within a bucket a breadth-first search emits a spanning forest, never pairs.

Null and empty texts have fingerprint 0 and are linked like any other.
Repeated rows give repeated result rows. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import cut
from .components import components

BUCKET_ROWS = 4096
FREE_BITS = 14
SEED = 42
_BLOCK = 1 << 16  # hashes held at once
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ALL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_array(texts: pa.Array, shingle: int) -> np.ndarray:
    """Fingerprints of a string column."""
    one = xxhash.xxh64_intdigest
    counts, ones = np.zeros(len(texts), np.int64), np.zeros((len(texts), 64), np.int64)
    h: list[int] = []
    of: list[np.ndarray] = []

    def flush():
        if h:
            T.count_bits(np.array(h, np.uint64), np.concatenate(of), ones)
            h.clear()
            of.clear()

    for k, value in enumerate(texts):
        words = (value.as_py() or "").encode().translate(_LOWER).split()
        line = b" ".join(words)
        if len(words) <= shingle:
            counts[k] = bool(words)
            h += [one(line, SEED)] * bool(words)
            of.append(np.full(int(counts[k]), k))
            continue
        end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        start = np.r_[0, end[:-1] + 1]
        counts[k] = len(words) - shingle + 1
        for at in range(0, int(counts[k]), _BLOCK):
            to = min(at + _BLOCK, int(counts[k]))
            h += [one(line[a:b], SEED) for a, b in zip(start[at:to].tolist(), end[at + shingle - 1 : to + shingle - 1].tolist())]
            of.append(np.full(to - at, k))
            if len(h) >= _BLOCK:
                flush()
    flush()
    return T.over_half(ones, counts)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": fingerprint_array(part.column("text"), shingle).view(np.int64)})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.mapper(run), "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """The structured masks: any ``radius`` bit positions lie outside at least one."""
    n = (1 << (radius + 1)) - 1
    vector = [i % n + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() % 2) for v in range(1, n + 1)]


def _refined(mask: int, radius: int) -> list[int]:
    free = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << i for i in free[k :: radius + 1]) for k in range(radius + 1)]


def forest(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the fingerprints within ``radius`` bits of each other."""
    rest, u, v = fps.copy(), [], []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                u.append(np.full(len(found), x))
                v.append(found)
                todo.extend(found)
                rest = rest[~near]
    return (np.concatenate(u), np.concatenate(v)) if u else (fps[:0], fps[:0])


def _links_of_sorted(radius: int):
    """Links within buckets of a partition sorted by mask and key; a bucket may span batches."""

    def links(mask, key, fp):
        new = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[new, len(mask)])
        pair = new[size == 2]
        near = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= radius]
        u, v = [fp[near]], [fp[near + 1]]
        for at, n in zip(new[size > 2], size[size > 2]):
            a, b = forest(fp[at : at + n], radius)
            u.append(a)
            v.append(b)
        return pa.RecordBatch.from_pydict({"u": np.concatenate(u).view(np.int64), "v": np.concatenate(v).view(np.int64)})

    def run(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
        for batch in batches:
            got = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)]
            held = [np.concatenate(x) for x in zip(held, got)]
            mask, key, _ = held
            if not len(mask):
                continue
            last = int(np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])[-1])
            if last:
                yield links(*(x[:last] for x in held))
                held = [x[last:] for x in held]
        if len(held[0]):
            yield links(*held)

    return run


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within ``radius`` bits; ``fps`` has distinct fp."""
    spark = fps.sparkSession
    masks, out = covering_masks(radius), None
    table = fps.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        rows = table.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = cut(rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
        bounded = [m for m in masks if 64 - m.bit_count() <= FREE_BITS]
        large = (F.col("n") > BUCKET_ROWS) & ~F.col("mask").isin([_signed(m) for m in bounded])
        known = rows.join(sizes, ["mask", "key"])
        found = known.where(~large).select("mask", "key", "fp").repartition("mask", "key").sortWithinPartitions("mask", "key", "fp").mapInArrow(_links_of_sorted(radius), "u long, v long")
        out = found if out is None else out.union(found)
        if sizes.where(large).isEmpty():
            return out
        finer = [(_signed(m), _signed(x)) for m in masks if m not in bounded for x in _refined(m, radius)]
        step = F.broadcast(spark.createDataFrame(finer, "mask long, finer long"))
        table = cut(known.where(large).join(step, "mask").select("fp", F.col("finer").alias("mask")).distinct())
        masks = sorted({x & _ALL for _, x in finer})


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each document."""
    prints = cut(fingerprints(docs, shingle))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct.select("fp"), radius))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # Written first, so that the join by root is one that Spark can split.
    least = cut(placed.groupBy("root").agg(F.min("least").alias("component_id")))
    ids = placed.join(least, "root").select("fp", "component_id")
    return prints.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
