"""Codes of vectors: each of 8 parts of a vector becomes the index of its nearest codebook entry.

Components are integers, ``floor(scale * x)``, and everything decided from them
is exact. Distances to all entries come from one float32 matrix product with an
interval around each, wide enough for every rounding error of that product in
any order of summation; entries whose interval overlaps that of the best are
computed again in int64, and ties go to the lower index. Each round sums the
components and the members of every entry in the tasks and then over tasks:
what reaches the driver is one codebook, ``ENTRIES`` vectors long.

Vectors that are null, or hold a null, a NaN or an infinity, are dropped. A vector
shorter than the longest kept one, or than the next multiple of 8, counts as
followed by zeros; an empty one is all zeros. Integers from ``NARROW`` on do not
fit in float32 and int64 and go through Python's integers, as exact and slower;
``error`` and ``label_error`` stop at the largest long. The first codebook is that
of the smallest vec_ids, nulls last, equal vec_ids in the order of their vectors;
fewer than ``ENTRIES`` kept vectors give as many entries. Repeated rows are kept
and weigh as often. Labels are compared as they are, nulls together. An empty
table gives an empty table. Extra columns are ignored.

The table is read once for its longest vector, once for its first ones, and once
for each round: write it first if it is dear to compute.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Integers below this in size, with vectors of up to MOST_NARROW components, keep every squared distance within int64.
NARROW = 1 << 22
MOST_NARROW = 1 << 16
#: Rows that a task handles at once.
ROWS = 4096
#: A sum is shuffled as limbs of so many bits, the last one signed: 2**27 tasks can be summed in longs.
LIMB = 36
MOST = (1 << 63) - 1

Book = list[list[list[int]]]  # by part, entry and position


def _integers(vector: list[float], width: int) -> list[int]:
    return [(int(x) * SCALE if abs(x) >= 2.0**53 else math.floor(x * SCALE)) for x in vector] + [0] * (width - len(vector))


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, list[tuple[int, list[int]]]]:
    """Integer components of a batch, and the rows that need Python's integers: these are zero in the array."""
    column = batch.column(batch.schema.get_field_index("vector"))
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum())).to_numpy(zero_copy_only=False)
    values = np.zeros((len(sizes), width))
    values[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    wide = np.abs(values).max(axis=1, initial=0) >= NARROW // SCALE if width <= MOST_NARROW else np.ones(len(values), bool)
    large = [(int(i), _integers(values[i].tolist(), width)) for i in np.flatnonzero(wide)]
    values[wide] = 0
    return np.floor(values * SCALE).astype(np.int64), large


def screened(rows: np.ndarray, entries: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance to it for each row of narrow integers, both exact."""
    n, d = rows.shape
    narrow = np.array([all(abs(c) < NARROW for c in e) for e in entries])
    table = np.array([e if ok else [0] * d for e, ok in zip(entries, narrow)], np.int64).reshape(len(entries), d)
    dot = (rows.astype(np.float32) @ table.astype(np.float32).T).astype(np.float64)
    row_norm, norm = np.sqrt((rows * rows).sum(axis=1).astype(np.float64)), (table * table).sum(axis=1).astype(np.float64)
    # |x.c| is off by at most (d u / (1 - d u)) |x| |c| with u = 2**-24, whatever the order of its sums; d + 2 and the last terms cover the float64 steps.
    u = (d + 2) * 2.0**-24
    size = row_norm[:, None] * np.sqrt(norm)
    middle, error = norm - 2 * dot, 2 * u / (1 - u) * size * (1 + 2.0**-20) + 2.0**-48 * (norm + 2 * size)
    low, high = middle - error, middle + error
    for k in np.flatnonzero(~narrow):  # such an entry is at least so far away
        gap = max(map(abs, entries[k])) - NARROW
        low[:, k], high[:, k] = float(min(gap * gap, 10**300)) - row_norm**2 * (1 + 2.0**-48), np.inf
    open_ = low <= high.min(axis=1, keepdims=True)
    code = open_.argmax(axis=1)
    at, k = np.nonzero(open_ & (open_.sum(axis=1) > 1)[:, None])
    if len(at) and narrow[k].all():
        exact = np.full((n, len(entries)), MOST)
        exact[at, k] = ((rows[at] - table[k]) ** 2).sum(axis=1)
        several = np.unique(at)
        code[several] = exact[several].argmin(axis=1)
    else:
        for i in np.unique(at):
            code[i] = _nearest(rows[i].tolist(), entries, k[at == i].tolist())[0]
    far = ~narrow[code]
    distance = ((rows - table[code]) ** 2).sum(axis=1)
    if far.any():
        distance = distance.astype(object)
        for i in np.flatnonzero(far):
            distance[i] = _nearest(rows[i].tolist(), entries, [int(code[i])])[1]
    return code, distance


def _nearest(vector: list[int], entries: list[list[int]], among: list[int]) -> tuple[int, int]:
    distance, k = min((sum((x - c) ** 2 for x, c in zip(vector, entries[k])), k) for k in among)
    return k, distance


def _coded(batch: pa.RecordBatch, book: Book, width: int):
    """Codes (rows x parts) and distances of a batch, its integers, and the rows with large ones."""
    rows, large = _rows(batch, width)
    size = width // PARTS
    found = [screened(rows[:, p * size : (p + 1) * size], book[p]) for p in range(PARTS)]
    codes, distances = np.stack([c for c, _ in found], axis=1), reduce(np.add, [d.astype(object) if d.dtype == object else d for _, d in found])
    if large and distances.dtype != object:
        distances = distances.astype(object)
    for i, vector in large:
        best = [_nearest(vector[p * size : (p + 1) * size], book[p], range(len(book[p]))) for p in range(PARTS)]
        codes[i], distances[i] = [k for k, _ in best], sum(d for _, d in best)
    return codes, distances, rows, large


def _bounded(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _limbs(value: int, n: int) -> list[int]:
    return [(value >> LIMB * i) & ((1 << LIMB) - 1) for i in range(n - 1)] + [value >> LIMB * (n - 1)]


def _summed(shared, width: int):
    """Rows (slot, limb, members, sums) of a task; slot is part * ENTRIES + entry."""

    def run(batches):
        book, size = shared.value, width // PARTS
        sums, members = np.zeros((PARTS * ENTRIES, size), object), np.zeros(PARTS * ENTRIES, np.int64)
        for batch in _bounded(batches):
            codes, _, rows, large = _coded(batch, book, width)
            narrow = np.ones(len(rows), bool)
            narrow[[i for i, _ in large]] = False
            slots = codes + ENTRIES * np.arange(PARTS)
            members += np.bincount(slots.ravel(), minlength=PARTS * ENTRIES)
            for p in range(PARTS):
                order = np.flatnonzero(narrow)[np.argsort(codes[narrow, p], kind="stable")]
                if len(order) and size:
                    of = slots[order, p]
                    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                    sums[of[first]] += np.add.reduceat(rows[order, p * size : (p + 1) * size], first, axis=0)
            for i, vector in large:
                for p in range(PARTS):
                    sums[slots[i, p]] += np.array(vector[p * size : (p + 1) * size], object)
        used = np.flatnonzero(members)
        if not len(used):
            return
        most = max((int(v).bit_length() + 1 for v in sums[used].ravel()), default=1)
        n = max(2, -(-most // LIMB))
        out = [(int(s), limb, int(members[s]) if not limb else 0, x) for s in used for limb, x in enumerate(np.array([_limbs(int(v), n) for v in sums[s]], object).reshape(size, n).T.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["slot", "limb", "members", "sums"])

    return run


def _next_book(vectors: DataFrame, book: Book, width: int) -> Book:
    size = width // PARTS
    shared = vectors.sparkSession.sparkContext.broadcast(book)
    parts = vectors.select("vector").mapInArrow(_summed(shared, width), "slot int, limb int, members long, sums array<long>")
    sums = F.array(*[F.sum(F.col("sums")[i]) for i in range(size)]) if size else F.array().cast("array<long>")
    total: dict[int, list[int]] = {}
    members: dict[int, int] = {}
    for row in parts.groupBy("slot", "limb").agg(F.sum("members").alias("members"), sums.alias("sums")).collect():  # 128 slots
        have = total.setdefault(row.slot, [0] * size)
        total[row.slot] = [a + (b << LIMB * row.limb) for a, b in zip(have, row.sums)]
        members[row.slot] = members.get(row.slot, 0) + row.members
    shared.unpersist()
    return [[[s // members[slot] for s in total[slot]] if members.get(slot := p * ENTRIES + k) else entry for k, entry in enumerate(book[p])] for p in range(PARTS)]


def kept_vectors(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label") -> DataFrame:
    """(vec_id, label, vector) without vectors that are null or hold a null or non-finite component."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))


def fitted_codebooks(kept: DataFrame, rounds: int = ROUNDS) -> tuple[Book, int]:
    """The codebooks after all rounds, and the number of components of a vector."""
    longest = kept.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    first = [_integers(r.vector, width) for r in kept.orderBy(F.asc_nulls_last("vec_id"), "vector").select("vector").limit(ENTRIES).collect()]
    size = width // PARTS
    book = [[v[p * size : (p + 1) * size] for v in first] for p in range(PARTS)]
    for _ in range(rounds if first else 0):
        book = _next_book(kept, book, width)
    return book, width


def codes(kept: DataFrame, book: Book, width: int) -> DataFrame:
    """(vec_id, label, code, error) of each kept vector; code has two hex digits for each part."""
    shared = kept.sparkSession.sparkContext.broadcast(book)
    digits = np.array([f"{k:02x}" for k in range(ENTRIES)])

    def run(batches):
        for batch in _bounded(batches):
            if not batch.num_rows:
                continue
            found, distances, _, _ = _coded(batch, shared.value, width)
            text = ["".join(x) for x in digits[found].tolist()]
            error = [min(int(x), MOST) for x in distances] if distances.dtype == object else distances
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = dict(kept.dtypes)
    return kept.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def compressed(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept vector."""
    kept = kept_vectors(vectors)
    book, width = fitted_codebooks(kept, rounds)
    digest = hashlib.sha256(",".join(str(c) for part in book for entry in part for c in entry).encode()).hexdigest()
    coded = cut(codes(kept, book, width))
    # Written first, so that the join by label is one that Spark can split; a label may hold a third of all rows.
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    labels = cut(coded.groupBy("label").agg(total.alias("label_error"))).withColumnRenamed("label", "of")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
