"""Mixing sources to target weights by entropy balancing.

Each source gets a token target: its weight's part of ``SHARE`` of all tokens,
but at most ``MAX_COPIES`` times its own, the excess reshared by weight. Rates
minimise the binary relative entropy to the base rate SHARE among all rates in
(0, MAX_COPIES) that meet the targets; the optimum tilts the odds of a
document's rate exponentially, ``exp(lambda * size / mean size)``, with one
multiplier a source. The convex dual is separable in these, and a guarded
Newton iteration solves it: each step is one aggregation over a histogram of
(source, size), and the multipliers stay in a table, so sources may be many.

Rates are rounded to whole copies, so texts are never cut. The documents of one
source and size have one rate; they get the whole part of it each, and those
with the lowest hashes a copy more. How many do is settled on the table of
(source, size), from the longest size down: what a size is off its rates is
carried on to shorter ones (``_carried``). So a source is off its target by a
short document or less, unless it has little besides a few long ones, and
reruns agree. Rows alike in doc_id, source and text are rounded together.

Null texts have size 0 and nothing is taken of them. A null source is a source
of its own, ranked last. Repeated rows count each. Extra columns are ignored
by :func:`mixed` and kept by :func:`mixture`, but for its own two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, fresh

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_COPIES = 2
#: Relative error of a target at which Newton's iteration ends, and its most steps.
TOLERANCE, STEPS = 1e-9, 60
#: Longest step of a multiplier, against overshooting where the dual is flat.
LONGEST_STEP = 8.0
#: Bits of the hash that picks documents for a copy more, and documents of one size ranked at once for it.
PICK_BITS, PICKED = 62, 512


def _size_and_key():
    size = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    return size, F.coalesce(F.concat(F.lit("="), "source"), F.lit("~"))


def _pick():
    return F.shiftrightunsigned(F.xxhash64(F.lit("mix"), F.col("doc_id").cast("long"), "text"), 64 - PICK_BITS)


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, key, size, pick) with size in words; ``key`` names the source, null included, ``pick`` is a hash of the row."""
    size, key = _size_and_key()
    return docs.select(F.col("doc_id").cast("long"), key.alias("key"), size.alias("size"), _pick().alias("pick"))


def targets(by_source: DataFrame) -> DataFrame:
    """Adds ``target`` to (key, source_size): one row a source, so the ranking windows hold sources only.

    A source is capped if its part at the final level would pass its cap;
    sources reach their caps in the order of size over weight.
    """
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(W.orderBy("key")) - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    cap = F.lit(float(MAX_COPIES)) * F.col("source_size")
    ranked = by_source.withColumn("weight", weight.cast("double")).withColumn("cap", cap)
    order = W.orderBy(F.col("cap") / F.col("weight"), "key")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.lit(SHARE) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    levels = ranked.withColumn("level", left / F.sum("weight").over(after))
    level = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return levels.withColumn("final", level).select("key", "source_size", F.least(F.coalesce(F.col("final") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def _rate(tilt):
    base = SHARE / (MAX_COPIES - SHARE)
    return F.lit(float(MAX_COPIES)) / (F.lit(1.0) + F.exp(-tilt) / F.lit(base))


def multipliers(histogram: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, lam) solving the dual; ``histogram`` has (key, size, n), ``goals`` (key, source_size, target, mean)."""
    # Sources at their cap take every document MAX_COPIES times and need no multiplier.
    state = cut(goals.where((F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * MAX_COPIES * (1 - 1e-12))).select("key", "target", "mean", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(False).alias("done")))
    for _ in range(STEPS):
        z = F.col("size") / F.col("mean")
        r = _rate(F.col("lam") * z)
        sums = histogram.join(state.where(~F.col("done")).select("key", "mean", "lam"), "key").groupBy("key").agg(F.sum(F.col("n") * F.col("size") * r).alias("got"), F.sum(F.col("n") * F.col("size") * z * r * (1 - r / MAX_COPIES)).alias("slope"))
        miss = F.col("got") - F.col("target")
        state = state.join(sums, "key", "left")
        state = state.withColumn("low", F.when(miss < 0, F.col("lam")).otherwise(F.col("low"))).withColumn("high", F.when(miss > 0, F.col("lam")).otherwise(F.col("high")))
        step = F.least(F.greatest(-miss / F.greatest("slope", F.lit(1e-300)), F.lit(-LONGEST_STEP) * (1 + F.abs("lam"))), F.lit(LONGEST_STEP) * (1 + F.abs("lam")))
        newton = F.col("lam") + step
        guarded = F.when((newton > F.col("low")) & (newton < F.col("high")) | F.col("low").isNull() & ((newton < F.col("high")) | F.col("high").isNull()) | F.col("high").isNull() & (newton > F.col("low")), newton).otherwise((F.col("low") + F.col("high")) / 2)
        ended = F.coalesce(F.abs(miss) <= TOLERANCE * F.col("target"), F.lit(True))
        state = cut(state.select("key", "target", "mean", F.when(ended, F.col("lam")).otherwise(guarded).alias("lam"), "low", "high", ended.alias("done")))
        if state.where(~F.col("done")).isEmpty():
            break
    return state.select("key", "lam")


def solved(histogram: DataFrame) -> DataFrame:
    """(key, source_size, target, mean, lam) of each source, from (key, size, n)."""
    goals = cut(targets(histogram.groupBy("key").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))))
    means = histogram.where("size > 0").groupBy("key").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"))
    goals = cut(goals.join(means, "key", "left"))
    return cut(goals.join(multipliers(histogram, goals), "key", "left"))


def _carried(batches):
    """Of each (key, size), sorted by key and falling size, how many copies its documents get together.

    What a size is off goes to the next one, up to a copy of that; the rest, left by much
    longer documents, is spread over all shorter ones by the ``room`` they have upwards or
    the words (``floor``) they have downwards, itself included. A copy goes up or down
    rather than leave more than those can make good.
    """
    last, off, far = None, 0.0, 0.0
    for part in batches:
        got = []
        for key, size, n, rate, room, floor in zip(*(part.column(c).to_pylist() for c in ("key", "size", "n", "rate", "room", "floor"))):
            if key != last:
                last, off, far = key, 0.0, 0.0
            near = min(max(off, -size), size)
            far += off - near
            shift = max(min(far / room, 1.0), 0.0) * (MAX_COPIES - rate) + min(max(far / floor, -1.0), 0.0) * rate if room > 0 and floor > 0 else 0.0
            far -= n * size * shift
            words = n * size * (rate + shift) + near
            least, most = np.floor(rate + shift + 1e-9), np.ceil(rate + shift - 1e-9)
            copies = min(max(np.floor(words / size + 0.5), n * least), n * most)
            up, down = room - n * size * (MAX_COPIES - rate), floor - n * size * rate

            def beyond(m):  # words that the shorter ones can't make good
                left = words + far - m * size
                return round(max(left - up, -down - left, 0.0), 3), abs(m - copies)

            got.append(int(min((m for m in (copies - 1, copies, copies + 1) if n * least <= m <= n * most), key=beyond)))
            off = words - got[-1] * size
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.int64())], names=[*part.schema.names, "got"])


def rounded(measured: DataFrame) -> DataFrame:
    """(key, size, source_size, target, rate, whole, below): a document of that source and size gets ``whole`` copies, and one more if its ``pick`` is under ``below``."""
    histogram = cut(measured.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")))
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("lam").isNull(), float(MAX_COPIES)).otherwise(_rate(F.col("lam") * F.col("size") / F.col("mean")))
    rated = histogram.join(solved(histogram), "key").withColumn("rate", rate).select("key", "size", "n", "source_size", "target", "rate")
    # A source of w words has at most sqrt(2 w) sizes, so one task can go through them.
    shorter = W.partitionBy("key").orderBy("size")
    room, floor = F.sum(F.col("n") * F.col("size") * (MAX_COPIES - F.col("rate"))), F.sum(F.col("n") * F.col("size") * F.col("rate"))
    worded = rated.where("size > 0").withColumn("room", room.over(shorter)).withColumn("floor", floor.over(shorter))
    worded = worded.repartition("key").sortWithinPartitions("key", F.desc("size"))
    worded = worded.mapInArrow(_carried, worded.withColumn("got", F.lit(0).cast("long")).schema)
    worded = cut(worded.withColumn("whole", F.expr("got div n")).withColumn("more", F.expr("got % n")))
    # The pick of the last document that gets more: first its bucket of hashes, then its rank within that.
    bits = F.least(F.greatest(F.ceil(F.log2(F.col("n") / F.lit(float(PICKED)))), F.lit(0)), F.lit(PICK_BITS)).cast("int")
    some = worded.where("more > 0").select("key", "size", "more", bits.alias("bits"))
    placed = cut(measured.join(some, ["key", "size"]).withColumn("bucket", F.expr(f"shiftright(pick, {PICK_BITS} - bits)")).select("key", "size", "more", "bucket", "pick"))
    up_to = F.sum("rows").over(W.partitionBy("key", "size").orderBy("bucket"))
    buckets = placed.groupBy("key", "size", "more", "bucket").agg(F.count(F.lit(1)).alias("rows")).withColumn("up_to", up_to)
    buckets = buckets.where("up_to >= more and up_to - rows < more").select("key", "size", "bucket", (F.col("more") - F.col("up_to") + F.col("rows")).alias("rank"))
    ranked = placed.drop("more").join(buckets, ["key", "size", "bucket"]).withColumn("at", F.row_number().over(W.partitionBy("key", "size").orderBy("pick")))
    last = ranked.where(F.col("at") == F.col("rank")).select("key", "size", (F.col("pick") + 1).alias("last"))
    out = worded.join(last, ["key", "size"], "left").withColumn("below", F.coalesce("last", F.lit(0).cast("long")))
    names = ["key", "size", "source_size", "target", "rate", "whole", "below"]
    wordless = rated.where("size = 0").withColumns({"whole": F.lit(0).cast("long"), "below": F.lit(0).cast("long")})
    return cut(out.select(*names).unionByName(wordless.select(*names)))


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, rate, copies, partial_words, taken) for each document; no copy is partial."""
    measured = cut(sizes(docs))
    out = measured.join(rounded(measured), ["key", "size"])
    copies = F.col("whole") + (F.col("pick") < F.col("below")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", "rate", copies.alias("copies"), F.lit(0).cast("long").alias("partial_words"), (copies * F.col("size")).alias("taken"))


def mixture(docs: DataFrame) -> DataFrame:
    """The mix itself: a row for each copy of a document, whole, with ``copy`` and ``copy_words``.

    A table of (source, size) that fits Spark's broadcast limit is joined without moving texts.
    """
    docs = docs.drop("copy", "copy_words")
    k, n, p, whole, below = fresh(docs, "_key", "_size", "_pick", "_whole", "_below")
    plan = rounded(cut(sizes(docs))).where("whole > 0 or below > 0").select(F.col("key").alias(k), F.col("size").alias(n), F.col("whole").alias(whole), F.col("below").alias(below))
    size, key = _size_and_key()
    rated = docs.withColumn(p, _pick()).withColumn(n, size).withColumn(k, key).join(plan, [k, n])
    names = [F.col(f"`{c}`") for c in docs.schema.names]
    times = F.col(whole) + (F.col(p) < F.col(below)).cast("long")
    copies = rated.withColumn(whole, times).where(F.col(whole) > 0)
    return copies.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col(whole))).alias("copy"), F.col(n).alias("copy_words"))
