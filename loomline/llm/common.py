"""Tables, shared folders and lineage cuts for the operators of this subpackage."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends, lost executors don't matter."""
    path = f"{scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as it takes not to clash with a column, letter case aside."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def bounded_sample(df: DataFrame, key: str, bound: int) -> DataFrame:
    """All rows if there are at most ``bound``, else about ``bound`` of them, chosen by a hash of ``key``."""
    n = df.count()
    if n <= bound:
        return df
    share = int(bound / n * (1 << 30))
    return df.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < share)


def text_keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit hash of each text, null as empty, as two longs."""
    digests = b"".join(xxhash.xxh3_128_digest((v.as_py() or "").encode()) for v in column)
    pair = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return pair[:, 0], pair[:, 1]


#: The most bits of a bitmap: 16 MB. More values than fit only make it let more through.
BITMAP_BITS = 27


def bitmap(values: DataFrame, column: str):
    """A broadcast bitmap of the top bits of a long column; at most 2**BITMAP_BITS bits."""
    bits = min(BITMAP_BITS, max(16, (16 * values.count()).bit_length()))
    place = F.shiftrightunsigned(F.col(column), 64 - bits)
    words = values.select(F.shiftrightunsigned(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - bits}) & 63 as int))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["word"].to_numpy()] = words["bit"].to_numpy()
    return values.sparkSession.sparkContext.broadcast((bits, out.view(np.uint64)))


def in_bitmap(shared, values: np.ndarray) -> np.ndarray:
    bits, words = shared.value
    place = values.view(np.uint64) >> np.uint64(64 - bits)
    return (words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
