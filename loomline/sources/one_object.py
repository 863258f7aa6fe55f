"""One giant JSON object of windows by id, read in splits.

Spark's text reader cuts records at every ``}``, a byte that is never part of
another character, so a file of any length is read in byte ranges. A range can't
know whether it begins inside a string, nor how deep, but it begins after a ``}``,
so no escape is open. The first pass says of each range, for both cases, how it
ends: inside a string or not, how much deeper, and at which relative depths it has
commas. A scan over these few summaries gives each range its true beginning; the
second pass then cuts the entries. Only an entry that crosses ranges is put
together by a shuffle.

An id that occurs twice gives two rows. An object without entries gives none; a file
that is not one whole object is an error, and so is an entry that isn't JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

_QUOTE, _ESCAPE, _COMMA = 34, 92, 44
_STEP = np.zeros(256, np.int8)
_STEP[[ord("{"), ord("[")]] = 1
_STEP[[ord("}"), ord("]")]] = -1
SUMMARY = "file string, start long, bytes long, inside_0 boolean, depth_0 long, commas_0 array<long>, inside_1 boolean, depth_1 long, commas_1 array<long>"
PIECE = "file string, start long, owner long, entry string"


def structure(data: np.ndarray, inside: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """Depth after each byte, from 0 on, and whether it is outside strings; whether the end is inside one."""
    quotes = np.flatnonzero(data == _QUOTE)
    plain = np.where(data != _ESCAPE, np.arange(len(data)), -1)
    last = np.r_[-1, np.maximum.accumulate(plain)]  # of each byte the last one before that is no backslash
    real = quotes[(quotes - 1 - last[quotes]) % 2 == 0]
    turns = np.zeros(len(data), np.int64)
    turns[real] = 1
    outside = (np.cumsum(turns) + inside) % 2 == 0
    return np.cumsum(np.where(outside, _STEP[data], 0), dtype=np.int64), outside, bool((len(real) + inside) % 2)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, np.ndarray]]:
    """(file, start of the range, bytes) in order; a range may come in several parts."""
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, value = batch.column("file"), batch.column("start").to_numpy(), batch.column("value")
        names = file.dictionary_encode().indices.to_numpy()
        new = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (names[1:] != names[:-1])])
        for a, b in zip(new.tolist(), [*new[1:].tolist(), batch.num_rows]):
            text = b"}".join(v.as_py().encode() for v in value.slice(a, b - a)) + b"}"
            yield file[a].as_py(), int(start[a]), np.frombuffer(text, np.uint8)


def _summaries(batches):
    """How a range ends, for a beginning outside and inside a string."""
    found: dict[tuple[str, int], list] = {}
    for file, start, data in _ranges(batches):
        state = found.setdefault((file, start), [0, [False, 0, set()], [True, 0, set()]])
        state[0] += len(data)
        for case in state[1:]:
            depth, outside, case[0] = structure(data, case[0])
            case[2] |= set((depth[outside & (data == _COMMA)] + case[1]).tolist())
            case[1] += int(depth[-1])
    rows = [(file, start, n, *(x for inside, depth, commas in cases for x in (inside, depth, sorted(commas)))) for (file, start), (n, *cases) in found.items()]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c[0], list) else pa.array(c, pa.list_(pa.int64())) for c in zip(*rows)], [f.split()[0] for f in SUMMARY.split(", ")])


def beginnings(summaries: list) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """Of each range whether it begins inside a string, its depth, and the range in which the entry open there began."""
    out = {}
    for file in sorted({s.file for s in summaries}):
        inside, depth, owner = False, 0, -1
        for s in sorted((s for s in summaries if s.file == file), key=lambda s: s.start):
            out[file, s.start] = inside, depth, owner
            ends, deeper, commas = (s.inside_1, s.depth_1, s.commas_1) if inside else (s.inside_0, s.depth_0, s.commas_0)
            if depth == 0 or 1 - depth in commas:  # the object opens here, or one entry ends and another begins
                owner = s.start
            inside, depth = ends, depth + deeper
        if inside or depth not in (0, -1):  # -1: the reader gives no sign of a last record without its brace
            raise ValueError(f"not one whole JSON object: {file}")
    return out


def _pieces(known):
    """Entries of a range; owner is null for whole ones, else the range where an entry that crosses ranges began, of which this is a part."""

    def run(batches):
        begins = known.value
        now, inside, depth, owner, held, first = None, False, 0, None, b"", True
        rows: list[tuple] = []

        def close():
            """The end of a range is a part of the entry that is open there."""
            if held:
                rows.append((*now, owner if first else now[1], held.decode()))

        for file, start, data in _ranges(batches):
            if (file, start) != now:
                close()
                now, held, first = (file, start), b"", True
                inside, depth, owner = begins[now]  # the two passes read the same ranges
            steps, outside, inside = structure(data, inside)
            level = steps + depth
            opens = np.flatnonzero(outside & (data == ord("{")) & (level == 1) & (np.r_[depth, level[:-1]] == 0))
            commas = np.flatnonzero(outside & (data == _COMMA) & (level == 1))
            ends = np.flatnonzero(outside & (data == ord("}")) & (level == 0))
            raw, at = data.tobytes(), 0
            for i in np.sort(np.r_[opens, commas, ends]).tolist():
                text = held + raw[at:i]
                if raw[i] != ord("{"):
                    if first and owner >= 0:
                        rows.append((*now, owner, text.decode()))
                    elif text.strip():
                        rows.append((*now, None, text.decode()))
                first, held, at = False, b"", i + 1
            held = (held + raw[at:]) if level[-1] > 0 else b""
            depth = int(level[-1])
            if rows:
                yield _batch(rows)
                rows.clear()
        close()
        if rows:
            yield _batch(rows)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in PIECE.split(", ")])


def entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, entry): the text ``"id": {...}`` of every entry of the objects in ``paths``."""
    text = spark.read.option("lineSep", "}").text(paths).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    summaries = text.mapInArrow(_summaries, SUMMARY).collect()  # a row for each range of some 128 MB
    known = spark.sparkContext.broadcast(beginnings(summaries))
    pieces = written(text.mapInArrow(_pieces(known), PIECE))
    parts = F.transform(F.sort_array(F.collect_list(F.struct("start", "entry"))), lambda p: p["entry"])
    crossing = pieces.where("owner is not null").groupBy("file", "owner").agg(F.array_join(parts, "").alias("entry"))
    return pieces.where("owner is null").select("file", "entry").unionByName(crossing.select("file", "entry")).where("trim(entry) <> ''")


def windows_object(spark: SparkSession, paths: list[str], window: str) -> DataFrame:
    """(wid, *window) of files that each hold one object of windows by id; ``window`` is the DDL of a window's fields."""
    parsed = F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), f"map<string,struct<{window}>>", {"mode": "FAILFAST"})
    return entries(spark, paths).select(F.explode(parsed).alias("wid", "w")).select("wid", "w.*")


def range_bytes(spark: SparkSession, path: str, least: int, a_core: int) -> int:
    """Bytes of a range so that what is in ``path`` has at most ``a_core`` ranges a core, but not under ``least`` nor over 128 MB."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return min(max(least, whole // (a_core * spark.sparkContext.defaultParallelism)), 128 << 20)


def write_object(windows: DataFrame, path: str, key: str = "wid", together: str | None = None, files: int = 1) -> None:
    """Windows as one object a file, as many files as there are partitions; empty partitions write none.

    With ``together`` those of equal values of that column, which is not written, go to one of ``files``, as finished texts.
    """
    columns = [c for c in windows.columns if c not in (key, together)]
    entry = F.concat(F.to_json(F.array(key)).substr(F.lit(2), F.length(F.to_json(F.array(key))) - 2), F.lit(": "), F.to_json(F.struct(*columns)))

    def run(batches):
        """Each text is written with what stands before it; the last brace stands alone."""
        some = False
        for batch in batches:
            for value in batch.column(0):
                yield pa.RecordBatch.from_pydict({"value": [("," if some else "{") + value.as_py()]})
                some = True
        if some:
            yield pa.RecordBatch.from_pydict({"value": ["}"]})

    texts = windows.select(entry.alias("entry"), *([together] if together else []))
    texts = texts.repartition(files, together).select("entry") if together else texts
    texts.mapInArrow(run, "value string").write.text(path)
