"""Removal of long repeated byte strings by external induced sorting of sampled suffixes.

Every string of ``LENGTH`` bytes owns the sampled suffix that starts at the
least hash of a ``HEAD``-byte gram within it, the leftmost of equals: equal
strings own suffixes at the same distance from their start, wherever they
stand. (Sampled suffixes take the part of the LMS suffixes of induced
sorting; all others are induced from them.) A suffix and the strings that own
it form a tuple with one context, the bytes from the first string's start to
the last one's end.

1. Suffixes whose head occurs once are dropped: nothing they own repeats.
2. Equal contexts repeat as a whole and are settled by counting.
3. Different contexts with one head are sorted by suffix, and each carries the
   length of its common prefix with the one before. From the order and common
   prefixes of the suffixes that start x bytes before the sampled ones those of
   x + 1 are induced, by the byte to the left; a string repeats if its suffix
   shares LENGTH bytes with a neighbour. Spark's shuffle sort is the external
   queue of the tuples: it spills sorted runs to disk and merges them.
4. A head with more than ``GROUP_ROWS`` contexts recurses: the owned strings
   are halved by x, each half is dealt by a hash of the bytes that all its
   strings share, and so on until groups are small, or a half is one string,
   where equal hashes are the repeats. So one task never holds a large group,
   and no pairs are made.

Bitmaps of at most ``2**BITMAP_BITS`` bits (see common) carry heads and texts
that matter to the next scan; what passes one by chance is dropped by an exact
join or count.

Null texts are empty, and texts under LENGTH bytes lose nothing. Strings never
cross documents. These are told apart by a 128-bit hash of their text, since
equal texts have equal results, so repeated rows are each other's copies. Extra
columns are ignored by :func:`removals` and kept by :func:`without_repeats`.

LENGTH bytes may be more than a passage of many short words has, so
:func:`removals` also reports the words that passages shared with other
documents cover (see ``passages``); these are not removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bitmap, cut, fresh, in_bitmap, text_keys
from .passages import shared_words

LENGTH = 400
HEAD = 128
SPAN = LENGTH - HEAD  # the farthest that a string starts before its suffix
GROUP_ROWS = 2000
_MAX = np.uint64(2**64 - 1)


def _window_min(h: np.ndarray, w: int) -> np.ndarray:
    """Least value of each full window of w values, in linear time by blocks."""
    n = len(h)
    padded = np.full(-(-n // w) * w, _MAX)
    padded[:n] = h
    block = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


class Tuples:
    """The suffix tuples of the documents of one column.

    ``first`` and ``last`` are the starts of the first and last string that
    own the suffix at ``at``; ``doc`` is the document.
    """

    def __init__(self, column: pa.Array):
        self.data, self.offsets = T.utf8(column)
        self.spans = T.Spans(self.data)
        n, w = len(self.data), SPAN + 1
        empty = np.zeros(0, np.int64)
        self.first = self.last = self.at = self.doc = empty
        self.key = empty.view(np.uint64)
        size = np.diff(self.offsets)
        if not (size >= LENGTH).any():
            return
        starts = np.arange(n - HEAD + 1)
        h = self.spans.hash(starts, starts + HEAD)
        room = np.zeros(n + 1, np.int32)  # strings of LENGTH start where this sums to 1
        long = size >= LENGTH
        np.add.at(room, self.offsets[:-1][long], 1)
        np.add.at(room, self.offsets[1:][long] - LENGTH + 1, -1)
        valid = np.cumsum(room)[: n - LENGTH + 1] > 0
        least = _window_min(h, w)
        own = np.flatnonzero(valid)
        new = np.ones(len(own), bool)
        after = own[1:][own[1:] == own[:-1] + 1]
        fresh = (least[after] != least[after - 1]) | (h[after - 1] == least[after - 1])
        new[1:][own[1:] == own[:-1] + 1] = fresh
        # Documents that touch: the next one's strings start a new tuple.
        new[np.searchsorted(own, self.offsets[:-1][long])] = True
        begin = np.flatnonzero(new)
        self.first = own[begin]
        self.last = own[np.r_[begin[1:], len(own)] - 1]
        self.doc = np.searchsorted(self.offsets, self.first, side="right") - 1
        # A suffix has the least hash of some window: of those around it, the largest minimum.
        around = np.full(w - 1 + len(h), _MAX)
        around[w - 1 : w - 1 + len(least)] = ~least
        candidates = np.flatnonzero(h <= ~_window_min(around, w))
        value, entered = least[self.first], self.first + w - 1
        self.at = candidates[np.minimum(np.searchsorted(candidates, self.first), len(candidates) - 1)]
        # Where the least hash has just entered, it is the last of the window and the only one.
        follows = np.r_[False, (self.first[1:] == self.last[:-1] + 1) & (self.doc[1:] == self.doc[:-1])]
        self.at = np.where(follows & (value < least[np.maximum(self.first - 1, 0)]), entered, self.at)
        for k in np.flatnonzero((h[self.at] != value) | (self.at > entered)).tolist():  # strings across documents mislead at a start
            self.at[k] = self.first[k] + int(np.argmin(h[self.first[k] : entered[k] + 1]))
        self.key = T.mix(h[self.at] + np.uint64(1))  # least hashes are small, and bitmaps go by the top bits

    def contexts(self) -> np.ndarray:
        return self.spans.hash(self.first, self.last + LENGTH)


_CHUNK = T.CHUNK_BYTES
OCCURRENCES = "t1 long, t2 long, first long, key long, back long, strings long, context long"


def _sliced(part: pa.RecordBatch):
    """Texts with the row and the byte at which each starts. A long text comes in slices.

    Slices overlap by LENGTH - 1 bytes, so each string is in exactly one. A
    tuple may be cut in two by that; its contexts are then sorted, not counted.
    """
    column = part.column("text")
    if part.num_rows > 1 or len(T.utf8(column)[0]) <= 2 * _CHUNK:
        yield column, np.arange(part.num_rows), 0
        return
    data = T.utf8(column)[0]
    for at in range(0, len(data) - LENGTH + 1, _CHUNK):
        yield pa.array([data[at : at + _CHUNK + LENGTH - 1].tobytes()], pa.large_binary()), np.zeros(1, np.int64), at


def _heads(docs: DataFrame) -> DataFrame:
    """The head of every tuple; a task sums equal ones of a chunk."""

    def run(batches):
        for part in T.chunks(batches, limit=_CHUNK):
            for column, _, _ in _sliced(part):
                key, n = np.unique(Tuples(column).key, return_counts=True)
                yield pa.RecordBatch.from_pydict({"key": key.view(np.int64), "n": n})

    return docs.select("text").mapInArrow(run, "key long, n long")


def _occurrences(docs: DataFrame, heads, texts=None) -> DataFrame:
    """The tuples whose head passes the bitmap, with their document and where they stand in it.

    With a bitmap of ``texts`` only those that pass it are read, and the bytes of contexts come, too.
    """

    def found(part, column, row, base) -> pa.RecordBatch | None:
        tuples = Tuples(column)
        keep = np.flatnonzero(in_bitmap(heads, tuples.key))
        if not len(keep):
            return None
        doc, first, last = tuples.doc[keep], tuples.first[keep], tuples.last[keep]
        used, place = np.unique(doc, return_inverse=True)
        t1, t2 = text_keys(part.column("text").take(pa.array(row[used])))
        out = {"t1": t1[place], "t2": t2[place], "first": base + first - tuples.offsets[doc], "key": tuples.key[keep].view(np.int64), "back": tuples.at[keep] - first, "strings": last - first + 1, "context": tuples.spans.hash(first, last + LENGTH).view(np.int64)}
        if texts is not None:
            raw = tuples.data.tobytes()
            out["bytes"] = pa.array([raw[a : z + LENGTH] for a, z in zip(first.tolist(), last.tolist())], pa.binary())
        return pa.RecordBatch.from_pydict(out)

    def run(batches):
        for part in T.chunks(batches, limit=_CHUNK):
            if texts is not None:
                part = part.filter(pa.array(in_bitmap(texts, text_keys(part.column("text"))[0])))
                if not part.num_rows:
                    continue
            for column, row, base in _sliced(part):
                out = found(part, column, row, base)
                if out is not None:
                    yield out

    return docs.select("text").mapInArrow(run, OCCURRENCES + (", bytes binary" if texts is not None else ""))


_SAME = ["key", "back", "strings", "context"]
MEMBER = "t1 long, t2 long, first long, single boolean, back long, strings long, bytes binary"
FOUND = "t1 long, t2 long, start long, stop long"


class _Least:
    """Least values of ranges of one array, by a table of powers of two."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            last, half = self.rows[-1], 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Least of values[start:stop]; no range is empty."""
        level = np.frexp((stop - start).astype(np.float64))[1] - 1
        out = np.empty(len(start), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.rows[k][start[at]], self.rows[k][stop[at] - (1 << k)])
        return out


def _common_prefixes(suffixes: list[bytes], group: np.ndarray) -> np.ndarray:
    """Length of what each sorted suffix shares with the one before; -1 at the first of a group."""
    table = np.zeros((len(suffixes), LENGTH), np.uint8)
    size = np.empty(len(suffixes), np.int64)
    for k, row in enumerate(suffixes):
        row = row[:LENGTH]
        size[k] = len(row)
        table[k, : len(row)] = np.frombuffer(row, np.uint8)
    common = np.full(len(suffixes), -1, np.int64)
    if len(suffixes) > 1:
        differs = table[1:] != table[:-1]
        common[1:] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), LENGTH), np.minimum(size[1:], size[:-1]))
        common[1:][group[1:] != group[:-1]] = -1
    return common


def induced(group: np.ndarray, back: np.ndarray, strings: np.ndarray, texts: list[bytes], low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    """For each context, which of its strings stand in another context of its group, too.

    The rows come sorted by group and suffix. One step to the left turns the
    order of the suffixes that start x bytes before the sampled ones, with
    their common prefixes, into that of x + 1: rows go stably into the bucket of
    their next byte, and neighbours in a bucket share one byte more than the least
    common prefix between them. A string that starts x bytes before is repeated
    if its suffix shares LENGTH bytes with a neighbour. Rows that can't reach
    that any more leave. Only strings low to high bytes before are decided.
    """
    out = [np.zeros(n, bool) for n in strings.tolist()]
    ends = np.cumsum([len(t) for t in texts])
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sampled = ends - [len(t) for t in texts] + back
    row, common = np.arange(len(texts)), _common_prefixes([t[b:] for t, b in zip(texts, back.tolist())], group)
    most = int(high.max())
    for x in range(most + 1):
        least = np.maximum(common, np.r_[common[1:], -1])  # the most that a row shares with a neighbour
        for r in row[(least >= LENGTH) & (low[row] <= x) & (x <= high[row]) & (x <= back[row]) & (x > back[row] - strings[row])].tolist():
            out[r][back[r] - x] = True
        at = np.flatnonzero((back[row] > x) & (high[row] > x) & (least + (high[row] - x) >= LENGTH))
        if len(at) < 2:
            break
        of = group[row[at]] * 256 + flat[sampled[row[at]] - x - 1]
        order = np.argsort(of, kind="stable")
        at, of = at[order], of[order]
        # Buckets keep the order, so a neighbour in one stood farther up in the last order.
        same = np.flatnonzero(of[1:] == of[:-1])
        after = np.where(group[row[at]][1:] == group[row[at]][:-1], 0, -1)
        after[same] = _Least(common).of(at[same] + 1, at[same + 1] + 1) + 1
        row, common = row[at], np.r_[-1, after]
    return out


_GROUP = ["group", "low", "high"]


def _group_numbers(table: pa.Table) -> np.ndarray:
    """Numbers of the runs of equal groups in sorted rows."""
    columns = [table[k].to_numpy() for k in _GROUP]
    new = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.r_[0, np.cumsum(new)]


def _repeats(table: pa.Table) -> pa.Table:
    """Removed byte ranges of the contexts of some whole groups; those of settled contexts are known."""
    marks = induced(_group_numbers(table), *(table[k].to_numpy() for k in ("back", "strings")), table["bytes"].to_pylist(), table["low"].to_numpy(), table["high"].to_numpy())
    t1, t2, first, single = (table[k].to_numpy(zero_copy_only=False) if k == "single" else table[k].to_numpy() for k in ("t1", "t2", "first", "single"))
    rows = []
    for i, mark in enumerate(marks):
        if single[i] and mark.any():
            edge = np.flatnonzero(np.diff(np.r_[0, mark.astype(np.int8), 0]))
            rows += [(t1[i], t2[i], first[i] + a, first[i] + z - 1 + LENGTH) for a, z in zip(edge[::2], edge[1::2])]
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["t1", "t2", "start", "stop"])


def _induced_of_sorted(batches):
    """Groups of a partition sorted by group; a few thousand contexts at a time, groups whole."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        for part in (batch.slice(k, GROUP_ROWS) for k in range(0, batch.num_rows, GROUP_ROWS)):
            held.append(part)
            rows += part.num_rows
            if rows >= 2 * GROUP_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                number = _group_numbers(table)
                whole = int(np.searchsorted(number, number[-1]))
                if whole:
                    yield from _repeats(table.slice(0, whole)).to_batches()
                held, rows = table.slice(whole).to_batches(), table.num_rows - whole
    if rows:
        yield from _repeats(pa.Table.from_batches(held).combine_chunks()).to_batches()


def _halves(members: DataFrame) -> DataFrame:
    """Each context in the halves of its group's range of x that it has strings in, dealt by the bytes that these share."""

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for row in batch.to_pylist():
                middle = (row["low"] + row["high"]) // 2
                for low, high in ((row["low"], middle), (middle + 1, row["high"])):
                    if low <= row["back"] and high > row["back"] - row["strings"]:
                        core = row["bytes"][row["back"] - low : row["back"] - high + LENGTH]
                        mark = xxhash.xxh3_64_intdigest(core + row["group"].to_bytes(8, "little", signed=True) + low.to_bytes(2, "little") + high.to_bytes(2, "little"))
                        rows.append(row | {"group": mark - (1 << 64) if mark >> 63 else mark, "low": low, "high": high})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, batch.schema)

    return members.mapInArrow(run, members.schema)


def _settled_by_sorting(members: DataFrame) -> DataFrame:
    """Removed ranges of contexts that occur once but share a head with others."""
    found = None
    now = members.withColumn("group", F.col("key")).withColumn("low", F.lit(0).cast("long")).withColumn("high", F.lit(SPAN).cast("long")).select("group", "low", "high", *[c.split()[0] for c in MEMBER.split(", ")])
    now = cut(now)
    while True:
        sizes = cut(now.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.max("single").alias("open")).where("n > 1 and open"))
        known = now.join(sizes.drop("open"), _GROUP)
        large = F.col("n") > GROUP_ROWS
        small = known.where(~large & (F.col("low") < F.col("high"))).drop("n")
        one = known.where((F.col("low") == F.col("high")) & F.col("single"))
        at = F.col("first") + F.col("back") - F.col("low")
        suffix = F.expr("substring(bytes, cast(back + 1 as int))")
        part = small.repartition(*_GROUP).sortWithinPartitions(*_GROUP, suffix).mapInArrow(_induced_of_sorted, FOUND).union(one.select("t1", "t2", at.alias("start"), (at + LENGTH).alias("stop")))
        found = part if found is None else found.union(part)
        if sizes.where(large & (F.col("low") < F.col("high"))).isEmpty():
            return found
        now = cut(_halves(known.where(large & (F.col("low") < F.col("high"))).drop("n")))


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(t1, t2, start, stop): byte ranges to remove from the texts with hash (t1, t2); ranges may overlap."""
    heads = cut(_heads(docs).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"))
    places = cut(_occurrences(docs, bitmap(heads, "key")))
    classes = places.groupBy(*_SAME).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "first")).alias("one"))
    classes = cut(classes)
    whole = places.join(classes.where("n > 1").select(*_SAME), _SAME).select("t1", "t2", F.col("first").alias("start"), (F.col("first") + F.col("strings") - 1 + LENGTH).alias("stop")).distinct()
    open_heads = cut(classes.groupBy("key").agg(F.count(F.lit(1)).alias("contexts"), F.min("n").alias("least")).where("contexts > 1 and least = 1").select("key"))
    if open_heads.isEmpty():
        return whole
    # One occurrence stands for each context, and only the texts with such occurrences are read for their bytes.
    ones = cut(classes.join(open_heads, "key").select(*_SAME, "one.*", (F.col("n") == 1).alias("single")))
    texts = _occurrences(docs, bitmap(open_heads, "key"), bitmap(ones.select("t1").distinct(), "t1")).dropDuplicates(["t1", "t2", "first"])
    members = ones.join(texts.select("t1", "t2", "first", "bytes"), ["t1", "t2", "first"])
    return whole.union(_settled_by_sorting(members))


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of (start, stop) rows."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    new = np.r_[True, ranges[1:, 0] > reach[:-1]]
    return np.column_stack([ranges[new, 0], reach[np.r_[new[1:], True]]])


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _split(docs: DataFrame) -> tuple[DataFrame, Callable[[pa.Array], pa.Array]]:
    """Documents whose text may have ranges, with these in the last two columns; and a test of a column for the others."""
    ranges = cut(repeated_ranges(docs))
    shared = bitmap(ranges.select("t1").distinct(), "t1")
    k1, k2, starts, stops = fresh(docs, "_t1", "_t2", "_starts", "_stops")
    keyed = docs.withColumns({k1: F.lit(0).cast("long"), k2: F.lit(0).cast("long")}).schema

    def chosen(part: pa.RecordBatch) -> pa.RecordBatch:
        t1, t2 = text_keys(part.column("text"))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(t1), pa.array(t2)], names=keyed.names).filter(pa.array(in_bitmap(shared, t1)))

    lists = ranges.distinct().groupBy("t1", "t2").agg(F.collect_list(F.struct("start", "stop")).alias("r"))
    lists = lists.select(F.col("t1").alias(k1), F.col("t2").alias(k2), F.col("r.start").alias(starts), F.col("r.stop").alias(stops))
    some = docs.mapInArrow(T.mapper(chosen), keyed).join(lists, [k1, k2], "left")
    return some, lambda column: pa.array(~in_bitmap(shared, text_keys(column)[0]))


_NO_RANGES = np.zeros((0, 2), np.int64)


def _cuts(part: pa.RecordBatch):
    """Text bytes and merged ranges of each row."""
    for text, starts, stops in zip(part.column("text"), part.column(part.num_columns - 2), part.column(part.num_columns - 1)):
        data = (text.as_py() or "").encode()
        if starts.as_py():
            yield data, _merged(np.column_stack([starts.values.to_numpy(), stops.values.to_numpy()]))
        else:
            yield data, _NO_RANGES


def _kept(data: bytes, ranges: np.ndarray) -> bytes:
    if not len(ranges):
        return data
    return b"".join(data[a:z] for a, z in zip([0, *ranges[:, 1].tolist()], [*ranges[:, 0].tolist(), len(data)]))


def removals(docs: DataFrame) -> DataFrame:
    """What is removed from each document, a digest of what stays, and the words of shared passages."""
    names = [c.split()[0] for c in REMOVED.split(", ")]

    def judged(ids, rows) -> pa.RecordBatch:
        rows = [(len(data), int((r[:, 1] - r[:, 0]).sum()), len(r), hashlib.sha256(_kept(data, r)).hexdigest()) for data, r in rows]
        n_bytes, n_removed, n_spans, digest = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest, pa.string())], names=names)

    def joined(part: pa.RecordBatch) -> pa.RecordBatch:
        return judged(part.column("doc_id"), _cuts(part))

    def untouched(part: pa.RecordBatch) -> pa.RecordBatch:
        part = part.filter(other(part.column("text")))
        return judged(part.column("doc_id"), ((((v.as_py() or "").encode()), _NO_RANGES) for v in part.column("text")))

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    some, other = _split(docs)
    judged_all = some.mapInArrow(T.mapper(joined), REMOVED).union(docs.mapInArrow(T.mapper(untouched), REMOVED))
    words = shared_words(docs).select(F.col("doc_id").alias("of"), "shared_words")
    return judged_all.join(words, F.col("doc_id") == F.col("of"), "left").select(*names, F.coalesce("shared_words", F.lit(0)).cast("long").alias("passage_words"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their repeated strings cut out; a character cut in two goes with the cut."""
    schema = docs.schema

    def joined(part: pa.RecordBatch) -> pa.RecordBatch:
        old = part.column("text").to_pylist()
        new = pa.array([_kept(data, r).decode("utf-8", "ignore") if len(r) else o for o, (data, r) in zip(old, _cuts(part))], pa.string())
        return pa.RecordBatch.from_arrays([new if c == "text" else part.column(c) for c in schema.names], names=schema.names)

    def untouched(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(other(part.column("text")))

    some, other = _split(docs)
    return some.mapInArrow(T.mapper(joined), schema).union(docs.mapInArrow(T.mapper(untouched), schema))
