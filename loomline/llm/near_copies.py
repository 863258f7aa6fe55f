"""One document of each group of near copies, by SimHash at several resolutions.

Two texts are near copies if the Jaccard similarity of their word shingles is
``SIMILARITY`` or more. The SimHash of a whole text finds pairs whose
fingerprints are within the radius (by the covering tables of ``simhash``).
That alone misses most pairs at similarity 0.8, so each text also has
``VIEWS`` SimHashes of samples of four shingles, those that come first under
four hash orders. Near copies share one with probability
``1 - (1 - s**4)**VIEWS``: 0.995 at 0.8. Texts that share one are compared by
sketches of 32 bits a shingle: all shingles up to ``SKETCH``, beyond that those
under a power of two of the hash range, about half of ``SKETCH`` at least. A
sketch that leaves out shingles decides only beyond ``DOUBT`` (three deviations
and more); texts with pairs in between are compared again by all their
shingles. A bucket emits a spanning forest of its links, never pairs.

Buckets of more than ``BUCKET_ROWS`` texts are dealt in blocks, linked through
``PIVOTS``. Where that leaves one in several components its texts are dealt again by a
prefix filter, which loses no pair: under one order of all shingles, rare ones
first, texts at 0.8 share one of the first fifth of theirs. If a shingle has more
than BUCKET_ROWS texts, blocks and pivots come first, too, and then the texts
outside the largest component meet every block. Buckets whose texts are of one
component already are passed over in every round, and of buckets of views that hold the same texts all but one.

Exact copies are one text, told by a 128-bit hash; null and empty are the same
text. Texts go by the hash's first half ``t``; where different texts share that,
all but one go by a hash of both halves. Of a group the row with the smallest (doc_id, hash) stays, one if rows
repeat; null doc_ids come last. All columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from . import text as T
from .common import bitmap, cut, fresh, in_bitmap, text_keys
from .components import components

SHINGLE, SIMILARITY, RADIUS = 5, 0.8, 3
VIEWS, SKETCH = 10, 512
DOUBT = (0.7, 0.9)
BUCKET_ROWS, PIVOTS, FIRST_VIEWS = 2048, 64, 3
ORDER_BITS = 20  # of the table of shingle counts by which the prefix filter orders
_ORDERS = np.random.default_rng(7).integers(0, 2**63, (VIEWS, 4), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

PRINT = "t long, t2 long, fp long, views array<long>, level int, kept int, shingles array<int>"


def _majority(a, b, c, d):
    """The SimHash of four hashes: bits set in over half."""
    return a & b & (c | d) | c & d & (a | b)


def _prints(part: pa.RecordBatch) -> pa.RecordBatch | None:
    column = part.column("text")
    data, offsets = T.utf8(column)
    low = T.LOWER[data]
    start, end, doc = T.words(low, offsets)
    h, of = T.shingles(T.Spans(low).hash(start, end), doc, SHINGLE)
    if not len(h):
        return None
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (of[1:] != of[:-1])]
    h, of = h[new], of[new]
    first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    size = np.diff(np.r_[first, len(h)])
    ones = np.zeros((len(first), 64), np.int64)
    T.count_bits(h, np.repeat(np.arange(len(first)), size), ones)
    fp = T.over_half(ones, size).view(np.int64)
    views = []
    for row in _ORDERS:
        views.append(_majority(*(np.minimum.reduceat(h * odd, first) for odd in row)))
    levels, kept = [], []
    for a, n in zip(first.tolist(), size.tolist()):
        mine = h[a : a + n]
        k = 0
        while n > SKETCH:  # of sorted hashes, those under 2**(64 - k) come first
            k += 1
            n = int(np.searchsorted(mine, np.uint64(1 << (64 - k))))
        levels.append(k)
        kept.append(n)
    t1, t2 = text_keys(column.take(pa.array(of[first])))
    upper = pa.ListArray.from_arrays(pa.array(np.r_[first, len(h)], pa.int32()), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(t1), pa.array(t2), pa.array(fp), pa.array(list(np.stack(views, axis=1).view(np.int64)), pa.list_(pa.int64())), pa.array(levels, pa.int32()), pa.array(kept, pa.int32()), upper], names=[c.split()[0] for c in PRINT.split(", ")])


def _under(sketch: np.ndarray, level: int) -> int:
    return len(sketch) if not level else int(np.searchsorted(sketch, np.uint32(1 << (32 - level))))


def forest(sketches: list[np.ndarray], levels: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Edges of a spanning forest of the sure links within one bucket, and the rows that have pairs in doubt.

    A breadth-first search from the most central texts: each text reached is
    compared with all not reached yet, over the hashes that two or more have.
    """
    m = len(sketches)
    _, code, times = np.unique(np.concatenate(sketches), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sketches])
    shared = times[code] > 1
    row, code = row[shared], code[shared]
    start = np.searchsorted(row, np.arange(m + 1))
    central = np.bincount(row, times[code], minlength=m)
    size = np.array([[_under(s, k) for k in range(int(levels.max()) + 1)] for s in sketches])
    order = np.argsort(-central, kind="stable")
    unreached, doubt = np.ones(m, bool), np.zeros(m, bool)
    mark = np.zeros(len(times), bool)
    edges: list[tuple[int, int]] = []
    live_row, live_code, left = row, code, m
    for root in order.tolist():
        if not unreached[root]:
            continue
        unreached[root] = False
        todo = [root]
        while todo:
            x = todo.pop()
            rest = np.flatnonzero(unreached)
            if not len(rest):
                return edges, doubt
            if len(rest) < left // 2:
                keep = unreached[live_row]
                live_row, live_code, left = live_row[keep], live_code[keep], len(rest)
            mine = code[start[x] : start[x + 1]]
            mark[mine] = True
            common = np.bincount(live_row[mark[live_code]], minlength=m)[rest]
            mark[mine] = False
            level = np.maximum(levels[x], levels[rest])
            both = size[x, level] + size[rest, level]
            near = common / np.maximum(both - common, 1) + 1e-9
            sure = near >= np.where(level, DOUBT[1], SIMILARITY)
            maybe = ~sure & (level > 0) & (near >= DOUBT[0])
            if maybe.any():
                doubt[x] = True
                doubt[rest[maybe]] = True
            edges += [(x, y) for y in rest[sure].tolist()]
            todo += rest[sure].tolist()
            unreached[rest[sure]] = False
    return edges, doubt


_BUCKET = ["view", "value", "block"]
_FOUND = "u long, v long, view int, value long, block long"
_HELD_BYTES = 8 << 20


def _links_of_sorted(batches):
    """Links within the buckets of a partition sorted by bucket, which may span batches; texts in doubt as rows with no v."""

    def bucket(table: pa.Table) -> np.ndarray:
        columns = [table[k].to_numpy() for k in _BUCKET]
        return np.r_[0, np.cumsum(np.any([c[1:] != c[:-1] for c in columns], axis=0))]

    def links(table: pa.Table) -> pa.RecordBatch:
        number, t, level = bucket(table), table["t"].to_numpy(), table["level"].to_numpy()
        lists = table["sketch"].combine_chunks()
        flat, offsets = lists.values.to_numpy().view(np.uint32), lists.offsets.to_numpy()
        first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        u, v, at = [], [], []
        for a, z in zip(first.tolist(), np.r_[first[1:], len(number)].tolist()):
            if z - a < 2:
                continue
            edges, doubt = forest([flat[offsets[k] : offsets[k + 1]] for k in range(a, z)], level[a:z])
            unsure = t[a:z][doubt].tolist()
            u += [t[a + i] for i, _ in edges] + unsure
            v += [t[a + j] for _, j in edges] + [None] * len(unsure)
            at += [a] * (len(edges) + len(unsure))
        keys = [table[k].combine_chunks().take(pa.array(at, pa.int64())) for k in _BUCKET]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), *keys], names=["u", "v", *_BUCKET])

    held: list[pa.RecordBatch] = []
    rows = size = 0
    for part in _parts(batches):
        held.append(part)
        rows, size = rows + part.num_rows, size + part.nbytes
        if rows < 4096 and size < _HELD_BYTES:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        number = bucket(table)
        whole = int(np.searchsorted(number, number[-1]))
        if whole:
            yield links(table.slice(0, whole).combine_chunks())
            table = table.slice(whole).combine_chunks()
        held, rows, size = table.to_batches(), table.num_rows, table.nbytes if whole else 0
    if rows:
        yield links(pa.Table.from_batches(held).combine_chunks())


def _compared(members: DataFrame, prints: DataFrame) -> DataFrame:
    """Links (u, v) within the buckets of ``members`` (t, view, value, block), by sketches, then by all shingles."""

    def linked(texts: DataFrame) -> DataFrame:
        return texts.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET, "t").mapInArrow(_links_of_sorted, _FOUND)

    sketch = F.slice("shingles", F.lit(1), F.col("kept")).alias("sketch")
    found = cut(linked(members.select("t", *_BUCKET).join(prints.select("t", "level", sketch), "t")))
    unsure = found.where("v is null").select(F.col("u").alias("t"), *_BUCKET).distinct()
    whole = prints.select("t", F.lit(0).alias("level"), F.col("shingles").alias("sketch"))
    return found.where("v is not null").select("u", "v").union(linked(unsure.join(whole, "t")).select("u", "v"))


def _parts(batches):
    for batch in batches:
        yield from (batch.slice(k, 256) for k in range(0, batch.num_rows, 256))


def _prefixes(texts: DataFrame) -> DataFrame:
    """(t, value): the shingles of each text (t, shingles) of which texts at SIMILARITY share one."""
    places = np.uint32(32 - ORDER_BITS)

    def count(batches):
        for batch in _parts(batches):
            n = np.bincount(batch.column(0).flatten().to_numpy().view(np.uint32) >> places, minlength=1 << ORDER_BITS)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"place": at, "n": n[at]})

    # At most 2**ORDER_BITS rows; any fixed counts give an order under which no pair is lost.
    counts = texts.select("shingles").mapInArrow(count, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(1 << ORDER_BITS, np.int64)
    table[counts["place"].to_numpy()] = counts["n"].to_numpy()
    table = texts.sparkSession.sparkContext.broadcast(table)

    def first(batches):
        for batch in _parts(batches):
            lists = batch.column("shingles")
            t, size = batch.column("t").to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            flat, row = lists.flatten().to_numpy().view(np.uint32), np.repeat(np.arange(len(size)), size)
            order = np.lexsort((flat, table.value[flat >> places], row))
            rank = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
            most = size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1
            keep = rank < most[row]
            yield pa.RecordBatch.from_pydict({"t": t[row[keep]], "value": flat[order][keep].astype(np.int64)})

    return texts.select("t", "shingles").mapInArrow(first, "t long, value long")


def _rooted(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """Rows (t, ...) with the component that each text is in by now."""
    if links is None:
        return rows.withColumn("root", F.col("t"))
    return rows.join(components(links), F.col("t") == F.col("node"), "left").withColumn("root", F.coalesce("root", "t")).drop("node")


def _open(rows: DataFrame, once: bool = False) -> DataFrame:
    """Members (t, view, value, root) of the buckets that hold texts of two components, with the number n of their texts.

    With ``once``, for rows without repetition, one of the buckets that hold the same texts, told by a 128-bit hash of the set.
    """
    marks = [F.bit_xor(F.xxhash64(F.lit(i), "t")).alias(f"mark{i}") for i in range(2)] if once else []
    sizes = rows.groupBy("view", "value").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), *marks).where("low < high")
    if once:
        sizes = sizes.groupBy("n", "mark0", "mark1").agg(F.min(F.struct("view", "value")).alias("one")).select("one.view", "one.value", "n")
    return rows.join(cut(sizes.select("view", "value", "n")), ["view", "value"])


def _more(links: DataFrame | None, found: DataFrame) -> DataFrame:
    return cut(found if links is None else links.union(found))


def _blocks(large: DataFrame, prints: DataFrame) -> DataFrame:
    """Links within the blocks of large buckets and with their pivots."""
    blocks = F.ceil(F.col("n") / BUCKET_ROWS).cast("long")
    own = F.array(F.pmod(F.xxhash64("t"), blocks))
    pivot = F.pmod(F.xxhash64(F.lit("pivot"), "t"), F.col("n")) < PIVOTS
    return _compared(large.withColumn("block", F.explode(F.when(pivot, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(own))), prints)


def _every_block(large: DataFrame, prints: DataFrame) -> DataFrame | None:
    """Links of the texts outside the largest component of a bucket with all its texts, in a bucket for each pair of blocks."""
    parts = cut(large.groupBy("view", "value", "root").agg(F.count(F.lit(1)).alias("texts")))
    most = parts.groupBy("view", "value").agg(F.max(F.struct("texts", "root")).alias("most"), F.sum("texts").alias("all"))
    most = cut(most.select("view", "value", F.col("most.root").alias("main"), (F.col("all") - F.col("most.texts")).alias("outside")))
    if most.isEmpty():
        return None
    half = BUCKET_ROWS // 2
    count = lambda c: F.ceil(F.col(c) / half).cast("long")
    each = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda block, out: block * F.lit(1 << 31) + out
    own, mine = F.pmod(F.xxhash64("t"), count("n")), F.pmod(F.xxhash64(F.lit("out"), "t"), count("outside"))
    meets = F.transform(each(count("outside")), lambda o: pair(own, o))
    meets = F.when(F.col("root") == F.col("main"), meets).otherwise(F.array_union(meets, F.transform(each(count("n")), lambda b: pair(b, mine))))
    return _compared(large.join(most, ["view", "value"]).withColumn("block", F.explode(meets)), prints)


def _hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, t, t2, rows) of each document's text."""

    def keys(part: pa.RecordBatch) -> pa.RecordBatch:
        t1, t2 = text_keys(part.column("text"))
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(t1), pa.array(t2)], names=["doc_id", "t", "t2"])

    ids = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(T.mapper(keys), "doc_id long, t long, t2 long")
    return ids.groupBy("doc_id", "t", "t2").agg(F.count(F.lit(1)).alias("rows"))


def shared_halves(texts: DataFrame) -> DataFrame:
    """(t, least): the first halves that different texts (t, t2) share, with the least second half."""
    return cut(texts.groupBy("t").agg(F.min("t2").alias("least"), F.max("t2").alias("most")).where("least < most").select("t", "least"))


def told_apart(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """Texts (t, t2, ...) with a t for each text: that of the least t2 stays, the others' become a hash of both halves."""
    other = F.when(F.col("t2") > F.col("least"), F.xxhash64("t", "t2")).otherwise(F.col("t"))
    return texts.join(shared, "t", "left").withColumn("t", other).drop("least")


def _each_print(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The prints of each text once. Only texts whose t is not alone in ``ids`` are moved for it, told by a bitmap."""
    again = bitmap(ids.groupBy("t").agg(F.sum("rows").alias("n")).where("n > 1").select("t"), "t")

    def of(repeated: bool):
        def run(part: pa.RecordBatch) -> pa.RecordBatch | None:
            part = part.filter(pa.array(in_bitmap(again, text_keys(part.column("text"))[0]) == repeated))
            return _prints(part) if part.num_rows else None

        return docs.select("text").mapInArrow(T.mapper(run), PRINT)

    return of(False).union(of(True).groupBy("t", "t2").agg(*[F.first(c).alias(c) for c in ("fp", "views", "level", "kept", "shingles")]))


def text_links(docs: DataFrame, shared: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Edges (u, v) between texts' t, told apart by their shared halves, that join all near copies.

    Buckets go in rounds, and only where texts of several components meet: the
    whole texts' and the first views, the other views, the blocks of large
    buckets, the prefixes of what is open in those, and those in every block.
    """
    ids = cut(_hashed(docs)) if ids is None else ids
    prints = cut(told_apart(_each_print(docs, ids), shared_halves(ids) if shared is None else shared).drop("t2"))
    near = components(simhash.links(prints.select("fp").distinct(), RADIUS))
    whole = prints.select("t", "fp").join(near, F.col("fp") == F.col("node"), "left").select("t", F.lit(VIEWS).alias("view"), F.coalesce("root", "fp").alias("value"))
    spots = prints.select("t", F.posexplode("views").alias("view", "value")).union(whole)
    fits = F.col("n") <= BUCKET_ROWS
    no_block = F.lit(0).cast("long")
    early = F.col("view").isin(VIEWS, *range(FIRST_VIEWS))
    links = _more(None, _compared(_open(_rooted(spots.where(early), None), True).where(fits).withColumn("block", no_block), prints))
    links = _more(links, _compared(_open(_rooted(spots.where(~early), links), True).where(fits).withColumn("block", no_block), prints))
    large = cut(_open(_rooted(spots, links), True).where(~fits))
    if large.isEmpty():
        return links
    links = _more(links, _blocks(large, prints))
    texts = cut(_open(_rooted(large.select("t", "view", "value"), links)).select("t").distinct())
    if texts.isEmpty():
        return links
    again = cut(_prefixes(texts.join(prints, "t")).select("t", F.lit(-1).alias("view"), "value"))
    links = _more(links, _compared(_open(_rooted(again, links)).where(fits).withColumn("block", no_block), prints))
    large = cut(_open(_rooted(again, links)).where(~fits))
    if large.isEmpty():
        return links
    links = _more(links, _blocks(large, prints))
    rest = _every_block(cut(_open(_rooted(large.select("t", "view", "value"), links))), prints)
    return links if rest is None else links.union(rest)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies of a kept one, with all their columns."""
    schema = docs.schema
    ids = cut(_hashed(docs))
    halves = shared_halves(ids)
    links = text_links(docs, halves, ids)
    ids = told_apart(ids.withColumn("t1", F.col("t")), halves)
    placed = ids.join(components(links), F.col("t") == F.col("node"), "left").withColumn("group", F.coalesce("root", "t"))
    groups = cut(placed.groupBy("group").agg(F.min(F.struct(F.isnull("doc_id"), "doc_id", "t")).alias("one"), F.sum("rows").alias("n")).where("n > 1").select("group", F.col("one.doc_id").alias("one_id"), F.col("one.t").alias("one_t")))
    stays = F.col("doc_id").eqNullSafe(F.col("one_id")) & (F.col("t") == F.col("one_t"))
    key, key2, key_id, key_t, key_t2, one = fresh(docs, "_key", "_key2", "_id", "_t", "_t2", "_one")
    # Of these rows the first kind goes; of the second, repeated, one stays.
    judged = cut(placed.join(groups, "group").where(~stays | (F.col("rows") > 1)).select(F.col("doc_id").alias(key_id), F.col("t1").alias(key_t), F.col("t2").alias(key_t2), stays.alias(one)))
    shared = bitmap(judged.select(key_t).distinct(), key_t)
    keyed = docs.withColumns({key: F.lit(0).cast("long"), key2: F.lit(0).cast("long")}).schema

    def clear(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(~in_bitmap(shared, text_keys(part.column("text"))[0])))

    def in_doubt(part: pa.RecordBatch) -> pa.RecordBatch:
        t1, t2 = text_keys(part.column("text"))
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(t1), pa.array(t2)], names=keyed.names).filter(pa.array(in_bitmap(shared, t1)))

    same = (F.col(key) == F.col(key_t)) & (F.col(key2) == F.col(key_t2)) & F.col("doc_id").cast("long").eqNullSafe(F.col(key_id))
    doubt = docs.mapInArrow(T.mapper(in_doubt), keyed).join(judged, same, "left")
    names = [F.col(f"`{c}`") for c in schema.names]
    single = doubt.where(F.col(one).isNull()).select(*names)
    repeated = doubt.where(F.col(one)).dropDuplicates([key_id, key_t, key_t2]).select(*names)
    return docs.mapInArrow(T.mapper(clear), schema).union(single).union(repeated)
