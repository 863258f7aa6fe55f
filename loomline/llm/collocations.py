"""Collocations: phrases of 2 to 5 words by how far their words attract each other, for each language.

Candidates level by level: the words of a phrase can be frequent enough only if
both phrases of one word less are, which a bitmap of these tells. What passes is
summed over tasks as far as the least count, so the candidates are exactly the
frequent phrases. Counting: a minimal perfect hash (levels of bits, each holding
the keys that no other key of the level met) gives each candidate a slot; a key
that is stored in the slot tells it from whatever else hashes there. Tasks count
slots in NumPy arrays, a tree of tasks sums these, and all parts of a phrase's
cuts are read by slot. Candidates go in blocks of about ``SLOTS``, each counted in
a pass of its own: an array, and what the driver and a task hold, has a bound
whatever the number of candidates. Scores are in Python's integers, exact.

Null languages are ``und``, null texts empty. Ties go to the smallest cut, then
phrases in the order of their bytes. Repeated rows count as often. An empty table
gives an empty table. Extra columns are ignored. A task holds some 100 bytes for
each byte of the longest text.
"""

from __future__ import annotations

import operator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as T
from .common import bitmap, cut, in_bitmap

LONGEST = 5
LEAST = 100
BEST = 2000
#: Candidates of a block; its keys take 16 bytes each, its counts 8.
SLOTS = 1 << 20
#: Bytes of text whose phrases a task counts before it hands them on.
_CHUNK = 1 << 21
_BREAK = 0x0A
_MARKED = np.array([_BREAK if c in b".,;:!?\n\v\f\r" else 0x20 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_APART = np.isin(np.arange(256), (_BREAK, 0x20))
_UINT = np.uint64


class Phrases:
    """The words of some texts in one buffer, a space after each, and how many words there are from each to the end of its piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        data, offsets = T.utf8(texts)
        data = _MARKED[data]
        start, end, self.doc = T.words(data, offsets, _APART)
        size = end - start + 1
        self.end = np.cumsum(size) - 1
        self.start = self.end - size + 1
        self.data = data[np.minimum(np.repeat(start - self.start, size) + np.arange(int(size.sum())), max(len(data) - 1, 0))]
        self.data[self.end] = 0x20
        breaks = np.r_[0, np.cumsum(data == _BREAK)][start]
        edge = np.flatnonzero((breaks[1:] != breaks[:-1]) | (self.doc[1:] != self.doc[:-1])) + 1
        ends = np.r_[edge, len(start)]
        self.room = np.repeat(ends, np.diff(np.r_[0, ends])) - np.arange(len(start))
        self.langs = langs
        known: dict[str, int] = {}
        of = np.array([known.setdefault(x, xxhash.xxh3_64_intdigest(x.encode())) for x in langs.to_pylist()], _UINT)
        self.salt = T.mix(of)[self.doc]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each word and its language."""
        one = T.word_hashes(self.data, self.start, self.end)
        two = T.word_hashes(self.data ^ np.uint8(0x5A), self.start, self.end)
        return T.mix(one + self.salt), T.mix(two ^ self.salt)

    def at(self, k: int) -> np.ndarray:
        """Where phrases of k words start."""
        return np.flatnonzero(self.room >= k)

    def rows(self, at: np.ndarray, k: int, n: np.ndarray) -> pa.RecordBatch:
        start, size = self.start[at], self.end[at + k - 1] - self.start[at]
        ends = np.cumsum(size)
        text = self.data[np.repeat(start - ends + size, size) + np.arange(int(size.sum()))]
        phrases = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(np.r_[0, ends].astype(np.int64)), pa.py_buffer(text)])
        return pa.RecordBatch.from_arrays([self.langs.take(pa.array(self.doc[at])), phrases.cast(pa.string()), pa.array(n)], ["lang", "phrase", "n"])


def _long(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words, by the run's first word."""
    return h if k == 1 else T.grams(h, k)


class PerfectHash:
    """A slot from 0 to n - 1 for each of n keys of two 64-bit halves, no two the same."""

    def __init__(self, keys: np.ndarray):
        self.levels, slots, rest, before = [], np.empty(len(keys), np.int64), np.arange(len(keys)), 0
        while len(rest):
            size = 64 * (len(rest) // 32 + 1)
            place = self._place(keys[rest, 0], keys[rest, 1], len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            bits = np.zeros(size, np.uint8)
            bits[place[alone]] = 1
            words = np.packbits(bits, bitorder="little").view(_UINT)
            ranks = before + np.cumsum(np.bitwise_count(words), dtype=np.int64) - np.bitwise_count(words)
            self.levels.append((size, words, ranks))
            slots[rest[alone]] = self._rank(words, ranks, place[alone])
            before += int(alone.sum())
            rest = rest[~alone]
        self.keys = np.empty_like(keys)
        self.keys[slots] = keys

    @staticmethod
    def _place(h: np.ndarray, g: np.ndarray, level: int, size: int) -> np.ndarray:
        return (T.mix(T.mix(h + _UINT(level)) + g) % _UINT(size)).astype(np.int64)

    @staticmethod
    def _rank(words: np.ndarray, ranks: np.ndarray, place: np.ndarray) -> np.ndarray:
        at, bit = place >> 6, (place & 63).astype(_UINT)
        return ranks[at] + np.bitwise_count(words[at] & ((_UINT(1) << bit) - _UINT(1)))

    def slots(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the key stored there is another."""
        out, rest = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (size, words, ranks) in enumerate(self.levels):
            if not len(rest):
                break
            place = self._place(h[rest], g[rest], level, size)
            here = (words[place >> 6] >> (place & 63).astype(_UINT) & _UINT(1)).astype(bool)
            out[rest[here]] = self._rank(words, ranks, place[here])
            rest = rest[~here]
        found = np.flatnonzero(out >= 0)
        wrong = (self.keys[out[found]] != np.column_stack([h[found], g[found]])).any(axis=1)
        out[found[wrong]] = -1
        return out


def _phrases(part: pa.RecordBatch) -> Phrases:
    return Phrases(part.column("text"), part.column("lang"))


def _counted(phrases: Phrases, h: np.ndarray, at: np.ndarray, k: int, most: int | None) -> pa.RecordBatch:
    """Each phrase of a chunk once with its count, or with ``most`` if that is less."""
    _, first, n = np.unique(h[at], return_index=True, return_counts=True)
    return phrases.rows(at[first], k, np.minimum(n, most) if most else n)


def _words(part: pa.RecordBatch) -> pa.RecordBatch:
    phrases = _phrases(part)
    return _counted(phrases, phrases.keys()[0], phrases.at(1), 1, None)


def _longer(known, k: int, least: int):
    """Phrases of k words of a chunk whose two phrases of k - 1 words are in the bitmap."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        phrases = _phrases(part)
        h = phrases.keys()[0]
        frequent = in_bitmap(known, _long(h, k - 1))
        at = phrases.at(k)
        return _counted(phrases, _long(h, k), at[frequent[at] & frequent[at + 1]], k, least)

    return run


def _keyed(batches):
    """(lang, phrase, k, h, g) of phrases, each the only one of its text."""
    for batch in batches:
        phrases = Phrases(batch.column(1), batch.column(0))
        first = np.searchsorted(phrases.doc, np.arange(batch.num_rows))
        k = phrases.room[first]
        keys = np.zeros((batch.num_rows, 2), _UINT)
        for n in range(1, LONGEST + 1):
            some = k == n
            keys[some] = np.column_stack([_long(x, n)[first[some]] for x in phrases.keys()])
        keys = keys.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(k), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["lang", "phrase", "k", "h", "g"])


def _slot_counts(shared, known: list):
    """One row of a task: how often each slot's phrase occurs. ``known`` has the bitmap of each level but the last."""

    def run(batches):
        table = shared.value
        total = np.zeros(len(table.keys), np.int64)
        for part in T.chunks(batches, limit=_CHUNK):
            phrases = _phrases(part)
            h, g = phrases.keys()
            frequent = np.ones(len(h) + 1, bool)
            for k in range(1, LONGEST + 1):
                at = phrases.at(k)
                at = at[frequent[at] & frequent[at + 1]]
                hs, gs = _long(h, k), _long(g, k)
                if k <= len(known):
                    frequent[: len(hs)] = in_bitmap(known[k - 1], hs)
                    at = at[frequent[at]]
                slots = table.slots(hs[at], gs[at])
                total += np.bincount(slots[slots >= 0], minlength=len(total))
        yield pa.RecordBatch.from_pydict({"counts": [total.tobytes()]})

    return run


def _parts(shared):
    """Of each candidate the counts of the whole and of both parts of each cut, zero where a part is not in this block."""

    def run(batches):
        table, counts = shared.value
        counts = np.r_[counts, 0]
        for batch in batches:
            phrases = Phrases(batch.column(1), batch.column(0))
            first, k = np.searchsorted(phrases.doc, np.arange(batch.num_rows)), batch.column(2).to_numpy()
            h, g = phrases.keys()
            found = np.zeros((batch.num_rows, 2 * LONGEST - 1), np.int64)
            for n in range(1, LONGEST + 1):
                hs, gs = _long(h, n), _long(g, n)
                read = lambda at: counts[table.slots(hs[at], gs[at])]  # noqa: B023, E731
                whole, head = k == n, k > n
                found[whole, 0] = read(first[whole])
                if n < LONGEST:
                    found[head, 2 * n - 1] = read(first[head])
                for size in range(n + 1, LONGEST + 1):  # the rest after the first size - n words
                    tail = k == size
                    found[tail, 2 * (size - n)] = read(first[tail] + size - n)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *map(pa.array, found.T)], ["lang", "phrase", "k", *_F])

    return run


_F = [f"f{i}" for i in range(2 * LONGEST - 1)]


def _scored(batches):
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        out = []
        for k, n, a, *parts in zip(*columns[2:]):
            score, at = min((1000 * a * n // (parts[2 * i] * parts[2 * i + 1]), i) for i in range(k - 1))
            out.append((a, parts[2 * at], parts[2 * at + 1], n, score))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in zip(*out))], ["lang", "phrase", "k", "a", "l", "r", "n", "score"]) if out else pa.RecordBatch.from_pylist([], _SCORED)


_SCORED = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("k", pa.int64()), *((c, pa.int64()) for c in ("a", "l", "r", "n", "score"))])
_KEYED = "lang string, phrase string, k long, h long, g long"


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, list]:
    """(lang, phrase, k, h, g) of all phrases of up to LONGEST words that occur ``least`` times, (lang, n) of all words, and the bitmaps of all levels but the last."""
    words = cut(docs.mapInArrow(T.mapper(_words, limit=_CHUNK), "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")))
    levels = [cut(words.where(F.col("n") >= least).select("lang", "phrase").mapInArrow(_keyed, _KEYED))]
    known: list = []
    for k in range(2, LONGEST + 1):
        known.append(bitmap(levels[-1], "h"))
        seen = docs.mapInArrow(T.mapper(_longer(known[-1], k, least), limit=_CHUNK), "lang string, phrase string, n long")
        sums = seen.groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
        levels.append(cut(sums.where(F.col("n") >= least).select("lang", "phrase").mapInArrow(_keyed, _KEYED)))
    return reduce(DataFrame.unionAll, levels), words.groupBy("lang").agg(F.sum("n").alias("n")), known


def counted(docs: DataFrame, phrases: DataFrame, known: list) -> DataFrame:
    """(lang, phrase, k, f0, ...) of each phrase of two words or more: its count and those of both parts of each cut."""
    spark = docs.sparkSession
    blocks = -(-phrases.count() // SLOTS)
    block = F.pmod(F.col("h"), F.lit(max(blocks, 1)))
    candidates, out = phrases.where("k > 1").select("lang", "phrase", "k"), []
    for b in range(blocks):
        keys = phrases.where(block == b).select("h", "g").toArrow()  # about SLOTS keys
        table = PerfectHash(np.column_stack([keys.column(i).to_numpy().view(_UINT) for i in (0, 1)]))
        shared = spark.sparkContext.broadcast(table)
        each = docs.mapInArrow(_slot_counts(shared, known), "counts binary").rdd.map(lambda row: np.frombuffer(row.counts, np.int64))
        total = each.treeAggregate(0, operator.add, operator.add)
        read = spark.sparkContext.broadcast((table, total))
        out.append(candidates.mapInArrow(_parts(read), f"lang string, phrase string, k long, {', '.join(f'{f} long' for f in _F)}"))
    if not out:
        return spark.createDataFrame([], f"lang string, phrase string, k long, {', '.join(f'{f} long' for f in _F)}")
    return reduce(DataFrame.unionAll, out).groupBy("lang", "phrase", "k").agg(*[F.sum(f).alias(f) for f in _F])


def collocations(docs: DataFrame, least: int = LEAST, best: int = BEST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's best phrases."""
    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    phrases, totals, known = frequent_phrases(rows, least)
    # Tables of a row for each language and for each candidate, written so that the joins with them can be split or broadcast.
    totals, parts = cut(totals), cut(counted(rows, phrases, known))
    scored = cut(parts.join(totals, "lang").select("lang", "phrase", "k", "n", *_F).mapInArrow(_scored, "lang string, phrase string, k long, a long, l long, r long, n long, score long"))
    head, tail = F.expr("substring_index(phrase, ' ', cast(k - 1 as int))"), F.expr("substring(phrase, instr(phrase, ' ') + 1)")
    # A phrase inside a longer one of the same count is inside one of one word more.
    inside = scored.where("k > 2").select("lang", F.explode(F.array(head, tail)).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = scored.join(cut(inside), ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are among the best of its shares, so no task sorts a whole language.
    share = F.pmod(F.xxhash64("phrase"), F.lit(256))
    some = kept.withColumn("share", share).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
