"""Benchmark decontamination by template windows.

Tokens are runs of letters and digits (a point or comma between digits stays
inside). Numbers, units after a number and names become typed placeholders. A name is
capitalised, and inside a sentence or, at the beginning of one, none of the ``COMMON``
words that begin sentences; so other words there count as names, too, in items
and documents alike. Names, or numbers, with a space or a hyphen between them are one
token: "New York" takes the place of "Boston", "twenty-five" of "9". Windows of ``WINDOW`` tokens are hashed
twice, literally (letter case aside) and as templates; a template needs one
placeholder and ``WINDOW_LITERAL`` other tokens. Windows of documents are joined
with those of the benchmark by hash. Literal matches count as they are. Template
matches count if along their alignment of the item with the document

- the matched windows hold ``LEAST_LITERAL`` units of the item that are no
  placeholders, and
- slots are consistent: every value of the item is replaced by one value, and no
  two of its values by the same one; values that stay take part.

So a question with other numbers or names is found, and a chance fit of
placeholders is not. A document is contaminated by an item if the matched windows
cover ``COVERAGE`` of the item's tokens, or ``LONG_RUN`` consecutive ones.

An item of fewer than WINDOW tokens or units is one window of its own length, searched for
in the same way; one of fewer than ``SHORTEST`` can't be told from common phrases
and is not searched for. A screen of the benchmark's hashes goes to every task if
it has at most ``SCREEN_WINDOWS`` windows; beyond that all windows of the
documents take part in the join, with the same rows.

Null and empty texts match nothing. Documents are told apart by doc_id and a
64-bit hash of the text, so repeated rows give one result row. Extra columns
are ignored, and kept by :func:`decontaminate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bitmap, cut, fresh, in_bitmap

WINDOW = 8
SHORTEST = 4
WINDOW_LITERAL = 2
LEAST_LITERAL = 5
COVERAGE = 0.5
LONG_RUN = 13
SCREEN_WINDOWS = 4_000_000

# Units that may follow a number, and number words.
UNITS = """mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec second seconds min minute minutes h hr hour
hours day days week weeks month months year years mph kmh kph hz khz mhz ghz w kw mw v a j kj cal kcal c f k pa kpa
bar percent pct dollars dollar euros euro cents pounds pound miles mile meters meter metres metre inches inch feet
foot yards kilometers kilometres kilograms grams liters litres gallons degrees usd eur gbp""".split()
NUMBER_WORDS = """zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen
seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion""".split()
# Words that begin sentences and are no names.
COMMON = """a an the this that these those it he she they we you i his her their our your my its there here what which who whom
whose when where why how if then so and but or nor for yet as at by from in into of on to with without after before during while
until since because although each every all both some any no not is are was were do does did has have had can could may might must
should will would let find given suppose assume calculate compute determine solve write name state choose explain describe list
show der die das ein eine wie wer wo wann warum welche es er sie wir und aber oder wenn dann im am auf mit nach le la les un une
des ce cette il elle ils nous vous qui que quand comment pourquoi combien si et mais ou dans sur avec pour el los las una este esta
ella ellos qué quién dónde cuándo cómo cuántos por pero en con para""".split()

_DIGIT = np.array([48 <= c <= 57 for c in range(256)])
_POINT = np.array([chr(c) in ".," for c in range(256)])
_STOP = np.array([chr(c) in ".!?:;\n\"" for c in range(256)])
_JOINS = np.array([chr(c) in " -" for c in range(256)])
NUMBER, UNIT, NAME = 1, 2, 3
_HOLDER = T.mix(np.arange(4, dtype=np.uint64) + np.uint64(77))
WINDOWS = "id long, text_key long, n_tokens long, width int, pos long, low long, high long, literal boolean, key long, slots array<string>, plain array<long>"


def _hashes_of(words: list[str]) -> np.ndarray:
    flat = np.frombuffer("".join(words).encode(), np.uint8)
    end = np.cumsum([len(w) for w in words])
    return np.sort(T.Spans(flat).hash(end - [len(w) for w in words], end))


_UNIT_HASHES, _NUMBER_HASHES, _COMMON_HASHES = _hashes_of(UNITS), _hashes_of(NUMBER_WORDS), _hashes_of(COMMON)


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


class Tokens:
    """Tokens of a column: spans, documents, hashes; and its units: their tokens, documents, hashes and placeholder types."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = T.utf8(column)
        self.low = T.lowered(column)
        apart = T.IS_APART[self.data]
        digit = _DIGIT[self.data]
        if len(apart) > 2:
            apart[1:-1] &= ~(_POINT[self.data[1:-1]] & digit[:-2] & digit[2:])
        marks = np.zeros(256, bool)
        marks[1] = True
        self.start, self.end, self.doc = T.words(apart.astype(np.uint8), self.offsets, marks)
        self.hash = T.Spans(self.low).hash(self.start, self.end)
        n = len(self.start)
        same = np.zeros(n, bool)
        same[1:] = self.doc[1:] == self.doc[:-1]
        lead = self.data[self.start] if n else np.zeros(0, np.uint8)
        kind = np.zeros(n, np.int64)
        kind[_DIGIT[lead] | _among(self.hash, _NUMBER_HASHES)] = NUMBER
        after = np.zeros(n, bool)
        after[1:] = (kind[:-1] == NUMBER) & same[1:]
        kind[after & (kind == 0) & _among(self.hash, _UNIT_HASHES)] = UNIT
        stops = np.concatenate([[0], np.cumsum(_STOP[self.data])])
        inside = np.zeros(n, bool)
        inside[1:] = same[1:] & (stops[self.start[1:]] == stops[self.end[:-1]])
        second = self.data[np.minimum(self.start + 1, max(len(self.data) - 1, 0))] if n else lead
        capital = (lead >= 65) & (lead <= 90) | (lead == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        kind[(kind == 0) & capital & (inside | ~_among(self.hash, _COMMON_HASHES))] = NAME
        # Names and numbers that stand together are one token.
        again = np.zeros(n, bool)
        again[1:] = same[1:] & (kind[1:] == kind[:-1]) & np.isin(kind[1:], (NUMBER, NAME)) & (self.start[1:] - self.end[:-1] == 1) & _JOINS[self.data[self.end[:-1]]]
        first = np.flatnonzero(~again)
        self.low_token, self.high_token = first, np.r_[first[1:], n]
        self.unit_hash = self.hash
        if n:
            place = np.arange(n) - first[np.cumsum(~again) - 1]
            self.unit_hash = np.add.reduceat(T.mix(self.hash + place.astype(np.uint64)), first)
        self.kind, self.unit_doc = kind[first], self.doc[first]

    def literal_windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First token and hash of each window of tokens."""
        at = np.flatnonzero(self.doc[: max(len(self.doc) - width + 1, 0)] == self.doc[width - 1 :])
        return at, T.grams(self.hash, width)[at]

    def template_windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First unit and hash of each window of units that is a template."""
        m = max(len(self.kind) - width + 1, 0)
        holders = np.concatenate([[0], np.cumsum(self.kind > 0)])
        held = holders[width : width + m] - holders[:m]
        at = np.flatnonzero((self.unit_doc[:m] == self.unit_doc[width - 1 :]) & (held > 0) & (width - held >= WINDOW_LITERAL))
        return at, T.grams(np.where(self.kind > 0, _HOLDER[self.kind], self.unit_hash), width)[at]

    def slots(self, first: int, width: int) -> list[str]:
        at = first + np.flatnonzero(self.kind[first : first + width])
        return [f"{self.kind[k]}{self.low[self.start[self.low_token[k]] : self.end[self.high_token[k] - 1]].tobytes().decode().replace('-', ' ')}" for k in at]


def _screen(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys, and a bitmap of their top 22 bits that most other keys fail."""
    keys = np.unique(keys)
    bitmap = np.zeros(1 << 22, bool)
    bitmap[(keys >> np.uint64(42)).astype(np.int64)] = True
    return keys, bitmap


def _passes(h: np.ndarray, screen) -> np.ndarray:
    keys, bitmap = screen
    out = bitmap[(h >> np.uint64(42)).astype(np.int64)]
    at = np.flatnonzero(out)
    out[at] = _among(h[at], keys) if len(keys) else False
    return out


def windows(rows: DataFrame, widths: list[int] | None = None, screens=None) -> DataFrame:
    """Literal and template windows of (id, text_key, text).

    With ``widths`` those of each width, all or those that pass the broadcast
    screens; without, those of items: of WINDOW tokens, or of all in a shorter text.
    """

    def of(part: pa.RecordBatch, tokens: Tokens, width: int) -> pa.RecordBatch | None:
        at, literal = tokens.literal_windows(width)
        units, template = tokens.template_windows(width)
        lead, unit_lead = (np.searchsorted(d, np.arange(part.num_rows + 1)) for d in (tokens.doc, tokens.unit_doc))
        if widths is None and width < WINDOW:  # shorter items only
            own, unit_own = np.diff(lead)[tokens.doc[at]] == width, np.diff(unit_lead)[tokens.unit_doc[units]] == width
            at, literal, units, template = at[own], literal[own], units[unit_own], template[unit_own]
        if screens is not None:
            exact, fit = _passes(literal, screens.value[0]), _passes(template, screens.value[1])
            at, literal, units, template = at[exact], literal[exact], units[fit], template[fit]
        if not len(at) + len(units):
            return None
        doc, many = np.r_[tokens.doc[at], tokens.unit_doc[units]], len(at)
        pos = np.r_[at - lead[tokens.doc[at]], units - unit_lead[tokens.unit_doc[units]]]
        low = np.r_[at, tokens.low_token[units]] - lead[doc]
        high = np.r_[at + width, tokens.high_token[units + width - 1]] - lead[doc]
        slots = [[]] * many + [tokens.slots(k, width) for k in units.tolist()]
        # Only the items' are asked for; positions count from the item's start.
        plain = [[]] * many + [(p + np.flatnonzero(tokens.kind[k : k + width] == 0) if widths is None else []) for k, p in zip(units.tolist(), pos[many:].tolist())]
        key = np.r_[literal, template].view(np.int64)
        return pa.RecordBatch.from_arrays(
            [part.column("id").take(pa.array(doc)), part.column("text_key").take(pa.array(doc)), pa.array(np.diff(lead)[doc]), pa.array(np.full(len(doc), width, np.int32)), pa.array(pos), pa.array(low), pa.array(high), pa.array(np.arange(len(doc)) < many), pa.array(key), pa.array(slots, pa.list_(pa.string())), pa.array(plain, pa.list_(pa.int64()))],
            names=[c.split()[0] for c in WINDOWS.split(", ")],
        )

    def run(batches):
        for part in T.chunks(batches):
            tokens = Tokens(part.column("text"))
            for width in widths or range(SHORTEST, WINDOW + 1):
                out = of(part, tokens, width)
                if out is not None:
                    yield out

    return rows.mapInArrow(run, WINDOWS)


def _keyed(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.xxhash64("text").alias("text_key"), "text")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_key, item_id, covered_tokens, n_tokens, longest_run, literal_windows) of each contaminated pair."""
    theirs = windows(_keyed(benchmark, "item_id")).select(F.col("id").alias("item_id"), "n_tokens", "width", F.col("pos").alias("item_pos"), "low", "high", "literal", "key", F.col("slots").alias("item_slots"), "plain")
    screens = None
    widths = sorted(r.width for r in theirs.select("width").distinct().collect())  # WINDOW - SHORTEST + 1 at most
    if theirs.count() <= SCREEN_WINDOWS:
        known = theirs.select("literal", "key").toArrow()
        key, literal = known["key"].to_numpy().view(np.uint64), known["literal"].to_numpy()
        screens = docs.sparkSession.sparkContext.broadcast((_screen(key[literal]), _screen(key[~literal])))
    hits = windows(_keyed(docs, "doc_id"), widths or [WINDOW], screens).drop("n_tokens", "plain", "low", "high").join(theirs, ["literal", "width", "key"])
    pair, line = ["id", "text_key", "item_id", "n_tokens"], F.col("pos") - F.col("item_pos")
    span = F.struct("low", "high")
    # A literal match counts in any case and gives its span to no line; templates are judged line by line.
    lined = hits.groupBy(*pair, "literal", F.when(~F.col("literal"), line).alias("line")).agg(
        F.collect_set(span).alias("spans"), F.array_distinct(F.flatten(F.collect_set(F.arrays_zip("item_slots", "slots")))).alias("pairs"), F.array_distinct(F.flatten(F.collect_set("plain"))).alias("plain"),
    )
    one_way = lambda side: F.size(F.array_distinct(F.transform("pairs", lambda p: p[side]))) == F.size("pairs")
    sound = lined.where(F.col("literal") | one_way("item_slots") & one_way("slots") & (F.size("plain") >= LEAST_LITERAL))
    spans = F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans"))))
    pair = sound.groupBy(*pair).agg(spans.alias("spans"), F.coalesce(F.max(F.when(F.col("literal"), F.size("spans"))), F.lit(0)).cast("long").alias("literal_windows"))
    # Tokens that the windows cover, and the longest run of tokens whose windows overlap or touch.
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("covered"), zero.alias("run"), zero.alias("longest"), (zero - 1).alias("last"))

    def step(acc, x):
        more = F.greatest(x["high"] - F.greatest(acc["last"], x["low"]), zero)
        run = F.when(x["low"] <= acc["last"], acc["run"] + more).otherwise(more)
        return F.struct((acc["covered"] + more).alias("covered"), run.alias("run"), F.greatest(acc["longest"], run).alias("longest"), F.greatest(acc["last"], x["high"]).alias("last"))

    pair = pair.withColumn("fit", F.aggregate("spans", start, step))
    found = pair.select(F.col("id").alias("doc_id"), "text_key", "item_id", F.col("fit.covered").alias("covered_tokens"), "n_tokens", F.col("fit.longest").alias("longest_run"), "literal_windows")
    return found.where((F.col("covered_tokens") >= COVERAGE * F.col("n_tokens")) | (F.col("longest_run") >= LONG_RUN))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that no item contaminates, with all their columns. Only those with a contaminated text's key in a bitmap are moved for it."""
    key, of, own = fresh(docs, "_contaminated", "_of", "_own")
    bad = cut(contaminated(docs, benchmark).select(F.col("text_key").alias(key), F.col("doc_id").alias(of)).distinct())
    screen, schema = bitmap(bad, key), docs.schema

    def held(inside: bool) -> DataFrame:
        def run(part: pa.RecordBatch) -> pa.RecordBatch:
            return part.filter(pa.array(in_bitmap(screen, part.column(own).to_numpy()) == inside)).select(schema.names)

        return docs.withColumn(own, F.xxhash64("text")).mapInArrow(T.mapper(run), schema)

    doubt = held(True)
    clean = doubt.join(bad, (F.xxhash64(doubt["text"]) == F.col(key)) & doubt["doc_id"].cast("long").eqNullSafe(F.col(of)), "left_anti")
    return held(False).union(clean)
