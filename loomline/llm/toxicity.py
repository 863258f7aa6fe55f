"""Toxic passages as maximum-scoring segments of token log-odds.

Training counts how often each token, and each byte prefix of it in
``PREFIXES``, stands in toxic and in other labelled texts. The posterior rate
of a token has a Dirichlet prior centred on that of its longest prefix, and so
on down to the overall rate; its logit, less the overall one and ``DRIFT``, is
the token's score. A linear-time scan (Ruzzo and Tompa's) finds all maximal
scoring segments. Segment maxima of texts without toxicity follow an extreme
value law, P(max < S) = exp(-K n exp(-lambda S)) for n tokens; lambda and K
are fitted on labelled texts whose tokens were not counted. A segment is
significant if its expected number of equals by chance is under ``E_VALUE``.
The excess bits of a text's best segment and of all its segments go through a
logistic curve fitted on those same texts.

Labels come from at most about ``LABEL_BOUND`` rows, chosen by a hash of
doc_id; rows whose crc32(doc_id) mod 5 is 0 are never read for learning, and
those with 4 calibrate. Texts only make the score. Null and empty texts score
as texts without tokens. Without labels of both kinds every score is the
share of toxic labels (0 if none). Repeated rows are scored one by one; extra
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .common import bounded_sample, cut

PREFIXES = (5, 7, 9, None)
BUCKET_BITS = 20
PRIOR = 5.0
DRIFT = 0.5
E_VALUE = 0.05
LABEL_BOUND = 100_000
FOLDS = 5

SCORED = "doc_id long, held_out boolean, score double, predicted int, n_passages long, passages string"


@dataclass
class Model:
    """Counts by bucket, the share of toxic tokens and of toxic labels, the extreme-value law and the logistic curve."""

    seen: np.ndarray
    toxic: np.ndarray
    rate: float
    share: float = 0.0
    lam: float = 1.0
    k: float = 1.0
    curve: tuple[float, float, float] | None = None


def fold(doc_id="doc_id"):
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))


def _buckets(spans: T.Spans, start: np.ndarray, end: np.ndarray):
    for n in PREFIXES:
        to = end if n is None else np.minimum(end, start + n)
        yield (T.mix(spans.hash(start, to) + np.uint64(n or 0)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _tokens(column: pa.Array):
    data, offsets = T.utf8(column)
    low = T.lowered(column)
    start, end, doc = T.words(low, offsets, T.IS_APART)
    return data, offsets, start, end, doc, T.Spans(low)


def token_scores(model: Model, spans: T.Spans, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    p = np.full(len(start), model.rate)
    for bucket in _buckets(spans, start, end):
        p = (model.toxic[bucket] + PRIOR * p) / (model.seen[bucket] + PRIOR)
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p)) - np.log(model.rate / (1 - model.rate)) - DRIFT


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, sum); only tokens that score above 0 are looped over."""
    at = np.flatnonzero(scores > 0)
    total = np.concatenate([[0.0], np.cumsum(scores)])
    left, right, first, last, above = [], [], [], [], []
    for k in at.tolist():
        l, r, a = total[k], total[k + 1], k
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= l:
                j = above[j]
            if j < 0 or right[j] >= r:
                break
            l, a = left[j], first[j]
            del left[j:], right[j:], first[j:], last[j:], above[j:]
        left.append(l)
        right.append(r)
        first.append(a)
        last.append(k + 1)
        above.append(j)
    return [(a, z, r - l) for l, r, a, z in zip(left, right, first, last)]


def _by_doc(model: Model, column: pa.Array):
    """For each document: number of tokens, its segments, and the tokens' byte spans."""
    data, offsets, start, end, doc, spans = _tokens(column)
    scores = token_scores(model, spans, start, end)
    border = np.searchsorted(doc, np.arange(len(offsets)))
    for i, (a, z) in enumerate(zip(border[:-1], border[1:])):
        yield z - a, segments(scores[a:z]), start[a:z], end[a:z], data, offsets[i]


def _excess(model: Model, n: int, sums: list[float]) -> tuple[float, float]:
    """Nats by which the best segment, and all together, pass what chance makes."""
    floor = np.log(model.k * max(n, 1))
    over = [model.lam * s - floor for s in sums]
    return max(over, default=-floor), float(np.log1p(sum(x for x in over if x > 0)))


def _law(n: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """Maximum likelihood lambda and K of the extreme value law."""
    def at(lam):
        k = len(n) / np.sum(n * np.exp(-lam * best))
        return np.sum(np.log(k * lam * n) - lam * best) - len(n), k

    grid = np.geomspace(0.02, 20, 400)
    lam = grid[int(np.argmax([at(x)[0] for x in grid]))]
    return float(lam), float(at(lam)[1])


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Newton's method with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-2 * np.eye(len(w)), x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """``labels`` has doc_id and toxic; only the training folds are read."""
    context = docs.sparkSession.sparkContext
    usable = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold() != 0)
    chosen = bounded_sample(usable, "doc_id", LABEL_BOUND)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    size = 1 << BUCKET_BITS

    def count(batches):
        seen, toxic = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for part in T.chunks(batches):
            _, _, start, end, doc, spans = _tokens(part.column("text"))
            bad = part.column("toxic").to_numpy()[doc] == 1
            for bucket in _buckets(spans, start, end):
                np.add.at(seen, bucket, 1)
                np.add.at(toxic, bucket[bad], 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": at, "seen": seen[at], "toxic": toxic[at]})

    fitted = rows.where(fold() < FOLDS - 1).select("text", "toxic").mapInArrow(count, "bucket long, seen long, toxic long")
    table = fitted.groupBy("bucket").agg(F.sum("seen").alias("seen"), F.sum("toxic").alias("toxic")).toArrow()
    seen, toxic = np.zeros(size, np.float32), np.zeros(size, np.float32)
    at = table["bucket"].to_numpy()
    seen[at], toxic[at] = table["seen"].to_numpy(), table["toxic"].to_numpy()
    share = float(chosen.agg(F.avg("toxic")).first()[0] or 0.0)
    if not 0 < toxic.sum() < seen.sum():
        return Model(seen, toxic, 0.0, share)
    model = Model(seen, toxic, float(toxic.sum(dtype=float) / seen.sum(dtype=float)), share)
    shared = context.broadcast(model)

    def measure(part: pa.RecordBatch) -> pa.RecordBatch:
        n, sums = zip(*((n, [s for *_, s in found]) for n, found, *_ in _by_doc(shared.value, part.column("text"))))
        return pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "sums": pa.array(sums, pa.list_(pa.float64())), "toxic": part.column("toxic")})

    # As many rows as labels calibrate, LABEL_BOUND / 4 or so; the driver sees a few numbers of each and no list of segments.
    measured = cut(rows.where(fold() == FOLDS - 1).select("text", "toxic").mapInArrow(T.mapper(measure), "n long, sums array<double>, toxic int"))
    best = measured.select("n", "toxic", F.coalesce(F.array_max("sums"), F.lit(0.0)).alias("best")).toArrow()
    n, y = best["n"].to_numpy(), best["toxic"].to_numpy()
    if not 0 < y.sum() < len(y):
        return model
    clean = (y == 0) & (n > 0)
    if clean.any():
        model.lam, model.k = _law(n[clean].astype(float), best["best"].to_numpy()[clean])
    floor = F.log(F.lit(model.k) * F.greatest("n", F.lit(1)))
    over = measured.select("toxic", floor.alias("floor"), F.transform("sums", lambda s: s * model.lam - floor).alias("over"))
    above = F.aggregate("over", F.lit(0.0), lambda total, x: total + F.greatest(x, F.lit(0.0)))
    points = over.select("toxic", F.coalesce(F.array_max("over"), -F.col("floor")).alias("a"), F.log1p(above).alias("b")).toArrow()
    model.curve = _logistic(np.column_stack([points["a"].to_numpy(), points["b"].to_numpy()]), points["toxic"].to_numpy())
    return model


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Score, verdict and significant passages (code points, start:end) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(part: pa.RecordBatch) -> pa.RecordBatch:
        m: Model = shared.value
        score, count, passages = [], [], []
        for n, found, start, end, data, offset in _by_doc(m, part.column("text")) if 0 < m.rate < 1 else (((0, [], None, None, None, 0),) * part.num_rows):
            if m.curve is None:
                score.append(m.share)
            else:
                a, b = _excess(m, n, [s for *_, s in found])
                score.append(float(1 / (1 + np.exp(-np.clip(m.curve[0] + m.curve[1] * a + m.curve[2] * b, -30, 30)))))
            limit = np.log(m.k * max(n, 1)) - np.log(E_VALUE)
            real = [(start[a], end[z - 1]) for a, z, s in found if m.lam * s >= limit]
            count.append(len(real))
            if real:
                place = np.concatenate([[0], np.cumsum((data[offset : real[-1][1]] & 0xC0) != 0x80)])
                passages.append(",".join(f"{place[a - offset]}:{place[z - offset]}" for a, z in real))
            else:
                passages.append("")
        held = part.column("fold").to_numpy() == 0
        score = np.array(score)
        return pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "held_out": held, "score": score, "predicted": (score >= 0.5).astype(np.int32), "n_passages": pa.array(count, pa.int64()), "passages": pa.array(passages, pa.string())})

    # A null doc_id has no fold and counts as trained on, never as held out.
    return docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(fold(), F.lit(1)).cast("long").alias("fold")).mapInArrow(T.mapper(judge), SCORED)
