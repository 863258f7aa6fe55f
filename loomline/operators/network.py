"""The network over windows and entities: a local encoder of each window, and messages along typed edges.

Weights are seeded NumPy arrays, a few MB whatever the data, broadcast to the tasks.
Vectors are double arrays. The local encoder sees one window at a time, at most
``MOST_POSITIONS`` places of it. Edges meet in blocks, to which each vector goes once;
sums over the edges of a node are formed in its blocks first, so a
node with a third of all edges is no one task's.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

MOST_POSITIONS = 150
#: Edges of a block, about, and of those weighed at once.
EDGES, STEP = 1 << 18, 1 << 16


def _linear(rng: np.random.Generator, n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    return rng.uniform(-1, 1, (n, m)) / np.sqrt(n), rng.uniform(-1, 1, m) / np.sqrt(n)


def _normal(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class LocalEncoder:
    """Self-attention over the places of a window: projection, sinusoids, ``layers`` layers of attention and a network, each added and normalised."""

    def __init__(self, inputs: int, size: int = 256, heads: int = 8, layers: int = 2, inner: int = 512, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.size, self.heads = size, heads
        self.first = _linear(rng, inputs, size)
        self.layers = [{"in": _linear(rng, size, 3 * size), "out": _linear(rng, size, size), "up": _linear(rng, size, inner), "down": _linear(rng, inner, size)} for _ in range(layers)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x @ self.first[0] + self.first[1]
        angle = np.arange(len(x))[:, None] * 10000.0 ** (-np.arange(0, self.size, 2) / self.size)
        x[:, 0::2] += np.sin(angle)
        x[:, 1::2] += np.cos(angle[:, : self.size // 2])
        for w in self.layers:
            q, k, v = ((x @ w["in"][0] + w["in"][1]).reshape(len(x), 3, self.heads, -1)[:, i].swapaxes(0, 1) for i in range(3))
            seen = (softmax(q @ k.swapaxes(1, 2) / np.sqrt(q.shape[-1])) @ v).swapaxes(0, 1).reshape(len(x), -1)
            x = _normal(x + seen @ w["out"][0] + w["out"][1])
            x = _normal(x + np.maximum(x @ w["up"][0] + w["up"][1], 0) @ w["down"][0] + w["down"][1])
        return x


def encode_windows(records: DataFrame, encoder: LocalEncoder, by_count: bool = True, most: int = MOST_POSITIONS) -> DataFrame:
    """(wid, pos, encoded) of the records (wid, pos, count, vec) of each window, in the order of pos.

    Each record stands ``count`` times before it is encoded, and gets the mean over its places. Places beyond
    ``most`` are not seen; a record that has none is all zeros. Without ``by_count`` each stands once.
    """
    count = F.greatest(F.col("count").cast("long"), F.lit(1)) if by_count else F.lit(1).cast("long")
    window = records.groupBy("wid").agg(F.sort_array(F.collect_list(F.struct("pos", count.alias("count"), F.col("vec").cast("array<double>").alias("vec")))).alias("r"))
    shared = records.sparkSession.sparkContext.broadcast(encoder)

    def run(batches):
        for batch in batches:
            for wid, counts, vectors, places in zip(*(batch.column(i) for i in range(4))):
                n = np.minimum(counts.values.to_numpy(), most)
                last = np.minimum(np.cumsum(n), most)
                n = np.diff(np.r_[0, last])
                x = vectors.values.flatten().to_numpy().reshape(len(n), -1)
                seen = shared.value(np.repeat(x, n, axis=0))
                out = np.zeros((len(n), seen.shape[1]))
                some = n > 0
                out[some] = np.add.reduceat(seen, (last - n)[some], axis=0) / n[some, None]
                yield pa.RecordBatch.from_arrays([pa.array([wid.as_py()] * len(n)), places.values, pa.array(list(out), pa.list_(pa.float64()))], ["wid", "pos", "encoded"])

    kinds = dict(records.dtypes)
    return window.select("wid", "r.count", "r.vec", "r.pos").mapInArrow(run, f"wid {kinds['wid']}, pos {kinds['pos']}, encoded array<double>")


class TypedLayer:
    """Weights of one layer of messages: maps of each kind of node, and of each relation (from kind, to kind)."""

    def __init__(self, relations: dict[str, tuple[str, str]], size: int = 256, heads: int = 8, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.relations, self.size, self.heads, d = relations, size, heads, size // heads
        kinds = sorted({k for pair in relations.values() for k in pair})
        self.kinds = {k: {name: _linear(rng, size, size) for name in ("key", "query", "value", "out")} for k in kinds}
        self.maps = {r: {"key": rng.normal(0, d**-0.5, (heads, d, d)), "value": rng.normal(0, d**-0.5, (heads, d, d)), "weight": np.ones(heads)} for r in sorted(relations)}

    def _split(self, kind: str, name: str, x: np.ndarray) -> np.ndarray:
        w, b = self.kinds[kind][name]
        return (x @ w + b).reshape(len(x), self.heads, -1)

    def query(self, kind: str, x: np.ndarray) -> np.ndarray:
        return self._split(kind, "query", x).reshape(len(x), -1)

    def sent(self, relation: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and messages of nodes along a relation."""
        kind, maps = self.relations[relation][0], self.maps[relation]
        key = np.einsum("nhd,hde->nhe", self._split(kind, "key", x), maps["key"]) * maps["weight"][None, :, None]
        return key.reshape(len(x), -1), np.einsum("nhd,hde->nhe", self._split(kind, "value", x), maps["value"]).reshape(len(x), -1)

    def scores(self, query: np.ndarray, key: np.ndarray) -> np.ndarray:
        n = len(query)
        return (query.reshape(n, self.heads, -1) * key.reshape(n, self.heads, -1)).sum(-1) / np.sqrt(self.size // self.heads)

    def updated(self, kind: str, x: np.ndarray, received: np.ndarray) -> np.ndarray:
        """Half of the node as it was and half of what it has received, through a smooth rectifier and its map."""
        w, b = self.kinds[kind]["out"]
        smooth = received * 0.5 * (1 + np.tanh(np.sqrt(2 / np.pi) * (received + 0.044715 * received**3)))
        return 0.5 * (smooth @ w + b) + 0.5 * x


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of one length, as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(np.ascontiguousarray(x).ravel()))


def _merge(first: np.ndarray, top: np.ndarray, total: np.ndarray, message: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of rows that begin at ``first`` as one each: sums of exponentials by head, and of messages, each relative to its own top."""
    most = np.maximum.reduceat(top, first, axis=0)
    scale = np.exp(top - np.repeat(most, np.diff(np.r_[first, len(top)]), axis=0))
    weighted = message.reshape(len(top), top.shape[1], -1) * scale[:, :, None]
    return most, np.add.reduceat(total * scale, first, axis=0), np.add.reduceat(weighted, first, axis=0).reshape(len(first), -1)


def _meet(edges: pa.Table, ends: pa.Table, layer: TypedLayer, schema: pa.Schema) -> pa.Table:
    """Of the edges of a block that lead to one node: the top score of each head, the sum of exponentials, and that of messages."""
    out = []
    x, kinds, ids = _rows(ends["x"]), ends["kind"].combine_chunks(), ends["id"].combine_chunks()
    at = {k: np.flatnonzero(pc.equal(kinds, k).to_numpy(zero_copy_only=False)) for k in pc.unique(kinds).to_pylist()}
    for relation in pc.unique(edges["relation"]).to_pylist():
        source, target = layer.relations[relation]
        if source not in at or target not in at:
            continue
        rows = edges.filter(pc.equal(edges["relation"], relation))
        found = [pc.fill_null(pc.index_in(rows[c], value_set=ids.take(pa.array(at[k]))), -1).to_numpy() for c, k in (("src", source), ("dst", target))]
        known = (found[0] >= 0) & (found[1] >= 0)
        order = np.argsort(found[1][known], kind="stable")
        src, dst = (f[known][order] for f in found)
        query = layer.query(target, x[at[target]])
        key, message = layer.sent(relation, x[at[source]])
        for a in range(0, len(src), STEP):
            s, d = src[a : a + STEP], dst[a : a + STEP]
            first = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            score = layer.scores(query[d], key[s])
            merged = _merge(first, score, np.ones_like(score), message[s])
            named = ids.take(pa.array(at[target][d[first]]))
            out.append(pa.table([pa.array([target] * len(first), pa.string()), named, *map(_lists, merged), pa.nulls(len(first), pa.list_(pa.float64()))], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def _updates(layer: TypedLayer):
    """Over a partition in order of (kind, id), each node with all that it receives; what a batch ends with waits for the next."""

    def of(table: pa.Table) -> pa.RecordBatch:
        kind, ids = table["kind"].combine_chunks(), table["id"].combine_chunks()
        own = table["x"].combine_chunks().is_valid().to_numpy(zero_copy_only=False)
        run = np.cumsum(_changes(kind, ids)) - 1
        received = np.zeros((run[-1] + 1, layer.size))
        if not own.all():
            parts, of_run = table.filter(pa.array(~own)), run[~own]
            first = np.flatnonzero(np.r_[True, of_run[1:] != of_run[:-1]])
            _, total, message = _merge(first, *(_rows(parts[c]) for c in ("top", "total", "message")))
            received[of_run[first]] = (message.reshape(len(first), layer.heads, -1) / total[:, :, None]).reshape(len(first), -1)
        nodes, received = table.filter(pa.array(own)), received[run[own]]
        x, kinds = _rows(nodes["x"]).copy(), nodes["kind"].combine_chunks()
        for k in pc.unique(kinds).to_pylist():
            mine = pc.equal(kinds, k).to_numpy(zero_copy_only=False)
            x[mine] = layer.updated(k, x[mine], received[mine])
        return pa.RecordBatch.from_arrays([kinds, nodes["id"].combine_chunks(), _lists(x)], ["kind", "id", "x"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            last = int(np.flatnonzero(_changes(table["kind"].combine_chunks(), table["id"].combine_chunks()))[-1])
            if last:
                yield of(table.slice(0, last))
            held = table.slice(last)
        if held is not None:
            yield of(held)

    return run


def _changes(*columns: pa.Array) -> np.ndarray:
    """Whether a row differs from the one before it."""
    return np.r_[True, np.any([pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in columns], axis=0)]


def dealt(nodes: DataFrame, edges: DataFrame, relations: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """Edges (block, src, relation, dst) in blocks of some ``EDGES``, and the ends (block, kind, id) of each block, once.

    A block has all edges of its nodes of the kind that has more of them, so a vector goes once to
    each block where it is needed and not along every edge. A node of over an eighth of ``EDGES`` is dealt to several blocks.
    """
    many = {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()}  # a row for each kind
    edges = edges.where(F.col("relation").isin(*relations)).select("src", "relation", "dst")
    by_src = [r for r, (source, target) in relations.items() if many.get(source, 0) >= many.get(target, 0)]
    first = F.col("relation").isin(*by_src) if by_src else F.lit(False)
    edges = edges.withColumns({"_own": F.when(first, F.col("src")).otherwise(F.col("dst")), "_other": F.when(first, F.col("dst")).otherwise(F.col("src"))})
    part = max(EDGES // 8, 1)
    counts = written(edges.groupBy("_own").agg(F.count(F.lit(1)).alias("_n")))
    blocks = max(1, -(-(counts.agg(F.sum("_n")).first()[0] or 0) // EDGES))
    heavy = counts.where(F.col("_n") > part)
    share = F.coalesce(F.pmod(F.xxhash64("_other"), F.ceil(F.col("_n") / part)), F.lit(0))
    edges = edges.join(F.broadcast(heavy), "_own", "left").select(F.pmod(F.xxhash64("_own", share), F.lit(blocks)).alias("block"), "src", "relation", "dst")
    kind = lambda end: F.element_at(F.create_map(*[F.lit(v) for r, pair in relations.items() for v in (r, pair[end])]), F.col("relation"))
    both = F.explode(F.array(F.struct(kind(0).alias("kind"), F.col("src").alias("id")), F.struct(kind(1).alias("kind"), F.col("dst").alias("id")))).alias("e")
    return edges, written(edges.select("block", both).select("block", "e.kind", "e.id").distinct())


def pass_messages(nodes: DataFrame, edges: DataFrame, layer: TypedLayer, ends: DataFrame | None = None) -> DataFrame:
    """(kind, id, x) after one layer; ``nodes`` is the same before it, ``edges`` has (src, relation, dst), or is what :func:`dealt` gives, with its ``ends``.

    A node weighs the messages of all its edges by one softmax a head. Nodes without
    an edge receive zeros. Edges whose ends are not among the nodes are left out.
    """
    if ends is None:
        edges, ends = dealt(nodes, edges, layer.relations)
    shared = nodes.sparkSession.sparkContext.broadcast(layer)
    ids, lists = dict(nodes.dtypes)["id"], "top array<double>, total array<double>, message array<double>, x array<double>"
    schema = pa.schema([("kind", pa.string()), ("id", pa.int64() if ids == "bigint" else pa.int32() if ids == "int" else pa.string()), *[(c, pa.list_(pa.float64())) for c in ("top", "total", "message", "x")]])
    given = ends.join(nodes.hint("merge"), ["kind", "id"]).select("block", "kind", "id", "x")
    parts = edges.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(lambda e, g: _meet(e, g, shared.value, schema), f"kind string, id {ids}, {lists}")
    none = F.lit(None).cast("array<double>")
    rows = parts.unionByName(nodes.select("kind", "id", *[none.alias(c) for c in ("top", "total", "message")], "x"))
    rows = rows.repartition("kind", "id").sortWithinPartitions("kind", "id")
    return rows.mapInArrow(lambda batches: _updates(shared.value)(batches), f"kind string, id {ids}, x array<double>")
