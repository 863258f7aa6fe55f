"""The window, line and entity graph as tables, and searches on it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Distinct sets of hot entities in a block: so many for up to 16 blocks, up to 8 times as many beyond.
SET_BLOCK = 2048
#: Sets whose overlaps with a block are found at once, sets of the other block that give the first bounds, entities of a matrix, and the share of pairs that hold an entity from which on a product of matrices is faster.
STRIPE, AHEAD, COLUMNS, DENSE = 128, 2048, 1024, 0.004


def nodes(windows: DataFrame, records: DataFrame, window_entities: DataFrame, most_text: int = 200) -> DataFrame:
    """(node_type, node_id, content) of windows (wid, label), lines, labels and entities, each once."""
    def node(df, kind, value, content):
        return df.select(F.lit(kind).alias("node_type"), F.concat(F.lit(kind + ":"), value).alias("node_id"), content.alias("content")).distinct()

    line_id = F.concat_ws("_", "wid", F.col("log_idx").cast("string"))
    out = node(windows, "Window", F.col("wid"), F.col("wid"))
    out = out.union(node(windows, "Anomaly", F.col("label"), F.col("label")))
    out = out.union(node(records, "LogInstance", line_id, F.substring("raw_line", 1, most_text)))
    entities = window_entities.select("entity_type", "entity").distinct()
    return out.union(entities.select(F.col("entity_type").alias("node_type"), F.concat_ws(":", "entity_type", "entity").alias("node_id"), F.col("entity").alias("content")))


def edges(windows: DataFrame, records: DataFrame, line_entities: DataFrame) -> DataFrame:
    """(src, dst, relation): windows contain lines and entities, lines go with entities, windows have labels; each once."""
    window = F.concat(F.lit("Window:"), F.col("wid"))
    line = F.concat(F.lit("LogInstance:"), F.concat_ws("_", "wid", F.col("log_idx").cast("string")))
    entity = F.concat_ws(":", "entity_type", "entity")
    out = records.select(window.alias("src"), line.alias("dst"), F.lit("CONTAINS").alias("relation"))
    out = out.union(line_entities.select(window, entity, F.lit("CONTAINS")).distinct())
    out = out.union(line_entities.select(line, entity, F.lit("ASSOCIATED_WITH")).distinct())
    return out.union(windows.select(window, F.concat(F.lit("Anomaly:"), F.col("label")), F.lit("HAS_ANOMALY")))


def belongs_to(entities: DataFrame) -> DataFrame:
    """(region, consensus_group): regions and consensus groups of the same number, of those that exist."""
    entities = written(entities.where("entity_type in ('DataRegion', 'ConsensusGroup')").select("entity_type", "entity").distinct())
    regions = entities.where("entity_type = 'DataRegion'").select("entity", F.regexp_extract("entity", r"^DataRegion:(\d+)$", 1).alias("id")).where("id <> ''").distinct()
    groups = entities.where("entity_type = 'ConsensusGroup'").select("entity", F.regexp_extract("entity", r"^DataRegion:(\d+)$", 1).alias("id")).where("id <> ''").distinct()
    return regions.alias("r").join(groups.alias("g"), "id").select(F.col("r.entity").alias("region"), F.col("g.entity").alias("consensus_group"))


def reverse(edge_table: DataFrame, relation: str) -> DataFrame:
    """Edges of a relation the other way round."""
    return edge_table.where(F.col("relation") == relation).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit("REVERSE_" + relation).alias("relation"))


def hot_entities(window_entity: DataFrame, most: int) -> DataFrame:
    """Entities of more than ``most`` windows; input is the distinct (wid, entity)."""
    return window_entity.groupBy("entity").agg(F.count(F.lit(1)).alias("coverage")).where(F.col("coverage") > most)


class _Block:
    """Distinct sets of one block in order of their first windows' names: their numbers of entities as (row, value)."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pc.sort_indices(rows["first"]))
        hot = rows["hot"].combine_chunks()
        self.n, self.set, self.first = len(rows), rows["set"].to_numpy(), rows["first"].combine_chunks()
        self.row = np.repeat(np.arange(self.n), pc.list_value_length(hot).to_numpy())
        self.value = hot.flatten().to_numpy()


def _holders(a: _Block, b: _Block):
    """(columns of ``a``'s values, -1 for those left out, and of ``b``'s, weights): entities that the same sets of both blocks hold are one column of that weight."""
    values = np.concatenate([a.value, b.value])
    held = np.bincount(values) > 0
    known, where = int(held.sum()), (np.cumsum(held) - 1)[values]
    where = where.astype(np.uint16) if known <= 1 << 16 else where  # short numbers are sorted faster
    rows = np.concatenate([a.row, a.n + b.row]).astype(np.int32)[np.argsort(where, kind="stable")]
    ends = np.cumsum(np.bincount(where, minlength=known)).tolist()
    columns, column, weights = {}, np.full(known, -1), []
    for i, (start, end) in enumerate(zip([0, *ends], ends)):
        same = columns.setdefault(rows[start:end].tobytes(), len(weights))
        if same == len(weights):
            column[i] = same
            weights.append(0)
        weights[same] += 1
    column = column[where]
    return column[: len(a.value)], column[len(a.value) :], np.array(weights, np.float32)


def _overlaps(a: _Block, b: _Block):
    """(start, overlaps): STRIPE sets of ``a`` at a time against all of ``b``. Common entities by products of matrices, the others by their holders."""
    mine, theirs, weights = _holders(a, b)
    a_row, mine, b_row, theirs = a.row[mine >= 0], mine[mine >= 0], b.row[theirs >= 0], theirs[theirs >= 0]
    in_a, in_b = np.bincount(mine, minlength=len(weights)), np.bincount(theirs, minlength=len(weights))
    dense = in_a * in_b > DENSE * a.n * b.n
    sparse, column, width = ~dense & (in_b > 0), np.cumsum(dense) - 1, int(dense.sum())
    ends = np.cumsum(in_b)
    short = theirs.astype(np.uint16) if len(weights) <= 1 << 16 else theirs
    holders = np.split(b_row[np.argsort(short, kind="stable")], ends[:-1])

    def matrix(n: int, rows: np.ndarray, values: np.ndarray, first: int, value) -> np.ndarray:
        at = column[values] - first
        pick = dense[values] & (at >= 0) & (at < COLUMNS)
        out = np.zeros((n, min(COLUMNS, width - first)), np.float32)
        out[rows[pick], at[pick]] = value[values[pick]]
        return out

    ones = np.ones_like(weights)
    kept = matrix(b.n, b_row, theirs, 0, ones) if 0 < width <= COLUMNS else None
    for start in range(0, a.n, STRIPE):
        part = slice(*np.searchsorted(a_row, [start, start + STRIPE]))
        rows, values = a_row[part] - start, mine[part]
        out = np.zeros((min(STRIPE, a.n - start), b.n), np.float32)
        for first in range(0, width, COLUMNS):
            out += matrix(len(out), rows, values, first, weights) @ (matrix(b.n, b_row, theirs, first, ones) if kept is None else kept).T
        pick = sparse[values]
        for i, j in zip(rows[pick].tolist(), values[pick].tolist()):
            out[i, holders[j]] += weights[j]  # a set holds an entity once
        yield start, out


def _ahead(overlaps: np.ndarray, k: int):
    """(row, column, overlap) of the k largest overlaps of one at least in each row, ties by column."""
    n = overlaps.shape[1]
    if (float(overlaps.max(initial=0)) + 1) * n >= 1 << 24:
        overlaps = overlaps.astype(np.float64)
    keys = overlaps * overlaps.dtype.type(n)
    keys += np.arange(n - 1, -1, -1, dtype=overlaps.dtype)
    keys = (np.partition(keys, n - k, axis=1)[:, -k:] if n > k else keys).astype(np.int64)
    row, at = np.nonzero(keys >= n)
    keys = keys[row, at]
    return row, n - 1 - keys % n, keys // n


class _Best:
    """The k best of each row so far; columns come in order of name, so a later one must have a larger overlap than the k-th."""

    def __init__(self, n: int, k: int):
        self.k, self.floor = k, np.zeros(n, np.float32)
        self.found, self.more = [np.zeros(0, np.int64)] * 3, []

    def add(self, row: np.ndarray, column: np.ndarray, overlap: np.ndarray):
        self.more.append((row, column, overlap.astype(np.int64)))

    def settle(self):
        """(row, column, overlap) of the best, and with them the bounds for what comes."""
        row, column, overlap = (np.concatenate(x) for x in zip(self.found, *self.more))
        order = np.lexsort((column, -overlap, row))
        row = row[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        order, row, rank = order[rank < self.k], row[rank < self.k], rank[rank < self.k]
        self.found, self.more = [row, column[order], overlap[order]], []
        last = rank == self.k - 1
        self.floor[row[last]] = self.found[2][last]
        return self.found


def _meet(sets: pa.Table, asked: pa.Table, k: int) -> pa.Table:
    """For each set of a pair of blocks the k sets of the other with the largest overlap, ties by first window; and, without ``first``, the overlaps asked for."""
    own, lo, hi = (sets[c].to_numpy() for c in ("block", "lo", "hi"))
    a = _Block(sets.filter(pa.array(own == lo)))
    same = bool(len(own)) and lo[0] == hi[0]
    b = a if same else _Block(sets.filter(pa.array(own == hi)))
    left, right = asked["l"].to_numpy(), asked["r"].to_numpy()
    order_a, order_b = np.argsort(a.set), np.argsort(b.set)
    row = order_a[np.searchsorted(a.set, left, sorter=order_a)] if len(left) else np.zeros(0, np.int64)
    col = order_b[np.searchsorted(b.set, right, sorter=order_b)] if len(left) else np.zeros(0, np.int64)
    by_row = np.argsort(row, kind="stable")
    out, theirs, settled = [], _Best(b.n, k), 0

    def give(x: _Block, y: _Block, r: np.ndarray, c: np.ndarray, overlap: np.ndarray):
        out.append(pa.table([x.set[r], y.set[c], y.first.take(pa.array(c)), overlap], ["set", "other", "first", "score"]))

    for start, overlaps in _overlaps(a, b):
        stop = start + len(overlaps)
        mine = _Best(len(overlaps), k)
        mine.add(*_ahead(np.ascontiguousarray(overlaps[:, :AHEAD]), k))
        mine.settle()
        r, c = np.divmod(np.flatnonzero(overlaps[:, AHEAD:] > mine.floor[:, None]), max(b.n - AHEAD, 1))
        mine.add(r, AHEAD + c, overlaps[r, AHEAD + c])
        r, c, overlap = mine.settle()
        give(a, b, start + r, c, overlap)
        if not same:
            if start == 0:
                c, r, overlap = _ahead(np.ascontiguousarray(overlaps.T), k)
            else:
                r, c = np.divmod(np.flatnonzero(overlaps > theirs.floor), b.n)
                overlap = overlaps[r, c]
            theirs.add(c, start + r, overlap)
            if stop >= 2 * settled or stop == a.n:  # bounds need not be new at each stripe
                settled = stop
                theirs.settle()
        now = by_row[slice(*np.searchsorted(row[by_row], [start, stop]))]
        out.append(pa.table([left[now], right[now], pa.nulls(len(now), pa.string()), overlaps[row[now] - start, col[now]].astype(np.int64)], ["set", "other", "first", "score"]))
    if not same:
        c, r, overlap = theirs.found
        give(b, a, c, r, overlap)
    return pa.concat_tables(out).select(["set", "other", "first", "score"])


def _numbered_hot(window_entity: DataFrame, most: int) -> DataFrame:
    """(entity, number) of hot entities: a rank within one of 256 buckets by hash and the bucket, so no task ranks all."""
    bucket = F.pmod(F.xxhash64("entity"), F.lit(256))
    rank = F.row_number().over(W.partitionBy("_bucket").orderBy("entity"))
    return hot_entities(window_entity, most).withColumn("_bucket", bucket).select("entity", ((rank - 1) * 256 + F.col("_bucket")).cast("int").alias("number"))


def shared_entity_scores(window_entity: DataFrame, most: int, k: int, within: list[str] | None = None) -> DataFrame:
    """(wid, neighbor, score): number of shared entities, for pairs of windows that hold each window's k best.

    Pairs that share an entity of at most ``most`` windows come from a join over
    such entities, so these make at most ``most`` squared rows each. Windows of one set of
    hot entities are alike in these; distinct sets, as arrays of numbers, meet in pairs of
    blocks. A task adds the overlaps of the pairs that the join has found and gives the k + 1
    best sets for each set, of which the windows that come first by name are taken.
    So ``most`` changes the work and never the k best. ``within`` names columns that both windows must agree on.
    """
    within, first = within or [], k + 1
    window_entity = written(window_entity)  # read by every branch below, found once
    hot = written(_numbered_hot(window_entity, most))
    rare = window_entity.join(hot, "entity", "left_anti")
    a = rare.select(F.col("wid"), "entity", *within)
    b = rare.select(F.col("wid").alias("neighbor"), "entity", *within)
    pairs = a.join(b.hint("merge"), ["entity", *within]).where("wid < neighbor").groupBy("wid", "neighbor").agg(F.count(F.lit(1)).alias("rare"))

    sets = window_entity.join(hot, "entity").groupBy("wid", *within).agg(F.sort_array(F.collect_set("number")).alias("hot"))
    marked = written(sets.withColumn("set", F.xxhash64(*within, "hot")))
    distinct = marked.groupBy("set", *within).agg(F.min("wid").alias("first"), F.first("hot").alias("hot"))
    n = F.count_distinct("set")
    blocks = F.greatest(F.ceil(n / (8 * SET_BLOCK)), F.least(F.ceil(n / SET_BLOCK), F.lit(16)))
    groups = marked.groupBy(*within).agg(blocks.alias("blocks")).where("blocks > 0")
    with_blocks = lambda df: df.join(F.broadcast(groups), within) if within else df.crossJoin(F.broadcast(groups))
    block = lambda name: F.pmod(F.xxhash64(name), F.col("blocks"))
    distinct = with_blocks(distinct).withColumn("block", block("set"))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("with")
    dealt = distinct.select("set", "hot", "first", "block", *within, meets).select("set", "hot", "first", "block", *within, F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))

    held = with_blocks(marked.select("wid", "set", *within)).select("wid", "set", block("set").alias("block"), *within)
    mine = held.select("wid", F.col("set").alias("s1"), F.col("block").alias("b1"), *within)
    theirs = held.select(F.col("wid").alias("neighbor"), F.col("set").alias("s2"), F.col("block").alias("b2"))
    pairs = pairs.join(mine.hint("merge"), "wid", "left").join(theirs.hint("merge"), "neighbor", "left")
    ends = [F.when(F.col("b1") <= F.col("b2"), F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("l", "s1", "s2"), ("r", "s2", "s1"))]
    pairs = written(pairs.select("wid", "neighbor", "rare", *within, *ends, F.least("b1", "b2").alias("lo"), F.greatest("b1", "b2").alias("hi"), (F.col("s1").isNotNull() & F.col("s2").isNotNull()).alias("hot")))
    asked = pairs.where("hot").select(*within, "lo", "hi", "l", "r").distinct()
    keys = [*within, "lo", "hi"]
    met = written(dealt.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(lambda sets, asked: _meet(sets, asked, first), "set long, other long, first string, score long"))

    known = met.where("first is null").select(F.col("set").alias("l"), F.col("other").alias("r"), "score")
    scored = pairs.join(known.hint("merge"), ["l", "r"], "left").select("wid", "neighbor", (F.col("rare") + F.coalesce("score", F.lit(0))).alias("score"))
    scored = scored.union(scored.select("neighbor", "wid", "score"))

    by_first = F.row_number().over(W.partitionBy("set").orderBy(F.desc("score"), "first"))
    best = met.where("first is not null").withColumn("rank", by_first).where(F.col("rank") <= first).drop("rank", "first")
    few = W.partitionBy("set").orderBy("wid")
    named = marked.select(F.col("set").alias("other"), F.col("wid").alias("neighbor"), F.row_number().over(few).alias("i")).where(F.col("i") <= first)
    rank = F.row_number().over(W.partitionBy("set").orderBy(F.desc("score"), "neighbor"))
    best = best.join(named.hint("merge"), "other").withColumn("rank", rank).where(F.col("rank") <= first).select("set", "neighbor", "score")
    alike = marked.select("wid", "set").join(best.hint("merge"), "set").where("wid <> neighbor").select("wid", "neighbor", "score")
    return scored.union(alike).groupBy("wid", "neighbor").agg(F.max("score").alias("score"))


def top_neighbors(scores: DataFrame, k: int) -> DataFrame:
    """The k best neighbours of each window, ties by name; adds rank from 1."""
    rank = F.row_number().over(W.partitionBy("wid").orderBy(F.desc("score"), "neighbor"))
    return scores.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def line_sets(line_entities: DataFrame) -> DataFrame:
    """(wid, log_idx, entities): the distinct entities of each line that has any, from (wid, log_idx, entity); lines that come with such arrays have theirs already."""
    if "entities" in line_entities.columns:
        return line_entities.where(F.size("entities") > 0).select("wid", "log_idx", "entities")
    return line_entities.groupBy("wid", "log_idx").agg(F.collect_set("entity").alias("entities"))


def _windows(sets: DataFrame) -> DataFrame:
    """(wid, held, lines, edges): the distinct entities of each window, its lines and their edges."""
    return sets.groupBy("wid").agg(F.array_distinct(F.flatten(F.collect_list("entities"))).alias("held"), F.count("log_idx").alias("lines"), F.sum(F.size("entities")).alias("edges"))


def ego_edges(targets: DataFrame, line_entities: DataFrame) -> DataFrame:
    """Edges of each target's subgraph over its own and its neighbours' windows.

    ``targets`` has (target, wid), the target itself among its windows. Rows
    have local numbers for windows, lines and entities, from 0 in order of name.

    Lines and entities are ranked once in their window, however many targets
    it has. A target ranks its windows and their distinct entities only, and its
    edges, which are many more, come from a join of both and are not sorted.
    """
    partitions = int(targets.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer, larger ones: rows are sorted in each
    targets, sets = targets.select("target", "wid").distinct(), line_sets(line_entities).repartition(partitions, "wid")
    window, target = W.partitionBy("wid"), W.partitionBy("target")
    line = F.row_number().over(window.orderBy("log_idx")) - 1
    rows = sets.select("wid", "log_idx", line.alias("_line"), "entities").select("wid", "log_idx", "_line", F.explode("entities").alias("entity"))
    rows = rows.withColumn("_entity", F.dense_rank().over(window.orderBy("entity")) - 1)

    by_name = target.orderBy("wid")
    before = F.coalesce(F.sum("lines").over(by_name.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    of = targets.join(_windows(sets).select("wid", "held", "lines").hint("merge"), "wid").repartition(partitions, "target")
    of = of.select("target", "wid", (F.row_number().over(by_name) - 1).cast("long").alias("window_no"), before.alias("_before"), "held")
    of = of.select("target", "wid", "window_no", "_before", F.explode("held").alias("entity"))
    of = of.select("target", "wid", "window_no", "_before", (F.dense_rank().over(target.orderBy("entity")) - 1).cast("long").alias("_no"))
    of = of.groupBy("target", "wid", "window_no", "_before").agg(F.sort_array(F.collect_list("_no")).alias("_numbers"))  # in order of name, as entities of a window
    return rows.join(of.hint("merge"), "wid").select("target", "wid", "log_idx", "entity", "window_no", (F.col("_before") + F.col("_line")).alias("line_no"), F.get("_numbers", F.col("_entity")).alias("entity_no"))


def ego_sizes(targets: DataFrame, line_entities: DataFrame) -> DataFrame:
    """(target, windows, lines, entities, edges) of each subgraph of :func:`ego_edges`, without building it.

    A line is in one window, so lines and edges are sums over windows; only entities can be in several.
    """
    of = targets.select("target", "wid").distinct().join(_windows(line_sets(line_entities)).hint("merge"), "wid").repartition("target")
    sums = of.groupBy("target").agg(F.count(F.lit(1)).alias("windows"), F.sum("lines").alias("lines"), F.sum("edges").alias("edges"))
    entities = of.select("target", F.explode("held").alias("entity")).distinct().groupBy("target").agg(F.count(F.lit(1)).alias("entities"))
    return sums.join(entities.hint("merge"), "target").select("target", "windows", "lines", "entities", "edges")


def upsert(node_updates: DataFrame) -> DataFrame:
    """(node_id, key, value) merged from updates with ``at``: the last value of each key that is not null wins."""
    return node_updates.where("value is not null").groupBy("node_id", "key").agg(F.max_by("value", "at").alias("value"))


def global_ids(node_table: DataFrame) -> DataFrame:
    """Adds ``number``: dense ids from 0 within each node type, in order of node_id.

    A type's nodes are numbered by counts of ranges of the id's hash: rows are
    ranked within a bucket, and a running sum over the buckets gives offsets,
    so no task ranks a whole type. Order: bucket, then node_id.
    """
    bucketed = node_table.withColumn("_bucket", F.substring(F.md5("node_id"), 1, 2))
    counts = bucketed.groupBy("node_type", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("node_type").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("node_type", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(W.partitionBy("node_type", "_bucket").orderBy("node_id"))
    return bucketed.join(offsets, ["node_type", "_bucket"]).withColumn("number", F.col("_before") + rank - 1).drop("_bucket", "_before")


def fanned_out(line_entities: DataFrame, lines: DataFrame) -> DataFrame:
    """Older edges: every entity of a window goes with every line of it. Grows with lines times entities of a window."""
    return lines.select("wid", "log_idx").distinct().join(line_entities.select("wid", "entity").distinct(), "wid")


def touching_lines(targets: DataFrame, line_entities: DataFrame) -> DataFrame:
    """(target, wid, log_idx): the target's own lines, and those of its other windows that hold an entity of the target.

    A line meets each of its window's targets once, as a set, and comes out once.
    """
    targets, sets = targets.select("target", "wid").distinct(), line_sets(line_entities).repartition("wid")
    own = _windows(sets).select(F.col("wid").alias("target"), F.col("held").alias("_own"))
    of = targets.join(own.hint("merge"), "target", "left")
    touches = (F.col("target") == F.col("wid")) | F.arrays_overlap("entities", "_own")
    return sets.join(of.hint("merge"), "wid").where(touches).select("target", "wid", "log_idx")


def sampled_lines(target_lines: DataFrame, most: int) -> DataFrame:
    """At most ``most`` lines of each target, its own first, the others in a hash order."""
    key = F.md5(F.concat_ws(":", "target", "wid", F.col("log_idx").cast("string")))
    rank = F.row_number().over(W.partitionBy("target").orderBy((F.col("target") != F.col("wid")).cast("int"), key))
    return target_lines.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def hops(near: DataFrame, n: int) -> DataFrame:
    """(wid, neighbor, hop): what is reached in up to n steps over (wid, neighbor), by the fewest."""
    reached = near.select("wid", "neighbor").distinct().withColumn("hop", F.lit(1))
    edge = reached
    for hop in range(2, n + 1):
        step = near.select(F.col("wid").alias("neighbor"), F.col("neighbor").alias("next")).distinct()
        edge = edge.select("wid", "neighbor").join(step, "neighbor").where("wid <> next").select("wid", F.col("next").alias("neighbor")).distinct()
        edge = edge.join(reached, ["wid", "neighbor"], "left_anti").withColumn("hop", F.lit(hop))
        reached = reached.union(edge)
    return reached


def frequency_edges(levels: DataFrame) -> DataFrame:
    """Edges from windows to their entities with how many lines hold them, in percent and as a level; input is that of ``compress.frequency_levels``."""
    return levels.select(F.concat(F.lit("Window:"), "wid").alias("src"), F.concat_ws(":", "entity_type", "entity").alias("dst"), F.lit("CONTAINS").alias("relation"), "lines", "percent", "level")


def postings(window_entity: DataFrame, digits: int = 2) -> DataFrame:
    """(entity, block, windows, wids): the windows of an entity, dealt to 16^digits blocks by a hash, so no row holds all windows of a common one."""
    block = F.substring(F.md5("wid"), 1, digits).alias("block")
    return window_entity.groupBy("entity", block).agg(F.count(F.lit(1)).alias("windows"), F.array_join(F.sort_array(F.collect_list("wid")), ",").alias("wids"))
