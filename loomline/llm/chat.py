"""Chat formatting with minimum-cost role repair.

Legal conversations are: at most one system turn first, then user and
assistant turns in alternation from user to assistant. A given turn keeps its
role, is relabelled, or is merged into the turn before; empty turns may be
inserted between and at the end. The cheapest repair is found by dynamic
programming over the automaton's states (nothing yet, or the role of the last
turn); ties go to the smaller state in ``STATES``. Each repaired turn is
rendered as a piece; a conversation is its pieces in the order of ``seq``.

Turns are ordered by turn (nulls first), then by a hash of role and text; rows
that repeat are turns of their own (which of them comes first makes no
difference). All turns are dealt by range of (conv_id, turn) to at most
``MOST_PARTS`` sorted partitions, and these are cut into chunks of at most
``CHUNK_ROWS``, so one conversation may span any number of tasks: a chunk sums up the cut conversations at its ends as
(min, +) matrices, these are chained for each conversation, and the chunks are
repaired from their entry state to their exit state. A null conv_id is a
conversation of its own, null roles are unknown, null texts empty. Extra
columns are ignored; no rows, no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

STATES = ("", "system", "user", "assistant")
ROLES = STATES[1:]
CHUNK_ROWS = 5000
MOST_PARTS = 20_000
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 2, 1, 1, 3
FAR = 1 << 40
OPEN, CLOSE, GLUE = "<|im_start|>{}\n", "<|im_end|>\n", "\n\n"
# Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}

_FOLLOWS = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns to insert on the way from one state to another, where the automaton has a way."""
    out = {}
    for p in range(4):
        found = {x: () for x in _FOLLOWS[p]}
        edge = list(found)
        while edge:
            nearer = []
            for x in edge:
                for y in _FOLLOWS[x]:
                    if y not in found and x != 1:  # empty system turns are never inserted
                        found[y] = (*found[x], x)
                        nearer.append(y)
            edge = nearer
        out |= {(p, x): v for x, v in found.items()}
    return out


_WAY = _paths()
#: Of the role's number (0: unknown), the entry state and the given role: cost, merged, inserted roles; None where illegal.
_MOVES: list[list[list[tuple | None]]] = []
for _role in range(4):
    _MOVES.append([])
    for _p in range(4):
        _row: list[tuple | None] = [None]
        for _x in range(1, 4):
            _label = 0 if _role == _x else RELABEL_UNKNOWN if _role == 0 else RELABEL
            _ways = [(_label + INSERT * len(_WAY[_p, _x]), False, _WAY[_p, _x])] if (_p, _x) in _WAY else []
            if _p == _x:
                _ways.append((_label + MERGE, True, ()))
            _row.append(min(_ways, default=None))
        _MOVES[-1].append(_row)
#: Empty turns that end a conversation in each state.
_ENDING = [(2, 3), (2, 3), (3,), ()]
_END_COST = [FAR, *(INSERT * len(x) for x in _ENDING[1:])]


def _forward(roles: list[int], cost: list[int]) -> tuple[list[int], list[list[int]]]:
    """Costs of the states after the turns, and each turn's best earlier states."""
    back = []
    for role in roles:
        new, best = [FAR] * 4, [0] * 4
        for p in range(4):
            if cost[p] >= FAR:
                continue
            for x in (1, 2, 3):
                move = _MOVES[role][p][x]
                if move and cost[p] + move[0] < new[x]:
                    new[x], best[x] = cost[p] + move[0], p
        back.append(best)
        cost = new
    return cost, back


def matrix(roles: list[int]) -> list[int]:
    """The (min, +) matrix of a run of turns, row by row."""
    return [c for p in range(4) for c in _forward(roles, [0 if p == q else FAR for q in range(4)])[0]]


def states(roles: list[int], entry: int = 0, leave: int | None = None) -> list[int]:
    """The states of a cheapest repair, the entry state first; ``leave`` is None at a conversation's end."""
    cost, back = _forward(roles, [0 if q == entry else FAR for q in range(4)])
    at = leave if leave is not None else min(range(4), key=lambda q: (cost[q] + _END_COST[q], q))
    out = [at]
    for best in reversed(back):
        out.append(best[out[-1]])
    return out[::-1]


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return STATES.index(name) if name in ROLES else 0


def repaired(roles: list[int], texts: list[str], path: list[int], last: bool) -> dict[str, list]:
    """Rows for a run of turns whose states are known."""
    out: dict[str, list] = {k: [] for k in ("new_role", "action", "inserted", "cost", "piece")}
    for i, (role, text) in enumerate(zip(roles, texts)):
        p, x = path[i], path[i + 1]
        cost, merged, between = _MOVES[role][p][x]
        piece = GLUE + text if merged else CLOSE * (p > 0) + "".join(OPEN.format(STATES[k]) + CLOSE for k in between) + OPEN.format(STATES[x]) + text
        added = [STATES[k] for k in between]
        if last and i == len(roles) - 1:
            piece += CLOSE + "".join(OPEN.format(STATES[k]) + CLOSE for k in _ENDING[x])
            added += ["end:" + STATES[k] for k in _ENDING[x]]
            cost += _END_COST[x]
        out["new_role"].append(STATES[x])
        out["action"].append("+".join(["relabel"] * (role != x) + ["merge"] * merged) or "keep")
        out["inserted"].append(",".join(added))
        out["cost"].append(cost)
        out["piece"].append(piece)
    return out


def _runs(ids: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each conversation in sorted rows."""
    new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    return list(zip(new.tolist(), np.r_[new[1:], len(ids)].tolist()))


def _chained(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit states of the pieces of one conversation, in the order of their chunks."""
    rows = rows.sort_values("chunk")
    m = np.array(rows["m"].tolist(), np.int64).reshape(-1, 4, 4)
    before = [np.array([0, FAR, FAR, FAR])]
    for one in m:
        before.append((before[-1][:, None] + one).min(axis=0))
    leave = [int(np.argmin(before[-1] + np.array(_END_COST)))]
    for one, v in zip(m[::-1], before[-2::-1]):
        leave.append(int(np.argmin(v + one[:, leave[-1]])))
    path = leave[::-1]
    return pd.DataFrame({"chunk": rows["chunk"].to_numpy(), "key": rows["key"].to_numpy(), "entry": path[:-1], "leave": path[1:], "last": [False] * (len(path) - 2) + [True]})


RESULT = "conv_id long, turn long, seq long, role string, new_role string, action string, inserted string, cost long, piece string"


def role_repair(turns: DataFrame) -> DataFrame:
    """One row for each turn: its new role, what was done, and its rendered piece.

    ``seq`` orders the turns of all conversations; ``inserted`` names the empty
    turns before this one, and with ``end:`` those behind the last.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("~"))).withColumn("tie", F.xxhash64("role", "text")).withColumn("own", F.monotonically_increasing_id())
    n = max(1, min(-(-rows.count() // CHUNK_ROWS), MOST_PARTS))
    order = ["key", "turn", "tie", "own"]
    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "key", F.monotonically_increasing_id().alias("seq"))
    # An id is the partition's number times 2^33 and the row's place, so chunks never span partitions and keep their order.
    place = F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))
    placed = cut(placed.withColumn("chunk", F.col("seq") - place + F.floor(place / CHUNK_ROWS)))

    def ends(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        keys, roles = table["key"].to_numpy(), [role_number(r) for r in table["role"].to_pylist()]
        runs = _runs(keys)
        at = sorted({0, len(runs) - 1})
        return pa.table({"chunk": pa.array([table["chunk"][0].as_py()] * len(at), pa.int64()), "key": [keys[runs[k][0]] for k in at], "m": pa.array([matrix(roles[slice(*runs[k])]) for k in at], pa.list_(pa.int64()))})

    cuts = placed.select("chunk", "seq", "key", "role").groupBy("chunk").applyInArrow(ends, "chunk long, key string, m array<long>")
    known = cuts.groupBy("key").applyInPandas(_chained, "chunk long, key string, entry long, leave long, last boolean")
    known = cut(known.groupBy("chunk").agg(F.collect_list(F.struct("key", "entry", "leave", "last")).alias("cuts")))

    def repair(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        given = {c["key"]: c for c in table["cuts"][0].as_py()}
        keys, roles, texts = table["key"].to_numpy(), [role_number(r) for r in table["role"].to_pylist()], table["text"].to_pylist()
        out: dict[str, list] = {}
        for a, z in _runs(keys):
            cutting = given.get(keys[a])
            last = cutting is None or cutting["last"]
            path = states(roles[a:z], cutting["entry"] if cutting else 0, cutting["leave"] if cutting else None)
            for k, v in repaired(roles[a:z], texts[a:z], path, last).items():
                out.setdefault(k, []).extend(v)
        plain = {k: table[k] for k in ("conv_id", "turn", "seq", "role")}
        return pa.table({**plain, **{k: pa.array(v, pa.int64() if k == "cost" else pa.string()) for k, v in out.items()}})

    return placed.join(known, "chunk").groupBy("chunk").applyInArrow(repair, RESULT)
