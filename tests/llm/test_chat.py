import random
from itertools import product

import pytest

from loomline.llm import chat

from .helpers import by_id


def cheapest(roles, most_inserted=3):
    """Least cost over all labellings, merges and insertions, by exhaustive search."""
    best = None
    for labels in product((1, 2, 3), repeat=len(roles)):
        cost = sum(0 if r == x else chat.RELABEL_UNKNOWN if r == 0 else chat.RELABEL for r, x in zip(roles, labels))
        reach = {0: cost}  # state -> cost
        for x in labels:
            new = {}
            for p, c in reach.items():
                ways = []
                for k in range(most_inserted + 1):
                    for extra in product((2, 3), repeat=k):
                        path = (p, *extra, x)
                        if all(b in chat._FOLLOWS[a] for a, b in zip(path, path[1:])):
                            ways.append(c + chat.INSERT * k)
                if p == x:
                    ways.append(c + chat.MERGE)
                if ways:
                    new[x] = min(new.get(x, 1 << 30), min(ways))
            reach = new
        for p, c in reach.items():
            total = c + chat._END_COST[p]
            best = total if best is None or total < best else best
    return best


@pytest.mark.parametrize("seed", range(12))
def test_states_are_cheapest(seed):
    rng = random.Random(seed)
    roles = [rng.randrange(4) for _ in range(rng.randint(1, 5))]
    rows = chat.repaired(roles, ["t"] * len(roles), chat.states(roles), True)
    assert sum(rows["cost"]) == cheapest(roles)


def legal(text):
    roles = [p.split("\n")[0] for p in text.split("<|im_start|>")[1:]]
    if roles[:1] == ["system"]:
        roles = roles[1:]
    return roles and len(roles) % 2 == 0 and all(r == ("user", "assistant")[i % 2] for i, r in enumerate(roles)) and text.count("<|im_start|>") == text.count("<|im_end|>")


def table(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(30):
        for turn in range(rng.randint(1, 8)):
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "human", "GPT", "tool", None]), rng.choice(["hello", "", None, "more\ntext"]), conv))
    rows += [(99, t, rng.choice(["user", "assistant", "system", None]), f"turn {t}", 1) for t in range(400)]
    rows += [(None, None, "assistant", "x", 1)] * 3 + [(98, 0, "user", "same", 1)] * 5
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, seq long").repartition(3)


@pytest.mark.parametrize("chunk, parts", [(5000, 20_000), (37, 20_000), (37, 2)])
def test_repairs_are_legal_whole_and_cheapest(spark, monkeypatch, chunk, parts):
    monkeypatch.setattr(chat, "CHUNK_ROWS", chunk)  # 37: conversation 99 spans many chunks
    monkeypatch.setattr(chat, "MOST_PARTS", parts)
    frame = table(spark)
    rows = chat.role_repair(frame).orderBy("seq").collect()
    assert len(rows) == frame.count()
    found = {}
    for r in rows:
        found.setdefault(r.conv_id, []).append(r)
    for conv, turns in found.items():
        assert legal("".join(t.piece for t in turns)), conv
        roles = [chat.role_number(t.role) for t in turns]
        want = chat.repaired(roles, [""] * len(roles), chat.states(roles), True)
        assert sum(t.cost for t in turns) == sum(want["cost"])
        assert [t.turn for t in turns] == sorted((t.turn for t in turns), key=lambda n: (n is not None, n or 0))


def test_matrices_chain():
    rng = random.Random(1)
    roles = [rng.randrange(4) for _ in range(60)]
    whole = chat.matrix(roles)
    a, b = chat.matrix(roles[:23]), chat.matrix(roles[23:])
    assert whole == [min(a[4 * p + q] + b[4 * q + x] for q in range(4)) if min(a[4 * p + q] + b[4 * q + x] for q in range(4)) < chat.FAR else chat.FAR for p in range(4) for x in range(4)]


def test_good_conversations_stay(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a")]
    got = by_id(chat.role_repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), "turn")
    assert {r["action"] for r in got.values()} == {"keep"} and sum(r["cost"] for r in got.values()) == 0
    assert got[0]["piece"] + got[1]["piece"] + got[2]["piece"] == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nu<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"


def test_empty_table(spark):
    assert chat.role_repair(table(spark).limit(0)).collect() == []
