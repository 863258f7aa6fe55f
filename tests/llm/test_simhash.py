import random

import pyarrow as pa
import pytest
import xxhash

from loomline.llm import near_copies, simhash

from .helpers import WORD, by_id, docs, empty, prose, texts


def fingerprint(text, n=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("rows", [4096, 3])
def test_equals_brute_force(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)  # 3: most buckets are dealt again
    monkeypatch.setattr(simhash, "FREE_BITS", 6)
    values = texts(7) + ["word " * k for k in range(1, 30)]
    got = by_id(simhash.near_duplicates(docs(spark, values)))
    prints = [fingerprint(t) for t in values]
    assert [got[i]["fingerprint"] for i in range(len(values))] == [f"{p:016x}" for p in prints]
    assert [got[i]["component_id"] for i in range(len(values))] == groups(prints, 3)


@pytest.mark.parametrize("rows", [4096, 8])
def test_links_of_close_fingerprints(spark, monkeypatch, rows):
    monkeypatch.setattr(simhash, "BUCKET_ROWS", rows)
    rng = random.Random(2)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(8):
            prints.add(base)
            for bit in rng.sample(range(64), rng.randint(1, 4)):
                base ^= 1 << bit
    prints = sorted(prints)
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    root = list(range(len(prints)))
    place = {simhash._signed(p): i for i, p in enumerate(prints)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for u, v in simhash.links(frame).collect():
        assert ((u ^ v) & (1 << 64) - 1).bit_count() <= 3
        a, b = sorted((find(place[u]), find(place[v])))
        root[b] = a
    assert [find(i) for i in range(len(prints))] == groups(prints, 3)


def test_masks_cover_any_three_bits():
    masks = simhash.covering_masks(3)
    rng = random.Random(1)
    for _ in range(3000):
        bits = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & bits for m in masks)


def shingles(text):
    words = WORD.findall(text or "")
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.mark.parametrize("rows, sketch", [(2048, 512), (6, 512), (2, 32)])
def test_one_of_each_group_stays(spark, monkeypatch, rows, sketch):
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", rows)
    monkeypatch.setattr(near_copies, "SKETCH", sketch)
    rng = random.Random(5)
    values = [prose(rng, rng.randint(30, 500)).lower() for _ in range(40)]
    family = list(range(40))
    for i in range(40):
        for _ in range(i % 4):
            words = values[i].split(" ")
            for _ in range(max(1, len(words) // 120)):
                words[rng.randrange(len(words))] = "edited"
            near = " ".join(words)
            a, b = shingles(values[i]), shingles(near)
            if len(a & b) >= 0.85 * len(a | b):
                values.append(near)
                family.append(i)
    values += [values[3], values[3], None, "", "tiny", "tiny"]
    family += [3, 3, -1, -1, -2, -2]
    rows = by_id(near_copies.one_of_each(docs(spark, values)))
    kept = [family[i] for i in rows]
    assert sorted(kept) == sorted(set(family))
    first = {f: family.index(f) for f in family}
    assert set(rows) == set(first.values())


def test_texts_that_share_half_a_hash_are_told_apart(spark):
    texts = spark.createDataFrame([(1, 5, 7), (2, 5, 3), (3, 5, 3), (4, 6, 9), (5, 5, 8)], "doc_id long, t long, t2 long")
    shared = near_copies.shared_halves(texts)
    assert [tuple(r) for r in shared.collect()] == [(5, 3)]
    t = {r.doc_id: r.t for r in near_copies.told_apart(texts, shared).collect()}
    assert t[2] == t[3] == 5 and t[4] == 6 and len({t[1], t[2], t[4], t[5]}) == 4


@pytest.mark.parametrize("rows", [2048, 8])
def test_links_join_all_near_copies(spark, monkeypatch, rows):
    """Against brute force: texts of one template, of which some are near copies, in buckets that are too large."""
    monkeypatch.setattr(near_copies, "BUCKET_ROWS", rows)
    monkeypatch.setattr(near_copies, "PIVOTS", 1)
    monkeypatch.setattr(near_copies, "SKETCH", 64)
    rng = random.Random(11)
    template = prose(rng, 150).lower().split()
    values = []
    for _ in range(12):
        own = prose(rng, rng.choice([10, 20, 40, 60])).lower().split()
        for _ in range(5):
            words = template + own
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
            values.append(" ".join(words))
    sets = [shingles(v) for v in values]
    keys = [int(k) for k in near_copies.text_keys(pa.array(values))[0]]
    wanted = {frozenset((keys[i], keys[j])) for i in range(len(values)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    links = {frozenset((r.u, r.v)) for r in near_copies.text_links(docs(spark, values)).collect()}
    assert links <= wanted

    def joined(edges):
        root = {k: k for k in keys}

        def find(k):
            while root[k] != k:
                k = root[k]
            return k

        for edge in edges:
            a, *b = edge
            root[find(a)] = find(b[0] if b else a)
        return {frozenset(k for k in keys if find(k) == find(x)) for x in keys}

    assert joined(links) == joined(wanted) and len(joined(wanted)) > 1


def test_repeated_rows_and_null_ids(spark):
    frame = docs(spark, ["one two three four five six seven"] * 3 + ["other words are here and there"]).drop("doc_id")
    frame = frame.selectExpr("cast(null as bigint) as doc_id", "*")
    assert near_copies.one_of_each(frame).count() == 2
    assert simhash.near_duplicates(frame).count() == 4


def test_empty_table(spark):
    assert simhash.near_duplicates(empty(spark)).collect() == [] == near_copies.one_of_each(empty(spark)).collect()


def test_buckets_of_the_same_texts_are_met_once(spark):
    """Near copies share most views, so most of their buckets hold the same texts; those with others stay."""
    rows = [(t, view, 5, t) for view in range(4) for t in (1, 2, 3)] + [(1, 7, 9, 1), (2, 7, 9, 2), (4, 8, 1, 4)]
    frame = spark.createDataFrame(rows, "t long, view int, value long, root long")
    got = sorted((r.view, r.t, r.n) for r in near_copies._open(frame, True).collect())
    assert got == [(0, 1, 3), (0, 2, 3), (0, 3, 3), (7, 1, 2), (7, 2, 2)]


def test_texts_that_are_alone_are_not_moved_for_their_prints(spark):
    texts = [(i, " ".join(f"w{(i * j) % 97}" for j in range(30))) for i in range(1, 9)]
    frame = spark.createDataFrame(texts + [(20, texts[0][1]), (1, texts[0][1])], "doc_id long, text string")
    prints = near_copies._each_print(frame, near_copies.cut(near_copies._hashed(frame)))
    assert prints.count() == prints.select("t").distinct().count() == 8
    assert "Union" in prints._jdf.queryExecution().optimizedPlan().toString()
