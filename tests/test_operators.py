"""Properties of the operators, and expectations worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from loomline.functions import entities as E
from loomline.operators import compress, evaluate, graph, learn, measure, retrieval, windows
from loomline.sources import eventlog, knowledge

SF = "/root/testdata/sf0.001"


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    "thread, group",
    [
        ("pool-6-IoTDB-Flush-4", "IoTDB-Flush"), ("1@group-000100000002-SegmentedRaftLogWorker", "SegmentedRaftLogWorker"), ("grpc-default-worker-ELG-3-3", "grpc-default-worker"),
        ("2-server-thread1", "server-thread"), ("pool-27-IoTDB-ClientRPC-Processor-3$20240114_144746_00004_1", "IoTDB-ClientRPC-Processor"), ("grpc-default-executor-4", "grpc-default-executor"), ("a-1-2-3", None), ("", None),
    ],
)
def test_thread_groups(spark, thread, group):
    assert frame(spark, [(thread,)], "t string").select(E.normal_thread(F.col("t"))).first()[0] == group


def test_entities_of_a_line(spark):
    line = "- 2024-01-14 22:37:02,123 [1@group-000100000002-StateMachineUpdater] INFO  o.a.Handler:95 - RestorableTsFileIOWriter:95 opened 1705243672551-1-0-0.tsfile root.db1 nodeId=3 client-4F2A9C00ab term:9 0x133f2326"
    got = {(e["type"], e["value"]) for e in frame(spark, [(line,)], "raw_line string").select(E.clean_entities(F.col("raw_line"))).first()[0]}
    want = {("ConsensusGroup", "group-000100000002"), ("Node", "node1"), ("Node", "3"), ("DataRegion", "Database:root.db1")}
    want |= {("GeneralEntity", v) for v in ("TsFile:1705243672551", "Subsystem:TsFile", "ThreadGroup:StateMachineUpdater", "RestorableTsFileIOWriter:95", "ClientId:4F2A9C00", "nodeId=3", "0x133f2326", "db1", "4F2A9C00ab")}
    assert want == got


def test_header_with_an_inner_bracket_has_no_thread(spark):
    line = "- 2024-01-14 22:37:02,123 [pool-31-DataRegion[1]-1] INFO  a - b"
    assert frame(spark, [(line,)], "l string").select(E.thread(F.col("l"))).first()[0] is None


def test_token_complexity(spark):
    rows = frame(spark, [("blk_3587508140",), ("1705029356052",), ("a",)], "t string").select(E.token_complexity(F.col("t"))).collect()
    assert [r[0] for r in rows] == [3, 1, 1]


def test_peers_give_addresses(spark):
    line = "Peer{groupId=g, endpoint=TEndPoint(ip:10.0.0.1, port:1), nodeId=4} Peer{groupId=g, endpoint=TEndPoint(ip:10.0.0.2, port:1), nodeId=4} nodeId = 5"
    row = frame(spark, [(line,)], "l string").select(E.structured(F.col("l"))["node_ips"]).first()[0]
    assert row == ["4=10.0.0.2", "5=10.0.0.1"]


def test_splits_are_whole_and_stratified(spark):
    rows = frame(spark, [(str(i), "ab"[i % 3 == 0]) for i in range(97)], "wid string, label string")
    got = windows.stratified_split(rows, "wid", "label").groupBy("label", "split").count().collect()
    counts = {(r.label, r.split): r["count"] for r in got}
    for label, n in (("b", 33), ("a", 64)):
        assert counts[label, "train"] == int(0.8 * n) and counts[label, "val"] == int(0.1 * n)
        assert sum(v for (x, _), v in counts.items() if x == label) == n


def test_count_windows_number_every_stream(spark):
    rows = frame(spark, [(s, t, t // 7) for s in "xy" for t in range(50)], "s string, t int, b int")
    got = windows.count_windows(rows, "s", ["t"], F.col("b"), 20).collect()
    assert all((r.window_no, r.log_idx) == divmod(r.t, 20) for r in got) and len(got) == 100


def test_compression_keeps_every_line(spark):
    lines = eventlog.lines(spark, SF)
    records = lines.select("wid", "log_idx", "ts_s", "raw_line", E.thread(F.col("raw_line")).alias("thread"), compress.template_mask(E.message(F.col("raw_line"))).alias("template"), F.array().cast("array<string>").alias("entities"))
    for got in (compress.compress_windows(records), compress.compress_runs(records)):
        assert got.groupBy().sum("count").first()[0] == lines.count()


def test_coverage_filter_is_idempotent(spark):
    rows = frame(spark, [(w, "T", e) for w, e in [("1", "a"), ("2", "a"), ("2", "b"), ("3", "a")]], "wid string, entity_type string, entity string")
    coverage = compress.entity_coverage(rows)
    once = compress.coverage_filter(rows, coverage, 2)
    assert sorted(once.collect()) == sorted(compress.coverage_filter(once, coverage, 2).collect()) and {r.entity for r in once.collect()} == {"a"}


@pytest.mark.parametrize("most, block", [(2, 2048), (3, 2), (0, 2), (100, 2048)])
def test_best_neighbors_equal_brute_force(spark, monkeypatch, most, block):
    """The number of windows from which an entity is hot, and the blocks, change no neighbour."""
    monkeypatch.setattr(graph, "SET_BLOCK", block)
    sets = {f"w{i}": {f"e{j}" for j in range(12) if (i * j + i) % 5 < 2 or j == 0} for i in range(9)} | {"x": {"e0"}, "y": {"e0"}, "z": {"other"}}
    rows = frame(spark, [(w, e, "odd" if w in ("w1", "x", "w3") else "even") for w, s in sets.items() for e in s], "wid string, entity string, label string")
    true = {(a, b): len(sets[a] & sets[b]) for a in sets for b in sets if a != b and sets[a] & sets[b]}
    for k, within in ((1, []), (4, []), (2, ["label"])):
        alike = {p: n for p, n in true.items() if not within or (p[0] in ("w1", "x", "w3")) == (p[1] in ("w1", "x", "w3"))}
        best = {(a, *p) for a in sets for p in sorted(((b, n) for (x, b), n in alike.items() if x == a), key=lambda p: (-p[1], p[0]))[:k]}
        scores = graph.shared_entity_scores(rows, most, k, within)
        assert all(alike[r.wid, r.neighbor] == r.score for r in scores.collect())
        assert {(r.wid, r.neighbor, r.score) for r in graph.top_neighbors(scores, k).collect()} == best


def test_belongs_to_needs_both_ends(spark):
    rows = frame(spark, [("DataRegion", "DataRegion:1"), ("DataRegion", "DataRegion:2"), ("ConsensusGroup", "DataRegion:1"), ("ConsensusGroup", "group-1"), ("DataRegion", "Database:root.x")], "entity_type string, entity string")
    assert [tuple(r) for r in graph.belongs_to(rows).collect()] == [("DataRegion:1", "DataRegion:1")]


def test_class_weights_and_report(spark):
    rows = frame(spark, [("a", "a"), ("a", "a"), ("a", "b"), ("b", "a")], "label string, pred string")
    weights = {r.label: r.weight for r in measure.class_weights(rows).collect()}
    assert weights == {"a": 0.5, "b": 1.5}
    report = {r.label: (r.support, r.precision, r.recall, r.f1) for r in measure.class_report(rows).collect()}
    assert report == {"a": (3, 0.666667, 0.666667, 0.666667), "b": (1, 0.0, 0.0, 0.0)}


def test_reports_are_checked(spark):
    text = "x (see TS‑HC‑4) (see AB-1, CD-2) Tuple 3 <think>a\nb</think>. SHOW REGIONS; FLUSH; SHOW X"
    row = evaluate.citations(frame(spark, [(text, ["TS-HC-4", "Q"])], "text string, evidence array<string>"))
    row = evaluate.citation_validity(row, F.array(F.lit("Q"))).withColumn("plain", evaluate.without_thoughts(F.col("text")))
    got = row.withColumn("bad", evaluate.unknown_commands(evaluate.mentions(F.col("text"))["commands"], ["SHOW REGIONS WHERE", "FLUSH"])).first()
    assert got.cited_ids == ["TS-HC-4"] and got.valid_ids == 1 and got.invalid_ranks == 1 and "think" not in got.plain and got.bad == ["SHOW X"]
    assert frame(spark, [(1,)], "x int").select(evaluate.unknown_settings(F.array(F.lit("a")), [])).first()[0] is None


def test_knowledge_files(spark, tmp_path):
    entry = {"id": "T-1", "title": "t", "symptom": "s", "root_cause": "r", "fix": ["f"], "anomaly_classes": ["a"], "tags": []}
    (tmp_path / "01_tuples.json").write_text(json.dumps({"doc_type": "faq", "source": "x", "tuples": [entry]}))
    code = {"code": 605, "name": "N", "meaning": "m", "common_root_cause": "c", "subsystems": [], "severity": "high"}
    (tmp_path / "02_codes.json").write_text(json.dumps({"by_anomaly_class": {"flush": [code | {"fix_hint": "h"}], "export": [code, code | {"code": 7}]}, "key_anomaly_diagnostic_codes": {"k": [605]}}))
    (tmp_path / "03_config.json").write_text(json.dumps({"parameters": [{"name": "p", "description": "d", "type": "int", "default": "1", "anomaly_classes": ["a"]}, {"name": "q", "anomaly_classes": []}]}))
    tuples = knowledge.tuple_entries(spark, [str(tmp_path / "01_tuples.json")])
    codes = knowledge.code_entries(spark, [str(tmp_path / "02_codes.json")])
    parameters = knowledge.parameter_entries(spark, [str(tmp_path / "03_config.json")])
    rows = {r.id: r for r in tuples.unionByName(codes).unionByName(parameters).collect()}
    assert set(rows) == {"T-1", "SC-605", "SC-7", "CFG-p"}
    assert rows["SC-605"].anomaly_classes == ["flush"] and rows["SC-605"].fix == ["h"] and rows["SC-605"].tags == ["smoking_gun"] and not rows["SC-7"].tags


def test_missing_files_are_passed_over(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"wid": "w", "logs": []}))
    there, missing = str(tmp_path / "a.json"), str(tmp_path / "b.json")
    assert knowledge.windows_lines(spark, [there, missing]).count() == 1 and knowledge.windows_lines(spark, [missing]).count() == 0
    assert knowledge.windows_lines(spark, [str(tmp_path / "*.json")]).count() == 1


def test_window_files_and_resume(spark, tmp_path):
    path = tmp_path / "w.json"
    path.write_text(json.dumps({f"f:count:{i}:1.0": {"label_file": "f", "anomaly_types": ["error"], "logs": [{"raw_line": "a", "timestamp": "1"}, {"raw_line": "", "timestamp": "2"}]} for i in range(3)}))
    rows = knowledge.windows_json(spark, [str(path)])
    assert rows.count() == 3 and knowledge.log_lines(rows).count() == 3
    done = rows.limit(1).select("wid")
    assert knowledge.remaining(rows, done, "wid").count() == 2


def test_encoder_hook(spark):
    encode = learn.encoder(lambda texts: [[len(t), 1.0] for t in texts])
    assert frame(spark, [("abc",)], "t string").select(encode("t").alias("v")).first().v == [3.0, 1.0]


@pytest.mark.parametrize("queries, base, k, on", [(3, 5, 4, None), (2, 3, 3, "label"), (100, 4096, 2, "label")])
def test_best_entries_equal_brute_force(spark, monkeypatch, queries, base, k, on):
    """Blocks of any size, ties, classes of one and of many, null vectors."""
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", queries)
    monkeypatch.setattr(retrieval, "BASE_BLOCK", base)
    rows = [(f"v{i:02d}", [float((i * j) % 5) for j in range(1, 4)], "ab"[i % 4 == 0]) for i in range(30)] + [("null", None, "a")]
    table = spark.createDataFrame(rows, "id string, vec array<double>, label string")
    asked = table.where("id < 'v09' or id = 'null'").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), "label")
    got = {(r.qid, r["rank"]): (r.id, r.sim) for r in retrieval.cosine_topk(asked if on else asked.drop("label"), table, k, on, 1 / F.length("label")).collect()}
    want = {}
    for q, v, x in rows[:9]:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w, y in rows[:-1] if not on or x == y)
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(scored[:k])}
    assert got == want
    assert "NestedLoop" not in retrieval.cosine_topk(asked.drop("label"), table, k)._jdf.queryExecution().toString()


def test_overlaps_ask_for_blocks_of_numbers(spark):
    """Each pair of blocks meets once, and pairs that share a rare entity carry no sets of entities."""
    rows = frame(spark, [(f"w{i}", f"e{j}") for i in range(9) for j in range(6) if (i + j) % 4] + [("w1", "r"), ("w2", "r")], "wid string, entity string")
    plan = graph.shared_entity_scores(rows, 2, 2)._jdf.queryExecution().toString()
    assert "array_intersect" not in plan
    assert {r.score for r in graph.shared_entity_scores(rows, 2, 2).where("wid = 'w1' and neighbor = 'w2'").collect()} == {5}


def test_touching_lines_move_no_lines_to_the_driver(spark):
    """Line tables look small as Parquet files, so they must not be broadcast; lines of other windows stay if they share an entity."""
    lines = frame(spark, [("a", 0, "x"), ("b", 0, "x"), ("b", 1, "y"), ("a", 1, "z")], "wid string, log_idx long, entity string")
    got = graph.touching_lines(frame(spark, [("a", "a"), ("a", "b")], "target string, wid string"), lines)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == [("a", "a", 0), ("a", "a", 1), ("a", "b", 0)]


def test_words_of_subsystems_stand_in_their_patterns(spark):
    """A pattern is only tried where one of its words stands, so each branch of it must hold one."""
    texts = ["FLUSH x", "Compact", "CompactionRecover", "a.tsfile", "LOG_INPROGRESS", "segmentedraftlog", "WriteAheadLog", "OutOfMemory", "grpc-1", "requestVote", "leader x election", "minorgc", "GarbageCollect", "coordinator", "bloomfilter", "CreateRegionGroups", "StateMachineProcedure", "elected", "plain"]
    found = {r.t: set(r.s) for r in frame(spark, [(t,) for t in texts], "t string").select("t", E.subsystems(F.col("t")).alias("s")).collect()}
    import re
    for text in texts:
        assert found[text] == {name for name, p in E.SUBSYSTEMS if re.search(p, text)}


def test_fast_tokens_equal_the_patterns_of_sql(spark):
    """Random texts of what the patterns tell apart, letters that are not ASCII and combining marks among it."""
    import random
    pick = random.Random(7)
    parts = ["a", "B", "_", "7", "12", "é", "́", "٣", "=", ":", "[", "]", "[3]", "-", ".", ".log", ".TSFILE", ".wal", ".conf", " ", "$", "K", "term:1", "Flush:12", "TsFile:1234"]
    texts = [("".join(pick.choices(parts, k=pick.randint(0, 14))),) for _ in range(4000)]
    plain = F.array_distinct(F.concat(*[F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in E.TOKENS]))
    found = frame(spark, texts, "t string").select("t", F.array_sort(plain).alias("plain"), F.array_sort(E.tokens(F.col("t"))).alias("fast"))
    assert [r.t for r in found.where("plain <> fast").collect()] == []
    assert found.where("size(plain) > 1").count() > 1000


def test_entities_are_found_before_lines_are_written(spark):
    """Small files are read back by one task a core, so what costs most must not come after them."""
    from loomline.plans import registry
    lines = registry._numbered(spark, SF)
    assert "regexp" not in registry._entities(lines)._jdf.queryExecution().toString()
    assert registry._entities(lines).exceptAll(E.entity_rows(lines.drop("found"), ["wid", "log_idx"])).count() == 0
    assert "regexp_extract_all" not in registry.entity_coverage(spark, SF)._jdf.queryExecution().toString()


def _subgraphs(spark):
    """Targets and lines, in rows and in sets: repeated rows, lines and windows without entities, targets of windows that are not there."""
    rows = [("a", 0, "x"), ("a", 0, "x"), ("a", 0, "z"), ("a", 2, "y"), ("b", 5, "z"), ("b", 1, "w"), ("c", 0, "z"), ("c", 7, "v"), ("c", 7, "x")]
    targets = [("a", "a"), ("a", "b"), ("a", "b"), ("b", "b"), ("b", "c"), ("b", "a"), ("c", "c"), ("d", "d"), ("d", "c"), ("c", "e")]
    lines = frame(spark, rows, "wid string, log_idx long, entity string")
    sets = lines.groupBy("wid", "log_idx").agg(F.collect_set("entity").alias("entities")).union(frame(spark, [("a", 1, []), ("d", 0, [])], "wid string, log_idx long, entities array<string>"))
    return set(targets), set(rows), frame(spark, targets, "target string, wid string"), lines, sets


def test_edges_of_a_subgraph_are_ranked_before_targets_join(spark):
    targets, rows, of, lines, sets = _subgraphs(spark)
    want = set()
    for target in {t for t, _ in targets}:
        mine = {r for r in rows if (target, r[0]) in targets}
        orders = [sorted({f(r) for r in mine}) for f in (lambda r: r[0], lambda r: r[:2], lambda r: r[2])]
        want |= {(target, *r, orders[0].index(r[0]), orders[1].index(r[:2]), orders[2].index(r[2])) for r in mine}
    for given in (lines, sets):
        got = graph.ego_edges(of, given)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan[: plan.index("Join Inner")]


def test_sizes_of_subgraphs_come_from_windows(spark):
    targets, rows, of, lines, sets = _subgraphs(spark)
    want = set()
    for target in {t for t, _ in targets}:
        mine = {r for r in rows if (target, r[0]) in targets}
        want |= {(target, len({r[0] for r in mine}), len({r[:2] for r in mine}), len({r[2] for r in mine}), len(mine))}
    for given in (lines, sets):
        assert {tuple(r) for r in graph.ego_sizes(of, given).collect()} == want


def test_touching_lines_come_out_once(spark):
    targets, rows, of, lines, sets = _subgraphs(spark)
    own = {t: {r[2] for r in rows if r[0] == t} for t, _ in targets}
    want = sorted({(t, *r[:2]) for t, w in targets for r in rows if r[0] == w and (t == w or r[2] in own[t])})
    for given in (lines, sets):
        got = graph.touching_lines(of, given)
        assert sorted(map(tuple, got.collect())) == want
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Aggregate" not in plan[: plan.index("Join Inner")]


def test_meeting_blocks_equal_brute_force(spark, monkeypatch):
    """Bounds, stripes, products of matrices and columns of several entities change no overlap and no tie."""
    import numpy as np
    import pyarrow as pa
    pick = np.random.default_rng(3)
    sets = {i: sorted(set(pick.integers(0, 12, pick.integers(0, 9)).tolist()) | ({20, 21} if i % 3 else set())) for i in range(60)}
    names, block = {i: f"w{pick.integers(1000)}:{i}" for i in sets}, {i: i % 2 for i in sets}
    for lo, hi in ((0, 0), (0, 1)):
        there = [i for i in sets if block[i] in (lo, hi)]
        table = pa.table({"set": pa.array(there), "hot": pa.array([sets[i] for i in there], pa.list_(pa.int32())), "first": [names[i] for i in there], "block": [block[i] for i in there], "lo": [lo] * len(there), "hi": [hi] * len(there)})
        pairs = [(i, j) for i in there for j in there if block[i] == lo and block[j] == hi]
        want = {(i, j, None, len(set(sets[i]) & set(sets[j]))) for i, j in pairs[::3]}
        for i in there:
            scored = sorted((-len(set(sets[i]) & set(sets[j])), names[j], j) for j in there if lo == hi or block[i] != block[j])
            want |= {(i, j, name, -n) for n, name, j in scored[:4] if n}
        for stripe, ahead, dense, columns in ((128, 2048, 0.004, 1024), (3, 5, 2.0, 4), (7, 2, 0.0, 3), (4, 30, 0.2, 1)):
            for name, value in (("STRIPE", stripe), ("AHEAD", ahead), ("DENSE", dense), ("COLUMNS", columns)):
                monkeypatch.setattr(graph, name, value)
            got = graph._meet(table, pa.table({"l": [i for i, _ in pairs[::3]], "r": [j for _, j in pairs[::3]]}), 4)
            assert len(got) == len(want) and set(zip(*(got[c].to_pylist() for c in ("set", "other", "first", "score")))) == want
    a = graph._Block(table)
    assert len(graph._holders(a, a)[2]) == 13 and graph._holders(a, a)[2].sum() == 14  # 20 and 21 are one column


def test_neighbors_of_two_hops_are_ranked_once(spark):
    from loomline.plans import registry
    assert "Window" not in registry.two_hop_neighbors(spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_entities_do_not_hang_on_time(spark):
    """Lines that differ in time share what is found; headers that are none, digits at their edges and null lines stay apart."""
    tails = ["[3@group-00010-X] INFO  app.view:43 - Flush root.sg1[43] size=43", "[17052436725] WARN  a - 1-0-0.tsfile nodeId=3", "[t] info x root.a1.b", "[] INFO  a1", "@group-12] INFO  x=1", "-1-2-3.tsfile [t] INFO a"]
    heads = ["", "- 2024-01-01 00:00:00,000 ", "2025-12-31 23:59:59,999\t", " -  2024-01-02  03:04:05,678   ", "- 2024-01-01 00:00:00,000", "2024-01-01 00:00:00,00 ", "1705243672500"]
    texts = [(i, h + t) for i, (h, t) in enumerate([(h, t) for h in heads for t in tails])] + [(-1, None), (-2, ""), (-3, None)]
    lines = frame(spark, texts, "id int, raw_line string")
    want = {r.id: None if r.e is None else sorted(map(tuple, r.e)) for r in lines.select("id", E.clean_entities(F.col("raw_line")).alias("e")).collect()}
    got = {r.id: None if r.found is None else sorted(map(tuple, r.found)) for r in E.with_entities(lines, ["id"]).collect()}
    assert got == want and any(want.values())
    assert lines.where(E.timeless(F.col("raw_line")) == F.col("raw_line")).count() > 20
    assert lines.where("raw_line like '%Flush%' and id >= 0").select(E.timeless(F.col("raw_line"))).distinct().count() < 6
