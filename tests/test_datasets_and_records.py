import pytest
from pyspark.sql import functions as F

from skylode.functions import boxes
from skylode.operators import datasets, ledger, records
from skylode.operators.audits import ContractError

GT = "image string, gi long, box struct<x1:double,y1:double,x2:double,y2:double>, fine int, width int, height int"


def test_ground_truth_and_features(spark):
    labels = spark.createDataFrame([("a", 1, 24, 0.5, 0.5, 0.1, 0.1), ("a", 2, 30, 0.5, 0.5, 0.1, 0.1), ("a", 3, 0, 0.05, 0.05, 0.1, 0.1)], "image string, line_no int, fine int, x double, y double, w double, h double")
    images = spark.createDataFrame([("a", "f", 100, 200), ("b", "f", 100, 100)], "image string, family string, width int, height int")
    gt = datasets.ground_truth(images, labels)
    rows = gt.orderBy("gi").collect()
    assert [(r.gi, r.fine) for r in rows] == [(0, 24), (1, 0)] and tuple(rows[0].box) == pytest.approx((45, 90, 55, 110))
    found = {(r.image, r.feature): r.n for r in datasets.balance_features(images, gt).collect()}
    assert found["b", "background_images"] == 1 and found["a", "coarse:ship"] == 1 and found["a", "edge_instances"] == 1
    assert ("a", "background_images") not in found


def test_components_of_copies(spark):
    rows = spark.createDataFrame([("a", "x", 0), ("b", "x", 1 << 40), ("c", "y", 1), ("d", None, None), ("e", "z", 255)], "id string, sha string, phash long")
    found = {r.id: r.component for r in datasets.copy_components(rows, 2).collect()}
    assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    unions = spark.createDataFrame([("e", "d")], "left_id string, right_id string")
    assert {r.id: r.component for r in datasets.copy_components(rows, 2, unions).collect()}["e"] == "d"


def test_object_lookup(spark):
    g = spark.createDataFrame([("a", 0, (0.0, 0.0, 9.0, 9.0), 1, 9, 9), ("a", 1, (20.0, 0.0, 29.0, 9.0), 1, 9, 9), ("a", 2, (40.0, 0.0, 49.0, 9.0), 2, 9, 9), ("a", 3, (0.0, 0.0, 5.0, 5.0), 3, 9, 9)], GT)
    o = spark.createDataFrame([("a", 0, (20.0, 0.0, 29.0, 9.0), 1, 9, 9), ("a", 5, (0.0, 0.0, 9.0, 9.0), 1, 9, 9), ("a", 2, (1.0, 0.0, 9.0, 9.0), 2, 9, 9)], GT)
    assert [(r.gi, r.found_gi, r.how) for r in datasets.object_lookup(g, o).orderBy("gi").collect()] == [(0, 5, "overlap"), (1, 0, "overlap"), (2, 2, "only"), (3, None, None)]


def test_scenes_by_unique_name(spark):
    images = spark.createDataFrame([("t/a", "a"), ("v/b", "b"), ("v/c", "c")], "image string, name string")
    scenes = spark.createDataFrame([("t/a", "a", "s1"), ("x/b", "b", "s2"), ("x/c", "c", "s3"), ("y/c", "c", "s4")], "image string, name string, scene string")
    assert {r.image: r.scene for r in datasets.scene_of(images, scenes).collect()} == {"t/a": "s1", "v/b": "s2", "v/c": None}


def test_remapping_needs_equal_sets(spark):
    index = spark.createDataFrame([(0, "a"), (1, "b")], "position int, sha string")
    cache = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "sha string, value double")
    assert [r.value for r in datasets.remapped(index, cache).orderBy("position").collect()] == [1.0, 2.0]
    with pytest.raises(ContractError):
        datasets.remapped(index, cache.where("sha = 'a'"))


def test_caps_and_references(spark):
    rows = spark.createDataFrame([("a", i) for i in range(3)], "image string, pi int")
    assert datasets.not_truncated(rows, 4) is rows
    with pytest.raises(ContractError):
        datasets.not_truncated(rows, 3)
    rows = spark.createDataFrame([(f"i{i}", 0, "no_candidate" if i < 6 else "detected", 0.5, "p" if i < 5 else f"q{i}") for i in range(12)], "image string, gi int, error string, score double, product string")
    chosen = datasets.references(rows, 8)
    assert len(chosen) == 8 and len({x for x, _ in chosen}) == 8
    assert sum(x in {f"i{i}" for i in range(5)} for x, _ in chosen) == 3
    assert datasets.checklist(a=rows.limit(0), b=rows) == {"a": True, "b": False, "training_ready": False}


def test_ledger_files(tmp_path):
    path = tmp_path / "l.jsonl"
    first = records.append_chain(path, {"a": "é"})
    assert records.append_chain(path, {"b": 1})["event"]["previous_event_sha256"] == first["event_sha256"]
    records.record_epoch(path, 1, {"map": 0.5})
    with pytest.raises(ContractError):
        records.record_epoch(path, 1, {"map": 0.6})
    assert len(records.read_chain(path)) == 3
    path.write_text(path.read_text("utf-8").replace("é", "e"), "utf-8")
    with pytest.raises(ContractError):
        records.read_chain(path)


def test_run_states_and_stages():
    assert [records.classify_run(*x).action for x in ((True, 5, 5, True, True), (True, 3, 5, True, True), (False, 0, 5, False, False), (True, 3, 5, True, False))] == ["skip", "resume", "start", "error"]
    p = records.Pipeline(("a", "b", "c"))
    assert p.blocked_by("a") is None and p.blocked_by("c") == "a"
    with pytest.raises(ContractError):
        p.complete("b")
    p.complete("a")
    assert p.blocked_by("b") is None


def test_health_ranking_and_decisions():
    good = {"experiment": "g", "optimizer_verified": True, "cache_misses": 0, "global_nonzero_batches": 1, "global_grad_events": 1, "global_grad_norm_sum": 0.1}
    assert records.healthy(good) and not records.healthy(good | {"cache_misses": 1}) and not records.healthy(None)
    assert not records.healthy(good | {"experiment": "gp"})
    groups = {g: {"recall": 0.9, "false_alarm_rate": 0.1} for g in ("ship", "aircraft", "vehicle")}
    assert len(records.ranking_items(groups, {"total_seconds": 9})) == 7
    with pytest.raises(ContractError):
        records.ranking_items(groups, {})
    assert records.find_fingerprint({"x": [{"dataset_fingerprint": "a" * 64}]}) == "a" * 64
    assert records.mismatches({"a": 1}, {"a": 2, "b": None}) == {"a": (1, 2)}
    assert records.cell(" 1e-3 ") == 0.001 and records.cell(" x ") == "x"
    assert records.nested_get({"a": {"b": 1}}, "a", "b") == 1 and records.nested_get({"a": 1}, "a", "b") is None


def test_the_passing_model_with_the_best_metric_advances(spark):
    columns = "model string, map50_95 double, recall double, false_alarm_rate double, f1_ship double, f1_aircraft double, f1_vehicle double, kd_health boolean, deploy_parity boolean"
    fine = lambda m, v, ship=0.9: (m, v, 0.9, 0.1, ship, 0.95, 0.8, True, True)
    base, rows = fine("C0", 0.8, 0.88), [fine("b", 0.81), fine("a", 0.81), fine("z", 0.9, 0.88)]
    said = lambda x: tuple(ledger.advancing(spark.createDataFrame(x, columns)).first())
    assert said([base, *rows]) == ("one advances", 3, 2, "a")
    assert said([base, rows[2]]) == ("none passes", 1, 0, None)
    assert said([base]) == ("no candidates", 0, 0, None)
    assert said(rows)[0] == said([])[0] == "no baseline"


def test_box_conversions_are_inverse(spark):
    one = spark.range(1).select(boxes.corners(F.lit(0.5), F.lit(0.4), F.lit(0.2), F.lit(0.1), F.lit(200.0), F.lit(100.0)).alias("b"))
    row = one.select(boxes.centred(F.col("b"), F.lit(200.0), F.lit(100.0)).alias("c"), boxes.letterboxed(F.col("b"), F.lit(200.0), F.lit(100.0)).alias("l")).first()
    assert tuple(row.c) == pytest.approx((0.5, 0.4, 0.2, 0.1))
    assert tuple(row.l) == pytest.approx((0.5, 0.45, 0.2, 0.05))
