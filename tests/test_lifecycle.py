import hashlib
import json

import pytest
from pyspark.sql import functions as F

from skylode.functions import paths
from skylode.operators import provenance, records, runs, training
from skylode.operators.audits import ContractError
from skylode.sources import config


def test_fingerprints_are_digests_of_canonical_json_in_order(spark):
    rows = [("val", "s", "sc", "", "b.bmp", "b.txt", "1", "2"), ("train", "s", "é", None, "B.bmp", "B.txt", "3", "4"), ("train", "s", "sc", "c", "a.bmp", "a.txt", "5", "6")]
    df = spark.createDataFrame(rows, "split string, source string, scene_id string, cluster_id string, image string, label string, image_sha256 string, label_sha256 string")
    want = [{f: (r[f] or "") for f in provenance.SPLIT_FIELDS} for r in sorted(df.collect(), key=lambda r: (r.split, r.image.casefold()))]
    digest = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    made = provenance.fingerprints(df, provenance.SPLIT_FIELDS).first()
    assert (made.fingerprint, made.n) == (digest(want), 3)
    report = {"dataset_id": "d", "dataset_fingerprint": "a" * 64, "split_fingerprint": made.fingerprint}
    own = provenance.identity(df, report, {"dataset_id": "d", "dataset_fingerprint": None})
    assert own["image_count"] == 3 and sorted(own["split_inventory_fingerprints"]) == ["train", "val"]
    for bad in (report | {"split_fingerprint": "b" * 64}, report | {"dataset_fingerprint": "A" * 64}):
        with pytest.raises(ContractError):
            provenance.identity(df, bad)
    with pytest.raises(ContractError):
        provenance.fingerprints(df.limit(0))
    files = spark.createDataFrame([(f"images/{r[0]}/{r[4]}", r[6]) for r in rows] + [(f"labels/{r[0]}/{r[5]}", r[7]) for r in rows], "path string, sha256 string")
    listed = provenance.inventory(df, files)
    got = provenance.dataset_fingerprint(listed, "dataset.v1", "set", "c", "s", "yes", scene_audit="q").first()
    parts = {"schema": "dataset.v1", "dataset_id": "set", "class_mapping_fingerprint": "c", "split_fingerprint": "s", "background_confirmation": "yes", "label_fix_manifest_sha256": "none", "non_l_scene_audit_sha256": "q"}
    entries = [{f: r[f] for f in provenance.OLD_INVENTORY_FIELDS} for r in sorted(listed.collect(), key=lambda r: r.relative_image)]
    assert got.fingerprint == digest(parts | {"inventory": entries})
    with pytest.raises(ContractError):
        provenance.inventory(df, files.limit(4))
    with pytest.raises(ContractError):
        provenance.class_fingerprint({"0": "a", "2": "b"}, "dataset.v1", "classes")
    assert provenance.class_fingerprint({"1": "b", "0": "a"}, "dataset.v1", "classes") == provenance.class_fingerprint({0: "a", 1: "b"}, "dataset.v1", "classes")


@pytest.mark.parametrize("n,samples", [(1, 5), (7, 3), (100, 64), (64, 64), (10, 0)])
def test_samples_are_evenly_spaced(spark, n, samples):
    rows = spark.range(n).select(F.format_string("%04d", "id").alias("name"), "id")
    count = min(max(samples, 1), n)
    want = sorted({round(i * (n - 1) / max(count - 1, 1)) for i in range(count)})
    assert sorted(r.id for r in provenance.sampled(rows, "name", samples).collect()) == want


def test_cache_samples_and_contracts(spark):
    cache = spark.createDataFrame([(str(i), f"images/train/{i}", f"labels/train/{i}", "i", "l") for i in range(5)], "key string, relative_image string, relative_label string, image_sha256 string, label_sha256 string")
    files = spark.createDataFrame([(f"{k}/train/{i}", "x" if (i, k) == (1, "images") else k[0]) for i in range(4) for k in ("images", "labels")], "path string, sha256 string")
    entries = spark.createDataFrame([(str(i), "i", "x" if i == 2 else "l", "m" if i else "other") for i in (0, 2, 4)], "key string, image_sha256 string, label_sha256 string, manifest string")
    found = {r.key: r.problem for r in provenance.sample_problems(cache, files, entries, "m").collect()}
    assert found == {"0": "entry of another cache", "1": "file changed", "2": "entry differs", "3": "entry missing", "4": "file missing"}
    done = cache.select("image_sha256", F.lit(True).alias("valid")).limit(1)
    assert provenance.resumable(cache, done, {"a": 1}, None).count() == 5 and provenance.resumable(cache, done, {"a": 1}, {"a": 1}).count() == 0
    with pytest.raises(ContractError):
        provenance.resumable(cache, done, {"a": 1}, {"a": 2})
    own = provenance.cache_manifest({"dataset_fingerprint": "f"}, "train", "s", 5, {"sha256": "t"}, image_size=640, dino={"repository": "r", "path": "/x"})
    other = provenance.cache_manifest({"dataset_fingerprint": "f"}, "train", "s", 5, {"sha256": "t"}, image_size=640, dino={"repository": "r", "path": "/y"})
    assert own["compatibility_fingerprint"] == other["compatibility_fingerprint"] != provenance.cache_manifest({}, "val", "s", 5, {})["compatibility_fingerprint"]
    first = provenance.lineage({"seed": 1})
    assert provenance.lineage({"seed": 1}, first, {"sha256": "c"})["resumes"] == [{"sha256": "c"}]
    with pytest.raises(ContractError):
        provenance.lineage({"seed": 2}, first, {"sha256": "c"})


def test_a_run_from_start_to_end(spark, tmp_path):
    put = lambda name, value: (tmp_path / name).write_text(json.dumps(value)) and str(tmp_path / name)
    report, settings, weights = put("d.json", {"dataset_fingerprint": "a" * 64}), put("c.json", {"lr": 0.1}), put("w.pt", "w")
    registry = tmp_path / "registry.jsonl"
    started = runs.begin(tmp_path / "r1", registry, "g", report, settings, 7, weights, "train", run_id="one")
    assert started["record"]["dataset"]["fingerprint"] == "a" * 64 and runs.opened(tmp_path / "r1")["run_id"] == "one"
    with pytest.raises(ContractError):
        runs.begin(tmp_path / "r1", registry, "g", report, settings, 7, weights, "train")
    with pytest.raises(ContractError):
        runs.begin(tmp_path / "r2", registry, "g", settings, settings, 7, weights, "train")
    runs.resume(tmp_path / "r1", weights, "train again")
    with pytest.raises(ContractError):
        runs.end(tmp_path / "r1", "completed", {"best": weights}, {}, ["health"], formal=True)
    runs.end(tmp_path / "r1", "completed", {"best": weights}, {"map": 0.5}, formal=True)
    with pytest.raises(ContractError):
        runs.resume(tmp_path / "r1", weights, "late")
    runs.begin(tmp_path / "r2", registry, "p", report, settings, 7, weights, "train", run_id="two", resumed_from=weights, parent=tmp_path / "r1")
    assert [r["event"]["payload"]["action"] for r in records.read_chain(registry)] == ["init", "resume", "complete", "init"]
    states = {r.run_id: (r.state, r.resumes, r.summary) for r in runs.run_states(spark.read.text(str(registry))).collect()}
    assert states == {"one": ("complete", 1, '{"map":0.5}'), "two": ("open", 0, None)}


def test_reports_in_one_form_and_what_they_lack(spark):
    rows = lambda *x: spark.createDataFrame([(str(i), json.dumps(v) if not isinstance(v, str) else v) for i, v in enumerate(x)], "run_id string, report string")
    native = runs.native_metrics(rows({"models": {"m": {"metrics": {"mAP50-95": 0.5, "P": 1}}}}, {"map50_95": 0.25}, {"models": {"a": {}, "b": {}}}, "no json"))
    got = {r.run_id: (r.model, r.problem is None, r.map50_95, r.precision) for r in native.collect()}
    assert got["0"] == ("m", True, 0.5, 1.0) and got["1"] == (None, True, 0.25, None) and got["2"][:2] == (None, False) and got["3"][2] is None
    rates = {g: {"recall": 0.9, "false_alarm_rate": 0.1} for g in runs.GROUPS}
    competition = runs.competition_points(rows({"operating_points": {"best": {"confidence": 0.4, "groups": rates}}, "class_aware_matching": True}, {"confidence": 0.3, "class_aware_matching": True, "per_group": {"ship": {}}}), "best")
    assert [r.confidence for r in competition.orderBy("run_id").collect()] == [0.4, 0.3]
    assert runs.competition_points(rows({"operating_points": {}}), "best").first().problem is not None
    diagnosed = runs.diagnostics(rows({"summaries": {"m": {"per_group": {}, "per_size": {s: {} for s in runs.SIZES}, "attributes": {"crowded": 1, "edge": 2}}}}, {"per_size": {"small": 1}}))
    timed = runs.timings(rows({"excludes_image_read": True, "image_count": 2, "total_seconds": 1.4}, {"image_count": 2, "total_seconds": 1}))
    assert timed.where("run_id = '0'").first().mean_ms_per_image == pytest.approx(700) and timed.where("run_id = '1'").first().problem is not None
    found = {}
    for r in runs.evidence_problems(native.where("run_id < '2'"), competition, diagnosed, timed).collect():
        found.setdefault(r.run_id, set()).add(r.problem)
    assert found == {"1": {"rates of each group", "diagnostics by group", "diagnostics by size", "diagnostics by attribute", "timing without reading"}}
    same = {"parity": True, "full_detector_sha256": "a", "deploy_detector_sha256": "a"}
    assert [r.parity for r in runs.parity(rows(same, same | {"parity": False}, same | {"deploy_detector_sha256": "b"}, {})).orderBy("run_id").collect()] == [True, False, False, False]
    results = spark.createDataFrame([("a", 1, "x"), ("a", 2, " "), ("a", 3, None)], "run_id string, epoch int, metrics string")
    health = spark.createDataFrame([("a", 1, 1, "old"), ("a", 1, 2, "new")], "run_id string, epoch int, position int, health string")
    assert {(r.epoch, r.health) for r in runs.unrecorded_epochs(results, health, results.where("epoch = 2")).collect()} == {(1, "new"), (3, None)}
    assert runs.completed_epochs(results.select("run_id", "metrics")).first().epochs == 1


def test_contact_sheets_replays_frames_and_reviews(spark):
    counts = spark.createDataFrame([("a", "ship", 5), ("a", "car", 9), ("b", "ship", 5), ("b", "car", 8), ("c", "car", 1), ("d", "car", 0)], "image string, grp string, n long")
    assert sorted(map(tuple, training.contact_sheet(counts, ("ship", "car"), 2).collect())) == [("car", "c", 1, 1), ("ship", "a", 5, 1), ("ship", "b", 5, 2)]
    images = spark.createDataFrame([("a",), ("b",)], "image string")
    assert training.replayed(images, spark.createDataFrame([("a", 2)], "image string, repeats int")).count() == 4
    with pytest.raises(ContractError):
        training.replayed(images, spark.createDataFrame([("z", 2)], "image string, repeats int"))
    assert sorted(r.n for r in training.first_in_frame(counts, "grp", ["n", "image"], 2).collect()) == [0, 1, 5, 5]
    pairs = spark.createDataFrame([("x", "y", True, 9), ("x", "z", False, 1)], "left_image string, right_image string, strong boolean, inliers int")
    manifest = spark.createDataFrame([("x", "1"), ("y", "2")], "image string, image_sha256 string")
    assert tuple(training.semantic_unions(pairs, manifest).first())[:3] == ("1", "2", "same_scene_union")
    with pytest.raises(ContractError):
        training.semantic_unions(pairs, manifest.limit(1))
    labels = spark.createDataFrame([("a", 1, "1 2"), ("a", 2, " 1  2"), ("a", 3, ""), ("a", 4, "0 1"), ("b", 1, "x")], "image string, line_no int, row string")
    assert [tuple(r) for r in training.duplicate_report(labels).collect()] == [("a", 3, 2, 1, "1 2\n0 1\n")]
    box = F.struct(*[F.lit(float(v)).alias(n) for v, n in ((10, "x1"), (10, "y1"), (30, "x2"), (20, "y2"))])
    assert tuple(spark.range(1).select(training.context_window(box, 3.0, F.lit(45), F.lit(30)).alias("w")).first().w) == (0, 0, 45, 30)
    sums = spark.createDataFrame([("fine:4", "a", [0.0, 2.0], 2), ("fine:4", "b", [3.0, 0.0], 3), ("fine:5", "b", [0.0, 4.0], 4), ("coarse:x", "b", [1.0, 0.0], 9)], "key string, scene string, sum array<double>, n long")
    assert [(r.key, r.n, r.prototype) for r in training.fine_candidates(sums, "a").orderBy("key").collect()] == [("fine:4", 3, [1.0, 0.0]), ("fine:5", 4, [0.0, 1.0])]
    ready = spark.createDataFrame([("m", "s", 3)], "id string, candidate_sha256 string, rows int")
    assert training.approved(ready, ready).first().approved
    with pytest.raises(ContractError):
        training.approved(ready, ready.withColumn("rows", F.lit(4)))


def test_paths_and_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(paths.label_of(F.lit("/i/train/a.b.jpg"), "/i", "/l/")) == "/l/train/a.b.txt" and one(paths.label_of(F.lit("/j/a.jpg"), "/i", "/l")) is None
    assert one(paths.below_train(F.lit("C:\\d\\images\\train\\a\\b.png"))) == "a/b.png" and one(paths.below_train(F.lit("images/val/a"))) is None
    assert one(paths.safe_id(F.lit(" a.b-1 "))) == "a.b-1" and one(paths.safe_id(F.lit("a/b"))) is None
    assert one(paths.run_folder("/r", F.lit("g"), F.lit("s"))) == "/r/s/g" and one(paths.run_folder("/r", F.lit(".."), F.lit("s"))) is None
    assert tuple(one(paths.split_and_image(F.lit("labels/val/x.y.txt")))) == ("val", "x.y.jpg")
    assert one(paths.data_uri(F.lit(b"abc"))) == "data:image/jpeg;base64,YWJj" and one(paths.escaped(F.lit("<a&'\">"))) == "&lt;a&amp;&#x27;&quot;&gt;"
    assert one(paths.seconds_between(F.lit("2026-01-01T00:00:00Z"), F.lit("2026-01-01T01:00:00+00:30"))) == 1800 and one(paths.utc_now()).endswith("Z")


def test_configuration_files(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "images" / "train").mkdir(parents=True)
    (tmp_path / "images" / "train" / "a.jpg").write_bytes(b"x")
    (tmp_path / "train.txt").write_text("images/train/a.jpg\nimages/train/a.jpg\n/abs/b.jpg\n")
    (tmp_path / "d.yaml").write_text("train: images/train\nval: train.txt\ntest: /abs\nnames: [a]\n")
    data = config.dataset(tmp_path / "d.yaml")
    assert data["path"] == str(tmp_path) and config.split_folder(data, "train") == tmp_path / "images" / "train"
    for split in ("val", "names"):
        with pytest.raises(ContractError):
            config.split_folder(data, split)
    assert config.unportable(tmp_path, config.mapping(tmp_path / "d.yaml")) == {"val": "absolute;repeated;missing", "test": "absolute"}
    assert config.group_caps(["ship=0.1"], 0.2) == {"ship": 0.1, "aircraft": 0.2, "vehicle": 0.2}
    for bad in ("ship", "boat=0.1", "ship=2", "ship=x"):
        with pytest.raises(ContractError):
            config.group_caps([bad], 0.2)
    assert config.metrics('{"a": 1}') == {"a": 1}
    with pytest.raises(ContractError):
        config.metrics()
    point = {"confidence": 0.4, "nms_iou": 0.5, "class_aware_matching": True, "overall": {}, "per_group": {}, "competition_ranking_items": {}, "overall_safety_gate": {}}
    frozen = config.frozen_point(point, "best", "point.v1", model="m", data_yaml="d", image_size=640, batch=8, max_det=300)
    assert config.checked_point(json.loads(json.dumps(frozen)), "point.v1") == frozen
    for bad in ({"batch": True}, {"confidence": 2}, {"class_aware_matching": False}, {"iou_thresholds": {}}, {"schema_version": "x"}):
        with pytest.raises(ContractError):
            config.checked_point(frozen | bad, "point.v1")
    facts = config.snapshot(tmp_path / "d.yaml", tmp_path / "kept", "data")
    assert facts["sha256"] == config.file_digest(facts["snapshot"])
    for how in ("copy", "hardlink", "symlink"):
        config.placed(tmp_path / "d.yaml", tmp_path / how / "d.yaml", how)
        config.placed(tmp_path / "d.yaml", tmp_path / how / "d.yaml", how)
        with pytest.raises(ContractError):
            config.placed(tmp_path / "train.txt", tmp_path / how / "d.yaml", how)
    made = config.dataset_files(tmp_path / "d.yaml", {tmp_path / "l.yaml": "/here", tmp_path / "s.yaml": "/there"}, "id")
    assert config.dataset(tmp_path / "s.yaml")["path"] == "/there" and len(made) == 2
    (tmp_path / "folds.json").write_text(json.dumps({"read_only": True, "folds": 2, "summaries": [{"fold": 1}, {"fold": 0}]}))
    assert config.fold_manifest(tmp_path, 2)["folds"] == 2
    with pytest.raises(ContractError):
        config.fold_manifest(tmp_path, 3)
    assert config.with_digests({"r": {"checkpoint": str(tmp_path / "d.yaml")}, "q": {}}, {"q": {"map": 1}})["q"] == {"map": 1, "sha256": None}
