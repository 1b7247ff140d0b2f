import random

import pytest
from pyspark.sql import functions as F

from skylode.functions import boxes
from skylode.operators import matching

DET = "image string, pi long, box struct<x1:double,y1:double,x2:double,y2:double>, score double, fine int"
GT = "image string, gi long, box struct<x1:double,y1:double,x2:double,y2:double>, fine int"


def det(spark, rows):
    return spark.createDataFrame(rows, DET).withColumn("grp", boxes.coarse_group("fine"))


def gt(spark, rows):
    return spark.createDataFrame(rows, GT).withColumn("grp", boxes.coarse_group("fine"))


def counts(spark, d, g):
    rows = matching.metrics(det(spark, d), gt(spark, g)).where("grp = 'overall'").first()
    return rows["tp"], rows["fp"], rows["fn"]


def test_a_second_detection_of_a_box_is_false(spark):
    d = [("a", 0, (1.0, 1.0, 99.0, 99.0), 0.9, 24), ("a", 1, (1.0, 1.0, 99.0, 99.0), 0.8, 24)]
    assert counts(spark, d, [("a", 0, (0.0, 0.0, 100.0, 100.0), 24)]) == (1, 1, 0)


@pytest.mark.parametrize(("fine", "expected"), [(24, (1, 0, 0)), (0, (0, 1, 1))])
def test_vehicles_have_a_lower_threshold(spark, fine, expected):
    assert counts(spark, [("a", 0, (45.0, 0.0, 145.0, 100.0), 0.9, fine)], [("a", 0, (0.0, 0.0, 100.0, 100.0), fine)]) == expected


def test_without_boxes_a_detection_is_false(spark):
    assert counts(spark, [("a", 0, (0.0, 0.0, 10.0, 10.0), 0.9, 4)], []) == (0, 1, 0)


def test_one_detection_takes_one_box(spark):
    g = gt(spark, [("a", 0, (0.0, 0.0, 10.0, 10.0), 0), ("a", 1, (0.0, 0.0, 10.0, 10.0), 0)])
    assert matching.greedy_matches(det(spark, [("a", 0, (0.0, 0.0, 10.0, 10.0), 0.9, 0)]), g).count() == 1


def test_no_predictions_have_precision_one(spark):
    row = matching.with_rates(spark.createDataFrame([(0, 0, 5)], "tp long, fp long, fn long")).first()
    assert (row["precision"], row["f1"]) == (1.0, 0.0)


def iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    return both / max((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both, 1e-9)


@pytest.mark.parametrize("class_aware", [True, False])
def test_matching_equals_a_plain_loop(spark, class_aware):
    r = random.Random(5)

    def box():
        x, y = r.randint(0, 40), r.randint(0, 40)
        return (float(x), float(y), float(x + r.randint(5, 30)), float(y + r.randint(5, 30)))

    d = [(str(i), j, box(), r.randint(1, 9) / 10, r.choice([0, 5, 24])) for i in range(30) for j in range(r.randint(0, 9))]
    g = [(str(i), j, box(), r.choice([0, 5, 24])) for i in range(30) for j in range(r.randint(0, 7))]
    group = lambda f: "ship" if f < 4 else "vehicle" if f == 24 else "aircraft"
    expected = set()
    for i in map(str, range(30)):
        used = set()
        for _, pi, b, _, f in sorted((x for x in d if x[0] == i), key=lambda x: (-x[3], x[1])):
            best = max(((iou(b, y[2]), -y[1], y) for y in g if y[0] == i and y[1] not in used and (not class_aware or group(y[3]) == group(f))), default=None, key=lambda t: t[:2])
            if best and best[0] >= (0.35 if group(best[2][3]) == "vehicle" else 0.5):
                used.add(best[2][1])
                expected.add((i, pi, best[2][1]))
    found = {(r.image, r.pi, r.gi) for r in matching.greedy_matches(det(spark, d), gt(spark, g), class_aware).collect()}
    assert found == expected


def test_error_classes(spark):
    g = gt(spark, [("a", i, (20.0 * i, 0.0, 20.0 * i + 10, 10.0), 0) for i in range(5)])
    current = [("a", 0, (0.0, 0.0, 10.0, 10.0), 0.9, 0)]
    low = current + [("a", 1, (20.0, 0.0, 30.0, 10.0), 0.1, 0)]
    loose = low + [("a", 2, (40.0, 0.0, 50.0, 10.0), 0.9, 0), ("a", 3, (60.0, 0.0, 70.0, 10.0), 0.9, 4), ("a", 4, (80.0, 0.0, 84.0, 10.0), 0.9, 0)]
    rows = matching.instance_errors(det(spark, current), det(spark, low), det(spark, loose), g).orderBy("gi").collect()
    assert [r.error for r in rows] == ["detected", "low_confidence", "nms_suppressed", "wrong_group", "localization"]


def test_false_positive_classes(spark):
    g = gt(spark, [("a", 0, (0.0, 0.0, 100.0, 100.0), 0), ("a", 1, (200.0, 0.0, 300.0, 100.0), 24)])
    d = [("a", 0, (0.0, 0.0, 100.0, 100.0), 0.9, 0), ("a", 1, (0.0, 0.0, 100.0, 100.0), 0.8, 0), ("a", 2, (200.0, 0.0, 300.0, 100.0), 0.7, 4), ("a", 3, (0.0, 0.0, 20.0, 100.0), 0.6, 0), ("a", 4, (500.0, 500.0, 510.0, 510.0), 0.5, 0)]
    rows = matching.false_positives(det(spark, d), g).orderBy("pi").collect()
    assert [r.reason for r in rows] == ["duplicate", "wrong_group", "localization", "background"]
    assert rows[-1].nearest_gi == -1


def test_suppression_by_group_and_by_class(spark):
    rows = [("a", 0, (0.0, 0.0, 10.0, 10.0), 0.9, 0), ("a", 1, (1.0, 0.0, 11.0, 10.0), 0.8, 1), ("a", 2, (100.0, 0.0, 110.0, 10.0), 0.7, 24)]
    assert matching.suppressed(det(spark, rows), 0.5).count() == 2
    assert matching.suppressed(det(spark, rows), 0.5, "fine").count() == 3


def test_crowded_boxes(spark):
    g = gt(spark, [("a", 0, (0.0, 0.0, 10.0, 10.0), 0), ("a", 1, (11.0, 0.0, 21.0, 10.0), 0), ("a", 2, (100.0, 100.0, 110.0, 110.0), 0)])
    assert [r.crowded for r in matching.crowded(g).orderBy("gi").collect()] == [True, True, False]


def test_operating_points(spark):
    rows = matching.with_rates(spark.createDataFrame([(0.4, 95, 5, 5), (0.8, 85, 1, 15)], "confidence double, tp long, fp long, fn long"))
    found = {r.selection: r.confidence for r in matching.operating_points(rows).collect()}
    assert found == {"gate_min_fdr": 0.8, "best_f1": 0.4, "max_recall_under_fdr": 0.4}


def test_points_of_empty_input(spark):
    rows = matching.with_rates(spark.createDataFrame([], "confidence double, tp long, fp long, fn long"))
    assert matching.operating_points(rows).count() == 0


def test_tiles_sizes_and_edges(spark):
    one = spark.range(1)
    assert one.select(boxes.tile_starts(F.lit(10000), 800, 480).alias("s")).first()["s"][-1] == 9200
    assert one.select(boxes.tile_starts(F.lit(600), 800, 480).alias("s")).first()["s"] == [0]
    assert one.select(boxes.size_bucket(F.lit(100.0)).alias("a"), boxes.size_bucket(F.lit(2500.0)).alias("b")).first() == ("small", "medium")
