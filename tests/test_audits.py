import functools
import hashlib
import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from skylode.functions import names, numbers
from skylode.operators import audits, ledger, mining, prototypes, similarity, splits
from skylode.operators.graph import connected_components


def test_grids():
    assert len(numbers.grid(0.3, 0.35, 0.01)) == 6
    assert numbers.grid(0.45, 0.55, 0.05) == [0.45, 0.5, 0.55]
    with pytest.raises(ValueError):
        numbers.grid(1, 0, 0.1)


def test_identities_of_names(spark):
    f = F.col("f")
    rows = spark.createDataFrame([("01-PAN-X-L00001-CCD3_5_crop7.jpg",)], "f string")
    both = rows.select(names.crop_identities(f).alias("x")).first()["x"]
    assert tuple(both) == ("01-PAN-X-L00001-CCD3_5", "01-PAN-X-L00001")
    families = {"L00000010061": "L-number", "1_3_100_10300": "1_3_*", "E103.9_N1.2_abc": "other:E103.9", "AUAU12": "AUAU*"}
    rows = spark.createDataFrame([(k,) for k in families], "f string")
    assert {r.f: r.s for r in rows.select("f", names.scene_family(f).alias("s")).collect()} == families
    rows = spark.createDataFrame([("W120.5_S3.5_20230101_L1A0000124-PAN1.tif",), ("02-pan-20240305-11-22-L00000012345-CCD3_5.jpg",)], "f string")
    assert [r.s for r in rows.select(names.conservative_scene(f).alias("s")).collect()] == ["geo_site:-120:-04", "pan_strip:02-PAN-20240305-11"]


def test_packed_counts_round_trip(spark):
    row = spark.range(1).select(names.packed(F.create_map(F.lit(3), F.lit(1), F.lit(1), F.lit(2), F.lit(7), F.lit(0))).alias("t"))
    assert row.first()["t"] == "1:2;3:1"
    assert row.select(names.unpacked(F.col("t")).alias("m")).first()["m"] == {"1": 2, "3": 1}


def test_hamming_pairs_equal_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(63) for _ in range(20)]
    rows = [(i, base[i % 20] ^ sum(1 << r.randrange(63) for _ in range(r.randint(0, 3))), "ab"[i % 2]) for i in range(120)] + [(999, None, "a")]
    df = spark.createDataFrame(rows, "id long, hash long, s string")
    for distance in (0, 2, 5):
        expected = {(a[0], b[0]) for a in rows[:-1] for b in rows[:-1] if a[0] < b[0] and bin(a[1] ^ b[1]).count("1") <= distance}
        assert {(x.left_id, x.right_id) for x in similarity.hamming_pairs(df, distance).collect()} == expected
        apart = {(a, b) for a, b in expected if a % 2 != b % 2}
        assert {(x.left_id, x.right_id) for x in similarity.hamming_pairs(df, distance, apart="s").collect()} == apart


def test_neighbours_are_never_of_the_same_split(spark):
    rows = [(0, "train", [1.0, 0.0, 0.0]), (1, "train", [0.9, 0.1, 0.0]), (2, "val", [1.0, 0.05, 0.0]), (3, "test", [0.0, 1.0, 0.0]), (4, "test", None)]
    found = similarity.cross_split_topk(spark.createDataFrame(rows, "id long, split string, embedding array<double>"), 2).collect()
    assert len(found) == 8 and all(r.query_split != r.split for r in found)
    assert next(r.id for r in found if r.query_id == 0 and r.rank == 1) == 2
    empty = spark.createDataFrame([], "id long, split string, embedding array<double>")
    assert similarity.cross_split_topk(empty, 2).count() == 0


def shuffled(spark, run):
    """Bytes that a run puts into shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        found = sc.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    run()
    return written() - before


def nearest(rows, k):
    """What the search must give, pair by pair."""
    out = []
    sums = lambda a, b: functools.reduce(lambda s, x: s + x, (x * y for x, y in zip(a, b, strict=True)), 0.0)
    usable = [r for r in rows if None not in (r[0], r[2]) and math.isfinite(sums(r[2], r[2]))]
    for i, s, v in usable:
        found = []
        for j, t, w in usable:
            if s != t:
                n = sums(v, v) * sums(w, w)
                c = max(-1.0, min(1.0, sums(v, w) / math.sqrt(n))) if n else 0.0
                found.append((-math.copysign(math.floor(abs(c) * 1e9 + 0.5), c), j, t, c))
        out += [(i, s, rank, j, t, c) for rank, (_, j, t, c) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_equal_brute_force_with_copies_zeros_and_what_is_not_finite(spark, kind):
    r = random.Random(6)
    base = [[float(r.randint(-3, 3)) for _ in range(5)] for _ in range(40)] + [[0.0] * 5]
    # One vector very often, copies in all splits, vectors that differ by less than single precision tells.
    rows = [(i * 7 % 401, "train" if i % 20 < 14 else "val" if i % 20 < 17 else "test", base[0] if i % 3 == 0 else base[r.randrange(41)]) for i in range(400)]
    rows = [(i, s, v if n % 5 or not any(v) else [v[0] * (1 + n * 1e-7) + 1, *v[1:]]) for n, (i, s, v) in enumerate(rows)]
    rows += [(1000, "val", [float("nan")] * 5), (1001, "train", [float("inf"), 1.0, 0.0, 0.0, 0.0]), (1002, "test", None), (None, "val", base[1])]
    df = spark.createDataFrame(rows, f"id long, split string, embedding array<{kind}>").repartition(3)
    if kind == "float":
        rows = [(i, s, v and [struct.unpack("f", struct.pack("f", x))[0] for x in v]) for i, s, v in rows]
    for k, block in ((3, 16), (5, 4096)):
        found = sorted(tuple(x) for x in similarity.cross_split_topk(df, k, block=block).collect())
        assert found == nearest(rows, k)


def test_neighbours_without_components_have_no_cosine_but_zero(spark):
    blank = spark.createDataFrame([(0, "train", []), (1, "val", []), (2, None, [])], "id long, split string, embedding array<double>")
    found = similarity.cross_split_topk(blank, 2).collect()
    assert sorted((r.query_id, r.query_split, r.rank, r.id, r.split, r.cosine) for r in found) == [(0, "train", 1, 1, "val", 0.0), (0, "train", 2, 2, None, 0.0), (1, "val", 1, 0, "train", 0.0), (1, "val", 2, 2, None, 0.0), (2, None, 1, 0, "train", 0.0), (2, None, 2, 1, "val", 0.0)]


def test_the_search_for_neighbours_shuffles_no_vectors(spark):
    rows = spark.range(1500).selectExpr("id", "if(id % 3 = 0, 'a', 'b') split", "transform(sequence(1, 64), x -> cast(sin(id * 64.0 + x * x) as float)) embedding").cache()
    found = []
    moved = shuffled(spark, lambda: found.extend(similarity.cross_split_topk(rows, 2, block=64).collect()))
    assert len(found) == 3000
    assert moved < 1500 * 64 * 4


def test_a_summary_of_neighbours_moves_their_pairs_alone(spark):
    rows = spark.range(40000).selectExpr("id * 7919 % 5003 query_id", "id * 104729 % 5009 id", "round(sin(id), 6) cosine", "id % 97 = 0 same_product", "if(id % 5 = 0, null, id % 89 = 1) nearby").cache()
    held = rows.collect()
    found = []
    moved = shuffled(spark, lambda: found.extend(similarity.neighbour_summary(rows, 0.0, 0.7).collect()))
    chosen = [r for r in held if r.cosine >= 0 or r.same_product or r.nearby]
    pairs = {(min(r.query_id, r.id), max(r.query_id, r.id)) for r in chosen}
    expected = (len(held), len(chosen), len(pairs), sum(r.cosine >= 0.7 for r in held), sum(r.same_product for r in held), sum(bool(r.nearby) for r in held))
    assert tuple(found[0])[:6] == expected
    assert tuple(found[0])[6:] == pytest.approx([*np.quantile([r.cosine for r in held], [0.5, 0.9, 0.95, 0.99]), max(r.cosine for r in held)], abs=1e-12)
    assert moved < 40 * len(held)


def test_components_equal_a_plain_search(spark):
    r = random.Random(4)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(None, 3), (7, 7)]
    found = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    assert found == {x: root(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_chains_show_changes(spark):
    rows = [("l", i, f"p{i}") for i in range(1, 6)]
    chain = ledger.build_chain(spark.createDataFrame(rows, "ledger string, sequence long, payload string"))
    assert ledger.verify_chain(chain).count() == 0
    assert chain.orderBy("sequence").first()["previous"] == "0" * 64
    changed = chain.withColumn("payload", F.when(F.col("sequence") == 3, "x").otherwise(F.col("payload")))
    assert [(r.sequence, r.problem) for r in ledger.verify_chain(changed).collect()] == [(3, "digest")]
    lost = chain.where("sequence != 2")
    assert ledger.verify_chain(lost).orderBy("sequence").first()["problem"] == "sequence"


def test_timing_weighs_images(spark):
    row = ledger.timing_report(spark.createDataFrame([("r", 1.0, 1), ("r", 0.4, 1)], "run_id string, seconds double, size int")).first()
    assert row["mean_ms"] == pytest.approx(700) and row["images"] == 2


def test_a_fingerprint_ignores_order(spark):
    rows = [(str(i), f"h{i}") for i in range(50)]
    a, b = (spark.createDataFrame(x, "image string, sha string") for x in (rows, rows[::-1]))
    one, two = (ledger.inventory_fingerprint(x, "image", "sha").first() for x in (a, b))
    assert one == two
    assert ledger.inventory_fingerprint(b.where("image != '3'"), "image", "sha").first() != one


def test_the_gate(spark):
    kind = "model string, map50_95 double, recall double, false_alarm_rate double, f1_ship double, f1_aircraft double, f1_vehicle double, kd_health boolean, deploy_parity boolean"
    rows = [("C0", 0.800, 0.9, 0.1, 0.91, 0.99, 0.78, True, True), ("good", 0.801, 0.9, 0.1, 0.916, 0.988, 0.79, True, True), ("low", 0.790, 0.9, 0.1, 0.916, 0.988, 0.79, True, True), ("sick", 0.801, 0.9, 0.1, 0.916, 0.988, 0.79, None, True)]
    found = {r.model: r for r in ledger.result_gate(spark.createDataFrame(rows, kind)).collect()}
    assert found["good"].passed and not found["low"].passed
    assert found["low"].failed == "map_noninferiority" and found["sick"].next_action.startswith("STOP")


def test_reviews_take_the_last_decision_of_an_unordered_pair(spark):
    pairs = spark.createDataFrame([(1, 2), (3, 4)], "left_id long, right_id long")
    reviews = spark.createDataFrame([(2, 1, "same", 1), (1, 2, "different", 2)], "left_id long, right_id long, decision string, position int")
    assert {r.left_id: r.decision for r in audits.reviewed(pairs, reviews).collect()} == {1: "different", 3: "unresolved"}


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "i int, s string")
    with pytest.raises(audits.ContractError):
        audits.require(df, s=F.col("s") == "a")
    with pytest.raises(audits.ContractError):
        audits.unique(df.union(df), "i")
    assert audits.require(df, i=F.col("i") > 0) is df


def test_equal_label_lines(spark):
    rows = spark.createDataFrame([("a", 1, "24 0.5 0.5 0.1 0.1"), ("a", 2, "0 0.5 0.5 0.1 0.1"), ("a", 3, "24  0.5 0.5 0.1 0.10"), ("a", 4, "24 0.5 0.5  0.1 0.1")], "image string, line_no int, row string")
    assert [(r.times, r.lines) for r in audits.duplicate_label_rows(rows).collect()] == [(2, "1,4")]
    assert audits.first_labels(rows).count() == 3 and audits.first_labels(rows, exact_text=False).count() == 2


def test_splits_keep_groups_whole(spark):
    r = random.Random(1)
    rows = [(f"g{i}", f, n) for i in range(30) for f, n in (("images", r.randint(1, 50 if i < 3 else 6)), (f"fine:{i % 4}", r.randint(1, 5)))]
    df = spark.createDataFrame(rows, "group string, feature string, n int")
    out = splits.grouped_split(df).collect()
    assert len(out) == 30 and {x.split for x in out} == {"train", "val", "test"}
    again = splits.grouped_split(df.orderBy(F.desc("group"))).collect()
    assert sorted(out) == sorted(again)
    folds = splits.grouped_folds(df, 3).collect()
    assert len(folds) == 30 and {x.fold for x in folds} == {0, 1, 2}


def plain_split(rows, ratios, passes=20):
    """The rule of grouped_split, group by group."""
    groups, totals = {}, {}
    for g, k, n in rows:
        groups.setdefault(g, {})[k] = n
        totals[k] = totals.get(k, 0) + n
    weight = splits.feature_weight
    md5 = lambda g: hashlib.md5(f"20260810:{g}".encode()).hexdigest()
    order = sorted(groups, key=lambda g: (-sum(weight(k) * n / totals[k] for k, n in sorted(groups[g].items())), -groups[g].get("images", 0), md5(g), g))
    counts, at = {s: dict.fromkeys(totals, 0) for s in ratios}, {}

    def cost(s):
        goal = {k: ratios[s] * t for k, t in totals.items()}
        out = sum(weight(k) * ((n - goal[k]) / max(goal[k], 3.0 if k.startswith("fine") else 1.0)) ** 2 for k, n in counts[s].items())
        return out + 50.0 * max(0.0, counts[s]["images"] / totals["images"] - ratios[s] - 0.025) ** 2

    def change(s, g, sign):
        before = cost(s)
        add(s, g, sign)
        after = cost(s)
        add(s, g, -sign)
        return after - before

    def add(s, g, sign):
        for k, n in groups[g].items():
            counts[s][k] += sign * n

    for g in order:
        at[g] = min(ratios, key=lambda s: round(change(s, g, 1), 12))
        add(at[g], g, 1)
    for _ in range(passes):
        held = dict(at)
        for g in order:
            gain = change(at[g], g, -1)
            value, best = min(((gain + change(s, g, 1), s) for s in ratios if s != at[g]), key=lambda x: round(x[0], 12))
            if value < -1e-10:
                add(at[g], g, -1)
                add(best, g, 1)
                at[g] = best
        if held == at:
            break
    return at


def test_the_split_equals_its_rule(spark):
    r = random.Random(4)
    rows = [(f"g{i}", f, r.randint(1, 9 if f == "images" else 30)) for i in range(400) for f in ("images", f"fine:{r.randrange(5)}", f"family:{i % 3}", *(["crowded_instances"] if i % 4 else []))]
    found = splits.grouped_split(spark.createDataFrame(rows, "group string, feature string, n long")).collect()
    assert {x.group: x.split for x in found} == plain_split(rows, splits.RATIOS) and len(found) == 400
    with pytest.raises(Exception, match="a feature twice"):
        splits.grouped_split(spark.createDataFrame([*rows, rows[0]], "group string, feature string, n long"))
    assert splits.grouped_split(spark.createDataFrame([], "group string, feature string, n long")).count() == 0


def test_many_groups_are_split(spark):
    n = 200_003
    features = spark.range(n).select(F.concat(F.lit("s"), "id").alias("group"), F.explode(F.array(F.lit("images"), F.concat(F.lit("fine:"), F.col("id") % 7))).alias("feature"), F.lit(1).alias("n"))
    out = {x.split: x.n for x in splits.grouped_split(features).groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("group")).collect()}
    assert sum(out.values()) == n and all(abs(out[s] / n - share) < 0.01 for s, share in splits.RATIOS.items())
    folds = {x.fold: x.n for x in splits.grouped_folds(features, 3).groupBy("fold").agg(F.countDistinct("group").alias("n")).collect()}
    assert sum(folds.values()) == n and max(folds.values()) - min(folds.values()) <= 7


def test_systematic_samples(spark):
    df = spark.range(10)
    assert [r.id for r in splits.evenly_spaced(df, 4, "id").orderBy("id").collect()] == [0, 3, 6, 9]
    assert [r.id for r in splits.evenly_spaced(df, 1, "id").collect()] == [5]
    assert splits.evenly_spaced(df, 0, "id").count() == 0 and splits.evenly_spaced(df, 99, "id").count() == 10


def test_turns_and_samples_of_a_value_with_most_rows(spark):
    r = random.Random(5)
    ids = r.sample(range(1000), 300)
    rows = [(i, "a" if n < 250 else "b" if n < 290 else None) for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "id long, turn string").repartition(5)
    lists = {t: sorted(i for i, x in rows if x == t) for t in ("a", "b")}
    expected = [i for _, _, i in sorted((n, t, i) for t, own in lists.items() for n, i in enumerate(own))]
    assert [x.id for x in splits.round_robin(df, "turn", "id").orderBy("position").collect()] == expected
    found = [(x.turn, x.id) for x in splits.evenly_spaced(df, 3, "id", by=["turn"]).collect()]
    whole = lists | {None: sorted(i for i, x in rows if x is None)}
    assert sorted(found, key=str) == sorted(((t, own[round(n * (len(own) - 1) / 2)]) for t, own in whole.items() for n in range(3)), key=str)
    assert splits.round_robin(df.limit(0), "turn", "id").count() == 0


def test_copies_of_a_hash_meet_across_splits_alone(spark):
    rows = [(i, 7, "a") for i in range(20)] + [(100, 7, "b"), (101, 6, None), (102, 6, None), (103, 7, None)]
    found = similarity.hamming_pairs(spark.createDataFrame(rows, "id long, hash long, s string"), 1, apart="s").collect()
    assert {(x.left_id, x.right_id) for x in found} == {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[2] != b[2]}
    assert len(found) == len(set(found))


def bits(a, b):
    return bin((a ^ b) % (1 << 64)).count("1")


def crowded_rows():
    """Hashes that share most chunks, some of them often, with sign bits, null values and ids."""
    r = random.Random(3)
    base = [r.getrandbits(64) - (1 << 63) for _ in range(6)]
    turn = lambda h, at: (h % (1 << 64) ^ sum(1 << b for b in at)) - (1 << 63)
    rows = [(i, turn(base[i % 6], {r.choice((0, 1, 2, 31, 32, 62, 63)) for _ in range(r.randint(0, 3))}), r.choice("abc") if r.random() > 0.1 else None) for i in range(150)]
    return rows, [*rows, (999, None, "a"), (None, 5, "a")]


@pytest.mark.parametrize("crowd, block", [(0, 1), (3, 2), (512, 256)])
def test_hot_keys_and_large_classes_lose_no_pair(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(similarity, "CROWD", crowd)
    monkeypatch.setattr(similarity, "BLOCK", block)
    rows, all_rows = crowded_rows()
    df = spark.createDataFrame(all_rows, "id long, hash long, s string")
    for distance in (1, 2):
        expected = sorted((a[0], b[0], bits(a[1], b[1])) for a in rows for b in rows if a[0] < b[0] and bits(a[1], b[1]) <= distance)
        assert sorted(map(tuple, similarity.hamming_pairs(df, distance).collect())) == expected
        apart = [x for x in expected if rows[x[0]][2] != rows[x[1]][2]]
        assert sorted(map(tuple, similarity.hamming_pairs(df, distance, apart="s").collect())) == apart


def test_reviews_meet_rows_and_not_pairs(spark, monkeypatch, tmp_path):
    import duckdb

    from skylode.plans import leakage

    keys = [(4096 * i, i % 3) for i in range(200)] + [(4096 * i + 1, i % 3) for i in range(100)]
    spark.createDataFrame(keys, "c_custkey long, c_nationkey int").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    met, plain = [], audits.reviewed
    monkeypatch.setattr(audits, "reviewed", lambda pairs, reviews: met.extend([pairs.count(), reviews.count()]) or plain(pairs, reviews))
    found = sorted((x.decision, x.distance, x.n) for x in leakage.review_join(spark, str(tmp_path)).collect())
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet/*.parquet'")
    assert found == sorted(duck.execute(f"SELECT decision, distance, n FROM ({leakage.ORACLES['review_join']})").fetchall())
    assert sum(x[2] for x in found) > 2000 and max(met) <= 3 * len(keys)


@pytest.mark.parametrize("crowd", [3, 512])
def test_class_pairs_count_what_rows_give(spark, monkeypatch, crowd):
    monkeypatch.setattr(similarity, "CROWD", crowd)
    rows, all_rows = crowded_rows()
    out = similarity.hamming_class_pairs(spark.createDataFrame(all_rows, "id long, hash long, s string"), 2, "s").collect()
    found, expected = {}, {}
    for x in out:
        assert x.pairs > 0 and bits(x.left_hash, x.right_hash) == x.distance
        key = frozenset([(x.left_hash, x.left_s), (x.right_hash, x.right_s)])
        assert key not in found
        found[key] = x.pairs
    for a in rows:
        for b in rows:
            if a[0] < b[0] and bits(a[1], b[1]) <= 2:
                key = frozenset([a[1:], b[1:]])
                expected[key] = expected.get(key, 0) + 1
    assert found == expected


def test_prototypes_leave_their_scene_out(spark):
    rows = [("fine:4", "a", [0.0, 0.0, 1.0]), *[("fine:4", "b", [2.0, 0.0, 0.0])] * 3, ("fine:4", "c", None)]
    sums = prototypes.vector_sums(spark.createDataFrame(rows, "key string, scene string, embedding array<double>"), "key", "scene")
    found = {r.scene: (r.n, r.prototype) for r in prototypes.leave_one_out(sums, min_count=2).collect()}
    assert found["a"] == (3, [1.0, 0.0, 0.0]) and found["b"] == (1, None)


def test_the_background_cascade(spark):
    box = (100.0, 100.0, 120.0, 120.0)
    kind = "image string, pi int, grp string, reason string, score double, nearest_iou double, box struct<x1:double,y1:double,x2:double,y2:double>, width int, height int"
    rows = [("a", i, "vehicle", "background", s, 0.0, box, 640, 640) for i, s in enumerate((0.8, 0.7, 0.6, 0.5, 0.45))]
    rows += [("b", 5, "ship", "background", 0.9, 0.0, box, 640, 640), ("b", 6, "vehicle", "localization", 0.9, 0.0, box, 640, 640), ("b", 7, "vehicle", "background", 0.1, 0.0, box, 640, 640), ("b", 8, "vehicle", "background", 0.9, 0.5, box, 640, 640), ("b", 9, "vehicle", "background", 0.9, 0.0, (0.0, 0.0, 9.0, 9.0), 640, 640)]
    out = mining.safe_backgrounds(spark.createDataFrame(rows, kind)).collect()
    assert sorted(r.score for r in out if r.excluded is None) == [0.5, 0.6, 0.7, 0.8]
    assert sorted(r.excluded for r in out if r.excluded) == ["below_minimum_score", "localization", "near_any_gt", "other_group", "per_image_cap", "prediction_at_image_edge"]
