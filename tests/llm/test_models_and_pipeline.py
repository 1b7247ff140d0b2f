import random

import numpy as np
import pytest
from conftest import SMALL

from skylode.llm import ann, quality, queries


def test_the_rotation_and_the_scan_find_the_nearest():
    random_ = np.random.default_rng(1)
    points = random_.standard_normal((3000, 24))
    query = random_.standard_normal(24)
    far = ((points - query) ** 2).sum(axis=1)
    places, read = ann.adaptive_scan(query, points, 10)
    assert len({*places} & {*np.argsort(far)[:10]}) >= 9 and read < points.size
    bound = np.sort(far)[9]
    places, less = ann.adaptive_scan(query, points, 10, bound)
    assert less < read


def brute(rows, queries_, top):
    fine = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8}
    out = {}
    for q in queries_:
        if q in fine:
            scores = sorted((-float(v @ fine[q]), i) for i, v in fine.items() if i != q)
            out[q] = scores[:top]
    return out


def test_neighbours_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, rows[5][1]) for i in range(300, 360)]  # many copies
    rows += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None] + [0.0] * 6), (404, [float("nan")] * 8), (405, [float("inf")] * 8), (406, [1.0] * 3), (None, [1.0] * 8), (7, rows[7][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, class string, list int")
    asked = df.where("vec_id % 5 = 0")
    held = [(r.vec_id, r.embedding) for r in df.collect()]
    want = brute(held, {i for i, _ in held if i is not None and i % 5 == 0}, 20)
    out = ann.nearest(df, asked, lists=6, probes=6).collect()
    got = {}
    for x in sorted(out, key=lambda x: (x.query_id, x["rank"])):
        got.setdefault(x.query_id, []).append((-x.score, x.vec_id))
    assert got.keys() == want.keys()
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.95 * sum(map(len, want.values()))
    assert all(len(got[q]) == 20 and got[q] == sorted(got[q]) for q in want)
    few = ann.nearest(df.where("vec_id < 5"), df.where("vec_id = 0")).collect()
    assert [x["rank"] for x in sorted(few, key=lambda x: x["rank"])] == [1, 2, 3, 4]
    assert ann.nearest(df.limit(0), df).count() == 0


def test_equal_vectors_have_equal_scores_and_stand_by_id(spark):
    random_ = np.random.default_rng(5)
    base = random_.standard_normal((700, 12)).astype(np.float32)
    base[1] = -base[0]
    rows = [(3 * i + copy, base[i].tolist()) for i in range(700) for copy in range(3 if i % 2 else 2)]
    rows += [(9000, [0.0, *base[4, 1:].tolist()]), (9001, [-0.0, *base[4, 1:].tolist()]), (9002, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    held = {i: np.array(v, np.float64) for i, v in rows}
    out = {}
    for x in ann.nearest(df, df.where("vec_id % 20 = 0 or vec_id >= 9000"), lists=7, probes=5).collect():
        out.setdefault(x.query_id, []).append((x["rank"], -x.score, x.vec_id))
    assert len(out) == len([i for i in held if i % 20 == 0 or i >= 9000]) - 1 and 9002 not in out
    for q, found in out.items():
        found.sort()
        assert [r for r, _, _ in found] == [*range(1, 21)]
        assert [x[1:] for x in found] == sorted(x[1:] for x in found), q
        by_vector = {}
        for _, score, i in found:
            by_vector.setdefault((held[i] + 0.0).tobytes(), {"scores": set(), "ids": []})
            by_vector[(held[i] + 0.0).tobytes()]["scores"].add(score)
            by_vector[(held[i] + 0.0).tobytes()]["ids"].append(i)
        last = (held[found[-1][2]] + 0.0).tobytes()
        for vector, own in by_vector.items():
            every = [i for i, v in held.items() if len(v) == 12 and (v + 0.0).tobytes() == vector and i != q]
            assert len(own["scores"]) == 1 and own["ids"] == sorted(own["ids"])
            assert own["ids"] == sorted(every)[: len(own["ids"])] and (vector == last or len(own["ids"]) == len(every))


def test_recall_on_the_small_table(spark):
    out = queries.op5_nearest(spark, SMALL).collect()
    held = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    fine = {i: np.array(v, float) for i, v in held}
    hit = total = 0
    for q in {x.query_id for x in out}:
        true = sorted((-float(v @ fine[q]), i) for i, v in fine.items() if i != q)[:20]
        hit += len({i for _, i in true} & {x.vec_id for x in out if x.query_id == q})
        total += 20
    assert hit / total >= 0.9 and len(out) == total


def corpus(n, seed=1):
    r = random.Random(seed)
    stock = ["".join(r.choice("abcdefg") for _ in range(r.randint(3, 8))) for _ in range(300)]
    out = []
    for i in range(n):
        body = [r.choice(stock) for _ in range(r.randint(20, 80))]
        kind = i % 4
        if kind == 0:
            body = [w.upper() + "!!" for w in body]
        elif kind == 1:
            for _ in range(4):
                body[r.randrange(len(body))] = "nasty" + r.choice(["er", "ing", ""])
        out.append((i, " ".join(body), 0 if kind == 0 else 1, int(kind == 1)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(2400)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _, _ in rows], "doc_id long, text string, grade string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows if i < 1800], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert np.all(np.diff(model.thresholds) > 0)
    out = {r.doc_id: r for r in quality.grade_documents(docs, model).collect()}
    held = [(out[i], q, x) for i, _, q, x in rows if i >= 1800]
    right = sum(r.kept == (q == 1 and x == 0) for r, q, x in held)
    assert right / len(held) > 0.95
    assert all(0 <= r.expected_grade <= 2 and 0 <= r.tail_probability <= 1 for r, _, _ in held)


def test_grading_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "c"), (1, "", "c"), (None, "a b", "c"), (2, "x" * 50000, None), (3, "w " * 20000, "c")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(1, None, 1), (1, 1, None), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    for model in (quality.train(docs, labels), quality.train(docs, labels.limit(0)), quality.fit([], np.zeros(0, int))):
        out = quality.grade_documents(docs, model)
        assert out.count() == 5 and out.where("kept is null or expected_grade is null").count() == 0
        assert quality.keep_documents(docs, model).columns == docs.columns
        assert quality.grade_documents(docs.limit(0), model).count() == 0


def test_the_sample_is_bounded(spark):
    rows = corpus(200)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q, x) for i, _, q, x in rows], "doc_id long, quality int, toxic int")
    assert quality.train(docs, labels, sample=0).weights.any() == False  # noqa: E712
    assert quality.train(docs, labels, sample=50).weights.any()


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    held = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, held, SMALL)
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        assert 0 < out.count() <= held.count()
        held = out
    from skylode.llm import dedup, secrets, simhash

    assert dedup.exact_duplicates(held).where("group_size > 1").count() == 0
    assert secrets.scan_secrets(held).where("n_assign + n_access + n_hex > 0").count() == 0
    before = spark.read.parquet(f"{tmp_path}/exact_dedup")
    components = simhash.alike_documents(before).select("component_id").distinct().count()
    assert spark.read.parquet(f"{tmp_path}/near_dedup").count() == components
    packed = cp.run(spark, SMALL)
    assert packed.select("doc_id").distinct().count() == held.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run_over_the_small_tables(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_stages_take_empty_documents(spark, tmp_path):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, SMALL).count() == 0


def test_the_near_stage_links_by_fingerprints(spark):
    import corpus_pipeline as cp
    from skylode.llm import simhash

    line = "one line that is said again and "
    texts = [line * 400 + " ".join(f"{x}{i}" for i in range(40)) for x in "abc"] + [" ".join(f"d{i}" for i in range(300)), "", None]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    groups = {x.doc_id: x.component_id for x in simhash.near_duplicates(docs).collect()}
    assert groups == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 4}
    assert sorted(x.doc_id for x in cp.near(spark, docs, "").collect()) == [0, 3, 4]
    # What the stage leaves, no fingerprint links any more.
    left = cp.near(spark, cp.exact(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), ""), "")
    found = simhash.near_duplicates(left)
    assert found.count() == found.select("component_id").distinct().count() > 100


def test_dedup_stages_leave_one_row_of_each_group(spark):
    import corpus_pipeline as cp

    long = " ".join(f"word{i}" for i in range(60))
    rows = [(7, "x dup"), (7, "y other"), (9, "X dup"), (1, "same text"), (1, "same text"), (1, "Same text"), (None, "no id"), (None, "no id"), (None, None), (None, ""), (4, long), (4, long + " more"), (5, long.upper()), (None, long + " tail")]
    docs = spark.createDataFrame([(i, t, "en", {"row": t or ""}, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, key string, order map<string,string>, n_chars long")
    out = cp.exact(spark, docs, "")
    assert out.schema == docs.schema
    found = sorted([(x.doc_id or 0, (x.text or "").lower()) for x in out.collect()])
    assert found == sorted([(7, "y other"), (9, "x dup"), (1, "same text"), (0, "no id"), (0, ""), (4, long + " more"), (5, long), (0, long + " tail")])
    assert sorted(map(str, out.collect())) == sorted(map(str, cp.exact(spark, docs.repartition(7), "").collect()))
    left = cp.near(spark, out, "")
    assert left.schema == docs.schema
    assert sorted([(x.doc_id or 0, (x.text or "").lower()) for x in left.collect()]) == sorted([(7, "y other"), (9, "x dup"), (1, "same text"), (0, "no id"), (0, ""), (4, long + " more")])
    assert cp.near(spark, docs, "").count() == 6 and cp.near(spark, docs.limit(0), "").count() == cp.exact(spark, docs.limit(0), "").count() == 0
