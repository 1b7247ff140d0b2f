"""Queries over vectors, events and run tables: prototypes, confusion, timing, chains, registries, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skylode.functions import boxes, numbers
from skylode.operators import ledger, mining, prototypes
from skylode.plans.derive import MANIFEST_SQL, manifest, vectors
from skylode.runtime import table

ROUND = 6


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, ROUND) for n in names})


def loo_prototypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(F.col("label").alias("key"), (F.col("id") % 7).alias("scene"), "embedding")
    out = prototypes.leave_one_out(prototypes.vector_sums(rows, "key", "scene"))
    # The prototype's first components and length; arrays are compared by value.
    return out.select("key", "scene", "n", *[F.round(F.col("prototype")[i], ROUND).alias(f"p{i}") for i in range(4)], F.round(numbers.length(F.col("prototype")), ROUND).alias("norm"))


_LOO = """WITH e AS (SELECT label AS key, vec_id % 7 AS scene, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings),
c AS (SELECT key, scene, i, sum(v[i]) AS s, count(*) AS n FROM e, range(1, 65) t(i) GROUP BY 1, 2, 3),
w AS (SELECT key, i, sum(s) AS s, sum(n) AS n FROM c GROUP BY 1, 2),
d AS (SELECT key, scene, i, w.s - c.s AS s, CAST(w.n - c.n AS BIGINT) AS n FROM c JOIN w USING (key, i)),
l AS (SELECT key, scene, n, sqrt(sum(s * s)) AS len, list(s ORDER BY i) AS v FROM d GROUP BY key, scene, n)
SELECT key, scene, n, round(v[1] / len, 6) AS p0, round(v[2] / len, 6) AS p1, round(v[3] / len, 6) AS p2, round(v[4] / len, 6) AS p3, 1.0::DOUBLE AS norm FROM l"""


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("id", F.col("label").alias("y"), F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10.0).alias("logits"))


def confusion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.array_position("logits", F.array_max("logits")) - 1
    return _rounded(prototypes.confusion(_logits(spark, sf_dir).withColumn("p", top), "y", "p"), "share")


_LOGITS = "g AS (SELECT vec_id AS id, label AS y, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10.0) AS z FROM embeddings)"


def temperature_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prototypes.temperature_profile(_logits(spark, sf_dir), "logits", "y", [0.5, 1.0, 2.0, 4.0])
    return _rounded(out, "mean_confidence", "mean_entropy", "mean_margin", "accuracy")


_TEMPERATURE = f"""WITH {_LOGITS}, t AS (SELECT unnest([0.5, 1.0, 2.0, 4.0]::DOUBLE[]) AS temperature),
x AS (SELECT temperature, y, z, list_transform(z, lambda v: exp((v - list_max(z)) / temperature)) AS w FROM g, t),
p AS (SELECT temperature, y, z, list_transform(w, lambda v: v / list_sum(w)) AS p FROM x)
SELECT temperature, count(*) AS n, round(avg(list_max(p)), 6) AS mean_confidence, round(avg(-list_sum(list_transform(p, lambda v: CASE WHEN v > 0 THEN v * ln(v) ELSE 0 END)) / ln(10)), 6) AS mean_entropy,
round(avg(list_max(p) - list_reverse_sort(p)[2]), 6) AS mean_margin, round(avg(CASE WHEN list_position(z, list_max(z)) - 1 = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p GROUP BY temperature"""


def prototype_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _logits(spark, sf_dir).withColumn("rule", prototypes.gate(F.col("logits"), F.col("y") % 4 != 0))
    return rows.groupBy(F.coalesce("rule", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))


_GATE = f"""WITH {_LOGITS}, x AS (SELECT y, list_transform(z, lambda v: exp(v - list_max(z))) AS w FROM g), p AS (SELECT y, list_transform(w, lambda v: v / list_sum(w)) AS p FROM x)
SELECT CASE WHEN list_max(p) < 0.7 THEN 'low_confidence' WHEN list_max(p) - list_reverse_sort(p)[2] < 0.1 THEN 'low_margin' WHEN y % 4 = 0 THEN 'wrong_coarse' ELSE 'kept' END AS rule, count(*) AS n FROM p GROUP BY 1"""


def timing_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = table(spark, sf_dir, "events").select(F.col("event_type").alias("run_id"), (F.abs("value") / 100 + 0.001).alias("seconds"), (F.col("event_id") % 8).alias("size"))
    return _rounded(ledger.timing_report(batches), "total_seconds", "mean_ms", "p50_ms", "p95_ms", "throughput")


_TIMING = """WITH b AS (SELECT event_type AS run_id, abs(value) / 100 + 0.001 AS s, event_id % 8 AS n FROM events WHERE event_id % 8 > 0), x AS (SELECT run_id, s FROM b, range(8) t(i) WHERE i < n),
q AS (SELECT run_id, quantile_cont(s, 0.5) * 1000 AS p50, quantile_cont(s, 0.95) * 1000 AS p95 FROM x GROUP BY run_id)
SELECT b.run_id, CAST(sum(n) AS BIGINT) AS images, round(sum(s), 6) AS total_seconds, round(sum(s) * 1000 / sum(n), 6) AS mean_ms, round(any_value(p50), 6) AS p50_ms, round(any_value(p95), 6) AS p95_ms,
round(sum(n) / sum(s), 6) AS throughput, max(s) <= 20 AS within_limit FROM b JOIN q USING (run_id) GROUP BY b.run_id"""


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("ledger"), F.row_number().over(w).cast("long").alias("sequence"), F.concat_ws(":", "event_id", "event_type").alias("payload"))


def chain_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each ledger."""
    return ledger.latest(ledger.build_chain(_payloads(spark, sf_dir)), "ledger", "sequence").select("ledger", "sequence", "previous", "sha")


_CHAIN = """WITH p AS (SELECT user_id AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, CAST(event_id AS VARCHAR) || ':' || event_type AS payload FROM events),
l AS (SELECT ledger, list(payload ORDER BY sequence) AS ps, count(*) AS n FROM p GROUP BY ledger),
r AS (SELECT ledger, n, list_reduce(ps, lambda acc, x: list_append(acc, sha256('{"payload":"' || x || '","previous_event_sha256":"' || acc[-1] || '","sequence":' || CAST(len(acc) AS VARCHAR) || '}')), [repeat('0', 64)]) AS hs FROM l)
SELECT ledger, n AS sequence, hs[n] AS previous, hs[n + 1] AS sha FROM r"""


def chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of which every 50th event has been changed or lost."""
    events = ledger.build_chain(_payloads(spark, sf_dir))
    number = F.substring_index("payload", ":", 1).cast("long")
    broken = events.where(number % 50 != 3).withColumn("payload", F.when(number % 50 == 1, F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return ledger.verify_chain(broken).groupBy("problem").agg(F.count("*").alias("n"))


_VERIFY = """WITH p AS (SELECT user_id AS ledger, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, event_id FROM events), k AS (SELECT * FROM p WHERE event_id % 50 <> 3),
o AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY sequence) AS rn, coalesce(lag(sequence) OVER (PARTITION BY ledger ORDER BY sequence), 0) AS before FROM k)
SELECT problem, count(*) AS n FROM (SELECT CASE WHEN sequence <> rn THEN 'sequence' WHEN sequence <> before + 1 THEN 'previous' WHEN event_id % 50 = 1 THEN 'digest' END AS problem FROM o) WHERE problem IS NOT NULL GROUP BY problem"""


def canonical_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = manifest(spark, sf_dir)
    per = ledger.inventory_fingerprint(m, "doc_id", "sha", by="split")
    whole = ledger.inventory_fingerprint(m, "doc_id", "sha").select(F.lit("all").alias("split"), "fingerprint", "n")
    return per.unionByName(whole)


_PRINT = """SELECT {0} AS split, sha256(string_agg(h, '' ORDER BY b)) AS fingerprint, CAST(sum(n) AS BIGINT) AS n FROM (SELECT {0} AS split, d[1:4] AS b, sha256(string_agg(d, '' ORDER BY d)) AS h, count(*) AS n
FROM (SELECT split, sha256(CAST(doc_id AS VARCHAR) || chr(0) || sha || chr(0)) AS d FROM m) GROUP BY 1, 2) GROUP BY 1"""


def _epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    position = F.row_number().over(w).cast("long")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), position.alias("position"), F.round(F.abs("value"), 4).alias("map"), F.col("event_id"))
    return rows.withColumn("epoch", F.col("position") - F.when(F.col("event_id") % 17 == 0, 2).otherwise(0))


_EPOCHS = """e0 AS (SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS position, round(abs(value), 4) AS map, event_id FROM events),
e AS (SELECT run_id, position, map, position - CASE WHEN event_id % 17 = 0 THEN 2 ELSE 0 END AS epoch FROM e0), o AS (SELECT *, lag(epoch) OVER (PARTITION BY run_id ORDER BY position) AS before FROM e)"""


def registry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.registry_summary(_epochs(spark, sf_dir))


def epoch_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.monotonic_problems(_epochs(spark, sf_dir))


def kd_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.when(F.col("event_id") % 997 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("experiment"), (F.col("event_id") % 101 != 0).alias("healthy"), bad.alias("loss"))
    return _rounded(ledger.health(rows, ["loss"]), "mean_loss", "least_loss", "most_loss")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models that stand for nations; nation 0 is the baseline."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum(F.floor("c_acctbal")).alias("s"))
    k, v = F.col("c_nationkey").cast("long"), (F.col("s") % 23).cast("long")
    return c.select(
        F.when(k == 0, "C0").otherwise(F.concat(F.lit("C"), k)).alias("model"),
        (F.lit(0.8) + (k % 5) / 1000.0).alias("map50_95"),
        (F.lit(0.84) + (k % 7) / 100.0).alias("recall"),
        (F.lit(0.15) + (k % 8) / 100.0).alias("false_alarm_rate"),
        (F.lit(0.9) + (k % 3) / 100.0).alias("f1_ship"),
        (F.lit(0.99) - (k % 4) / 500.0).alias("f1_aircraft"),
        (F.lit(0.78) + v / 1000.0).alias("f1_vehicle"),
        (k % 9 != 5).alias("kd_health"),
        F.when(k % 11 != 7, True).alias("deploy_parity"),
    )


def result_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ledger.result_gate(_models(spark, sf_dir))
    return _rounded(out, "delta_map50_95", "delta_f1_ship", "delta_f1_aircraft", "delta_f1_vehicle")


_MODELS = """WITH c AS (SELECT c_nationkey AS k, CAST(sum(floor(c_acctbal)) AS BIGINT) % 23 AS v FROM customer GROUP BY 1),
m AS (SELECT 'C' || CAST(k AS VARCHAR) AS model, CAST(0.8 AS DOUBLE) + (k % 5) / 1000.0::DOUBLE AS mp, CAST(0.84 AS DOUBLE) + (k % 7) / 100.0::DOUBLE AS recall, CAST(0.15 AS DOUBLE) + (k % 8) / 100.0::DOUBLE AS fdr, CAST(0.9 AS DOUBLE) + (k % 3) / 100.0::DOUBLE AS ship,
 CAST(0.99 AS DOUBLE) - (k % 4) / 500.0::DOUBLE AS air, CAST(0.78 AS DOUBLE) + v / 1000.0::DOUBLE AS veh, k % 9 <> 5 AS kd, coalesce(k % 11 <> 7, false) AS dep FROM c)"""
_RESULT = f"""{_MODELS}, x AS (SELECT m.model, m.recall >= 0.85 AS c1, m.fdr <= 0.2 AS c2, m.mp - b.mp >= -0.002 AS c3, m.air - b.air >= -0.005 AS c4, greatest(m.ship - b.ship, m.veh - b.veh) >= 0.005 AS c5, m.kd, m.dep, m.mp - b.mp AS d1, m.ship - b.ship AS d2, m.air - b.air AS d3, m.veh - b.veh AS d4
 FROM m, (SELECT * FROM m WHERE model = 'C0') b WHERE m.model <> 'C0')
SELECT model, c1 AND c2 AND c3 AND c4 AND c5 AND kd AND dep AS passed,
concat_ws(';', CASE WHEN NOT c1 THEN 'competition_recall' END, CASE WHEN NOT c2 THEN 'competition_fdr' END, CASE WHEN NOT c3 THEN 'map_noninferiority' END, CASE WHEN NOT c4 THEN 'aircraft_noninferiority' END, CASE WHEN NOT c5 THEN 'weak_group_gain' END, CASE WHEN NOT kd THEN 'kd_health' END, CASE WHEN NOT dep THEN 'deploy_parity' END) AS failed,
round(d1, 6) AS delta_map50_95, round(d2, 6) AS delta_f1_ship, round(d3, 6) AS delta_f1_aircraft, round(d4, 6) AS delta_f1_vehicle,
CASE WHEN NOT (kd AND dep) THEN '{ledger.ACTIONS["stop"]}' WHEN NOT (c1 AND c2) THEN '{ledger.ACTIONS["gates"]}' WHEN NOT (c3 AND c4) THEN '{ledger.ACTIONS["damage"]}' WHEN NOT c5 THEN '{ledger.ACTIONS["hold"]}' ELSE '{ledger.ACTIONS["advance"]}' END AS next_action FROM x"""


def safety_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    timing = F.when(F.length("model") > 2, F.col("recall") < 0.89)
    return ledger.safety_gate(_models(spark, sf_dir).withColumn("timing_ok", timing)).select("model", "recall_ok", "alarm_ok", "gate")


def nested_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as nested entries of turns, packed by role, and their canonical digest."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t"))
    roles = F.array_join(F.transform("t", lambda x: x["role"]), ";")
    return rows.select("conv_id", F.size("t").cast("long").alias("n_turns"), roles.alias("roles"), numbers.digest(numbers.canonical(conv=F.col("conv_id"), roles=roles)).alias("sha"))


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles along sides that are as long as parts' sizes make them."""
    side = (F.col("p_size") * 100 + 200).cast("int")
    rows = table(spark, sf_dir, "part").select("p_partkey", boxes.tile_starts(side, 800, 480).alias("s"))
    return rows.select("p_partkey", F.size("s").cast("long").alias("n_tiles"), F.array_max("s").cast("long").alias("last_start"))


def kd_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", F.round(ledger.schedule(F.col("p_partkey") % 60, 5, 15, 30, 0.1), ROUND).alias("weight"))
    return rows


def replay_score_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule cascade over customers: the first rule that each fails."""
    rules = [("segment", F.col("c_mktsegment") != "BUILDING"), ("balance", F.col("c_acctbal") > 0), ("nation", F.col("c_nationkey") < 20)]
    rows = mining.cascade(table(spark, sf_dir, "customer"), rules)
    return rows.groupBy(F.coalesce("excluded", F.lit("kept")).alias("rule")).agg(F.count("*").alias("n"))


def class_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label pairs over sources, with totals."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    level = F.when(F.grouping_id() == 0, "cell").when(F.grouping_id() == 3, "source").otherwise("all")
    out = rows.groupingSets([["source", "quality", "toxic"], ["source"], []], "source", "quality", "toxic").agg(level.alias("level"), F.count("*").alias("n"))
    return out.select("level", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        loo_prototypes, confusion_report, temperature_profile, prototype_gate, timing_percentiles, chain_build, chain_verify, canonical_fingerprint, registry_summary, epoch_problems, kd_health,
        result_gate, safety_gate, nested_manifest, tile_grid, kd_schedule, replay_score_order, class_balance,
    )
}
ORACLES = {
    "loo_prototypes": _LOO,
    "confusion_report": f"WITH {_LOGITS}, c AS (SELECT y AS truth, CAST(list_position(z, list_max(z)) - 1 AS BIGINT) AS predicted, count(*) AS n FROM g GROUP BY 1, 2) SELECT truth, predicted, n, round(n / sum(n) OVER (PARTITION BY truth), 6) AS share FROM c",
    "temperature_profile": _TEMPERATURE,
    "prototype_gate": _GATE,
    "timing_percentiles": _TIMING,
    "chain_build": _CHAIN,
    "chain_verify": _VERIFY,
    "canonical_fingerprint": f"WITH {MANIFEST_SQL} {_PRINT.format('split')} UNION ALL {_PRINT.format(chr(39) + 'all' + chr(39))}",
    "registry_summary": f"""WITH {_EPOCHS} SELECT run_id, count(*) AS epochs, arg_max(epoch, {{'m': map, 'p': -position}}) AS best_epoch, max(map) AS best, arg_max(epoch, position) AS last_epoch, arg_max(map, position) AS last,
bool_and(coalesce(epoch > before, true)) AS monotonic FROM o GROUP BY run_id""",
    "epoch_problems": f"WITH {_EPOCHS} SELECT run_id, position, epoch, CASE WHEN epoch = before THEN 'repeated' ELSE 'decreasing' END AS problem FROM o WHERE epoch <= before",
    "kd_health": """WITH h AS (SELECT user_id % 20 AS experiment, event_id % 101 <> 0 AS healthy, event_id % 997 = 0 AS bad, value FROM events)
SELECT experiment, count(*) AS records, count(*) FILTER (healthy) AS healthy, NOT bool_or(bad) AS all_finite, round(avg(value) FILTER (NOT bad), 6) AS mean_loss, round(min(value) FILTER (NOT bad), 6) AS least_loss, round(max(value) FILTER (NOT bad), 6) AS most_loss,
NOT bool_or(bad) AND bool_and(healthy) AS health_pass FROM h GROUP BY experiment""",
    "result_gate": _RESULT,
    "safety_gate": _MODELS + " SELECT model, recall >= 0.85 AS recall_ok, fdr <= 0.2 AS alarm_ok, recall >= 0.85 AND fdr <= 0.2 AND CASE WHEN length(model) > 2 THEN recall < 0.89 END AS gate FROM m",
    "nested_manifest": """WITH t AS (SELECT conv_id, count(*) AS n_turns, string_agg(role, ';' ORDER BY turn, role) AS roles FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns, roles, sha256('{"conv":' || CAST(conv_id AS VARCHAR) || ',"roles":"' || roles || '"}') AS sha FROM t""",
    "tile_grid": """WITH s AS (SELECT p_partkey, greatest(p_size * 100 + 200 - 800, 0) AS last FROM part)
SELECT p_partkey, CAST(last // 480 + 1 + CASE WHEN last % 480 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS n_tiles, CAST(last AS BIGINT) AS last_start FROM s""",
    "kd_schedule": """WITH e AS (SELECT p_partkey, p_partkey % 60 AS e FROM part)
SELECT p_partkey, round(CASE WHEN e < 5 THEN (e + 1) / 5.0 WHEN e < 20 THEN 1.0 ELSE 0.1 + 0.45 * (1 + cos(least(greatest((e - 20) / 30.0, 0), 1) * 3.141592653589793)) END, 6)::DOUBLE AS weight FROM e""",
    "replay_score_order": "SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' WHEN c_acctbal <= 0 THEN 'balance' WHEN c_nationkey >= 20 THEN 'nation' ELSE 'kept' END AS rule, count(*) AS n FROM customer GROUP BY 1",
    "class_balance": """SELECT CASE GROUPING(source, quality, toxic) WHEN 0 THEN 'cell' WHEN 3 THEN 'source' ELSE 'all' END AS level, coalesce(source, '') AS source, coalesce(quality, -1) AS quality, coalesce(toxic, -1) AS toxic, count(*) AS n
FROM labels JOIN documents USING (doc_id) GROUP BY GROUPING SETS ((source, quality, toxic), (source), ())""",
}
