"""Hash chains, fingerprints, run registries, health and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skylode.functions.numbers import canonical, digest

GENESIS = "0" * 64
#: The default limits of the result gate.
GATES = {"minimum_recall": 0.85, "maximum_fdr": 0.20, "maximum_map50_95_drop": 0.002, "maximum_aircraft_f1_drop": 0.005, "minimum_weak_group_f1_gain": 0.005}
#: What a gate tells to do next; the leading words are fixed values.
ACTIONS = {
    "stop": "STOP: the training signal or the exported model is unproven, so its accuracy says nothing yet.",
    "gates": "REJECT: recall or false alarms are outside the limits.",
    "damage": "REJECT: boxes or the aircraft group have become worse than the baseline allows.",
    "hold": "HOLD: neither ship nor vehicle gains enough; change the data or the routing before a longer run.",
    "advance": "ADVANCE: train once more from another seed and compare again.",
}


def event_digest(sequence: Column, previous: Column, payload: Column) -> Column:
    """SHA-256 of the canonical JSON of an event whose payload is text."""
    return digest(canonical(sequence=sequence, previous_event_sha256=previous, payload=payload))


def verify_chain(events: DataFrame, ledger: str = "ledger") -> DataFrame:
    """Rows (ledger, sequence, problem) of events (ledger, sequence, previous, payload, sha) that break their chain.

    The first event's previous digest is 64 zeros. A window over each ledger compares neighbours; ledgers are verified side by side.
    """
    w = Window.partitionBy(ledger).orderBy("sequence")
    before = F.coalesce(F.lag("sha").over(w), F.lit(GENESIS))
    problem = (
        F.when(F.col("sequence") != F.row_number().over(w), "sequence")
        .when(~F.col("previous").eqNullSafe(before), "previous")
        .when(~F.col("sha").eqNullSafe(event_digest(F.col("sequence"), F.col("previous"), F.col("payload"))), "digest")
    )
    return events.select(ledger, "sequence", problem.alias("problem")).where("problem is not null")


def build_chain(payloads: DataFrame, ledger: str = "ledger") -> DataFrame:
    """Events of each ledger from its payloads (ledger, sequence, payload), chained by digests. A fold over one ledger."""
    row = F.struct(F.col("sequence").cast("long").alias("sequence"), F.col("payload").alias("payload"))
    lists = payloads.groupBy(ledger).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    kind = "struct<sequence:bigint,previous:string,payload:string,sha:string>"

    def step(done: Column, x: Column) -> Column:
        previous = F.coalesce(F.try_element_at(done, F.lit(-1))["sha"], F.lit(GENESIS))
        event = F.struct(x["sequence"].alias("sequence"), previous.alias("previous"), x["payload"].alias("payload"), event_digest(x["sequence"], previous, x["payload"]).alias("sha"))
        return F.concat(done, F.array(event))

    return lists.select(ledger, F.inline(F.aggregate("rows", F.expr(f"cast(array() as array<{kind}>)"), step)))


def inventory_fingerprint(rows: DataFrame, *fields: str, by: str | None = None) -> DataFrame:
    """One row ([by,] fingerprint, n): the digest of the rows' own digests in order.

    Each row's fields, NUL-ended, are hashed; the sorted digests are hashed by their first four
    digits, and these digests again. So it doesn't depend on the order of rows, and the last step has 65,536 digests at most.
    """
    key = [by] if by else []
    text = F.concat(*[F.concat(F.coalesce(F.col(f).cast("string"), F.lit("")), F.char(F.lit(0))) for f in fields])
    each = rows.select(*key, digest(text).alias("d"))
    leaves = each.groupBy(*key, F.substring("d", 1, 4).alias("b")).agg(digest(F.array_join(F.array_sort(F.collect_list("d")), "")).alias("h"), F.count("*").alias("n"))
    return leaves.groupBy(*key).agg(digest(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "h"))), lambda x: x["h"]), "")).alias("fingerprint"), F.sum("n").alias("n"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the largest ``order``. A partial aggregate; a window would gather whole groups."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(whole, order).alias("__r")).select("__r.*")


def registry_summary(epochs: DataFrame, run: str = "run_id", metric: str = "map") -> DataFrame:
    """Rows (run_id, epochs, best_epoch, best, last_epoch, last, monotonic): the best row by metric (the first at a tie), and whether epochs only rise."""
    w = Window.partitionBy(run).orderBy("position")
    rises = F.coalesce(F.col("epoch") > F.lag("epoch").over(w), F.lit(True))
    own = epochs.withColumn("__rises", rises)
    return own.groupBy(run).agg(
        F.count("*").alias("epochs"),
        F.max_by("epoch", F.struct(metric, (-F.col("position")).alias("p"))).cast("long").alias("best_epoch"),
        F.max(metric).alias("best"),
        F.max_by("epoch", "position").cast("long").alias("last_epoch"),
        F.max_by(metric, "position").alias("last"),
        F.bool_and("__rises").alias("monotonic"),
    )


def monotonic_problems(epochs: DataFrame, run: str = "run_id") -> DataFrame:
    """Rows (run_id, position, epoch, problem) where an epoch repeats or goes back."""
    w = Window.partitionBy(run).orderBy("position")
    before = F.lag("epoch").over(w)
    problem = F.when(F.col("epoch") == before, "repeated").when(F.col("epoch") < before, "decreasing")
    return epochs.select(run, "position", "epoch", problem.alias("problem")).where("problem is not null")


def health(records: DataFrame, metrics: list[str], key: str = "experiment") -> DataFrame:
    """Rows (experiment, records, healthy, all_finite, health_pass, and mean, least, most of each metric). A NaN or infinity anywhere fails; nulls are left out."""
    finite = lambda m: F.coalesce(~F.isnan(F.col(m)) & (F.abs(F.col(m)) < float("inf")), F.lit(True))
    every = reduce(lambda a, b: a & b, [finite(m) for m in metrics])
    stats = [f(F.when(finite(m), F.col(m))).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("least", F.min), ("most", F.max))]
    whole = records.groupBy(key).agg(F.count("*").alias("records"), F.count_if(F.col("healthy")).alias("healthy"), F.bool_and(every).alias("all_finite"), *stats)
    return whole.withColumn("health_pass", F.col("all_finite") & (F.col("healthy") == F.col("records")))


def timing_report(batches: DataFrame, key: str = "run_id", limit: float = 20.0) -> DataFrame:
    """Rows (run_id, images, total_seconds, mean_ms, p50_ms, p95_ms, throughput, within_limit) of batches (seconds, size).

    A batch's seconds are the latency of each image in it, so percentiles weigh by size; without batches of a size the gate is null.
    """
    per = F.col("seconds")
    w = F.col("size").cast("long")
    return (
        batches.where("size > 0")
        .groupBy(key)
        .agg(
            F.sum(w).alias("images"),
            F.sum("seconds").alias("total_seconds"),
            (F.sum("seconds") * 1000 / F.sum(w)).alias("mean_ms"),
            (F.percentile(per, F.lit(0.5), w) * 1000).alias("p50_ms"),
            (F.percentile(per, F.lit(0.95), w) * 1000).alias("p95_ms"),
            (F.sum(w) / F.sum("seconds")).alias("throughput"),
            (F.max(per) <= limit).alias("within_limit"),
        )
    )


def result_gate(models: DataFrame, baseline: str = "C0", gates: dict[str, float] | None = None) -> DataFrame:
    """Rows (model, passed, failed, deltas, next_action) of candidates against the baseline.

    ``models`` has (model, map50_95, recall, false_alarm_rate, f1_ship, f1_aircraft, f1_vehicle, kd_health, deploy_parity). The baseline is one row.
    """
    limits = GATES | (gates or {})
    base = models.where(F.col("model") == baseline).limit(1)
    base = base.select(*[F.col(c).alias(f"b_{c}") for c in ("map50_95", "f1_ship", "f1_aircraft", "f1_vehicle")])
    rows = models.where(F.col("model") != baseline).join(F.broadcast(base))
    change = {c: F.col(c) - F.col(f"b_{c}") for c in ("map50_95", "f1_ship", "f1_aircraft", "f1_vehicle")}
    yes = lambda c: F.coalesce(c, F.lit(False))
    checks = {
        "competition_recall": yes(F.col("recall") >= limits["minimum_recall"]),
        "competition_fdr": yes(F.col("false_alarm_rate") <= limits["maximum_fdr"]),
        "map_noninferiority": yes(change["map50_95"] >= -limits["maximum_map50_95_drop"]),
        "aircraft_noninferiority": yes(change["f1_aircraft"] >= -limits["maximum_aircraft_f1_drop"]),
        "weak_group_gain": yes(F.greatest(change["f1_ship"], change["f1_vehicle"]) >= limits["minimum_weak_group_f1_gain"]),
        "kd_health": yes(F.col("kd_health")),
        "deploy_parity": yes(F.col("deploy_parity")),
    }
    both = lambda a, b: checks[a] & checks[b]
    action = (
        F.when(~both("kd_health", "deploy_parity"), ACTIONS["stop"])
        .when(~both("competition_recall", "competition_fdr"), ACTIONS["gates"])
        .when(~both("map_noninferiority", "aircraft_noninferiority"), ACTIONS["damage"])
        .when(~checks["weak_group_gain"], ACTIONS["hold"])
        .otherwise(F.lit(ACTIONS["advance"]))
    )
    failed = F.concat_ws(";", *[F.when(~c, n) for n, c in checks.items()])
    passed = reduce(lambda a, b: a & b, checks.values())
    return rows.select("model", passed.alias("passed"), failed.alias("failed"), *[v.alias(f"delta_{k}") for k, v in change.items()], action.alias("next_action"))


def advancing(models: DataFrame, baseline: str = "C0", gates: dict[str, float] | None = None) -> DataFrame:
    """One row (state, candidates, passing, best) of the gate over all models: whether there is a baseline, and the passing model with the highest map50_95.

    Equal values go to the first name. Aggregates only, so models may be many.
    """
    verdicts = result_gate(models, baseline, gates).join(models.select("model", "map50_95"), "model")
    found = models.agg(F.coalesce(F.bool_or(F.col("model") == baseline), F.lit(False)).alias("known"))
    ahead = F.when(F.col("passed"), F.struct((-F.col("map50_95")).alias("m"), "model"))
    summed = verdicts.agg(F.count("*").alias("candidates"), F.count_if("passed").alias("passing"), F.min(ahead)["model"].alias("best"))
    state = F.when(~F.col("known"), "no baseline").when(F.col("candidates") == 0, "no candidates").when(F.col("passing") == 0, "none passes").otherwise("one advances")
    return summed.join(found).select(state.alias("state"), "candidates", "passing", "best")


def safety_gate(points: DataFrame, min_recall: float = 0.85, max_alarm: float = 0.20) -> DataFrame:
    """``points`` with recall_ok, alarm_ok and gate: the timing flag ``timing_ok`` may be null, and then the gate is unknown unless another part fails."""
    recall, alarm = F.col("recall") >= min_recall, F.col("false_alarm_rate") <= max_alarm
    return points.withColumn("recall_ok", recall).withColumn("alarm_ok", alarm).withColumn("gate", recall & alarm & F.col("timing_ok"))


def schedule(epoch: Column, warmup: int, hold: int, decay: int, least: float = 0.0) -> Column:
    """A weight by epoch: a linear rise, a plateau, and a cosine fall to ``least``."""
    t = F.least(F.greatest((epoch - warmup - hold) / F.lit(float(max(decay, 1))), F.lit(0.0)), F.lit(1.0))
    fall = F.lit(least) + F.lit((1 - least) / 2) * (1 + F.cos(t * 3.141592653589793))
    return F.when(epoch < warmup, (epoch + 1) / F.lit(float(max(warmup, 1)))).when(epoch < warmup + hold, F.lit(1.0)).otherwise(fall)
