"""Runs from their start to their evidence: reports in one form, what a formal result needs, and the registry of runs.

Reports are rows (run_id, report), the report being JSON text, so that thousands of runs are read in one query. The lifecycle itself is files of one run.
"""

from __future__ import annotations

import time
import uuid
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.operators.audits import ContractError
from skylode.operators.ledger import latest
from skylode.operators.records import append_chain, canonical_digest, find_fingerprint
from skylode.sources import config, writers

#: The names under which reports hold a metric, and the groups, sizes and attributes of a formal result.
ALIASES = {
    "precision": ("metrics/precision(B)", "precision", "P"),
    "recall": ("metrics/recall(B)", "recall", "R"),
    "map50": ("metrics/mAP50(B)", "mAP50", "map50"),
    "map50_95": ("metrics/mAP50-95(B)", "mAP50-95", "map50_95"),
    "fitness": ("fitness",),
}
GROUPS, SIZES, ATTRIBUTES = ("ship", "aircraft", "vehicle"), ("small", "medium", "large"), ("crowded", "edge")
_TIMING = {"image_count": "long", "total_seconds": "double", "mean_ms_per_image": "double", "p50_ms_per_image": "double", "p95_ms_per_image": "double", "excludes_image_read": "boolean"}
MANIFEST, COMPLETION, RESUMES = "run_manifest.json", "completion.json", "resume_events.jsonl"


# --- reports as rows ---------------------------------------------------------


def _object(text: Column) -> Column:
    """The members of a JSON object, as JSON text each; null for anything else."""
    return F.from_json(text, "map<string,string>")


def chosen_model(report: Column, model: Column, inside: str = "models") -> Column:
    """Struct (model, report, problem): the part of a report that is one model's.

    That of the named model, else the only one, else the problem that there are several. A report without models is itself the part.
    """
    models = _object(_object(report)[inside])
    only = F.element_at(F.map_keys(models), 1)
    name = F.when(models.isNull() | F.map_contains_key(models, model), model).when(F.size(models) == 1, only)
    part = F.when(models.isNull(), report).otherwise(F.try_element_at(models, name))
    return F.struct(name.alias("model"), part.alias("report"), F.when(part.isNull(), "several models and none is chosen").alias("problem"))


def native_metrics(reports: DataFrame, model: Column | None = None) -> DataFrame:
    """Rows (run_id, model, problem, precision, recall, map50, map50_95, fitness) of native reports: each metric under the first of its names that is there."""
    picked = reports.select("run_id", chosen_model(F.col("report"), F.lit(None).cast("string") if model is None else model).alias("x"))
    held = picked.select("run_id", "x.model", "x.problem", F.coalesce(_object(_object(F.col("x.report"))["metrics"]), _object(F.col("x.report"))).alias("m"))
    return held.select("run_id", "model", "problem", *[F.coalesce(*[F.try_element_at("m", F.lit(n)).try_cast("double") for n in names]).alias(k) for k, names in ALIASES.items()])


def competition_points(reports: DataFrame, point: str) -> DataFrame:
    """Rows (run_id, problem, split, confidence, class_aware_matching, overall, per_group) of competition reports at one operating point; a report without points is one itself."""
    whole = _object(F.col("report"))
    points = _object(whole["operating_points"])
    held = reports.select("run_id", whole.alias("w"), F.when(points.isNull(), whole).otherwise(_object(F.try_element_at(points, F.lit(point)))).alias("p"))
    pick = lambda *names: F.coalesce(*[F.try_element_at("p", F.lit(n)) for n in names])
    return held.select(
        "run_id",
        F.when(F.col("p").isNull(), f"no operating point {point}").alias("problem"),
        F.col("w")["split"].alias("split"),
        F.coalesce(pick("confidence"), F.col("w")["confidence"]).try_cast("double").alias("confidence"),
        F.col("w")["class_aware_matching"].try_cast("boolean").alias("class_aware_matching"),
        pick("overall").alias("overall"),
        pick("per_group", "groups").alias("per_group"),
    )


def diagnostics(reports: DataFrame, model: Column | None = None) -> DataFrame:
    """Rows (run_id, model, problem, overall, per_group, per_size, attributes, false_positives), JSON text each, of one model's diagnostics."""
    picked = reports.select("run_id", chosen_model(F.col("report"), F.lit(None).cast("string") if model is None else model, "summaries").alias("x"))
    held = picked.select("run_id", "x.model", "x.problem", _object(F.col("x.report")).alias("m"))
    return held.select("run_id", "model", "problem", *[F.try_element_at("m", F.lit(n)).alias(n) for n in ("overall", "per_group", "per_size", "attributes", "false_positives")])


def timings(reports: DataFrame) -> DataFrame:
    """Rows (run_id, problem, image_count, total_seconds, mean_ms_per_image, p50, p95 and excludes_image_read) of timing reports. A mean that isn't given is computed; the time of reading images must be left out."""
    whole = _object(F.col("report"))
    held = reports.select("run_id", *[F.try_element_at(whole, F.lit(k)).try_cast(t).alias(k) for k, t in _TIMING.items()])
    problem = (
        F.when(~F.coalesce("excludes_image_read", F.lit(False)), "image reading isn't excluded")
        .when(F.col("image_count").isNull() | F.col("total_seconds").isNull(), "a number is missing")
        .when((F.col("image_count") <= 0) | (F.col("total_seconds") < 0), "a number is out of range")
    )
    mean = F.coalesce("mean_ms_per_image", F.when(F.col("image_count") > 0, F.col("total_seconds") * 1000 / F.col("image_count")))
    return held.withColumn("mean_ms_per_image", mean).select("run_id", problem.alias("problem"), *_TIMING)


def parity(reports: DataFrame) -> DataFrame:
    """Rows (run_id, parity): whether a stripped checkpoint's detector is the full one's, by the report's flag and both digests."""
    whole = _object(F.col("report"))
    same = (whole["parity"] == "true") & (whole["full_detector_sha256"] == whole["deploy_detector_sha256"])
    return reports.select("run_id", F.coalesce(same, F.lit(False)).alias("parity"))


def evidence_problems(native: DataFrame, competition: DataFrame, diagnosed: DataFrame, timed: DataFrame, health: DataFrame | None = None) -> DataFrame:
    """Rows (run_id, problem): what each run of ``native`` lacks for a formal result. ``health`` (run_id, health_pass) is asked where it is given."""
    has = lambda c, *keys: F.size(F.array_except(F.array(*map(F.lit, keys)), F.coalesce(F.json_object_keys(c), F.expr("cast(array() as array<string>)")))) == 0
    rates = [F.get_json_object("per_group", f"$.{g}.{m}").isNotNull() for g in GROUPS for m in ("recall", "false_alarm_rate")]
    rules = {
        "native map50_95": (native, F.col("map50_95").isNotNull()),
        "class-aware matching": (competition, F.coalesce("class_aware_matching", F.lit(False))),
        "rates of each group": (competition, reduce(lambda a, b: a & b, rates)),
        "diagnostics by group": (diagnosed, F.col("per_group").isNotNull()),
        "diagnostics by size": (diagnosed, has(F.col("per_size"), *SIZES)),
        "diagnostics by attribute": (diagnosed, has(F.col("attributes"), *ATTRIBUTES)),
        "timing without reading": (timed, F.col("problem").isNull()),
    }
    if health is not None:
        rules["health"] = (health, F.coalesce("health_pass", F.lit(False)))
    out = native.select("run_id")
    for i, (df, rule) in enumerate(rules.values()):
        out = out.join(df.groupBy("run_id").agg(F.bool_or(rule).alias(f"r{i}")), "run_id", "left")
    lacking = [F.when(~F.coalesce(F.col(f"r{i}"), F.lit(False)), name) for i, name in enumerate(rules)]
    return out.select("run_id", F.explode(F.array_compact(F.array(*lacking))).alias("problem"))


def registry_state(events: DataFrame) -> DataFrame:
    """Rows (run_id, experiment, state, seconds, summary) of registry events (sequence, run_id, action, utc, experiment, summary).

    A run's last completion counts; a run that has begun and not completed is open, and one whose start isn't in the registry is known by its stored summary alone. A partial aggregate.
    """
    at = lambda action, what: F.max_by(F.when(F.col("action") == action, F.col(what)), F.when(F.col("action") == action, F.col("sequence")))
    per = events.where("run_id is not null").groupBy("run_id").agg(
        F.max_by("experiment", F.when(F.col("experiment").isNotNull(), F.col("sequence"))).alias("experiment"),
        at("init", "utc").alias("begun"),
        at("complete", "utc").alias("ended"),
        at("complete", "summary").alias("summary"),
        F.count_if(F.col("action") == "resume").alias("resumes"),
    )
    state = F.when(F.col("begun").isNull(), "summary alone").when(F.col("ended").isNull(), "open").otherwise("complete")
    seconds = (F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("begun").cast("timestamp"))) / 1e6
    return per.select("run_id", "experiment", state.alias("state"), "resumes", seconds.alias("seconds"), "summary")


def unrecorded_epochs(results: DataFrame, health: DataFrame, recorded: DataFrame) -> DataFrame:
    """Rows (run_id, epoch, metrics, health) of results that a ledger doesn't hold yet, with the last health record of their epoch, or none."""
    keys = ["run_id", "epoch"]
    last = health.groupBy(*keys).agg(F.max_by("health", "position").alias("health"))
    return results.join(last, keys, "left").join(recorded.select(*keys), keys, "left_anti").select(*keys, "metrics", "health")


def completed_epochs(results: DataFrame) -> DataFrame:
    """Rows (run_id, epochs): rows of results in which some value isn't empty, counted for each run."""
    some = F.greatest(*[F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in results.columns if c != "run_id"], F.lit(False))
    return results.groupBy("run_id").agg(F.count_if(some).alias("epochs"))


# --- one run's files ----------------------------------------------------------


def _now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def _folder(run: str | Path) -> Path:
    return Path(run) / "evidence"


def opened(run: str | Path) -> dict:
    """The manifest of a run that has begun and not ended."""
    if (_folder(run) / COMPLETION).exists():
        raise ContractError(f"{run} has ended")
    return writers.verified(config.mapping(_folder(run) / MANIFEST))


def begin(run: str | Path, registry: str | Path, experiment: str, dataset_report: str | Path, settings: str | Path, seed: int, checkpoint: str | Path, command: str, resumed_from: str | Path | None = None, parent: str | Path | None = None, run_id: str | None = None) -> dict:
    """Writes a run's manifest, once, and tells the registry. The dataset's report must name one fingerprint; a parent run needs the checkpoint that is resumed."""
    target = _folder(run) / MANIFEST
    if target.exists() or (_folder(run) / COMPLETION).exists():
        raise ContractError(f"{run} has begun already")
    if not (fingerprint := find_fingerprint(config.structured(dataset_report))):
        raise ContractError(f"{dataset_report} names no dataset fingerprint")
    if parent and not resumed_from:
        raise ContractError("a run with a parent resumes a checkpoint")
    resolved = config.mapping(settings)
    record = {
        "kind": "run_manifest",
        "run_id": run_id or f"{experiment}-{_now()}-{uuid.uuid4().hex[:8]}",
        "experiment": experiment,
        "created_utc": _now(),
        "seed": seed,
        "command": command,
        "registry": str(Path(registry).resolve()),
        "dataset": {"fingerprint": fingerprint, "report": config.file_facts(dataset_report)},
        "config": {"source": config.file_facts(settings), "resolved": resolved, "sha256": canonical_digest(resolved)},
        "checkpoint": config.file_facts(checkpoint),
        "lineage": {"resumed": config.file_facts(resumed_from) if resumed_from else None, "parent": opened_or_ended(parent)["run_id"] if parent else None},
    }
    written = writers.envelope(record)
    config.put_json(target, written)
    told = {k: record[k] for k in ("run_id", "experiment", "seed")} | {"action": "init", "utc": record["created_utc"], "manifest_sha256": written["record_sha256"], "dataset_fingerprint": fingerprint, "config_sha256": record["config"]["sha256"]}
    append_chain(registry, told)
    return written


def opened_or_ended(run: str | Path) -> dict:
    return writers.verified(config.mapping(_folder(run) / MANIFEST))


def resume(run: str | Path, checkpoint: str | Path, command: str) -> dict:
    """Adds a resumption to an open run's own chain and to the registry."""
    record, facts = opened(run), config.file_facts(checkpoint)
    event = append_chain(_folder(run) / RESUMES, {"kind": "resume", "utc": _now(), "run_id": record["run_id"], "checkpoint": facts, "command": command})
    append_chain(record["registry"], {"action": "resume", "utc": _now(), "run_id": record["run_id"], "checkpoint_sha256": facts["sha256"], "resume_event_sha256": event["event_sha256"]})
    return event


def end(run: str | Path, status: str, files: dict[str, str | Path], summary: dict, problems: list[str] = (), formal: bool = False) -> dict:
    """Writes an open run's completion, once: snapshots of its files by role, a summary, and what speaks against a formal result (which then is refused). The registry gets the summary."""
    if status not in ("completed", "failed", "stopped"):
        raise ContractError(f"{status} is no end of a run")
    record = opened(run)
    if formal and (status != "completed" or problems):
        raise ContractError(f"no formal result: {[status, *problems]}")
    kept = {role: config.snapshot(path, _folder(run) / "snapshots", role) for role, path in sorted(files.items())}
    done = {"kind": "run_completion", "run_id": record["run_id"], "status": status, "utc": _now(), "files": kept, "summary": summary, "problems": list(problems), "paper_ready": formal}
    written = writers.envelope(done)
    config.put_json(_folder(run) / COMPLETION, written)
    append_chain(record["registry"], {"action": "complete", "utc": done["utc"], "run_id": record["run_id"], "completion_sha256": written["record_sha256"], "summary": summary})
    return written


def run_states(registry: DataFrame, column: str = "value") -> DataFrame:
    """:func:`registry_state` of a ledger file's lines, read as text."""
    payload = "struct<run_id:string,action:string,utc:string,experiment:string,summary:string>"
    rows = registry.select(F.from_json(column, f"struct<event:struct<sequence:bigint,payload:{payload}>>")["event"].alias("e"))
    return registry_state(rows.select("e.sequence", "e.payload.*").withColumn("utc", F.to_timestamp("utc")))


def newest(rows: DataFrame, key: str = "run_id") -> DataFrame:
    """The last row of each run by sequence."""
    return latest(rows, key, "sequence")
