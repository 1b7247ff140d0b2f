"""Dataset identity and cache contracts: fingerprints over manifests in order, inventories, sampled verification, lineage.

A fingerprint here is the SHA-256 of canonical JSON of all rows in order, so that it equals those which other tools keep. Such
a digest is sequential: its rows meet in one task, and more than ``MOST_ROWS`` are refused. For larger manifests
:func:`skylode.operators.ledger.inventory_fingerprint` gives a digest of digests, which has no such limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skylode.functions import paths
from skylode.functions.numbers import canonical, digest, is_digest
from skylode.operators.audits import ContractError, require
from skylode.operators.records import canonical_digest, mismatches
from skylode.operators.splits import placed

#: Rows (some 300 bytes each) that a fingerprint in order may gather in its one task.
MOST_ROWS = 2_000_000
#: The fields of fingerprints and of a cache's compatibility.
SPLIT_FIELDS = ("split", "source", "scene_id", "cluster_id", "image")
INVENTORY_FIELDS = ("split", "image", "label", "image_sha256", "label_sha256")
OLD_SPLIT_FIELDS = ("split", "scene_id", "image")
OLD_INVENTORY_FIELDS = ("relative_image", "split", "scene_id", "image_sha256", "label_sha256")
COMPATIBLE = (
    "format", "kind", "split", "image_size", "feature_channels", "num_classes", "roi_embedding_dim", "dataset_fingerprint", "split_fingerprint", "inventory_fingerprint",
    "split_inventory_fingerprint", "inventory_sha256", "inventory_count", "teacher_sha256", "teacher_provenance_fingerprint", "preprocess",
)


def _listed(rows: DataFrame, fields: tuple[str, ...], order: list[Column]) -> Column:
    """An aggregate: the JSON list of the rows' ``fields``, by ``order``; null where there are too many rows."""
    one = canonical(**{f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields})
    entries = F.array_sort(F.collect_list(F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)], one.alias("row"))))
    return F.concat(F.lit("["), F.array_join(F.transform(entries, lambda x: x["row"]), ","), F.lit("]"))


def _counted(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` if no group has too many for one task."""
    most = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    if (most or 0) > MOST_ROWS:
        raise ContractError(f"{most} rows are too many for a digest in order; use ledger.inventory_fingerprint")
    return rows


def fingerprints(rows: DataFrame, fields: tuple[str, ...] = INVENTORY_FIELDS, by: str | None = None) -> DataFrame:
    """Rows ([by,] fingerprint, n): the digest of the rows' fields in the order of split and image, capitals aside. Nulls count as empty text; a manifest without rows is an error."""
    key = [by] if by else []
    order = [F.col("split"), F.lower("image"), F.col("image")]
    out = _counted(rows, key).groupBy(*key).agg(digest(_listed(rows, fields, order)).alias("fingerprint"), F.count("*").alias("n"))
    return require(out, rows=F.col("n") > 0)


def dataset_fingerprint(inventory: DataFrame, schema: str, dataset_id: str, classes: str, split: str, background: str, label_fixes: str | None = None, scene_audit: str | None = None) -> DataFrame:
    """One row (fingerprint, n): the digest of a whole dataset's parts under the name of their schema, the inventory (relative_image, split, scene_id and both digests) in order of its images."""
    parts = {"schema": schema, "dataset_id": dataset_id, "class_mapping_fingerprint": classes, "split_fingerprint": split, "background_confirmation": background, "label_fix_manifest_sha256": label_fixes or "none", "non_l_scene_audit_sha256": scene_audit or "none"}
    # The JSON of the parts with a mark in the inventory's place, which is then put there by the query.
    before, after = canonical_text(parts | {"inventory": "\0"}).split('"\\u0000"')
    listed = _listed(inventory, OLD_INVENTORY_FIELDS, [F.col("relative_image")])
    return _counted(inventory, []).agg(digest(F.concat(F.lit(before), listed, F.lit(after))).alias("fingerprint"), F.count("*").alias("n"))


def canonical_text(value: object) -> str:
    from skylode.operators.records import canonical_json

    return canonical_json(value)


def class_fingerprint(names: dict, schema: str, kind: str) -> str:
    """The digest of class names by number, under the names of their schema and kind; the numbers run from 0 without a gap."""
    by_number = {int(k): str(v) for k, v in names.items()}
    if not by_number or sorted(by_number) != list(range(len(names))):
        raise ContractError(f"class numbers must run from 0 on, not {sorted(by_number)}")
    return canonical_digest({"schema": schema, "kind": kind, "names": {str(k): v for k, v in by_number.items()}})


def inventory(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (relative_image, split, scene_id, image_sha256, label_sha256) of a manifest (split, image, label, scene_id) whose files (path, sha256) are found; a missing one is an error."""
    rows = manifest.select("split", "image", "label", "scene_id").withColumn("relative_image", paths.relative_image(F.col("split"), F.col("image"))).withColumn("relative_label", paths.relative_label(F.col("split"), F.col("label")))
    digests = lambda name: found.select(F.col("path").alias(f"relative_{name}"), F.col("sha256").alias(f"{name}_sha256"))
    both = rows.join(digests("image"), "relative_image", "left").join(digests("label"), "relative_label", "left")
    return require(both, images=F.col("image_sha256").isNotNull(), labels=F.col("label_sha256").isNotNull()).select(*OLD_INVENTORY_FIELDS)


def identity_problems(manifest: DataFrame, report: dict, configured: dict | None = None) -> dict[str, tuple]:
    """What speaks against a dataset: fields of its report that aren't well formed, differ from the configuration, or that the manifest doesn't reproduce."""
    well = {k: isinstance(report.get(k), str) and len(report[k]) == 64 and not set(report[k]) - set("0123456789abcdef") for k in ("dataset_fingerprint", "split_fingerprint")}
    out = {k: (report.get(k), "64 hex digits") for k, fine in well.items() if not fine}
    out |= {k: v for k, v in mismatches(report, {k: v for k, v in (configured or {}).items() if v}).items()}
    made = fingerprints(manifest, SPLIT_FIELDS).first()["fingerprint"]
    return out | ({"split_manifest": (made, report.get("split_fingerprint"))} if made != report.get("split_fingerprint") else {})


def identity(manifest: DataFrame, report: dict, configured: dict | None = None) -> dict:
    """The identity that everything made from a dataset keeps: its report's fingerprints, and those of the inventory as a whole and by split. Any problem is an error."""
    if problems := identity_problems(manifest, report, configured):
        raise ContractError(f"the dataset isn't what its report says: {problems}")
    by_split = {r["split"]: (r["fingerprint"], r["n"]) for r in fingerprints(manifest, by="split").collect()}  # as many rows as splits
    own = {k: report[k] for k in ("dataset_id", "dataset_fingerprint", "split_fingerprint")}
    whole = fingerprints(manifest).first()
    return own | {"strict": True, "inventory_fingerprint": whole["fingerprint"], "split_inventory_fingerprints": {k: v[0] for k, v in by_split.items()}, "image_count": whole["n"]}


# --- caches -----------------------------------------------------------------


def cache_inventory(manifest: DataFrame, root: str) -> DataFrame:
    """Rows (key, relative_image, relative_label, image_sha256, label_sha256) of a manifest (split, image, label and both digests); keys name the images' absolute paths."""
    image = paths.relative_image(F.col("split"), F.col("image"))
    key = paths.image_key(F.concat(F.lit(root.rstrip("/") + "/"), image))
    return manifest.select(key.alias("key"), image.alias("relative_image"), paths.relative_label(F.col("split"), F.col("label")).alias("relative_label"), "image_sha256", "label_sha256")


def index_payload(rows: DataFrame, *fields: str) -> DataFrame:
    """The fields of an index as text, absent or null ones as empty text."""
    return rows.select(*[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) if f in rows.columns else F.lit("").alias(f) for f in fields])


def patch_rows(rows: DataFrame) -> DataFrame:
    """Rows of a patch manifest with whole numbers for lines; empty text is null."""
    number = lambda c: F.col(c).try_cast("int")
    return rows.withColumn("line_number", number("line_number")).withColumn("duplicate_of_line", number("duplicate_of_line"))


def compatibility(manifest: dict, model: tuple[str, ...] = ("repository", "revision", "weights_sha256")) -> dict:
    """The part of a cache's manifest on which its use depends, and its digest. Of the model that made it, only what identifies it."""
    kept = {k: manifest.get(k) for k in COMPATIBLE} | {"dino": {k: (manifest.get("dino") or {}).get(k) for k in model}}
    return {"payload": kept, "compatibility_fingerprint": canonical_digest(kept)}


def cache_manifest(identity_: dict, split: str, inventory_sha256: str, inventory_count: int, teacher: dict, **settings: object) -> dict:
    """A cache's manifest: the dataset and split, its inventory, the teacher and settings, with the digest that tells whether another cache is compatible."""
    own = {k: identity_.get(k) for k in ("dataset_fingerprint", "split_fingerprint", "inventory_fingerprint")}
    own |= {"dataset": identity_, "split": split, "split_inventory_fingerprint": identity_.get("split_inventory_fingerprints", {}).get(split), "inventory_file": "inventory.jsonl"}
    own |= {"inventory_sha256": inventory_sha256, "inventory_count": inventory_count, "teacher_sha256": teacher.get("sha256"), "teacher_provenance_fingerprint": teacher.get("core_fingerprint")} | settings
    return own | {"compatibility_fingerprint": compatibility(own)["compatibility_fingerprint"]}


def resumable(wanted: DataFrame, done: DataFrame, contract: dict, kept: dict | None) -> DataFrame:
    """The rows (image_sha256, ...) of an index that a cache doesn't hold yet. A cache under another contract can't be resumed; without one all rows are left."""
    if kept is None:
        return wanted
    if differing := mismatches(kept, contract):
        raise ContractError(f"the cache was made under another contract: {differing}")
    return wanted.join(done.where("valid"), "image_sha256", "left_anti")


def sampled(rows: DataFrame, order: str, samples: int) -> DataFrame:
    """``samples`` rows (at least one, at most all) evenly spaced by ``order``, the first and the last among them.

    Rows are numbered within ranges of the order, so no task gets all of them.
    """
    counted = placed(rows, [], (order,))
    count = F.least(F.greatest(F.lit(samples).cast("long"), F.lit(1).cast("long")), F.col("__n"))
    # Place p is chosen if some i in 0..count-1 rounds to it: i is the nearest to p * (count-1) / (n-1).
    last, gaps = F.col("__n") - 1, F.greatest(count - 1, F.lit(1))
    near = F.floor(F.col("__at") * gaps / F.greatest(last, F.lit(1)))
    hit = lambda i: (i < count) & (F.bround(i * last / gaps) == F.col("__at"))
    return counted.withColumn("__at", F.col("__r") - 1).where(hit(near) | hit(near + 1)).select(*rows.columns)


def sample_problems(cache: DataFrame, files: DataFrame, entries: DataFrame, fingerprint: str, samples: int = 64) -> DataFrame:
    """Rows (key, problem) of evenly spaced cache rows whose files (path, sha256) or entries (key, image_sha256, label_sha256, manifest) are missing or differ. No rows: the sample holds."""
    rows = sampled(cache, "relative_image", samples)
    own = lambda name: files.select(F.col("path").alias(f"relative_{name}"), F.col("sha256").alias(f"{name}_now"))
    kept = entries.select("key", F.struct("image_sha256", "label_sha256").alias("kept"), F.col("manifest").alias("kept_manifest"))
    rows = rows.join(own("image"), "relative_image", "left").join(own("label"), "relative_label", "left").join(kept, "key", "left")
    problem = (
        F.when(F.col("image_now").isNull() | F.col("label_now").isNull(), "file missing")
        .when((F.col("image_now") != F.col("image_sha256")) | (F.col("label_now") != F.col("label_sha256")), "file changed")
        .when(F.col("kept_manifest").isNull(), "entry missing")
        .when(F.col("kept") != F.struct("image_sha256", "label_sha256"), "entry differs")
        .when(F.col("kept_manifest") != fingerprint, "entry of another cache")
    )
    return rows.select("key", problem.alias("problem")).where("problem is not null")


def lineage(core: dict, before: dict | None = None, checkpoint: dict | None = None) -> dict:
    """A run's lineage: what it depends on and the digest of that. A resumed run (``before`` and a checkpoint) must depend on the same."""
    own = {"core": core, "core_fingerprint": canonical_digest(core)}
    if before is None:
        return own | {"mode": "fresh", "resumes": []}
    if checkpoint is None or before["core_fingerprint"] != own["core_fingerprint"]:
        raise ContractError(f"the run can't be resumed: {mismatches(before['core'], core) or 'no checkpoint'}")
    return own | {"mode": "resume", "resumes": [*before.get("resumes", []), checkpoint]}


def well_formed(rows: DataFrame, *digests: str) -> DataFrame:
    """``rows`` if all these columns hold digests."""
    return require(rows, **{c: is_digest(F.col(c)) for c in digests})
