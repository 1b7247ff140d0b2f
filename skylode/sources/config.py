"""Configuration and small state files, read on the driver: one file each, never rows of data."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import tempfile
from collections.abc import Iterable
from pathlib import Path, PurePosixPath, PureWindowsPath

from skylode.functions.boxes import THRESHOLDS
from skylode.operators.audits import ContractError

IMAGES = frozenset((".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff"))


def structured(path: str | Path) -> object:
    """What a JSON or YAML file holds, by its ending; YAML needs the yaml library."""
    text = Path(path).read_text("utf-8-sig")
    if Path(path).suffix.lower() == ".json":
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ContractError(f"{path} is YAML, for which no library is installed") from e
    return yaml.safe_load(text)


def mapping(path: str | Path) -> dict:
    """A file that must hold names and values."""
    value = structured(path)
    if not isinstance(value, dict):
        raise ContractError(f"{path} holds a {type(value).__name__}, not a mapping")
    return value


def dataset(path: str | Path) -> dict:
    """A dataset's description, its ``path`` made absolute: relative ones start where the file lies, which is also meant where there is none."""
    home = Path(path).resolve().parent
    value = mapping(path)
    return value | {"path": str((home / str(value.get("path") or ".")).resolve())}


def split_folder(data: dict, split: str) -> Path:
    """The folder of a split's images. Lists of images are refused, as labels are found by folder."""
    value = data.get(split)
    if not isinstance(value, str):
        raise ContractError(f"{split} must be a folder, not {value!r}")
    folder = Path(data["path"]) / value
    if folder.is_file() or folder.suffix.lower() == ".txt":
        raise ContractError(f"{split} is a list of images, {folder}, not a folder")
    return folder


def unportable(root: str | Path, data: dict, lists: Iterable[str] = ("train", "val", "test")) -> dict[str, str]:
    """What hinders a dataset from being moved: absolute paths, and lists that name absolute, missing or repeated images. By split."""
    root, out = Path(root), {}
    absolute = lambda x: PurePosixPath(x).is_absolute() or PureWindowsPath(x).is_absolute()
    if data.get("path") and absolute(str(data["path"])):
        out["path"] = "absolute"
    for split in lists:
        value = data.get(split)
        if not isinstance(value, str):
            continue
        if absolute(value):
            out[split] = "absolute"
        elif value.endswith(".txt"):
            with open(root / value, encoding="utf-8") as f:
                names = [line.strip() for line in f if line.strip()]
            bad = {"absolute": any(map(absolute, names)), "repeated": len(set(names)) < len(names), "missing": any(not (root / n).is_file() for n in names)}
            if found := [k for k, v in bad.items() if v]:
                out[split] = ";".join(found)
    return out


def metrics(text: str | None = None, file: str | Path | None = None) -> dict:
    """Metrics from JSON text or from a file, exactly one of which is given."""
    if (text is None) == (file is None):
        raise ContractError("give metrics either as text or as a file")
    value = json.loads(text) if file is None else structured(file)
    if not isinstance(value, dict):
        raise ContractError("metrics are names and values")
    return value


def group_caps(values: Iterable[str], default: float, groups: tuple[str, ...] = ("ship", "aircraft", "vehicle")) -> dict[str, float]:
    """The limit of each group: ``default``, or what a text GROUP=VALUE says, a share from 0 to 1."""
    caps = dict.fromkeys(groups, default)
    for text in values:
        group, equals, value = text.partition("=")
        try:
            share = float(value)
        except ValueError:
            share = -1.0
        if not equals or group not in caps or not 0 <= share <= 1:
            raise ContractError(f"{text!r} isn't GROUP=SHARE for one of {', '.join(groups)}")
        caps[group] = share
    return caps


def fold_manifest(folder: str | Path, folds: int) -> dict:
    """The description of prepared folds, checked: read-only, of the wanted number, with one summary for each."""
    value = mapping(Path(folder) / "folds.json")
    numbers = sorted(x.get("fold", -1) for x in value.get("summaries", []))
    if not value.get("read_only") or value.get("folds") != folds or numbers != list(range(folds)):
        raise ContractError(f"{folder} doesn't hold {folds} complete, read-only folds")
    return value


def checkpoint_name(value: str | Path, allowed: Iterable[str]) -> str:
    """A checkpoint's file name, one of those allowed."""
    if (name := Path(value).name) not in (names := set(allowed)):
        raise ContractError(f"{name} is not one of {sorted(names)}")
    return name


# --- operating points -------------------------------------------------------


def frozen_point(point: dict, selection: str, schema: str, **settings: object) -> dict:
    """A chosen operating point with the settings (model, data_yaml, image_size, batch, max_det) it was measured with, as it is kept for the test under the name of its ``schema``."""
    kept = {k: point[k] for k in ("overall", "per_group", "competition_ranking_items", "overall_safety_gate")}
    frozen = {"schema_version": schema, "selection": selection, "class_aware_matching": point.get("class_aware_matching"), "iou_thresholds": dict(THRESHOLDS), "validation_snapshot": kept, **settings}
    return checked_point(frozen | {k: float(point[k]) for k in ("confidence", "nms_iou")}, schema)


def checked_point(value: dict, schema: str) -> dict:
    """A frozen operating point that may be used: of the schema, matched by class under the official limits, with shares and sizes in range."""
    whole = lambda k: isinstance(value.get(k), int) and not isinstance(value[k], bool) and value[k] > 0
    share = lambda k: isinstance(value.get(k), (int, float)) and 0 <= value[k] <= 1
    rules = {
        "schema": value.get("schema_version") == schema,
        "class-aware matching": value.get("class_aware_matching") is True,
        "limits of overlap": value.get("iou_thresholds") == dict(THRESHOLDS),
        **{k: share(k) for k in ("confidence", "nms_iou")},
        **{k: whole(k) for k in ("image_size", "batch", "max_det")},
    }
    if bad := [k for k, fine in rules.items() if not fine]:
        raise ContractError(f"the operating point is wrong in {', '.join(bad)}")
    return value


# --- files ------------------------------------------------------------------


def file_digest(path: str | Path) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def file_facts(path: str | Path) -> dict:
    """Absolute path, size and digest of a file."""
    found = Path(path).resolve()
    return {"path": str(found), "size_bytes": found.stat().st_size, "sha256": file_digest(found)}


def put_bytes(path: str | Path, data: bytes) -> None:
    """Writes a file whole or not at all: under another name first, which then replaces it."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile(dir=target.parent, prefix=f".{target.name}.", delete=False) as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(f.name, target)


def put_json(path: str | Path, value: object) -> None:
    put_bytes(path, (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n").encode())


def placed(source: str | Path, target: str | Path, how: str = "copy") -> Path:
    """``source`` at ``target`` by copy, hardlink or symlink. The same content there already is left; other content is an error."""
    ways = {"copy": lambda: put_bytes(target, Path(source).read_bytes()), "hardlink": lambda: os.link(source, target), "symlink": lambda: os.symlink(Path(source).resolve(), target)}
    if how not in ways:
        raise ContractError(f"{how} is none of {', '.join(ways)}")
    if os.path.lexists(target):
        if not Path(target).is_file() or file_digest(source) != file_digest(target):
            raise ContractError(f"{target} is there with other content")
    else:
        Path(target).parent.mkdir(parents=True, exist_ok=True)
        ways[how]()
    return Path(target)


def snapshot(source: str | Path, folder: str | Path, role: str) -> dict:
    """Copies a file into ``folder`` under its role and digest; a copy that differs is removed, and an error."""
    facts = file_facts(source)
    target = Path(folder) / f"{role}-{facts['sha256'][:12]}{Path(source).suffix}"
    target.parent.mkdir(parents=True, exist_ok=True)
    shutil.copyfile(source, target)
    if file_digest(target) != facts["sha256"]:
        target.unlink()
        raise ContractError(f"{source} changed while it was copied")
    return facts | {"role": role, "snapshot": str(target.resolve())}


def dataset_files(source: str | Path, targets: dict[str | Path, str], dataset_id: str | None = None) -> dict[str, dict]:
    """Writes a dataset's description once for each target file, with that place as its path; everything else stays as it is."""
    value, out = mapping(source), {}
    for target, root in targets.items():
        own = value | {"path": root} | ({"dataset_id": dataset_id} if dataset_id else {})
        put_bytes(target, (json.dumps(own, ensure_ascii=False, indent=2) + "\n").encode())  # JSON is YAML, too
        out[str(target)] = own
    return out


def with_digests(runs: dict[str, dict], overrides: dict | None = None) -> dict:
    """Old evidence with overrides, each run's ``checkpoint`` given its digest where the file is still there (else null)."""
    out = {k: v | (overrides or {}).get(k, {}) for k, v in runs.items()}
    return {k: v | {"sha256": v.get("sha256") or (file_digest(p) if (p := v.get("checkpoint")) and Path(p).is_file() else None)} for k, v in out.items()}
