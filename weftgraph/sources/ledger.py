"""Small files beside the tables: manifests and their drift ledger, tokens, configuration."""

from __future__ import annotations

import ast
import hashlib
import importlib.util
import json
import os
import subprocess
import tomllib
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.sources.store import ArtifactStore, canonical, cut

LEDGER = "record_address string, manifest_diff_hash string, entry string"


def config(path: str, defaults: dict, section: str = "weftgraph") -> dict:
    """The section of a TOML file over the defaults; a missing file gives the defaults."""
    p = Path(path)
    return defaults | (tomllib.loads(p.read_text()).get(section, {}) if p.is_file() else {})


def artifact_root(user: str | None, packaged: str) -> str:
    """The user's folder where it is there, else the packaged one."""
    return user if user and Path(user).is_dir() else packaged


def sole_record(folder: str) -> str:
    """The one artifact record in a folder, manifests aside; ValueError for none or several."""
    found = sorted(p.name for p in Path(folder).glob("*.json") if not p.name.endswith(".manifest.json"))
    if len(found) != 1:
        raise ValueError(f"{folder} has {len(found)} records")
    return found[0].removesuffix(".json")


def flatten(tree: dict, prefix: str = "") -> dict[str, object]:
    """Nested tokens under dotted keys."""
    out = {}
    for k, v in tree.items():
        out |= flatten(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": v}
    return out


def unflatten(flat: dict[str, object]) -> dict:
    out: dict = {}
    for key, v in flat.items():
        *path, last = key.split(".")
        at = out
        for p in path:
            at = at.setdefault(p, {})
        at[last] = v
    return out


def replaced(path: str, text: str) -> None:
    """Writes a file under another name and renames it, so that readers see the old or the new one."""
    staged = f"{path}.{os.getpid()}.tmp"
    Path(staged).write_text(text)
    os.replace(staged, path)


def write_tokens(path: str, new: dict[str, object]) -> dict[str, object]:
    """Loads the token file (absent: empty), puts the new dotted keys over its own, writes it back; the merged tokens."""
    p = Path(path)
    merged = (flatten(json.loads(p.read_text())) if p.is_file() else {}) | new
    replaced(path, json.dumps(unflatten(merged), indent=2) + "\n")
    return merged


def own_modules(entry: list[str], package: str) -> list[str]:
    """The entry modules and every module of the package that they import, by reading their source."""
    seen, todo = set(), list(entry)
    while todo:
        name = todo.pop()
        spec = safe_spec(name) if (name == package or name.startswith(package + ".")) and name not in seen else None
        if spec is None or not spec.origin:
            continue
        seen.add(name)
        for node in ast.walk(ast.parse(Path(spec.origin).read_text())):
            if isinstance(node, ast.Import):
                todo += [a.name for a in node.names]
            elif isinstance(node, ast.ImportFrom) and node.module and not node.level:
                todo += [node.module, *(f"{node.module}.{a.name}" for a in node.names)]
    return sorted(seen)


def safe_spec(name: str):
    try:
        return importlib.util.find_spec(name)
    except ModuleNotFoundError:
        return None


def manifest(entry: list[str], package: str, lock: str | None = None) -> dict:
    """Digest of each source module that a run derives from, of the lock file, and the commit (which is never compared)."""
    rows = {}
    for name in own_modules(entry, package):
        origin = Path(safe_spec(name).origin)
        rows[name] = {"path": str(origin), "sha256": hashlib.sha256(origin.read_bytes()).hexdigest()}
    digest = hashlib.sha256(Path(lock).read_bytes()).hexdigest() if lock and Path(lock).is_file() else None
    try:
        head = subprocess.run(["git", "rev-parse", "HEAD"], capture_output=True, text=True, timeout=10, cwd=Path(safe_spec(package).origin).parent)
        commit = head.stdout.strip() or None
    except (OSError, subprocess.TimeoutExpired):
        commit = None
    return {"modules": rows, "lock": digest, "commit": commit}


def manifest_diff(baseline: dict, live: dict) -> list[dict]:
    """One row for each module on which the two disagree or that one of them lacks, by name, then the lock file's."""
    out = []
    for name in sorted(set(baseline["modules"]) | set(live["modules"])):
        was, now = baseline["modules"].get(name), live["modules"].get(name)
        if was and now and was["sha256"] == now["sha256"]:
            continue
        out.append({"anchor": name, "path": (now or was)["path"], "baseline": was and was["sha256"], "live": now and now["sha256"]})
    if baseline["lock"] != live["lock"]:
        out.append({"anchor": "lock", "path": "lock", "baseline": baseline["lock"], "live": live["lock"]})
    return out


def diff_hash(diff: list[dict]) -> str:
    return hashlib.sha256(canonical(diff).encode()).hexdigest()


def write_sidecar(path: str, data: dict) -> None:
    replaced(path, json.dumps(data, sort_keys=True, indent=2) + "\n")


def read_sidecar(path: str) -> dict | None:
    """None if it is absent; raises if it is malformed."""
    p = Path(path)
    return json.loads(p.read_text()) if p.is_file() else None


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Distinct (record_address, manifest_diff_hash) of a ledger of JSON lines; lines that don't decode count for nothing."""
    try:
        rows = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "record_address string, manifest_diff_hash string")
    v = F.try_parse_json("value")
    return rows.select(F.try_variant_get(v, "$.record_address", "string").alias("record_address"), F.try_variant_get(v, "$.manifest_diff_hash", "string").alias("manifest_diff_hash")).where("record_address IS NOT NULL AND manifest_diff_hash IS NOT NULL").distinct()


def append_ledger(spark: SparkSession, path: str, entries: DataFrame) -> int:
    """Appends the entries (``LEDGER``) whose address and hash the ledger lacks, once each; how many these are.

    Tasks write the lines; nothing is collected. Writers at one time may both append an entry: it is one entry still, as an entry is its address and
    hash and ``read_ledger`` gives each once.
    """
    key = ["record_address", "manifest_diff_hash"]
    new = cut(entries.dropDuplicates(key).join(read_ledger(spark, path), key, "left_anti").select(F.to_json(F.struct(*key, "entry")).alias("value")))
    n = new.count()
    if n:
        new.write.mode("append").text(path)
    return n


def cached_run(store: ArtifactStore, seeds: DataFrame, failures: DataFrame, parameters: dict, run, live: dict, sidecars: str, ledger: str) -> tuple[dict[str, DataFrame], bool, str | None]:
    """Tables of a run, whether they were stored already, and what went wrong while noting drift.

    On a miss, ``run()`` makes the tables and the manifest ``live`` becomes the record's baseline, beside it. On a hit, drift of ``live`` from
    the baseline is noted in the ledger, and the tables get this call's own seeds and seed failures.
    """
    names = [r.node_id for r in seeds.select("node_id").collect()]  # the seeds asked for
    key, tables, hit = store.cached(names, parameters, run)
    sidecar = f"{sidecars}/{key}.json"
    if hit:
        return hit_parity(tables, seeds, failures), True, observed(store.spark, ledger, key, sidecar, live)
    write_sidecar(sidecar, live)
    return tables, False, None


def observed(spark: SparkSession, ledger: str, key: str, sidecar: str, live: dict) -> str | None:
    """On a hit: notes drift of ``live`` against the stored manifest. Whatever goes wrong is returned as text and never stops the serve."""
    try:
        baseline = read_sidecar(sidecar)
        diff = manifest_diff(baseline, live) if baseline is not None else []
        if diff:
            append_ledger(spark, ledger, spark.createDataFrame([(key, diff_hash(diff), canonical(diff))], LEDGER))
    except Exception as e:  # noqa: BLE001  the fence: a ledger's fault must not break the run
        return str(e)
    return None


def hit_parity(tables: dict[str, DataFrame], seeds: DataFrame, failures: DataFrame) -> dict[str, DataFrame]:
    """A stored run's tables with this call's own seeds, in its order, and seed failures."""
    return tables | {"seeds": seeds, "seed_failures": failures}


def bundle_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of two tables with the same columns that only one of them has, repeats counted."""
    return a.exceptAll(b).withColumn("side", F.lit("baseline")).unionByName(b.exceptAll(a).withColumn("side", F.lit("live")))
