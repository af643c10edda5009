"""Writing metrics, run metadata and small tables."""

from __future__ import annotations

import json
import math
import os
import platform
import subprocess
import tempfile
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coerce(value) -> float | None:
    """A finite number, None for others; bools and what is no number are errors."""
    if isinstance(value, bool) or not isinstance(value, (int, float, type(None))):
        raise TypeError(f"not a number: {value!r}")
    return float(value) if value is not None and math.isfinite(value) else None


def atomic_json(path: str | Path, data) -> None:
    """Written beside its place, synced and renamed; numbers that JSON lacks are errors."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "w") as f:
        json.dump(data, f, indent=2, sort_keys=True, allow_nan=False)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def git_sha(root: str = ".") -> str:
    try:
        return subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=True, timeout=10).stdout.strip()
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def human_bytes(n: Column) -> Column:
    return F.when(n.isNull(), "unknown size").when(n >= 10**9, F.format_string("%.1f GB", n / 1e9)).when(n >= 10**6, F.format_string("%.0f MB", n / 1e6)).otherwise(F.format_string("%d B", n))


def write_results(folder: str, project: str, card: str, metrics: DataFrame, outputs: dict[str, DataFrame], metadata: dict) -> dict[str, str]:
    """metrics.json and run_metadata.json, and each output as Parquet below outputs/.

    metrics: (name, value), a row per metric, read to the driver as there are few; folder: one the driver and, for
    outputs, the executors can write to. Of the metadata's own keys, model and policy belong under provenance.
    """
    values = {r["name"]: coerce(r["value"]) for r in metrics.select("name", F.col("value").cast("double").alias("value")).collect()}
    spark = metrics.sparkSession
    for name, df in outputs.items():
        df.write.mode("overwrite").parquet(f"{folder}/{project}/outputs/{name}")
    base = {
        "schema_version": 1, "project": project, "dataset_card_id": card, "git_sha": git_sha(), "started_utc": datetime.now(timezone.utc).isoformat(),
        "python": platform.python_version(), "packages": {"pyspark": spark.version}, "device": "cpu", "deterministic": True,
        "normalization": {"applied": False, "method": "none"}, "notes": "", "outputs": {k: f"outputs/{k}" for k in outputs},
    }
    atomic_json(f"{folder}/{project}/metrics.json", {"project": project, "dataset_card_id": card, "metrics": values})
    atomic_json(f"{folder}/{project}/run_metadata.json", base | metadata)
    return {"metrics": f"{folder}/{project}/metrics.json", "run_metadata": f"{folder}/{project}/run_metadata.json"}


def merge_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, value: new over old."""
    return old.withColumnRenamed("value", "o").join(new.withColumnRenamed("value", "n").withColumn("has", F.lit(True)), "name", "full_outer").select("name", F.when(F.col("has"), F.col("n")).otherwise(F.col("o")).alias("value"))


def _cell(value, digits: int, missing: str) -> str:
    if isinstance(value, float):
        return f"{value:.{digits}f}" if math.isfinite(value) else missing
    return missing if value is None else str(value)


def to_markdown(df: DataFrame, note: str = "") -> str:
    """A small table as markdown; numbers with four digits, n/a for those that aren't."""
    rows = [[_cell(v, 4, "n/a") for v in r] for r in df.collect()]
    lines = ["| " + " | ".join(x) + " |" for x in [df.columns, ["---"] * len(df.columns), *rows]]
    return "\n".join([*lines, *(["", note] if note else [])]) + "\n"


def to_csv(df: DataFrame) -> str:
    rows = [[_cell(v, 6, "") for v in r] for r in df.collect()]
    return "\n".join(",".join(x) for x in [df.columns, *rows]) + "\n"


def write_table(df: DataFrame, folder: str, name: str, note: str = "", pending: bool = False) -> None:
    """name.md, .csv and .json of a small table; a pending one has its columns alone."""
    df = df.limit(0) if pending else df
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(folder, f"{name}.md").write_text(to_markdown(df, note))
    Path(folder, f"{name}.csv").write_text(to_csv(df))
    rows = [[None if isinstance(v, float) and not math.isfinite(v) else v for v in r] for r in df.collect()]
    atomic_json(Path(folder, f"{name}.json"), {"name": name, "headers": df.columns, "rows": rows, "note": note, "pending": pending})
