"""The manifest of a run: settings without secrets, inputs with digests, status."""

from __future__ import annotations

import datetime
import json
import platform
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .records import write_text

SECRET_WORDS = ("key", "token", "secret", "password", "credential", "authorization")


def without_secrets(settings: object) -> object:
    if isinstance(settings, dict):
        return {k: "***" if any(w in str(k).lower() for w in SECRET_WORDS) else without_secrets(v) for k, v in settings.items()}
    if isinstance(settings, list):
        return [without_secrets(x) for x in settings]
    return settings


def input_inventory(spark: SparkSession, path: str) -> list[dict]:
    """Path, size and SHA-256 of the input files of a run, a bounded list."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256")).orderBy("path").limit(10_000)
    return [r.asDict() for r in rows.collect()]


class RunManifest:
    """Written as running at the start, as completed or failed at the end."""

    def __init__(self, path: str, command: str, settings: dict, inputs: list[dict] | None = None):
        self.path = path
        self.data = {"command": command, "settings": without_secrets(settings), "inputs": inputs or [], "python": platform.python_version(), "started": self._now(), "status": "running"}

    @staticmethod
    def _now() -> str:
        return datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")

    def _write(self) -> None:
        write_text(self.path, json.dumps(self.data, ensure_ascii=False, indent=2))

    def __enter__(self) -> RunManifest:
        self._write()
        return self

    def __exit__(self, kind, error, trace) -> None:
        self.data |= {"status": "failed" if error else "completed", "finished": self._now()} | ({"error": f"{kind.__name__}: {error}"[:240]} if error else {})
        self._write()


def previous_run(folder: str, before: str | None = None) -> str | None:
    """The latest completed run under a folder, by its manifest."""
    found = []
    for m in Path(folder).glob("*/manifest.json"):
        data = json.loads(m.read_text(encoding="utf-8"))
        if data.get("status") == "completed" and str(m.parent) != before:
            found.append((data.get("finished", ""), str(m.parent)))
    return max(found)[1] if found else None
