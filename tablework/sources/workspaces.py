"""Workspaces: named folders of tables with aliases, saved steps and a history, kept in versions of a manifest.

A change reads the newest manifest and creates the next one, a file of its own that nobody can create twice; who comes too
late is told so. Readers take the newest, so they never see half a change. All of it goes through Hadoop's file systems.
"""

from __future__ import annotations

import json
import re
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from tablework.operators.quantiles import nan_to_null
from tablework.plans import pipelines
from tablework.sources.files import read_csv

FOLDERS = ("data/raw", "data/working", "data/trials", "reports", "pipelines")
STAGES = ("raw", "working", "trial", "output")
#: Entries of the history that opening a workspace shows.
RECENT = 10


class Workspace:
    """A workspace under base; create() makes it, open() finds it."""

    def __init__(self, spark: SparkSession, base: str, name: str):
        if not re.fullmatch(r"[\w.-]+", name) or name.startswith("."):
            raise ValueError(f"{name!r} is no name for a workspace")
        self.spark, self.name, self.path = spark, name, f"{base.rstrip('/')}/{name}"

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at, fs = self._at(f"{self.path}/manifest")
        return sorted(int(n[:-5]) for x in fs.listStatus(at) if re.fullmatch(r"\d+\.json", n := x.getPath().getName())) if fs.exists(at) else []

    def manifest(self) -> dict:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no workspace {self.name!r}")
        text = self.spark.read.text(f"{self.path}/manifest/{versions[-1]}.json", wholetext=True).first()[0]
        return json.loads(text) | {"version": versions[-1]}

    def _store(self, manifest: dict) -> dict:
        version = manifest.pop("version", 0) + 1
        at, fs = self._at(f"{self.path}/manifest/{version}.json")
        draft, _ = self._at(f"{self.path}/manifest/.{version}-{datetime.now(timezone.utc).strftime('%Y%m%dT%H%M%S%f')}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest, indent=1, sort_keys=True).encode()))
        out.close()
        if fs.exists(at) or not fs.rename(draft, at):
            fs.delete(draft, False)
            raise RuntimeError(f"workspace {self.name!r} has been changed meanwhile; open it again")
        return manifest | {"version": version}

    def create(self, description: str = "") -> Workspace:
        """Folders and a first manifest; a workspace of that name is an error."""
        if self._versions():
            raise FileExistsError(f"workspace {self.name!r} exists")
        for folder in FOLDERS:
            at, fs = self._at(f"{self.path}/{folder}")
            fs.mkdirs(at)
        self._store({"name": self.name, "description": description, "created": _now(), "files": {}, "pipelines": {}, "active_file": None, "history": []})
        return self

    def open(self) -> dict:
        """Description, active file, aliases, names of saved steps, and the last of the history."""
        m = self.manifest()
        return {**{k: m[k] for k in ("name", "description", "created", "active_file")}, "aliases": {a: {k: f[k] for k in ("path", "stage", "rows")} for a, f in m["files"].items()}, "pipelines": sorted(m["pipelines"]), "history": m["history"][-RECENT:]}

    def register(self, path: str, alias: str, stage: str = "raw", active: bool = False) -> dict:
        """Give the table at path an alias (its rows are counted); an alias that is taken now means the new table."""
        if stage not in STAGES:
            raise ValueError(f"unknown stage {stage!r}; known: {', '.join(STAGES)}")
        if "/" in alias or not alias:
            raise ValueError(f"{alias!r} is no alias")
        at, fs = self._at(path)
        if not fs.exists(at):
            raise FileNotFoundError(path)
        m = self.manifest()
        size = fs.getContentSummary(at).getLength()
        m["files"][alias] = {"path": path, "stage": stage, "rows": read_table(self.spark, path).count(), "size_bytes": size, "registered": _now()}
        if active:
            m["active_file"] = alias
        return self._store(m)["files"][alias]

    def files(self, stage: str = "") -> DataFrame:
        """(alias, stage, path, rows, size_bytes, registered) of all tables, or those of a stage."""
        rows = [(a, f["stage"], f["path"], f["rows"], f["size_bytes"], f["registered"]) for a, f in sorted(self.manifest()["files"].items()) if stage in ("", f["stage"])]
        return self.spark.createDataFrame(rows, "alias string, stage string, path string, rows long, size_bytes long, registered string")

    def table(self, alias: str) -> DataFrame:
        files = self.manifest()["files"]
        if alias not in files:
            raise KeyError(f"no {alias!r} in workspace {self.name!r}; there are {', '.join(sorted(files))}")
        return read_table(self.spark, files[alias]["path"])

    def save_pipeline(self, name: str, steps: list[dict]) -> None:
        """Keep steps under a name; unknown ones are an error here already."""
        pipelines.check(steps)
        m = self.manifest()
        m["pipelines"][name] = {"steps": steps, "saved": _now()}
        self._store(m)

    def run_pipeline(self, name: str, source: str, target: str, stage: str = "working") -> DataFrame:
        """Saved steps over the table source, stored as a table of its own with alias target; source stays as it is."""
        m = self.manifest()
        if name not in m["pipelines"]:
            raise KeyError(f"no pipeline {name!r}; there are {', '.join(sorted(m['pipelines']))}")
        out = pipelines.apply(self.table(source), m["pipelines"][name]["steps"])
        folder = {"trial": "data/trials", "output": "reports"}.get(stage, f"data/{stage}")
        path = f"{self.path}/{folder}/{target}-{m['version'] + 1}.parquet"
        out.write.mode("errorifexists").parquet(path)
        rows = self.register(path, target, stage)["rows"]
        m = self.manifest()
        m["history"].append({"pipeline": name, "source": source, "target": target, "rows": rows, "at": _now()})
        self._store(m)
        return self.spark.read.parquet(path)


def _now() -> str:
    return datetime.now(timezone.utc).isoformat(timespec="seconds")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by its path's ending: .csv, .tsv, .json, else Parquet; NaN is null."""
    ending = path.rstrip("/").rpartition(".")[2].lower()
    if ending in ("csv", "tsv"):
        return read_csv(spark, path, "\t" if ending == "tsv" else ",")
    return nan_to_null(spark.read.json(path) if ending in ("json", "jsonl") else spark.read.parquet(path))


def resolve(spark: SparkSession, reference: str, base: str) -> DataFrame:
    """The table that workspace:name/alias (or project:name/alias) means, or the one at a path."""
    match = re.fullmatch(r"(?:workspace|project):([^/]+)/(.+)", reference)
    return Workspace(spark, base, match[1]).table(match[2]) if match else read_table(spark, reference)
