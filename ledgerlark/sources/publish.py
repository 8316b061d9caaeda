"""Several tables published as one: new snapshot folders, then a manifest that names them, swapped last.

A reader goes by the newest manifest, so a run that dies before its manifest is written leaves the old tables as they were; what it wrote
is in folders that no manifest names. A manifest is written under a temporary name and renamed, which fails if that number is there
already, so of two runs at once the second stops instead of overwriting the first."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.state import patched


def files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


class Publication:
    """Tables under a root. `version` is that of the manifest read, 0 where there is none."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.refresh()

    def refresh(self) -> None:
        folder, fs = files(self.spark, f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        versions = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        self.version = max(versions, default=0)
        text = self.spark.read.text(f"{self.root}/manifests/{self.version:08d}.json", wholetext=True).first() if versions else None
        self.manifest: dict = json.loads(text.value) if text else {"tables": {}, "header": {}}

    @property
    def header(self) -> dict:
        return self.manifest["header"]

    def table(self, name: str) -> DataFrame | None:
        """A table as published, null where it is not. Its types are those it was written with."""
        entry = self.manifest["tables"].get(name)
        return None if entry is None else self.spark.read.schema(T.StructType.fromJson(entry["schema"])).parquet(f"{self.root}/{entry['path']}")

    def commit(self, tables: dict[str, DataFrame], header: dict) -> int:
        """Write the tables, then the manifest. Tables that are not given stay as they are."""
        run = uuid.uuid4().hex
        entries = dict(self.manifest["tables"])
        for name, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{self.root}/data/{run}/{name}")
            entries[name] = {"path": f"data/{run}/{name}", "schema": json.loads(df.schema.json())}
        self.swap({"tables": entries, "header": header})
        return self.version

    def swap(self, manifest: dict) -> None:
        new = self.version + 1
        temporary, fs = files(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}")
        final, _ = files(self.spark, f"{self.root}/manifests/{new:08d}.json")
        out = fs.create(temporary, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            fs.delete(temporary, False)
            raise FileExistsError(f"version {new} has been published meanwhile")
        self.version, self.manifest = new, manifest

    def patch(self, events: DataFrame, sources: DataFrame, report: DataFrame, header: dict, others: dict[str, DataFrame] | None = None) -> int:
        """Publish a run of some sources: their events and report rows replace those published, all others stay. Without an earlier output
        there is nothing to patch. The header stays the earlier run's where it is of the same day."""
        before, told = self.table("events"), self.table("report")
        if before is None:
            raise FileNotFoundError("nothing has been published that could be patched; run all sources first")
        merged = {"events": patched(before, events, sources)}
        if told is not None:
            merged["report"] = told.join(report.select("source"), "source", "left_anti").unionByName(report, allowMissingColumns=True)
        else:
            merged["report"] = report
        kept = {k: v for k, v in self.header.items()} if self.header.get("today") == header.get("today") else {}
        return self.commit({**merged, **(others or {})}, {**header, **kept})

    def prune(self, keep: int = 3) -> list[str]:
        """Delete the folders that none of the last `keep` manifests names, and older manifests. Run it when no other run is under way."""
        named, dropped = set(), []
        folder, fs = files(self.spark, f"{self.root}/manifests")
        for s in list(fs.listStatus(folder)):
            name = s.getPath().getName()
            if name[:-5].isdigit() and int(name[:-5]) > self.version - keep:
                entries = json.loads(self.spark.read.text(f"{self.root}/manifests/{name}", wholetext=True).first().value)["tables"]
                named |= {e["path"].split("/")[1] for e in entries.values()}
            elif not name.endswith(".crc"):
                fs.delete(s.getPath(), False)
        data, fs = files(self.spark, f"{self.root}/data")
        for s in list(fs.listStatus(data)) if fs.exists(data) else []:
            if s.getPath().getName() not in named:
                fs.delete(s.getPath(), True)
                dropped.append(s.getPath().getName())
        return dropped


def kept_timeline(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A timeline of one JSON row a line, or null if a line is damaged: then it must not be written over. A missing file is an empty
    timeline. The file is read twice, once to see that it is whole: a row a day."""
    at, fs = files(spark, path)
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    said = F.from_json("value", f"{schema}, __damaged string", {"columnNameOfCorruptRecord": "__damaged"})
    lines = spark.read.text(path).where(F.trim("value") != "").select(said.alias("r"))
    return lines.select("r.*").drop("__damaged") if lines.where("r.__damaged is not null").isEmpty() else None


def update_timeline(spark: SparkSession, path: str, schema: str, change: Callable[[DataFrame], DataFrame]) -> bool:
    """Rewrite a timeline by change(rows), sorted by day, beside the old one and then in its place; a damaged one stays as it is."""
    old = kept_timeline(spark, path, schema)
    if old is None:
        return False
    beside = f"{path}.{uuid.uuid4().hex}"
    change(old).coalesce(1).sortWithinPartitions("date").write.json(beside)  # a row a day
    was, fs = files(spark, path)
    new, _ = files(spark, beside)
    away, _ = files(spark, f"{path}.old")
    fs.delete(away, True)
    if fs.exists(was):
        fs.rename(was, away)
    fs.rename(new, was)
    fs.delete(away, True)
    return True
