"""Runs that go on where they stopped: stages are tables below a shared folder, known by the keys of their contents."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .measure import measured


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()


class Folder:
    """Small files and listings in any store that Spark reads, by its own file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def files(self) -> list[tuple[str, int, int]]:
        """Path below the folder, bytes and time of change of every file, sorted."""
        root = self._path(self.path)
        if not self._fs.exists(root):
            raise FileNotFoundError(self.path)
        base, out, todo = self._fs.getFileStatus(root).getPath().toString(), [], self._fs.listFiles(root, True)
        while todo.hasNext():
            f = todo.next()
            out.append((f.getPath().toString().removeprefix(base), f.getLen(), f.getModificationTime()))
        return sorted(out)

    def write(self, name: str, data: dict) -> None:
        """A JSON file that is there whole or not at all."""
        target, part = self._path(f"{self.path}/{name}"), self._path(f"{self.path}/.{name}.part")
        self._fs.mkdirs(self._path(self.path))
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(data, sort_keys=True, default=str).encode()))
        out.close()
        self._fs.delete(target, False)
        if not self._fs.rename(part, target):
            raise OSError(f"{target} could not be written")

    def read(self, name: str) -> dict:
        lines = self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()
        return json.loads(lines[0])


def content_key(spark: SparkSession, path: str) -> str:
    """A key of the files below a path: their names, sizes and times of change."""
    return _digest(Folder(spark, path).files())


@dataclass
class Stages:
    """The stages of a run below folder. Each has a key of its name, settings and inputs' keys; a finished one with this
    key is read, whoever computed it and whenever, others are computed, written and then marked. So a driver that is lost
    between stages costs the stage it was in, and changed settings cost what depends on them."""

    spark: SparkSession
    folder: str
    keys: dict[str, str] = field(default_factory=dict)
    reused: list[str] = field(default_factory=list)
    computed: list[str] = field(default_factory=list)
    usage: dict[str, dict] = field(default_factory=dict)

    def source(self, name: str, path: str) -> None:
        """Name an input by what its files are."""
        self.keys[name] = content_key(self.spark, path)

    def run(self, name: str, inputs: tuple[str, ...], settings: Mapping[str, object], build: Callable[[], Mapping[str, DataFrame]]) -> dict[str, DataFrame]:
        """The tables of a stage by name. inputs: names of sources and stages it depends on."""
        key = self.keys[name] = _digest([name, dict(settings), {i: self.keys[i] for i in inputs}])
        place = Folder(self.spark, f"{self.folder}/{name}-{key[:16]}")
        if place.exists("done.json"):
            said = place.read("done.json")
            self.reused.append(name)
        else:
            with measured(self.spark, name) as u:
                tables = build()
                for t, df in tables.items():
                    df.write.mode("overwrite").parquet(f"{place.path}/{t}")
            said = {"stage": name, "key": key, "settings": dict(settings), "inputs": {i: self.keys[i] for i in inputs}, "tables": {t: df.schema.json() for t, df in tables.items()}, "usage": u.row()}
            place.write("done.json", said)
            self.computed.append(name)
        self.usage[name] = said["usage"]
        return {t: self.spark.read.schema(_schema(s)).parquet(f"{place.path}/{t}") for t, s in said["tables"].items()}


def _schema(text: str):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(text))
