"""Stages as a graph whose tables are addressed by what they are made from.

A stage's key is a hash of its name, version and settings and of the keys of what it reads. Its table lies under that key, so a
second run reads what is there, a changed setting recomputes that stage and what follows it, and a run that broke off goes on
after its last whole table.
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import complete, exists, written


@dataclasses.dataclass(frozen=True)
class Stage:
    """make(inputs, settings) gives the stage's table from a dictionary of its inputs by name. An input is a source or an earlier
    stage; one that was skipped is None, and make has to do without it. `version` changes where the code does."""

    name: str
    make: Callable[[dict[str, DataFrame | None], object], DataFrame]
    needs: tuple[str, ...] = ()
    settings: object = None
    version: str = "1"


def plain(settings: object) -> object:
    """Settings as JSON has them: dataclasses as dictionaries, sets and tuples as lists."""
    if dataclasses.is_dataclass(settings) and not isinstance(settings, type):
        return plain(dataclasses.asdict(settings))
    if isinstance(settings, dict):
        return {str(k): plain(v) for k, v in settings.items()}
    if isinstance(settings, (set, frozenset)):
        return sorted(map(str, settings))
    return [plain(v) for v in settings] if isinstance(settings, (list, tuple)) else settings


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps([plain(p) for p in parts], sort_keys=True, default=str).encode()).hexdigest()[:16]


def fingerprint(spark: SparkSession, path: str) -> str:
    """A hash of the names, lengths and times of the files under a path: what a source's key is where nothing better is known.
    Only the list of files is read."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found, files = store.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        files.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return digest(sorted(files))


class Graph:
    """Stages in an order in which each comes after what it needs. `root` is a folder in a store that all executors share."""

    def __init__(self, root: str, stages: Iterable[Stage]):
        self.root, self.stages = root.rstrip("/"), {}
        for s in stages:
            if s.name in self.stages:
                raise ValueError(f"two stages are called {s.name}")
            self.stages[s.name] = s

    def wanted(self, skip: Iterable[str] = (), stop_after: str | None = None) -> list[str]:
        """The stages of a run: all up to `stop_after`, without the skipped ones. Unknown names are an error."""
        names = list(self.stages)
        for name in [*skip, *([stop_after] if stop_after else [])]:
            if name not in self.stages:
                raise ValueError(f"no stage {name}; there are {', '.join(names)}")
        last = names.index(stop_after) + 1 if stop_after else len(names)
        return [n for n in names[:last] if n not in set(skip)]

    def keys(self, sources: dict[str, str], skip: Iterable[str] = ()) -> dict[str, str]:
        """The key of each stage, from those of the sources. A skipped stage has none, which its followers' keys show."""
        found: dict[str, str | None] = dict(sources)
        for s in self.stages.values():
            for n in s.needs:
                if n not in found:
                    raise ValueError(f"{s.name} needs {n}, which is neither a source nor an earlier stage")
            found[s.name] = None if s.name in set(skip) else digest(s.name, s.version, s.settings, [found[n] for n in s.needs])
        return {n: found[n] for n in self.stages if found[n]}

    def path(self, name: str, key: str) -> str:
        return f"{self.root}/{name}-{key}"

    def run(
        self, spark: SparkSession, sources: dict[str, tuple[str, DataFrame]], skip: Iterable[str] = (), stop_after: str | None = None
    ) -> tuple[dict[str, DataFrame], list[str]]:
        """(the tables of the stages that were wanted, the names of those that were computed now). sources: name -> (key, table).

        A table counts once its write came to its end; half of one is written anew.
        """
        keys = self.keys({n: k for n, (k, _) in sources.items()}, skip)
        tables: dict[str, DataFrame | None] = {n: df for n, (_, df) in sources.items()} | dict.fromkeys(skip)
        made, out = [], {}
        for name in self.wanted(skip, stop_after):
            s, path = self.stages[name], self.path(name, keys[name])
            if complete(spark, path):
                tables[name] = spark.read.parquet(path)
            else:
                tables[name] = written(s.make({n: tables.get(n) for n in s.needs}, s.settings), path)
                made.append(name)
            out[name] = tables[name]
        return out, made


def backfill(spark: SparkSession, source: str, target: str, names: Iterable[str] | None = None) -> list[str]:
    """Copy the whole stage tables of one root that another lacks, by Spark; gives the folders copied. names: stages wanted."""
    source, target = source.rstrip("/"), target.rstrip("/")
    if not exists(spark, source):
        return []
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(source)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    folders = sorted(f.getPath().getName() for f in listed if f.isDirectory())
    copied = []
    for folder in folders:
        stage = folder.rpartition("-")[0]
        if (names is None or stage in set(names)) and complete(spark, f"{source}/{folder}") and not complete(spark, f"{target}/{folder}"):
            written(spark.read.parquet(f"{source}/{folder}"), f"{target}/{folder}")
            copied.append(folder)
    return copied
