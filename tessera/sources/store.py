"""Heap and sorted tables in a folder: create, load, append, scan."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import EngineError, UnknownAttribute
from tessera.functions.predicate import Cnf, bind, parse_cnf


class Store:
    """A table under a path that Spark reads: Parquet folders, and a log with one file per version that names the current ones.

    A heap takes appended rows as they come. A sorted table is range-partitioned and sorted by its keys, so that scans
    with ranges on them skip files and row groups by their statistics; rows appended to it are sorted by themselves, as a
    delta beside the rest, and compact() or every DELTAS-th append merges all. New files are written before the
    log names them, so readers never see half a version, and a version is entered by renaming a file: of two writers that
    start from the same version one fails. Folders that no version up to the last but one names are deleted.
    """

    DELTAS = 8

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _log(self) -> str:
        return f"{self.path}/log"

    def create(self, kind: str = "heap", keys: Sequence[str] = ()) -> Store:
        """kind: heap or sorted, the latter with its sort keys."""
        if kind not in ("heap", "sorted") or (kind == "sorted") != bool(keys):
            raise EngineError("a table is a heap, or sorted by keys")
        self._note({"kind": kind, "keys": list(keys), "versions": [], "n": 0})
        return self

    def _files(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(conf), where

    def _note(self, meta: dict) -> None:
        """Enter a version: a file of its number, which must not exist."""
        fs, final = self._files(f"{self._log()}/{meta['n']:010d}.json")
        _, temp = self._files(f"{self._log()}/.{uuid.uuid4().hex}")
        out = fs.create(temp)
        out.write(json.dumps(meta).encode())
        out.close()
        if fs.exists(final) or not fs.rename(temp, final):
            fs.delete(temp, False)
            raise EngineError(f"version {meta['n']} of {self.path} was written by another")

    def _noted(self) -> list[str]:
        """Paths of the log's files, the last version last."""
        fs, log = self._files(self._log())
        return sorted(x.getPath().toString() for x in fs.listStatus(log) if x.getPath().getName().endswith(".json")) if fs.exists(log) else []

    def _read(self, path: str) -> dict:
        return json.loads(self.spark.read.text(path, wholetext=True).first()["value"])

    def meta(self) -> dict:
        """The latest log entry."""
        if not (noted := self._noted()):
            raise EngineError(f"no table at {self.path}")
        return self._read(noted[-1])

    def load(self, df: DataFrame) -> Store:
        """Replace all rows."""
        return self._put(self.meta(), df, [])

    def append(self, df: DataFrame) -> Store:
        """Add rows; the columns are matched by name. Only these rows are sorted, save at every DELTAS-th append."""
        meta = self.meta()
        if meta["kind"] == "sorted" and len(meta["versions"]) >= self.DELTAS:
            return self._put(meta, self._frame(meta).unionByName(df), [])
        return self._put(meta, df, meta["versions"])

    def compact(self) -> Store:
        """Write all rows as one folder, sorted anew in a sorted table."""
        meta = self.meta()
        return self._put(meta, self._frame(meta), []) if len(meta["versions"]) > 1 else self

    def _put(self, meta: dict, df: DataFrame, kept: list[str]) -> Store:
        if missing := set(meta["keys"]) - set(df.columns):
            raise UnknownAttribute(f"sort keys are missing: {sorted(missing)}")
        name = f"{self.path}/v{meta['n'] + 1}-{uuid.uuid4().hex[:8]}"
        keys = [F.col(f"`{k}`") for k in meta["keys"]]
        (df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df).write.parquet(name)
        self._note(meta | {"versions": [*kept, name], "n": meta["n"] + 1})
        self._clean()
        return self

    def _clean(self) -> None:
        """Delete what neither of the last two versions names; a reader of the version before may still be at work."""
        noted = self._noted()
        if len(noted) > 2:
            named = {v for x in noted[-2:] for v in self._read(x)["versions"]}
            for v in set(self._read(noted[-3])["versions"]) - named:
                fs, where = self._files(v)
                fs.delete(where, True)

    def _frame(self, meta: dict) -> DataFrame:
        if not meta["versions"]:
            raise EngineError("nothing has been loaded")
        return self.spark.read.parquet(*meta["versions"])

    def scan(self, cnf: Cnf | str | None = None, mode: str = "ansi") -> DataFrame:
        """All rows, or those that meet a predicate, which reaches the Parquet scan."""
        df = self._frame(self.meta())
        if cnf is None:
            return df
        return df.where(bind(parse_cnf(cnf, mode) if isinstance(cnf, str) else cnf, df.schema, mode=mode))
