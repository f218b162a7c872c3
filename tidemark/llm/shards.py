"""Sharding with size-tiered compaction, in DataFrame functions and the Hadoop file system only.

Arrivals are appended as small immutable runs of files. Runs of one size tier merge,
once there are enough of them, into files of the target size. What a table consists
of is said by a versioned manifest alone: a new version is written aside and put into
place by an operation that fails if the version is there already, so one writer wins.

A writer notes each run under pending/ before the run's first file exists and until
after its commit, so vacuum() leaves alone what is still being written. The notes of
writers that died count no more after an age; a run that such a vacuum has taken can't
be committed, as commit() looks whether its runs are there.
"""

from __future__ import annotations

import contextlib
import json
import math
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .common import remove

MB = 1 << 20
#: Size of a merged file; runs of a tier that start a merge; bytes of the lowest tier and how much a tier is larger than the one below.
TARGET, FAN, BASE, RATIO = 128 * MB, 4, 16 * MB, 4
#: Files of the target size that one job of a merge writes.
AT_ONCE = 256
#: Seconds after which the note of a writer counts no more.
AGE = 7 * 86_400


@dataclass(frozen=True)
class Run:
    path: str
    size: int
    rows: int
    files: int
    schema: str


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, fan: int = FAN, base: int = BASE, ratio: int = RATIO):
        self.spark, self.root, self.target, self.fan, self.base, self.ratio = spark, root.rstrip("/"), target, fan, base, ratio
        # merges plan in a session of their own: there a union of frames of one partition keeps a partition for each
        self._merging = spark.newSession()
        self._merging.conf.set("spark.sql.unionOutputPartitioning", "false")

    # --- files ---------------------------------------------------------------------------------------

    def _path(self, p: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(p)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        fs, at = self._fs(), self._path(f"{self.root}/manifest")
        if not fs.exists(at):
            return []
        return sorted(int(n[1:-5]) for n in (s.getPath().getName() for s in fs.listStatus(at)) if n[0] == "v" and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Run]]:
        """Version and runs; version 0 is the empty table."""
        have = self.versions()
        v = (have[-1] if have else 0) if version is None else version
        if v == 0:
            return 0, []
        stream = self._fs().open(self._path(f"{self.root}/manifest/v{v:010d}.json"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return v, [Run(**r) for r in json.loads(text)["runs"]]

    def _put(self, aside, final) -> bool:
        """Gives the file its final name, in one step, unless the name is taken.

        On a local disk by a hard link, elsewhere by a rename that doesn't replace,
        which HDFS and file systems like it do in one step. On a store without such
        a rename, only one writer at a time may commit.
        """
        jvm = self.spark._jvm
        try:
            if self._fs().getUri().getScheme() == "file":
                local = [jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, aside)]
                jvm.java.nio.file.Files.createLink(*local)
                self._fs().delete(aside, False)
            else:
                none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark._jsc.hadoopConfiguration()).rename(aside, final, none)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e) or self._fs().exists(final):
                return False
            raise
        return True

    def commit(self, base: int, runs: list[Run]) -> int:
        """Version base + 1. Conflict if it is there already, FileNotFoundError if a run isn't."""
        fs, new = self._fs(), base + 1
        for r in runs:
            if not fs.exists(self._path(r.path)):
                raise FileNotFoundError(f"run {r.path} is gone")
        aside, final = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}"), self._path(f"{self.root}/manifest/v{new:010d}.json")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps({"version": new, "runs": [asdict(r) for r in runs]}).encode()))
        out.close()
        if not self._put(aside, final):
            fs.delete(aside, False)
            raise Conflict(f"version {new} exists")
        return new

    @contextlib.contextmanager
    def _writing(self):
        """The path of a new run, noted as pending until the block ends."""
        name = uuid.uuid4().hex
        note = self._path(f"{self.root}/pending/{name}")
        self._fs().create(note, False).close()
        try:
            yield f"{self.root}/data/{name}"
        finally:
            self._fs().delete(note, False)

    def _run(self, path: str, schema) -> Run:
        """What stands at the path after Spark's committer has made it whole."""
        total = self._fs().getContentSummary(self._path(path))
        back = self.spark.read.schema(schema).parquet(path)
        return Run(path, total.getLength(), back.count(), sum(f.endswith(".parquet") for f in back.inputFiles()), schema.json())

    # --- operations ------------------------------------------------------------------------------------

    def append(self, df: DataFrame, attempts: int = 20) -> int:
        """One arrival. An arrival without rows changes nothing. Writers may append at the same time."""
        with self._writing() as path:
            df.write.parquet(path)
            run = self._run(path, df.schema)
            if not run.rows:
                remove(self.spark, path)
                return self.manifest()[0]
            for _ in range(attempts):
                v, runs = self.manifest()
                try:
                    return self.commit(v, [*runs, run])
                except Conflict:
                    continue
            raise Conflict("too many writers")

    def tier(self, size: int) -> int:
        return 0 if size <= self.base else 1 + int(math.log(size / self.base, self.ratio))

    def due(self, runs: list[Run]) -> list[Run]:
        """The runs of the lowest tier that has fan or more."""
        by: dict[int, list[Run]] = {}
        for r in runs:
            by.setdefault(self.tier(r.size), []).append(r)
        return next((by[t] for t in sorted(by) if len(by[t]) >= self.fan), [])

    def compact(self) -> int:
        """Merges until no tier is full; returns the version.

        Files are dealt in order to groups of about the target size; a task reads one
        group and writes one file. So no task does more than that, nothing is
        shuffled, and no key can be hot. A commit that another writer forestalls is
        tried again on the new version, as long as that still has the merged runs.
        """
        while True:
            v, runs = self.manifest()
            some = self.due(runs)
            if not some:
                return v
            with self._writing() as path:
                schema = self._frame(some).schema
                groups = self._groups(some)
                for lo in range(0, len(groups), AT_ONCE):
                    frames = [self._frame(g, self._merging).coalesce(1) for g in groups[lo : lo + AT_ONCE]]
                    _union(frames).write.mode("append").parquet(path)
                merged = self._run(path, schema)
                while True:
                    try:
                        self.commit(v, [r for r in runs if r not in some] + [merged])
                        break
                    except Conflict:
                        v, runs = self.manifest()
                        if not all(r in runs for r in some):  # another compaction was faster
                            remove(self.spark, path)
                            break

    def _groups(self, runs: list[Run]) -> list[list[Run]]:
        """The files of runs as runs of one file, in groups of about the target size; names and sizes come to the driver."""
        fs, out, size = self._fs(), [[]], 0
        for r in runs:
            for f in fs.listStatus(self._path(r.path)):
                if f.getPath().getName().endswith(".parquet"):
                    if out[-1] and size + f.getLen() / 2 > self.target:
                        out.append([])
                        size = 0
                    out[-1].append(Run(f.getPath().toString(), f.getLen(), 0, 1, r.schema))
                    size += f.getLen()
        return out

    def _frame(self, runs: list[Run], spark: SparkSession | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        frames: dict[str, list[str]] = {}
        for r in runs:
            frames.setdefault(r.schema, []).append(r.path)
        return _union([(spark or self.spark).read.schema(StructType.fromJson(json.loads(s))).parquet(*paths) for s, paths in frames.items()])

    def read(self, version: int | None = None) -> DataFrame:
        """The table at a version (the last by default)."""
        v, runs = self.manifest(version)
        if not runs:
            raise ValueError("the table is empty")
        return self._frame(runs)

    def vacuum(self, age: float = AGE, clock: Callable[[], float] = time.time) -> int:
        """Deletes runs that neither the last version nor a writer's note names; earlier versions, and readers of them, can't read them any more then. Notes older than age seconds go first.

        Data is listed before notes and notes before the version: a run without a note
        by then has been committed before the version is read, or never will be.
        """
        fs = self._fs()
        ls = lambda name: list(fs.listStatus(at)) if fs.exists(at := self._path(f"{self.root}/{name}")) else []
        data, pending = ls("data"), set()
        for note in ls("pending"):
            if note.getModificationTime() / 1000 < clock() - age:
                fs.delete(note.getPath(), False)
            else:
                pending.add(note.getPath().getName())
        live = {r.path.rsplit("/", 1)[1] for r in self.manifest()[1]} | pending
        gone = [s.getPath() for s in data if s.getPath().getName() not in live]
        for p in gone:
            fs.delete(p, True)
        return len(gone)


def _union(frames: list[DataFrame]) -> DataFrame:
    """A balanced tree, so that the plan of many frames isn't deep."""
    while len(frames) > 1:
        frames = [a[0].unionByName(a[1], allowMissingColumns=True) if len(a) == 2 else a[0] for a in (frames[i : i + 2] for i in range(0, len(frames), 2))]
    return frames[0]
