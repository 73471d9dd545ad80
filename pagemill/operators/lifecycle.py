"""A store of tables partitioned by task: its schema's version, and tasks that go to a trash folder as a whole or not at all."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.errors import StoreError

META, TRASH = "_schema_version", "_trash"


class _Files:
    """The Hadoop file system of a path, so that any that Spark writes to will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, self._path = root.rstrip("/"), spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def path(self, *parts: str):
        return self._path("/".join([self.root, *parts]))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.path(*parts))

    def names(self, *parts: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.path(*parts))] if self.exists(*parts) else []

    def move(self, source: list[str], target: list[str]) -> None:
        self.fs.mkdirs(self.path(*target[:-1]))
        if self.exists(*target) or not self.fs.rename(self.path(*source), self.path(*target)):
            raise StoreError(f"cannot move {'/'.join(source)} to {'/'.join(target)}")

    def delete(self, *parts: str) -> None:
        self.fs.delete(self.path(*parts), True)

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.path(*parts))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        """The file is there whole or as it was before: written beside, then renamed."""
        beside = [*parts[:-1], f"{parts[-1]}.new"]
        stream = self.fs.create(self.path(*beside), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.delete(*parts)
        self.move(beside, list(parts))


class Store:
    """Tables below a folder, each partitioned by `key`.

    Opened with the version that this code writes: a new store gets it; an older one goes through `steps`, one for each
    version after its own, and gets each step's version once that step is done, so that a failed one is taken up again;
    a newer one, or one without a needed step, is refused and left as it is. One driver at a time opens or deletes.
    """

    def __init__(self, spark: SparkSession, root: str, version: int, key: str = "task_id", steps: dict[int, Callable[[SparkSession, str], None]] | None = None):
        self.spark, self.root, self.key, self.files = spark, root.rstrip("/"), key, _Files(spark, root)
        found = self.version()
        if found is None:
            self.files.fs.mkdirs(self.files.path())
            self.files.write(str(version), META)
            return
        if found > version:
            raise StoreError(f"the store's version is {found}, this code knows {version}")
        if lost := [v for v in range(found + 1, version + 1) if v not in (steps or {})]:
            raise StoreError(f"no step to version {lost[0]}")
        for v in range(found + 1, version + 1):
            steps[v](spark, self.root)
            self.files.write(str(v), META)

    def version(self) -> int | None:
        """None for a store that is not there yet."""
        name = META if self.files.exists(META) else f"{META}.new"  # a rename that did not come to its end
        if not self.files.exists(name):
            return None
        text = self.files.read(name).strip()
        if not text.isdigit():
            raise StoreError(f"no version: {text!r}")
        return int(text)

    def tables(self) -> list[str]:
        return sorted(n for n in self.files.names() if not n.startswith(("_", ".")))

    def write(self, table: str, rows: DataFrame) -> None:
        """The rows' tasks get these rows in place of those they had; other tasks stay."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.key).parquet(f"{self.root}/{table}")

    def read(self, table: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def partition(self, task: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_-]+", task):
            raise StoreError(f"no name of a task: {task!r}")
        return f"{self.key}={task}"

    def _moved(self, moves: list[tuple[list[str], list[str]]]) -> None:
        """All moves, or none: those that were done are undone, last first, before the failure is raised."""
        done = []
        try:
            for source, target in moves:
                self.files.move(source, target)
                done.append((source, target))
        except Exception:
            for source, target in reversed(done):
                self.files.move(target, source)
            raise

    def delete_task(self, task: str, now: dt.datetime | None = None) -> str:
        """Moves a task's rows of all tables to the trash, by renames of folders, and returns their place there; no row is
        read. A task that no table holds is an error."""
        part, stamp = self.partition(task), (now or dt.datetime.now(dt.UTC)).strftime("%Y%m%dT%H%M%S%f")
        place = f"{task}.{stamp}"
        if not (held := [t for t in self.tables() if self.files.exists(t, part)]):
            raise StoreError(f"no task {task}")
        if self.files.exists(TRASH, place):
            raise StoreError(f"{place} is in the trash already")
        try:
            self._moved([([t, part], [TRASH, place, t, part]) for t in held])
        except Exception:
            self.files.delete(TRASH, place)
            raise
        return place

    def restore_task(self, place: str) -> None:
        """Takes a deleted task back, unless there is one of its name again."""
        part = self.partition(place.split(".")[0])
        if not (held := sorted(self.files.names(TRASH, place))):
            raise StoreError(f"{place} is not in the trash")
        if again := [t for t in self.tables() if self.files.exists(t, part)]:
            raise StoreError(f"{again[0]} holds {part} again")
        self._moved([([TRASH, place, t, part], [t, part]) for t in held])
        self.files.delete(TRASH, place)

    def trash(self) -> list[tuple[str, int]]:
        """(place, bytes) of what was deleted."""
        size = lambda p: self.files.fs.getContentSummary(self.files.path(TRASH, p)).getLength()
        return [(p, size(p)) for p in sorted(self.files.names(TRASH))]

    def empty_trash(self, before: dt.datetime) -> int:
        """Removes for good what was deleted before that time; returns the bytes that this freed."""
        gone = [(p, n) for p, n in self.trash() if p.rsplit(".", 1)[1] < before.strftime("%Y%m%dT%H%M%S%f")]
        for place, _ in gone:
            self.files.delete(TRASH, place)
        return sum(n for _, n in gone)
