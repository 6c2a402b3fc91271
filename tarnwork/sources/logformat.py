"""Scanner logs as a Spark data source of their own: ``spark.read.format("scanlogs")`` and ``df.write.format("scanlogs")``.

Reading gives a row for each file under a folder, also for those of no bytes, which Spark's file sources don't list; files
are dealt to tasks by size. Writing gives one file for each row. Files are staged in a hidden folder of the target and
moved into place when all tasks are done; a failed write leaves nothing behind. The folder is one that all machines
mount; logs in another store are read by ``scanlogs.read_logs``.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tarnwork.functions.workers import importable
from tarnwork.sources.scanlogs import LOGS, check_log

#: Bytes of a task's files, and files of a task at most.
TASK_BYTES, TASK_FILES = 16_000_000, 1000
ENDING = ".sarif"


def register(spark: SparkSession) -> None:
    importable(spark)
    spark.dataSource.register(ScanLogs)


def _local(path: str) -> str:
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path} is in no mounted folder; use scanlogs.read_logs")
    return os.path.abspath(path)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths):
        super().__init__(0)
        self.paths = tuple(paths)


@dataclass
class Written(WriterCommitMessage):
    """What a task has staged: names under the staging folder and under the target."""

    files: list[tuple[str, str]] = field(default_factory=list)


class ScanLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "scanlogs"

    def schema(self) -> str:
        return LOGS

    def reader(self, schema) -> LogReader:
        return LogReader(_local(self.options["path"]))

    def writer(self, schema, overwrite: bool) -> LogWriter:
        return LogWriter(_local(self.options["path"]), _local(self.options["root"]) if "root" in self.options else None, overwrite)


class LogReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Files]:
        if not os.path.exists(self.folder):
            raise FileNotFoundError(self.folder)
        found = [self.folder] if os.path.isfile(self.folder) else []
        for top, folders, names in os.walk(self.folder):
            folders[:] = sorted(f for f in folders if not f.startswith((".", "_")))
            found += [os.path.join(top, n) for n in sorted(names) if n.endswith(ENDING)]
        out, held, size = [], [], 0
        for path in found:
            held.append(path)
            size += os.path.getsize(path)
            if size >= TASK_BYTES or len(held) >= TASK_FILES:
                out.append(Files(held))
                held, size = [], 0
        return out + ([Files(held)] if held or not out else [])

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with open(path, "rb") as file:
                    text, error = check_log(file.read())
            except OSError as e:
                text, error = None, f"unreadable: {type(e).__name__}"
            yield path, error is None, error, text


class LogWriter(DataSourceWriter):
    """Reads path and raw of each row by name. Paths are relative to ``root``, or to the target if they are not absolute."""

    def __init__(self, target: str, root: str | None, overwrite: bool):
        self.target, self.root, self.overwrite = target, root, overwrite
        self.staging = os.path.join(target, f"_staging-{uuid.uuid4().hex}")

    def _name(self, path: str) -> str:
        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        name = os.path.normpath(os.path.relpath(path, self.root) if self.root else path)
        if os.path.isabs(name) or name.split(os.sep)[0] in ("..", "."):
            raise ValueError(f"{path} is not under the written folder")
        return name

    def write(self, iterator: Iterator) -> Written:
        # an attempt that fails or is repeated stages under a name of its own
        own, done = os.path.join(self.staging, uuid.uuid4().hex), Written()
        for k, row in enumerate(iterator):
            name = self._name(row["path"])
            if row["raw"] is None:
                raise ValueError(f"{name} has no text")
            os.makedirs(own, exist_ok=True)
            at = os.path.join(own, str(k))
            with open(at, "wb") as file:
                file.write(row["raw"].encode())
                file.flush()
                os.fsync(file.fileno())
            done.files.append((at, name))
        return done

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m for f in m.files]
        names = {name for _, name in files}
        if len(names) < len(files):
            raise ValueError("two rows have one path")
        there = [n for n in names if os.path.exists(os.path.join(self.target, n))]
        if there and not self.overwrite:
            raise FileExistsError(sorted(there)[0])
        os.makedirs(self.target, exist_ok=True)
        for at, name in files:
            to = os.path.join(self.target, name)
            os.makedirs(os.path.dirname(to), exist_ok=True)
            os.replace(at, to)
        shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)
