"""A write-once sink of raw files, in two phases: tasks stage, the driver commits."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Moves that the driver has under way at a time.
MOVES = 16
_STAGING = "_staging"


def _opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system and the path in it; a path without a scheme is a local or mounted one."""
    if re.match(r"[a-z][a-z0-9+.\-]*:", path):
        system, inside = arrow_fs.FileSystem.from_uri(path)
        return system, inside.rstrip("/")
    return arrow_fs.LocalFileSystem(), path.rstrip("/")


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: (staged path, name in the sink, SHA-256 of the bytes)."""

    files: list[tuple[str, str, str]]


class RawFiles(DataSource):
    """``df.write.format("raw_files").mode("append").save(path)``: a file for each row (name, content).

    A task writes its files under a staging folder of its own; only when all tasks have
    succeeded does the driver move them into place, so that a failed or repeated task
    leaves nothing. A name that is taken keeps its bytes: equal ones are skipped, others
    make the write fail before anything is moved. Two rows of one name must be equal too.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("raw files are written once: use mode append")
        names = [f.name for f in schema.fields]
        if sorted(names) != ["content", "name"]:
            raise ValueError("raw files have the columns name and content")
        return RawFilesWriter(self.options["path"])


class RawFilesWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.run = path, uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Staged:
        system, root = _opened(self.path)
        folder = f"{root}/{_STAGING}/{self.run}/{uuid.uuid4().hex}"
        files: list[tuple[str, str, str]] = []
        system.create_dir(folder, recursive=True)
        for n, row in enumerate(rows):
            name, content = row["name"], bytes(row["content"] or b"")
            if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"no name for a file: {name!r}")
            with system.open_output_stream(f"{folder}/{n}") as out:
                out.write(content)
            files.append((f"{folder}/{n}", name, hashlib.sha256(content).hexdigest()))
        return Staged(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = _opened(self.path)
        wanted: dict[str, tuple[str, str]] = {}
        for message in messages:
            for staged, name, digest in message.files if isinstance(message, Staged) else ():
                if wanted.setdefault(name, (staged, digest))[1] != digest:
                    raise ValueError(f"two contents for {name}")
        with ThreadPoolExecutor(MOVES) as pool:
            moved = list(pool.map(lambda x: self._taken(system, f"{root}/{x[0]}", x[1][1]), wanted.items()))
            fresh = [(staged, f"{root}/{name}") for (name, (staged, _)), taken in zip(wanted.items(), moved) if not taken]
            for folder in sorted({target.rpartition("/")[0] for _, target in fresh}):
                system.create_dir(folder, recursive=True)
            list(pool.map(lambda x: system.move(*x), fresh))
        self._clear(system, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*_opened(self.path))

    @staticmethod
    def _taken(system: arrow_fs.FileSystem, target: str, digest: str) -> bool:
        if system.get_file_info(target).type == arrow_fs.FileType.NotFound:
            return False
        held = hashlib.sha256()
        with system.open_input_stream(target) as file:
            while chunk := file.read(1 << 20):
                held.update(chunk)
        if held.hexdigest() != digest:
            raise ValueError(f"{target} holds other bytes")
        return True

    def _clear(self, system: arrow_fs.FileSystem, root: str) -> None:
        for folder in (f"{root}/{_STAGING}/{self.run}", f"{root}/{_STAGING}"):
            info = system.get_file_info(folder)
            if info.type == arrow_fs.FileType.Directory:
                if folder.endswith(self.run) or not system.get_file_info(arrow_fs.FileSelector(folder)):
                    system.delete_dir(folder)


def write_raw_files(files: DataFrame, path: str) -> None:
    """Write rows (name, content) as files under ``path``, all or none."""
    register(files.sparkSession)
    files.select("name", "content").write.format("raw_files").mode("append").save(path)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawFiles)
