"""A sink that publishes files all at once: tasks stage, the driver's commit makes the folder appear, an abort leaves nothing.

Rows are (name, content), a file each. A task writes its files below a hidden folder beside the target; the commit gathers those of
the tasks that succeeded in one folder and renames it to the target. A target that exists is never touched. The path may be a
local one or a URI of a file system that pyarrow opens.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "published"
SCHEMA = "name string, content binary"


@dataclass
class Staged(WriterCommitMessage):
    """What one task has staged."""

    folder: str
    names: list[str]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if re.match(r"[A-Za-z][A-Za-z0-9+.-]*://?", path) else (fs.LocalFileSystem(), path)


def _exists(files: fs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != fs.FileType.NotFound


def safe(name: str | None) -> str:
    """A relative name of plain parts."""
    parts = (name or "").split("/")
    if not all(parts) or any(p in (".", "..") for p in parts) or "\\" in name or ":" in name:
        raise ValueError(f"not a file's name inside the folder: {name!r}")
    return name


class PublishedWriter(DataSourceWriter):
    def __init__(self, path: str) -> None:
        self.path = path.rstrip("/")
        self.run = uuid.uuid4().hex
        files, _, stage = self._places()
        files.create_dir(stage)  # on the driver: tasks don't make it, so one that goes on after an abort finds no place to write

    def _places(self) -> tuple[fs.FileSystem, str, str]:
        files, target = _opened(self.path)
        return files, target, posixpath.join(posixpath.dirname(target), f".{posixpath.basename(target)}-{self.run}")

    def write(self, iterator: Iterator[Row]) -> Staged:
        files, _, stage = self._places()
        folder, names = f"{stage}/{uuid.uuid4().hex}", []  # an attempt's own
        made = {stage}
        for row in iterator:
            parts = safe(row.name).split("/")
            for i in range(len(parts)):
                above = "/".join([folder, *parts[:i]])
                if above not in made:
                    files.create_dir(above, recursive=False)
                    made.add(above)
            with files.open_output_stream(f"{folder}/{row.name}") as out:
                out.write(bytes(row.content or b""))
            names.append(row.name)
        return Staged(folder, names)

    def commit(self, messages: list[Staged | None]) -> None:
        files, target, stage = self._places()
        done = [m for m in messages if m]
        try:
            names = [n for m in done for n in m.names]
            if len(set(names)) < len(names):
                raise ValueError("a name is published twice")
            if _exists(files, target):
                raise FileExistsError(target)
            whole = f"{stage}/whole"
            files.create_dir(whole)
            for m in done:
                for n in m.names:
                    files.create_dir(posixpath.dirname(f"{whole}/{n}"))
                    files.move(f"{m.folder}/{n}", f"{whole}/{n}")
            files.move(whole, target)
        finally:
            self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        files, _, stage = self._places()
        if _exists(files, stage):
            files.delete_dir(stage)


class Published(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> PublishedWriter:
        if overwrite:
            raise ValueError("what is published is never overwritten")
        return PublishedWriter(self.options["path"])


def publish_files(rows: DataFrame, path: str) -> None:
    """Publishes rows (name, content) as the folder ``path``; fails, and leaves nothing, if it exists, a name leaves it or stands twice, or a task fails."""
    rows.sparkSession.dataSource.register(Published)
    rows.select("name", "content").write.format(NAME).mode("append").option("path", path).save()
