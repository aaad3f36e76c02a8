"""Workbooks as files: `df.write.format("workbooks").save(folder)` makes a file of each row (name, content), all of them or none.

Tasks write to a folder of the run beside the others; only when all are done does the driver move the files to their names. A file that
is there already, of an earlier run or open in a program that locks it, is never touched: the new one gets the time of day, and if need be
a number, at the end of its name. What tasks or runs that failed have written is deleted.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from gridloom.sources.pagefiles import opened


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # name, and where it stands until the run is done


def free_name(at: fs.FileSystem, folder: str, name: str, suffix: str, clock: str) -> str:
    """The path of a file that isn't there yet: with the name alone, with the time after it, with a number after that."""
    tried = [name, f"{name}_{clock}"]
    while True:
        path = f"{folder}/{tried.pop(0)}{suffix}"
        if at.get_file_info(path).type == fs.FileType.NotFound:
            return path
        tried = tried or [f"{name}_{clock}_{uuid.uuid4().hex[:6]}"]


class WorkbookWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.folder, self.suffix = options["path"], options.get("suffix", ".xlsx")
        self.run = uuid.uuid4().hex

    @property
    def staging(self) -> tuple[fs.FileSystem, str, str]:
        at, folder = opened(self.folder)
        return at, folder.rstrip("/"), f"{folder.rstrip('/')}/_staging/{self.run}"

    def write(self, iterator: Iterator[Row]) -> Written:
        at, _, staging = self.staging
        at.create_dir(staging, recursive=True)
        files: list[tuple[str, str]] = []
        try:
            for row in iterator:
                name = re.sub(r"[\\/:*?\"<>|\x00-\x1f]", "_", row["name"] or "") or "_"
                files.append((name, f"{staging}/{uuid.uuid4().hex}"))
                with at.open_output_stream(files[-1][1]) as out:
                    out.write(bytes(row["content"] or b""))
        except BaseException:
            for _, path in files:
                if at.get_file_info(path).type != fs.FileType.NotFound:
                    at.delete_file(path)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        at, folder, staging = self.staging
        clock = time.strftime("%H%M%S")
        for name, path in sorted(f for m in messages if m for f in m.files):
            at.move(path, free_name(at, folder, name, self.suffix, clock))
        self._clear(at, folder, staging)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self.staging)

    @staticmethod
    def _clear(at: fs.FileSystem, folder: str, staging: str) -> None:
        if at.get_file_info(staging).type != fs.FileType.NotFound:
            at.delete_dir(staging)
        above = f"{folder}/_staging"
        if at.get_file_info(above).type != fs.FileType.NotFound and not at.get_file_info(fs.FileSelector(above)):
            at.delete_dir(above)


class Workbooks(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbooks"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options)


def write(books: DataFrame, folder: str, suffix: str = ".xlsx") -> None:
    """Each row (name, content) as a file of its own."""
    books.sparkSession.dataSource.register(Workbooks)
    books.select("name", "content").write.format("workbooks").option("suffix", suffix).mode("append").save(folder)
