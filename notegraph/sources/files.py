"""A sink that writes one file for each row, as a batch data source: format "text_files"."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

DONE = "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    files: int


class TextFiles(DataSource):
    """Rows (file, text) as files under option path, any store that Arrow reaches. Modes append and overwrite both replace files of the same name and leave others."""

    @classmethod
    def name(cls) -> str:
        return "text_files"

    def schema(self) -> str:
        return "file string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return TextFilesWriter(self.options["path"])


class TextFilesWriter(DataSourceWriter):
    """A file is written under another name and then moved, so it is there whole or not at all, and a task that is run again, or twice at once, ends with the same files. The mark DONE, with their number, comes last, once all tasks are through."""

    def __init__(self, path: str):
        self.path = path

    def _open(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def _put(self, store: fs.FileSystem, root: str, name: str, text: str) -> None:
        held = f"{root}/.{uuid.uuid4().hex}"
        with store.open_output_stream(held) as out:
            out.write(text.encode())
        store.move(held, f"{root}/{name}")

    def write(self, iterator: Iterator[Row]) -> Written:
        store, root = self._open()
        store.create_dir(root, recursive=True)
        n = 0
        for row in iterator:
            if not row["file"] or "/" in row["file"] or row["file"].startswith("."):
                raise ValueError(f"no file may be named {row['file']!r}")
            self._put(store, root, row["file"], row["text"] or "")
            n += 1
        return Written(n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = self._open()
        store.create_dir(root, recursive=True)
        self._put(store, root, DONE, str(sum(m.files for m in messages if m is not None)))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files of tasks that ended stay, whole as they are, without the mark; the next export replaces them."""
