"""A Spark data source that writes text files under names that the rows give.

Each task streams its rows to hidden files and names them to the driver; the commit moves them to their names, so a
reader never meets half a file, and a task that is repeated after a lost executor leaves nothing behind.
"""

from __future__ import annotations

import posixpath
import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

FORMAT = "langmill_named_files"
HIDDEN = "_pending-"


@dataclass
class Written(WriterCommitMessage):
    """(name, source, block, hidden file) of each file that a task wrote."""

    files: list[tuple[str, str, int, str]]


class NamedFiles(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def writer(self, schema, overwrite):
        return NamedFilesWriter(self.options["path"], overwrite, uuid.uuid4().hex)


class NamedFilesWriter(DataSourceArrowWriter):
    """Rows (name, source, block, value); a line of file ``name`` each.

    ``source`` and ``block`` tell where the line comes from. Lines of one block should come one after the other, as a scan gives
    them. A name with lines from several blocks becomes ``name.part-00000`` and so on in the order of blocks, so that a
    huge input is written by many tasks.
    """

    def __init__(self, path: str, overwrite: bool, job: str):
        self.path, self.overwrite, self.job = path, overwrite, job

    def _store(self):
        if "://" in self.path or self.path.startswith("file:"):
            uri = self.path if "://" in self.path else "file://" + self.path[len("file:"):]
            return fs.FileSystem.from_uri(uri)
        return fs.LocalFileSystem(), self.path

    def write(self, iterator):
        store, folder = self._store()
        hidden = posixpath.join(folder, HIDDEN + self.job)
        store.create_dir(hidden, recursive=True)
        files, place, out = [], None, None
        try:
            for batch in iterator:
                names, sources, blocks, values = (batch.column(c).to_pylist() for c in ("name", "source", "block", "value"))
                begin = 0
                for i in range(1, len(names) + 1):
                    if i < len(names) and (names[i], sources[i], blocks[i]) == (names[begin], sources[begin], blocks[begin]):
                        continue
                    if place != (here := (names[begin], sources[begin], blocks[begin])):
                        if out:
                            out.close()
                        place, target = here, posixpath.join(hidden, uuid.uuid4().hex)
                        out = store.open_output_stream(target)
                        files.append((*here, target))
                    out.write("".join(f"{value}\n" for value in values[begin:i]).encode())
                    begin = i
        finally:
            if out:
                out.close()
        return Written(files)

    def commit(self, messages):
        store, folder = self._store()
        found: dict[str, list] = {}
        for message in messages:
            for name, source, block, target in message.files if message else ():
                found.setdefault(name, []).append((source, block, target))
        for name, parts in found.items():
            sources = {source for source, _, _ in parts}
            if not name or "/" in name or name.startswith(("_", ".")) or len(sources) > 1:
                self.abort(messages)
                raise ValueError(f"no name for one output file: {name!r} of {sorted(sources)[:3]}")
        if self.overwrite:
            for old in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if old.type == fs.FileType.File:
                    store.delete_file(old.path)
        for name, parts in found.items():
            # Blocks that come in several runs keep the order in which their task met them.
            for i, (_, _, target) in enumerate(sorted(parts, key=lambda part: part[1])):
                store.move(target, posixpath.join(folder, name if len(parts) == 1 else f"{name}.part-{i:05}"))
        self._clear(store, folder)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(posixpath.join(folder, "_SUCCESS")):
            pass

    def abort(self, messages):
        self._clear(*self._store())

    def _clear(self, store, folder):
        hidden = posixpath.join(folder, HIDDEN + self.job)
        if store.get_file_info(hidden).type == fs.FileType.Directory:
            store.delete_dir(hidden)


def write_named(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write (name, source, block, value) as files of their names below ``path``; rows are not shuffled."""
    lines.sparkSession.dataSource.register(NamedFiles)
    rows = lines.select(F.col("name").cast("string"), F.col("source").cast("string"), F.col("block").cast("long"), F.col("value").cast("string"))
    rows.write.format(FORMAT).mode(mode).save(path)
