"""A sink of notes: one Markdown file for each row, in place as a whole or not at all.

Tasks write into a staging folder of their own, which Spark's readers do not see. When all are done
the driver writes a mark beside the staged files, and from then on the batch counts: the files are
moved to their places, and where that breaks off, `recover` moves the rest. A task that fails, or runs
twice, leaves nothing that is moved.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections import defaultdict
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING, MARK, LIST = ".staging", "_committed", "_list"
#: Files that the driver moves at a time.
MOVERS = 16


@dataclass
class Staged(WriterCommitMessage):
    """The folder of a task; what is in it stands in its list, so the driver gets a name a task."""

    folder: str


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("/") else fs.FileSystem.from_uri("file://" + root.removeprefix("file:"))


def _read(files: fs.FileSystem, path: str) -> bytes | None:
    if files.get_file_info(path).type != fs.FileType.File:
        return None
    with files.open_input_stream(path) as f:
        return f.read()


def _write(files: fs.FileSystem, path: str, data: bytes) -> None:
    with files.open_output_stream(path) as f:
        f.write(data)


class NoteWriter(DataSourceWriter):
    def __init__(self, root: str, columns: list[str], replace: bool):
        self.root, self.replace, self.job = root, replace, uuid.uuid4().hex
        self.path, self.note = columns.index("path"), columns.index("note")

    def write(self, rows: Iterator) -> Staged:
        """Stages the rows of a task; a note that stands there already with the same bytes is only listed."""
        files, root = _opened(self.root)
        folder = posixpath.join(root, STAGING, self.job, uuid.uuid4().hex)
        files.create_dir(folder)
        with files.open_output_stream(posixpath.join(folder, LIST)) as listed:
            for k, row in enumerate(rows):
                path, data = row[self.path], row[self.note].encode()
                if posixpath.isabs(path) or ".." in path.split("/"):
                    raise ValueError(f"not a path below the folder: {path}")
                staged = None
                if _read(files, posixpath.join(root, path)) != data:
                    staged = str(k)
                    _write(files, posixpath.join(folder, staged), data)
                listed.write((json.dumps([staged, path]) + "\n").encode())
        return Staged(folder)

    def commit(self, messages: list[Staged | None]) -> None:
        files, root = _opened(self.root)
        job = posixpath.join(root, STAGING, self.job)
        mark = {"folders": [m.folder for m in messages if m is not None], "replace": self.replace}
        files.create_dir(job)
        _write(files, posixpath.join(job, MARK + ".new"), json.dumps(mark).encode())
        files.move(posixpath.join(job, MARK + ".new"), posixpath.join(job, MARK))
        roll_forward(files, root, self.job)

    def abort(self, messages: list[Staged | None]) -> None:
        files, root = _opened(self.root)
        job = posixpath.join(root, STAGING, self.job)
        if files.get_file_info(job).type == fs.FileType.Directory:
            files.delete_dir(job)


def roll_forward(files: fs.FileSystem, root: str, job: str) -> None:
    """Moves what a committed job has staged, task by task; what an earlier try has moved is no longer staged."""
    at = posixpath.join(root, STAGING, job)
    mark = json.loads(_read(files, posixpath.join(at, MARK)))
    kept: dict[str, set[str]] = defaultdict(set)

    def placed(folder: str, staged: str | None, path: str) -> None:
        source, target = posixpath.join(folder, staged or "."), posixpath.join(root, path)
        if staged is not None and files.get_file_info(source).type == fs.FileType.File:
            files.move(source, target)

    with ThreadPoolExecutor(MOVERS) as movers:
        for folder in mark["folders"]:
            rows = [json.loads(line) for line in (_read(files, posixpath.join(folder, LIST)) or b"").splitlines()]
            parents = {posixpath.dirname(path) for _, path in rows}
            for parent in parents:
                files.create_dir(posixpath.join(root, parent))
            list(movers.map(lambda row: placed(folder, *row), rows))  # noqa: B023
            if mark["replace"]:
                for _, path in rows:
                    kept[posixpath.dirname(path)].add(posixpath.basename(path))
    for parent, names in kept.items():
        for old in files.get_file_info(fs.FileSelector(posixpath.join(root, parent))):
            if old.type == fs.FileType.File and old.extension == "md" and old.base_name not in names:
                files.delete_file(old.path)
    files.delete_dir(at)


class NoteSink(DataSource):
    """Format "notes": columns path (below the folder that is saved to) and note.

    Mode append adds notes, and replaces those of the same path. Mode overwrite leaves in each folder
    that has a note of the batch only these, and other folders as they are. A batch that is written
    again changes nothing. Of rows that share a path one is kept; a null path or note fails the batch.
    """

    @classmethod
    def name(cls) -> str:
        return "notes"

    def writer(self, schema, overwrite: bool) -> NoteWriter:
        return NoteWriter(self.options["path"], schema.fieldNames(), overwrite)


def recover(root: str, abandoned: bool = False) -> int:
    """Moves what committed batches have not moved yet, and says how many there were; drops other staged files if nothing runs."""
    files, at = _opened(root)
    found = 0
    for job in files.get_file_info(fs.FileSelector(posixpath.join(at, STAGING), allow_not_found=True)):
        if files.get_file_info(posixpath.join(job.path, MARK)).type == fs.FileType.File:
            roll_forward(files, at, job.base_name)
            found += 1
        elif abandoned:
            files.delete_dir(job.path)
    return found


def write_notes(rows: DataFrame, root: str, replace: bool = False) -> None:
    """Writes rows (final_path, note) below root; earlier batches stay."""
    rows.sparkSession.dataSource.register(NoteSink)
    out = rows.selectExpr("final_path as path", "note").write.format("notes").mode("overwrite" if replace else "append")
    out.save(root)


def read_notes(spark: SparkSession, root: str) -> DataFrame:
    """path (below root) and note of all notes below root; a file without a byte gives no row."""
    base = root if "://" in root else "file:" + root
    rows = spark.read.text(base, wholetext=True, pathGlobFilter="*.md", recursiveFileLookup=True)
    return rows.selectExpr("url_decode(replace(substring_index(_metadata.file_path, '/" + posixpath.basename(root) + "/', -1), '+', '%2B')) as path", "value as note")
