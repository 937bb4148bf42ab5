"""Lines of log files with the place of each, read from the end: only the last blocks are opened.

Files follow each other by path, and the bytes of all make one row of blocks; a block has the lines
that begin in it, so every line has one place, whatever the sizes.
"""

from __future__ import annotations

import io
import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a block, and blocks that are read first.
BLOCK, BLOCKS = 1 << 20, 4
PATTERN = "WARNING|ERROR"


@dataclass
class Block(InputPartition):
    path: str
    start: int
    end: int


def log_files(root: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files at or below root, by path; hidden ones, and those with a leading underscore, are none."""
    files, at = fs.FileSystem.from_uri(root)
    info = files.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(at, info.size)]
    found = files.get_file_info(fs.FileSelector(at, recursive=True))
    shown = [f for f in found if f.type == fs.FileType.File and not any(p[:1] in "._" for p in posixpath.relpath(f.path, at).split("/"))]
    return sorted((f.path, f.size) for f in shown)


class LogReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.block, self.last = options["path"], int(options["block"]), int(options["last"])
        self.files = json.loads(options["files"])

    def partitions(self) -> list[Block]:
        """The blocks of the last `last` bytes."""
        out, left = [], self.last
        for path, size in reversed(self.files):
            end = size
            while end > 0 and left > 0:
                start = max(0, end - self.block)
                out.append(Block(path, start, end))
                left -= end - start
                end = start
        return out

    def read(self, block: Block) -> Iterator[tuple]:
        files, _ = fs.FileSystem.from_uri(self.root)
        with io.BufferedReader(files.open_input_file(block.path)) as f:
            at = max(0, block.start - 1)
            f.seek(at)
            if block.start:  # a line that begins before the block is another's
                at += len(f.readline())
            while at < block.end and (line := f.readline()):
                yield block.path, at, line.rstrip(b"\r\n").decode("utf-8", "replace")
                at += len(line)


class LogLines(DataSource):
    """Format "log_lines": file, at (the byte at which a line begins) and value."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return "file string, at long, value string"

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)


def log_tail(spark: SparkSession, root: str, n: int = 50, pattern: str = PATTERN, block: int = BLOCK) -> DataFrame:
    """file, at, value of the last n lines that match, in order of file and place.

    The last blocks are read, then four times as many, until they hold n lines or are all. Other bytes
    than UTF-8 are replaced; an empty folder has no lines.
    """
    spark.dataSource.register(LogLines)
    files = log_files(root)
    whole, last = sum(size for _, size in files), BLOCKS * block
    while True:
        lines = spark.read.format("log_lines").options(path=root, block=block, last=min(last, max(whole, 1)), files=json.dumps(files)).load()
        found = lines.where(F.col("value").rlike(pattern)).orderBy(F.desc("file"), F.desc("at")).limit(n)
        if last >= whole or found.count() >= n:
            return found.orderBy("file", "at")
        last *= 4
