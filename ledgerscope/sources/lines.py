"""A streaming source over text files that other programs append to.

Spark's own file source takes a file once, as it is when first seen. Here an offset holds, for every file, the number of
bytes read so far; a micro-batch is the bytes that have been added since, up to the last line end, so a line that is still
being written waits. Offsets are in the stream's checkpoint: a restarted query goes on behind the last committed line.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes of one task's part of a file, and of one read while a line end is sought.
PART_BYTES, STEP_BYTES = 64 << 20, 64 << 10


class FilePart(InputPartition):
    """Lines that begin in [start, end) of a file; ``first``: the offset that a line is known to begin at."""

    def __init__(self, path: str, first: int, start: int, end: int, limit: int):
        self.path, self.first, self.start, self.end, self.limit = path, first, start, end, limit


class AppendedLinesReader(DataSourceStreamReader):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def _files(self):
        from pyarrow import fs
        system, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, root

    def _line_end(self, system, path: str, size: int) -> int:
        """The offset behind the last line end within ``size`` bytes; 0 if there is none."""
        with system.open_input_file(path) as f:
            end = size
            while end > 0:
                start = max(0, end - STEP_BYTES)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
        return 0

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        from pyarrow import fs
        system, root = self._files()
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return {}
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root))
        ends = {}
        for f in found:
            name = posixpath.basename(f.path)
            if f.type == fs.FileType.File and name.endswith(self.suffix) and not name.startswith(("_", ".")):
                ends[f.path] = self._line_end(system, f.path, f.size)
        return {p: n for p, n in sorted(ends.items()) if n}

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        parts = []
        for path, to in end.items():
            begin = start.get(path, 0)
            if to < begin:
                raise ValueError(f"{path} was cut from {begin} to {to} bytes; a log may only grow")
            parts += [FilePart(path, begin, a, min(a + PART_BYTES, to), to) for a in range(begin, to, PART_BYTES)]
        return parts

    def read(self, partition: FilePart) -> Iterator[tuple]:
        system, _ = self._files()
        with system.open_input_file(partition.path) as f:
            at = partition.start
            if at > partition.first:  # the line that holds the byte before belongs to the part before
                f.seek(at - 1)
                at = at - 1 + len(self._rest_of_line(f, partition.limit - at + 1))
            f.seek(at)
            held = b""
            while at < partition.end:
                chunk = f.read(min(STEP_BYTES, partition.limit - at - len(held)))
                if not chunk:
                    break
                held += chunk
                *lines, held = held.split(b"\n")
                for line in lines:
                    if at >= partition.end:
                        return
                    yield (line.removesuffix(b"\r").decode("utf-8", "replace"), posixpath.basename(partition.path), at)
                    at += len(line) + 1

    @staticmethod
    def _rest_of_line(f, most: int) -> bytes:
        out = b""
        while len(out) < most:
            chunk = f.read(min(STEP_BYTES, most - len(out)))
            at = chunk.find(b"\n")
            if at >= 0:
                return out + chunk[:at + 1]
            if not chunk:
                break
            out += chunk
        return out

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """Format ``appended_lines``: (value, file, position) for every whole line of the files below ``path``.

    Options: ``path`` (a file or a folder, local or any URI that pyarrow opens, reachable by the driver and all executors),
    ``suffix`` (only files that end so). A file that does not exist yet has no lines.
    """

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("value", T.StringType()), T.StructField("file", T.StringType()), T.StructField("position", T.LongType())])

    def streamReader(self, schema: T.StructType) -> AppendedLinesReader:
        return AppendedLinesReader(self.options["path"], self.options.get("suffix", ""))


def appended_lines(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """The stream of whole lines that are, or will be, in the files below ``path``."""
    spark.dataSource.register(AppendedLines)
    return spark.readStream.format("appended_lines").option("suffix", suffix).load(path)


def appended_json(spark: SparkSession, path: str, schema: T.StructType, suffix: str = "") -> DataFrame:
    """The stream of the JSON lines as columns; blank lines are skipped, malformed ones are all null."""
    lines = appended_lines(spark, path, suffix).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("j")).select("j.*")
