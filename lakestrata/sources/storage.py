"""File-system calls on whole files and partition folders, through Hadoop so that any store works."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import date
from urllib.parse import unquote

from pyspark.sql import SparkSession

# Fixed value: the folder Spark writes rows to whose partition column is NULL.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"

LISTING_THREADS = 32


class Files:
    def __init__(self, spark: SparkSession):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._codecs = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory
        self._reader = spark.sparkContext._jvm.java.io.BufferedReader
        self._decoder = spark.sparkContext._jvm.java.io.InputStreamReader

    def _open(self, path: str):
        located = self._path(path)
        return located.getFileSystem(self._conf), located

    def exists(self, path: str) -> bool:
        fs, located = self._open(path)
        return fs.exists(located)

    def qualified(self, path: str) -> str:
        """The path with scheme and working directory filled in, as `glob` returns it."""
        fs, located = self._open(path)
        return str(fs.makeQualified(located))

    def glob(self, pattern: str) -> list[str]:
        """Paths matching the pattern, as given by the store; none if nothing matches."""
        fs, located = self._open(pattern)
        return [str(status.getPath()) for status in fs.globStatus(located) or []]

    def glob_all(self, patterns: Iterable[str]) -> list[str]:
        """Paths matching any of many patterns; the listings overlap, as each one mostly waits."""
        return [path for found in self._each(self.glob, patterns) for path in found]

    def folders(self, path: str) -> list[str]:
        """The folders right below a path; none if it does not exist."""
        fs, located = self._open(path)
        if not fs.exists(located):
            return []
        return sorted(str(status.getPath()) for status in fs.listStatus(located) if status.isDirectory())

    def data_files(self, path: str) -> dict[str, int]:
        """Names and lengths of the files right in a folder, without hidden ones; none if it does not exist."""
        fs, located = self._open(path)
        if not fs.exists(located):
            return {}
        found = {status.getPath().getName(): status.getLen() for status in fs.listStatus(located) if not status.isDirectory()}
        return {name: length for name, length in found.items() if name[0] not in "._"}

    def first_line(self, path: str) -> str | None:
        """The first line of a text file that is not blank, or None; no more than a buffer is read beyond it."""
        fs, located = self._open(path)
        stream = fs.open(located)
        try:
            codec = self._codecs(self._conf).getCodec(located)
            lines = self._reader(self._decoder(codec.createInputStream(stream) if codec else stream, "UTF-8"))
            while (line := lines.readLine()) is not None:
                if any(char > " " for char in line):
                    return line
            return None
        finally:
            stream.close()

    def first_lines(self, paths: Iterable[str]) -> list[str | None]:
        """`first_line` of many files; the calls overlap."""
        return list(self._each(self.first_line, paths))

    def all_data_files(self, paths: Sequence[str]) -> list[dict[str, int]]:
        return self._each(self.data_files, paths)

    def make_folders(self, paths: Iterable[str]) -> None:
        def make(path: str) -> None:
            fs, located = self._open(path)
            fs.mkdirs(located)

        self._each(make, paths)

    def delete_all(self, paths: Iterable[str]) -> None:
        self._each(self.delete, paths)

    def delete_empty(self, path: str) -> None:
        """Delete a folder if nothing but hidden files is in it."""
        fs, located = self._open(path)
        if fs.exists(located) and all(status.getPath().getName()[0] in "._" for status in fs.listStatus(located)):
            fs.delete(located, True)

    def _each(self, call: Callable, paths: Iterable[str]) -> list:
        """Calls to the store overlap, as each one mostly waits."""
        with ThreadPoolExecutor(LISTING_THREADS) as pool:
            return list(pool.map(call, paths))

    def delete(self, path: str) -> None:
        fs, located = self._open(path)
        fs.delete(located, True)


def partition_value(path: str, column: str) -> str:
    """The value of `column` in a path such as `.../order_date=2025-05-05/...`, the innermost if there are several."""
    for part in reversed(path.split("/")):
        name, equals, value = part.partition("=")
        if equals and name == column:
            return unquote(value)
    raise ValueError(f"no partition {column} in {path}")


def day_value(path: str, column: str) -> date | None:
    """The date that a day partition stands for, None for that of rows without one."""
    value = partition_value(path, column)
    return None if value == NULL_PARTITION else date.fromisoformat(value)


def day_name(day: date | None) -> str:
    """The folder value of a day partition."""
    return NULL_PARTITION if day is None else day.isoformat()


def in_order(days: Iterable[date | None]) -> list[date | None]:
    """Days by date, the one that stands for rows without a date last."""
    return sorted(days, key=lambda day: (day is None, day))
