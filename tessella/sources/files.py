"""Files by path or URI, and the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def filesystem(path: str):
    """pyarrow's file system and the path in it; plain paths are local ones."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def size_of(path: str) -> int:
    files, at = filesystem(path)
    info = files.get_file_info(at)
    if info.size is None:
        raise FileNotFoundError(path)
    return info.size


def shared_folder(spark: SparkSession, given: str | None = None) -> str:
    """A new folder for intermediate data: in ``given``, else in spark.checkpoint.dir. Where
    neither is set, a temporary one if all run on this machine; an error on a cluster."""
    root = given or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("give a cache folder, or set spark.checkpoint.dir, that driver and executors share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tessella-{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def spread(df: DataFrame, rows: int, *columns: str, most: int = 20_000) -> DataFrame:
    """df dealt by the columns in tasks of about so many rows. Their number is fixed, as
    adaptive execution would join tasks of few bytes, however much work their rows are."""
    n = max(1, min(most, -(-df.count() // rows)))
    return df.repartition(n, *columns)


class Ranges:
    """A file that many tasks write, each its byte ranges, under a temporary name until ``commit``.

    Where files are local or mounted, a range is written at its place in one file. Other file
    systems (object stores, HDFS) cannot do that: there a range is a file of its own, called by
    its place, and the commit puts them together in order. A repeated task writes the same
    bytes again."""

    def __init__(self, output: str, mark: str):
        self.files, self.place = filesystem(output)
        self.mounted = isinstance(self.files, fs.LocalFileSystem)
        self.temporary = f"{self.place}.{mark}.part"

    @contextmanager
    def at(self, begin: int):
        """An open range, of which only ``write`` is used."""
        if self.mounted:
            out = Positioned(os.open(self.temporary, os.O_WRONLY | os.O_CREAT, 0o666), begin)
            try:
                yield out
            finally:
                os.close(out.number)
            return
        own = f"{self.temporary}-{uuid.uuid4().hex}"
        self.files.create_dir(self.temporary, recursive=True)
        with self.files.open_output_stream(own, compression=None) as out:
            yield out
        self.files.move(own, f"{self.temporary}/{begin:020d}")

    def commit(self, size: int) -> None:
        """Gives the file its name; replaces one that is there. A repeated commit does nothing."""
        if self.files.get_file_info(self.temporary).type.value == 0 and self.files.get_file_info(self.place).size == size:
            return
        if self.mounted:
            os.replace(self.temporary, self.place)
            return
        parts = sorted(i.path for i in self.files.get_file_info(fs.FileSelector(self.temporary)))
        with self.files.open_output_stream(f"{self.temporary}-whole", compression=None) as out:
            for part in parts:
                with self.files.open_input_stream(part, compression=None) as source:
                    while chunk := source.read(8 << 20):
                        out.write(chunk)
        self.files.move(f"{self.temporary}-whole", self.place)
        self.files.delete_dir(self.temporary)

    def drop(self) -> None:
        info = self.files.get_file_info(self.temporary)
        if info.is_file:
            self.files.delete_file(self.temporary)
        elif info.type.value:
            self.files.delete_dir(self.temporary)


class Positioned:
    """A file that writes on from a place of its own."""

    def __init__(self, number: int, at: int):
        self.number, self.place = number, at

    def write(self, data: bytes) -> None:
        view = memoryview(data)
        while len(view):
            n = os.pwrite(self.number, view, self.place)
            view, self.place = view[n:], self.place + n
