"""Named files through a data source: written staged by task and committed once, read by folder.

A row is a file: the folder it belongs to, its name and its text; written with extensions it is a
file for each of them. All rows of a folder have to lie in one partition. A task writes into a
staging folder of its own attempt; the commit, which Spark runs once and only after every task has
succeeded, moves the folders of the successful attempts to their places, one rename a folder, and
drops the staging area with whatever retried or speculative attempts left there. A job that fails
drops its staging area alone.

Reading, the driver lists folders only; tasks list and read the files of a few folders each.

Paths are addresses of any file system that Arrow opens: local or mounted, HDFS, object stores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row

STAGING = "_staging"
#: Folders that one task reads, and bytes of text that it hands on at a time.
FOLDERS = 20
BATCH_BYTES = 1 << 23


def opened(address: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path of an address; one without a scheme is local."""
    if "://" in address or address.startswith("file:"):
        return fs.FileSystem.from_uri(address.replace("file:/", "file:///", 1) if address.startswith("file:/") and not address.startswith("file://") else address)
    return fs.LocalFileSystem(), address


@dataclass
class Staged(WriterCommitMessage):
    """What one task attempt wrote: its staging folder and the folders in it."""

    place: str = ""
    folders: list[str] = field(default_factory=list)
    files: int = 0


class FolderWriter(DataSourceWriter):
    def __init__(self, address: str, job: str, extensions: Sequence[str] = ("",)) -> None:
        self.address, self.job, self.extensions = address, job, extensions

    def write(self, rows: Iterator[Row]) -> WriterCommitMessage:
        store, root = opened(self.address)
        context = TaskContext.get()
        out = Staged(f"{root}/{STAGING}/{self.job}/{context.partitionId()}-{context.taskAttemptId()}")
        known: set[str] = set()
        for row in rows:
            if row["folder"] not in known:
                known.add(row["folder"])
                store.create_dir(f"{out.place}/{row['folder']}", recursive=True)
            text = row["text"].encode()
            for extension in self.extensions:
                with store.open_output_stream(f"{out.place}/{row['folder']}/{row['name']}{extension}") as file:
                    file.write(text)
                out.files += 1
        out.folders = sorted(known)
        return out

    def _drop_staging(self, store: fs.FileSystem, root: str) -> None:
        for place in (f"{root}/{STAGING}/{self.job}", f"{root}/{STAGING}"):
            info = store.get_file_info(place)
            if info.type == fs.FileType.Directory and (
                place.endswith(self.job) or not store.get_file_info(fs.FileSelector(place))
            ):
                store.delete_dir(place)

    def commit(self, messages: list[WriterCommitMessage]) -> None:
        store, root = opened(self.address)
        done = [m for m in messages if m is not None]
        moved = [folder for m in done for folder in m.folders]
        if len(moved) != len(set(moved)):
            raise ValueError("a folder's files lie in more than one partition")
        for message in done:
            for folder in message.folders:
                target = f"{root}/{folder}"
                if store.get_file_info(target).type != fs.FileType.NotFound:
                    store.delete_dir(target)
                store.move(f"{message.place}/{folder}", target)
        self._drop_staging(store, root)

    def abort(self, messages: list[WriterCommitMessage]) -> None:
        self._drop_staging(*opened(self.address))


class FolderReader(DataSourceReader):
    def __init__(self, address: str, folders: str) -> None:
        self.address, self.folders = address, folders

    def partitions(self) -> list[InputPartition]:
        store, root = opened(self.address)
        found = sorted(
            info.base_name for info in store.get_file_info(fs.FileSelector(root))
            if info.type == fs.FileType.Directory and fnmatchcase(info.base_name, self.folders)
        )
        if not found:
            raise FileNotFoundError(f"no folder {self.folders} in {self.address}")
        return [InputPartition(found[i : i + FOLDERS]) for i in range(0, len(found), FOLDERS)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, root = opened(self.address)
        for folder in partition.value:
            names, texts, size = [], [], 0
            for info in store.get_file_info(fs.FileSelector(f"{root}/{folder}")):
                # As Spark's own readers do: hidden and empty files are none.
                if info.type != fs.FileType.File or info.base_name[0] in "._" or not info.size:
                    continue
                with store.open_input_stream(info.path) as file:
                    texts.append(file.read())
                names.append(info.base_name)
                size += len(texts[-1])
                if size >= BATCH_BYTES:
                    yield _batch(folder, names, texts)
                    names, texts, size = [], [], 0
            if names:
                yield _batch(folder, names, texts)


def _batch(folder: str, names: list[str], texts: list[bytes]) -> pa.RecordBatch:
    # A view: bytes are handed on as they are, like those of a text file.
    text = pa.array(texts, pa.binary()).view(pa.string())
    return pa.RecordBatch.from_arrays([pa.array([folder] * len(names)), pa.array(names), text], ["folder", "name", "text"])


class FolderSource(DataSource):
    """``df.write.format("named_files").mode("append").save(address)`` and
    ``spark.read.format("named_files").load(address)``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "folder string, name string, text string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        extensions = self.options.get("extensions", "").split(",")
        return FolderWriter(self.options["path"].rstrip("/"), self.options["job"], extensions)

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(self.options["path"].rstrip("/"), self.options.get("folders", "*"))


def read_files(spark: SparkSession, address: str, folders: str = "*") -> DataFrame:
    """(folder, name, text) of every file in the folders under ``address`` whose names match
    ``folders``; none of them is an error."""
    spark.dataSource.register(FolderSource)
    return spark.read.format("named_files").option("folders", folders).load(address)


def write_files(rows: DataFrame, address: str, extensions: Sequence[str] = ("",)) -> None:
    """Write ``rows`` (folder, name, text) as files under ``address``, one for each of
    ``extensions``. A folder that is there already is replaced; others stay."""
    spark = rows.sparkSession
    spark.dataSource.register(FolderSource)
    dealt = rows.select("folder", "name", "text").repartition("folder").sortWithinPartitions("folder", "name")
    writer = dealt.write.format("named_files").mode("append").option("job", uuid.uuid4().hex)
    writer.option("extensions", ",".join(extensions)).save(address)
