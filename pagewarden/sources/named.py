"""A data source that writes each row as a file of its own name, which Spark's file sinks can't.

Names may hold any characters: what a file name can't hold is percent-encoded. A file is written beside its
place and then moved, so a task that is run again leaves the same files, and readers see whole ones only.
Folders are any that pyarrow's file systems reach from the executors (local or shared paths, hdfs, s3, gs).
They are read by Spark's own file sources, as tables and as streams.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage


ROUND = 100_000  # files of through_files that are there at once
TURN, TURN_CHARS = 1_000, 1 << 25  # files of a task of through_own_files that are there at once, and their characters but for the last file's


def file_name(name: str) -> str:
    """A first dot or underscore is encoded too: readers take such files for hidden ones."""
    plain = quote(name, safe="")
    return f"%{ord(plain[0]):02X}{plain[1:]}" if plain[0] in "._" else plain


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, overwrite: bool):
        self.path, self.suffix = path.rstrip("/"), suffix
        files, folder = open_folder(self.path)
        if overwrite and files.get_file_info(folder).type == pafs.FileType.Directory:
            files.delete_dir_contents(folder)
        files.create_dir(folder, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, folder = open_folder(self.path)
        task = TaskContext.get()
        mark = f"{task.partitionId()}-{task.taskAttemptId()}"
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                place = f"{folder}/{file_name(name)}{self.suffix}"
                with files.open_output_stream(f"{folder}/_{mark}.part") as out:
                    out.write(content if isinstance(content, bytes) else content.encode())
                files.move(f"{folder}/_{mark}.part", place)
        return WriterCommitMessage()

    def commit(self, messages) -> None:
        files, folder = open_folder(self.path)
        files.open_output_stream(f"{folder}/_SUCCESS").close()

    def abort(self, messages) -> None:
        """Whole files stay; without _SUCCESS the folder counts as unfinished."""


class NamedFiles(DataSource):
    """Format named_files: rows of (name string, content string or binary) to folder ``path``, files end in ``suffix``."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options.get("suffix", ""), overwrite)


def write_named(rows: DataFrame, path: str, suffix: str = "") -> None:
    """A file for each row of two columns, name and content; rows without either, or with an empty name, are left out. What the folder held is replaced."""
    rows.sparkSession.dataSource.register(NamedFiles)
    whole = rows.toDF("name", "content").withColumn("name", F.col("name").cast("string"))
    whole.where("name <> '' AND content IS NOT NULL").write.format("named_files").option("suffix", suffix).mode("overwrite").save(path)


def name_of(suffix: str) -> Column:
    """The name under which write_named wrote the file that a row was read from."""
    plain = F.url_decode(F.col("_metadata.file_name"))  # which encodes the file's own name once more
    return F.url_decode(F.substring(plain, F.lit(1), F.length(plain) - len(suffix)))


def read_named(spark: SparkSession, path: str, suffix: str = "", files_per_trigger: int | None = None, stream: bool = False) -> DataFrame:
    """(name, content) of a folder of text files, or of one file; as a stream of arriving files if asked for."""
    reader = spark.readStream if stream else spark.read
    reader = reader.option("pathGlobFilter", f"*{suffix}")
    if stream and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.text(path, wholetext=True).select(name_of(suffix).alias("name"), F.col("value").alias("content"))


def through_files(rows: DataFrame, path: str, suffix: str, read: Callable[[str], DataFrame], most: int = ROUND) -> DataFrame:
    """What ``read`` gives for a folder of the files that write_named makes of rows of (name, content), all of them, in rounds.

    A file takes a block of disk at least, and a listing of millions fills a driver. So some ``most`` files are written, read
    back and deleted before the next ones: every row passes a file of its own, and disk holds a round's files and two tables.
    Rows of one name are in one round; each round reads its own part of the rows only.
    """
    spark = rows.sparkSession
    whole = rows.toDF("name", "content").withColumn("name", F.col("name").cast("string")).where("name <> '' AND content IS NOT NULL")
    whole.write.parquet(f"{path}/rows")
    held = spark.read.schema(whole.schema).parquet(f"{path}/rows")
    rounds = max(1, -(-held.count() // most))
    if rounds > 1:
        held.withColumn("round", F.pmod(F.xxhash64("name"), F.lit(rounds)).cast("int")).write.partitionBy("round").parquet(f"{path}/rounds")
    files, folder = open_folder(path)
    for i in range(rounds):
        part = held
        if rounds > 1:
            at = f"{path}/rounds/round={i}"
            if files.get_file_info(f"{folder}/rounds/round={i}").type != pafs.FileType.Directory:
                continue
            part = spark.read.schema(whole.schema).parquet(at)
        write_named(part.repartition(spark.sparkContext.defaultParallelism), f"{path}/files{i}", suffix)
        back = read(f"{path}/files{i}")
        back.write.mode("append").parquet(f"{path}/back")
        files.delete_dir(f"{folder}/files{i}")
    return spark.read.schema(back.schema).parquet(f"{path}/back")


def _turn(files: pafs.FileSystem, folder: str, suffix: str, rows: list[tuple[str, str]]) -> pa.RecordBatch:
    """Rows written as files to an empty folder, and what a listing finds there; the folder is empty again afterwards."""
    for name, content in rows:
        with files.open_output_stream(f"{folder}/{file_name(name)}{suffix}") as out:
            out.write(content.encode())
    names, contents = [], []
    for file in files.get_file_info(pafs.FileSelector(folder)):
        with files.open_input_stream(file.path) as data:
            names.append(unquote(file.base_name[: len(file.base_name) - len(suffix)]))
            contents.append(data.read().decode())
    files.delete_dir_contents(folder)
    return pa.RecordBatch.from_pydict({"name": pa.array(names, pa.string()), "content": pa.array(contents, pa.string())})


def _turns(batches: Iterator[pa.RecordBatch], path: str, suffix: str, most: int) -> Iterator[pa.RecordBatch]:
    """A task's turns, in one folder of its own: a folder for each turn would take file systems several times as long."""
    files, top = open_folder(path)
    folder = f"{top}/{uuid.uuid4().hex}"
    files.create_dir(folder, recursive=True)
    held, size = [], 0
    try:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((name, content))
                size += len(content)
                if len(held) >= most or size >= TURN_CHARS:
                    yield _turn(files, folder, suffix, held)
                    held, size = [], 0
        if held:
            yield _turn(files, folder, suffix, held)
    finally:
        files.delete_dir(folder)


def through_own_files(rows: DataFrame, path: str, suffix: str, most: int = TURN) -> DataFrame:
    """(name, content) of the files that are made of rows of (name, content), all of them; names differ.

    through_files lists a folder by the driver for each round, and Spark's readers take milliseconds a file. Here each task has
    a folder of its own under ``path``: it writes ``most`` files, lists the folder, reads what lies there, deletes it and goes on.
    So all tasks write, read and delete at once, and disk holds ``most`` files a task at any number of rows.
    """
    whole = rows.toDF("name", "content").withColumns({c: F.col(c).cast("string") for c in ("name", "content")}).where("name <> '' AND content IS NOT NULL")
    # The rows' own partitions may be few, as rows are small for the time that their files take.
    dealt = whole.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "name")
    return dealt.mapInArrow(partial(_turns, path=path, suffix=suffix, most=most), "name string, content string")
