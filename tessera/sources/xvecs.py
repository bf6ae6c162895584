"""Binary vector files: repeated ``int32 dim`` + ``dim`` numbers, float32 or int32.

A Python data source reads record ranges in parallel and writes one file per partition. Paths may
be plain (a mounted folder) or URIs pyarrow understands.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

from tessera.session import shared_dir

# fixed values: number type per file kind
KINDS = {"fvecs": ("<f4", pa.float32(), "float"), "ivecs": ("<i4", pa.int32(), "int")}
RECORDS_PER_BATCH = 8192
BYTES_PER_PARTITION = 64 << 20


def qualified(spark: SparkSession, path: str) -> str:
    """The path as a URI on the file system that Spark itself would use; mount points are resolved.

    A path without a scheme on the local file system of a cluster is an error: tasks would write to
    their own disks. ``file:`` paths and the folder of ``spark.checkpoint.dir`` are taken at their word, as
    mounts that all machines share.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(conf)
    uri = system.makeQualified(p).toUri()
    if uri.getScheme() == "viewfs":
        names = []  # of folders yet to be written
        while not system.exists(p):
            names.append(p.getName())
            p = p.getParent()
        p = system.resolvePath(p)
        for name in reversed(names):
            p = jvm.org.apache.hadoop.fs.Path(p, name)
        uri = p.toUri()
    elif uri.getScheme() == "file" and ":" not in path.split("/")[0]:
        if not spark.sparkContext.master.startswith("local") and not _in_shared_dir(spark, path):
            raise ValueError(f"{path} is local to each machine")
    return "file://" + uri.getPath() if uri.getScheme() == "file" else uri.toString()


def _in_shared_dir(spark: SparkSession, path: str) -> bool:
    """Whether a plain path lies in the folder named by ``spark.checkpoint.dir``, which all machines share."""
    shared = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    return os.path.normpath(path).startswith(os.path.normpath(shared) + os.sep)


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def list_files(path: str, kind: str) -> list[tuple[str, int]]:
    """(file, bytes) of one file or of all files of the kind in a folder, by name."""
    system, p = open_fs(path)
    info = system.get_file_info(p)
    if info.type == fs.FileType.Directory:
        found = system.get_file_info(fs.FileSelector(p))
        return sorted((f.path, f.size) for f in found if f.path.endswith("." + kind))
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return [(p, info.size)]


@dataclass
class RecordRange(InputPartition):
    file: str
    dim: int
    first: int
    count: int
    row: int


class XvecsReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"]
        self.step = int(options.get("partitionBytes", BYTES_PER_PARTITION))

    def partitions(self):
        """Record ranges; one file is opened for the dimension, tasks check it in every record."""
        system, _ = open_fs(self.path)
        parts, row, dim = [], 0, 0
        for file, size in list_files(self.path, self.kind):
            if size == 0:
                continue
            if not dim:
                with system.open_input_file(file) as f:
                    dim = int(np.frombuffer(f.read(4), "<i4")[0])
            record = 4 + 4 * dim
            if dim <= 0 or size % record:
                raise ValueError(f"{file}: size {size} does not fit records of {dim} numbers")
            n, per = size // record, max(self.step // record, 1)
            for first in range(0, n, per):
                count = min(per, n - first)
                parts.append(RecordRange(file, dim, first, count, row + first))
            row += n
        return parts or [RecordRange("", 0, 0, 0, 0)]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if not partition.count:
            return
        system, _ = open_fs(self.path)
        number, arrow, _ = KINDS[self.kind]
        record = 4 + 4 * partition.dim
        with system.open_input_file(partition.file) as f:
            f.seek(partition.first * record)
            for done in range(0, partition.count, RECORDS_PER_BATCH):
                n = min(RECORDS_PER_BATCH, partition.count - done)
                raw = np.frombuffer(f.read(n * record), "<i4").reshape(n, 1 + partition.dim)
                if (raw[:, 0] != partition.dim).any():
                    raise ValueError(f"{partition.file}: record with another dimension")
                flat = np.ascontiguousarray(raw[:, 1:]).view(number).ravel()
                offsets = np.arange(0, len(flat) + 1, partition.dim, dtype=np.int32)
                rows = np.arange(n, dtype=np.int64) + partition.row + done
                vec = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=arrow))
                yield pa.RecordBatch.from_arrays([pa.array(rows), vec], ["row", "vec"])


@dataclass
class WrittenFile(WriterCommitMessage):
    temp: str
    final: str


class XvecsWriter(DataSourceArrowWriter):
    """Tasks write hidden files; only the files of a successful job get their final names.

    Names begin with the time the job began, so a later append adds files after the earlier ones.
    """

    def __init__(self, options):
        self.path, self.kind = options["path"], options["kind"]
        self.job = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"

    def write(self, iterator):
        from pyspark import TaskContext

        system, folder = open_fs(self.path)
        system.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        temp = f"{folder}/_part-{part:06d}-{uuid.uuid4().hex}"
        number = KINDS[self.kind][0]
        with system.open_output_stream(temp) as out:
            for batch in iterator:
                col = batch.column(batch.schema.get_field_index("vec"))
                if not len(col):
                    continue
                flat = col.flatten().to_numpy(zero_copy_only=False).astype(number)
                x = flat.reshape(len(col), -1)
                head = np.full((len(x), 1), x.shape[1], dtype="<i4")
                out.write(np.hstack([head, x.view("<i4")]).tobytes())
        return WrittenFile(temp, f"{folder}/part-{self.job}-{part:06d}.{self.kind}")

    def commit(self, messages):
        system, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                system.move(m.temp, m.final)

    def abort(self, messages):
        system, _ = open_fs(self.path)
        for m in messages:
            if m is not None:
                system.delete_file(m.temp)


class XvecsSource(DataSource):
    @classmethod
    def name(cls):
        return "xvecs"

    def schema(self):
        return f"row long, vec array<{KINDS[self.options['kind']][2]}>"

    def reader(self, schema):
        return XvecsReader(self.options)

    def writer(self, schema, overwrite):
        return XvecsWriter(self.options)


def read_xvecs(spark: SparkSession, path: str, kind: str, partition_bytes: int = BYTES_PER_PARTITION) -> DataFrame:
    """``(row, vec)`` of a file or folder; ``row`` counts over all files by name."""
    spark.dataSource.register(XvecsSource)
    return (
        spark.read.format("xvecs").option("path", qualified(spark, path)).option("kind", kind)
        .option("partitionBytes", partition_bytes).load()
    )


def write_xvecs(df: DataFrame, path: str, kind: str, order: str, vec: str = "embedding") -> None:
    """Part files in the order of ``order``, so row numbers read back follow it."""
    df.sparkSession.dataSource.register(XvecsSource)
    numbers = KINDS[kind][2]
    out = df.repartitionByRange(order).sortWithinPartitions(order).select(
        F.lit(0).cast("long").alias("row"), F.col(vec).cast(f"array<{numbers}>").alias("vec")
    )
    out.write.format("xvecs").option("path", qualified(df.sparkSession, path)).option("kind", kind).mode("append").save()


def read_query_set(spark: SparkSession, queries: str, truth: str) -> DataFrame:
    """Queries with their ground-truth id lists: ``(qid, qvec, truth)``, joined on row number."""
    q = read_xvecs(spark, queries, "fvecs").withColumnsRenamed({"row": "qid", "vec": "qvec"})
    t = read_xvecs(spark, truth, "ivecs").withColumnsRenamed({"row": "qid", "vec": "truth"})
    return q.join(t, "qid")
