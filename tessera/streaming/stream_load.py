"""Labelled stream load: new files become labelled batches, each loaded once."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LEDGER = "_ledger"  # folder of the commit log; names with an underscore are no data to Spark
ENTRY = "label string, folder string, files array<string>"
_FILE = "_loaded_file"


class Ledger:
    """The commit log of a table: one entry per batch that names its label, its data folder and its source files.

    An entry is a file that is created only if no other has its number, after the data is written: data
    folders without an entry are no part of the table, and files of an entry are never loaded again
    under its label, whatever became of the stream's checkpoint.
    """

    def __init__(self, spark: SparkSession, table_path: str):
        self.spark, self.table = spark, table_path.rstrip("/")
        self.path = f"{self.table}/{LEDGER}"
        self._jvm = spark._jvm
        self._fs = self._place(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _place(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def size(self) -> int:
        """Number of entries; they are numbered from 0 without gaps."""
        place = self._place(self.path)
        if not self._fs.exists(place):
            return 0
        return sum(1 for f in self._fs.listStatus(place) if f.getPath().getName().endswith(".json"))

    def entries(self) -> DataFrame:
        """(label, folder, files) of every committed batch."""
        if not self.size():
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).json(self.path)

    def loaded(self, label: str) -> DataFrame:
        """The source files that a label has loaded, one column ``file``."""
        rows = self.entries().where(F.col("label") == label)
        return rows.select(F.explode("files").alias("file"))

    def commit(self, label: str, folder: str, files: list[str], number: int) -> bool:
        """Create entry ``number``; False when another loader has created it meanwhile."""
        place = self._place(f"{self.path}/{number:012d}.json")
        if self._fs.exists(place):
            return False
        text = json.dumps({"label": label, "folder": folder, "files": files}) + "\n"
        draft = self._place(f"{self.path}/.draft-{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(text.encode())
        out.close()
        # a rename without overwriting never shows half an entry, and fails where there is one
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.makeQualified(place).toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark._sc._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(place), plain)
        except Py4JJavaError as e:
            self._fs.delete(draft, False)
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def table_rows(self, schema: StructType) -> DataFrame:
        """The rows of all committed batches with their ``label`` partition."""
        folders = [r["folder"] for r in self.entries().select("folder").collect()]  # one per batch
        paths = [f"{self.table}/{f}" for f in folders]
        if not paths:
            return self.spark.createDataFrame([], schema).withColumn("label", F.lit(None).cast("string"))
        return self.spark.read.option("basePath", self.table).parquet(*paths)


def stream_load(
    spark: SparkSession, in_dir: str, schema: StructType, table_path: str, checkpoint: str,
    label: str, columns: dict[str, Column | str] | None = None, fmt: str = "parquet",
    files_per_batch: int = 1000,
) -> DataFrame:
    """Load all files now in ``in_dir`` that the label has not loaded before; returns the table.

    A micro-batch takes the files that the table's ledger does not name for the label, writes their rows
    to a folder of its own and then commits both with one ledger entry. A batch that is replayed, from this
    checkpoint or from a new one, finds its files in the ledger and adds nothing; a folder whose
    commit was lost is not read. Every micro-batch has at most ``files_per_batch`` files.
    """
    ledger = Ledger(spark, table_path)
    source = (
        spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(in_dir)
    )
    keep = {k: source[v] if isinstance(v, str) else v for k, v in columns.items()} if columns else {c: source[c] for c in source.columns}
    source = source.select(*[v.alias(k) for k, v in keep.items()], F.col("_metadata.file_path").alias(_FILE))

    def write(batch: DataFrame, number: int) -> None:
        while True:
            at = ledger.size()
            fresh = batch.join(F.broadcast(ledger.loaded(label).join(batch.select(F.col(_FILE).alias("file")).distinct(), "file", "left_semi")),
                               F.col(_FILE) == F.col("file"), "left_anti")
            files = sorted(r[0] for r in fresh.select(_FILE).distinct().collect())  # at most files_per_batch
            if not files:
                return
            folder = f"label={label}-{at:012d}-{uuid.uuid4().hex[:8]}"
            fresh.drop(_FILE).write.parquet(f"{ledger.table}/{folder}")
            if ledger.commit(label, folder, files, at):
                return

    (
        source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start().awaitTermination()
    )
    return ledger.table_rows(source.drop(_FILE).schema)
