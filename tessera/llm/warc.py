"""WARC archives of Zstandard frames that share a dictionary.

A dictionary is trained on a bounded sample of the records to be archived. Every archive begins with a
skippable frame that holds it, then come the records, each compressed alone, so a reader can start at any
of them. Archives are rows of a table written by Spark, a file each after ``export``. Of pages with equal
payloads one is archived whole, the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from tessera.llm.common import named, whole_text
from tessera.llm.rows import FILE, ROW, located, written
from tessera.sources.xvecs import open_fs, qualified

# Fixed values of the format.
DICTIONARY_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 1000  # shorter payloads are archived as often as they occur
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS = 1_000  # records that the dictionary is trained on, at most
SAMPLE_RECORD_BYTES = 32 << 10  # longer ones are not in the sample
ARCHIVE_BYTES = 8 << 20  # an archive ends with the record that reaches this
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
_GROUP_BYTES = 16 << 20
_FEED = 64 << 10

ARCHIVES = "archive string, n_records int, raw_bytes long, content binary"
RECORDS = (
    "archive string, offset long, record_type string, record_id string, date string, target_uri string, page_id string,"
    " refers_to string, refers_to_page string, payload_bytes long, payload_digest string, payload binary"
)


def _text(value: object) -> str | None:
    """A value on one line of visible ASCII; ``unquote`` gives it back."""
    return None if value is None or value != value else quote(str(value), safe="")


def _uri(value: object) -> str | None:
    """The address with all that no URI may hold (controls, spaces, other scripts) percent-encoded."""
    return None if value is None or value != value else quote(str(value), safe="".join(map(chr, range(0x21, 0x7F))))


def record(headers: Sequence[tuple[str, object]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers if v is not None), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_head(length: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length


def page_record(row: dict, date: str = DATE) -> bytes:
    """The record of one decided row: a response with its payload, or a revisit without."""
    revisit = row["revisit"]
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(row['record_id'])}>"),
        ("WARC-Date", date), ("WARC-Target-URI", _uri(row["url"])), ("Content-Type", "application/http;msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()), ("X-Page-Id", _text(row["page_id"])),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:uuid:{uuid.UUID(row['refers_to'])}>"),
            ("X-Refers-To-Page-Id", _text(row["refers_to_page"])),
        ]
    return record(headers, http_head(row["payload_bytes"]) + (b"" if revisit else row["payload"].encode()))


def build_dictionary(samples: Sequence[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary, or nothing where the samples are too few or too short to train one."""
    total = sum(map(len, samples))
    if len(samples) < 8 or total < 2048:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 10)), list(samples)).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes, level: int = LEVEL) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT) if dictionary else None
    if shared:
        shared.precompute_compress(level=level)
    return zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True, write_content_size=True)


def leading_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def archives_of(records: Iterable[bytes], name: str, dictionary: bytes, most: int = ARCHIVE_BYTES) -> Iterator[tuple[str, int, int, bytes]]:
    """(name, records, their bytes, content) of archives that hold the records in order, each after a warcinfo record."""
    compress = _compressor(dictionary).compress
    out: list[bytes] = []
    size = n = raw = k = 0

    def archive_name() -> str:
        return f"{name}-{k:05d}.warc.zst"

    for r in records:
        if not out:
            info = record(
                [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, archive_name())}>"),
                 ("WARC-Date", DATE), ("WARC-Filename", archive_name()), ("Content-Type", "application/warc-fields")],
                b"format: WARC File Format 1.1\r\n",
            )
            out = [leading_frame(dictionary), compress(info)]
            size = sum(map(len, out))
        out.append(compress(r))
        size, n, raw = size + len(out[-1]), n + 1, raw + len(r)
        if size >= most:
            yield archive_name(), n, raw, b"".join(out)
            out, size, n, raw, k = [], 0, 0, 0, k + 1
    if out:
        yield archive_name(), n, raw, b"".join(out)


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decompressed bytes) of every compressed frame; the leading dictionary is used if there is one."""
    view = memoryview(content)
    at, shared = 0, None
    while at < len(view):
        magic, length = struct.unpack_from("<II", view, at) if at + 8 <= len(view) else (0, 0)
        if magic in SKIPPABLE:
            if at == 0 and magic == DICTIONARY_MAGIC:
                held = bytes(view[8:8 + length])
                if held[:4] == struct.pack("<I", zstandard.MAGIC_NUMBER):  # a writer may compress it
                    held = zstandard.ZstdDecompressor().decompress(held)
                shared = zstandard.ZstdCompressionDict(held)
            at += 8 + length
            continue
        one = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
        begin, parts = at, []
        while not one.eof:
            fed = view[at:at + _FEED]
            if not len(fed):
                raise ValueError(f"the frame at {begin} is cut off")
            parts.append(one.decompress(fed))
            at += len(fed) - len(one.unused_data)
        yield begin, b"".join(parts)


@dataclass
class Record:
    headers: dict[str, str]  # names in lower case
    block: bytes


def parse(raw: bytes) -> Record:
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {}
    for line in lines:
        k, _, v = line.decode().partition(":")
        headers[k.lower()] = v.strip()
    n = int(headers["content-length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record of another length than it says")
    return Record(headers, rest[:n])


def _page(r: Record) -> dict:
    """What a record says of its page; a whole payload is checked against its digest."""
    h = r.headers
    kind = h["warc-type"]
    given = lambda k: unquote(h[k]) if k in h else None
    out = {
        "record_type": kind, "record_id": h["warc-record-id"], "date": h.get("warc-date"), "target_uri": h.get("warc-target-uri"),
        "page_id": given("x-page-id"), "refers_to": h.get("warc-refers-to"), "refers_to_page": given("x-refers-to-page-id"),
        "payload_bytes": None, "payload_digest": None, "payload": None,
    }
    if kind in ("response", "revisit"):
        head, _, payload = r.block.partition(b"\r\n\r\n")
        method, _, digest = h["warc-payload-digest"].partition(":")
        out["payload_digest"] = base64.b32decode(digest).hex()
        if kind == "response":
            if method == "sha1" and hashlib.sha1(payload).hexdigest() != out["payload_digest"]:
                raise ValueError(f"{out['record_id']}: the payload does not have its digest")
            out["payload"], out["payload_bytes"] = payload, len(payload)
        else:  # the head is that of the whole response
            out["payload_bytes"] = int(re.search(rb"(?im)^content-length: *(\d+)", head)[1])
    return out


def decide(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES
) -> DataFrame:
    """What is to be archived per row: (page_id, url, payload, payload_bytes, sha1, record_id, revisit, refers_to, refers_to_page).

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the largest id is archived
    whole (of equal ids the one whose place in the table is last); the others are revisits, without a
    payload. Payloads are equal when their SHA-256 are. NULL payloads are empty; a NULL id is smaller than
    any. Only digests and places are grouped; a digest that occurs once takes no part in the join.
    """
    rows = located(pages.select(
        named(pages, id_col).alias("page_id"), named(pages, url_col).cast("string").alias("url"), whole_text(named(pages, payload_col)).alias("payload")
    ))
    rows = rows.select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha2("payload", 256)).alias("digest"),
        F.struct("page_id", FILE, ROW).alias("place"),
    )
    groups = rows.where(F.col("payload_bytes") >= min_bytes).groupBy("digest").agg(
        F.max("place").alias("whole"), F.count(F.lit(1)).alias("n")
    ).where("n > 1").select("digest", "whole")
    # written, so the planner knows the size: a small one is broadcast and no payload moves
    joined = rows.join(written(groups, "equal-payloads"), "digest", "left")
    revisit = F.col("whole").isNotNull() & ~F.col("whole").eqNullSafe(F.col("place"))
    key = lambda place: F.md5(F.concat_ws("\n", F.col(f"{place}.{FILE}"), F.col(f"{place}.{ROW}").cast("string")))
    return joined.select(
        "page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "payload_bytes", F.sha1("payload").alias("sha1"),
        key("place").alias("record_id"), revisit.alias("revisit"), F.when(revisit, key("whole")).alias("refers_to"),
        F.when(revisit, F.col("whole.page_id")).alias("refers_to_page"),
    )


def train(decided: DataFrame, n_rows: int, records: int = SAMPLE_RECORDS, size: int = DICTIONARY_BYTES) -> bytes:
    """The dictionary of a sample of the whole records, at most ``records`` of at most SAMPLE_RECORD_BYTES each.

    The sample is drawn by a hash of record ids at a rate that leaves about twice ``records`` of ``n_rows``
    rows, so what reaches the driver does not grow with the table or its tasks.
    """
    short = decided.where(~F.col("revisit") & (F.col("payload_bytes") <= SAMPLE_RECORD_BYTES))
    drawn = short.where(F.pmod(F.xxhash64("record_id"), F.lit(max(n_rows, 1))) < 2 * records)
    rows = drawn.orderBy(F.xxhash64("record_id"), "record_id").limit(records).collect()
    return build_dictionary([page_record(r.asDict()) for r in rows], size)


def write(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_bytes: int = MIN_REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES, date: str = DATE,
) -> DataFrame:
    """Archives of all rows, written as a table at ``path`` (see ARCHIVES): one record a row, in any order.

    An archive ends with the record that reaches ``archive_bytes``, so a task holds one archive and one
    record. Ids are header values and come back as they were; of addresses, characters that no URI may
    hold are percent-encoded and stay so; a NULL one has no header. Other columns are not read. Where no dictionary can be trained archives have no leading frame; an empty table gives none.
    """
    spark = pages.sparkSession
    decided = decide(pages, id_col, url_col, payload_col, min_bytes)
    dictionary = spark.sparkContext.broadcast(train(decided, pages.count()))

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        records = (page_record(r, date) for df in batches for r in df.to_dict("records"))
        for found in archives_of(records, f"pages-{TaskContext.get().partitionId():06d}", dictionary.value, archive_bytes):
            yield pd.DataFrame([found], columns=["archive", "n_records", "raw_bytes", "content"])

    texts = decided.withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to_page")})
    out = texts.mapInPandas(run, ARCHIVES)
    out.write.option("parquet.block.size", _GROUP_BYTES).option("compression", "none").parquet(path)
    return spark.read.schema(ARCHIVES).parquet(path)


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of a table with ``archive`` and ``content`` (see RECORDS), warcinfo records too.

    Digests are in hexadecimal; ``payload_bytes`` and ``payload_digest`` of a revisit are those of the
    payload it refers to. Whole payloads are checked against their digests and left out unless wanted.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for name, content in zip(df["archive"], df["content"]):
                rows, held = [], 0
                for offset, raw in frames(content):
                    row = _page(parse(raw))
                    if not payloads:
                        row["payload"] = None
                    rows.append({"archive": name, "offset": offset, **row})
                    held += len(raw) if payloads else 512
                    if held >= 4 * ARCHIVE_BYTES:
                        yield _table(rows)
                        rows, held = [], 0
                if rows:
                    yield _table(rows)

    return archives.select("archive", "content").mapInPandas(run, RECORDS)


def _table(rows: list[dict]) -> pd.DataFrame:
    df = pd.DataFrame(rows)
    return df.assign(payload_bytes=df["payload_bytes"].astype("Int64"))


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(archive, content) of the ``.warc.zst`` files of a folder, on any file system that Spark reads."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")


@dataclass
class Placed(WriterCommitMessage):
    files: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    """Tasks write hidden files; those of a successful job get their names."""

    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator):
        system, folder = open_fs(self.folder)
        system.create_dir(folder, recursive=True)
        files = []
        for batch in iterator:
            for row in batch.to_pylist():
                temp = f"{folder}/_{row['archive']}-{uuid.uuid4().hex}"
                with system.open_output_stream(temp) as out:
                    out.write(row["content"])
                files.append((temp, f"{folder}/{row['archive']}"))
        return Placed(files)

    def commit(self, messages):
        system, _ = open_fs(self.folder)
        for temp, final in (f for m in messages if m for f in m.files):
            system.move(temp, final)

    def abort(self, messages):
        system, _ = open_fs(self.folder)
        for temp, _ in (f for m in messages if m for f in m.files):
            system.delete_file(temp)


class ArchiveFiles(DataSource):
    @classmethod
    def name(cls):
        return "warc_files"

    def schema(self):
        return "archive string, content binary"

    def writer(self, schema, overwrite):
        return FilesWriter(self.options["path"])


def export(archives: DataFrame, folder: str) -> None:
    """One ``.warc.zst`` file per archive, in a folder that all executors reach."""
    spark = archives.sparkSession
    spark.dataSource.register(ArchiveFiles)
    archives.select("archive", "content").write.format("warc_files").option("path", qualified(spark, folder)).mode("append").save()
