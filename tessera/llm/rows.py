"""Rows of a file-backed table by place, and their removal without moving the whole table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import named
from tessera.scale import BROADCAST_VALUES
from tessera.session import work_path

FILE, ROW = "_place_file", "_place_row"
_MAP_ROWS = 1 << 15  # rows of one bitmap made by bitmap_construct_agg
_MAP_BYTES = (_MAP_ROWS >> 3) + 256  # with its file name


def located(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of every row: file and row number.

    ``docs`` is a scan of Parquet files with projections and filters; anything else (joins, unions,
    local data) is first written to the shared folder. The place tells equal rows apart and does not
    change when a task runs again.
    """
    for df in (docs, None):
        if df is None:
            path = work_path(docs.sparkSession, "staged")
            docs.write.parquet(path)
            df = docs.sparkSession.read.schema(docs.schema).parquet(path)
        try:
            return df.select(
                *[named(df, c) for c in docs.columns],
                F.col("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW),
            )
        except AnalysisException:
            continue
    raise ValueError("the rows of this table have no place")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, safe from lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _by_place(rows: DataFrame) -> DataFrame:
    """(file, piece, bits): which rows of every file are in ``rows``, as bitmaps of 4 KB for _MAP_ROWS rows each."""
    at = F.col(ROW)
    return rows.where(F.col(FILE).isNotNull()).groupBy(
        F.col(FILE).alias("_place_of"), F.expr(f"{ROW} div {_MAP_ROWS}").alias("_place_piece")
    ).agg(F.bitmap_construct_agg((at % _MAP_ROWS).cast("long")).alias("_place_bits"))


def marked(docs: DataFrame, members: DataFrame, room: int | None = None) -> list[DataFrame]:
    """``docs`` (from ``located``) with ``_place_in``: whether the place of a row is among ``members``; exact.

    The bitmaps of the members' files are broadcast, and where they would be more than ``room`` bytes in
    all, the files are taken in as many groups as it takes, each scanned on its own with its bitmaps. Every
    file is read once, and no text is shuffled, whatever the number of members.
    """
    room = 8 * BROADCAST_VALUES if room is None else room
    cols = docs.columns
    maps = written(_by_place(members), "places")
    n_groups = max(1, -(-maps.count() * _MAP_BYTES // room))
    out = []
    for g in range(n_groups):
        mine, own = docs, maps
        if n_groups > 1:
            group = lambda c: F.pmod(F.xxhash64(c), F.lit(n_groups)) == g
            mine, own = docs.where(group(FILE)), maps.where(group("_place_of"))
        joined = mine.join(
            F.broadcast(own),
            (F.col(FILE) == F.col("_place_of")) & (F.expr(f"{ROW} div {_MAP_ROWS}") == F.col("_place_piece")), "left",
        )
        at = F.col(ROW) % _MAP_ROWS
        byte = F.conv(F.hex(F.substring(F.col("_place_bits"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        with_byte = joined.withColumn("_place_byte", F.coalesce(byte, F.lit(0)))
        bit = F.expr(f"shiftright(_place_byte, cast({ROW} % 8 as int)) & 1") == 1
        out.append(with_byte.select(*[named(with_byte, c) for c in cols], bit.alias("_place_in")))
    return out


def _chosen(docs: DataFrame, members: DataFrame, inside: bool, places: bool, room: int | None) -> DataFrame:
    cols = [c for c in docs.columns if places or c not in (FILE, ROW)]
    out = None
    for part in marked(docs, members, room):
        kept = part.where(F.col("_place_in") == F.lit(inside))
        kept = kept.select(*[named(kept, c) for c in cols])
        out = kept if out is None else out.unionByName(kept)
    return out


def only(docs: DataFrame, members: DataFrame, room: int | None = None) -> DataFrame:
    """The rows of ``docs`` (from ``located``) whose place is in ``members``, with their places."""
    return _chosen(docs, members, True, True, room)


def without(docs: DataFrame, losers: DataFrame, room: int | None = None) -> DataFrame:
    """The rows of ``docs`` (from ``located``) whose place is not in ``losers``, without place columns."""
    return _chosen(docs, losers, False, False, room)
