"""Words, hold-out splits and names shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A word is a run of bytes other than these six: space, and tab to carriage return.
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def whole_text(text: Column) -> Column:
    """The text itself; NULL counts as empty."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text, in order; empty for NULL."""
    return F.array_remove(F.split(whole_text(text), WORD_BREAKS), "")


def byte_words(text: str | None) -> list[bytes]:
    """The same words in UTF-8 with A-Z lower-cased: ``bytes.split`` breaks at the same six bytes."""
    return (text or "").encode().lower().split()


def remainder(id_col: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; 0 for a NULL id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % mod, F.lit(0)).cast("int")


def fresh(taken: Sequence[str], name: str) -> str:
    """``name``, lengthened until no column has it (Spark ignores case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name += "_"
    return name


def named(df: DataFrame, column: str) -> Column:
    """A column by its exact name, also when the name holds dots or back-ticks."""
    return df["`" + column.replace("`", "``") + "`"]


def sent(spark: SparkSession, model: object) -> Broadcast:
    """The attributes of a model as a broadcast: plain data, which tasks can read without this package."""
    state = model.__getstate__()
    return spark.sparkContext.broadcast(dict(state))


def received(shared: Broadcast, kind: type):
    """The model of a ``sent`` broadcast, built once per worker process."""
    state = shared.value
    if "_built" not in state:
        model = kind.__new__(kind)
        model.__dict__.update(state)
        state["_built"] = model
    return state["_built"]
