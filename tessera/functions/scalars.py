"""Scalar column functions: vector text, sizes, durations, shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.distance import as_col

# fixed values: bytes per unit as powers of 1024, milliseconds per unit
SIZE_UNITS = {"B": 0, "KB": 1, "MB": 2, "GB": 3, "TB": 4}
DURATION_MS = {"hour": 3_600_000.0, "min": 60_000.0, "sec": 1000.0, "ms": 1.0, "us": 1e-3, "ns": 1e-6}

_NUMBER = r"(\d+(?:\.\d+)?)"


def vector_text(vec, digits: int = 6) -> Column:
    """``[v1,v2,...]`` with a fixed number of digits."""
    fmt = f"%.{digits}f"
    items = F.transform(as_col(vec), lambda x: F.format_string(fmt, x.cast("double")))
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def size_to_mb(text) -> Column:
    """``3.93 MB`` style sizes in megabytes; NULL when not of that form."""
    s = F.trim(as_col(text))
    pattern = rf"^{_NUMBER}\s*([A-Za-z]+)$"
    unit = F.upper(F.regexp_extract(s, pattern, 2))
    factor = F.create_map(*[F.lit(x) for u, p in SIZE_UNITS.items() for x in (u, 1024.0 ** (p - 2))])
    value = F.regexp_extract(s, pattern, 1)
    # NULL for an unknown unit
    return F.when(s.rlike(pattern), value).cast("double") * F.try_element_at(factor, unit)


def duration_to_ms(text) -> Column:
    """``1sec456ms`` style durations in milliseconds; NULL when not of that form."""
    s = F.trim(as_col(text))
    ordered = "".join(rf"(?:\d+(?:\.\d+)?{u})?" for u in DURATION_MS)
    valid = s.rlike(rf"^{ordered}$") & (F.length(s) > 0)
    item = F.lit(_NUMBER + r"([a-z]+)")
    numbers, units = (F.regexp_extract_all(s, item, F.lit(i)) for i in (1, 2))
    factor = F.create_map(*[F.lit(x) for pair in DURATION_MS.items() for x in pair])
    terms = F.zip_with(numbers, units, lambda n, u: n.cast("double") * F.try_element_at(factor, u))
    return F.when(valid, F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def bits(value, width: int = 8) -> Column:
    """The lowest ``width`` bits as 0/1 text."""
    return F.lpad(F.bin(as_col(value).bitwiseAND(F.lit((1 << width) - 1))), width, "0")
