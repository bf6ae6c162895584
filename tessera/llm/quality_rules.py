"""Quality rules: one threshold table compiled into one Spark projection.

Every measure is a built-in expression over the words and lines of a whole text, evaluated row by row
in the scan's own stage: no user function, no shuffle, and memory bounded by one text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import named, whole_text, words

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it with as was on be at by this have from or an are not but "
    "der die das und in zu den mit von sich des auf ist im dem nicht ein eine als auch an es "
    "de la le et les des en un du une que est pour qui dans a par plus pas au sur "
    "el los del se las por con no una su para al lo como y"
).split()

# measure, least, most: a document passes if every measure lies within its bounds (None: no bound).
# The bounds are wide: the rules reject wreckage, not style.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("mean_word_length", 1.5, 25.0),
    ("symbol_ratio", None, 0.1),
    ("stop_word_ratio", 0.02, None),
    ("duplicate_line_ratio", None, 0.4),
)

WINDOW = 8


def _fraction(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _once(df: DataFrame) -> DataFrame:
    """``df`` with every column computed once.

    A generator that makes one row of one row: no filter above is moved below it, so expressions that
    look an array up inside a lambda never get the array's own expression in its place.
    """
    return df.select(F.stack(F.lit(1), *[F.col(c) for c in df.columns]).alias(*df.columns))


def _covered(sorted_windows: Column) -> Column:
    """Words under windows that occur twice or more; input: (hash, position) in sorted order."""
    at = lambda i: F.get(sorted_windows, i)["h"]
    twice = F.transform(
        sorted_windows,
        lambda x, i: F.struct(x["p"].alias("p"), (
            F.coalesce(at(i - 1) == x["h"], F.lit(False)) | F.coalesce(at(i + 1) == x["h"], F.lit(False))
        ).alias("d")),
    )
    places = F.sort_array(F.transform(F.filter(twice, lambda x: x["d"]), lambda x: x["p"]))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    return F.aggregate(
        places, start,
        lambda acc, p: F.struct(
            (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")
        ),
        lambda acc: acc["n"],
    )


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every document: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words
    (long) and n_stop_words, n_lines.

    NULL and empty texts have zero everywhere. Lines without a word do not count. A repeat is a
    window of eight words that occurs twice or more in the text (by 64-bit hash of its words);
    ``n_repeat_words`` counts the words under such windows, the first occurrence included. Rows are
    judged one by one, so equal rows stay as many as they are; other columns are not read.
    """
    text = whole_text(named(docs, text_col))
    base = docs.select(
        named(docs, id_col).alias("doc_id"),
        words(named(docs, text_col)).alias("w"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    windows = F.transform(
        F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW))
    )
    hashed = _once(base).select(
        "doc_id", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size(F.filter("w", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("w") >= WINDOW, windows).alias("h"),
    )
    ordered = _once(hashed).withColumn(
        "s",
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("p")))),
        ),
    )
    return _once(_once(ordered.drop("h")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("s"))).alias("n_repeat_words"),
        "n_stop_words", "n_lines",
    ))


def passes(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one boolean expression over the columns of ``judge``."""
    tests = []
    for name, least, most in thresholds:
        if least is not None:
            tests.append(F.col(name) >= F.lit(float(least)))
        if most is not None:
            tests.append(F.col(name) <= F.lit(float(most)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """``measures`` with the ratios, ``base_failed`` and ``kept`` of every document.

    ``base_failed``: fewer than 20 words, or more than 30 % of the words under repeated windows.
    ``kept``: not ``base_failed`` and within every bound of ``thresholds``. Ratios of texts
    without words or lines are 0. An empty table gives an empty result.
    """
    m = measures(docs, id_col, text_col)
    rated = m.select(
        "*",
        _fraction(F.col("word_chars"), F.col("n_words")).alias("mean_word_length"),
        _fraction(F.col("n_symbols"), F.col("word_chars")).alias("symbol_ratio"),
        _fraction(F.col("n_stop_words"), F.col("n_words")).alias("stop_word_ratio"),
        _fraction(F.col("n_dup_lines"), F.col("n_lines")).alias("duplicate_line_ratio"),
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
    )
    return rated.withColumn("kept", ~F.col("base_failed") & passes(thresholds))
