"""A small table with everything that operators must survive."""

SCHEMA = (
    "doc_id long, text string, lang string, score double, kept string, digest string, n_tokens string, "
    "fp string, bucket string, `a.b` int, held_out string, label string, key string, n string"
)
LONG = "Längere Wörter und the same again. " * 3000


def rows():
    one = "The cat sat on the mat, and the dog lay by the door of the old house all day long."
    texts = [
        (1, one, "en"), (1, one, "en"), (2, one, "en"), (None, one, "en"), (3, None, "en"), (4, "", None),
        (5, " \t\n\x0b ", "en"), (6, LONG, "de"), (7, LONG, "de"), (8, "123 456 !!!", "fr"), (9, "é", "fr"),
        (None, None, None), (10, "a\x00b <|endoftext|> \u3000 it's 'S we'll", "en"), (11, "x" * 50_000, "en"),
    ]
    return [(i, t, g, 0.5, "kept", "digest", "tokens", "fp", "bucket", 3, "yes", "label", "key", "n") for i, t, g in texts]


def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ordered(found):
    return sorted(found, key=repr)
