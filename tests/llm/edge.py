"""A small table with every kind of difficult row."""

LONG = "Lorem ipsum dolor sit amet. " * 4000
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, shard string, rank int, number int"
ROWS = [
    (0, "The quick brown fox jumps over the lazy dog. It runs. It hides!", "en", "a", 10, "x", 1, 1),
    (1, "The quick brown fox jumps over the lazy dog. It runs. It hides!", "en", "a", 10, "x", 1, 1),
    (2, None, "en", "a", None, None, None, None),
    (3, "", None, None, 0, "", 0, 0),
    (4, "12345 !!! --- 678", "en", "b", 3, "y", 2, 2),
    (None, "An unnamed text that nobody has seen before today.", "de", "b", 1, "y", 2, 2),
    (None, None, None, None, None, None, None, None),
    (6, LONG, "la", "c", len(LONG), "z", 3, 3),
    (7, "Repeated row, one of three.", "en", "c", 5, "z", 3, 3),
    (7, "Repeated row, one of three.", "en", "c", 5, "z", 3, 3),
    (7, "Repeated row, one of three.", "en", "c", 5, "z", 3, 3),
    (7, "Another text under the same id.", "en", "c", 5, "z", 3, 3),
    (8, "naïve  café \t\n\n 日本語 🙂 <|endoftext|> it's", "fr", "c", 5, "z", 3, 3),
]


def edge(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
