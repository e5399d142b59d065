"""Texts that every operator must cope with, as (doc_id, text)."""

LONG = "word" * 3 + " " + " ".join(f"w{i % 997}" for i in range(30_000))
EDGE = [
    (1, None),
    (2, ""),
    (3, "   \n\t \n"),
    (4, "one"),
    (5, "one two three four five"),
    (6, "one two three four five"),
    (6, "one two three four five"),
    (7, LONG),
    (8, "Ünïcödé ▁ mark 😀 é \x00 nul\r\nline sep"),
    (None, "a row without an id"),
    (9, "<s> </s> <|endoftext|> <|STARTOFTEXT|> <unk> it's 'tis, well... end."),
]
SCHEMA = "doc_id long, text string"


def edge(spark):
    return spark.createDataFrame(EDGE, SCHEMA)


def clashing(spark, *names):
    """One document with extra columns that have the operator's own names."""
    return spark.createDataFrame([(1, "one two three four five six", *("x" for _ in names))], SCHEMA + "".join(f", {n} string" for n in names))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
