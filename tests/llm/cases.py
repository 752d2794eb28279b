"""Rows that every operator must survive, and helpers of the tests."""

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls in every column, empty and blank texts, ties, repeated rows, a very long text, other scripts.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog again and again today", "en", "a", 10),
    (2, "the QUICK brown fox jumps over the lazy dog again and again today", "en", "a", 10),
    (2, "the QUICK brown fox jumps over the lazy dog again and again today", "en", "a", 10),
    (3, None, None, None, None),
    (None, "no id here, only some words to keep it company", "en", None, None),
    (4, "", "en", "b", 0),
    (5, " \t\n ", "en", "b", 4),
    (6, "ÄPFEL sind grün é   \U0001f600 x", "de", "b", 20),
    (7, "äpfel sind grün é   \U0001f600 x", "de", "b", 20),
    (8, "word " * 60_000, "en", "c", 300_000),
    (9, "one", "en", "c", 3),
    (10, "one", None, "c", 3),
    (None, None, None, None, None),
]
#: Columns named like ones the operators use inside.
CLASHING = ("id", "n", "size", "key", "digest", "row_id", "block", "owner", "target", "component_id", "kept", "spans", "base", "p")


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, DOCS)


def clashing(df):
    for c in CLASHING:
        df = df.withColumn(c, F.lit("x"))
    return df


def rows(df, *columns):
    """Rows as a sorted list of tuples."""
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def lower(text):
    """A-Z only."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
