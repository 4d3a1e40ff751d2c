"""Column expressions on text that stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything but these characters belongs to a word.
SEPARATOR = r"[\x20\x09-\x0D]+"


def text_or_empty(text: str | Column = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.array_remove(F.split(text_or_empty(text), SEPARATOR), "")


def word_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")
