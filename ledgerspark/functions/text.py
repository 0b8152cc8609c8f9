"""Text preparation for the product search."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerspark.functions.cleaning import strip


def search_text(name: Column, clean_name: Column) -> Column:
    """Name and clean name in one string; a missing clean name adds nothing."""
    return strip(F.concat_ws(" ", name, clean_name))


def search_query(query: Column) -> Column:
    return strip(F.lower(query))


def comparable(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as blanks, trimmed."""
    return strip(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", " "))


def ascii_tokens(text: Column) -> Column:
    """Sorted words of the plain ASCII part, repeated words kept."""
    plain = comparable(F.regexp_replace(text, r"[^\x00-\x7F]", ""))
    return F.array_sort(F.filter(F.split(plain, r"\s+"), lambda word: word != ""))


def grams(text: Column) -> Column:
    """Distinct substrings of one to three characters."""
    starts = F.sequence(F.lit(1), F.length(text))
    pieces = F.transform(starts, lambda i: F.array(
        F.substr(text, i, F.lit(1)), F.substr(text, i, F.lit(2)), F.substr(text, i, F.lit(3))))
    return F.when(F.length(text) > 0, F.array_distinct(F.flatten(pieces))).otherwise(F.array().cast("array<string>"))
