"""Scalar functions on texts and identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffix, its replacement, and the least number of bytes that must be left before it, in order of trial.
SUFFIXES = [
    ("tions", "t", 0), ("tion", "t", 0), ("ments", "", 0), ("ment", "", 0), ("ities", "", 0), ("ity", "", 0), ("ings", "", 0), ("ing", "", 3),
    ("ies", "y", 0), ("ers", "", 3), ("er", "", 3), ("ors", "", 3), ("or", "", 3), ("izes", "", 0), ("ize", "", 0), ("ated", "at", 0), ("ate", "at", 4), ("ed", "", 3), ("es", "", 3),
]


def estimate_tokens(text: Column) -> Column:
    """A quarter of the bytes, rounded up; 0 for empty, null for null."""
    return F.ceil(F.octet_length(text) / 4)


def split_identifier(text: Column) -> Column:
    """The lower-cased words of identifiers: split at what is no letter or digit and at changes of case."""
    border = r"[^\p{L}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    return F.filter(F.transform(F.split(text, border), F.lower), lambda w: w != "")


def stem(word: Column) -> Column:
    """The word without the first suffix of the list that leaves enough; a plain plural s goes last."""
    size = F.octet_length(word)
    out = F.when(size <= 3, word)
    for suffix, put, least in SUFFIXES:
        out = out.when(word.endswith(suffix) & (size >= least + len(suffix)), F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(put)))
    return out.when(word.endswith("s") & ~word.endswith("ss") & (size >= 4), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def term_set(text: Column, keep: str | None = None) -> Column:
    """Distinct words of two bytes or more, each with its stem, in no order. The text is split once, a repeated word stemmed once.

    ``keep`` is a pattern of the words (in lower case) to go on with; others are dropped before they are stemmed.
    """
    border = r"[^\p{L}\p{N}]+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})"
    words = F.array_distinct(F.split(text, border))
    words = F.array_distinct(F.transform(F.filter(words, lambda w: F.octet_length(w) >= 2), F.lower))
    if keep is not None:
        words = F.filter(words, lambda w: F.rlike(w, F.lit(keep)))
    return F.array_distinct(F.filter(F.flatten(F.transform(words, lambda w: F.array(w, stem(w)))), lambda w: F.octet_length(w) >= 2))


def tokenize(text: Column) -> Column:
    """Sorted distinct words of two bytes or more, each with its stem."""
    return F.sort_array(term_set(text))


def first_line(text: Column) -> Column:
    """The first line without the blanks around it."""
    return F.trim(F.substring_index(text, "\n", 1))
