"""Column expressions shared by the text operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

#: A word is a run of anything but these.
NOT_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.

    Texts of one byte per character take the built-in lower(), which is the
    same there and much faster than translate().
    """
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(NOT_WORD)), F.lit(0)).cast("long")


def id_crc(key: Column) -> Column:
    """CRC-32 of the key written as text; NULL counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")))
