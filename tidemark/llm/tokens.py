"""Counting and cutting tokens: runs of ``A-Za-z0-9_`` or single other characters that are not white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
TOKEN_AND_SPACE = r"(?:[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n])[ \t\r\n]*"


def token_marks(text: Column) -> Column:
    """One character for each token of a text: the first of a run, or the single one."""
    return F.regexp_replace(text, r"[ \t\r\n]+|([A-Za-z0-9_])[A-Za-z0-9_]*", "$1")


def token_count(text: Column) -> Column:
    """Tokens of a text; null counts as empty. No list of the tokens is made for it."""
    return F.coalesce(F.length(token_marks(text)), F.lit(0))


def spaced_tokens(text: Column) -> Column:
    """The tokens in order, each with the white space after it. White space before the first is not among them."""
    return F.regexp_extract_all(text, F.lit(TOKEN_AND_SPACE), F.lit(0))
