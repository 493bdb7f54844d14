"""Token-bounded overlapping chunks: paragraphs, then sentences, then slices, packed left to right."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import sha256_hex
from tidemark.functions.text import paragraphs, sentences
from tidemark.session import computed_once

MAX_TOKENS = 512
OVERLAP_TOKENS = 77
TOKEN = r"[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n]"
_TOKEN_WITH_SPACE = r"(?:[A-Za-z0-9_]+|[^A-Za-z0-9_ \t\r\n])[ \t\r\n]*"


def count_tokens(c: Column) -> Column:
    """Tokens by the pattern, counted without a list of them: each is replaced by its first character."""
    return F.length(F.regexp_replace(c, r"[ \t\r\n]+|([A-Za-z0-9_])[A-Za-z0-9_]*", "$1"))


def pattern_slices(sentence: Column, most: int) -> Column:
    """Consecutive slices of at most ``most`` tokens."""
    tokens = F.regexp_extract_all(sentence, F.lit(_TOKEN_WITH_SPACE), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens), F.lit(1)), F.lit(most))
    return F.transform(starts, lambda s: F.rtrim(F.array_join(F.slice(tokens, s, most), "")))


@dataclass(frozen=True)
class Tokenizer:
    """How texts are measured and how what is too long is sliced, as expressions. No token may reach over a blank line."""

    count: Callable[[Column], Column] = count_tokens
    slices: Callable[[Column, int], Column] = pattern_slices


def units(text: Column, most: int, by: Tokenizer) -> Column:
    """(t, n): paragraphs as they are; of longer ones the sentences; of longer ones slices. Each is counted once."""
    sized = lambda parts: F.transform(parts, lambda x: F.struct(x.alias("t"), by.count(x).alias("n")))
    of_sentence = lambda s: F.when(s["n"] <= most, F.array(s)).otherwise(sized(by.slices(s["t"], most)))
    of_paragraph = lambda p: F.when(p["n"] <= most, F.array(p)).otherwise(F.flatten(F.transform(sized(sentences(p["t"])), of_sentence)))
    return F.flatten(F.transform(sized(paragraphs(text)), of_paragraph))


def pack_windows(counts: np.ndarray, most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) of every window, by binary search in the running sums of the units' tokens."""
    upto = np.concatenate(([0], np.cumsum(counts)))
    out, i, n = [], 0, len(counts)
    while i < n:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, "right")) - 1)
        out.append((i, j))
        if j == n:
            break
        # the last unit from which on the overlap is held, though not the window's first
        held = int(np.searchsorted(upto, upto[j] - overlap, "right")) - 1 if overlap > 0 else j
        i = max(min(held, j), i + 1)
    return out


def chunk(docs: DataFrame, key: str, text: str, most: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, by: Tokenizer = Tokenizer()) -> DataFrame:  # noqa: B008
    """Rows (key, ordinal, text, token_count, text_sha256): the chunks of every text.

    A window takes units while their tokens' sum stays within ``most``; the next one goes back over units until
    ``overlap`` tokens are repeated, but never as far as the window's own first unit. Chunks join their units by a blank
    line, over which no token reaches, so token_count is the sum of the units'. No trailing chunk of overlap alone is made.

    Null, empty and blank texts give no rows; other columns are not used. The units' token counts are packed in
    Python, a batch of texts at a time, and nothing is shuffled.
    """

    window = pa.list_(pa.struct([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int32())]))

    def with_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column("u")
            counts, at = unit.flatten().field("n").to_numpy(), np.concatenate(([0], np.cumsum(unit.value_lengths().fill_null(0).to_numpy())))
            found = []
            for k in range(len(batch)):
                own = counts[at[k] : at[k + 1]]
                upto = np.concatenate(([0], np.cumsum(own)))
                found.append([{"i": i, "j": j, "n": int(upto[j] - upto[i])} for i, j in pack_windows(own, most, overlap)])
            yield pa.RecordBatch.from_arrays([batch.column(key), unit, pa.array(found, window)], names=[key, "u", "w"])

    kind = docs.schema[key].dataType.simpleString()
    found = docs.select(key, units(F.col(text), most, by).alias("u")).mapInArrow(with_windows, f"`{key}` {kind}, u array<struct<t:string,n:int>>, w array<struct<i:int,j:int,n:int>>")
    made = found.select(key, F.transform("u", lambda x: x["t"]).alias("u"), "w").select(key, "u", F.posexplode("w").alias("ordinal", "s"))
    body = F.array_join(F.slice("u", F.col("s.i") + 1, F.col("s.j") - F.col("s.i")), "\n\n")
    return computed_once(made.select(key, "ordinal", "u", "s"), text=body).select(
        key, "ordinal", "text", F.col("s.n").alias("token_count"), sha256_hex(F.col("text")).alias("text_sha256")
    )
