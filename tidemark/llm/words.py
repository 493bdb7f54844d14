"""Words of many texts at once, as hashes in flat arrays; used inside tasks, on batches that Spark hands over."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np

# Letters of other scripts that look like Latin ones.
LOOKALIKES = dict(zip("авекмнорстухіјѕԁгпαεικνορτυχ", "abekmhopctyxijsdrnaeiknoptux", strict=True))
MARKUP = re.compile(r"</?[A-Za-z][^<>]*>")
ENTITY = re.compile(r"&(?:#(\d{1,7})|#x([0-9a-fA-F]{1,6})|([a-z]{2,8}));")
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}

#: Bytes to lower-case letters, digits and spaces. Emphasis marks and apostrophes vanish, so that they never part a word.
DROPPED = b"*_~`'\\"
_TABLE = bytes(
    c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)
)
#: The same, with line ends kept.
keep_lines = bytes(10 if c == 10 else b for c, b in enumerate(_TABLE))
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
#: Bytes worked on at once.
SLICE = 1 << 20


def _entity(m: re.Match) -> str:
    if m[3]:
        return NAMED.get(m[3], " ")
    code = int(m[1]) if m[1] else int(m[2], 16)
    return chr(code) if 31 < code < 0x110000 and not 0xD800 <= code < 0xE000 else " "


def _folded(ch: str) -> str:
    if ch in LOOKALIKES:
        return LOOKALIKES[ch]
    kind = unicodedata.category(ch)
    if kind in ("Cf", "Mn"):
        return ""
    if ch in "’‘ʼ":
        return ""
    if kind[0] in "LN":
        flat = "".join(c for c in unicodedata.normalize("NFKD", ch) if unicodedata.category(c) != "Mn")
        return flat.lower() if flat else ch
    return " "


class _Folding(dict):
    def __missing__(self, code: int) -> str:
        self[code] = out = chr(code) if code < 128 else _folded(chr(code).lower()[:1])
        return out


_FOLD = _Folding()


def fold_text(text: str) -> bytes:
    """A text's bytes without accents, invisible or lookalike characters."""
    if not text.isascii():
        text = text.translate(_FOLD)
    return text.encode("utf-8", "ignore")


def plain_words(text: str | None) -> bytes:
    """A text as lower-case words parted by spaces: no markup, entities, accents, invisible or lookalike characters."""
    if not text:
        return b""
    if "<" in text:
        text = MARKUP.sub("", text)
    if "&" in text:
        text = ENTITY.sub(_entity, text)
    return fold_text(text).translate(_TABLE, DROPPED)


def _powers(n: int, base: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[0] = 1
    return np.multiply.accumulate(p)


_UP, _DOWN = np.empty(0, np.uint64), np.empty(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Well-spread 64-bit hashes from weak ones."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_words(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first byte) of every word of a text of plain words; equal words have equal hashes anywhere."""
    global _UP, _DOWN
    a = np.frombuffer(buffer, np.uint8)
    if not len(a):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(_UP) <= len(a):
        n = max(SLICE, len(a)) + 1
        _UP, _DOWN = _powers(n, _MULTIPLIER), _powers(n, pow(_MULTIPLIER, -1, 2**64))
    inside = np.concatenate(([False], a > 32, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(a * _UP[: len(a)], dtype=np.uint64)))
    return mixed((total[end] - total[start]) * _DOWN[start]), start


def slices(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(hashes of the words, first word of each text and the end, first text, end text) for runs of texts of about SLICE bytes."""
    held, size, first, at = [], 0, 0, 0
    for t in texts:
        held.append(plain_words(t))
        size += len(held[-1]) + 1
        at += 1
        if size >= SLICE:
            yield (*_words_of(held), first, at)
            held, size, first = [], 0, at
    if held:
        yield (*_words_of(held), first, at)


def _words_of(held: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum([0, *(len(b) + 1 for b in held)])
    h, at = hash_words(b" ".join(held))
    return h, np.searchsorted(at, starts)
