"""Held-out passages inside a corpus: SimHash of passage-sized windows, Hamming blocks, exact check.

The items are few and their number is fixed, so their windows' fingerprints are an index that every task holds;
more items are looked for block by block. What is an instruction and what a word weighs is settled over all items first, so that
the blocks make no difference. The corpus is read once a block and nothing of it is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import hash_words, plain_words, slices
from tidemark.session import cut_lineage

#: Words in a window, about the length of a sentence of a passage.
WINDOW = 10
#: Step between windows of the corpus; the items have one at every word.
STRIDE = 5
#: Largest Hamming distance of the 64-bit fingerprints. Eight blocks of 8 bits: within 7, one block is equal.
RADIUS = 7
BLOCKS = 8
#: Least share of the shingles' weight that a window must have in common with the passage.
SIMILAR = 0.5
#: How far words may have shifted by insertions and omissions nearby.
SHIFT = 3
#: Least share of the passage's words.
SHARE = 0.4
#: A sentence is an instruction if it stands with at least so many different passages, and so great a part of the suite's.
INSTRUCTION_FROM = 3
INSTRUCTION_SHARE = 0.05
#: Items in one index, about 4 KB each.
ITEMS_PER_BLOCK = 10_000

_LABEL = re.compile(r"\b(?:question|passage|context|answer|note)\s*:", re.IGNORECASE)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|[\r\n]+", _LABEL.sub("\n", text)) if s.strip()]


def told(text: str | None) -> list[tuple[int, str]]:
    """(key, sentence) of a text's sentences that are no questions; equally worded ones have equal keys."""
    said = [x for x in sentences(text or "") if not x.rstrip().endswith("?")]
    return [(int.from_bytes(blake2b(b" ".join(plain_words(x).split()), digest_size=8).digest(), "little", signed=True), x) for x in said]


def shared_instructions(items: DataFrame) -> frozenset[tuple[str, int]]:
    """(suite, key) of the sentences that stand in front of, or after, many different passages of a suite.

    items: item_id, suite, text. A passage that several items share, each with a question of its own, is none, however many they are:
    its sentences always stand with the same others. There are at most 1 / INSTRUCTION_SHARE such keys for each sentence of an item.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for suite, text in zip(pdf.suite, pdf.text, strict=True):
                own = {k for k, _ in told(text)}
                whole = sum(own)
                out += [(suite, k, (whole - k) % (1 << 62), whole % (1 << 62)) for k in own]
            yield pd.DataFrame(out, columns=["suite", "key", "others", "whole"])

    each = items.select("suite", "text").mapInPandas(rows, "suite string, key bigint, others bigint, whole bigint")
    stands = each.groupBy("suite", "key").agg(F.countDistinct("others").alias("n")).where(F.col("n") >= INSTRUCTION_FROM)
    all_of = each.groupBy("suite").agg(F.countDistinct("whole").alias("n_all"))
    found = stands.join(all_of, "suite").where(F.col("n") >= INSTRUCTION_SHARE * F.col("n_all"))
    return frozenset((r["suite"], r["key"]) for r in found.select("suite", "key").collect())


def passages(items: pd.DataFrame, instructions: frozenset[tuple[str, int]] = frozenset()) -> dict[int, np.ndarray]:
    """Each item's passage as word hashes, without questions and instructions. What is all instruction stays whole."""
    suites = items.suite if "suite" in items else [""] * len(items)
    out = {}
    for i, suite, text in zip(items.item_id, suites, items.text, strict=True):
        own = told(text)
        kept = [x for k, x in own if (suite, k) not in instructions] or [x for _, x in own]
        words = hash_words(plain_words(" ".join(kept)))[0]
        if len(words):
            out[i] = words
    return out


@dataclass
class Vocabulary:
    """The words of all passages with their weights: the fewer passages have one, the more it weighs."""

    known: np.ndarray  # sorted hashes
    weight: np.ndarray
    unknown: float  # weight of other words, between those of common and rare ones

    @staticmethod
    def of(known: np.ndarray, in_items: np.ndarray, n_items: int) -> Vocabulary:
        return Vocabulary(known, np.log1p(n_items / in_items), float(np.log1p(n_items**0.5)))

    @staticmethod
    def of_passages(own: dict[int, np.ndarray]) -> Vocabulary:
        return Vocabulary.of(*np.unique(np.concatenate([np.unique(w) for w in own.values()]), return_counts=True), len(own))


def vocabulary_of(items: DataFrame, instructions: frozenset[tuple[str, int]]) -> Vocabulary | None:
    """The vocabulary of all items' passages, counted by Spark; what reaches the driver are the different words, 16 bytes each."""

    def words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = passages(pdf, instructions)
            # a row without a word stands for the passage itself
            yield pd.DataFrame({"word": [x for w in own.values() for x in (None, *np.unique(w).view(np.int64).tolist())]}, dtype=object)

    counted = items.mapInPandas(words, "word bigint").groupBy("word").agg(F.count("*").alias("n")).select(F.coalesce("word", F.lit(0)).alias("word"), "n", F.col("word").isNull().alias("whole")).toPandas()
    if not len(counted):
        return None
    real = counted[~counted.whole]
    word = real.word.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(word)
    return Vocabulary.of(word[order], real.n.to_numpy()[order], int(counted.n[counted.whole].sum()))


def fingerprints(words: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SimHash of each row of words."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(*words.shape, 8), axis=2)
    votes = np.einsum("nw,nwb->nb", weights, bits.astype(np.float32) * 2 - 1)
    return np.packbits(votes > 0, axis=1).view(np.uint64).ravel()


@dataclass
class ItemIndex:
    ids: np.ndarray
    words: np.ndarray  # of all passages, one after another
    first: np.ndarray  # of each passage, and the end
    vocabulary: Vocabulary
    item: np.ndarray  # of each window
    offset: np.ndarray  # first word of each window within its passage
    prints: np.ndarray
    order: np.ndarray  # by block, the windows by the block's value
    upto: np.ndarray  # by block and value, where it begins in order

    def weights_of(self, words: np.ndarray) -> np.ndarray:
        """Of words that no passage has, the weight with a minus."""
        v = self.vocabulary
        at = np.minimum(np.searchsorted(v.known, words), len(v.known) - 1)
        return np.where(v.known[at] == words, v.weight[at], -v.unknown).astype(np.float32)


def build_index(items: pd.DataFrame, instructions: frozenset[tuple[str, int]] = frozenset(), vocabulary: Vocabulary | None = None) -> ItemIndex | None:
    """The index of a block of items; without a vocabulary of all items it has that of its own."""
    own = passages(items, instructions)
    if not own:
        return None
    v = vocabulary or Vocabulary.of_passages(own)
    ids = np.array(sorted(own), dtype=np.int64)
    words = np.concatenate([own[i] for i in ids])
    first = np.cumsum([0, *(len(own[i]) for i in ids)])
    size = np.diff(first)
    width = np.minimum(size, WINDOW)
    item = np.repeat(np.arange(len(ids)), size - width + 1)
    offset = np.concatenate([np.arange(n) for n in size - width + 1])
    at = first[item][:, None] + offset[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < width[item][:, None]
    taken = words[np.minimum(at, len(words) - 1)]
    prints = fingerprints(taken, np.where(inside, v.weight[np.searchsorted(v.known, taken)], 0).astype(np.float32))
    blocks = prints.view(np.uint8).reshape(-1, BLOCKS)
    order = np.argsort(blocks, axis=0, kind="stable").T.astype(np.int32)
    upto = np.stack([np.searchsorted(blocks[order[b], b], np.arange(257)) for b in range(BLOCKS)])
    return ItemIndex(ids, words, first, v, item.astype(np.int32), offset.astype(np.int32), prints, order, upto)


def near_windows(index: ItemIndex, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, item window) of all pairs within the radius; a pair may come more than once."""
    for begin in range(0, len(prints), 4096):
        part = prints[begin : begin + 4096]
        blocks = part.view(np.uint8).reshape(-1, BLOCKS)
        for b in range(BLOCKS):
            lo = index.upto[b][blocks[:, b]]
            n = index.upto[b][blocks[:, b].astype(int) + 1] - lo
            q = np.repeat(np.arange(len(part)), n)
            w = index.order[b][np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            close = np.bitwise_count(part[q] ^ index.prints[w]) <= RADIUS
            yield q[close] + begin, w[close]


def covered_words(index: ItemIndex, item: int, text: np.ndarray, shift: int) -> np.ndarray:
    """Which words of a passage the text has, if the passage's word 0 stands at about ``shift``.

    A window counts where shingles of two words with enough of its weight stand in the same order within reach;
    from its first to its last such word it is covered.
    """
    own = index.words[index.first[item] : index.first[item + 1]]
    n = len(own)
    pad = np.zeros(n + 2 * SHIFT, np.uint64)
    lo, hi = max(0, shift - SHIFT), min(len(text), shift + n + SHIFT)
    if hi <= lo:
        return np.zeros(n, bool)
    pad[lo - (shift - SHIFT) : hi - (shift - SHIFT)] = text[lo:hi]
    same = np.stack([pad[s : s + n] == own for s in range(2 * SHIFT + 1)])
    weight = index.vocabulary.weight[np.searchsorted(index.vocabulary.known, own)]
    pair = (same[:, :-1] & same[:, 1:]).any(axis=0) if n > 1 else same.any(axis=0)
    value = weight[:-1] + weight[1:] if n > 1 else weight
    width = min(WINDOW - 1, len(value))
    total = lambda v: np.convolve(v, np.ones(width), "valid")
    good = total(value * pair) >= SIMILAR * total(value)
    met = np.zeros(n, bool)
    met[: len(pair)] |= pair
    if n > 1:
        met[1:] |= pair
    out = np.zeros(n, bool)
    for k in np.flatnonzero(good):
        hit = np.flatnonzero(met[k : k + width + 1])
        out[k + hit[0] : k + hit[-1] + 1] = True
    return out


def leaks_in(index: ItemIndex, texts: pd.Series) -> Iterator[tuple[int, int, float]]:
    """(text's place, item, share of the passage's words) of every passage of which a window was found."""
    for words, first, begin, end in slices(texts):
        signed = index.weights_of(words)
        size = np.diff(first)
        count = np.where(size > WINDOW, -(-(size - WINDOW) // STRIDE) + 1, (size > 0).astype(int))
        text = np.repeat(np.arange(len(size)), count)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
        at = first[text] + np.maximum(0, np.minimum(nth * STRIDE, size[text] - WINDOW))
        # where words that no passage has hold most of the weight, no window can be similar enough
        plus = np.concatenate(([0], np.cumsum(np.maximum(signed, 0), dtype=np.float64)))
        every = np.concatenate(([0], np.cumsum(np.abs(signed), dtype=np.float64)))
        stop = np.minimum(at + WINDOW, first[text + 1])
        hopeful = plus[stop] - plus[at] >= SIMILAR * (every[stop] - every[at])
        text, at, stop = text[hopeful], at[hopeful], stop[hopeful]
        anchors: set[tuple[int, int, int]] = set()
        for lo in range(0, len(at), 16384):
            spot = at[lo : lo + 16384, None] + np.arange(WINDOW)
            inside = spot < stop[lo : lo + 16384, None]
            spot = np.minimum(spot, len(words) - 1)
            prints = fingerprints(words[spot], np.where(inside, np.abs(signed[spot]), 0).astype(np.float32))
            for q, w in near_windows(index, prints):
                place = at[lo + q] - first[text[lo + q]] - index.offset[w]
                anchors.update(zip(text[lo + q].tolist(), index.item[w].tolist(), place.tolist(), strict=True))
        found: dict[tuple[int, int], np.ndarray] = {}
        tried: dict[tuple[int, int], int] = {}
        for t, i, place in sorted(anchors):
            if place - tried.get((t, i), place - 9) <= 1:  # the neighbour tried last saw the same words
                continue
            tried[t, i] = place
            got = covered_words(index, i, words[first[t] : first[t + 1]], place)
            found[t, i] = found[t, i] | got if (t, i) in found else got
        for (t, i), got in found.items():
            if got.any():
                yield begin + t, int(index.ids[i]), float(got.mean())


def leak_shares(documents: DataFrame, items: DataFrame, items_per_block: int = ITEMS_PER_BLOCK) -> DataFrame:
    """Rows (doc_id, item_id, share): pages with any verified window of an item's passage, and how much of it they hold.

    documents: doc_id, text. items: item_id, text, suite (may be absent); of repeated item ids the greatest text counts.
    Null and empty texts, and items without a passage, give nothing; so do empty tables. Repeated documents give
    repeated rows. Letter case, markup, entities, accents, lookalike and invisible characters make no difference.
    Items are indexed in blocks, each of which is one pass over the documents; the result is the same for any size of the blocks.
    """
    spark = documents.sparkSession
    suite = F.coalesce(F.col("suite").cast("string"), F.lit("")) if "suite" in items.columns else F.lit("")
    slim = items.where("item_id is not null and text is not null").select("item_id", suite.alias("suite"), "text")
    slim = cut_lineage(slim.groupBy("item_id").agg(F.max(F.struct("text", "suite")).alias("x")).select("item_id", "x.*"))
    instructions = shared_instructions(slim)
    vocabulary = vocabulary_of(slim, instructions)
    blocks = -(-slim.count() // items_per_block)
    out = None
    for b in range(blocks if vocabulary else 0):
        part = slim.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).toPandas()  # about items_per_block rows
        index = spark.sparkContext.broadcast(build_index(part, instructions, vocabulary))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = list(leaks_in(index.value, pdf.text)) if index.value else []
                yield pd.DataFrame(
                    {"doc_id": pdf.doc_id.to_numpy()[[r[0] for r in rows]], "item_id": [r[1] for r in rows], "share": [r[2] for r in rows]}
                )

        found = documents.select(F.col("doc_id").cast("bigint"), "text").mapInPandas(search, "doc_id bigint, item_id bigint, share double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "doc_id bigint, item_id bigint, share double")


def find_leaks(documents: DataFrame, items: DataFrame, share: float = SHARE) -> DataFrame:
    """Rows (doc_id, item_id), each once: the pages that hold at least ``share`` of an item's passage."""
    return leak_shares(documents, items).where(F.col("share") >= share).select("doc_id", "item_id").distinct()
