import random

import numpy as np
import pandas as pd
import pytest

from tidemark.llm.leaks import BLOCKS, RADIUS, WINDOW, build_index, find_leaks, leak_shares, near_windows, passages, shared_instructions
from tidemark.llm.words import hash_words, plain_words

RNG = random.Random(11)
NAMES = ["".join(RNG.choice(["ka", "zo", "mi", "tru", "ven", "hul"]) for _ in range(3)).title() for _ in range(400)]
PATTERN = "{} moved its {} to {} after {} quiet weeks."
THINGS = ["ledger", "pipeline", "survey", "contract", "rota", "clause", "branch", "forecast"]


def sentence():
    return PATTERN.format(RNG.choice(NAMES), RNG.choice(THINGS), RNG.choice(NAMES), RNG.randint(2, 900))


ITEMS = [(i, "Read the passage and answer. " + " ".join(sentence() for _ in range(8)) + f" Question: why number {i}?") for i in range(20)]
CLEAN = [t.removeprefix("Read the passage and answer. ").split(" Question:")[0] for _, t in ITEMS]


def sentences_of(i, a, b):
    return " ".join(s + "." for s in CLEAN[i].split(".")[a:b] if s.strip())


def filler(n):
    return " ".join(sentence() for _ in range(n))


def upper_without_marks(t):
    return t.upper().replace(".", "").replace("'", "")


PAGES = {
    "whole": (filler(5) + " " + CLEAN[0] + " " + filler(5), {0}),
    "half": (filler(9) + " " + sentences_of(1, 0, 4) + " " + filler(3), {1}),
    "two places": (sentences_of(2, 0, 3) + filler(30) + sentences_of(2, 5, 8), {2}),
    "upper": (upper_without_marks(CLEAN[3]), {3}),
    "marked up": (" ".join(f"**{w}**" if k % 3 == 0 else f"<b>{w}</b>" if k % 3 == 1 else w for k, w in enumerate(CLEAN[4].split())), {4}),
    "lookalikes": (CLEAN[5].replace("e", "е").replace("o", "о").replace("a", "a​"), {5}),
    "entities": (CLEAN[6].replace(",", "&#44;").replace(".", "&#46;"), {6}),
    "touched": (CLEAN[7].replace("moved", "shifted").replace(" quiet", " calm"), {7}),
    "two items": (CLEAN[8] + "\n\n" + filler(40) + "\n\n" + CLEAN[9], {8, 9}),
    "short quotation": (filler(10) + " " + sentences_of(10, 2, 4) + " " + filler(10), set()),
    "instruction and question": ("Read the passage and answer. Question: why number 11? " + filler(10), set()),
    "similar phrasing": (filler(200), set()),
    "very long": (filler(8000) + CLEAN[12] + filler(8000), {12}),
    "empty": ("", set()),
    "null": (None, set()),
    "blank": ("\n \t", set()),
}
DOCS = "doc_id bigint, text string, item_id string"
ITEM = "item_id bigint, text string, doc_id string"


def test_finds_what_was_planted_and_no_more(spark):
    names = list(PAGES)
    docs = spark.createDataFrame([(k, PAGES[n][0], "clash") for k, n in enumerate(names)] * 2, DOCS)
    items = spark.createDataFrame([(i, t, "clash") for i, t in ITEMS + ITEMS[:3]] + [(99, None, ""), (None, "x", "")], ITEM)
    got = {(names[r.doc_id], r.item_id) for r in find_leaks(docs, items).collect()}
    assert got == {(n, i) for n, (_, want) in PAGES.items() for i in want}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, CLEAN[0], "")], DOCS), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert leak_shares(docs.limit(0), items).count() == 0
    assert leak_shares(docs, items.limit(0)).count() == 0
    assert leak_shares(docs, spark.createDataFrame([(1, "Why?"), (2, "")], "item_id bigint, text string")).count() == 0


def own_passages(spark, rows):
    pdf = pd.DataFrame([(i, "s", t) for i, t in rows], columns=["item_id", "suite", "text"])
    return passages(pdf, shared_instructions(spark.createDataFrame(pdf)))


def test_passages_leave_out_questions_and_instructions(spark):
    own = own_passages(spark, ITEMS)
    for i, c in enumerate(CLEAN):
        assert (own[i] == hash_words(plain_words(c))[0]).all()


def test_a_passage_that_many_items_share_is_kept(spark):
    rows = [(i, f"Read the passage and answer. {CLEAN[i // 3]} Question: what is {i}?") for i in range(9)]
    own = own_passages(spark, rows)
    for i in range(9):
        assert (own[i] == hash_words(plain_words(CLEAN[i // 3]))[0]).all()
    assert set(own_passages(spark, rows[:3])) == {0, 1, 2}  # one passage alone
    only = own_passages(spark, [(100 + i, "Read the passage and answer.") for i in range(4)] + rows)
    assert all(len(only[100 + i]) == 5 for i in range(4))


def test_blocks_of_items_make_no_difference(spark):
    # neighbours share a sentence, so that counts differ from block to block
    shared = [(i, f"Read the passage and answer. {CLEAN[i]} {sentences_of((i + 1) % 20, 0, 1)} Question: why {i}?") for i in range(20)]
    names = list(PAGES)
    docs = spark.createDataFrame([(k, PAGES[n][0], "clash") for k, n in enumerate(names)], DOCS)
    items = spark.createDataFrame(shared, "item_id bigint, text string")
    one, three, many = ({tuple(r) for r in leak_shares(docs, items, n).collect()} for n in (100, 7, 1))
    assert one == three == many and len(one) > 10


def test_blocks_find_every_fingerprint_within_the_radius():
    index = build_index(pd.DataFrame(ITEMS, columns=["item_id", "text"]))
    rng = np.random.default_rng(2)
    base = index.prints[rng.integers(0, len(index.prints), 300)]
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, n, replace=False)) for n in rng.integers(0, RADIUS + 4, 300)], np.uint64)
    asked = base ^ flips
    got = {(int(q), int(w)) for a, b in near_windows(index, asked) for q, w in zip(a, b, strict=True)}
    far = np.bitwise_count(asked[:, None] ^ index.prints[None, :])
    assert got == set(map(tuple, np.argwhere(far <= RADIUS).tolist())) and BLOCKS == RADIUS + 1 and WINDOW == 10


@pytest.mark.parametrize("text", ["", " ", "a", "a b", "ä ö  x\n", "日本 語", "&amp; <b>x</b>*y*", "a" * 3000 + " b"])
def test_word_hashes_depend_on_the_word_alone(text):
    words = plain_words(text).split()
    h, at = hash_words(plain_words(text))
    assert len(h) == len(at) == len(words)
    for w, x in zip(words, h, strict=True):
        assert hash_words(b"zz  " + w)[0][1] == x
