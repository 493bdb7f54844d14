import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.llm.split import LIMIT, OVERLAP, split_oversized
from tidemark.llm.tokens import TOKEN, spaced_tokens, token_count

COLUMNS = "item_kind string, item_id bigint, text string, body string"


def tokens(t):
    return re.findall(TOKEN, t)


def check(spark, texts, limit=LIMIT, overlap=OVERLAP):
    rows = [("k", i, t, "clash") for i, t in enumerate(texts)]
    got = {}
    for r in split_oversized(spark.createDataFrame(rows, COLUMNS), limit, overlap).collect():
        got.setdefault(r.item_id, []).append(r)
    for i, t in enumerate(texts):
        if t is None:
            assert i not in got
            continue
        pieces = sorted(got[i], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces))) and {p.pieces for p in pieces} == {len(pieces)}
        whole = ""
        for p in pieces:
            assert p.token_count == len(tokens(p.text)) <= limit
            if p.piece:
                assert overlap <= p.overlap_tokens <= overlap + 20
                # the text after the repeated tokens continues where the piece before ended
                cut = [m.start() for m in re.finditer(TOKEN, p.text)][p.overlap_tokens]
                assert whole.endswith(p.text[:cut])
                whole += p.text[cut:]
            else:
                whole = p.text
        assert whole == t
        assert (len(pieces) > 1) == (len(tokens(t)) > limit)
    return got


def test_round_trip_over_odd_texts(spark):
    rng = random.Random(5)
    words = ["alpha", "beta", "e.g.", "no.", "7", "x_y", "Delta", "naïve", "版は", "🙂"]
    prose = lambda n: " ".join(rng.choice(words) + (". " if rng.random() < 0.1 else "") for _ in range(n))
    texts = [None, "", " \n\t ", "one", prose(300), prose(5000), "  \r\n" + prose(900).replace(". ", ".\r\n\r\n"), "x " * 3000, "公開前に二人で読みます。" * 200, "a," * 2000, "。" * 1500, "word " * LIMIT, "word " * (LIMIT + 1)]
    check(spark, texts)


def test_small_limits(spark):
    rng = random.Random(6)
    check(spark, [" ".join(rng.choice(["a", "b.", "C", "d!"]) for _ in range(n)) for n in (59, 60, 61, 200, 999)], limit=60, overlap=5)


def test_ends_at_sentences_where_it_can(spark):
    text = " ".join(f"Sentence {i} has just a few words in it, e.g. these." for i in range(300))
    for p in check(spark, [text])[0]:
        assert p.text.rstrip().endswith("these.")
        assert p.text.startswith("Sentence")


def test_greedy_cuts_match_a_loop(spark):
    """The cuts are those of a plain greedy walk over the same boundaries."""
    from tidemark.llm.split import LEEWAY, boundaries, oversized_cuts

    rng = random.Random(7)
    texts = ["".join("w " * rng.randint(1, 700) + ". X" for _ in range(rng.randint(3, 60))) for _ in range(12)]
    df = spark.createDataFrame([("k", i, t, "") for i, t in enumerate(texts)], COLUMNS)
    nodes = {}
    for r in boundaries(df, LIMIT - OVERLAP - LEEWAY).collect():
        nodes.setdefault(r.item_id, {})[r.node] = r.natural
    cuts = {}
    for r in oversized_cuts(df).collect():
        cuts.setdefault(r.item_id, set()).add(r.node)
    for i, own in nodes.items():
        at, want = 0, {0}
        while at < max(own):
            near = [n for n, nat in own.items() if nat and at - OVERLAP - LEEWAY <= n <= at - OVERLAP]
            start = 0 if at == 0 else max(near, default=max(0, at - OVERLAP))
            reach = [n for n in own if at < n <= start + LIMIT]
            at = max([n for n in reach if own[n]] or reach)
            want.add(at)
        assert cuts[i] == want


def test_token_functions(spark):
    text = " a_b, cé\r\n-- "
    r = spark.createDataFrame([(text,), (None,)], "t string").select(token_count(F.col("t")).alias("n"), spaced_tokens(F.col("t")).alias("s")).collect()
    assert r[0].n == len(tokens(text)) and "".join(r[0].s) == text.lstrip() and r[1].n == 0


def test_repeats_empty_tables_and_bad_limits(spark):
    df = spark.createDataFrame([("k", 1, "word " * 600, ""), ("k", 1, "word " * 600, ""), ("k", None, "x", "")], COLUMNS)
    assert split_oversized(df).count() == 2
    assert split_oversized(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, limit=50, overlap=77).count()
