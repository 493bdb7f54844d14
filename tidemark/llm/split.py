"""Splitting oversized texts at natural boundaries by pointer doubling.

Every boundary knows its farthest legal successor, the overlap included. Squaring the successor table
doubles the distance that it covers, so all greedy cuts of all texts are known after as many rounds
as the longest text has doublings.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.tokens import spaced_tokens, token_count, token_marks
from tidemark.session import cut_lineage

LIMIT = 512
OVERLAP = 77
#: How far before its due place an overlap may begin, so that it begins with a sentence.
LEEWAY = 20

# Shortenings whose full stop ends no sentence.
SHORTENINGS = ("e.g", "i.e", "no", "approx", "etc", "vs", "cf", "fig", "dr", "mr", "mrs", "ms", "st", "inc", "bzw", "z.b", "p. ej", "ca")

#: Stands where a text may be cut, while boundaries are looked for; a text's own is read as its neighbour, one token like it.
MARK, NEIGHBOUR = "\ue000", "\ue001"


def marked(text: Column) -> Column:
    """text with a mark wherever a new sentence, line or paragraph begins.

    Every pattern starts at the sign that ends a sentence or line, so that nothing else is tried at other places.
    """
    short = "|".join(re.escape(s) for s in SHORTENINGS)
    sentence = r"[.!?…][\"'”’)\]*_]{0,3}[ \t]{1,3}(?=[^\s\p{Ll}])"
    own = F.when(text.contains(MARK), F.translate(text, MARK, NEIGHBOUR)).otherwise(text)
    begins = F.regexp_replace(own, rf"{sentence}|[。！？](?=[^\s。！？])|[\r\n](?=[^\s])", f"$0{MARK}")
    return F.regexp_replace(begins, rf"(?i)(\.[ \t]{{1,3}}){MARK}(?<=(?<![\p{{L}}\p{{N}}])(?:{short})\.[ \t]{{1,3}}{MARK})", "$1")


ITEM = ("item_kind", "item_id")


def boundaries(items: DataFrame, step: int) -> DataFrame:
    """(item, node, natural): places, in tokens from the start, at which a text may be cut.

    Between natural boundaries more than ``step`` tokens apart, forced ones stand every ``step`` tokens.
    Only counts leave the rows, no text.
    """
    counts = F.transform(F.split(token_marks(marked(F.col("text"))), MARK), F.length)
    each = items.select(*ITEM, F.posexplode(counts).alias("n", "tokens")).where("tokens > 0")
    node = F.sum("tokens").over(Window.partitionBy(*ITEM).orderBy("n"))
    ends = each.withColumn("node", node.cast("int"))
    start = F.col("node") - F.col("tokens")
    inner = F.when(
        F.col("tokens") > step, F.transform(F.sequence(F.lit(1), ((F.col("tokens") - 1) / step).cast("int")), lambda k: (start + k * step).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    spots = F.concat(
        F.array(F.struct(F.col("node").alias("node"), F.lit(True).alias("natural"))),
        F.transform(inner, lambda x: F.struct(x.alias("node"), F.lit(False).alias("natural"))),
    )
    return ends.select(*ITEM, F.explode(spots).alias("s")).select(*ITEM, "s.*")


def successors(nodes: DataFrame, limit: int, overlap: int, leeway: int) -> DataFrame:
    """(item, node, start, next): where the piece after a cut begins, and the farthest cut that it may end at.

    A piece begins ``overlap`` tokens before the cut, or up to ``leeway`` more where a natural boundary is there.
    It ends at the farthest natural boundary within the limit, else at the farthest forced one.
    The last cut is its own successor.
    """
    first = nodes.groupBy(*ITEM).agg(F.lit(0).alias("node"), F.lit(True).alias("natural"))
    w = Window.partitionBy(*ITEM).orderBy("node")
    natural = F.when(F.col("natural"), F.col("node"))
    begin = F.max(natural).over(w.rangeBetween(-(overlap + leeway), -overlap))
    n = nodes.unionByName(first).withColumn("start", F.when(F.col("node") == 0, 0).otherwise(F.coalesce(begin, F.greatest(F.col("node") - overlap, F.lit(0)))))
    either = lambda *c: n.select(*ITEM, *c)
    nothing = F.lit(None).cast("int")
    spots = either(F.col("node").alias("at"), F.lit(0).alias("asks"), nothing.alias("node"), nothing.alias("start"), natural.alias("nat"), F.col("node").alias("spot"))
    asks = either((F.col("start") + limit).alias("at"), F.lit(1).alias("asks"), "node", "start", nothing.alias("nat"), nothing.alias("spot"))
    upto = Window.partitionBy(*ITEM).orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    seen = spots.unionByName(asks).withColumn("nat", F.max("nat").over(upto)).withColumn("spot", F.max("spot").over(upto))
    farthest = F.when(F.col("nat") > F.col("node"), F.col("nat")).otherwise(F.col("spot"))
    return seen.where("asks = 1").select(*ITEM, "node", "start", farthest.alias("next"))


def greedy_cuts(table: DataFrame, rounds: int) -> DataFrame:
    """(item, node, start): all nodes that the chain of successors from 0 passes, by squaring the successor table.

    After round k the table leads 2^k cuts on, and the first 2^k cuts of every text are known. Both are settled in one
    self-join and one aggregate: a node that is known to be a cut makes one of the node that it leads to. Nodes that are no cut and to
    which none leads any more can't become one and are left out, so the table soon is hardly more than the cuts.
    """
    state = table.select(*ITEM, "node", "start", "next", (F.col("node") == 0).alias("is_cut"))
    nothing, no, yes = F.lit(None).cast("int"), F.lit(False), F.lit(True)
    spot = lambda node, start, to, cut, led_to: F.struct(node.alias("node"), start.alias("start"), to.alias("next"), cut.alias("is_cut"), led_to.alias("is_led_to"))
    leap = F.coalesce("after", "next")
    own = spot(F.col("node"), F.col("start"), leap, F.col("is_cut"), no)
    cut = F.when(F.col("is_cut"), F.array(spot(F.col("next"), nothing, nothing, yes, yes))).otherwise(F.array())
    for k in range(rounds):
        if k == rounds - 1:  # the table need not lead any farther
            spots = state.where("is_cut").withColumn("after", nothing).select(*ITEM, F.explode(F.concat(F.array(own), cut)).alias("s"))
            starts = state.select(*ITEM, spot(F.col("node"), F.col("start"), F.col("next"), no, no).alias("s"))
            spots = spots.unionByName(starts)
        else:
            seen = state.join(state.select(*ITEM, F.col("node").alias("next"), F.col("next").alias("after")), [*ITEM, "next"], "left")
            spots = seen.select(*ITEM, F.explode(F.concat(F.array(own, spot(leap, nothing, nothing, no, yes)), cut)).alias("s"))
        merged = spots.select(*ITEM, "s.*").groupBy(*ITEM, "node").agg(*[F.max(c).alias(c) for c in ("start", "next", "is_cut", "is_led_to")])
        state = cut_lineage(merged.where("is_cut or is_led_to").drop("is_led_to"))
    return state.where("is_cut").select(*ITEM, "node", "start")


def split_oversized(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Rows (item_kind, item_id, piece, pieces, text, token_count, overlap_tokens).

    items: item_kind, item_id (together unique), text. An item within the limit comes back whole as its only piece.
    A longer one is cut greedily: each piece is of at most ``limit`` tokens, ends at the farthest paragraph, line
    or sentence end within reach or, where there is none, after a token, and repeats at least ``overlap`` tokens of
    the piece before. Pieces without their overlaps, put together, are the text; token_count is counted, never copied.

    A null text gives no piece; an empty or blank one gives one piece of 0 tokens. Of repeated ids
    one row counts, that with the greatest text. Empty input gives no rows; other columns are not used.
    """
    one = items.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(*ITEM, "text")
    if one.groupBy(*ITEM).count().where("count > 1").take(1):  # texts move for it only where ids do repeat
        one = one.groupBy(*ITEM).agg(F.max("text").alias("text"))
    sized = one.withColumn("tokens", token_count(F.col("text")))
    whole = sized.where(F.col("tokens") <= limit).select(
        *ITEM, F.lit(0).alias("piece"), F.lit(1).alias("pieces"), "text", F.col("tokens").alias("token_count"), F.lit(0).alias("overlap_tokens")
    )
    cuts = oversized_cuts(sized.where(F.col("tokens") > limit), limit, overlap)
    order = Window.partitionBy(*ITEM).orderBy("node")
    ranges = cuts.withColumn("prior", F.lag("node").over(order)).withColumn("begin", F.lag("start").over(order)).where("node > 0")
    lists = ranges.groupBy(*ITEM).agg(F.sort_array(F.collect_list(F.struct("node", "prior", "begin"))).alias("cuts"))  # the pieces of one text
    made = (
        one.where(F.length("text") > limit)  # a text has no more tokens than characters; which texts have cuts is known
        .join(lists, list(ITEM))
        .withColumn("parts", spaced_tokens(F.col("text")))
        .withColumn("lead", F.regexp_extract("text", r"^[ \t\r\n]*", 0))
        .select(*ITEM, F.posexplode("cuts").alias("piece", "c"), F.size("cuts").alias("pieces"), "parts", "lead")
    )
    body = F.array_join(F.slice("parts", F.col("c.begin") + 1, F.col("c.node") - F.col("c.begin")), "")
    cut = made.select(
        *ITEM,
        "piece",
        "pieces",
        F.when(F.col("piece") == 0, F.concat("lead", body)).otherwise(body).alias("text"),
        (F.col("c.node") - F.col("c.begin")).alias("token_count"),
        (F.col("c.prior") - F.col("c.begin")).alias("overlap_tokens"),
    )
    return whole.unionByName(cut)


def oversized_cuts(oversized: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item, node, start) of the texts over the limit: their greedy cuts, 0 included, and where the piece after each begins."""
    if overlap + LEEWAY >= limit:
        raise ValueError("the overlap leaves no room within the limit")
    step = limit - overlap - LEEWAY
    nodes = cut_lineage(boundaries(oversized, step))  # read four times below; the texts are split once
    table = cut_lineage(successors(nodes, limit, overlap, LEEWAY))
    longest = table.agg(F.max("node")).first()[0] or 0
    # two cuts in a row pass more than a step, or the first would have reached farther
    rounds = math.ceil(math.log2(2 * longest / step + 3))
    return greedy_cuts(table, rounds)
