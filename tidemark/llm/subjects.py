"""Subject areas of pages, by class-association rules mined with parallel FP-growth.

Sentences of labelled pages are transactions of words and their pages' subjects. Rules from words to a subject are
pruned to those that say more than their own parts, and a sentence is on the subject for which the rules that match
it give the most evidence. How much is enough is calibrated on labelled pages held out from mining. A page has the subjects of at least
a quarter of its sentences on any subject.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.times import neutral
from tidemark.llm.words import DROPPED, SLICE, fold_text, hash_words, keep_lines
from tidemark.session import cut_lineage

#: Labelled pages, at most about so many, from which rules are mined and, of one in HELD_OUT, the least evidence is calibrated. All pages are scored.
LABELLED = 5000
HELD_OUT = 5
#: Least share of the sentences that hold a rule's words and subject.
SUPPORT = 0.0002
LEAST_COUNT = 3
#: Least confidence over the subject's share of all sentences.
LIFT = 1.6
#: What a longer rule must add to the confidence of each rule that it contains.
GAIN = 0.04
#: Sentences by which a rule's confidence is drawn to the subject's share.
PRIOR_COUNT = 2.0
#: Least evidence, as a log ratio, for a sentence to be on a subject: the usual one, and others that held-out labels may call for.
EVIDENCE = 1.3
OTHER_EVIDENCE = (0.7, 0.9, 1.1, 1.5, 1.7, 1.9)
#: Rounds in which a sentence's evidence is weighed with the rest of its page, and the sentences added to each subject for it.
ROUNDS = 1
PAGE_PRIOR = 2.0
#: Share of a page's sentences on any subject that makes a subject the page's.
SHARE = 0.25
LABEL = "subject:"


def page_lines(text: Column) -> Column:
    """The sentences of a page, one a line; front matter, code, shortcodes, tags, headings and table rules are left out."""
    t = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    t = F.regexp_replace(t, r"(?s)\A\s*---\n.*?\n---\n|```.*?(?:```|\z)|\{\{.*?\}\}", "\n")
    t = F.when(t.contains("<"), F.regexp_replace(t, r"<[^<>]{1,200}>", "")).otherwise(t)
    t = F.regexp_replace(t, r"(?m)^[ \t]*(?:#.*$|(?:[-*+]|\d+[.)])[ \t]+)|\|", "\n")
    return F.regexp_replace(t, r"([.!?…][*_\"')]{0,3})[ \t]+(?=[^\p{Ll}\s])", "$1\n")


def words_of(line: Column) -> Column:
    flat = F.lower(F.regexp_replace(line, r"[*_~`'’\\]", ""))
    return F.array_distinct(F.filter(F.split(flat, r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) > 1) & ~w.rlike(r"\d")))


def clean_labels(labels: DataFrame, areas: DataFrame) -> DataFrame:
    """(doc_id, subject) without repeats, in the spelling of the list of areas; other subjects are ignored."""
    known = areas.select(neutral("subject").alias("key"), F.col("subject").alias("subject")).where("key is not null").dropDuplicates(["key"])
    said = labels.where("doc_id is not null").select("doc_id", neutral("subject").alias("key"))
    return said.join(known, "key").select("doc_id", "subject").distinct()


def labelled_pages(documents: DataFrame, labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, lang, lines, subjects, is_held_out) of a sample of the labelled pages."""
    pages = labels.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.concat(F.lit(LABEL), "subject"))).alias("subjects"))
    share = min(1.0, most / max(1, pages.count()))
    picked = pages.where(F.pmod(F.xxhash64("doc_id", F.lit("rules")), F.lit(1 << 20)) < int(share * (1 << 20)))
    lang = F.coalesce(F.substring(neutral("lang"), 1, 2), F.lit("?"))
    held_out = F.pmod(F.xxhash64("doc_id", F.lit("held out")), F.lit(HELD_OUT)) == 0
    own = documents.join(picked, "doc_id").select("doc_id", lang.alias("lang"), F.coalesce(page_lines(F.col("text")), F.lit("")).alias("lines"), "subjects", held_out.alias("is_held_out"))
    return cut_lineage(own)  # a bounded sample, read for mining and calibration


def transactions(pages: DataFrame) -> DataFrame:
    """(doc_id, n, lang, subjects, words): each sentence of labelled pages with its page's subjects."""
    lines = pages.select("doc_id", "subjects", "lang", F.posexplode(F.split("lines", "\n")).alias("n", "line"))
    items = lines.withColumn("words", words_of(F.col("line"))).where(F.size("words") > 2)
    return cut_lineage(items.select("doc_id", "n", "lang", "subjects", "words"))  # read many times


def expected_shares(sentences: DataFrame) -> DataFrame:
    """(lang, s, share): each subject's share of the sentences in a language, drawn to its share of all."""
    pairs = sentences.select("lang", F.explode("subjects").alias("s"))
    n_all = max(1, sentences.count())
    overall = {r["s"]: r["count"] / n_all for r in pairs.groupBy("s").count().collect()}  # a row per subject of the fixed list
    langs = sentences.groupBy("lang").agg(F.count("*").alias("of_lang"))
    given = F.create_map(*[F.lit(x) for item in sorted(overall.items()) for x in item])
    grid = langs.select("lang", "of_lang", F.explode(given).alias("s", "overall"))
    both = pairs.groupBy("lang", "s").agg(F.count("*").alias("both"))
    filled = grid.join(both, ["lang", "s"], "left").fillna(0, ["both"])
    return filled.select("lang", "s", ((F.col("both") + PRIOR_COUNT * F.col("overall")) / (F.col("of_lang") + PRIOR_COUNT)).alias("share"))


def telling_words(sentences: DataFrame, least: int) -> DataFrame:
    """(word, s, expected): frequent words of which some subject has clearly more than its share, and every subject's share.

    A subject's expected share is that in the languages of the word's sentences, so that the common words of a
    language in which one subject prevails don't speak for it. Of words that always occur together one stands for all.
    """
    each = sentences.select(F.explode("words").alias("word"), "subjects", "lang", F.xxhash64("doc_id", "n").alias("at"))
    n_word = each.groupBy("word").agg(F.count("*").alias("n_word"), F.bit_xor("at").alias("places")).where(F.col("n_word") >= least)
    shares = expected_shares(sentences)
    by_lang = each.groupBy("word", "lang").agg(F.count("*").alias("m")).join(n_word.select("word", "n_word"), "word")
    due = by_lang.join(F.broadcast(shares), "lang").groupBy("word", "s").agg((F.sum(F.col("m") * F.col("share")) / F.max("n_word")).alias("expected"))
    n_both = each.select("word", F.explode("subjects").alias("s")).groupBy("word", "s").agg(F.count("*").alias("both"))
    joined = due.join(n_both, ["word", "s"], "left").fillna(0, ["both"]).join(n_word, "word")
    chance = F.col("n_word") * F.col("expected")
    clear = (F.col("both") >= LIFT * chance) & (F.col("both") - chance >= 2 * F.sqrt(chance)) & (F.col("both") >= LEAST_COUNT)
    known = joined.withColumn("clear", clear)
    one = known.where("clear").groupBy("word").agg(F.first("n_word").alias("n_word"), F.first("places").alias("places"))
    one = one.groupBy("n_word", "places").agg(F.min("word").alias("word")).select("word")
    return known.join(one, "word", "left_semi").select("word", "s", "expected")


def mine_rules(sentences: DataFrame) -> DataFrame:
    """(words, subject, weight): pruned rules, weight being the log of the drawn confidence over the expected share."""
    total = sentences.count()
    least = max(LEAST_COUNT, SUPPORT * total)
    telling = cut_lineage(telling_words(sentences, int(least)))
    kept = (
        sentences.select("doc_id", "n", F.explode("words").alias("word"))
        .join(telling.select("word").distinct(), "word")
        .groupBy("doc_id", "n")
        .agg(F.collect_list("word").alias("words"))  # the words of one sentence
    )
    baskets = kept.join(sentences.select("doc_id", "n", "subjects"), ["doc_id", "n"]).select(F.concat("words", "subjects").alias("items"))
    baskets = cut_lineage(baskets)
    n = max(1, baskets.count())
    frequent = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=1.0).fit(baskets).freqItemsets
    of = lambda keep: F.sort_array(F.filter("items", lambda x: x.startswith(LABEL) if keep else ~x.startswith(LABEL)))
    sets = frequent.select(of(False).alias("words"), of(True).alias("subjects"), "freq")
    sets = cut_lineage(sets.where("size(words) > 0 and size(subjects) <= 1"))
    bodies = sets.where("size(subjects) = 0").select("words", F.col("freq").alias("n"))
    heads = sets.where("size(subjects) = 1").select("words", F.col("subjects")[0].alias("s"), F.col("freq").alias("both"))
    due = heads.select("words", "s", F.explode("words").alias("word")).join(telling, ["word", "s"]).groupBy("words", "s").agg(F.max("expected").alias("share"))
    rules = heads.join(bodies, "words").join(due, ["words", "s"])
    drawn = (F.col("both") + PRIOR_COUNT * F.col("share")) / (F.col("n") + PRIOR_COUNT)
    rules = cut_lineage(rules.withColumn("confidence", drawn).where(F.col("confidence") >= LIFT * F.col("share")))
    parts = rules.where("size(words) > 1").select("words", "s", "confidence", F.explode("words").alias("left_out"))
    parts = parts.withColumn("part", F.array_remove("words", F.col("left_out")))
    smaller = rules.select(F.col("words").alias("part"), "s", F.col("confidence").alias("part_confidence"))
    idle = parts.join(smaller, ["part", "s"]).where(F.col("confidence") < F.col("part_confidence") + GAIN).select("words", "s").distinct()
    return rules.join(idle, ["words", "s"], "left_anti").select(
        "words", F.expr(f"substring(s, {len(LABEL) + 1})").alias("subject"), F.log(F.col("confidence") / F.col("share")).alias("weight")
    )


class RuleBook:
    """Pruned rules as arrays: single words and longer rules, by the hashes of their words."""

    def __init__(self, rules: pd.DataFrame, subjects: list[str]):
        self.subjects = subjects
        at = {s: i for i, s in enumerate(subjects)}
        weights: dict[tuple[int, ...], np.ndarray] = {}
        for words, subject, weight in zip(rules.words, rules.subject, rules.weight, strict=True):
            hashes = tuple(sorted({int(h) for w in words for h in hash_words(fold_text(w).translate(keep_lines, DROPPED))[0]}))
            weights.setdefault(hashes, np.zeros(len(subjects)))[at[subject]] = weight
        self.words = np.unique(np.array([h for body in weights for h in body], np.uint64))
        self.single = np.zeros((len(self.words), len(subjects)))
        longer = []
        for body, w in weights.items():
            spots = np.searchsorted(self.words, np.array(body, np.uint64))
            if len(spots) == 1:
                self.single[spots[0]] = w
            else:
                longer.append((spots, w))
        self.size = np.array([len(s) for s, _ in longer], np.int64)
        self.longer = np.array([w for _, w in longer]).reshape(-1, len(subjects))
        pairs = sorted((int(s), r) for r, (spots, _) in enumerate(longer) for s in spots)
        self.rule = np.array([r for _, r in pairs], np.int64)
        self.rules_upto = np.searchsorted(np.array([s for s, _ in pairs], np.int64), np.arange(len(self.words) + 1))

    def evidence(self, line: np.ndarray, words: np.ndarray, lines: int) -> np.ndarray:
        """Evidence for each subject of each line, given (line, hash) of all words."""
        out = np.zeros((lines, len(self.subjects)))
        if not len(self.words):
            return out
        spot = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        hit = self.words[spot] == words
        once = np.unique(line[hit] * len(self.words) + spot[hit])
        line, spot = np.divmod(once, len(self.words))
        np.add.at(out, line, self.single[spot])
        n = self.rules_upto[spot + 1] - self.rules_upto[spot]
        rule = self.rule[np.repeat(self.rules_upto[spot] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        if len(rule):
            met, count = np.unique(np.repeat(line, n) * len(self.size) + rule, return_counts=True)
            line, rule = np.divmod(met, len(self.size))
            full = count == self.size[rule]
            np.add.at(out, line[full], self.longer[rule[full]])
        return out


def page_counts(book: RuleBook, texts: list[str], least: tuple[float, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each least evidence the sentences on each subject, evidence in all) of each page, given as lines."""
    counts, sums, held, size = [[] for _ in least], [], [], 0

    def settle() -> None:
        buffer = b"\n".join(held)
        words, start = hash_words(buffer)
        ends = np.flatnonzero(np.frombuffer(buffer, np.uint8) == 10)
        line = np.searchsorted(ends, start)
        page_of_line = np.searchsorted(np.cumsum([len(b) + 1 for b in held]), np.concatenate(([0], ends + 1)), "right")
        e = book.evidence(line, words, len(ends) + 1)
        for enough, out in zip(least, counts, strict=True):
            on = e.max(1) >= enough
            page, e_on = page_of_line[on], e[on]
            chosen = e_on.argmax(1)
            for _ in range(1 + ROUNDS):
                n = np.zeros((len(held), len(book.subjects)))
                np.add.at(n, (page, chosen), 1)
                prior = np.log((n + PAGE_PRIOR) / (n.sum(1, keepdims=True) + PAGE_PRIOR * n.shape[1]))
                chosen = np.where(e_on > 0, e_on + prior[page], -np.inf).argmax(1)
            out.append(n)
        s = np.zeros((len(held), len(book.subjects)))
        np.add.at(s, page_of_line, e)
        sums.append(s)

    for t in texts:
        held.append(fold_text(t).translate(keep_lines, DROPPED))
        size += len(held[-1]) + 1
        if size >= SLICE:
            settle()
            held, size = [], 0
    if held:
        settle()
    empty = np.zeros((0, len(book.subjects)))
    return [np.concatenate(c or [empty]) for c in counts], np.concatenate(sums or [empty])


def chosen_subjects(n: np.ndarray, evidence: np.ndarray, share: float, usual: int) -> np.ndarray:
    """Which subjects each page has: those with the share of its sentences on any, else the one with the most sentences, the most evidence, or the usual one."""
    chosen = n / np.maximum(n.sum(1), 1)[:, None] >= share
    lost = np.flatnonzero(~chosen.any(1))
    best = np.where(n[lost].any(1), n[lost].argmax(1), evidence[lost].argmax(1))
    best[~n[lost].any(1) & ~evidence[lost].any(1)] = usual
    chosen[lost, best] = True
    return chosen


def calibrated_evidence(held_out: DataFrame, book: Broadcast, share: float, usual: int) -> float:
    """The least evidence under which most held-out pages get exactly their labelled subjects.

    held_out: lines, subjects (with LABEL in front), a bounded sample. Labels may be wrong, so another value than the usual one is only taken if it
    is right on clearly more pages than it is wrong on where the two differ: by over two standard errors.
    """
    least = (EVIDENCE, *OTHER_EVIDENCE)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = {LABEL + s: i for i, s in enumerate(book.value.subjects)}
            said = np.zeros((len(pdf), len(at)), bool)
            for row, own in enumerate(pdf.subjects):
                said[row, [at[s] for s in own if s in at]] = True
            n, evidence = page_counts(book.value, pdf.lines.tolist(), least)
            right = [(chosen_subjects(c, evidence, share, usual) == said).all(1) for c in n]
            yield pd.DataFrame({"least": least, "gained": [int((r & ~right[0]).sum()) for r in right], "spoilt": [int((right[0] & ~r).sum()) for r in right]})

    sums = held_out.select("lines", "subjects").mapInPandas(compare, "least double, gained bigint, spoilt bigint")
    rows = sums.groupBy("least").agg(F.sum("gained").alias("gained"), F.sum("spoilt").alias("spoilt")).collect()  # a row per value
    better = [(r["gained"] - r["spoilt"], -abs(r["least"] - EVIDENCE), r["least"]) for r in rows if r["gained"] - r["spoilt"] > 2 * (r["gained"] + r["spoilt"]) ** 0.5]
    return max(better)[2] if better else EVIDENCE


def assign_subjects(documents: DataFrame, labels: DataFrame, areas: DataFrame, most_labelled: int = LABELLED, share: float = SHARE) -> DataFrame:
    """Rows (doc_id, subject, sentences, share): the subjects of every page and how much of it is on them.

    documents: doc_id, text, lang (may be absent). labels: doc_id, subject, spelt anyhow, wrong, repeated or of pages that aren't there.
    areas: subject, a short fixed list. Every page gets at least one subject: a page without a sentence on any takes
    that with the most evidence in all, and failing that (as for a null or empty text) the most frequent
    of the rules. Repeated pages give repeated rows. Without areas, documents or usable labels there are no rows.
    """
    spark = documents.sparkSession
    clean = clean_labels(labels, areas)
    lang = "lang" if "lang" in documents.columns else F.lit(None).cast("string").alias("lang")
    pages = labelled_pages(documents.select("doc_id", "text", lang), clean, most_labelled)
    sentences = transactions(pages.where("not is_held_out"))
    if not sentences.take(1):  # so few labels that all are needed
        sentences = transactions(pages)
    schema = "doc_id bigint, subject string, sentences int, share double"
    rules = mine_rules(sentences).toPandas() if sentences.take(1) else pd.DataFrame({"words": [], "subject": [], "weight": []})  # bounded by the sample and the support
    if not len(rules):
        return spark.createDataFrame([], schema)
    subjects = sorted(set(rules.subject))
    book = spark.sparkContext.broadcast(RuleBook(rules, subjects))
    most = sorted(clean.groupBy("subject").count().collect(), key=lambda r: (-r["count"], r["subject"]))[0]["subject"]
    usual = subjects.index(most) if most in subjects else 0
    enough = calibrated_evidence(pages.where("is_held_out"), book, share, usual)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            (n,), evidence = page_counts(book.value, pdf.lines.tolist(), (enough,))
            row, s = np.nonzero(chosen_subjects(n, evidence, share, usual))
            part = n / np.maximum(n.sum(1), 1)[:, None]
            yield pd.DataFrame(
                {
                    "doc_id": pdf.doc_id.to_numpy()[row],
                    "subject": np.array(book.value.subjects, object)[s],
                    "sentences": n[row, s].astype(np.int32),
                    "share": part[row, s],
                }
            )

    lines = documents.select("doc_id", F.coalesce(page_lines(F.col("text")), F.lit("")).alias("lines"))
    return lines.mapInPandas(score, schema)
