import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import tidemark.llm.subjects as s
from tidemark.llm.subjects import assign_subjects, calibrated_evidence, clean_labels, labelled_pages, mine_rules, page_lines, transactions

AREAS = {"law": ["clause", "court order", "licence"], "sport": ["penalty", "corner kick", "goal"], "money": ["invoice", "tax return", "ledger"]}
PLAIN = ["Please read the whole page.", "No answer is also an answer, e.g. on a holiday.", "The numbers were looked at again."]
PATTERNS = ["The {a} sits next to the {b} here.", "Ask who owns the {a} before the {b} moves.", "A {a} ages badly, i.e. like a {b} does."]
DOCS = "doc_id bigint, text string, lang string, subject string"


def sentence(rng, subject):
    a, b = rng.sample(AREAS[subject], 2)
    return rng.choice(PATTERNS).format(a=a, b=b)


def page(rng, mix, n=16):
    body = [sentence(rng, t) for t, share in mix.items() for _ in range(round(share * n))] + rng.sample(PLAIN, 2)
    rng.shuffle(body)
    return "---\ntitle: x\n---\n# Heading of the goal\n" + " ".join(body[:6]) + "\n\n- " + "\n- ".join(body[6:])


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(n):
        a, b = rng.sample(sorted(AREAS), 2)
        mix = rng.choice([{a: 1.0}, {a: 0.875, b: 0.125}, {a: 0.5, b: 0.5}])
        truth[i] = {t for t, share in mix.items() if share >= 0.25}
        rows.append((i, page(rng, mix), "en", "clash"))
    return rows, truth


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    labels = [(i, f" {t.upper()} ", "ann") for i in range(0, 120) for t in truth[i]] + [(5, "nonsense", "ann"), (None, "law", ""), (6, None, ""), (999, "law", "")]
    labels += labels[:20]
    areas = spark.createDataFrame([(t, "") for t in AREAS], "subject string, note string")
    got = {}
    out = assign_subjects(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string"), areas).collect()
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert len(out) == sum(map(len, got.values())) and set(got) == set(truth)
    held_out = [i for i in truth if i >= 120]
    assert sum(got[i] == truth[i] for i in held_out) >= 0.95 * len(held_out)


def test_every_page_has_a_subject(spark):
    rows, truth = corpus(n=60)
    odd = [(1000, None, None, ""), (1001, "", "en", ""), (1002, "\r\n", "en", ""), (1003, "Nothing known.", "en", ""), (1004, sentence(random.Random(1), "sport") * 20000, "en", "")]
    labels = spark.createDataFrame([(i, t) for i in truth for t in truth[i]], "doc_id bigint, subject string")
    areas = spark.createDataFrame([(t,) for t in AREAS], "subject string")
    got = assign_subjects(spark.createDataFrame(rows + odd, DOCS).drop("lang"), labels, areas).where("doc_id >= 1000").collect()
    assert {r.doc_id for r in got} == {1000, 1001, 1002, 1003, 1004}
    assert [r.subject for r in got if r.doc_id == 1004] == ["sport"]


def test_empty_tables(spark):
    rows, truth = corpus(n=20)
    docs, areas = spark.createDataFrame(rows, DOCS), spark.createDataFrame([(t,) for t in AREAS], "subject string")
    labels = spark.createDataFrame([(i, t) for i in truth for t in truth[i]], "doc_id bigint, subject string")
    assert assign_subjects(docs.limit(0), labels, areas).count() == 0
    assert assign_subjects(docs, labels.limit(0), areas).count() == 0
    assert assign_subjects(docs, labels, areas.limit(0)).count() == 0


def test_rules_match_counting_by_hand(spark):
    """Confidence, lift and pruning of single words and pairs, against plain counting."""
    rows, truth = corpus(n=150)
    labels = spark.createDataFrame([(i, t) for i in truth for t in truth[i]], "doc_id bigint, subject string")
    clean = clean_labels(labels, spark.createDataFrame([(t,) for t in AREAS], "subject string"))
    sentences = transactions(labelled_pages(spark.createDataFrame(rows, DOCS), clean))
    data = [(set(r.words), {x.removeprefix(s.LABEL) for x in r.subjects}) for r in sentences.collect()]
    share = {t: sum(t in own for _, own in data) / len(data) for t in AREAS}
    for r in mine_rules(sentences).collect():
        with_words = [own for w, own in data if set(r.words) <= w]
        both = sum(r.subject in own for own in with_words)
        due = (share[r.subject] * len(data) + s.PRIOR_COUNT * share[r.subject]) / (len(data) + s.PRIOR_COUNT)
        confidence = (both + s.PRIOR_COUNT * due) / (len(with_words) + s.PRIOR_COUNT)
        assert r.weight == pytest.approx(math.log(confidence / due), abs=0.02)
        assert confidence >= s.LIFT * due * 0.99
        for part in combinations(r.words, len(r.words) - 1):
            if part:
                smaller = [own for w, own in data if set(part) <= w]
                of_part = (sum(r.subject in own for own in smaller) + s.PRIOR_COUNT * due) / (len(smaller) + s.PRIOR_COUNT)
                assert confidence >= of_part + s.GAIN - 0.01 or of_part < s.LIFT * due


def test_least_evidence_follows_held_out_labels(spark, monkeypatch):
    """Where the usual value asks for too much, the labels call for a lower one; where it serves, it stays, even if some labels are wrong."""
    rows, truth = corpus(n=300)
    wrong = {i: {"law"} if i % 10 == 0 else t for i, t in truth.items()}
    labels = spark.createDataFrame([(i, t) for i in truth for t in wrong[i]], "doc_id bigint, subject string")
    clean = clean_labels(labels, spark.createDataFrame([(t,) for t in AREAS], "subject string"))
    pages = labelled_pages(spark.createDataFrame(rows, DOCS), clean)
    held = pages.where("is_held_out")
    assert 30 <= held.count() <= 90
    rules = mine_rules(transactions(pages.where("not is_held_out"))).toPandas()
    book = spark.sparkContext.broadcast(s.RuleBook(rules, sorted(set(rules.subject))))
    assert calibrated_evidence(held, book, s.SHARE, 0) == s.EVIDENCE
    assert calibrated_evidence(held.limit(0), book, s.SHARE, 0) == s.EVIDENCE
    monkeypatch.setattr(s, "EVIDENCE", 50.0)
    assert calibrated_evidence(held, book, s.SHARE, 0) < 2


def test_lines_are_the_sentences(spark):
    text = "---\r\ntitle: t\r\n---\r\n# Head\r\nOne two, e.g. three. Four <b>five</b>! **Six.** Seven?\r\n```\ncode. here\n```\n| 1 | Cell one. |\n- Item no. 7 here.\n{{% alert %}}\nIn it.\n{{% /alert %}}\n"
    got = spark.createDataFrame([(text,)], "t string").select(page_lines(F.col("t")).alias("x")).first().x
    kept = [" ".join(x.split()).strip("*") for x in got.split("\n") if x.strip()]
    assert kept == ["One two, e.g. three.", "Four five!", "Six.", "Seven?", "1", "Cell one.", "Item no.", "7 here.", "In it."]
