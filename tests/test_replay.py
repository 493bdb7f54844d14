import hashlib
import random

import pytest

from tidemark.operators import replay
from tidemark.operators.ordering import carry_forward, chain_ends, dense_ids

CHANGES = "seq bigint, commit_sha string, ts timestamp_ntz, action string, old_doc string, new_doc string, content_key int"


def bucket(key, salt):
    return int(hashlib.sha256(f"{salt}:{key}".encode()).hexdigest(), 16) % 100 < 50


class Model:
    """A plain walk over the log, one change at a time."""

    def __init__(self, t0, stubs):
        self.live, self.current, self.n, self.ops, self.stubs, self.status = set(t0), {}, {}, [], stubs, {}
        for d in t0:
            self.make(d, -1, 0)

    def count(self, name):
        self.n[name] = self.n.get(name, 0) + 1

    def make(self, doc, seq, phase):
        self.current[doc] = -1 if seq < 0 else seq * 4 + phase
        self.live.add(doc)
        self.status[doc] = ("live", None)
        self.ops.append(("upsert", doc, self.current[doc]))

    def retire(self, doc, op):
        self.ops.append((op, doc, self.current[doc]))

    def step(self, seq, action, old, new, key):
        stub = self.stubs[key]
        if action == "add" and not stub:
            self.make(new, seq, 0)
            self.count("add")
        elif action == "update" and stub:
            if new in self.live:
                self.delete(new)
        elif action == "update" and new in self.live:
            buggy = bucket(new, "mode-a-update")
            self.retire(new, "skip" if buggy else "delete")
            self.make(new, seq, 0)
            self.count("update_buggy" if buggy else "update_correct")
        elif action == "update":
            self.make(new, seq, 0)
            self.count("add_from_stub")
        elif action == "delete" and old in self.live:
            self.delete(old)
        elif action == "rename":
            if old in self.live:
                buggy = bucket(old, "mode-d-rename")
                self.retire(old, "skip" if buggy else "delete")
                self.live.discard(old)
                self.status[old] = ("renamed", new)
                self.count("rename_buggy" if buggy else "rename_correct")
            else:
                self.count("rename_degraded_to_add")
            if not stub:
                self.make(new, seq, 1)

    def delete(self, doc, name="delete"):
        self.retire(doc, "delete")
        self.live.discard(doc)
        self.status[doc] = ("deleted", None)
        self.count(name)


@pytest.mark.parametrize("seed", [1, 2])
def test_walk_matches_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    stubs = {k: k % 4 == 0 for k in range(12)}
    docs = [f"d{i}" for i in range(15)]
    log = []
    for seq in range(400):
        action = rng.choice(["add", "update", "update", "delete", "rename"])
        a, b = rng.sample(docs, 2)
        a = "d0" if rng.random() < 0.3 and b != "d0" else a
        old, new = {"add": (None, a), "update": (a, a), "delete": (a, None), "rename": (a, b)}[action]
        log.append((seq, f"c{seq // 3}", None, action, old, new, rng.randrange(12)))
    t0 = docs[:8]
    m = Model(t0, stubs)
    for seq, _, _, action, old, new, key in log:
        m.step(seq, action, old, new, key)
        if seq == 200:
            for d in sorted(m.live):
                m.make(d, seq, 2)
                m.count("reingest")
        if seq == 350:
            for d in ("d1", "d2", "d3"):
                if d in m.live:
                    m.delete(d, "erase")
                m.status[d] = ("deleted", None)
    changes = spark.createDataFrame(log, CHANGES)
    contents = spark.createDataFrame([(k, s, f"sha{k}") for k, s in stubs.items()], "content_key int, is_stub boolean, content_sha256 string")
    steps = replay.walk(
        spark.createDataFrame([(d, 1) for d in t0], "doc string, content_key int"), changes, contents,
        spark.createDataFrame([(200,)], "seq bigint"), spark.createDataFrame([(350, d) for d in ("d1", "d2", "d3")], "seq bigint, doc string"),
    ).cache()
    assert {r.outcome: r.n for r in replay.counters(steps).collect()} == m.n
    assert {r.doc: (r.status, r.renamed_to) for r in replay.final_status(steps).collect()} == m.status
    made = steps.where("made is not null").select("doc", "made").distinct()
    chunks = made.selectExpr("doc", "made", "concat(doc, '@', made) as chunk_id")
    got = sorted((r.op, r.chunk_id) for r in replay.engine_ops(steps, chunks).collect())
    assert got == sorted((op, f"{d}@{v}") for op, d, v in m.ops)
    versions = replay.minted_versions(steps, contents).collect()
    assert sorted(v.version_id for v in versions) == list(range(1, len(versions) + 1))
    assert sum(v.made is None for v in versions) == sum(n for k, n in m.n.items() if k in ("delete", "rename_buggy", "rename_correct"))


def test_status_lines(spark):
    lines = ["A\ta.md", "A\ta.png", "M\tb.md", "D\tc.md", "R100\td.md\te.md", "R90\td.png\te.md", "R90\td.md\te.png", "R90\td.png\te.png", "T\tx.md", "", None]
    got = [tuple(r) for r in replay.parse_name_status(spark.createDataFrame([(x,) for x in lines], "line string")).select("action", "old_path", "new_path").collect()]
    assert sorted(got, key=str) == sorted(
        [("add", None, "a.md"), ("update", "b.md", "b.md"), ("delete", "c.md", None), ("rename", "d.md", "e.md"), ("add", None, "e.md"), ("delete", "d.md", None)], key=str
    )


def test_dense_ids_number_everything_in_order(spark):
    df = spark.range(0, 1000).selectExpr("(id * 37) % 1000 as k", "'x' as id")
    rows = dense_ids(df, ["k"], "n", start=5).collect()
    assert sorted((r.k, r.n) for r in rows) == [(k, k + 5) for k in range(1000)]
    assert dense_ids(df.limit(0), ["k"], "n").count() == 0


def test_carry_forward_over_spans(spark):
    rng = random.Random(3)
    rows = [(rng.choice("aab"), s, rng.choice([None, None, s])) for s in range(300)] + [("c", 5, None)]
    got = {(r.k, r.seq): r.before for r in carry_forward(spark.createDataFrame(rows, "k string, seq bigint, v bigint"), "k", "seq", ["seq"], {"before": "v"}, span=16).collect()}
    last, want = {}, {}
    for k, s, v in sorted(rows, key=lambda r: r[1]):
        want[k, s] = last.get(k)
        last[k] = last.get(k) if v is None else v
    assert got == want


def test_chain_ends(spark):
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), (None, "q"), ("n", None)] + [(f"k{i}", f"k{i + 1}") for i in range(70)]
    got = {r.source: (r.end, r.steps) for r in chain_ends(spark.createDataFrame(links, "f string, t string"), "f", "t").collect()}
    want = {"a": ("d", 3), "b": ("d", 2), "c": ("d", 1), "x": (None, None), "y": (None, None), "z": (None, None), "s": (None, None)}
    assert got == want | {f"k{i}": ("k70", 70 - i) for i in range(70)}
    assert chain_ends(spark.createDataFrame([], "f string, t string"), "f", "t").count() == 0
